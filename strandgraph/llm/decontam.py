"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over every document's words.

A-Z are lower-cased; a word is a run of digits, a-z and non-ASCII characters. A window is WINDOW consecutive words of an
item, or all of an item with fewer. Document windows are rolled as 64-bit hashes, and each hit is verified on its words.
The set goes out in slices of about SLICE_WORDS benchmark words, so what the driver holds and broadcasts is bounded however
large the benchmark is; a further slice is a further pass over the rows that the one before it has written.

Defined results: a null text has no words; an item without words has no windows; a document without hits has 0 items and
the digest of the empty string; repeated rows are judged each for itself; repeated items count once by item_id; words in
windows of an item without item_id are hit, but it isn't among a document's items.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnum as T
from .common import map_arrow, materialize, table, unused

WINDOW, SLICE_WORDS, FILTER_BITS = 10, 1_000_000, 22


@dataclass
class Windows:
    """Windows of one slice of the benchmark. lengths: by window length a bitmap of hashes and the sorted hashes."""

    lengths: dict[int, tuple[np.ndarray, np.ndarray]]
    items: dict[bytes, tuple[str, ...]]  # the words, joined by spaces -> items


def _joined(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> bytes:
    return b" ".join(T.WORD_BYTE[data[a:b]].tobytes() for a, b in zip(s, e))


def build(items: pa.Table) -> Windows:
    data, off = T.views(items["text"])
    h, s, e, word_off = T.words(data, off)
    ids = items["item_id"].to_pylist()
    found: dict[int, list[int]] = defaultdict(list)
    owners: dict[bytes, set[str]] = defaultdict(set)
    n_words = np.diff(word_off)
    for length in {min(WINDOW, int(n)) for n in n_words if n}:
        x, at = T.windows(h, word_off, length)
        row = np.searchsorted(word_off, at, side="right") - 1
        for hash_, a, r in zip(x.tolist(), at.tolist(), row.tolist()):
            if length == WINDOW or n_words[r] == length:
                found[length].append(hash_)
                owners[_joined(data, s[a : a + length], e[a : a + length])].update(() if ids[r] is None else (str(ids[r]),))
    lengths = {}
    for length, hashes in found.items():
        keys = np.unique(np.array(hashes, np.uint64))
        bitmap = np.zeros(1 << FILTER_BITS, bool)
        bitmap[(keys >> T.U(64 - FILTER_BITS)).astype(np.int64)] = True
        lengths[length] = (bitmap, keys)
    return Windows(lengths, {k: tuple(sorted(v)) for k, v in owners.items()})


def slices(benchmark: DataFrame, max_words: int) -> Iterator[tuple[Windows, bool]]:
    """The benchmark's windows in slices of about so many words, and if a slice is the last; an item is in one slice.

    A slice is read and built when the one before it is done with, so the driver holds one.
    """
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    n = -(-total // max_words)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) if n > 1 else F.lit(0)
    for k in range(n):
        yield build(rows.filter(part == k).toArrow()), k == n - 1
    if not n:
        yield Windows({}, {}), True


def hits(found: Windows, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
    """Offsets of the rows' words, if each word is hit, and by row the items with occurring windows."""
    h, s, e, word_off = T.words(data, off)
    change = np.zeros(len(h) + 1, np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for length, (bitmap, keys) in found.lengths.items():
        x, at = T.windows(h, word_off, length)
        maybe = np.flatnonzero(bitmap[(x >> T.U(64 - FILTER_BITS)).astype(np.int64)])
        if not len(maybe):
            continue
        place = np.minimum(np.searchsorted(keys, x[maybe]), len(keys) - 1)
        maybe = maybe[keys[place] == x[maybe]]
        rows = np.searchsorted(word_off, at[maybe], side="right") - 1
        for a, r in zip(at[maybe].tolist(), rows.tolist()):
            owners = found.items.get(_joined(data, s[a : a + length], e[a : a + length]))  # the hash alone proves nothing
            if owners is not None:
                change[a] += 1
                change[a + length] -= 1
                items[r].update(owners)
    return word_off, np.cumsum(change[:-1]) > 0, items


def scan(docs: DataFrame, benchmark: DataFrame, max_words: int = SLICE_WORDS) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    state = f"doc_id {kind}, text string, hit array<int>, items array<string>"
    final = f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    for k, (one, last) in enumerate(slices(benchmark, max_words)):
        held = docs.sparkSession.sparkContext.broadcast(one)

        def run(batches, held=held, last=last, first=k == 0):
            for b in batches:
                data, off = T.views(b["text"])
                done = []
                for i, j in T.row_blocks(off):
                    word_off, hit, items = hits(held.value, data, off[i : j + 1])
                    for r in range(j - i):
                        own, names = hit[word_off[r] : word_off[r + 1]], items.get(r, set())
                        if not first:
                            own = own.copy()
                            own[b["hit"][i + r].as_py()] = True
                            names = names | set(b["items"][i + r].as_py())
                        if last:
                            digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
                            n = int(own.sum())
                            done.append((len(own), n, len(names), digest, n > 0))
                        else:
                            done.append((np.flatnonzero(own).astype(np.int32), sorted(names)))
                cols = list(zip(*done))
                if last:
                    yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())))], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
                else:
                    yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array(cols[0], pa.list_(pa.int32())), pa.array(cols[1], pa.list_(pa.string()))], ["doc_id", "text", "hit", "items"])

        rows = _passed(map_arrow(rows, run, final if last else state), held, last)
    return rows


def _passed(rows: DataFrame, held, last: bool) -> DataFrame:
    """The rows of a pass. All passes but the last are written, and their slice is taken from the executors."""
    if not last:
        rows = materialize(rows, "slice")
        held.destroy()
    return rows


def remove(docs: DataFrame, benchmark: DataFrame, max_words: int = SLICE_WORDS, spans: bool = False) -> DataFrame:
    """Without the contaminated documents, all columns kept; or with spans=True all documents, without the hit spans.

    A removed span runs from the first byte of its first hit word to the last byte of its last one. The places of hit words
    go with a document through all slices, and its spans are cut once, after the last.
    """
    return _cut(docs, benchmark, max_words) if spans else _drop(docs, benchmark, max_words)


def _drop(docs: DataFrame, benchmark: DataFrame, max_words: int) -> DataFrame:
    for one, last in slices(benchmark, max_words):
        held = docs.sparkSession.sparkContext.broadcast(one)

        def run(batches, held=held):
            for b in batches:
                data, off = T.views(b["text"])
                keep = np.ones(b.num_rows, bool)
                for i, j in T.row_blocks(off):
                    word_off, hit, _ = hits(held.value, data, off[i : j + 1])
                    keep[i + np.searchsorted(word_off, np.flatnonzero(hit), side="right") - 1] = False
                yield b.filter(pa.array(keep))

        docs = _passed(map_arrow(docs, run, docs.schema), held, last)
    return docs


def _cut(docs: DataFrame, benchmark: DataFrame, max_words: int) -> DataFrame:
    final = docs.schema
    (name,) = unused(docs.columns, "hit")
    rows = docs.withColumn(name, F.array().cast("array<int>"))
    for one, last in slices(benchmark, max_words):
        held = docs.sparkSession.sparkContext.broadcast(one)

        def run(batches, held=held, last=last):
            for b in batches:
                data, off = T.views(b["text"])
                found: list[np.ndarray] = []
                for i, j in T.row_blocks(off):
                    word_off, hit, _ = hits(held.value, data, off[i : j + 1])
                    found += [np.flatnonzero(hit[word_off[r] : word_off[r + 1]]) for r in range(j - i)]
                had = b[name]
                found = [np.union1d(x, y.values.to_numpy()) if len(y.values) else x for x, y in zip(found, had)]
                if not last:
                    yield b.set_column(b.schema.get_field_index(name), b.schema.field(name), pa.array(found, pa.list_(pa.int32())))
                    continue
                at = b.schema.get_field_index("text")
                texts = [_without(data[off[k] : off[k + 1]], x) if len(x) else t.as_py() for k, (x, t) in enumerate(zip(found, b["text"]))]
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                yield b.select([c for c in b.schema.names if c != name])

        rows = _passed(map_arrow(rows, run, final if last else rows.schema), held, last)
    return rows


def _without(data: np.ndarray, places: np.ndarray) -> str:
    _, s, e, _ = T.words(data, np.array([0, len(data)]))
    hit = np.zeros(len(s), np.int8)
    hit[places] = 1
    edge = np.diff(np.concatenate([[0], hit, [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        out.append(data[at : s[a]].tobytes())
        at = int(e[b - 1])
    return b"".join([*out, data[at:].tobytes()]).decode()


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove(docs, table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS t(i) WHERE len(ws) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM w, lens, unnest(range(1, len(ws) - n + 2)) AS t(i) WHERE len(ws) >= n),
hit AS (SELECT doc_id, item_id, i, bw.n FROM dw JOIN bw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
