"""Ranked lexical search: a K2-treap over each block's term-document grid, searched by joint best-first descent.

A block is a record batch of documents. Its grid has a row for each different term (the most frequent first) and a column
for each document (the shortest first); a point is a term's impact in a document, the part of the score without the term's
weight. The K2-treap is a quadtree of which each cell holds the largest impact that no cell above it holds, with its place in
the cell, so each posting is in one cell, and no impact below is larger. Cells are stored level by level: which of the four
quarters exist (4 bits), the impact's rank among the block's different impacts, and the place in as few bytes as the level
needs. Every row of the table and every term is in the index; the index is a table, written once.

A query's terms are looked up among the block's rows. From the whole block, ranges of documents are halved, and each term's
path goes down to the cell that has its row and the range. A cell whose point is in the term's row gives that document its
exact part. A range's bound is the weighted sum of its cells' impacts and the largest part already found in it. The ranges of
the largest bound are opened first, GROUP at a time; ranges whose bound is under the query's k-th best score are left. That
score is kept from block to block of a task. Each task gives its k best of each query, and these are merged in two steps.

Terms are 64-bit hashes in the index: among a million terms of queries and a billion of documents, one pair is confused
with a probability of about 1 in 20,000.

Queries go out in slices of at most SLICE_WORDS words, whose weights and terms the driver holds and broadcasts; a further
slice is a further pass over the index.

Defined results: a null or empty text has no term; a query without terms, or none of whose terms occurs, has no results;
repeated queries (item_id and text) count once, and of one item_id with several texts each text is ranked for itself;
repeated documents are ranked each; equal scores by ascending doc_id, null first. Only doc_id and text, item_id and text are
read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textnum as T
from .common import map_arrow, materialize, table

K, SLICE_WORDS, GROUP = 20, 200_000, 128
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Parts in which the tasks' results of a query are ranked before the last step.
PARTS = 64
_BITS = np.array([bin(k).count("1") for k in range(16)], np.int64)


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers at the even places of 64."""
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << shift)) & keep
    return x


def _gather(x: np.ndarray) -> np.ndarray:
    """The even bits together: what `_spread` has spread."""
    x = x & 0x5555555555555555
    for shift, keep in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> shift)) & keep
    return x


def _narrow(level: int) -> str:
    """The type of a place in a cell of 2**level rows and columns."""
    return "<u1" if level <= 4 else "<u2" if level <= 8 else "<u4" if level <= 16 else "<u8"


@dataclass
class Treap:
    """A K2-treap: its cells level by level, the whole grid first.

    mask: which quarters of a cell exist; place: where in its cell the point is (bits of row and column in turn);
    rank: the point's value as a place in values; sizes: cells of each level.
    """

    sizes: list[int]
    mask: bytes
    place: bytes
    rank: bytes
    values: bytes

    @classmethod
    def build(cls, row: np.ndarray, col: np.ndarray, value: np.ndarray) -> Treap:
        depth = max(int(row.max(initial=0)).bit_length(), int(col.max(initial=0)).bit_length())
        code = (_spread(row) << 1) | _spread(col)
        order = np.argsort(code)
        code, value = code[order], value[order]
        levels, places, chosen = [], [], []
        for level in range(depth, -1, -1):
            if not len(code):
                break
            cell = code >> (2 * level)
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            largest = np.repeat(np.maximum.reduceat(value, starts), np.diff(np.append(starts, len(cell))))
            top = np.flatnonzero(value == largest)
            top = top[np.concatenate([[True], cell[top[1:]] != cell[top[:-1]]])]
            levels.append(cell[starts])
            places.append((code[top] & ((1 << (2 * level)) - 1)).astype(_narrow(level)).tobytes())
            chosen.append(value[top])
            rest = np.ones(len(code), bool)
            rest[top] = False
            code, value = code[rest], value[rest]
        masks = []
        for own, below in zip(levels, levels[1:] + [np.zeros(0, np.int64)]):
            parent = np.searchsorted(own, below >> 2)
            masks.append(np.bincount(parent, 1 << (below & 3), len(own)).astype(np.uint8))
        mask = np.concatenate(masks)
        mask = np.append(mask, np.uint8(0)) if len(mask) % 2 else mask
        values, rank = np.unique(np.concatenate(chosen), return_inverse=True)
        return cls([len(x) for x in levels], (mask[::2] | (mask[1::2] << 4)).tobytes(), b"".join(places), rank.astype("<u4" if len(values) > 65536 else "<u2").tobytes(), values.astype("<i8").tobytes())


class Cells:
    """A K2-treap to walk on: of each cell its mask, first quarter, and the row, column and value of its point."""

    def __init__(self, treap: Treap, depth: int):
        n = sum(treap.sizes)
        packed = np.frombuffer(treap.mask, np.uint8)
        self.mask = np.stack([packed & 15, packed >> 4], 1).ravel()[:n].astype(np.int64)
        values = np.frombuffer(treap.values, "<i8")
        self.value = values[np.frombuffer(treap.rank, "<u4" if len(values) > 65536 else "<u2")]
        self.first = 1 + np.cumsum(_BITS[self.mask]) - _BITS[self.mask]
        code = np.empty(n, np.int64)
        cell, at, done = np.zeros(1, np.int64), 0, 0
        for level, size in zip(range(depth, -1, -1), treap.sizes):
            kind = np.dtype(_narrow(level))
            place = np.frombuffer(treap.place, kind, size, at).astype(np.int64)
            at += size * kind.itemsize
            code[done : done + size] = (cell << (2 * level)) | place
            quarter = (self.mask[done : done + size, None] >> np.arange(4)) & 1
            parent, which = np.nonzero(quarter)
            cell = (cell[parent] << 2) | which
            done += size
        self.row, self.col, self.depth = _gather(code >> 1), _gather(code), depth


def postings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different terms' hashes (sorted); of each posting the term, text and occurrences; and each text's terms."""
    data, off = T.views(texts)
    h, _, _, word_off = T.words(data, off)
    n = np.diff(word_off)
    terms, term = np.unique(h, return_inverse=True)
    key, tf = np.unique(term * np.int64(len(n)) + np.repeat(np.arange(len(n)), n), return_counts=True)
    return terms, key // len(n) if len(n) else key, key % len(n) if len(n) else key, tf, n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with a term and all their terms, by batch: beginnings of runs of word bytes."""
    for b in batches:
        data, off = T.views(b["text"])
        documents = words = 0
        for i, j in T.row_blocks(off):
            own = off[i : j + 1] - off[i]
            inside = T.WORD_BYTE[data[off[i] : off[j]]] != 0
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            begins = own[:-1][np.diff(own) > 0]
            first[begins] = inside[begins]
            seen = np.concatenate([[0], np.cumsum(first)])[own]
            documents += int((np.diff(seen) > 0).sum())
            words += int(seen[-1])
        yield pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([words], pa.int64())], ["documents", "words"])


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    found = map_arrow(docs.select("text"), _counts, "documents bigint, words bigint").agg(F.sum("documents"), F.sum("words")).first()
    return found[0] or 0, found[1] or 0


def index(docs: DataFrame, documents: int, words: int) -> DataFrame:
    """A row for each block: doc_ids (the columns), terms (sorted hashes), rows (each term's), df, depth and the treap."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    layout = f"doc_ids array<{kind}>, terms binary, rows binary, df binary, depth int, sizes array<int>, mask binary, place binary, rank binary, impacts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, term, doc, tf, n = postings(b["text"])
            if not len(terms):
                continue
            order = np.argsort(n, kind="stable")
            order = order[n[order] > 0]
            col = np.zeros(len(n), np.int64)
            col[order] = np.arange(len(order))
            m = np.array([75 + 25 * x * documents // words for x in n.tolist()], np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
            df = np.bincount(term, minlength=len(terms))
            row = np.empty(len(terms), np.int64)
            row[np.argsort(-df, kind="stable")] = np.arange(len(terms))
            treap = Treap.build(row[term], col[doc], impact)
            depth = max(int(len(terms) - 1).bit_length(), int(len(order) - 1).bit_length())
            ids = b["doc_id"].take(pa.array(order))
            values = [pa.array([x], t) for x, t in ((terms.astype("<u8").tobytes(), pa.binary()), (row.astype("<u4").tobytes(), pa.binary()), (df.astype("<u4").tobytes(), pa.binary()), (depth, pa.int32()), (treap.sizes, pa.list_(pa.int32())), (treap.mask, pa.binary()), (treap.place, pa.binary()), (treap.rank, pa.binary()), (treap.values, pa.binary()))]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *values], ["doc_ids", "terms", "rows", "df", "depth", "sizes", "mask", "place", "rank", "impacts"])

    return materialize(map_arrow(docs.select("doc_id", "text"), run, layout), "index")


@dataclass
class Queries:
    """Queries of one slice: the different terms (sorted) with their weights, and of each query places of terms and repeats."""

    terms: np.ndarray
    weights: np.ndarray
    places: list[np.ndarray]
    repeats: list[np.ndarray]


class Best:
    """The k best (score, doc_id) so far of a query. least: the score that a document needs at least."""

    def __init__(self, k: int):
        self.k, self.rows, self.least, self.last = k, [], 1, None

    def add(self, scores: list[int], ids: list) -> None:
        self.rows = sorted(self.rows + [(-s, d is not None, d) for s, d in zip(scores, ids)])[: self.k]
        if len(self.rows) == self.k:
            self.least, self.last = -self.rows[-1][0], self.rows[-1][2]


def descend(cells: Cells, ids: list, lowest: list[np.ndarray] | None, rows: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Add to `best` the documents of a block that belong there, for the query's rows in it.

    lowest: by level the least id of each range of columns, by which ranges that can only tie with the k-th are left; None:
    ids that aren't such numbers, of which all ties are looked at.
    """
    part = np.zeros(len(ids), np.int64)
    level, low, node, bound = np.array([cells.depth]), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64), np.array([1 << 62])
    first = cells.row[0] == rows
    part[cells.col[0]] += (weights[first] * cells.value[0]).sum()

    def closed(lows, levels) -> None:
        """Ranges below which no term has a posting: their documents' parts are whole scores."""
        if len(lows) == 1:
            a = int(lows[0])
            cols = np.arange(a, min(a + (1 << int(levels[0])), len(part)))
        else:
            sizes = np.minimum(lows + (1 << levels), len(part)) - lows
            cols = np.repeat(lows - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cols = cols[part[cols] >= best.least]
        if len(cols) > best.k:
            least = np.partition(part[cols], -best.k)[-best.k]
            cols = cols[part[cols] >= least]
        if len(cols):
            best.add(part[cols].tolist(), [ids[c] for c in cols.tolist()])

    while len(level):
        keep = bound >= best.least
        if lowest is not None and best.last is not None and (tied := keep & (bound == best.least)).any():
            keep[tied] = [lowest[a][b >> a] < best.last for a, b in zip(level[tied].tolist(), low[tied].tolist())]
        if not keep.all():
            level, low, node, bound = level[keep], low[keep], node[keep], bound[keep]
        if len(level) > GROUP:
            order = np.argpartition(-bound, GROUP)
            now, later = order[:GROUP], order[GROUP:]
            held = level[later], low[later], node[later], bound[later]
            level, low, node = level[now], low[now], node[now]
        else:
            held = level[:0], low[:0], node[:0], bound[:0]
        if not len(level):
            break
        level = level - 1
        mask = np.where(node >= 0, cells.mask[node], 0)
        quarter = ((rows >> level[:, None]) & 1) << 1
        low = np.concatenate([low, low + (1 << level)])
        level = np.concatenate([level, level])
        child = []
        for bit in (0, 1):
            q = quarter | bit
            child.append(np.where((mask >> q) & 1, cells.first[node] + _BITS[mask & ((1 << q) - 1)], -1))
        node = np.concatenate(child)
        inside = low < len(part)
        level, low, node = level[inside], low[inside], node[inside]
        there = node >= 0
        r, t = np.nonzero(there & (cells.row[node] == rows))
        found = node[r, t]
        np.add.at(part, cells.col[found], weights[t] * cells.value[found])
        open_ = there.any(1) & (level > 0)
        if not open_.all():
            closed(low[~open_], level[~open_])
            level, low, node, there = level[open_], low[open_], node[open_], there[open_]
        bound = (np.where(there, cells.value[node], 0) * weights).sum(1)
        if len(level):
            most = np.array([part[a : a + (1 << b)].max() for a, b in zip(low.tolist(), level.tolist())])
            bound = bound + most
        level, low, node, bound = (np.concatenate(x) for x in zip((level, low, node, bound), held))


def _minima(ids: np.ndarray, depth: int) -> list[np.ndarray]:
    """By level the least id of each aligned range of columns."""
    out = [ids]
    for _ in range(depth):
        x = out[-1]
        out.append(np.minimum.reduceat(x, np.arange(0, len(x), 2)))
    return out


def search(built: DataFrame, items: DataFrame, documents: int, k: int = K, max_words: int = SLICE_WORDS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item, from `index`'s table and its number of documents."""
    spark = built.sparkSession
    rows = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(TERM)))).first()[0] or 0
    doc_kind = built.schema["doc_ids"].dataType.elementType.simpleString()
    slices = max(1, -(-words // max_words))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices))
    out = None
    for number in range(slices):
        asked = rows.filter(part == number).orderBy("item_id", "text").toArrow() if slices > 1 else rows.orderBy("item_id", "text").toArrow()
        queries = _weighted(built, asked["text"], documents)
        held = spark.sparkContext.broadcast(queries)
        found = map_arrow(built, _searched(held, k), f"query int, doc_id {doc_kind}, score bigint")
        for keys in ((F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)),), ()):
            order = Window.partitionBy("query", *keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
            found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        names = spark.createDataFrame(asked.select(["item_id"]).append_column("query", pa.array(range(len(asked)), pa.int32())))
        found = found.join(F.broadcast(names), "query").select(F.col("item_id").cast(items.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def _weighted(built: DataFrame, texts: pa.ChunkedArray, documents: int) -> Queries:
    """The slice's queries; weights from how many documents hold each term."""
    data, off = T.views(texts)
    h, _, _, word_off = T.words(data, off)
    terms = np.unique(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, df in zip(b["terms"], b["df"]):
                have = np.frombuffer(own.as_py(), "<u8")
                at = np.searchsorted(have, terms)
                hit = at < len(have)
                hit[hit] = have[at[hit]] == terms[hit]
                counts = np.frombuffer(df.as_py(), "<u4")[at[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(hit), pa.int32()), pa.array(counts, pa.int64())], ["term", "df"])

    df = np.zeros(len(terms), np.int64)
    for term, n in map_arrow(built.select("terms", "df"), run, "term int, df bigint").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2.0 * documents + 2) / (2.0 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
    places, repeats = [], []
    for a, b in zip(word_off[:-1], word_off[1:]):
        found = sorted(Counter(np.searchsorted(terms, h[a:b]).tolist()).items())
        places.append(np.array([x for x, _ in found], np.int64))
        repeats.append(np.array([n for _, n in found], np.int64))
    return Queries(terms, weights, places, repeats)


def _searched(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = held.value
        best = [Best(k) for _ in queries.places]
        kind = None
        for b in batches:
            kind = b.schema.field("doc_ids").type.value_type
            for block in range(b.num_rows):
                get = lambda name: b[name][block].as_py()  # noqa: B023, E731
                terms = np.frombuffer(get("terms"), "<u8")
                at = np.searchsorted(terms, queries.terms)
                hit = (at < len(terms)) & (queries.weights > 0)
                hit[hit] = terms[at[hit]] == queries.terms[hit]
                row = np.full(len(hit), -1, np.int64)
                row[hit] = np.frombuffer(get("rows"), "<u4")[at[hit]]
                ids, depth = b["doc_ids"][block].values, get("depth")
                numbers = pa.types.is_integer(ids.type) and not ids.null_count
                lowest = _minima(ids.to_numpy(), depth) if numbers else None
                cells = Cells(Treap(get("sizes"), get("mask"), get("place"), get("rank"), get("impacts")), depth)
                names = ids.to_pylist()
                for places, repeats, own in zip(queries.places, queries.repeats, best):
                    there = row[places] >= 0
                    if there.any():
                        descend(cells, names, lowest, row[places[there]], queries.weights[places[there]] * repeats[there], own)
        if kind is not None:
            found = [(q, d, -s) for q, own in enumerate(best) for s, _, d in own.rows]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate((pa.int32(), kind, pa.int64()))], ["query", "doc_id", "score"])

    return run


def op12(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    documents, words = totals(docs)
    return search(index(docs, documents, words), table(spark, sf_dir, "benchmark"), documents)


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qt AS (SELECT i, item_id, t, count(*) AS k FROM (SELECT i, item_id, unnest(ws) AS t FROM q) GROUP BY ALL),
total AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
post AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * n_docs::DOUBLE + 2) / (2 * df::DOUBLE + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM post GROUP BY t), total),
scored AS (
  SELECT i, item_id, r, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM qt JOIN post USING (t) JOIN weight USING (t), total GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
