"""Spelling variants: the vocabulary's minimised acceptor, composed with a one-edit transducer and the acceptor again.

Words are counted over all documents. Two words are near if one inserted, deleted or replaced code point turns one into the
other. With m the length of the shorter and p the length of their common prefix, such a pair agrees before p and after the
edit at p, so the composition falls apart by the states that p's range begins and ends at: a cell (m, range lo..hi of p,
prefix before lo, suffix after hi) holds the words of length m and m + 1 with this prefix and suffix, and a pair lies in the
one cell whose range has its p. Each word begins in the cells of both halves of its length. A cell of more than CELL words
has its range cut in two again, and so on, so no cell is large: with a range of one place all its words differ there only.

For each cell a worker builds the minimised acceptor of what lies between prefix and suffix, numbers its words by rank, and
composes: while no edit is made, both copies of the acceptor are in one state; there two symbols that differ are a
replacement, and a symbol that one copy reads alone an insertion (its other copy's next symbol differs, so a pair is found
at its p alone); after that, the words accepted from both states are those of their intersection, kept for each pair of
states. Of a cell a row for each word with partners is returned (their number, the most frequent), never the pairs.

A word's form is its near word of largest count (ties: smallest in code-point order) if that is `ratio` times its own.

Defined results: null texts have no words; a null doc_id counts as the empty string; repeated rows count each; an empty
table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, materialize, table

LEAST_CHARS, LEAST_COUNT, RATIO, ONE_IN = 7, 2, 10, 31
#: Words of a cell that one acceptor is built of.
CELL = 50_000
LETTERS = r"[A-Za-zÀ-ÿ]"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """The minimal deterministic acceptor of sorted, different words. States are numbered so that targets come first.

    next: by state its symbols' targets, with the rank of the first word behind each; final, size: if a state accepts, and
    how many words are accepted from it. The rank of a word is its place in the sorted list.
    """

    def __init__(self, words: list[str]):
        self.next: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list, list[bool]]] = [([], [False])]  # states of the last word: (symbols and targets, if it accepts)

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                arcs, final = path.pop()
                key = (final[0], *arcs)
                state = known.get(key)
                if state is None:
                    known[key] = state = self._add(arcs, final[0])
                path[-1][0].append((last[len(path) - 1], state))

        last = ""
        for word in words:
            common = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                common += 1
            close(common)
            path.extend(([], [False]) for _ in range(len(word) - common))
            path[-1][1][0] = True
            last = word
        close(0)
        self.start = self._add(path[0][0], path[0][1][0])

    def _add(self, arcs: list, final: bool) -> int:
        rank, targets = int(final), {}
        for symbol, target in arcs:
            targets[symbol] = (target, rank)
            rank += self.size[target]
        self.next.append(targets)
        self.final.append(final)
        self.size.append(rank)
        return len(self.next) - 1


def _intersect(a: Acceptor, p: int, q: int, known: dict) -> list[tuple[int, int]]:
    """Ranks, from p and from q, of the words accepted from both."""
    stack = [(p, q)]
    while stack:
        x, y = stack[-1]
        if (x, y) in known:
            stack.pop()
            continue
        if x == y:
            known[x, y] = [(k, k) for k in range(a.size[x])]
            continue
        left, right = a.next[x], a.next[y]
        both = [(left[s], right[s]) for s in (left if len(left) <= len(right) else right) if s in left and s in right]
        missing = [(u[0], v[0]) for u, v in both if (u[0], v[0]) not in known]
        if missing:
            stack.extend(missing)
            continue
        out = [(0, 0)] if a.final[x] and a.final[y] else []
        for (u, i), (v, j) in both:
            out += [(i + f, j + g) for f, g in known[u, v]]
        known[x, y] = out
    return known[p, q]


def compose(words: list[str], at_end: bool = True) -> Iterator[tuple[int, int]]:
    """Places of the pairs of sorted, different words at one edit, each pair once; the shorter word is the first.

    at_end: with insertions behind the shorter word's last symbol.
    """
    a, known = Acceptor(words), {}
    found: list[list[tuple[int, int]]] = []
    for state, targets in enumerate(a.next):
        out = []
        arcs = list(targets.values())
        for target, rank in arcs:
            out += [(rank + i, rank + j) for i, j in found[target]]
        for k, (t, r) in enumerate(arcs):
            for u, s in arcs[k + 1 :]:  # replaced
                out += [(r + i, s + j) for i, j in _intersect(a, t, u, known)]
            for i, j in _intersect(a, state, t, known):  # inserted
                if not r <= i < r + a.size[t] and (at_end or i or not a.final[state]):
                    out.append((i, r + j))
        found.append(out)
    return iter(found[a.start])


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, one_in: int = ONE_IN) -> DataFrame:
    """word, n: runs of letters with A-Z lower-cased, of one in `one_in` (by crc32 of doc_id and run) a code point deleted."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{least_chars},}})"), F.lit(1))).alias("run"))
    runs = runs.select("id", F.translate("run", CAPITALS, SMALL).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    words = runs.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _cell(m: Column, lo: Column, hi: Column) -> list[Column]:
    """Columns of the cell of `word` for pairs with a shorter word of m and a common prefix of lo to hi - 1 code points."""
    after = F.greatest(m - hi, F.lit(0))
    size = F.char_length("word")
    key = F.concat_ws(" ", m, lo, hi, F.substr("word", F.lit(1), lo), F.substr("word", size - after + 1, after))
    return [key.alias("cell"), m.alias("m"), lo.alias("lo"), hi.alias("hi"), "word", "n"]


def _halves(lo: Column, hi: Column) -> Column:
    middle = F.shiftright(lo + hi, 1)
    return F.explode(F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi"))))


def cells(words: DataFrame, limit: int = CELL) -> DataFrame:
    """cell, m, lo, hi, word, n: each word in its cells, none of which has more than `limit` words and two places to cut."""
    size = F.char_length("word")
    m = F.explode(F.when(size > 1, F.array(size, size - 1)).otherwise(F.array(size)))
    now = words.select("word", "n", m.alias("m")).select("word", "n", "m", _halves(F.lit(0), F.col("m") + 1).alias("p"))
    now, ready = now.select(*_cell(F.col("m"), F.col("p.lo"), F.col("p.hi"))), None
    while True:
        large = now.filter("hi - lo > 1").groupBy("cell").agg(F.count("*").alias("size")).filter(F.col("size") > limit).select("cell", F.lit(True).alias("large"))
        large = materialize(large, "large")
        if large.isEmpty():
            discard(large)
            return now if ready is None else ready.unionByName(now)
        marked = materialize(now.join(large, "cell", "left"), "cells")
        small = marked.filter("large is null").drop("large")
        ready = small if ready is None else ready.unionByName(small)
        now = marked.filter("large").select("word", "n", "m", _halves(F.col("lo"), F.col("hi")).alias("p"))
        now = now.select(*_cell(F.col("m"), F.col("p.lo"), F.col("p.hi")))


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (cell, m, lo, hi, word, n), sorted by cell: for each word with partners their number and the best."""

    def grouped():
        held, own = [], None
        for b in batches:
            for cell, m, lo, hi, word, n in zip(*(b[c].to_pylist() for c in ("cell", "m", "lo", "hi", "word", "n"))):
                if cell != own:
                    if len(held) > 1:
                        yield (*place, held)  # noqa: F821
                    held, own, place = [], cell, (m, lo, hi)
                held.append((word, n))
        if len(held) > 1:
            yield (*place, held)

    out: list[tuple] = []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["word", "n", "near", "best_n", "best"])

    for m, lo, hi, held in grouped():
        if all(len(w) > m for w, _ in held):
            continue
        after = max(m - hi, 0)
        held.sort(key=lambda x: x[0][lo : len(x[0]) - after])
        near: dict[int, tuple[int, int, str]] = {}
        for i, j in compose([w[lo : len(w) - after] for w, _ in held], at_end=hi > m):
            if len(held[i][0]) > m and len(held[j][0]) > m:
                continue  # of a cell of m + 1
            for x, y in ((i, j), (j, i)):
                k, (word, n) = near.get(x), held[y]
                if k is None:
                    near[x] = (1, n, word)
                else:
                    near[x] = (k[0] + 1, *((n, word) if (-n, word) < (-k[1], k[2]) else k[1:]))
        out += [(*held[x], *k) for x, k in near.items()]
        if len(out) > 20_000:
            yield flush()
            out = []
    if out:
        yield flush()


def variants(words: DataFrame, ratio: int = RATIO, limit: int = CELL) -> DataFrame:
    """word, form, n, n_near, form_n of a written table words(word, n) with different words."""
    dealt = cells(words, limit).repartition("cell").sortWithinPartitions("cell")
    found = map_arrow(dealt, _partners, "word string, n bigint, near bigint, best_n bigint, best string")
    rows = found.unionByName(words.select("word", "n", F.lit(0).cast("bigint").alias("near"), F.lit(None).cast("bigint").alias("best_n"), F.lit(None).cast("string").alias("best")))
    rows = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("best"))
    chosen = -F.col("best.less") >= ratio * F.col("n")
    return rows.select("word", F.when(chosen, F.col("best.best")).alias("form"), "n", "n_near", F.when(chosen, -F.col("best.less")).alias("form_n"))


def with_roots(found: DataFrame) -> DataFrame:
    """A written table found(word, form, ...) with root: forms followed from word to the last. Each round doubles the steps."""
    links = found.filter("form is not null").select("word", F.col("form").alias("root"))
    own, more = None, True
    while more:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialize(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        more = not stepped.filter("moved").isEmpty()
        if own is not None:
            discard(own)
        own, links = stepped, stepped.select("word", "root")
    return found.join(links, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11(spark, sf_dir: str) -> DataFrame:
    words = materialize(vocabulary(table(spark, sf_dir, "documents")), "words")
    found = with_roots(materialize(variants(words), "variants"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents WHERE text IS NOT NULL),
counted AS (
  SELECT run, CAST(coalesce(doc_id::VARCHAR, '') AS VARCHAR) || ':' || run AS s, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(s, ''),
           lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END)),
         lambda c, b: xor(c >> 8, t[1 + xor(c, b) % 256]))) AS h FROM counted, crc),
changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS u(p)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, min({'less': -m, 'other': other}) AS b FROM pairs GROUP BY word),
found AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * n THEN b.other END AS form, CASE WHEN -b.less >= 10 * n THEN -b.less END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS here, 0 AS steps FROM found
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN found f ON f.word = c.here WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT max_by(here, steps) FROM chain c WHERE c.word = f.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM found f
"""
