"""Mixing sources to target weights by temperature, by DataFrame and SQL functions only.

Each source's share of tokens is raised to an exponent and normalised. The exponent is bisected (by sixteenths, one small
aggregate a pass) to the largest one whose weights have the target entropy; if a source would then be repeated more than
`max_repeat` times, to the smallest exponent that keeps the limit. A weight times the token budget is a source's quota.
Each pass over a source is a permutation of its documents by hash; documents are taken while the tokens before them are
below the quota. What part of its quota lies before a document decides its block, so that every block holds each source in
its weight; within a block, documents are permuted by hash.

Running sums are kept exact without gathering a source: hash prefixes split a source into small pieces, whose sums are
summed first.

Defined results: rows alike in doc_id, source and text are one unit, with their tokens summed; a null source is a source
of its own; null texts and texts without tokens have 0 tokens and go with their neighbours; equal hashes follow by text
hash. An empty table, or one without tokens, gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table, unused

#: Tokens to draw, as a part of those there are; where between the entropy of the shares and of equal weights the target lies.
BUDGET, ENTROPY, MAX_REPEAT, BLOCK_TOKENS = 1.0, 0.5, 4.0, 100_000
PIECE_ROWS = 512
TOKEN = r"[^ \t\n\x0B\f\r]+"


def _section(shares: DataFrame, good) -> float:
    """The edge in [0, 1] between exponents that are good and those that are not, where good(exponent, sum of p^a, entropy)."""
    lo, hi = 0.0, 1.0
    for _ in range(10):
        at = [lo + (hi - lo) * k / 16 for k in range(17)]
        row = shares.agg(
            *[F.sum(F.pow("p", F.lit(a))).alias(f"z{k}") for k, a in enumerate(at)],
            *[F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"u{k}") for k, a in enumerate(at)],
        ).first()
        ok = [good(a, row[f"z{k}"], math.log(row[f"z{k}"]) - a * row[f"u{k}"] / row[f"z{k}"]) for k, a in enumerate(at)]
        k = next((k for k in range(16) if ok[k] != ok[k + 1]), None)
        if k is None:
            return 1.0 if ok[0] else 0.0
        lo, hi = at[k], at[k + 1]
    return lo if ok[0] else hi


def weights(tokens: DataFrame, budget: float = BUDGET, entropy: float = ENTROPY, max_repeat: float = MAX_REPEAT) -> DataFrame | None:
    """From (source, n_tokens): source, tokens, p, weight, quota. None: there are no tokens."""
    by_source = materialize(tokens.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")).filter("tokens > 0"), "sources")
    total, n, least = by_source.agg(F.sum("tokens"), F.count("*"), F.min("tokens")).first()
    if not total:
        return None
    shares = by_source.withColumn("p", F.col("tokens") / F.lit(float(total)))
    own = shares.agg(-F.sum(F.col("p") * F.log("p"))).first()[0]
    target = own + entropy * (math.log(n) - own)
    alpha = round(_section(shares, lambda a, z, h: h >= target - 1e-12), 9)
    rare = least / total

    def within(a: float, z: float, _: float) -> bool:
        return budget * rare ** (a - 1) / z <= max_repeat

    if not within(alpha, shares.agg(F.sum(F.pow("p", F.lit(alpha)))).first()[0], 0):
        alpha = round(_section(shares, lambda a, z, h: not within(a, z, h)) + 1e-9, 9)
    z = shares.agg(F.sum(F.pow("p", F.lit(alpha)))).first()[0]
    weight = F.round(F.pow("p", F.lit(alpha)) / F.lit(z), 9)
    return shares.withColumn("weight", weight).withColumn("quota", F.floor(F.col("weight") * F.lit(float(total) * budget)))


def plan(units: DataFrame, budget: float = BUDGET, entropy: float = ENTROPY, max_repeat: float = MAX_REPEAT, block_tokens: int = BLOCK_TOKENS) -> DataFrame | None:
    """From (doc_id, source, raw, n_tokens): these columns with weight, copy, block and position, a row for each copy drawn."""
    source = weights(units, budget, entropy, max_repeat)
    if source is None:
        return None
    total = source.agg(F.sum("quota")).first()[0]
    n_blocks = max(1, -(-int(total) // block_tokens))
    # hexadecimal digits of the hash that split a source into pieces of PIECE_ROWS rows or fewer
    digits = F.greatest(F.lit(0), F.ceil(F.log(F.col("n_rows") / PIECE_ROWS) / math.log(16))).cast("int")
    source = source.select(F.col("source").alias("s"), "tokens", "weight", "quota", digits.alias("digits")).filter("quota > 0")
    rows = units.join(source, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    copies = F.sequence(F.lit(0), F.ceil(F.col("quota") / F.col("tokens")).cast("int") - 1)
    rows = rows.withColumn("copy", F.explode(copies)).withColumn("h", F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("copy").cast("string"))))
    rows = rows.withColumn("piece", F.expr("substring(h, 1, digits)"))
    key = ["source", "copy", "piece"]
    before = Window.partitionBy("source", "copy").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*key).agg(F.sum("n_tokens").alias("in_piece")).withColumn("base", F.coalesce(F.sum("in_piece").over(before), F.lit(0)))
    base = base.select(*[F.col(c).alias(f"b_{c}") for c in key], "base")
    within = Window.partitionBy(*key).orderBy("h", "raw").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(base, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("copy") == F.col("b_copy")) & (F.col("piece") == F.col("b_piece")))
    start = F.col("copy") * F.col("tokens") + F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    rows = rows.withColumn("start", start).filter("start < quota")
    rows = rows.withColumn("block", F.floor(F.col("start") / F.col("quota") * n_blocks))
    order = Window.partitionBy("block").orderBy("h", "raw")
    return rows.withColumn("position", F.row_number().over(order)).select("doc_id", "source", "raw", "n_tokens", "weight", "copy", "block", "position")


def units(docs: DataFrame) -> DataFrame:
    tokens = F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long")
    raw = F.xxhash64(F.coalesce("text", F.lit("")))
    return materialize(docs.select("doc_id", "source", raw.alias("raw"), tokens.alias("n")).groupBy("doc_id", "source", "raw").agg(F.sum("n").alias("n_tokens")), "units")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The drawn documents with all their columns and mix_copy, mix_block, mix_position (which replace columns so named)."""
    chosen = plan(units(docs), **how)
    names = ["mix_copy", "mix_block", "mix_position"]
    docs = docs.drop(*names)
    if chosen is None:
        return docs.limit(0).select("*", F.lit(0).alias(names[0]), F.lit(0).cast("long").alias(names[1]), F.lit(0).alias(names[2]))
    doc, source, raw = unused([*docs.columns, *names], "m_doc", "m_source", "m_raw")
    chosen = materialize(chosen.select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("raw").alias(raw), *[F.col(c[4:]).alias(c) for c in names]), "mix")
    on = (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(raw)) & docs["doc_id"].eqNullSafe(F.col(doc)) & docs["source"].eqNullSafe(F.col(source))
    return docs.join(chosen, on).drop(doc, source, raw)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chosen = plan(units(docs))
    if chosen is None:
        return docs.limit(0).select("doc_id", "source", *[F.lit(0).cast(t).alias(c) for c, t in (("n_tokens", "long"), ("weight", "double"), ("copy", "int"), ("block", "long"), ("position", "int"))])
    return chosen.drop("raw")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


OP2_SQL = r"""
WITH RECURSIVE u AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens) AS tokens FROM u GROUP BY source HAVING sum(n_tokens) > 0),
p AS (SELECT source, tokens, tokens / CAST((SELECT sum(tokens) FROM s) AS DOUBLE) AS p FROM s),
l AS (SELECT list(p) AS ps, -sum(p * ln(p)) AS own, ln(count(*)) AS top FROM p),
bis AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi FROM l
  UNION ALL
  SELECT i + 1,
    CASE WHEN h >= target THEN mid ELSE lo END,
    CASE WHEN h >= target THEN hi ELSE mid END
  FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid, own + 0.5 * (top - own) - 1e-12 AS target,
      ln(list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))))
        - (lo + hi) / 2 * list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2) * ln(x)))
          / list_sum(list_transform(ps, lambda x: pow(x, (lo + hi) / 2))) AS h
    FROM bis, l WHERE i < 44) q),
a AS (SELECT round(lo, 9) AS alpha FROM bis WHERE i = 44),
w AS (SELECT source, tokens, round(pow(p, alpha) / (SELECT sum(pow(p, alpha)) FROM p, a), 9) AS weight FROM p, a),
q AS (SELECT source, tokens, weight, CAST(floor(weight * CAST((SELECT sum(tokens) FROM s) AS DOUBLE)) AS BIGINT) AS quota FROM w),
b AS (SELECT greatest(1, CAST(ceil(sum(quota) / 100000.0) AS BIGINT)) AS n_blocks FROM q),
e AS (
  SELECT doc_id, source, n_tokens, weight, copy, md5(concat_ws('|', doc_id, copy)) AS h, tokens, quota
  FROM u JOIN q USING (source), unnest(range(0, CAST(ceil(quota / CAST(tokens AS DOUBLE)) AS BIGINT))) AS t(copy)),
c AS (
  SELECT *, copy * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, copy ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
k AS (SELECT *, CAST(floor(CAST(start AS DOUBLE) / quota * n_blocks) AS BIGINT) AS block FROM c, b WHERE start < quota)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, weight, CAST(copy AS INTEGER) AS copy, block,
  CAST(row_number() OVER (PARTITION BY block ORDER BY h) AS INTEGER) AS position
FROM k
"""
