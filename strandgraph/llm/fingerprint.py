"""Document fingerprints: canonical exact digests, by DataFrame and SQL functions only.

Canonical text: NFKC, full case folding and NFKC again (ICU's, through the SQL function reflect), each run of white space
one space, no white space at the ends. Digest: 128 bits of xxhash64 under two seeds, and the length. Texts of equal digests are
compared by their bytes: a pre-aggregated minimum and maximum for each bucket, so that a large group of copies is never
gathered; were they to differ, the texts' SHA-256 would tell them apart in the fingerprint.

Defined results: null counts as the empty text; rows with a null doc_id come last in descending doc_id; rows of one
doc_id follow each other by their digest; the only row's next document is itself; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Ranges of doc_id that the search for the next document is dealt over, at most.
RANGES = 1 << 18
ROWS_A_RANGE = 250
#: So many digests of several documents are broadcast at most (some 40 MB); more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def canonical(text: Column) -> Column:
    """The canonical form of a text that isn't null."""
    # ICU's NFKC also maps the no-break and typographic spaces to a space
    def compose(x: Column) -> Column:
        return F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    # folding maps ß to ss and final sigma to sigma, and may leave text that isn't composed
    folded = compose(F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(text), F.lit(True)))
    spaces = "\\t-\\r\\u001c-\\u001f\\u0085\\u1680\\u2028\\u2029"
    return F.btrim(F.regexp_replace(folded, f"[{spaces}][ {spaces}]*| [ {spaces}]+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash64 and the length in hexadecimal digits."""
    return F.concat(
        F.lpad(F.lower(F.hex(F.xxhash64(canon))), 16, "0"),
        F.lpad(F.lower(F.hex(F.xxhash64(F.lit("second seed"), canon))), 16, "0"),
        F.lpad(F.lower(F.hex(F.length(canon))), 8, "0"),
    )


def clashes(texts: DataFrame) -> DataFrame:
    """Of rows (fp, canon): the digests that stand for different texts. Only texts of digests seen twice are compared."""
    twice = materialize(texts.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "twice")
    small = twice.count() <= BROADCAST_ROWS
    again = texts.join(F.broadcast(twice) if small else twice, "fp", "left_semi")
    return materialize(again.groupBy("fp").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).filter("lo <> hi").select("fp"), "clashes")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, and n_same, the number of documents that share it."""
    rows = docs.select("doc_id", canonical(F.coalesce("text", F.lit(""))).alias("canon")).withColumn("fp", digest(F.col("canon")))
    named = settled(rows.withColumn("sha", F.sha2("canon", 256)), clashes(rows.select("fp", "canon")), {"fingerprint": ("fp", "sha")})
    counts = named.groupBy("fingerprint").agg(F.count("*").alias("n_same"))
    return named.select("doc_id", "fingerprint").join(counts, "fingerprint").select("doc_id", "fingerprint", "n_same")


def settled(rows: DataFrame, bad: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """Each name's fingerprint: the digest, and for a digest of different texts the text's SHA-256 after it."""
    if bad.isEmpty():
        return rows.withColumns({name: F.col(fp) for name, (fp, _) in names.items()})
    for name, (fp, sha) in names.items():
        rows = rows.join(bad.select(F.col("fp").alias(f"__{name}")), F.col(fp) == F.col(f"__{name}"), "left")
        rows = rows.withColumn(name, F.when(F.col(f"__{name}").isNull(), F.col(fp)).otherwise(F.concat(fp, sha))).drop(f"__{name}")
    return rows


def with_next(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Each row with the columns `extra` of the next row in descending (doc_id, fp), as next_<column>; after the last, the first.

    Rows are dealt by ranges of doc_id. The first row of a range is also sent to the range before it, as what follows that
    range's last row; a table of RANGES rows at most says which these are, so it can be broadcast.
    """
    lo, hi, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if lo is None:
        lo, hi = 0, 0
    # enough ranges that each is a small sort
    width = max(1, -(-(hi - lo + 1) // max(1, min(RANGES, n // ROWS_A_RANGE))))
    last = RANGES + 1  # rows without doc_id
    own = F.coalesce(F.floor((F.lit(float(hi)) - F.col("doc_id").cast("double")) / float(width)).cast("int"), F.lit(last))
    rows = rows.withColumn("__range", own)
    first = rows.groupBy("__range").agg(F.max("doc_id").alias("__first"))
    order = Window.orderBy("__range")  # over RANGES + 2 rows at most
    first = first.select("__range", "__first", F.lag("__range").over(order).alias("__before"), F.max("__range").over(Window.partitionBy()).alias("__end"))
    rows = rows.join(F.broadcast(first), "__range")
    # copies of a range's first rows: for the range before it, or (of the first range) for after the very last row
    is_first = F.col("doc_id").eqNullSafe(F.col("__first"))
    guard = F.struct(F.coalesce("__before", "__end").alias("r"), F.when(F.col("__before").isNull(), 2).otherwise(1).alias("g"))
    places = F.when(is_first, F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("g")), guard)).otherwise(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("g"))))
    rows = rows.withColumn("__place", F.explode(places)).select(*[c for c in rows.columns if not c.startswith("__")], "__place")
    seq = Window.partitionBy("__place.r").orderBy(F.col("__place.g"), F.col("doc_id").desc_nulls_last(), F.col("fp").desc())
    rows = rows.select("*", *[F.lead(c).over(seq).alias(f"next_{c}") for c in extra])
    return rows.filter("__place.g = 0").drop("__place")


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.withColumn("canon", canonical(F.col("text"))).withColumns({"fp": digest(F.col("canon")), "n_chars": F.char_length("text").cast("long")})
    rows = with_next(rows.drop("canon"), ["text", "fp"])
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_canon", canonical(F.col("edited")))
    rows = rows.withColumns({"edited_fp": digest(F.col("edited_canon")), "edited_sha256": F.sha2("edited", 256)})
    canon, sha = canonical(F.col("text")), lambda c: F.sha2(c, 256)
    # likeness: equal digests, and equal bytes where digests are equal
    near_edited = F.when(F.col("fp") == F.col("edited_fp"), (canon == F.col("edited_canon")).cast("double")).otherwise(0.0)
    near_next = F.when(F.col("fp") == F.col("next_fp"), (canon == canonical(F.col("next_text"))).cast("double")).otherwise(0.0)
    bad = clashes(docs.select(canonical(F.col("text")).alias("canon")).select(digest(F.col("canon")).alias("fp"), "canon"))
    shas = {} if bad.isEmpty() else {"sha": sha(canon), "edited_sha": sha("edited_canon")}
    rows = settled(rows.withColumns(shas), bad, {"fingerprint": ("fp", "sha"), "edited_fingerprint": ("edited_fp", "edited_sha")})
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near_edited.alias("near_edited"), near_next.alias("near_next"))
