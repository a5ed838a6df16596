"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of a record batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (unset, in local mode, as in tests) a new one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back. A lost executor costs no recomputation of what is above."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` wrote and that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the decimal doc_id, modulo `mod`; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


def hash_share(rows: DataFrame, key: Column, want: Column, by: Column) -> Column | None:
    """A condition that keeps about `want` (an aggregate) rows by hash of `key` in each of the few classes `by`.

    One aggregate over the table decides the shares. None: the table is empty.
    """
    out = None
    for y, n, wanted in rows.groupBy(by.alias("y")).agg(F.count("*"), want).collect():
        part = by.eqNullSafe(F.lit(y)) & (F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000_000)) < int(1_000_000_000 * min(1.0, wanted / n)))
        out = part if out is None else out | part
    return out


def bounded_sample(rows: DataFrame, max_rows: int, max_bytes: int, by: Column | None = None) -> DataFrame:
    """At most max_rows of the different texts of rows(text, ...), and max_bytes of text, in each of the few classes `by`.

    By hash of the text, so copies count once and the rows of one doc_id, or none, are no group. First a share of about
    max_rows texts is picked; of these, few and without their texts, a running sum ends where a bound is met. Texts that take
    more than a quarter of max_bytes are left out, so that one can't end the sum.
    """
    by = F.lit(0) if by is None else by
    size, text = F.octet_length("text"), F.col("text")
    rows = rows.filter(size <= max_bytes // 4)
    share = hash_share(rows, text, F.least(F.lit(float(max_rows)), max_bytes / F.greatest(F.avg(size), F.lit(1.0))), by)
    if share is None:
        return rows
    names = [f"`{c}`" for c in rows.columns]
    near = rows.filter(share).select(by.alias("y"), F.xxhash64(text).alias("h"), F.struct(*names).alias("row"), size.alias("bytes"))
    heads = near.groupBy("y", "h").agg(F.max("bytes").alias("bytes"))
    order = Window.partitionBy("y").orderBy("h")
    heads = heads.select("y", "h", F.row_number().over(order).alias("k"), F.sum("bytes").over(order).alias("sum"))
    heads = heads.filter((F.col("k") <= max_rows) & (F.col("sum") <= max_bytes)).select("y", "h")
    return near.join(F.broadcast(heads), ["y", "h"]).groupBy("y", "h").agg(F.min("row").alias("row")).orderBy("y", "h").select("row.*")


def labelled_sample(docs: DataFrame, labels: DataFrame, mark: str, eligible: Column, max_rows: int, max_bytes: int) -> DataFrame:
    """docs' rows with their mark from labels(doc_id, mark): a bounded sample of each class. A doc_id's mark is its highest."""
    marked = labels.select("doc_id", mark).filter(F.col("doc_id").isNotNull() & F.col(mark).isNotNull() & eligible).groupBy("doc_id").agg(F.max(mark).alias(mark))
    share = hash_share(marked, F.col("doc_id"), F.lit(float(max_rows)), F.col(mark))
    if share is None:
        return docs.limit(0).withColumn(mark, F.lit(0))
    # about max_rows ids of a class, so few enough to broadcast
    return bounded_sample(docs.join(F.broadcast(marked.filter(share)), "doc_id"), max_rows, max_bytes, F.col(mark))


def labelled_parts(docs: DataFrame, labels: DataFrame, mark: str, eligible: Column, part_rows: int, bits: int = 17) -> DataFrame:
    """A written table of every row of docs(doc_id, text, ...) that labels(doc_id, mark) marks: docs' columns, the mark as an
    int, and part. A doc_id's mark is its highest; eligible is a condition on doc_id.

    Parts are of about part_rows marked rows, by hash of doc_id; a part's rows lie together in one file, in the order of a hash.
    Before texts are shuffled, rows whose doc_id is surely unmarked leave by a bitmap of 64 * 2**bits hashes; marks then meet
    their rows by a window, so texts move once.
    """
    kind = docs.schema["doc_id"].dataType
    marked = labels.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col(mark).cast("int").alias(mark))
    marked = marked.filter(F.col("doc_id").isNotNull() & F.col(mark).isNotNull() & eligible)
    parts = max(1, -(-marked.count() // part_rows))
    key = F.xxhash64("doc_id")
    word, bit = F.pmod(key, F.lit(1 << bits)), F.pmod(F.shiftright(key, 40), F.lit(64)).cast("int")
    known = marked.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    near = docs.filter(eligible).withColumn("__word", word).join(F.broadcast(known), "__word").filter(F.bit_get("__bits", bit) == 1)
    both = near.select(*docs.columns).withColumn("__row", F.lit(True)).unionByName(marked, allowMissingColumns=True)
    both = both.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts)).cast("int")).repartition(parts, "part")
    both = both.withColumn(mark, F.max(mark).over(Window.partitionBy("part", "doc_id"))).filter(F.col("__row") & F.col(mark).isNotNull()).drop("__row")
    return materialize(both.sortWithinPartitions("part", F.xxhash64("doc_id", "text"), *(c for c in docs.columns if c != "doc_id")).drop("doc_id"), "labelled")


def hot_join(left: DataFrame, right: DataFrame, key: str, counted: DataFrame | None = None, parts: int = 256, least: int = 512) -> DataFrame:
    """left joined to right on a key of which left may hold very many rows; right has few rows a key.

    Keys of a 1/parts share of left's rows or more (so at most `parts` keys, which are broadcast) are split by a hash of the
    row, and right's rows of these keys are repeated for each split. The key isn't null; columns starting with __ are taken.
    counted: a written table with the keys of left's rows, where left isn't one itself; or with __n, the rows of each key.
    Both sides grow with the data, so they are merged and never broadcast. parts * least rows fit a task and aren't split.
    """
    counted, right = left if counted is None else counted, right.hint("merge")
    known = "__n" in counted.columns
    total = (counted.agg(F.sum("__n")).first()[0] or 0) if known else counted.count()
    if total <= parts * least:
        return left.join(right, key)
    limit = -(-total // parts)
    rows = counted if known else counted.groupBy(key).agg(F.count("*").alias("__n"))
    hot = rows.filter(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__k"))
    hot = materialize(hot, "hot")
    if hot.isEmpty():
        return left.join(right, key)
    spread = F.pmod(F.xxhash64(*left.columns), F.coalesce("__k", F.lit(1)))
    a = left.join(F.broadcast(hot), key, "left").withColumn("__salt", spread.cast("int")).drop("__k")
    b = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__k", F.lit(1)) - 1))).drop("__k")
    return a.join(b.hint("merge"), [key, "__salt"]).drop("__salt")


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with record batches of at most BATCH_BYTES (or one row), so that workers need little memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def fit_in_task(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object | None:
    """What `fit` makes of a bounded sample's rows, in their order, in one task: the driver gets the model, never the texts.

    No row: None. A lost executor costs this one task, which gives the same model again.
    """
    (place,) = unused(sample.columns, "place")

    def run(batches):
        got = list(batches)
        if sum(b.num_rows for b in got):
            model = fit(pa.Table.from_batches(got).sort_by(place).drop_columns(place))
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(model), 1)], pa.binary())], ["model"])

    rows = map_arrow(sample.withColumn(place, F.monotonically_increasing_id()).coalesce(1), run, "model binary").collect()
    return pickle.loads(zlib.decompress(rows[0].model)) if rows else None


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
