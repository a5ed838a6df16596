"""Written tables in the folder that driver and executors share: they cut the lineage of iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (unset, in local mode, as in tests) a new folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: With this setting a statement deletes its shuffles when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str = "step") -> DataFrame:
    """The same rows, read back from a table written to the shared folder; a lost executor can't lose them. The shuffles that
    made them are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def folders(*tables: DataFrame) -> list[str]:
    return sorted({name.rsplit("/", 1)[0] for df in tables for name in df.inputFiles()})


def together(*tables: DataFrame) -> DataFrame:
    """The union of tables of one schema that `written` wrote, as one scan."""
    return tables[0] if len(tables) == 1 else tables[0].sparkSession.read.schema(tables[0].schema).parquet(*folders(*tables))


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` wrote and that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in folders(df):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
