"""Readers and writers of the engine's file formats, all with explicit schemas."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir

_DATA = "data array<struct<_key:string,_VALUE:string>>"


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id, attrs) and edges(src, dst, attrs) of a GraphML file; attributes are maps of strings."""
    attrs = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    nodes = read("node", f"_id string, {_DATA}").select(F.col("_id").alias("id"), attrs.alias("attrs"))
    edges = read("edge", f"_source string, _target string, {_DATA}").select(F.col("_source").alias("src"), F.col("_target").alias("dst"), attrs.alias("attrs"))
    return nodes, edges


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes(id, attrs) and edges(src, dst, attrs) as GraphML parts under path/nodes and path/edges."""
    data = F.transform(F.map_entries("attrs"), lambda e: F.struct(e["key"].alias("_key"), e["value"].alias("_VALUE"))).alias("data")
    nodes.select(F.col("id").alias("_id"), data).write.format("xml").option("rootTag", "graphml").option("rowTag", "node").save(f"{path}/nodes")
    edges.select(F.col("src").alias("_source"), F.col("dst").alias("_target"), data).write.format("xml").option("rootTag", "graphml").option("rowTag", "edge").save(f"{path}/edges")


def graph_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A graph kept as two Parquet tables."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_graph_tables(nodes: DataFrame, edges: DataFrame, path: str, overwrite: bool = False) -> None:
    mode = "overwrite" if overwrite else "errorifexists"
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.write.mode(mode).parquet(f"{path}/edges")


def load_or_build(spark: SparkSession, path: str, make, rebuild: bool = False) -> DataFrame:
    """The table at a path; built and written first where there is none, or if asked for."""
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As jsonl(); a line that can't be read is a row with its text in _raw and _error true."""
    rows = spark.read.schema(f"{schema}, _raw string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw").json(path)
    return rows.withColumn("_error", F.col("_raw").isNotNull())


def write_jsonl(rows: DataFrame, path: str) -> None:
    """UTF-8, non-ASCII characters as they are."""
    rows.write.json(path)


def write_paths(rows: DataFrame, path: str) -> None:
    """Path records in order of (target, score): part after part."""
    rows.orderBy("target", "score").write.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Nested columns as JSON text."""
    nested = {f.name: F.to_json(f.name) for f in rows.schema if f.dataType.typeName() in ("array", "struct", "map")}
    rows.withColumns(nested).write.option("header", True).csv(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def severities(spark: SparkSession, path: str) -> DataFrame:
    """name, severity from JSON lines {coordinate, cves: [{name, severity}]} or flat {name, severity}; the last of a name holds
    (by file and place in it)."""
    rows = spark.read.schema("coordinate string, cves array<struct<name:string,severity:string>>, name string, severity string").json(path)
    rows = rows.withColumn("file", F.col("_metadata.file_path")).withColumn("place", F.monotonically_increasing_id())
    one = F.when(F.col("cves").isNotNull(), F.col("cves")).otherwise(F.array(F.struct("name", "severity")))
    flat = rows.select("file", "place", F.posexplode(one).alias("k", "c")).select("file", "place", "k", "c.name", "c.severity")
    return flat.filter("name IS NOT NULL").groupBy("name").agg(F.max_by("severity", F.struct("file", "place", "k")).alias("severity"))


def advisory(cves: DataFrame, osv: DataFrame, nvd: DataFrame) -> DataFrame:
    """cve_id with the advisory payload of OSV, or else of NVD, and its source."""
    a, b = osv.select("cve_id", F.col("payload").alias("osv")), nvd.select("cve_id", F.col("payload").alias("nvd"))
    rows = cves.join(a, "cve_id", "left").join(b, "cve_id", "left")
    return rows.select("cve_id", F.when(F.col("osv").isNotNull(), "OSV").when(F.col("nvd").isNotNull(), "NVD").alias("source"), F.coalesce("osv", "nvd").alias("payload"))


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Of (cve_id, ranked): number of CVEs, of predictions, and their mean."""
    n = F.size("ranked")
    return predictions.agg(F.count("*").alias("n_cves"), F.sum(n).alias("n_predictions"), F.avg(n).alias("mean_length"))


def write_gexf(edges: DataFrame, path: str) -> None:
    """A GEXF document as text parts in order of their names: head, nodes, edges, tail. Nothing passes through the driver;
    `cat path/part=*/*` is the document."""
    pairs = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    nodes = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    lines = {
        "0": edges.sparkSession.createDataFrame([('<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><nodes>',)], "value string"),
        "1": nodes.select(F.concat(F.lit("<node id="), quoted("id"), F.lit(" label="), quoted("id"), F.lit("/>")).alias("value")),
        "2": edges.sparkSession.createDataFrame([("</nodes><edges>",)], "value string"),
        "3": pairs.select(F.concat(F.lit('<edge id="'), F.monotonically_increasing_id().cast("string"), F.lit('" source='), quoted("src"), F.lit(" target="), quoted("dst"), F.lit("/>")).alias("value")),
        "4": edges.sparkSession.createDataFrame([("</edges></graph></gexf>",)], "value string"),
    }
    for part, rows in lines.items():
        rows.write.text(f"{path}/part={part}")


def fresh(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
