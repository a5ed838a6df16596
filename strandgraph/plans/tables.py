"""The engine's canonical tables as projections of the given ones, in Spark and (CANON) in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import build

DAY_MS = 86_400_000


class Tables:
    """Canonical tables of a folder; each is a plan, built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def releases(self) -> DataFrame:
        """A release of software o_custkey for each order."""
        order = Window.partitionBy("software_id").orderBy("ts", "node_id")
        rows = self.raw("orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("software_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"))
        rows = rows.withColumn("ord", F.row_number().over(order))
        version = F.concat(F.lit("1."), F.floor(F.col("ord") / 10).cast("string"), F.lit("."), (F.col("ord") % 10).cast("string"))
        rows = rows.withColumn("version", version)
        return rows.withColumn("release", F.concat(F.lit("org.c"), (F.col("software_id") % 20).cast("string"), F.lit(":lib-"), F.col("software_id").cast("string"), F.lit(":"), F.col("version")))

    @cached_property
    def raw_edges(self) -> DataFrame:
        """src, dst, label: a release depends on a software; a software owns a release."""
        needs = self.raw("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("dependency").alias("label")).distinct()
        owns = self.raw("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("relationship_AR").alias("label"))
        return needs.unionByName(owns)

    @cached_property
    def dep_edges(self) -> DataFrame:
        """src, dst: release to release, resolved in time."""
        return build.resolve_edges(self.raw_edges.filter("label = 'dependency'").select("src", "dst"), self.releases)

    @cached_property
    def cve_list(self) -> DataFrame:
        n = self.raw("orders").agg(F.count("*")).first()[0]
        value = F.col("value")
        severity = F.when(value < 10, "LOW").when(value < 40, "MEDIUM").when(value < 100, "HIGH").otherwise("CRITICAL")
        return self.raw("events").filter("event_type = 'error'").select(
            ((F.col("event_id") * 7919) % n).alias("node_id"), F.concat(F.lit("CVE-2024-"), F.lpad(F.col("event_id").cast("string"), 7, "0")).alias("cve_id"), severity.alias("severity"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("[CWE-"), (F.col("user_id") % 30).cast("string"), F.lit(",CWE-"), (F.col("event_id") % 7).cast("string"), F.lit("]")).alias("cwe_ids"),
        )

    @cached_property
    def added_values(self) -> DataFrame:
        """owner_id, type, value: popularity, freshness and speed of releases."""
        n = self.raw("orders").agg(F.count("*")).first()[0]
        kind = F.when(F.col("event_type") == "purchase", "POPULARITY_1_YEAR").when(F.col("event_type") == "view", "FRESHNESS").otherwise("SPEED")
        k = F.get_json_object("props", "$.k")
        fresh = F.concat(F.lit('{\\"freshness\\":{\\"numberMissedRelease\\":\\"'), k, F.lit('\\",\\"outdatedTimeInMs\\":\\"'), (k.cast("long") * DAY_MS).cast("string"), F.lit('\\"}}'))
        value = F.when(F.col("event_type") == "view", fresh).otherwise(F.round("value", 2).cast("string"))
        return self.raw("events").filter("event_type IN ('purchase', 'view', 'click')").select(
            F.col("event_id").alias("value_id"), ((F.col("event_id") * 104729) % n).alias("owner_id"), kind.alias("type"), value.alias("value")
        )

    @cached_property
    def points(self) -> DataFrame:
        idx = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
        return self.raw("embeddings").select(F.col("vec_id").alias("pid"), F.col("label").alias("node_id"), idx.alias("cve_idx"), "embedding")

    @cached_property
    def series(self) -> DataFrame:
        """t (hour, epoch seconds), n, value of events."""
        return self.raw("events").groupBy(F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("t")).agg(F.count("*").alias("n"), F.avg("value").alias("value"))

    @cached_property
    def family(self) -> DataFrame:
        """Every release: the nodes of the graph algorithms."""
        return self.releases.select("node_id", "software_id", "ts")

    @cached_property
    def family_edges(self) -> DataFrame:
        """Every resolved dependency edge: the edges of the graph algorithms."""
        return self.dep_edges


#: The same tables as SQL common table expressions.
CANON = r"""
WITH RECURSIVE releases AS (
  SELECT *, 'org.c' || (software_id % 20) || ':lib-' || software_id || ':' || version AS release FROM (
    SELECT *, '1.' || (ord // 10) || '.' || (ord % 10) AS version FROM (
      SELECT o_orderkey AS node_id, o_custkey AS software_id, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS ts,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS ord FROM orders))),
raw_edges AS (
  SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst, 'dependency' AS label FROM lineitem
  UNION ALL SELECT o_custkey, o_orderkey, 'relationship_AR' FROM orders),
dep_edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT e.src, max_by(r.node_id, struct_pack(a := r.ts, b := r.node_id)) AS dst
    FROM raw_edges e JOIN releases s ON s.node_id = e.src JOIN releases r ON r.software_id = e.dst AND r.ts <= s.ts
    WHERE e.label = 'dependency' GROUP BY e.src, e.dst) WHERE src <> dst),
cve_list AS (
  SELECT (event_id * 7919) % (SELECT count(*) FROM orders) AS node_id, 'CVE-2024-' || lpad(CAST(event_id AS VARCHAR), 7, '0') AS cve_id,
    CASE WHEN value < 10 THEN 'LOW' WHEN value < 40 THEN 'MEDIUM' WHEN value < 100 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
    epoch_us(ts) // 1000 AS ts, '[CWE-' || (user_id % 30) || ',CWE-' || (event_id % 7) || ']' AS cwe_ids
  FROM events WHERE event_type = 'error'),
added_values AS (
  SELECT event_id AS value_id, (event_id * 104729) % (SELECT count(*) FROM orders) AS owner_id,
    CASE event_type WHEN 'purchase' THEN 'POPULARITY_1_YEAR' WHEN 'view' THEN 'FRESHNESS' ELSE 'SPEED' END AS type,
    CASE event_type WHEN 'view' THEN NULL ELSE round(value, 2) END AS num,
    CASE event_type WHEN 'view' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
  FROM events WHERE event_type IN ('purchase', 'view', 'click')),
points AS (
  SELECT vec_id AS pid, label AS node_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS cve_idx, embedding FROM embeddings),
series AS (
  SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS t, count(*) AS n, avg(value) AS value FROM events GROUP BY 1),
family AS (SELECT node_id, software_id, ts FROM releases),
family_edges AS (SELECT src, dst FROM dep_edges)
"""
