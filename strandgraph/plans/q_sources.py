"""Queries of sources and sinks (A): tables written in a format and read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import build
from ..sources import files, lookups
from ..sources.results import Results
from .registry import query
from .tables import CANON

c = F.col


@query("a01_graphml", CANON + "SELECT 'nodes' AS part, count(*) AS n, CAST(sum(node_id) AS BIGINT) AS s FROM family UNION ALL SELECT 'edges', count(*), CAST(sum(src) AS BIGINT) FROM family_edges")
def _(t):
    path = files.fresh(t.spark, "graphml")
    nodes = t.family.select(c("node_id").cast("string").alias("id"), F.create_map(F.lit("timestamp"), c("ts").cast("string"), F.lit("labels"), F.lit(":Release")).alias("attrs"))
    edges = t.family_edges.select(c("src").cast("string").alias("src"), c("dst").cast("string").alias("dst"), F.create_map(F.lit("label"), F.lit("dependency")).alias("attrs"))
    files.write_graphml(nodes, edges, path)
    got_nodes, _ = files.graphml(t.spark, f"{path}/nodes")
    _, got_edges = files.graphml(t.spark, f"{path}/edges")
    n = got_nodes.filter(build.is_release(c("attrs")["labels"])).agg(F.lit("nodes").alias("part"), F.count("*").alias("n"), F.sum(c("id").cast("long")).alias("s"))
    return n.unionByName(got_edges.filter(c("attrs")["label"] == "dependency").agg(F.lit("edges").alias("part"), F.count("*").alias("n"), F.sum(c("src").cast("long")).alias("s")))


@query("a02_graph_tables", CANON + "SELECT src, dst FROM family_edges")
def _(t):
    path = files.fresh(t.spark, "graph")
    files.write_graph_tables(t.family, t.family_edges, path)
    return files.graph_tables(t.spark, path)[1]


@query("a05_jsonl", "SELECT doc_id, text, lang FROM documents")
def _(t):
    path = files.fresh(t.spark, "jsonl")
    files.write_jsonl(t.raw("documents").select("doc_id", "text", "lang"), path)
    return files.jsonl(t.spark, path, "doc_id bigint, text string, lang string")


@query("a07_jsonl_tolerant", "SELECT event_id % 10 = 3 AS bad, count(*) AS n FROM events GROUP BY 1")
def _(t):
    path = files.fresh(t.spark, "lines")
    line = F.when(c("event_id") % 10 == 3, F.lit('{"event_id": 1, oops')).otherwise(F.to_json(F.struct("event_id", "event_type")))
    t.raw("events").select(line.alias("value")).write.text(path)
    rows = files.jsonl_tolerant(t.spark, path, "event_id bigint, event_type string").filter(c("_error") | c("event_type").isNotNull())
    return rows.groupBy(c("_error").alias("bad")).agg(F.count("*").alias("n"))


@query("a08_path_records", CANON + "SELECT src AS target, dst AS score FROM family_edges")
def _(t):
    path = files.fresh(t.spark, "paths")
    files.write_paths(t.family_edges.select(c("src").alias("target"), c("dst").alias("score")), path)
    return files.jsonl(t.spark, path, "target bigint, score bigint")


@query("a09_gexf", CANON + "SELECT (SELECT count(DISTINCT n) FROM (SELECT src AS n FROM family_edges UNION ALL SELECT dst FROM family_edges)) AS n_nodes, (SELECT count(*) FROM family_edges) AS n_edges")
def _(t):
    path = files.fresh(t.spark, "gexf")
    files.write_gexf(t.family_edges, path)
    xml = t.spark.read.text(path)
    return xml.agg(F.count_if(c("value").startswith("<node id")).alias("n_nodes"), F.count_if(c("value").startswith("<edge id")).alias("n_edges"))


@query("a10_csv", CANON + "SELECT node_id, count(*) AS n FROM cve_list GROUP BY node_id")
def _(t):
    path = files.fresh(t.spark, "csv")
    files.write_csv(t.cve_list.groupBy("node_id").agg(F.collect_list(F.struct("cve_id", "severity")).alias("cves")), path)
    rows = files.csv(t.spark, path, "node_id bigint, cves string")
    return rows.select("node_id", F.size(F.from_json("cves", "array<struct<cve_id:string,severity:string>>")).cast("long").alias("n"))


@query("a11_severities", CANON + "SELECT cve_id AS name, severity FROM cve_list")
def _(t):
    path = files.fresh(t.spark, "severity")
    lists = t.cve_list.groupBy("node_id").agg(F.collect_list(F.struct(c("cve_id").alias("name"), "severity")).alias("cves"))
    files.write_jsonl(lists.select(c("node_id").cast("string").alias("coordinate"), "cves"), path)
    return files.severities(t.spark, path)


@query("a12_advisories", "SELECT 'C' || event_id AS cve_id, CASE WHEN event_id % 2 = 0 THEN 'OSV' WHEN event_id % 3 = 0 THEN 'NVD' END AS source, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN props END AS payload FROM events")
def _(t):
    e = t.raw("events").select(F.concat(F.lit("C"), c("event_id").cast("string")).alias("cve_id"), c("props").alias("payload"), "event_id")
    return files.advisory(e.select("cve_id"), e.filter("event_id % 2 = 0"), e.filter("event_id % 3 = 0"))


@query("a16_cached_scores", CANON + "SELECT node_id, count(*) AS n FROM cve_list GROUP BY node_id")
def _(t):
    """Counts by node, of scores by CVE and by node that are committed once and then loaded together."""
    kept = Results(t.spark, files.fresh(t.spark, "scores"))
    kept.commit("per_cve", t.cve_list.select("cve_id", "node_id"))
    kept.commit("per_node", t.cve_list.groupBy("node_id").agg(F.count("*").alias("n")))
    per_cve, per_node = kept.load_all("per_cve", "per_node")
    return per_node.join(per_cve, "node_id", "left_semi")


@query("a18_labels_csv", "SELECT doc_id, quality, toxic, quality + toxic AS total FROM labels")
def _(t):
    path = files.fresh(t.spark, "labels")
    files.write_csv(t.raw("labels").withColumn("total", c("quality") + c("toxic")), path)
    return files.csv(t.spark, path, "doc_id bigint, quality int, toxic int, total int")


@query("a19_prediction_summary", CANON + "SELECT count(DISTINCT src) AS n_cves, count(*) AS n_predictions, round(count(*) / count(DISTINCT src), 9) AS mean_length FROM dep_edges")
def _(t):
    return files.prediction_summary(build.adjacency(t.dep_edges).withColumnRenamed("neighbours", "ranked")).withColumn("mean_length", F.round("mean_length", 9))


@query("a17_checkpointed_scores", CANON + "SELECT 'in' AS name, 2 AS version, node_id, n FROM (SELECT dst AS node_id, count(*) AS n FROM family_edges GROUP BY 1) UNION ALL SELECT 'out', 1, src, count(*) FROM family_edges GROUP BY src")
def _(t):
    """Results kept by algorithm, committed, listed and loaded; the first version of one is replaced."""
    kept = Results(t.spark, files.fresh(t.spark, "algorithms"))
    degree = lambda end: t.family_edges.groupBy(c(end).alias("node_id")).agg(F.count("*").alias("n"))
    kept.commit("in", degree("src"))
    kept.commit("in", degree("dst"))
    kept.commit("out", degree("src"))
    newest = {r["name"]: r["version"] for r in kept.listed().groupBy("name").agg(F.max("version").alias("version")).collect()}
    return reduce(DataFrame.unionByName, [kept.load(name).select(F.lit(name).alias("name"), F.lit(version).alias("version"), "node_id", "n") for name, version in sorted(newest.items())])


@query("a12_lookup_table", """WITH l AS (SELECT user_id % 40 AS key, epoch_us(ts) // 1000 AS met, max(CASE WHEN event_type IN ('click', 'purchase') THEN props END) AS payload FROM events WHERE event_type <> 'view' GROUP BY ALL),
q AS (SELECT event_id, user_id % 40 AS key, epoch_us(ts) // 1000 AS asked_at FROM events WHERE event_type = 'view'),
f AS (SELECT q.*, l.met, l.payload FROM q ASOF LEFT JOIN l ON l.key = q.key AND l.met <= q.asked_at),
h AS (SELECT *, met IS NOT NULL AND asked_at < met + CASE WHEN payload IS NULL THEN 300000 ELSE 86400000 END AS holds FROM f)
SELECT event_id, CASE WHEN NOT holds THEN 'stale' WHEN payload IS NULL THEN 'miss' ELSE 'hit' END AS state, CASE WHEN holds THEN payload END AS payload FROM h""")
def _(t):
    """Views ask for a key; other events are lookups, of which clicks and purchases have found something."""
    e = t.raw("events").select("event_id", "event_type", "props", (c("user_id") % 40).alias("key"), F.unix_millis(c("ts").cast("timestamp")).alias("at"))
    found = e.filter("event_type <> 'view'").withColumn("payload", F.when(c("event_type").isin("click", "purchase"), c("props")))
    early = found.filter("event_id % 2 = 0")
    stored = lookups.merged(early, found.filter("event_id % 2 = 1"))
    return lookups.as_of(e.filter("event_type = 'view'").withColumnRenamed("at", "asked_at"), stored).select("event_id", "state", "payload")


@query("a03_saved_table", CANON + "SELECT node_id, release FROM releases")
def _(t):
    path = files.fresh(t.spark, "table")
    t.releases.select("node_id", "release").write.mode("overwrite").parquet(path)
    return t.spark.read.parquet(path)


@query("a04_json_document", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def _(t):
    """Documents that span lines: a folder for each eighth of the users, with one JSON array."""
    path = files.fresh(t.spark, "document")
    rows = t.raw("events").groupBy("user_id").agg(F.count("*").alias("n"))
    item = F.concat(F.lit('{\n "user_id": '), c("user_id").cast("string"), F.lit(',\n "n": '), c("n").cast("string"), F.lit("\n}"))
    parts = rows.groupBy(F.pmod("user_id", F.lit(8)).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value"))
    parts.write.partitionBy("part").text(path)
    return files.json_document(t.spark, path, "user_id bigint, n bigint").select("user_id", "n")


@query("a06_jsonl_written", "SELECT doc_id, text FROM documents WHERE text LIKE '%é%'")
def _(t):
    path = files.fresh(t.spark, "written")
    files.write_jsonl(t.raw("documents").select("doc_id", "text"), path)
    raw = t.spark.read.text(path).filter(c("value").contains("é"))  # as it is in the file, not escaped
    return raw.select(F.from_json("value", "doc_id bigint, text string").alias("x")).select("x.*")


@query("a15_load_or_build", CANON + "SELECT node_id, count(*) AS n FROM cve_list GROUP BY node_id")
def _(t):
    path = files.fresh(t.spark, "memo")
    build_it = lambda: t.cve_list.groupBy("node_id").agg(F.count("*").alias("n"))
    files.load_or_build(t.spark, path, build_it)
    return files.load_or_build(t.spark, path, lambda: build_it().limit(0))
