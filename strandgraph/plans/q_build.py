"""Queries of graph construction (B) and the joins it is made of (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import build, substrings
from .registry import query
from .tables import CANON


@query("b01_is_release", "SELECT event_type, event_type = 'view' AS is_release, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    labels = F.when(F.col("event_type") == "view", ":AddedValue:Release").otherwise(":Artifact")
    return t.raw("events").select("event_type", build.is_release(labels).alias("is_release")).groupBy("event_type", "is_release").agg(F.count("*").alias("n"))


@query("b02_timestamp_or_zero", "SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE event_id * 1000 END AS ts FROM events")
def _(t):
    given = F.when(F.col("event_type") == "view", "unknown").otherwise((F.col("event_id") * 1000).cast("string"))
    return t.raw("events").select("event_id", build.timestamp_or_zero(given).alias("ts"))


@query("b03_attached_values", CANON + "SELECT owner_id AS src, count(*) AS n, min(value_id) AS lo, max(value_id) AS hi FROM added_values GROUP BY 1")
def _(t):
    edges = t.added_values.select(F.col("owner_id").alias("src"), F.col("value_id").alias("dst"), F.lit("addedValues").alias("label"))
    return build.attached_values(edges).select("src", F.size("values").cast("long").alias("n"), F.get("values", F.lit(0)).alias("lo"), F.element_at("values", -1).alias("hi"))


@query("b04_has_cve", CANON + "SELECT node_id, release FROM releases WHERE node_id IN (SELECT node_id FROM cve_list)")
def _(t):
    return t.releases.join(t.cve_list, "node_id", "left_semi").select("node_id", "release")


@query("b05_adjacency", CANON + "SELECT src, count(*) AS degree, min(dst) AS lo, max(dst) AS hi FROM dep_edges GROUP BY src")
def _(t):
    return build.adjacency(t.dep_edges).select("src", F.size("neighbours").cast("long").alias("degree"), F.get("neighbours", F.lit(0)).alias("lo"), F.element_at("neighbours", -1).alias("hi"))


@query("b06_release_owner", "SELECT o_orderkey AS release, o_custkey AS software FROM orders")
def _(t):
    return build.owners(t.raw_edges)


@query("b06_release_owner_last_wins", "SELECT release, max_by(software, edge_seq) AS software FROM (SELECT o_orderkey AS release, o_custkey AS software, 0 AS edge_seq FROM orders UNION ALL SELECT l_orderkey, l_suppkey, l_suppkey + 1 FROM lineitem) GROUP BY release")
def _(t):
    seq = F.when(F.col("label") == "dependency", F.col("dst") + 1).otherwise(F.lit(0))
    return build.owners(t.raw_edges.withColumn("edge_seq", seq), last_edge_wins=True)


@query("b07_release_lists", CANON + "SELECT software_id, count(*) AS n, min_by(node_id, ts * 1000000 + node_id) AS first, max_by(node_id, ts * 1000000 + node_id) AS last FROM releases GROUP BY software_id")
def _(t):
    return build.release_lists(t.releases).select("software_id", F.size("releases").cast("long").alias("n"), F.get("releases", F.lit(0)).alias("first"), F.element_at("releases", -1).alias("last"))


@query("b08_validity", CANON + "SELECT node_id, ts, lead(ts) OVER (PARTITION BY software_id ORDER BY ts, node_id) AS ts_end FROM releases")
def _(t):
    return build.validity(t.releases).select("node_id", "ts", "ts_end")


@query("b09_normalise_edges", CANON + "SELECT CASE WHEN label = 'dependency' THEN src ELSE dst END AS src, CASE WHEN label = 'dependency' THEN dst ELSE src END AS dst, label FROM raw_edges")
def _(t):
    return build.normalise_edges(t.raw_edges)


@query("b10_releases_in_range", CANON + "SELECT software_id, node_id, ts FROM releases WHERE ts >= 883612800000 + software_id * 86400000 AND ts < 946684800000")
def _(t):
    spans = t.releases.select("software_id", (F.lit(883612800000) + F.col("software_id") * 86400000).alias("start_ts"), F.lit(946684800000).alias("end_ts")).distinct()
    return build.in_range(t.releases, spans).select("software_id", "node_id", "ts")


@query("b11_asof_edges", CANON + "SELECT src, dst FROM dep_edges")
def _(t):
    return t.dep_edges


_LAGGED = """, lagged AS (
  SELECT e.src, max_by(r.node_id, struct_pack(a := r.ts, b := r.node_id)) AS dst
  FROM raw_edges e JOIN releases s ON s.node_id = e.src JOIN releases r ON r.software_id = e.dst AND r.ts <= s.ts - 31536000000
  WHERE e.label = 'dependency' GROUP BY e.src, e.dst),
filled AS (
  SELECT e.src, e.dst AS software, min_by(r.node_id, struct_pack(a := r.ts, b := r.node_id)) AS dst
  FROM raw_edges e JOIN releases s ON s.node_id = e.src JOIN releases r ON r.software_id = e.dst AND r.ts >= s.ts - 31536000000
  WHERE e.label = 'dependency' AND NOT EXISTS (SELECT 1 FROM releases q WHERE q.software_id = e.dst AND q.ts <= s.ts - 31536000000)
  GROUP BY e.src, e.dst)
"""


@query("b11_asof_edges_lagged", CANON + _LAGGED + "SELECT DISTINCT src, dst FROM lagged WHERE src <> dst")
def _(t):
    return build.resolve_edges(t.raw_edges.filter("label = 'dependency'"), t.releases, lag_ms=31_536_000_000)


@query("b12_forward_fill", CANON + _LAGGED + "SELECT DISTINCT src, dst FROM (SELECT src, dst FROM lagged UNION ALL SELECT src, dst FROM filled) WHERE src <> dst")
def _(t):
    return build.resolve_edges(t.raw_edges.filter("label = 'dependency'"), t.releases, lag_ms=31_536_000_000, forward_fill=True)


_WINDOW = """, v AS (SELECT node_id, ts, lead(ts) OVER (PARTITION BY software_id ORDER BY ts, node_id) AS ts_end FROM releases),
win AS (SELECT DISTINCT e.src, r.node_id AS dst FROM raw_edges e JOIN v ON v.node_id = e.src JOIN releases r ON r.software_id = e.dst AND r.ts >= v.ts AND (v.ts_end IS NULL OR r.ts < v.ts_end)
  WHERE e.label = 'dependency' AND e.src <> r.node_id)
"""


@query("b13_window_edges", CANON + _WINDOW + "SELECT src, dst FROM win")
def _(t):
    return build.resolve_edges(t.raw_edges.filter("label = 'dependency'"), t.releases, strategy="window")


@query("b14_causal_edges", CANON + "SELECT e.src, e.dst, s.ts - d.ts AS lag FROM dep_edges e JOIN releases s ON s.node_id = e.src JOIN releases d ON d.node_id = e.dst WHERE d.ts <= s.ts - 86400000")
def _(t):
    r = t.releases.select("node_id", "ts")
    s, d = r.select(F.col("node_id").alias("src"), F.col("ts").alias("s_ts")), r.select(F.col("node_id").alias("dst"), F.col("ts").alias("d_ts"))
    return t.dep_edges.join(s, "src").join(d, "dst").filter(F.col("d_ts") <= F.col("s_ts") - 86400000).select("src", "dst", (F.col("s_ts") - F.col("d_ts")).alias("lag"))


@query("b15_used_nodes", CANON + "SELECT node_id, version, ts FROM releases WHERE node_id IN (SELECT src FROM dep_edges UNION SELECT dst FROM dep_edges)")
def _(t):
    return build.used_nodes(t.dep_edges, t.releases).select("node_id", "version", "ts")


@query("b16_integrity", CANON + "SELECT 0 AS unknown_ends, count(*) FILTER (d.ts > s.ts) AS against_time, count(*) AS n_edges FROM dep_edges e JOIN releases s ON s.node_id = e.src JOIN releases d ON d.node_id = e.dst")
def _(t):
    return build.integrity(t.dep_edges, t.releases)


_CVE_AGG = ", c AS (SELECT node_id, count(*) AS n, string_agg(cve_id || '/' || severity, ',' ORDER BY cve_id, severity) AS names FROM cve_list GROUP BY node_id) "


@query("b17_enrich", CANON + _CVE_AGG + "SELECT r.node_id, r.release, coalesce(n, 0) AS cve_count, n IS NOT NULL AS has_cve, coalesce(names, '') AS names FROM releases r LEFT JOIN c USING (node_id)")
def _(t):
    rows = build.enrich(t.releases, t.cve_list)
    names = F.array_join(F.transform("cve_list", lambda c: F.concat_ws("/", c["name"], c["severity"])), ",")
    return rows.select("node_id", "release", F.col("cve_count").cast("long").alias("cve_count"), "has_cve", names.alias("names"))


@query("b18_node_records", CANON + ", i AS (SELECT dst AS node_id, count(*) AS n FROM dep_edges GROUP BY 1), o AS (SELECT src AS node_id, count(*) AS n FROM dep_edges GROUP BY 1) SELECT r.node_id, c.cve_id AS name, c.severity, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM releases r LEFT JOIN cve_list c USING (node_id) LEFT JOIN i USING (node_id) LEFT JOIN o USING (node_id)")
def _(t):
    return build.node_records(t.releases, t.cve_list, t.dep_edges, one_row_per_cve=True).select("node_id", "name", "severity", "in_degree", "out_degree")


@query("b21_undirected", CANON + "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM dep_edges WHERE src <> dst")
def _(t):
    return build.undirected(t.dep_edges, t.releases)


@query("b22_nodes_and_edges", CANON + "SELECT 'releases' AS part, count(*) AS n FROM releases UNION ALL SELECT label, count(*) FROM raw_edges GROUP BY label")
def _(t):
    return t.releases.agg(F.count("*").alias("n")).select(F.lit("releases").alias("part"), "n").unionByName(t.raw_edges.groupBy(F.col("label").alias("part")).agg(F.count("*").alias("n")))


@query("b23_release_keys", CANON + """, p AS (SELECT node_id, split_part(release, ':', 1) AS g, split_part(release, ':', 2) AS a, version FROM releases),
k AS (SELECT 'pkg' AS kind, g || ':' || a AS key, node_id FROM p UNION ALL SELECT 'pkg_version', g || ':' || a || '@' || version, node_id FROM p UNION ALL SELECT 'artifact', a, node_id FROM p
  UNION ALL SELECT 'base', a, node_id FROM p UNION ALL SELECT 'prefix', 'lib', node_id FROM p UNION ALL SELECT 'prefix2', a, node_id FROM p)
SELECT kind, key, count(*) AS n, min(node_id) AS lo FROM k GROUP BY kind, key""")
def _(t):
    parts = F.split("release", ":")
    parsed = t.releases.select("node_id", parts[0].alias("grp"), parts[1].alias("artifact"), "version")
    return build.release_keys(parsed).groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("node_id").alias("lo"))


@query("b24_neighbours", CANON + "SELECT node_id, CAST(sum(f) AS BIGINT) AS forward, CAST(sum(b) AS BIGINT) AS backward FROM (SELECT src AS node_id, 1 AS f, 0 AS b FROM dep_edges UNION ALL SELECT dst, 0, 1 FROM dep_edges) GROUP BY node_id")
def _(t):
    both = t.dep_edges.select(F.col("src").alias("node_id"), F.lit(1).alias("f"), F.lit(0).alias("b")).unionByName(t.dep_edges.select(F.col("dst").alias("node_id"), F.lit(0).alias("f"), F.lit(1).alias("b")))
    return both.groupBy("node_id").agg(F.sum("f").alias("forward"), F.sum("b").alias("backward"))


@query("e01_lookup_join", CANON + "SELECT r.release, c.cve_id FROM releases r LEFT JOIN cve_list c USING (node_id)")
def _(t):
    return t.releases.join(t.cve_list, "node_id", "left").select("release", "cve_id")


@query("e02_asof_values", CANON + """SELECT node_id, cve_id, version_seen FROM (
  SELECT c.node_id, c.cve_id, r.version AS version_seen, row_number() OVER (PARTITION BY c.cve_id ORDER BY r.ts DESC, r.node_id DESC) AS k
  FROM cve_list c JOIN releases o USING (node_id) JOIN releases r ON r.software_id = o.software_id AND r.ts <= o.ts + 15552000000) WHERE k = 1""")
def _(t):
    points = t.cve_list.select("node_id", "cve_id").join(t.releases, "node_id").select("node_id", "cve_id", "software_id", (F.col("ts") + 15552000000).alias("at"))
    found = build.asof_past(points, t.releases)
    return found.join(t.releases.select(F.col("node_id").alias("past"), F.col("version").alias("version_seen")), "past").select("node_id", "cve_id", "version_seen")


@query("e03_interval_join", CANON + _WINDOW + "SELECT src, count(*) AS n FROM win GROUP BY src")
def _(t):
    return build.resolve_edges(t.raw_edges.filter("label = 'dependency'"), t.releases, strategy="window").groupBy("src").agg(F.count("*").alias("n"))


@query("e04_semi_join", CANON + "SELECT src, dst FROM dep_edges WHERE dst IN (SELECT node_id FROM cve_list)")
def _(t):
    return t.dep_edges.join(t.cve_list.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst")


@query("e05_anti_join", CANON + "SELECT cve_id, node_id FROM cve_list WHERE node_id NOT IN (SELECT src FROM dep_edges UNION SELECT dst FROM dep_edges)")
def _(t):
    return t.cve_list.join(build.used_nodes(t.dep_edges, t.releases), "node_id", "left_anti").select("cve_id", "node_id")


@query("e07_zip_join", "SELECT a.o_orderkey AS sample_id, a.o_custkey AS gt, b.l_suppkey AS pred FROM orders a JOIN (SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1) b ON a.o_orderkey = b.l_orderkey")
def _(t):
    gt = t.raw("orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("gt"))
    pred = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.min("l_suppkey").alias("pred"))
    return gt.join(pred, "sample_id")


@query("e10_fuzzy_join", "SELECT s_name, min(c_name) AS first_match FROM supplier JOIN customer ON contains(substr(c_name, 10), ltrim(substr(s_name, 10), '0')) WHERE ltrim(substr(s_name, 10), '0') <> '' GROUP BY s_name")
def _(t):
    """Substring join: every supplier's number against the names that hold it."""
    number = t.raw("supplier").select("s_name", F.ltrim(F.substring("s_name", 10, 30), F.lit("0")).alias("key")).filter("key <> ''")
    name = t.raw("customer").select("c_name", F.substring("c_name", 10, 30).alias("text"))
    return number.join(substrings.contained(number, name), "key").join(name, "text").groupBy("s_name").agg(F.min("c_name").alias("first_match"))


@query("e10_resolved_packages", """WITH n AS (SELECT DISTINCT ltrim(substr(c_name, 10), '0') AS name FROM customer), k AS (SELECT DISTINCT ltrim(substr(s_name, 10), '0') AS key FROM supplier WHERE s_suppkey % 3 > 0)
SELECT name, CASE WHEN bool_or(name = key) THEN name ELSE min(key) END AS key, CASE WHEN bool_or(name = key) THEN 'equal' ELSE 'part' END AS how FROM n JOIN k ON contains(name, key) OR contains(key, name) WHERE name <> '' AND key <> '' GROUP BY name""")
def _(t):
    """Customers' numbers by the first supplier's number that is equal, or contains it or is in it."""
    number = lambda x: F.ltrim(F.substring(x, 10, 30), F.lit("0"))
    return substrings.resolve(t.raw("customer").select(number("c_name").alias("name")), t.raw("supplier").filter("s_suppkey % 3 > 0").select(number("s_name").alias("key")))
