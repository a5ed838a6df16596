"""Queries of ground truth (M), localisers (N), evaluation (O) and perturbation (P)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text, versions
from ..operators import aggregate, evaluate, graph, ground_truth, localise, lookup, paths, robust, vectors
from ..sources import advisories
from ..sources.shared import shared_dir, written
from .registry import query
from .tables import CANON

c = F.col

# An advisory for every software: introduced in its second version, fixed in its sixth, introduced again in its eighth.
_SPANS = """, ev AS (SELECT software_id, ord AS idx, CASE WHEN ord IN (2, 8) THEN version END AS introduced, CASE WHEN ord = 6 THEN version END AS fixed FROM releases WHERE ord IN (2, 6, 8)),
sp AS (SELECT a.software_id, a.introduced, min_by(b.fixed, b.idx) AS fixed, a.idx AS lo, coalesce(min(b.idx), 1000000) AS hi FROM ev a LEFT JOIN ev b ON b.software_id = a.software_id AND b.idx > a.idx AND b.fixed IS NOT NULL WHERE a.introduced IS NOT NULL GROUP BY a.software_id, a.introduced, a.idx)
"""


def _spans(t):
    o = c("ord")
    events = t.releases.filter(o.isin(2, 6, 8)).select(F.concat(F.lit("CVE-1-"), c("software_id").cast("string")).alias("cve_id"), c("software_id").alias("package"), o.alias("idx"), F.when(o.isin(2, 8), c("version")).alias("introduced"), F.when(o == 6, c("version")).alias("fixed"))
    return ground_truth.range_pairs(events)


def _named(t):
    return t.releases.select(c("software_id").alias("package"), "node_id", "ts", "version")


@query("m01_root_causes", CANON + _SPANS + "SELECT 'CVE-1-' || r.software_id AS cve_id, r.software_id AS package, min_by(r.node_id, r.ts * 1000000 + r.node_id) AS node_id, count(DISTINCT r.node_id) AS n, 0.8 AS confidence FROM sp JOIN releases r ON r.software_id = sp.software_id AND r.ord >= lo AND r.ord < hi GROUP BY r.software_id")
def _(t):
    spans = _spans(t)
    said = spans.select("cve_id", F.lit("OSV").alias("source"), F.array(F.lit("abcdef1")).alias("fix_commits"))
    return ground_truth.root_causes(spans, _named(t), said).select("cve_id", "package", "node_id", "n", F.round("confidence", 6).alias("confidence"))


@query("m02_range_pairs", CANON + _SPANS + "SELECT software_id AS package, introduced, fixed FROM sp")
def _(t):
    return _spans(t).select("package", "introduced", "fixed")


@query("m02_affected_releases", CANON + _SPANS + "SELECT DISTINCT r.software_id AS package, r.node_id FROM sp JOIN releases r ON r.software_id = sp.software_id AND r.ord >= lo AND r.ord < hi")
def _(t):
    return ground_truth.affected(_spans(t), _named(t)).select("package", "node_id")


@query("m03_temporal_entries", CANON + "SELECT 'C' || software_id AS cve_id, software_id || '@' || CASE WHEN software_id % 3 = 0 THEN min_by(version, ord) ELSE max_by(version, ord) END AS origin_version, CASE WHEN software_id % 3 = 0 THEN count(*) ELSE 1 END AS n FROM releases WHERE software_id % 3 <> 1 GROUP BY software_id")
def _(t):
    seq = localise.sequences(t.releases).select(c("software_id").cast("string").alias("package"), "versions")
    v = F.when(c("package").cast("int") % 3 == 0, "0").when(c("package").cast("int") % 3 == 1, "0123456789abcdef0123456789").otherwise(F.element_at("versions", -1))
    roots = seq.select(F.concat(F.lit("C"), "package").alias("cve_id"), "package", v.alias("version"), F.lit(0.5).alias("confidence"))
    return ground_truth.temporal_entries(roots, seq).select("cve_id", "origin_version", F.size("version_sequence").cast("long").alias("n"))


@query("m04_entries_from_advisories", CANON + _SPANS + "SELECT 'CVE-1-' || software_id AS cve_id, software_id AS package, min_by(introduced, lo) AS origin FROM sp GROUP BY software_id")
def _(t):
    order = Window.partitionBy("cve_id", "package").orderBy(versions.sort_key(c("introduced")))
    return _spans(t).withColumn("k", F.row_number().over(order)).filter("k = 1").select("cve_id", "package", c("introduced").alias("origin"))


def _osv(t):
    """An OSV container for every software: a range, the same again, and one of commits; three ways to write the name."""
    s = t.releases.select("software_id").distinct()
    n = c("software_id").cast("string")
    name = F.when(c("software_id") % 3 == 0, F.concat(F.lit("org.c:lib"), n, F.lit("-core"))).when(c("software_id") % 3 == 1, F.concat(F.lit("acme/LIB"), n)).otherwise(F.concat(F.lit("lib"), n))
    event = lambda i, f: F.struct(i.alias("introduced"), f.alias("fixed"))
    none = F.lit(None).cast("string")
    start = F.when(c("software_id") % 2 == 0, "0").otherwise("1.0.2")
    spans = lambda kind, e: F.struct(F.lit(kind).alias("type"), F.lit("https://git/x/y.git").alias("repo"), e.alias("events"))
    semver = spans("SEMVER", F.array(event(start, none), event(none, F.lit("1.0.6")), event(F.lit("1.0.8"), none)))
    git = spans("GIT", F.array(event(F.lit("0123456789abcdef0123"), none)))
    pack = F.struct(F.struct(F.lit("Maven").alias("ecosystem"), name.alias("name")).alias("package"), F.array(semver, git).alias("ranges"))
    record = F.struct(F.concat(F.lit("GHSA-"), n).alias("id"), F.array(F.lit("GHSA-0"), F.concat(F.lit("CVE-1-"), n)).alias("aliases"), F.array(pack, pack).alias("affected"))
    return s.select(F.lit("osv").alias("source"), F.to_json(record).alias("data"))


@query("m04_osv_entries", CANON + """, v AS (SELECT software_id, list(version ORDER BY ord) AS vs FROM releases GROUP BY software_id),
o AS (SELECT software_id, vs, CASE WHEN software_id % 2 = 0 THEN vs[1] ELSE '1.0.2' END AS o, '1.0.6' AS d FROM v UNION ALL SELECT software_id, vs, '1.0.8', vs[len(vs)] FROM v),
f AS (SELECT software_id, vs, o, min_by(d, CASE WHEN d = '1.0.6' THEN 0 ELSE 1 END) AS d FROM o GROUP BY software_id, vs, o)
SELECT 'CVE-1-' || f.software_id AS cve_id, 'lib' || f.software_id AS package, 'lib' || f.software_id || '@' || o AS origin_version, 'lib' || f.software_id || '@' || d AS discovered_version, len(vs) AS n,
  coalesce(round(abs(b.ts - a.ts) / 86400000, 2), 0.0) AS lag
FROM f LEFT JOIN releases a ON a.software_id = f.software_id AND a.version = o LEFT JOIN releases b ON b.software_id = f.software_id AND b.version = d""")
def _(t):
    index = t.releases.select(F.concat(F.lit("lib"), c("software_id").cast("string")).alias("package"), "node_id", "ts", "version")
    entries = ground_truth.entries_from_spans(advisories.osv_spans(_osv(t)), index)
    return entries.select("cve_id", "package", "origin_version", "discovered_version", F.size("version_sequence").cast("long").alias("n"), c("time_lag_days").alias("lag"))


@query("m05_origin_version", CANON + _SPANS + "SELECT software_id AS package, min_by(introduced, lo) AS origin_version, max_by(fixed, hi) FILTER (fixed IS NOT NULL) AS fixed_version FROM sp GROUP BY software_id")
def _(t):
    return ground_truth.origin(_spans(t)).select("package", "origin_version", "fixed_version")


@query("m06_split_sources", "SELECT CASE WHEN event_id % 3 = 0 THEN 'NVD' ELSE 'OSV' END AS source, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def _(t):
    meta = t.raw("events").filter("event_type = 'error'").select(c("user_id").alias("node_id"), c("event_id").alias("cve_id"), F.when(c("event_id") % 3 == 0, "NVD").otherwise("OSV").alias("source"), c("props").alias("payload"))
    osv, nvd = ground_truth.split_sources(meta)
    return osv.unionByName(nvd).groupBy("source").agg(F.count("*").alias("n"))


@query("m07_release_index", CANON + "SELECT 'org.c' || (software_id % 20) || ':lib-' || software_id AS key, count(*) AS n, min_by(version, ts * 1000000 + node_id) AS first FROM releases GROUP BY software_id")
def _(t):
    return ground_truth.release_index(t.releases).select("key", "n", "first")


@query("m08_package_index", CANON + "SELECT 'lib-' || software_id AS package, string_agg(node_id, ',' ORDER BY node_id) AS nodes FROM releases GROUP BY software_id")
def _(t):
    index = lookup.package_index(t.releases.select("node_id", text.coordinates(c("release"))["package"].alias("package")))
    rows = index.filter("kind = 'artifact'").groupBy(c("key").alias("package")).agg(F.array_sort(F.collect_list("node_id")).alias("l"))
    return rows.select("package", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("nodes"))


@query("m08_nodes_of_packages", CANON + "SELECT software_id AS q, node_id, CASE WHEN software_id % 3 = 0 THEN 'full' ELSE 'artifact' END AS kind FROM releases WHERE software_id % 3 < 2")
def _(t):
    """Packages asked for by their whole name, under a group that doesn't exist, or by an unknown name."""
    index = lookup.package_index(t.releases.select("node_id", text.coordinates(c("release"))["package"].alias("package")))
    n = c("q").cast("string")
    name = F.when(c("q") % 3 == 0, F.concat(F.lit(" Org.C"), (c("q") % 20).cast("string"), F.lit(":lib-"), n)).when(c("q") % 3 == 1, F.concat(F.lit("other:Lib-"), n)).otherwise(F.concat(F.lit("no-"), n))
    return lookup.nodes_of(t.releases.select(c("software_id").alias("q")).distinct().withColumn("package", name), index)


@query("m09_family_merge", CANON + "SELECT 'before' AS state, count(DISTINCT software_id) AS n FROM releases UNION ALL SELECT 'after', count(DISTINCT software_id % 20) FROM releases")
def _(t):
    before = t.releases.agg(F.countDistinct(text.coordinates(c("release"))["package"]).alias("n")).select(F.lit("before").alias("state"), "n")
    return before.unionByName(t.releases.agg(F.countDistinct(F.split("release", ":")[0]).alias("n")).select(F.lit("after").alias("state"), "n"))


@query("m09_merge_effect", CANON + ", s AS (SELECT DISTINCT software_id FROM releases) SELECT 'before' AS state, (SELECT count(*) FROM s) AS n_keys, (SELECT count(*) FROM releases) AS n_releases, (SELECT count(*) FROM s) * 2 AS n_asked, (SELECT count(*) FROM s) AS n_met UNION ALL SELECT 'after', (SELECT count(*) FROM s), (SELECT count(*) FROM releases), (SELECT count(*) FROM s) * 2, (SELECT count(*) FROM s) * 2")
def _(t):
    """Advisories for every package and for one more artifact of each, which only the family has."""
    names = t.releases.select(text.coordinates(c("release"))["package"].alias("package")).distinct()
    more = names.select(F.concat("package", F.lit("-core")).alias("package"))
    return ground_truth.merge_effect(t.releases, names.unionByName(more))


@query("m10_paths_by_root", CANON + """, st AS (SELECT e.dst AS src, e.src AS dst FROM family_edges e JOIN family a ON a.node_id = e.dst JOIN family b ON b.node_id = e.src WHERE b.ts >= a.ts),
walk(origin, node_id, depth) AS (SELECT node_id, node_id, 0 FROM family WHERE node_id % 50 = 0 UNION SELECT origin, s.dst, depth + 1 FROM walk JOIN st s ON s.src = walk.node_id WHERE depth < 6),
ld AS MATERIALIZED (SELECT origin, node_id, min(depth) AS depth FROM walk GROUP BY ALL),
before AS MATERIALIZED (SELECT l.origin, l.node_id, min(e.src) AS parent FROM ld l JOIN st e ON e.dst = l.node_id JOIN ld p ON p.origin = l.origin AND p.node_id = e.src AND p.depth = l.depth - 1 WHERE l.depth > 0 GROUP BY ALL),
pth(origin, node_id, path) AS (SELECT origin, node_id, CAST(node_id AS VARCHAR) FROM ld WHERE depth = 0 UNION ALL SELECT b.origin, b.node_id, path || '>' || b.node_id FROM pth JOIN before b ON b.origin = pth.origin AND b.parent = pth.node_id)
SELECT 'CVE-' || origin AS cve_id, origin AS root_id, node_id AS leaf, path FROM pth WHERE node_id <> origin AND NOT EXISTS (SELECT 1 FROM before b WHERE b.origin = pth.origin AND b.parent = pth.node_id)""")
def _(t):
    """The reference paths of J19 through a store: written as steps, read again, and as node sequences by root and CVE."""
    nodes, edges = written(t.family, "nodes"), written(t.family_edges, "edges")
    roots = nodes.filter("node_id % 50 = 0").select(F.concat(F.lit("CVE-"), c("node_id").cast("string")).alias("cve_id"), "node_id", F.lit(0.8).alias("confidence"))
    folder = f"{shared_dir(t.spark)}/path-store-{uuid.uuid4().hex}"
    paths.store(graph.reference_paths(roots, edges, nodes), folder)
    return paths.sequences(paths.load(t.spark, folder)).withColumn("path", paths.text(c("path")))


_E = "CAST(a.embedding AS DOUBLE[])"
_F = "CAST(b.embedding AS DOUBLE[])"
_HITS = f", knn AS (SELECT * FROM (SELECT a.pid AS qid, b.pid AS node_id, 1 - list_dot_product({_E}, {_F}) AS d, row_number() OVER (PARTITION BY a.pid ORDER BY 1 - list_dot_product({_E}, {_F}), b.pid) AS k FROM points a, points b WHERE a.pid % 50 = 0) WHERE k <= 15)"


def _hits(t):
    q = t.points.filter("pid % 50 = 0").select(c("pid").alias("qid"), c("embedding").alias("q"))
    return vectors.exact(q, t.points, 15).select("qid", c("pid").alias("node_id"), "distance")


_RANKED = _HITS + """, z AS (SELECT qid, node_id, d, ts, min(ts) OVER (PARTITION BY qid) AS lo, max(ts) OVER (PARTITION BY qid) AS hi FROM knn JOIN releases USING (node_id)),
s AS (SELECT qid, node_id, round(0.7 * (1 - (ts - lo) / (hi - lo)) + 0.3 / (1 + abs(d)), 9) AS score FROM z)
"""


@query("n01_root_cause_ranking", CANON + _HITS + ", dg AS (SELECT node_id, count(*) AS g FROM (SELECT src AS node_id FROM dep_edges UNION ALL SELECT dst FROM dep_edges) GROUP BY 1) SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN r.software_id % 5 = qid % 5 THEN 1 ELSE 0 END DESC, coalesce(g, 0) DESC, ts, node_id) AS rank FROM knn JOIN releases r USING (node_id) LEFT JOIN dg USING (node_id)")
def _(t):
    """Neighbours of a query text, those in its community first, then by centrality and earliness."""
    rows = _hits(t).join(t.releases, "node_id").join(aggregate.degrees(t.dep_edges), "node_id", "left").na.fill(0, ["degree"])
    order = Window.partitionBy("qid").orderBy(F.desc((c("software_id") % 5 == c("qid") % 5).cast("int")), F.desc("degree"), "ts", "node_id")
    return rows.select("qid", "node_id", F.row_number().over(order).alias("rank"))


@query("n01_root_cause_analysis")
def _(t):
    """Neighbours of a query, its sub-graph's communities scored, those of the best community first."""
    return localise.root_causes(_hits(t), t.releases, t.dep_edges, aggregate.node_scores(t.cve_list), 15)


@query("n02_vector_temporal", CANON + _RANKED + "SELECT qid, max(score) AS best, count(*) AS n FROM s GROUP BY qid")
def _(t):
    return localise.vector_temporal(_hits(t), t.releases).groupBy("qid").agg(F.max(F.round("score", 9)).alias("best"), F.count("*").alias("n"))


def _entries(t):
    return t.cve_list.select("cve_id", "node_id").join(t.releases.select("node_id", "software_id", c("ts").alias("at")), "node_id")


@query("n03_temporal_only", CANON + "SELECT e.cve_id, min_by(r.version, r.ts * 1000000 + r.node_id) AS origin, 'temporal_window' AS method FROM (SELECT c.cve_id, r.software_id, r.ts AS t0 FROM cve_list c JOIN releases r USING (node_id)) e JOIN releases r ON r.software_id = e.software_id AND r.ts BETWEEN t0 - 63072000000 AND t0 GROUP BY e.cve_id")
def _(t):
    return localise.temporal_only(_entries(t), t.releases)


@query("n03_versions_back", CANON + "SELECT c.cve_id, q.version AS origin, 'n_back' AS method FROM cve_list c JOIN releases r USING (node_id) JOIN releases l ON l.software_id = r.software_id AND l.ord = (SELECT max(ord) FROM releases m WHERE m.software_id = r.software_id AND m.ts <= r.ts) JOIN releases q ON q.software_id = r.software_id AND q.ord = greatest(1, l.ord - 3)")
def _(t):
    return localise.temporal_only(_entries(t), t.releases, back=3)


@query("n04_earliest", CANON + "SELECT software_id, min_by(version, ts * 1000000 + node_id) AS origin FROM releases GROUP BY software_id")
def _(t):
    return localise.earliest(t.releases)


@query("n09_batch_prediction", CANON + _RANKED + "SELECT CAST(count(DISTINCT qid) AS BIGINT) AS n_queries, count(*) AS n_predictions, round(count(*) / count(DISTINCT qid), 6) AS mean_length FROM s")
def _(t):
    ranked = localise.vector_temporal(_hits(t), t.releases)
    return ranked.agg(F.countDistinct("qid").alias("n_queries"), F.count("*").alias("n_predictions"), F.round(F.count("*") / F.countDistinct("qid"), 6).alias("mean_length"))


@query("n09_predictions", CANON + _RANKED + "SELECT qid, node_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS INTEGER) AS rank, round(score, 6) AS score FROM s")
def _(t):
    """The ranked list of every query, a row for each prediction."""
    return localise.vector_temporal(_hits(t), t.releases).withColumn("score", F.round("score", 6))


# Ground truth: a software's first version. Prediction: three versions before its last. Confidence by the number of versions.
_GT = """, q AS (SELECT software_id, list(version ORDER BY ord) AS vs, list(ts ORDER BY ord) AS tss, count(*) AS n FROM releases GROUP BY software_id),
p AS (SELECT software_id AS sample_id, vs[1] AS gt, vs[greatest(1, n - 3)] AS pred, greatest(1, n - 3) - 1 AS distance, abs(tss[greatest(1, n - 3)] - tss[1]) / 86400000.0 AS error_days, 1 - 1.0 / (1 + n) AS confidence FROM q)
"""


def _pred(t):
    seq = localise.sequences(t.releases)
    pred = versions.back(c("versions"), F.element_at("versions", -1), 3)
    rows = seq.select(c("software_id").alias("sample_id"), c("versions")[0].alias("gt"), pred.alias("pred"), "versions", (1 - 1 / (1 + F.size("versions"))).alias("confidence"))
    when = t.releases.select(c("software_id").alias("sample_id"), "version", "ts")
    rows = rows.join(when.select("sample_id", c("version").alias("gt"), c("ts").alias("gt_ts")), ["sample_id", "gt"])
    return rows.join(when.select("sample_id", c("version").alias("pred"), c("ts").alias("pred_ts")), ["sample_id", "pred"])


def _metrics(t):
    rows = _pred(t)
    return evaluate.sample_metrics(rows).join(rows.select("sample_id", "confidence"), "sample_id")


@query("n10_evaluated_samples", CANON + _GT + "SELECT sample_id, gt, pred FROM p")
def _(t):
    return _pred(t).select("sample_id", "gt", "pred")


# Three runs: as given, without a tenth of the edges, with jittered times.
_RUNS = """, hashed AS (SELECT *, CAST('0x' || substr(md5(concat_ws(',', node_id, 42)), 1, 15) AS BIGINT) AS h FROM releases),
rel AS MATERIALIZED (SELECT r AS run, node_id, software_id, version, ts, ord FROM releases, unnest([0, 1]) AS q(r)
  UNION ALL SELECT 2, node_id, software_id, version, ts + (h % 7 + 1) * (CASE WHEN (h >> 32) % 2 = 0 THEN 1 ELSE -1 END) * 86400000, ord FROM hashed),
edg AS MATERIALIZED (SELECT r AS run, src, dst FROM dep_edges, unnest([0, 1, 2]) AS q(r) WHERE r <> 1 OR CAST('0x' || substr(md5(concat_ws(',', src, dst, 42)), 1, 15) AS BIGINT) % 1000000 >= 100000)"""


def _runs(t):
    releases = written(t.releases.select("node_id", "software_id", "version", "ts"), "releases")
    return robust.perturbed(releases, written(t.dep_edges, "edges"))


@query("n10_evaluation_matrix", CANON + _RUNS + """, uses AS (SELECT run, dst AS node_id, count(*) AS n FROM edg GROUP BY ALL), ends AS (SELECT run, software_id, max(ts) AS at_end FROM rel GROUP BY ALL),
preds AS (SELECT 'earliest' AS algorithm, run, software_id, min_by(version, struct_pack(a := ts, b := node_id)) AS pred FROM rel GROUP BY ALL
  UNION ALL SELECT 'dependents', run, software_id, min_by(version, struct_pack(a := -coalesce(n, 0), b := ts, c := node_id)) FROM rel LEFT JOIN uses USING (run, node_id) GROUP BY ALL
  UNION ALL SELECT 'window', run, software_id, min_by(version, struct_pack(a := ts, b := node_id)) FROM rel JOIN ends USING (run, software_id) WHERE ts >= at_end - 63072000000 GROUP BY ALL),
gt AS (SELECT software_id, max(ord) AS gt FROM releases WHERE ord <= 2 GROUP BY 1),
ev AS (SELECT p.algorithm, p.run, abs(r.ord - gt) AS d, p.pred = b.pred AS same FROM preds p JOIN gt USING (software_id) JOIN releases r ON r.software_id = p.software_id AND r.version = p.pred JOIN preds b ON b.run = 0 AND b.algorithm = p.algorithm AND b.software_id = p.software_id)
SELECT algorithm, run, count(*) AS n, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0 END), 9) AS exact, round(avg(CASE WHEN d <= 1 THEN 1.0 ELSE 0 END), 9) AS within_1, round(avg(CASE WHEN d <= 3 THEN 1.0 ELSE 0 END), 9) AS within_3, round(avg(d), 9) AS mean_distance,
  round(avg(CASE WHEN same THEN 1.0 ELSE 0 END), 9) AS stable, list_sort(list(d))[count(*) // 2 + 1] AS median_distance, list_sort(list(d))[least(count(*) - 1, CAST(floor(0.95 * count(*)) AS BIGINT)) + 1] AS p95_distance FROM ev GROUP BY ALL""")
def _(t):
    """Every localiser on every run, against each software's second version, in one plan."""
    sequences = localise.sequences(t.releases).withColumnRenamed("software_id", "sample_id")
    truth = sequences.select("sample_id", F.element_at("versions", F.least(F.lit(2), F.size("versions"))).alias("gt"))
    rows = robust.summary(robust.evaluated(robust.predictions(*_runs(t)), truth, sequences.select("sample_id", "versions")))
    return rows.select("algorithm", "run", "n", *(F.round(x, 9).alias(x) for x in ("exact", "within_1", "within_3", "mean_distance", "stable")), "median_distance", "p95_distance")


@query("p05_robustness", CANON + _SPANS + _RUNS + """, root AS MATERIALIZED (SELECT run, 'CVE-1-' || r.software_id AS cve_id, min_by(r.node_id, struct_pack(a := r.ts, b := r.node_id)) AS node_id FROM sp JOIN rel r ON r.software_id = sp.software_id AND r.ord >= lo AND r.ord < hi WHERE r.software_id % 50 = 0 GROUP BY run, r.software_id),
st AS MATERIALIZED (SELECT e.run, e.dst AS src, e.src AS dst FROM edg e JOIN rel a ON a.node_id = e.dst AND a.run = e.run JOIN rel b ON b.node_id = e.src AND b.run = e.run WHERE b.ts >= a.ts),
walk(run, cve_id, node_id, depth) AS (SELECT run, cve_id, node_id, 0 FROM root UNION SELECT w.run, cve_id, s.dst, depth + 1 FROM walk w JOIN st s ON s.src = w.node_id AND s.run = w.run WHERE depth < 6),
ld AS MATERIALIZED (SELECT run, cve_id, node_id, min(depth) AS depth FROM walk GROUP BY ALL),
steps AS MATERIALIZED (SELECT l.run, l.cve_id, min(e.src) AS src, l.node_id AS dst FROM ld l JOIN st e ON e.dst = l.node_id AND e.run = l.run JOIN ld p ON p.run = l.run AND p.cve_id = l.cve_id AND p.node_id = e.src AND p.depth = l.depth - 1 WHERE l.depth > 0 GROUP BY l.run, l.cve_id, l.node_id),
items AS MATERIALIZED (SELECT 'roots' AS what, run, cve_id || ' ' || node_id AS item FROM root UNION ALL SELECT 'steps', run, cve_id || ' ' || src || ' ' || dst FROM steps),
size_ AS (SELECT what, count(*) AS k FROM items WHERE run = 0 GROUP BY 1)
SELECT i.what, i.run, count(*) AS n, count(b.item) AS shared, round(count(b.item) / greatest(1, count(*) + any_value(k) - count(b.item)), 9) AS overlap FROM items i JOIN size_ USING (what) LEFT JOIN items b ON b.run = 0 AND b.what = i.what AND b.item = i.item GROUP BY ALL""")
def _(t):
    """Root causes and their reference paths, built anew on every run, for every 50th package."""
    spans = _spans(t).filter("package % 50 = 0")
    said = spans.select("cve_id", F.lit("OSV").alias("source"), F.array(F.lit("abcdef1")).alias("fix_commits")).distinct()
    roots, steps = robust.rebuilt(*_runs(t), spans, said)
    cve = F.substring_index("cve_id", "#", 1).alias("cve_id")
    own = lambda x: robust.id_of(c(x)).alias(x)
    parts = {"roots": robust.stability(roots.select("run", cve, own("node_id")), ["cve_id", "node_id"]), "steps": robust.stability(steps.select("run", cve, own("src"), own("dst")), ["cve_id", "src", "dst"])}
    both = [rows.select(F.lit(what).alias("what"), "run", "n", "shared", F.round("overlap", 9).alias("overlap")) for what, rows in parts.items()]
    return both[0].unionByName(both[1])


@query("o01_rank_metrics", "WITH s AS (SELECT event_type AS g, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) SELECT round(avg(1.0 / r), 9) AS mrr, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 9) AS hits FROM s WHERE event_id % 10 = 0")
def _(t):
    s = t.raw("events").select(c("event_type").alias("group"), c("event_id").alias("node_id"), c("value").alias("score"))
    return evaluate.rank_metrics(s, s.filter("node_id % 10 = 0").select("group", "node_id")).select(F.round("mrr", 9).alias("mrr"), F.round("hits", 9).alias("hits"))


@query("o02_lead_time", CANON + ", x AS (SELECT (ts - 788918400000) // 15552000000 AS w, software_id AS s, CAST(count(*) AS DOUBLE) AS k FROM releases GROUP BY ALL), z AS (SELECT w, s, (k - avg(k) OVER v) / CASE WHEN coalesce(stddev_samp(k) OVER v, 0) = 0 THEN 1 ELSE stddev_samp(k) OVER v END AS z FROM x WINDOW v AS (PARTITION BY w)), a AS (SELECT s, min(w) * 15552000000 AS alarm FROM z WHERE z >= 0.8 GROUP BY s), e AS (SELECT software_id AS s, max(ts) - 788918400000 AS t FROM releases GROUP BY 1) SELECT round(avg((t - alarm) / 86400000.0), 6) AS lead_days, count(*) AS n FROM a JOIN e USING (s) WHERE t >= alarm")
def _(t):
    s = t.releases.groupBy((F.floor((c("ts") - 788918400000) / 15552000000) * 15552000000).alias("t"), c("software_id").alias("node_id")).agg(F.count("*").cast("double").alias("score"))
    e = t.releases.groupBy(c("software_id").alias("node_id")).agg((F.max("ts") - 788918400000).alias("t"))
    return evaluate.lead_time(s, e).select(F.round("lead_days", 6).alias("lead_days"), "n")


@query("o03_community_purity", CANON + ", mates AS (SELECT r.node_id AS root, m.node_id FROM family r JOIN family m ON m.software_id % 5 = r.software_id % 5 WHERE r.node_id % 50 = 0), near AS (SELECT DISTINCT root, node_id FROM (SELECT src AS root, dst AS node_id FROM family_edges UNION ALL SELECT dst, src FROM family_edges) WHERE root % 50 = 0), x AS (SELECT root, count(*) AS b FROM mates JOIN near USING (root, node_id) GROUP BY root) SELECT root, round(coalesce(b, 0) / (SELECT count(*) FROM mates m WHERE m.root = r.root), 9) AS purity, round(coalesce(coalesce(b, 0) / nullif((SELECT count(*) FROM near n WHERE n.root = r.root), 0), 0), 9) AS coverage FROM (SELECT node_id AS root FROM family WHERE node_id % 50 = 0) r LEFT JOIN x USING (root)")
def _(t):
    comm = t.family.select("node_id", (c("software_id") % 5).alias("comm"))
    return evaluate.purity(comm, t.family_edges, t.family.filter("node_id % 50 = 0")).select("root", F.round("purity", 9).alias("purity"), F.round("coverage", 9).alias("coverage"))


@query("o03_purity_of_communities")
def _(t):
    """Of the communities that modularity finds."""
    edges = graph.written(t.family_edges, "pu")
    return evaluate.purity(graph.communities(t.family, edges), edges, t.family.filter("node_id % 50 = 0"))


_PF = ", k AS (SELECT DISTINCT src % 4 AS g, src AS p, dst AS n FROM family_edges), f AS (SELECT DISTINCT g, p, n FROM k WHERE n % 3 <> 0), ks AS (SELECT g, p, count(*) AS n FROM k GROUP BY ALL), fs AS (SELECT g, p, count(*) AS n FROM f GROUP BY ALL), sh AS (SELECT k.g, k.p AS kp, f.p AS fp, count(*) AS s FROM k JOIN f ON k.g = f.g AND k.n = f.n GROUP BY ALL), hit AS (SELECT sh.* FROM sh JOIN ks ON ks.g = sh.g AND ks.p = kp JOIN fs ON fs.g = sh.g AND fs.p = fp WHERE s / (ks.n + fs.n - s) >= 0.5)"


@query("o04_path_f1", CANON + _PF + " SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re + 1e-9), 6) AS f1 FROM (SELECT (SELECT count(DISTINCT (g, fp)) FROM hit) / ((SELECT count(*) FROM fs) + 1e-9) AS pr, (SELECT count(DISTINCT (g, kp)) FROM hit) / ((SELECT count(*) FROM ks) + 1e-9) AS re)")
def _(t):
    k = written(t.family_edges, "edges").select((c("src") % 4).alias("group"), c("src").alias("path_id"), c("dst").alias("node_id"))
    return evaluate.path_f1(k, k.filter("node_id % 3 <> 0")).select(*(F.round(x, 6).alias(x) for x in ("precision", "recall", "f1")))


@query("o05_node_f1", CANON + ", k AS (SELECT DISTINCT dst AS n FROM family_edges), f AS (SELECT DISTINCT src AS n FROM family_edges) SELECT round(2 * (SELECT count(*) FROM k WHERE n IN (SELECT n FROM f)) / ((SELECT count(*) FROM k) + (SELECT count(*) FROM f)), 6) AS f1")
def _(t):
    return evaluate.node_f1(t.family_edges.select(c("dst").alias("node_id")), t.family_edges.select(c("src").alias("node_id"))).select(F.round("f1", 6).alias("f1"))


@query("o06_version_distance", CANON + _GT + "SELECT sample_id, CAST(CASE WHEN sample_id % 2 = 0 THEN distance ELSE 0 END AS INTEGER) AS d FROM p")
def _(t):
    rows = _pred(t)
    known = evaluate.version_distance(c("gt"), c("pred"), c("versions"))
    other = evaluate.version_distance(c("gt"), c("gt"), F.array().cast("array<string>"))
    return rows.select("sample_id", F.when(c("sample_id") % 2 == 0, known).otherwise(other).alias("d"))


@query("o07_sample_metrics", CANON + _GT + "SELECT sample_id, CAST(distance AS INTEGER) AS distance, distance <= 0 AS exact, distance <= 1 AS within_1, distance <= 3 AS within_3, round(error_days, 6) AS error_days FROM p")
def _(t):
    return evaluate.sample_metrics(_pred(t)).withColumn("error_days", F.round("error_days", 6))


@query("o08_roll_up", CANON + _GT + ", o AS (SELECT distance, row_number() OVER (ORDER BY distance) - 1 AS i, count(*) OVER () AS n FROM p) SELECT count(*) AS n, round(avg(CASE WHEN distance = 0 THEN 1.0 ELSE 0.0 END), 9) AS exact, round(avg(CASE WHEN distance <= 1 THEN 1.0 ELSE 0.0 END), 9) AS within_1, round(avg(CASE WHEN distance <= 3 THEN 1.0 ELSE 0.0 END), 9) AS within_3, round(avg(distance), 9) AS mean_distance, CAST(max(distance) FILTER (i = n // 2) AS INTEGER) AS median_distance, CAST(max(distance) FILTER (i = CAST(floor(0.95 * n) AS BIGINT)) AS INTEGER) AS p95_distance FROM o")
def _(t):
    return evaluate.roll_up(_metrics(t)).select("n", *(F.round(x, 9).alias(x) for x in ("exact", "within_1", "within_3", "mean_distance")), "median_distance", "p95_distance")


@query("o09_time_accuracy", CANON + _GT + "SELECT round(avg(error_days), 6) AS mean_days, round(median(error_days), 6) AS median_days, round(avg(CASE WHEN error_days <= 30 THEN 1.0 ELSE 0.0 END), 6) AS within_30, round(avg(CASE WHEN error_days <= 90 THEN 1.0 ELSE 0.0 END), 6) AS within_90 FROM p")
def _(t):
    return evaluate.time_accuracy(_metrics(t)).select(*(F.round(x, 6).alias(x) for x in ("mean_days", "median_days", "within_30", "within_90")))


@query("o10_utility", CANON + _GT + "SELECT round(avg(distance), 6) AS review_effort, round(coalesce(avg(CASE WHEN distance = 0 THEN 1.0 ELSE 0.0 END) FILTER (confidence >= 0.7), 0), 6) AS confident_accuracy, count(*) FILTER (confidence >= 0.7) AS n_confident FROM p")
def _(t):
    return evaluate.utility(_metrics(t)).select(F.round("review_effort", 6).alias("review_effort"), F.round("confident_accuracy", 6).alias("confident_accuracy"), "n_confident")


@query("o11_calibration", CANON + _GT + "SELECT round(avg(abs(b - a)), 6) AS calibration_error FROM (SELECT floor(confidence * 10) / 10 AS b, avg(CASE WHEN distance = 0 THEN 1.0 ELSE 0.0 END) AS a FROM p GROUP BY 1)")
def _(t):
    return evaluate.calibration(_metrics(t)).select(F.round("calibration_error", 6).alias("calibration_error"))


@query("o12_accuracy_by_lag", CANON + _GT + ", g AS (SELECT CASE WHEN error_days < 30 THEN '<30' WHEN error_days < 180 THEN '<180' WHEN error_days < 365 THEN '<365' ELSE '>=365' END AS g, avg(CASE WHEN distance = 0 THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM p GROUP BY 1) SELECT b.g AS \"group\", round(coalesce(a, 0), 6) AS accuracy, coalesce(n, 0) AS n FROM (SELECT unnest(['<30', '<180', '<365', '>=365']) AS g) b LEFT JOIN g USING (g)")
def _(t):
    return evaluate.by_group(_metrics(t), evaluate.lag_bucket(c("error_days")), ["<30", "<180", "<365", ">=365"]).withColumn("accuracy", F.round("accuracy", 6))


@query("o13_all_metrics", CANON + _GT + "SELECT 'exact' AS metric, round(avg(CASE WHEN distance = 0 THEN 1.0 ELSE 0.0 END), 6) AS value FROM p UNION ALL SELECT 'mean_days', round(avg(error_days), 6) FROM p UNION ALL SELECT 'review_effort', round(avg(distance), 6) FROM p")
def _(t):
    m = _metrics(t)
    one = m.agg(F.avg((c("distance") == 0).cast("double")).alias("exact"), F.avg("error_days").alias("mean_days"), F.avg("distance").alias("review_effort"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.round(k, 6).alias("value")) for k in ("exact", "mean_days", "review_effort")))).alias("x")).select("x.*")


@query("o14_fused_ranking", CANON + ", a AS (SELECT dst AS node_id, count(*) AS k FROM family_edges GROUP BY 1), b AS (SELECT node_id, software_id % 7 AS s FROM family) SELECT node_id, round(0.6 * coalesce(k, 0) + 0.4 * s, 6) AS score FROM b LEFT JOIN a USING (node_id)")
def _(t):
    """Path counts and community scores fused by 0.6 and 0.4."""
    paths = t.family_edges.groupBy(c("dst").alias("node_id")).agg(F.count("*").alias("k"))
    rows = t.family.select("node_id", (c("software_id") % 7).alias("s")).join(paths, "node_id", "left").na.fill(0)
    return rows.select("node_id", F.round(0.6 * c("k") + 0.4 * c("s"), 6).alias("score"))


@query("o14_fused_communities")
def _(t):
    """Edges into a release as its paths, and the score of its community by CVE scores and centrality."""
    edges = graph.written(t.family_edges, "fu")
    comm = graph.written(graph.communities(t.family, edges), "fu")
    of = graph.choose_community(comm, t.family, edges, aggregate.node_scores(t.cve_list), w_early=0.0)
    return evaluate.fused(t.family, edges.groupBy(c("dst").alias("node_id")).agg(F.count("*").alias("n")), comm, of)


_PREDS = ", pr AS (SELECT src AS cve_id, dst AS node_id, row_number() OVER (PARTITION BY src ORDER BY dst) AS rank FROM dep_edges), vul AS (SELECT DISTINCT node_id FROM cve_list), nn AS (SELECT count(*) AS n FROM releases)"


@query("o15_top_k", CANON + _PREDS + ", ks AS (SELECT unnest([1, 3]) AS k), s AS (SELECT DISTINCT k, node_id FROM pr, ks WHERE rank <= k) SELECT k, count(*) AS inspected, count(v.node_id) AS found, round(count(v.node_id) / (SELECT count(*) FROM vul), 6) AS recall, round(count(v.node_id) / count(*), 6) AS precision, round(1 - count(*) / (SELECT n FROM nn), 6) AS effort_spared FROM s LEFT JOIN vul v USING (node_id) GROUP BY k")
def _(t):
    p = t.dep_edges.select(c("src").alias("cve_id"), c("dst").alias("node_id"), F.row_number().over(Window.partitionBy("src").orderBy("dst")).alias("rank"))
    return evaluate.top_k(p, t.cve_list, t.releases.count(), [1, 3]).select("k", "inspected", "found", *(F.round(x, 6).alias(x) for x in ("recall", "precision", "effort_spared")))


@query("o16_depth_mrr", CANON + ", l AS (SELECT src, list(dst ORDER BY dst) AS preds FROM dep_edges GROUP BY src), r AS (SELECT src, max(dst) AS root FROM dep_edges GROUP BY src) SELECT round(avg(coalesce(1.0 / list_position(preds, root), 0)), 9) AS mrr FROM l JOIN r USING (src)")
def _(t):
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    lists = t.dep_edges.select(c("src").alias("cve_id"), rank.alias("rank"), c("dst").alias("node_id"))
    roots = t.dep_edges.groupBy(c("src").alias("cve_id")).agg(F.max("dst").alias("root")).withColumn("depth_limit", F.lit(1))
    return evaluate.mrr_by_depth(roots, lists).select(F.round("mrr", 9).alias("mrr"))


@query("o16_mrr_by_depth", CANON + """, st AS (SELECT e.dst AS src, e.src AS dst FROM family_edges e JOIN family a ON a.node_id = e.dst JOIN family b ON b.node_id = e.src WHERE b.ts >= a.ts),
walk(origin, node_id, depth) AS (SELECT node_id, node_id, 0 FROM family WHERE node_id % 50 = 0 UNION SELECT origin, s.dst, depth + 1 FROM walk JOIN st s ON s.src = walk.node_id WHERE depth < 3),
ld AS MATERIALIZED (SELECT origin, node_id, min(depth) AS depth FROM walk WHERE node_id <> origin GROUP BY 1, 2),
pr AS MATERIALIZED (SELECT dst AS origin, src AS node_id, row_number() OVER (PARTITION BY dst ORDER BY src) AS rank FROM dep_edges)
SELECT k AS depth_limit, count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM ld JOIN (SELECT unnest([1, 2, 3]) AS k) ON depth <= k LEFT JOIN pr USING (origin, node_id) WHERE origin IN (SELECT origin FROM pr) GROUP BY k""")
def _(t):
    """Reference paths cut at depths of 1 to 3, against each origin's dependents in order."""
    nodes, edges = written(t.family, "nodes"), written(t.family_edges, "edges")
    roots = nodes.filter("node_id % 50 = 0").select(c("node_id").cast("string").alias("cve_id"), "node_id", F.lit(0.8).alias("confidence"))
    found = graph.reference_paths(roots, edges, nodes, depth=3).select("cve_id", c("dst").alias("root"), F.explode(F.sequence(c("depth"), F.lit(3))).alias("depth_limit"))
    rank = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    lists = edges.select(c("dst").cast("string").alias("cve_id"), rank.alias("rank"), c("src").alias("node_id"))
    return evaluate.mrr_by_depth(found, lists).withColumn("mrr", F.round("mrr", 9))


@query("o17_agreement", "WITH b AS (SELECT event_id, event_id % 3 AS x, user_id % 3 AS y FROM events), a AS (SELECT count(*) AS n, avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) AS raw FROM b), e AS (SELECT sum(kx * ky) AS s FROM (SELECT x AS l, count(*) AS kx FROM b GROUP BY x) JOIN (SELECT y AS l, count(*) AS ky FROM b GROUP BY y) USING (l)) SELECT n, round(raw, 6) AS raw, round((raw - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM a, e")
def _(t):
    e = t.raw("events")
    return evaluate.agreement(e.select(c("event_id").alias("cve_id"), (c("event_id") % 3).alias("label")), e.select(c("event_id").alias("cve_id"), (c("user_id") % 3).alias("label"))).select("n", F.round("raw", 6).alias("raw"), F.round("kappa", 6).alias("kappa"))


@query("o18_control_drop", "WITH b AS (SELECT event_type AS metric, avg(value) AS base, avg(value) FILTER (event_id % 2 = 0) AS control FROM events GROUP BY 1) SELECT metric, round((base - control) / base * 100, 6) AS drop_percent FROM b")
def _(t):
    m = lambda rows: rows.groupBy(c("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    e = t.raw("events")
    return evaluate.drop_percent(m(e), m(e.filter("event_id % 2 = 0"))).select("metric", F.round("drop_percent", 6).alias("drop_percent"))


@query("o19_masked_scores", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN value ELSE 0.0 END AS score FROM events")
def _(t):
    e = t.raw("events").select(c("event_id").alias("node_id"), c("value").alias("score"), "event_type")
    kept = e.filter(c("event_type").isin("view", "click")).select("node_id")
    return evaluate.mask_or_fill(e.select("node_id", "score"), kept).withColumnRenamed("node_id", "event_id")


@query("p01_deleted_edges", CANON + "SELECT src, dst FROM dep_edges WHERE CAST('0x' || substr(md5(concat_ws(',', src, dst, 42)), 1, 15) AS BIGINT) % 1000000 >= 100000")
def _(t):
    return evaluate.delete_edges(t.dep_edges, 0.1)


_MOVED = ", hashed AS (SELECT *, CAST('0x' || substr(md5(concat_ws(',', node_id, 42)), 1, 15) AS BIGINT) AS h FROM releases), moved AS (SELECT node_id, software_id, version, ts + (h % 7 + 1) * (CASE WHEN (h >> 32) % 2 = 0 THEN 1 ELSE -1 END) * 86400000 AS ts FROM hashed) "


@query("p02_jittered_times", CANON + _MOVED + "SELECT node_id, ts FROM moved")
def _(t):
    return evaluate.jitter(t.releases.select("node_id", "ts"))


@query("p03_permuted_times", CANON + "SELECT ts, count(*) AS n FROM releases GROUP BY ts")
def _(t):
    """The permuted times, counted: as many of each as before."""
    return evaluate.permute_times(t.releases.select("node_id", "ts")).groupBy("ts").agg(F.count("*").alias("n"))


@query("p04_stratified_sample", CANON + "SELECT severity, least(count(*), 5) AS n FROM cve_list GROUP BY severity")
def _(t):
    return evaluate.stratified(t.cve_list, "severity", 5, "cve_id").groupBy("severity").agg(F.count("*").alias("n"))


@query("p05_jittered_origins", CANON + _MOVED + ", a AS (SELECT software_id, min_by(version, struct_pack(a := ts, b := node_id)) AS v FROM releases GROUP BY 1), b AS (SELECT software_id, min_by(version, struct_pack(a := ts, b := node_id)) AS v FROM moved GROUP BY 1) SELECT count(*) AS n, avg(CASE WHEN a.v = b.v THEN 1.0 ELSE 0.0 END) AS stable FROM a JOIN b USING (software_id)")
def _(t):
    """Version metrics of the earliest-release localiser on jittered times."""
    moved = t.releases.drop("ts").join(evaluate.jitter(t.releases.select("node_id", "ts")), "node_id")
    truth = localise.earliest(t.releases)
    return truth.join(localise.earliest(moved).withColumnRenamed("origin", "found"), "software_id").agg(F.count("*").alias("n"), F.avg((c("origin") == c("found")).cast("double")).alias("stable"))
