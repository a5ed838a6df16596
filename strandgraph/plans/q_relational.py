"""Queries of aggregations (F), ranking (G), top-k (H), set operations (I), and the similarity and window joins (E06, E08, E09, E11)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text, versions
from ..operators import aggregate, build, localise, windows
from .registry import query
from .tables import CANON

c = F.col
_DEG = ", deg AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM dep_edges UNION ALL SELECT dst FROM dep_edges) GROUP BY 1) "
_CSET = ", cs AS (SELECT DISTINCT cve_id, software_id FROM cve_list JOIN releases USING (node_id)), "


@query("e08_jaccard_join", "WITH s AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS i FROM lineitem), n AS (SELECT o, count(*) AS n FROM s GROUP BY o) SELECT * FROM (SELECT x.o AS a, y.o AS b, round(count(*) / (min(p.n) + min(q.n) - count(*)), 6) AS jaccard FROM s x JOIN s y ON x.i = y.i AND x.o < y.o JOIN n p ON p.o = x.o JOIN n q ON q.o = y.o GROUP BY 1, 2) WHERE jaccard > 0.5")
def _(t):
    sets = t.raw("lineitem").select(c("l_orderkey").alias("owner"), c("l_suppkey").alias("item")).distinct()
    return aggregate.jaccard_pairs(sets, 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("e09_earliest_node", CANON + "SELECT software_id, min_by(cve_id, event_order) AS cve_id, min(ts) AS origin_ts, max(ts) AS discovered_ts FROM (SELECT r.software_id, c.cve_id, r.ts, r.ts * 1000000 + r.node_id AS event_order FROM cve_list c JOIN releases r USING (node_id)) GROUP BY software_id")
def _(t):
    rows = t.cve_list.select("cve_id", "node_id").join(t.releases, "node_id")
    return rows.groupBy("software_id").agg(F.min_by("cve_id", F.struct("ts", "node_id", "cve_id")).alias("cve_id"), F.min("ts").alias("origin_ts"), F.max("ts").alias("discovered_ts"))


@query("e11_unify", CANON + ", a AS (SELECT node_id, count(*) AS n_cves FROM cve_list GROUP BY 1), b AS (SELECT owner_id AS node_id, count(*) AS n_values FROM added_values GROUP BY 1) SELECT coalesce(a.node_id, b.node_id) AS node_id, coalesce(n_cves, 0) AS n_cves, coalesce(n_values, 0) AS n_values FROM a FULL OUTER JOIN b ON a.node_id = b.node_id")
def _(t):
    a = t.cve_list.groupBy("node_id").agg(F.count("*").alias("n_cves"))
    b = t.added_values.groupBy(c("owner_id").alias("node_id")).agg(F.count("*").alias("n_values"))
    return a.join(b, "node_id", "full_outer").na.fill(0)


@query("f01_degree_top", CANON + _DEG + "SELECT node_id, degree FROM deg ORDER BY degree DESC, node_id LIMIT 10")
def _(t):
    return aggregate.degree_top(t.dep_edges)


@query("f02_software_with_cves", CANON + "SELECT src AS node_id, count(*) AS n FROM raw_edges WHERE label = 'relationship_AR' AND dst IN (SELECT node_id FROM cve_list) GROUP BY 1 ORDER BY n DESC, node_id LIMIT 10")
def _(t):
    return aggregate.cve_out_degree(t.raw_edges, t.cve_list, "dst", "relationship_AR")


@query("f03_cve_releases_by_dependencies", CANON + "SELECT src AS node_id, count(*) AS n FROM raw_edges WHERE label = 'dependency' AND src IN (SELECT node_id FROM cve_list) GROUP BY 1 ORDER BY n DESC, node_id LIMIT 10")
def _(t):
    return aggregate.cve_out_degree(t.raw_edges, t.cve_list, "src", "dependency")


@query("f04_degree_centrality_top", CANON + _DEG + "SELECT node_id, round(degree / ((SELECT count(*) FROM releases) - 1), 12) AS cent FROM deg ORDER BY degree DESC, node_id LIMIT 10")
def _(t):
    n = t.releases.count()
    return aggregate.degree_top(t.dep_edges).select("node_id", F.round(c("degree") / (n - 1), 12).alias("cent"))


_SEV = "CASE severity WHEN 'CRITICAL' THEN 9.5 WHEN 'HIGH' THEN 8.0 WHEN 'MEDIUM' THEN 5.5 ELSE 2.0 END"
for _how, _fn in (("sum", "sum"), ("max", "max"), ("mean", "avg")):

    @query(f"f05_node_score_{_how}", CANON + f"SELECT node_id, round(CAST({_fn}(CASE WHEN cve_id LIKE '%7' THEN 1.5 ELSE {_SEV} END) AS DOUBLE), 6) AS score FROM cve_list GROUP BY node_id")
    def _(t, how=_how):
        own = t.cve_list.filter("cve_id LIKE '%7'").select("cve_id", F.lit(1.5).alias("score"))
        return aggregate.node_scores(t.cve_list, own, how).select("node_id", F.round("score", 6).alias("score"))


@query("f06_severity_sum", CANON + "SELECT node_id, CAST(sum(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS BIGINT) AS severity FROM cve_list GROUP BY node_id")
def _(t):
    return t.cve_list.groupBy("node_id").agg(F.sum(scores.severity_rank(c("severity"))).alias("severity"))


_FEAT = ", feat AS (SELECT owner_id, coalesce(max(num) FILTER (type = 'POPULARITY_1_YEAR'), 0) AS popularity, CAST(coalesce(max(k), 0) AS DOUBLE) AS freshness_missrelease, CAST(coalesce(max(k), 0) AS DOUBLE) AS freshness_outdays, coalesce(max(num) FILTER (type = 'SPEED'), 0) AS speed FROM added_values GROUP BY owner_id)"


@query("f07_features", CANON + _FEAT + " SELECT * FROM feat")
def _(t):
    return aggregate.features(t.added_values)


_MATRIX = _FEAT + """, sev AS (SELECT node_id, sum(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS severity FROM cve_list GROUP BY node_id),
outd AS (SELECT src AS node_id, count(*) AS outdegree FROM dep_edges GROUP BY 1), deg AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM dep_edges UNION ALL SELECT dst FROM dep_edges) GROUP BY 1),
m AS (SELECT r.node_id, coalesce(popularity, 0) AS popularity, coalesce(freshness_missrelease, 0) AS freshness_missrelease, coalesce(freshness_outdays, 0) AS freshness_outdays, coalesce(speed, 0) AS speed,
  CAST(coalesce(severity, 0) AS DOUBLE) AS severity, CAST(coalesce(outdegree, 0) AS DOUBLE) AS outdegree, CAST(coalesce(degree, 0) AS DOUBLE) AS degree
  FROM releases r LEFT JOIN feat ON owner_id = r.node_id LEFT JOIN sev USING (node_id) LEFT JOIN outd USING (node_id) LEFT JOIN deg USING (node_id))
"""


def _matrix(t):
    return aggregate.feature_matrix(t.releases, t.added_values, t.cve_list, t.dep_edges)


@query("f08_feature_matrix", CANON + _MATRIX + "SELECT * FROM m")
def _(t):
    return _matrix(t)


@query("f09_correlations", CANON + _MATRIX + "SELECT 'speed' AS a, 'degree' AS b, round(corr(speed, degree), 6) AS corr FROM m UNION ALL SELECT 'degree', 'speed', round(corr(degree, speed), 6) FROM m UNION ALL SELECT 'speed', 'speed', 1.0 UNION ALL SELECT 'degree', 'degree', 1.0")
def _(t):
    return aggregate.correlations(_matrix(t), ["speed", "degree"]).select("a", "b", F.round("corr", 6).alias("corr"))


@query("f10_stepwise_regression", CANON + _MATRIX + "SELECT 1 AS step, 'degree' AS feature, round(regr_r2(outdegree, degree), 6) AS r2 FROM m")
def _(t):
    first = aggregate.stepwise(_matrix(t), "outdegree", ["degree", "speed", "popularity", "severity"])[:1]
    return t.spark.createDataFrame([(k + 1, f, round(r, 6)) for k, (f, r) in enumerate(first)], "step int, feature string, r2 double")


@query("f10_all_steps")
def _(t):
    """Every step of the selection, with the R2 that it reaches."""
    steps = aggregate.stepwise(_matrix(t), "outdegree", ["degree", "speed", "popularity", "severity"])
    return t.spark.createDataFrame([(k + 1, f, round(r, 6)) for k, (f, r) in enumerate(steps)], "step int, feature string, r2 double")


@query("f11_correlation_weight", CANON + _MATRIX + """, r AS (SELECT abs(corr(freshness_missrelease, outdegree)) AS a, abs(corr(freshness_outdays, outdegree)) AS b, abs(corr(popularity, outdegree)) AS c, abs(corr(speed, outdegree)) AS d, abs(corr(severity, outdegree)) AS e FROM m),
w AS (SELECT node_id, (freshness_missrelease * a + freshness_outdays * b + popularity * c + speed * d + severity * e) / (a + b + c + d + e) AS w FROM m, r)
SELECT node_id, round((w - (SELECT min(w) FROM w)) / ((SELECT max(w) FROM w) - (SELECT min(w) FROM w)) * 1000, 4) AS weight FROM w""")
def _(t):
    return aggregate.correlation_weight(_matrix(t), scale=1000.0).select("node_id", F.round("weight", 4).alias("weight"))


@query("f12_community_score", CANON + _DEG + """, s AS (SELECT node_id, sum(CASE severity WHEN 'CRITICAL' THEN 9.5 WHEN 'HIGH' THEN 8.0 WHEN 'MEDIUM' THEN 5.5 ELSE 2.0 END) AS cve_score FROM cve_list GROUP BY node_id),
n AS (SELECT r.node_id, software_id % 10 AS comm, CAST(coalesce(cve_score, 0) AS DOUBLE) AS cve_score, CAST(coalesce(degree, 0) AS DOUBLE) AS cent, ts FROM releases r LEFT JOIN s USING (node_id) LEFT JOIN deg USING (node_id))
SELECT comm, round(sum(cve_score) + sum(cent) - 0.5 * min(ts), 3) AS score, max_by(node_id, struct_pack(a := cve_score + cent, b := -ts, c := -node_id)) AS representative, count(*) AS n FROM n GROUP BY comm""")
def _(t):
    cent = aggregate.degrees(t.dep_edges).select("node_id", c("degree").cast("double").alias("cent"))
    nodes = t.releases.select("node_id", (c("software_id") % 10).alias("comm"), "ts").join(aggregate.node_scores(t.cve_list).withColumnRenamed("score", "cve_score"), "node_id", "left").join(cent, "node_id", "left").na.fill(0.0)
    return aggregate.community_scores(nodes).withColumn("score", F.round("score", 3))


_INF = {
    "max": "SELECT label, round(max(s), 6) AS influence FROM x GROUP BY label",
    "mean": "SELECT label, round(avg(s), 6) AS influence FROM x GROUP BY label",
    "topk_mean": "SELECT label, round(avg(s), 6) AS influence FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC) AS r FROM x) WHERE r <= 5 GROUP BY label",
    "gini": "SELECT label, round(greatest(0, (n + 1 - 2 * cum / s) / n), 6) AS influence FROM (SELECT label, count(*) AS n, sum(s) AS s, sum(rs) AS cum FROM (SELECT *, sum(s) OVER (PARTITION BY label ORDER BY s ROWS UNBOUNDED PRECEDING) AS rs FROM x) GROUP BY label)",
    "entropy": "SELECT label, round(-sum(p * ln(p + 1e-10)), 6) AS influence FROM (SELECT label, s / sum(s) OVER (PARTITION BY label) AS p FROM x) GROUP BY label",
}
for _how, _sql in _INF.items():

    @query(f"f13_influence_{_how}", "WITH x AS (SELECT event_type AS label, value AS s FROM events) " + _sql)
    def _(t, how=_how):
        rows = t.raw("events").select(c("event_type").alias("label"), c("value").alias("score"))
        return windows.influence(rows, ["label"], how).select("label", F.round("influence", 6).alias("influence"))


@query("f14_median", "SELECT user_id, round(median(value), 6) AS m FROM events GROUP BY user_id")
def _(t):
    return t.raw("events").groupBy("user_id").agg(F.round(F.median("value"), 6).alias("m"))


@query("f15_node_hits", "WITH s AS (SELECT label, vec_id, 1 / (1 + abs(CAST(embedding[1] AS DOUBLE))) AS sim FROM embeddings) SELECT label, round(max(sim), 6) AS top, round(avg(sim), 6) AS mean, round(sum(sim), 4) AS total, max_by(vec_id, sim) AS best FROM s GROUP BY label")
def _(t):
    s = t.raw("embeddings").select("label", "vec_id", (1 / (1 + F.abs(c("embedding")[0].cast("double")))).alias("sim"))
    return s.groupBy("label").agg(F.round(F.max("sim"), 6).alias("top"), F.round(F.avg("sim"), 6).alias("mean"), F.round(F.sum("sim"), 4).alias("total"), F.max_by("vec_id", "sim").alias("best"))


@query("f16_cve_dates", CANON + "SELECT node_id, min(ts) AS first_cve, max(ts) AS last_cve FROM cve_list GROUP BY node_id")
def _(t):
    return t.cve_list.groupBy("node_id").agg(F.min("ts").alias("first_cve"), F.max("ts").alias("last_cve"))


@query("f17_group_counts", CANON + "SELECT type, count(*) AS n FROM added_values GROUP BY type UNION ALL SELECT severity, count(*) FROM cve_list GROUP BY severity")
def _(t):
    return t.added_values.groupBy("type").agg(F.count("*").alias("n")).unionByName(t.cve_list.groupBy(c("severity").alias("type")).agg(F.count("*").alias("n")))


@query("f18_multimaps", CANON + ", w AS (SELECT cve_id, node_id, unnest(regexp_extract_all(cwe_ids, 'CWE-\\d+')) AS cwe FROM cve_list) SELECT cwe, count(DISTINCT cve_id) AS n_cves, count(DISTINCT software_id) AS n_packages FROM w JOIN releases USING (node_id) GROUP BY cwe")
def _(t):
    rows = t.cve_list.select("cve_id", "node_id", F.explode(text.cwe_list(c("cwe_ids"))).alias("cwe")).join(t.releases, "node_id")
    return rows.groupBy("cwe").agg(F.countDistinct("cve_id").alias("n_cves"), F.countDistinct("software_id").alias("n_packages"))


@query("f19_package_rollup", CANON + "SELECT regexp_replace(release, ':[^:]*$', '') AS package, count(DISTINCT node_id) AS n_releases, count(*) AS n_cves FROM cve_list JOIN releases USING (node_id) GROUP BY 1")
def _(t):
    rows = t.cve_list.select("cve_id", "node_id").join(t.releases, "node_id")
    return rows.groupBy(F.regexp_replace("release", ":[^:]*$", "").alias("package")).agg(F.countDistinct("node_id").alias("n_releases"), F.count("*").alias("n_cves"))


@query("f20_freshness", CANON + _FEAT + ", b AS (SELECT min(freshness_missrelease) AS l1, max(freshness_missrelease) AS h1, min(speed) AS l2, max(speed) AS h2 FROM feat) SELECT owner_id, round(0.6 * (freshness_missrelease - l1) / (h1 - l1) + 0.4 * (speed - l2) / (h2 - l2), 6) AS score FROM feat, b")
def _(t):
    rows = aggregate.min_max(aggregate.features(t.added_values), ["freshness_missrelease", "speed"])
    return rows.select("owner_id", F.round(0.6 * c("freshness_missrelease") + 0.4 * c("speed"), 6).alias("score"))


@query("f21_zscore", "SELECT event_id, round((value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type), 6) AS z, round((value - avg(value) OVER (PARTITION BY user_id)) / CASE WHEN stddev_pop(value) OVER (PARTITION BY user_id) = 0 THEN 1 ELSE stddev_pop(value) OVER (PARTITION BY user_id) END, 6) AS zp FROM events")
def _(t):
    return t.raw("events").select("event_id", F.round(aggregate.zscore(c("value"), ["event_type"]), 6).alias("z"), F.round(aggregate.zscore(c("value"), ["user_id"], population=True), 6).alias("zp"))


@query("f22_safe_mean", "SELECT user_id, round(coalesce(avg(CASE WHEN event_type = 'view' THEN value END), 0), 6) AS m FROM events GROUP BY user_id")
def _(t):
    return t.raw("events").groupBy("user_id").agg(F.round(F.coalesce(F.avg(F.when(c("event_type") == "view", c("value"))), F.lit(0.0)), 6).alias("m"))


@query("f23_graph_statistics", CANON + "SELECT (SELECT count(*) FROM releases WHERE ts IS NOT NULL) AS with_ts, (SELECT count(DISTINCT node_id) FROM cve_list) AS vulnerable, (SELECT count(*) FROM cve_list) AS cves")
def _(t):
    return build.enrich(t.releases, t.cve_list).agg(F.count("ts").alias("with_ts"), F.count_if("has_cve").alias("vulnerable"), F.sum("cve_count").alias("cves"))


@query("f24_path_ratio", CANON + "SELECT avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) AS ratio FROM (SELECT node_id, (SELECT count(*) FROM dep_edges WHERE src = node_id) AS n FROM releases)")
def _(t):
    paths = t.releases.join(build.adjacency(t.dep_edges), c("node_id") == c("src"), "left").select(F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("path"))
    return paths.agg(F.avg((F.size("path") > 0).cast("double")).alias("ratio"))


@query("f25_family_statistics", CANON + "SELECT software_id % 20 AS family, count(*) AS n, min(ts) AS first, max(ts) AS last FROM releases GROUP BY 1 ORDER BY n DESC, family LIMIT 10")
def _(t):
    return aggregate.top(t.releases.groupBy((c("software_id") % 20).alias("family")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last")), "n", "family", 10)


@query("f26_combined_centrality", CANON + _DEG + ", s AS (SELECT node_id, CAST(degree AS DOUBLE) AS score FROM deg UNION ALL SELECT node_id, CAST(count(*) AS DOUBLE) FROM cve_list GROUP BY 1) SELECT node_id, sum(score) AS score FROM s GROUP BY 1 ORDER BY score DESC, node_id LIMIT 10")
def _(t):
    return aggregate.combined([aggregate.degrees(t.dep_edges).select("node_id", c("degree").cast("double").alias("score")), t.cve_list.groupBy("node_id").agg(F.count("*").cast("double").alias("score"))])


@query("f27_value_counts", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return t.raw("events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query("g01_rank", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def _(t):
    return t.raw("events").select("event_id", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")).alias("rank"))


@query("g02_precision_at_k", "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 5 AS INTEGER) AS hit FROM events")
def _(t):
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return t.raw("events").select("event_id", (rank <= 5).cast("int").alias("hit"))


@query("g03_root_pick", CANON + _DEG + "SELECT software_id, max_by(node_id, struct_pack(a := coalesce(degree, 0), b := -ts, d := -node_id)) AS root FROM releases LEFT JOIN deg USING (node_id) GROUP BY software_id")
def _(t):
    rows = t.releases.join(aggregate.degrees(t.dep_edges), "node_id", "left").na.fill(0, ["degree"])
    return rows.groupBy("software_id").agg(F.max_by("node_id", F.struct(c("degree"), -c("ts"), -c("node_id"))).alias("root"))


@query("g04_full_ranking", CANON + _DEG + "SELECT node_id, row_number() OVER (PARTITION BY software_id ORDER BY CASE WHEN node_id % 3 = 0 THEN 1 ELSE 0 END DESC, coalesce(degree, 0) DESC, ts, node_id) AS rank FROM releases LEFT JOIN deg USING (node_id)")
def _(t):
    rows = t.releases.join(aggregate.degrees(t.dep_edges), "node_id", "left").na.fill(0, ["degree"])
    order = Window.partitionBy("software_id").orderBy(F.desc((c("node_id") % 3 == 0).cast("int")), F.desc("degree"), "ts", "node_id")
    return rows.select("node_id", F.row_number().over(order).alias("rank"))


_SEQ = ", seq AS (SELECT software_id, list(version ORDER BY ts, node_id) AS vs FROM releases GROUP BY software_id)"


@query("g05_version_sequence", CANON + _SEQ + "SELECT software_id, array_to_string(vs, ',') AS versions FROM seq")
def _(t):
    return localise.sequences(t.releases).select("software_id", F.array_join("versions", ",").alias("versions"))


@query("g06_earliest_latest", CANON + "SELECT software_id, min_by(version, ts * 1000000 + node_id) AS earliest, max_by(version, ts * 1000000 + node_id) AS latest FROM releases GROUP BY software_id")
def _(t):
    return t.releases.groupBy("software_id").agg(F.min_by("version", F.struct("ts", "node_id")).alias("earliest"), F.max_by("version", F.struct("ts", "node_id")).alias("latest"))


@query("g07_subsequence", CANON + _SEQ + "SELECT software_id, array_to_string(vs[2:4], ',') AS part FROM seq WHERE len(vs) >= 4")
def _(t):
    rows = localise.sequences(t.releases).filter(F.size("versions") >= 4)
    return rows.select("software_id", F.array_join(versions.between(c("versions"), c("versions")[1], c("versions")[3]), ",").alias("part"))


@query("g08_versions_back", CANON + _SEQ + "SELECT software_id, vs[greatest(1, len(vs) - 3)] AS origin FROM seq")
def _(t):
    return localise.sequences(t.releases).select("software_id", versions.back(c("versions"), F.element_at("versions", -1), 3).alias("origin"))


@query("g09_earliest_node", CANON + "SELECT software_id, min_by(node_id, struct_pack(a := CASE WHEN node_id % 5 = 0 THEN 9223372036854775807 ELSE ts END, b := ord)) AS node_id FROM releases GROUP BY software_id")
def _(t):
    ts = F.when(c("node_id") % 5 == 0, None).otherwise(c("ts"))
    return t.releases.groupBy("software_id").agg(F.min_by("node_id", F.struct(F.coalesce(ts, F.lit(2**63 - 1)), versions.semver(c("version")))).alias("node_id"))


@query("g10_fuzzy_position", CANON + _SEQ + "SELECT r.node_id, list_position(vs, version) - 1 AS place FROM releases r JOIN seq USING (software_id)")
def _(t):
    rows = t.releases.join(localise.sequences(t.releases), "software_id")
    return rows.select("node_id", versions.position(c("versions"), F.concat(c("version"), F.lit(".0"))).alias("place"))


_SER = ", s AS (SELECT t, n, value FROM series) "


def _series(t):
    return t.series.select(F.lit("events").alias("series"), "t", "value")


@query("g11_smooth", CANON + """, x AS (SELECT t, value, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS m, first_value(value) OVER (ORDER BY t) AS f, first_value(value) OVER (ORDER BY t DESC) AS l, sum(value) OVER (ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM series)
SELECT t, round((w + greatest(0, 2 - i + 1) * f + greatest(0, i + 2 - m) * l) / 5, 6) AS smooth FROM x""")
def _(t):
    return windows.smooth(_series(t), 5).select("t", F.round("smooth", 6).alias("smooth"))


_GRAD = """, x AS (SELECT t, value AS y, lag(value) OVER o AS y0, lead(value) OVER o AS y1, t - lag(t) OVER o AS h0, lead(t) OVER o - t AS h1 FROM series WINDOW o AS (ORDER BY t)),
g AS (SELECT t, y, CASE WHEN y0 IS NULL THEN (y1 - y) / h1 WHEN y1 IS NULL THEN (y - y0) / h0 ELSE (h0 * h0 * y1 + (h1 * h1 - h0 * h0) * y - h1 * h1 * y0) / (h0 * h1 * (h0 + h1)) END AS gradient FROM x)
"""


@query("g12_gradient", CANON + _GRAD + "SELECT t, round(gradient, 9) AS gradient FROM g")
def _(t):
    return windows.gradient(_series(t)).select("t", F.round("gradient", 9).alias("gradient"))


@query("g13_peaks", CANON + _GRAD + ", a AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS idx, abs(gradient) AS g, lag(abs(gradient)) OVER (ORDER BY t) AS p, lead(abs(gradient)) OVER (ORDER BY t) AS q FROM g) SELECT CAST(idx AS INTEGER) AS idx, t FROM a WHERE g > p AND g > q")
def _(t):
    return windows.peaks(_series(t), 0.0).select("idx", "t")


@query("g14_change_windows", CANON + _GRAD + ", a AS (SELECT t, abs(gradient) AS g, lag(abs(gradient)) OVER (ORDER BY t) AS p, lead(abs(gradient)) OVER (ORDER BY t) AS q, min(t) OVER () AS lo, max(t) OVER () AS hi FROM g), b AS (SELECT DISTINCT t FROM a WHERE (g > p AND g > q) OR t = lo OR t = hi) SELECT t_s, t_e FROM (SELECT t AS t_s, lead(t) OVER (ORDER BY t) AS t_e FROM b) WHERE t_e IS NOT NULL")
def _(t):
    return windows.change_windows(_series(t), 0.0).select("t_s", "t_e")


@query("h01_top_nodes", "WITH d AS (SELECT q.vec_id AS qid, b.label, b.vec_id, 1 - list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS d FROM embeddings q, embeddings b WHERE q.vec_id % 50 = 0) SELECT qid, label, vec_id, round(d, 6) + 0.0 AS d FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, vec_id) <= 10")
def _(t):
    from ..operators import vectors

    q = t.raw("embeddings").filter("vec_id % 50 = 0").select(c("vec_id").alias("qid"), c("embedding").alias("q"))
    hits = vectors.exact(q, t.raw("embeddings").select(c("vec_id").alias("pid"), c("label").alias("node_id"), "embedding"), 10)
    return hits.select("qid", c("node_id").alias("label"), c("pid").alias("vec_id"), (F.round("distance", 6) + 0.0).alias("d"))


@query("h03_root_in_window", CANON + "SELECT software_id, min_by(node_id, ts * 1000000 + node_id) AS root FROM releases WHERE ts BETWEEN 883612800000 AND 946684800000 GROUP BY software_id")
def _(t):
    return windows.nodes_in(t.releases, 883612800000, 946684800000, closed=True).groupBy("software_id").agg(F.min_by("node_id", F.struct("ts", "node_id")).alias("root"))


@query("h04_nearest_event", "WITH e AS (SELECT epoch_us(ts) // 1000 AS t, event_id FROM events WHERE event_type = 'error'), q AS (SELECT event_id AS qid, epoch_us(ts) // 1000 AS t FROM events WHERE event_type = 'view') SELECT qid, min_by(e.event_id, struct_pack(d := abs(e.t - q.t), i := e.event_id)) AS event_id FROM q JOIN e ON abs(e.t - q.t) <= 600000 GROUP BY qid")
def _(t):
    ms = F.unix_millis(c("ts").cast("timestamp"))
    events = t.raw("events")
    q = events.filter("event_type = 'view'").select(c("event_id").alias("qid"), ms.alias("t"))
    e = events.filter("event_type = 'error'").select("event_id", ms.alias("t"))
    return localise.nearest(q, e, 600_000)


@query("h05_representative_cases", "SELECT bucket, event_id FROM (SELECT CASE WHEN user_id = 0 THEN 'exact' WHEN user_id <= 2 THEN 'near' WHEN user_id >= 5 THEN 'far' END AS bucket, event_id, row_number() OVER (PARTITION BY CASE WHEN user_id = 0 THEN 'exact' WHEN user_id <= 2 THEN 'near' WHEN user_id >= 5 THEN 'far' END ORDER BY value DESC, event_id) AS k FROM events) WHERE bucket IS NOT NULL AND k <= 2")
def _(t):
    rows = t.raw("events").select("event_id", c("user_id").alias("distance"), c("value").alias("confidence"))
    return localise.cases(rows, per_bucket=2).select("bucket", c("event_id"))


@query("h06_auto_source", CANON + """SELECT 'earliest' AS strategy, min_by(node_id, ts * 1000000 + node_id) AS node_id FROM family UNION ALL
SELECT 'indegree0', min_by(node_id, ts * 1000000 + node_id) FROM family WHERE node_id NOT IN (SELECT dst FROM family_edges) UNION ALL
SELECT 'earliest_cve', min_by(node_id, ts * 1000000 + node_id) FROM family WHERE node_id IN (SELECT node_id FROM cve_list) UNION ALL
SELECT 'top_sim', max_by(node_id, node_id % 1000 + 1.0 / (node_id + 1)) FROM family""")
def _(t):
    sim = t.family.select("node_id", (c("node_id") % 1000 + 1.0 / (c("node_id") + 1)).alias("score"))
    out = None
    for s in ("earliest", "indegree0", "earliest_cve", "top_sim"):
        one = localise.auto_source(t.family, t.family_edges, t.cve_list, sim, s).select(F.lit(s).alias("strategy"), "node_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("i01_union_sources", CANON + "SELECT node_id, min(depth) AS depth FROM (SELECT dst AS node_id, 1 AS depth FROM family_edges UNION ALL SELECT b.dst, 2 FROM family_edges a JOIN family_edges b ON a.dst = b.src) GROUP BY node_id")
def _(t):
    one = t.family_edges.select(c("dst").alias("node_id"), F.lit(1).alias("depth"))
    two = t.family_edges.select(c("dst").alias("mid")).distinct().join(t.family_edges, c("mid") == c("src")).select(c("dst").alias("node_id"), F.lit(2).alias("depth"))
    return one.unionByName(two).groupBy("node_id").agg(F.min("depth").alias("depth"))


@query("i02_set_operations", CANON + "SELECT 'both' AS part, count(*) AS n FROM (SELECT node_id FROM cve_list INTERSECT SELECT src FROM dep_edges) UNION ALL SELECT 'only_cve', count(*) FROM (SELECT node_id FROM cve_list EXCEPT SELECT src FROM dep_edges)")
def _(t):
    a, b = t.cve_list.select("node_id"), t.dep_edges.select(c("src").alias("node_id"))
    both, only = a.intersect(b), a.distinct().join(b, "node_id", "left_anti")
    return both.agg(F.count("*").alias("n")).select(F.lit("both").alias("part"), "n").unionByName(only.agg(F.count("*").alias("n")).select(F.lit("only_cve").alias("part"), "n"))


@query("i03_path_fingerprints", CANON + ", p AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS f FROM family_edges GROUP BY src), q AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS f FROM family_edges WHERE src % 2 = 0 OR dst % 3 = 0 GROUP BY src) SELECT round((SELECT count(*) FROM q WHERE (src, f) NOT IN (SELECT src, f FROM p)) / (SELECT count(*) FROM q), 6) AS new_ratio, round((SELECT count(*) FROM q WHERE (src, f) IN (SELECT src, f FROM p)) / (SELECT count(*) FROM p), 6) AS recall")
def _(t):
    from ..operators import evaluate

    p = t.family_edges.select(c("src").alias("cve_id"), F.struct("src", "dst").alias("edge"))
    return evaluate.path_novelty(p.filter("edge.src % 2 = 0 OR edge.dst % 3 = 0"), p)


@query("i04_first_wins", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(t):
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return t.raw("events").withColumn("k", first).filter("k = 1").select("user_id", "event_id")


@query("i05_edge_coverage", CANON + "SELECT round((SELECT count(*) FROM family_edges WHERE src % 2 = 0) / (SELECT count(*) FROM family_edges), 6) AS coverage")
def _(t):
    from ..operators import evaluate

    return evaluate.edge_coverage(t.family_edges, t.family_edges.filter("src % 2 = 0"))
