"""Queries of scalar functions (C) and filters (D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text, times, versions
from ..operators import build, lookup, substrings, windows
from ..sources import advisories
from .registry import query
from .tables import CANON


def _col(name, sql, value):
    """A query over events: event_id and one computed column x."""

    @query(name, f"SELECT event_id, {sql} AS x FROM events")
    def _(t):
        return t.raw("events").select("event_id", value().alias("x"))


def _rel(name, sql, value):
    """A query over releases: node_id and one computed column x."""

    @query(name, CANON + f"SELECT node_id, {sql} AS x FROM releases")
    def _(t):
        return t.releases.select("node_id", value().alias("x"))


c = F.col
_col("c01_unescape_json", "CAST(json_extract_string(props, '$.k') AS BIGINT)", lambda: F.from_json(text.unescape_json(F.replace(c("props"), F.lit('"'), F.lit('\\"'))), "k bigint")["k"])
_col("c02_first_nonempty", "coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN '  ' WHEN event_id % 3 = 1 THEN ' a ' END), ''), nullif(trim(event_type), ''))", lambda: text.first_nonempty(F.when(c("event_id") % 3 == 0, "  ").when(c("event_id") % 3 == 1, " a "), c("event_type")))
_col("c03_advisory_text", "'CVE-' || event_id || CASE WHEN event_id % 2 = 0 THEN ': severity HIGH, CWE CWE-1, CWE-' || user_id ELSE ': CWE CWE-1, CWE-' || user_id END", lambda: text.advisory_text(F.concat(F.lit("CVE-"), c("event_id").cast("string")), F.when(c("event_id") % 2 == 0, "HIGH"), F.array(F.lit("CWE-1"), F.concat(F.lit("CWE-"), c("user_id").cast("string")))))
_col("c04_cve_id_of_record", "coalesce(nullif(trim(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE 'A' || event_id END), ''), 'B' || event_id)", lambda: text.first_nonempty(F.when(c("event_id") % 2 == 0, " ").otherwise(F.concat(F.lit("A"), c("event_id").cast("string"))), F.concat(F.lit("B"), c("event_id").cast("string"))))
_col("c05_cve_name", "CASE WHEN event_id % 2 = 0 THEN 'CVE-2024-' || event_id ELSE 'CVE-' || event_id END", lambda: text.cve_name(F.when(c("event_id") % 2 == 0, F.concat(F.lit(" cve-2024-"), c("event_id").cast("string"), F.lit(" "))).otherwise(c("event_id").cast("string"))))
_col("c06_is_cve", "(1990 + event_id % 50) BETWEEN 1999 AND 2030 AND user_id > 0", lambda: text.is_cve(F.concat(F.lit("CVE-"), (1990 + c("event_id") % 50).cast("string"), F.lit("-"), c("user_id").cast("string"))))
_col("c07_bitnami_cve", "CASE WHEN event_id % 2 = 0 THEN 'CVE-2023-' || event_id ELSE 'GHSA-' || event_id END", lambda: text.bitnami_cve(F.when(c("event_id") % 2 == 0, F.concat(F.lit("BIT-my.pkg_x-2023-"), c("event_id").cast("string"))).otherwise(F.concat(F.lit("GHSA-"), c("event_id").cast("string")))))
_col("c08_severity_score", "CASE event_type WHEN 'error' THEN 9.5 WHEN 'click' THEN 5.5 WHEN 'view' THEN 2.0 ELSE 0.0 END", lambda: scores.severity_score(F.when(c("event_type") == "error", " critical").when(c("event_type") == "click", "Moderate").when(c("event_type") == "view", "low").otherwise("?")))

_CVSS = """CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE ceil(round(CASE WHEN imp <= 0 THEN 0.0 WHEN s THEN least(1.08 * (imp + ex), 10) ELSE least(imp + ex, 10) END * 100000) / 10000) / 10 END"""


@query("c09_cvss31", f"""SELECT event_id, {_CVSS} AS x FROM (
  SELECT *, CASE WHEN s THEN 7.52 * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) ELSE 6.42 * iss END AS imp FROM (
    SELECT event_id, event_id % 2 = 1 AS s,
      8.22 * [0.85, 0.62, 0.55, 0.2][event_id % 4 + 1] * [0.77, 0.44][user_id % 2 + 1] * CASE WHEN event_id % 2 = 1 THEN [0.85, 0.68, 0.5][user_id % 3 + 1] ELSE [0.85, 0.62, 0.27][user_id % 3 + 1] END * [0.85, 0.62][event_id % 2 + 1] AS ex,
      1 - (1 - [0, 0.22, 0.56][event_id % 3 + 1]) * (1 - [0, 0.22, 0.56][user_id % 3 + 1]) * (1 - [0, 0.22, 0.56][(event_id + user_id) % 3 + 1]) AS iss FROM events))""")
def _(t):
    pick = lambda letters, k: F.element_at(F.array(*(F.lit(x) for x in letters)), (k % len(letters) + 1).cast("int"))
    e, u = c("event_id"), c("user_id")
    vector = F.concat(F.when(e % 11 == 0, "CVSS:2.0/AV:").otherwise("CVSS:3.1/AV:"), pick("NALP", e), F.lit("/AC:"), pick("LH", u), F.lit("/PR:"), pick("NLH", u), F.lit("/UI:"), pick("NR", e), F.lit("/S:"), pick("UC", e), F.lit("/C:"), pick("NLH", e), F.lit("/I:"), pick("NLH", u), F.lit("/A:"), pick("NLH", e + u))
    return t.raw("events").select("event_id", scores.cvss31(vector).alias("x"))


@query("c10_best_metric", "SELECT user_id, coalesce(max_by(value, event_id) FILTER (event_type = 'view'), max(value)) AS x FROM events GROUP BY user_id")
def _(t):
    m = F.struct("event_id", F.lit("x").alias("source"), F.when(c("event_type") == "view", "Primary").otherwise("Secondary").alias("type"), c("value").alias("score"), c("props").alias("vector"))
    return t.raw("events").groupBy("user_id").agg(F.array_sort(F.collect_list(m)).alias("ms")).select("user_id", scores.best_metric(c("ms"))["score"].alias("x"))


_col("c11_first_cvss", "CASE WHEN event_id % 2 = 0 THEN props END", lambda: scores.first_cvss(F.array(F.struct(F.lit("OTHER").alias("type"), F.lit("z").alias("score")), F.struct(F.when(c("event_id") % 2 == 0, "cvss_v3").otherwise("x").alias("type"), c("props").alias("score")))))
_col("c12_reference_urls", "CASE WHEN event_id % 2 = 0 THEN 'https://a/' || event_id ELSE '' END", lambda: F.array_join(advisories.reference_urls(F.array(F.struct(F.lit("").alias("url")), F.struct(F.when(c("event_id") % 2 == 0, F.concat(F.lit("https://a/"), c("event_id").cast("string"))).alias("url")))), ","))
_col("c13_cpe_packages", "'v:1,v:' || user_id", lambda: F.concat(F.lit("v:1,"), F.array_join(text.cpe_packages(F.array(F.concat(F.lit("cpe:2.3:a:v:"), c("user_id").cast("string"), F.lit(":1.0")), F.lit("bad"))), ",")))
_col("c14_package_names", "CASE WHEN event_id % 2 = 0 THEN 'p' || user_id ELSE 'repo' || user_id END", lambda: F.array_join(text.package_names(F.array(F.struct(F.struct(F.when(c("event_id") % 2 == 0, F.concat(F.lit("p"), c("user_id").cast("string"))).alias("name")).alias("package"), F.array(F.struct(F.concat(F.lit("https://git/x/repo"), c("user_id").cast("string"), F.lit(".git")).alias("repo"))).alias("ranges")))), ","))
_col("c15_fix_commits", "'abcdef' || (1000000 + event_id) || ',fixed'", lambda: F.array_join(text.fix_commits(F.array(F.lit("fixed")), F.array(F.struct(F.lit("FIX").alias("type"), F.concat(F.lit("https://h/commit/abcdef"), (1000000 + c("event_id")).cast("string")).alias("url")), F.struct(F.lit("WEB").alias("type"), F.lit("https://h/commit/1234567").alias("url")))), ","))


@query("c16_advisory_records", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'OSV' ELSE 'NVD' END AS source, 'CVE-2024-' || event_id AS cve_id, CASE WHEN event_id % 2 = 0 THEN 'p' || user_id END AS package FROM events WHERE event_type = 'error'")
def _(t):
    e = t.raw("events").filter("event_type = 'error'")
    name = F.concat(F.lit("CVE-2024-"), c("event_id").cast("string"))
    osv = e.filter("event_id % 2 = 0").select("event_id", F.lit("OSV").alias("source"), name.alias("cve_id"), F.concat(F.lit("p"), c("user_id").cast("string")).alias("package"))
    nvd = e.filter("event_id % 2 = 1").select("event_id", F.lit("NVD").alias("source"), name.alias("cve_id"))
    return osv.unionByName(nvd, allowMissingColumns=True)


_V31 = "'CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H'"


@query("c16_normalised_records", f"""SELECT 'GHSA-' || event_id AS id, 9.8 AS base_score, {_V31} AS vector, 'https://h/commit/abcdef' || (1000000 + event_id) AS refs, CASE WHEN event_id % 4 = 0 THEN 'p' || user_id ELSE 'repo' || user_id END AS packages,
  'abcdef' || (1000000 + event_id) || ',fix' AS commits, 'OSV' AS source FROM events WHERE event_type = 'error' AND event_id % 2 = 0
UNION ALL SELECT 'CVE-' || k || '-' || event_id, round(value, 2), 'v' || user_id, 'https://n/' || event_id, 'v:a,v:p' || user_id, '', 'NVD' FROM events, (SELECT unnest([1, 2]) AS k) WHERE event_type = 'error' AND event_id % 2 = 1""")
def _(t):
    """Containers of both feeds made of the events, as JSON text, and brought to one schema."""
    e = t.raw("events").filter("event_type = 'error'")
    i, u, lit = c("event_id").cast("string"), c("user_id").cast("string"), F.lit
    none = lit(None).cast("string")
    repo = F.when(c("event_id") % 4 != 0, F.concat(lit("https://git/x/repo"), u, lit(".git")))
    spans = F.struct(lit("SEMVER").alias("type"), repo.alias("repo"), F.array(F.struct(lit("0").alias("introduced"), none.alias("fixed")), F.struct(none.alias("introduced"), lit("fix").alias("fixed"))).alias("events"))
    names = F.struct(F.struct(F.when(c("event_id") % 4 == 0, F.concat(lit("p"), u)).alias("name")).alias("package"), F.array(spans).alias("ranges"))
    ref = F.struct(lit("fix").alias("type"), F.concat(lit("https://h/commit/abcdef"), (1000000 + c("event_id")).cast("string")).alias("url"))
    osv = F.struct(F.concat(lit("GHSA-"), i).alias("id"), F.array(F.struct(lit("CVSS_V3").alias("type"), lit(_V31.strip("'")).alias("score"))).alias("severity"), F.array(ref).alias("references"), F.array(names).alias("affected"))
    metric = lambda kind, score: F.struct(lit("x").alias("source"), lit(kind).alias("type"), F.struct(score.alias("baseScore"), F.concat(lit("v"), u).alias("vectorString")).alias("cvssData"))
    cpes = F.array(F.struct(F.concat(lit("cpe:2.3:a:v:p"), u, lit(":1.0")).alias("criteria")), F.struct(lit("cpe:2.3:a:v:a:2").alias("criteria")), F.struct(lit("bad").alias("criteria")))
    cve = lambda k: F.struct(F.struct(
        F.concat(lit(f"CVE-{k}-"), i).alias("id"), F.struct(F.array(metric("Primary", F.round("value", 2)), metric("Secondary", lit(99.0))).alias("cvssMetricV31")).alias("metrics"),
        F.array(F.struct(F.concat(lit("https://n/"), i).alias("url")), F.struct(lit("").alias("url"))).alias("references"), F.array(F.struct(F.array(F.struct(cpes.alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
    ).alias("cve"))
    nvd = F.struct(F.array(cve(1), cve(2)).alias("vulnerabilities"))
    even = c("event_id") % 2 == 0
    r = advisories.records(e.select(F.when(even, "osv").otherwise("nvd").alias("source"), F.when(even, F.to_json(osv)).otherwise(F.to_json(nvd)).alias("data")))
    joined = (F.array_join(c(x), ",").alias(y) for x, y in (("references", "refs"), ("packages", "packages"), ("fix_commits", "commits")))
    return r.select("id", c("severity.base_score").alias("base_score"), c("severity.vector").alias("vector"), *joined, "source")


@query("c17_cve_entries", CANON + "SELECT node_id, cve_id FROM cve_list")
def _(t):
    """Lists of a node's CVEs as JSON, with elements that aren't objects among them."""
    lists = t.cve_list.groupBy("node_id").agg(F.collect_list(F.to_json(F.struct(c("cve_id").alias("id"), "severity"))).alias("l"))
    return advisories.entries(lists.withColumn("l", F.concat(F.lit('[3,"x",null,{"severity":"LOW"},'), F.array_join("l", ","), F.lit("]"))), "node_id", column="l").select("node_id", "cve_id")


for _mode, _sql in (("artifact", "'lib-' || software_id"), ("simple", "'lib'"), ("group:artifact", "'org.c' || (software_id % 20) || ':lib-' || software_id"), ("right", "'org.c' || (software_id % 20) || ':lib-' || software_id"), ("family", "'lib-' || software_id")):
    _rel(f"c18_coordinates_{_mode.replace(':', '_')}", f"{_sql} || '|' || version", lambda m=_mode: F.concat_ws("|", text.coordinates(c("release"), m)["package"], text.coordinates(c("release"), m)["version"]))
_rel("c19_looks_like_version", "node_id % 2 = 0", lambda: text.looks_like_version(F.when(c("node_id") % 2 == 0, c("version")).otherwise("beta")))
_rel("c20_semver", "1000000 + (ord // 10) * 1000 + ord % 10", lambda: (lambda v: v["major"] * 1000000 + v["minor"] * 1000 + v["patch"])(versions.semver(F.concat(F.lit("v"), c("version"), F.lit("-rc1")))).cast("long"))
_rel("c21_range_contains", "ord % 10 >= 3 AND ord < 10 OR ord // 10 > 0 AND ord // 10 < 2", lambda: versions.contains(F.lit(">=1.0.3, <1.2.0"), versions.semver(c("version"))))
_rel("c22_lenient_version", "1000 + (ord // 10) * 100 + (ord % 10) * 10 + 7", lambda: (lambda v: v["a"] * 1000 + v["b"] * 100 + v["c"] * 10 + v["d"])(versions.lenient(F.concat(c("version"), F.lit(".7")))))
_rel("c23_version_sort_key", "CASE WHEN node_id % 2 = 0 THEN ord ELSE 5 END", lambda: (lambda v: F.when(c("node_id") % 2 == 0, v["minor"] * 10 + v["patch"]).otherwise(v["major"]))(versions.sort_key(F.when(c("node_id") % 2 == 0, c("version")).otherwise("r5"))).cast("long"))
_rel("c24_version_kind", "CASE node_id % 4 WHEN 0 THEN 'zero' WHEN 1 THEN 'commit' WHEN 2 THEN 'semver' ELSE 'unknown' END", lambda: versions.kind(F.when(c("node_id") % 4 == 0, "0").when(c("node_id") % 4 == 1, "0123456789abcdef01234567").when(c("node_id") % 4 == 2, c("version")).otherwise("alpha")))
_rel("c25_pkg_at_version", "'lib@x' || software_id || '|' || version", lambda: (lambda p: F.concat_ws("|", p["package"], p["version"]))(text.pkg_at_version(F.concat(F.lit("Lib@X"), c("software_id").cast("string"), F.lit("@"), c("version")))))


@query("c26_prediction_names", CANON + "SELECT o_orderkey AS p, CASE WHEN o_orderkey % 2 = 0 THEN 'lib@' || version ELSE 'given@1.0' END AS x FROM orders LEFT JOIN releases ON node_id = o_orderkey")
def _(t):
    p = t.raw("orders").select(c("o_orderkey").alias("p"), F.when(c("o_orderkey") % 2 == 0, c("o_orderkey").cast("string")).otherwise("given@1.0").alias("pred"))
    r = t.releases.select(c("node_id").cast("string").alias("pred"), text.coordinates(c("release"), "simple").alias("s"))
    return p.join(r, "pred", "left").select("p", F.when(F.instr("pred", "@") > 0, c("pred")).otherwise(text.simple_id(c("s.package"), c("s.version"))).alias("x"))


_rel("c27_package_norm", "'lib-' || software_id", lambda: text.package_norm(F.concat(F.lit(" Lib-"), c("software_id").cast("string"), F.lit("-service "))))
_rel("c27_package_base", "'my-lib-' || software_id", lambda: text.package_base(F.concat(F.lit("My_Lib."), c("software_id").cast("string"), F.lit("-core"))))


@query("c28_resolve_package", CANON + "SELECT DISTINCT 'lib-' || software_id AS short, min('org.c' || (software_id % 20) || ':lib-' || software_id) OVER (PARTITION BY software_id) AS full_name FROM releases")
def _(t):
    known = t.releases.select(text.coordinates(c("release"))["package"].alias("full_name")).distinct()
    return lookup.resolve_packages(known.select(text.short_package(c("full_name")).alias("name")), known).withColumnRenamed("name", "short")


_rel("c29_coordinates_of_node", "'org.c' || (software_id % 20) || '/lib-' || software_id", lambda: F.concat_ws("/", text.norm(F.split("release", ":")[0]), text.norm(F.split("release", ":")[1])))
_col("c30_family_key", "CASE event_type WHEN 'error' THEN 'tomcat' WHEN 'view' THEN 'springweb' WHEN 'click' THEN 'kafka' WHEN 'signup' THEN 'apache' ELSE 'mylib' END", lambda: text.family_key(F.when(c("event_type") == "error", "org.apache.tomcat.embed").when(c("event_type") == "signup", "org.apache.x").otherwise("com.acme"), F.when(c("event_type") == "view", "spring-boot-web").when(c("event_type") == "click", "my-kafka-client").when(c("event_type") == "signup", "ab").otherwise("MyLib-core")))
_col("c31_coerce_time", "epoch_ms(CAST(date_trunc('second', ts) AS TIMESTAMP))", lambda: F.unix_millis(times.coerce(F.when(c("event_id") % 2 == 0, F.unix_timestamp(c("ts").cast("timestamp")).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))))
_col("c32_to_ms", "CASE WHEN event_id % 2 = 0 THEN (1700000000 + event_id) * 1000 ELSE 1700000000000 + event_id END", lambda: times.to_ms(F.when(c("event_id") % 2 == 0, c("event_id") + 1700000000).otherwise(c("event_id") + 1700000000000)))
_col("c33_event_date", "strftime(ts, '%Y-%m-%d')", lambda: F.date_format(F.to_date(times.coerce(F.date_format("ts", "yyyy-MM-dd"))), "yyyy-MM-dd"))
_rel("c34_node_key", "release || ' / ' || version || ' / ' || strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S')", lambda: text.node_key(c("release"), c("version"), c("ts")))
_col("c35_path_nodes", "'a-b' || event_id", lambda: F.array_join(text.path_nodes(F.when(c("event_id") % 3 == 0, F.concat(F.lit('["a","b'), c("event_id").cast("string"), F.lit('"]'))).when(c("event_id") % 3 == 1, F.concat(F.lit('{"nodes":["a","b'), c("event_id").cast("string"), F.lit('"]}'))).otherwise(F.concat(F.lit("a, b"), c("event_id").cast("string")))), "-"))
_col("c36_record_cve_id", "CASE WHEN event_id % 2 = 0 THEN 'CVE-1-' || event_id ELSE 'CVE-2-' || event_id END", lambda: advisories.cve_id(F.when(c("event_id") % 2 == 0, F.concat(F.lit("CVE-1-"), c("event_id").cast("string"))), F.lit("GHSA-1"), F.when(c("event_id") % 2 == 1, F.array(F.lit("GHSA-1"), F.concat(F.lit("CVE-2-"), c("event_id").cast("string"))))))


@query("c37_node_severity", CANON + ", s AS (SELECT node_id, sum(CASE severity WHEN 'CRITICAL' THEN 5.0 WHEN 'HIGH' THEN 3.0 WHEN 'MEDIUM' THEN 2.0 WHEN 'LOW' THEN 1.0 ELSE 0.0 END) AS w FROM cve_list GROUP BY node_id) SELECT node_id, CAST(w AS DOUBLE) AS x FROM s")
def _(t):
    return build.enrich(t.releases, t.cve_list).filter("has_cve").select("node_id", scores.node_severity(c("cve_list")).alias("x"))


@query("c38_severity_rank", CANON + "SELECT cve_id, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END AS x FROM cve_list")
def _(t):
    return t.cve_list.select("cve_id", scores.severity_rank(c("severity")).alias("x"))


_col("c39_similarity", "round(1 / (1 + abs(value) + 1e-8), 9)", lambda: F.round(scores.similarity(c("value")), 9))
_col("c40_origin_confidence", "round(greatest(0.1, least(0.95, 0.7 + CASE WHEN 1 / (1 + value) > 0.8 THEN 0.15 WHEN 1 / (1 + value) > 0.6 THEN 0.10 WHEN 1 / (1 + value) > 0.4 THEN 0.05 ELSE 0 END + CASE WHEN user_id <= 0 THEN 0 WHEN user_id <= 3 THEN 0.1 WHEN user_id <= 10 THEN 0.05 WHEN user_id > 30 THEN -0.05 ELSE 0 END + CASE WHEN event_id % 7 >= 5 THEN 0.05 WHEN event_id % 7 = 1 THEN -0.05 ELSE 0 END)), 6)", lambda: F.round(scores.origin_confidence(F.lit("vector_temporal"), c("value"), c("user_id"), c("event_id") % 7), 6))
_col("c40_propagation_confidence", "round(greatest(0.0, least(1.0, 0.5 * greatest(0, 1 - (event_id % 9) * 0.15) + 0.3 * CASE WHEN value BETWEEN 1 AND 365 THEN 1.0 WHEN value > 365 THEN 0.8 ELSE 0.5 END + 0.2 * least(1.0, (user_id % 5) / 3.0))), 6)", lambda: F.round(scores.propagation_confidence(c("event_id") % 9 + 1, c("value"), c("user_id") % 5), 6))
@query("c41_shuffled_tokens", "SELECT doc_id, len(string_split_regex(text, '\\s+')) AS n, list_sort(string_split_regex(text, '\\s+'))[1] AS lo FROM documents WHERE text <> ''")
def _(t):
    shuffled = F.split(text.shuffled_tokens(c("text")), " ")
    return t.raw("documents").filter("text <> ''").select("doc_id", shuffled.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.array_min("w").alias("lo"))


@query("c42_severity_number", CANON + "SELECT cve_id, CAST(CASE severity WHEN 'CRITICAL' THEN 9 WHEN 'HIGH' THEN 7.5 WHEN 'LOW' THEN 3 ELSE 5 END AS DOUBLE) AS x FROM cve_list")
def _(t):
    return t.cve_list.select("cve_id", scores.severity_number(c("severity")).alias("x"))


@query("c43_cwe_list", CANON + "SELECT cve_id, unnest(regexp_extract_all(cwe_ids, 'CWE-\\d+')) AS cwe FROM cve_list")
def _(t):
    return t.cve_list.select("cve_id", F.explode(text.cwe_list(c("cwe_ids"))).alias("cwe"))


_col("c44_file_name", "event_type || '_rank_' || user_id", lambda: text.file_name(F.concat(F.initcap("event_type"), F.lit(" (Rank) #"), c("user_id").cast("string"))))


@query("d01_window_filter", CANON + "SELECT node_id FROM releases WHERE ts >= 883612800000 AND ts < 915148800000")
def _(t):
    return windows.nodes_in(t.releases, 883612800000, 915148800000).select("node_id")


@query("d02_temporal_subgraph", CANON + ", k AS (SELECT node_id FROM releases WHERE ts BETWEEN 883612800000 AND 946684800000 AND software_id % 2 = 0) SELECT src, dst FROM dep_edges WHERE src IN (SELECT node_id FROM k) AND dst IN (SELECT node_id FROM k)")
def _(t):
    return windows.subgraph(t.releases, t.dep_edges, 883612800000, 946684800000, keep=t.releases.filter("software_id % 2 = 0"))[1]


@query("d03_scope", CANON + "SELECT CASE WHEN (least(max(ts), 946684800000) - greatest(min(ts), 883612800000)) / (max(ts) - min(ts)) >= 0.95 THEN 'global' ELSE 'window' END AS scope, CAST(count(*) FILTER (ts BETWEEN 883612800000 AND 946684800000) AS BIGINT) AS n FROM releases")
def _(t):
    scope, rows = windows.scoped(t.releases, 883612800000, 946684800000)
    return rows.agg(F.lit(scope).alias("scope"), F.count("*").alias("n"))


@query("d04_has_value", CANON + "SELECT node_id FROM releases WHERE node_id IN (SELECT owner_id FROM added_values WHERE type = 'SPEED') AND node_id NOT IN (SELECT owner_id FROM added_values WHERE type = 'FRESHNESS')")
def _(t):
    return lookup.with_values(t.releases, t.added_values, has=["SPEED"], lacks=["FRESHNESS"]).select("node_id")


@query("d04_first_value", CANON + ", f AS (SELECT owner_id AS node_id, min_by(type, value_id) AS type FROM added_values GROUP BY 1) SELECT node_id FROM releases JOIN f USING (node_id) WHERE type = 'POPULARITY_1_YEAR'")
def _(t):
    return lookup.first_value_is(t.releases, t.added_values, "POPULARITY_1_YEAR").select("node_id")


@query("d05_path_severity", CANON + ", p AS (SELECT a.src, a.dst AS mid, b.dst FROM family_edges a JOIN family_edges b ON a.dst = b.src) SELECT src, mid, dst FROM p WHERE mid IN (SELECT node_id FROM cve_list)")
def _(t):
    """Only edges into and out of a node with a CVE are joined, so other hubs make no paths."""
    bad = t.cve_list.select(c("node_id").alias("mid")).distinct()
    into = t.family_edges.withColumnRenamed("dst", "mid").join(bad, "mid", "left_semi")
    out = t.family_edges.withColumnRenamed("src", "mid").join(bad, "mid", "left_semi")
    return into.join(out, "mid").select("src", "mid", "dst")


@query("d06_version_match", CANON + """SELECT node_id, CASE WHEN version IN ('1.0.1', '1.0.2') THEN 'exact' ELSE 'range' END AS how FROM releases
WHERE version IN ('1.0.1', '1.0.2') OR (ord % 10 >= 5 AND ord < 10)""")
def _(t):
    exact = c("version").isin("1.0.1", "1.0.2")
    ranged = versions.contains(F.lit(">=1.0.5,<1.1.0"), versions.semver(c("version")))
    return t.releases.withColumn("how", F.when(exact, "exact").when(ranged, "range")).filter("how IS NOT NULL").select("node_id", "how")


@query("d06_staged_match", CANON + """SELECT software_id AS q, node_id, CASE software_id % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'number' WHEN 2 THEN 'range' ELSE 'all' END AS how FROM releases
WHERE CASE software_id % 4 WHEN 0 THEN ord IN (1, 2) WHEN 1 THEN ord = 3 WHEN 2 THEN ord = 1 OR ord BETWEEN 5 AND 9 ELSE true END""")
def _(t):
    """An advisory for every software: listed versions, versions written otherwise, ranges after versions that don't exist, or neither."""
    kind = lambda *rows: F.element_at(F.array(*(F.array(*(F.lit(x) for x in r)).cast("array<string>") for r in rows)), (c("q") % 4 + 1).cast("int"))
    asked = t.releases.select(c("software_id").alias("q")).distinct().withColumn("package", c("q"))
    asked = asked.withColumns({"versions": kind(["1.0.1", "1.0.2"], ["v1.0.3", "9.9.9"], ["7.7.7"], []), "ranges": kind([">=1.0.0"], [">=99.0.0"], [">=1.0.5,<1.1.0", "==1.0.1"], [])})
    return lookup.match_versions(asked, t.releases.select(c("software_id").alias("package"), "node_id", "version"))


@query("d07_candidate_nodes", CANON + """SELECT q, node_id, CASE WHEN q % 2 = 0 THEN 'pkg' ELSE 'artifact' END AS kind
FROM (SELECT DISTINCT l_suppkey AS q FROM lineitem) JOIN releases ON software_id = q""")
def _(t):
    """Packages asked for by coordinates or by artifact alone: the first kind of key that is known decides."""
    parts = F.split("release", ":")
    index = build.release_keys(t.releases.select("node_id", parts[0].alias("grp"), parts[1].alias("artifact"), "version"))
    s = F.concat(F.lit("lib-"), c("q").cast("string"))
    asked = t.raw("lineitem").select(c("l_suppkey").alias("q")).distinct().select("q", F.when(c("q") % 2 == 0, F.concat(F.lit("org.c"), (c("q") % 20).cast("string"), F.lit(":"), s)).otherwise(s).alias("key"))
    order = F.when(c("kind") == "pkg", 0).when(c("kind") == "artifact", 1).when(c("kind") == "prefix", 2).otherwise(3)
    found = asked.join(index.filter("kind <> 'pkg_version'"), "key").withColumn("p", order)
    return found.withColumn("best", F.min("p").over(Window.partitionBy("q"))).filter("p = best").select("q", "node_id", "kind")


@query("d07_candidates_by_part", CANON + """, asked AS (SELECT DISTINCT l_suppkey AS q, CASE l_suppkey % 3 WHEN 0 THEN 'org.c' || (l_suppkey % 20) || ':lib-' || l_suppkey WHEN 1 THEN 'lib-' || l_suppkey ELSE 'ib-' || l_suppkey || ':1.1' END AS key FROM lineitem)
SELECT q, node_id, CASE q % 3 WHEN 0 THEN 'pkg' WHEN 1 THEN 'artifact' ELSE 'substring' END AS kind FROM asked JOIN releases ON CASE WHEN q % 3 < 2 THEN software_id = q ELSE contains(release, key) END""")
def _(t):
    """As d07, of which a third are known by a part of the release's name alone."""
    parts = F.split("release", ":")
    index = build.release_keys(t.releases.select("node_id", parts[0].alias("grp"), parts[1].alias("artifact"), "version")).filter("kind <> 'pkg_version'")
    s = F.concat(F.lit("lib-"), c("q").cast("string"))
    key = F.when(c("q") % 3 == 0, F.concat(F.lit("org.c"), (c("q") % 20).cast("string"), F.lit(":"), s)).when(c("q") % 3 == 1, s).otherwise(F.concat(F.lit("ib-"), c("q").cast("string"), F.lit(":1.1")))
    asked = t.raw("lineitem").select(c("l_suppkey").alias("q")).distinct().select("q", key.alias("key"))
    return substrings.candidates(asked, index, t.releases)


@query("d08_nodes_with_cve", CANON + "SELECT cve_id, node_id FROM cve_list WHERE cve_id IN (SELECT 'CVE-2024-' || lpad(CAST(event_id AS VARCHAR), 7, '0') FROM events WHERE event_type = 'error')")
def _(t):
    asked = t.raw("events").filter("event_type = 'error'").select(text.cve_name(F.concat(F.lit("cve-2024-"), F.lpad(c("event_id").cast("string"), 7, "0"))).alias("cve_id"))
    return t.cve_list.join(asked, "cve_id", "left_semi").select("cve_id", "node_id")


@query("d09_infer_package", CANON + "SELECT cve_id, 'lib-' || min_by(software_id, c.node_id) AS package FROM cve_list c JOIN releases USING (node_id) GROUP BY cve_id")
def _(t):
    return t.cve_list.join(t.releases, "node_id").groupBy("cve_id").agg(F.min_by(text.coordinates(c("release"), "artifact")["package"], "node_id").alias("package"))
