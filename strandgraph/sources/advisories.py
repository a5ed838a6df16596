"""Advisory records: containers of the OSV and NVD feeds, as JSON text, brought to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text

OSV = (
    "id string, name string, published string, modified string, aliases array<string>, severity array<struct<type:string,score:string>>, references array<struct<type:string,url:string>>, "
    "affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,repo:string,events:array<struct<introduced:string,fixed:string>>>>>>"
)
_CVE = (
    "id:string,published:string,lastModified:string,metrics:struct<cvssMetricV31:array<struct<source:string,type:string,cvssData:struct<baseScore:double,vectorString:string>>>>,"
    "references:array<struct<url:string>>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>"
)
NVD = f"vulnerabilities array<struct<cve:struct<{_CVE}>>>"


def cve_id(name: Column, own: Column, aliases: Column) -> Column:
    """The CVE of a record: the first alias that is one, else its name or its own id if that is one, else null."""
    found = F.try_element_at(F.filter(aliases, lambda a: a.startswith("CVE-")), F.lit(1))
    return F.coalesce(found, F.when(name.startswith("CVE-"), name), F.when(own.startswith("CVE-"), own))


def reference_urls(refs: Column) -> Column:
    """The urls, but null and empty ones, of an array of references with a field url; no array: none."""
    urls = F.filter(F.transform(refs, lambda r: r["url"]), lambda u: F.coalesce(u, F.lit("")) != "")
    return F.coalesce(urls, F.array().cast("array<string>"))


def entries(lists: DataFrame, *keep: str, column: str = "cve_list") -> DataFrame:
    """The columns to keep, cve_id and severity: a row for each object with a CVE's name in a JSON array (name, id, cve_id or
    cveId, the first that is there). Elements that aren't objects, and text that isn't an array, give none."""
    fields = "name string, id string, cve_id string, cveId string, severity string"
    rows = lists.select(*keep, F.explode(F.from_json(column, "array<string>")).alias("e")).filter(F.ltrim("e").startswith("{"))
    rows = rows.select(*keep, F.from_json("e", fields).alias("e"))
    return rows.select(*keep, text.cve_name(text.first_nonempty(*(F.col(f"e.{x}") for x in ("name", "id", "cve_id", "cveId")))).alias("cve_id"), "e.severity").filter("cve_id IS NOT NULL")


def _severity(base: Column, vector: Column, source: str) -> Column:
    return F.struct(base.cast("double").alias("base_score"), vector.alias("vector"), F.lit(source).alias("source")).alias("severity")


def osv(containers: DataFrame) -> DataFrame:
    """One record for each OSV container(data): its base score is that of its vector, null where it has no CVSS 3.1 one."""
    r = containers.select(F.from_json("data", OSV).alias("r")).select("r.*").filter("id IS NOT NULL")
    vector = scores.first_cvss(F.col("severity"))
    base = F.when(vector.startswith("CVSS:3.1/"), scores.cvss31(vector))
    ranges = F.flatten(F.transform("affected", lambda a: F.coalesce(a["ranges"], F.array())))
    fixed = F.filter(F.flatten(F.transform(ranges, lambda x: F.transform(x["events"], lambda e: e["fixed"]))), lambda x: x.isNotNull())
    refs = F.transform("references", lambda x: F.struct(F.upper(x["type"]).alias("type"), x["url"].alias("url")))
    none = F.array().cast("array<string>")
    commits = text.fix_commits(F.coalesce(fixed, none), F.coalesce(refs, F.array().cast("array<struct<type:string,url:string>>")))
    packages = F.array_sort(F.coalesce(text.package_names(F.col("affected")), none))
    return r.select("id", "published", "modified", _severity(base, vector, "OSV"), reference_urls(F.col("references")).alias("references"), packages.alias("packages"), commits.alias("fix_commits"), F.lit("OSV").alias("source"))


def nvd(containers: DataFrame) -> DataFrame:
    """A record for each vulnerability of each NVD container(data)."""
    r = containers.select(F.explode(F.from_json("data", NVD)["vulnerabilities"]).alias("v")).select("v.cve.*").filter("id IS NOT NULL")
    metrics = F.transform(F.col("metrics.cvssMetricV31"), lambda m: F.struct(m["source"].alias("source"), m["type"].alias("type"), m["cvssData"]["baseScore"].alias("score"), m["cvssData"]["vectorString"].alias("vector")))
    best = scores.best_metric(metrics)
    criteria = F.flatten(F.flatten(F.transform("configurations", lambda g: F.transform(g["nodes"], lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"])))))
    none = F.array().cast("array<string>")
    return r.select("id", "published", F.col("lastModified").alias("modified"), _severity(best["score"], best["vector"], "NVD"), reference_urls(F.col("references")).alias("references"), F.coalesce(text.cpe_packages(criteria), none).alias("packages"), none.alias("fix_commits"), F.lit("NVD").alias("source"))


def records(containers: DataFrame) -> DataFrame:
    """containers(source, data) of both feeds as records of one schema; text that isn't JSON gives none."""
    kind = F.lower("source")
    return osv(containers.filter(kind == "osv")).unionByName(nvd(containers.filter(kind == "nvd")))


def _fixed(rest: Column) -> Column:
    """The first fix among events before the next introduction."""
    cut = F.array_position(F.transform(rest, lambda e: e["introduced"].isNotNull()), F.lit(True))
    before = F.when(cut > 0, F.slice(rest, F.lit(1), (cut - 1).cast("int"))).otherwise(rest)
    return F.try_element_at(F.filter(before, lambda e: e["fixed"].isNotNull()), F.lit(1))["fixed"]


def osv_spans(containers: DataFrame) -> DataFrame:
    """(cve_id, package, kind, introduced, fixed) of OSV containers(data) that name a CVE; kind is the type of the range."""
    r = containers.select(F.from_json("data", OSV).alias("r")).select("r.*")
    ranges = r.select(cve_id(F.col("name"), F.col("id"), F.col("aliases")).alias("cve_id"), F.explode("affected").alias("a")).filter("cve_id IS NOT NULL")
    ranges = ranges.select("cve_id", F.col("a.package.name").alias("package"), F.explode("a.ranges").alias("g"))
    events = F.col("g.events")
    spans = F.transform(events, lambda e, i: F.struct(e["introduced"].alias("introduced"), _fixed(F.slice(events, i + 2, F.size(events))).alias("fixed")))
    spans = F.filter(spans, lambda s: s["introduced"].isNotNull())
    return ranges.select("cve_id", "package", F.col("g.type").alias("kind"), F.explode(spans).alias("s")).select("cve_id", "package", "kind", "s.introduced", "s.fixed")
