"""String and JSON columns: identifiers, package names, release coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unescape_json(value: Column) -> Column:
    r"""JSON that was escaped once more: \" becomes "."""
    return F.replace(value, F.lit('\\"'), F.lit('"'))


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cols))


def advisory_text(name: Column, severity: Column, cwes: Column) -> Column:
    """'CVE-…: severity X, CWE a, b' from what is there."""
    parts = F.concat_ws(", ", F.when(severity.isNotNull(), F.concat(F.lit("severity "), severity)), F.when(F.size(cwes) > 0, F.concat(F.lit("CWE "), F.array_join(cwes, ", "))))
    return F.when(parts == "", name).otherwise(F.concat(name, F.lit(": "), parts))


def cve_name(value: Column) -> Column:
    """Trimmed, upper case, with the CVE- prefix; null for nothing."""
    up = F.upper(F.trim(value))
    return F.when(up == "", None).when(up.startswith("CVE-"), up).otherwise(F.concat(F.lit("CVE-"), up))


def is_cve(value: Column) -> Column:
    """CVE-<year 1999 to 2030>-<number over 0>."""
    parts = F.split(value, "-")
    ok = value.rlike(r"^CVE-\d+-\d+$")
    return F.when(ok, F.get(parts, F.lit(1)).try_cast("int").between(1999, 2030) & (F.get(parts, F.lit(2)).try_cast("long") > 0)).otherwise(F.lit(False))


def bitnami_cve(value: Column) -> Column:
    """BIT-<package>-YYYY-N -> CVE-YYYY-N, others as they are."""
    year = F.regexp_extract(value, r"^BIT-[A-Za-z0-9._-]+-(\d{4}-\d+)$", 1)
    return F.when(year != "", F.concat(F.lit("CVE-"), year)).otherwise(value)


def cwe_list(value: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(value, F.lit(r"(CWE-\d+)"), F.lit(1)), F.array().cast("array<string>"))


def norm(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def package_norm(value: Column) -> Column:
    """Lower case, trimmed, without a run of -core, -parent, -service, -lib in that order at the end."""
    out = norm(value)
    for suffix in ("-core", "-parent", "-service", "-lib"):
        out = F.regexp_replace(out, f"{suffix}$", "")
    return out


def package_base(artifact: Column) -> Column:
    """An artifact without one common suffix, separators as single hyphens."""
    out = F.regexp_replace(norm(artifact), r"[-_.](core|impl|common|api|parent|lib|service)$", "")
    return F.btrim(F.regexp_replace(out, r"[-_.]+", "-"), F.lit("-_."))


def short_package(value: Column) -> Column:
    """What follows the last ':' and '/', in lower case."""
    return F.lower(F.substring_index(F.substring_index(F.trim(value), ":", -1), "/", -1))


def coordinates(release: Column, mode: str = "group:artifact") -> Column:
    """struct(package, version) of a release string under one of the five conventions in use.

    artifact: g:a:v -> a; a:v -> a. simple: as artifact, up to the first '-'. group:artifact: g:a:v -> g:a, version last.
    right: everything before the last ':', '@' or '#', if what follows looks like a version. family: the family key.
    """
    parts = F.split(release, ":")
    n = F.size(parts)
    artifact = F.when(n >= 3, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    last = F.when(n >= 2, F.element_at(parts, -1))
    if mode == "artifact":
        package, version = artifact, last
    elif mode == "simple":
        package, version = F.substring_index(artifact, "-", 1), last
    elif mode == "group:artifact":
        package, version = F.when(n >= 3, F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), ":")).otherwise(F.get(parts, F.lit(0))), last
    elif mode == "right":
        tail = F.regexp_extract(release, r"^(.*)[:@#]([^:@#]*)$", 2)
        good = looks_like_version(tail)
        package = F.when(good, F.regexp_extract(release, r"^(.*)[:@#]([^:@#]*)$", 1)).otherwise(release)
        version = F.when(good, tail)
    elif mode == "family":
        package, version = family_key(F.get(parts, F.lit(0)), artifact), last
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.struct(package.alias("package"), version.alias("version"))


def looks_like_version(value: Column) -> Column:
    return F.coalesce(value.rlike(r"\d+\.\d+"), F.lit(False))


def pkg_at_version(value: Column) -> Column:
    """struct(package in lower case, version) of pkg@version; without '@' all is the package."""
    has = F.instr(value, "@") > 0
    return F.struct(F.lower(F.when(has, F.regexp_extract(value, r"^(.*)@([^@]*)$", 1)).otherwise(value)).alias("package"), F.when(has, F.regexp_extract(value, r"^(.*)@([^@]*)$", 2)).alias("version"))


# Fixed values of the family names: beginnings of groups, words of artifacts, endings that say no product, first words that are
# joined to the next, and names for artifacts of one or two letters by what their group holds. Of several the first counts.
FAMILIES = {
    "org.apache.tomcat": "tomcat", "org.apache.hadoop": "hadoop", "org.apache.kafka": "kafka", "org.apache.camel": "camel", "org.apache.nifi": "nifi",
    "org.apache.struts": "struts", "org.apache.commons": "commons", "org.apache.httpcomponents": "httpclient", "org.apache.spark": "spark",
    "org.springframework": "spring", "com.fasterxml.jackson": "jackson", "org.slf4j": "slf4j", "ch.qos.logback": "logback", "io.netty": "netty",
    "com.google.guava": "guava", "com.alibaba.fastjson": "fastjson", "junit": "junit", "org.keycloak": "keycloak", "org.wildfly": "wildfly",
}
FAMILY_WORDS = ("tomcat", "keycloak", "camel", "nifi", "spark", "kafka", "hadoop", "struts")
FAMILY_ENDINGS = ("embed", "core", "common", "client", "starter", "server", "runtime", "impl", "lib", "api", "all", "bundle", "parent")
FAMILY_JOINED = ("spring", "hadoop", "jackson", "commons", "log4j")
FAMILY_GROUPS = {"apache": "apache", "springframework": "spring", "fasterxml": "jackson"}


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _product(artifact: Column) -> Column:
    """An artifact's name from its words: without an ending, a first word that is joined to the next (spring boot as spring)."""

    def without_ending(words: Column) -> Column:
        has_ending = (F.size(words) > 1) & F.element_at(words, -1).isin(*FAMILY_ENDINGS)
        return F.slice(words, F.lit(1), F.size(words) - has_ending.cast("int"))

    def joined(words: Column) -> Column:
        first = F.get(words, F.lit(0))
        boot = (first == "spring") & (F.get(words, F.lit(1)) == "boot") & (F.size(words) > 2)
        between = F.when((F.size(words) > 1) & ~first.isin(*FAMILY_JOINED), "-").otherwise("")
        return F.concat(first, between, F.array_join(F.slice(words, F.when(boot, 3).otherwise(2), F.size(words)), "-"))

    return _let(F.split(F.lower(F.trim(artifact)), "-"), lambda words: _let(without_ending(words), joined))


def family_key(group: Column, artifact: Column) -> Column:
    """One name for the artifacts of a product family: the first that a table gives for group or name, else the name."""

    def named(name: Column) -> Column:
        given = [F.when(group.startswith(x), family) for x, family in FAMILIES.items()]
        given += [F.when(name.contains(x), x) for x in FAMILY_WORDS]
        given += [F.when((F.length(name) < 3) & group.contains(x), family) for x, family in FAMILY_GROUPS.items()]
        return F.coalesce(*given, name)

    return _let(_product(artifact), named)


def node_key(release: Column, version: Column, ts_ms: Column) -> Column:
    return F.concat_ws(" / ", release, version, F.date_format(F.timestamp_millis(ts_ms), "yyyy-MM-dd'T'HH:mm:ss"))


def path_nodes(value: Column) -> Column:
    """A path given as a JSON list, as JSON {"nodes": [...]}, or as a comma-separated string."""
    listed = F.from_json(value, "array<string>")
    inner = F.from_json(value, "struct<nodes:array<string>>")["nodes"]
    plain = F.transform(F.split(value, ","), lambda x: F.trim(x))
    return F.when(F.trim(value).startswith("["), listed).when(F.trim(value).startswith("{"), inner).otherwise(plain)


def simple_id(package: Column, version: Column) -> Column:
    """package@version without a dangling '@'."""
    return F.regexp_replace(F.concat_ws("@", package, F.coalesce(version, F.lit(""))), "@$", "")


def file_name(algorithm: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(algorithm), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def shuffled_tokens(value: Column, seed: int = 42) -> Column:
    """The tokens of a text in an order by hash: the same for the same text and seed."""
    tokens = F.split(value, r"\s+")
    keyed = F.transform(tokens, lambda x, i: F.struct(F.xxhash64(x, i, F.lit(seed)).alias("h"), x.alias("x")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda y: y["x"]), " ")


def repo_name(url: Column) -> Column:
    """Last path segment of a repository URL, without .git."""
    return F.nullif(F.regexp_extract(F.rtrim(url, F.lit("/")), r"/([^/]+?)(?:\.git)?$", 1), F.lit(""))


def cpe_packages(criteria: Column) -> Column:
    """Sorted distinct vendor:product of an array of CPE strings."""
    parts = F.transform(criteria, lambda c: F.split(c, ":"))
    good = F.filter(parts, lambda p: F.size(p) > 4)
    return F.array_sort(F.array_distinct(F.transform(good, lambda p: F.concat_ws(":", F.get(p, F.lit(3)), F.get(p, F.lit(4))))))


def fix_commits(fixed: Column, refs: Column) -> Column:
    """Sorted distinct commits: fixed events, and FIX references of the form …/commit/<7 to 40 hexadecimal digits>."""
    urls = F.transform(F.filter(refs, lambda r: r["type"] == "FIX"), lambda r: F.regexp_extract(r["url"], r"/commit/([0-9a-f]{7,40})", 1))
    return F.array_sort(F.array_union(fixed, F.filter(urls, lambda u: u != "")))


def package_names(affected: Column) -> Column:
    """Names of an advisory's packages, or of the repositories of its ranges where it has none."""
    names = F.array_distinct(F.filter(F.transform(affected, lambda a: a["package"]["name"]), lambda n: F.coalesce(n, F.lit("")) != ""))
    repos = F.flatten(F.transform(affected, lambda a: F.transform(a["ranges"], lambda r: repo_name(r["repo"]))))
    return F.when(F.size(names) > 0, names).otherwise(F.array_distinct(F.filter(repos, lambda x: x.isNotNull())))
