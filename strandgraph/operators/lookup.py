"""What is asked for by name, version or attribute, found among nodes: joins on keys, in stages, each for what the last left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, versions


def with_values(nodes: DataFrame, values: DataFrame, has: list[str] = (), lacks: list[str] = ()) -> DataFrame:
    """nodes(node_id, ...) that own a value of every kind in `has` and none of a kind in `lacks`, by values(owner_id, type).

    An owner's values are brought down to one flag a kind before the join, so an owner of very many costs one row.
    """
    flag = {k: F.max(F.col("type") == k) for k in dict.fromkeys([*has, *lacks])}
    wanted = [flag[k] for k in has] + [~flag[k] for k in lacks]
    if not wanted:
        return nodes
    owned = values.filter(F.col("type").isin(*flag)).groupBy(F.col("owner_id").alias("node_id"))
    fit = owned.agg(reduce(Column.__and__, wanted).alias("fit"))
    if has:
        return nodes.join(fit.filter("fit").select("node_id"), "node_id", "left_semi")
    return nodes.join(fit.filter("NOT fit").select("node_id"), "node_id", "left_anti")


def first_value_is(nodes: DataFrame, values: DataFrame, kind: str) -> DataFrame:
    """nodes whose first value, by values(value_id, owner_id, type), is of a kind; later ones don't count."""
    first = values.groupBy(F.col("owner_id").alias("node_id")).agg(F.min_by("type", "value_id").alias("type"))
    return nodes.join(first.filter(F.col("type") == kind), "node_id", "left_semi")


def package_index(named: DataFrame) -> DataFrame:
    """named(node_id, package) -> (kind, key, node_id): by the whole package name, and by its artifact, in normal form."""
    name = text.norm(F.col("package"))
    keys = F.array(F.struct(F.lit("full").alias("kind"), name.alias("key")), F.struct(F.lit("artifact").alias("kind"), F.substring_index(name, ":", -1).alias("key")))
    return named.select("node_id", F.explode(keys).alias("k")).select("k.kind", "k.key", "node_id").filter("key <> ''").distinct()


def nodes_of(asked: DataFrame, index: DataFrame) -> DataFrame:
    """asked(q, package) -> (q, node_id, kind): the nodes of the whole name if it is known, else those of the artifact."""
    rows = asked.select("q", text.norm(F.col("package")).alias("key"))
    full = rows.join(index.filter("kind = 'full'"), "key").select("q", "node_id", "kind")
    rest = rows.join(full.select("q").distinct(), "q", "left_anti").withColumn("key", F.substring_index("key", ":", -1))
    return full.unionByName(rest.join(index.filter("kind = 'artifact'"), "key").select("q", "node_id", "kind")).distinct()


def resolve_packages(names: DataFrame, known: DataFrame) -> DataFrame:
    """names(name) by known(full_name): (name, full_name). A name with a group stays; else the first known name, in order, that
    ends in it; else itself. All in lower case."""
    by_short = known.groupBy(text.short_package(F.col("full_name")).alias("short")).agg(F.min("full_name").alias("found"))
    rows = names.select("name", F.lower("name").alias("short")).distinct().join(by_short, "short", "left")
    return rows.select("name", F.when(F.contains("short", F.lit(":")), F.col("short")).otherwise(F.coalesce("found", "short")).alias("full_name"))


def match_versions(asked: DataFrame, releases: DataFrame) -> DataFrame:
    """asked(q, package, versions, ranges) by releases(package, node_id, version): (q, node_id, how).

    Of each q the first stage that finds something decides: releases of a listed version (exact), or of an equal semantic
    version (number), or in any of the range expressions (range). Without ranges all releases of the package are found (all);
    with ranges that hold none, no row. Listed versions meet releases on (package, version), so only what the lists
    leave over meets a package's other releases. Null arrays count as empty.
    """
    number = versions.semver(F.col("version"))
    listed = asked.select("q", "package", F.explode("versions").alias("listed"))

    def by(rows: DataFrame, theirs: Column, own: Column, how: str) -> DataFrame:
        key = releases.select("package", "node_id", own.alias("key")).filter("key IS NOT NULL")
        return rows.select("q", "package", theirs.alias("key")).distinct().join(key, ["package", "key"]).select("q", "node_id", F.lit(how).alias("how")).distinct()

    exact = by(listed, F.lower("listed"), F.lower("version"), "exact")
    left = listed.join(exact.select("q").distinct(), "q", "left_anti")
    sure = exact.unionByName(by(left, versions.semver(F.col("listed")), number, "number"))
    rest = asked.join(sure.select("q").distinct(), "q", "left_anti").join(releases, "package").withColumn("number", number)
    inside = F.col("number").isNotNull() & F.exists("ranges", lambda r: versions.contains(r, F.col("number")))
    how = F.when(F.coalesce(F.size("ranges"), F.lit(0)) <= 0, "all").when(inside, "range")
    return sure.unionByName(rest.select("q", "node_id", how.alias("how")).filter("how IS NOT NULL").distinct())
