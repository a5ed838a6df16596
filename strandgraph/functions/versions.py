"""Version columns. A semantic version is struct<major,minor,patch>, which orders as versions do."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _semver(value: Column, pattern: str) -> Column:
    part = lambda k: F.regexp_extract(value, pattern, k).try_cast("int")
    return F.when(value.rlike(pattern), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def semver(value: Column) -> Column:
    """The version of the whole string (a leading v aside), else the first x.y.z in it, else null."""
    bare = F.regexp_replace(F.trim(value), r"^[vV](?=.)", "")
    return F.coalesce(_semver(bare, r"^(\d+)\.(\d+)\.(\d+)(?:[-+.].*)?$"), _semver(bare, r"(\d+)\.(\d+)\.(\d+)"))


def lenient(value: Column) -> Column:
    """Up to four numbers of a version as struct<a,b,c,d>, missing ones 0."""
    numbers = F.regexp_extract_all(value, F.lit(r"(\d+)"), F.lit(1))
    return F.struct(*(F.coalesce(F.get(numbers, F.lit(k)).try_cast("long"), F.lit(0)).alias(n) for k, n in enumerate("abcd")))


def sort_key(value: Column) -> Column:
    """A semantic version, or one made of the first numbers there are, or 0.0.0."""
    numbers = F.regexp_extract_all(value, F.lit(r"(\d+)"), F.lit(1))
    rough = F.struct(*(F.coalesce(F.get(numbers, F.lit(k)).try_cast("int"), F.lit(0)).alias(n) for k, n in enumerate(("major", "minor", "patch"))))
    return F.coalesce(semver(value), rough, F.struct(F.lit(0).alias("major"), F.lit(0).alias("minor"), F.lit(0).alias("patch")))


def kind(value: Column) -> Column:
    """zero, commit (20 hexadecimal digits or more), semver or unknown."""
    return F.when(value.isNull() | (value == ""), "unknown").when(value == "0", "zero").when(value.rlike("^[0-9a-fA-F]{20,}$"), "commit").when(value.rlike(r"\d+\.\d+"), "semver").otherwise("unknown")


def ranges(expr: Column) -> Column:
    """'>=1.2.0,<1.4.0' -> array of struct<op, ver>; a bare version is an '=='."""
    terms = F.filter(F.transform(F.split(expr, ","), lambda x: F.trim(x)), lambda x: x != "")

    def term(x: Column) -> Column:
        op = F.regexp_extract(x, r"^(>=|<=|==|>|<)?", 1)
        return F.struct(F.when(op == "", "==").otherwise(op).alias("op"), semver(F.regexp_replace(x, r"^(>=|<=|==|>|<)\s*", "")).alias("ver"))

    return F.filter(F.transform(terms, term), lambda t: t["ver"].isNotNull())


def contains(expr: Column, version: Column) -> Column:
    """A semantic version lies in a range expression; an exact version in it decides alone."""
    terms = ranges(expr)
    exact = F.filter(terms, lambda t: t["op"] == "==")

    def holds(t: Column) -> Column:
        return F.when(t["op"] == ">=", version >= t["ver"]).when(t["op"] == ">", version > t["ver"]).when(t["op"] == "<=", version <= t["ver"]).otherwise(version < t["ver"])

    return F.when(F.size(exact) > 0, F.element_at(exact, -1)["ver"] == version).otherwise(F.forall(terms, holds))


def without_zeros(value: Column) -> Column:
    """1.2.0.0 -> 1.2: versions that differ by trailing zeros are one."""
    return F.regexp_replace(value, r"(\.0)+$", "")


def position(versions: Column, value: Column) -> Column:
    """0-based place of a version in an array, by name or else without trailing zeros; null if it isn't there."""
    exact = F.array_position(versions, value)
    rough = F.array_position(F.transform(versions, without_zeros), without_zeros(value))
    return F.coalesce(F.nullif(exact, F.lit(0)), F.nullif(rough, F.lit(0))) - 1


def between(versions: Column, first: Column, last: Column) -> Column:
    """The part of a version array from one version to another; empty if either isn't there, or out of order."""
    a, b = position(versions, first), position(versions, last)
    return F.when((a <= b), F.slice(versions, (a + 1).cast("int"), (b - a + 1).cast("int"))).otherwise(F.array().cast("array<string>"))


def back(versions: Column, found: Column, n: int) -> Column:
    """The version n places before the one found; the first where there are fewer."""
    at = F.coalesce(position(versions, found), F.size(versions) - 1)
    return F.try_element_at(versions, F.greatest(at + 1 - n, F.lit(1)).cast("int"))
