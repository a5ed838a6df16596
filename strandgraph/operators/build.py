"""Construction of the release graph: edge normalisation, validity intervals, and edges resolved in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

#: Width of the time slots that as-of joins are dealt over, in milliseconds (90 days).
SLOT_MS = 90 * 86_400_000


def is_release(labels: Column) -> Column:
    """The label says release; labels is a string, or several joined by ':'."""
    return F.array_contains(F.split(labels, ":"), "Release")


def timestamp_or_zero(ts: Column) -> Column:
    return F.coalesce(ts.try_cast("long"), F.lit(0))


def attached_values(edges: DataFrame) -> DataFrame:
    """src and the sorted metric nodes attached to it."""
    return edges.filter("label = 'addedValues'").groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("values"))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def owners(edges: DataFrame, last_edge_wins: bool = False) -> DataFrame:
    """release -> its own software, from ownership edges.

    last_edge_wins: dependency edges also map a release to the software it depends on, and the last edge by edge_seq holds.
    """
    if not last_edge_wins:
        return edges.filter("label = 'relationship_AR'").groupBy(F.col("dst").alias("release")).agg(F.max("src").alias("software"))
    both = edges.filter("label IN ('relationship_AR', 'dependency')")
    owned = F.col("label") == "relationship_AR"
    both = both.select(F.when(owned, F.col("dst")).otherwise(F.col("src")).alias("release"), F.when(owned, F.col("src")).otherwise(F.col("dst")).alias("software"), "edge_seq")
    return both.groupBy("release").agg(F.max_by("software", "edge_seq").alias("software"))


def release_lists(releases: DataFrame) -> DataFrame:
    """software_id and its releases in order of (ts, node_id)."""
    return releases.groupBy("software_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "node_id"))), lambda x: x["node_id"]).alias("releases"))


def _beside(releases: DataFrame, ahead: bool, name: str, slot_ms: int) -> DataFrame:
    """Each release with the time of its software's next (or previous) one in order of (ts, node_id).

    Releases are dealt by (software, slot of time), so that a hub's history isn't sorted in one task; the last (first) of a
    slot takes the first (last) time of the next slot that holds any, from a table of one row a slot. Without ts: null.
    """
    rows = releases.withColumn("__slot", F.floor(F.col("ts") / slot_ms))
    step, end = (F.lead, F.min) if ahead else (F.lag, F.max)
    ends = rows.filter("__slot IS NOT NULL").groupBy("software_id", "__slot").agg(end("ts").alias("__end"))
    ends = ends.select("software_id", "__slot", step("__end").over(Window.partitionBy("software_id").orderBy("__slot")).alias("__beyond"))
    inner = step("ts").over(Window.partitionBy("software_id", "__slot").orderBy("ts", "node_id"))
    met = rows.withColumn("__inner", inner).join(ends, ["software_id", "__slot"], "left")
    return met.select(*releases.columns, F.coalesce("__inner", "__beyond").alias(name))


def validity(releases: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """Each release with [ts, ts_end): until the next release of its software, open for the last."""
    return _beside(releases, True, "ts_end", slot_ms)


def steps_back(releases: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """(software_id, src, dst): from each release to its software's one before, in order of (ts, node_id).

    Dealt over slots of time, as validity is; a release without ts has no step.
    """
    rows = releases.filter("ts IS NOT NULL").select("software_id", "node_id", "ts", F.floor(F.col("ts") / slot_ms).alias("__slot"))
    last = rows.groupBy("software_id", "__slot").agg(F.max(F.struct("ts", "node_id"))["node_id"].alias("__last"))
    last = last.select("software_id", "__slot", F.lag("__last").over(Window.partitionBy("software_id").orderBy("__slot")).alias("__beyond"))
    inner = F.lag("node_id").over(Window.partitionBy("software_id", "__slot").orderBy("ts", "node_id"))
    met = rows.withColumn("__inner", inner).join(last, ["software_id", "__slot"])
    return met.select("software_id", F.col("node_id").alias("src"), F.coalesce("__inner", "__beyond").alias("dst")).filter("dst IS NOT NULL")


def normalise_edges(edges: DataFrame) -> DataFrame:
    """(release, software) pairs: dependency edges as they are, ownership edges turned round, others dropped."""
    owned = F.col("label") == "relationship_AR"
    return edges.filter("label IN ('dependency', 'relationship_AR')").select(F.when(owned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(owned, F.col("src")).otherwise(F.col("dst")).alias("dst"), "label")


def in_range(releases: DataFrame, spans: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """Releases of spans(software_id, start_ts, end_ts) with start_ts <= ts < end_ts.

    Spans are cut at the slots of the time that has releases, and the join's key is (software, slot).
    """
    lo, hi = releases.agg(F.min("ts"), F.max("ts")).first()
    if lo is None:
        lo, hi = 0, -1
    first = F.greatest(F.floor(F.col("start_ts") / slot_ms), F.lit(lo // slot_ms))
    last = F.least(F.floor((F.col("end_ts") - 1) / slot_ms), F.lit(hi // slot_ms))
    known = F.col("start_ts").isNotNull() & F.col("end_ts").isNotNull()
    cut = spans.filter(known & (first <= last)).withColumn("__slot", F.explode(F.sequence(first, last)))
    met = cut.join(releases.withColumn("__slot", F.floor(F.col("ts") / slot_ms)), ["software_id", "__slot"]).drop("__slot")
    return met.filter((F.col("ts") >= F.col("start_ts")) & (F.col("ts") < F.col("end_ts")))


def _slots(releases: DataFrame, lo: int, hi: int, slot_ms: int) -> DataFrame:
    """Validity intervals cut at slot boundaries: a row for each slot between lo and hi that an interval touches."""
    spans = validity(releases).filter(F.col("ts") <= hi).withColumn("until", F.coalesce(F.col("ts_end"), F.lit(hi + 1)))
    first = F.greatest(F.floor(F.col("ts") / slot_ms), F.lit(lo // slot_ms))
    last = F.least(F.floor(F.col("until") / slot_ms), F.lit(hi // slot_ms))
    return spans.filter(first <= last).withColumn("slot", F.explode(F.sequence(first, last)))


def asof_past(points: DataFrame, releases: DataFrame, slot_ms: int = SLOT_MS, bounds: tuple | None = None) -> DataFrame:
    """points(software_id, at, ...) with the latest release of the software at or before `at`: past, past_ts (else dropped).

    Releases are validity intervals, cut into time slots, and the join's key is (software, slot): a hub software with very
    many points and releases is dealt over its slots, and no point meets more than the releases of one slot. bounds: times
    that hold all points, where they are known without reading the points.
    """
    lo, hi = bounds or points.agg(F.min("at"), F.max("at")).first()
    if hi is None:
        return points.select("*", F.lit(None).cast("long").alias("past"), F.lit(None).cast("long").alias("past_ts"))
    spans = _slots(releases.select("software_id", "node_id", "ts"), lo, hi, slot_ms)
    spans = spans.select("software_id", "slot", F.col("node_id").alias("past"), F.col("ts").alias("past_ts"), "ts_end")
    met = points.withColumn("slot", F.floor(F.col("at") / slot_ms)).join(spans, ["software_id", "slot"])
    return met.filter((F.col("past_ts") <= F.col("at")) & (F.col("ts_end").isNull() | (F.col("at") < F.col("ts_end")))).drop("slot", "ts_end")


def asof_future(points: DataFrame, releases: DataFrame, slot_ms: int = SLOT_MS, bounds: tuple | None = None) -> DataFrame:
    """points(software_id, at, ...) with the first release at or after `at`: next, next_ts (else dropped).

    A release answers for the points since the release before it; these intervals are cut into slots as in asof_past.
    """
    lo, hi = bounds or points.agg(F.min("at"), F.max("at")).first()
    if hi is None:
        return points.select("*", F.lit(None).cast("long").alias("next"), F.lit(None).cast("long").alias("next_ts"))
    since = F.col("__since")
    spans = _beside(releases.select("software_id", "node_id", "ts"), False, "__since", slot_ms).filter((F.col("ts") >= lo) & (since.isNull() | (since < hi)))
    first = F.greatest(F.floor(F.coalesce(since, F.lit(lo)) / slot_ms), F.lit(lo // slot_ms))
    last = F.least(F.floor(F.col("ts") / slot_ms), F.lit(hi // slot_ms))
    spans = spans.filter(first <= last).withColumn("__slot", F.explode(F.sequence(first, last)))
    spans = spans.select("software_id", "__slot", F.col("node_id").alias("next"), F.col("ts").alias("next_ts"), "__since")
    met = points.withColumn("__slot", F.floor(F.col("at") / slot_ms)).join(spans, ["software_id", "__slot"])
    return met.filter((F.col("at") <= F.col("next_ts")) & (since.isNull() | (F.col("at") > since))).drop("__slot", "__since")


def resolve_edges(edges: DataFrame, releases: DataFrame, strategy: str = "nearest_past", lag_ms: int = 0, forward_fill: bool = False) -> DataFrame:
    """(release, software) edges resolved to distinct (release, release) edges without self-loops.

    nearest_past: the target software's latest release at or before the source's time less lag_ms; with forward_fill, where
    there is none, its first release after that. window: all its releases inside the source's validity interval.
    """
    source = validity(releases).select(F.col("node_id").alias("src"), F.col("ts").alias("src_ts"), F.col("ts_end").alias("src_end"))
    named = edges.select("src", F.col("dst").alias("software_id")).distinct().join(source, "src")
    if strategy == "window":
        spans = named.select("src", "software_id", F.col("src_ts").alias("start_ts"), F.coalesce("src_end", F.lit((1 << 63) - 1)).alias("end_ts"))
        met = in_range(releases.select("software_id", F.col("node_id").alias("dst"), "ts"), spans)
        return met.filter("src <> dst").select("src", "dst").distinct()
    if strategy != "nearest_past":
        raise ValueError(f"unknown strategy {strategy}")
    points = named.select("src", "software_id", (F.col("src_ts") - lag_ms).alias("at"))
    # points lie in the releases' time, a scan of one column, less the lag
    bounds = releases.agg(F.min("ts") - lag_ms, F.max("ts") - lag_ms).first()
    found = asof_past(points, releases, bounds=tuple(bounds)).select("src", "software_id", F.col("past").alias("dst"))
    if forward_fill:
        rest = points.join(found, ["src", "software_id"], "left_anti")
        found = found.unionByName(asof_future(rest, releases, bounds=tuple(bounds)).select("src", "software_id", F.col("next").alias("dst")))
    return found.filter("src <> dst").select("src", "dst").distinct()


def used_nodes(edges: DataFrame, releases: DataFrame) -> DataFrame:
    """The releases that edges touch, with version and time."""
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id"))).distinct()
    return releases.join(ends, "node_id", "left_semi")


def integrity(edges: DataFrame, releases: DataFrame, lag_ms: int = 0) -> DataFrame:
    """Numbers of ends that are no release, and of edges against time."""
    time = releases.select("node_id", "ts")
    s = time.select(F.col("node_id").alias("src"), F.col("ts").alias("src_ts"))
    d = time.select(F.col("node_id").alias("dst"), F.col("ts").alias("dst_ts"))
    met = edges.join(s, "src", "left").join(d, "dst", "left")
    unknown = F.col("src_ts").isNull().cast("long") + F.col("dst_ts").isNull().cast("long")
    late = F.col("dst_ts") > F.col("src_ts") - lag_ms
    return met.agg(F.coalesce(F.sum(unknown), F.lit(0)).alias("unknown_ends"), F.count_if(late).alias("against_time"), F.count("*").alias("n_edges"))


def undirected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct unordered pairs (a < b); with nodes, without edges of unknown ends."""
    pairs = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    if nodes is None:
        return pairs
    known = nodes.select("node_id")
    return pairs.join(known.withColumnRenamed("node_id", "a"), "a", "left_semi").join(known.withColumnRenamed("node_id", "b"), "b", "left_semi").select("a", "b")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among nodes(node_id)."""
    keep = nodes.select("node_id").distinct()
    return edges.join(keep.withColumnRenamed("node_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select("src", "dst")


def enrich(releases: DataFrame, cves: DataFrame) -> DataFrame:
    """Releases with cve_list (sorted), cve_count and has_cve."""
    lists = cves.groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct(F.col("cve_id").alias("name"), "severity"))).alias("cve_list"))
    out = releases.join(lists, "node_id", "left").withColumn("cve_list", F.coalesce("cve_list", F.array().cast("array<struct<name:string,severity:string>>")))
    return out.withColumns({"cve_count": F.size("cve_list"), "has_cve": F.size("cve_list") > 0})


def node_records(releases: DataFrame, cves: DataFrame, edges: DataFrame, one_row_per_cve: bool = False) -> DataFrame:
    """Release records with in- and out-degree; one_row_per_cve: a row for each CVE, and one for a release without."""
    ins, outs = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("in_degree")), edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"))
    rows = enrich(releases, cves).join(ins, "node_id", "left").join(outs, "node_id", "left").na.fill(0, ["in_degree", "out_degree"])
    if not one_row_per_cve:
        return rows
    return rows.withColumn("cve", F.explode_outer("cve_list")).drop("cve_list").withColumns({"name": F.col("cve.name"), "severity": F.col("cve.severity")}).drop("cve")


def release_keys(parsed: DataFrame) -> DataFrame:
    """An inverted index of releases(node_id, grp, artifact, version): kind of key, key, node_id.

    Kinds: pkg (group:artifact), pkg_version, artifact, base (the artifact without common suffixes), and prefix (its first
    word, and first two words, after words that only name a vendor).
    """
    pkg = F.concat_ws(":", "grp", "artifact")
    words = F.filter(F.split("artifact", "-"), lambda w: w != "")
    # Vendor words.
    vendor = F.array(*(F.lit(w) for w in "apache jboss eclipse wildfly xwiki org com net io".split()))
    first = F.array_position(F.transform(words, lambda w: F.array_contains(vendor, w)), F.lit(False)).cast("int")
    rest = F.when(first > 0, F.slice(words, F.greatest(first, F.lit(1)), F.size(words)))
    kinds = {
        "pkg": pkg, "pkg_version": F.concat_ws("@", pkg, "version"), "artifact": F.col("artifact"), "base": text.package_base(F.col("artifact")),
        "prefix": F.try_element_at(rest, F.lit(1)), "prefix2": F.when(F.size(rest) > 1, F.array_join(F.slice(rest, 1, 2), "-")),
    }
    keys = F.array(*(F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in kinds.items()))
    return parsed.select("node_id", F.explode(keys).alias("k")).select("k.kind", "k.key", "node_id").filter("key <> ''").distinct()
