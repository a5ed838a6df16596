"""Version-level localisation of origins, and picks of roots and cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times, versions
from ..sources.shared import written
from . import aggregate, build, graph

#: Releases and edges of a software whose graph one task takes.
GROUP = 20_000


def sequences(releases: DataFrame) -> DataFrame:
    """software_id, versions: its versions in order of time, the first of equal ones."""
    first = releases.groupBy("software_id", "version").agg(F.min(F.struct("ts", "node_id")).alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "version")))
    return first.groupBy("software_id").agg(F.transform(ordered, lambda x: x["version"]).alias("versions"))


def nearest(queries: DataFrame, events: DataFrame, within_ms: int) -> DataFrame:
    """queries(qid, t) with the nearest event(event_id, t) at most so far away; ties by event_id.

    Times are dealt into slots as wide as the window and run through in order, forward and back; what lies beyond a slot is
    the last event of the slot before it or the first of the one after, so a query meets four events at most.
    """
    slot = F.floor(F.col("t") / within_ms).alias("slot")
    event = F.struct("t", "event_id")
    of = events.filter("t IS NOT NULL").groupBy("t").agg(F.min("event_id").alias("event_id")).select("t", slot, event.alias("event"))
    ends = of.groupBy("slot").agg(F.min("event").alias("first"), F.max("event").alias("last"))
    rows = of.unionByName(queries.filter("t IS NOT NULL").select("t", slot, "qid"), allowMissingColumns=True)
    # of one time the event comes before the queries, either way
    order = Window.partitionBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back, ahead = (F.last("event", ignorenulls=True).over(order.orderBy(at, F.col("event").isNull())) for at in (F.asc("t"), F.desc("t")))
    met = rows.withColumns({"back": back, "ahead": ahead}).filter("event IS NULL").select("qid", "t", "slot", "back", "ahead")
    met = met.join(ends.select((F.col("slot") + 1).alias("slot"), F.col("last").alias("before")), "slot", "left").join(ends.select((F.col("slot") - 1).alias("slot"), F.col("first").alias("after")), "slot", "left")
    away = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col(x)["t"] - F.col("t")).alias("d"), F.col(x)["event_id"].alias("event_id")))
    best = met.select("qid", F.least(*(away(x) for x in ("back", "ahead", "before", "after"))).alias("m")).filter(F.col("m.d") <= within_ms)
    return best.groupBy("qid").agg(F.min("m")["event_id"].alias("event_id"))


def cases(rows: DataFrame, per_bucket: int = 1) -> DataFrame:
    """The most confident cases that are exact, near (1 or 2 versions off) and far (5 or more)."""
    d = F.col("distance")
    bucket = F.when(d == 0, "exact").when(d <= 2, "near").when(d >= 5, "far")
    order = Window.partitionBy("bucket").orderBy(F.desc("confidence"), "event_id")
    return rows.withColumn("bucket", bucket).filter("bucket IS NOT NULL").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_bucket)


def auto_source(nodes: DataFrame, edges: DataFrame, cves: DataFrame, similar: DataFrame, strategy: str = "earliest_cve") -> DataFrame:
    """One source node: earliest, earliest without incoming edge, earliest with a CVE, or most similar; else the earliest."""
    first = F.min_by("node_id", F.struct("ts", "node_id"))
    if strategy == "earliest":
        return nodes.agg(first.alias("node_id"))
    if strategy == "indegree0":
        some = nodes.join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti").agg(first.alias("node_id"))
    elif strategy == "earliest_cve":
        some = nodes.join(cves.select("node_id"), "node_id", "left_semi").agg(first.alias("node_id"))
    elif strategy == "top_sim":
        some = nodes.join(similar, "node_id").agg(F.max_by("node_id", F.struct("score", -F.col("node_id"))).alias("node_id"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return some.crossJoin(nodes.agg(first.alias("other"))).select(F.coalesce("node_id", "other").alias("node_id"))  # one row each


def temporal_only(entries: DataFrame, releases: DataFrame, years: float = 2.0, back: int | None = None) -> DataFrame:
    """entries(cve_id, software_id, at): the earliest release within the years before `at`, else the earliest of all.

    back: instead, the release so many versions before the one at that time.
    """
    span = int(years * 365 * times.DAY_MS)
    if back is not None:
        found = build.asof_past(entries.select("cve_id", "software_id", "at"), releases).join(releases.select(F.col("node_id").alias("past"), F.col("version").alias("seen")), "past")
        rows = found.join(sequences(releases), "software_id")
        return rows.select("cve_id", versions.back(F.col("versions"), F.col("seen"), back).alias("origin"), F.lit("n_back").alias("method"))
    rows = entries.select("cve_id", "software_id", "at").join(releases.select("software_id", "node_id", "version", "ts"), "software_id")
    inside = F.col("ts").between(F.col("at") - span, F.col("at"))
    key = F.struct("ts", "node_id")
    out = rows.groupBy("cve_id").agg(F.min_by(F.when(inside, F.col("version")), F.when(inside, key)).alias("near"), F.min_by("version", key).alias("first"))
    return out.select("cve_id", F.coalesce("near", "first").alias("origin"), F.when(F.col("near").isNull(), "conservative").otherwise("temporal_window").alias("method"))


def vector_temporal(hits: DataFrame, releases: DataFrame, w_time: float = 0.7, w_sim: float = 0.3) -> DataFrame:
    """hits(qid, node_id, distance) ranked by 0.7 * earliness + 0.3 * similarity: qid, node_id, score, rank."""
    rows = hits.join(releases.select("node_id", "ts"), "node_id")
    w = Window.partitionBy("qid")
    lo, hi = F.min("ts").over(w), F.max("ts").over(w)
    early = F.when(hi > lo, 1 - (F.col("ts") - lo) / (hi - lo)).otherwise(1.0)
    score = w_time * early + w_sim / (1 + F.abs("distance"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "node_id")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(order)).select("qid", "node_id", "score", "rank")


def _leading(near: list[list[int]]) -> np.ndarray:
    """Leading eigenvector of A + I of a small undirected graph, from equal values; degrees if it doesn't settle."""
    n = len(near)
    a = np.eye(n)
    for i, js in enumerate(near):
        a[i, js] = 1.0
    x = np.full(n, n**-0.5)
    for _ in range(200):
        y = a @ x
        y /= np.linalg.norm(y)
        if np.abs(y - x).sum() < n * 1e-6:
            return y
        x = y
    return a.sum(axis=1) - 1


def root_causes(hits: DataFrame, nodes: DataFrame, edges: DataFrame, cve_scores: DataFrame, k: int, t_s: int | None = None, t_e: int | None = None) -> DataFrame:
    """Root-cause analysis of all queries at once: hits(qid, node_id, distance), at most k a query, ranked.

    Each query's neighbours inside the window (all of them where none is, or without a window) form a sub-graph with the
    edges among them; its communities are scored by CVE scores, eigenvector centrality and earliest time. Neighbours of
    the best community come first, then by CVE score, earliness and centrality. The sub-graphs of all queries are one graph
    of (query, neighbour) nodes, so that communities are found in one run; only centrality, of at most k nodes, is a
    query's own group. qid, node_id, rank, comm (its smallest node_id), in_root, cve_score, cent.
    """
    place = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "node_id"))
    rows = hits.groupBy("qid", "node_id").agg(F.min("distance").alias("distance")).join(nodes.select("node_id", "ts"), "node_id").withColumn("place", place).filter(F.col("place") <= k)
    inside = (F.lit(True) if t_s is None else F.col("ts") >= t_s) & (F.lit(True) if t_e is None else F.col("ts") <= t_e)
    inside = F.coalesce(inside, F.lit(False))
    rows = rows.withColumn("inside", inside | ~F.max(inside).over(Window.partitionBy("qid")))
    rows = rows.join(cve_scores.select("node_id", F.col("score").alias("cve_score")), "node_id", "left").na.fill(0.0, ["cve_score"])
    rows = written(rows.withColumn("pid", F.col("qid").cast("long") * (k + 1) + F.col("place")), "rc")
    own = rows.filter("inside")
    a, b = own.select("qid", F.col("node_id").alias("src"), F.col("pid").alias("a")), own.select("qid", F.col("node_id").alias("dst"), F.col("pid").alias("b"))
    inner = written(edges.join(a, "src").join(b, ["qid", "dst"]).filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")), "rc")
    comm = graph.communities(own.select(F.col("pid").alias("node_id")), inner).select(F.col("node_id").alias("pid"), "comm")
    near = graph.both_ways(inner).groupBy(F.col("src").alias("pid")).agg(F.collect_set("dst").alias("near"))

    def central(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {p: i for i, p in enumerate(pdf["pid"])}
        cent = _leading([[at[p] for p in js] if js is not None else [] for js in pdf["near"]])
        return pd.DataFrame({"pid": pdf["pid"], "cent": cent})

    cent = own.select("qid", "pid").join(near, "pid", "left").groupBy("qid").applyInPandas(central, "pid long, cent double")
    scored = written(own.join(comm, "pid").join(cent, "pid"), "rc")
    parts = scored.select("qid", F.col("pid").alias("node_id"), "comm", "cve_score", "cent", "ts")
    best = aggregate.community_scores(parts).join(scored.groupBy("comm").agg(F.first("qid").alias("qid"), F.min("node_id").alias("name")), "comm")
    root = best.groupBy("qid").agg(F.max_by("comm", F.struct("score", -F.col("comm"))).alias("root"))
    names = best.select("comm", "name")
    full = rows.select("qid", "node_id", "pid", "ts", "cve_score").join(scored.select("pid", "comm", "cent"), "pid", "left").join(root, "qid").join(names, "comm", "left")
    full = full.withColumn("in_root", F.coalesce(F.col("comm") == F.col("root"), F.lit(False))).na.fill(0.0, ["cent"])
    order = Window.partitionBy("qid").orderBy(F.desc("in_root"), F.desc("cve_score"), F.col("ts").asc_nulls_last(), F.desc(F.round("cent", 6)), "node_id")
    return full.select("qid", "node_id", F.row_number().over(order).alias("rank"), F.col("name").alias("comm"), "in_root", "cve_score", "cent")


def earliest(releases: DataFrame) -> DataFrame:
    return releases.groupBy("software_id").agg(F.min_by("version", F.struct("ts", "node_id")).alias("origin"))


def pagerank(src: np.ndarray, dst: np.ndarray, n: int, weight: np.ndarray | None = None, alpha: float = 0.85, rounds: int = 100) -> np.ndarray:
    """PageRank of a small graph; nodes without outgoing edges give to all."""
    w = np.ones(len(src)) if weight is None else weight
    out = np.bincount(src, w, n)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        flow = np.bincount(dst, x[src] * w / np.where(out[src] > 0, out[src], 1), n) if len(src) else np.zeros(n)
        y = alpha * (flow + x[out == 0].sum() / n) + (1 - alpha) / n
        if np.abs(y - x).sum() < 1e-6 * n:
            return y
        x = y
    return x


def betweenness(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """Betweenness of a small directed graph, normalised."""
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(src.tolist(), dst.tolist()):
        near[a].append(b)
    total = np.zeros(n)
    for s in range(n):
        dist, paths, order, before = {s: 0}, np.zeros(n), [s], [[] for _ in range(n)]
        paths[s] = 1
        for v in order:  # grows while it is read: breadth first
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = np.zeros(n)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    return total / ((n - 1) * (n - 2)) if n > 2 else total


def by_centrality(releases: DataFrame, edges: DataFrame, how: str, limit: float, group: int = GROUP) -> DataFrame:
    """software_id, origin: of its releases' graph (own edges and steps from a release to the one before), the earliest
    version whose centrality, scaled to a maximum of 1, is over the limit; else the highest.

    how: pagerank, betweenness, or temporal_pagerank, whose edges weigh max(0.1, 1 - lateness). The graphs of softwares of
    at most `group` releases and edges are a task's groups; those of larger ones are found by rounds of joins over all of
    them, with the same scores.
    """
    own = written(releases.select("software_id", "node_id", "ts", "version"), "lo")
    a, b = (own.select(F.col("node_id").alias(end), F.col("software_id").alias(name), F.col("ts").alias(f"{name}_ts")) for end, name in (("src", "s"), ("dst", "d")))
    inner = edges.select("src", "dst").join(a, "src").join(b, "dst").filter("s = d").select("src", "dst")
    both = inner.unionByName(build.steps_back(own).select("src", "dst")).distinct().join(a, "src").join(b, "dst")
    both = written(both.select(F.col("s").alias("software_id"), "src", "dst", ((F.col("s_ts") + F.col("d_ts")) / 2).alias("mid")), "lo")
    sizes = own.groupBy("software_id").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).join(both.groupBy("software_id").agg(F.count("*").alias("m")), "software_id", "left")
    sizes = written(sizes.select("software_id", "lo", "hi", (F.col("n") + F.coalesce("m", F.lit(0)) > group).alias("large")), "lo")
    late = (F.col("mid") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))
    weight = F.greatest(F.lit(0.1), 1 - late) if how == "temporal_pagerank" else F.lit(1.0)
    pairs = both.join(sizes, "software_id").select("software_id", "src", "dst", weight.alias("weight"), "large")

    def central(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {v: k for k, v in enumerate(pdf["node_id"])}
        out = [(at[x], at[u["dst"]], u["weight"]) for x, us in zip(pdf["node_id"], pdf["uses"]) if us is not None for u in us]
        src, dst, w = (np.array(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        score = betweenness(src, dst, len(pdf)) if how == "betweenness" else pagerank(src, dst, len(pdf), w)
        return pd.DataFrame({"software_id": pdf["software_id"], "node_id": pdf["node_id"], "score": score})

    uses = pairs.filter("NOT large").groupBy(F.col("src").alias("node_id")).agg(F.collect_list(F.struct("dst", "weight")).alias("uses"))
    small = own.join(sizes.filter("NOT large"), "software_id", "left_semi").select("software_id", "node_id").join(uses, "node_id", "left")
    score = small.groupBy("software_id").applyInPandas(central, "software_id bigint, node_id bigint, score double")
    if not sizes.filter("large").isEmpty():
        wide = written(own.join(sizes.filter("large"), "software_id", "left_semi").select(F.col("software_id").alias("grp"), "node_id"), "lo")
        ways = pairs.filter("large").select(F.col("software_id").alias("grp"), "src", "dst", "weight")
        found = graph.betweenness(wide, ways).join(wide, "node_id").withColumnRenamed("cent", "rank") if how == "betweenness" else graph.group_pagerank(wide, ways)
        score = score.unionByName(found.select(F.col("grp").alias("software_id"), "node_id", F.col("rank").alias("score")))
    score = written(score, "lo")
    most = score.groupBy("software_id").agg(F.max("score").alias("most"))
    # the highest is always over a limit below 1; where all are 0, each is the highest
    over = (F.col("most") <= 0) | (F.round(F.col("score") / F.col("most"), 9) > limit)
    rows = own.join(score, ["software_id", "node_id"]).join(most, "software_id").filter(over)
    return rows.groupBy("software_id").agg(F.min_by("version", F.struct(F.col("ts").isNull(), "ts", "node_id")).alias("origin"))


def by_community(nodes: DataFrame, communities: DataFrame) -> DataFrame:
    """software_id, origin: the earliest version in its largest community (ties: the smallest name)."""
    rows = nodes.join(communities, "node_id")
    size = rows.groupBy("software_id", "comm").agg(F.count("*").alias("n"), F.min(F.struct("ts", "node_id", "version")).alias("m"))
    return size.groupBy("software_id").agg(F.max_by("m", F.struct("n", -F.col("comm"))).alias("m")).select("software_id", F.col("m.version").alias("origin"))


def confidence_rank(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
