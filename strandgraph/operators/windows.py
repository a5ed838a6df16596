"""Time windows: node filters, sub-graphs, window tables, series, and the choice of a window size."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import build
from . import peaks as find


def nodes_in(nodes: DataFrame, t_s: int, t_e: int, closed: bool = False) -> DataFrame:
    """Nodes of [t_s, t_e), or of [t_s, t_e] if closed."""
    return nodes.filter((F.col("ts") >= t_s) & ((F.col("ts") <= t_e) if closed else (F.col("ts") < t_e)))


def subgraph(nodes: DataFrame, edges: DataFrame, t_s: int | None, t_e: int | None, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of the closed window (and of keep(node_id)) and the edges among them; without bounds the whole graph."""
    if t_s is None and t_e is None:
        return nodes, edges
    own = nodes.filter(F.lit(True) if t_s is None else F.col("ts") >= t_s).filter(F.lit(True) if t_e is None else F.col("ts") <= t_e)
    if keep is not None:
        own = own.join(keep.select("node_id").distinct(), "node_id", "left_semi")
    return own, build.induced(edges, own)


def scoped(nodes: DataFrame, t_s: int, t_e: int, coverage: float = 0.95) -> tuple[str, DataFrame]:
    """'global' and all nodes if the window covers so much of their time, else 'window' and its nodes."""
    lo, hi = nodes.agg(F.min("ts"), F.max("ts")).first()
    if lo is None or hi == lo or (min(hi, t_e) - max(lo, t_s)) / (hi - lo) >= coverage:
        return "global", nodes
    return "window", nodes_in(nodes, t_s, t_e, closed=True)


def sliding(nodes: DataFrame, size: int, step: int) -> DataFrame:
    """Windows wid, t_s, t_e = min(t_s + size, end) from the first time to the last."""
    bounds = nodes.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).filter("lo < hi")
    spans = bounds.select("hi", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(step))).alias("t_s"), "lo")
    return spans.select(((F.col("t_s") - F.col("lo")) / step).cast("int").alias("wid"), "t_s", F.least(F.col("t_s") + size, F.col("hi")).alias("t_e"))


def members(nodes: DataFrame, lo: int, hi: int, size: int, step: int) -> DataFrame:
    """(wid, node_id, ts): every node with the windows that hold it, by arithmetic and without a join."""
    offset = F.col("ts") - lo
    first = F.greatest(F.lit(0), F.floor((offset - size) / step).cast("int") + 1)
    last = F.least(F.floor(offset / step).cast("int"), F.lit(max(0, math.ceil((hi - lo) / step) - 1)))
    return nodes.filter((F.col("ts") >= lo) & (F.col("ts") < hi) & (first <= last)).withColumn("wid", F.explode(F.sequence(first, last))).select("wid", "node_id", "ts")


def window_degrees(nodes: DataFrame, edges: DataFrame, size: int, step: int) -> DataFrame:
    """(wid, node_id, degree, n, cent) for every node of every sliding window: degree centrality of the induced graph.

    All windows at once: members of windows are joined to edges by (window, node), so the work is that of the edges times
    the windows an edge lies in. Windows of fewer than two nodes are left out.
    """
    lo, hi = nodes.agg(F.min("ts"), F.max("ts")).first()
    if lo is None or lo == hi:
        return nodes.select(F.lit(0).alias("wid"), "node_id", F.lit(0).cast("long").alias("degree"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("cent")).limit(0)
    own = members(nodes, lo, hi, size, step)
    n = own.groupBy("wid").agg(F.count("*").alias("n")).filter("n >= 2")
    src, dst = own.select("wid", F.col("node_id").alias("src")), own.select("wid", F.col("node_id").alias("dst"))
    inner = edges.join(src, "src").join(dst, ["wid", "dst"])
    degree = inner.select("wid", F.explode(F.array("src", "dst")).alias("node_id")).groupBy("wid", "node_id").agg(F.count("*").alias("degree"))
    rows = own.join(degree, ["wid", "node_id"], "left").join(n, "wid")
    return rows.select("wid", "node_id", F.coalesce("degree", F.lit(0)).alias("degree"), "n").withColumn("cent", F.col("degree") / (F.col("n") - 1))


def influence(scores: DataFrame, by: list[str], method: str = "topk_mean", k: int = 5) -> DataFrame:
    """One number for a group's scores: topk_mean, max, mean, gini or entropy."""
    if method in ("max", "mean"):
        return scores.groupBy(*by).agg((F.max if method == "max" else F.avg)("score").alias("influence"))
    if method == "topk_mean":
        top = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score")))
        return scores.withColumn("r", top).filter(F.col("r") <= k).groupBy(*by).agg(F.avg("score").alias("influence"))
    if method == "gini":
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("score"))
        # the sum of running sums is sum((n + 1 - rank) * score)
        rows = scores.withColumn("r", rank).groupBy(*by).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(F.col("r") * F.col("score")).alias("rs"))
        cum = (F.col("n") + 1) * F.col("s") - F.col("rs")
        return rows.select(*by, F.greatest(F.lit(0.0), F.when(F.col("s") > 0, (F.col("n") + 1 - 2 * cum / F.col("s")) / F.col("n")).otherwise(0.0)).alias("influence"))
    if method == "entropy":
        total = scores.groupBy(*by).agg(F.sum("score").alias("s"), F.count("*").alias("n"))
        p = F.when(F.col("s") > 0, F.col("score") / F.col("s")).otherwise(1 / F.col("n"))
        return scores.join(total, by).withColumn("p", p).groupBy(*by).agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-10))).alias("influence"))
    raise ValueError(f"unknown aggregation {method}")


def smooth(series: DataFrame, k: int) -> DataFrame:
    """Moving average over an odd window of k points (an even k: k + 1), the ends repeated."""
    k += 1 - k % 2
    pad = k // 2
    order = Window.partitionBy("series").orderBy("t")
    near = order.rowsBetween(-pad, pad)
    whole = Window.partitionBy("series").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, n = F.row_number().over(order), F.count("*").over(Window.partitionBy("series"))
    before, after = F.greatest(F.lit(0), pad - at + 1), F.greatest(F.lit(0), at + pad - n)
    total = F.sum("value").over(near) + before * F.first("value").over(whole) + after * F.last("value").over(whole)
    return series.withColumn("smooth", total / k)


def gradient(series: DataFrame, value: str = "value") -> DataFrame:
    """Second-order central differences over unequal steps, one-sided at the ends, of (series, t, value)."""
    return find.gradient(series, value).drop("i", "n")


def _steep(series: DataFrame) -> DataFrame:
    """Written (series, t, i, n, value, y): points with |gradient|."""
    return written(find.gradient(series).select("series", "t", "i", "n", "value", F.abs("gradient").alias("y")), "steep")


def peaks(series: DataFrame, prominence: float, distance: int | None = None) -> DataFrame:
    """(series, idx, t) of the peaks of |gradient|."""
    rows = _steep(series)
    tops, _ = find.prominent(rows, prominence, distance)
    return tops.select("series", F.col("place").alias("i")).join(rows, ["series", "i"]).select("series", F.col("i").cast("int").alias("idx"), "t")


def change_windows(series: DataFrame, prominence: float, distance: int | None = None) -> DataFrame:
    """Windows (series, t_s, t_e) between the ends of a series and its change points."""
    ends = series.groupBy("series").agg(F.array(F.min("t"), F.max("t")).alias("e")).select("series", F.explode("e").alias("t"))
    cuts = ends.unionByName(peaks(series, prominence, distance).select("series", "t")).distinct()
    nxt = F.lead("t").over(Window.partitionBy("series").orderBy("t"))
    return cuts.select("series", F.col("t").alias("t_s"), nxt.alias("t_e")).filter("t_e IS NOT NULL AND t_s < t_e")


def median_step(times: DataFrame, by: str = "series") -> DataFrame:
    step = F.lead("t").over(Window.partitionBy(by).orderBy("t")) - F.col("t")
    return times.withColumn("step", step).groupBy(by).agg(F.median("step").alias("median_step"))


def decay_lag(series: DataFrame, block: int = 16) -> DataFrame:
    """(series, lag): the first lag at which the autocorrelation, 1 at lag 0, is below a half; a quarter of the points if none.

    Sums of products are taken for a block of lags at a time, twice as long each round, by a join of points with those so
    many places later; series whose lag is found leave. A constant series has lag 1.
    """
    mean = series.groupBy("series").agg(F.avg("value").alias("mean"))
    rows = written(find.places(series.select("series", "t", "value")).join(mean, "series").select("series", "i", (F.col("value") - F.col("mean")).alias("x")), "lag")
    sums = written(rows.groupBy("series").agg(F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("square"), F.max(F.abs("x")).alias("most")), "lag")
    flat = sums.filter("coalesce(most, 0) <= 1e-8").select("series", F.lit(1.0).alias("lag"))
    left, done, first = sums.filter("most > 1e-8").select("series", "n", "square"), [flat], 1
    later = rows.select("series", F.col("i").alias("j"), F.col("x").alias("y"))
    while not left.isEmpty():
        lag = F.explode(F.sequence(F.lit(first), F.lit(first + block - 1)))
        ahead = rows.join(left.select("series", "n"), "series").select("series", "i", "x", lag.alias("lag"), "n").filter(F.col("i") + F.col("lag") < F.col("n"))
        products = ahead.withColumn("j", F.col("i") + F.col("lag")).join(later, ["series", "j"]).groupBy("series", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("product"))
        low = products.join(left, "series").filter(F.col("product") / F.col("square") < 0.5).groupBy("series").agg(F.min("lag").cast("double").alias("found"))
        first += block
        block *= 2
        met = written(left.join(low, "series", "left"), "lag")
        ended = F.col("found").isNotNull() | (F.col("n") <= first)
        done.append(met.filter(ended).select("series", F.coalesce("found", F.greatest(F.lit(1), F.floor(F.col("n") / 4)).cast("double")).alias("lag")))
        left = met.filter(~ended).select("series", "n", "square")
    return reduce(DataFrame.unionByName, done)


def _spread(rows: DataFrame) -> DataFrame:
    """(series, med, mad): median of y and of its distance from that."""
    med = find.medians(rows, "y").withColumnRenamed("median", "med")
    off = rows.join(med, "series").select("series", F.abs(F.col("y") - F.col("med")).alias("off"))
    return written(med.join(find.medians(off, "off"), "series").select("series", "med", (F.col("median") + 1e-12).alias("mad")), "spread")


def time_scales(series: DataFrame) -> DataFrame:
    """(series, tau_c, tau_chg, grad_median, grad_mad): correlation and change times, and robust statistics of |gradient|."""
    rows = _steep(series)
    spread = _spread(rows)
    tops, found = find.prominent(rows, spread.select("series", (F.col("med") + 2 * F.col("mad")).alias("least")))
    width = find.medians(find.half_widths(tops, found, rows), "width").withColumnRenamed("median", "width")
    steps = find.beside(rows.select("series", "i", "t"), "i", ["t"]).select("series", (F.col("after_t") - F.col("t")).cast("double").alias("step"))
    step = find.medians(steps, "step").withColumnRenamed("median", "step")
    sizes = rows.groupBy("series").agg(F.count("*").alias("k"), (F.max("t") - F.min("t")).cast("double").alias("span"))
    all_ = sizes.join(spread, "series", "left").join(width, "series", "left").join(step, "series", "left").join(decay_lag(series), "series", "left")
    few, none = F.col("k") < 3, F.lit(0.0)
    return all_.select(
        "series", F.when(few, 2.0).otherwise(F.greatest(F.col("step"), F.col("lag") * F.col("step"))).alias("tau_c"),
        F.when(few, F.greatest(F.lit(2.0), F.col("span") / 10)).otherwise(F.greatest(F.col("step"), F.coalesce("width", 5 * F.col("step")))).alias("tau_chg"),
        F.when(few, none).otherwise(F.col("med")).alias("grad_median"), F.when(few, none).otherwise(F.col("mad")).alias("grad_mad"),
    )


def candidate_scores(series: DataFrame, beta: float = 1.0) -> DataFrame:
    """Per candidate (series): stability S, sensitivity C, resolvability R and their combination F-beta(S, C) * R."""
    rows = _steep(series)
    spread = _spread(rows)
    limit = F.col("med") + 2.5 * F.col("mad")
    tops, _ = find.prominent(rows, spread.select("series", limit.alias("least")))
    peaks_of = tops.groupBy("series").agg(F.count("*").alias("n_peaks"))
    x = F.col("value").cast("double")
    sums = rows.join(spread, "series", "left").groupBy("series").agg(
        F.count("*").alias("k"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.var_pop(x).alias("var"), F.avg(x * x).alias("square"), (F.max("t") - F.min("t")).cast("double").alias("span"),
        F.avg(F.when(F.col("y") > limit, F.col("y"))).alias("high"), F.first("mad").alias("mad"),
    )
    all_ = sums.join(peaks_of, "series", "left")
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("std") / (F.abs("mean") + 1e-12)))
    dense = F.coalesce("n_peaks", F.lit(0)) / F.greatest(F.col("span"), F.lit(1e-9))
    c = F.tanh(0.5 * dense) * F.tanh(0.5 * F.coalesce("high", F.lit(0.0)) / F.col("mad"))
    r = 0.6 * F.tanh(F.col("k") / 20) + 0.4 * F.tanh(F.col("var") / (F.col("square") + 1e-12))
    few = F.col("k") < 3
    out = all_.select("series", *(F.when(few, 0.0).otherwise(v).alias(n) for n, v in (("s", s), ("c", c), ("r", r))))
    below = beta**2 * F.col("s") + F.col("c")
    return out.withColumn("score", F.when(below == 0, 0.0).otherwise((1 + beta**2) * F.col("s") * F.col("c") / below) * F.col("r"))


def probe(nodes: DataFrame, edges: DataFrame, shares: list[float], how: str = "sum") -> DataFrame:
    """(r, score): the best non-overlapping window of each size r * span, by the sum, maximum or mean of degree centrality."""
    lo, hi = nodes.agg(F.min("ts"), F.max("ts")).first()
    out = None
    for r in shares:
        size = max(1, int(r * (hi - lo)))
        best = window_degrees(nodes, edges, size, size).groupBy("wid").agg({"sum": F.sum, "max": F.max, "mean": F.avg}[how]("cent").alias("v")).agg(F.max("v").alias("score")).select(F.lit(r).alias("r"), "score")
        out = best if out is None else out.unionByName(best)
    return out


def window_series(nodes: DataFrame, edges: DataFrame, size: int, step: int, name: str, method: str = "mean") -> DataFrame:
    """(series, t, value): influence of degree centrality in each sliding window, at the window's middle."""
    lo = nodes.agg(F.min("ts")).first()[0] or 0
    value = influence(window_degrees(nodes, edges, size, step).withColumnRenamed("cent", "score"), ["wid"], method)
    return value.select(F.lit(name).alias("series"), (F.lit(lo) + F.col("wid").cast("long") * step + size // 2).cast("long").alias("t"), F.col("influence").alias("value"))


def cve_window(cves: DataFrame, nodes: DataFrame, years: float = 2.0) -> DataFrame:
    """(cve_id, t_s, t_e): the years around a CVE, within the data; without a time the middle half of the nodes."""
    order = Window.orderBy("ts")
    n = nodes.count()
    # places n/4 and 3n/4 of the ordered times, from a table of distinct times with running counts
    runs = nodes.groupBy("ts").agg(F.count("*").alias("k")).withColumn("up_to", F.sum("k").over(order))
    mid = runs.agg(F.min(F.when(F.col("up_to") > n // 4, F.col("ts"))).alias("a"), F.min(F.when(F.col("up_to") > 3 * n // 4, F.col("ts"))).alias("b"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    span = int(years * 365 * 86_400_000)
    seen = F.col("ts").isNotNull()
    return cves.select("cve_id", F.when(seen, F.greatest(F.lit(mid["lo"]), F.col("ts") - span)).otherwise(mid["a"]).alias("t_s"), F.when(seen, F.least(F.lit(mid["hi"]), F.col("ts") + span)).otherwise(mid["b"]).alias("t_e"))
