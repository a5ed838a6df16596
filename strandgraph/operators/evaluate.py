"""Evaluation of rankings, paths and version localisation; perturbations for negative controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions
from . import aggregate


def path_novelty(found: DataFrame, known: DataFrame) -> DataFrame:
    """From (cve_id, edge): paths as fingerprints (cve, set of edges); the share of new ones, and the share of known ones found."""
    mark = lambda p: p.groupBy("cve_id").agg(F.array_sort(F.collect_set("edge")).alias("f"))
    a, b = mark(found), mark(known)
    hit = a.join(b.withColumn("hit", F.lit(1)), ["cve_id", "f"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    return hit.crossJoin(b.agg(F.count("*").alias("m"))).select(F.round(1 - F.col("k") / F.col("n"), 6).alias("new_ratio"), F.round(F.col("k") / F.col("m"), 6).alias("recall"))


def edge_coverage(known: DataFrame, found: DataFrame) -> DataFrame:
    a = known.select("src", "dst").distinct()
    return a.join(found.select("src", "dst").distinct().withColumn("hit", F.lit(1)), ["src", "dst"], "left").agg(F.round(F.coalesce(F.count("hit") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("coverage"))


def rank_metrics(scores: DataFrame, targets: DataFrame, k: int = 3) -> DataFrame:
    """Mean reciprocal rank and Hits@k of targets(group, node_id) among scores(group, node_id, score); a target not ranked counts 0."""
    rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "node_id"))
    ranked = scores.withColumn("rank", rank).select("group", "node_id", "rank")
    return targets.join(ranked, ["group", "node_id"], "left").agg(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias("hits"))


def mrr_by_depth(paths: DataFrame, predictions: DataFrame) -> DataFrame:
    """paths(depth_limit, cve_id, root) by predictions(cve_id, rank, node_id): depth_limit, n, mrr.

    A root that isn't predicted counts 0; paths of a CVE without predictions don't count. A node's best rank counts.
    """
    best = predictions.groupBy("cve_id", F.col("node_id").alias("root")).agg(F.min("rank").alias("rank"))
    rows = paths.join(predictions.select("cve_id").distinct(), "cve_id", "left_semi").join(best, ["cve_id", "root"], "left")
    return rows.groupBy("depth_limit").agg(F.count("*").alias("n"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def mask_or_fill(scores: DataFrame, keep: DataFrame, fill: float = 0.0) -> DataFrame:
    """node_id, score of all nodes of scores(node_id, score) and keep(node_id): those kept have their score, or 0 where they
    have none; the others have `fill`. Without any score there is no row."""
    some = scores.limit(1).select(F.lit(1).alias("__some"))
    both = scores.join(keep.select("node_id").distinct().withColumn("__kept", F.lit(True)), "node_id", "full_outer").join(F.broadcast(some))  # one row
    return both.select("node_id", F.when(F.col("__kept"), F.coalesce("score", F.lit(0.0))).otherwise(F.lit(fill)).alias("score"))


def lead_time(scores: DataFrame, events: DataFrame, limit: float = 0.8) -> DataFrame:
    """Mean days from a node's first z-score of `limit` or more to its event, of events after it and within a century."""
    w = Window.partitionBy("t")
    sd = F.stddev_samp("score").over(w)
    z = (F.col("score") - F.avg("score").over(w)) / F.when(F.coalesce(sd, F.lit(0.0)) == 0, 1.0).otherwise(sd)
    first = scores.withColumn("z", z).filter(F.col("z") >= limit).groupBy("node_id").agg(F.min("t").alias("alarm"))
    days = (F.col("t") - F.col("alarm")) / 86_400_000.0
    return events.join(first, "node_id").withColumn("days", days).filter("days >= 0 AND days < 36500").agg(F.avg("days").alias("lead_days"), F.count("*").alias("n"))


def purity(communities: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Of each root: the share of its community that are its neighbours (purity), and of its neighbours in it (coverage)."""
    near = edges.select(F.col("src").alias("root"), F.col("dst").alias("node_id")).unionByName(edges.select(F.col("dst").alias("root"), F.col("src").alias("node_id"))).distinct()
    near = near.join(roots.select(F.col("node_id").alias("root")), "root", "left_semi")
    # a community is counted, never joined to itself: a large one costs no more than its members
    n = communities.groupBy("comm").agg(F.count("*").alias("n"))
    own = roots.select("node_id").distinct().join(communities, "node_id").select(F.col("node_id").alias("root"), "comm").join(n, "comm")
    met = near.join(communities.select("node_id", F.col("comm").alias("theirs")), "node_id", "left").join(own, "root")
    both = met.groupBy("root").agg(F.count_if(F.col("theirs") == F.col("comm")).alias("both"), F.count("*").alias("m"))
    rows = own.join(both, "root", "left").na.fill(0, ["both", "m"])
    return rows.select("root", (F.col("both") / F.col("n")).alias("purity"), F.when(F.col("m") > 0, F.col("both") / F.col("m")).otherwise(0.0).alias("coverage"))


def fused(nodes: DataFrame, paths: DataFrame, communities: DataFrame, scores: DataFrame, share: float = 0.6) -> DataFrame:
    """node_id, score: share * (paths through a node, by the most) + (1 - share) * (its community's score, by the most).

    paths(node_id, n), communities(node_id, comm), scores(comm, score); what is missing counts as 0.
    """
    rows = nodes.select("node_id").join(paths, "node_id", "left").join(communities, "node_id", "left").join(scores.select("comm", F.col("score").alias("of_comm")), "comm", "left").na.fill(0, ["n", "of_comm"])
    most = rows.agg(F.max("n").alias("most_n"), F.max("of_comm").alias("most_comm"))
    part = lambda x, top: F.when(F.col(top) > 0, F.col(x) / F.col(top)).otherwise(0.0)
    return rows.join(F.broadcast(most)).select("node_id", (share * part("n", "most_n") + (1 - share) * part("of_comm", "most_comm")).alias("score"))


def path_f1(known: DataFrame, found: DataFrame, limit: float = 0.5, mode: str = "jaccard") -> DataFrame:
    """From (group, path_id, node_id): a path is matched where one of its group overlaps by the limit; precision, recall, F1.

    Paths meet through the nodes they share, so paths without a common node make no pair; by Jaccard index only through nodes
    that paths as alike as asked for must share (`aggregate.overlapping`).
    """
    a, b = known.select("group", F.col("path_id").alias("g"), "node_id").distinct(), found.select("group", F.col("path_id").alias("p"), "node_id").distinct()
    na, nb = a.groupBy("group", "g").agg(F.count("*").alias("na")), b.groupBy("group", "p").agg(F.count("*").alias("nb"))
    if mode == "jaccard" and limit > 0:
        of = lambda x, path: x.select("group", F.col(path).alias("owner"), F.col("node_id").alias("item"))
        hit = aggregate.overlapping(of(a, "g"), of(b, "p"), limit, by=("group",), repeats=True).select("group", F.col("a").alias("g"), F.col("b").alias("p"))
    else:
        shared = a.join(b, ["group", "node_id"]).groupBy("group", "g", "p").agg(F.count("*").alias("s")).join(na, ["group", "g"])
        hit = (shared.join(nb, ["group", "p"]).withColumn("over", F.col("s") / (F.col("na") + F.col("nb") - F.col("s"))) if mode == "jaccard" else shared.withColumn("over", F.col("s") / F.col("na"))).filter(F.col("over") >= limit)
    counts = (
        hit.agg(F.countDistinct("group", "g").alias("kg"), F.countDistinct("group", "p").alias("kp"))
        .crossJoin(na.agg(F.count("*").alias("ng"))).crossJoin(nb.agg(F.count("*").alias("np")))
    )
    p, r = F.col("kp") / (F.col("np") + F.lit(1e-9)), F.col("kg") / (F.col("ng") + F.lit(1e-9))
    return counts.select(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + F.lit(1e-9))).alias("f1"))


def node_f1(known: DataFrame, found: DataFrame) -> DataFrame:
    """F1 of the distinct nodes of two sets of paths."""
    both = known.select("node_id").distinct().withColumn("a", F.lit(1)).join(found.select("node_id").distinct().withColumn("b", F.lit(1)), "node_id", "full_outer")
    n = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("n"))
    return n.select(F.when(F.col("n") > 0, 2 * F.col("n") / (F.col("n_a") + F.col("n_b"))).otherwise(0.0).alias("f1"))


def version_distance(gt, pred, seq):
    """Steps between two versions in a sequence; else by numbers (100 a major, 10 a minor, 1 a patch); else 999."""
    by_seq = F.abs(versions.position(seq, gt) - versions.position(seq, pred))
    a, b = versions.semver(gt), versions.semver(pred)
    by_number = F.abs(a["major"] - b["major"]) * 100 + F.abs(a["minor"] - b["minor"]) * 10 + F.abs(a["patch"] - b["patch"])
    return F.coalesce(by_seq.cast("int"), by_number, F.lit(999))


def sample_metrics(rows: DataFrame) -> DataFrame:
    """rows(sample_id, gt, pred, versions, gt_ts, pred_ts): distance, exact, within_1, within_3, error_days."""
    d = version_distance(F.col("gt"), F.col("pred"), F.col("versions"))
    out = rows.withColumn("distance", d)
    return out.select("sample_id", "distance", *((F.col("distance") <= k).alias(n) for k, n in ((0, "exact"), (1, "within_1"), (3, "within_3"))), (F.abs(F.col("pred_ts") - F.col("gt_ts")) / 86_400_000.0).alias("error_days"))


def roll_up(metrics: DataFrame) -> DataFrame:
    """Rates, mean, upper median (place n // 2) and 95th percentile (place int(.95 n)) of distance, as places of the sorted list.

    The two places come from running counts over distinct distances, so the list itself is never gathered.
    """
    n = metrics.count()
    runs = metrics.groupBy("distance").agg(F.count("*").alias("k")).withColumn("up_to", F.sum("k").over(Window.orderBy("distance")))
    place = lambda k: F.min(F.when(F.col("up_to") > k, F.col("distance")))
    order = runs.agg(place(n // 2).alias("median_distance"), place(min(n - 1, int(0.95 * n))).alias("p95_distance"))
    rates = metrics.agg(F.count("*").alias("n"), *(F.avg(F.col(c).cast("double")).alias(c) for c in ("exact", "within_1", "within_3")), F.avg("distance").alias("mean_distance"))
    return rates.crossJoin(order)  # one row each


def time_accuracy(metrics: DataFrame) -> DataFrame:
    e = F.col("error_days")
    return metrics.agg(F.avg(e).alias("mean_days"), F.median(e).alias("median_days"), F.avg((e <= 30).cast("double")).alias("within_30"), F.avg((e <= 90).cast("double")).alias("within_90"))


def utility(rows: DataFrame, confident: float = 0.7) -> DataFrame:
    """Mean number of versions to review, and accuracy and number of confident predictions."""
    sure = F.col("confidence") >= confident
    return rows.agg(F.avg("distance").alias("review_effort"), F.coalesce(F.avg(F.when(sure, (F.col("distance") == 0).cast("double"))), F.lit(0.0)).alias("confident_accuracy"), F.count_if(sure).alias("n_confident"))


def calibration(rows: DataFrame) -> DataFrame:
    """Mean gap between confidence and accuracy over the buckets of a tenth that have rows."""
    bucket = F.floor(F.col("confidence") * 10) / 10
    by = rows.groupBy(bucket.alias("bucket")).agg(F.avg((F.col("distance") == 0).cast("double")).alias("accuracy"))
    return by.agg(F.avg(F.abs(F.col("bucket") - F.col("accuracy"))).alias("calibration_error"))


def by_group(rows: DataFrame, group, names: list[str]) -> DataFrame:
    """Accuracy and number of rows by group, with 0 for groups that have none."""
    every = rows.sparkSession.createDataFrame([(n,) for n in names], "group string")
    have = rows.groupBy(group.alias("group")).agg(F.avg((F.col("distance") == 0).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    return every.join(have, "group", "left").na.fill(0.0).na.fill(0)


def lag_bucket(days):
    return F.when(days < 30, "<30").when(days < 180, "<180").when(days < 365, "<365").otherwise(">=365")


def top_k(predictions: DataFrame, vulnerable: DataFrame, n_nodes: int, ks: list[int]) -> DataFrame:
    """predictions(cve_id, rank, node_id): recall, precision, coverage and spared effort of the first k of each list."""
    out = None
    for k in ks:
        seen = predictions.filter(F.col("rank") <= k).select("node_id").distinct()
        one = seen.join(vulnerable.select("node_id").distinct().withColumn("hit", F.lit(1)), "node_id", "left").agg(F.count("*").alias("inspected"), F.count("hit").alias("found"))
        one = one.crossJoin(vulnerable.agg(F.countDistinct("node_id").alias("n_vulnerable"))).select(F.lit(k).alias("k"), "inspected", "found", (F.col("found") / F.col("n_vulnerable")).alias("recall"), (F.col("found") / F.col("inspected")).alias("precision"), (1 - F.col("inspected") / n_nodes).alias("effort_spared"))
        out = one if out is None else out.unionByName(one)
    return out


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Raw agreement and Cohen's kappa of two annotators' (cve_id, label)."""
    both = a.select("cve_id", F.col("label").alias("x")).join(b.select("cve_id", F.col("label").alias("y")), "cve_id")
    n = both.agg(F.count("*").alias("n"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("raw"))
    px, py = both.groupBy(F.col("x").alias("l")).agg(F.count("*").alias("kx")), both.groupBy(F.col("y").alias("l")).agg(F.count("*").alias("ky"))
    chance = px.join(py, "l").agg(F.sum(F.col("kx") * F.col("ky")).alias("s"))
    pe = F.coalesce("s", F.lit(0)) / (F.col("n") * F.col("n"))
    return n.crossJoin(chance).select("n", "raw", F.when(pe < 1, (F.col("raw") - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def drop_percent(base: DataFrame, control: DataFrame) -> DataFrame:
    """metric, base, control and the drop in percent of two tables (metric, value)."""
    both = base.select("metric", F.col("value").alias("base")).join(control.select("metric", F.col("value").alias("control")), "metric")
    return both.withColumn("drop_percent", F.when(F.col("base") != 0, (F.col("base") - F.col("control")) / F.col("base") * 100).otherwise(0.0))


def chance(*columns: str, seed: int) -> Column:
    """A number below 2^60 from the columns' values by md5: the same in every run and in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", *(F.col(x).cast("string") for x in columns), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def delete_edges(edges: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Without a share of the edges, chosen by hash: the same ones in every run."""
    return edges.filter(chance("src", "dst", seed=seed) % 1_000_000 >= int(share * 1_000_000))


def jitter(nodes: DataFrame, days_min: int = 1, days_max: int = 7, seed: int = 42) -> DataFrame:
    """Times moved by some whole days, forth or back, by hash."""
    h = chance("node_id", seed=seed)
    days = h % (days_max - days_min + 1) + days_min
    sign = F.when(F.shiftright(h, 32) % 2 == 0, 1).otherwise(-1)
    return nodes.withColumn("ts", F.col("ts") + days * sign * 86_400_000)


def permute_times(nodes: DataFrame, seed: int = 42, pieces: int = 4096) -> DataFrame:
    """The same times dealt to nodes at random: the k-th node by one hash gets the time of the k-th node by another.

    Ranks are counted within hash pieces, and pieces start where those before end, so no task orders all nodes.
    """

    def ranked(rows: DataFrame, salt: int, keep: str) -> DataFrame:
        h = F.xxhash64("node_id", F.lit(seed), F.lit(salt))
        rows = rows.select("node_id", keep, h.alias("h"), F.shiftright(h, 64 - 12).alias("piece")) if keep != "node_id" else rows.select("node_id", h.alias("h"), F.shiftright(h, 64 - 12).alias("piece"))
        before = Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        start = rows.groupBy("piece").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        place = F.row_number().over(Window.partitionBy("piece").orderBy("h", "node_id"))
        return rows.withColumn("place", place).join(start, "piece").withColumn("rank", F.col("start") + F.col("place"))

    a = ranked(nodes, 1, "node_id").select("node_id", "rank")
    b = ranked(nodes, 2, "ts").select("ts", "rank")
    return a.join(b, "rank").select("node_id", "ts")


def stratified(rows: DataFrame, stratum: str, per_stratum: int, key: str, seed: int = 42) -> DataFrame:
    """So many rows of each stratum, the first by hash."""
    order = Window.partitionBy(stratum).orderBy(F.xxhash64(key, F.lit(seed)), key)
    return rows.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= per_stratum).drop("__k")
