"""Aggregations over nodes, scores and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text


def degrees(edges: DataFrame) -> DataFrame:
    """node_id and degree: its ends in all edges."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k rows of the highest score; equal scores by key."""
    return df.orderBy(F.desc(score), key).limit(k)


def degree_top(edges: DataFrame, k: int = 10) -> DataFrame:
    return top(degrees(edges), "degree", "node_id", k)


def cve_out_degree(edges: DataFrame, cve_nodes: DataFrame, end: str, label: str, k: int = 10) -> DataFrame:
    """Sources with the most edges of a label of which the given end (src or dst) has a CVE."""
    hit = edges.filter(F.col("label") == label).join(cve_nodes.select(F.col("node_id").alias(end)).distinct(), end, "left_semi")
    return top(hit.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n")), "n", "node_id", k)


def node_scores(cves: DataFrame, per_cve: DataFrame | None = None, how: str = "sum") -> DataFrame:
    """node_id, score: sum, max or mean over its CVEs of the CVE's own score(cve_id, score), else of its severity's."""
    if how not in ("sum", "max", "mean", "decay_mean"):
        raise ValueError(f"unknown aggregation {how}")
    value = scores.severity_score(F.col("severity"))
    rows = cves
    if per_cve is not None:
        rows = cves.join(per_cve.select("cve_id", F.col("score").alias("own")), "cve_id", "left")
        value = F.coalesce("own", value)
    return rows.groupBy("node_id").agg({"sum": F.sum, "max": F.max}.get(how, F.avg)(value).alias("score"))


def features(values: DataFrame) -> DataFrame:
    """owner_id with popularity, freshness_missrelease, freshness_outdays and speed; the largest value of a kind, or 0."""
    fresh = F.from_json(text.unescape_json(F.col("value")), "freshness struct<numberMissedRelease:string,outdatedTimeInMs:string>")["freshness"]
    of = lambda kind, v: F.coalesce(F.max(F.when(F.col("type") == kind, v)), F.lit(0.0))
    return values.withColumn("fresh", F.when(F.col("type") == "FRESHNESS", fresh)).groupBy("owner_id").agg(
        of("POPULARITY_1_YEAR", F.col("value").try_cast("double")).alias("popularity"),
        of("FRESHNESS", F.col("fresh.numberMissedRelease").try_cast("double")).alias("freshness_missrelease"),
        of("FRESHNESS", F.col("fresh.outdatedTimeInMs").try_cast("double") / 86_400_000.0).alias("freshness_outdays"),
        of("SPEED", F.col("value").try_cast("double")).alias("speed"),
    )


FEATURES = ("freshness_missrelease", "freshness_outdays", "popularity", "speed", "severity")


def feature_matrix(nodes: DataFrame, values: DataFrame, cves: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its features, severity (sum of ranks), outdegree and degree."""
    rank = cves.groupBy("node_id").agg(F.sum(scores.severity_rank(F.col("severity"))).cast("double").alias("severity"))
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").cast("double").alias("outdegree"))
    rows = nodes.select("node_id").join(features(values).withColumnRenamed("owner_id", "node_id"), "node_id", "left").join(rank, "node_id", "left").join(out, "node_id", "left")
    rows = rows.join(degrees(edges).withColumn("degree", F.col("degree").cast("double")), "node_id", "left")
    return rows.na.fill(0.0)


def correlations(rows: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, corr) of every pair of columns, by one aggregate."""
    pairs = [(a, b) for a in names for b in names]
    one = rows.agg(*(F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("corr")) for k, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def correlation_weight(rows: DataFrame, scale: float = 2_776_187.0) -> DataFrame:
    """node_id, weight: features weighted by their share of |correlation with outdegree|, min-max scaled."""
    r = rows.agg(*(F.abs(F.corr(f, "outdegree")).alias(f) for f in FEATURES)).first().asDict()
    r = {k: 0.0 if v is None or v != v else v for k, v in r.items()}
    total = sum(r.values())
    share = {k: v / total if total else 1 / len(FEATURES) for k, v in r.items()}
    weighted = rows.select("node_id", sum((F.col(f) * F.lit(share[f]) for f in FEATURES), F.lit(0.0)).alias("w"))
    lo, hi = weighted.agg(F.min("w"), F.max("w")).first()
    if lo is None or hi == lo:
        return weighted.select("node_id", F.col("w").alias("weight"))
    return weighted.select("node_id", ((F.col("w") - lo) / (hi - lo) * scale).alias("weight"))


def student_p(t: float, free: float) -> float:
    """Of |t| with so many degrees of freedom, the probability of as much or more on both sides: the regularised incomplete
    beta function of free / (free + t * t), by its continued fraction."""
    import math

    x, a, b = free / (free + t * t), free / 2, 0.5
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):  # the fraction converges on the other side
        x, a, b, other = 1 - x, b, a, True
    else:
        other = False
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a if x > 0 else 0.0
    f = d = 1 / (1 - (a + b) * x / (a + 1))
    c = 1.0
    for m in range(1, 1000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + up * d)
            c = 1 + up / c
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * f if other else front * f


def stepwise(rows: DataFrame, target: str, names: list[str], p_limit: float = 0.05) -> list[tuple[str, float]]:
    """Forward selection: add the feature of the best R2 whose p-value is below the limit; (feature, R2) in order.

    Ordinary least squares from sums of products, which one pass over the rows gives; only that small matrix comes here.
    """
    import math

    import numpy as np

    every = [*names, target]
    sums = rows.agg(F.count("*").alias("n"), *(F.sum(a).alias(f"s_{a}") for a in every), *(F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(every) for b in every[i:])).first()
    n = sums["n"]
    cross = lambda a, b: (sums[f"p_{a}_{b}"] if f"p_{a}_{b}" in sums.asDict() else sums[f"p_{b}_{a}"]) - sums[f"s_{a}"] * sums[f"s_{b}"] / n
    total, chosen, out = cross(target, target), [], []
    while len(chosen) < len(names):
        best = None
        for name in (x for x in names if x not in chosen and cross(x, x) > 1e-12):
            use = [*chosen, name]
            xx, xy = np.array([[cross(a, b) for b in use] for a in use]), np.array([cross(a, target) for a in use])
            if np.linalg.cond(xx) > 1e12:
                continue
            beta = np.linalg.solve(xx, xy)
            left, free = total - float(beta @ xy), n - len(use) - 1
            if free <= 0 or total <= 0:
                continue
            error = math.sqrt(max(left, 0.0) / free * np.linalg.inv(xx)[-1, -1])
            p = 0.0 if error == 0 else student_p(abs(beta[-1]) / error, free)
            r2 = 1 - left / total
            if p < p_limit and (best is None or r2 > best[1]):
                best = (name, r2)
        if best is None:
            break
        chosen.append(best[0])
        out.append(best)
    return out


def zscore(value: Column, by: list[str] = (), population: bool = False) -> Column:
    """Standardised; where the deviation is 0 or unknown it counts as 1."""
    w = Window.partitionBy(*by)
    sd = (F.stddev_pop if population else F.stddev_samp)(value).over(w)
    return (value - F.avg(value).over(w)) / F.when(F.coalesce(sd, F.lit(0.0)) == 0, 1.0).otherwise(sd)


def min_max(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns scaled to [0, 1] over all rows; constant columns become 0. The bounds are one row."""
    bounds = rows.agg(*(F.min(c).alias(f"__lo_{c}") for c in names), *(F.max(c).alias(f"__hi_{c}") for c in names))
    out = rows.crossJoin(F.broadcast(bounds))  # one row
    scaled = {c: F.when(F.col(f"__hi_{c}") > F.col(f"__lo_{c}"), (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))).otherwise(0.0) for c in names}
    return out.withColumns(scaled).drop(*(f"__{b}_{c}" for c in names for b in ("lo", "hi")))


def community_scores(nodes: DataFrame, w_cve: float = 1.0, w_cent: float = 1.0, w_early: float = 0.5) -> DataFrame:
    """From (node_id, comm, cve_score, cent, ts): comm, score = sum cve + sum cent - weighted earliest time, representative."""
    rep = F.max_by("node_id", F.struct(F.col("cve_score") * w_cve + F.col("cent") * w_cent, -F.col("ts"), -F.col("node_id")))
    score = w_cve * F.sum("cve_score") + w_cent * F.sum("cent") - w_early * F.coalesce(F.min("ts"), F.lit(float("inf")))
    return nodes.groupBy("comm").agg(score.alias("score"), rep.alias("representative"), F.count("*").alias("n"))


def combined(lists: list[DataFrame], k: int = 10) -> DataFrame:
    """Score lists (node_id, score) joined on all nodes, gaps 0, summed; the k highest."""
    both = None
    for one in lists:
        both = one.select("node_id", "score") if both is None else both.unionByName(one.select("node_id", "score"))
    return top(both.groupBy("node_id").agg(F.sum("score").alias("score")), "score", "node_id", k)


#: Sets of at most so many items meet by two shared items, and carry them; larger ones by one, and are joined again.
PAIRED = 32


def needed(size: Column, least: float, strict: bool = False) -> Column:
    """How many items a set of the size shares at least with one of its size or smaller whose Jaccard index is `least` (strict: more)."""
    return F.floor(size * least + 1e-12) + 1 if strict else F.greatest(F.lit(1), F.ceil(size * least - 1e-9))


def overlapping(left: DataFrame, right: DataFrame, least: float, strict: bool = False, both: bool = False, by: tuple = (), repeats: bool = False) -> DataFrame:
    """From distinct (*by, owner, item) of two sides: pairs (*by, a, b, jaccard) of at least `least` (strict: over it).

    both: the sides are one table, and pairs are a < b. by: only owners alike in these columns meet, each has one value of
    them. repeats: a pair may come several times.

    Sets meet through the rarest of their items. Sets that must share k items share k of any prefix that leaves out no more
    than they may miss, so those that must share two meet by pairs of items in prefixes one longer: of two common items
    together there are few. Sets that need to share only one, and those of more than PAIRED items, meet by one.
    """
    by = list(by)
    rarity = (left if both else left.unionByName(right)).groupBy(*by, "item").agg(F.count("*").alias("freq"))
    near_in_size = F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size") - 1e-9
    index = F.col("shared") / (F.col("a_size") + F.col("b_size") - F.col("shared"))
    alike = F.col("jaccard") > least if strict else F.col("jaccard") >= least
    ordered = (F.col("a") < F.col("b")) if both else F.lit(True)

    def sized(sets: DataFrame) -> DataFrame:
        return sets.join(sets.groupBy(*by, "owner").agg(F.count("*").alias("size")), [*by, "owner"]).join(rarity, [*by, "item"])

    def small(rows: DataFrame, name: str) -> DataFrame:
        sets = rows.filter(F.col("size") <= PAIRED).groupBy(*by, "owner", F.col("size").cast("int").alias("size")).agg(F.array_sort(F.collect_list(F.struct("freq", "item"))).alias("items"))
        sets = sets.select(*by, "owner", "size", F.transform("items", lambda x: x["item"]).alias("items"))
        least_shared = needed(F.col("size"), least, strict).cast("int")
        prefix = F.slice("items", F.lit(1), F.least(F.col("size"), F.col("size") - least_shared + 2))
        two = F.flatten(F.transform(prefix, lambda x, i: F.transform(F.slice(prefix, i + 2, F.lit(PAIRED)), lambda y: F.xxhash64(*by, x, y))))
        one = F.when(least_shared == 1, F.transform("items", lambda x: F.xxhash64(*by, x))).otherwise(F.array().cast("array<bigint>"))
        return sets.select(*by, F.col("owner").alias(name), F.col("items").alias(f"{name}_items"), F.col("size").alias(f"{name}_size"), F.explode(F.concat(one, two)).alias("key"))

    def large(rows: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*by, "owner").orderBy("freq", "item"))
        kept = rows.filter(F.col("size") >= least * PAIRED).withColumn("place", place).filter(F.col("place") <= F.col("size") - needed(F.col("size"), least, strict) + 1)
        return kept.select(*by, F.col("owner").alias(name), "item", F.col("size").alias(f"{name}_size"))

    a, b = sized(left), sized(left if both else right)
    few = small(a, "a").join(small(b, "b"), ["key", *by]).filter(ordered & near_in_size).withColumn("shared", F.size(F.array_intersect("a_items", "b_items")))
    few = few.select(*by, "a", "b", index.alias("jaccard")).filter(alike)
    few = few if repeats else few.distinct()
    many = large(a, "a").join(large(b, "b"), [*by, "item"]).filter(ordered & near_in_size & (F.greatest("a_size", "b_size") > PAIRED)).select(*by, "a", "b", "a_size", "b_size").distinct()
    many = many.join(left.withColumnRenamed("owner", "a"), [*by, "a"]).join((left if both else right).withColumnRenamed("owner", "b"), [*by, "b", "item"])
    many = many.groupBy(*by, "a", "b", "a_size", "b_size").agg(F.count("*").alias("shared")).select(*by, "a", "b", index.alias("jaccard"))
    return few.unionByName(many.filter(alike))


def jaccard_pairs(sets: DataFrame, least: float) -> DataFrame:
    """From distinct (owner, item): pairs (a, b, jaccard) over `least`, through the items they share (`overlapping`)."""
    return overlapping(sets, sets, least, strict=True, both=True)
