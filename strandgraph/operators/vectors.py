"""Vector search over points(pid, node_id, embedding) with unit-length embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import nearest


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the dot product of unit vectors, on doubles."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def exact(queries: DataFrame, points: DataFrame, k: int, other_nodes: bool = False) -> DataFrame:
    """queries(qid, q) -> (qid, pid, node_id, distance, rank): the k nearest points of each, exactly (`nearest.join`).

    other_nodes: without points of the query's node (column q_node).
    """
    return nearest.join(queries, points, k, other_nodes)[0]


def node_scores(hits: DataFrame, how: str = "max") -> DataFrame:
    """(qid, node_id, score, best): similarity 1 / (1 + d) of a node's points by max, mean or sum, and its best point."""
    if how not in ("max", "mean", "sum"):
        raise ValueError(f"unknown aggregation {how}")
    sim = 1 / (1 + F.abs("distance"))
    return hits.withColumn("sim", sim).groupBy("qid", "node_id").agg({"max": F.max, "mean": F.avg, "sum": F.sum}[how]("sim").alias("score"), F.max_by("pid", F.struct("sim", -F.col("pid"))).alias("best"))


def top_pairs(points: DataFrame, per_point: int, k: int) -> DataFrame:
    """The k nearest pairs (a, b, distance) of points of different nodes, from every point's nearest."""
    q = points.select(F.col("pid").alias("qid"), F.col("embedding").alias("q"), F.col("node_id").alias("q_node"))
    hits = exact(q, points, per_point, other_nodes=True)
    pairs = hits.groupBy(F.least("qid", "pid").alias("a"), F.greatest("qid", "pid").alias("b")).agg(F.min("distance").alias("distance"))
    return pairs.orderBy("distance", "a", "b").limit(k)


def cells(points: DataFrame, centroids: np.ndarray, n: int = 1) -> DataFrame:
    """points with their n nearest centroids as rows (cell): the coarse part of an inverted-file index."""
    held = points.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for b in batches:
            v = np.array(b["embedding"].to_pylist(), np.float64)
            near = np.argsort(-(v @ held.value.T), axis=1, kind="stable")[:, :n]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], [*b.schema.names, "cells"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(run, f"{schema}, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")


def sampled(points: DataFrame, sample: int = 20_000) -> np.ndarray:
    """The vectors of about so many points, chosen by hash, in order of pid."""
    total = points.count()
    share = min(1.0, sample / max(total, 1))
    got = points.filter(F.pmod(F.xxhash64("pid"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("pid").select(F.col("embedding").cast("array<double>").alias("v")).toArrow()
    return nearest.matrix(got["v"].combine_chunks())


def fit_centroids(v: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of a bounded sample of vectors."""
    if not len(v):
        return np.zeros((1, 1))
    c = v[:: max(1, len(v) // n)][:n].copy()
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (near == j).any():
                m = v[near == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit_probes(v: np.ndarray, centroids: np.ndarray, k: int, target: float = 0.95, asked: int = 500) -> int:
    """So many nearest cells hold the target share of the k nearest of a sample, asked by brute force for some of it.

    In all points the k nearest are nearer than in the sample, so their cells rank no worse. Vectors that don't cluster need
    nearly all cells, clustered ones few.
    """
    if len(v) < 2:
        return len(centroids)
    own = np.argmax(v @ centroids.T, axis=1)
    ask = np.arange(len(v))[:: max(1, len(v) // asked)][:asked]
    like = v[ask] @ v.T
    like[np.arange(len(ask)), ask] = -np.inf
    near = np.argsort(-like, axis=1)[:, : min(k, len(v) - 1)]
    order = np.argsort(np.argsort(-(v[ask] @ centroids.T), axis=1, kind="stable"), axis=1)
    place = np.sort(np.take_along_axis(order, own[near], axis=1).ravel())
    return int(place[int(np.ceil(target * len(place))) - 1]) + 1


def approximate(queries: DataFrame, points: DataFrame, k: int, n_cells: int | None = None, probes: int | None = None) -> DataFrame:
    """As exact(), over the points of each query's nearest cells only: an inverted file, every point indexed. Without a
    number of probes, that which gives a recall of 0.95 in the sample that the cells are fitted on. Cells grow in number with the points."""
    sample = sampled(points)
    centroids = fit_centroids(sample, n_cells or max(32, nearest.n_cells(points.count())))
    probes = fit_probes(sample, centroids, k) if probes is None else probes
    index = cells(points.select("pid", "node_id", "embedding"), centroids)
    asked = cells(queries.select("qid", F.col("q").alias("embedding")), centroids, probes).select("qid", F.col("embedding").alias("q"), "cell")
    near = asked.join(index, "cell").withColumn("distance", cosine_distance(F.col("q"), F.col("embedding")))
    order = Window.partitionBy("qid").orderBy("distance", "pid")
    return near.select("qid", "pid", "node_id", "distance").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def self_recall(points: DataFrame, k: int = 5) -> DataFrame:
    """Share of points whose own node is among their k nearest nodes (themselves aside), and the mean reciprocal rank."""
    q = points.select(F.col("pid").alias("qid"), F.col("embedding").alias("q"))
    hits = exact(q, points, k + 1).filter("qid <> pid")
    own = points.select(F.col("pid").alias("qid"), F.col("node_id").alias("own"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "pid"))
    ranked = hits.withColumn("place", place).filter(F.col("place") <= k).join(own, "qid").groupBy("qid").agg(F.min(F.when(F.col("node_id") == F.col("own"), F.col("place"))).alias("first"))
    return ranked.agg(F.avg(F.col("first").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """n_queries and recall: the share of true neighbours (qid, pid) that were found."""
    met = true.select("qid", "pid").join(found.select("qid", "pid", F.lit(1).alias("hit")).distinct(), ["qid", "pid"], "left")
    return met.agg(F.countDistinct("qid").alias("n_queries"), (F.count("hit") / F.count("*")).alias("recall"))
