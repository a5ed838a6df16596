"""Exact k-nearest join of two tables of vectors, by cells, radii and the triangle inequality. Neither side passes the driver.

Centroids are fitted on a bounded sample. Points are written in blocks of one cell each, queries likewise. A point p of a
cell with centroid c and radius r (the largest |p - c|) has a dot product with q of at most q.c + |q| r, so a cell whose bound
is behind a query's k-th distance holds none of its k nearest. Queries first visit the nearest cells, which gives each its
k-th distance so far; then blocks of queries visit the other cells that some of theirs can't rule out, and keep of them only
points within that distance. How many cells are ruled out depends on the data; the result doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Cells at most (so many centroids are broadcast); points and queries of a block; points of a cell that make one join key.
CELLS, POINTS, QUERIES, KEY = 512, 1024, 256, 16_384
#: Vectors that the centroids are fitted on, and points a first visit covers at least, in multiples of k.
SAMPLE, FIRST = 20_000, 8
#: What the rounding of a dot product may move a bound.
SLACK = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows are equally long, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def n_cells(n: int) -> int:
    return max(1, min(CELLS, int(n**0.5 / 2)))


def _blocks(rows: DataFrame, key: str, own: str, centroids, size: int, parts: int) -> DataFrame:
    """Written blocks (block, cell, n, radius, ids, nodes, v): at most `size` rows of one cell each, v their vectors in turn."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, own)}
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        half = (c * c).sum(1) / 2
        for b in batches:
            v = matrix(b["v"])
            cell = (v @ c.T - half).argmax(1) if len(v) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], [*b.schema.names, "cell"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, made, base = held.value, 0, TaskContext.get().partitionId() << 32
        kept, cell, n = [], None, 0

        def block():
            t = pa.Table.from_batches(kept).combine_chunks()
            v = matrix(t["v"].chunk(0))
            radius = float(np.sqrt(((v - c[cell]) ** 2).sum(1).max()))
            cols = [pa.array([base + made], pa.int64()), pa.array([cell], pa.int32()), pa.array([len(v)], pa.int64()), pa.array([radius], pa.float64())]
            cols += [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), t[x].chunk(0)) for x in (key, own)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([v.ravel()], pa.list_(pa.float64()))], ["block", "cell", "n", "radius", "ids", "nodes", "v"])

        for b in batches:
            cells = b["cell"].to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for a, e in zip([0, *cuts], [*cuts, len(cells)]):
                while a < e:
                    if kept and (cells[a] != cell or n == size):
                        yield block()
                        kept, n, made = [], 0, made + 1
                    cell, take = int(cells[a]), min(e - a, size - n)
                    kept.append(b.slice(a, take))
                    a, n = a + take, n + take
        if kept:
            yield block()

    layout = f"`{key}` {kinds[key]}, `{own}` {kinds[own]}, v array<double>, cell int"
    dealt = rows.mapInArrow(assign, layout).repartition("cell", F.pmod(F.xxhash64(key), F.lit(parts))).sortWithinPartitions("cell")
    return written(dealt.mapInArrow(gather, f"block bigint, cell int, n bigint, radius double, ids array<{kinds[key]}>, nodes array<{kinds[own]}>, v array<double>"), "blocks")


def join(queries: DataFrame, points: DataFrame, k: int, other_nodes: bool = False) -> tuple[DataFrame, DataFrame]:
    """queries(qid, q[, q_node]), points(pid, node_id, embedding): hits (qid, pid, node_id, distance, rank) and, by block of
    queries, visits (n, first, later, cells): its queries, the cells visited in the two rounds, and all cells.

    other_nodes: without points of the query's node (q_node). Equal distances go by pid. qid and pid are unique.
    """
    from .vectors import fit_centroids, sampled

    n, asked = points.count(), queries.count()
    if not n:
        none = queries.select("qid").limit(0).crossJoin(points.select("pid", "node_id").limit(0))
        return none.select("*", F.lit(0.0).alias("distance"), F.lit(0).alias("rank")), none.selectExpr("0L AS n", "0 AS first", "0 AS later", "0 AS cells")
    centroids = fit_centroids(sampled(points, SAMPLE), n_cells(n))
    node = points.schema["node_id"].dataType
    q_node = F.col("q_node") if other_nodes else F.lit(None)
    to = points.select("pid", "node_id", F.col("embedding").cast("array<double>").alias("v"))
    of = queries.select("qid", q_node.cast(node).alias("q_node"), F.col("q").cast("array<double>").alias("v"))
    there = _blocks(to, "pid", "node_id", centroids, POINTS, 1 + n // 1_000_000)
    here = _blocks(of, "qid", "q_node", centroids, QUERIES, 1 + asked // 1_000_000)
    spark = points.sparkSession
    known = {r.cell: r for r in there.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()}  # at most CELLS rows
    numbers = np.array(sorted(known), int)
    state = spark.sparkContext.broadcast((centroids, numbers, np.array([known[c].radius for c in numbers]), np.array([known[c].n for c in numbers])))
    keys = spark.createDataFrame([(int(c), int(1 + known[c].n // KEY)) for c in numbers], "cell int, parts int")
    there = there.join(F.broadcast(keys), "cell").select("cell", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int").alias("part"), "ids", "nodes", "v")
    kinds = [f.dataType.simpleString() for f in (queries.schema["qid"], points.schema["pid"], points.schema["node_id"])]

    def near(b: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bounds to all cells, and the cells of its first visit."""
        c, own, radius, sizes = state.value
        v = b["v"][row].values.to_numpy().reshape(b["n"][row].as_py(), -1)
        bound = 1 - v @ c[own].T - np.sqrt((v * v).sum(1))[:, None] * radius
        order = np.argsort(((c[own] - v.mean(0)) ** 2).sum(1), kind="stable")
        enough = int(np.searchsorted(np.cumsum(sizes[order]), FIRST * k)) + 1
        return bound, order[:enough]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [state.value[1][near(b, r)[1]].tolist() for r in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], [*b.schema.names, "to"])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for r in range(b.num_rows):
                bound, seen = near(b, r)
                open_ = (bound <= b["limit"][r].values.to_numpy()[:, None] + SLACK).any(0)
                open_[seen] = False
                cells.append(state.value[1][open_].tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], [*b.schema.names, "to"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, pids = b["ids"][r].values, b["pids"][r].values
                q, p = b["v"][r].values.to_numpy().reshape(len(ids), -1), b["pv"][r].values.to_numpy().reshape(len(pids), -1)
                d = 1 - q @ p.T
                if other_nodes:
                    d[np.array(b["nodes"][r].values.to_pylist(), object)[:, None] == np.array(b["pnodes"][r].values.to_pylist(), object)] = np.inf
                edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]  # ties at the edge all go on
                i, j = np.nonzero((d <= np.minimum(edge, b["limit"][r].values.to_numpy() + SLACK)[:, None]) & np.isfinite(d))
                yield pa.RecordBatch.from_arrays([pa.array([b["block"][r].as_py()] * len(i), pa.int64()), pa.array(i, pa.int32()), ids.take(pa.array(i)), pids.take(pa.array(j)), b["pnodes"][r].values.take(pa.array(j)), pa.array(d[i, j])], ["block", "place", "qid", "pid", "node_id", "distance"])

    def visited(blocks: DataFrame) -> DataFrame:
        rows = blocks.select("block", "n", "ids", "nodes", "v", "limit", F.explode("to").alias("cell")).join(F.broadcast(keys), "cell")
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        other = there.select("cell", "part", F.col("ids").alias("pids"), F.col("nodes").alias("pnodes"), F.col("v").alias("pv"))
        both = rows.join(other, ["cell", "part"]).select("block", "ids", "nodes", "v", "limit", "pids", "pnodes", "pv")
        return both.mapInArrow(visit, f"block bigint, place int, qid {kinds[0]}, pid {kinds[1]}, node_id {kinds[2]}, distance double")

    nearest = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "pid"))

    def kept(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", nearest).filter(F.col("rank") <= k)

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in here.schema)
    start = here.mapInArrow(first, f"{columns}, to array<int>").withColumn("limit", F.array_repeat(F.lit(float("inf")), F.col("n").cast("int")))
    hits = written(kept(visited(start)), "hits")
    farthest = hits.groupBy("block", "place").agg(F.when(F.count("*") == k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("far"))
    # of each block the k-th distances by place; queries that have met no point yet have none
    far = farthest.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("place", "far"))).alias("far"))
    limit = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.coalesce(F.try_element_at("far", i), F.lit(float("inf"))))
    rest = here.join(far, "block", "left").withColumn("far", F.coalesce("far", F.create_map().cast("map<int,double>"))).withColumn("limit", limit).drop("far")
    rest = written(rest.mapInArrow(later, f"{columns}, limit array<double>, to array<int>"), "rest")
    out = kept(hits.drop("rank").unionByName(visited(rest))).select("qid", "pid", "node_id", "distance", "rank")
    met = start.select("block", F.size("to").alias("first"))
    return out, rest.select("block", "n", F.size("to").alias("later")).join(met, "block").select("n", "first", "later", F.lit(len(numbers)).alias("cells"))
