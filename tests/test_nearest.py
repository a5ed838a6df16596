"""The exact k-nearest join against all pairs."""

import numpy as np
import pytest

from strandgraph.operators import nearest, vectors


@pytest.mark.parametrize("seed, n, clusters, k, others", [(1, 900, 12, 5, False), (2, 400, 1, 3, True), (3, 30, 3, 40, False), (4, 700, 6, 4, True)])
def test_against_all_pairs(spark, monkeypatch, seed, n, clusters, k, others):
    """Clustered and other vectors, not of unit length, copies, few points, nodes that hold a third of them."""
    for name, value in (("POINTS", 20), ("QUERIES", 7), ("KEY", 60), ("SAMPLE", 300)):
        monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 6)) * 3
    v = (centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, 6)) * (0.05 if clusters > 1 else 1)).round(3)
    v[: n // 5] = v[0]
    node = np.where(rng.random(n) < 0.3, 0, rng.integers(1, n // 3 + 1, size=n))
    points = spark.createDataFrame([(i, int(node[i]), v[i].tolist()) for i in range(n)], "pid bigint, node_id bigint, embedding array<double>").repartition(3)
    asked = list(range(0, n, 3))
    queries = spark.createDataFrame([(i, v[i].tolist(), int(node[i])) for i in asked], "qid bigint, q array<double>, q_node bigint")
    hits, met = nearest.join(queries, points, k, others)
    got = {}
    for r in sorted(hits.collect(), key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append((round(r.distance, 9), r.pid))
    d = 1 - v @ v.T
    for i in asked:
        want = sorted((round(float(d[i, j]), 9), j) for j in range(n) if not others or node[j] != node[i])[:k]
        assert [x for x, _ in got.get(i, [])] == [x for x, _ in want]
        assert sorted(p for x, p in got.get(i, []) if x < want[-1][0]) == sorted(p for x, p in want if x < want[-1][0])
    rows = met.collect()
    assert sum(r.n for r in rows) == len(asked) and all(r.first + r.later <= r.cells for r in rows)
    if clusters > 10:
        assert sum(r.n * (r.first + r.later) for r in rows) < 0.8 * sum(r.n * r.cells for r in rows)
    assert nearest.join(queries.limit(0), points, k, others)[0].count() == 0 and vectors.exact(queries, points.limit(0), k, others).count() == 0
