"""Operators that SQL can't express against brute-force versions on small graphs, and edge cases of the others."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.functions import scores, text, versions
from strandgraph.operators import aggregate, build, evaluate, graph, localise, peaks, vectors, windows


@pytest.fixture(scope="module")
def small(spark):
    random.seed(3)
    n = 24
    edges = sorted({(a, b) for a in range(n) for b in random.sample(range(n), 2) if a != b})
    nodes = spark.createDataFrame([(i, i * 10, i % 4) for i in range(n)], "node_id bigint, ts bigint, software_id bigint")
    return n, edges, nodes, spark.createDataFrame(edges, "src bigint, dst bigint")


def test_pagerank(small):
    n, edges, nodes, df = small
    src, dst = (np.array(x) for x in zip(*edges))
    want = localise.pagerank(src, dst, n)
    got = {r.node_id: r.rank for r in graph.pagerank(nodes, df).collect()}
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-4) and abs(sum(got.values()) - 1) < 1e-6


def test_eigenvector(small):
    n, edges, nodes, df = small
    a = np.zeros((n, n))
    for x, y in edges:
        a[x, y] = a[y, x] = 1
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r.node_id: r.cent for r in graph.eigenvector(nodes, df).collect()}
    assert np.allclose([got[i] for i in range(n)], v, atol=1e-3)


def test_betweenness(small):
    n, edges, nodes, df = small
    want = localise.betweenness(*(np.array(x) for x in zip(*edges)), n)
    got = {r.node_id: r.cent for r in graph.betweenness(nodes, df).collect()}
    assert np.allclose([got[i] for i in range(n)], want)
    assert {r.cent for r in graph.betweenness(nodes, df.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("how", ["pagerank", "betweenness", "temporal_pagerank"])
def test_origins_of_large_graphs_are_those_of_small_ones(spark, how):
    rng = np.random.default_rng(3)
    rows = [(s, 100 * s + i, int(t), f"1.{i}") for s, n in ((1, 1), (2, 2), (3, 9), (4, 14)) for i, t in enumerate(np.sort(rng.integers(0, 400, n)) * 86_400_000)]
    releases = spark.createDataFrame([*rows, (5, 500, None, "1.0")], "software_id bigint, node_id bigint, ts bigint, version string")
    edges = spark.createDataFrame([(408, 402), (410, 402), (413, 405), (412, 403), (307, 301), (306, 301), (413, 301)], "src bigint, dst bigint")
    found = [{r.software_id: r.origin for r in localise.by_centrality(releases, edges, how, 0.5, group).collect()} for group in (1_000, 5)]
    assert found[0] == found[1] and sorted(found[0]) == [1, 2, 3, 4, 5]


def test_gexf_is_one_document(spark, tmp_path):
    import xml.etree.ElementTree as et

    from strandgraph.sources import files

    files.write_gexf(spark.createDataFrame([("a&b", 'c"<'), ("c\"<", "d"), ("a&b", 'c"<')], "src string, dst string"), f"{tmp_path}/g")
    parts = sorted(tmp_path.glob("g/part=*"))
    document = "".join(f.read_text() for p in parts for f in sorted(p.glob("part-*")))
    tree = et.fromstring(document.encode())
    named = lambda tag: [e.attrib for e in tree.iter("{http://gexf.net/1.3}" + tag)]
    assert {e["id"] for e in named("node")} == {"a&b", 'c"<', "d"} and {(e["source"], e["target"]) for e in named("edge")} == {("a&b", 'c"<'), ('c"<', "d")}


def test_communities_of_two_cliques(spark):
    pairs = [(a, b) for k in (0, 10) for a, b in itertools.combinations(range(k, k + 5), 2)] + [(4, 10)]
    nodes = spark.createDataFrame([(i,) for i in [*range(5), *range(10, 15), 99]], "node_id bigint")
    got = {r.node_id: r.comm for r in graph.communities(nodes, spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    assert {got[i] for i in range(5)} == {0} and {got[i] for i in range(10, 15)} == {10} and got[99] == 99


def test_communities_by_levels(spark):
    """A ring of cliques: each is found whole, and the modularity is that of the cliques or more."""
    pairs = [p for k in range(8) for p in itertools.combinations(range(4 * k, 4 * k + 4), 2)] + [(4 * k, (4 * k + 5) % 32) for k in range(8)]
    nodes, edges = spark.createDataFrame([(i,) for i in range(32)], "node_id bigint"), spark.createDataFrame(pairs, "src bigint, dst bigint")
    found = graph.communities(nodes, edges)
    got = {r.node_id: r.comm for r in found.collect()}
    assert all(len({got[4 * k + i] for i in range(4)}) == 1 for k in range(8))
    own = nodes.select("node_id", (F.floor(F.col("node_id") / 4)).alias("comm"))
    assert graph.modularity(edges, found).first()[0] >= graph.modularity(edges, own).first()[0] - 1e-9


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101)]
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "node_id bigint")
    got = {r.node_id: r.comp for r in graph.components(nodes, spark.createDataFrame(chain, "src bigint, dst bigint")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[200] == 200


def test_k_shortest_on_a_dag(spark):
    random.seed(5)
    w = {(a, b): float(random.randint(1, 9)) for a in range(8) for b in range(a + 1, 8)}
    df = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "src bigint, dst bigint, weight double")
    got = graph.k_shortest(df, spark.createDataFrame([(0,)], "node_id bigint"), 3).filter("target = 7").orderBy("rank").collect()
    every = []
    for r in range(7):
        for mid in itertools.combinations(range(1, 7), r):
            p = (0, *mid, 7)
            every.append((sum(w[e] for e in zip(p, p[1:])), p))
    assert [(r.weight, tuple(r.path)) for r in got] == sorted(every)[:3]


def test_asof_ties_and_gaps(spark):
    releases = spark.createDataFrame([(1, 7, 0), (2, 7, 5), (3, 7, 5), (4, 7, 10**12)], "node_id bigint, software_id bigint, ts bigint")
    points = spark.createDataFrame([("a", 7, -1), ("b", 7, 5), ("c", 7, 10**12 - 1), ("d", 8, 5), ("e", 7, 2 * 10**12)], "name string, software_id bigint, at bigint")
    got = {r.name: r.past for r in build.asof_past(points, releases).collect()}
    assert got == {"b": 3, "c": 3, "e": 4}
    assert build.asof_past(points.limit(0), releases).count() == 0
    assert {r.name: r.next for r in build.asof_future(points, releases).collect()} == {"a": 1, "b": 2, "c": 4}


def test_decay_lag_against_numpy(spark):
    rng = np.random.default_rng(5)
    series = {"noise": rng.normal(size=50), "slow": np.sin(np.arange(300) / 60), "ramp": np.arange(90.0), "flat": np.ones(7), "one": np.ones(1), "two": np.array([0.0, 1.0])}
    rows = [(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)]
    want = {}
    for k, x in series.items():
        x = x - x.mean()
        full = np.correlate(x, x, mode="full")[len(x) - 1 :]
        low = np.flatnonzero(full[1:] < 0.5 * full[0])
        want[k] = 1.0 if np.allclose(x, 0) else float(low[0] + 1) if len(low) else float(max(1, len(x) // 4))
    df = spark.createDataFrame(rows, "series string, t bigint, value double")
    assert {r.series: r.lag for r in windows.decay_lag(df, 4).collect()} == want
    assert windows.decay_lag(df.limit(0)).count() == 0


def test_slots_change_nothing(spark):
    """Intervals, ranges and joins in time with narrow slots, against brute force; one software holds half of all rows."""
    rng = np.random.default_rng(3)
    rel = [(i, int(rng.integers(0, 6)) if i % 2 else 0, int(rng.integers(-40, 400))) for i in range(160)]
    r = spark.createDataFrame(rel, "node_id bigint, software_id bigint, ts bigint")
    of = {s: sorted((t, i) for i, x, t in rel if x == s) for s in range(6)}
    want = {i: (h[k + 1][0] if k + 1 < len(h) else None) for h in of.values() for k, (t, i) in enumerate(h)}
    asked = [(k, int(rng.integers(0, 7)), int(rng.integers(-60, 450))) for k in range(200)]
    points = spark.createDataFrame(asked, "name bigint, software_id bigint, at bigint")
    later = {k: min(x for x in of[s] if x[0] >= at) for k, s, at in asked if s < 6 and of[s][-1][0] >= at}
    spans = spark.createDataFrame([(k, s, at, at + 7 * (k % 9)) for k, s, at in asked], "name bigint, software_id bigint, start_ts bigint, end_ts bigint")
    inside = {(k, i) for k, s, at in asked for i, x, t in rel if x == s and at <= t < at + 7 * (k % 9)}
    for slot in (1, 10, 10_000):
        assert {x.node_id: x.ts_end for x in build.validity(r, slot).collect()} == want
        assert {x.name: (x.next_ts, x.next) for x in build.asof_future(points, r, slot).collect()} == later
        assert {(x.name, x.node_id) for x in build.in_range(r, spans, slot).collect()} == inside
    assert build.in_range(r.limit(0), spans).count() == 0 and build.validity(r.limit(0)).count() == 0


def test_unknown_strategy(spark):
    r = spark.createDataFrame([(1, 7, 0)], "node_id bigint, software_id bigint, ts bigint")
    with pytest.raises(ValueError):
        build.resolve_edges(spark.createDataFrame([(1, 7)], "src bigint, dst bigint"), r, strategy="other")


def test_cvss(spark):
    cases = {"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H": 9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N": 6.1, "CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:H/I:N/A:N": 5.5, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N": 0.0, "CVSS:2.0/x": 0.0}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", scores.cvss31(F.col("v")).alias("s"))
    assert {r.v: r.s for r in df.collect()} == cases


def test_versions(spark):
    df = spark.createDataFrame([("v1.2.3",), ("lib-2.10.0-rc1",), ("1.2",), (None,), ("",)], "v string")
    got = [tuple(r.s) if r.s else None for r in df.select(versions.semver(F.col("v")).alias("s")).collect()]
    assert got == [(1, 2, 3), (2, 10, 0), None, None, None]
    rows = spark.createDataFrame([(">=1.0.0,<2.0.0", "1.5.0", True), (">=1.0.0,<2.0.0", "2.0.0", False), ("1.2.3", "1.2.3", True), (">1.0.0", "1.0.0", False), ("==1.0.0", "1.0.1", False)], "e string, v string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", versions.contains(F.col("e"), versions.semver(F.col("v"))).alias("got")).collect())


def test_coordinates_modes(spark):
    df = spark.createDataFrame([("org.a:lib-core:1.2.3",), ("lib:1.0",), ("lib",)], "r string")
    want = {"artifact": [("lib-core", "1.2.3"), ("lib", "1.0"), ("lib", None)], "simple": [("lib", "1.2.3"), ("lib", "1.0"), ("lib", None)], "group:artifact": [("org.a:lib-core", "1.2.3"), ("lib", "1.0"), ("lib", None)], "right": [("org.a:lib-core", "1.2.3"), ("lib", "1.0"), ("lib", None)]}
    for mode, rows in want.items():
        assert [tuple(r.c) for r in df.select(text.coordinates(F.col("r"), mode).alias("c")).collect()] == rows
    with pytest.raises(ValueError):
        text.coordinates(F.col("r"), "other")


def test_peaks_prominence(spark):
    y = [0, 3, 0, 1, 0, 5, 5, 0, 2, 1.5, 2.2, 0]
    rows = peaks.places(spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(y)], "series string, t bigint, y double"))
    found = lambda *how: sorted(r.place for r in peaks.prominent(rows, *how)[0].collect())
    assert found(1.5) == [1, 5, 10]
    assert found(0.0) == [1, 3, 5, 8, 10]
    assert found(0.0, 4) == [1, 5, 10]


def test_jaccard_pairs(spark):
    random.seed(1)
    sets = {o: set(random.sample(range(30), random.randint(2, 8))) for o in range(60)}
    df = spark.createDataFrame([(o, i) for o, s in sets.items() for i in s], "owner bigint, item bigint")
    for least in (0.3, 0.6):
        want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > least}
        assert {(r.a, r.b) for r in aggregate.jaccard_pairs(df, least).collect()} == want


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, i % 7, [float(x) for x in r]) for i, r in enumerate(v)], "pid bigint, node_id bigint, embedding array<double>")
    q = points.filter("pid < 15").select(F.col("pid").alias("qid"), F.col("embedding").alias("q"))
    want = {(i, int(j)) for i in range(15) for j in np.argsort(1 - v @ v[i], kind="stable")[:5]}
    assert {(r.qid, r.pid) for r in vectors.exact(q, points, 5).collect()} == want
    near = {(r.qid, r.pid) for r in vectors.approximate(q, points, 5, n_cells=16, probes=12).collect()}
    assert len(near & want) / len(want) >= 0.9


def test_influence_unknown(spark):
    with pytest.raises(ValueError):
        windows.influence(spark.createDataFrame([(1, 1.0)], "k int, score double"), ["k"], "other")


def test_perturbations(spark):
    nodes = spark.createDataFrame([(i, i * 1000) for i in range(500)], "node_id bigint, ts bigint")
    moved = evaluate.permute_times(nodes)
    assert sorted(r.ts for r in moved.collect()) == [i * 1000 for i in range(500)] and moved.join(nodes, ["node_id", "ts"]).count() < 50
    days = evaluate.jitter(nodes).join(nodes.withColumnRenamed("ts", "t0"), "node_id").select(F.abs(F.col("ts") - F.col("t0")).alias("d")).collect()
    assert {r.d // 86_400_000 for r in days} <= set(range(1, 8)) and all(r.d % 86_400_000 == 0 for r in days)
    edges = spark.createDataFrame([(i, i + 1) for i in range(2000)], "src bigint, dst bigint")
    assert 1700 < evaluate.delete_edges(edges, 0.1).count() < 1900


def test_gradient_matches_numpy(spark):
    t, y = np.array([0, 1, 3, 4, 8]), np.array([1.0, 2, 0, 5, 4])
    df = spark.createDataFrame([("s", int(a), float(b)) for a, b in zip(t, y)], "series string, t bigint, value double")
    got = [r.gradient for r in windows.gradient(df).orderBy("t").collect()]
    assert np.allclose(got, np.gradient(y, t))
    smooth = [r.smooth for r in windows.smooth(df, 3).orderBy("t").collect()]
    assert np.allclose(smooth, np.convolve(np.pad(y, 1, mode="edge"), np.ones(3) / 3, mode="valid"))


def test_streaming(spark, tmp_path):
    from strandgraph.streaming import events

    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1, "view", 2.0), (2, "2024-01-01 00:50:00", 1, "view", 3.0), (3, "2024-01-01 09:00:00", 1, "view", 1.0)], "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.hourly(events.read(spark, str(tmp_path / "in"), rows.schema))
    events.write(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.n, r.total) for r in done] == [(2, 5.0)]  # the last hour is still open
    assert events.hourly(rows).count() == 2 and events.sessions(rows).count() == 3


def test_student_and_all_steps(spark):
    """Known values of Student's t, and every step of a selection against least squares."""
    for t, free, p in ((0.0, 5, 1.0), (2.0, 10, 0.0733880348), (12.706204736, 1, 0.05), (2.570581836, 5, 0.05), (1.959963985, 1e7, 0.05), (5.0, 3, 0.0153924210), (0.5, 30, 0.6207230049)):
        assert abs(aggregate.student_p(t, free) - p) < 1e-6
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = 3 * x[:, 2] - 1.5 * x[:, 0] + 0.4 * x[:, 3] + rng.normal(size=300) * 0.5
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, d double, y double")
    got = aggregate.stepwise(rows, "y", ["a", "b", "c", "d"], p_limit=1e-6)
    assert [n for n, _ in got] == ["c", "a", "d"]
    for k, (_, r2) in enumerate(got):
        used = np.column_stack([np.ones(300), *(x[:, "abcd".index(n)] for n, _ in got[: k + 1])])
        left = y - used @ np.linalg.lstsq(used, y, rcond=None)[0]
        assert abs(r2 - (1 - left @ left / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_family_names(spark):
    from strandgraph.functions import text

    cases = {
        ("org.apache.tomcat.embed", "x"): "tomcat", ("a.b", "spring-boot-starter"): "springboot", ("a.b", "spring-boot-web-core"): "springweb", ("a.b", "spring-web"): "springweb", ("a.b", "spring-"): "spring",
        ("a.b", "hadoop-x-client"): "hadoop", ("a.b", "commons-io-lib"): "commonsio", ("a.b", " Log4J-API "): "log4j", ("a.b", "log4j-to-slf4j"): "log4jto-slf4j", ("a.b", "my-kafka-tool"): "kafka", ("a.b", "core"): "core",
        ("org.apache.x", "ab"): "apache", ("org.springframework.q", "ab"): "spring", ("c.fasterxml", "-core"): "jackson", ("x.y", "ab"): "ab", ("a.b", "one-two-three"): "one-two-three", ("a.b", "keycloak-tomcat"): "tomcat",
    }
    rows = spark.createDataFrame(list(cases), "g string, a string")
    assert {(r.g, r.a): r.k for r in rows.select("g", "a", text.family_key(F.col("g"), F.col("a")).alias("k")).collect()} == cases
