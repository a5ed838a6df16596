"""Peaks over blocks against one pass over a whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandgraph.operators import peaks, windows


def brute_peaks(y: np.ndarray, least: float, distance: int | None = None) -> np.ndarray:
    """Places of local maxima (middles of flat ones) of so much prominence; of close ones the higher stays."""
    n, found, i = len(y), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < n - 1 and y[j + 1] < y[i]:
            found.append((i + j) // 2)
        i = j + 1
    if distance and distance > 1:
        keep = dict.fromkeys(found, True)
        for p in sorted(found, key=lambda p: y[p], reverse=True):
            if keep[p]:
                for q in found:
                    if q != p and abs(q - p) < distance:
                        keep[q] = False
        found = [p for p in found if keep[p]]
    out = []
    for p in found:
        sides = []
        for path in (y[p::-1], y[p:]):
            higher = np.flatnonzero(path > y[p])
            sides.append(path[: higher[0] if len(higher) else len(path)].min())
        if y[p] - max(sides) >= least:
            out.append(p)
    return np.array(out, int)


def brute_widths(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> list[float]:
    """Full widths at half maximum of peaks, between the nearest samples at or below the half."""
    out = []
    for p in at:
        i = j = int(p)
        while i > 0 and y[i] > y[p] / 2:
            i -= 1
        while j < len(y) - 1 and y[j] > y[p] / 2:
            j += 1
        out.append(float(max(0.0, t[j] - t[i])))
    return out


def given(seed):
    rng = np.random.default_rng(seed)
    out = {}
    for name, n, kinds in (("ties", 300, 4), ("flat", 90, 1), ("fine", 257, 10**6), ("few", 2, 3), ("one", 1, 3), ("steps", 200, 3), ("edge", 64, 5)):
        y = rng.integers(0, kinds, n).astype(float)
        if name == "steps":
            y = np.repeat(y[: n // 10 + 1], 10)[:n]
        out[name] = (np.cumsum(rng.integers(1, 9, n)), y)
    out["hill"] = (np.arange(150), np.concatenate([np.arange(75), np.arange(75)[::-1]]).astype(float))
    return out


@pytest.mark.parametrize("seed, block, slot, least, distance", [(1, 4, 5, 0.0, None), (2, 3, 50, 2.0, 6), (3, 64, 4096, 1.0, 3)])
def test_peaks_of_many_series(spark, monkeypatch, seed, block, slot, least, distance):
    monkeypatch.setattr(peaks, "BLOCK", block)
    monkeypatch.setattr(peaks, "SLOT", slot)
    series = given(seed)
    rows = spark.createDataFrame([(name, int(t), float(y)) for name, (ts, ys) in series.items() for t, y in zip(ts, ys)], "series string, t bigint, y double").repartition(5)
    placed = peaks.places(rows)
    at = {(r.series, r.t): (r.i, r.n) for r in placed.collect()}
    assert at == {(name, int(t)): (i, len(ts)) for name, (ts, _) in series.items() for i, t in enumerate(ts)}
    tops, found = peaks.prominent(placed, least, distance)
    got, width = {}, {}
    for r in tops.collect():
        got.setdefault(r.series, set()).add(r.place)
    want = {name: set(brute_peaks(ys, least, distance).tolist()) for name, (_, ys) in series.items()}
    assert got == {k: v for k, v in want.items() if v}
    for r in peaks.half_widths(tops, found, placed).collect():
        width[r.series, r.place] = r.width
    assert width == {(name, p): w for name, (ts, ys) in series.items() for p, w in zip(sorted(want[name]), brute_widths(ts.astype(float), ys, np.array(sorted(want[name]), int)))}
    med = {r.series: r.median for r in peaks.medians(rows, "y").collect()}
    assert med == {name: float(np.median(ys)) for name, (_, ys) in series.items()}
    grad = {}
    for r in peaks.gradient(rows.withColumnRenamed("y", "value")).orderBy("series", "i").collect():
        grad.setdefault(r.series, []).append(r.gradient)
    for name, (ts, ys) in series.items():
        if len(ys) > 2:
            assert np.allclose(grad[name], np.gradient(ys, ts.astype(float), edge_order=1))
    assert peaks.prominent(placed.limit(0), least)[0].count() == 0


def test_scales_of_short_series(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("b", 50, 2.0)], "series string, t bigint, value double")
    got = {r.series: (r.tau_c, r.tau_chg, r.grad_median, r.grad_mad) for r in windows.time_scales(rows).collect()}
    assert got == {"a": (2.0, 2.0, 0.0, 0.0), "b": (2.0, 5.0, 0.0, 0.0)}
    assert [(r.s, r.c, r.r, r.score) for r in windows.candidate_scores(rows).collect()] == [(0, 0, 0, 0)] * 2
    assert windows.time_scales(rows.limit(0)).count() == 0
