"""Queries of time windows and series (L), and the streaming form of event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, build, graph, window_graph, windows
from ..streaming import events as stream
from .registry import query
from .tables import CANON

c = F.col
HALF_YEAR, YEAR = 15_552_000_000, 31_104_000_000

_WIN = f""", b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM releases),
win AS (SELECT CAST((t - lo) // {HALF_YEAR} AS INTEGER) AS wid, t AS t_s, least(t + {YEAR}, hi) AS t_e FROM b, unnest(range(lo, hi, {HALF_YEAR})) AS q(t))
"""


@query("l01_sliding_windows", CANON + _WIN + "SELECT * FROM win")
def _(t):
    return windows.sliding(t.releases, YEAR, HALF_YEAR)


_DEGW = _WIN + """, m AS (SELECT wid, node_id FROM win JOIN releases ON ts >= t_s AND ts < t_e), n AS (SELECT wid, count(*) AS n FROM m GROUP BY wid HAVING count(*) >= 2),
ed AS (SELECT p.wid, src, dst FROM dep_edges JOIN m p ON p.node_id = src JOIN m q ON q.node_id = dst AND q.wid = p.wid),
d AS (SELECT wid, node_id, count(*) AS d FROM (SELECT wid, src AS node_id FROM ed UNION ALL SELECT wid, dst FROM ed) GROUP BY ALL),
wc AS (SELECT m.wid, m.node_id, coalesce(d, 0) / (n - 1.0) AS cent FROM m JOIN n USING (wid) LEFT JOIN d ON d.wid = m.wid AND d.node_id = m.node_id)
"""


@query("l02_window_series", CANON + _DEGW + "SELECT wid, round(avg(cent), 9) AS mean, round(max(cent), 9) AS top, count(*) AS n FROM wc GROUP BY wid")
def _(t):
    rows = windows.window_degrees(t.releases, t.dep_edges, YEAR, HALF_YEAR)
    return rows.groupBy("wid").agg(F.round(F.avg("cent"), 9).alias("mean"), F.round(F.max("cent"), 9).alias("top"), F.count("*").alias("n"))


@query("l03_overlap_probe", CANON + """, b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM releases), r AS (SELECT unnest([0.25, 0.5]) AS r), z AS (SELECT r, lo, hi, CAST(floor(r * (hi - lo)) AS BIGINT) AS size FROM r, b),
m AS (SELECT r, (ts - lo) // size AS wid, node_id FROM releases, z WHERE ts < hi), n AS (SELECT r, wid, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 2),
ed AS (SELECT p.r, p.wid FROM dep_edges JOIN m p ON p.node_id = src JOIN m q ON q.node_id = dst AND q.wid = p.wid AND q.r = p.r), s AS (SELECT r, wid, 2 * count(*) AS d FROM ed GROUP BY ALL)
SELECT CAST(r AS DOUBLE) AS r, round(max(coalesce(d, 0) / (n - 1.0)), 6) AS score FROM n LEFT JOIN s USING (r, wid) GROUP BY r""")
def _(t):
    return windows.probe(t.releases, t.dep_edges, [0.25, 0.5], "sum").select("r", F.round("score", 6).alias("score"))


def _series(t):
    return t.series.select(F.lit("events").alias("series"), "t", "value")


@query("l04_median_step", CANON + "SELECT CAST(median(s) AS DOUBLE) AS median_step FROM (SELECT lead(t) OVER (ORDER BY t) - t AS s FROM series)")
def _(t):
    return windows.median_step(_series(t)).select("median_step")


@query("l04_decay_lag", CANON + ", x AS (SELECT row_number() OVER (ORDER BY t) AS i, value - avg(value) OVER () AS v, count(*) OVER () AS n FROM series), a AS (SELECT y.i - x.i AS lag, sum(x.v * y.v) / (SELECT sum(v * v) FROM x) AS r, min(x.n) AS n FROM x JOIN x y ON y.i > x.i GROUP BY 1) SELECT CAST(coalesce(min(lag) FILTER (r < 0.5), greatest(1, min(n) // 4)) AS DOUBLE) AS lag FROM a")
def _(t):
    return windows.decay_lag(_series(t)).select("lag")


# Of ser(series, t, v): |gradient| d, its median and deviation, and the peaks whose prominence is med + {times} * mad or more.
_PROMINENT = """, lagged AS (SELECT *, lag(v) OVER o AS y0, lead(v) OVER o AS y1, t - lag(t) OVER o AS h0, lead(t) OVER o - t AS h1, row_number() OVER o AS idx FROM ser WINDOW o AS (PARTITION BY series ORDER BY t)),
grad AS MATERIALIZED (SELECT series, t, v, idx, abs(CASE WHEN y0 IS NULL THEN (y1 - v) / h1 WHEN y1 IS NULL THEN (v - y0) / h0 ELSE (h0 * h0 * y1 + (h1 * h1 - h0 * h0) * v - h1 * h1 * y0) / (h0 * h1 * (h0 + h1)) END) AS d FROM lagged),
mids AS (SELECT series, median(d) AS med, count(*) AS n FROM grad GROUP BY 1), stat AS MATERIALIZED (SELECT series, med, n, median(abs(d - med)) + 1e-12::DOUBLE AS mad FROM grad JOIN mids USING (series) GROUP BY ALL),
tops AS (SELECT * FROM (SELECT *, lag(d) OVER o AS p, lead(d) OVER o AS q FROM grad WINDOW o AS (PARTITION BY series ORDER BY idx)) WHERE d > p AND d > q),
walls AS (SELECT a.series, a.idx, a.d, coalesce(max(b.idx) FILTER (b.idx < a.idx), 0) AS lo, coalesce(min(b.idx) FILTER (b.idx > a.idx), 1000000000000) AS hi FROM tops a LEFT JOIN grad b ON b.series = a.series AND b.d > a.d GROUP BY ALL),
feet AS (SELECT w.series, w.idx, w.d, greatest(min(b.d) FILTER (b.idx <= w.idx), min(b.d) FILTER (b.idx >= w.idx)) AS foot FROM walls w JOIN grad b ON b.series = w.series AND b.idx > w.lo AND b.idx < w.hi GROUP BY ALL),
peak AS MATERIALIZED (SELECT f.series, f.idx, f.d FROM feet f JOIN stat USING (series) WHERE f.d - foot >= med + {times} * mad)"""


@query("l05_time_scales", CANON + ", ser AS (SELECT 'events' AS series, t, value AS v FROM series)" + _PROMINENT.format(times=2) + """, x AS (SELECT row_number() OVER (ORDER BY t) AS i, value - avg(value) OVER () AS v, count(*) OVER () AS n FROM series),
decay AS (SELECT coalesce(min(lag) FILTER (r < 0.5), greatest(1, min(n) // 4)) AS lag FROM (SELECT y.i - x.i AS lag, sum(x.v * y.v) / (SELECT sum(v * v) FROM x) AS r, min(x.n) AS n FROM x JOIN x y ON y.i > x.i GROUP BY 1)),
step AS (SELECT median(s) AS step FROM (SELECT lead(t) OVER (ORDER BY t) - t AS s FROM series)),
half AS (SELECT p.idx, coalesce(max(b.idx) FILTER (b.idx <= p.idx), 1) AS i, coalesce(min(b.idx) FILTER (b.idx >= p.idx), (SELECT max(idx) FROM grad)) AS j FROM peak p LEFT JOIN grad b ON b.d <= p.d / 2 GROUP BY p.idx),
wide AS (SELECT median(b.t - a.t) AS width FROM half JOIN grad a ON a.idx = i JOIN grad b ON b.idx = j)
SELECT series, CAST(greatest(step, lag * step) AS DOUBLE) AS tau_c, CAST(greatest(step, coalesce(width, 5 * step)) AS DOUBLE) AS tau_chg, round(med, 9) AS grad_median, round(mad, 9) AS grad_mad FROM stat, step, decay, wide""")
def _(t):
    return windows.time_scales(_series(t)).select("series", "tau_c", "tau_chg", F.round("grad_median", 9).alias("grad_median"), F.round("grad_mad", 9).alias("grad_mad"))


@query("l06_candidate_scores", CANON + ", ser AS (SELECT event_type AS series, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS t, avg(value) AS v FROM events GROUP BY 1, 2)" + _PROMINENT.format(times=2.5) + """, m AS (
  SELECT series, any_value(n) AS n, greatest(0, least(1, 1 - stddev_pop(v) / (abs(avg(v)) + 1e-12::DOUBLE))) AS s, 0.6::DOUBLE * tanh(any_value(n) / 20) + 0.4::DOUBLE * tanh(var_pop(v) / (avg(v * v) + 1e-12::DOUBLE)) AS r,
    tanh(0.5::DOUBLE * (SELECT count(*) FROM peak WHERE peak.series = grad.series) / greatest(max(t) - min(t), 1e-9::DOUBLE)) * tanh(0.5::DOUBLE * coalesce(avg(d) FILTER (d > med + 2.5::DOUBLE * mad), 0) / any_value(mad)) AS c
  FROM grad JOIN stat USING (series) GROUP BY series)
SELECT series, round(CASE WHEN n < 3 THEN 0 ELSE s END, 6) AS s, round(CASE WHEN n < 3 THEN 0 ELSE c END, 6) AS c, round(CASE WHEN n < 3 THEN 0 ELSE r END, 6) AS r, round(CASE WHEN n < 3 OR s + c = 0 THEN 0 ELSE 2 * s * c / (s + c) * r END, 6) AS score FROM m""")
def _(t):
    kinds = t.raw("events").groupBy(c("event_type").alias("series"), F.unix_timestamp(F.date_trunc("day", c("ts").cast("timestamp"))).alias("t")).agg(F.avg("value").alias("value"))
    return windows.candidate_scores(kinds).select("series", *(F.round(x, 6).alias(x) for x in ("s", "c", "r", "score")))


@query("l07_window_recommendation")
def _(t):
    nodes, edges = _read_again(t)
    rows = window_graph.recommend(nodes, edges, alpha=0.1, coverage=0.9)
    return rows.select("candidate", "size", "step", F.round("score", 6).alias("score"), "distance", F.round("prominence", 12).alias("prominence"), "connected")


def _read_again(t):
    """Nodes and edges, written once, as several rounds and candidates read them."""
    from ..sources.shared import written

    return written(t.releases.select("node_id", "ts"), "nodes"), written(t.dep_edges, "edges")


_GROUPS = _WIN + """, own AS MATERIALIZED (SELECT wid, node_id, CAST(count(*) OVER (PARTITION BY wid) AS DOUBLE) AS n FROM win JOIN releases ON ts >= t_s AND ts < t_e),
inner_ AS MATERIALIZED (SELECT p.wid, src, dst FROM dep_edges JOIN own p ON p.node_id = src JOIN own q ON q.node_id = dst AND q.wid = p.wid)"""

_RANKS = _GROUPS + """, outs AS MATERIALIZED (SELECT wid, src, count(*) AS k FROM inner_ GROUP BY ALL), ways AS MATERIALIZED (SELECT wid, src, dst, 1.0::DOUBLE / k AS w FROM inner_ JOIN outs USING (wid, src)),
pr(i, wid, node_id, ends, n, rank, going) AS (
  SELECT 0, own.wid, node_id, src IS NULL, n, CAST(1.0 / n AS DOUBLE), true FROM own LEFT JOIN outs ON src = node_id AND outs.wid = own.wid
  UNION ALL SELECT i + 1, wid, node_id, ends, n, fresh, sum(abs(fresh - rank)) OVER (PARTITION BY wid) >= n * 1e-6
  FROM (SELECT p.*, 0.85::DOUBLE * (coalesce(f.flow, 0) + sum(CASE WHEN ends THEN rank ELSE 0 END) OVER (PARTITION BY p.wid) / n) + 0.15::DOUBLE / n AS fresh
    FROM pr p LEFT JOIN (SELECT w.wid, w.dst, sum(q.rank * w.w) AS flow FROM pr q JOIN ways w ON w.src = q.node_id AND w.wid = q.wid GROUP BY ALL) f ON f.dst = p.node_id AND f.wid = p.wid WHERE p.going AND p.i < 100)),
ranked AS MATERIALIZED (SELECT wid, node_id, arg_max(rank, i) AS cent FROM pr GROUP BY ALL)"""


@query("j04_window_pagerank", CANON + _RANKS + " SELECT wid, node_id, round(cent, 9) AS cent FROM ranked")
def _(t):
    return window_graph.pagerank(*_read_again(t), YEAR, HALF_YEAR).select("wid", "node_id", F.round("cent", 9).alias("cent"))


@query("l02_pagerank_series", CANON + _RANKS + f" SELECT CAST(lo + wid * {HALF_YEAR} + {YEAR // 2} AS BIGINT) AS t, round(avg(cent), 9) AS value FROM (SELECT wid, cent, row_number() OVER (PARTITION BY wid ORDER BY cent DESC) AS k FROM ranked), b WHERE k <= 5 GROUP BY ALL")
def _(t):
    return window_graph.centrality_series(*_read_again(t), YEAR, HALF_YEAR, "releases").select("t", F.round("value", 9).alias("value"))


@query("j04_window_eigenvector", CANON + _GROUPS + """, ways AS MATERIALIZED (SELECT wid, src, dst FROM inner_ UNION SELECT wid, dst, src FROM inner_),
ev(i, wid, node_id, n, x, base, going) AS (
  SELECT 0, wid, node_id, n, 1 / sqrt(n), 1 / sqrt(n), true FROM own WHERE n >= 10
  UNION ALL SELECT i + 1, wid, node_id, n, fresh, CASE WHEN (i + 1) % 5 = 0 THEN fresh ELSE base END, (i + 1) % 5 > 0 OR 2 - 2 * sum(fresh * base) OVER (PARTITION BY wid) >= n * 1e-12
  FROM (SELECT p.*, (x + coalesce(y, 0)) / sqrt(sum((x + coalesce(y, 0)) ** 2) OVER (PARTITION BY p.wid)) AS fresh
    FROM ev p LEFT JOIN (SELECT w.wid, w.dst, sum(q.x) AS y FROM ev q JOIN ways w ON w.src = q.node_id AND w.wid = q.wid GROUP BY ALL) f ON f.dst = p.node_id AND f.wid = p.wid WHERE p.going AND p.i < 100)),
deg AS (SELECT wid, src AS node_id, count(*) AS d FROM ways GROUP BY ALL)
SELECT wid, node_id, round(arg_max(x, i), 6) AS cent FROM ev GROUP BY ALL
UNION ALL SELECT o.wid, o.node_id, round(coalesce(d / sum(d) OVER (PARTITION BY o.wid), 0), 6) FROM own o LEFT JOIN deg ON deg.wid = o.wid AND deg.node_id = o.node_id WHERE n < 10""")
def _(t):
    return window_graph.eigenvector(*_read_again(t), YEAR, HALF_YEAR).select("wid", "node_id", F.round("cent", 6).alias("cent"))


_WIDTHS = (YEAR // 12, HALF_YEAR, YEAR)


@query("j21_window_components", CANON + f""", b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM releases), widths AS (SELECT unnest([{", ".join(map(str, _WIDTHS))}]) AS width),
win AS (SELECT width, k AS wid, lo + k * (width // 2) AS t_s FROM widths, b, unnest(range(0, CAST(ceil((hi - lo) / (width / 2)) AS BIGINT))) AS q(k)),
own AS MATERIALIZED (SELECT width, wid, node_id FROM win JOIN releases ON ts >= t_s AND ts < t_s + width),
ways AS MATERIALIZED (SELECT p.width, p.wid, e.src, e.dst FROM (SELECT src, dst FROM dep_edges UNION SELECT dst, src FROM dep_edges) e JOIN own p ON p.node_id = e.src JOIN own q ON q.node_id = e.dst AND q.wid = p.wid AND q.width = p.width),
reach(width, wid, node_id, comp) USING KEY (width, wid, node_id) AS (SELECT width, wid, node_id, node_id FROM own
UNION SELECT e.width, e.wid, e.dst, min(r.comp) FROM reach r JOIN ways e ON e.src = r.node_id AND e.wid = r.wid AND e.width = r.width
  JOIN recurring.reach AS had ON had.node_id = e.dst AND had.wid = e.wid AND had.width = e.width WHERE r.comp < had.comp GROUP BY ALL),
sizes AS (SELECT width, wid, comp, count(*) AS k FROM reach GROUP BY ALL)
SELECT width, wid, CAST(sum(k) AS BIGINT) AS n, round(max(k) / sum(k), 9) AS share FROM sizes GROUP BY width, wid HAVING sum(k) >= 2""")
def _(t):
    """Half-overlapping windows of a month, half a year and a year."""
    return window_graph.connected_shares(*_read_again(t), list(_WIDTHS)).select("width", "wid", "n", F.round("share", 9).alias("share"))


@query("j21_connected_width")
def _(t):
    """The least width of which nine of ten windows have a tenth of their nodes connected."""
    nodes, edges = _read_again(t)
    return t.spark.range(1).select(F.lit(window_graph.connected_width(nodes, edges, 0.1, 0.9)).alias("width"))


@query("l08_event_grid", CANON + ", f AS (SELECT r.node_id, coalesce(min(e.ts), min(r.ts)) AS t FROM releases r LEFT JOIN cve_list e USING (node_id) GROUP BY r.node_id) SELECT (t + 2591999999) // 2592000000 * 2592000000 AS t, count(*) AS n FROM f GROUP BY 1")
def _(t):
    """Nodes at their first CVE, or else their release, moved to the next date of a grid of 30 days."""
    first = t.releases.join(t.cve_list.select("node_id", c("ts").alias("cve_ts")), "node_id", "left").groupBy("node_id").agg(F.coalesce(F.min("cve_ts"), F.min("ts")).alias("t"))
    return first.groupBy((F.ceil(c("t") / 2592000000) * 2592000000).alias("t")).agg(F.count("*").alias("n"))


@query("l09_window_analysis")
def _(t):
    """A window's communities with scores and representatives: sub-graph, communities, centrality, score."""
    from ..sources.shared import written

    nodes, edges = windows.subgraph(t.family, t.family_edges, 788918400000, 946684800000)
    nodes, edges = written(nodes, "nodes"), written(edges, "edges")
    return graph.choose_community(graph.communities(nodes, edges), nodes, edges, aggregate.node_scores(t.cve_list)).select("comm", "representative", "n")


@query("l10_cve_window", CANON + ", b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM releases), x AS (SELECT cve_id, CASE WHEN cve_id LIKE '%3' THEN NULL ELSE r.ts END AS ts FROM cve_list c JOIN releases r USING (node_id)), o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM releases) SELECT cve_id, CASE WHEN ts IS NULL THEN (SELECT ts FROM o WHERE i = n // 4) ELSE greatest(lo, ts - 63072000000) END AS t_s, CASE WHEN ts IS NULL THEN (SELECT ts FROM o WHERE i = 3 * n // 4) ELSE least(hi, ts + 63072000000) END AS t_e FROM x, b")
def _(t):
    rows = t.cve_list.select("cve_id", "node_id").join(t.releases.select("node_id", "ts"), "node_id").select("cve_id", F.when(c("cve_id").endswith("3"), None).otherwise(c("ts")).alias("ts"))
    return windows.cve_window(rows, t.releases)


@query("s01_event_windows", "SELECT CAST(epoch(time_bucket(INTERVAL 1 hour, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t):
    """Hourly windows by type, by the same transformation that runs on the stream."""
    rows = stream.hourly(t.raw("events").withColumn("ts", c("ts").cast("timestamp")))
    return rows.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("s02_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER o <= INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) // 1000 AS first, count(*) AS n FROM k GROUP BY user_id, s")
def _(t):
    rows = stream.sessions(t.raw("events").withColumn("ts", c("ts").cast("timestamp")), "30 minutes")
    return rows.select("user_id", F.unix_millis("start").alias("first"), "n")
