"""URL filters: a temporal list join, by DataFrame and SQL functions only.

A list is a history of dated entries (domain, ts, action): `block` puts a domain and its subdomains on the list, `allow`
takes it off. The entries of a domain become validity intervals [ts, next ts); entries of one domain and time are one, and
`block` wins. A capture is judged by the entry of its host that is active at fetch time, or else of the nearest parent
domain that has an active entry. Intervals are cut at the boundaries of days that have entries or are asked for, so that the
join's key is (domain, day) and a domain's long history, or a host with very many captures, is dealt over its days.

Defined results: a null or malformed url has no host and is kept; so is a capture without fetch time or without active
entry; entries without domain, time or known action count for nothing; domains compare in lower case, without port and
without a dot at the end; repeated captures are judged each for itself; an empty list keeps everything. Only the columns
named are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

ACTIONS = ("block", "allow")


def host(url: Column) -> Column:
    """The lower-case host of an http(s) url, or null; what stands before the last @ isn't part of it."""
    found = F.regexp_extract(url, r"(?i)^\s*https?://(?:[^/?#]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\[\]]+?)\.?(?::\d*)?(?:[/?#].*)?\s*$", 1)
    return F.when(found != "", F.lower(found))


def parents(name: Column) -> Column:
    """A host and its parent domains, nearest first: a.b.c, b.c, c; an address in brackets has none."""
    parts = F.when(name.startswith("["), F.array(name)).otherwise(F.split(name, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def history(entries: DataFrame) -> DataFrame:
    """(domain, ts, action): a row for each domain and time with a known action; of one time, block comes after allow."""
    rows = entries.select(F.lower(F.regexp_replace("domain", r"\.$", "")).alias("domain"), F.col("ts").cast("timestamp").alias("ts"), F.lower("action").alias("action"))
    rows = rows.filter((F.col("domain") != "") & F.col("ts").isNotNull() & F.col("action").isin(*ACTIONS))
    return rows.groupBy("domain", "ts").agg(F.max("action").alias("action"))


def intervals(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(domain, day, action, entry_ts, begins, ends): validity intervals cut at day boundaries, for the days that have entries
    or are in asked(domain, day); begins and ends are null at the day's own bounds.

    Entries of one domain and day are ordered among themselves; from one day to the next only the last entry is carried.
    """
    rows = materialize(history(entries).withColumn("day", F.to_date("ts")), "history")
    inside = rows.select("domain", "day", "action", F.col("ts").alias("entry_ts"), F.col("ts").alias("begins"), F.lead("ts").over(Window.partitionBy("domain", "day").orderBy("ts")).alias("ends"))
    held = rows.groupBy("domain", "day").agg(F.max(F.struct("ts", "action")).alias("end"), F.min("ts").alias("first"))
    # domains without an entry are asked for in vain: com, say, has all its captures under it
    wanted = asked.join(rows.select("domain").distinct(), "domain", "left_semi").select("domain", "day").distinct()
    days = held.unionByName(wanted, allowMissingColumns=True).groupBy("domain", "day").agg(F.max("end").alias("end"), F.min("first").alias("first"))
    earlier = F.last("end", ignorenulls=True).over(Window.partitionBy("domain").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    carried = days.withColumn("end", earlier).filter("end IS NOT NULL")
    carried = carried.select("domain", "day", F.col("end.action").alias("action"), F.col("end.ts").alias("entry_ts"), F.lit(None).cast("timestamp").alias("begins"), F.col("first").alias("ends"))
    return inside.unionByName(carried)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(capture_id, url, fetched) with host, matched_domain, entry_ts and verdict (block or keep): a row for each."""
    rows = captures.select("capture_id", "url", F.col("fetched").cast("timestamp").alias("fetched"), host(F.col("url")).alias("host"))
    # many captures share host and time: each is judged once
    asked = rows.filter(F.col("host").isNotNull() & F.col("fetched").isNotNull()).select("host", "fetched").distinct()
    asked = asked.select("host", "fetched", F.posexplode(parents(F.col("host"))).alias("level", "domain")).withColumn("day", F.to_date("fetched"))
    asked = materialize(asked, "asked")
    active = asked.join(intervals(entries, asked), ["domain", "day"])
    active = active.filter((F.col("begins").isNull() | (F.col("begins") <= F.col("fetched"))) & (F.col("ends").isNull() | (F.col("fetched") < F.col("ends"))))
    nearest = active.groupBy("host", "fetched").agg(F.min(F.struct("level", "domain", "entry_ts", "action")).alias("m"))
    nearest = nearest.select("host", "fetched", F.col("m.domain").alias("matched_domain"), F.col("m.entry_ts").alias("entry_ts"), F.col("m.action").alias("action"))
    out = rows.join(nearest, ["host", "fetched"], "left")
    verdict = F.when(F.col("action") == "block", "block").otherwise("keep")
    return out.select("capture_id", "url", "host", "fetched", "matched_domain", "entry_ts", verdict.alias("verdict"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Captures: all pages, fetched in page_id order over January 2024. Entries: every event, for the domain of its user.

    The domains are the hosts of pages and their parents of two or more labels. With n of them, a domain's users are those
    whose user_id and whose domain's md5 are alike modulo n: about one domain for a user, however many there are of either.
    Errors and clicks put a domain on the list, other events take it off.
    """
    pages = table(spark, sf_dir, "pages")
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", F.timestamp_seconds(F.unix_timestamp(start) + F.pmod(F.col("page_id") * 7919, F.lit(30 * 86400))).alias("fetched"))
    names = captures.select(F.explode(parents(host(F.col("url")))).alias("domain")).filter(F.col("domain").contains(".")).distinct()
    names = materialize(names, "domains")
    n = F.lit(max(1, names.count()))
    # few rows pass here: one for each domain and user, never one for each page or event
    ranked = names.withColumn("slot", F.pmod(F.conv(F.substring(F.md5("domain"), 1, 8), 16, 10).cast("long"), n))
    events = table(spark, sf_dir, "events").select(F.col("user_id"), "ts", F.when(F.col("event_type").isin("error", "click"), "block").otherwise("allow").alias("action"))
    users = events.select("user_id").distinct().withColumn("slot", F.pmod(F.col("user_id").cast("long"), n))
    owners = ranked.join(users, "slot").select("user_id", "domain")
    entries = owners.join(events, "user_id").select("domain", "ts", "action")
    return judge(captures, entries)


OP5_SQL = r"""
WITH c AS (
  SELECT page_id AS capture_id, url, lower(nullif(regexp_extract(url, '(?i)^\s*https?://(?:[^/?#]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\[\]]+?)\.?(?::\d*)?(?:[/?#].*)?\s*$', 1), '')) AS host,
    TIMESTAMP '2024-01-01 00:00:00' + to_seconds((page_id * 7919) % (30 * 86400)) AS fetched FROM pages),
p AS (
  SELECT DISTINCT host, k - 1 AS level, array_to_string(string_split(host, '.')[k:], '.') AS domain
  FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL), unnest(range(1, len(string_split(host, '.')) + 1)) AS t(k)),
dn AS (SELECT DISTINCT domain FROM p WHERE contains(domain, '.')),
n AS (SELECT domain, CAST('0x' || substr(md5(domain), 1, 8) AS BIGINT) % (SELECT count(*) FROM dn) AS slot FROM dn),
d AS (SELECT user_id, ts, CASE WHEN event_type IN ('error', 'click') THEN 'block' ELSE 'allow' END AS action FROM events),
e AS (SELECT domain, ts, max(action) AS action FROM n JOIN d ON d.user_id % (SELECT count(*) FROM dn) = n.slot GROUP BY domain, ts),
i AS (SELECT domain, action, ts AS from_ts, lead(ts) OVER (PARTITION BY domain ORDER BY ts) AS to_ts FROM e),
m AS (
  SELECT capture_id, i.domain, i.from_ts, i.action, row_number() OVER (PARTITION BY capture_id ORDER BY level) AS k
  FROM c JOIN p USING (host) JOIN i ON i.domain = p.domain AND i.from_ts <= c.fetched AND (i.to_ts IS NULL OR c.fetched < i.to_ts))
SELECT c.capture_id, url, host, fetched, m.domain AS matched_domain, m.from_ts AS entry_ts,
  CASE WHEN m.action = 'block' THEN 'block' ELSE 'keep' END AS verdict
FROM c LEFT JOIN m ON m.capture_id = c.capture_id AND m.k = 1
"""
