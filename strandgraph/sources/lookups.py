"""A table of lookups that expire: what was found for a key, or that nothing was, and how long that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How long a hit and a miss hold, in milliseconds.
HIT_MS, MISS_MS = 24 * 3_600_000, 5 * 60_000
#: Width of the time slots that a key's lookups are dealt over.
SLOT_MS = 3_600_000


def merged(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Lookups (key, at, payload) of both tables, one for each key and time; of one time a hit, then the larger payload."""
    both = stored.select("key", "at", "payload").unionByName(new.select("key", "at", "payload"))
    return both.filter("key IS NOT NULL AND at IS NOT NULL").groupBy("key", "at").agg(F.max("payload").alias("payload"))


def latest(stored: DataFrame) -> DataFrame:
    """The last lookup of each key, all that a table for readers of today has to keep."""
    return stored.groupBy("key").agg(F.max(F.struct("at", "payload")).alias("m")).select("key", "m.at", "m.payload")


def until(at: Column, payload: Column, hit_ms: int = HIT_MS, miss_ms: int = MISS_MS) -> Column:
    return at + F.when(payload.isNull(), F.lit(miss_ms)).otherwise(F.lit(hit_ms))


def as_of(asked: DataFrame, stored: DataFrame, hit_ms: int = HIT_MS, miss_ms: int = MISS_MS) -> DataFrame:
    """asked(key, asked_at, ...) with state, payload and found_at: by the last lookup up to then, `hit` or `miss` while it
    holds, else `stale`, which has to be looked up again.

    Both are dealt by (key, slot of an hour) and run through in order of time; a slot begins with the last lookup of those
    before it, from a table of one row a slot. So a key with a long history, or asked for very often, is dealt over its
    slots, and no row meets more than one lookup.
    """
    slot = F.floor(F.col("at") / F.lit(SLOT_MS)).alias("__slot")
    known = F.col("key").isNotNull() & F.col("asked_at").isNotNull()
    found = F.struct(F.col("at").alias("found_at"), "payload")
    of = stored.filter("key IS NOT NULL AND at IS NOT NULL").select("key", "at", slot, found.alias("__of"))
    wanted = asked.filter(known).select("key", F.col("asked_at").alias("at"), F.struct(*asked.columns).alias("__row")).withColumn("__slot", slot)
    rows = of.unionByName(wanted, allowMissingColumns=True)
    by_slot = Window.partitionBy("key").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("key", "__slot").agg(F.max("__of").alias("__end")).select("key", "__slot", F.last("__end", ignorenulls=True).over(by_slot).alias("__before"))
    # of one time lookups come first, the one of the larger payload last
    in_slot = Window.partitionBy("key", "__slot").orderBy("at", F.col("__row").isNotNull(), "__of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.withColumn("__last", F.last("__of", ignorenulls=True).over(in_slot)).filter("__row IS NOT NULL").join(ends, ["key", "__slot"])
    last = F.coalesce("__last", "__before")
    holds = F.col("__row.asked_at") < until(last["found_at"], last["payload"], hit_ms, miss_ms)
    out = met.select("__row.*", F.when(holds, last["found_at"]).alias("found_at"), F.when(holds, last["payload"]).alias("payload"))
    out = out.unionByName(asked.filter(~known), allowMissingColumns=True)
    return out.withColumn("state", F.when(F.col("found_at").isNull(), "stale").when(F.col("payload").isNull(), "miss").otherwise("hit"))
