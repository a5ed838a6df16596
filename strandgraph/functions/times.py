"""Time columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def to_ms(value: Column) -> Column:
    """Numbers below 1e10 are seconds, others milliseconds."""
    return F.when(value < 10_000_000_000, value * 1000).otherwise(value)


def coerce(value: Column) -> Column:
    """A timestamp from a string: epoch seconds or milliseconds, ISO, or one of the usual date formats; else null."""
    number = value.try_cast("double")
    formats = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy")
    return F.coalesce(F.timestamp_millis(to_ms(number).cast("long")), *(F.try_to_timestamp(value, F.lit(f)) for f in formats))


def days_between(a_ms: Column, b_ms: Column) -> Column:
    return (b_ms - a_ms) / F.lit(float(DAY_MS))
