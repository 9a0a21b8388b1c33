"""Timestamps: epoch milliseconds, whole seconds, 8-hour buckets, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_HOURS = 8
# Years 0001 to 9999, the range of a Spark timestamp.
FIRST_MS = -62135596800000
LAST_MS = 253402300799999


def in_range_ms(ms: Column) -> Column:
    return ms.between(FIRST_MS, LAST_MS)


def from_epoch_ms(ms: Column) -> Column:
    """UTC instant; null when the value lies outside the timestamp range."""
    return F.timestamp_millis(F.when(in_range_ms(ms), ms))


def whole_second(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def bucket_start(ts: Column, hours: int = BUCKET_HOURS) -> Column:
    """Start of the UTC bucket holding ``ts``: plain long arithmetic, any plan node."""
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(hours * 3600)))


def last_update(carry_bucket: Column, stats_ts: Column) -> Column:
    """The later of two instants, a missing one counting as the epoch."""
    epoch = F.timestamp_seconds(F.lit(0))
    return F.greatest(F.coalesce(carry_bucket, epoch), F.coalesce(stats_ts, epoch))


def zulu_text(ts: Column) -> Column:
    """RFC 3339 text, ``Z`` for UTC (document level)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def offset_text(ts: Column) -> Column:
    """ISO text with a numeric offset, ``+00:00`` for UTC (cell level)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")
