"""Reductions of the two fact tables to one row per bucket or market.

Every step here is a hash aggregate with a map-side half, so a market that owns
a large share of all ticks reaches the shuffle as one row per task and bucket.
``max_by`` on fixed-width columns keeps the buffers updatable in place, which a
struct or a sorted window would not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrygrid.functions.timing import bucket_start


def carry_8h(carry: DataFrame) -> DataFrame:
    """Mean rate and tick count per (exchange, market, 8-hour bucket).

    The sum stays decimal to the last step, so the mean does not depend on the
    order in which partial sums meet.
    """
    return (
        carry.select("exchange_id", "market_id", "rate", bucket_start(F.col("ts")).alias("bucket_start"))
        .groupBy("exchange_id", "market_id", "bucket_start")
        .agg(F.sum("rate").alias("total"), F.count(F.lit(1)).alias("samples"))
        .select(
            "exchange_id",
            "market_id",
            "bucket_start",
            (F.col("total").cast("double") / F.col("samples")).alias("rate_8h"),
            "samples",
        )
    )


def latest_carry_8h(buckets: DataFrame) -> DataFrame:
    """Newest bucket per (exchange, market) of `carry_8h` rows."""
    return buckets.groupBy("exchange_id", "market_id").agg(
        F.max_by("rate_8h", "bucket_start").alias("rate_8h"),
        F.max("bucket_start").alias("bucket_start"),
    )


def newest_carry(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Merge newest buckets: the later start wins, a recomputed bucket replaces itself.

    Both sides have one row per market, so the rows to compare are two at most.
    """
    both = stored.withColumn("_age", F.lit(0)).unionByName(fresh.withColumn("_age", F.lit(1)))
    order = F.struct("bucket_start", "_age")
    return both.groupBy("exchange_id", "market_id").agg(
        F.max_by("rate_8h", order).alias("rate_8h"), F.max("bucket_start").alias("bucket_start")
    )


def latest_stats(stats: DataFrame) -> DataFrame:
    """Newest stats row per market. (market_id, ts) is unique, so there are no ties."""
    return stats.groupBy("market_id").agg(
        F.max_by("open_interest", "ts").alias("open_interest"),
        F.max_by("volume_24h", "ts").alias("volume_24h"),
        F.max("ts").alias("ts"),
    )


def latest_market_stats(stats: DataFrame, markets: DataFrame) -> DataFrame:
    """`latest_stats` with the exchange of the market; joined after the reduction."""
    owner = markets.select(F.col("id").alias("market_id"), "exchange_id")
    return (
        latest_stats(stats)
        .join(owner, "market_id")
        .select("exchange_id", "market_id", "open_interest", "volume_24h", "ts")
    )


def carry_marks(carry: DataFrame) -> DataFrame:
    """High-water mark: the newest stored tick of every market that has one."""
    return carry.groupBy("market_id").agg(F.max("ts").alias("last_ts"))


def active_market_marks(markets: DataFrame, marks: DataFrame) -> DataFrame:
    """Active markets with their mark, null where nothing is stored yet."""
    active = markets.where("is_active").select(
        F.col("id").alias("market_id"), "exchange_id", "market_symbol"
    )
    return active.join(marks, "market_id", "left")
