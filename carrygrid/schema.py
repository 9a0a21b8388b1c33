"""Schemas of the stored tables, the normalised records and the landing zone."""

from __future__ import annotations

from pyspark.sql import types as T

RATE = T.DecimalType(18, 10)  # carry rate as a fraction
AMOUNT = T.DecimalType(30, 10)  # open interest, volume
WIDE = T.DecimalType(38, 8)  # what a quantity or price must fit at least


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, null) for name, dtype, null in fields])


EXCHANGES = _table(
    ("id", T.LongType(), False),
    ("name", T.StringType(), False),
    ("carry_interval_minutes", T.IntegerType(), True),
    ("is_active", T.BooleanType(), False),
    ("created_at", T.TimestampType(), False),
    ("updated_at", T.TimestampType(), False),
)
TOKENS = _table(
    ("id", T.LongType(), False),
    ("symbol", T.StringType(), False),
    ("created_at", T.TimestampType(), False),
)
MARKETS = _table(
    ("id", T.LongType(), False),
    ("exchange_id", T.LongType(), False),
    ("token_id", T.LongType(), False),
    ("market_symbol", T.StringType(), False),
    ("is_active", T.BooleanType(), False),
    ("created_at", T.TimestampType(), False),
    ("updated_at", T.TimestampType(), False),
)
# Facts are identified by (market_id, ts); they carry no surrogate id, which
# no query reads. ``dt`` is the UTC day of ``ts`` and the Parquet partition.
CARRY_RATES = _table(
    ("exchange_id", T.LongType(), False),
    ("market_id", T.LongType(), False),
    ("rate", RATE, False),
    ("ts", T.TimestampType(), False),
)
MARKET_STATS = _table(
    ("market_id", T.LongType(), False),
    ("open_interest", AMOUNT, True),
    ("volume_24h", AMOUNT, True),
    ("ts", T.TimestampType(), False),
)
# Materialised 8-hour buckets and per-market marks (both can be rebuilt).
CARRY_8H = _table(
    ("exchange_id", T.LongType(), False),
    ("market_id", T.LongType(), False),
    ("bucket_start", T.TimestampType(), False),
    ("rate_8h", T.DoubleType(), True),
    ("samples", T.LongType(), False),
)
LATEST_CARRY = _table(
    ("exchange_id", T.LongType(), False),
    ("market_id", T.LongType(), False),
    ("rate_8h", T.DoubleType(), True),
    ("bucket_start", T.TimestampType(), False),
)
CARRY_MARKS = _table(
    ("market_id", T.LongType(), False),
    ("last_ts", T.TimestampType(), False),
)

# One landed HTTP response per row.
LANDING = _table(
    ("exchange", T.StringType(), True),
    ("kind", T.StringType(), True),  # markets | carry | stats
    ("market", T.StringType(), True),  # the market asked for, if any
    ("received_at", T.TimestampType(), True),
    ("payload", T.StringType(), True),
)

# Records that wait for their market, by name.
WAITING_CARRY = T.StructType(
    [
        T.StructField("exchange", T.StringType()),
        T.StructField("market_symbol", T.StringType()),
        T.StructField("rate", RATE),
        T.StructField("ts", T.TimestampType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("pos", T.IntegerType()),
    ]
)
WAITING_STATS = T.StructType(
    [
        T.StructField("exchange", T.StringType()),
        T.StructField("asked_market", T.StringType()),
        T.StructField("market_symbol", T.StringType()),
        T.StructField("open_interest", AMOUNT),
        T.StructField("volume_24h", AMOUNT),
        T.StructField("ts", T.TimestampType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("pos", T.IntegerType()),
    ]
)
# The markets that such records are of.
WAITING_MARKETS = T.StructType([T.StructField("exchange", T.StringType()), T.StructField("market_symbol", T.StringType())])
