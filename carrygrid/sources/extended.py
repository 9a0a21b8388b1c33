"""Normaliser for responses of the shape ``{"data": ...}``.

All numbers are required and arrive as strings, times as epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrygrid.functions import names, numbers, timing
from carrygrid.schema import AMOUNT, RATE

from .records import accept, first_reason, is_failfast, item_reason, items_of

NAME = "extended"  # fixed value: the exchange name that selects this normaliser


def parse_markets(responses: DataFrame, failfast: bool = False) -> DataFrame:
    rows = items_of(responses, "data array<struct<name:string,assetName:string,active:boolean>>", "data")
    item = F.col("item")
    return rows.select(
        F.lit(NAME).alias("exchange"),
        item["assetName"].alias("symbol"),
        item["name"].alias("market_symbol"),
        item["assetName"].alias("base_currency"),
        names.quote_of(item["name"]).alias("quote_currency"),
        item["active"].alias("is_active"),
        "received_at",
        "pos",
        F.lit(True).alias("wanted"),
        item_reason(
            failfast,
            (item["name"].isNull(), "missing name"),
            (item["assetName"].isNull(), "missing assetName"),
            (item["active"].isNull(), "missing active"),
        ),
    )


def parse_stats(responses: DataFrame, failfast: bool = False) -> DataFrame:
    """One row per response; the market is the one asked for. No price conversion."""
    schema = "data struct<openInterest:string,dailyVolume:string>"
    data = F.from_json("payload", schema)["data"]
    rows = responses.select("market", "received_at", data.alias("item"))
    item = F.col("item")
    oi = item["openInterest"].try_cast(AMOUNT)
    volume = item["dailyVolume"].try_cast(AMOUNT)
    reject = first_reason(
        failfast,
        (item.isNull(), "malformed response"),
        (F.col("market").isNull(), "missing market"),
        (oi.isNull(), "bad openInterest"),
        (volume.isNull(), "bad dailyVolume"),
    )
    return rows.select(
        F.lit(NAME).alias("exchange"),
        F.col("market").alias("asked_market"),
        F.col("market").alias("market_symbol"),
        oi.alias("open_interest"),
        volume.alias("volume_24h"),
        F.col("received_at").alias("ts"),
        "received_at",
        F.lit(0).alias("pos"),
        F.lit(True).alias("wanted"),
        reject.alias("reject"),
    )


def parse_carry(responses: DataFrame, failfast: bool = False) -> DataFrame:
    rows = items_of(responses, "data array<struct<m:string,f:string,T:bigint>>", "data")
    item = F.col("item")
    return rows.select(
        F.lit(NAME).alias("exchange"),
        item["m"].alias("market_symbol"),
        item["f"].try_cast(RATE).alias("rate"),
        timing.from_epoch_ms(item["T"]).alias("ts"),
        "received_at",
        "pos",
        F.lit(True).alias("wanted"),
        item_reason(
            failfast,
            (item["m"].isNull(), "missing m"),
            (item["f"].try_cast(RATE).isNull(), "bad f"),
            (item["T"].isNull(), "bad T"),
            (~timing.in_range_ms(item["T"]), "T out of range"),
        ),
    )


def markets(responses: DataFrame, mode: str = "failfast") -> DataFrame:
    return accept(parse_markets(responses, is_failfast(mode)), is_failfast(mode))


def stats(responses: DataFrame, mode: str = "failfast") -> DataFrame:
    return accept(parse_stats(responses, is_failfast(mode)), is_failfast(mode))


def carry(responses: DataFrame, mode: str = "failfast") -> DataFrame:
    return accept(parse_carry(responses, is_failfast(mode)), is_failfast(mode))
