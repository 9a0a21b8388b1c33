"""Normaliser for responses of the shape ``{"results": [...]}``.

Numbers may be JSON numbers, strings, blanks or null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrygrid.functions import names, numbers, timing
from carrygrid import keys
from carrygrid.schema import AMOUNT, RATE, WIDE

from .records import accept, is_failfast, item_reason, items_of

NAME = "paradex"  # fixed value: the exchange name that selects this normaliser


def parse_markets(responses: DataFrame, failfast: bool = False) -> DataFrame:
    rows = items_of(
        responses,
        "results array<struct<symbol:string,base_currency:string,quote_currency:string>>",
        "results",
    )
    item = F.col("item")
    return rows.select(
        F.lit(NAME).alias("exchange"),
        item["base_currency"].alias("symbol"),
        item["symbol"].alias("market_symbol"),
        item["base_currency"].alias("base_currency"),
        item["quote_currency"].alias("quote_currency"),
        F.lit(True).alias("is_active"),
        "received_at",
        "pos",
        names.is_perpetual(item["symbol"]).alias("wanted"),
        item_reason(
            failfast,
            (item["symbol"].isNull(), "missing symbol"),
            (item["base_currency"].isNull(), "missing base_currency"),
            (item["quote_currency"].isNull(), "missing quote_currency"),
        ),
    )


def parse_stats(responses: DataFrame, failfast: bool = False) -> DataFrame:
    """Open interest arrives in base units and is stored in dollars."""
    fields = ["open_interest", "volume_24h", "mark_price", "underlying_price", "last_traded_price"]
    rows = items_of(
        responses,
        "results array<struct<symbol:string," + ",".join(f"{f}:string" for f in fields) + ">>",
        "results",
    )
    item = F.col("item")
    types = [WIDE, AMOUNT, WIDE, WIDE, WIDE]
    price = numbers.first_price(*[numbers.given(item[f]) for f in fields[2:]])
    base = numbers.given(item["open_interest"])
    dollars = numbers.open_interest_usd(base, price)
    return rows.select(
        F.lit(NAME).alias("exchange"),
        F.col("market").alias("asked_market"),
        item["symbol"].alias("market_symbol"),
        dollars.alias("open_interest"),
        numbers.optional_decimal(item["volume_24h"], AMOUNT).alias("volume_24h"),
        F.col("received_at").alias("ts"),  # a summary carries no time of its own
        "received_at",
        "pos",
        names.is_perpetual(item["symbol"]).alias("wanted"),
        item_reason(
            failfast,
            (item["symbol"].isNull(), "missing symbol"),
            *[(numbers.unreadable(item[f], t), f"bad {f}") for f, t in zip(fields, types)],
            (dollars.isNull() & base.isNotNull() & price.isNotNull(), "open_interest out of range"),
        ),
    )


def parse_carry(responses: DataFrame, failfast: bool = False) -> DataFrame:
    """Ticks; one without a rate is not wanted.

    The three carry numbers must be present, though they may be null, so the
    records are read as maps, which keep an absent key apart from a null.
    """
    rows = items_of(responses, "results array<map<string,string>>", "results")
    item = F.col("item")
    fields = [keys.INDEX, keys.PREMIUM, keys.RATE]
    rate = numbers.optional_decimal(item[keys.RATE], RATE)
    ms = numbers.epoch_ms(item["created_at"])
    return rows.select(
        F.lit(NAME).alias("exchange"),
        item["market"].alias("market_symbol"),
        rate.alias("rate"),
        timing.from_epoch_ms(ms).alias("ts"),
        "received_at",
        "pos",
        rate.isNotNull().alias("wanted"),
        item_reason(
            failfast,
            (item["market"].isNull(), "missing market"),
            *[(~F.map_contains_key(item, f), f"missing {f}") for f in fields],
            # Neither is stored, so any number will do.
            (numbers.no_number(item[keys.INDEX]), f"bad {keys.INDEX}"),
            (numbers.no_number(item[keys.PREMIUM]), f"bad {keys.PREMIUM}"),
            (numbers.unreadable(item[keys.RATE], RATE), f"bad {keys.RATE}"),
            (ms.isNull(), "bad created_at"),
            (~timing.in_range_ms(ms), "created_at out of range"),
        ),
    )


def markets(responses: DataFrame, mode: str = "failfast") -> DataFrame:
    return accept(parse_markets(responses, is_failfast(mode)), is_failfast(mode))


def stats(responses: DataFrame, mode: str = "failfast") -> DataFrame:
    return accept(parse_stats(responses, is_failfast(mode)), is_failfast(mode))


def carry(responses: DataFrame, mode: str = "failfast") -> DataFrame:
    return accept(parse_carry(responses, is_failfast(mode)), is_failfast(mode))
