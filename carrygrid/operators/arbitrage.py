"""Cross-exchange spreads and the best long/short pair per token.

The widest pair of a token is its lowest and its highest rate, so one grouped
pass finds it; no pair is ever materialised. Equal rates go to the exchange
whose name sorts first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrygrid.functions import classes
from carrygrid.functions.constants import BPS, MIN_SPREAD_BPS

LOWEST = "min(struct(carry_rate AS rate, exchange, double(open_interest) AS oi))"
HIGHEST = "min(struct(-carry_rate AS falling, exchange, carry_rate AS rate, double(open_interest) AS oi))"
# A decimal sum is exact in any order.
TOTAL_OI = "double(sum(open_interest))"


def total_open_interest(served: DataFrame) -> DataFrame:
    return served.groupBy("token").agg(F.expr(TOTAL_OI).alias("total_oi"))


def arb_spread(served: DataFrame) -> DataFrame:
    """Highest minus lowest rate in bps; null with fewer than two exchanges."""
    spread = f"CASE WHEN count(1) >= 2 THEN (max(carry_rate) - min(carry_rate)) * {BPS}D END"
    return served.groupBy("token").agg(F.expr(spread).alias("spread"))


def pair_of(low: str, high: str) -> str:
    """Pair struct from the two extremes; null below the smallest spread.

    Doubles are compared on purpose: a nominal 2 bps that computes to
    1.9999999999999998 is no pair.
    """
    spread = f"({high}.rate - {low}.rate) * {BPS}D"
    return f"""CASE WHEN {low}.exchange <> {high}.exchange AND {spread} >= {MIN_SPREAD_BPS}D THEN struct(
        {low}.exchange AS long_exchange, {high}.exchange AS short_exchange,
        {low}.rate AS long_rate, {high}.rate AS short_rate,
        {spread} AS spread, {low}.oi + {high}.oi AS combined_oi) END"""


def best_arb(served: DataFrame) -> DataFrame:
    """Best pair per token; tokens without one are absent."""
    extremes = served.groupBy("token").agg(F.expr(LOWEST).alias("low"), F.expr(HIGHEST).alias("high"))
    return (
        extremes.selectExpr("token", f"{pair_of('low', 'high')} AS pair")
        .where("pair IS NOT NULL")
        .select("token", "pair.*")
    )


def rate_classes(served: DataFrame) -> DataFrame:
    """Class of every cell. A window holds one token: at most one row per exchange."""
    cells = served.selectExpr(
        "token",
        "exchange",
        "carry_rate",
        "min(carry_rate) OVER (PARTITION BY token) AS low",
        "max(carry_rate) OVER (PARTITION BY token) AS high",
        "count(1) OVER (PARTITION BY token) AS exchanges",
    )
    return cells.selectExpr(
        "token", "exchange", "carry_rate",
        f"{classes.rate_class('carry_rate', 'low', 'high', 'exchanges')} AS rate_class",
    )
