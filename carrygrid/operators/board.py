"""The board: one row per token with everything the table shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrygrid.functions import classes, display
from carrygrid.functions.constants import BPS, MISSING

from .arbitrage import HIGHEST, LOWEST, TOTAL_OI, pair_of


def carry_board(served: DataFrame, display_mode: str = "rate", spread_unit: str = "percentage") -> DataFrame:
    """Token, total open interest, spread, best pair, classes, texts and cells.

    One aggregate per token yields all of it; the per-cell classes are computed
    inside the collected array (bounded by the number of exchanges), so neither
    a window nor a join back is needed.
    """
    per_token = served.groupBy("token").agg(
        F.count(F.lit(1)).alias("exchanges"),
        F.expr(TOTAL_OI).alias("total_oi"),
        F.expr(LOWEST).alias("low"),
        F.expr(HIGHEST).alias("high"),
        F.expr("collect_list(struct(exchange, carry_rate, double(open_interest) AS open_interest))").alias("raw_cells"),
        F.max("last_update").alias("last_update"),
    )
    raw = f"""struct(c.exchange, c.carry_rate, c.open_interest,
        {display.unit_scaled("c.open_interest")} AS oi_scaled)"""
    cell = f"""struct(
        c.exchange, c.carry_rate, c.open_interest,
        {classes.rate_class("c.carry_rate", "low.rate", "high.rate", "exchanges")} AS rate_class,
        {display.rate_text("c.carry_rate", display_mode)} AS rate_text,
        {display.dollars("c.open_interest", "c.oi_scaled")} AS oi_text)"""
    pairs = per_token.selectExpr(
        "token",
        "total_oi",
        f"{display.unit_scaled('total_oi')} AS total_oi_scaled",
        f"CASE WHEN exchanges >= 2 THEN (high.rate - low.rate) * {BPS}D END AS spread",
        f"{pair_of('low', 'high')} AS pair",
        f"{display.unit_scaled('low.oi + high.oi')} AS pair_oi_scaled",
        f"transform(transform(sort_array(raw_cells), c -> {raw}), c -> {cell}) AS cells",
        "last_update",
    )
    rates = ("pair.long_rate", "pair.short_rate", "pair.spread")
    return pairs.selectExpr(
        "token",
        "total_oi",
        f"{display.dollars('total_oi', 'total_oi_scaled')} AS total_oi_text",
        "spread",
        f"{display.spread_text('spread', spread_unit)} AS spread_text",
        f"{classes.spread_class('spread')} AS spread_class",
        "pair",
        f"{display.arb_label('pair.long_exchange', 'pair.short_exchange', *rates)} AS pair_label",
        f"{display.capture_text(*rates)} AS capture_text",
        f"""CASE WHEN pair IS NULL THEN '{MISSING}'
            ELSE {display.dollars('pair.combined_oi', 'pair_oi_scaled')} END AS pair_oi_text""",
        f"{classes.opportunity_class(*rates)} AS pair_class",
        f"{classes.row_class(*rates)} AS row_class",
        "cells",
        "last_update",
    )


def _sort_value(column: str) -> Column:
    """Sort key with the value that stands in for a missing one."""
    keys = {
        "token": F.col("token"),
        "openInterest": F.col("total_oi"),
        "arbSpread": F.coalesce("spread", F.lit(-1.0)),
        "arbCombo": F.coalesce("pair.spread", F.lit(-1.0)),
        "arbOI": F.coalesce("pair.combined_oi", F.lit(-1.0)),
    }
    if column in keys:
        return keys[column]
    if column.startswith("exchange_"):
        name = column.removeprefix("exchange_")
        cell = F.get(F.filter("cells", lambda c: c["exchange"] == name), F.lit(0))
        return F.coalesce(cell["carry_rate"], F.lit(-999.0))
    raise ValueError(f"unknown sort column: {column}")


def sort_board(board: DataFrame, column: str = "", direction: str = "desc") -> DataFrame:
    """Board in display order; an empty column leaves it as it is."""
    if not column:
        return board
    if direction not in ("asc", "desc"):
        raise ValueError(f"unknown direction: {direction}")
    key = _sort_value(column)
    return board.orderBy(key.asc() if direction == "asc" else key.desc(), F.col("token"))


def toggled(column: str, direction: str, clicked: str) -> tuple[str, str]:
    """Next sort after a click: the same column flips, another starts descending."""
    if clicked == column:
        return column, "desc" if direction == "asc" else "asc"
    return clicked, "desc"
