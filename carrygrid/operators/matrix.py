"""The token x exchange carry matrix.

Cells are kept long (one row per token and exchange); the nested document is
built from them at the very end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrygrid import keys
from carrygrid.functions import timing


def active_exchanges(exchanges: DataFrame) -> DataFrame:
    return exchanges.where("is_active").select("id", "name").orderBy("name")


def active_markets(markets: DataFrame, exchange_id: int) -> DataFrame:
    return (
        markets.where((F.col("exchange_id") == exchange_id) & F.col("is_active"))
        .select("id", "market_symbol")
        .orderBy("market_symbol")
    )


def find_exchange(exchanges: DataFrame, name: str) -> DataFrame:
    """Active exchange of that name in any letter case."""
    return exchanges.where(F.col("is_active") & (F.lower("name") == F.lower(F.lit(name)))).select("id", "name")


def resolve_exchanges(asked: DataFrame, exchanges: DataFrame) -> DataFrame:
    """`find_exchange` for a column of names: adds ``exchange_id`` and ``exchange``."""
    known = exchanges.where("is_active").select(
        F.lower("name").alias("_key"), F.col("id").alias("exchange_id"), F.col("name").alias("exchange")
    )
    return asked.withColumn("_key", F.lower("name")).join(known, "_key").drop("_key")


def market_dim(markets: DataFrame, tokens: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Active markets with token symbol and exchange name.

    No broadcast is forced: Spark broadcasts a side that its statistics show to
    be small, and AQE splits a hot token or exchange of a sort-merge join.
    """
    return (
        markets.where("is_active")
        .join(tokens.select(F.col("id").alias("token_id"), F.col("symbol").alias("token")), "token_id")
        .join(exchanges.select(F.col("id").alias("exchange_id"), F.col("name").alias("exchange")), "exchange_id")
        .select(F.col("id").alias("market_id"), "exchange_id", "exchange", "token_id", "token", "market_symbol")
    )


def matrix_cells(
    markets: DataFrame,
    tokens: DataFrame,
    exchanges: DataFrame,
    latest_carry: DataFrame,
    latest_stats: DataFrame,
) -> DataFrame:
    """One row per token and exchange with an active market.

    Where a token has several active markets on an exchange, the highest market
    id fills the cell; ``last_update`` still covers all of them. The markets are
    reduced to cells before the names are joined, so a token with very many
    markets never reaches a join as a hot key.
    """
    carry = latest_carry.select(
        "exchange_id", "market_id", "rate_8h", F.col("bucket_start").alias("carry_bucket")
    )
    stats = latest_stats.select(
        "market_id", "open_interest", "volume_24h", F.col("ts").alias("stats_ts")
    )
    active = (
        markets.where("is_active")
        .select(F.col("id").alias("market_id"), "exchange_id", "token_id", "market_symbol")
        .join(carry, ["exchange_id", "market_id"], "left")
        .join(stats, "market_id", "left")
    )
    newest = lambda name: F.max_by(name, "market_id").alias(name)
    cells = active.groupBy("token_id", "exchange_id").agg(
        newest("market_symbol"),
        newest("rate_8h"),
        newest("carry_bucket"),
        newest("open_interest"),
        newest("volume_24h"),
        newest("stats_ts"),
        F.max(timing.last_update(F.col("carry_bucket"), F.col("stats_ts"))).alias("last_update"),
    )
    return (
        cells.join(exchanges.select(F.col("id").alias("exchange_id"), F.col("name").alias("exchange")), "exchange_id")
        .join(tokens.select(F.col("id").alias("token_id"), F.col("symbol").alias("token")), "token_id")
        .select(
            "token", "exchange", "market_symbol", "rate_8h", "carry_bucket",
            "open_interest", "volume_24h", "stats_ts", "last_update",
        )
    )


def served_cells(cells: DataFrame, null_rate: str = "zero") -> DataFrame:
    """Cells as the API serves them: missing numbers are 0.

    ``null_rate='drop'`` leaves cells without a carry rate out instead of
    letting them enter the arbitrage maths as 0. Open interest stays decimal
    here, so that sums over it are exact; outputs cast it to double.
    """
    if null_rate == "drop":
        cells = cells.where(F.col("rate_8h").isNotNull())
    elif null_rate != "zero":
        raise ValueError(f"unknown null_rate: {null_rate}")
    return cells.select(
        "token",
        "exchange",
        F.coalesce("market_symbol", F.lit("")).alias("market_symbol"),
        F.coalesce("rate_8h", F.lit(0.0)).alias("carry_rate"),
        F.coalesce("open_interest", F.lit(0).cast("decimal(30,10)")).alias("open_interest"),
        F.coalesce("volume_24h", F.lit(0).cast("decimal(30,10)")).alias("volume_24h"),
        F.col("carry_bucket").alias("carry_ts"),
        "stats_ts",
        "last_update",
    )


def carry_matrix(cells: DataFrame) -> DataFrame:
    """One row per token: map of exchange to cell, and the token's last update.

    A token has at most one cell per exchange, so the collected list is bounded
    by the number of exchanges.
    """
    cell = F.struct(
        "market_symbol",
        F.col("rate_8h").alias(keys.RATE_8H),
        F.col("carry_bucket").alias(keys.BUCKET),
        F.col("open_interest").cast("double").alias("open_interest"),
        F.col("volume_24h").cast("double").alias("volume_24h"),
        "stats_ts",
    )
    return (
        cells.groupBy(F.col("token").alias("symbol"))
        .agg(
            F.collect_list(F.struct("exchange", cell.alias("cell"))).alias("entries"),
            F.max("last_update").alias("last_update"),
        )
        .select("symbol", F.map_from_entries(F.sort_array("entries")).alias("per_exchange"), "last_update")
    )


def token_last_update(cells: DataFrame) -> DataFrame:
    return cells.groupBy("token").agg(F.max("last_update").alias("last_update"))


def matrix_health(cells: DataFrame) -> DataFrame:
    """Number of tokens and the newest update; null on empty input."""
    return token_last_update(cells).agg(
        F.count(F.lit(1)).alias("tokens"), F.max("last_update").alias("last_updated")
    )


def health_document(cells: DataFrame) -> DataFrame:
    """`matrix_health` as the API's JSON text."""
    fields = F.struct(
        F.lit(True).alias("ok"), "tokens", timing.zulu_text(F.col("last_updated")).alias("last_updated")
    )
    return matrix_health(cells).select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("document"))


def matrix_documents(cells: DataFrame) -> DataFrame:
    """One JSON document per token, in the shape of the API's ``tokens`` entries.

    Tokens stay separate rows, so no row or task ever holds the whole matrix;
    ``df.write.text`` stores them as JSON lines. The API's ``last_updated`` is
    `matrix_health`.
    """
    served = served_cells(cells)
    cell = F.struct(
        "market_symbol",
        F.col("carry_rate").alias(keys.RATE),
        F.col("open_interest").cast("double").alias("open_interest"),
        F.col("volume_24h").cast("double").alias("volume_24h"),
        timing.offset_text(F.col("carry_ts")).alias(keys.TIME),
        timing.offset_text(F.col("stats_ts")).alias("stats_ts"),
    )
    rows = served.groupBy("token").agg(
        F.collect_list(F.struct("exchange", cell.alias("cell"))).alias("entries")
    )
    document = F.struct("token", F.map_from_entries(F.sort_array("entries")).alias("exchanges"))
    return rows.select("token", F.to_json(document, {"ignoreNullFields": "false"}).alias("document"))


STORED_CELL = (
    f"market_symbol string, {keys.RATE_8H} double, {keys.RATE} double, open_interest double, "
    f"volume_24h double, {keys.BUCKET} string, {keys.TIME} string, stats_ts string"
)


def read_stored_cells(rows: DataFrame, column: str) -> DataFrame:
    """Replace a column of cell JSON text by the cell's fields.

    Older field names are read where the current ones are absent; missing
    numbers are 0, missing times null. The text is parsed once per row.
    """
    keep = [c for c in rows.columns if c != column]
    cells = rows.select(*keep, F.from_json(column, STORED_CELL).alias("c"))
    return cells.selectExpr(
        *keep,
        "coalesce(c.market_symbol, '') AS market_symbol",
        f"coalesce(c.{keys.RATE_8H}, c.{keys.RATE}, 0D) AS carry_rate",
        "coalesce(c.open_interest, 0D) AS open_interest",
        "coalesce(c.volume_24h, 0D) AS volume_24h",
        f"coalesce(c.{keys.BUCKET}, c.{keys.TIME}) AS carry_ts",
        "c.stats_ts",
    )


def exchange_header(markets: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Sorted names of the exchanges that appear in the matrix.

    Every active market yields a cell, with or without facts, so the two
    dimensions are enough and no fact table is read.
    """
    used = markets.where("is_active").select("exchange_id").distinct()
    return (
        exchanges.join(used, exchanges["id"] == used["exchange_id"], "left_semi")
        .select(F.col("name").alias("exchange"))
        .orderBy("exchange")
    )


def matrix_wide(served: DataFrame, header: list[str]) -> DataFrame:
    """One column pair per exchange, null where a token has no cell there."""
    return (
        served.groupBy("token")
        .pivot("exchange", header)
        .agg(
            F.first("carry_rate").alias("rate"),
            F.first(F.col("open_interest").cast("double")).alias("oi"),
        )
    )
