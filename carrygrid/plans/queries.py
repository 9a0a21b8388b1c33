"""The registered queries: every operation run over the given tables.

Each function takes the derived tables and returns a DataFrame; timestamps are
cast to ``timestamp_ntz`` at the end, the type of the given data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carrygrid import keys
from carrygrid.functions import classes, display, names, numbers, timing
from carrygrid.operators import arbitrage, board, facts, matrix, upserts, windows
from carrygrid.session import shared_folder
from carrygrid.sources import extended, paradex, registry
from carrygrid.sources.landing import write_landing
from carrygrid.sources.warehouse import Warehouse
from carrygrid.streaming import ingest, rolling

from . import jobs
from .fixtures import NOW, StreamTables, Tables, as_ntz, ts_literal

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


def now() -> Column:
    return ts_literal(NOW)


# ---- responses built from events ---------------------------------------------


def _json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _response(exchange: Column, kind: str, payload: Column, market: Column | None = None,
              received: Column | None = None) -> list[Column]:
    return [
        exchange.alias("exchange"),
        F.lit(kind).alias("kind"),
        (F.lit(None).cast("string") if market is None else market).alias("market"),
        (ts_literal(NOW) if received is None else received).alias("received_at"),
        payload.alias("payload"),
    ]


def results_ticks() -> Column:
    """``{"results": [...]}`` with the tick, one without rate and one with a blank rate."""
    def tick(rate: Column) -> Column:
        return F.struct(
            F.col("market_symbol").alias("market"),
            F.lit("1.5").alias(keys.INDEX),
            F.lit(None).cast("string").alias(keys.PREMIUM),
            rate.alias(keys.RATE),
            F.unix_millis("ts").cast("string").alias("created_at"),
        )

    rates = [F.col("rate").cast("string"), F.lit(None).cast("string"), F.lit("  ")]
    return _json(F.lit(None).cast("string").alias("next"), F.array(*[tick(r) for r in rates]).alias("results"))


def data_ticks() -> Column:
    tick = F.struct(
        F.col("market_symbol").alias("m"),
        F.col("rate").cast("string").alias("f"),
        F.unix_millis("ts").alias("T"),
    )
    return _json(F.array(tick).alias("data"))


def results_markets(t: Tables) -> DataFrame:
    def entry(symbol: Column) -> Column:
        return F.struct(
            symbol.alias("symbol"),
            F.split_part("market_symbol", F.lit("-"), F.lit(1)).alias("base_currency"),
            F.lit("USD").alias("quote_currency"),
            F.lit(None).cast("string").alias("asset_kind"),
        )

    symbol = F.col("market_symbol")
    variants = [
        F.when(F.col("id") % 2 == 0, symbol).otherwise(F.concat(F.lower(symbol), F.lit("s"))),
        F.concat(symbol, F.lit("-OPTION")),
    ]
    payload = _json(F.array(*[entry(v) for v in variants]).alias("results"))
    return t.markets().select(*_response(F.lit("paradex"), "markets", payload))


def results_stats(t: Tables) -> DataFrame:
    price = lambda n: ((F.col("event_id") % 1000 + n).cast("decimal(18,2)") / 4).cast("decimal(18,2)").cast("string")
    known = lambda n, c: F.when(F.col("event_id") % n != 0, c)
    entry = F.struct(
        t.market_symbol().alias("symbol"),
        known(7, F.col("value").cast("decimal(18,2)").cast("string")).alias("open_interest"),
        F.when(F.col("event_id") % 5 == 0, F.lit(" "))
        .otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
        .alias("volume_24h"),
        known(2, price(1)).alias("mark_price"),
        known(4, price(2)).alias("underlying_price"),
        known(8, price(3)).alias("last_traded_price"),
    )
    payload = _json(F.array(entry).alias("results"))
    return t.purchases().select(*_response(F.lit("paradex"), "stats", payload, received=F.col("ts")))


# ---- sources -------------------------------------------------------------------


@query
def norm_markets_a(t: Tables) -> DataFrame:
    return paradex.markets(results_markets(t)).drop("received_at", "pos")


@query
def norm_stats_a(t: Tables) -> DataFrame:
    rows = paradex.stats(results_stats(t)).select("market_symbol", "open_interest", "volume_24h", "ts")
    return as_ntz(rows, "ts")


@query
def norm_carry_a(t: Tables) -> DataFrame:
    responses = t.ticks().select(*_response(F.lit("paradex"), "carry", results_ticks()))
    return as_ntz(paradex.carry(responses).select("market_symbol", "rate", "ts"), "ts")


@query
def norm_markets_b(t: Tables) -> DataFrame:
    entry = F.struct(
        F.when(F.col("id") % 7 == 0, F.col("id").cast("string"))
        .otherwise(F.concat(F.col("id").cast("string"), F.lit("-USD")))
        .alias("name"),
        F.concat(F.lit("TKN"), F.col("token_id").cast("string")).alias("assetName"),
        F.col("is_active").alias("active"),
    )
    payload = _json(F.array(entry).alias("data"))
    responses = t.markets().select(*_response(F.lit("extended"), "markets", payload))
    return extended.markets(responses).drop("received_at", "pos")


@query
def norm_carry_b(t: Tables) -> DataFrame:
    responses = t.ticks().select(*_response(F.lit("extended"), "carry", data_ticks()))
    return as_ntz(extended.carry(responses).select("market_symbol", "rate", "ts"), "ts")


@query
def norm_stats_b(t: Tables) -> DataFrame:
    data = F.struct(
        F.col("value").cast("decimal(18,2)").cast("string").alias("openInterest"),
        (F.col("value").cast("decimal(18,2)") * 10).cast("string").alias("dailyVolume"),
    )
    responses = t.purchases().select(
        *_response(F.lit("extended"), "stats", _json(data.alias("data")), t.market_symbol(), F.col("ts"))
    )
    rows = extended.stats(responses).select("market_symbol", "open_interest", "volume_24h", "ts")
    return as_ntz(rows, "ts")


def mixed_carry(t: Tables) -> DataFrame:
    """Carry responses of two supported exchanges and an unknown one."""
    kind = F.col("user_id") % 3
    exchange = F.when(kind == 0, "Paradex ").when(kind == 1, " EXTENDED").otherwise("Elsewhere")
    payload = F.when(kind == 1, data_ticks()).otherwise(results_ticks())
    return t.ticks().select(*_response(exchange, "carry", payload))


@query
def norm_all(t: Tables) -> DataFrame:
    rows = registry.normalize(mixed_carry(t), "carry")
    return as_ntz(rows.select("exchange", "market_symbol", "rate", "ts"), "ts")


@query
def norm_skipped(t: Tables) -> DataFrame:
    return registry.skipped(mixed_carry(t))


@query
def unnest_batch(t: Tables) -> DataFrame:
    # At most 100 ticks to an array, since event ids are unique.
    batch = (
        t.ticks()
        .groupBy(F.floor(F.col("event_id") / 100).alias("chunk"))
        .agg(F.collect_list(F.struct("market_id", "rate", "ts")).alias("rows"))
        .select(*[F.col(f"rows.{c}").alias(c) for c in ("market_id", "rate", "ts")])
    )
    return as_ntz(registry.rows_of_arrays(batch, "market_id", "rate", "ts"), "ts")


@query
def active_exchanges(t: Tables) -> DataFrame:
    return matrix.active_exchanges(t.exchange_table())


@query
def active_markets(t: Tables) -> DataFrame:
    return matrix.active_markets(t.markets(), 3)


DOCUMENT = (
    f"token string, exchanges map<string, struct<market_symbol:string, {keys.RATE}:double, "
    f"open_interest:double, volume_24h:double, {keys.TIME}:string, stats_ts:string>>"
)


@query
def matrix_document(t: Tables) -> DataFrame:
    """The JSON documents, read back cell by cell."""
    documents = matrix.matrix_documents(t.cells())
    parsed = documents.select(F.from_json("document", DOCUMENT).alias("d"))
    return parsed.select(F.col("d.token").alias("token"), F.explode("d.exchanges").alias("exchange", "cell")).select(
        "token", "exchange", "cell.*"
    ).withColumnsRenamed({keys.RATE: "carry_rate", keys.TIME: "carry_ts"})


@query
def matrix_health(t: Tables) -> DataFrame:
    return as_ntz(matrix.matrix_health(t.cells()), "last_updated")


@query
def health_document(t: Tables) -> DataFrame:
    return matrix.health_document(t.cells())


# ---- scalar functions ------------------------------------------------------------


@query
def perp_filter(t: Tables) -> DataFrame:
    base = F.concat(t.token(), F.lit("-"), F.col("event_id").cast("string"))
    suffixes = ["-PERP", "-perps", "-Perp", "PERP", "-PERPX", "-PERP-C"]
    suffix = F.element_at(F.array(*[F.lit(s) for s in suffixes]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = t.events().select("event_id", F.concat(base, suffix).alias("symbol"))
    return rows.where(names.is_perpetual(F.col("symbol")))


def _prices() -> list[Column]:
    value = F.col("value").cast("decimal(18,2)")
    gap = lambda n, c: F.when(F.col("event_id") % n != 0, c)
    return [gap(2, value), gap(4, value + 1), gap(8, value + 2)]


@query
def price_fallback(t: Tables) -> DataFrame:
    price = numbers.first_price(*_prices()).cast("decimal(20,2)")
    return t.events().select("event_id", price.alias("price"))


@query
def oi_usd(t: Tables) -> DataFrame:
    base = F.when(F.col("event_id") % 5 != 0, (F.col("user_id") * 3 + 1).cast("decimal(18,0)"))
    usd = numbers.open_interest_usd(base, numbers.first_price(*_prices()))
    # Large supplies at tiny prices: a product that neither factor's places may be cut for.
    supply = F.concat(F.col("user_id") * 3 + 1, F.lpad(F.col("event_id").cast("string"), 13, "0"))
    tiny = (F.col("value").cast("decimal(18,2)") * 100).cast("bigint") * 7919 + F.col("event_id") % 1000
    small = numbers.open_interest_usd(supply, F.concat(F.lit("0."), F.lpad(tiny.cast("string"), 18, "0")))
    return t.events().select("event_id", usd.alias("open_interest"), small.alias("tiny_price"))


@query
def epoch_ms_to_second(t: Tables) -> DataFrame:
    ms = numbers.epoch_ms(F.unix_millis("ts").cast("string"))
    rows = t.events().select("event_id", timing.whole_second(timing.from_epoch_ms(ms)).alias("ts"))
    return as_ntz(rows, "ts")


@query
def exchange_lookup_ci(t: Tables) -> DataFrame:
    spelled = ["AFRICA", "america", "aSIA", "Europe", "middle EAST", "nowhere"]
    name = F.element_at(F.array(*[F.lit(s) for s in spelled]), (F.col("event_id") % 6 + 1).cast("int"))
    asked = t.events().select("event_id", name.alias("name"))
    return matrix.resolve_exchanges(asked, t.exchange_table()).select("event_id", "exchange_id", "exchange")


@query
def normalize_names(t: Tables) -> DataFrame:
    text = F.concat(F.col("s_name"), F.lit("-dEX x1."), F.col("s_suppkey").cast("string"), F.lit("ab"))
    return t.read("supplier").select("s_suppkey", names.display_name(text).alias("name"))


@query
def bucket_8h(t: Tables) -> DataFrame:
    rows = t.events().select("event_id", timing.bucket_start(F.col("ts")).alias("bucket_start"))
    return as_ntz(rows, "bucket_start")


@query
def cell_defaults(t: Tables) -> DataFrame:
    value = F.col("value").cast("decimal(18,2)").cast("string")
    kind = F.col("event_id") % 4
    parts = [
        F.when(kind == 0, F.concat(F.lit(f'"{keys.RATE_8H}":'), value))
        .when(kind == 1, F.concat(F.lit(f'"{keys.RATE_8H}":null,"{keys.RATE}":'), value))
        .when(kind == 2, F.concat(F.lit(f'"{keys.RATE}":'), value)),
        F.when(kind != 3, F.concat(F.lit('"open_interest":'), value)),
        F.when(kind == 0, F.lit('"volume_24h":null')),
        F.when(kind == 0, F.lit(f'"{keys.BUCKET}":"2024-01-01T00:00:00+00:00"')).when(
            kind == 1, F.lit(f'"{keys.TIME}":"2023-12-31T16:00:00+00:00"')
        ),
        F.when(kind == 2, F.lit('"stats_ts":"2024-01-02T00:00:00+00:00"')),
        F.when(kind != 1, F.concat(F.lit('"market_symbol":"M'), F.col("user_id").cast("string"), F.lit('"'))),
    ]
    text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return matrix.read_stored_cells(t.events().select("event_id", text.alias("cell")), "cell")


@query
def fmt_number(t: Tables) -> DataFrame:
    # Powers of ten up to 10^9, both signs.
    scaled = t.events().selectExpr(
        "event_id",
        "value * array(1D, 10D, 1e3D, 1e5D, 1e6D, 1e8D, 1e9D)[event_id % 7] * if(event_id % 11 = 0, -1D, 1D) AS v",
    )
    return scaled.selectExpr("event_id", f"{display.number_text('v')} AS text")


@query
def fmt_rate(t: Tables) -> DataFrame:
    rates = t.events().select("event_id", t.rate().cast("double").alias("rate"))
    return rates.selectExpr(
        "event_id",
        f"{display.rate_text('rate')} AS rate_text",
        f"{display.rate_text('rate', 'annualized')} AS apr_text",
        f"{display.rate_apr('rate')} AS rate_apr",
    )


@query
def fmt_spread(t: Tables) -> DataFrame:
    spreads = t.events().selectExpr("event_id", "CASE WHEN event_id % 9 <> 0 THEN value END AS spread")
    return spreads.selectExpr(
        "event_id",
        f"{display.spread_text('spread')} AS percent_text",
        f"{display.spread_text('spread', 'bps')} AS bps_text",
    )


RATES = ("long_rate", "short_rate", "spread")


@query
def arb_label(t: Tables) -> DataFrame:
    label = display.arb_label("long_exchange", "short_exchange", *RATES)
    return t.arbs().selectExpr("event_id", f"{label} AS label")


@query
def capture_info(t: Tables) -> DataFrame:
    return t.arbs().selectExpr("event_id", f"{display.capture_text(*RATES)} AS capture")


@query
def spread_class(t: Tables) -> DataFrame:
    return t.arbs().selectExpr("event_id", f"{classes.spread_class('spread')} AS class")


@query
def opportunity_class(t: Tables) -> DataFrame:
    return t.arbs().selectExpr("event_id", f"{classes.opportunity_class(*RATES)} AS class")


@query
def row_class(t: Tables) -> DataFrame:
    return t.arbs().selectExpr("event_id", f"{classes.row_class(*RATES)} AS class")


# ---- joins, aggregates, latest values ------------------------------------------------


@query
def market_dim(t: Tables) -> DataFrame:
    return matrix.market_dim(t.markets(), t.tokens(), t.exchanges())


@query
def stats_by_symbol(t: Tables) -> DataFrame:
    # Every ninth event asks for a symbol that no market has.
    symbol = F.when(F.col("event_id") % 9 == 0, F.lit("NONE-PERP")).otherwise(t.market_symbol())
    incoming = t.purchases().select(
        t.exchange_id().alias("exchange_id"),
        symbol.alias("market_symbol"),
        t.amount(100_000).alias("open_interest"),
        t.amount(1_000_000).alias("volume_24h"),
        timing.whole_second(F.col("ts")).alias("ts"),
    )
    rows = upserts.stats_by_symbol(incoming, t.markets())
    return as_ntz(rows.select("market_id", "open_interest", "volume_24h", "ts"), "ts")


@query
def carry_8h(t: Tables) -> DataFrame:
    return as_ntz(t.buckets(), "bucket_start")


@query
def latest_carry_8h(t: Tables) -> DataFrame:
    return as_ntz(facts.latest_carry_8h(t.buckets()), "bucket_start")


@query
def latest_market_stats(t: Tables) -> DataFrame:
    return as_ntz(facts.latest_market_stats(t.stats(), t.markets()), "ts")


@query
def carry_matrix(t: Tables) -> DataFrame:
    """The nested rows, opened again for comparison."""
    nested = matrix.carry_matrix(t.cells())
    rows = nested.select("symbol", "last_update", F.explode("per_exchange").alias("exchange", "cell"))
    return as_ntz(rows.select("symbol", "exchange", "cell.*", "last_update").withColumnsRenamed({keys.RATE_8H: "carry_rate_8h", keys.BUCKET: "carry_bucket"}), "carry_bucket", "stats_ts", "last_update")


@query
def token_last_update(t: Tables) -> DataFrame:
    return as_ntz(matrix.token_last_update(t.cells()), "last_update")


@query
def total_open_interest(t: Tables) -> DataFrame:
    return arbitrage.total_open_interest(t.served())


@query
def arb_spread(t: Tables) -> DataFrame:
    return arbitrage.arb_spread(t.served())


@query
def best_arb(t: Tables) -> DataFrame:
    return arbitrage.best_arb(t.served())


@query
def best_arb_known_rates(t: Tables) -> DataFrame:
    """Best pairs over the cells that have a rate."""
    return arbitrage.best_arb(matrix.served_cells(t.cells(), null_rate="drop"))


@query
def carry_hwm(t: Tables) -> DataFrame:
    rows = facts.active_market_marks(t.markets(), facts.carry_marks(t.carry()))
    return as_ntz(rows, "last_ts")


@query
def exchange_header(t: Tables) -> DataFrame:
    return matrix.exchange_header(t.markets(), t.exchanges())


@query
def matrix_wide(t: Tables) -> DataFrame:
    # The header has one name per exchange, of which the region table has five.
    header = [r.exchange for r in matrix.exchange_header(t.markets(), t.exchanges()).collect()]
    return matrix.matrix_wide(t.served(), header)


@query
def rate_class(t: Tables) -> DataFrame:
    return arbitrage.rate_classes(t.served())


def flat_board(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        *[c for c in rows.columns if c not in ("pair", "cells", "last_update")],
        "pair.long_exchange",
        "pair.short_exchange",
        "pair.long_rate",
        "pair.short_rate",
        "pair.spread AS pair_spread",
        "pair.combined_oi",
        "bigint(size(cells)) AS cells",
        "array_join(cells.rate_class, ',') AS rate_classes",
        "array_join(cells.rate_text, ',') AS rate_texts",
        "array_join(cells.oi_text, ',') AS oi_texts",
        "cast(last_update AS timestamp_ntz) AS last_update",
    )


@query
def carry_board(t: Tables) -> DataFrame:
    return flat_board(board.carry_board(t.served()))


@query
def carry_board_annualized(t: Tables) -> DataFrame:
    rows = board.carry_board(t.served(), display_mode="annualized", spread_unit="bps")
    return rows.selectExpr("token", "spread_text", "array_join(cells.rate_text, ',') AS rate_texts")


@query
def board_sorted(t: Tables) -> DataFrame:
    rows = board.sort_board(board.carry_board(t.served()), "arbCombo")
    return rows.select("token", "total_oi", "spread", F.col("pair.spread").alias("pair_spread"))


# ---- table maintenance ------------------------------------------------------------------


@query
def upsert_exchanges(t: Tables) -> DataFrame:
    asked = (
        t.read("region").select(F.upper("r_name").alias("name")).where("r_regionkey % 2 = 1")
        .unionByName(t.read("nation").select(F.concat(F.lower("n_name"), F.lit("-dex")).alias("name")))
    )
    existing = t.exchange_table()
    rows = upserts.upsert_exchanges(existing, asked, now())
    known = existing.select("name", F.col("id").alias("known_id"))
    return as_ntz(
        rows.join(known, "name", "left").select(
            "name", "known_id", "carry_interval_minutes", "is_active", "created_at", "updated_at"
        ),
        "created_at", "updated_at",
    )


def stored_tokens(t: Tables) -> DataFrame:
    """The tokens taken as known already; the upsert itself sees all of them."""
    return t.tokens().where("id % 3 <> 0").select("id", "symbol", ts_literal("2024-01-01 00:00:00").alias("created_at"))


@query
def upsert_tokens(t: Tables) -> DataFrame:
    symbols = t.events().select(t.token().alias("symbol"))
    rows = upserts.upsert_tokens(stored_tokens(t), symbols, now())
    known = stored_tokens(t).select("symbol", F.col("id").alias("known_id"))
    return as_ntz(rows.join(known, "symbol", "left").select("symbol", "known_id", "created_at"), "created_at")


@query
def upsert_tokens_ids(t: Tables) -> DataFrame:
    """New ids follow the highest given one without gaps or repeats."""
    symbols = t.events().select(t.token().alias("symbol"))
    rows = upserts.upsert_tokens(stored_tokens(t), symbols, now())
    return rows.agg(
        F.count(F.lit(1)).alias("tokens"), F.count_distinct("id").alias("ids"), F.max("id").alias("last_id")
    )


@query
def upsert_markets(t: Tables) -> DataFrame:
    """Every market is known, new, or both known and in the batch, by its id."""
    existing = t.market_table().where("id % 4 <> 0")
    symbol = F.when(F.col("id") % 7 == 0, F.lit("TKN0")).otherwise(F.concat(F.lit("TKN"), F.col("token_id").cast("string")))
    incoming = t.markets().where("id % 5 <> 0 OR id % 4 = 0").select(
        "exchange_id",
        symbol.alias("symbol"),
        "market_symbol",
        F.when(F.col("id") % 3 == 0, ~F.col("is_active")).otherwise(F.col("is_active")).alias("is_active"),
    )
    rows = upserts.upsert_markets(existing, incoming, t.tokens(), now())
    return as_ntz(
        rows.select("exchange_id", "token_id", "market_symbol", "is_active", "created_at", "updated_at"),
        "created_at", "updated_at",
    )


def _appended(first: DataFrame, second: DataFrame, add: Callable) -> DataFrame:
    """Append two batches to an empty table, the second batch containing itself twice."""
    nothing = first.sparkSession.createDataFrame([], first.schema)
    stored = add(first, nothing, ["event_id"])
    twice = second.withColumn("copy", F.lit(0)).unionByName(second.withColumn("copy", F.lit(1)))
    return stored.unionByName(add(twice, stored, ["event_id", "copy"]))


def _before(rows: DataFrame, day: str) -> DataFrame:
    return rows.where(F.col("ts") < ts_literal(day))


def _from(rows: DataFrame, day: str) -> DataFrame:
    return rows.where(F.col("ts") >= ts_literal(day))


@query
def append_carry(t: Tables) -> DataFrame:
    ticks = t.ticks().select("event_id", "exchange_id", "market_id", "rate", "ts")
    rows = _appended(_before(ticks, "2024-01-20"), _from(ticks, "2024-01-15"), upserts.new_carry)
    return as_ntz(rows, "ts")


@query
def append_stats(t: Tables) -> DataFrame:
    stats = t.purchases().select(
        "event_id",
        F.col("user_id").alias("market_id"),
        t.amount(100_000).alias("open_interest"),
        t.amount(1_000_000).alias("volume_24h"),
        "ts",
    )
    rows = _appended(_before(stats, "2024-01-20"), _from(stats, "2024-01-15"), upserts.new_stats)
    return as_ntz(rows, "ts")


@query
def set_interval(t: Tables) -> DataFrame:
    return as_ntz(upserts.set_interval(t.exchange_table(), now()), "created_at", "updated_at")


def _small_tables(t: Tables) -> dict[str, DataFrame]:
    return {
        "exchanges": t.exchange_table(),
        "tokens": t.tokens(),
        "markets": t.market_table(),
        "carry_rates": t.carry(),
        "market_stats": t.stats(),
    }


@query
def cascade_delete(t: Tables) -> DataFrame:
    left = upserts.without_exchange(_small_tables(t), "EUROPE")
    parts = [
        left[name].agg(F.count(F.lit(1)).alias("row_count"), F.sum(key).cast("bigint").alias("key_sum")).select(
            F.lit(name).alias("table_name"), "row_count", "key_sum"
        )
        for name, key in (
            ("exchanges", "id"), ("tokens", "id"), ("markets", "id"),
            ("carry_rates", "market_id"), ("market_stats", "market_id"),
        )
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def constraint_report(t: Tables) -> DataFrame:
    """The report on the whole tables, with orphans, repeated keys and nulls added."""
    tables = _small_tables(t)
    orphan = t.carry().where("market_id % 97 = 5").withColumn("market_id", F.col("market_id") + 1_000_000_000)
    tables["carry_rates"] = tables["carry_rates"].unionByName(orphan)
    stats = tables["market_stats"]
    tables["market_stats"] = stats.unionByName(stats.where("market_id % 10 = 1"))
    tables["markets"] = tables["markets"].withColumn(
        "market_symbol", F.when(F.col("id") % 13 != 4, F.col("market_symbol"))
    )
    return upserts.constraint_report(tables)


# ---- incremental reads ----------------------------------------------------------------------

READ_AT_MS = 1706486400000  # 2024-01-29 00:00:00 UTC


def _stored_marks(t: Tables) -> DataFrame:
    stored = _before(t.carry(), "2024-01-20")
    return facts.active_market_marks(t.markets(), facts.carry_marks(stored))


@query
def resolve_windows(t: Tables) -> DataFrame:
    specs = {
        "between": windows.Between(1705000000000, 1706000000000),
        "lookback": windows.LookbackHours(48),
        "since_last": windows.SinceLastOrLookbackHours(24),
        "saturating": windows.LookbackHours(10**6),
    }
    marks = _stored_marks(t)
    parts = [
        windows.resolve_windows(marks, spec, READ_AT_MS).select(
            F.lit(name).alias("spec"), "market_id", "start_ms", "end_ms"
        )
        for name, spec in specs.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def incremental_extract(t: Tables) -> DataFrame:
    spans = windows.resolve_windows(_stored_marks(t), windows.SinceLastOrLookbackHours(24), READ_AT_MS)
    ticks = t.ticks().select("exchange_id", "market_symbol", "rate", "ts")
    rows = windows.ticks_in_windows(ticks, spans)
    return as_ntz(rows.select("exchange_id", "market_id", "rate", "ts"), "ts")


# ---- streams ------------------------------------------------------------------------------------


def _finish(stream) -> None:
    stream.awaitTermination()


def _streamed_buckets(t: Tables) -> DataFrame:
    return rolling.carry_8h_stream(StreamTables(t.spark, t.folder).carry())


@query
def stream_carry_8h(t: Tables) -> DataFrame:
    path = shared_folder(t.spark, "buckets")
    _finish(rolling.write_updates(_streamed_buckets(t), path))
    return as_ntz(rolling.read_buckets(t.spark, path), "bucket_start")


@query
def stream_latest_stats(t: Tables) -> DataFrame:
    wh = Warehouse(t.spark, shared_folder(t.spark, "tables"))
    _finish(rolling.latest_stats_stream(wh, StreamTables(t.spark, t.folder).stats()))
    return as_ntz(wh.dimension("latest_stats"), "ts")


@query
def stream_latest_carry(t: Tables) -> DataFrame:
    wh = Warehouse(t.spark, shared_folder(t.spark, "tables"))
    _finish(rolling.latest_carry_stream(wh, _streamed_buckets(t)))
    return as_ntz(wh.dimension("latest_carry"), "bucket_start")


# ---- jobs: landed responses of two exchanges, tables, board ------------------------------------------

JOB_NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
ALL_TIME = windows.Between(0, 1706745600000)


def _responses(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Markets (with user_id), ticks and stats of all events as responses; users alternate between the exchanges, two to a token."""
    even = F.col("user_id") % 2 == 0
    token = F.concat(F.lit("TKN"), F.floor(F.col("user_id") / 2.0).cast("string"))
    symbol = F.concat(token, F.lit("-USD-PERP"))
    exchange = F.when(even, "paradex").otherwise("extended")
    active = F.col("user_id") % 20 != 7

    listing_a = F.struct(symbol.alias("symbol"), token.alias("base_currency"), F.lit("USD").alias("quote_currency"))
    listing_b = F.struct(symbol.alias("name"), token.alias("assetName"), active.alias("active"))
    listing = F.when(even, _json(F.array(listing_a).alias("results"))).otherwise(_json(F.array(listing_b).alias("data")))
    users = t.read("events").select("user_id").distinct()
    markets = users.select("user_id", *_response(exchange, "markets", listing))

    events = t.events().withColumn("market_symbol", symbol).withColumn("rate", t.rate())
    ticks = events.where("event_type <> 'purchase'").select(
        *_response(exchange, "carry", F.when(even, results_ticks()).otherwise(data_ticks()),
                   received=F.col("ts") + F.expr("INTERVAL 1 MINUTE"))
    )
    value = F.col("value").cast("decimal(18,2)").cast("string")
    summary = F.struct(symbol.alias("symbol"), value.alias("open_interest"), F.lit("2").alias("mark_price"), value.alias("volume_24h"))
    snapshot = F.struct(value.alias("openInterest"), value.alias("dailyVolume"))
    payload = F.when(even, _json(F.array(summary).alias("results"))).otherwise(_json(snapshot.alias("data")))
    stats = events.where("event_type = 'purchase'").select(
        "user_id", *_response(exchange, "stats", payload, market=symbol, received=F.col("ts"))
    )
    return markets, ticks, stats


def _land(t: Tables) -> str:
    path = shared_folder(t.spark, "landing")
    for part in _responses(t):
        write_landing(part, path)
    return path


def _land_all_but(t: Tables, late: str) -> tuple[str, DataFrame]:
    """Responses without the late markets, which are given too. Some stats were asked for one market and tell of another."""
    markets, ticks, stats = _responses(t)
    other = (F.col("user_id") % 2 == 0) & (F.col("user_id") % 7 == 2)
    asked = stats.withColumn("market", F.when(other, F.concat("market", F.lit("-X"))).otherwise(F.col("market")))
    path = shared_folder(t.spark, "landing")
    for part in (ticks, asked, markets.where(f"NOT ({late})")):
        write_landing(part, path)
    return path, markets.where(late)


def _stored_facts(wh: Warehouse) -> DataFrame:
    """Per market: what is stored, and what waits."""
    ticks = wh.fact("carry_rates").groupBy("market_id").agg(
        F.count(F.lit(1)).alias("ticks"), F.min("ts").alias("first_tick"), F.max("ts").alias("last_tick")
    )
    stats = wh.fact("market_stats").groupBy("market_id").agg(F.count(F.lit(1)).alias("stats"), F.max("ts").alias("last_stats"))
    key = ["exchange_key", "market_symbol"]
    waits = [
        wh.waiting(kind).groupBy(F.col("exchange").alias("exchange_key"), "market_symbol").agg(F.count(F.lit(1)).alias(name))
        for kind, name in (("carry", "waiting_ticks"), ("stats", "waiting_stats"))
    ]
    owner = wh.dimension("exchanges").select(F.col("id").alias("exchange_id"), F.col("name").alias("exchange"), names.lookup_key(F.col("name")).alias("exchange_key"))
    rows = wh.dimension("markets").withColumnRenamed("id", "market_id").join(owner, "exchange_id")
    rows = rows.join(ticks, "market_id", "left").join(stats, "market_id", "left").join(waits[0], key, "left").join(waits[1], key, "left")
    rows = rows.na.fill(0, ["ticks", "stats", "waiting_ticks", "waiting_stats"])
    return as_ntz(rows, "first_tick", "last_tick", "last_stats").select(
        "exchange", "market_symbol", "ticks", "first_tick", "last_tick", "stats", "last_stats", "waiting_ticks", "waiting_stats"
    )


def _new_tables(t: Tables) -> Warehouse:
    wh = Warehouse(t.spark, shared_folder(t.spark, "tables"))
    for name in ("paradex", "extended"):
        jobs.ensure_exchange(wh, name, JOB_NOW)
    return wh


def _job_board(wh: Warehouse) -> DataFrame:
    return jobs.board_report(wh).selectExpr(
        "token", "total_oi", "spread", "pair.long_exchange", "pair.short_exchange",
        "pair.long_rate", "pair.short_rate", "pair.combined_oi",
    )


@query
def job_init(t: Tables) -> DataFrame:
    """Landing zone to board through `run_init`."""
    wh = _new_tables(t)
    jobs.run_init(wh, _land(t), JOB_NOW, ALL_TIME)
    return _job_board(wh)


@query
def stream_ingest(t: Tables) -> DataFrame:
    """The same through the three ingest streams, one after the other."""
    wh, landing = _new_tables(t), _land(t)
    _finish(ingest.markets(wh, landing, lambda: JOB_NOW))
    _finish(ingest.carry(wh, landing))
    _finish(ingest.stats(wh, landing))
    return _job_board(wh)


@query
def job_late_markets(t: Tables) -> DataFrame:
    """Ticks and stats that land before their market wait for it, and are stored with the run that finds it."""
    wh = _new_tables(t)
    path, late = _land_all_but(t, "user_id % 3 = 0")
    jobs.sync_new(wh, path, JOB_NOW)
    write_landing(late, path)
    jobs.sync_new(wh, path, JOB_NOW)
    return _stored_facts(wh)


@query
def job_add_exchange(t: Tables) -> DataFrame:
    """One exchange, added and synced; stats count for its inactive markets too."""
    wh = Warehouse(t.spark, shared_folder(t.spark, "tables"))
    jobs.add_exchange(wh, _land(t), JOB_NOW, "EXTENDED")
    return _stored_facts(wh)


@query
def job_backfill(t: Tables) -> DataFrame:
    """One exchange by a time window, from responses landed at any time."""
    wh = _new_tables(t)
    path, _ = _land_all_but(t, "FALSE")
    jobs.backfill(wh, path, JOB_NOW, "paradex", windows.Between(1705000000000, 1706000000000))
    return _stored_facts(wh)


@query
def stream_carry_8h_table(t: Tables) -> DataFrame:
    """Means of all ticks of a stream, however late, from the stored ones."""
    wh = Warehouse(t.spark, shared_folder(t.spark, "tables"))
    _finish(rolling.carry_8h_table(wh, StreamTables(t.spark, t.folder).carry()))
    return as_ntz(wh.fact("carry_8h"), "bucket_start")
