"""Upserts and appends as pure functions of DataFrames.

Nothing here writes; `carrygrid.sources.warehouse` stores the results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from carrygrid.functions.constants import CARRY_INTERVAL_MINUTES
from carrygrid.functions.names import display_name
from carrygrid.functions.timing import whole_second

ID_BUCKETS = 512


_HASH, _SECOND = 1 << 32, 1 << 31


def _packed(order: list[Column], rest: list[str]) -> Column:
    """The order (a long or time, then at most an int) and a hash of the rest, as one number that an aggregate updates in place."""
    first, *more = order
    second = more[0] if more else F.lit(0)
    # The int is shifted to be positive, so that it never reaches into the place above.
    low = F.pmod(F.xxhash64(*rest), F.lit(_HASH)).cast("decimal(10,0)")
    middle = (second.cast("bigint") + _SECOND).cast("decimal(10,0)") * F.lit(_HASH).cast("decimal(10,0)")
    return first.cast("decimal(19,0)") * F.lit(str(2 * _SECOND * _HASH)).cast("decimal(20,0)") + middle + low


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of every key in the given order: a long or a time, then an int.

    Hash aggregates with a map-side half, so many copies of one key
    shrink to one per task before the shuffle, and fixed-width columns are neither sorted nor
    copied. A hash of the other columns breaks ties, which makes the choice reproducible.
    """
    kinds = dict(rows.dtypes)
    order = [F.unix_micros(c) if isinstance(c, str) and kinds[c] == "timestamp" else F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.withColumn("_order", _packed(order, rest))
        .groupBy(*keys)
        .agg(*[F.min_by(c, "_order").alias(c) for c in rest])
        .select(*keys, *rest)
    )


def with_new_ids(new_rows: DataFrame, existing: DataFrame, key: str, buckets: int = ID_BUCKETS) -> DataFrame:
    """Number rows with a unique key from max(existing id) + 1, without gaps.

    Rows are numbered inside hash buckets of the key, and every bucket starts
    where the one before it ends. The running sum covers at most ``buckets`` + 1
    rows, so it is cheap in one task and its result is small enough to
    broadcast by construction. Bucket -1 stands for the ids already given.
    """
    bucketed = new_rows.withColumn("_bucket", F.pmod(F.hash(key), F.lit(buckets)))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"))
    given = existing.agg(F.lit(-1).alias("_bucket"), F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.unionByName(given).select("_bucket", F.sum("n").over(before).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy(key)
    return (
        bucketed.withColumn("_n", F.row_number().over(within))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("id", F.col("_offset") + F.col("_n"))
        .drop("_bucket", "_n", "_offset")
    )


def upsert_exchanges(existing: DataFrame, names: DataFrame, now: Column, touch_active: bool = False) -> DataFrame:
    """Make sure an active exchange of every name exists.

    An active one of that name (any letter case) stays as it is, an inactive one
    is switched on and touched, an unknown one is added with its name
    normalised. ``touch_active`` also touches active ones.
    """
    wanted = names.select(display_name(F.col("name")).alias("name")).distinct()
    hit = wanted.withColumn("_hit", F.lit(True))
    current = existing.join(hit, "name", "left")
    touched = F.col("_hit") if touch_active else F.col("_hit") & ~F.col("is_active")
    kept = current.select(
        "id",
        "name",
        "carry_interval_minutes",
        F.coalesce(F.col("_hit"), F.col("is_active")).alias("is_active"),
        "created_at",
        F.when(touched, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    new = wanted.join(existing.select("name"), "name", "left_anti")
    added = with_new_ids(new, existing, "name").select(
        "id",
        "name",
        F.lit(None).cast("int").alias("carry_interval_minutes"),
        F.lit(True).alias("is_active"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    return kept.unionByName(added)


def upsert_tokens(existing: DataFrame, symbols: DataFrame, now: Column) -> DataFrame:
    """Known tokens unchanged, unknown symbols added with fresh ids."""
    new = symbols.select("symbol").distinct().join(existing.select("symbol"), "symbol", "left_anti")
    added = with_new_ids(new, existing, "symbol").select("id", "symbol", now.alias("created_at"))
    return existing.select("id", "symbol", "created_at").unionByName(added)


def upsert_markets(existing: DataFrame, incoming: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    """Add unknown (exchange_id, market_symbol) pairs, update the activity of known ones.

    A known market keeps its token and creation time, a market that the batch
    does not mention stays untouched. ``incoming`` has exchange_id, symbol,
    market_symbol, is_active and one row per key (`first_per_key`).
    """
    key = ["exchange_id", "market_symbol"]
    change = incoming.select(*key, F.col("is_active").alias("_active"))
    kept = existing.join(change, key, "left").select(
        "id",
        "exchange_id",
        "token_id",
        "market_symbol",
        F.coalesce("_active", "is_active").alias("is_active"),
        "created_at",
        F.when(F.col("_active").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    token_ids = tokens.select(F.col("id").alias("token_id"), "symbol")
    new = incoming.join(existing.select(*key), key, "left_anti").join(token_ids, "symbol")
    keyed = new.withColumn("_key", F.struct(*key))
    added = with_new_ids(keyed, existing, "_key").select(
        "id",
        "exchange_id",
        "token_id",
        "market_symbol",
        "is_active",
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    return kept.unionByName(added)


def set_interval(exchanges: DataFrame, now: Column, ids: DataFrame | None = None,
                 minutes: int = CARRY_INTERVAL_MINUTES) -> DataFrame:
    """Set the carry interval where it is null or different; touch only those rows."""
    wrong = ~F.col("carry_interval_minutes").eqNullSafe(F.lit(minutes))
    rows = exchanges
    if ids is not None:
        rows = rows.join(ids.select("id").distinct().withColumn("_chosen", F.lit(True)), "id", "left")
        wrong = wrong & F.coalesce("_chosen", F.lit(False))
    return rows.select(
        "id",
        "name",
        F.when(wrong, F.lit(minutes)).otherwise(F.col("carry_interval_minutes")).cast("int").alias("carry_interval_minutes"),
        "is_active",
        "created_at",
        F.when(wrong, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def stats_by_symbol(stats: DataFrame, markets: DataFrame) -> DataFrame:
    """Stats with (exchange_id, market_symbol) resolved to market ids.

    Inactive markets count too; rows of unknown symbols fall away.
    """
    ids = markets.select(F.col("id").alias("market_id"), "exchange_id", "market_symbol")
    return stats.join(ids, ["exchange_id", "market_symbol"])


def second_sets(facts: DataFrame) -> DataFrame:
    """(market_id, word, bits): which of the 64 seconds of each word have a row.

    One fixed-width number per market and 64 seconds, built where the rows lie: of a stored
    table this is all that is shuffled, at most a row per tick and mostly far fewer.
    """
    second = F.unix_seconds("ts")
    return facts.groupBy("market_id", F.floor(second / 64).alias("word")).agg(F.bit_or(_bit(second)).alias("bits"))


def _bit(second: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(second, F.lit(64)).cast("int"))


def new_facts(batch: DataFrame, existing: DataFrame, order: list[Column | str], columns: list[str]) -> DataFrame:
    """Rows of the batch to append: whole seconds, first of every key, unknown so far.

    The batch holds a (market, second) once, so a hot market spreads over its seconds; it is
    held against the sets of seconds that the stored rows have.
    """
    key = ["market_id", "ts"]
    kept = [c for c in columns if c not in key] + [c for c in order if isinstance(c, str) and c not in (*key, *columns)]
    named = batch.select("market_id", whole_second(F.col("ts")).alias("ts"), *kept)
    first = first_per_key(named, key, order)
    second = F.unix_seconds("ts")
    known = second_sets(existing)
    marked = first.withColumn("word", F.floor(second / 64)).join(known, ["market_id", "word"], "left")
    return marked.where(F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(_bit(second)) == 0).select(*columns)


def new_carry(batch: DataFrame, existing: DataFrame, order: list[Column | str]) -> DataFrame:
    return new_facts(batch, existing, order, ["exchange_id", "market_id", "rate", "ts"])


def new_stats(batch: DataFrame, existing: DataFrame, order: list[Column | str]) -> DataFrame:
    return new_facts(batch, existing, order, ["market_id", "open_interest", "volume_24h", "ts"])


def without_exchange(tables: dict[str, DataFrame], name: str) -> dict[str, DataFrame]:
    """The tables after deleting an exchange and all that refers to it.

    The side of the deleted markets holds each id once; the fact side of the
    anti join may be split by AQE where a market is hot.
    """
    exchanges, markets = tables["exchanges"], tables["markets"]
    gone = exchanges.where(F.lower("name") == F.lower(F.lit(name))).select(F.col("id").alias("exchange_id"))
    gone_markets = markets.join(gone, "exchange_id", "left_semi").select(F.col("id").alias("market_id"))
    out = dict(tables)
    out["exchanges"] = exchanges.where(F.lower("name") != F.lower(F.lit(name)))
    out["markets"] = markets.join(gone, "exchange_id", "left_anti")
    for fact in tables:
        if fact not in ("exchanges", "markets", "tokens"):
            out[fact] = tables[fact].join(gone_markets, "market_id", "left_anti")
    return out


def constraint_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations per declared constraint: (constraint, violations).

    A table is read twice: grouped by its keys for uniqueness, and grouped by the
    ids it refers to for nulls and references. The second grouping leaves a row
    per combination of ids, so a hot id is one row when the parents are joined.
    """

    def unique(table: str, *keys: str) -> DataFrame:
        repeated = tables[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return repeated.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(f"{table}: unique {', '.join(keys)}").alias("constraint"), "violations"
        )

    def columns(table: str, required: list[str], refers: dict[str, str]) -> DataFrame:
        missing = " OR ".join(f"{c} IS NULL" for c in required)
        groups = tables[table].groupBy(*refers).agg(
            F.count(F.lit(1)).alias("n"), F.expr(f"count_if({missing})").alias("missing")
        )
        checks = {f"{table}: not null {', '.join(required)}": "sum(missing)"}
        for column, parent in refers.items():
            found = tables[parent].select(F.col("id").alias(column)).distinct().withColumn(f"has_{column}", F.lit(True))
            groups = groups.join(found, column, "left")
            orphan = f"{column} IS NOT NULL AND has_{column} IS NULL"
            checks[f"{table}: {column} in {parent}"] = f"sum(CASE WHEN {orphan} THEN n END)"
        totals = groups.agg(*[F.expr(f"coalesce({e}, 0)").alias(f"c{i}") for i, e in enumerate(checks.values())])
        pairs = ", ".join(f"'{name}', c{i}" for i, name in enumerate(checks))
        return totals.selectExpr(f"stack({len(checks)}, {pairs}) AS (constraint, violations)")

    checks = [
        unique("exchanges", "id"),
        unique("exchanges", "name"),
        unique("tokens", "id"),
        unique("tokens", "symbol"),
        unique("markets", "id"),
        unique("markets", "exchange_id", "market_symbol"),
        unique("carry_rates", "market_id", "ts"),
        unique("market_stats", "market_id", "ts"),
        columns("exchanges", ["id", "name", "is_active"], {}),
        columns("tokens", ["id", "symbol"], {}),
        columns(
            "markets",
            ["id", "exchange_id", "token_id", "market_symbol", "is_active"],
            {"exchange_id": "exchanges", "token_id": "tokens"},
        ),
        columns(
            "carry_rates",
            ["exchange_id", "market_id", "rate", "ts"],
            {"exchange_id": "exchanges", "market_id": "markets"},
        ),
        columns("market_stats", ["market_id", "ts"], {"market_id": "markets"}),
    ]
    return reduce(DataFrame.unionByName, checks)
