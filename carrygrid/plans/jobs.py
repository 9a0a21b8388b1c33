"""The sync jobs: landed responses in, tables and board out.

Without time windows a job takes the responses that it has not taken before (see
`sources.intake`). With windows it reads the landed days that they touch, whether taken before or
not; markets and stats then read the landing zone from ``landed_from`` on. Either way records of markets that are
not active yet wait and are stored once they are. Running a
job again changes nothing but what an interrupted run left undone. Loops on the
driver run over the exchanges that have a normaliser, or over days and markets, never over rows.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from carrygrid.functions.names import lookup_key
from carrygrid.functions.timing import utc_day
from carrygrid.operators import board, facts, matrix, upserts, windows
from carrygrid.operators.windows import Between, SinceLastOrLookbackHours, WindowSpec
from carrygrid.sources import registry
from carrygrid.sources.intake import consume
from carrygrid.sources.landing import read_landing
from carrygrid.sources.records import accept, is_failfast, rejected
from carrygrid.sources.warehouse import WAITING, Warehouse

Days = frozenset[dt.date]
DAY_MS = 24 * windows.HOUR_MS


@dataclass(frozen=True)
class Outcome:
    exchange: str
    rows: int
    error: str | None = None
    rejected: int = 0


def _utc_day(ms: int) -> dt.date:
    day = dt.datetime.fromtimestamp(min(ms, windows.LAST_DAY_MS) / 1000, dt.timezone.utc)
    return day.date()


def _now(at: dt.datetime):
    return F.lit(at.astimezone(dt.timezone.utc).isoformat()).cast("timestamp")


def _ms(at: dt.datetime) -> int:
    return int(at.timestamp() * 1000)


# ---- which exchanges ---------------------------------------------------------------


def supported_exchanges(wh: Warehouse) -> list:
    """Active exchanges with a normaliser, by name; at most one row per normaliser."""
    known = lookup_key(F.col("name")).isin(*registry.NORMALISERS)
    return matrix.active_exchanges(wh.dimension("exchanges")).where(known).collect()


def require_exchange(wh: Warehouse, name: str):
    row = matrix.find_exchange(wh.dimension("exchanges"), name).first()
    if row is None:
        raise ValueError(f"exchange not found or inactive: {name}")
    return row


def ensure_exchange(wh: Warehouse, name: str, now: dt.datetime):
    """The active exchange of that name, added or switched on if need be."""
    exchanges = wh.dimension("exchanges")
    row = matrix.find_exchange(exchanges, name).first()
    if row is None:
        asked = wh.spark.createDataFrame([(name,)], "name string")
        wh.replace_dimension("exchanges", upserts.upsert_exchanges(exchanges, asked, _now(now)))
        row = require_exchange(wh, name)
    return row


def _with_exchange_id(records: DataFrame, targets: list) -> DataFrame:
    """Tag records of the target exchanges with their id, drop all others."""
    ids = F.create_map(*[F.lit(x) for t in targets for x in (t.name.strip().lower(), t.id)])
    return records.withColumn("exchange_id", F.try_element_at(ids, F.col("exchange"))).where("exchange_id IS NOT NULL")


# ---- applying records --------------------------------------------------------------


def apply_markets(wh: Warehouse, records: DataFrame, targets: list, now: dt.datetime) -> list[Outcome]:
    """Upsert normalised markets; of several answers the newest counts."""
    if not targets:
        return []
    records = _with_exchange_id(records, targets)
    newest_first = [-F.unix_micros("received_at"), F.col("pos")]
    incoming = upserts.first_per_key(
        records.select("exchange_id", "market_symbol", "symbol", "is_active", "received_at", "pos"),
        ["exchange_id", "market_symbol"],
        newest_first,
    ).persist()
    try:
        counts = {r.exchange_id: r["count"] for r in incoming.groupBy("exchange_id").count().collect()}
        if counts:
            tokens = upserts.upsert_tokens(wh.dimension("tokens"), incoming, _now(now))
            tokens = wh.replace_dimension("tokens", tokens)
            markets = upserts.upsert_markets(wh.dimension("markets"), incoming, tokens, _now(now))
            wh.replace_dimension("markets", markets)
    finally:
        incoming.unpersist()
    return [Outcome(t.name, counts.get(t.id, 0)) for t in targets]


def _observed(seen: Observation) -> dict:
    """Metrics of a finished write, for information; AQE drops an empty plan together with its metrics."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def _append(wh: Warehouse, table: str, rows: DataFrame) -> int:
    """Append and report the number of rows."""
    seen = Observation()
    wh.append_fact(table, rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return _observed(seen).get("n", 0)


def days_of(rows: DataFrame, column: str = "ts") -> Days:
    """The days that rows fall on: as many as there are, however far apart."""
    return frozenset(r[0] for r in rows.select(utc_day(F.col(column)).alias("day")).distinct().collect() if r[0] is not None)


def append_carry(wh: Warehouse, batch: DataFrame) -> tuple[int, Days]:
    """Append the ticks not stored yet; also gives the days of the batch, stored before or not.

    The batch is kept for two passes: its days first, so that only those are
    read from the stored ticks, however far apart they are.
    """
    batch = batch.persist()
    try:
        days = days_of(batch)
        if not days:
            return 0, days
        existing = wh.fact("carry_rates", days=days)
        return _append(wh, "carry_rates", upserts.new_carry(batch, existing, ["received_at", "pos"])), days
    finally:
        batch.unpersist()


def refresh_derived(wh: Warehouse, days: Days) -> None:
    """Bring buckets, newest buckets and marks up to date with the days of a batch.

    A bucket never crosses a UTC day, so a day's buckets follow from that day
    alone and late ticks are repaired by refreshing their day. Callers give the
    days of the whole batch, not of the rows that were new: a run that died
    between append and refresh is healed by running it again.
    """
    if not days:
        return
    written = wh.fact("carry_rates", days=days)
    wh.replace_days("carry_8h", facts.carry_8h(written))
    fresh = facts.latest_carry_8h(wh.fact("carry_8h", days=days))
    wh.replace_dimension("latest_carry", facts.newest_carry(wh.dimension("latest_carry"), fresh))
    marks = wh.dimension("carry_marks").unionByName(facts.carry_marks(written))
    wh.replace_dimension("carry_marks", marks.groupBy("market_id").agg(F.max("last_ts").alias("last_ts")))


def refresh_latest_stats(wh: Warehouse, days: Days) -> None:
    rows = wh.dimension("latest_stats").unionByName(wh.fact("market_stats", days=days))
    wh.replace_dimension("latest_stats", facts.latest_stats(rows))


def rebuild_derived(wh: Warehouse) -> None:
    """Recompute everything that is derived from the facts."""
    wh.replace_fact("carry_8h", facts.carry_8h(wh.fact("carry_rates")))
    wh.replace_dimension("latest_carry", facts.latest_carry_8h(wh.fact("carry_8h")))
    wh.replace_dimension("carry_marks", facts.carry_marks(wh.fact("carry_rates")))
    wh.replace_dimension("latest_stats", facts.latest_stats(wh.fact("market_stats")))


def _active(wh: Warehouse) -> DataFrame:
    return wh.dimension("markets").where("is_active").select("exchange_id", "market_symbol", F.col("id").alias("market_id"))


def apply_carry(wh: Warehouse, records: DataFrame, targets: list) -> tuple[int, Days]:
    """Append all normalised ticks of active markets (no window), then refresh."""
    batch = _with_exchange_id(records, targets).join(_active(wh), ["exchange_id", "market_symbol"])
    done, days = append_carry(wh, batch)
    refresh_derived(wh, days)
    return done, days


def _names(wh: Warehouse, targets: list) -> DataFrame:
    return wh.spark.createDataFrame([(lookup(t.name), t.id) for t in targets], "exchange string, exchange_id long")


def _unmatched(wh: Warehouse, records: DataFrame, targets: list, markets: DataFrame) -> DataFrame:
    """Records whose market is none of ``markets``."""
    known = markets.select("exchange_id", "market_symbol")
    return records.join(_names(wh, targets).join(known, "exchange_id"), ["exchange", "market_symbol"], "left_anti")


def _asked(records: DataFrame) -> DataFrame:
    """Stats without those of another market than the one asked for."""
    return records.where(F.coalesce(F.col("asked_market") == F.col("market_symbol"), F.lit(True)))


def release(wh: Warehouse, kind: str, targets: list) -> int:
    """Store what waits for markets that are active by now; only the parts that it lies in are opened.

    Records go only after they are stored, so a crash in between loses none, and the
    unique key absorbs the repetition.
    """
    if not targets or not wh.waiting_folders(kind):
        return 0
    listed = wh.dimension(f"waiting_{kind}")
    named = listed.join(_names(wh, targets), "exchange").join(_active(wh), ["exchange_id", "market_symbol"], "left_semi")
    ready = named.select("exchange", "market_symbol").persist()
    try:
        parts = [tuple(r) for r in ready.select("exchange", wh.part_of()).distinct().collect()]
        if not parts:
            return 0
        records = wh.waiting(kind, parts).join(ready, ["exchange", "market_symbol"], "left_semi")
        if kind == "carry":
            done, _ = apply_carry(wh, records, targets)
        else:
            done = sum(o.rows for o in apply_stats(wh, records, days_of(records, "received_at"), targets))
        wh.forget(kind, ready, parts)
        return done
    finally:
        ready.unpersist()


def ingest_carry(wh: Warehouse, records: DataFrame | None = None, targets: list | None = None) -> int:
    """Append ticks as they come. Those whose market is not active yet wait, apart from those of other markets."""
    targets = supported_exchanges(wh) if targets is None else targets
    done = 0
    if records is not None:
        done, _ = apply_carry(wh, records, targets)
        wh.add_waiting("carry", _unmatched(wh, records, targets, _active(wh)))
    return done + release(wh, "carry", targets)


def ingest_stats(wh: Warehouse, records: DataFrame | None = None, targets: list | None = None, by_symbol: bool = False) -> int:
    """The same for stats."""
    targets = supported_exchanges(wh) if targets is None else targets
    done = 0
    if records is not None:
        done = sum(o.rows for o in apply_stats(wh, records, days_of(records, "received_at"), targets, by_symbol))
        wh.add_waiting("stats", _unmatched(wh, _asked(records), targets, _stats_markets(wh, by_symbol)))
    return done + release(wh, "stats", targets)


def _stats_markets(wh: Warehouse, by_symbol: bool) -> DataFrame:
    return wh.dimension("markets") if by_symbol else wh.dimension("markets").where("is_active")


def apply_stats(wh: Warehouse, records: DataFrame, days: Days, targets: list,
                by_symbol: bool = False) -> list[Outcome]:
    """Append normalised stats received on ``days``; ``by_symbol`` includes inactive markets.

    A response that was asked for one market counts for that market only.
    """
    if not targets or not days:
        return [Outcome(t.name, 0) for t in targets]
    batch = upserts.stats_by_symbol(_asked(_with_exchange_id(records, targets)), _stats_markets(wh, by_symbol))
    columns = ["exchange_id", "market_id", "open_interest", "volume_24h", "ts"]
    rows = upserts.new_facts(batch, wh.fact("market_stats", days=days), ["received_at", "pos"], columns)
    seen = Observation()
    counts = [F.count_if(F.col("exchange_id") == t.id).alias(f"n{t.id}") for t in targets]
    wh.append_fact("market_stats", rows.observe(seen, *counts))
    got = _observed(seen)
    refresh_latest_stats(wh, days)
    return [Outcome(t.name, got.get(f"n{t.id}", 0)) for t in targets]


# ---- reading responses -----------------------------------------------------------------


def _responses_of(wh: Warehouse, landing: str, kind: str, landed_from: dt.date | None, targets: list) -> DataFrame:
    """Landed responses of the targets alone; bad answers of other exchanges are not even parsed."""
    names = [t.name.strip().lower() for t in targets]
    return read_landing(wh.spark, landing, kind, landed_from).where(lookup_key(F.col("exchange")).isin(names))


def _checked(wh: Warehouse, responses: DataFrame, kind: str, mode: str, apply) -> list[Outcome]:  # noqa: ANN001
    """``apply`` to the usable records; in quarantine mode the others are stored first and counted."""
    if is_failfast(mode):
        return apply(registry.normalize(responses, kind, mode))
    parsed = registry.parse(responses, kind, mode).persist()
    try:
        bad = rejected(parsed)
        wh.store_rejects(kind, uuid.uuid4().hex, 0, bad)
        counts = {r.exchange: r["count"] for r in bad.groupBy("exchange").count().collect()}
        return [replace(o, rejected=counts.get(lookup(o.exchange), 0)) for o in apply(accept(parsed, failfast=False))]
    finally:
        parsed.unpersist()


def lookup(name: str) -> str:
    return name.strip().lower()


# ---- jobs ------------------------------------------------------------------------------


def sync_markets(wh: Warehouse, landing: str, now: dt.datetime, exchange: str | None = None,
                 landed_from: dt.date | None = None, mode: str = "failfast") -> list[Outcome]:
    """Markets of all active exchanges, or of one, which is added if unknown. What waited for them is stored."""
    targets = [ensure_exchange(wh, exchange, now)] if exchange else supported_exchanges(wh)
    targets = [t for t in targets if registry.normalizer_for(t.name)]
    responses = _responses_of(wh, landing, "markets", landed_from, targets)
    done = _checked(wh, responses, "markets", mode, lambda records: apply_markets(wh, records, targets, now))
    for kind in ("carry", "stats"):
        release(wh, kind, targets)
    return done


def sync_carry(wh: Warehouse, landing: str, now: dt.datetime, exchange: str | None = None,
                 spec: WindowSpec = SinceLastOrLookbackHours(), mode: str = "failfast",
                 landed_from: dt.date | None = None) -> list[Outcome]:
    """Ticks of the window. One exchange: errors are raised. All: an exchange that
    fails is reported and the others go on.

    Responses are read from the day of the earliest window start on. A market that
    has been quiet for long makes that early; a scheduled run can give the day of
    the run before as ``landed_from``, since older responses are done.
    """
    targets = [require_exchange(wh, exchange)] if exchange else supported_exchanges(wh)
    _set_intervals(wh, now, F.col("id") == targets[0].id if exchange else F.col("is_active"))
    outcomes, days = [], frozenset()
    try:
        for target in targets:
            try:
                rows, written = _sync_carry_of(wh, landing, now, target, spec, mode, landed_from)
                days |= written
                outcomes.append(Outcome(target.name, rows))
            except Exception as error:  # noqa: BLE001 - one exchange must not stop the others
                if exchange:
                    raise
                outcomes.append(Outcome(target.name, 0, str(error)))
    finally:
        refresh_derived(wh, days)
    return outcomes


def _set_intervals(wh: Warehouse, now: dt.datetime, which) -> None:  # noqa: ANN001
    """The interval of the chosen exchanges, with a normaliser or not; writes only where it differs."""
    exchanges = wh.dimension("exchanges")
    chosen = exchanges.where(which)
    wrong = ~F.col("carry_interval_minutes").eqNullSafe(F.lit(upserts.CARRY_INTERVAL_MINUTES))
    if not chosen.where(wrong).isEmpty():
        wh.replace_dimension("exchanges", upserts.set_interval(exchanges, _now(now), chosen))


def _sync_carry_of(wh: Warehouse, landing: str, now: dt.datetime, target, spec: WindowSpec,
                     mode: str, landed_from: dt.date | None) -> tuple[int, Days]:
    markets = wh.dimension("markets").where(F.col("exchange_id") == target.id)
    spans = windows.resolve_windows(
        facts.active_market_marks(markets, wh.dimension("carry_marks")), spec, _ms(now)
    )
    start_ms = spans.where("start_ms <= end_ms").agg(F.min("start_ms")).first()[0]
    normaliser = registry.normalizer_for(target.name)
    if normaliser is None:
        return 0, frozenset()
    # Ticks of markets that are not active yet are looked for from the start of a market without ticks on.
    unknown_ms = spec.start_ms if isinstance(spec, Between) else max(0, _ms(now) - spec.hours * windows.HOUR_MS)
    start_ms = unknown_ms if start_ms is None else min(start_ms, unknown_ms)
    if landed_from is None and start_ms > 2 * DAY_MS:
        # A response cannot hold ticks from after its receipt; a day of clock skew is allowed.
        landed_from = _utc_day(start_ms - DAY_MS)
    responses = read_landing(wh.spark, landing, "carry", landed_from).where(
        lookup_key(F.col("exchange")) == target.name.strip().lower()
    )
    if is_failfast(mode):
        ticks = normaliser.carry(responses, mode)
    else:
        parsed = normaliser.parse_carry(responses)
        wh.store_rejects("carry", uuid.uuid4().hex, 0, rejected(parsed))
        ticks = accept(parsed, failfast=False)
    ticks = ticks.persist()
    try:
        wh.add_waiting("carry", _unmatched(wh, ticks, [target], _active(wh)))
        own = ticks.withColumn("exchange_id", F.lit(target.id).cast("bigint"))
        return append_carry(wh, windows.ticks_in_windows(own, spans))
    finally:
        ticks.unpersist()


def sync_stats(wh: Warehouse, landing: str, exchange: str | None = None, landed_from: dt.date | None = None,
               by_symbol: bool = False, mode: str = "failfast") -> list[Outcome]:
    """Stats of all active exchanges or of one; the first error stops the job."""
    targets = [require_exchange(wh, exchange)] if exchange else supported_exchanges(wh)
    targets = [t for t in targets if registry.normalizer_for(t.name)]
    responses = _responses_of(wh, landing, "stats", landed_from, targets)
    # Stats carry the time of receipt, so the days follow without parsing anything.
    days = days_of(responses, "received_at")

    def apply(records: DataFrame) -> list[Outcome]:
        done = apply_stats(wh, records, days, targets, by_symbol)
        wh.add_waiting("stats", _unmatched(wh, _asked(records), targets, _stats_markets(wh, by_symbol)))
        return done

    return _checked(wh, responses, "stats", mode, apply)


def sync_new(wh: Warehouse, landing: str, now: dt.datetime, exchange: str | None = None, mode: str = "failfast",
             by_symbol: bool = False) -> dict[str, list[Outcome]]:
    """Markets, ticks and stats of the responses that no such run has taken yet, of all active exchanges or of one.

    Each exchange and kind has its own mark, so an exchange whose ticks fail is reported and tried again, and the
    others go on; errors of markets and stats, and of one exchange alone, are raised.
    """
    targets = [ensure_exchange(wh, exchange, now)] if exchange else supported_exchanges(wh)
    _set_intervals(wh, now, F.col("id") == targets[0].id if exchange else F.col("is_active"))
    targets = [t for t in targets if registry.normalizer_for(t.name)]

    def take(kind: str, target, apply) -> Outcome:  # noqa: ANN001
        done = {"rows": 0, "rejected": 0}

        def on_records(records: DataFrame, rejected: int) -> None:
            done["rows"] += apply(records)
            done["rejected"] += rejected

        checkpoint = f"{wh.root}/progress/{kind}/{lookup(target.name)}"
        consume(wh, landing, kind, on_records, checkpoint, target.name, mode).awaitTermination()
        return Outcome(target.name, rejected=done["rejected"], rows=done["rows"])

    out: dict[str, list[Outcome]] = {"markets": [], "carry": [], "stats": []}
    for target in targets:
        out["markets"].append(take("markets", target, lambda records, t=target: apply_markets(wh, records, [t], now)[0].rows))
    for kind in ("carry", "stats"):
        release(wh, kind, targets)
    for target in targets:
        try:
            out["carry"].append(take("carry", target, lambda records, t=target: ingest_carry(wh, records, [t])))
        except Exception as error:  # noqa: BLE001 - one exchange must not stop the others
            if exchange:
                raise
            out["carry"].append(Outcome(target.name, 0, str(error)))
    for target in targets:
        out["stats"].append(take("stats", target, lambda records, t=target: ingest_stats(wh, records, [t], by_symbol)))
    return out


def run_init(wh: Warehouse, landing: str, now: dt.datetime, spec: WindowSpec | None = None,
             landed_from: dt.date | None = None, mode: str = "failfast") -> dict[str, list[Outcome]]:
    """Markets, then carry, then stats of all active exchanges: what is new, or what the windows say."""
    if spec is None:
        return sync_new(wh, landing, now, mode=mode)
    return {
        "markets": sync_markets(wh, landing, now, landed_from=landed_from, mode=mode),
        "carry": sync_carry(wh, landing, now, spec=spec, mode=mode, landed_from=landed_from),
        "stats": sync_stats(wh, landing, landed_from=landed_from, mode=mode),
    }


def _one_exchange(wh: Warehouse, landing: str, now: dt.datetime, name: str, spec: WindowSpec | None,
                  landed_from: dt.date | None, mode: str) -> dict[str, list[Outcome]]:
    if spec is None:
        return sync_new(wh, landing, now, name, mode, by_symbol=True)
    return {
        "markets": sync_markets(wh, landing, now, name, landed_from, mode),
        "carry": sync_carry(wh, landing, now, name, spec, mode, landed_from),
        "stats": sync_stats(wh, landing, name, landed_from, by_symbol=True, mode=mode),
    }


def add_exchange(wh: Warehouse, landing: str, now: dt.datetime, name: str, spec: WindowSpec | None = None,
                 landed_from: dt.date | None = None, mode: str = "failfast") -> dict[str, list[Outcome]]:
    """Add an exchange, or switch it on, and sync it; its stats count for inactive markets too."""
    ensure_exchange(wh, name, now)
    return _one_exchange(wh, landing, now, name, spec, landed_from, mode)


def backfill(wh: Warehouse, landing: str, now: dt.datetime, name: str, spec: WindowSpec = SinceLastOrLookbackHours(),
             landed_from: dt.date | None = None, mode: str = "failfast") -> dict[str, list[Outcome]]:
    """Sync a known exchange by windows, whatever was taken before."""
    require_exchange(wh, name)
    return _one_exchange(wh, landing, now, name, spec, landed_from, mode)


def drop_exchange(wh: Warehouse, name: str) -> None:
    """Delete an exchange with its markets and facts; facts go first."""
    fact_tables = ["carry_rates", "market_stats", "carry_8h"]
    small = ["carry_marks", "latest_carry", "latest_stats", "markets", "exchanges"]
    tables = {t: wh.dimension(t) for t in small}
    tables.update({t: wh.fact(t) for t in fact_tables})
    left = upserts.without_exchange(tables, name)
    for t in fact_tables:
        wh.replace_fact(t, left[t])
    for t in small:
        wh.replace_dimension(t, left[t])
    for kind in registry.KINDS:
        if kind in WAITING:
            wh.forget_exchange(kind, lookup(name))
        wh.drop([f"{wh.root}/progress/{kind}/{lookup(name)}"])


# ---- reading -----------------------------------------------------------------------------


def cells(wh: Warehouse) -> DataFrame:
    """Matrix cells from the newest rows per market: no history is read."""
    return matrix.matrix_cells(
        wh.dimension("markets"),
        wh.dimension("tokens"),
        wh.dimension("exchanges"),
        wh.dimension("latest_carry"),
        wh.dimension("latest_stats"),
    )


def board_report(wh: Warehouse, column: str = "", direction: str = "desc", display_mode: str = "rate",
                 spread_unit: str = "percentage", null_rate: str = "zero") -> DataFrame:
    rows = board.carry_board(matrix.served_cells(cells(wh), null_rate), display_mode, spread_unit)
    return board.sort_board(rows, column, direction)


def check_constraints(wh: Warehouse) -> DataFrame:
    tables = {t: wh.dimension(t) for t in ("exchanges", "tokens", "markets")}
    tables.update({t: wh.fact(t) for t in ("carry_rates", "market_stats")})
    return upserts.constraint_report(tables)
