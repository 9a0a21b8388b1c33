"""Interrupted runs, late markets, bad answers of others, rejects and large numbers."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from carrygrid import keys
from carrygrid.functions import numbers
from carrygrid.operators import facts
from carrygrid.operators.windows import SinceLastOrLookbackHours
from carrygrid.plans import jobs
from carrygrid.sources import paradex
from carrygrid.sources.warehouse import WAITING_PARTS, Warehouse
from carrygrid.streaming import ingest, rolling
from tests.test_jobs import (  # noqa: F401 - fixtures
    FIRST,
    NOW,
    data_markets,
    data_ticks,
    landing,
    response,
    results_markets,
    results_ticks,
    snapshot,
    summary,
    wh,
    with_exchanges,
)

SPEC = SinceLastOrLookbackHours(24)


class Broken(Exception):
    pass


@pytest.mark.parametrize("fail_at", [("replace_days", "carry_8h"), ("replace_dimension", "latest_carry"), ("replace_dimension", "latest_stats")])
def test_a_rerun_heals_what_a_crash_left(wh, landing, spark, tmp_path, monkeypatch, fail_at):  # noqa: F811
    path = landing(FIRST)
    expected = with_exchanges(Warehouse(spark, str(tmp_path / "whole")))
    jobs.run_init(expected, path, NOW, SPEC)
    method, table = fail_at
    real = getattr(Warehouse, method)

    def once(self, name, rows):
        if name == table:
            raise Broken(table)
        return real(self, name, rows)

    with monkeypatch.context() as m:
        m.setattr(Warehouse, method, once)
        with pytest.raises(Broken):
            jobs.run_init(wh, path, NOW, SPEC)
    jobs.run_init(wh, path, NOW, SPEC)
    assert snapshot(wh) == snapshot(expected)


def test_ticks_and_stats_wait_for_their_market(spark, wh, landing, tmp_path):  # noqa: F811
    path = landing([r for r in FIRST if r[1] != "markets"])

    def run():
        for name, start in (("f", ingest.carry), ("s", ingest.stats)):
            start(wh, path, str(tmp_path / name)).awaitTermination(120)
        ingest.markets(wh, path, lambda: NOW, str(tmp_path / "m")).awaitTermination(120)

    run()
    assert wh.fact("carry_rates").count() == 0
    landing([r for r in FIRST if r[1] == "markets"])
    run()
    other = with_exchanges(Warehouse(spark, str(tmp_path / "batch")))
    jobs.run_init(other, path, NOW, SPEC)
    a, b = snapshot(wh), snapshot(other)
    for t in set(a) - {"exchanges"}:
        assert a[t] == b[t], t
    # The inactive market goes on waiting.
    assert {r.market_symbol for r in wh.waiting("carry").collect()} == {"OLD-USD"}


def _by_name(wh):  # noqa: F811
    """Stored ticks, stats and buckets by the names of their markets, since ids depend on the order of the runs."""
    exchanges = {r.id: r.name for r in wh.dimension("exchanges").collect()}
    owner = {r.id: (exchanges[r.exchange_id], r.market_symbol) for r in wh.dimension("markets").collect()}
    tables = {
        "ticks": (wh.fact("carry_rates"), ["rate", "ts"]), "stats": (wh.fact("market_stats"), ["open_interest", "volume_24h", "ts"]),
        "buckets": (wh.fact("carry_8h"), ["bucket_start", "rate_8h", "samples"]), "marks": (wh.dimension("carry_marks"), ["last_ts"]),
        "latest": (wh.dimension("latest_stats"), ["open_interest", "ts"]),
    }
    return {name: sorted(((*owner[r.market_id], *(r[c] for c in columns)) for r in rows.collect()), key=repr) for name, (rows, columns) in tables.items()}


def test_batch_runs_keep_what_waits(spark, wh, landing, tmp_path):  # noqa: F811
    """Ticks and stats land a day before their market; runs by windows and runs of what is new end with the same tables as the streams."""
    path = landing([r for r in FIRST if r[1] != "markets"])
    runs = {
        "windows": lambda w: jobs.run_init(w, path, NOW, SPEC, landed_from=NOW.date() - dt.timedelta(days=2)),
        "new": lambda w: jobs.run_init(w, path, NOW),
    }
    houses = {name: with_exchanges(Warehouse(spark, str(tmp_path / name))) for name in runs}
    for _ in range(2):
        for name, run in runs.items():
            run(houses[name])
            assert houses[name].fact("carry_rates").count() == 0
    waiting = {name: w.waiting("carry").count() for name, w in houses.items()}
    assert len(set(waiting.values())) == 1 and waiting["new"] > 0  # a second run adds nothing
    landing([r for r in FIRST if r[1] == "markets"])
    for name, run in runs.items():
        run(houses[name])
    for name, start in (("s", ingest.stats), ("f", ingest.carry)):
        start(wh, path, str(tmp_path / f"cp-{name}")).awaitTermination(120)
    ingest.markets(wh, path, lambda: NOW, str(tmp_path / "cp-m")).awaitTermination(120)
    streamed = _by_name(wh)
    assert streamed["ticks"] and streamed["stats"]
    for name, w in houses.items():
        assert _by_name(w) == streamed, name
        assert {r.market_symbol for r in w.waiting("carry").collect()} == {"OLD-USD"}


def test_folders_of_waiting_records_do_not_grow_with_the_markets(wh, landing, monkeypatch):  # noqa: F811
    names = [f"M{i}-USD" for i in range(200)]
    at = int(NOW.timestamp() * 1000) - 3_600_000
    ticks = {"data": [{"m": name, "f": "0.1", "T": at + i} for i, name in enumerate(names)]}
    path = landing([response("extended", "carry", ticks)])
    jobs.run_init(wh, path, NOW)
    assert wh.waiting("carry").count() == 200 and len(wh.waiting_folders("carry")) <= WAITING_PARTS
    landing([response("extended", "markets", data_markets(*((name, True) for name in names[:3])))])

    def broken(self, paths):
        raise Broken

    with monkeypatch.context() as m:  # the records are stored, but those that go on waiting are there twice
        m.setattr(Warehouse, "drop", broken)
        with pytest.raises(Broken):
            jobs.run_init(wh, path, NOW)
    for _ in range(2):
        jobs.sync_markets(wh, path, NOW)
        assert {r.market_symbol for r in wh.waiting("carry").collect()} == set(names[3:]) and wh.waiting("carry").count() == 197
        assert wh.fact("carry_rates").count() == 3
        assert {r.market_symbol for r in wh.dimension("waiting_carry").collect()} == set(names[3:])
    jobs.drop_exchange(wh, "extended")
    assert not wh.waiting_folders("carry") and wh.dimension("waiting_carry").isEmpty()


def test_a_second_run_opens_no_old_response(wh, landing):  # noqa: F811
    path = landing(FIRST)
    first = jobs.run_init(wh, path, NOW)
    assert sum(o.rows for o in first["carry"]) == 6
    second = jobs.run_init(wh, path, NOW)
    assert [o.rows for os in second.values() for o in os] == [0] * 6
    landing([response("extended", "markets", data_markets(("NEW-USD", True)))])
    assert {o.exchange: o.rows for o in jobs.run_init(wh, path, NOW)["markets"]} == {"Extended": 1, "Paradex": 0}


def test_bad_answers_of_another_exchange_do_no_harm(wh, landing):  # noqa: F811
    path = landing([response("paradex", "markets", "no json"), response("paradex", "stats", "no json"),
                    response("extended", "markets", data_markets(("BTC-USD", True))),
                    response("extended", "stats", {"data": {"openInterest": "2", "dailyVolume": "3"}}, "BTC-USD")])
    assert [o.rows for o in jobs.sync_markets(wh, path, NOW, "extended")] == [1]
    assert [o.rows for o in jobs.sync_stats(wh, path, "extended")] == [1]
    with pytest.raises(Exception, match="malformed response"):
        jobs.sync_markets(wh, path, NOW, "paradex")


def test_rejects_of_every_run_are_kept(spark, wh, landing, tmp_path):  # noqa: F811
    bad = {"results": [{"symbol": "A-USD-PERP", "open_interest": "x"}, {"symbol": "B-USD-PERP", "open_interest": "1"}]}
    path = landing([response("paradex", "markets", results_markets("A-USD-PERP", "B-USD-PERP")), response("paradex", "stats", bad),
                    response("paradex", "carry", results_ticks("A-USD-PERP", (1, "oops"), (2, "0.1")))])
    jobs.sync_markets(wh, path, NOW)
    done = {o.exchange: o for o in jobs.sync_stats(wh, path, mode="quarantine")}
    assert (done["Paradex"].rows, done["Paradex"].rejected) == (1, 1)
    jobs.sync_carry(wh, path, NOW, spec=SPEC, mode="quarantine")
    for name in ("one", "two"):
        ingest.stats(wh, path, str(tmp_path / name)).awaitTermination(120)
    assert spark.read.parquet(f"{wh.root}/quarantine/stats").count() == 3
    assert [r.reject for r in spark.read.parquet(f"{wh.root}/quarantine/carry").collect()] == [f"bad {keys.RATE}"]


def test_late_ticks_count_in_the_stored_buckets(spark, wh, tmp_path):  # noqa: F811
    schema = "exchange_id long, market_id long, rate decimal(18,10), ts timestamp"
    parts = [[(1, 1, Decimal("0.1"), NOW)], [(1, 1, Decimal("0.2"), NOW)], [(1, 1, Decimal("0.4"), NOW - dt.timedelta(days=9)), (1, 2, Decimal("0.5"), NOW)],
             [(1, 1, Decimal("0.3"), NOW - dt.timedelta(days=9, hours=1))]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
        ticks = spark.readStream.schema(schema).parquet(f"{tmp_path}/ticks")
        rolling.carry_8h_table(wh, ticks, str(tmp_path / "cp")).awaitTermination(120)
    first = [r for k, rows in enumerate(parts) for r in rows if k != 1]  # of copies of a key the first counts
    expected = facts.carry_8h(spark.createDataFrame(first, schema)).collect()
    assert sorted(map(tuple, wh.fact("carry_8h").collect())) == sorted(map(tuple, expected))


def test_large_numbers(spark, landing):  # noqa: F811
    rows = [("2e15", "0.0001"), ("9e14", "9e8"), ("1", "50000000000.5"), ("10", "0.1234567890123"), (None, "1"), ("3", None)]
    found = spark.createDataFrame(rows, "oi string, price string").select(numbers.open_interest_usd(F.col("oi"), F.col("price"))).collect()
    assert [r[0] for r in found] == [Decimal("200000000000"), None, Decimal("50000000000.5"), Decimal("1.2345678901"), None, None]
    landed = spark.createDataFrame(
        [response("paradex", "stats", summary(f"M{i}-USD-PERP", oi, price, "1")) for i, (oi, price) in enumerate(rows[:3])]
        + [response("paradex", "carry", {"results": [{"market": "M", keys.INDEX: 25000000000.5, keys.PREMIUM: None, keys.RATE: "0.1", "created_at": 1}]})],
        "exchange string, kind string, market string, received_at timestamp, payload string",
    )
    parsed = paradex.parse_stats(landed.where("kind = 'stats'")).orderBy("market_symbol").collect()
    assert [r.reject for r in parsed] == [None, "open_interest out of range", None]
    assert paradex.carry(landed.where("kind = 'carry'")).count() == 1
    assert data_ticks("a", (1, "1"))
