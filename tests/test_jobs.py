"""The sync jobs end to end on small landed responses."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from carrygrid import keys
from carrygrid.operators import upserts
from carrygrid.operators.windows import Between, LookbackHours, SinceLastOrLookbackHours
from carrygrid.plans import jobs
from carrygrid.schema import LANDING
from carrygrid.sources.landing import write_landing
from carrygrid.sources.warehouse import Warehouse
from carrygrid.streaming import ingest

UTC = dt.timezone.utc
DAY = dt.datetime(2024, 3, 1, tzinfo=UTC)
NOW = DAY + dt.timedelta(hours=20)


def ms(hours: float) -> int:
    return int((DAY + dt.timedelta(hours=hours)).timestamp() * 1000)


def response(exchange, kind, payload, market=None, hours=12.0):
    at = (DAY + dt.timedelta(hours=hours)).replace(tzinfo=None)
    return (exchange, kind, market, at, payload if isinstance(payload, str) else json.dumps(payload))


def results_markets(*symbols):
    return {"results": [{"symbol": s, "base_currency": s.split("-")[0], "quote_currency": "USD"} for s in symbols]}


def results_ticks(market, *ticks):
    return {
        "results": [
            {"market": market, keys.INDEX: "1", keys.PREMIUM: None, keys.RATE: r, "created_at": ms(h)}
            for h, r in ticks
        ]
    }


def summary(symbol, oi, price, volume):
    return {"results": [{"symbol": symbol, "open_interest": oi, "mark_price": price, "volume_24h": volume}]}


def data_markets(*rows):
    return {"data": [{"name": n, "assetName": n.split("-")[0], "active": a} for n, a in rows]}


def data_ticks(market, *ticks):
    return {"data": [{"m": market, "f": r, "T": ms(h)} for h, r in ticks]}


FIRST = [
    response("paradex", "markets", results_markets("BTC-USD-PERP", "ETH-USD-PERP", "BTC-USD-OPTION")),
    response("extended", "markets", data_markets(("BTC-USD", True), ("ETH-USD", True), ("OLD-USD", False))),
    response("nowhere", "markets", "{}"),
    response("paradex", "carry", results_ticks("BTC-USD-PERP", (1, "0.0001"), (7.9, "0.0003"), (9, "0.0004"), (9, None))),
    response("paradex", "carry", results_ticks("ETH-USD-PERP", (2, "-0.0002"))),
    response("extended", "carry", data_ticks("BTC-USD", (1, "0.0010"), (10, "0.0016"))),
    response("extended", "carry", data_ticks("OLD-USD", (1, "0.5"))),
    response("paradex", "stats", summary("BTC-USD-PERP", "10", "50000", "7")),
    response("extended", "stats", {"data": {"openInterest": "250000", "dailyVolume": "9"}}, "BTC-USD"),
    response("extended", "stats", {"data": {"openInterest": "1", "dailyVolume": "1"}}, "OLD-USD"),
]


@pytest.fixture
def landing(spark, tmp_path):
    path = str(tmp_path / "landing")

    def land(rows):
        write_landing(spark.createDataFrame(rows, LANDING), path)
        return path

    return land


def with_exchanges(warehouse):
    names = warehouse.spark.createDataFrame([("paradex",), ("EXTENDED",), ("nowhere",)], "name string")
    now = F.lit(NOW.isoformat()).cast("timestamp")
    rows = upserts.upsert_exchanges(warehouse.dimension("exchanges"), names, now)
    warehouse.replace_dimension("exchanges", rows)
    return warehouse


@pytest.fixture
def wh(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "tables"))
    return with_exchanges(warehouse)


def snapshot(wh):
    out = {}
    for t in ("exchanges", "tokens", "markets", "carry_marks", "latest_carry", "latest_stats"):
        out[t] = sorted(map(tuple, wh.dimension(t).collect()), key=repr)
    for t in ("carry_rates", "market_stats", "carry_8h"):
        out[t] = sorted(map(tuple, wh.fact(t).collect()), key=repr)
    return out


def test_init_and_board(wh, landing):
    path = landing(FIRST)
    done = jobs.run_init(wh, path, NOW, SinceLastOrLookbackHours(24))
    assert {o.exchange: o.rows for o in done["markets"]} == {"Extended": 3, "Paradex": 2}
    assert {o.exchange: o.rows for o in done["carry"]} == {"Extended": 2, "Paradex": 4}
    assert {o.exchange: o.rows for o in done["stats"]} == {"Extended": 1, "Paradex": 1}
    assert [o.error for os in done.values() for o in os] == [None] * 6

    rows = {r.token: r for r in jobs.board_report(wh, "token", "asc").collect()}
    assert set(rows) == {"BTC", "ETH"}  # OLD is inactive
    btc = rows["BTC"]
    assert btc.pair.long_exchange == "Paradex" and btc.pair.short_exchange == "Extended"
    assert btc.pair.long_rate == pytest.approx(0.0004) and btc.pair.short_rate == pytest.approx(0.0016)
    assert btc.total_oi == 750000.0 and btc.total_oi_text == "$750.00K"
    assert btc.pair_label == "L:PAR S:EXT"
    eth = rows["ETH"]  # no rate on one exchange counts as 0
    assert [c.carry_rate for c in eth.cells] == [0.0, pytest.approx(-0.0002)]

    buckets = wh.fact("carry_8h").orderBy("market_id", "bucket_start").collect()
    assert sum(b.samples for b in buckets) == wh.fact("carry_rates").count() == 6
    intervals = {r.name: r.carry_interval_minutes for r in wh.dimension("exchanges").collect()}
    assert intervals == {"Paradex": 480, "Extended": 480, "Nowhere": 480}
    assert jobs.check_constraints(wh).agg(F.sum("violations")).first()[0] == 0


def test_second_run_changes_nothing(wh, landing):
    path = landing(FIRST)
    jobs.run_init(wh, path, NOW, SinceLastOrLookbackHours())
    before = snapshot(wh)
    again = jobs.run_init(wh, path, NOW, Between(ms(0), ms(30)))
    assert all(o.rows == 0 for o in again["carry"] + again["stats"])
    assert snapshot(wh) == before


def test_since_last_reads_only_new_ticks_and_repairs_late_ones(wh, landing):
    path = landing(FIRST)
    jobs.run_init(wh, path, NOW, SinceLastOrLookbackHours())
    # 8.5 h is older than the mark (9 h): skipped by since-last, found by a wider window.
    landing([response("paradex", "carry", results_ticks("BTC-USD-PERP", (8.5, "0.0008"), (17, "0.0005")), hours=19)])
    assert jobs.sync_carry(wh, path, NOW, "PARADEX")[0].rows == 1
    assert jobs.sync_carry(wh, path, NOW, "paradex", LookbackHours(24))[0].rows == 1
    bucket = wh.fact("carry_8h").where(F.hour("bucket_start") == 8).orderBy("market_id")
    means = [r.rate_8h for r in bucket.collect()]
    assert pytest.approx(0.0006) in means  # 8.5 h and 9 h together
    kept = snapshot(wh)
    jobs.rebuild_derived(wh)
    assert snapshot(wh) == kept  # refreshing day by day equals recomputing everything


def test_tick_of_the_marked_second_is_absorbed(wh, landing):
    half = 0.5 / 3600
    rows = FIRST[:3] + [response("extended", "carry", data_ticks("BTC-USD", (1, "0.1"), (1 + half, "0.2")))]
    path = landing(rows)
    jobs.run_init(wh, path, NOW, SinceLastOrLookbackHours())
    assert jobs.sync_carry(wh, path, NOW, "extended")[0].rows == 0
    assert [r.rate for r in wh.fact("carry_rates").collect()] == [Decimal("0.1000000000")]


def test_one_failing_exchange_does_not_stop_the_other(wh, landing):
    path = landing(FIRST + [response("paradex", "carry", results_ticks("BTC-USD-PERP", (3, "oops")))])
    jobs.sync_markets(wh, path, NOW)
    done = {o.exchange: o for o in jobs.sync_carry(wh, path, NOW)}
    assert done["Extended"].rows == 2 and done["Extended"].error is None
    assert done["Paradex"].rows == 0 and f"bad {keys.RATE}" in done["Paradex"].error
    with pytest.raises(Exception, match=f"bad {keys.RATE}"):
        jobs.sync_carry(wh, path, NOW, "paradex")
    assert wh.fact("carry_8h").count() == 2
    assert jobs.sync_carry(wh, path, NOW, "paradex", mode="quarantine")[0].rows == 4


def test_unknown_or_inactive_exchange(wh, landing):
    path = landing(FIRST)
    with pytest.raises(ValueError, match="not found or inactive"):
        jobs.sync_carry(wh, path, NOW, "absent")
    with pytest.raises(ValueError, match="not found or inactive"):
        jobs.backfill(wh, path, NOW, "absent")


def test_add_exchange_takes_stats_of_inactive_markets(spark, tmp_path, landing):
    wh = Warehouse(spark, str(tmp_path / "fresh"))
    done = jobs.add_exchange(wh, landing(FIRST), NOW, "extended", SinceLastOrLookbackHours())
    assert [done[k][0].rows for k in ("markets", "carry", "stats")] == [3, 2, 2]
    jobs.backfill(wh, str(tmp_path / "landing"), NOW, "Extended")
    assert wh.fact("market_stats").count() == 2


def test_drop_exchange(wh, landing):
    jobs.run_init(wh, landing(FIRST), NOW, SinceLastOrLookbackHours())
    jobs.drop_exchange(wh, "Extended")
    assert [r.name for r in wh.dimension("exchanges").orderBy("name").collect()] == ["Nowhere", "Paradex"]
    assert wh.dimension("markets").count() == 2 and wh.dimension("tokens").count() == 3
    assert wh.fact("carry_rates").count() == 4 and wh.fact("market_stats").count() == 1
    assert jobs.check_constraints(wh).agg(F.sum("violations")).first()[0] == 0


def test_empty_landing_is_a_no_op(wh, landing):
    path = landing([response("nowhere", "markets", "{}")])
    before = snapshot(wh)
    done = jobs.run_init(wh, path, NOW, SinceLastOrLookbackHours())
    assert all(o.rows == 0 and o.error is None for os in done.values() for o in os)
    after = snapshot(wh)
    assert {k: v for k, v in after.items() if k != "exchanges"} == {k: v for k, v in before.items() if k != "exchanges"}


def test_streams_equal_the_batch_jobs(spark, wh, landing, tmp_path):
    path = landing(FIRST + [response("extended", "carry", data_ticks("ETH-USD", (4, "oops")))])
    for start in (lambda: ingest.markets(wh, path, lambda: NOW), lambda: ingest.stats(wh, path)):
        query = start()  # one writer at a time
        assert query.awaitTermination(120) and query.exception() is None
    checkpoint = str(tmp_path / "checkpoint")
    ingest.carry(wh, path, checkpoint).awaitTermination(120)
    assert wh.fact("carry_rates").count() == 6  # the bad tick is set aside
    rejects = spark.read.parquet(f"{wh.root}/quarantine/carry").collect()
    assert [r.reject for r in rejects] == ["bad f"]
    landing([response("extended", "carry", data_ticks("ETH-USD", (5, "0.01"), (1, "0.02")), hours=13)])
    ingest.carry(wh, path, checkpoint).awaitTermination(120)
    assert wh.fact("carry_rates").count() == 8

    other = with_exchanges(Warehouse(spark, str(tmp_path / "batch")))
    jobs.sync_markets(other, path, NOW)
    jobs.sync_carry(other, path, NOW, spec=Between(0, ms(48)), mode="quarantine")
    jobs.sync_stats(other, path)
    a, b = snapshot(wh), snapshot(other)
    for t in set(a) - {"exchanges"}:
        assert a[t] == b[t], t
