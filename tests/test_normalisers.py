"""The normalisers on hand-written responses."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal

import pytest

from carrygrid import keys
from carrygrid.schema import LANDING
from carrygrid.sources import extended, paradex, registry
from carrygrid.sources.landing import read_payload_files

HERE = os.path.join(os.path.dirname(__file__), "fixtures")
RECEIVED = dt.datetime(2024, 3, 1, 12, 0, 0, 250000)


@pytest.fixture
def landed(spark):
    def load(file, exchange="paradex", kind="carry", market=None):
        text = file
        if file.endswith(".json"):
            with open(os.path.join(HERE, file), encoding="utf-8") as f:
                text = f.read()
        return spark.createDataFrame([(exchange, kind, market, RECEIVED, text)], LANDING)

    return load


def test_results_markets_keep_perpetuals(landed):
    rows = paradex.markets(landed("a_markets.json")).orderBy("pos").collect()
    assert [(r.symbol, r.market_symbol, r.quote_currency, r.is_active) for r in rows] == [
        ("BTC", "BTC-USD-PERP", "USD", True),
        ("ETH", "eth-usd-perps", "USD", True),
    ]


def test_results_stats_convert_open_interest(landed):
    rows = {r.market_symbol.split("-")[0]: r for r in paradex.stats(landed("a_summary.json")).collect()}
    assert set(rows) == {"ALL", "UND", "LAST", "NOPRICE", "NOOI", "BIG"}
    assert {k: r.open_interest for k, r in rows.items()} == {
        "ALL": Decimal("25"),
        "UND": Decimal("50"),
        "LAST": Decimal("61"),
        "NOPRICE": None,
        "NOOI": None,
        # 400000000000000.12345678 * 0.0000123456789, to ten places
        "BIG": Decimal("4938271560.0000015242"),
    }
    assert rows["ALL"].volume_24h == Decimal("100.25") and rows["NOOI"].volume_24h is None
    assert rows["ALL"].ts == RECEIVED


def test_results_carry(landed):
    rows = paradex.carry(landed("a_carry.json")).orderBy("pos").collect()
    assert [(r.rate, r.ts) for r in rows] == [
        (Decimal("0.0001234568"), dt.datetime(2024, 3, 1, 1, 0, 0, 123000)),
        (Decimal("0.0002"), dt.datetime(2024, 3, 1, 1, 0, 0, 999000)),
        (Decimal("0.00001"), dt.datetime(2024, 3, 1, 1, 0, 4)),
        (Decimal("-0.00005"), dt.datetime(1969, 12, 31, 23, 59, 59, 999000)),
    ]


def test_unusable_ticks(landed):
    responses = landed("a_carry_missing_index.json")
    with pytest.raises(Exception, match=f"missing {keys.INDEX}"):
        paradex.carry(responses).collect()
    assert [r.rate for r in paradex.carry(responses, "quarantine").collect()] == [Decimal("0.2")]
    assert [r.reject for r in registry.rejects(responses, "carry").orderBy("pos").collect()] == [
        f"missing {keys.INDEX}",
        f"bad {keys.RATE}",
        "bad created_at",
        "created_at out of range",
    ]


def test_one_bad_number_fails_even_a_dropped_symbol(landed):
    text = '{"results": [{"symbol": "BTC-USD-C", "volume_24h": "x"}]}'
    with pytest.raises(Exception, match="bad volume_24h"):
        paradex.stats(landed(text)).collect()
    assert paradex.stats(landed(text), "quarantine").count() == 0


@pytest.mark.parametrize("text", ["not json", "[]", "{}", '{"results": null}'])
def test_malformed_responses(landed, text):
    with pytest.raises(Exception, match="malformed response"):
        paradex.carry(landed(text)).collect()
    assert registry.rejects(landed(text), "carry").count() == 1


def test_empty_array_is_no_error(landed):
    assert paradex.carry(landed('{"results": []}')).count() == 0
    assert extended.carry(landed('{"data": []}', "extended")).count() == 0


def test_data_markets(landed):
    rows = extended.markets(landed("b_markets.json")).orderBy("pos").collect()
    assert [(r.symbol, r.market_symbol, r.quote_currency, r.is_active) for r in rows] == [
        ("BTC", "BTC-USD", "USD", True),
        ("OLD", "OLD-USD", "USD", False),
        ("PLAIN", "PLAIN", "", True),
    ]


def test_data_carry_rounds_to_ten_places(landed):
    rows = extended.carry(landed("b_carry.json")).orderBy("pos").collect()
    assert [r.rate for r in rows] == [Decimal("0.0001"), Decimal("-0.0002"), Decimal("0.1234567891")]


def test_data_carry_bad(landed):
    responses = landed("b_carry_bad.json", "extended")
    with pytest.raises(Exception, match="bad f"):
        extended.carry(responses).collect()
    assert [r.reject for r in registry.rejects(responses, "carry").orderBy("pos").collect()] == ["bad f", "bad T"]


def test_data_stats(landed):
    row = extended.stats(landed("b_stats.json", "extended", "stats", "BTC-USD")).first()
    assert (row.market_symbol, row.open_interest, row.volume_24h) == ("BTC-USD", Decimal("123456.789"), Decimal(42))
    for text in ('{"data": {"openInterest": null, "dailyVolume": "1"}}', '{"data": {"openInterest": "1"}}', "{}"):
        with pytest.raises(Exception, match="unusable record"):
            extended.stats(landed(text, "extended", "stats", "BTC-USD")).collect()


def test_dispatch_by_name(landed):
    both = landed("a_carry.json", " PARADEX ").unionByName(landed("b_carry.json", "Extended"))
    rows = registry.normalize(both.unionByName(landed("?", "elsewhere")), "carry")
    assert {(r.exchange, r["count"]) for r in rows.groupBy("exchange").count().collect()} == {
        ("paradex", 4), ("extended", 3),
    }
    assert registry.skipped(both.unionByName(landed("?", "elsewhere"))).collect() == [("elsewhere", 1)]
    assert registry.normalizer_for("Other") is None


def test_payload_files(spark, tmp_path):
    folder = tmp_path / "BTC-USD"
    folder.mkdir()
    with open(os.path.join(HERE, "b_stats.json"), encoding="utf-8") as f:
        (folder / "stats.json").write_text(f.read())
    responses = read_payload_files(spark, str(tmp_path / "*" / "*.json"), "extended", "stats", r"([^/]+)/stats\.json")
    row = registry.normalize(responses, "stats").first()
    assert row.market_symbol == "BTC-USD" and row.open_interest == Decimal("123456.789")


def test_later_steps_do_not_hide_bad_records(spark, landed):
    """Records that a later filter or join would drop are still checked."""
    text = f"""{{"results": [{{"market": %s, "{keys.INDEX}": null, "{keys.PREMIUM}": null,
               "{keys.RATE}": null, "created_at": %s}}]}}"""
    known = spark.createDataFrame([("BTC-USD-PERP",)], "market_symbol string")
    for market, created, reason in (("null", "1", "missing market"), ('"X"', '"soon"', "bad created_at")):
        ticks = paradex.carry(landed(text % (market, created))).where("ts > timestamp'2000-01-01'")
        with pytest.raises(Exception, match=reason):
            ticks.join(known, "market_symbol").collect()
