"""Thresholds, ties, rounding, upserts and plans on small literals."""

from __future__ import annotations

import datetime as dt
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from carrygrid import keys
from carrygrid.functions import classes, display, names, timing
from carrygrid.operators import arbitrage, board, facts, matrix, upserts, windows
from carrygrid.plans import fixtures
from carrygrid.session import shared_folder
from carrygrid.streaming import rolling

SERVED = (
    "token string, exchange string, market_symbol string, carry_rate double, open_interest decimal(30,10), "
    "volume_24h decimal(30,10), carry_ts timestamp, stats_ts timestamp, last_update timestamp"
)


@pytest.fixture
def served(spark):
    def build(tokens):
        rows = [
            (token, name, "", float(rate), Decimal(oi), Decimal(0), None, None, dt.datetime(2024, 1, 1))
            for token, cells in tokens.items()
            for name, (rate, oi) in cells.items()
        ]
        return spark.createDataFrame(rows, SERVED)

    return build


def evaluate(spark, sql, **columns):
    """Values of an SQL expression over literal columns."""
    rows = list(zip(*columns.values()))
    kinds = ", ".join(f"{c} {'string' if any(isinstance(v, str) for v in vs) else 'double'}" for c, vs in columns.items())
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {kinds}")
    return [r.v for r in frame.selectExpr("i", f"{sql} AS v").orderBy("i").collect()]


def test_fixed_rounds_the_exact_value(spark):
    values = [1.005, 0.125, 0.375, 2.675, -0.125, 1.45, 8.345, 1e10, 0.0, -0.0, -0.001, 10.235, 1234.5678]
    expected = ["1.00", "0.13", "0.38", "2.67", "-0.13", "1.45", "8.35", "10000000000.00", "0.00", "0.00", "-0.00",
                "10.23", "1234.57"]
    assert evaluate(spark, display.fixed("x", 2), x=values) == expected
    assert evaluate(spark, display.fixed("x", 0), x=[0.5, 1.5, 2.5, 2.4999999999999996, -2.5]) == ["1", "2", "3", "2", "-3"]
    assert evaluate(spark, display.fixed("x", 3), x=[0.0005, 0.0625, 0.05 / 100]) == ["0.001", "0.063", "0.001"]


def test_fixed_agrees_with_exact_decimals(spark):
    draw = random.Random(5)
    values = [draw.uniform(-1, 1) * 10 ** draw.randint(-4, 8) for _ in range(1000)]
    values += [k / 1000 for k in range(-500, 500)] + [k / 16 for k in range(-200, 200)]

    def by_hand(x, places):
        text = f"{Decimal(abs(x)).quantize(Decimal(1).scaleb(-places), rounding='ROUND_HALF_UP'):f}"
        return "-" + text if x < 0 else text

    for places in (0, 2, 3):
        assert evaluate(spark, display.fixed("x", places), x=values) == [by_hand(x, places) for x in values]


def test_number_rate_and_spread_text(spark):
    values = [0.0, 999.4, 1000.0, 1234.5, 999999.0, 1e6, 2.5e9, -5000.0]
    assert evaluate(spark, display.number_text("x"), x=values) == [
        "0", "999", "1.00K", "1.23K", "1000.00K", "1.00M", "2.50B", "-5000",
    ]
    assert evaluate(spark, display.rate_text("x"), x=[0.0001, -0.00005]) == ["0.010%", "-0.005%"]
    assert evaluate(spark, display.rate_text("x", "annualized"), x=[0.0001]) == ["10.95%"]
    assert evaluate(spark, display.spread_text("x"), x=[12.0, None]) == ["0.120%", "–"]
    assert evaluate(spark, display.spread_text("x", "bps"), x=[12.4, None]) == ["12 bps", "–"]
    with pytest.raises(ValueError):
        display.rate_text("x", "weekly")


def test_class_edges(spark):
    below = lambda v: v - 1e-9
    spread = [None, 0.0, below(5.0), 5.0, below(10.0), 10.0, below(25.0), 25.0, below(50.0), 50.0]
    assert evaluate(spark, classes.spread_class("x"), x=spread) == [
        "", "arb-low", "arb-low", "arb-medium", "arb-medium", "arb-high", "arb-high", "arb-very-high",
        "arb-very-high", "arb-extreme",
    ]
    spread = [None, 2.0, below(4.0), 4.0, below(8.0), 8.0, below(15.0), 15.0, 60.0]
    opposite = dict(l=[-1.0] * 9, s=[1.0] * 9, x=spread)
    assert evaluate(spark, classes.opportunity_class("l", "s", "x"), **opposite) == [
        "", *["arb-combo-minimal"] * 2, *["arb-combo-decent"] * 2, *["arb-combo-good"] * 2, *["arb-combo-excellent"] * 2,
    ]
    rates = dict(l=[1.0, 1.0, -2.0, -2.0, 0.0, -1.0, 1.0], s=[2.0, 2.0, -1.0, -1.0, 2.0, 1.0, 2.0],
                 x=[50.0, 25.0, 50.0, below(25.0), 50.0, 25.0, None])
    assert evaluate(spark, classes.row_class("l", "s", "x"), **rates) == [
        "row-extreme-capture", "row-high-capture", "row-extreme-capture", "", "row-high-spread", "row-high-spread", "",
    ]
    assert evaluate(spark, classes.opportunity_class("l", "s", "x"), **rates)[:4] == [
        *["arb-combo-extreme-capture"] * 3, "arb-combo-excellent",
    ]
    assert evaluate(spark, display.capture_text("l", "s", "x"), **rates) == [
        "Both positive, 50bps spread", "Both positive, 25bps spread", "Both negative, 50bps spread", None, None, None, None,
    ]
    label = display.arb_label("'extended'", "'paradex'", "l", "s", "x")
    assert evaluate(spark, label, **rates) == [
        "🔥 L:EXT S:PAR", "🎯 L:EXT S:PAR", "🔥 L:EXT S:PAR", "L:EXT S:PAR", "⚡ L:EXT S:PAR", "⚡ L:EXT S:PAR", "–",
    ]


def test_rate_classes(served):
    tokens = {
        "ONE": {"a": (0.01, 1)},
        "FLAT": {"a": (0.0, 1), "b": (0.0, 1)},
        "TIGHT": {"a": (0.0, 1), "b": (0.00019, 1)},
        "SMALL": {"a": (0.0, 1), "b": (0.0002, 1), "c": (0.0001, 1)},
        "WIDE": {"a": (-0.0005, 1), "b": (0.0005, 1), "c": (0.0001, 1), "d": (-0.0001, 1), "e": (0.0, 1)},
        "POS": {"a": (0.001, 1), "b": (0.0045, 1), "c": (0.002, 1)},
        "NEG": {"a": (-0.001, 1), "b": (-0.0045, 1)},
        "TIES": {"a": (0.001, 1), "b": (0.001, 1), "c": (-0.001, 1)},
    }
    got = {}
    for r in arbitrage.rate_classes(served(tokens)).orderBy("token", "exchange").collect():
        got.setdefault(r.token, []).append(r.rate_class.removeprefix("rate-"))
    assert got == {
        "ONE": ["neutral"],
        "FLAT": ["neutral", "neutral"],
        "TIGHT": ["neutral", "neutral"],
        "SMALL": ["long-opportunity", "short-opportunity", "positive"],
        "WIDE": ["long-candidate", "short-candidate", "positive", "negative", "neutral"],
        "POS": ["extreme-long", "extreme-short", "positive"],
        "NEG": ["extreme-short", "extreme-long"],
        "TIES": ["short-candidate", "short-candidate", "long-candidate"],
    }


def test_best_pair_thresholds_and_ties(served):
    tokens = {
        "ONE": {"a": (0.01, 1)},
        "EDGE": {"a": (0.0, 5), "b": (0.0002, 7)},
        "SHORTFALL": {"a": (0.0001, 1), "b": (0.0003, 1)},  # 1.9999999999999998 bps
        "EQUAL": {"a": (0.5, 1), "b": (0.5, 1)},
        "TIES": {"d": (0.0, 1), "c": (0.0, 2), "b": (0.01, 4), "a": (0.01, 8)},
    }
    rows = {r.token: r for r in arbitrage.best_arb(served(tokens)).collect()}
    assert set(rows) == {"EDGE", "TIES"}
    assert (rows["EDGE"].long_exchange, rows["EDGE"].short_exchange, rows["EDGE"].combined_oi) == ("a", "b", 12.0)
    assert (rows["TIES"].long_exchange, rows["TIES"].short_exchange, rows["TIES"].combined_oi) == ("c", "a", 10.0)
    spreads = {r.token: r.spread for r in arbitrage.arb_spread(served(tokens)).collect()}
    assert spreads["ONE"] is None and spreads["EQUAL"] == 0.0


def test_best_pair_equals_all_pairs(served):
    draw = random.Random(3)
    tokens = {
        f"T{i}": {f"x{j}": (draw.choice([draw.uniform(-0.01, 0.01), 0.0, 0.001]), draw.randint(0, 99)) for j in range(draw.randint(0, 6))}
        for i in range(200)
    }

    def by_hand(cells):
        best, widest = None, 0.0
        for (n1, (r1, o1)), (n2, (r2, o2)) in itertools.combinations(sorted(cells.items()), 2):
            spread = abs(r1 - r2) * 10000
            if spread > widest and spread >= 2:
                widest = spread
                best = (n2, n1, r2, r1, spread, o1 + o2) if r1 > r2 else (n1, n2, r1, r2, spread, o1 + o2)
        return best

    want = {t: by_hand(c) for t, c in tokens.items() if by_hand(c)}
    got = {r.token: tuple(r)[1:] for r in arbitrage.best_arb(served(tokens)).collect()}
    assert got == want


def test_board_sorts(served):
    tokens = {
        "A": {"x": (0.01, 10), "y": (0.0, 5)},
        "B": {"x": (0.02, 1)},
        "C": {"y": (0.03, 100), "z": (0.0, 1)},
    }
    rows = board.carry_board(served(tokens))
    order = lambda *a: [r.token for r in board.sort_board(rows, *a).collect()]
    assert order("token") == ["C", "B", "A"] and order("token", "asc") == ["A", "B", "C"]
    assert order("openInterest") == ["C", "A", "B"]
    assert order("arbSpread") == ["C", "A", "B"] and order("arbSpread", "asc") == ["B", "A", "C"]
    assert order("arbCombo") == ["C", "A", "B"] and order("arbOI") == ["C", "A", "B"]
    assert order("exchange_x") == ["B", "A", "C"] and order("exchange_x", "asc") == ["C", "A", "B"]
    with pytest.raises(ValueError):
        order("volume")
    assert board.toggled("", "desc", "token") == ("token", "desc")
    assert board.toggled("token", "desc", "token") == ("token", "asc")
    assert board.toggled("token", "asc", "arbOI") == ("arbOI", "desc")


def test_bucket_edges_and_late_tick(spark):
    at = lambda h, m=0, s=0: dt.datetime(2024, 3, 1, h, m, s)
    rows = [(1, 1, Decimal("0.1"), at(7, 59, 59)), (1, 1, Decimal("0.2"), at(8)), (1, 1, Decimal("0.3"), at(8, 0, 1)),
            (1, 1, Decimal("0.5"), at(0))]
    carry = spark.createDataFrame(rows, "exchange_id long, market_id long, rate decimal(18,10), ts timestamp")
    got = {r.bucket_start.hour: (r.rate_8h, r.samples) for r in facts.carry_8h(carry).collect()}
    assert got == {0: (0.3, 2), 8: (0.25, 2)}
    assert facts.latest_carry_8h(facts.carry_8h(carry)).first().bucket_start == at(8)
    times = spark.createDataFrame([(at(17, 59, 59),), (dt.datetime(1969, 12, 31, 23, 0),)], "ts timestamp")
    starts = [r[0] for r in times.select(timing.bucket_start(F.col("ts"))).collect()]
    assert starts == [at(16), dt.datetime(1969, 12, 31, 16, 0)]


def test_stored_cells(spark):
    texts = [f'{{"{keys.RATE_8H}": 0.5, "{keys.RATE}": 9}}', f'{{"{keys.RATE_8H}": "x", "{keys.RATE}": 0.25}}',
             f'{{"{keys.TIME}": "a", "{keys.BUCKET}": null, "stats_ts": "b"}}', "no json"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, cell string")
    got = [tuple(r)[1:] for r in matrix.read_stored_cells(rows, "cell").orderBy("i").collect()]
    assert got == [("", 0.5, 0.0, 0.0, None, None), ("", 0.25, 0.0, 0.0, None, None),
                   ("", 0.0, 0.0, 0.0, "a", "b"), ("", 0.0, 0.0, 0.0, None, None)]


def test_names(spark):
    rows = spark.createDataFrame([("foo-BAR x1.9aB",), ("PARADEX",), ("mIDDLE  east",)], "n string")
    assert [r[0] for r in rows.select(names.display_name(F.col("n"))).collect()] == ["Foo-Bar X1.9ab", "Paradex", "Middle  East"]


def test_duplicate_market_of_a_token(spark):
    markets = spark.createDataFrame(
        [(1, 1, 1, "OLD", True), (2, 1, 1, "NEW", True), (3, 1, 1, "OFF", False)],
        "id long, exchange_id long, token_id long, market_symbol string, is_active boolean",
    )
    dims = [spark.createDataFrame([(1, n)], f"id long, {c} string") for n, c in (("BTC", "symbol"), ("X", "name"))]
    late, early = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1)
    latest = spark.createDataFrame([(1, 1, 0.5, late), (1, 2, 0.25, early)],
                                   "exchange_id long, market_id long, rate_8h double, bucket_start timestamp")
    none = spark.createDataFrame([], "market_id long, open_interest decimal(30,10), volume_24h decimal(30,10), ts timestamp")
    cell = matrix.matrix_cells(markets, *dims, latest, none).collect()
    assert len(cell) == 1
    # the higher market id fills the cell, the token's update covers both
    assert (cell[0].market_symbol, cell[0].rate_8h, cell[0].last_update) == ("NEW", 0.25, late)


def test_append_is_idempotent_and_order_free(spark):
    at = lambda s, us=0: dt.datetime(2024, 3, 1, 0, 0, s, us)
    schema = "exchange_id long, market_id long, rate decimal(18,10), ts timestamp, seq long"
    a = spark.createDataFrame([(1, 1, Decimal(1), at(0), 0), (1, 1, Decimal(2), at(0, 500000), 1), (1, 2, Decimal(3), at(0), 2)], schema)
    b = spark.createDataFrame([(1, 1, Decimal(4), at(1), 0), (1, 1, Decimal(4), at(1), 0)], schema)
    empty = a.limit(0)
    plain = lambda d: sorted(map(tuple, d.collect()))
    first = upserts.new_carry(a, empty, ["seq"])
    assert [r.rate for r in first.orderBy("market_id").collect()] == [Decimal(1), Decimal(3)]
    assert upserts.new_carry(a, first, ["seq"]).count() == 0
    ab = first.unionByName(upserts.new_carry(b, first, ["seq"]))
    second = upserts.new_carry(b, empty, ["seq"])
    ba = second.unionByName(upserts.new_carry(a, second, ["seq"]))
    assert plain(ab) == plain(ba) and ab.count() == 3


def test_new_ids_are_dense_in_any_bucket_count(spark):
    existing = spark.createDataFrame([(7, "a")], "id long, k string")
    new = spark.createDataFrame([(f"k{i}",) for i in range(1000)], "k string")
    for buckets in (1, 3, 512):
        ids = sorted(r.id for r in upserts.with_new_ids(new, existing, "k", buckets).collect())
        assert ids == list(range(8, 1008))
    assert upserts.with_new_ids(new.limit(0), existing, "k").count() == 0


def test_exchange_upserts(spark):
    old = dt.datetime(2024, 1, 1)
    now = F.lit("2024-02-01").cast("timestamp")
    existing = spark.createDataFrame(
        [(1, "Paradex", None, True, old, old), (2, "Foo-Bar", 60, False, old, old)],
        "id long, name string, carry_interval_minutes int, is_active boolean, created_at timestamp, updated_at timestamp",
    )
    asked = spark.createDataFrame([("PARADEX",), ("foo-bar",), ("new one",)], "name string")
    rows = {r.name: r for r in upserts.upsert_exchanges(existing, asked, now).collect()}
    assert rows["Paradex"].updated_at == old and rows["Paradex"].id == 1
    assert rows["Foo-Bar"].is_active and rows["Foo-Bar"].updated_at > old and rows["Foo-Bar"].carry_interval_minutes == 60
    assert rows["New One"].id == 3
    touched = upserts.upsert_exchanges(existing, asked, now, touch_active=True)
    assert touched.where("updated_at = created_at AND id < 3").count() == 0
    intervals = upserts.set_interval(existing, now, spark.createDataFrame([(1,)], "id long")).orderBy("id").collect()
    assert [(r.carry_interval_minutes, r.updated_at > old) for r in intervals] == [(480, True), (60, False)]


def test_windows(spark):
    marks = spark.createDataFrame(
        [(1, 1, "A", dt.datetime(2024, 3, 1)), (2, 1, "B", None)],
        "market_id long, exchange_id long, market_symbol string, last_ts timestamp",
    )
    now = 1709337600000
    span = lambda spec: [(r.start_ms, r.end_ms) for r in windows.resolve_windows(marks, spec, now).orderBy("market_id").collect()]
    assert span(windows.Between(5, 6)) == [(5, 6)] * 2
    assert span(windows.LookbackHours(1)) == [(now - 3600000, now)] * 2
    assert span(windows.LookbackHours(10**9)) == [(0, now)] * 2
    assert span(windows.SinceLastOrLookbackHours(2)) == [(1709251200001, now), (now - 7200000, now)]
    ticks = spark.createDataFrame([(1, "A", Decimal(1), dt.datetime(2024, 3, 1))],
                                  "exchange_id long, market_symbol string, rate decimal(18,10), ts timestamp")
    hit = lambda a, b: windows.ticks_in_windows(ticks, windows.resolve_windows(marks, windows.Between(a, b), now)).count()
    at = 1709251200000
    assert [hit(at, at), hit(at + 1, at + 2), hit(at - 1, at - 1), hit(at + 1, at)] == [1, 0, 0, 0]


def test_stream_drops_duplicates_and_late_ticks_the_batch_keeps(spark, tmp_path):
    schema = "exchange_id long, market_id long, rate decimal(18,10), ts timestamp"
    source, out = str(tmp_path / "ticks"), str(tmp_path / "out")
    at = lambda d, h=1: dt.datetime(2024, 3, d, h)

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        rolling.write_updates(rolling.carry_8h_stream(stream), out, str(tmp_path / "cp")).awaitTermination(120)
        return {r.bucket_start: (r.rate_8h, r.samples) for r in rolling.read_buckets(spark, out).collect()}

    run([(1, 1, Decimal("0.1"), at(1)), (1, 1, Decimal("0.1"), at(1)), (1, 1, Decimal("0.3"), at(1, 2))])
    got = run([(1, 1, Decimal("0.5"), at(10)), (1, 1, Decimal("0.2"), at(1, 3))])
    assert got == {at(1, 0): (pytest.approx(0.2), 3), at(10, 0): (0.5, 1)}
    got = run([(1, 1, Decimal("0.9"), at(1, 4))])  # far behind the watermark
    assert got[at(1, 0)][1] == 3
    batch = facts.carry_8h(spark.read.schema(schema).parquet(source).distinct())
    assert batch.where(F.col("samples") == 4).count() == 1


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


# ---- plans ---------------------------------------------------------------------------


def plan_of(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    t = fixtures.Tables(spark, "/root/testdata/sf0.001")
    pairs = plan_of(arbitrage.best_arb(t.served()))
    assert "NestedLoop" not in pairs and "Cartesian" not in pairs
    # ticks: one scan of the needed columns with the filters pushed, hash aggregates with map-side halves
    latest = plan_of(facts.latest_carry_8h(t.buckets()))
    assert latest.count("FileScan") == 1 and "SortAggregate" not in latest and "Sort [" not in latest
    assert latest.count("partial_") >= 2 and "props" not in latest
    assert "Not(EqualTo(event_type,purchase))" in latest
    stats = plan_of(facts.latest_stats(t.stats()))
    assert stats.count("Exchange") == 1 and "Window" not in stats
    # the board needs no window and no join back
    assert "Window" not in plan_of(board.carry_board(t.served()))


def test_no_single_task_steps(spark):
    """Global windows run over the id buckets' sizes only."""
    t = fixtures.Tables(spark, "/root/testdata/sf0.001")
    rows = upserts.with_new_ids(t.tokens().select("symbol"), t.tokens(), "symbol")
    plan = plan_of(rows)
    assert plan.count("Exchange SinglePartition") == 2  # max(id) and the running sum of bucket sizes


def test_stored_days_are_pruned(spark, tmp_path):
    from carrygrid.sources.warehouse import Warehouse

    wh = Warehouse(spark, str(tmp_path))
    t = fixtures.Tables(spark, "/root/testdata/sf0.001")
    wh.append_fact("carry_rates", t.carry())
    day = dt.date(2024, 1, 5)
    pruned = wh.fact("carry_rates", day, day)
    assert "PartitionFilters: [isnotnull(dt" in plan_of(pruned)
    assert pruned.count() == t.carry().where(F.to_date("ts") == F.lit(day)).count() > 0


def test_versions_of_a_dimension(spark, tmp_path):
    from carrygrid.sources.warehouse import Warehouse

    wh = Warehouse(spark, str(tmp_path))
    assert wh.dimension("tokens").count() == 0
    for n in range(1, 6):
        rows = wh.dimension("tokens").select("symbol").unionByName(spark.createDataFrame([(f"T{n}",)], "symbol string"))
        wh.replace_dimension("tokens", upserts.upsert_tokens(wh.dimension("tokens"), rows, F.current_timestamp()))
    assert sorted(r.id for r in wh.dimension("tokens").collect()) == [1, 2, 3, 4, 5]
    (tmp_path / "tokens" / "v00000006").mkdir()  # an unfinished write is not seen
    assert wh.dimension("tokens").count() == 5
    assert wh.drop_old_versions("tokens", keep=2) == 3 and wh.drop_old_versions("tokens", keep=2) == 0
    assert wh.dimension("tokens").count() == 5
