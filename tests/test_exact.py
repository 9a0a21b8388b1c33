"""Exact products, exact text of large numbers, first rows and sets of seconds."""

from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal, localcontext

from pyspark.sql import functions as F

from carrygrid.functions import numbers
from carrygrid.functions.display import fixed
from carrygrid.operators import upserts
from carrygrid.plans import jobs
from carrygrid.sources.warehouse import Warehouse


def _number(draw: random.Random) -> str:
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    whole = str(draw.randrange(10 ** draw.randint(1, 20)))
    sign = draw.choice(["", "", "-"])
    return draw.choice([sign + whole, "0." + "0" * draw.randint(0, 17) + "7", f"{sign}{whole}.{digits(draw.randint(1, 18))}", f"{draw.randint(1, 999)}e{draw.randint(-16, 17)}", "1e20"])


def test_products_equal_decimals(spark):
    draw = random.Random(1)
    rows = [(_number(draw), _number(draw)) for _ in range(3000)]
    rows += [("2e15", "0.000000001"), ("2e15", "0.000000015"), ("1e15", "0.123456789012"), ("-0.00000000005", "1"), ("0.5", "0.0000000001")]
    rows += [("0.49999999", "0.0000000001"), ("9" * 20, "1"), ("9" * 20, "1.1"), (None, "1"), ("1", None), ("0", "-5")]
    found = spark.createDataFrame(rows, "a string, b string").select(numbers.exact_product(F.col("a"), F.col("b"))).collect()
    with localcontext() as context:
        context.prec = 100
        for (a, b), row in zip(rows, found):
            want = None if a is None or b is None else (Decimal(a) * Decimal(b)).quantize(Decimal("1e-10"), ROUND_HALF_UP)
            assert row[0] == (want if want is None or abs(want) < Decimal(10) ** 20 else None), (a, b)


def test_text_of_large_numbers_is_exact(spark):
    draw = random.Random(2)
    values = [draw.uniform(-1, 1) * 10 ** draw.uniform(0, 37) for _ in range(1500)]
    values += [90071992547409.125 * k for k in range(1, 100)] + [2.0**k + 0.125 for k in range(40, 60)] + [2.0**k for k in range(50, 126)] + [0.125, 1.005, -0.125]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    with localcontext() as context:
        context.prec = 100
        for places in (0, 2, 3):
            for v, row in zip(values, df.selectExpr(fixed("x", places)).collect()):
                want = format(Decimal(v).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP), "f")
                assert row[0] == want or Decimal(row[0]) == Decimal(want) == 0, (v, places)


def test_first_rows_come_without_sorting(spark):
    rows = [(1, 5, 3, "b"), (1, 5, 2, "a"), (1, 4, 9, "c"), (2, -7, -1, "x"), (2, -7, 0, "y")]
    df = spark.createDataFrame(rows, "k long, t long, pos int, v string")
    assert {r.k: r.v for r in upserts.first_per_key(df, ["k"], ["t", "pos"]).collect()} == {1: "c", 2: "x"}
    facts = spark.createDataFrame([(1, 1, Decimal("0.1"), dt.datetime(2024, 1, 1), 1)], "exchange_id long, market_id long, rate decimal(18,10), ts timestamp, event_id long")
    plan = upserts.new_carry(facts, facts.limit(0), ["event_id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_seconds_known_are_not_appended(spark):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    kind = "exchange_id long, market_id long, rate decimal(18,10), ts timestamp, event_id long"
    row = lambda market, second, event: (1, market, Decimal("0.1"), start + dt.timedelta(seconds=second, milliseconds=7), event)
    stored = spark.createDataFrame([row(m, s, 0) for m in (1, 2) for s in (*range(0, 200, 3), -1, 63, 64, 100_000)], kind)
    batch = spark.createDataFrame([row(m, s, s) for m in (1, 3) for s in range(-5, 210)], kind)
    found = upserts.new_carry(batch, stored, ["event_id"]).collect()
    at = lambda r: int((r.ts.astimezone(dt.timezone.utc) - start).total_seconds())
    known = {*range(0, 200, 3), -1, 63, 64}
    assert sorted((r.market_id, at(r)) for r in found) == sorted([(1, s) for s in range(-5, 210) if s not in known] + [(3, s) for s in range(-5, 210)])


def test_a_late_tick_opens_its_day_only(spark, tmp_path, monkeypatch):
    wh = Warehouse(spark, str(tmp_path / "tables"))
    kind = "exchange_id long, market_id long, rate decimal(18,10), ts timestamp, received_at timestamp, pos int"
    at = lambda day: dt.datetime(2024, 1, day, 5, tzinfo=dt.timezone.utc)
    batch = lambda *days: spark.createDataFrame([(1, 1, Decimal("0.1"), at(d), at(d), 0) for d in days], kind)
    jobs.append_carry(wh, batch(*range(1, 20)))
    asked: list = []
    real = Warehouse.fact

    def fact(self, table, *args, **named):
        asked.append(sorted(named.get("days") or ()))
        return real(self, table, *args, **named)

    monkeypatch.setattr(Warehouse, "fact", fact)
    done, days = jobs.append_carry(wh, batch(2, 2, 25))
    assert done == 1 and sorted(d.day for d in days) == [2, 25] and [[d.day for d in x] for x in asked] == [[2, 25]]
