"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8)
choose data and cores. Each query is built and run to a no-op sink once to warm
up and then ``BENCH_RUNS`` times (default 3); the median counts.

``python bench.py compare`` times alternatives to the plans chosen instead.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from carrygrid.plans.queries import QUERIES  # noqa: E402
from carrygrid.session import build_session  # noqa: E402

HEADLINE = [
    "norm_carry_a",
    "norm_all",
    "carry_8h",
    "latest_carry_8h",
    "latest_market_stats",
    "carry_matrix",
    "matrix_document",
    "matrix_health",
    "total_open_interest",
    "arb_spread",
    "best_arb",
    "rate_class",
    "matrix_wide",
    "carry_board",
    "board_sorted",
    "carry_hwm",
    "incremental_extract",
    "append_carry",
    "upsert_markets",
    "constraint_report",
]


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(build, runs: int) -> float:
    run(build())
    seconds = []
    for _ in range(runs):
        start = time.perf_counter()
        run(build())
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 4)


def alternatives(spark, folder: str) -> dict:
    """Chosen plan against the obvious other one, on the same data."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from carrygrid.operators import facts
    from carrygrid.plans.fixtures import Tables

    t = Tables(spark, folder)

    def by_window():
        newest = Window.partitionBy("market_id").orderBy(F.col("ts").desc())
        return t.stats().withColumn("rn", F.row_number().over(newest)).where("rn = 1")

    stored = tempfile.mkdtemp(prefix="run-") + "/buckets"
    t.buckets().write.parquet(stored)
    return {
        "latest_stats: max_by aggregate": lambda: facts.latest_stats(t.stats()),
        "latest_stats: row_number window": by_window,
        "latest_carry_8h: from ticks": lambda: facts.latest_carry_8h(t.buckets()),
        "latest_carry_8h: from stored buckets": lambda: facts.latest_carry_8h(spark.read.parquet(stored)),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    if sys.argv[1:] == ["compare"]:
        cases = alternatives(spark, folder)
    else:
        cases = {name: (lambda q=QUERIES[name]: q(spark, folder)) for name in HEADLINE}
    queries = {name: timed(build, runs) for name, build in cases.items()}
    print(json.dumps({
        "metric": "rate analytics, sum of median query seconds",
        "value": round(sum(queries.values()), 4),
        "unit": "sec",
        "queries": queries,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
