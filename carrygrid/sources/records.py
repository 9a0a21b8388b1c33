"""From a response to its records, and what becomes of unreadable ones.

The normalisers build *parsed* frames: record columns plus ``reject``, the
reason why a record cannot be used (null for good ones), and ``wanted``, whether
a good one belongs into the tables. Two modes:

* ``failfast``    the first bad record fails the job, as one bad number fails a
                  whole response
* ``quarantine``  bad records are left out; `rejected` lists them

In failfast mode the reason is raised where it is found, so the checks appear
once in the plan in either mode and the generated code stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENVELOPE = ["exchange", "market", "received_at"]


def is_failfast(mode: str) -> bool:
    if mode not in ("failfast", "quarantine"):
        raise ValueError(f"unknown mode: {mode}")
    return mode == "failfast"


def first_reason(failfast: bool, *checks: tuple[Column, str]) -> Column:
    """Reason of the first check that holds, null if none does."""
    reasons = []
    for bad, text in checks:
        reason = F.raise_error(F.lit(f"unusable record: {text}")).cast("string") if failfast else F.lit(text)
        reasons.append(F.when(bad, reason))
    return F.coalesce(*reasons)


def items_of(responses: DataFrame, schema: str, field: str) -> DataFrame:
    """One row per element of the response's array ``field``: envelope, pos, item, broken.

    A response that is no JSON object or lacks the field gives one ``broken``
    row without item; an empty array gives none.
    """
    parsed = responses.select(*ENVELOPE, F.from_json("payload", schema)[field].alias("items"))
    flagged = parsed.withColumn("broken", F.col("items").isNull())
    rows = flagged.select(*ENVELOPE, "broken", F.posexplode_outer("items").alias("pos", "item"))
    return rows.where("broken OR pos IS NOT NULL").withColumn("pos", F.coalesce("pos", F.lit(0)))


def item_reason(failfast: bool, *checks: tuple[Column, str]) -> Column:
    """`first_reason` for rows of `items_of`."""
    return first_reason(
        failfast,
        (F.col("broken"), "malformed response"),
        (F.col("item").isNull(), "malformed record"),
        *checks,
    ).alias("reject")


def accept(parsed: DataFrame, failfast: bool) -> DataFrame:
    """Records without a reason against them.

    The optimizer may run later filters, and the null checks of later joins,
    before this one, which would hide bad records that those drop anyway. A
    non-deterministic condition is neither reordered nor merged, so with it
    every record is checked first.
    """
    good = F.col("reject").isNull()
    if failfast:
        good = F.when(F.spark_partition_id() >= 0, good)
    return parsed.where(good).where("wanted").drop("reject", "wanted")


def rejected(parsed: DataFrame) -> DataFrame:
    """Bad records: where they came from and why."""
    return parsed.where(F.col("reject").isNotNull()).select(
        "exchange", "market_symbol", "received_at", "pos", "reject"
    )
