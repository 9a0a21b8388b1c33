"""The landing zone: one row per HTTP response of an exchange.

A collector outside this package stores responses as they come. Stored as
Parquet below ``landed_date=/kind=/exchange=`` the zone splits freely, and a job
opens only the days, the kind and the exchange that it works on; whole-file JSON
can be read too, one task per file.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrygrid.schema import LANDING

FOLDERS = ["landed_date", "kind", "exchange"]
LANDING_WITH_DAY = T.StructType([*LANDING.fields, T.StructField("landed_date", T.DateType())])


def read_landing(
    spark: SparkSession,
    path: str,
    kind: str | None = None,
    landed_from: dt.date | None = None,
    landed_to: dt.date | None = None,
) -> DataFrame:
    """Landed responses, pruned to the days asked for (both inclusive)."""
    rows = spark.read.schema(LANDING_WITH_DAY).parquet(path)
    if landed_from is not None:
        rows = rows.where(F.col("landed_date") >= F.lit(landed_from))
    if landed_to is not None:
        rows = rows.where(F.col("landed_date") <= F.lit(landed_to))
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    return rows.select(*LANDING.names)


def stream_landing(spark: SparkSession, path: str, kind: str, max_files: int | None = None) -> DataFrame:
    """The landing zone as a stream; the file source remembers what it has read."""
    reader = spark.readStream.schema(LANDING_WITH_DAY)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).where(F.col("kind") == kind).select(*LANDING.names)


def write_landing(responses: DataFrame, path: str) -> None:
    """Append responses, one folder per day of receipt, kind and exchange.

    The rebalance hint merges small folders' rows into one task and splits a hot
    folder over several.
    """
    rows = responses.select(*LANDING.names).withColumn("landed_date", F.to_date("received_at"))
    rows.hint("rebalance", *FOLDERS).write.mode("append").partitionBy(*FOLDERS).parquet(path)


def read_payload_files(
    spark: SparkSession, path: str, exchange: str, kind: str, market_pattern: str | None = None
) -> DataFrame:
    """Responses kept as JSON files; receipt time is the file's modification time.

    ``market_pattern`` is a regular expression whose first group takes the
    market asked for from the file path.
    """
    files = spark.read.text(path, wholetext=True)
    market = F.lit(None).cast("string")
    if market_pattern:
        market = F.regexp_extract(F.col("_metadata.file_path"), market_pattern, 1)
    return files.select(
        F.lit(exchange).alias("exchange"),
        F.lit(kind).alias("kind"),
        market.alias("market"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        F.col("value").alias("payload"),
    )

