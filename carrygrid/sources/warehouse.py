"""The five tables as Parquet below one root folder.

Dimensions are small and change in place, so every change writes a complete new
snapshot ``<table>/v<number>``; the newest one with a success marker is current
and a path being read is never overwritten. Facts are appended to their current
version below ``dt=<UTC day>`` and get a new version only when an exchange is
deleted; days of the 8-hour buckets, which follow from the facts, are replaced in place. Records whose
market is not active yet wait below ``waiting/<kind>/exchange=/part=``, by a hash of the market, so the number of
folders does not grow with the markets; a dimension lists the markets that are waited for. One writer at a time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrygrid import schema
from carrygrid.functions.timing import utc_day

DIMENSIONS = {
    "exchanges": schema.EXCHANGES,
    "tokens": schema.TOKENS,
    "markets": schema.MARKETS,
    "carry_marks": schema.CARRY_MARKS,
    "latest_carry": schema.LATEST_CARRY,
    "latest_stats": schema.MARKET_STATS,
    "waiting_carry": schema.WAITING_MARKETS,
    "waiting_stats": schema.WAITING_MARKETS,
}
WAITING = {"carry": schema.WAITING_CARRY, "stats": schema.WAITING_STATS}
WAITING_KEY = ["exchange", "market_symbol", "received_at", "pos", "ts"]
WAITING_PARTS = 64
FACTS = {
    "carry_rates": (schema.CARRY_RATES, "ts"),
    "market_stats": (schema.MARKET_STATS, "ts"),
    "carry_8h": (schema.CARRY_8H, "bucket_start"),
}


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ---- versions -------------------------------------------------------

    def _filesystem(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _version(self, table: str) -> int:
        """Newest complete version, 0 if there is none."""
        fs, folder = self._filesystem(f"{self.root}/{table}")
        if not fs.exists(folder):
            return 0
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        numbers = sorted((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()), reverse=True)
        for number in numbers:
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(table, number)}/_SUCCESS")
            if fs.exists(marker):
                return number
        return 0

    def _path(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/v{version:08d}"

    def drop_old_versions(self, table: str, keep: int = 3) -> int:
        """Delete all but the newest ``keep`` versions; for a maintenance run.

        Jobs that still read an older snapshot need it to stay, so this is never
        done in passing.
        """
        if keep < 1:
            raise ValueError("the current version must stay")
        fs, _ = self._filesystem(f"{self.root}/{table}")
        last = self._version(table) - keep
        dropped = 0
        for number in range(last, 0, -1):
            folder = self._filesystem(self._path(table, number))[1]
            if not fs.exists(folder):
                break  # older ones went in an earlier run
            fs.delete(folder, True)
            dropped += 1
        return dropped

    # ---- dimensions -----------------------------------------------------

    def dimension(self, table: str) -> DataFrame:
        version = self._version(table)
        if not version:
            return self.spark.createDataFrame([], DIMENSIONS[table])
        return self.spark.read.schema(DIMENSIONS[table]).parquet(self._path(table, version))

    def replace_dimension(self, table: str, rows: DataFrame) -> DataFrame:
        """Store a new snapshot and return it as read back."""
        path = self._path(table, self._version(table) + 1)
        columns = DIMENSIONS[table].names
        rows.select(*columns).write.mode("overwrite").parquet(path)
        return self.dimension(table)

    # ---- quarantine -----------------------------------------------------

    def store_rejects(self, kind: str, run: str, batch_id: int, rows: DataFrame) -> None:
        """Keep the unusable records of one batch of a run; a replay of that batch replaces them."""
        rows.write.mode("overwrite").parquet(f"{self.root}/quarantine/{kind}/run={run}/batch={batch_id}")

    # ---- records that wait for their market --------------------------------

    @staticmethod
    def part_of() -> Column:
        """The part of an exchange's waiting records that those of a market are in."""
        return F.pmod(F.hash("market_symbol"), F.lit(WAITING_PARTS))

    def waiting_folders(self, kind: str) -> list[tuple[str, int, str]]:
        """(exchange, part, path) of all that waits: at most ``WAITING_PARTS`` entries per exchange."""
        root = f"{self.root}/waiting/{kind}"
        fs, folder = self._filesystem(root)
        if not fs.exists(folder):
            return []
        found = fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{root}/exchange=*/part=*"))
        paths = [status.getPath() for status in found]
        value = lambda path: unquote(path.getName().split("=", 1)[1])
        return [(value(p.getParent()), int(value(p)), p.toString()) for p in paths]

    def waiting(self, kind: str, parts: Iterable[tuple[str, int]] | None = None) -> DataFrame:
        """Waiting records: all, or those of the given (exchange, part), which are the only ones opened.

        A crash in `forget` may leave a record twice; it is read once.
        """
        folders = self.waiting_folders(kind)
        wanted = None if parts is None else set(parts)
        paths = [path for exchange, part, path in folders if wanted is None or (exchange, part) in wanted]
        if not paths:
            return self.spark.createDataFrame([], WAITING[kind])
        names = WAITING[kind].names
        read = self.spark.read.schema(WAITING[kind]).option("basePath", f"{self.root}/waiting/{kind}")
        # A glob pattern would take the escapes of folder names for its own.
        return read.option("pathGlobFilter", "*.parquet").parquet(*paths).select(*names).dropDuplicates(WAITING_KEY)

    def _write_waiting(self, kind: str, rows: DataFrame) -> None:
        laid_out = rows.withColumn("part", self.part_of()).hint("rebalance", "exchange", "part")
        laid_out.write.mode("append").partitionBy("exchange", "part").parquet(f"{self.root}/waiting/{kind}")

    def add_waiting(self, kind: str, rows: DataFrame) -> None:
        """Store records by market, without those that already wait.

        The markets are listed first: a crash in between leaves one that nothing waits for, which does no harm.
        """
        markets = rows.select("exchange", "market_symbol").distinct().persist()
        try:
            parts = [tuple(r) for r in markets.select("exchange", self.part_of()).distinct().collect()]
            if not parts:
                return
            self.replace_dimension(f"waiting_{kind}", self.dimension(f"waiting_{kind}").unionByName(markets).distinct())
        finally:
            markets.unpersist()
        new = rows.select(*WAITING[kind].names).dropDuplicates(WAITING_KEY)
        self._write_waiting(kind, new.join(self.waiting(kind, parts).select(*WAITING_KEY), WAITING_KEY, "left_anti"))

    def forget(self, kind: str, markets: DataFrame, parts: Iterable[tuple[str, int]]) -> None:
        """Remove the waiting records of ``markets``, which lie in ``parts``.

        What else is in the parts is written anew before the old files go, so a crash in between loses none.
        """
        wanted = set(parts)
        folders = [path for exchange, part, path in self.waiting_folders(kind) if (exchange, part) in wanted]
        files = [path for folder in folders for path in self._files(folder)]
        key = ["exchange", "market_symbol"]
        self._write_waiting(kind, self.waiting(kind, wanted).join(markets, key, "left_anti"))
        self.drop(files)
        self.drop(folder for folder in folders if not self._files(folder))
        name = f"waiting_{kind}"
        self.replace_dimension(name, self.dimension(name).join(markets, key, "left_anti"))

    def forget_exchange(self, kind: str, exchange: str) -> None:
        """Remove all that waits of an exchange."""
        self.drop(path for owner, _, path in self.waiting_folders(kind) if owner == exchange)
        name = f"waiting_{kind}"
        if self._version(name):
            self.replace_dimension(name, self.dimension(name).where(F.col("exchange") != exchange))

    def _files(self, folder: str) -> list[str]:
        fs, path = self._filesystem(folder)
        return [status.getPath().toString() for status in fs.listStatus(path) if status.getPath().getName().endswith(".parquet")]

    def drop(self, paths: Iterable[str]) -> None:
        """Delete files or folders."""
        for path in paths:
            fs, place = self._filesystem(path)
            fs.delete(place, True)

    # ---- facts ----------------------------------------------------------

    def fact(self, table: str, first_day: dt.date | None = None, last_day: dt.date | None = None,
             days: Iterable[dt.date] | None = None) -> DataFrame:
        """A fact table, pruned to whole days by partition folder."""
        columns, _ = FACTS[table]
        version = self._version(table)
        if not version:
            return self.spark.createDataFrame([], columns)
        with_day = T.StructType([*columns.fields, T.StructField("dt", T.DateType())])
        rows = self.spark.read.schema(with_day).parquet(self._path(table, version))
        if first_day is not None:
            rows = rows.where(F.col("dt") >= F.lit(first_day))
        if last_day is not None:
            rows = rows.where(F.col("dt") <= F.lit(last_day))
        if days is not None:
            rows = rows.where(F.col("dt").isin([F.lit(d) for d in days]))
        return rows.select(*columns.names)

    def _laid_out(self, table: str, rows: DataFrame) -> DataFrame:
        """Partition by day without small files or oversized tasks.

        The rebalance hint lets AQE merge small days and split a hot one; sorted
        files give tight row-group ranges on market_id.
        """
        columns, time = FACTS[table]
        day = rows.select(*columns.names).withColumn("dt", utc_day(F.col(time)))
        return day.hint("rebalance", "dt").sortWithinPartitions("dt", "market_id", time)

    def append_fact(self, table: str, rows: DataFrame) -> None:
        version = self._version(table) or 1
        self._laid_out(table, rows).write.mode("append").partitionBy("dt").parquet(self._path(table, version))

    def replace_days(self, table: str, rows: DataFrame) -> None:
        """Overwrite just the days present in ``rows`` (which must not read this table).

        The first write makes a whole version, since a dynamic overwrite leaves
        no success marker.
        """
        version = self._version(table)
        if not version:
            return self.replace_fact(table, rows)
        (
            self._laid_out(table, rows)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("dt")
            .parquet(self._path(table, version))
        )

    def replace_fact(self, table: str, rows: DataFrame) -> None:
        """Store a complete new version; readers keep the old one until it is done."""
        (
            self._laid_out(table, rows)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy("dt")
            .parquet(self._path(table, self._version(table) + 1))
        )
