"""Continuous ingest: the sync jobs driven by the landing zone's file stream (see `sources.intake`).

Bad records are stored aside instead of stopping the stream.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from carrygrid.plans import jobs
from carrygrid.session import shared_folder
from carrygrid.sources.intake import consume
from carrygrid.sources.warehouse import Warehouse


def _start(wh: Warehouse, landing: str, kind: str, apply: Callable[[DataFrame], object],
           checkpoint: str | None, every: str | None, max_files: int | None) -> StreamingQuery:
    checkpoint = checkpoint or shared_folder(wh.spark, f"ingest-{kind}")
    return consume(wh, landing, kind, lambda records, _: apply(records), checkpoint, every=every, max_files=max_files)


def carry(wh: Warehouse, landing: str, checkpoint: str | None = None, every: str | None = None,
            max_files: int | None = None) -> StreamingQuery:
    """Append ticks as they land; without ``every`` the backlog is read once.

    The usual schedule is one run per interval (``every="480 minutes"``). Ticks
    of markets that are not known yet wait for them.
    """
    def apply(records: DataFrame) -> None:
        jobs.ingest_carry(wh, records)

    return _start(wh, landing, "carry", apply, checkpoint, every, max_files)


def markets(wh: Warehouse, landing: str, now: Callable[[], dt.datetime], checkpoint: str | None = None,
            every: str | None = None, max_files: int | None = None) -> StreamingQuery:
    """Market discovery, usually daily. Ticks and stats that waited for a market are stored with it."""
    def apply(records: DataFrame) -> None:
        jobs.apply_markets(wh, records, jobs.supported_exchanges(wh), now())
        jobs.ingest_carry(wh)
        jobs.ingest_stats(wh)

    return _start(wh, landing, "markets", apply, checkpoint, every, max_files)


def stats(wh: Warehouse, landing: str, checkpoint: str | None = None, every: str | None = None,
          max_files: int | None = None) -> StreamingQuery:
    """Stats snapshots, usually daily. Stats of markets that are not known yet wait for them."""
    def apply(records: DataFrame) -> None:
        jobs.ingest_stats(wh, records)

    return _start(wh, landing, "stats", apply, checkpoint, every, max_files)
