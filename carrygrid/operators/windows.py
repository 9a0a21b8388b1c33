"""Per-market time windows for incremental reads. The clock is a parameter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrygrid.functions.constants import DEFAULT_LOOKBACK_HOURS

HOUR_MS = 3_600_000
LAST_DAY_MS = 253402300799999  # end of year 9999


@dataclass(frozen=True)
class Between:
    start_ms: int
    end_ms: int


@dataclass(frozen=True)
class LookbackHours:
    hours: int


@dataclass(frozen=True)
class SinceLastOrLookbackHours:
    hours: int = DEFAULT_LOOKBACK_HOURS


WindowSpec = Between | LookbackHours | SinceLastOrLookbackHours


def resolve_windows(marks: DataFrame, spec: WindowSpec, now_ms: int) -> DataFrame:
    """Add ``start_ms`` and ``end_ms`` (both inclusive) to markets with ``last_ts``."""
    if isinstance(spec, Between):
        start, end = F.lit(spec.start_ms), F.lit(spec.end_ms)
    else:
        back = F.lit(max(0, now_ms - spec.hours * HOUR_MS))
        end = F.lit(now_ms)
        if isinstance(spec, LookbackHours):
            start = back
        else:
            # Stored ticks are whole seconds, so the mark is a multiple of 1000 ms.
            start = F.coalesce(F.unix_seconds("last_ts") * 1000 + 1, back)
    return marks.withColumns({"start_ms": start.cast("bigint"), "end_ms": end.cast("bigint")})


def ticks_in_windows(ticks: DataFrame, windows: DataFrame) -> DataFrame:
    """Normalised ticks of the windows' markets, tagged with market and exchange id.

    ``ticks`` carries ``exchange_id``. Windows with start after end select
    nothing. The join key is unique on the windows side; a hot market's ticks
    are streamed past a broadcast or split by AQE.
    """
    w = windows.where("start_ms <= end_ms").select(
        "exchange_id", "market_symbol", "market_id", "start_ms", "end_ms"
    )
    ms = F.unix_millis("ts")
    return (
        ticks.join(w, ["exchange_id", "market_symbol"])
        .where(ms.between(F.col("start_ms"), F.col("end_ms")))
        .drop("start_ms", "end_ms")
    )
