"""Which exchange is read by which normaliser."""

from __future__ import annotations

from functools import reduce
from types import ModuleType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrygrid.functions.names import lookup_key

from . import extended, paradex
from .records import accept, is_failfast, rejected

NORMALISERS: dict[str, ModuleType] = {m.NAME: m for m in (paradex, extended)}
KINDS = ("markets", "carry", "stats")


def normalizer_for(exchange: str) -> ModuleType | None:
    return NORMALISERS.get(exchange.strip().lower())


def _of(responses: DataFrame, exchange: str, kind: str) -> DataFrame:
    return responses.where((lookup_key(F.col("exchange")) == exchange) & (F.col("kind") == kind))


def parse(responses: DataFrame, kind: str, mode: str = "failfast") -> DataFrame:
    """Parsed records of one kind from every supported exchange; others are passed over."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    parts = [
        getattr(m, f"parse_{kind}")(_of(responses, name, kind), is_failfast(mode))
        for name, m in NORMALISERS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def normalize(responses: DataFrame, kind: str, mode: str = "failfast") -> DataFrame:
    """Usable records of one kind from every supported exchange."""
    return accept(parse(responses, kind, mode), is_failfast(mode))


def rejects(responses: DataFrame, kind: str) -> DataFrame:
    """Unusable records of one kind, for the quarantine table."""
    return rejected(parse(responses, kind, "quarantine"))


def skipped(responses: DataFrame) -> DataFrame:
    """Responses of exchanges without a normaliser, counted by name."""
    known = F.coalesce(lookup_key(F.col("exchange")).isin(*NORMALISERS), F.lit(False))
    return responses.where(~known).groupBy("exchange").agg(F.count(F.lit(1)).alias("responses"))


def rows_of_arrays(batch: DataFrame, *arrays: str) -> DataFrame:
    """Parallel arrays to rows, one column per array."""
    return batch.select(F.inline(F.arrays_zip(*arrays)))
