"""Judging candidate pairs: batches of signature places under a posterior bound, then the full sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMERATOR, DENOMINATOR = 3, 4
MISS = 1e-5  # chance of dropping a true pair in a batch
BATCH = 40


@cache
def fewest_matches(seen: int, miss: float = MISS) -> int:
    """Fewest matches in ``seen`` places at which a similarity of 0.75 keeps a posterior of ``miss``."""
    grid = (np.arange(4000) + 0.5) / 4000
    high = grid >= NUMERATOR / DENOMINATOR
    for matches in range(seen + 1):
        logs = matches * np.log(grid) + (seen - matches) * np.log1p(-grid)
        weight = np.exp(logs - logs.max())
        if weight[high].sum() / weight.sum() >= miss:
            return matches
    return seen


def survivors(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs of signatures (rows) that stay likely after every batch."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for seen in range(BATCH, left.shape[1] + 1, BATCH):
        window = slice(seen - BATCH, seen)
        matches[alive] += (left[alive, window] == right[alive, window]).sum(axis=1)
        alive = alive[matches[alive] >= fewest_matches(seen)]
    return alive


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            left, right = (
                np.frombuffer(b"".join(part.column(name).to_pylist()), np.uint16).reshape(part.num_rows, -1)
                for name in ("left", "right")
            )
            yield part.select(["a", "b"]).take(pa.array(survivors(left, right)))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for row, (x, y) in enumerate(zip(batch.column("left"), batch.column("right"))):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if min(len(s), len(t)) * DENOMINATOR < max(len(s), len(t)) * NUMERATOR:
                continue
            both = np.concatenate((s, t))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= 75 * (len(s) + len(t) - common):
                keep.append(row)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _sides(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with the value of either end as ``left`` and ``right``."""
    return pairs.join(values.select(F.col("id").alias("b"), F.col(value).alias("right")), "b").join(
        values.select(F.col("id").alias("a"), F.col(value).alias("left")), "a"
    ).select("a", "b", "left", "right")


def likely(pairs: DataFrame, signature: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures (id, signature) leave a similarity of 0.75 likely enough."""
    return _sides(pairs, signature, "signature").mapInArrow(_judge, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets (id, shingles) have a Jaccard similarity of 0.75 or more."""
    return _sides(pairs, sets, "shingles").mapInArrow(_confirm, "a long, b long")


