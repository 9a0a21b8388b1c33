"""MinHash near-dedup with sequential Bayesian verification.

Texts become sets of five-word shingles. Equal sets form one class, of which
the smallest doc_id stands for all. Classes that share a band of MinHash
values are candidates. A pair is then judged in batches of signature places:
after each batch it is dropped where the posterior chance of a similarity of
0.75 or more, given the matches seen and a uniform prior, is below
``bayes.MISS``. What survives is confirmed on the full sets.

Null or empty texts have no set and are linked with nothing. A null doc_id
keeps its row, is never linked and counts as kept. Repeated rows of one doc_id
share its component; where their texts differ, each row goes by its own text.
Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrygrid.llm.bayes import likely
from carrygrid.llm.components import Filter, buckets, link_buckets
from carrygrid.llm.store import written
from carrygrid.llm.words import chunks, mix, shingle_sets

BANDS, ROWS = 32, 5  # a pair at 0.75 is missed by all bands with a chance of 2e-4
PLACES = BANDS * ROWS
_SEEDS = mix(np.arange(1, 2 * PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B = _SEEDS[:PLACES] | np.uint64(1), _SEEDS[PLACES:]


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """MinHash values (rows x places, 32 bits) of non-empty sets."""
    joined = np.concatenate(sets)
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), places), np.uint32)
    for k in range(places):
        out[:, k] = np.minimum.reduceat(((joined * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each ``rows`` neighbouring places."""
    bands = signature.shape[1] // rows
    total = np.zeros((len(signature), bands), np.uint64)
    for k in range(rows):
        total = mix(total + signature[:, k::rows] + np.uint64(k + 1))
    return mix(total ^ (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


SIGNED = "id long, n_shingles long, set_hash long, signature binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for chunk in chunks(batch.column(1)):
            sets = list(shingle_sets(chunk))
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            hashes = np.zeros(len(sets), np.uint64)
            signed: list = [None] * len(sets)
            keys: list = [None] * len(sets)
            if len(full):
                some = [sets[i] for i in full]
                values = signatures(some)
                bands = band_keys(values).view(np.int64)
                small = values.astype(np.uint16)
                for row, i in enumerate(full):
                    hashes[i] = mix(some[row]).sum(dtype=np.uint64)
                    signed[i], keys[i] = small[row].tobytes(), bands[row]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(chunk.first, chunk.rows).cast(pa.int64()),
                    pa.array(sizes),
                    pa.array(hashes.view(np.int64)),
                    pa.array(signed, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "n_shingles", "set_hash", "signature", "bands"],
            )


def shingles_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles): the full sets of the documents with the given ids, and of a few others.

    The texts stay where they are; a bitmap of a fixed size picks those to look at.
    """
    wanted = Filter(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = wanted(batch.column(0).cast(pa.int64()).to_numpy())
            batch = batch.filter(pa.array(some))
            for chunk in chunks(batch.column(1)):
                found = [s.tobytes() for s in shingle_sets(chunk)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.rows).cast(pa.int64()), pa.array(found, pa.binary())],
                    names=["id", "shingles"],
                )

    return docs.mapInArrow(sets, "id long, shingles binary").groupBy("id").agg(F.min("shingles").alias("shingles"))


def classes(spark: SparkSession, signed: DataFrame) -> DataFrame:
    """Rows of ``signed`` with a set: id, n_shingles, first_id (smallest id with the same set), signature, bands.

    Signature and bands are left with the first of a class only. A class of a
    third of all rows is one minimum per task, and its join key is split.
    """
    named = signed.where("n_shingles > 0 and id is not null")
    firsts = named.groupBy("set_hash", "n_shingles").agg(F.min("id").alias("first_id"))
    own = F.col("id") == F.col("first_id")
    joined = named.join(firsts, ["set_hash", "n_shingles"]).select(
        "id", "n_shingles", "first_id",
        F.when(own, F.col("signature")).alias("signature"), F.when(own, F.col("bands")).alias("bands"),
    )
    return written(spark, joined, "classes")


def banded(spark: SparkSession, grouped: DataFrame) -> DataFrame:
    """Members (key, id, n, leader) of the bands that two classes or more share."""
    keys = grouped.where("bands is not null").select(
        F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n")
    )
    return written(spark, buckets(keys), "members")


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept. See the module for the method."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = written(spark, docs.mapInArrow(_sign, SIGNED), "signed")
    grouped = classes(spark, signed)
    members = banded(spark, grouped)
    signature = grouped.where("signature is not null").groupBy("id").agg(F.min("signature").alias("signature"))

    texts = docs.where("doc_id is not null")
    labels = link_buckets(
        spark, members, lambda ids: shingles_of(texts, ids), lambda pairs: likely(pairs, signature), signature
    )
    placed = (
        grouped.select(F.col("id").alias("doc_id"), "n_shingles", F.col("first_id").alias("id"))
        .join(labels, "id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    )
    alone = signed.where("n_shingles = 0 or id is null").select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("id").alias("component_id")
    )
    return placed.union(alone).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def keep_one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for."""
    gone = near_duplicates(spark, docs).where("not kept").select("doc_id").distinct()
    return docs.join(written(spark, gone, "removed"), "doc_id", "left_anti").select(docs.columns)
