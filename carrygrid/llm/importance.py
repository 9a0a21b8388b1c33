"""Target-distribution importance resampling over hashed words.

Documents are drawn without replacement as if from the target (the benchmark
texts): a feature is a word (letters a-z, digits and all that is not ASCII), hashed by
the CRC-32 of its bytes into ``BUCKETS`` buckets. The gain of a bucket is the log ratio of
its smoothed share in the target to that in the corpus, in thousandths and as a whole
number; a document's weight is the sum over its features. The highest weights plus
Gumbel noise, which follows from the seed and the doc_id, are drawn.

All CRCs of a chunk of texts are computed together: distinct features of equal
length form a matrix of bytes, and one step over a column updates all of them.
Features over ``BLOCK`` bytes are cut into blocks of that size, which are rows of one
matrix, and chained by the tables that push a state through a block of zeros.

Counts cover all rows of both tables; each task adds up its own, and one number per
bucket comes to the driver. Ranks need no global sort in one task: rows are sorted by
ranges and counted on from the ranges before.

Null text has no features: a weight of 0. Null ids are hashed like empty ones and come last among equal
scores; rows of one id have the same noise; equal rows take their ranks in any order. Without a target, or an
empty table, gains still are defined (add-one smoothing). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from carrygrid.llm.store import table, written
from carrygrid.llm.words import Chunk, chunks, no_letter

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
BLOCK = 256


@cache
def crc_table() -> np.ndarray:
    """State after one byte, for the reflected polynomial of CRC-32."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1)
    return state


def crc_columns(matrix: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States after all columns; ``matrix[k]`` holds byte ``k`` of every row."""
    steps = crc_table()
    for column in matrix:
        state = steps[(state ^ column) & 255] ^ (state >> 8)
    return state


@cache
def block_tables() -> np.ndarray:
    """What each byte of a state becomes after ``BLOCK`` zero bytes; the parts of a state add by exclusive or."""
    alone = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
    return crc_columns(np.zeros((BLOCK, 1024), np.uint8), alone).reshape(4, 256)


def _long_crc(data: np.ndarray) -> int:
    """CRC of one long feature: its blocks are rows of a matrix."""
    count = len(data) // BLOCK
    own = crc_columns(data[: count * BLOCK].reshape(count, BLOCK).T, np.zeros(count, np.uint32))
    push = block_tables().tolist()
    state = 0xFFFFFFFF
    for x in own.tolist():
        state = push[0][state & 255] ^ push[1][state >> 8 & 255] ^ push[2][state >> 16 & 255] ^ push[3][state >> 24] ^ x
    rest = data[count * BLOCK :]
    return int(crc_columns(rest[:, None], np.array([state], np.uint32))[0]) ^ 0xFFFFFFFF


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte runs ``start[i]:end[i]``: one matrix for each length."""
    out = np.zeros(len(start), np.uint32)
    size = end - start
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for length, some in zip(lengths.tolist(), np.split(order, first[1:])):
        if length <= BLOCK:
            matrix = data[start[some] + np.arange(length)[:, None]]
            out[some] = crc_columns(matrix, np.full(len(some), 0xFFFFFFFF, np.uint32)) ^ np.uint32(0xFFFFFFFF)
        else:
            out[some] = [_long_crc(data[start[i] : end[i]]) for i in some]
    return out


def buckets_of(chunk: Chunk, buckets: int) -> np.ndarray:
    """Bucket of every word of a chunk; the CRC of each distinct word is computed once and scattered back."""
    if not len(chunk.start):
        return np.zeros(0, np.int64)
    _, first, place = np.unique(chunk.hashes(), return_index=True, return_inverse=True)
    return (crcs(chunk.data, chunk.start[first], chunk.end[first]) % np.uint32(buckets)).astype(np.int64)[place]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of the column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0), gap=no_letter):
                total += np.bincount(buckets_of(chunk, buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket, target over raw, in whole thousandths."""
    n, s, t = len(raw), float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((float(target[i]) + 1) * s / ((float(raw[i]) + 1) * t))) for i in range(n)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight) of every row."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1), gap=no_letter):
                sums = np.concatenate(([0], np.cumsum(gain[buckets_of(chunk, len(gain))])))
                bounds = chunk.word_bounds
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(chunk.first, chunk.rows).cast(pa.int64()),
                        pa.array(np.diff(bounds).astype(np.int64)),
                        pa.array(sums[bounds[1:]] - sums[bounds[:-1]]),
                    ],
                    names=["doc_id", "n_features", "weight"],
                )

    return docs.select("doc_id", "text").mapInArrow(add_up, "doc_id long, n_features long, weight long")


def with_noise(weighed: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``score``: the weight and Gumbel noise from the seed and the doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return weighed.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform))))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = np.arange(at, at + batch.num_rows, dtype=np.int64)
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"]
        )


def draw(spark: SparkSession, scored: DataFrame, least: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Add ``rank``: 1, 2, 3 by falling score among the ``percent`` drawn of the rows with ``least`` features, else null."""
    fit = F.col("n_features") >= least
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "weight", "n_features"]
    sorted_rows = scored.where(fit).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(spark, sorted_rows.mapInArrow(_numbered, "doc_id long, n_features long, weight long, score long, part int, place long"), "ranked")
    # One row per range: where it begins, and how many rows there are.
    sizes = placed.groupBy("part").count()
    before = F.sum("count").over(Window.orderBy("part")) - F.col("count")
    begin = sizes.select("part", before.alias("begin"), F.sum("count").over(Window.partitionBy()).alias("n"))
    rank = F.col("begin") + F.col("place") + 1
    drawn = F.floor(F.col("n") * percent / 100)
    ranked = placed.join(F.broadcast(begin), "part").select(
        "doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank")
    )
    return ranked.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; the rank is null for those not drawn."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    return draw(spark, written(spark, with_noise(weigh(docs, gain)), "scored"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

CRC_SQL = """steps AS (
  SELECT list(list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t
  FROM range(256) AS r(i))"""


def crc_sql(text: str) -> str:
    """CRC-32 of a text in DuckDB, where ``steps.t`` is at hand."""
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, x: xor(t[(xor(a, x) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295)"


ORACLE = f"""
WITH {CRC_SQL},
own AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS} AS w FROM documents),
target AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
per_doc AS (SELECT row, word, count(*) AS n FROM (SELECT row, unnest(w) AS word FROM own) GROUP BY ALL),
every AS (SELECT DISTINCT word FROM (SELECT word FROM per_doc UNION ALL SELECT word FROM target)),
hashed AS (SELECT word, {crc_sql("word")} % {BUCKETS} AS bucket FROM every, steps),
raw AS (SELECT bucket, sum(n)::BIGINT AS s FROM per_doc JOIN hashed USING (word) GROUP BY bucket),
aim AS (SELECT bucket, count(*) AS t FROM target JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM raw), 0)::DOUBLE + {BUCKETS} AS ss, coalesce((SELECT sum(t) FROM aim), 0)::DOUBLE + {BUCKETS} AS tt),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ss / ((coalesce(s, 0) + 1)::DOUBLE * tt)))::BIGINT AS g
  FROM range({BUCKETS}) AS b(bucket) LEFT JOIN raw USING (bucket) LEFT JOIN aim USING (bucket), totals),
weighed AS (SELECT row, sum(n * g)::BIGINT AS weight FROM per_doc JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM own LEFT JOIN weighed USING (row)),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(n * {PERCENT} / 100) THEN place END AS rank FROM ranked
UNION ALL
SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < {LEAST_WORDS}
"""
