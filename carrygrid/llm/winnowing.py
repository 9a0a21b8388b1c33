"""Document fingerprints by winnowing.

The hashes of all ``GRAM`` code points in a row are cut into windows of
``WINDOW`` neighbours; of each window the smallest hash is kept with its
position, of equal ones the rightmost. So whatever two texts share in a row
over ``GRAM + WINDOW - 1`` code points leaves a common hash in both
fingerprints, and nothing shorter than ``GRAM`` does. A text of fewer hashes
than a window is one window, a text shorter than ``GRAM`` one gram.

A fingerprint is text: eight hex digits of the hash and eight of the position
for each kept gram, in the order of the text. The likeness of two is the Jaccard
similarity of their sets of hashes, 1 for two empty ones.

To compare a document with its successor, documents are dealt by ranges of
doc_id, and the first document of each range is copied to the one before it;
every task then streams through its ranges and keeps some texts at a time.
Texts are shuffled once.

Null text counts as empty: no grams, an empty fingerprint. Documents follow each other by
falling doc_id, null ids last, rows of one id by the hash of the text; the last is followed
by the first, a lone document by itself. Repeated rows are documents of their own.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrygrid.llm.words import mix, powers

GRAM, WINDOW = 24, 48
CHUNK_CHARS = 200_000
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by windows of doubled widths."""
    least, own = values, 1
    while own * 2 <= width:
        least = np.minimum(least[:-own], least[own:])
        own *= 2
    rest = width - own
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def fingerprints(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, hashes, positions): the kept grams of text ``i`` lie at ``bounds[i]:bounds[i + 1]``."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    n = len(points)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(_P, n + 1)[:n], out=sums[1:])
    inverse = powers(_P_INVERSE, n + 1)
    whole = max(n - gram + 1, 0)
    keys = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    keys[:whole] = mix((sums[gram:] - sums[:whole]) * inverse[:whole]) if whole else 0
    lone = np.flatnonzero((sizes > 0) & (sizes < gram))
    keys[first[lone]] = mix((sums[first[lone] + sizes[lone]] - sums[first[lone]]) * inverse[first[lone]])
    # Smallest hash first, then the rightmost place.
    keys = (keys & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    grams = np.where(sizes >= gram, sizes - gram + 1, np.minimum(sizes, 1))
    large = np.flatnonzero(grams >= window)
    least = sliding_least(keys, window) if len(large) else keys[:0]
    inside = np.zeros(len(least) + 1, np.int64)
    np.add.at(inside, first[large], 1)
    np.add.at(inside, first[large] + grams[large] - window + 1, -1)
    chosen = least[np.cumsum(inside[:-1]) > 0]
    small = np.flatnonzero((grams > 0) & (grams < window))
    if len(small):
        edges = np.stack((first[small], first[small] + grams[small]), axis=1).ravel()
        chosen = np.concatenate((chosen, np.minimum.reduceat(np.append(keys, keys[-1]), edges)[::2]))
    place = np.sort((np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64))
    place = place[np.concatenate(([True], place[1:] != place[:-1]))] if len(place) else place
    bounds = np.searchsorted(place, np.append(first, n))
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    return bounds, (keys[place] >> np.uint64(32)).astype(np.uint32), (place - first[owner]).astype(np.uint32)


def _texts_of(bounds: np.ndarray, hashes: np.ndarray, positions: np.ndarray) -> list[str]:
    both = np.stack((hashes, positions), axis=1).astype(">u4").tobytes().hex()
    return [both[16 * a : 16 * b] for a, b in zip(bounds[:-1], bounds[1:])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _judge(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
    """Result rows of documents in a row; ``following`` comes after the last."""
    changed = [edited(a, b) for a, b in zip(texts, [*texts[1:], following])]
    bounds, hashes, positions = fingerprints([*texts, following, *changed])
    sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    written = _texts_of(bounds, hashes, positions)
    n = len(texts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array(written[:n], pa.string()),
            pa.array(written[n + 1 :], pa.string()),
            pa.array([likeness(sets[i], sets[n + 1 + i]) for i in range(n)], pa.float64()),
            pa.array([likeness(sets[i], sets[i + 1]) for i in range(n)], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, text, part, ahead) in, results of those that are not ahead out."""
    ids: list = []
    texts: list[str] = []
    size, part = 0, None
    for batch in batches:
        for doc_id, text, own, ahead in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if own != part:
                ids, texts, size, part = [], [], 0, own
            if ahead and not ids:
                continue  # a further copy of the row that follows the part
            text = text.as_py() or ""
            if ids and (ahead or size >= CHUNK_CHARS):
                yield _judge(ids, texts, text)
                ids, texts, size = [], [], 0
            if not ahead:
                ids.append(doc_id)
                texts.append(text)
                size += len(text)


def succession(spark: SparkSession, docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, part, ahead): ranges of falling doc_id, each with the row that follows it marked as ``ahead``.

    Only the ``parts`` borders and the first row of each range come to the driver, without texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    borders = rows.agg(F.percentile_approx("doc_id", shares, 10_000).alias("b")).first().b if parts > 1 else None
    borders = sorted(set(borders or []), reverse=True)
    # The part is the number of borders above the id; null ids come last.
    above = F.size(F.filter(F.lit(borders).cast("array<long>"), lambda b: b > F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(borders))).otherwise(above).cast("int")
    rows = rows.withColumn("part", part)
    # Bitwise not turns the order of whole numbers round, without overflow.
    down = F.bitwise_not("doc_id")
    firsts = sorted(rows.groupBy("part").agg(F.min(F.struct(down.isNull().alias("last"), down.alias("down"), "tie")).alias("first")).collect())
    if not firsts:
        return rows.select("doc_id", "text", "part", F.lit(False).alias("ahead"))
    copies = [(one.first.down, one.first.tie, before.part) for one, before in zip(firsts, [firsts[-1], *firsts[:-1]])]
    also = spark.createDataFrame(copies, "down long, first_tie long, before int")
    marked = rows.join(F.broadcast(also), down.eqNullSafe(F.col("down")) & (F.col("tie") == F.col("first_tie")), "left")
    own, ahead = (F.struct(F.col(x).alias("part"), F.lit(x == "before").alias("ahead")) for x in ("part", "before"))
    every = marked.select("doc_id", "text", "tie", F.inline(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, ahead))))
    return (
        every.repartitionById(len(borders) + 1, F.col("part"))
        .sortWithinPartitions("part", "ahead", F.col("doc_id").desc_nulls_last(), "tie")
        .select("doc_id", "text", "part", "ahead")
    )


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; see the module."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return succession(spark, docs, parts).mapInArrow(_stream, RESULT)
