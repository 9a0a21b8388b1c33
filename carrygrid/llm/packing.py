"""Best-fit packing of tokenised texts into sequences, in bulk-synchronous rounds.

A text becomes its ids and a closing 0; what is longer than a sequence is cut
into full pieces with the remainder first. Pieces and gaps are sorted into
classes by size, and ranked within a class in parallel. A round sweeps the
pieces from the longest on: each class goes to its successor, the smallest
class of gaps it fits, and on to the next ones; ranks decide which piece takes
which gap, so no gap is taken twice. Then the gaps are updated and the next
round begins. New sequences are opened for pieces over half the size at once, for others
when no gap takes any piece, as many as the remaining tokens fill.

Only the sizes of the classes (at most ``CAPACITY`` numbers) pass through the
driver. Classes are split by their size, so one length may hold any share of the pieces. Every
round is a written table. Equal lengths are placed in the order of the pieces' numbers. A very long text is
many pieces, in as many sequences.

Null text counts as empty: one piece with the closing 0. Rows with a null
or repeated doc_id are packed like any other. An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carrygrid.llm.store import written
from carrygrid.llm.words import give_back

CAPACITY = 2048
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
# Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Byte strings and special tokens of a byte-level BPE file, with their ids; ids are merge ranks."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    # Bytes that do not print stand as the characters from 256 on, in order.
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printing)]
    byte = {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {x["content"]: x["id"] for x in content["added_tokens"]}
    return {bytes(byte[c] for c in t): i for t, i in content["model"]["vocab"].items() if t not in special}, special


def encoder(ranks: dict[bytes, int], special: dict[str, int]) -> tiktoken.Encoding:
    """Gives the ids of the file's own library, faster; tests compare the two."""
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(bpe: tiktoken.Encoding, special: dict[str, int], text: str) -> list[int]:
    if any(s in text for s in special):
        return bpe.encode(text, allowed_special=set(special), disallowed_special=())
    return bpe.encode_ordinary(text)


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a text: full ones but for the first."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text, tokenised where it lies."""
    ranks, special = vocabulary(path)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks, special)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, number, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    ids = np.array([*encode(bpe, special, text.as_py() or ""), 0], "<u4")
                    for k, (a, n) in enumerate(cuts(len(ids), capacity)):
                        row.append(i)
                        number.append(k)
                        start.append(a)
                        length.append(n)
                        crc.append(zlib.crc32(ids[a : a + n].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
            give_back()

    return docs.select("doc_id", "text").mapInArrow(tokenise, PIECE)


def ranked(rows: DataFrame, size: str, number: str) -> DataFrame:
    """``rows`` with ``rank``, counted from 0 within each class of equal ``size``.

    A class of n rows is split into about the square root of n parts of as many rows, which are numbered by
    themselves and shifted by the parts before, so a class of any size is as many tasks as it needs.
    Classes are at most ``CAPACITY`` and so may be broadcast; the table of shifts has a row per class and part.
    """
    parts = rows.groupBy(size).agg(F.ceil(F.sqrt(F.count("*"))).alias("parts"))
    salted = rows.join(F.broadcast(parts), size).withColumn("salt", F.pmod(F.xxhash64(number), F.col("parts"))).drop("parts")
    counts = salted.groupBy(size, "salt").count()
    before = F.sum("count").over(Window.partitionBy(size).orderBy("salt")) - F.col("count")
    shifts = counts.select(size, "salt", before.alias("shift"))
    within = F.row_number().over(Window.partitionBy(size, "salt").orderBy(number)) - 1
    return salted.withColumn("within", within).join(shifts, [size, "salt"]).withColumn("rank", F.col("shift") + F.col("within")).drop("salt", "shift", "within")


class Sweep:
    """Class sizes of the unplaced pieces and of the open gaps, and the rounds over them."""

    def __init__(self, lengths: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        self.taken = np.zeros(capacity + 1, np.int64)
        self.gaps = np.zeros(capacity + 1, np.int64)
        self.opened = 0
        for length, n in lengths.items():
            self.left[length] = n

    def shortest(self) -> int:
        """Length of the shortest unplaced piece, 0 if all are placed."""
        some = np.flatnonzero(self.left)
        return int(some[0]) if len(some) else 0

    def _give(self, length: int, gap: int, most: int) -> tuple[int, int]:
        """Pieces of a class that go to ``most`` gaps of one size at most, and the gaps they need."""
        each = gap // length
        n = int(min(self.left[length], most * each))
        self.left[length] -= n
        self.taken[length] += n
        return n, -(-n // each)

    def round(self) -> list[tuple[int, int, int, int, int, int]]:
        """One sweep: (length, first rank, pieces, pieces per gap, gap, first rank of the gaps); gap 0 is a new sequence."""
        moves, free, next_gap = [], self.gaps.copy(), np.zeros(self.capacity + 1, np.int64)
        left_over = np.zeros(self.capacity + 1, np.int64)

        def place(length: int, gap: int, most: int, first: int, new: bool) -> int:
            rank = int(self.taken[length])
            n, used = self._give(length, gap, most)
            each = gap // length
            moves.append((length, rank, n, each, 0 if new else gap, first))
            left_over[gap - each * length] += n // each
            if n % each:
                left_over[gap - (n % each) * length] += 1
            return used

        for length in np.flatnonzero(self.left)[::-1].tolist():
            for gap in (length + np.flatnonzero(free[length:])).tolist():
                if not self.left[length]:
                    break
                used = place(length, gap, int(free[gap]), int(next_gap[gap]), False)
                free[gap] -= used
                next_gap[gap] += used
            if self.left[length] and 2 * length > self.capacity:
                self.opened += place(length, self.capacity, int(self.left[length]), self.opened, True)
        if not moves:
            sizes = np.arange(self.capacity + 1)
            new = int(-(-(self.left * sizes).sum() // self.capacity))
            for length in np.flatnonzero(self.left)[::-1].tolist():
                if new:
                    # One piece for each of them; the rest of the sequence stays open for the next round.
                    n = int(min(new, self.left[length]))
                    moves.append((length, int(self.taken[length]), n, 1, 0, self.opened))
                    self.left[length] -= n
                    self.taken[length] += n
                    left_over[self.capacity - length] += n
                    self.opened += n
                    new -= n
        self.gaps = free + left_over
        self.gaps[: max(self.shortest(), 1)] = 0
        return moves


MOVE = "length long, first long, n long, each long, gap long, first_gap long"


def pack(spark: SparkSession, found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (with length) with sequence_id and offset."""
    items = written(spark, found.withColumn("__item", F.monotonically_increasing_id()), "pieces")
    waiting = written(spark, ranked(items.select("__item", "length"), "length", "__item"), "ranked")
    sweep = Sweep({r["length"]: r["count"] for r in items.groupBy("length").count().collect()}, capacity)
    gaps = spark.createDataFrame([], "sequence_id long, gap long")
    placed = spark.createDataFrame([], "__item long, sequence_id long, offset long")
    while sweep.shortest():
        # At most two moves for each length and gap size.
        moves = F.broadcast(spark.createDataFrame(sweep.round(), MOVE))
        matched = waiting.join(moves, "length").where("rank >= first and rank < first + n").select(
            "__item", "length", "gap",
            (F.col("first_gap") + F.expr("(rank - first) div each")).alias("place"),
            F.expr("(rank - first) % each * length").alias("shift"),
        )
        matched = written(spark, matched, "matched")
        numbered = ranked(gaps, "gap", "sequence_id").withColumnRenamed("rank", "place")
        filled = (
            matched.where("gap > 0")
            .join(numbered, ["gap", "place"])
            .select("__item", "length", "sequence_id", "gap", (capacity - F.col("gap") + F.col("shift")).alias("offset"))
            .union(matched.where("gap = 0").select("__item", "length", F.col("place").alias("sequence_id"), F.lit(capacity).cast("long"), F.col("shift").alias("offset")))
        )
        filled = written(spark, filled, "placed")
        used = filled.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.max("gap").alias("gap"))
        rest = (
            gaps.join(used.select("sequence_id"), "sequence_id", "left_anti")
            .union(used.select("sequence_id", F.col("gap") - F.col("used")))
            .where(F.col("gap") >= max(sweep.shortest(), 1))
        )
        gaps = written(spark, rest, "gaps")
        placed = placed.union(filled.select("__item", "sequence_id", "offset"))
    return items.join(placed, "__item").drop("__item")


def sequences(spark: SparkSession, docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    return pack(spark, pieces(docs, path, capacity), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
