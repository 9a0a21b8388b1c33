"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine c have the squared distance 2 - 2c. They are rotated and
split into blocks; if two vectors lie within the budget as a whole, they do in one of
the blocks within its share. Each block is range-joined: its vectors fall into cells
around centres. For two cells, rows are sorted along the line through the centres and
only those are compared whose places on it differ by no more than the share allows;
a pair of vectors counts in the first block that has it.

No vector is moved once per partner. A block's cells are packed into tiles, one row of
a table each, and every pair of tiles is read by a task from that table (a product
of its partitions, without a shuffle). So disk grows with the rows. One block is
done after the other, and its tiles are dropped before the next.

Coordinates in tiles are steps of 1 / ``STEPS``. That decides all pairs but those within
the rounding of the limit; these are given out and verified, as all were, by the
cosine of the given numbers in double precision. Centres come from rows with small
hashes; they decide how much is compared, never what is found.

A task returns, for each of its vectors, the number of links and a representative of
what is linked with it, never pairs beyond those to be verified. Equal vectors are one
class from the start, so copies are neither paired nor moved.

Vectors that are null, empty, zero or hold null or non-finite numbers link with
nothing, nor do those of different lengths with each other. A row with a null
id is not compared and counts as kept. Rows that repeat an id with an equal vector
count each; with different vectors they are one node, whose links add up. An
empty table gives no rows. Other columns, label among them, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from carrygrid.llm.components import components
from carrygrid.llm.store import drop_table, settings, written

COSINE = 0.9
BLOCK = 16  # coordinates of a block
TILE = 6000  # rows of a tile, more in large tables
TILE_BYTES = 8 << 20  # of a large tile
SLICE_BYTES = 256 << 10  # of a row of the table of tiles
PART_BYTES = 32 << 20  # of a partition of it; a task holds two
ROUGH = 1e-5  # more than single precision errs
STEPS = 32767  # of a coordinate between 0 and 1
CELLS = 4096  # centres of a block at most
SAMPLE = 1 << 21  # numbers on the driver that centres are made from
CHUNK = 128  # rows compared at once
PENDING = 200_000  # links that wait to be counted


def rotation(size: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def block_bounds(size: int) -> np.ndarray:
    return np.linspace(0, size, -(-size // BLOCK) + 1).astype(int)


def reach(size: int, cosine: float) -> tuple[float, float]:
    """Distances of vectors in steps within which all are linked, and beyond which none are."""
    whole, rounding = np.sqrt(2 - 2 * cosine), np.sqrt(size) / STEPS + 1e-9
    return max(whole - rounding, 0) * STEPS, (whole + rounding) * STEPS


def share(size: int, cosine: float) -> float:
    """Squared distance, between 0 and 1 a coordinate, that one of the blocks must keep to."""
    return (reach(size, cosine)[1] / STEPS) ** 2 / (len(block_bounds(size)) - 1)


FLOAT, DOUBLE = "<f4", "<f8"


def units(data: list[bytes], kind: str = FLOAT) -> np.ndarray:
    rows = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    if kind == DOUBLE:  # squares of very large or small numbers do not fit
        rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def _read(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, data, keys = [], [], []
        for number, vector in zip(batch.column(0), batch.column(1)):
            raw = None
            if number.is_valid and vector.is_valid and len(vector) and not vector.values.null_count:
                row = vector.values.to_numpy(zero_copy_only=False).astype(kind)
                if np.isfinite(row).all() and row.any():
                    raw = (row + row.dtype.type(0)).tobytes()  # -0 is 0
            ids.append(number.as_py())
            data.append(raw)
            keys.append(hashlib.blake2b(raw, digest_size=16).digest() if raw is not None else None)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary()), pa.array(keys, pa.binary())], names=["id", "data", "same"])


def _nearest(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre next to each row."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(part[at : at + 1024] @ centres.T - half).argmax(axis=1) for at in range(0, len(part), 1024)] or [np.zeros(0, int)])


def centres_of(classes: DataFrame, counts: dict[int, int], kind: str = FLOAT) -> dict[int, list[np.ndarray]]:
    """Centres by size and block: about half the root of the rows, so a cell has twice the root."""
    some = min(1.0, SAMPLE / max(1, sum(size * n for size, n in counts.items())))
    rows = classes if some == 1 else classes.where(F.col("same") < F.lit(int(some * 2**64).to_bytes(8)))
    by_size: dict[int, list[bytes]] = {}
    for _, data in sorted((bytes(r.same), bytes(r.data)) for r in rows.select("same", "data").collect()):
        by_size.setdefault(len(data) // int(kind[-1]), []).append(data)
    found = {}
    for size, n in counts.items():
        data, bounds = by_size.get(size, []), block_bounds(size)
        spread = units(data, kind) @ rotation(size).T if data else np.zeros((1, size))
        wanted = max(1, min(round(np.sqrt(n) / 2), CELLS, SAMPLE // size, len(spread)))
        found[size] = []
        for low, high in zip(bounds[:-1], bounds[1:]):
            part = spread[:, low:high].astype(np.float32)
            centres = part[:wanted]
            for _ in range(2):
                own = _nearest(part, centres)
                total = np.zeros_like(centres)
                np.add.at(total, own, part)
                members = np.bincount(own, minlength=wanted)[:, None]
                centres = np.where(members > 0, total / np.maximum(members, 1), centres).astype(np.float32)
            found[size].append(centres)
    return found


TURNED = "size int, id long, weight long, same binary, data binary, cells array<int>"


def turned(classes: DataFrame, centres: dict[int, list[np.ndarray]], kind: str = FLOAT) -> DataFrame:
    """The classes (id, weight, same, data) as rotated units in steps, with their cell in each block."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            data = batch.column(3).to_pylist()
            sizes = np.array([len(d) // int(kind[-1]) for d in data])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                if size not in turns:
                    turns[size] = rotation(size)
                steps = np.rint(units([data[i] for i in rows], kind) @ turns[size].T * STEPS).astype("<i2")
                bounds = block_bounds(size)
                part = steps.astype(np.float32) / np.float32(STEPS)
                cells = [_nearest(part[:, low:high], c) for low, high, c in zip(bounds[:-1], bounds[1:], centres[size])]
                lists = pa.ListArray.from_arrays(np.arange(0, len(rows) * len(cells) + 1, len(cells), dtype=np.int32), np.stack(cells, 1).astype(np.int32).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), size, np.int32)), *batch.take(pa.array(rows)).columns[:3],
                        pa.array([row.tobytes() for row in steps], pa.binary()), lists,
                    ],
                    names=["size", "id", "weight", "same", "data", "cells"],
                )

    return classes.select("id", "weight", "same", "data").mapInArrow(place, TURNED)


def tile_plan(members: dict[tuple[int, int], int], tile: int = TILE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """First tile and number of tiles of each cell, by size, from the rows of each (size, cell) of a block.

    Small cells share a tile, a large one is dealt into several.
    """
    plan, at = {}, 0
    for size in sorted({s for s, _ in members}):
        cells = sorted(c for s, c in members if s == size)
        n = sum(members[size, c] for c in cells)
        most = max(1, min(max(min(tile, max(n // 16, 64)), n // 64), TILE_BYTES // (2 * size + 32)))
        first, pieces, left = np.zeros(cells[-1] + 1, np.int64), np.ones(cells[-1] + 1, np.int64), 0
        for cell in cells:
            rows = members[size, cell]
            pieces[cell] = -(-rows // most)
            if pieces[cell] > 1 or rows > left:  # a new tile
                first[cell], at, left = at, at + pieces[cell], most - rows
            else:
                first[cell], left = at - 1, left - rows
        plan[size] = first, pieces
    return plan


DEALT = "tile int, size int, cell int, id long, weight long, same binary, data binary"
COLUMNS = ("cells", "ids", "weights", "same", "data")
TILES = "tile int, size int, slice int, " + ", ".join(f"{c} binary" for c in COLUMNS)


def tiles(placed: DataFrame, block: int, plan: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The vectors of each tile of a block by cell, in slices of columns of fixed width."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, cells = (batch.column(i).to_numpy() for i in range(2))
            hashes = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<u4")[::4].astype(np.int64)
            tile = np.zeros(len(sizes), np.int32)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                first, pieces = (x[cells[rows]] for x in plan[size])
                tile[rows] = first + hashes[rows] % pieces
            yield pa.RecordBatch.from_arrays([pa.array(tile), *batch.columns], names=["tile", *batch.schema.names])

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        group = group.take(pa.array(np.lexsort((group.column("id").to_numpy(), group.column("cell").to_numpy()))))
        tile, size = (group.column(c)[0].as_py() for c in ("tile", "size"))
        rows = max(1, SLICE_BYTES // (2 * size + 36))
        packed: dict[str, list] = {name: [] for name in ("tile", "size", "slice", *COLUMNS)}
        for number, at in enumerate(range(0, group.num_rows, rows)):
            some = group.slice(at, rows)
            numbers = (some.column(c).to_numpy().astype(kind).tobytes() for c, kind in (("cell", "<i4"), ("id", "<i8"), ("weight", "<i8")))
            texts = (b"".join(some.column(c).to_pylist()) for c in ("same", "data"))
            for name, value in zip(packed, (tile, size, number, *numbers, *texts)):
                packed[name].append(value)
        return pa.table({name: pa.array(v, pa.binary() if name in COLUMNS else pa.int32()) for name, v in packed.items()})

    own = placed.where(F.size("cells") > block).select("size", F.col("cells")[block].alias("cell"), "id", "weight", "same", "data")
    return own.mapInArrow(deal, DEALT).groupBy("tile").applyInArrow(pack, TILES)


def partition_pairs(packed: DataFrame) -> DataFrame:
    """For every pair of partitions, as one partition: each slice of the left one once (a_) and each of the right one once (b_)."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    left, right = (packed.withColumn("first", first).toDF(*(f"{side}_{c}" for c in (*packed.columns, "first"))) for side in "ab")
    both = left.join(right.hint("shuffle_replicate_nl"), F.col("a_first") | F.col("b_first"))
    # Of all pairs of slices only those with the first one of either side pass, and bring the other.
    return both.select(*(F.when(F.col(f"{other}_first"), F.col(f"{side}_{c}")).alias(f"{side}_{c}") for side, other in ("ab", "ba") for c in packed.columns))


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each component of the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Links:
    """Weights linked with each row, and the smallest row linked with it; links are counted in portions and not kept."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights, self.count, self.label = weights, np.zeros(len(weights)), np.arange(len(weights))
        self.a, self.b, self.waiting = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.waiting += len(a)
        if self.waiting > PENDING:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            a, b, n = np.concatenate(self.a), np.concatenate(self.b), len(self.count)
            self.count += np.bincount(a, self.weights[b], n) + np.bincount(b, self.weights[a], n)
            self.tie(a, b)
        self.a, self.b, self.waiting = [], [], 0

    def tie(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.label[a], self.label[b]
        if (new := a != b).any():
            self.label = _labels(len(self.label), a[new], b[new])[self.label]


    def add_all(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        """The links marked between the rows a and b."""
        self.count[a] += linked @ self.weights[b].astype(np.float64)
        self.count[b] += self.weights[a].astype(np.float64) @ linked
        i, j = np.nonzero(linked & (self.label[a][:, None] != self.label[b]))
        if len(i):
            self.tie(a[i], b[j])


class _Tile:
    """Slices of a tile in memory, with one block's coordinates as rows and columns of a product."""

    def __init__(self, size: int, slices: dict[int, dict], block: int) -> None:
        self.size, self.slices = size, sorted(slices)
        cells, self.ids, self.weights, same, steps = (
            np.concatenate([np.frombuffer(slices[n][c], kind) for n in self.slices])
            for c, kind in zip(COLUMNS, ("<i4", "<i8", "<i8", np.uint8, "<i2"))
        )
        self.same, self.steps = same.reshape(-1, 16), steps.reshape(len(self.ids), -1)
        self.cells, starts = np.unique(cells, return_index=True)
        self.ends = [*starts.tolist(), len(self.ids)]
        # One product in single precision gives minus half the squared distance.
        part = self.of_block(slice(None), block)
        half, ones = (part**2).sum(axis=1, keepdims=True) / 2, np.ones((len(self.ids), 1), np.float32)
        self.rows, self.columns = np.hstack((part, -half, ones)), np.hstack((part, ones, -half))
        self.part = self.rows[:, : part.shape[1]]

    def of_block(self, rows: slice | np.ndarray, block: int) -> np.ndarray:
        low, high = block_bounds(self.size)[block : block + 2]
        return self.steps[rows, low:high].astype(np.float32) / np.float32(STEPS)

    def whole(self, rows: np.ndarray) -> np.ndarray:
        return self.steps[rows].astype(np.float32) / np.float32(STEPS)


def _half_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Half the squared distances of all rows of x and y."""
    return (x**2).sum(axis=1)[:, None] / 2 + (y**2).sum(axis=1) / 2 - x @ y.T


def _compare(a: _Tile, b: _Tile, block: int, centres: np.ndarray, cosine: float) -> pa.RecordBatch:
    inner, size, bounds = a is b, a.size, block_bounds(a.size)
    low, high = reach(size, cosine)
    budget = share(size, cosine)
    limit, width = budget * STEPS**2, np.float32(np.sqrt(budget) + ROUGH)
    least = np.float32(-budget / 2 - ROUGH)
    rough = ROUGH * max(1, size / 64)
    offset = 0 if inner else len(a.ids)
    ids = a.ids if inner else np.concatenate((a.ids, b.ids))
    links = _Links(a.weights if inner else np.concatenate((a.weights, b.weights)))
    unsure = []

    def look(x: np.ndarray, y: np.ndarray) -> None:
        for cut in range(0, len(x), 20_000):
            p, q = x[cut : cut + 20_000], y[cut : cut + 20_000]
            apart = np.add.reduceat((a.steps[p].astype(np.float64) - b.steps[q]) ** 2, bounds[:-1], axis=1)  # whole numbers: the same in every task
            new = (apart[:, block] <= limit) & ~(apart[:, :block] <= limit).any(axis=1)
            total = apart.sum(axis=1)
            sure = new & (total <= low**2)
            links.add(p[sure], q[sure] + offset)
            rest = new & ~sure & (total <= high**2)
            if rest.any():
                unsure.append((a.same[p[rest]], b.same[q[rest]]))

    def look_at_all(x: np.ndarray, y: np.ndarray, near: np.ndarray) -> None:
        """Of many candidates among the rows x and y, those that single precision decides."""
        found = near >= least
        if inner:
            found &= x[:, None] < y
        sure = near >= -budget / 2 + ROUGH
        for earlier in range(block):
            half = _half_apart(a.of_block(x, earlier), b.of_block(y, earlier))
            found &= half > budget / 2 - ROUGH
            sure &= half > budget / 2 + ROUGH
        if not found.any():
            return
        half = _half_apart(a.whole(x), b.whole(y))
        sure &= found & (half <= (low / STEPS) ** 2 / 2 - rough)
        if sure.any():
            links.add_all(x, y + offset, sure)
        i, j = np.nonzero(found & ~sure & (half <= (high / STEPS) ** 2 / 2 + rough))
        look(x[i], y[j])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def look_at_waiting(most: int = 0) -> None:
        if sum(len(p) for p, _ in waiting) > most:
            look(*(np.concatenate([pair[side] for pair in waiting]) for side in (0, 1)))
            waiting.clear()

    for i, cell in enumerate(a.cells):
        start, others = a.ends[i], range(i if inner else 0, len(b.cells))
        lines = centres[b.cells[others.start :]] - centres[cell]
        lines /= np.maximum(np.sqrt((lines**2).sum(axis=1, keepdims=True)), np.float32(1e-6))
        places = lines @ a.part[start : a.ends[i + 1]].T
        for k, j in enumerate(others):
            # Of points nearer than the width, the places on any line are.
            s, t, own = places[k], b.part[b.ends[j] : b.ends[j + 1]] @ lines[k], inner and i == j
            x, y = np.flatnonzero(s >= t.min() - width), np.flatnonzero(t <= s.max() + width)
            if not len(x) or not len(y):
                continue
            if not own:  # in a cell itself all places are 0
                x, y = x[np.argsort(-s[x])], y[np.argsort(t[y])]
            upto = np.searchsorted(t[y], s[x[::CHUNK]] + width, side="right").tolist()
            y = y[: upto[0]]
            rows, columns = a.rows[start:].take(x, axis=0), b.columns[b.ends[j] :].take(y, axis=0)
            x, y = x + start, y + b.ends[j]
            for at in range(0, len(x), CHUNK):
                some, last = x[at : at + CHUNK], upto[at // CHUNK]
                for over in range(at if own else 0, last, 32 * CHUNK):
                    partners = y[over : min(over + 32 * CHUNK, last)]
                    near = rows[at : at + CHUNK] @ columns[over : over + len(partners)].T
                    hits = np.flatnonzero(near >= least)
                    if not len(hits):
                        continue
                    if len(hits) > 1000 and 16 * len(hits) > near.size:
                        look_at_all(some, partners, near)
                        continue
                    p, q = np.divmod(hits, len(partners))
                    p, q = some[p], partners[q]
                    waiting.append((p[p < q], q[p < q]) if own else (p, q))
            look_at_waiting(PENDING)
    look_at_waiting()
    links.settle()
    linked = np.flatnonzero(links.count)
    left, right = (np.concatenate([np.zeros((0, 16), np.uint8), *(u[side] for u in unsure)]) for side in (0, 1))
    some, more = len(linked), len(left)
    numbers = [ids[linked], links.count[linked].astype(np.int64), ids[links.label[linked]]]
    return pa.RecordBatch.from_arrays(
        [
            *(pa.concat_arrays([pa.array(c, pa.int64()), pa.nulls(more, pa.int64())]) for c in numbers),
            *(pa.concat_arrays([pa.nulls(some, pa.binary()), pa.array([k.tobytes() for k in side], pa.binary())]) for side in (left, right)),
        ],
        names=["id", "links", "root", "x", "y"],
    )


Slices = dict[tuple[int, int], dict[int, dict]]  # columns by slice by (size, tile)
FOUND = "id long, links long, root long, x binary, y binary"


def comparer(cosine: float, block: int, centres: dict[int, np.ndarray]):  # noqa: ANN201
    """Of pairs of partitions: links and a representative by id, and pairs (x, y) of classes to be verified.

    Of two tiles the lower or, as often, the upper one is to be on the left, so that each pair counts once
    and no task is idle.
    """

    def pairs(left: Slices, right_slices: Slices) -> Iterator[tuple[_Tile, _Tile]]:
        right = {tile: _Tile(size, slices, block) for (size, tile), slices in sorted(right_slices.items())}
        for (size, tile), slices in sorted(left.items()):
            a = None
            for other, b in right.items():
                if b.size != size or (tile < other) != ((tile + other) % 2 == 1) and tile != other:
                    continue
                if tile == other and sorted(slices) == b.slices:
                    yield b, b
                elif tile == other:  # it lies in several partitions: slice by slice, each pair once
                    raw = right_slices[size, tile]
                    for x in sorted(slices):
                        for y in b.slices:
                            if x <= y:
                                c = _Tile(size, {x: slices[x]}, block)
                                yield c, c if x == y else _Tile(size, {y: raw[y]}, block)
                else:
                    a = a or _Tile(size, slices, block)
                    yield a, b

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[str, Slices] = {"a": {}, "b": {}}
        for batch in batches:
            for side, slices in sides.items():
                tile, size, number, *columns = (batch.column(batch.schema.get_field_index(f"{side}_{c}")) for c in ("tile", "size", "slice", *COLUMNS))
                for i in np.flatnonzero(tile.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    own = slices.setdefault((size[i].as_py(), tile[i].as_py()), {})
                    own[number[i].as_py()] = {name: c[i].as_buffer() for name, c in zip(COLUMNS, columns)}
        for a, b in pairs(sides["a"], sides["b"]):
            yield _compare(a, b, block, centres[a.size], cosine)

    return compare


def verified(unsure: DataFrame, classes: DataFrame, cosine: float, kind: str = FLOAT) -> DataFrame:
    """Of pairs (x, y) of classes those with the cosine of their numbers: (id, links, root) for either."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(d) for d in batch.column(2).to_pylist()])
            for size in np.unique(sizes).tolist():
                rows = batch.take(pa.array(np.flatnonzero(sizes == size)))
                x, y = (units(rows.column(c).to_pylist(), kind) for c in (2, 5))
                some = rows.filter(pa.array(np.einsum("ij,ij->i", x, y) >= cosine))
                a, n, _, b, m, _ = some.columns
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, b]), pa.concat_arrays([m, n]), pa.concat_arrays([a, a])], names=["id", "links", "root"])

    first, second = (classes.select(F.col("same").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("id", "weight", "data"))) for side in "xy")
    rows = unsure.select("x", "y").join(first, "x").join(second, "y").select(*(f"{side}_{c}" for side in "xy" for c in ("id", "weight", "data")))
    return rows.mapInArrow(verify, "id long, links long, root long")


# Files of a shuffle go when its table is written; partitions of tiles are few.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
WIDE = {"spark.sql.files.maxPartitionBytes": str(PART_BYTES)}


def near_vectors(spark: SparkSession, rows: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``rows`` (vec_id, embedding)."""
    # Single precision is kept as it is; all other numbers are read as doubles.
    single = isinstance(rows.schema["embedding"].dataType.elementType, FloatType)
    kind, name = (FLOAT, "float") if single else (DOUBLE, "double")
    chosen = rows.select("vec_id", F.col("embedding").cast(f"array<{name}>"))
    with settings(spark, LEAN):
        read = written(spark, chosen.mapInArrow(lambda batches: _read(batches, kind), "id long, data binary, same binary"), "vectors")
        classes = written(
            spark,
            read.where("same is not null").groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.min("data").alias("data")),
            "classes",
        )
        keys = written(spark, read.select("id", "same"), "keys")
        drop_table(spark, read)
        sizes = classes.groupBy(F.length("data").alias("bytes")).count().collect()
        counts = {r["bytes"] // int(kind[-1]): r["count"] for r in sizes}
        centres = centres_of(classes, counts, kind)
        placed = written(spark, turned(classes, centres, kind), "turned")
        members = placed.select("size", F.posexplode("cells").alias("block", "cell")).groupBy("size", "block", "cell").count().collect()
        found = []
        for block in range(max((len(c) for c in centres.values()), default=0)):
            plan = tile_plan({(r.size, r.cell): r["count"] for r in members if r.block == block}, tile)
            packed = written(spark, tiles(placed, block, plan), "tiles")
            own = {size: c[block] for size, c in centres.items() if block < len(c)}
            with settings(spark, WIDE):
                found.append(written(spark, partition_pairs(packed).mapInArrow(comparer(cosine, block, own), FOUND), "found"))
            drop_table(spark, packed)
        drop_table(spark, placed)
        together = reduce(DataFrame.union, found) if found else spark.createDataFrame([], FOUND)
        sure, unsure = together.where("id is not null").select("id", "links", "root"), together.where("x is not null")
        every = sure.union(written(spark, verified(unsure, classes, cosine, kind), "verified"))
        labels = components(spark, every.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = every.groupBy("id").agg(F.sum("links").alias("links"))
    named = (
        classes.select("same", "id", "weight")
        .join(links, "id", "left")
        .join(labels, "id", "left")
        .select("same", F.coalesce("component", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    )
    linked = keys.where("same is not null").join(named, "same").select("id", "n_links", "component_id")
    alone = keys.where("same is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
