"""Connected components and sparse linking of buckets, as joins and aggregates over tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrygrid.llm.bayes import confirmed, survivors
from carrygrid.llm.store import drop_table, written
from carrygrid.llm.words import mix


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component) of every id that ``links`` (a, b) names; component is the smallest id reachable.

    Each round takes the smallest label among the neighbours and then the label
    of that label, so labels travel along doubling distances. Every round is a
    written table: a lost executor costs no more than one round. A hub is only
    many rows of a join key, which is split, and of a minimum, which is halved
    before the shuffle. No links give no rows.
    """
    edges = written(
        spark,
        links.select(F.col("a").alias("id"), F.col("b").alias("other"))
        .union(links.select(F.col("b"), F.col("a")))
        .where("id <> other")
        .distinct(),
        "edges",
    )
    labels = written(spark, edges.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("component")), "labels")
    while True:
        heard = (
            edges.join(labels.withColumnRenamed("id", "other"), "other")
            .groupBy("id")
            .agg(F.min("component").alias("heard"))
        )
        near = labels.join(heard, "id").select(
            "id", F.least("component", "heard").alias("component"), F.col("component").alias("old")
        )
        near = written(spark, near, "labels")
        far = near.select(F.col("id").alias("component"), F.col("component").alias("further"))
        jumped = written(
            spark,
            near.join(far, "component").select("id", F.col("further").alias("component"), (F.col("further") != F.col("old")).alias("moved")),
            "labels",
        )
        drop_table(spark, labels)
        drop_table(spark, near)
        labels = jumped.select("id", "component")
        if jumped.where("moved").isEmpty():
            drop_table(spark, edges)
            return labels


def buckets(rows: DataFrame) -> DataFrame:
    """(key, id, n, leader) of the rows (key, id, n) whose key occurs with two ids or more.

    The leader is the smallest id of the bucket. The bucket is never gathered:
    its bounds are a minimum and a maximum, and a hot key of the join is split.
    """
    shared = (
        rows.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last").drop("last")
    )
    return rows.join(shared, "key")


class Filter:
    """Which 64-bit ids are wanted, as a bitmap of a fixed size; it may let others pass, never loses one.

    Its size does not grow with the ids. With far more ids than bits it lets
    everything pass, and the join that follows does the work alone.
    """

    BITS = 25

    def __init__(self, ids: DataFrame) -> None:
        name, bits = ids.columns[0], self.BITS

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                value = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                place = (mix(value) >> np.uint64(64 - bits)).astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([pa.array(place)], names=["place"])

        found = (
            ids.select(F.col(name).cast("long"))
            .mapInArrow(places, "place long")
            .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
            .collect()
        )
        self.bits = np.zeros(1 << (bits - 3), np.uint8)
        for row in found:
            at = (row.bucket - 1) * 4096
            self.bits[at : at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        place = mix(ids.view(np.uint64)) >> np.uint64(64 - self.BITS)
        return (self.bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


BLOCK_ROWS, BLOCK_SHINGLES = 400, 400_000
GROUP_ROWS = 20_000


def link_buckets(
    spark: SparkSession,
    members: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    prune: Callable[[DataFrame], DataFrame] | None = None,
    signature: DataFrame | None = None,
) -> DataFrame:
    """(id, component) under all links between ids of one bucket: Jaccard similarity of 0.75 or more.

    ``members`` (key, id, n, leader) comes from ``buckets``, ``sets_of`` gives
    (id, shingles) of wanted ids at least, ``prune`` drops unlikely pairs (a, b),
    ``signature`` has (id, signature).

    First every member is compared with the leader of its bucket: as many pairs
    as rows. Buckets whose other members all are in one component then are done.
    The rest is compared in blocks: each group is dealt into blocks of bounded
    size, each pair of blocks is one small task, which compares all pairs of
    different components and returns a spanning forest of the links. So no
    pairs within a group are written out, no group is gathered, and no link
    that matters to the components is missed. A group is what hangs together by
    shared buckets or, where that has over ``GROUP_ROWS`` ids, a bucket.
    """
    first = written(
        spark, members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct(), "pairs"
    )
    likely = written(spark, prune(first), "likely") if prune else first
    ids = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    links = written(spark, confirmed(likely, written(spark, sets_of(ids), "sets")), "links")
    labels = components(spark, links)
    marked = members.join(labels, "id", "left").select(
        "key", "id", "n", "leader", F.coalesce("component", "id").alias("component")
    )
    others = F.when(F.col("id") != F.col("leader"), F.col("component"))
    open_keys = marked.groupBy("key").agg(F.min(others).alias("x"), F.max(others).alias("y")).where("x < y").select("key")
    rest = written(spark, marked.join(open_keys, "key").drop("leader"), "members")
    if rest.isEmpty():
        return labels
    more = written(spark, _compare_in_blocks(spark, rest, sets_of, signature), "links")
    return components(spark, links.union(more))


def _compare_in_blocks(
    spark: SparkSession, rest: DataFrame, sets_of: Callable[[DataFrame], DataFrame], signature: DataFrame | None
) -> DataFrame:
    # An id is tied to the smallest of the first ids of its buckets, and so are those first ids: few links, same components.
    heads = written(spark, rest.join(rest.groupBy("key").agg(F.min("id").alias("head")), "key").select("id", "head").distinct(), "heads")
    tops = heads.groupBy("id").agg(F.min("head").alias("top"))
    tied = tops.select(F.col("id").alias("a"), F.col("top").alias("b"))
    hanging = components(spark, tied.union(heads.join(tops, "id").select(F.col("head").alias("a"), F.col("top").alias("b"))).distinct())
    sizes = hanging.groupBy("component").count()
    small = hanging.join(sizes, "component").select("id", F.when(F.col("count") <= GROUP_ROWS, F.col("component")).alias("tied"))
    # One row for each id of a group; a large group falls into its buckets.
    dealt = written(
        spark,
        rest.join(small, "id")
        .select(F.struct(F.col("tied").isNull().alias("bucket"), F.coalesce("tied", "key").alias("of")).alias("group"), "id", "n", "component")
        .distinct(),
        "groups",
    )
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    counted = dealt.groupBy("group").agg(blocks.alias("blocks"))
    values = written(spark, sets_of(dealt.select("id").distinct()), "sets")
    if signature is not None:
        values = values.join(signature, "id")
    else:
        values = values.withColumn("signature", F.lit(None).cast("binary"))
    rows = (
        dealt.join(counted, "group")
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "own", "id", "component")
        .join(values, "id")
        .select("task", "own", "id", "component", "signature", "shingles")
    )
    return rows.groupBy("task").applyInArrow(_forest, "a long, b long")


def _forest(group: pa.Table) -> pa.Table:
    """A spanning forest of the links between different components of one pair of blocks."""
    ids = group.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    sets = group.column("shingles").to_pylist()
    signed = group.column("signature").to_pylist()
    parent = {int(c): int(c) for c in group.column("component").to_numpy()}
    component = group.column("component").to_numpy()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left = [i for i in order]
    pairs = [(i, j) for i, j in _likely_pairs(np.array(left), component, signed)]
    common = shared_counts([np.frombuffer(s, np.uint64) for s in sets], pairs)
    sizes = [len(s) // 8 for s in sets]
    a, b = [], []
    for (i, j), both in zip(pairs, common):
        if 100 * both >= 75 * (sizes[i] + sizes[j] - both):
            x, y = root(int(component[i])), root(int(component[j]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                a.append(int(ids[i]))
                b.append(int(ids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _likely_pairs(order: np.ndarray, component: np.ndarray, signed: list) -> Iterator[tuple[int, int]]:
    rows = np.frombuffer(b"".join(signed), np.uint16).reshape(len(signed), -1) if signed and signed[0] is not None else None
    for at, i in enumerate(order[:-1]):
        others = order[at + 1 :]
        others = others[component[others] != component[i]]
        if rows is not None:
            others = others[survivors(np.broadcast_to(rows[i], (len(others), rows.shape[1])), rows[others])]
        for j in others:
            yield int(i), int(j)


def shared_counts(sets: list[np.ndarray], pairs: list[tuple[int, int]]) -> list[int]:
    """Sizes of the intersections of the pairs, by products of incidence columns."""
    if len(pairs) < 4 * len(sets):
        out = []
        for i, j in pairs:
            both = np.concatenate((sets[i], sets[j]))
            both.sort()
            out.append(int((both[1:] == both[:-1]).sum()))
        return out
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(values), 4096):
        a, b = np.searchsorted(place, (at, at + 4096))
        some = np.zeros((len(sets), 4096), np.float32)
        some[owner[a:b], place[a:b] - at] = 1
        total += some @ some.T
    return [int(total[i, j]) for i, j in pairs]
