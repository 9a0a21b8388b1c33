from __future__ import annotations

from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row

from carrygrid.llm import bayes, components, near_dup, passages, vectors
from tests.llm import brute
from tests.llm.conftest import PASSAGE


def test_near_duplicates_equal_brute_force(spark, docs):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    found = near_dup.near_duplicates(spark, docs).collect()
    assert {r.doc_id: r.component_id for r in found} == brute.near_duplicates(texts)
    assert all(r.n_shingles == len(brute.shingles(texts[r.doc_id])) for r in found)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_on_odd_rows(spark, odd, none):
    found = near_dup.near_duplicates(spark, odd).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == odd.count()
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept for i in (1, 2, 3))
    assert {by_id[i].component_id for i in (4, 5, 6)} == {4}
    assert by_id[8].component_id == 7
    assert all(r.kept for r in found if r.doc_id is None)
    assert near_dup.near_duplicates(spark, none).count() == 0
    kept = near_dup.keep_one_of_each(spark, odd)
    assert kept.columns == odd.columns
    assert not {5, 6, 8} & {r.doc_id for r in kept.collect()}


def test_a_group_that_no_leader_links_is_found(spark):
    """A chain of edits: most pairs are no links, yet all are one component."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(f"new{k}" if k < 2 * i else w for k, w in enumerate(words))))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dup.near_duplicates(spark, texts).collect()
    assert {r.doc_id: r.component_id for r in found} == brute.near_duplicates(dict(rows))


def test_blocks_of_any_size_give_the_same(spark, docs, monkeypatch):
    whole = {tuple(r) for r in near_dup.near_duplicates(spark, docs).collect()}
    monkeypatch.setattr(components, "BLOCK_ROWS", 3)
    monkeypatch.setattr(components, "GROUP_ROWS", 4)
    assert {tuple(r) for r in near_dup.near_duplicates(spark, docs).collect()} == whole


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(0)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(900, 950)] + [tuple(map(int, rng.integers(2000, 2100, 2))) for _ in range(70)]
    found = components.components(spark, spark.createDataFrame(links, "a long, b long")).collect()
    ids = {x for p in links if p[0] != p[1] for x in p}
    assert {r.id: r.component for r in found} == brute.components(ids, [p for p in links if p[0] != p[1]])


def test_posterior_bound():
    assert bayes.fewest_matches(40) < 30
    assert bayes.fewest_matches(160) / 160 > bayes.fewest_matches(40) / 40
    same = np.ones((3, 160), np.uint16)
    other = same.copy()
    other[1] = 0
    assert bayes.survivors(same, other).tolist() == [0, 2]


def test_filter_loses_no_id(spark):
    ids = np.random.default_rng(1).integers(-(2**62), 2**62, 2000)
    keep = components.Filter(spark.createDataFrame([(int(i),) for i in ids], "id long"))
    assert keep(ids).all()
    assert keep(np.arange(10_000, dtype=np.int64)).mean() < 0.01


def test_passages(spark, odd, none):
    found = passages.repeats(spark, odd).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == {(8, 7), (10, 9)}
    words = [r.n_words for r in found if r.doc_id == 10]
    assert min(words) >= passages.LEAST_RUN
    cut = passages.without_repeats(spark, odd)
    assert cut.columns == odd.columns and cut.dtypes == odd.dtypes
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert 8 not in texts and PASSAGE in texts[9] and PASSAGE not in texts[10]
    assert texts[10].startswith("The tenth begins otherwise") and texts[10].endswith("and ends otherwise")
    assert texts[1] is None and texts[2] == ""
    assert passages.repeats(spark, none).count() == 0


def test_no_long_passage_stays_twice(spark, docs):
    """Fifty-one words never occur in two documents afterwards, but for runs of one repeated word."""
    cut = passages.without_repeats(spark, docs).select("doc_id", "text").collect()
    changed = {r.doc_id for r in passages.repeats(spark, docs).select("doc_id").collect()}
    before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert all(r.text == before[r.doc_id] for r in cut if r.doc_id not in changed)
    first: dict = {}
    for r in sorted(cut):
        w = r.text.lower().split()
        for i in range(len(w) - 50):
            window = tuple(w[i : i + 51])
            if len(set(window)) > 10:
                assert first.setdefault(window, r.doc_id) == r.doc_id


def test_near_duplicate_paragraphs(spark):
    line = [f"p{i}" for i in range(80)]
    near = line.copy()
    near[40] = "other"
    rows = [(1, "first line\n" + " ".join(line)), (2, " ".join(near) + "\nlast line"), (3, " ".join(f"q{i}" for i in range(80)))]
    found = passages.repeated_paragraphs(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert found == [Row(doc_id=2, first_doc_id=1, start=0, end=len(" ".join(near)), n_words=80)]


@pytest.mark.parametrize("tile", [7, 6000])
def test_vectors_equal_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 32))
    own = np.concatenate([centres[rng.integers(0, 12, 60)] + 0.25 * rng.standard_normal((60, 32)), rng.standard_normal((40, 32))]).astype("f4")
    own[70] = own[3]
    own[71] = -own[3]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(own)]
    rows += [(200, None, 0), (201, [0.0] * 32, 0), (202, [float("nan")] * 32, 0), (203, [1.0, None], 0), (204, [], 0), (205, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    found = vectors.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tile=tile).collect()
    unit = own.astype(float) / np.linalg.norm(own.astype(float), axis=1, keepdims=True)
    links = [(i, j) for i in range(100) for j in range(i) if unit[i] @ unit[j] >= 0.9]
    assert len(links) > 20
    expected = brute.components(range(100), links)
    by_id = {r.vec_id: r for r in found}
    assert len(found) == len(rows)
    for i in range(100):
        assert by_id[i].component_id == expected[i]
        assert by_id[i].n_links == sum(i in p for p in links)
    assert all(by_id[i].n_links == 0 and by_id[i].kept for i in (200, 201, 202, 203, 204, 205))
    assert by_id[None].kept
    assert vectors.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_are_not_stored_for_each_partner(spark, monkeypatch):
    """Shuffles and tables of many tiles hold a few times the input; many near copies and cosines next to the limit are as by brute force."""
    rng = np.random.default_rng(5)
    own = rng.standard_normal((900, 64))
    own[:200] = own[0] + 0.05 * rng.standard_normal((200, 64))
    for i in range(200, 400, 2):  # the next row at a cosine of 0.9 give or take up to 1e-4
        unit = own[i] / np.linalg.norm(own[i])
        across = own[i + 1] - (own[i + 1] @ unit) * unit
        angle = np.arccos(0.9 + (i - 300) * 1e-6)
        own[i + 1] = np.cos(angle) * unit + np.sin(angle) * across / np.linalg.norm(across)
    own = own.astype("f4")
    places = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), spark.conf.get("spark.checkpoint.dir")]

    def on_disk():
        return sum(f.stat().st_size for p in places for f in Path(p).rglob("*") if f.suffix in (".data", ".parquet") and f.exists())

    before, most, write = on_disk(), [0], vectors.written

    def written(*args):
        table = write(*args)
        most[0] = max(most[0], on_disk() - before)
        return table

    monkeypatch.setattr(vectors, "written", written)
    found = vectors.near_vectors(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id long, embedding array<float>"), tile=7).collect()
    assert most[0] < 20 * own.nbytes
    unit = own.astype(float) / np.linalg.norm(own.astype(float), axis=1, keepdims=True)
    links = [(i, j) for i in range(900) for j in range(i) if unit[i] @ unit[j] >= 0.9]
    assert 199 * 100 < len(links) < 199 * 100 + 99
    expected, count = brute.components(range(900), links), Counter(i for p in links for i in p)
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == {(i, count[i], expected[i]) for i in range(900)}


def test_tiles_may_lie_in_several_partitions(spark, monkeypatch):
    rng = np.random.default_rng(6)
    own = (rng.standard_normal((8, 20))[rng.integers(0, 8, 160)] + 0.3 * rng.standard_normal((160, 20))).astype("f4")
    pairs = vectors.partition_pairs
    monkeypatch.setattr(vectors, "SLICE_BYTES", 400)
    monkeypatch.setattr(vectors, "partition_pairs", lambda packed: pairs(packed.repartition(3, "tile", "slice")))
    found = vectors.near_vectors(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "vec_id long, embedding array<float>"), tile=60).collect()
    unit = own.astype(float) / np.linalg.norm(own.astype(float), axis=1, keepdims=True)
    links = [(i, j) for i in range(160) for j in range(i) if unit[i] @ unit[j] >= 0.9]
    assert len(links) > 400
    expected, count = brute.components(range(160), links), Counter(i for p in links for i in p)
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == {(i, count[i], expected[i]) for i in range(160)}


def test_runs_stand_in_one_other_document(spark):
    """Short phrases of different documents in a row are no repeated passage; spans stay with the row they were found in."""
    def words(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    phrases = [words(f"phrase{i}x", 20) for i in range(6)]
    rows = [(i, f"{words(f'a{i}x', 20)} {p} {words(f'b{i}x', 20)}") for i, p in enumerate(phrases)]
    rows += [(50, " ".join(phrases))]
    whole = words("whole", 60)
    rows += [(60, f"{words('c', 9)} {whole} {words('d', 9)}"), (61, f"{words('e', 30)} {whole} {words('f', 9)}"), (61, words("ü", 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeats(spark, docs).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == {(61, 60)}
    left = passages.without_repeats(spark, docs.selectExpr("*", "cast(length(text) as long) n_chars")).collect()
    texts = sorted(r.text for r in left if r.doc_id == 61)
    assert texts[1] == words("ü", 80) and "whole30" not in texts[0] and "e29" in texts[0]
    assert next(r.text for r in left if r.doc_id == 50) == " ".join(phrases)


def test_passages_of_any_64_bit_id(spark):
    passage = " ".join(f"passage{i}" for i in range(70))
    rows = [(1 << 40, f"one\n{passage}\nend"), ((1 << 62) + 5, f"two\n{passage}\nother"), (-(1 << 61), "nothing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeats(spark, docs).collect()
    assert {(r.doc_id, r.first_doc_id) for r in found} == {((1 << 62) + 5, 1 << 40)}


def test_doubles_are_compared_as_doubles(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e200, 2e200]), (3, [2e39, 4.00001e39]), (4, [1e-200, -5e-200]), (5, None), (6, [0.0, 0.0])]
    found = vectors.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (0, 6)}
