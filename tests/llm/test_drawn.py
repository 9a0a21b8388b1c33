"""Conversation repair, importance resampling and fingerprints."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from carrygrid.llm import dialogue, importance, winnowing
from carrygrid.llm.words import chunks, no_letter
from tests.llm.conftest import SF
from tests.oracle_check import compare, connect

TURNS = "conv_id long, turn long, role string, text string, kind string, live int, part int"


@pytest.fixture(scope="module")
def talks():
    """Nulls, blanks, ties, repeated rows, unknown roles, conversations of any size."""
    draw = random.Random(5)
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    texts = [None, "", " ", "a.", "b", "hi! ", "é？", "x\n", "x.\n"]
    rows = []
    for conv in [*range(300), None]:
        for t in range(draw.choice([1, 2, 3, 5, 9, 60])):
            rows.append((conv, draw.choice([None, t, t, t, t + 1]), draw.choice(roles), draw.choice(texts)))
    return rows


def _sql(rows):
    con = duckdb.connect()
    kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
    con.register("conversations", pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds.items())}))
    return con


@pytest.mark.parametrize("block_rows", [1, 7, dialogue.BLOCK_ROWS])
def test_repair_equals_sql_however_conversations_are_cut(spark, talks, block_rows):
    df = spark.createDataFrame([(*r, "k", 0, 9) for r in talks], TURNS)
    found = dialogue.repaired(spark, dialogue.damaged(df), block_rows)
    assert compare(found, _sql(talks), dialogue.ORACLE) == []


def _cheapest(rows: list[tuple[str, bool, int]], state: str = "") -> tuple[int, str]:
    """Cost and audit by trying all edits of (initial, doomed, extra); a row is preceded by up to two insertions."""
    best = None
    for edits in itertools.product(*[["", "I", "II"] if k % 2 == 0 else ["D", "K", "R"] for k in range(2 * len(rows) + 1)]):
        cost, out, ok = 0, "", True
        for k, edit in enumerate(edits):
            row = rows[k // 2] if k % 2 else None
            for e in edit:
                new = "a" if out.endswith("u") else "u"
                if e == "I":
                    cost, out = cost + 3, out + new
                elif e == "D":
                    cost += 4
                elif row[1]:
                    ok = False
                else:
                    cost, out = cost + row[2] + (3 if e == "R" else 0), out + (new if e == "R" else row[0])
        if ok and re.fullmatch("(s?(ua)+)?", out):
            found = (cost, "".join(edits))
            best = found if best is None or found < best else best
    return best


def test_least_audit_equals_all_edits():
    draw = random.Random(2)
    for _ in range(60):
        rows = [(draw.choice("suax"), draw.random() < 0.2, draw.choice([0, 0, 3])) for _ in range(draw.randint(0, 4))]
        block = dialogue.Block(1, turns=[1] * len(rows), roles=[r[0] for r in rows], texts=[f"{i}" for i in range(len(rows))])
        own = dialogue.Rows(
            np.array([0, len(rows)]), np.array(["sua".find(r[0]) + 1 for r in rows], np.int64),
            np.array([1 if r[1] else 3 if r[2] else 0 for r in rows], np.int64),
        )
        (piece,) = dialogue.repair([block], own, dialogue.ACCEPT[None], np.array([True]), np.array([0]))
        assert (piece.cost, piece.audit) == _cheapest(rows)


def test_conversation_of_many_rows_is_cut(spark):
    """One conversation of nearly all rows, with repeats across blocks."""
    rows = [(1, t, ["user", "assistant"][t % 2], f"text {t % 700}.") for t in range(3000)] + [(2, 0, "user", "a"), (3, 0, None, None)]
    found = dialogue.repaired(spark, dialogue.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), 100)
    assert compare(found, _sql(rows), dialogue.ORACLE) == []


def test_no_conversations(spark):
    assert dialogue.report(spark, spark.createDataFrame([], TURNS)).count() == 0


def test_crc_matrices_equal_zlib():
    draw = np.random.default_rng(0)
    data = draw.integers(0, 256, 200_000).astype(np.uint8)
    start = np.concatenate((draw.integers(0, 1000, 500), [0, 5, 17, 1000, 0, 9]))
    end = start + np.concatenate((draw.integers(0, 40, 500), [256, 257, 1024, 100_000, 70_000, 0]))
    assert importance.crcs(data, start, end).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end)]


def test_features_of_odd_texts():
    texts = [None, "", "Aa1 b-B\x00c É漢 \U0001f600", "x" * 3000, "a a a", "_[`{~"]
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    expected = [zlib.crc32(w.encode()) % 10_000 for t in texts for w in pattern.findall((t or "").translate(lower))]
    assert [b for c in chunks(pa.array(texts), gap=no_letter) for b in importance.buckets_of(c, 10_000)] == expected


def test_resampling_of_odd_tables(spark, odd, none, docs):
    target = docs.limit(5)
    found = importance.resample(spark, odd, target).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found}
    assert by[1].n_features == 0 and by[1].weight == 0 and by[1].rank is None
    assert sum(r.rank is not None for r in found) == sum(r.n_features >= 20 for r in found) * 10 // 100
    assert importance.resample(spark, none, target).count() == 0
    empty = importance.resample(spark, docs, docs.limit(0)).where("rank is not null").orderBy("rank").collect()
    assert [r.rank for r in empty] == list(range(1, len(empty) + 1))
    assert all((-a.score, a.doc_id) < (-b.score, b.doc_id) for a, b in zip(empty, empty[1:]))


def _winnow(text: str) -> list[tuple[str, int]]:
    """Grams kept by the definition, by the text of the gram and its place."""
    k, w = winnowing.GRAM, winnowing.WINDOW
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] if len(text) >= k else [text] if text else []
    value = {}
    for g in set(grams):
        total = sum((ord(c) + 1) * pow(winnowing._P, i, 1 << 64) for i, c in enumerate(g)) % (1 << 64)
        value[g] = int(winnowing.mix(np.array([total], np.uint64))[0]) >> 32
    kept: list[tuple[int, int]] = []
    for at in range(max(len(grams) - w + 1, min(len(grams), 1))):
        window = [(value[g], -i) for i, g in enumerate(grams[at : at + w], at)]
        least = min(window)
        if (least[0], -least[1]) not in kept:
            kept.append((least[0], -least[1]))
    return kept


def test_winnowing_equals_its_definition():
    draw = random.Random(1)
    texts = ["", "a", "ab" * 5, "x" * 200, "q" * 23, "q" * 24, "é漢\U0001f600" * 40, ""]
    texts += ["".join(draw.choice("ab c") for _ in range(n)) for n in (70, 71, 72, 300, 400)]
    bounds, hashes, places = winnowing.fingerprints(texts)
    for i, text in enumerate(texts):
        some = slice(bounds[i], bounds[i + 1])
        assert list(zip(hashes[some].tolist(), places[some].tolist())) == _winnow(text)


def test_shared_passages_are_found():
    draw = random.Random(3)
    least = winnowing.GRAM + winnowing.WINDOW - 1
    for _ in range(50):
        a, b, both = ("".join(draw.choice("abcdefgh ") for _ in range(n)) for n in (200, 150, least))
        bounds, hashes, _ = winnowing.fingerprints([a + both + b, b + both + a])
        assert set(hashes[bounds[0] : bounds[1]]) & set(hashes[bounds[1] : bounds[2]])


def _fingerprint(text: str) -> str:
    return "".join(f"{h:08x}{p:08x}" for h, p in _winnow(text))


def _likeness(a: str, b: str) -> float:
    x, y = ({t[i : i + 8] for i in range(0, len(t), 16)} for t in (_fingerprint(a), _fingerprint(b)))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints_equal_brute_force(spark, docs):
    some = [(r.doc_id, (r.text or "")[:900]) for r in docs.select("doc_id", "text").collect()]
    some += [(5000, None), (-7, ""), (1 << 62, "end"), (None, "no id")]
    found = winnowing.report(spark, spark.createDataFrame(some, "doc_id long, text string").repartition(5)).collect()
    order = sorted(some, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by = {r.doc_id: r for r in found}
    assert len(found) == len(some)
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        row = by[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        if k % 10 == 0 or len(text) < 100:
            assert row.fingerprint == _fingerprint(text) and row.edited_fingerprint == _fingerprint(changed)
            assert row.near_edited == _likeness(text, changed) and row.near_next == _likeness(text, following)


def test_fingerprints_of_odd_tables(spark, odd, none):
    found = winnowing.report(spark, odd).collect()
    assert len(found) == odd.count()
    assert winnowing.report(spark, none).count() == 0
    (lone,) = winnowing.report(spark, odd.where("doc_id = 4")).collect()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"one ton").hexdigest()


@pytest.mark.parametrize("name", ["op11_path_ranking", "op12_crc_matrices"])
def test_equal_to_sql(spark, name):
    from carrygrid.llm.queries import ORACLE, QUERIES

    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == []
