"""Toxicity classifier with counterfactual regularisation.

A logistic regression on hashed words and word beginnings of whole texts. In
the labelled texts every identity term is swapped for another one of its
group; the training loss penalises the squared change of the score that the
swap causes. So a term of a group cannot carry the verdict, and neutral
mentions of groups do not raise it.

Training uses at most ``SAMPLE`` labelled rows outside the held-out fold (those
with the smallest hash of the id), ``FEATURES`` features and a fixed number of
steps; all are parameters. Scoring is one pass over all texts, without a shuffle.

Null text counts as empty and gets the score of a text without features.
Labels with null ids or grades are not used, of contradicting labels the
toxic one counts. Without usable labels of both kinds every score is 0. Rows with
null or repeated ids are scored like any other. An empty table gives no rows.
Columns named score and predicted are replaced, all others kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from carrygrid.llm.store import held_out
from carrygrid.llm.words import Chunk, chunks, no_letter

SAMPLE = 16_000
FEATURES = 4096
CUT = 0.7
BEGINNINGS = (4, 5, 6, 7, 8)
PENALTY = 1.0
RIDGE = 3e-5
TOXIC_WEIGHT = 3.0  # toxic rows are the fewer; each counts as so many others
STEPS = 400

# Identity terms by group; a term may be swapped for any other of its group.
IDENTITY_GROUPS = (
    ("women", "men", "mujeres", "hombres", "femmes", "hommes", "frauen", "männer"),
    ("woman", "man", "mujer", "hombre", "femme", "homme", "frau", "mann"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous", "african", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "transgender", "queer"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian", "turkish"),
    ("immigrant", "native", "refugee", "foreigner", "citizen"),
    ("immigrants", "natives", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young", "old"),
)
_NEXT = {term: group[(i + 1) % len(group)] for group in IDENTITY_GROUPS for i, term in enumerate(group)}
_TERM = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, _NEXT), key=len, reverse=True)) + r")(?!\w)", re.I)


def swapped(text: str) -> str:
    """The text with every identity term replaced by the next one of its group."""
    return _TERM.sub(lambda m: _NEXT[m.group().lower()], text)


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash) of all words and word beginnings, repeats included."""
    owner = np.repeat(np.arange(chunk.rows), np.diff(chunk.word_bounds))
    owners, hashes = [owner], [chunk.hashes()]
    length = chunk.end - chunk.start
    for n in BEGINNINGS:
        some = np.flatnonzero(length > n)
        start = chunk.start[some]
        owners.append(owner[some])
        hashes.append(chunk.hashes(start + n, start) ^ np.uint64(n))
    return np.concatenate(owners), np.concatenate(hashes)


def _distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


@dataclass
class Model:
    """Weights by feature hash (sorted) and the score of a text without features."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def known(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(text number, place of the feature), distinct, of those features that the model has."""
        owner, value = features(chunk)
        some = self.maybe[(value >> np.uint64(44)).astype(np.int64)]
        owner, value = owner[some], value[some]
        if not len(self.hashes):
            return owner[:0], owner[:0]
        place = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
        some = self.hashes[place] == value
        return _distinct(owner[some], place[some])

    def scores(self, chunk: Chunk) -> np.ndarray:
        owner, place = self.known(chunk)
        z = self.bias + np.bincount(owner, self.weights[place], minlength=chunk.rows)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _pad(rows: int, owner: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    return np.split(place, np.searchsorted(owner, np.arange(1, rows))) if rows else []


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` training rows, one for each labelled id. The broadcast side has at most that many rows."""
    rows = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    # Of repeated rows of an id the least text counts.
    found = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id")
    return found.agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = np.asarray(batch.column(1))
        for chunk in chunks(batch.column(0), gap=no_letter):
            owner, value = _distinct(*features(chunk))
            value, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
            bad = np.bincount(inverse, toxic[chunk.first + owner], minlength=len(value)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count), pa.array(bad)], names=["feature", "n", "bad"])


def choose(rows: DataFrame, most: int = FEATURES) -> np.ndarray:
    """Hashes of the features that tell most, by the chi-square of their presence."""
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < bad < n:
        return np.zeros(0, np.uint64)
    share = bad / n
    counts = rows.mapInArrow(_counts, "feature long, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    gain = F.pow(F.col("bad") - F.col("n") * share, 2) / (F.col("n") * share * (1 - share))
    top = counts.where("n >= 3").orderBy(gain.desc(), "feature").limit(most).select("feature").collect()
    return np.sort(np.array([r.feature for r in top], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = FEATURES, penalty: float = PENALTY) -> Model:
    rows = labelled(docs, labels, sample)
    empty = Model(choose(rows, most), np.zeros(0), -60.0)
    if not len(empty.hashes):
        return empty

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            other = pa.array([swapped(t) if t else "" for t in batch.column(0).to_pylist()], pa.string())
            pairs = zip(chunks(batch.column(0), 1 << 16, gap=no_letter), _cut_alike(batch.column(0), other))
            for chunk, changed in pairs:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(chunk.first, chunk.rows),
                        pa.array(_pad(chunk.rows, *empty.known(chunk)), pa.list_(pa.int64())),
                        pa.array(_pad(chunk.rows, *empty.known(changed)), pa.list_(pa.int64())),
                    ],
                    names=["toxic", "own", "other"],
                )

    found = rows.mapInArrow(vectors, "toxic int, own array<long>, other array<long>").orderBy("toxic", "own", "other").toPandas()
    weights, bias = fit(found["toxic"].to_numpy(float), list(found["own"]), list(found["other"]), len(empty.hashes), penalty)
    return Model(empty.hashes, weights, bias)


def _cut_alike(own: pa.Array, other: pa.Array) -> Iterator[Chunk]:
    """Chunks of ``other`` with the same rows as those of ``own``."""
    for chunk in chunks(own, 1 << 16, gap=no_letter):
        yield next(chunks(other.slice(chunk.first, chunk.rows), 1 << 40, gap=no_letter))


def fit(
    toxic: np.ndarray, own: list[np.ndarray], other: list[np.ndarray], size: int, penalty: float = PENALTY,
    ridge: float = RIDGE, steps: int = STEPS,
) -> tuple[np.ndarray, float]:
    """Weights and bias: mean log loss + ridge + ``penalty`` times the mean squared change under the swap."""
    n = len(toxic)
    share = np.where(toxic > 0, TOXIC_WEIGHT, 1.0) / n
    flat = lambda rows: (np.concatenate([*rows, np.zeros(0)]).astype(np.int64), np.repeat(np.arange(n), [len(r) for r in rows]))
    place, owner = flat(own)
    # The change of a score under the swap is a sum over the features that come or go.
    come, come_of = flat([np.setdiff1d(b, a) for a, b in zip(own, other)])
    go, go_of = flat([np.setdiff1d(a, b) for a, b in zip(own, other)])
    weights, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        rate = 0.05 * (1 - (step - 1) / steps)
        z = bias + np.bincount(owner, weights[place], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - toxic) * share
        change = np.bincount(come_of, weights[come], minlength=n) - np.bincount(go_of, weights[go], minlength=n)
        grad = np.bincount(place, error[owner], minlength=size) + 2 * ridge * weights
        pull = 2 * penalty * change / n
        grad += np.bincount(come, pull[come_of], minlength=size) - np.bincount(go, pull[go_of], minlength=size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        c, d = 1 - 0.9**step, 1 - 0.999**step
        weights = weights - rate * (m / c) / (np.sqrt(v / d) + 1e-8)
        bias -= rate * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return weights, float(bias)


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``docs`` with the columns score (0 to 1) and predicted (1 from ``cut`` on)."""
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.scores(chunk) for chunk in chunks(batch.column(at), gap=no_letter)]
            values = np.concatenate([*found, np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values), pa.array((values >= cut).astype(np.int32))],
                names=[*batch.schema.names, "score", "predicted"],
            )

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.mapInArrow(judge, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    scored = score(docs.select("text", F.struct(*docs.columns).alias("row")), train(docs, labels))
    return scored.where("predicted = 0").select("row.*")
