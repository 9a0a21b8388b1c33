"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of its code
point. An n-gram is bound from its letters: their vectors, each permuted by its
place, are multiplied. A text is the bundle (sum) of its n-grams, a language
the bundle of the unit vectors of its training texts. The language whose
prototype has the largest cosine with the text is predicted; of equal ones
the first by name.

Prototypes are sums over all training texts: tasks add up their own, and one
vector per language and task is shuffled. Vectors are counted in millionths as
whole numbers, so the sum does not depend on the order of the rows.

Null text or text without a letter gets ``und`` and a score of 0, as does every text
when nothing could be learned. Rows with a null lang are not learned from; null and
repeated ids are scored like any other row. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrygrid.llm.store import held_out
from carrygrid.llm.words import mix

DIMENSIONS = 512
N = 3
CHUNK_CHARS = 500_000
GRAMS = 4096  # n-grams counted at a time
UNIT = 1_000_000


def letter_vectors(code_points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of +1 and -1 for each code point; 0 stands for whatever lies between words."""
    word = np.arange(dimensions // 64, dtype=np.uint64)
    bits = mix(mix(code_points.astype(np.uint64)[:, None] + np.uint64(1)) + word * np.uint64(0x9E3779B97F4A7C15))
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) << 1) - 1


def is_letter() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


def bundles(texts: list[str | None], letters: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """One vector per text; all zero where it has no letter."""
    low = [(t or "").lower() for t in texts]
    # A gap on either side, so that beginnings and ends of words count as such.
    points = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) + 2 for t in low])
    points = np.where(letters[points], points, 0)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 0) | (points[:-1] != 0) | (owner[1:] != owner[:-1])
    points, owner = points[keep], owner[keep]
    whole = owner[: 1 - N] == owner[N - 1 :]
    used, place = np.unique(points, return_inverse=True)
    code = np.zeros(int(whole.sum()), np.int64)
    for k in range(N):
        code = code * len(used) + place[k : len(place) - N + 1 + k][whole]
    owner = owner[: 1 - N][whole]
    if len(used) ** N <= 1 << 22:
        seen = np.zeros(len(used) ** N, bool)
        seen[code] = True
        grams = np.flatnonzero(seen)
        number = np.cumsum(seen)[code] - 1
    else:
        grams, number = np.unique(code, return_inverse=True)
    vectors = [np.roll(letter_vectors(used, dimensions), k, axis=1) for k in range(N)]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    out = np.zeros((len(low), dimensions), np.float32)
    # A table of texts by n-grams would grow with the alphabet, so it is made for some n-grams at a time.
    for a in range(0, len(grams), GRAMS):
        rest = grams[a : a + GRAMS]
        bound = np.ones((len(rest), dimensions), np.int8)
        bound[rest == 0] = 0  # a gram of gaps alone says nothing
        for k in range(N):
            bound *= vectors[k][rest % len(used)]
            rest = rest // len(used)
        some = slice(*np.searchsorted(number, (a, a + GRAMS)))
        counts = np.bincount(owner[some] * len(bound) + number[some] - a, minlength=len(low) * len(bound)).reshape(len(low), -1)
        out += counts.astype(np.float32) @ bound.astype(np.float32)
    return out


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of a batch in lists of about ``CHUNK_CHARS`` characters; no text is cut."""
    first, size, part = 0, 0, []
    for i, text in enumerate(batch.column(at)):
        part.append(text.as_py())
        size += len(part[-1] or "")
        if size >= CHUNK_CHARS or len(part) == 512:
            yield first, part
            first, size, part = i + 1, 0, []
    if part:
        yield first, part


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return vectors / np.where(norm > 0, norm, 1)


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Language names in order, and their prototypes, from all rows outside the held-out fold."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = is_letter()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            languages = np.array(batch.column(1).to_pylist(), object)
            for first, part in _parts(batch, 0):
                units = np.rint(_unit(bundles(part, letters, dimensions)) * UNIT).astype(np.int64)
                own = languages[first : first + len(part)]
                for name in set(own):
                    sums[name] = sums.get(name, 0) + units[own == name].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["lang", "v"]
        )

    parts = docs.where(~held_out("doc_id") & F.col("lang").isNotNull()).select("text", "lang").mapInArrow(add_up, "lang string, v array<long>")
    rows = (
        parts.select("lang", F.posexplode("v"))
        .groupBy("lang", "pos")
        .agg(F.sum("col").alias("total"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "total"))).alias("v"))
        .orderBy("lang")
        .collect()
    )
    rows = [r for r in rows if any(x.total for x in r.v)]
    if not rows:
        return [], np.zeros((0, dimensions))
    return [r.lang for r in rows], _unit(np.array([[x.total for x in r.v] for r in rows], np.float64))


def identify(docs: DataFrame, names: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    dimensions = prototypes.shape[1] if len(names) else 64

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = is_letter()
        for batch in batches:
            for first, part in _parts(batch, 1):
                units = _unit(bundles(part, letters, dimensions))
                cosines = np.round(units @ prototypes.T, 9) if len(names) else np.zeros((len(part), 1))
                best = cosines.argmax(axis=1)
                known = units.any(axis=1) & (len(names) > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        pa.array([names[b] if k else "und" for b, k in zip(best, known)], pa.string()),
                        pa.array(np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0.0)),
                    ],
                    names=["doc_id", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    found = identify(docs, *learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
