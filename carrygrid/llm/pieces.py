"""A unigram model over the pieces of a SentencePiece file, and the pre-tokens of whole texts.

The file's merge order gives the model: the piece of rank r has a probability
in proportion to 1/r (Zipf's law). Characters without a piece are spelled in
bytes, each as rare as the last rank. As in the library, a text gets a leading
space, and spaces become U+2581. No piece spans the start of a word, so a text's
lattice is the chain of the lattices of its pre-tokens (spaces and what follows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from carrygrid.llm.words import give_back, mix, powers

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
CHUNK_CHARS = 1_000_000
BEGIN_BITS = 22
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)


def prefix_sums(points: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(_P, len(points) + 1)[:-1], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(_P_INVERSE, len(sums))[start])


def normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


@dataclass
class Vocabulary:
    """Pieces by hash (sorted) with id and log probability; ids of single bytes follow ``first_byte``."""

    names: list[str]
    first_byte: int
    ids: np.ndarray
    hashes: np.ndarray
    logs: np.ndarray
    byte_log: float
    longest: int
    begins: np.ndarray  # by the first bits of a hash: whether a piece may begin so

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece holds the start of a word within")
        plain.sort(key=lambda i: (-model.get_score(i), i))
        rank = np.arange(1, len(plain) + 1)
        total = np.log((1 / rank).sum())
        points = np.array([ord(c) for i in plain for c in names[i]], np.uint32)
        bounds = np.concatenate(([0], np.cumsum([len(names[i]) for i in plain])))
        hashes = span_hashes(prefix_sums(points), bounds[:-1], bounds[1:])
        order = np.argsort(hashes)
        # Hashes of all beginnings of pieces: what is none of them needs no longer look.
        begins = np.zeros(1 << BEGIN_BITS, bool)
        sums, sizes = prefix_sums(points), np.diff(bounds)
        for k in range(1, int(sizes.max()) + 1):
            some = bounds[:-1][sizes >= k]
            begins[span_hashes(sums, some, some + k) >> np.uint64(64 - BEGIN_BITS)] = True
        return cls(
            names, next(i for i in range(size) if model.is_byte(i)), np.array(plain, np.int32)[order], hashes[order],
            (-np.log(rank) - total)[order], float(-np.log(len(plain)) - total), int(sizes.max()), begins,
        )

    def __post_init__(self) -> None:
        slot = (self.hashes >> np.uint64(44)).astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[slot] = True
        self.slot = np.zeros(1 << 20, np.int32)
        self.slot[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.most = int(np.unique(slot, return_counts=True)[1].max())
        # By id, for those who keep ids only.
        self.log_of = np.full(len(self.names), -np.inf)
        self.log_of[self.ids] = self.logs
        self.length_of = np.array([len(name) for name in self.names])
        self.by_name = {self.names[i]: x for i, x in zip(self.ids.tolist(), self.logs.tolist())}

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and their places."""
        slot = (hashes >> np.uint64(44)).view(np.int64)
        some = np.flatnonzero(self.maybe[slot])
        wanted, place = hashes[some], self.slot[slot[some]]
        hit = self.hashes[place] == wanted
        for _ in range(self.most - 1):
            rest = np.flatnonzero(~hit)
            if not len(rest):
                break
            place[rest] = np.minimum(place[rest] + 1, len(self.hashes) - 1)
            hit[rest] = self.hashes[place[rest]] == wanted[rest]
        return some[hit], place[hit]

    def begun(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may be beginnings of pieces; never wrong about those that are."""
        return self.begins[(hashes >> np.uint64(64 - BEGIN_BITS)).view(np.int64)]

    def decode(self, ids: Iterator[int]) -> str:
        """The text that ids stand for; undecodable bytes become U+FFFD."""
        data = bytearray()
        for i in ids:
            if self.first_byte <= i < self.first_byte + 256:
                data.append(i - self.first_byte)
            else:
                data += self.names[i].encode()
        return data.decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


def byte_count(points: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of each code point."""
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


@dataclass
class PreTokens:
    """Pre-tokens of some texts: ``word`` numbers the distinct ones, of which ``start``, ``length`` is an occurrence."""

    points: np.ndarray
    sums: np.ndarray
    owner: np.ndarray  # text of each occurrence
    word: np.ndarray  # distinct pre-token of each occurrence
    start: np.ndarray  # of each distinct pre-token
    length: np.ndarray
    order: np.ndarray  # occurrences by distinct pre-token

    @classmethod
    def of(cls, texts: list[str]) -> PreTokens:
        whole = [normal(t) for t in texts]
        points = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
        space = points == ord(SPACE)
        head = np.zeros(len(points), bool)
        if len(points):
            head[1:] = space[1:] & ~space[:-1]
        sizes = np.array([len(t) for t in whole], np.int64)
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        head[firsts] = True
        start = np.flatnonzero(head)
        end = np.append(start, len(points))[1:]
        sums = prefix_sums(points)
        owner = np.flatnonzero(sizes)[np.searchsorted(firsts, start, "right") - 1] if len(start) else start
        hashes = span_hashes(sums, start, end)
        order = np.argsort(hashes)
        hashes = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        word, first = np.empty(len(order), np.int64), order[new]
        word[order] = np.cumsum(new) - 1
        return cls(points, sums, owner, word, start[first], (end - start)[first], order)


def parts(texts: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in lists of about ``limit`` characters; null is empty, no text is cut."""
    first, size, part = 0, 0, []
    for i, text in enumerate(texts):
        part.append(text.as_py() or "")
        size += len(part[-1])
        if size >= limit:
            yield first, part
            first, size, part = i + 1, 0, []
    if part:
        yield first, part
    give_back()
