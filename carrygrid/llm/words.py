"""Words of whole texts as 64-bit hashes, computed on Arrow buffers without a Python object per word.

A word is a run of bytes other than white space (0x20, 0x09-0x0D) with A-Z
lower-cased. Its hash is a polynomial over its bytes modulo 2**64, mixed; five
words are combined with one odd factor each. Two different words or shingles
of a pair of documents meet with a chance of about size**2 / 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK_BYTES = 1 << 18
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SHORT = np.array([0, 0x1B03738712FAD5C9, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85, 0x4A7C15F39CC0605D], np.uint64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        grown = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        grown[0] = 1
        _powers[base] = np.cumprod(grown)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system. Idle Python workers keep theirs otherwise, beside those that work."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


@dataclass
class Chunk:
    """Some consecutive texts of a batch. Word ``i`` has bytes ``start[i]:end[i]`` of ``data``."""

    first: int  # row of the first text in the batch
    bounds: np.ndarray  # byte offsets of the texts, one more than texts
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word_bounds: np.ndarray  # word offsets of the texts
    sums: np.ndarray  # prefix sums of the polynomial

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def hashes(self, end: np.ndarray | None = None, start: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word, or of the bytes between given offsets."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        inverse = powers(_P_INVERSE, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * inverse[start])


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def no_letter(data: np.ndarray) -> np.ndarray:
    """Bytes between letter runs: all but a-z, 0-9 and parts of non-ASCII characters."""
    return ~(((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128))


def chunks(
    texts: pa.Array,
    limit: int = CHUNK_BYTES,
    lower: bool = True,
    gap: Callable[[np.ndarray], np.ndarray] = is_space,
) -> Iterator[Chunk]:
    """Cut a batch of texts (null counts as empty) into chunks of about ``limit`` bytes; no text is cut.

    ``gap`` tells which bytes separate words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        last = min(last, len(texts), row + 4096)
        data = whole[offsets[row] : offsets[last]]
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        bounds = offsets[row : last + 1] - offsets[row]
        space = gap(data)
        n = len(data)
        head = np.zeros(n + 1, bool)
        head[bounds] = True
        before = np.ones(n, bool)
        after = np.ones(n, bool)
        if n:
            before[1:] = space[:-1]
            after[:-1] = space[1:]
        start = np.flatnonzero(~space & (before | head[:n]))
        end = np.flatnonzero(~space & (after | head[1:])) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, n + 1)[:n], out=sums[1:])
        yield Chunk(row, bounds, data, start, end, np.searchsorted(start, bounds), sums)
        row = last
    give_back()


def combine(words: np.ndarray) -> np.ndarray:
    """Hash of every five consecutive words."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * _FACTORS[0]
    for k in range(1, SHINGLE):
        total += words[k : k + n] * _FACTORS[k]
    return mix(total)


def short(words: np.ndarray) -> np.ndarray:
    """The one shingle of a text of one to four words."""
    return mix(_SHORT[len(words) : len(words) + 1] + (words * _FACTORS[: len(words)]).sum(dtype=np.uint64))


def shingle_sets(chunk: Chunk) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of the chunk."""
    words = chunk.hashes()
    fives = combine(words)
    for a, b in zip(chunk.word_bounds[:-1], chunk.word_bounds[1:]):
        if b - a >= SHINGLE:
            s = np.sort(fives[a : b - SHINGLE + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield short(words[a:b])
        else:
            yield np.zeros(0, np.uint64)
