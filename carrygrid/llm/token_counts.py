"""Token counts by a trie: unigram forward scores once per shared prefix.

The distinct pre-tokens of a chunk of texts go into a trie. A node's forward
score is the best log probability of segmenting its prefix; it depends on the
prefix alone, so words that begin alike share it. Nodes are scored by depth, all
of one depth together. The terminal node of a pre-token holds the number of
tokens of its best segmentation, of which a text's count is the sum. Of equal
segmentations the one with the longer last piece counts.

A level of the trie is worth its step where many nodes share it. Pre-tokens over ``DEEP``
characters share next to nothing, so each is scored by a plain loop over its characters, in
time proportional to its length; very long texts without spaces are such.

Null or empty text has no tokens. Rows with null or repeated ids are counted like any
other. An empty table gives no rows. Nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from carrygrid.llm.pieces import MODEL, PreTokens, Vocabulary, byte_count, parts, span_hashes

CHUNK_CHARS = 2_000_000
DEEP = 128


def _long_count(word: str, vocabulary: Vocabulary) -> int:
    """Tokens of the best segmentation of one long pre-token."""
    logs, longest, n = vocabulary.by_name, vocabulary.longest, len(word)
    score, tokens = [0.0] * (n + 1), [0] * (n + 1)
    for end in range(1, n + 1):
        top, count = -math.inf, 0
        for start in range(max(0, end - longest), end):  # the longest last piece comes first
            log = logs.get(word[start:end])
            if log is not None and score[start] + log > top:
                top, count = score[start] + log, tokens[start] + 1
        if word[end - 1] not in logs:
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            spelled = score[end - 1] + size * vocabulary.byte_log
            if spelled > top:
                top, count = spelled, tokens[end - 1] + size
        score[end], tokens[end] = top, count
    return tokens[n]


def _text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def terminal_counts(found: PreTokens, vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of the best segmentation of each distinct pre-token."""
    long = found.length > DEEP
    out = np.zeros(len(long), np.int64)
    out[long] = [_long_count(_text(found.points[a : a + n]), vocabulary) for a, n in zip(found.start[long], found.length[long])]
    out[~long] = _shared_counts(replace(found, start=found.start[~long], length=found.length[~long]), vocabulary)
    return out


def _shared_counts(found: PreTokens, vocabulary: Vocabulary) -> np.ndarray:
    n = len(found.length)
    if not n:
        return np.zeros(0, np.int64)
    # Every prefix of every pre-token, and the trie node it is.
    begin = np.repeat(found.start, found.length)
    offset = np.concatenate(([0], np.cumsum(found.length)))
    depth = np.arange(offset[-1]) - np.repeat(offset[:-1], found.length) + 1
    _, sample, node = np.unique(span_hashes(found.sums, begin, begin + depth), return_index=True, return_inverse=True)
    node += 1  # node 0 is the root
    deep = depth[sample]
    last = begin[sample] + deep  # where the prefix ends
    score = np.full(len(sample) + 1, -np.inf)
    tokens = np.zeros(len(sample) + 1, np.int64)
    score[0] = 0
    order = np.argsort(deep, kind="stable")
    levels = np.searchsorted(deep[order], np.arange(1, deep.max() + 2))
    longest = vocabulary.longest
    for level, (a, b) in enumerate(zip(levels[:-1], levels[1:]), 1):
        own = order[a:b]
        reach = min(level, longest)
        gain = np.full((b - a, reach), -np.inf)
        for k in range(reach):  # the longest last piece comes first
            length = reach - k
            hit, place = vocabulary.find(span_hashes(found.sums, last[own] - length, last[own]))
            before = node[sample[own[hit]] - length] if length < level else 0
            gain[hit, k] = score[before] + vocabulary.logs[place]
        best = gain.argmax(axis=1)
        top = gain[np.arange(b - a), best]
        back = reach - best
        count = np.ones(b - a, np.int64)
        # A character without a piece is spelled in bytes.
        size = byte_count(found.points[last[own] - 1])
        parent = node[sample[own] - 1] if level > 1 else np.zeros(b - a, np.int64)
        spelled = score[parent] + size * vocabulary.byte_log
        lone = np.isneginf(gain[:, reach - 1]) & (spelled > top)
        top, back, count = np.where(lone, spelled, top), np.where(lone, 1, back), np.where(lone, size, count)
        source = np.where(back < level, node[np.maximum(sample[own] - back, 0)], 0)
        score[own + 1], tokens[own + 1] = top, tokens[source] + count
    return tokens[node[offset[1:] - 1]]


def count_tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_pretokens and n_tokens of every row."""
    vocabulary = Vocabulary.load(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in parts(batch.column(1), CHUNK_CHARS):
                found = PreTokens.of(texts)
                per_word = terminal_counts(found, vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array(np.bincount(found.owner, minlength=len(texts)).astype(np.int64)),
                        pa.array(np.bincount(found.owner, per_word[found.word], minlength=len(texts)).astype(np.int64)),
                    ],
                    names=["doc_id", "n_chars", "n_pretokens", "n_tokens"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_chars long, n_pretokens long, n_tokens long")
