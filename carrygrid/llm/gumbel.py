"""Segmentations sampled without replacement: Gumbel top-k by A* search over the lattice.

Every segmentation of a text has a Gumbel-perturbed log probability; the k largest
are a sample without replacement. They are found without listing any: a search
node is a set of segmentations, bounded by its log mass (backward scores of the
lattice make the bound exact), and carries its perturbed maximum. The best
node is popped, the segmentation that attains its maximum is drawn and emitted, and
what is left of the node is split by the first pre-token that differs; the
maxima of the parts are Gumbel variables cut off at the node's own. The largest value
that is not emitted gives the inclusion score of the others: the chance
of a perturbed value above it.

Random numbers come from a hash of (seed, row key, sample, place), so results depend
on neither partitions nor retries. All texts of a chunk take each step together. A word
must differ from the forms drawn before: it is drawn again up to ``TRIES`` times, and then
exactly, by a walk over the lattice without the mass of those forms. A text
with fewer than k segmentations gives all it has.

Null or empty text has one segmentation, the empty one. A null row key counts as 0;
rows with equal key and text get equal samples. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from carrygrid.llm.pieces import MODEL, PreTokens, Vocabulary, byte_count, parts, prefix_sums, span_hashes
from carrygrid.llm.words import mix

K = 2
SEED = 7
CHUNK_CHARS = 400_000
TRIES = 8
KEPT_BYTES = 1 << 16  # of the words whose other forms are kept for the next chunks
CLOSE = 1e-9  # below, what is left of a word is summed over its other forms
LINEAR, RATE = 400, 2.7  # pre-tokens up to this length are summed as plain numbers
TINY = 1e-250  # where plain sums end
LEADS = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)  # bits of the first byte, by UTF-8 bytes
_STEP = 0x9E3779B97F4A7C15


def shifted(key: np.ndarray, number) -> np.ndarray:  # noqa: ANN001
    """Another key for each number (or array of numbers)."""
    if np.ndim(number):
        return mix(key + (number.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP))
    return mix(key + np.uint64((number + 1) * _STEP % 2**64))


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), fixed by the key."""
    return ((key >> np.uint64(12)).astype(np.float64) + 0.5) / 2**52


@dataclass
class Lattice:
    """Edges of the distinct pre-tokens, only those that exist.

    Rows are the places of all pre-tokens, their ends first and the others by the characters
    still to come and the number of edges. The edges lie row after row, shorter ones first.
    """

    first: np.ndarray  # row of the start of each pre-token
    last: np.ndarray  # last edge of each row; of no use for ends
    piece: np.ndarray  # by edge: piece id, or beyond those the number of bytes that spell the character
    target: np.ndarray  # by edge: the row where it leads
    before: np.ndarray  # by edge: probability of the shorter ones of its row
    mass: np.ndarray  # log of the sum over all segmentations of each pre-token
    spelled: np.ndarray  # edges of characters that are spelled in bytes
    points: np.ndarray  # their code points
    log_of: np.ndarray  # log probability by piece, then by number of bytes
    length_of: np.ndarray  # characters by the same
    count_of: np.ndarray  # ids by the same

    @classmethod
    def of(cls, found: PreTokens, vocabulary: Vocabulary, logs: np.ndarray | None = None) -> Lattice:
        """``logs`` tells which pre-tokens are summed as logs: long ones, and those whose plain sums leave the range."""
        logs = found.length > LINEAR if logs is None else logs
        words, names, width = len(found.length), len(vocabulary.names), vocabulary.longest + 1
        log_of = np.append(vocabulary.log_of, np.arange(5) * vocabulary.byte_log)
        length_of = np.append(vocabulary.length_of, np.ones(5, np.int64))
        count_of = np.append(np.ones(names, np.int32), np.arange(5, dtype=np.int32))
        # The characters of the distinct pre-tokens, one after the other.
        size = int(found.length.sum())
        begin = np.cumsum(found.length) - found.length
        left = np.repeat(begin + found.length, found.length) - np.arange(size)  # characters still to come
        points = found.points[np.repeat(found.start - begin, found.length) + np.arange(size)]
        sums = prefix_sums(points)
        # Each has an edge of its own.
        hit, place = vocabulary.find(span_hashes(sums, np.arange(size), np.arange(1, size + 1)))
        single = byte_count(points) + names
        single[hit] = vocabulary.ids[place]
        count = np.ones(size, np.int16)
        longer = []  # by length: where edges start, their pieces, edges that lie before them
        at = np.flatnonzero(left > 1)
        for k in range(2, width):
            hashes = span_hashes(sums, at, at + k)
            hit, place = vocabulary.find(hashes)
            start = at[hit]
            longer.append((start, vocabulary.ids[place], count[start]))
            count[start] += 1
            at = at[vocabulary.begun(hashes)]
            at = at[left[at] > k]
        group = (left * 2 + np.repeat(logs, found.length)) * width + count
        order = np.argsort(group.astype(np.min_scalar_type(group.max(initial=0))), kind="stable")
        row = np.zeros(size + 1, np.int32)
        row[order] = np.arange(words, words + size)
        end = np.cumsum(count[order], dtype=np.int64)
        edges = int(end[-1]) if size else 0
        own = np.zeros(size, np.int64)
        own[order] = end - count[order]
        word = np.repeat(np.arange(words, dtype=np.int32), found.length)
        piece, target = np.zeros(edges, np.min_scalar_type(len(log_of))), np.zeros(edges, np.int32)
        for k, (start, ids, rank) in enumerate([(np.arange(size), single, 0), *longer], 1):
            edge = own[start] + rank
            piece[edge] = ids
            target[edge] = np.where(left[start] == k, word[start], row[start + k])
        bare = np.flatnonzero(single >= names)
        bare = bare[np.argsort(own[bare])]
        last = np.append(np.full(words, -1), end - 1).astype(np.int32)
        lattice = cls(row[begin], last, piece, target, np.zeros(edges), np.zeros(words), own[bare], points[bare], log_of, length_of, count_of)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            total = lattice._sum(found.length, group[order] // width, logs)
        lost = np.flatnonzero(~((total[words:] > TINY) & (total[words:] < 1 / TINY)) & ~logs[word[order]])
        if not len(lost):
            return lattice
        logs = logs.copy()
        logs[word[order[lost]]] = True
        return cls.of(found, vocabulary, logs)

    def _sum(self, length: np.ndarray, level: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Fill ``before`` and ``mass``; the sums by row. Rows of a level that have as many edges are a matrix."""
        words = len(length)
        # Each character counts exp(RATE) times its probability, so that plain sums stay near 1.
        weight_of = np.exp(self.log_of + RATE * self.length_of)
        total = np.append(np.where(logs, 0.0, 1.0), np.zeros(len(level)))
        sizes = np.diff(self.last[words:], prepend=-1)
        new = (level[1:] != level[:-1]) | (sizes[1:] != sizes[:-1])
        starts = np.concatenate(([0], np.flatnonzero(new) + 1)) if len(level) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(level))
        for a, b, n, as_logs in zip(starts.tolist(), ends.tolist(), sizes[starts].tolist(), (level[starts] % 2).tolist()):
            stop = int(self.last[words + b - 1]) + 1
            some = slice(stop - (b - a) * n, stop)
            after = total[self.target[some]]
            if as_logs:
                part = (self.log_of[self.piece[some]] + after).reshape(b - a, n)
                top = part.max(axis=1)
                part = np.exp(part - top[:, None])
            else:
                part = (weight_of[self.piece[some]] * after).reshape(b - a, n)
            for k in range(1, n):
                part[:, k] += part[:, k - 1]
            summed = part[:, -1]
            total[words + a : words + b] = top + np.log(summed) if as_logs else summed
            if n > 1:
                self.before[some].reshape(b - a, n)[:, 1:] = part[:, :-1] / summed[:, None]
        own = total[self.first]
        self.mass = np.where(logs, own, np.log(np.where(logs, 1.0, own)) - RATE * length)
        return total

    def edges(self, row: np.ndarray, take: np.ndarray) -> np.ndarray:
        """The edges of the given rows that are one character longer than ``take``."""
        edge = self.last[row].astype(np.int64)
        while len(far := np.flatnonzero(self.length_of[self.piece[edge]] > take + 1)):
            edge[far] -= 1
        return edge

    def gains(self, word: int) -> np.ndarray:
        """Log probability of a pre-token's edges by place and length; minus infinity where there is none."""
        row, rows = int(self.first[word]), []
        while row >= len(self.first):
            edge = int(self.last[row])
            own = [edge]
            while self.length_of[self.piece[edge]] > 1:
                edge -= 1
                own.append(edge)
            rows.append(self.piece[own])
            row = int(self.target[edge])
        log = np.full((len(rows), max((int(self.length_of[own[0]]) for own in rows), default=1)), -np.inf)
        for i, own in enumerate(rows):
            log[i, self.length_of[own] - 1] = self.log_of[own]
        return log

    def draw(self, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """A segmentation of each given pre-token: log probability, a hash of it, and its edges by step."""
        log, form = np.zeros(len(word)), np.zeros(len(word), np.uint64)
        active, edges = np.arange(len(word)), []
        row, at, shape = self.first[word], np.zeros(len(word), np.uint64), form
        while len(active):
            chance = uniform(mix(key + at * np.uint64(_STEP)))
            edge = self.last[row].astype(np.intp)
            far = np.flatnonzero(self.before[edge] >= chance)
            while len(far):
                edge[far] -= 1
                far = far[self.before[edge[far]] >= chance[far]]
            piece = self.piece[edge].astype(np.intp)
            log[active] += self.log_of[piece]
            length = self.length_of[piece].astype(np.uint64)
            shape = mix(shape + length * np.uint64(_STEP))
            form[active] = shape
            edges.append((active, edge))
            row = self.target[edge].astype(np.intp)
            on = np.flatnonzero(row >= len(self.first))
            active, row, key, at, shape = active[on], row[on], key[on], (at + length)[on], shape[on]
        return log, form, edges


@dataclass
class Others:
    """The forms of one pre-token without some barred ones, as log masses; nothing is subtracted, so none is too rare."""

    free: list[np.ndarray]  # by place: log probability of each edge
    left: dict[tuple[int, tuple[int, ...]], np.ndarray]  # the same without barred forms, by place and the barred forms that came there
    barred: list[dict[int, int]]  # the edge of each barred form by place
    log: float  # of all that is left

    @classmethod
    def of(cls, lattice: Lattice, word: int, barred: list[tuple[int, ...]]) -> Others:
        log = lattice.gains(word)
        n, width = log.shape
        total, free = np.zeros(n + 1), [np.zeros(0)] * n
        for i in range(n - 1, -1, -1):
            edge = log[i, : n - i] + total[i + 1 : i + 1 + width]
            total[i] = np.logaddexp.reduce(edge)
            free[i] = edge - total[i]
        at = [dict(zip(np.cumsum([0, *(t + 1 for t in takes)]).tolist(), takes)) for takes in barred]
        order = [(0, tuple(range(len(barred))))] if barred else []
        for i, forms in order:
            if i < n:
                order += [(i + t + 1, tuple(f for f in forms if at[f][i] == t)) for t in dict.fromkeys(at[f][i] for f in forms)]
        left: dict[tuple[int, tuple[int, ...]], np.ndarray] = {}
        rest: dict[tuple[int, tuple[int, ...]], float] = {}
        for i, forms in reversed(order):
            if i == n:
                rest[i, forms] = -np.inf
                continue
            own = free[i].copy()
            for t in {at[f][i] for f in forms}:
                own[t] += rest[i + t + 1, tuple(f for f in forms if at[f][i] == t)]
            left[i, forms], rest[i, forms] = own, float(np.logaddexp.reduce(own))
        return cls(free, left, at, rest[order[0]] if order else 0.0)

    def draw(self, key: np.uint64) -> tuple[int, ...]:
        """The edges of one of them."""
        out, i, forms = [], 0, tuple(range(len(self.barred)))
        chance = uniform(mix(np.uint64(key) + np.arange(len(self.free), dtype=np.uint64) * np.uint64(_STEP)))
        while i < len(self.free):
            edge = self.left[i, forms] if forms else self.free[i]
            below = np.cumsum(np.exp(edge - edge.max()))
            t = int(np.searchsorted(below, chance[i] * below[-1], "right"))
            out.append(t)
            forms = tuple(f for f in forms if self.barred[f][i] == t)
            i += t + 1
        return tuple(out)


def _best(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Place of the largest value of each section; -1 for an empty section or one without a finite value."""
    out = np.full(len(bounds) - 1, -1)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        top = np.maximum.reduceat(values, bounds[some])
        size = (bounds[1:] - bounds[:-1])[some]
        equal = np.flatnonzero((values == np.repeat(top, size)) & np.isfinite(values))
        section = np.repeat(some, size)[equal]
        out[section[::-1]] = equal[::-1]
    return out


@dataclass
class Sample:
    """The drawn words of all texts in one round, and what was emitted."""

    live: np.ndarray  # texts that have this sample
    log: np.ndarray  # per text
    value: np.ndarray  # perturbed log probability
    word_log: np.ndarray
    shape: np.ndarray
    edges: list  # (words, edges) by step, for words drawn anew
    source: np.ndarray  # per word: the sample whose edges it has


class Search:
    """The k best of all texts of a chunk, all texts in step."""

    def __init__(self, found: PreTokens, lattice: Lattice, keys: np.ndarray, k: int, others: dict[tuple[bytes, frozenset], Others] | None = None) -> None:
        self.found, self.lattice, self.k = found, lattice, k
        self.texts = len(keys)
        self.key = shifted(keys.astype(np.uint64), SEED)
        self.bounds = np.searchsorted(found.owner, np.arange(self.texts + 1))
        self.word_key = shifted(self.key[found.owner], np.arange(len(found.owner)) - self.bounds[found.owner])
        self.mass = lattice.mass[found.word]
        self.total = np.bincount(found.owner, self.mass, minlength=self.texts).astype(float)
        self.samples: list[Sample] = []
        self.others = {} if others is None else others  # by code points and barred forms, on which alone they depend
        self.flat: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        # Waiting parts, per text: perturbed maximum, place of the first differing word, sample it stems from.
        self.waiting = [np.full((self.texts, 0), -np.inf), np.zeros((self.texts, 0), np.int64), np.zeros((self.texts, 0), np.int64)]

    def run(self) -> np.ndarray:
        """Draw the samples; returns the largest value that is left over for each text."""
        value = self.total - np.log(-np.log(uniform(shifted(self.key, 0))))
        split = self.bounds[:-1].copy()
        source = np.full(self.texts, -1)
        live = np.ones(self.texts, bool)
        for number in range(self.k):
            self._emit(number, live, value, split, source)
            self._split(number, live, value, split, source)
            best = self.waiting[0].argmax(axis=1) if self.waiting[0].shape[1] else np.zeros(self.texts, np.int64)
            rows = np.arange(self.texts)
            if not self.waiting[0].shape[1]:
                return np.full(self.texts, -np.inf)
            value, split, source = (w[rows, best] for w in self.waiting)
            if number + 1 < self.k:
                self.waiting[0][rows, best] = -np.inf
            live = np.isfinite(value)
        return value

    def _emit(self, number: int, live: np.ndarray, value: np.ndarray, split: np.ndarray, source: np.ndarray) -> None:
        words = np.arange(len(self.found.owner))
        owner = self.found.owner
        # Equal words are drawn side by side, so that the lattice is read in its order.
        if number == 0:
            fresh = self.found.order
            word_log, shape = np.zeros(len(words)), np.zeros(len(words), np.uint64)
            stems = np.full(len(words), 0)
        else:
            of = np.maximum(source, 0)[owner]
            word_log = np.choose(of, [s.word_log for s in self.samples])
            shape = np.choose(of, [s.shape for s in self.samples])
            stems = np.choose(of, [s.source for s in self.samples])
            fresh = self.found.order
            fresh = fresh[(live[owner] & (words >= split[owner]))[fresh]]
            stems[fresh] = number
        log, form, edges = self.lattice.draw(self.found.word[fresh], shifted(self.word_key[fresh], number))
        word_log[fresh], shape[fresh] = log, form
        kept = [(fresh[a], edge) for a, edge in edges]
        if number:
            kept = self._redraw(number, live, split, source, word_log, shape, kept)
        self.samples.append(Sample(live, np.bincount(owner, word_log, minlength=self.texts).astype(float), value, word_log, shape, kept, stems))

    def _bars(self, split: np.ndarray, source: np.ndarray) -> list[np.ndarray]:
        """Per text, the segmentations that the word at ``split`` must differ from: one array for each earlier sample."""
        out = []
        last = max(len(self.found.owner) - 1, 0)
        place = np.minimum(split, last)
        for number, sample in enumerate(self.samples):
            # An earlier sample bars its form where it has the same words before the split.
            out.append(np.where(self._same_before(number, source, split), sample.shape[place] if len(sample.shape) else np.uint64(0), np.uint64(0)))
        return out

    def _same_before(self, number: int, source: np.ndarray, split: np.ndarray) -> np.ndarray:
        """Texts of which sample ``number`` exists and agrees with sample ``source`` on all words before ``split``."""
        result = self.samples[number].live.copy()
        for other in range(len(self.samples)):
            some = np.flatnonzero((source == other) & result)
            if other == number or not len(some):
                continue
            differ = self.samples[number].shape != self.samples[other].shape
            before = np.concatenate(([0], np.cumsum(differ)))
            result[some] &= before[split[some]] == before[self.bounds[some]]
        return result

    def _forms(self, words: np.ndarray, upto: int) -> list[dict[int, tuple[int, ...]]]:
        """The edges of the given words in each of the first samples."""
        wanted = np.zeros(len(self.found.owner), bool)
        wanted[words] = True
        drawn: list[dict[int, list[int]]] = []
        for sample in self.samples[:upto]:
            own: dict[int, list[int]] = {}
            for word, edge in sample.edges:
                some = np.flatnonzero(wanted[word])
                take = self.lattice.length_of[self.lattice.piece[edge[some]]] - 1
                for w, t in zip(word[some].tolist(), take.tolist()):
                    own.setdefault(w, []).append(t)
            drawn.append(own)
        return [{w: tuple(drawn[sample.source[w]].get(w, ())) for w in words.tolist()} for sample in self.samples[:upto]]

    def _redraw(self, number, live, split, source, word_log, shape, kept):  # noqa: ANN001, ANN202
        """Draw the words at the split until none has a barred form."""
        bars = self._bars(split, source)
        texts = np.flatnonzero(live)
        bad = texts[np.any([shape[split[texts]] == b[texts] for b in bars], axis=0)] if len(texts) else texts
        done, redrawn = np.zeros(len(self.found.owner), bool), []
        for attempt in range(1, TRIES + 1):
            if not len(bad):
                break
            word = split[bad]
            log, form, edges = self.lattice.draw(self.found.word[word], shifted(self.word_key[word], 1000 * attempt + number))
            ok = ~np.any([form == b[bad] for b in bars], axis=0)
            done[word[ok]] = True
            word_log[word[ok]], shape[word[ok]] = log[ok], form[ok]
            redrawn += [(word[a][ok[a]], e[ok[a]]) for a, e in edges]
            bad = bad[~ok]
        if len(bad):
            word = split[bad]
            forms = self._forms(word, number)
            keys = shifted(self.word_key[word], 1000 * (TRIES + 1) + number)
            takes = []
            for text, w, key in zip(bad.tolist(), word.tolist(), keys):
                barred = {own[w] for own, bar in zip(forms, bars) if bar[text]}
                others = self._others(int(self.found.word[w]), barred)
                takes.append(others.draw(key) if np.isfinite(others.log) else ())
            live[bad[[not t for t in takes]]] = False  # it has no other form
            word, takes = word[[bool(t) for t in takes]], [t for t in takes if t]
            done[word] = True
            word_log[word], shape[word] = 0, 0
            row = self.lattice.first[self.found.word[word]]
            for step in range(max(map(len, takes), default=0)):
                some = np.flatnonzero([len(t) > step for t in takes])
                take = np.array([takes[i][step] for i in some])
                w, edge = word[some], self.lattice.edges(row[some], take)
                word_log[w] += self.lattice.log_of[self.lattice.piece[edge]]
                shape[w] = mix(shape[w] + (take + 1).astype(np.uint64) * np.uint64(_STEP))
                redrawn.append((w, edge))
                row[some] = self.lattice.target[edge]
        return [(w[~done[w]], e[~done[w]]) for w, e in kept] + redrawn

    def _others(self, word: int, barred: set[tuple[int, ...]]) -> Others:
        start, n = self.found.start[word], self.found.length[word]
        key = self.found.points[start : start + n].tobytes(), frozenset(barred)
        if key not in self.others:
            self.others[key] = Others.of(self.lattice, word, sorted(barred))
        return self.others[key]

    def _close(self, number: int, words: np.ndarray, split: np.ndarray, bars: list[np.ndarray]) -> np.ndarray:
        """Log of what is left of the given words of a sample, where next to nothing is."""
        # Equal words of equal form count once; bars can hold for the words at the split only.
        of, shape, at = self.found.word[words], self.samples[number].shape[words], split[self.found.owner[words]] == words
        order = np.lexsort((shape, of))
        new = np.ones(len(words), bool)
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (of, shape)], axis=0) | at[order[1:]] | at[order[:-1]]
        some = np.sort(order[new])
        forms = self._forms(words[some], number + 1)
        log = np.zeros(len(words))
        for i, w in zip(some.tolist(), words[some].tolist()):
            text = self.found.owner[w]
            barred = {forms[number][w]} | {own[w] for own, bar in zip(forms, bars) if at[i] and bar[text]}
            log[i] = self._others(int(self.found.word[w]), barred).log
        out = np.empty(len(words))
        out[order] = log[order[new]][np.cumsum(new) - 1]
        return out

    def _split(self, number: int, live: np.ndarray, value: np.ndarray, split: np.ndarray, stem: np.ndarray) -> None:
        """Parts of the popped node without its sample, by the first word that differs."""
        sample = self.samples[number]
        owner = self.found.owner
        words = np.arange(len(owner))
        share = sample.word_log - self.mass  # log probability of the word's form
        # Summed text by text, so that no text's sums depend on its neighbours.
        ahead = np.concatenate([np.cumsum(share[a:b]) for a, b in zip(self.bounds[:-1], self.bounds[1:])] or [share]) - share
        taken = np.exp(share)
        source = np.full(self.texts, number)
        at = np.minimum(split, max(len(words) - 1, 0))
        if number and len(words):
            # At the split word, the forms barred before stay barred.
            seen = [sample.shape[at]]
            extra = np.zeros(self.texts)
            for earlier in range(number):
                same = self._same_before(earlier, source, split)
                form = self.samples[earlier].shape[at]
                new = same & live & ~np.any([form == s for s in seen], axis=0)
                extra += np.where(new, np.exp(self.samples[earlier].word_log[at] - self.mass[at]), 0)
                seen.append(np.where(same, form, seen[0]))
            np.add.at(taken, at[live], extra[live])
        rest = 1 - taken
        with np.errstate(divide="ignore"):
            log_rest = np.log(np.maximum(rest, 0))
        own = live[owner] & (words >= split[owner])
        close = np.flatnonzero(own & (rest < CLOSE))
        if len(close):
            log_rest[close] = self._close(number, close, split, self._bars(split, stem)[:number])
        log_mass = np.where(own, self.total[owner] + ahead + log_rest, -np.inf)
        g = log_mass - np.log(-np.log(uniform(shifted(self.word_key, 7_000_000 + number))))
        cut = -np.logaddexp(-value[owner], -g)
        cut[np.isneginf(log_mass)] = -np.inf
        for _ in range(self.k - number):
            best = _best(cut, self.bounds)
            ok = best >= 0
            column = np.full((self.texts, 1), -np.inf)
            column[ok, 0] = cut[best[ok]]
            self.waiting[0] = np.hstack((self.waiting[0], column))
            self.waiting[1] = np.hstack((self.waiting[1], np.maximum(best, 0)[:, None]))
            self.waiting[2] = np.hstack((self.waiting[2], np.full((self.texts, 1), number)))
            cut[best[ok]] = -np.inf

    def ids(self, number: int, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a sample, text after text, and where each text starts."""
        size, out = self._flat(number, vocabulary)
        return out, np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[self.bounds]

    def _flat(self, number: int, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has in a sample, and all ids."""
        if number in self.flat:
            return self.flat[number]
        sample, lattice = self.samples[number], self.lattice
        size = np.zeros(len(self.found.owner), np.int32)
        picked = []
        for word, edge in sample.edges:
            piece, shift = lattice.piece[edge], size[word]
            picked.append((word, edge, piece, shift))
            size[word] = shift + lattice.count_of[piece]
        taken = []
        for s in range(number):
            of = sample.source == s
            if of.any():
                many, ids = self._flat(s, vocabulary)
                size[of] = many[of]
                taken.append((of, ids[np.repeat(of, many)]))
        start = np.cumsum(size, dtype=np.int64) - size
        out = np.zeros(int(size.sum()), np.int32)
        for of, ids in taken:
            out[np.repeat(of, size)] = ids
        for word, edge, piece, shift in picked:
            at = start[word] + shift
            out[at] = piece
            some = np.flatnonzero(piece >= len(vocabulary.names))
            point = lattice.points[np.searchsorted(lattice.spelled, edge[some])]
            many = byte_count(point)
            for byte in range(4):
                has = np.flatnonzero(many > byte)
                data = point[has] >> (6 * (many[has] - 1 - byte)).astype(np.uint32)
                data = LEADS[many[has]] | data if not byte else data & 0x3F | 0x80
                out[at[some[has]] + byte] = vocabulary.first_byte + data
        self.flat[number] = size, out
        return size, out


SAMPLE = "sample int, log_prob double, perturbed double, inclusion double"


def _samples(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, k: int) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray]]:
    """(columns but for the ids, ids of all texts, where each begins, rows that have the sample) by chunk and sample."""
    others: dict[tuple[bytes, frozenset], Others] = {}
    for batch in batches:
        keys = batch.column(0).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        for first, texts in parts(batch.column(1), CHUNK_CHARS):
            found = PreTokens.of(texts)
            search = Search(found, Lattice.of(found, vocabulary), keys[first : first + len(texts)], k, others)
            bar = search.run()
            if sum(len(points) for points, _ in others) > KEPT_BYTES:
                others.clear()
            own = batch.column(0).slice(first, len(texts))
            for number, s in enumerate(search.samples):
                ids, bounds = search.ids(number, vocabulary)
                live = np.flatnonzero(s.live)
                chance = -np.expm1(-np.exp(np.minimum(s.log - bar, 700)))
                columns = [
                    own.take(pa.array(live)), pa.array(np.full(len(live), number, np.int32)), pa.array(s.log[live]),
                    pa.array(s.value[live]), pa.array(chance[live]),
                ]
                yield columns, ids, bounds, live


def segmentations(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, path: str = MODEL) -> DataFrame:
    """(key, sample, log_prob, perturbed, inclusion, ids) of up to k distinct segmentations of each text."""
    vocabulary = Vocabulary.load(path)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, ids, bounds, live in _samples(batches, vocabulary, k):
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)).take(pa.array(live))
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[key, "sample", "log_prob", "perturbed", "inclusion", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(sample, f"{key} {kind}, {SAMPLE}, ids array<int>")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, path: str = MODEL) -> DataFrame:
    """The same with n_tokens and ids_crc32 (little-endian unsigned 32-bit ids) in place of the ids, which do not leave their task."""
    vocabulary = Vocabulary.load(path)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, ids, bounds, live in _samples(batches, vocabulary, k):
            flat = ids.astype("<u4")
            crc = [zlib.crc32(flat[bounds[i] : bounds[i + 1]]) for i in live]
            sizes = np.diff(bounds)[live].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sizes), pa.array(crc, pa.int64())], names=[key, "sample", "log_prob", "perturbed", "inclusion", "n_tokens", "ids_crc32"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(sample, f"{key} {kind}, {SAMPLE}, n_tokens long, ids_crc32 long")


def decoded(sampled: DataFrame, path: str = MODEL) -> DataFrame:
    """``sampled`` with the text that its ids stand for."""
    vocabulary = Vocabulary.load(path)
    at = sampled.columns.index("ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else vocabulary.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sampled.schema.fields)
    return sampled.mapInArrow(decode, f"{columns}, decoded string")
