"""Substring dedup: repeated paragraphs by MinHash banding, and repeated passages inside paragraphs.

Paragraphs are the lines of a text with ``LEAST_WORDS`` words or more. Their
five-word shingle sets are banded (``BANDS`` bands of ``ROWS`` MinHash values
find a pair at 0.75 with a chance of 99.3 %), colliding paragraphs are joined,
pairs are verified by exact Jaccard similarity (0.75 or more), and removals
follow from connected components: all paragraphs of a component go but those
of the document that holds its first one.

A passage that starts or ends inside a line has no paragraph of its own. So
texts are also cut at places that depend on the words around them alone; such
segments are the same wherever a passage stands. Windows are the shortest rows of whole
segments with ``LEAST_RUN`` words or more, from each segment on and up to each
segment; together they cover every longer row. Of equal windows the document with the smallest
id keeps its own, and they go elsewhere, so whatever goes stands in one other document
with at least that many words in sequence. Repeats within one document are left alone.

Null or empty texts have no paragraphs. Rows with a null doc_id are neither
compared nor changed. Repeated rows of one doc_id are one document. doc_id is any
64-bit number. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from carrygrid.llm.components import Filter, link_buckets
from carrygrid.llm.near_dup import SIGNED, band_keys, banded, classes, signatures
from carrygrid.llm.store import written
from carrygrid.llm.words import Chunk, chunks, combine, mix, powers

BANDS, ROWS = 6, 2
LEAST_WORDS = 50
LEAST_RUN = 24
REACH = 4  # a segment starts at a word whose hash is least among this many neighbours on either side
_Q = 0x9E3779B97F4A7C15
_Q_INVERSE = pow(_Q, -1, 1 << 64)


def paragraph_ids(doc_ids: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A number for each paragraph, whatever the doc_ids are: a hash of both."""
    own = mix(doc_ids.astype(np.int64).view(np.uint64)) + np.asarray(lines, np.int64).astype(np.uint64) * np.uint64(_Q)
    return mix(own).view(np.int64)


def paragraphs(chunk: Chunk) -> Iterator[tuple[int, int, int, int]]:
    """(text number, line number, first word, word after the last) of all long lines."""
    breaks = np.flatnonzero(chunk.data == 10)
    word_line = np.searchsorted(breaks, chunk.start)
    starts = np.flatnonzero(
        np.concatenate(([True], word_line[1:] != word_line[:-1])) | np.isin(np.arange(len(word_line)), chunk.word_bounds)
    ) if len(word_line) else np.zeros(0, np.int64)
    ends = np.append(starts, len(word_line))[1:]
    text = np.searchsorted(chunk.word_bounds, starts, "right") - 1
    before = np.searchsorted(breaks, chunk.bounds)
    for i in np.flatnonzero(ends - starts >= LEAST_WORDS):
        yield int(text[i]), int(word_line[starts[i]] - before[text[i]]), int(starts[i]), int(ends[i])


def _paragraph_sets(chunk: Chunk) -> Iterator[tuple[int, int, np.ndarray]]:
    fives = combine(chunk.hashes())
    for text, line, a, b in paragraphs(chunk):
        yield text, line, np.unique(fives[a : b - 4])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        for chunk in chunks(batch.column(1)):
            found = list(_paragraph_sets(chunk))
            if not found:
                continue
            sets = [s for _, _, s in found]
            keys = band_keys(signatures(sets, BANDS * ROWS), ROWS).view(np.int64)
            own = ids[[chunk.first + t for t, _, _ in found]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(paragraph_ids(own, [line for _, line, _ in found])),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                    pa.nulls(len(sets), pa.binary()),
                    pa.array(list(keys), pa.list_(pa.int64())),
                    pa.array(own),
                ],
                names=["id", "n_shingles", "set_hash", "signature", "bands", "doc_id"],
            )


def _numbered(chunk: Chunk, own: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """The paragraphs of a chunk and their numbers."""
    lines = list(paragraphs(chunk))
    return lines, paragraph_ids(own[[chunk.first + t for t, *_ in lines]], [line for _, line, *_ in lines])


def paragraph_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles): the full sets of the paragraphs with the given numbers, and of a few others."""
    wanted = Filter(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).cast(pa.int64()).to_numpy()
            for chunk in chunks(batch.column(1)):
                lines, number = _numbered(chunk, own)
                some = np.flatnonzero(wanted(number))
                if not len(some):
                    continue
                fives = combine(chunk.hashes())
                found = [np.unique(fives[lines[i][2] : lines[i][3] - 4]).tobytes() for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(number[some]), pa.array(found, pa.binary())], names=["id", "shingles"])

    return docs.mapInArrow(sets, "id long, shingles binary").groupBy("id").agg(F.min("shingles").alias("shingles"))


def segment_starts(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """First words of all segments, and the text of each."""
    words = chunk.hashes()
    owner = np.repeat(np.arange(chunk.rows), np.diff(chunk.word_bounds))
    pair = words * np.uint64(_Q)
    same = owner[1:] == owner[:-1]
    pair[:-1][same] += words[1:][same]
    value = mix(pair)
    # Texts stand apart by enough of the largest value that none sees another.
    place = np.arange(len(words)) + REACH * (owner + 1)
    line = np.full(len(words) + REACH * (chunk.rows + 1), np.iinfo(np.uint64).max, np.uint64)
    line[place] = value
    least = np.ones(len(words), bool)
    for k in range(1, REACH + 1):
        least &= (value < line[place - k]) & (value <= line[place + k])
    first = np.zeros(len(words) + 1, bool)
    first[chunk.word_bounds] = True
    starts = np.flatnonzero(least | first[:-1])
    return starts, owner[starts]


def windows(chunk: Chunk) -> tuple[np.ndarray, ...]:
    """Text, hash, first word within the text, words, first and last byte of all windows."""
    starts, owner = segment_starts(chunk)
    ends = np.append(starts, len(chunk.start))[1:]
    count = len(starts)
    each = np.arange(count)
    first = np.concatenate((each, np.searchsorted(starts, ends - LEAST_RUN, "right") - 1))
    last = np.concatenate((np.searchsorted(ends, starts + LEAST_RUN), each))
    some = np.flatnonzero((first >= 0) & (last < count))
    some = some[owner[first[some]] == owner[last[some]]]
    pair = np.unique(first[some] * max(count, 1) + last[some])
    first, last = pair // max(count, 1), pair % max(count, 1)
    owner, a, b = owner[first], starts[first], ends[last]
    words = chunk.hashes()
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(_Q, len(words) + 1)[:-1], out=sums[1:])
    hashes = mix((sums[b] - sums[a]) * powers(_Q_INVERSE, len(words) + 1)[a] + (b - a).astype(np.uint64))
    at = chunk.bounds[owner]
    return owner, hashes, a - chunk.word_bounds[owner], b - a, chunk.start[a] - at, chunk.end[b - 1] - at


def _window_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
        for chunk in chunks(batch.column(1)):
            owner, hashes, *_ = windows(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids[chunk.first + owner])], names=["hash", "doc_id"])


def _window_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows = (batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in (0, 2))
        for chunk in chunks(batch.column(1)):
            owner, hashes, *places = windows(chunk)
            at = chunk.first + owner
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes.view(np.int64)), pa.array(ids[at]), pa.array(rows[at]), *(pa.array(x.astype(np.int32)) for x in places)],
                names=["hash", "doc_id", "row", "number", "words", "start", "end"],
            )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping windows of a row that one document keeps, as one span."""
    for batch in batches:
        rows = []
        for doc_id, row, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
            runs: list[list[int]] = []
            for x in sorted(found, key=lambda x: (x["first_doc_id"], x["number"], x["words"])):
                if runs and runs[-1][0] == x["first_doc_id"] and x["number"] <= runs[-1][3] + runs[-1][4]:
                    run = runs[-1]
                    run[2], run[4] = max(run[2], x["end"]), max(run[4], x["number"] + x["words"] - run[3])
                else:
                    runs.append([x["first_doc_id"], x["start"], x["end"], x["number"], x["words"]])
            rows += [(doc_id, row, first, start, end, words) for first, start, end, _, words in runs]
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "row", "first_doc_id", "start", "end", "n_words"])


SPAN = "doc_id long, row long, first_doc_id long, start long, end long, n_words long"


def _paragraph_spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, row, first_doc_id, start, end, n_words) of the paragraphs that another document keeps."""
    signed = written(spark, docs.mapInArrow(_sign, f"{SIGNED}, doc_id long"), "paragraphs")
    grouped = classes(spark, signed)

    labels = link_buckets(spark, banded(spark, grouped), lambda ids: paragraph_sets(docs, ids))
    # The document with the smallest id of a component keeps its paragraph.
    members = (
        grouped.select(F.col("id").alias("own"), F.col("first_id").alias("id"))
        .join(labels, "id", "left")
        .select(F.col("own").alias("id"), F.coalesce("component", "id").alias("component"))
        .join(signed.select("id", "doc_id").distinct(), "id")
    )
    members = written(spark, members, "members")
    kept = members.groupBy("component").agg(F.min("doc_id").alias("kept_in"), F.max("doc_id").alias("last")).where("kept_in < last")
    gone = members.join(kept, "component").where("doc_id <> kept_in").select("id", "kept_in").distinct()
    gone = written(spark, gone, "gone")
    wanted = Filter(gone.select("id"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, hashed = (batch.column(i).cast(pa.int64()).to_numpy() for i in (0, 2))
            for chunk in chunks(batch.column(1)):
                lines, number = _numbered(chunk, own)
                some = np.flatnonzero(wanted(number))
                text = hashed[[chunk.first + lines[i][0] for i in some]]
                rows = [(chunk.start[a] - chunk.bounds[t], chunk.end[b - 1] - chunk.bounds[t], b - a) for t, _, a, b in (lines[i] for i in some)]
                columns = list(zip(*rows)) or [()] * 3
                docs_of = own[[chunk.first + lines[i][0] for i in some]]
                arrays = [pa.array(number[some]), pa.array(docs_of), pa.array(text), *(pa.array(c, pa.int64()) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "doc_id", "row", "start", "end", "n_words"])

    return (
        docs.mapInArrow(spans, "id long, doc_id long, row long, start long, end long, n_words long")
        .join(gone, "id")
        .select("doc_id", "row", F.col("kept_in").alias("first_doc_id"), "start", "end", "n_words")
        .distinct()
    )


def repeated_paragraphs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, first_doc_id, start, end, n_words) of the paragraphs that another document keeps."""
    return _paragraph_spans(spark, docs.select("doc_id", "text", F.xxhash64("text").alias("row"))).drop("row")


def repeated_segments(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Spans made of windows that a document with a smaller id holds too."""
    shared = (
        docs.mapInArrow(_window_keys, "hash long, doc_id long")
        .groupBy("hash")
        .agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"))
        .where("first_doc_id < last")
        .select("hash", "first_doc_id")
    )
    places = docs.mapInArrow(_window_places, "hash long, doc_id long, row long, number int, words int, start int, end int")
    found = places.join(shared, "hash").where("doc_id <> first_doc_id")
    listed = found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("number", "start", "end", "words", "first_doc_id")).alias("found"))
    return listed.mapInArrow(_runs, SPAN)


def _spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The removed spans by doc_id and row, the hash of the text that they belong to."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("row"))
    return _paragraph_spans(spark, docs).union(repeated_segments(spark, docs))


def repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per removed span: doc_id, first_doc_id that keeps the passage, byte span, n_words. Spans may overlap."""
    return _spans(spark, docs).drop("row")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not spans or text is None:
                out.append(text)
                continue
            data, kept, at = text.encode(), [], 0
            for start, end in sorted((x["start"], x["end"]) for x in spans):
                if start > at:
                    kept.append(data[at:start])
                at = max(at, end)
            kept.append(data[at:])
            out.append(_join([k.decode() for k in kept]))
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, pa.string())], names=[*batch.schema.names[2:], "cut"])


def _join(parts: list[str]) -> str:
    """Parts around removed spans, with one line break or space in place of a span."""
    text = ""
    for part in parts:
        body = part.strip()
        if body:
            gap = text[len(text.rstrip()) :] + part[: len(part) - len(part.lstrip())]
            text = text.rstrip() + (("\n" if "\n" in gap else " ") if text else "") + body
            text += part[len(part.rstrip()) :]
        else:
            text += part
    return text.strip()


def without_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without the repeated spans, n_chars counted anew; those of which nothing is left go."""
    spans = written(spark, _spans(spark, docs), "spans")
    listed = spans.groupBy("doc_id", F.col("row").alias("text_hash")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("text").alias("text_hash"))
    joined = rows.join(listed, ["doc_id", "text_hash"], "left").select("text", "spans", "row", F.col("spans").isNotNull().alias("changed"))
    schema = StructType([*joined.schema.fields[2:], StructField("cut", StringType())])
    cut = joined.mapInArrow(_cut, schema).where("not changed or cut <> ''")
    length = F.when(F.col("changed"), F.length("cut").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("cut"), "n_chars": length}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"row.{c}") for c in docs.columns])
