"""Quality rules: text statistics, then a hashed n-gram log-likelihood ratio, all as column expressions.

Every document is scored by how much likelier its n-grams are under a trusted
target than under the raw corpus. Both are multinomials over ``BUCKETS``
n-grams (words, and words with their successor), hashed by CRC-32, with add-one smoothing. The raw corpus is all
documents; the target is fitted on the texts of all documents labelled good. Log ratios are whole millionths, so sums do not depend on their
order; the sum is divided by the number of n-grams, so long texts are not
favoured. The threshold is fixed: equal texts always get equal verdicts.

Null text counts as empty: no words, no n-grams, a ratio of 0, and the base
rule on length rejects it. Rows with a null or repeated doc_id are scored like
any other; labels with null ids or grades are not used. Without good labels the
target is uniform. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrygrid.llm.importance import CRC_SQL, crc_sql
from carrygrid.llm.store import written

BUCKETS = 1 << 14
TARGET_ROWS = 20_000  # of the SQL alone, which states the result up to that many good labels
MILLION = 1_000_000
THRESHOLD = -0.12
WINDOW = 5
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _covered(windows: Column) -> Column:
    """Words inside the windows whose hash occurs twice or more."""

    def places(s: Column) -> Column:
        twice = F.filter(
            s,
            lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    placed = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return let(placed, lambda s: let(places(s), total))


def repeat_words(single: Column, pairs: Column) -> Column:
    """Number of words in five-word windows that the text holds twice or more, from the hashes of words and pairs."""

    def count(fours: Column) -> Column:
        whole = F.slice(fours, F.lit(1), F.size(fours) - WINDOW + 1)
        windows = F.transform(whole, lambda x, i: F.xxhash64(x, F.get(single, i + 4)))
        return let(
            windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))
        )

    fours = F.transform(pairs, lambda x, i: F.xxhash64(x, F.get(pairs, i + 2)))
    return F.when(F.size(single) > WINDOW, let(fours, count)).otherwise(F.lit(0))


def pair_hashes(single: Column) -> Column:
    """Hash of each word with its successor; the last word stands alone."""
    return F.transform(single, lambda x, i: F.xxhash64(x, F.get(single, i + 1)))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def bucket(x: Column, buckets: int) -> Column:
    return (F.crc32(x) % buckets).cast("int")


def ngram_buckets(w: Column, buckets: int) -> Column:
    """Buckets of all words, and of all words with their successor."""
    pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.when(y.isNotNull(), bucket(F.concat(x, F.lit(" "), y), buckets)))
    return F.concat(F.transform(w, lambda x: bucket(x, buckets)), F.filter(pairs, lambda x: x.isNotNull()))


def target_ids(labels: DataFrame) -> DataFrame:
    """(word, bits): which of the 64 doc_ids of each word the target is fitted on, all that are labelled good."""
    good = labels.where("quality = 1 and doc_id is not null")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place(F.col("doc_id")))
    return good.groupBy(word(F.col("doc_id")).alias("word")).agg(F.bit_or(bit).alias("bits"))


def word(doc_id: Column) -> Column:
    return F.shiftright(doc_id.cast("bigint"), 6)


def place(doc_id: Column) -> Column:
    return doc_id.cast("bigint").bitwiseAND(F.lit(63)).cast("int")


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The log ratio of each bucket, target over raw, in millionths.

    One row per bucket and task is shuffled, and ``buckets`` numbers come to the driver whatever the
    input. The ids of the target are stored first, at a number per 64 ids, so that Spark knows their size:
    it sends them to the texts while they are small, and shuffles the texts beyond that.
    """
    good = written(docs.sparkSession, target_ids(labels), "target")
    is_good = F.call_function("shiftright", F.coalesce("bits", F.lit(0)), place(F.col("doc_id"))).bitwiseAND(F.lit(1))
    counted = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(good, word(F.col("doc_id")) == F.col("word"), "left")
        .select(F.coalesce(is_good, F.lit(0)).alias("good"), F.explode(let(words(F.col("text")), lambda w: ngram_buckets(w, buckets))).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
        .collect()
    )
    raw, target = [0] * buckets, [0] * buckets
    for row in counted:
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    r, t = float(sum(raw) + buckets), float(sum(target) + buckets)
    return [math.floor(MILLION * math.log(float(y + 1) * r / (float(x + 1) * t))) for x, y in zip(raw, target)]


def quality(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS
) -> DataFrame:
    """All columns of ``docs`` that are not replaced, the four statistics, n_words, llr, base_failed and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # A constant of ``buckets`` numbers, so no row carries them.
    weights = F.from_json(F.lit(json.dumps(log_ratios(docs, labels, buckets))), "array<long>")

    def total(found: Column) -> Column:
        return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + F.get(weights, x))

    def counts(w: Column) -> Column:
        def both(single: Column) -> Column:
            return let(
                pair_hashes(single),
                lambda pairs: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    repeat_words(single, pairs).cast("long").alias("n_repeat_words"),
                    F.when(F.size(w) > 0, total(ngram_buckets(w, buckets)) / (2 * F.size(w) - 1) / MILLION).otherwise(0.0).alias("llr"),
                ),
            )

        return let(F.transform(w, lambda x: F.xxhash64(x)), both)

    plain = text
    for sign in SYMBOLS:
        plain = F.replace(plain, F.lit(sign), F.lit(""))
    scored = docs.withColumns(
        {
            "__counts": let(words(text), counts),
            "n_symbols": (F.length(text) - F.length(plain)).cast("long"),
            "n_dup_lines": dup_lines(text).cast("long"),
        }
    )
    found = {name: F.col(f"__counts.{name}") for name in ("n_words", "word_chars", "n_repeat_words", "llr")}
    return (
        scored.withColumns(found)
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
        .drop("__counts")
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs.select("doc_id", "text"), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.col("text"))
    return quality(inner, labels).where("kept").select("row.*")


_WORD = r"[^\x20\x09-\x0D]"

ORACLE = f"""
WITH {CRC_SQL},
own AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') AS w FROM documents),
placed AS (SELECT row, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM own),
runs AS (SELECT *, {", ".join(f"lead(word, {k}) OVER (PARTITION BY row ORDER BY i) AS w{k}" for k in range(1, WINDOW))} FROM placed),
twice AS (SELECT row, i, count(*) OVER (PARTITION BY row, word, {", ".join(f"w{k}" for k in range(1, WINDOW))}) AS n FROM runs WHERE w{WINDOW - 1} IS NOT NULL),
repeated AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM twice, range({WINDOW}) AS r(k) WHERE n > 1 GROUP BY row),
grams AS (SELECT row, doc_id, word AS gram FROM runs UNION ALL SELECT row, doc_id, word || ' ' || w1 FROM runs WHERE w1 IS NOT NULL),
per_doc AS (SELECT row, doc_id, gram, count(*) AS n FROM grams GROUP BY ALL),
hashed AS (SELECT gram, {crc_sql("gram")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT gram FROM per_doc), steps),
graded AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS name FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
good AS (SELECT doc_id FROM graded, steps ORDER BY {crc_sql("name")}, doc_id LIMIT {TARGET_ROWS}),
raw AS (SELECT bucket, sum(n) AS x, coalesce(sum(n) FILTER (doc_id IN (SELECT doc_id FROM good)), 0) AS y FROM per_doc JOIN hashed USING (gram) GROUP BY bucket),
totals AS (SELECT coalesce(sum(x), 0)::DOUBLE + {BUCKETS} AS xx, coalesce(sum(y), 0)::DOUBLE + {BUCKETS} AS yy FROM raw),
weights AS (SELECT bucket, floor({MILLION} * ln((y + 1)::DOUBLE * xx / ((x + 1)::DOUBLE * yy)))::BIGINT AS weight FROM raw, totals),
scores AS (SELECT row, sum(n * weight) AS total FROM per_doc JOIN hashed USING (gram) JOIN weights USING (bucket) GROUP BY row),
told AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    CASE WHEN len(w) > 0 THEN total::DOUBLE / (2 * len(w) - 1) / {MILLION} ELSE 0 END AS llr
  FROM own LEFT JOIN repeated USING (row) LEFT JOIN scores USING (row)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM told)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words,
  base_failed, NOT base_failed AND llr >= {THRESHOLD} AS kept, llr
FROM judged
"""
