"""Quality rules: base counts of every text, and a hashed n-gram likelihood ratio.

Words and pairs of neighbouring words are hashed into ``buckets``. Their counts
over all documents give a raw multinomial, their counts over trusted documents
(label ``quality`` 1) a target one; both get the same prior of ``prior`` counts
in each bucket, so that rare buckets say little. A document's score is the mean
over its n-grams of ``log(target / raw)``, so it does not depend on length.

One trusted document in five, by a hash of its id, takes no part in the target
counts; these are scored like the documents that nobody labelled. The threshold
lies half as far again below their median as the score that a share ``reject``
of them stay under, so that good documents unlike the labelled ones pass. It is
read from a histogram with bins of fixed width: the same table always gives the
same verdicts.

Results for odd input: a null or empty text has zero words and fails the base
rules; a row without ``doc_id`` is scored and is never trusted; rows that repeat
a ``doc_id`` are scored each; without trusted documents the ratio is 0 and
nothing is rejected by it; an empty table gives an empty result; a text of any length
is read whole. Windows are compared by 64-bit hashes. Only named columns are read, so
clashing ones do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .words import SPACE, Words, pieces

BUCKETS = 1 << 16
PRIOR = 20.0
REPEAT = 8
BIN = 1 / 512

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = True

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def grams(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and of every pair of neighbours, and the text's row."""
    own = words.hashes()
    pair, at = words.runs(own, 2)
    bucket = (np.concatenate([own, pair]) & np.uint64(buckets - 1)).astype(np.int64)
    return bucket, np.concatenate([words.row, words.row[at]])


def _per_row(words: Words, flags: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array over each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[words.offsets[1:]] - total[words.offsets[:-1]]


def _duplicate_lines(words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    data, rows = words.data, len(words.count)
    out = np.zeros(rows, np.int64)
    breaks = data == 10
    many = np.flatnonzero(_per_row(words, breaks))
    raw = words.data.tobytes()
    for r in many.tolist():
        seen: set[bytes] = set()
        for line in raw[words.offsets[r] : words.offsets[r + 1]].split(b"\n"):
            if line in seen:
                out[r] += 1
            elif line.strip(b" \t\n\v\f\r"):
                seen.add(line)
    return out


def _repeated_words(words: Words, hashes: np.ndarray, width: int = REPEAT) -> np.ndarray:
    """Words in windows of ``width`` words that are found twice or more in their text."""
    out = np.zeros(len(words.count), np.int64)
    whole, at = words.runs(hashes, width)
    if not len(whole):
        return out
    order = np.lexsort((whole, words.row[at]))
    value, row = whole[order], words.row[at][order]
    same = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(hashes) + 1, np.int64)
    first = at[order[twice]]
    np.add.at(cover, first, 1)
    np.add.at(cover, first + width, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(words.row, weights=covered, minlength=len(words.count)).astype(np.int64)


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    data = words.data
    starts_char = (data & 0xC0) != 0x80
    return {
        "n_words": words.count,
        "word_chars": _per_row(words, starts_char & ~SPACE[data]),
        "n_symbols": _per_row(words, SYMBOL[data]),
        "n_dup_lines": _duplicate_lines(words),
        "n_repeat_words": _repeated_words(words, words.hashes()),
    }


def _count_rows(buckets: int):
    """One row per bucket and task."""

    def emit(batches):
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            trusted = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            for low, _, words in pieces(batch.column(0)):
                bucket, row = grams(words, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[trusted[low + row]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"]
        )

    return emit


def parts(trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trusted ids for the counts, and those for the threshold."""
    known = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    return known.where(~apart), known.where(apart)


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> np.ndarray:
    """``log(target / raw)`` of each bucket, from all documents.

    ``trusted`` has the different ``doc_id`` of trusted documents. The tasks send one row
    per bucket, so the driver gets ``buckets`` rows whatever the input.
    """
    known = trusted.withColumn("trusted", F.lit(True))
    # a merge join whatever the size: the same plan for every table, and no broadcast that grows
    marked = docs.select("doc_id", "text").join(known.hint("merge"), "doc_id", "left").select("text", "trusted")
    counts = (
        marked.mapInArrow(_count_rows(buckets), "bucket int, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toArrow()
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = counts.column("bucket").to_numpy()
    raw[at], target[at] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()
    if not target.sum():
        return np.zeros(buckets)
    expected = raw * (target.sum() / raw.sum())  # the raw multinomial at the target's size
    return np.log(target + prior) - np.log(expected + prior)


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``doc_id``, the base counts and ``score`` of every row."""
    buckets = len(ratio)

    def emit(batches):
        for batch in batches:
            for low, high, words in pieces(batch.column(1)):
                base = base_counts(words)
                bucket, row = grams(words, buckets)
                total = np.bincount(row, weights=ratio[bucket], minlength=high - low)
                size = np.bincount(row, minlength=high - low)
                mean = np.round(total / np.maximum(size, 1), 9)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), *(pa.array(base[c]) for c in BASE), pa.array(mean)],
                    ["doc_id", *BASE, "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        emit, "doc_id long, " + "".join(f"{c} long, " for c in BASE) + "score double"
    )


def threshold(scored: DataFrame, trusted: DataFrame, reject: float) -> float | None:
    """Of the trusted scores, the ``reject`` quantile less half its distance from the median, by histogram bins."""
    bins = (
        scored.where("n_words > 0").select("doc_id", F.floor(F.col("score") / F.lit(BIN)).alias("bin"))
        .join(trusted, "doc_id", "left_semi")
        .groupBy("bin")
        .count()
        .toArrow()  # scores lie within the log of the bucket counts: some ten thousand bins at most
        .to_pandas()
        .sort_values("bin")
    )
    if bins.empty:
        return None
    share = bins["count"].cumsum() / bins["count"].sum()
    low, middle = (float(bins["bin"][share > q].iloc[0]) for q in (reject, 0.5))
    return (low - (middle - low) / 2) * BIN


def judge(docs: DataFrame, trusted: DataFrame, reject: float = 0.005, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, ``score`` and ``kept`` of every document."""
    counted, apart = parts(trusted)
    scored = materialise(score(docs, fit(docs, counted, buckets)), "scores")
    least = threshold(scored, apart, reject)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    good = F.lit(True) if least is None else F.col("score") >= F.lit(least)
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & good)
