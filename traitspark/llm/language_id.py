"""Language of a text by n-gram filters that answer for all languages at once.

Learning counts the letter n-grams of every language's texts. A language has an
n-gram if it makes up at least ``FLOOR`` of the language's n-grams and is at least
``SHARE`` times as frequent there as where it is most frequent. All languages share one
Bloom filter whose slots are not bits but bitmasks, one bit a language (a filter a
language, cut into slices across languages): an n-gram sets its languages' bits in
``HASHES`` slots, and the AND of these slots gives all languages that have it.

Prediction adds up, for each language, how many n-grams of a whole text have its
bit. A filter answers falsely with a probability that is known from the share of
slots with the language's bit, so ``n`` n-grams with ``hits`` count as
``(hits - n * false) / (1 - false)``. The language with the largest corrected count
wins, the first by name of equal ones; the score is its share of all languages'.

At most ``1 / FLOOR`` n-grams belong to a language, so the filter's size is bounded by
the number of languages whatever the corpus; it is sized by the counted n-grams up to
``MAX_SLOTS``, and if there are more, false answers become likelier and are corrected.
Grams are taken from different words of a piece of the input once and weighted by
the words' counts, and added up in tasks before they are shuffled.

Words are runs of letters (Unicode category L) of the lower-cased text; n-grams have
``SIZES`` characters and may begin or end with the word's edge.

Results for odd input: a null text, or one without a letter, is ``und`` with score 0; a
text for none of whose n-grams the filter answers (another script) is given the language
with most n-grams learned, with score 0, or ``und`` if nothing was learned; null languages
and null texts teach nothing; rows that repeat a ``doc_id``, or have none, are judged each
(a null ``doc_id`` is never learned from nor held out); an empty table gives an empty
result; a text of any length is read whole, as a piece of its own; other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread
from .words import mix, signed, unsigned

SIZES = (1, 2, 3, 4, 5)
#: Least share of a language's n-grams.
FLOOR = 1e-5
#: Least frequency in comparison with the language that has the n-gram most often.
SHARE = 0.5
HASHES = 4
#: Slots for each n-gram, and the most slots (64 MB for up to 64 languages).
SLOTS = 16
MAX_SLOTS = 1 << 23
#: Characters of text handled at once; a longer text is a piece of its own.
PIECE_CHARS = 1 << 20
#: N-grams a task holds before it adds them up, and before it gives away what it has.
HELD = 1 << 22

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


class Grams:
    """N-grams of the different words of some texts.

    ``word`` has the word of each n-gram ``gram``; ``of`` has the word of each place and
    ``row`` its text.
    """

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        sizes = np.array([len(t) + 1 for t in lower], np.int64)
        points = np.frombuffer(" ".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = letters()[points]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.row = np.searchsorted(np.cumsum(sizes), start, side="right")
        self.has_letter = np.bincount(self.row, minlength=len(texts)) > 0
        size = end - start
        if not len(start):
            self.of = self.word = np.zeros(0, np.int64)
            self.gram, self.words = np.zeros(0, np.uint64), 0
            return
        # different words by a hash of their characters and places
        first = np.cumsum(size) - size
        mixed = mix(points[inside].astype(np.uint64))
        place = np.arange(len(mixed)) - np.repeat(first, size)
        key = mix(np.add.reduceat(mixed * (mix(place.astype(np.uint64)) | np.uint64(1)), first) + size.astype(np.uint64))
        _, which, self.of = np.unique(key, return_index=True, return_inverse=True)
        self.words = len(which)
        # the different words with one space around each
        size = size[which]
        at = np.cumsum(size + 1) - size
        line = np.full(int((size + 1).sum()) + 1, np.uint32(32))
        spot = np.repeat(at, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        line[spot] = points[np.repeat(start[which], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
        owner = np.zeros(len(line), np.int64)
        owner[at - 1] = np.arange(self.words)
        owner[spot] = np.repeat(np.arange(self.words), size)
        space = line == 32
        mixed = mix(line.astype(np.uint64))
        grams, words = [], []
        for n in SIZES:
            total = np.full(max(len(line) - n + 1, 0), np.uint64(n))
            good = np.ones(len(total), bool)
            for j in range(n):
                total += mixed[j : j + len(total)] * (mix(np.array([100 * n + j], np.uint64)) | np.uint64(1))
                if 0 < j < n - 1 or n == 1:
                    good &= ~space[j : j + len(total)]
            keep = np.flatnonzero(good)
            grams.append(mix(total[keep]))
            # a window that begins with a space belongs to the word after it, whose owner the space has
            words.append(owner[keep])
        self.gram, self.word = np.concatenate(grams), np.concatenate(words)


def cut(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of about ``PIECE_CHARS``; every row is in one."""
    sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    until, low = np.cumsum(sizes), 0
    while low < batch.num_rows:
        high = max(int(np.searchsorted(until, until[low] - sizes[low] + PIECE_CHARS, side="right")), low + 1)
        yield batch.slice(low, high - low)
        low = high


def _count_rows(batches):
    """``lang, gram, n`` of the task's texts, added up as far as memory allows."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def compact() -> int:
        for lang, parts in held.items():
            gram, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            held[lang] = [(gram, n)]
        return sum(len(parts[0][0]) for parts in held.values())

    def given() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            for gram, n in parts:
                for low in range(0, len(gram), 1 << 16):
                    part = slice(low, low + (1 << 16))
                    names = pa.array([lang] * len(gram[part]), pa.string())
                    yield pa.RecordBatch.from_arrays([names, pa.array(signed(gram[part])), pa.array(n[part])], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for part in cut(batch):
            langs, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
            for lang in dict.fromkeys(langs):
                found = Grams([t for t, own in zip(texts, langs) if own == lang])
                times = np.bincount(found.of, minlength=found.words)
                held.setdefault(lang, []).append((found.gram, times[found.word]))
                size += len(found.gram)
            if size >= HELD:
                size = compact()
                if size >= HELD // 2:
                    yield from given()
                    size = 0
    compact()
    yield from given()


def _slots(gram: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    for j in range(HASHES):
        yield (mix(gram + np.uint64(j)) & np.uint64(slots - 1)).astype(np.int64)


class Filter:
    """Masks of the slots, a row of 64-bit words for each 64 languages."""

    def __init__(self, languages: list[str], slots: int, fallback: str):
        self.languages, self.fallback = languages, fallback
        self.masks = np.zeros((-(-len(languages) // 64) or 1, slots), np.uint64)

    def put(self, gram: np.ndarray, word: np.ndarray, mask: np.ndarray) -> None:
        for slot in _slots(gram, self.masks.shape[1]):
            np.bitwise_or.at(self.masks, (word, slot), mask)

    def close(self) -> None:
        """The probability of a false answer of each language."""
        fill = [np.mean((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(self.languages))]
        self.false = np.minimum(np.array(fill) ** HASHES, 0.999)

    def found(self, gram: np.ndarray) -> list[np.ndarray]:
        """Masks of the languages that have each n-gram."""
        out = None
        for slot in _slots(gram, self.masks.shape[1]):
            masks = self.masks[:, slot]
            out = masks if out is None else out & masks
        return list(out)

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        grams = Grams(texts)
        masks = self.found(grams.gram)
        per_word = np.bincount(grams.word, minlength=grams.words)
        n = np.bincount(grams.row, weights=per_word[grams.of], minlength=len(texts))
        likely = np.zeros((len(self.languages), len(texts)))
        for i in range(len(self.languages)):
            bit = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.bincount(grams.word, weights=bit, minlength=grams.words)
            hits = np.bincount(grams.row, weights=hits[grams.of], minlength=len(texts))
            likely[i] = np.maximum((hits - n * self.false[i]) / (1 - self.false[i]), 0)
        total = likely.sum(axis=0)
        best = likely.argmax(axis=0) if len(likely) else np.zeros(len(texts), np.int64)
        top = likely.max(axis=0, initial=0.0)
        score = np.divide(top, total, out=np.zeros(len(texts)), where=total > 0)
        names = [
            "und" if not letter else (self.languages[b] if t > 0 else self.fallback)
            for letter, b, t in zip(grams.has_letter, best, top)
        ]
        return names, score


def learn(docs: DataFrame) -> Filter:
    """The filter of all rows of ``docs`` with ``text`` and ``lang``."""
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = known.mapInArrow(_count_rows, "lang string, gram long, n long")
    counts = materialise(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    names = totals.orderBy("lang").collect()  # languages
    if not names:
        empty = Filter([], 1, "und")
        empty.close()
        return empty
    languages = [r.lang for r in names]
    spark = docs.sparkSession
    number = spark.createDataFrame([(r.lang, r.total, i) for i, r in enumerate(names)], "lang string, total long, i int")
    often = counts.join(F.broadcast(number), "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= FLOOR)
    # at most 1 / FLOOR n-grams a language from here on
    most = often.groupBy("gram").agg(F.max("rate").alias("most"))
    own = often.join(most, "gram").where(F.col("rate") >= SHARE * F.col("most"))
    masks = own.groupBy("gram", F.expr("i div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, i % 64)")).alias("mask"))
    found = masks.toArrow()
    slots = 64
    while slots < min(SLOTS * found.num_rows, MAX_SLOTS):
        slots *= 2
    out = Filter(languages, slots, max(names, key=lambda r: (r.total, r.lang)).lang)
    out.put(*(unsigned(found.column("gram").to_numpy()), found.column("word").to_numpy(), unsigned(found.column("mask").to_numpy())))
    out.close()
    return out


def predict(docs: DataFrame, learned: Filter, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score`` of every row."""
    rows = docs.select(*keep, "text")
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def emit(batches):
        for batch in batches:
            for part in cut(batch):
                names, score = shared.value.judge([t or "" for t in part.column("text").to_pylist()])
                columns = [*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in keep)
    return rows.mapInArrow(emit, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learns from the documents that are not held out and judges all.

    Held out are those whose CRC-32 of the id, as text, leaves ``held`` when divided by ``parts``.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    own = spread(own.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % parts == held))
    learned = learn(own.where(~F.col("held_out")))
    return predict(own, learned, ["doc_id", "held_out"])
