"""Removal of passages that an earlier document has: repeated-phrase automata.

Documents with the same words are handled first: all but the first lose every
word (if they fill a window) and take no part in what follows.

1. *Propose.* Every window of ``width`` words chooses its smallest 5-word hash
   as anchor, so equal windows choose equal anchors, and only about a fifth of
   the positions are anchors. Anchors found in two documents recur; they go
   into a bit filter of fixed size. Of the windows with such an anchor, the
   hashes found in two documents go into another filter.
2. *Confirm.* Runs of proposed windows with one anchor are stretches. Equal
   stretches are combined before they are shuffled; their windows are compared
   word by word, and those that start in two documents are phrases.
3. *Locate.* Stretches are dealt into shards by anchor. A task compiles the
   different phrases of its shard, neighbours with one first document as one,
   into Aho-Corasick automata over words, each for some of the anchors, and the
   stretches of every document stream through that of their anchor, equal ones once;
   a shard with many stretches is dealt over several tasks that each compile it.

Hashes only propose: phrases are compared word by word.

Results for odd input: a null text has no words; texts shorter than a window
lose nothing; a row without a ``doc_id`` neither removes nor loses words; rows
that repeat a ``doc_id`` are handled each by its own text and never remove
words from each other; an empty table gives an empty result. Only the two
named columns are read, so clashing extra columns do not matter.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .filters import FILTER_BITS, BitFilter, bit_filter, filter_words, hits, possibly
from .words import SPACE, Words, mix, pieces, signed, text_arrays

ANCHOR = 5
#: Automata of a shard. Finding a word among those that phrases begin with takes time in proportion to their number.
AUTOMATA = 32
#: Different words of an automaton that have a character each; with more, words are whole numbers.
CHARACTERS = 0x110000


def _windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows within one text: first word, place of the anchor, hash of the anchor."""
    gram, at = words.runs(words.codes(), ANCHOR)
    span = width - ANCHOR + 1
    n = len(at) - span + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.view(np.uint64)
    # the place goes into the low bits, so that a sliding minimum finds both
    low = np.uint64((1 << max(20, len(gram).bit_length())) - 1)
    packed = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    best = packed[:n].copy()
    for j in range(1, span):
        np.minimum(best, packed[j : n + j], out=best)
    window = np.flatnonzero(words.row[at[:n]] == words.row[at[span - 1 :]])
    chosen = (best[window] & low).astype(np.int64)
    return at[window], chosen, gram[chosen]


def _text_key(words: Words) -> np.ndarray:
    """A hash of each text's words, which tells rows with the same id apart."""
    out = np.zeros(len(words.count), np.uint64)
    full = np.flatnonzero(words.count)
    if len(full):
        place = np.arange(len(words)) - words.first[words.row]
        out[full] = np.add.reduceat(mix(words.codes() + mix(place.astype(np.uint64))), words.first[full])
    return mix(out + words.count.astype(np.uint64))


def _stand(doc: np.ndarray, text_key: np.ndarray) -> np.ndarray:
    """One number for a document and its words, as in :func:`remove_repeats`."""
    return text_key ^ (doc.astype(np.int64).view(np.uint64) << np.uint64(20))


def _known(batches, firsts: BitFilter):
    """Documents' ids and words, without those whose words an earlier one has."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for low, high, words in pieces(batch.column(1)):
            key = _text_key(words)
            own = hits(firsts, _stand(ids[low:high], key))
            if not own.all():
                bounds = words.offsets
                data = np.concatenate([words.data[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(own)] or [words.data[:0]])
                words = Words(data, np.concatenate([[0], np.cumsum(np.diff(bounds)[own])]))
            if own.any():
                yield ids[low:high][own], words, key[own]


def _key_rows(batches):
    for batch in batches:
        for low, high, words in pieces(batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.array(signed(_text_key(words)))], ["doc", "text_key"]
            )


def _pairs(key: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Different pairs of a piece."""
    order = np.argsort(key, kind="stable")  # equal keys of one text stay together
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return pa.RecordBatch.from_arrays([pa.array(signed(key[new])), pa.array(doc[new])], ["key", "doc"])


def _anchor_rows(width: int, firsts: BitFilter):
    def emit(batches):
        for ids, words, _ in _known(batches, firsts):
            first, place, key = _windows(words, width)
            new = np.ones(len(place), bool)
            new[1:] = place[1:] != place[:-1]
            yield _pairs(key[new], ids[words.row[first[new]]])

    return emit


def _window_rows(width: int, firsts: BitFilter, anchors: BitFilter):
    def emit(batches):
        for ids, words, _ in _known(batches, firsts):
            first, _, key = _windows(words, width)
            whole, _ = words.runs(words.codes(), width)
            some = hits(anchors, key)
            yield _pairs(whole[some], ids[words.row[first[some]]])

    return emit


def _stretch_rows(width: int, firsts: BitFilter, anchors: BitFilter, proposed: BitFilter):
    names = ["key", "doc", "text_key", "place", "stretch"]

    def emit(batches):
        for ids, words, text_key in _known(batches, firsts):
            first, place, key = _windows(words, width)
            whole, _ = words.runs(words.codes(), width)
            some = np.flatnonzero(hits(anchors, key) & hits(proposed, whole))
            first, place, key = first[some], place[some], key[some]
            new = np.ones(len(some), bool)
            new[1:] = (place[1:] != place[:-1]) | (np.diff(first) != 1)
            begin = np.flatnonzero(new)
            last = first[np.append(begin[1:], len(some)) - 1] if len(some) else first
            key, first = key[begin], first[begin]
            row = words.row[first]
            raw = words.data.tobytes()
            start, end = words.start[first].tolist(), words.end[last + width - 1].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(key)),
                    pa.array(ids[row]),
                    pa.array(signed(text_key[row])),
                    pa.array(first - words.first[row]),
                    pa.array([b" ".join(raw[a:b].split()) for a, b in zip(start, end)], pa.binary()),
                ],
                names,
            )

    return emit


class Phrases:
    """The automaton over the phrases of a shard's stretches, and where each stretch holds phrases."""

    def __init__(self, sources: list[pa.RecordBatch], width: int):
        """``sources``: the different stretches, with the first and the last document of each."""
        low, high = (np.concatenate([s.column(i).to_numpy() for s in sources]) for i in (2, 3))
        self.texts = pa.concat_arrays([s.column(6) for s in sources])
        texts = self.texts.cast(pa.large_binary())
        words = Words(*byte_arrays(texts))
        # words are numbered by their bytes, so that equal numbers are equal words
        size = words.end - words.start
        only = [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)])), pa.py_buffer(words.data[~SPACE[words.data]])]
        named = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), only).dictionary_encode()
        number = named.indices.to_numpy().astype(np.int64) + 1
        self.bounds = words.first.tolist()
        text = len(named.dictionary) < CHARACTERS
        self.numbers = number.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") if text else number.tolist()
        kind = [] if text else [ahocorasick.KEY_SEQUENCE]
        self.automaton, self.located = ahocorasick.Automaton(ahocorasick.STORE_ANY, *kind), {}
        window, at = words.runs(mix(number.view(np.uint64)), width)
        order, begin = equal_runs(number, window, at, width)
        if not len(begin):
            return
        # first and last document of each window, over all stretches that hold it
        count = np.diff(np.append(begin, len(order)))
        row = words.row[at]
        first, last = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        first[order] = np.repeat(np.minimum.reduceat(low[row[order]], begin), count)
        last[order] = np.repeat(np.maximum.reduceat(high[row[order]], begin), count)
        phrase = np.flatnonzero(first < last)
        at, first = at[phrase], first[phrase]
        new = np.ones(len(at), bool)  # runs of phrases with one first document
        new[1:] = (np.diff(at) != 1) | (first[1:] != first[:-1])
        begin = np.flatnonzero(new)
        ends = at[np.append(begin[1:], len(at)) - 1] + width if len(at) else at
        for i, j, document in zip(at[begin].tolist(), ends.tolist(), first[begin].tolist()):
            self.automaton.add_word(self._key(i, j), (j - i, document))
        if len(self.automaton):
            self.automaton.make_automaton()

    def _key(self, i: int, j: int):
        own = self.numbers[i:j]
        return own if isinstance(own, str) else tuple(own)

    def spans(self, source: int) -> list[tuple[int, int, int]]:
        """``begin, end, first document`` in a stretch, which streams through once."""
        if source not in self.located:
            found = sorted(
                (stop - size + 1, -stop - 1, first)
                for stop, (size, first) in self.automaton.iter(self._key(self.bounds[source], self.bounds[source + 1]))
            )
            kept, reached = [], 0
            for begin, end, first in found:
                if -end > reached:  # else within one that is found, whose windows it has
                    kept.append((begin, -end, first))
                    reached = -end
            self.located[source] = kept
        return self.located[source]

    def rows(self, streams: pa.RecordBatch) -> list[np.ndarray]:
        """``doc, text_key, begin, end`` of what an earlier document has, in the order of the stretches."""
        # every stretch is among its shard's different ones
        source = pc.index_in(streams.column(6), value_set=self.texts).to_numpy()
        used, which = np.unique(source, return_inverse=True)
        spans = [self.spans(i) for i in used.tolist()]
        count = np.array([len(x) for x in spans], np.int64)
        flat = np.array([y for x in spans for y in x], np.int64).reshape(-1, 3)
        of = np.repeat(np.arange(len(source)), count[which])
        total = np.cumsum(count[which])
        at = (np.cumsum(count) - count)[which][of] + np.arange(len(of)) - (total - count[which])[of]
        doc, text_key, place = (streams.column(i).to_numpy()[of] for i in (3, 4, 5))
        late = flat[at, 2] < doc
        return [doc[late], text_key[late], (place + flat[at, 0])[late], (place + flat[at, 1])[late]]


def byte_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets, from zero on, of an array of large binaries without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def equal_runs(number: np.ndarray, window: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of windows of words that puts equal ones together, and where each different one begins.

    ``window``: their hashes, which only propose: words are compared, and windows with a hash that
    different ones share are ordered by their words.
    """
    order = np.argsort(window, kind="stable")
    if not len(order):
        return order, order
    new = np.ones(len(order), bool)
    new[1:] = np.diff(window[order]) != 0
    same = np.ones(len(order), bool)
    for j in range(width):
        own = number[at[order] + j]
        same[1:] &= own[1:] == own[:-1]
    if (~new & ~same).any():
        order = np.lexsort([number[at + j] for j in reversed(range(width))])
        new = np.zeros(len(order), bool)
        new[0] = True
        for j in range(width):
            own = number[at[order] + j]
            new[1:] |= own[1:] != own[:-1]
    return order, np.flatnonzero(new)


def _locate(width: int):
    """Rows come by shard, here that of one automaton: first its different stretches with first and last document, then those of all documents."""

    def emit(batches):
        shard, sources, phrases = None, [], None
        for batch in batches:
            out = [[np.zeros(0, np.int64)] * 4]
            of = [batch.column(i).to_numpy() for i in (0, 1)] + [batch.column(2).is_null().to_numpy(zero_copy_only=False)]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in of], axis=0)) + 1 if batch.num_rows else []
            for low, high in zip([0, *cut], [*cut, batch.num_rows]):
                part = batch.slice(low, high - low)
                if not part.num_rows:
                    continue
                if (of[0][low], of[1][low]) != shard:
                    shard, sources, phrases = (of[0][low], of[1][low]), [], None
                if not of[2][low]:
                    sources.append(part)
                    continue
                if phrases is None:
                    phrases, sources = Phrases(sources, width), []
                if len(phrases.automaton):
                    out.append(phrases.rows(part))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["doc", "text_key", "begin", "end"])

    return emit


def _plain_rows(batches):
    """Documents that lose nothing."""
    for batch in batches:
        data, offsets = text_arrays(batch.column(1))
        raw, bounds = data.tobytes(), offsets.tolist()
        words = [raw[a:b].split() for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(np.zeros(len(words), np.int64)),
                pa.array([b" ".join(w) for w in words], pa.binary()),
            ],
            ["doc_id", "n_words", "n_removed", "kept"],
        )


def _affected_rows(batches):
    """Documents that may lose words, with the hash of these."""
    for batch in batches:
        for low, high, words in pieces(batch.column(1)):
            raw, bounds = words.data.tobytes(), words.offsets.tolist()
            kept = [b" ".join(raw[a:b].split()) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.array(words.count), pa.array(signed(_text_key(words))), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "text_key", "kept"],
            )


def _cut_rows(width: int):
    def emit(batches):
        for batch in batches:
            yield _cut(batch, width)

    return emit


def _cut(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    ids, count, texts, spans = (batch.column(i) for i in range(4))
    removed, kept = [], []
    for text, ranges in zip(texts.to_pylist(), spans.to_pylist()):
        words = text.split()
        drop = np.zeros(len(words), bool)
        for span in ranges or []:
            if span["end"] >= 0:
                drop[span["begin"] : span["end"]] = True
            elif len(words) >= width:
                drop[:] = True
        removed.append(int(drop.sum()))
        kept.append(b" ".join([w for w, gone in zip(words, drop) if not gone]))
    return pa.RecordBatch.from_arrays(
        [ids, count, pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"]
    )


def remove_repeats(
    docs: DataFrame,
    width: int = 13,
    shard_stretches: int = 20_000,
    task_stretches: int = 40_000,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: ``kept`` has the remaining words joined by one space (binary UTF-8).

    A word goes when a window of ``width`` words covers it whose words also
    start in a document with a smaller ``doc_id``. ``shard_stretches`` and
    ``task_stretches`` set the size of a shard's automata and of a task, not what
    is found.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    known = texts.where("doc_id is not null")

    def recurring(rows: DataFrame) -> BitFilter:
        both = rows.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
        return bit_filter(both, "key", filter_bits)

    keys = materialise(known.mapInArrow(_key_rows, "doc long, text_key long"), "keys")
    same = keys.groupBy("text_key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    stand = F.col("text_key").bitwiseXOR(F.expr("shiftleft(low, 20)")).alias("stand")
    firsts = bit_filter(same.select(stand), "stand", filter_bits)
    anchors = recurring(known.mapInArrow(_anchor_rows(width, firsts), "key long, doc long"))
    proposed = recurring(known.mapInArrow(_window_rows(width, firsts, anchors), "key long, doc long"))
    stretches = known.mapInArrow(
        _stretch_rows(width, firsts, anchors, proposed), "key long, doc long, text_key long, place long, stretch binary"
    )
    stretches = materialise(stretches, "stretches")  # two readers
    for found in (firsts, anchors, proposed):
        found.drop()
    different = materialise(
        stretches.groupBy("key", "stretch").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count(F.lit(1)).alias("n")),
        "stretches",
    )
    shards = max(1, -(-different.count() // shard_stretches))
    # a shard is dealt out as a whole and has several automata, as all its phrases hang on the root of one
    shard = F.pmod(F.xxhash64("key"), F.lit(shards * AUTOMATA)).cast("long")
    group = F.floor(shard / F.lit(AUTOMATA)).cast("long").alias("group")
    salts = different.groupBy(group).agg(F.ceil(F.sum("n") / F.lit(task_stretches)).cast("int").alias("salts"))
    none = F.lit(None).cast("long")
    of_shard = {"shard": shard, "group": group}
    streams = stretches.withColumns(of_shard).join(F.broadcast(salts) if shards <= 10_000 else salts, "group").select(
        "shard", F.pmod(F.xxhash64("doc", "place"), F.col("salts")).cast("int").alias("salt"), none.alias("low"),
        "doc", "text_key", "place", "stretch",
    )
    sources = different.withColumns(of_shard).join(salts, "group").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "low",
        F.col("high").alias("doc"), none.alias("text_key"), none.alias("place"), "stretch",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = (
        sources.union(streams)
        .repartition(parts, F.floor(F.col("shard") / F.lit(AUTOMATA)), "salt")
        .sortWithinPartitions("shard", "salt", F.col("low").isNull())
        .mapInArrow(_locate(width), "doc long, text_key long, begin long, end long")
    )
    # a join of its own, which adaptive execution splits where many documents have one text
    copies = materialise(keys.join(same.where("low < high"), "text_key").where("doc > low").distinct(), "copies")
    spans = spans.union(copies.select("doc", "text_key", F.lit(0).cast("long"), F.lit(-1).cast("long")))  # -1: to the end
    # a document's own spans: no more than its words
    spans = materialise(
        spans.groupBy("doc", "text_key").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans"
    )
    ids = F.xxhash64("doc_id")
    affected = filter_words(spans.select(F.xxhash64("doc").alias("key")), "key", filter_bits)
    whole = possibly(texts, affected, ids, False).mapInArrow(
        _plain_rows, "doc_id long, n_words long, n_removed long, kept binary"
    )
    cut = (
        possibly(texts, affected, ids).mapInArrow(_affected_rows, "doc_id long, n_words long, text_key long, kept binary")
        .join(spans.withColumnRenamed("doc", "doc_id"), ["doc_id", "text_key"], "left")
        .select("doc_id", "n_words", "kept", "spans")
        .mapInArrow(_cut_rows(width), "doc_id long, n_words long, n_removed long, kept binary")
    )
    return whole.union(cut)


def digest(result: DataFrame) -> DataFrame:
    """The result with a SHA-256 of the kept words in place of them."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], width: int = 13) -> list[tuple]:
    """The same by a dictionary of all windows, for tests."""
    first: dict[tuple, int] = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - width + 1):
                k = tuple(w[i : i + width])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
