"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word's input is the mean of learned vectors of its hashed character 3-
and 4-grams (with marks at both ends, so beginnings tell) and a learned vector of
the word itself if the training texts have it often enough; ASCII signs count
as spaces. The network reads
windows of ``WINDOW`` words that overlap by half, in both directions; attention
weighs its states, and a logistic unit gives the window's probability. A text's
score is that of its highest window, and every window of every whole text is
scored.

The network is trained in numpy on a bounded sample of labelled texts: at most
``train_rows`` of each label, those with the smallest hashes of their id, of at
most ``train_chars`` characters. As a label marks a text and not a place, later
rounds train on the window that the network finds highest.

Results for odd input: a null text or one without words scores 0; texts shorter
than a window are one window; rows that repeat a ``doc_id``, or have none, are
each scored; labels that are null or not 0 or 1 are not learned from; without
toxic or clean labels to learn from every score is 0; an empty table gives an
empty result; a text of any length is scored by all its windows, though texts longer
than ``train_chars`` are not learned from, since a label says nothing about which of
their parts it means. Only named columns are read, so clashing ones do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import LOWER, PIECE_BYTES, Words, mix, pieces

WINDOW, STRIDE = 24, 12
CHAR, WORD, HIDDEN = 16, 8, 8
CHAR_BUCKETS = 1 << 13

#: ASCII signs become spaces, so that signs around a word do not hide it.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
VOCABULARY = 4096


def plain_words(texts: pa.Array, piece_bytes: int = PIECE_BYTES):
    """Words of the texts without ASCII signs, piece by piece."""
    for _, _, words in pieces(texts, piece_bytes):
        yield Words(PLAIN[words.data], words.offsets)


def char_grams(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character grams of the words ``at``, and how many each has."""
    size = words.end[at] - words.start[at]
    full = size + 2
    begin = np.cumsum(full) - full
    text = np.empty(int(full.sum()), np.uint8)
    text[begin], text[begin + full - 1] = 2, 3  # marks that no word holds
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(begin + 1, size) + inner] = LOWER[words.data[np.repeat(words.start[at], size) + inner]]
    owner = np.repeat(np.arange(len(at)), full)
    value, bucket, of = text.astype(np.uint64), [], []
    for k in (3, 4):
        n = len(text) - k + 1
        if n <= 0:
            continue
        whole = np.flatnonzero(owner[:n] == owner[k - 1 :])
        total = np.full(n, k, np.uint64)
        for j in range(k):
            total = total * np.uint64(0x100000001B3) + value[j : j + n]
        bucket.append((mix(total[whole]) % np.uint64(CHAR_BUCKETS)).astype(np.int64))
        of.append(owner[whole])
    bucket, of = np.concatenate(bucket), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return bucket[order], np.bincount(of, minlength=len(at))


class Inputs:
    """The different words of a piece: character buckets, word number, and each word's index."""

    def __init__(self, words: Words, vocabulary: np.ndarray):
        key = words.hashes(lower=True)
        different, first, self.index = np.unique(key, return_index=True, return_inverse=True)
        self.bucket, self.count = char_grams(words, first) if len(first) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        place = np.searchsorted(vocabulary, different)
        known = place < len(vocabulary)
        known[known] = vocabulary[place[known]] == different[known]
        self.word = np.where(known, place + 1, 0)  # 0: not in the vocabulary
        self.key = different


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each window, and its text; the last window ends with the text."""
    begin = np.cumsum(count) - count
    n = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), n)
    place = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    place = np.minimum(place, np.maximum(count[row] - WINDOW, 0))
    return begin[row] + place, row


def window_words(first: np.ndarray, row: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of each window's words; -1 after a short text's end."""
    end = np.cumsum(count)[row]
    place = first[:, None] + np.arange(WINDOW)
    return np.where(place < end[:, None], place, -1)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _sum_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the rows of each index."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
    out[index[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def start_weights(seed: int = 5) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    normal = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
    size = CHAR + WORD
    weights = {"char": normal(CHAR_BUCKETS, CHAR), "word": normal(VOCABULARY + 1, WORD), "attend": normal(2 * HIDDEN), "out": normal(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    for side in ("ahead", "back"):
        weights |= {f"{side}_in": normal(size, 3 * HIDDEN), f"{side}_own": normal(HIDDEN, 3 * HIDDEN), f"{side}_bias": np.zeros(3 * HIDDEN, np.float32)}
    return weights


def word_inputs(weights: dict, bucket: np.ndarray, count: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Input vector of each different word."""
    total = np.add.reduceat(weights["char"][bucket], np.cumsum(count) - count, axis=0)
    return np.concatenate([total / count[:, None].astype(np.float32), weights["word"][word]], 1)


def _run(weights: dict, side: str, table: np.ndarray, index: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction at each word; ``keep`` gets what training needs."""
    own, h = weights[f"{side}_own"], np.zeros((len(index), HIDDEN), np.float32)
    states = np.empty((WINDOW, len(index), HIDDEN), np.float32)
    for t in range(WINDOW) if side == "ahead" else range(WINDOW - 1, -1, -1):
        given, before = table[index[:, t]], h @ own
        gates = _sigmoid(given[:, : 2 * HIDDEN] + before[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(given[:, 2 * HIDDEN :] + r * before[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, z, r, new, before[:, 2 * HIDDEN :]))
        h = new + z * (h - new)
        states[t] = h
    return states


def forward(weights: dict, x: np.ndarray, index: np.ndarray, kept: dict | None = None):
    """Log odds of each window; ``index`` has rows of ``x``, the last of which stands for no word."""
    both = []
    for side in ("ahead", "back"):
        keep = [] if kept is not None else None
        table = x @ weights[f"{side}_in"] + weights[f"{side}_bias"]
        both.append(_run(weights, side, table, index, keep))
        if kept is not None:
            kept[side] = keep
    states = np.concatenate(both, 2)
    e = (states @ weights["attend"]).T
    e = np.where(index == len(x) - 1, -1e9, e)
    a = np.exp(e - e.max(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    pooled = np.einsum("bt,tbh->bh", a, states)
    if kept is not None:
        kept |= {"states": states, "a": a, "pooled": pooled}
    return pooled @ weights["out"] + weights["bias"][0]


def gradients(weights: dict, bucket, count, word, index: np.ndarray, y: np.ndarray, share: np.ndarray) -> dict:
    """Of the weighted log loss over some windows."""
    kept: dict = {}
    x = np.concatenate([word_inputs(weights, bucket, count, word), np.zeros((1, CHAR + WORD), np.float32)])
    odds = forward(weights, x, index, kept)
    d = ((_sigmoid(odds) - y) * share).astype(np.float32)
    states, a, pooled = kept["states"], kept["a"], kept["pooled"]
    out = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
    d_pooled = d[:, None] * weights["out"]
    d_a = np.einsum("bh,tbh->bt", d_pooled, states)
    d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
    out["attend"] = np.einsum("bt,tbh->h", d_e, states)
    d_states = a.T[:, :, None] * d_pooled + d_e.T[:, :, None] * weights["attend"]
    d_x = np.zeros_like(x)
    for s, side in enumerate(("ahead", "back")):
        w_in, own = weights[f"{side}_in"], weights[f"{side}_own"]
        d_own, d_table = np.zeros_like(own), np.zeros((len(x), 3 * HIDDEN), np.float32)
        given, flow = [], np.zeros((len(index), HIDDEN), np.float32)
        for t, h, z, r, new, before in reversed(kept[side]):
            dh = d_states[t, :, s * HIDDEN : (s + 1) * HIDDEN] + flow
            d_new = dh * (1 - z) * (1 - new * new)
            d_z = dh * (h - new) * z * (1 - z)
            d_r = d_new * before * r * (1 - r)
            gates = np.concatenate([d_z, d_r, d_new * r], 1)
            d_own += h.T @ gates
            flow = dh * z + gates @ own.T
            given.append((t, np.concatenate([d_z, d_r, d_new], 1)))
        rows = np.concatenate([g for _, g in given])
        at = np.concatenate([index[:, t] for t, _ in given])
        d_table += _sum_by(at, rows, len(x))
        out |= {f"{side}_own": d_own, f"{side}_in": x.T @ d_table, f"{side}_bias": d_table.sum(0)}
        d_x += d_table @ w_in.T
    d_x = d_x[:-1]
    out["word"] = _sum_by(word, d_x[:, CHAR:], VOCABULARY + 1)
    each = np.repeat(d_x[:, :CHAR] / count[:, None].astype(np.float32), count, axis=0)
    out["char"] = _sum_by(bucket, each, CHAR_BUCKETS)
    return out


def train(texts: pa.Array, y: np.ndarray, rounds: int = 12, batch: int = 256, rate: float = 0.02, seed: int = 5):
    """Weights and vocabulary from labelled texts."""
    words = next(plain_words(texts, 1 << 40))
    key = words.hashes(lower=True)
    pair = np.unique(np.stack([key, words.row.astype(np.uint64)]), axis=1)[0]
    value, texts_with = np.unique(pair, return_counts=True)
    often = np.flatnonzero(texts_with >= 3)
    vocabulary = np.sort(value[often[np.lexsort((value[often], -texts_with[often]))][:VOCABULARY]])
    inputs = Inputs(words, vocabulary)
    begin = np.cumsum(inputs.count) - inputs.count
    first, row = windows(words.count)
    place = window_words(first, row, words.count)
    index = np.where(place >= 0, inputs.index[place], len(inputs.key))
    weights = start_weights(seed)
    steps = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
    draw, step = np.random.default_rng(seed), 0
    edges = np.searchsorted(row, np.arange(len(words.count) + 1))
    for number in range(rounds):
        if number >= 2:
            x = np.concatenate([word_inputs(weights, inputs.bucket, inputs.count, inputs.word), np.zeros((1, CHAR + WORD), np.float32)])
            odds = np.concatenate([forward(weights, x, index[i : i + 8192]) for i in range(0, len(index), 8192)])
        chosen = []
        for r in range(len(words.count)):
            low, high = edges[r], edges[r + 1]
            if high == low:
                continue
            some = draw.integers(low, high, 3 if number < 2 or not y[r] else 0)
            top = [low + int(odds[low:high].argmax())] if number >= 2 else []
            chosen.append(np.unique(np.r_[some, top].astype(np.int64)))
        chosen = draw.permutation(np.concatenate(chosen))
        for i in range(0, len(chosen), batch):
            part = index[chosen[i : i + batch]]
            local, back = np.unique(part, return_inverse=True)
            back = back.reshape(part.shape)
            if local[-1] == len(inputs.key):
                local = local[:-1]
            count = inputs.count[local]
            grams = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[local], count)
            label = y[row[chosen[i : i + batch]]].astype(np.float32)
            share = np.full(len(label), 1 / len(label), np.float32)
            grad = gradients(weights, inputs.bucket[grams], count, inputs.word[local], back, label, share)
            step += 1
            for k, g in grad.items():
                m, v = steps[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                weights[k] -= rate * (1 - 0.9 * number / rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return weights, vocabulary


def score_texts(texts: pa.Array, weights: dict, vocabulary: np.ndarray, block: int = 8192) -> np.ndarray:
    """The highest window's probability of each text."""
    scores = [np.zeros(0)]
    for words in plain_words(texts):
        inputs = Inputs(words, vocabulary)
        best = np.zeros(len(words.count))
        if len(inputs.key):
            x = [word_inputs(weights, b, c, w) for b, c, w in _slices(inputs)]
            x = np.concatenate([*x, np.zeros((1, CHAR + WORD), np.float32)])
            first, row = windows(words.count)
            for i in range(0, len(first), block):
                place = window_words(first[i : i + block], row[i : i + block], words.count)
                index = np.where(place >= 0, inputs.index[place], len(inputs.key))
                np.maximum.at(best, row[i : i + block], _sigmoid(forward(weights, x, index).astype(np.float64)))
        scores.append(best)
    return np.concatenate(scores)


def _slices(inputs: Inputs, rows: int = 1 << 15):
    """Different words in slices, so that their character vectors take little memory."""
    edge = np.concatenate([[0], np.cumsum(inputs.count)])
    for i in range(0, len(inputs.key), rows):
        j = min(i + rows, len(inputs.key))
        yield inputs.bucket[edge[i] : edge[j]], inputs.count[i:j], inputs.word[i:j]


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, train_rows: int, train_chars: int) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels to learn from."""
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(~held_out(F.col("doc_id"))).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # at most train_rows of each label
    chosen = known.where("toxic = 1").orderBy(*order).limit(train_rows).union(known.where("toxic = 0").orderBy(*order).limit(train_rows))
    got = (
        docs.select("doc_id", "text").where(F.char_length("text") <= train_chars)
        .join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").select("text", "toxic").toArrow()
    )
    return got.column("text").combine_chunks(), got.column("toxic").to_numpy()


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = 1200, train_chars: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    texts, y = sample(docs, labels, train_rows, train_chars)
    model = train(texts, y) if len(y) and 0 < y.sum() < len(y) else None

    def emit(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                score = score_texts(part.column(1), *model) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(score, 9))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
