"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Symbols are characters, every code point its own, and a text's edge: 21 bits each, so
an n-gram is a pair of numbers while the model is built, and a 64-bit hash when it is
looked up. Neither the alphabet nor the number of n-grams is bounded: both grow with
the trusted text. Counts of 5-grams over all trusted documents
are combined in the tasks and summed; lower orders count different left neighbours.
Each order's table is joined with its contexts' totals and with the order below by
n-gram, so the model is built by joins that Spark deals out. A symbol that no trusted
text has gets the share of one unseen symbol.

For scoring, the model is dealt by the previous symbol into shards of about
``shard_grams`` n-grams; all orders of one place need the same shard. A shard is sent to
the tasks once, every document passes by it, and each different 5-gram of a piece of
text is looked up once. The parts of a document's log-probability are summed.

One trusted document in five takes no part in the counts, nor does one of each
language that would have none of these but has two or more. Per language, the
threshold lies half as far again above the median of these documents' log
perplexity as the quantile that a share ``reject`` of them exceed. A language
with fewer than ``FEW`` of them takes the threshold of all languages together
where that is higher, and a language without any takes it in any case. As the
mean of few characters varies, ``ALLOWANCE / sqrt(n)`` is first taken off the
log perplexity of a text with n symbols.

Results for odd input: a null or empty text has no perplexity and is rejected; a
null language is a language of its own; a language without trusted documents
is judged by the threshold of all languages; without any trusted text all
symbols are equally likely and nothing with text is rejected, nor is it where
the only trusted texts are one of each language and none is held out; rows that repeat a ``doc_id``,
or have none, are scored each; an empty table gives an empty result; a text of any
length is scored whole, as a piece of its own. Only ``doc_id``, ``lang`` and ``text``
are read, so clashing columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .quality_rules import parts
from .words import mix, signed, unsigned

ORDER = 5
#: A text's edge; code points are below it.
EDGE = 0x110000
BIN = 1 / 512
#: About the spread of a single symbol's surprise.
ALLOWANCE = 1.5
#: Held-out documents from which on a language's own threshold stands alone.
FEW = 20


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and how many each has."""
    size = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), size


def _groups(column: pa.Array, characters: int = 1 << 19, rows: int = 256):
    """Texts in groups of about so many characters, with the index of the first; so many rows at a time become strings."""
    group, size, first = [], 0, 0
    for low in range(0, len(column), rows):
        for i, text in enumerate(column.slice(low, rows).to_pylist(), low):
            group.append(text or "")
            size += len(group[-1])
            if size >= characters:
                yield first, group
                group, size, first = [], 0, i + 1
    if group:
        yield first, group


_FACTORS = mix(np.arange(1, ORDER + 1, dtype=np.uint64)) | np.uint64(1)


class Places:
    """The places of some texts: before and at each character, and the end of each."""

    def __init__(self, texts: list[str]):
        code, size = _codes(texts)
        # each text after four edges, and an edge at its end
        full = size + ORDER
        begin = np.cumsum(full) - full
        symbols = np.full(int(full.sum()), EDGE, np.uint64)
        symbols[np.arange(len(code)) + np.repeat(begin + ORDER - 1 - (np.cumsum(size) - size), size)] = code
        self.symbols, self.mixed = symbols, mix(symbols)
        self.count = size + 1
        self.at = np.arange(int(self.count.sum())) + np.repeat(begin + ORDER - 1 - (np.cumsum(self.count) - self.count), self.count)

    def grams(self, order: int, at: np.ndarray) -> np.ndarray:
        """Hash of the ``order`` symbols that end at each place."""
        total = np.full(len(at), np.uint64(order))
        for j in range(order):
            total += self.mixed[at - j] * _FACTORS[j]
        return mix(total)

    def contexts(self, order: int, at: np.ndarray) -> np.ndarray:
        """Hash of the ``order - 1`` symbols before each place."""
        total = np.full(len(at), np.uint64(100 + order))
        for j in range(1, order):
            total += self.mixed[at - j] * _FACTORS[j]
        return mix(total)

    def different(self) -> tuple[np.ndarray, np.ndarray]:
        """A place of each different 5-gram, and which of them each place has."""
        _, first, which = np.unique(self.grams(ORDER, self.at), return_index=True, return_inverse=True)
        return self.at[first], which


#: Bits of a symbol, and its mask.
BITS = 21
MASK = (1 << BITS) - 1


def count_grams(trusted: DataFrame) -> DataFrame:
    """``hi, lo, n`` over all trusted texts: the two first and the three last symbols of each 5-gram."""

    def emit(batches):
        held, size = [], 0

        def combined():
            key, hi, lo, n = (np.concatenate(x) for x in zip(*held))
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            return key[first], hi[first], lo[first], np.bincount(which, weights=n).astype(np.int64)

        def given():
            _, hi, lo, n = combined()
            return pa.RecordBatch.from_arrays([pa.array(signed(hi)), pa.array(signed(lo)), pa.array(n)], ["hi", "lo", "n"])

        for batch in batches:
            for _, group in _groups(batch.column(0)):
                places = Places(group)
                at, which = places.different()
                s = [places.symbols[at - j] for j in range(ORDER)]
                lo = s[0] | (s[1] << np.uint64(BITS)) | (s[2] << np.uint64(2 * BITS))
                hi = s[3] | (s[4] << np.uint64(BITS))
                held.append((places.grams(ORDER, at), hi, lo, np.bincount(which, minlength=len(at))))
                size += len(at)
                if size > 1 << 21:
                    held = [combined()]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield given()
                        held, size = [], 0
        if held:
            yield given()
        pa.default_memory_pool().release_unused()  # the worker may wait beside others

    rows = trusted.select("text").mapInArrow(emit, "hi long, lo long, n long")
    return rows.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _suffix(order: int) -> list:
    """The last ``order`` symbols of a longer n-gram."""
    hi = F.col("hi").bitwiseAND(F.lit((1 << BITS * max(order - 3, 0)) - 1))
    return [hi, F.col("lo").bitwiseAND(F.lit((1 << BITS * min(order, 3)) - 1))]


def _context() -> list:
    """All symbols of an n-gram but the last."""
    carried = F.shiftleft(F.col("hi").bitwiseAND(F.lit(MASK)), 2 * BITS)
    return [F.shiftright("hi", BITS), F.shiftright("lo", BITS).bitwiseOR(carried)]


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more from how many n-grams have counts 1 to 4."""
    if min(n) == 0:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return [min(max(d, 0.05), k) for k, d in zip((0.95, 1.95, 2.95), found)]


def fit(trusted: DataFrame) -> tuple[list[DataFrame], list[DataFrame], float]:
    """Per order, probabilities ``hi, lo, p, previous`` and context weights ``hi, lo, weight, previous``; the base probability."""
    tables = [materialise(count_grams(trusted), "grams")]
    for order in range(ORDER - 1, 0, -1):
        hi, lo = _suffix(order)
        tables.append(materialise(tables[-1].groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.count(F.lit(1)).alias("n")), "grams"))
    base = 1.0 / (tables[-1].count() + 1)
    probabilities, weights = [], []
    for order, table in enumerate(reversed(tables), 1):
        of = table.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first()
        d1, d2, d3 = discounts(list(of))
        less = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        (chi, clo), (shi, slo) = _context(), _suffix(order - 1)
        table = table.withColumns({"less": less, "chi": chi, "clo": clo, "shi": shi, "slo": slo})
        contexts = table.groupBy("chi", "clo").agg(F.sum("n").alias("total"), (F.sum("less") / F.sum("n")).alias("weight"))
        joined = table.join(contexts, ["chi", "clo"])
        direct = (F.col("n") - F.col("less")) / F.col("total")
        previous = F.col("clo").bitwiseAND(F.lit(MASK)).alias("previous")
        if order == 1:
            p = joined.select("hi", "lo", (direct + F.col("weight") * F.lit(base)).alias("p"), previous)
        else:
            below = probabilities[-1].select(F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("lower"))
            p = joined.join(below, ["shi", "slo"]).select(
                "hi", "lo", (direct + F.col("weight") * F.col("lower")).alias("p"), previous
            )
        probabilities.append(materialise(p, "model"))
        weights.append(materialise(contexts.select(F.col("chi").alias("hi"), F.col("clo").alias("lo"), "weight", previous), "model"))
    return probabilities, weights, base


def _sorted(table: DataFrame, order: int, context: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes as in :class:`Places`, ascending, and the values."""
    got = table.toArrow()
    hi, lo = (unsigned(got.column(i).to_numpy()) for i in (0, 1))
    value, mask = got.column(2).to_numpy().astype(np.float32), np.uint64(MASK)
    s = [(lo >> np.uint64(BITS * j)) & mask for j in range(3)] + [(hi >> np.uint64(BITS * j)) & mask for j in range(2)]
    if context:
        total = np.full(len(lo), np.uint64(100 + order))
        for j in range(1, order):
            total += mix(s[j - 1]) * _FACTORS[j]
        key = mix(total) if order > 1 else np.zeros(len(lo), np.uint64)
    else:
        total = np.full(len(lo), np.uint64(order))
        for j in range(order):
            total += mix(s[j]) * _FACTORS[j]
        key = mix(total)
    ascending = np.argsort(key)
    return key[ascending], value[ascending]


def _found(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the table has, and their values."""
    keys, values = table
    if not len(keys):
        return np.zeros(len(key), bool), np.zeros(len(key), np.float32)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    return keys[at] == key, values[at]


def _score_rows(shared, base: float, shards: int, own: int):
    """Sum of log-probabilities of the places whose previous symbol is in the shard."""

    def emit(batches):
        probabilities, weights = shared.value
        for batch in batches:
            for low, group in _groups(batch.column(3)):
                places = Places(group)
                at, which = places.different()
                mine = places.symbols[at - 1] % np.uint64(shards) == own
                p = np.full(len(at), base)
                for order in range(1, ORDER + 1):
                    context = places.contexts(order, at) if order > 1 else np.zeros(len(at), np.uint64)
                    known, weight = _found(weights[order - 1], context)
                    p = np.where(known, weight * p, p)
                    known, direct = _found(probabilities[order - 1], places.grams(order, at))
                    p = np.where(known, direct, p)
                value = np.where(mine, np.log(p), 0.0)[which]
                total = np.add.reduceat(value, np.cumsum(places.count) - places.count)
                n = np.where(places.count > 1, places.count, 0)
                part = batch.slice(low, len(group))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(-total), pa.array(n)],
                    ["doc_id", "lang", "text_key", "surprise", "n"],
                )
        pa.default_memory_pool().release_unused()  # the worker may wait beside others

    return emit


def perplexities(docs: DataFrame, model, shard_grams: int = 4_000_000) -> DataFrame:
    """``doc_id, lang, text_key, perplexity, symbols`` of every row."""
    probabilities, weights, base = model
    sc = docs.sparkSession.sparkContext
    shards = max(1, -(-sum(t.count() for t in probabilities) // shard_grams))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("text_key"), "text")
    scored = None
    for s in range(shards):
        mine = F.col("previous") % shards == s
        # single symbols have no previous one: as many as the alphabet
        held = [
            [_sorted(t if k == 0 else t.where(mine), k + 1, context) for k, t in enumerate(tables)]
            for tables, context in ((probabilities, False), (weights, True))
        ]
        rows = texts.mapInArrow(
            _score_rows(sc.broadcast(held), base, shards, s), "doc_id long, lang string, text_key long, surprise double, n long"
        )
        scored = rows if scored is None else scored.union(rows)
    if shards == 1:
        mean = F.col("surprise") / F.nullif(F.col("n"), F.lit(0))
        return scored.select("doc_id", "lang", "text_key", F.round(F.exp(mean), 6).alias("perplexity"), F.col("n").cast("double").alias("symbols"))
    summed = scored.groupBy("doc_id", "lang", "text_key").agg(
        F.sum("surprise").alias("surprise"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")
    )
    # each row was seen once by each shard
    mean = F.col("surprise") / F.nullif(F.col("n"), F.lit(0)) * F.lit(shards)
    return summed.select(
        "doc_id", "lang", "text_key", F.round(F.exp(mean), 6).alias("perplexity"),
        (F.col("n") / F.col("rows")).alias("symbols"),
        F.explode(F.sequence(F.lit(1), (F.col("rows") / F.lit(shards)).cast("int"))).alias("copy"),
    ).drop("copy")


def held_out(docs: DataFrame, trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trusted ids for the counts, and those for the thresholds: some of each language with two or more."""
    counted, apart = parts(trusted)
    known = counted.withColumn("held", F.lit(False)).union(apart.withColumn("held", F.lit(True)))
    rows = docs.where("text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "lang").join(known.hint("merge"), "doc_id")
    order = F.struct(F.xxhash64("doc_id").alias("key"), "doc_id")
    ends = rows.groupBy("lang").agg(F.min(order).alias("low"), F.max(order).alias("high"), F.max("held").alias("held"))
    # an id or none for a language
    more = materialise(ends.where("not held and low <> high").select("low.doc_id").distinct(), "held-out")
    return counted.join(more, "doc_id", "left_anti"), apart.union(more)


def limits(scored: DataFrame, apart: DataFrame, reject: float) -> tuple[DataFrame, float | None]:
    """``lang, limit``: the highest perplexity that is kept; and the limit of all languages together."""
    bins = (
        scored.where("perplexity is not null").join(apart, "doc_id", "left_semi")
        .groupBy("lang", F.floor(F.ln("perplexity") / F.lit(BIN)).alias("bin")).count()
    )
    # once by language and once for all
    bins = bins.withColumn("every", F.explode(F.array(F.lit(False), F.lit(True))))
    bins = bins.groupBy("every", F.when(~F.col("every"), F.col("lang")).alias("of"), "bin").agg(F.sum("count").alias("count"))
    w = Window.partitionBy("every", "of")  # bins of a language: a few thousand at most
    share = F.sum("count").over(w.orderBy("bin")) / F.sum("count").over(w)
    edges = bins.withColumn("share", share).groupBy("every", "of").agg(
        F.sum("count").alias("n"),
        F.min(F.when(F.col("share") >= 0.5, F.col("bin"))).alias("middle"),
        F.min(F.when(F.col("share") >= 1 - reject, F.col("bin"))).alias("high"),
    )
    high = F.col("high") + 1 + (F.col("high") - F.col("middle")) / 2
    edges = materialise(edges.select("every", "of", "n", F.exp(high * F.lit(BIN)).alias("limit")), "limits")
    whole = edges.where("every").first()
    common = whole.limit if whole else None
    few = F.when(F.col("n") < FEW, F.greatest("limit", F.lit(common).cast("double"))).otherwise(F.col("limit"))
    return edges.where("not every").select("of", few.alias("limit")), common


def classify(docs: DataFrame, trusted: DataFrame, reject: float = 0.005, shard_grams: int = 4_000_000) -> DataFrame:
    """``doc_id, lang, text_key, perplexity, symbols, limit, kept`` of every row; ``trusted`` has ids of trusted documents."""
    counted, apart = held_out(docs, trusted)
    # a merge join whatever the size: the same plan for every table, and no broadcast that grows
    model = fit(docs.select("doc_id", "text").join(counted.hint("merge"), "doc_id", "left_semi"))
    scored = materialise(perplexities(docs, model, shard_grams), "perplexities")
    known, common = limits(scored, apart, reject)
    limit = F.coalesce("limit", F.lit(common).cast("double"))
    least = F.col("perplexity") * F.exp(F.lit(-ALLOWANCE) / F.sqrt("symbols"))
    good = F.coalesce(least <= F.coalesce(limit, F.col("perplexity")), F.lit(False))
    judged = scored.join(known, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    return judged.withColumn("kept", good).withColumn("limit", limit)
