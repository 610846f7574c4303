"""Bit filters built by Spark and probed in tasks, and groups of linked nodes.

A filter has at most a fixed number of bits whatever the input, so what is sent to
the tasks has a proven bound, and no more bits than its keys need. It goes to the
executors once, as a broadcast, and is dropped when the stages that probe it have
written their result. It only spares work: a false hit costs time and is dropped by
an exact step later, and there are no false misses.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: At most 16 MB. Two bits a key: one false hit in fifty for ten million keys.
FILTER_BITS = 1 << 27
#: Bits for each bit that is set; at most one false hit in a thousand below the bound.
SPARSE = 32
#: Bits of the smallest filter.
LEAST_BITS = 1 << 13
#: Rows of a counted table that are no work for more than one task.
TASK_ROWS = 1 << 16


class BitFilter:
    """A filter on its way to the tasks."""

    def __init__(self, spark, words: np.ndarray):
        self.shared = spark.sparkContext.broadcast(words)

    @property
    def words(self) -> np.ndarray:
        return self.shared.value

    def drop(self) -> None:
        """Frees the filter everywhere; tables that were written with it do not need it."""
        self.shared.destroy()


def folded(words: np.ndarray) -> np.ndarray:
    """The same filter with as few bits as the set ones need: a slot is the low bits of a key, so halves overlay."""
    need = SPARSE * int(np.bitwise_count(words).sum())
    size = len(words)
    while size * 32 >= max(need, LEAST_BITS):
        size //= 2
    return np.bitwise_or.reduce(words.reshape(-1, size), axis=0)


def filter_words(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Two bits set for each key of a well mixed long column, by its low and high ends; at most ``bits``, a power of two."""
    ends = F.array(F.col(column), F.shiftrightunsigned(column, 32))
    slot = F.col("slot").bitwiseAND(F.lit(bits - 1))
    words = (
        keys.select(F.explode(ends).alias("slot"))
        .select(F.shiftright(slot, 6).cast("int").alias("word"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    )
    words = dealt(words, bits // 64).toArrow()  # no more rows
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return folded(out)


def bit_filter(keys: DataFrame, column: str, bits: int = FILTER_BITS) -> BitFilter:
    """The same on its way to the tasks."""
    return BitFilter(keys.sparkSession, filter_words(keys, column, bits))


def possibly(rows: DataFrame, words: np.ndarray, key: Column, want: bool = True) -> DataFrame:
    """Rows whose key the filter may hold, or with ``want`` false the others, by DataFrame functions."""
    table = rows.sparkSession.createDataFrame(pa.table({"filter": [words.view(np.int64)]}))  # one row, bounded

    def is_set(end: Column) -> Column:
        slot = end.bitwiseAND(F.lit(len(words) * 64 - 1))
        word = F.get("filter", F.shiftright(slot, 6).cast("int"))
        return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))) != 0

    held = is_set(key) & is_set(F.shiftrightunsigned(key, 32))
    return rows.join(F.broadcast(table), held if want else ~held, "left_semi")


def hits(found: BitFilter, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned keys the filter may hold."""
    filter_words = found.words
    some = np.ones(len(keys), bool)
    for end in (keys, keys >> np.uint64(32)):
        slot = end & np.uint64(len(filter_words) * 64 - 1)
        some &= (filter_words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return some


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has at most ``rows`` rows, written by no more tasks than these need; large tables stay as they are."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def settled(edges: DataFrame, rows: int) -> bool:
    """Whether edges from ``u`` to a smaller ``v`` hang each node on one only, which hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not dealt(nodes, 2 * rows).agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]


def forest(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns ``node`` and ``root``: the smallest node that links (``a``, ``b``) reach, for all others that they reach.

    Alternates two steps that hang every node on a smaller neighbour until all
    hang on the smallest; the number of rounds grows with the logarithm of the
    longest chain, and links that already are a forest take none. No step has more
    edges than there are links, which are counted. Nothing is collected.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    rows = edges.count()

    def lowest(df: DataFrame, low) -> DataFrame:
        nodes = df.groupBy("u").agg(low.alias("m"))
        return F.broadcast(dealt(nodes, rows)) if rows <= TASK_ROWS else nodes  # counted

    edges = materialise(dealt(edges.distinct(), rows), "links")
    for _ in range(rounds):
        if settled(edges, rows):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lowest(both, F.least(F.min("v"), F.col("u")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(dealt(large, rows), "links")
        low = lowest(large, F.min("v"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = materialise(dealt(small, rows), "links")
    raise RuntimeError(f"links did not settle in {rounds} rounds")
