"""Exact join of documents by the Jaccard similarity of their 5-word shingles, as a join in a metric space.

Texts with equal shingle sets are one node. ``1 - similarity`` is a metric, and
two nodes link at a distance of at most ``r = 1 - percent / 100``.

1. *First pivots.* Most texts are at distance 1 from each other, where document
   pivots tell nothing apart, so the first level takes single shingles as
   pivots: a node belongs to the regions of its first ``n - ceil(n * (1 - r)) + 1``
   shingles in one order of all shingles, and linked nodes share such a region.
   Shingles that a sample of one text in eight shows to be frequent come last in
   the order, which keeps regions small; any order gives the same links.
2. *Document pivots.* Each region's pivot is a node of it, in a large region the one
   that shares most memberships of large regions with others; nodes that share
   enough of their regions with a pivot are measured exactly against it, so a
   group of near copies costs one measurement a member. Linked nodes form
   groups. Regions that still hold many nodes outside the groups of their pivots take
   another pivot from these, level by level; a level reads no other region's groups,
   and starts from the groups that the levels before it found.
3. *Windows.* What is left are pairs from different groups in one region. A node
   goes to the ring of its distance from the pivot and to the neighbouring
   rings, by the triangle inequality; nodes that were not measured go to all
   rings. A pair must share enough regions for its sizes, which sketches of the nodes'
   regions bound within the join, and is then measured; it is emitted in the last few
   of the regions it shares only.

No cap drops a region, a node or a pair. A shingle is a 64-bit hash.

Results for odd input: a null text or one without words has an empty set and is
linked with nothing; texts with fewer than five words have their whole sequence
as the one shingle; a row without ``doc_id`` links nothing and has no component;
rows that repeat a ``doc_id`` keep a row each and join the component of their
own text; an empty table gives an empty result; a text of any length is a piece of its
own, whose whole set one task holds. Only named columns are read, so clashing ones do
not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .filters import FILTER_BITS, BitFilter, bit_filter, dealt, filter_words, forest, hits, possibly
from .words import Words, mix, pieces, signed, unsigned

SHINGLE = 5
#: Bytes of text whose shingles a task holds at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Longs in the sketch of a node's regions.
SKETCH = 8


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles and their text's row, ordered by row and hash."""
    own = words.codes(lower=True)
    key, at = words.runs(own, size)
    row = words.row[at]
    for n in range(1, size):  # texts with fewer words: the whole sequence
        short = np.flatnonzero(words.count == n)
        if len(short):
            first = words.first[short]
            total = np.full(len(short), n, np.uint64)
            for j in range(n):
                total = mix(total + own[first + j])
            key, row = np.concatenate([key, total]), np.concatenate([row, short])
    if not np.all(row[1:] >= row[:-1]):
        order = np.argsort(row, kind="stable")
        key, row = key[order], row[order]
    key = key.copy()
    bounds = np.searchsorted(row, np.arange(len(words.count) + 1)).tolist()
    for low, high in zip(bounds, bounds[1:]):
        key[low:high].sort()
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], row[new]


def nodes_of(key: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each text's set, and the set's size; texts with equal sets are one node."""
    n = np.bincount(row, minlength=rows)
    total = np.zeros(rows, np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        total[full] = np.add.reduceat(mix(key), (np.cumsum(n) - n)[full])
    return mix(total + n.astype(np.uint64)), n


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles, in one order of all shingles, two linked sets must share one of."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def _node_rows(batches):
    for batch in batches:
        for low, high, words in pieces(batch.column(1), PIECE_BYTES):
            key, row = shingle_sets(words)
            node, n = nodes_of(key, row, high - low)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(low, high - low) for i in (0, 2)), pa.array(n), pa.array(signed(node))],
                ["doc_id", "text_key", "n", "node"],
            )


def _sample_rows(batches):
    """Shingles of the sampled texts."""
    for batch in batches:
        for _, _, words in pieces(batch.column(0), PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(signed(shingle_sets(words)[0]))], ["key"])


def early_first(late: np.ndarray, n: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Place of each shingle in its row (``n`` in each) when the late ones come last, else in the order given."""
    before = np.concatenate([[0], np.cumsum(~late)])  # early ones
    begin = np.cumsum(n) - n
    early = (before[:-1] - before[begin][row]) if len(row) else before[:-1]
    total = before[begin + n] - before[begin]
    return np.where(late, total[row] + np.arange(len(row)) - begin[row] - early, early)


def _prefix_rows(percent: int, frequent: BitFilter, recurring: BitFilter | None):
    def emit(batches):
        for batch in batches:
            for low, high, words in pieces(batch.column(1), PIECE_BYTES):
                key, row = shingle_sets(words)
                node, n = nodes_of(key, row, high - low)
                late = hits(frequent, key)
                take = early_first(late, n, row) < prefix(n, percent)[row]
                if recurring is not None:
                    take &= hits(recurring, key)
                key, row = key[take], row[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), pa.array(signed(node[row])), pa.array(n[row])], ["key", "node", "n"]
                )

    return emit


def _set_rows(chosen: BitFilter):
    """Whole sets of wanted nodes, from the text that stands for the node."""

    def emit(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for low, high, words in pieces(batch.column(1), PIECE_BYTES):
                key, row = shingle_sets(words)
                node, n = nodes_of(key, row, high - low)
                stand = node ^ (unsigned(ids[low:high]) << np.uint64(20))
                want = np.flatnonzero(hits(chosen, stand) & (n > 0))
                begin = np.cumsum(n) - n
                sets = [key[begin[i] : begin[i] + n[i]].tobytes() for i in want.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(node[want])), pa.array(sets, pa.binary())], ["node", "shingles"]
                )

    return emit


def _common_rows(batches):
    for batch in batches:
        common = [
            len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(4)), pa.array(common, pa.int64())], ["a", "b", "a_n", "b_n", "common"]
        )


class Join:
    """One run of the join over ``docs``, with what its levels share."""

    def __init__(self, docs: DataFrame, percent: int, one_in: int, least: int, filter_bits: int):
        self.percent, self.bits = percent, filter_bits
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.known = self.texts.where("doc_id is not null")
        keyed = self.texts.withColumn("text_key", F.xxhash64("text"))
        self.nodes = materialise(keyed.mapInArrow(_node_rows, "doc_id long, text_key long, n long, node long"), "nodes")
        # the text that stands for each node
        stand = self.nodes.where("doc_id is not null and n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        self.stand = materialise(dealt(stand, self.nodes.count()), "stand")
        some = self.known.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select("text")
        seen = some.mapInArrow(_sample_rows, "key long").groupBy("key").count().where(F.col("count") >= least)
        self.frequent = bit_filter(seen, "key", filter_bits)

    def members(self) -> DataFrame:
        """``region, node, n``: every node in the regions of its first shingles that another node shares."""
        schema = "key long, node long, n long"
        rows = self.known.mapInArrow(_prefix_rows(self.percent, self.frequent, None), schema)
        shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
        recurring = bit_filter(shared, "key", self.bits)
        rows = self.known.mapInArrow(_prefix_rows(self.percent, self.frequent, recurring), schema).distinct()
        out = materialise(rows.withColumnRenamed("key", "region"), "regions")
        recurring.drop()
        self.frequent.drop()
        return out

    def needed(self, x: str, y: str):
        """Of how many regions two nodes of these sizes must both be members to be linked.

        All common shingles up to the end of the prefix that ends first are in
        both prefixes; the rest fit into what that set has after its prefix.
        """
        q = self.percent
        both = F.ceil(F.lit(q) * (F.col(x) + F.col(y)) / F.lit(100 + q))
        after = F.ceil(F.lit(q) * F.greatest(x, y) / F.lit(100)) - 1
        return F.greatest(both - after, F.lit(1))

    def fitting(self, x: str, y: str):
        return 100 * F.least(x, y) >= self.percent * F.greatest(x, y)

    def measured(self, pairs: DataFrame) -> DataFrame:
        """``a, b, a_n, b_n, common`` of pairs of nodes, from their whole sets."""
        rows = pairs.count()
        active = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        # only texts whose id may be one of these are hashed
        wanted = materialise(self.stand.join(dealt(active, 2 * rows), "node", "left_semi"), "wanted")
        chosen = bit_filter(wanted.select(F.col("node").bitwiseXOR(F.expr("shiftleft(doc_id, 20)")).alias("stand")), "stand", self.bits)
        ids = F.xxhash64("doc_id")
        texts = possibly(self.known, filter_words(wanted.select(ids.alias("key")), "key", self.bits), ids)
        sets = materialise(texts.mapInArrow(_set_rows(chosen), "node long, shingles binary"), "sets")
        chosen.drop()
        both = (
            pairs.join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b")
            .select("a", "b", "a_n", "b_n", "a_set", "b_set")
            .mapInArrow(_common_rows, "a long, b long, a_n long, b_n long, common long")
        )
        return materialise(dealt(both.distinct(), rows), "measured")

    def links(self, measured: DataFrame) -> DataFrame:
        union = F.col("a_n") + F.col("b_n") - F.col("common")
        return measured.where(100 * F.col("common") >= self.percent * union).select("a", "b")


def grouped(members: DataFrame, hung: DataFrame) -> DataFrame:
    """Members with the ``root`` of their group; a node that hangs on none is its own."""
    return members.join(hung, "node", "left").withColumn("root", F.coalesce("root", "node"))


def with_links(hung: DataFrame | None, links: DataFrame) -> DataFrame:
    """New links and those that groups found so far need."""
    return links if hung is None else links.union(hung.select(F.col("node").alias("a"), F.col("root").alias("b")))


def of_pivots(pivots: DataFrame, rooted: DataFrame) -> DataFrame:
    """Pivots with the group ``main`` that each is in."""
    own = rooted.select("region", F.col("node").alias("pivot"), F.col("root").alias("main"))
    return pivots.join(own, ["region", "pivot"])


def central(members: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """``region, pivot, pivot_n`` of every region, and ``node, weight`` of nodes in large ones.

    In a region of more than ``leaf`` nodes the pivot is the node that shares the
    most memberships of large regions with others: of a group of near copies, the
    text that most of them are near to, and not one of its edited copies.
    """
    rows = members.count()
    large = members.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > leaf)
    heavy = materialise(members.join(dealt(large, rows), "region"), "large-regions")
    weights = materialise(dealt(heavy.groupBy("node").agg(F.sum("size").alias("weight")), rows), "weights")
    middle = heavy.join(weights, "node").groupBy("region").agg(F.max(F.struct("weight", "node", "n")).alias("m"))
    first = members.groupBy("region").agg(F.min(F.struct("node", "n")).alias("p")).join(middle, "region", "left")
    return first.select(
        "region", F.coalesce("m.node", "p.node").alias("pivot"), F.coalesce("m.n", "p.n").alias("pivot_n")
    ), weights


def sketched(placed: DataFrame) -> DataFrame:
    """Rows of regions with nodes outside their pivot's group, with what the node's list of such regions tells.

    ``place`` is the region's place in that list, largest regions first, ``held`` the
    length of the list and ``w0`` ... a bit set for each region in it.
    """
    sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.max(~F.col("inner")).alias("some")).where("some")
    node = Window.partitionBy("node")  # no more rows than a text has shingles
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("region", 3).bitwiseAND(F.lit(63)).cast("int"))
    word = F.col("region").bitwiseAND(F.lit(SKETCH - 1))
    words = [
        F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).over(node).alias(f"w{i}") for i in range(SKETCH)
    ]
    place = F.row_number().over(node.orderBy(F.desc("size"), "region")).alias("place")
    return placed.join(sizes.drop("some"), "region").select(*placed.columns, place, F.count(F.lit(1)).over(node).alias("held"), *words)


def most_shared():
    """How many regions of their lists two nodes share at most: a bit that only one has is of a region the other lacks."""

    def bound(a: str, b: str):
        return F.col(f"{a}.held") - sum(
            F.bit_count(F.col(f"{a}.w{i}").bitwiseAND(F.bitwise_not(F.col(f"{b}.w{i}")))) for i in range(SKETCH)
        )

    return F.least(bound("x", "y"), bound("y", "x"))


def similar_nodes(docs: DataFrame, percent: int, one_in: int, least: int, leaf: int, levels: int, filter_bits: int):
    """The nodes of all documents, and those of a group that hang on its ``root``."""
    run = Join(docs, percent, one_in, least, filter_bits)
    members = run.members()
    pivots, weights = central(members, leaf)
    rows = members.count()

    def written(df: DataFrame, name: str) -> DataFrame:
        """A table of no more rows than members."""
        return materialise(dealt(df, rows), name)

    hung = distances = again = None
    left, pivots = members, written(pivots, "pivots")
    for level in range(levels):
        shared = (
            members.join(pivots, "region").where("node <> pivot").groupBy("node", "n", "pivot", "pivot_n")
            .agg(F.count(F.lit(1)).alias("regions"))
            .where(run.fitting("n", "pivot_n") & (2 * F.col("regions") >= run.needed("n", "pivot_n")))
            .select(F.col("node").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("a_n"), F.col("pivot_n").alias("b_n"))
        )
        found = run.measured(written(shared, "pairs"))
        distances = found if distances is None else distances.union(found)
        hung = forest(with_links(hung, run.links(found)))
        if level and level + 1 == levels:
            break
        # later levels: only what large regions have outside the groups of all their pivots so far
        rooted = written(grouped(left, hung), "rooted")
        of_pivot = of_pivots(pivots, rooted)
        if level == 0:
            every = rooted
            mains = of_pivot = written(of_pivot, "pivots")
        outside = rooted.join(of_pivot.select("region", "main"), "region").where("root <> main")
        large = outside.join(weights, "node", "left").groupBy("region").agg(
            F.count(F.lit(1)).alias("left"), F.max(F.struct("weight", "node", "n")).alias("p")
        ).where(F.col("left") > leaf)
        if level + 1 == levels:
            break
        pivots = written(large.select("region", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")), "pivots")
        if pivots.isEmpty():
            break
        left = written(outside.join(pivots, "region", "left_semi").select(*members.columns), "outside")
        if again is None:  # regions of later levels are among these
            again = pivots.select("region")
    rooted = every
    if again is not None:
        # the other regions keep the groups of the first level, which any later ones contain
        anew = written(grouped(members.join(again, "region", "left_semi"), hung), "rooted")
        rooted = every.join(again, "region", "left_anti").unionByName(anew)
        moved = of_pivots(mains.join(again, "region", "left_semi").drop("main"), anew)
        mains = mains.join(again, "region", "left_anti").unionByName(moved)
    # rings about each region's first pivot, whose own group needs no pairs within it
    d = 1 - F.col("common") / (F.col("a_n") + F.col("b_n") - F.col("common"))
    ring = distances.select(
        F.col("a").alias("node"), F.col("b").alias("pivot"), F.floor(d * 100 / (100 - percent)).cast("int").alias("ring")
    ).distinct()
    last = -(-100 // (100 - percent))
    placed = rooted.join(mains.drop("pivot_n"), "region").join(ring, ["node", "pivot"], "left").withColumn(
        "ring", F.when(F.col("node") == F.col("pivot"), 0).otherwise(F.col("ring"))
    )
    placed = written(placed.select("region", "node", "n", "root", "ring", (F.col("root") == F.col("main")).alias("inner")), "rings")
    placed = written(sketched(placed), "sketches")
    every = F.sequence(F.lit(-1), F.lit(last))
    # a measured node has its own ring as home and is copied to the two beside it;
    # nodes that were not measured are at home in ring -1, which all nodes are copied to
    left = placed.where("not inner").withColumn("ring", F.coalesce("ring", F.lit(-1)))
    window = F.when(F.col("ring").isNull(), every).otherwise(F.array(F.lit(-1), F.col("ring") - 1, F.col("ring"), F.col("ring") + 1))
    right = placed.withColumn("ring", F.explode(F.array_distinct(window)))
    x, y = left.alias("x"), right.alias("y")
    same = (F.col("x.region") == F.col("y.region")) & (F.col("x.ring") == F.col("y.ring"))
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("y.inner") | (F.col("x.node") < F.col("y.node")))
    size = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    # linked nodes share so many regions: one of these is at that place or later in the list of the smaller node
    needed = run.needed("x.n", "y.n")
    late = F.when(F.col("x.node") < F.col("y.node"), F.col("x.place")).otherwise(F.col("y.place")) >= needed
    pairs = (
        x.join(y, same & apart & size & late & (most_shared() >= needed))
        .select(
            F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"),
            F.when(F.col("x.node") < F.col("y.node"), F.col("x.n")).otherwise(F.col("y.n")).alias("a_n"),
            F.when(F.col("x.node") < F.col("y.node"), F.col("y.n")).otherwise(F.col("x.n")).alias("b_n"),
        )
        .distinct()
    )
    pairs = materialise(pairs, "pairs")
    if not pairs.isEmpty():
        hung = forest(with_links(hung, run.links(run.measured(pairs))))
    return run.nodes, hung


def rooted(
    docs: DataFrame,
    percent: int = 75,
    one_in: int = 8,
    least: int = 3,
    leaf: int = 64,
    levels: int = 3,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``doc_id, text_key, n_shingles, root, component_id`` of every row.

    ``root`` tells components apart: where rows repeat a ``doc_id`` with different
    texts, two components may have the same smallest one.
    """
    nodes, hung = similar_nodes(docs, percent, one_in, least, leaf, levels, filter_bits)
    own = nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    roots = materialise(dealt(grouped(own, hung), nodes.count()), "roots")
    lowest = roots.groupBy("root").agg(F.min("low").alias("component"))
    named = roots.join(lowest, "root").select("node", "root", "component")
    return nodes.join(named, "node", "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"), "root",
        F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )


def components(
    docs: DataFrame,
    percent: int = 75,
    one_in: int = 8,
    least: int = 3,
    leaf: int = 64,
    levels: int = 3,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Documents link when ``100 * intersection >= percent * union``; the component
    is the smallest ``doc_id`` that links reach. ``one_in`` and ``least`` say
    which shingles count as frequent, ``leaf`` and ``levels`` when regions take
    further pivots: they change the work, not the result.
    """
    found = rooted(docs, percent, one_in, least, leaf, levels, filter_bits)
    return found.select("doc_id", "n_shingles", "component_id")
