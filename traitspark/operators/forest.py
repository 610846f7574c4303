"""Random forest regression: randomised search, weighted refits and importances.

Rows are binned once. All forests of a search (every point, fold and tree) grow
together, level by level: one scan adds up a table of weights and label sums for
every (fit, tree, open node, feature, bin), the tables of the tasks are added, and the
best splits of all open nodes come from them. Only splits and trees are on the
driver; their size is bounded by the leaf and split shares, not by the rows. A level is
cut into several scans where its table would be larger than ``PASS_NUMBERS``.

A feature has at most ``BINS`` bins, so few features have few combinations of bins.
Where a table by group of rows and combination stays below ``CELL_NUMBERS``, one scan
adds up every tree's table of these, and a tree grows whole from it in one task. Sums are
exact either way and the trees are the same.

A fit belongs to a group of rows: all rows but a fold, or a subsample. The bootstrap
weight of a row in a tree is a Poisson draw from a hash of row and tree, so trees do not
depend on the layout. Labels are summed as whole multiples of 2**-30 of their range,
which makes the sums exact and independent of their order.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import PRIME, draw_constants, draw_limit, residue
from ..session import materialise, spread
from .sampling import CV_FOLDS, SPLIT_SEED, fold_rows

# Search grid.
GRID = {
    "n_estimators": [10, 100, 250, 500, 1000],
    "max_features": ["auto", "sqrt", "log2"],
    "max_depth": [5, 25, 100, 250],
    "min_samples_split": [0.001, 0.01, 0.1, 0.2],
    "min_samples_leaf": [0.001, 0.01, 0.1, 0.2],
}
#: Bins of a feature; one with at most this many frequent values is split exactly.
BINS = 64
#: Numbers of the statistics table that one scan adds up.
PASS_NUMBERS = 1 << 24
#: Combinations of bins, times groups of rows, up to which a tree grows from their sums.
CELL_NUMBERS = 1 << 16
#: Combinations of a forest's thresholds up to which predictions are kept.
KEPT_CELLS = 1 << 20
#: Rows a task works on at once.
CHUNK_ROWS = 1 << 16
#: Steps of the label's range.
STEPS = 1 << 30

# cumulative probabilities of the Poisson draw with mean 1, in steps of 2**-16
_POISSON = np.searchsorted(
    np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]), (np.arange(1 << 16) + 0.5) / (1 << 16)
).astype(np.uint8)


def draw_points(grid: Mapping[str, Sequence], n_iter: int, seed=SPLIT_SEED) -> list[dict]:
    """``n_iter`` distinct grid points, or the whole grid when it is smaller."""
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if n_iter >= len(points):
        return points
    return random.Random(seed).sample(points, n_iter)


@dataclass
class Rule:
    """A grid point as tests of a node: counts are shares of the rows of a fit."""

    trees: int = 100
    tried: str = "auto"
    depth: int | None = None
    split: float = 2
    leaf: float = 1
    bootstrap: bool = True

    @classmethod
    def of(cls, point: Mapping) -> Rule:
        return cls(
            int(point.get("n_estimators", 100)),
            point.get("max_features", "auto"),
            point.get("max_depth"),
            point.get("min_samples_split", 2),
            point.get("min_samples_leaf", 1),
            point.get("bootstrap", True),
        )

    def features(self, of: int) -> int:
        """How many features a node tries before it settles for a valid split."""
        return {"auto": of, "sqrt": max(1, int(of**0.5)), "log2": max(1, int(math.log2(of)))}[self.tried]

    def least(self, rows: int) -> tuple[int, int]:
        """Rows a node needs to be split, and rows of a leaf; shares are rounded up."""
        split = max(2, math.ceil(self.split * rows)) if isinstance(self.split, float) else max(2, self.split)
        leaf = max(1, math.ceil(self.leaf * rows)) if isinstance(self.leaf, float) else max(1, self.leaf)
        return split, leaf


class Folds:
    """Group ``k`` has all rows but those of fold ``k``; the last group has all."""

    def __init__(self, folds: int):
        self.groups = folds + 1
        self.marks = np.arange(folds) if folds else np.array([-1])

    def members(self, who: np.ndarray) -> np.ndarray:
        return who[:, None] != np.arange(self.groups)


class Draws:
    """Group ``k`` is the subsample ``k + 1`` of the rows, read from the residue of their key."""

    marks = None

    def __init__(self, seed, samples: int, fraction: float):
        self.groups = samples
        self.constants, self.limit = np.array(draw_constants(seed, samples), np.int64), draw_limit(fraction)

    def members(self, who: np.ndarray) -> np.ndarray:
        return (who[:, None] * self.constants[:, 0] + self.constants[:, 1]) % PRIME < self.limit


class Own:
    """Group ``k`` has the rows that carry the number ``k``."""

    def __init__(self, groups: int):
        self.groups = groups
        self.marks = np.arange(groups)

    def members(self, who: np.ndarray) -> np.ndarray:
        return who[:, None] == np.arange(self.groups)


@dataclass
class Tree:
    """Nodes of a tree in flat arrays; a leaf is its own child."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [BINS])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    weight: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])
    open: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, cut: int, gain: float, sides: Sequence[tuple[float, float]]) -> list[int]:
        """Two new leaves below ``node``; ``sides`` are their weight and mean."""
        first = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, first, gain
        for i, (weight, mean) in enumerate(sides):
            self.feature.append(0)
            self.cut.append(BINS)
            self.left.append(first + i)
            self.value.append(mean)
            self.weight.append(weight)
            self.gain.append(0.0)
            self.depth.append(self.depth[node] + 1)
        return [first, first + 1]

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left), max(self.depth)

    def pack(self) -> bytes:
        return np.array([self.feature, self.cut, self.left, self.value, self.weight, self.gain, self.depth], float).tobytes()

    @classmethod
    def unpack(cls, body: bytes) -> Tree:
        feature, cut, left, value, weight, gain, depth = np.frombuffer(body).reshape(7, -1)
        feature, cut, left, depth = (a.astype(int).tolist() for a in (feature, cut, left, depth))
        return cls(feature, cut, left, value.tolist(), weight.tolist(), gain.tolist(), depth, [])


def _leaves(bins: np.ndarray, base: np.ndarray, arrays) -> np.ndarray:
    """The node every row comes to."""
    feature, cut, left, depth = arrays
    node = np.zeros(len(base), np.int64)
    for _ in range(depth):
        node = left.take(node) + (bins.take(base + feature.take(node)) > cut.take(node))
    return node


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weights(row: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap."""
    turn = np.uint64((0x9E3779B97F4A7C15 * (1 + tree + (int(seed) << 20))) % (1 << 64))
    return _POISSON[(_mixed(row + turn) >> np.uint64(48)).astype(np.int64)]


class Binned:
    """Rows as bins, written once, with the cuts, the label's range and the rows of every group."""

    def __init__(self, df: DataFrame, features: Sequence[str], label: str, groups, who: Column, key: Sequence[str] = ()):
        features = list(features)
        self.features, self.groups = features, groups
        values = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
        row_id = F.xxhash64(*(list(key) or [*features, label]))
        rows = df.select(*values, F.col(label).cast("double").alias("_y"), who.cast("long").alias("_who"), row_id.alias("_row"))
        rows = rows.dropna(subset=[*(f"_x{i}" for i in range(len(features))), "_y"])
        steps = [k / BINS for k in range(1, BINS)]
        found = rows.agg(
            F.min("_y").alias("low"),
            F.max("_y").alias("high"),
            *[F.percentile_approx(f"_x{i}", F.lit(steps), 10000).alias(f"c{i}") for i in range(len(features))],
        ).first()
        self.low = found["low"] if found["low"] is not None else 0.0
        self.step = ((found["high"] or 0.0) - self.low) / STEPS or 1.0
        self.cuts = [sorted(set(found[f"c{i}"] or [])) for i in range(len(features))]
        cuts, low, step = [np.array(c) for c in self.cuts], self.low, self.step

        def bins(batches):
            for batch in batches:
                columns = [np.searchsorted(c, batch.column(i).to_numpy(), "left") for i, c in enumerate(cuts)]
                body = np.stack(columns, axis=1).astype(np.uint8) if len(batch) else np.zeros((0, len(cuts)), np.uint8)
                y = np.rint((batch.column(len(cuts)).to_numpy() - low) / step).astype(np.int64)
                size = body.shape[1]
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(body), [None, pa.py_buffer(body.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [data.cast(pa.binary()), pa.array(y), batch.column(len(cuts) + 1), batch.column(len(cuts) + 2)],
                    ["bins", "y", "who", "row"],
                )

        schema = "bins binary, y long, who long, row long"
        self.rows = materialise(spread(rows, "_row").mapInArrow(bins, schema), "bins")
        self.tasks = self.rows.rdd.getNumPartitions()
        self.counts = self._counts()
        self.cells = Cells([len(c) + 1 for c in self.cuts])
        self.by_cell = groups.marks is not None and self.cells.size * len(groups.marks) <= CELL_NUMBERS

    def _counts(self) -> np.ndarray:
        """Rows of every group."""
        groups = self.groups

        def count(batches):
            total = np.zeros(groups.groups, np.int64)
            for batch in batches:
                who = batch.column("who").to_numpy()
                for low in range(0, len(who), CHUNK_ROWS):
                    total += groups.members(who[low : low + CHUNK_ROWS]).sum(axis=0)
            yield pa.RecordBatch.from_pydict({"group": pa.array(np.arange(len(total))), "n": pa.array(total)})

        table = self.rows.select("who").mapInArrow(count, "group long, n long").groupBy("group").agg(F.sum("n").alias("n"))
        out = np.zeros(groups.groups, np.int64)
        for group, n in table.collect():  # groups
            out[group] = n
        return out

    def value(self, steps: float) -> float:
        return self.low + self.step * steps

    @staticmethod
    def chunks(batches, width: int) -> Iterator[tuple[np.ndarray, ...]]:
        """``bins`` (flat), first place of each row, ``y``, ``who`` and ``row`` of a chunk of rows."""
        held, n = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            if n >= CHUNK_ROWS or (batch is None and n):
                table = pa.Table.from_batches(held)
                for low in range(0, n, CHUNK_ROWS):
                    part = table.slice(low, CHUNK_ROWS)
                    bins = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8)
                    y, who, row = (part.column(c).to_numpy() for c in ("y", "who", "row"))
                    yield bins, np.arange(part.num_rows) * width, y.astype(float), who, row.view(np.uint64)
                held, n = [], 0


class Cells:
    """Numbers of the combinations of bins of all features."""

    def __init__(self, sizes: Sequence[int]):
        self.sizes, self.size = list(sizes), math.prod(sizes)
        self.steps = np.array([math.prod(self.sizes[i + 1 :]) for i in range(len(self.sizes))], dtype=object)

    def of(self, bins: np.ndarray) -> np.ndarray:
        """The cell of every row of ``bins`` (flat)."""
        return bins.reshape(-1, len(self.sizes)).astype(np.int64) @ self.steps.astype(np.int64)

    def bins(self, cells: np.ndarray) -> np.ndarray:
        """The bins of ``cells`` (flat), of few combinations."""
        return np.stack(np.unravel_index(cells, self.sizes), axis=1).astype(np.uint8).ravel()


def _table_rows(work: dict, groups, width: int, seed: int):
    """Statistics of the open nodes; ``work`` has, for each tree number, fits with their trees and open slots."""

    def emit(batches):
        from pyspark import TaskContext

        total: dict[tuple[int, int], np.ndarray] = {}
        for bins, base, y, who, row in Binned.chunks(batches, width):
            member = groups.members(who)
            some = member.any(axis=0)
            for tree, fits in work.items():
                drawn = None
                for fit, group, bootstrap, arrays, slots, opened in fits:
                    if not some[group]:
                        continue
                    if bootstrap and drawn is None:
                        drawn = _weights(row, seed, tree)
                    take = member[:, group] & (drawn > 0) if bootstrap else member[:, group]
                    at = np.flatnonzero(take)
                    slot = slots[_leaves(bins, base[at], arrays)]
                    at, slot = at[slot >= 0], slot[slot >= 0]
                    w = drawn[at].astype(float) if bootstrap else np.ones(len(at))
                    wy = w * y[at]
                    out = total.get((fit, tree))
                    if out is None:
                        out = total[fit, tree] = np.zeros((2, width, opened * BINS))
                    for f in range(width):
                        place = slot * BINS + bins[base[at] + f]
                        out[0, f] += np.bincount(place, w, opened * BINS)
                        out[1, f] += np.bincount(place, wy, opened * BINS)
        task = TaskContext.get().partitionId()
        keys = list(total)
        for low in range(0, len(keys), 512):
            part = keys[low : low + 512]
            fits, trees = zip(*part)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(fits, pa.int32()),
                    pa.array(trees, pa.int32()),
                    pa.array([task] * len(part), pa.int32()),
                    pa.array([total.pop(k).tobytes() for k in part], pa.binary()),
                ],
                ["fit", "tree", "task", "body"],
            )

    return emit


def _best_splits(rules: list[tuple[Rule, int, int]], width: int, seed: int):
    """Finds each open node's best split from a table, or from the added tables of some trees."""

    def best(fit: int, tree: int, stats: np.ndarray) -> np.ndarray:
        rule, _, rows = rules[fit]
        leaf = rule.least(rows)[1]
        w, y = stats
        all_w, all_y = w[0].sum(axis=1), y[0].sum(axis=1)
        left_w, left_y = w.cumsum(axis=2), y.cumsum(axis=2)
        right_w, right_y = all_w[:, None] - left_w, all_y[:, None] - left_y
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = np.nan_to_num(all_y / all_w)
            # gain of the sum of squares, by the distance of the two means
            gain = left_w * right_w / all_w[:, None] * (left_y / left_w - right_y / right_w) ** 2
        gain = np.where((left_w >= leaf) & (right_w >= leaf) & (left_w > 0) & (right_w > 0), gain, -1.0)
        cut = gain.argmax(axis=2)
        node = np.arange(len(all_w))
        most = np.take_along_axis(gain, cut[:, :, None], 2)[:, :, 0]
        tried = rule.features(width)
        order = np.broadcast_to(np.arange(width), (len(node), width))
        if tried < width:  # an own order of the features in every node
            turn = np.arange(len(node) * width, dtype=np.uint64).reshape(len(node), width)
            start = np.uint64(hash((int(seed), fit, tree, len(node))) % (1 << 64))
            order = _mixed(_mixed(turn + np.uint64(1)) + start).argsort(axis=1)
        top, feature = np.full(len(node), 1e-9), np.full(len(node), -1)
        for k in range(width):
            f = order[:, k]
            better = (most[f, node] > top) & ((k < tried) | (feature < 0))
            top, feature = np.where(better, most[f, node], top), np.where(better, f, feature)
        at = (np.maximum(feature, 0), node, cut[np.maximum(feature, 0), node])
        return np.column_stack([top, feature, at[2], all_w, mean, left_w[at], left_y[at], right_w[at], right_y[at]])

    def run(table: pa.Table) -> pa.Table:
        total: dict[tuple[int, int], np.ndarray] = {}
        for fit, tree, body in zip(*(table.column(c) for c in ("fit", "tree", "body"))):
            key, part = (fit.as_py(), tree.as_py()), np.frombuffer(body.as_buffer())
            total[key] = total[key] + part if key in total else part
        bodies = [best(fit, tree, part.reshape(2, width, -1, BINS)).tobytes() for (fit, tree), part in total.items()]
        fits, trees = zip(*total)
        return pa.table({"fit": pa.array(fits, pa.int32()), "tree": pa.array(trees, pa.int32()), "body": pa.array(bodies, pa.binary())})

    return best, run


def _cell_sums(draws: Sequence[int], cells: Cells, marks: np.ndarray, seed: int):
    """Weights and label sums by mark and cell, for each bootstrap; number -1 takes every row once."""
    size = len(marks) * cells.size

    def emit(batches):
        total = np.zeros((len(draws), 2, size), np.int64)
        for bins, _, y, who, row in Binned.chunks(batches, len(cells.sizes)):
            place = (who - marks[0]) * cells.size + cells.of(bins)
            for sums, draw in zip(total, draws):
                w = _weights(row, seed, draw).astype(float) if draw >= 0 else np.ones(len(y))
                sums[0] += np.bincount(place, w, size).astype(np.int64)
                sums[1] += np.bincount(place, w * y, size).astype(np.int64)
        for sums, draw in zip(total, draws):
            if sums[0].any():
                yield pa.RecordBatch.from_arrays([pa.array([draw], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["draw", "body"])

    return emit


def _cell_trees(work: Mapping[int, list], rules: list[tuple[Rule, int, int]], cells: Cells, groups, seed: int):
    """Grows the trees of a bootstrap from its table; ``work`` has their (fit, tree) pairs."""
    width, best = len(cells.sizes), _best_splits(rules, len(cells.sizes), seed)[0]

    def run(table: pa.Table) -> pa.Table:
        sums = np.zeros((2, len(groups.marks), cells.size), np.int64)
        for body in table.column("body"):
            sums += np.frombuffer(body.as_buffer(), np.int64).reshape(sums.shape)
        member = groups.members(groups.marks)
        out, of_group = [], {}
        for fit, t in work[table.column("draw")[0].as_py()]:
            rule, group, rows = rules[fit]
            if group not in of_group:
                w, y = sums[:, member[:, group]].sum(axis=1).astype(float)
                some = np.flatnonzero(w)
                of_group[group] = cells.bins(some), w[some], y[some]
            bins, w, y = of_group[group]
            tree, base = Tree(), np.arange(len(w)) * width
            while tree.open and len(w):
                opened = len(tree.open)
                slots = np.full(len(tree.feature), -1)
                slots[tree.open] = np.arange(opened)
                slot = slots[_leaves(bins, base, tree.arrays())]
                at = np.flatnonzero(slot >= 0)
                places = [slot[at] * BINS + bins[base[at] + f] for f in range(width)]
                stats = np.array([[np.bincount(p, v[at], opened * BINS) for p in places] for v in (w, y)])
                _apply(tree, best(fit, t, stats.reshape(2, width, -1, BINS)), rule, rows)
            out.append((fit, t, tree.pack()))
        fits, trees, bodies = zip(*out)
        return pa.table({"fit": pa.array(fits, pa.int32()), "tree": pa.array(trees, pa.int32()), "body": pa.array(bodies, pa.binary())})

    return run


def _grow_by_cell(data: Binned, rules: list[tuple[Rule, int, int]], forests: list[list[Tree]], live: list, seed: int) -> None:
    """Every tree from the sums of its bootstrap's cells; as many bootstraps a scan as ``PASS_NUMBERS`` has room for."""
    draws: dict[int, list] = {}
    for t, i in live:
        draws.setdefault(t if rules[i][0].bootstrap else -1, []).append((i, t))
    marks = data.groups.marks
    most = max(1, PASS_NUMBERS // (2 * len(marks) * data.cells.size))
    # a table a core and bootstrap is shuffled, however many rows there are
    rows = data.rows.coalesce(data.rows.sparkSession.sparkContext.defaultParallelism)
    for low in range(0, len(draws), most):
        part = dict(list(draws.items())[low : low + most])
        tables = rows.mapInArrow(_cell_sums(list(part), data.cells, marks, seed), "draw int, body binary")
        grown = tables.groupBy("draw").applyInArrow(
            _cell_trees(part, rules, data.cells, data.groups, seed), "fit int, tree int, body binary"
        )
        found = grown.toArrow()  # trees of the pass
        for i, t, body in zip(*(found.column(c).to_pylist() for c in ("fit", "tree", "body"))):
            forests[i][t] = Tree.unpack(body)


def grow(data: Binned, fits: Sequence[tuple[Mapping, int]], seed=SPLIT_SEED) -> list[list[Tree]]:
    """The trees of every fit, a (point, group) pair; all grow in the same scans."""
    width = len(data.features)
    rules = [(Rule.of(point), group, int(data.counts[group])) for point, group in fits]
    forests = [[Tree() for _ in range(rule.trees)] for rule, _, _ in rules]
    live = [(t, i) for i, forest in enumerate(forests) for t in range(len(forest)) if rules[i][2]]
    live.sort()  # trees with the same number share their bootstrap
    if data.by_cell:
        _grow_by_cell(data, rules, forests, live, int(seed))
        return forests
    while live:
        at = 0
        while at < len(live):
            work: dict[int, list] = {}
            numbers = 0
            while at < len(live) and (not work or numbers < PASS_NUMBERS):
                t, i = live[at]
                tree, (rule, group, _) = forests[i][t], rules[i]
                slots = np.full(len(tree.feature), -1)
                slots[tree.open] = np.arange(len(tree.open))
                work.setdefault(t, []).append((i, group, rule.bootstrap, tree.arrays(), slots, len(tree.open)))
                numbers += 2 * width * BINS * len(tree.open)
                at += 1
            tables = data.rows.mapInArrow(
                _table_rows(work, data.groups, width, int(seed)), "fit int, tree int, task int, body binary"
            )
            # tables of a tree meet in one part; a part stays small however many tasks send theirs
            part = F.pmod(F.xxhash64("fit", "tree"), F.lit(8 * max(data.tasks, 8)))
            best = tables.groupBy(part).applyInArrow(_best_splits(rules, width, int(seed))[1], "fit int, tree int, body binary")
            found = best.toArrow()  # open nodes of the pass
            for i, t, body in zip(*(found.column(c).to_pylist() for c in ("fit", "tree", "body"))):
                _apply(forests[i][t], np.frombuffer(body).reshape(-1, 9), rules[i][0], rules[i][2])
        # a tree none of whose rows were drawn has no table
        for t, i in live:
            if forests[i][t].weight[0] == 0:
                forests[i][t].open = []
        live = [(t, i) for t, i in live if forests[i][t].open]
    return forests


def _apply(tree: Tree, best: np.ndarray, rule: Rule, rows: int) -> None:
    """Splits the open nodes; new ones stay open while they may be split."""
    split, _ = rule.least(rows)
    depth = math.inf if rule.depth is None else rule.depth
    opened = []
    for node, (gain, f, cut, weight, mean, lw, ly, rw, ry) in zip(tree.open, best):
        if node == 0:
            tree.weight[0], tree.value[0] = float(weight), float(mean)
        if f < 0 or weight < split or tree.depth[node] >= depth:
            continue
        for child in tree.split(node, int(f), int(cut), float(gain), [(float(lw), float(ly / lw)), (float(rw), float(ry / rw))]):
            if tree.weight[child] >= split and tree.depth[child] < depth:
                opened.append(child)
    tree.open = opened


def group_scores(data: Binned, forests: Sequence[list[Tree]], groups: Sequence[int]) -> DataFrame:
    """``fit, test, train``: R2 of every fit on its group and on the other rows, in one scan."""
    width = len(data.features)
    work = [(g, [(t.arrays(), np.array(t.value)) for t in forest]) for g, forest in zip(groups, forests)]
    members, cells, by_cell = data.groups, data.cells, data.by_cell

    def predicted(bins, trees):
        base = np.arange(len(bins) // width) * width
        p = np.zeros(len(base))
        for arrays, value in trees:
            p += value[_leaves(bins, base, arrays)]
        return p

    def emit(batches):
        total = np.zeros((len(work), 2, 4))
        # a cell is predicted when it is first met
        known = np.zeros(cells.size if by_cell else 0, bool)
        of_cell = np.zeros((len(work), len(known)))
        for bins, _, y, who, _ in Binned.chunks(batches, width):
            member = members.members(who)
            scaled = y / STEPS
            if by_cell:
                cell = cells.of(bins)
                met = np.unique(cell[~known[cell]])
                if len(met):
                    of_cell[:, met] = [predicted(cells.bins(met), trees) for _, trees in work]
                    known[met] = True
            for i, (group, trees) in enumerate(work):
                p = of_cell[i, cell] if by_cell else predicted(bins, trees)
                e = (scaled - p / (len(trees) * STEPS)) ** 2
                for side, rows in enumerate((~member[:, group], member[:, group])):
                    total[i, side] += [rows.sum(), scaled[rows].sum(), (scaled[rows] ** 2).sum(), e[rows].sum()]
        flat = total.reshape(-1, 4)
        at = np.arange(len(flat))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // 2, pa.int32()), pa.array(at % 2 == 1), *(pa.array(flat[:, k]) for k in range(4))],
            ["fit", "own", "n", "y", "yy", "sse"],
        )

    rows = data.rows.coalesce(data.rows.sparkSession.sparkContext.defaultParallelism) if by_cell else data.rows
    sums = rows.mapInArrow(emit, "fit int, own boolean, n double, y double, yy double, sse double")
    sums = sums.groupBy("fit", "own").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy", "sse")])
    spread_ = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    r2 = F.when((F.col("n") > 0) & (spread_ > 1e-12 * F.col("n")), 1 - F.col("sse") / spread_)
    return sums.groupBy("fit").agg(F.max(F.when(~F.col("own"), r2)).alias("test"), F.max(F.when(F.col("own"), r2)).alias("train"))


@dataclass
class ForestFit:
    """A fitted forest: thresholds instead of bins, so that it works on raw columns."""

    name: str
    features: list[str]
    trees: list[dict]
    params: dict = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, data: Binned, trees: Sequence[Tree], params: Mapping) -> ForestFit:
        out = []
        for t in trees:
            leaf = [own == i for i, own in enumerate(t.left)]
            out.append(
                {
                    "feature": [-1 if end else f for f, end in zip(t.feature, leaf)],
                    "threshold": [math.inf if end else data.cuts[f][c] for f, c, end in zip(t.feature, t.cut, leaf)],
                    "left": list(t.left),
                    "value": [data.value(v) for v in t.value],
                    "weight": list(t.weight),
                    "gain": [g * data.step**2 for g in t.gain],
                }
            )
        return cls(name, list(data.features), out, dict(params))

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the rows of ``x``; a row with a missing feature has none.

        Rows between the same thresholds go the same ways: with few combinations of
        these, one row of each is sent through the trees and the result is kept.
        """
        arrays, cuts, known, kept = self._prepared()
        if kept is None:
            out = self._through(x, arrays)
        else:
            cell = np.zeros(len(x), np.int64)
            for j, c in enumerate(cuts):
                cell = cell * (len(c) + 1) + np.searchsorted(c, x[:, j], "left")
            new = np.flatnonzero(~known[cell])
            met, first = np.unique(cell[new], return_index=True)
            if len(met):
                kept[met], known[met] = self._through(x[new[first]], arrays), True
            out = kept[cell]
        return np.where(np.isnan(x).any(axis=1), np.nan, out)

    def _prepared(self):
        """Trees as arrays, thresholds of each feature, and the predictions made so far; not sent with the fit."""
        if "_made" not in self.__dict__:
            arrays = self._arrays()
            cuts: list[set] = [set() for _ in self.features]
            for t in self.trees:
                for f, threshold in zip(t["feature"], t["threshold"]):
                    if f >= 0:
                        cuts[f].add(threshold)
            size = math.prod(len(c) + 1 for c in cuts)
            few = size <= KEPT_CELLS
            known, kept = (np.zeros(size, bool), np.zeros(size)) if few else (None, None)
            self._made = arrays, [np.array(sorted(c)) for c in cuts], known, kept
        return self._made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def _through(self, x: np.ndarray, arrays) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in arrays:
            feature, threshold, left, value = t
            node = np.zeros(len(x), np.int64)
            while True:
                after = left[node] + (x[rows, feature[node]] > threshold[node])
                if (after == node).all():
                    break
                node = after
            total += value[node]
        return total / max(len(self.trees), 1)

    def _arrays(self) -> list[tuple[np.ndarray, ...]]:
        return [
            (np.maximum(np.array(t["feature"], np.int64), 0), np.array(t["threshold"], float), np.array(t["left"], np.int64), np.array(t["value"], float))
            for t in self.trees
        ]

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        fit = self

        @F.pandas_udf("double")
        def apply(frame: pd.DataFrame) -> pd.Series:
            values = pd.Series(fit.predict_array(frame.to_numpy(float)))
            return values.where(values.notna(), None)

        return df.withColumn(out, apply(F.struct(*[F.col(f).cast("double") for f in self.features])))

    def reset(self) -> UntrainedForest:
        return UntrainedForest(self.name, dict(self.params))


@dataclass
class UntrainedForest:
    """A forest without trees: its parameters."""

    name: str
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, features: Sequence[str], label: str, key: Sequence[str] = ()) -> ForestFit:
        return fit_forest(df, features, label, self.params, name=self.name, key=key)


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    point: Mapping | None = None,
    seed=SPLIT_SEED,
    name: str = "Random Forest",
    key: Sequence[str] = (),
) -> ForestFit:
    """Fit one forest; without ``key``, rows are told apart by their values."""
    data = Binned(df, features, label, Folds(0), F.lit(-1), key)
    return ForestFit.of(name, data, grow(data, [(point or {}, 0)], seed)[0], point or {})


def search_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: Sequence[str],
    grid: Mapping[str, Sequence] | None = None,
    n_iter: int = 10,
    folds: int = CV_FOLDS,
    seed=SPLIT_SEED,
    name: str = "Random Forest",
) -> tuple[ForestFit, DataFrame]:
    """Randomised search with cross-validation; the best point is fitted on all rows.

    All points, folds and trees grow in the same scans, and one scan scores them.
    """
    points = draw_points(grid or GRID, n_iter, seed)
    data = Binned(fold_rows(df, key, folds, seed, "_fold"), features, label, Folds(folds), F.col("_fold"), key)
    fits = [(i, fold) for i in range(len(points)) for fold in range(folds)]
    forests = grow(data, [(points[i], fold) for i, fold in fits], seed)
    scores = group_scores(data, forests, [fold for _, fold in fits])
    spark = df.sparkSession
    of_fit = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(fits)], "fit int, point int")
    listed = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(points)], "point int, params string")
    table = (
        scores.join(F.broadcast(of_fit), "fit")  # points times folds
        .groupBy("point")
        .agg(
            F.avg("test").alias("mean_test_score"),
            F.stddev_pop("test").alias("std_test_score"),
            F.avg("train").alias("mean_train_score"),
            F.stddev_pop("train").alias("std_train_score"),
        )
        .join(F.broadcast(listed), "point")
        .withColumn("model", F.lit(name))
    )
    table = materialise(table, "search")
    best = table.orderBy(F.col("mean_test_score").desc_nulls_last(), "point").first()["point"]
    trees = grow(data, [(points[best], folds)], seed)[0]
    return ForestFit.of(name, data, trees, points[best]), table


def refit_samples(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: Sequence[str],
    point: Mapping | None = None,
    n_samples: int = 10,
    fraction: float = 0.3,
    seed=0,
    name: str = "Random Forest",
) -> dict[int, ForestFit]:
    """A forest for each subsample, grown together without a copy of a row."""
    draws = Draws(seed, n_samples, fraction)
    data = Binned(df, features, label, draws, residue(seed, *key), key)
    forests = grow(data, [(point or {}, k) for k in range(n_samples)], seed)
    return {k + 1: ForestFit.of(name, data, trees, point or {}) for k, trees in enumerate(forests)}


def forest_importances(df: DataFrame, fit: ForestFit) -> DataFrame:
    """Mean share of the gain of each feature and its deviation over the trees."""
    shares = []
    for t in fit.trees:
        gain = np.zeros(len(fit.features))
        for f, g in zip(t["feature"], t["gain"]):
            if f >= 0:
                gain[f] += g
        shares.append(gain / gain.sum() if gain.sum() else gain)
    table = np.array(shares).reshape(-1, len(fit.features))
    # trees without a split tell nothing
    told = table[table.sum(axis=1) > 0]
    mean = told.mean(axis=0) if len(told) else np.zeros(len(fit.features))
    rows = [(j, f, float(mean[j]), float(table[:, j].std())) for j, f in enumerate(fit.features)]
    return df.sparkSession.createDataFrame(
        rows, "feature_index int, feature string, importance double, sd_importance double"
    )
