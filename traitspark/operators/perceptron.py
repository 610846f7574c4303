"""Multilayer perceptron regression by data-parallel gradient descent.

All networks of a search (every point and fold) train together: one Spark job an
epoch takes the live networks of a loop through the rows once, each skipping its
held-out fold. Rows lie in blocks by the hash of their key. In a block a network
takes mini-batch steps from the current weights, those without activation on the
mini-batches' moments; the row-weighted mean of the blocks' weights is the next state. The same pass scores the current weights on the
validation rows. Blocks depend on the rows alone and means are sums of whole
numbers, so the result does not depend on the number of cores. Only weights and sums
leave a task, added up in two steps; the driver holds one state for each network.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Mapping, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hex_bound, salted_md5
from ..session import materialise
from .forest import draw_points
from .sampling import CV_FOLDS, SPLIT_SEED, fold_rows

# Search grid and training constants.
WIDTHS = [1, 5, 10, 25, 50]
GRID = {
    "hidden_layer_sizes": [s for r in (1, 2, 3) for s in itertools.product(WIDTHS, repeat=r)],
    "activation": ["relu", "identity"],
    "solver": ["sgd"],
    "batch_size": [200, 1000, 5000],
    "max_iter": [200, 1000, 5000],
    "learning_rate": ["constant", "adaptive"],
}
LEARNING_RATE = 0.001
MOMENTUM = 0.9
L2 = 0.0001
VALIDATION_SHARE = 0.1
PATIENCE = 10
TOLERANCE = 1e-4


def _unpack(flat: np.ndarray, sizes: Sequence[int]):
    layers, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        w = flat[at : at + a * b].reshape(a, b)
        at += a * b
        layers.append((w, flat[at : at + b]))
        at += b
    return layers


def _start(sizes: Sequence[int], activation: str, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        bound = math.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def _forward(x: np.ndarray, layers, activation: str) -> list[np.ndarray]:
    states = [x]
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1 and activation == "relu":
            x = np.maximum(x, 0.0)
        states.append(x)
    return states


def _layers(flat: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """Views of the layers, each its weights with the biases as last line; leading axes of ``flat`` stay."""
    layers, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        layers.append(flat[..., at : at + (a + 1) * b].reshape(*flat.shape[:-1], a + 1, b))
        at += (a + 1) * b
    return layers


def _decay(sizes: Sequence[int]) -> np.ndarray:
    """The penalty of each number of a state: none for biases."""
    flat = np.full(sum((a + 1) * b for a, b in zip(sizes[:-1], sizes[1:])), L2)
    for layer in _layers(flat, sizes):
        layer[-1] = 0.0
    return flat


def _turned(x: np.ndarray) -> np.ndarray:
    """Rows as columns, with a line of ones for the biases."""
    turned = np.ones((x.shape[1] + 1, len(x)))
    turned[:-1] = x.T
    return turned


class _Scratch:
    """Memory for what the layers make of a mini-batch, used again by the next one."""

    def __init__(self) -> None:
        self.held: dict = {}
        self.cut: dict = {}

    def _take(self, name, lines: int, rows: int, kind=float) -> np.ndarray:
        flat = self.held.get(name)
        if flat is None or len(flat) < lines * rows:
            flat = self.held[name] = np.empty(lines * rows, kind)
        return flat[: lines * rows].reshape(lines, rows)

    def of(self, layers: Sequence[np.ndarray], rows: int) -> tuple[list, list, list]:
        """States of the layers, with a line for the biases' ones but in the last; slopes and signs of the inner ones."""
        units = tuple(layer.shape[1] for layer in layers)
        if (units, rows) not in self.cut:
            inner = list(enumerate(units[:-1]))
            self.cut[units, rows] = (
                [self._take(("state", i), n + 1, rows) for i, n in inner] + [self._take("last", units[-1], rows)],
                [self._take(("slope", i), n, rows) for i, n in inner],
                [self._take(("sign", i), n, rows, bool) for i, n in inner],
            )
        return self.cut[units, rows]


def _states(x: np.ndarray, layers: Sequence[np.ndarray], activation: str, scratch: _Scratch) -> list[np.ndarray]:
    """Turned rows and what each layer makes of them."""
    states = [x, *scratch.of(layers, x.shape[1])[0]]
    for layer, before, state in zip(layers[:-1], states, states[1:]):
        made = state[:-1]
        np.matmul(layer.T, before, out=made)
        state[-1] = 1.0
        if activation == "relu":
            np.maximum(made, 0.0, out=made)
    np.matmul(layers[-1].T, states[-2], out=states[-1])
    return states


def _slopes(x, y, layers, into, activation, scratch) -> None:
    """Puts the mean gradient over the turned rows into the layers of ``into``."""
    states, (_, slopes, signs) = _states(x, layers, activation, scratch), scratch.of(layers, x.shape[1])
    delta = states[-1]
    delta -= y
    delta /= len(y)
    for i in range(len(layers) - 1, -1, -1):
        np.matmul(states[i], delta.T, out=into[i])
        if i:
            back = slopes[i - 1]
            # with one unit the product is an outer one
            (np.multiply if len(delta) == 1 else np.matmul)(layers[i][:-1], delta, out=back)
            if activation == "relu":
                back *= np.greater(states[i][:-1], 0.0, out=signs[i - 1])
            delta = back


def _gradient(x, y, flat, sizes, activation) -> np.ndarray:
    found = np.empty_like(flat)
    _slopes(_turned(x), y, _layers(flat, sizes), _layers(found, sizes), activation, _Scratch())
    return found + _decay(sizes) * flat / len(y)


def _joined(layers: Sequence[np.ndarray]) -> np.ndarray:
    """The one layer that layers without activation come to."""
    whole = layers[-1]
    for layer in reversed(layers[:-1]):
        bias = np.zeros(len(layer))
        bias[-1] = 1.0
        whole = layer @ whole[:-1] + np.outer(bias, whole[-1])
    return whole


def _outputs(x: np.ndarray, flat: np.ndarray, sizes, activation, scratch: _Scratch) -> np.ndarray:
    """Predictions of turned rows."""
    layers = _layers(flat, sizes)
    if activation == "identity":
        return _joined(layers)[:, 0] @ x
    return _states(x, layers, activation, scratch)[-1][0]


def _predict_flat(x: np.ndarray, flat: np.ndarray, sizes, activation) -> np.ndarray:
    return _forward(x, _unpack(flat, sizes), activation)[-1][:, 0]


@dataclass
class PerceptronFit:
    """Weights of a trained network; prediction runs on Arrow batches."""

    name: str
    features: list[str]
    sizes: list[int]
    weights: list[float]
    params: dict = field(default_factory=dict)
    n_epochs: int = 0

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        return _predict_flat(x, np.array(self.weights), list(self.sizes), self.params.get("activation", "relu"))

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        flat, sizes = np.array(self.weights), list(self.sizes)
        activation = self.params.get("activation", "relu")

        @F.pandas_udf("double")
        def apply(frame: pd.DataFrame) -> pd.Series:
            return pd.Series(_predict_flat(frame.to_numpy(float), flat, sizes, activation))

        return df.withColumn(out, apply(F.struct(*[F.col(f).cast("double") for f in self.features])))

    def reset(self) -> UntrainedPerceptron:
        return UntrainedPerceptron(self.name, dict(self.params))


@dataclass
class UntrainedPerceptron:
    """A network without weights: its parameters."""

    name: str
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, features: Sequence[str], label: str, key: Sequence[str] = ()) -> PerceptronFit:
        """Without ``key``, rows are told apart by their values."""
        return fit_perceptron(df, features, label, list(key) or [*features, label], self.params, name=self.name)


#: Rows of a block: local steps between two means.
BLOCK_ROWS = 1 << 14
#: Units of a block and a share of the networks that a core should have at least.
UNITS_A_CORE = 4
#: Loops of epochs at a time.
LOOPS = 2
#: Whole steps of a weight in a sum; exact for weights below 2**14 in up to 2**15 blocks of a task.
STEPS = 1 << 34


@dataclass
class Network:
    """A network in training: its rows are those not of fold ``skip``, or only those of sample ``own``."""

    params: dict
    skip: int
    sizes: list[int]
    flat: np.ndarray
    speed: np.ndarray
    best_flat: np.ndarray
    rate: float = LEARNING_RATE
    best: float = -math.inf
    stale: int = 0
    epochs: int = 0
    live: bool = True
    own: int | None = None

    def rows(self, fold: np.ndarray) -> np.ndarray:
        return fold != self.skip if self.own is None else fold == self.own

    @classmethod
    def of(cls, params: Mapping, skip: int, features: int, seed, own: int | None = None) -> Network:
        params = {
            "hidden_layer_sizes": (100,), "activation": "relu", "batch_size": 200,
            "max_iter": 200, "learning_rate": "constant", **params,
        }
        sizes = [features, *params["hidden_layer_sizes"], 1]
        flat = _start(sizes, params["activation"], int(seed))
        return cls(params, skip, sizes, flat, np.zeros_like(flat), flat, own=own)

    def scored(self, score: float) -> None:
        """Stops, lowers the rate or goes on, by the validation score of the current weights."""
        score = score if math.isfinite(score) else -math.inf
        self.stale = 0 if score > self.best + TOLERANCE else self.stale + 1
        if score > self.best:
            self.best, self.best_flat = score, self.flat
        if self.stale >= PATIENCE:
            if self.params["learning_rate"] == "adaptive" and self.rate > 1e-6:
                self.rate, self.stale = self.rate / 5.0, 0
            else:
                self.live = False


def _move(w: np.ndarray, v: np.ndarray, push: np.ndarray, rate) -> None:
    """One step against the gradient ``push``, in place."""
    push *= rate
    v *= MOMENTUM
    v -= push
    w += MOMENTUM * v
    w -= push


def _batch_steps(x: np.ndarray, y: np.ndarray, net: Network, scratch: _Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Weights and speed after the mini-batches of the turned rows, in their order."""
    w, v, size, decay = net.flat.copy(), net.speed.copy(), int(net.params["batch_size"]), _decay(net.sizes)
    push = np.empty_like(w)
    layers, into = _layers(w, net.sizes), _layers(push, net.sizes)
    for low in range(0, len(y), size):
        truth = y[low : low + size]
        _slopes(x[:, low : low + size], truth, layers, into, net.params["activation"], scratch)
        push += decay * w / len(truth)
        _move(w, v, push, net.rate)
    return w, v


def _by_moments(net: Network) -> bool:
    """Whether a network without activation is better off with its mini-batches' moments than with their rows."""
    width = net.sizes[0] + 1
    return net.params["activation"] == "identity" and width <= int(net.params["batch_size"]) and width * width <= 3 * len(net.flat)


def _moments(x: np.ndarray, y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean products of the turned rows with each other and with the truth, and the rows, of each mini-batch."""
    width, count = x.shape
    full = count // size
    cut = x[:, : full * size].reshape(width, full, size).transpose(1, 0, 2)
    xx, xy = cut @ cut.transpose(0, 2, 1) / size, cut @ y[: full * size].reshape(full, size, 1) / size
    if left := count - full * size:
        rest = x[:, full * size :]
        xx = np.concatenate([xx, (rest @ rest.T / left)[None]])
        xy = np.concatenate([xy, (rest @ y[full * size :, None] / left)[None]])
    return xx, xy, np.array([size] * full + [left] * bool(left), float)


def _moment_steps(nets: Sequence[Network], moments: Sequence[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """``_batch_steps`` of networks of the same sizes and without activation, from their mini-batches' moments.

    The output is linear in a row, so the gradient of a mini-batch is a product of
    the weights and the mean products of its rows. A step is taken by all networks
    that still have a mini-batch, those with most of them first.
    """
    sizes, width = nets[0].sizes, nets[0].sizes[0] + 1
    order = sorted(range(len(nets)), key=lambda i: -len(moments[i][2]))
    w, v = (np.stack([getattr(nets[i], name) for i in order]) for name in ("flat", "speed"))
    push, rate, decay = np.empty_like(w), np.array([[nets[i].rate] for i in order]), _decay(sizes)
    turns = np.array([len(moments[i][2]) for i in order])
    xx, xy = np.zeros((turns[0], len(nets), width, width)), np.zeros((turns[0], len(nets), width, 1))
    rows = np.ones((turns[0], len(nets), 1))
    for at, i in enumerate(order):
        xx[: turns[at], at], xy[: turns[at], at], rows[: turns[at], at, 0] = moments[i]
    # what a layer makes of a row is the row times these; the last column makes the one for the biases
    states = [np.zeros((len(nets), width, h + 1)) for h in sizes[:-1]]
    states[0][:] = np.eye(width)
    for state in states[1:]:
        state[:, -1, -1] = 1.0
    live = 0
    for turn in range(turns[0]):
        if live != (n := int((turns > turn).sum())):
            live = n
            layers, into = _layers(w[:n], sizes), _layers(push[:n], sizes)
            made, known = [s[:n, :, :-1] for s in states[1:]], [s[:n] for s in states]
            turned = [s.transpose(0, 2, 1) for s in known]
            back = [layer[:, :-1].transpose(0, 2, 1) for layer in layers]
        for layer, state, out in zip(layers, known, made):
            np.matmul(state, layer, out=out)
        slope = xx[turn, :n] @ (known[-1] @ layers[-1]) - xy[turn, :n]
        share = None
        for i in range(len(layers) - 1, -1, -1):
            of_rows = turned[i] @ slope
            if share is None:
                into[i][:] = of_rows
            else:
                np.multiply(of_rows, share, out=into[i])
            if i:
                share = back[i] if share is None else share @ back[i]
        push[:n] += decay * w[:n] / rows[turn, :n]
        _move(w[:n], v[:n], push[:n], rate[:n])
    found = {i: (w[at], v[at]) for at, i in enumerate(order)}
    return [found[i] for i in range(len(nets))]


def lay_rows(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], fold: str | None, seed) -> DataFrame:
    """Blocks of rows by hash, one row a block, written once: values, folds and validation marks."""
    width = len(features) + 1
    columns = [F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate([*features, label])]
    hashed = df.select(
        *columns,
        (F.col(fold).cast("int") if fold else F.lit(-1)).alias("_fold"),
        salted_md5(f"{seed}:net", *key).alias("_hash"),
    ).dropna()
    hashed = materialise(hashed.withColumn("_held", F.col("_hash") < F.lit(hex_bound(VALIDATION_SHARE))), "rows")
    blocks = max(1, -(-hashed.count() // BLOCK_ROWS))
    # the leading digits choose the validation rows, later ones the block
    block = F.conv(F.substring("_hash", 9, 8), 16, 10).cast("long") % blocks

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_hash", "ascending"), *((f"_z{i}", "ascending") for i in range(width))])
        values = np.column_stack([table.column(f"_z{i}").to_numpy() for i in range(width)])
        return pa.table(
            {
                "block": table.column("block").slice(0, 1),
                "n": pa.array([len(values)], pa.int32()),
                "values": pa.array([values.tobytes()], pa.binary()),
                "folds": pa.array([table.column("_fold").to_numpy().astype(np.int32).tobytes()], pa.binary()),
                "held": pa.array([table.column("_held").to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
            }
        )

    schema = "block long, n int, values binary, folds binary, held binary"
    parts = max(df.sparkSession.sparkContext.defaultParallelism, blocks // 64)
    dealt = hashed.withColumn("block", block).repartition(parts, "block")
    return materialise(dealt.groupBy("block").applyInArrow(pack, schema), "blocks")


def _deal(blocks: DataFrame, networks: int) -> tuple[DataFrame, int]:
    """Blocks dealt evenly to the tasks; few blocks are written once for each share of the networks."""
    cores, count = blocks.sparkSession.sparkContext.defaultParallelism, blocks.count()
    shares = max(1, min(networks, -(-UNITS_A_CORE * cores // max(count, 1))))
    units = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    tasks = max(1, min(cores * -(-count // (64 * cores)), count * shares))  # whole waves of at most 64 blocks a task
    unit = F.col("block") * shares + F.col("share")
    return materialise(units.repartitionById(tasks, (unit % tasks).cast("int")), "units"), shares


class _Chosen:
    """A network's turned rows in a block, those held out for validation apart, with moments when they are asked for."""

    def __init__(self, x: np.ndarray, y: np.ndarray, own: np.ndarray, held: np.ndarray) -> None:
        test, part = np.flatnonzero(own & held), np.flatnonzero(own & ~held)
        self.test, self.truth = x.take(test, axis=1), y[test]
        self.x, self.y = x.take(part, axis=1), y[part]
        self.sums = np.array([len(test), self.truth.sum(), self.truth @ self.truth])
        self.moments: dict = {}

    def of(self, size: int) -> tuple:
        if size not in self.moments:
            self.moments[size] = _moments(self.x, self.y, size)
        return self.moments[size]


def _block_pass(nets: Sequence[tuple[int, Network]], z, fold, held, scratch: _Scratch):
    """Number, row and state after the block, of each network that has rows in it."""
    chosen: dict = {}  # networks of a fold share their rows
    alike: dict = {}
    x, y = _turned(z[:, :-1]), z[:, -1].copy()
    for i, net in nets:
        if (net.skip, net.own) not in chosen:
            own = net.rows(fold)
            chosen[net.skip, net.own] = _Chosen(x, y, own, held) if own.any() else None
        if chosen[net.skip, net.own] is not None:
            size = int(net.params["batch_size"])
            alike.setdefault((tuple(net.sizes), size) if _by_moments(net) else i, []).append((i, net, chosen[net.skip, net.own]))
    for group in alike.values():
        if _by_moments(group[0][1]):
            size = int(group[0][1].params["batch_size"])
            steps = _moment_steps([net for _, net, _ in group], [rows.of(size) for _, _, rows in group])
        else:
            steps = [_batch_steps(rows.x, rows.y, net, scratch) for _, net, rows in group]
        for (i, net, rows), (w, v) in zip(group, steps):
            e = _outputs(rows.test, net.flat, net.sizes, net.params["activation"], scratch) - rows.truth
            share = len(rows.y) / BLOCK_ROWS
            state = np.concatenate([w, v, [1.0]])
            state *= share
            # a network whose weights leave the range has lost its way; its scores say so
            np.clip(state, -16384, 16384, out=state)
            state[np.isnan(state)] = 0.0
            state *= STEPS
            np.rint(state, out=state)
            sums = np.array([*rows.sums, np.nan_to_num(e @ e, nan=1e300, posinf=1e300)])
            yield i, np.concatenate([state.astype(np.int64).view(np.float64), sums])


def _parts(networks: Sequence[Network]) -> list[list[Network]]:
    """Networks for each loop of epochs: those alike stay together, the costly kinds are dealt out in turn."""
    kinds: dict = {}
    for net in networks:
        kinds.setdefault((tuple(net.sizes), net.params["activation"], int(net.params["batch_size"])), []).append(net)
    cost = {k: (not _by_moments(nets[0])) * len(nets) * len(nets[0].flat) for k, nets in kinds.items()}
    ordered = sorted(kinds, key=lambda k: -cost[k])  # of equal ones the first comes first
    parts: list[list[Network]] = [[] for _ in range(min(LOOPS, len(kinds)))]
    for at, k in enumerate(ordered):
        parts[at % len(parts)] += kinds[k]
    return parts


def train(blocks: DataFrame, networks: Sequence[Network]) -> None:
    """Epochs over all networks until each has stopped.

    Networks don't depend on each other, so parts of them have loops of their own:
    while one plans its next epoch or waits for its last task, the cores do another's.
    """
    blocks, shares = _deal(blocks, len(networks))
    parts = _parts(networks)
    if len(parts) == 1:
        return _epochs(blocks, shares, parts[0])
    carried = inheritable_thread_target(blocks.sparkSession)  # the session itself where threads aren't pinned
    loop = carried(_epochs) if callable(carried) else _epochs
    with ThreadPoolExecutor(len(parts)) as pool:
        loops = [pool.submit(loop, blocks, shares, part) for part in parts]
        try:
            wait(loops, return_when=FIRST_EXCEPTION)
        finally:
            for net in networks:  # after an error or an interrupt the other loops end
                net.live = False
        for done in loops:
            done.result()


def _epochs(blocks: DataFrame, shares: int, networks: Sequence[Network]) -> None:
    width, tasks = networks[0].sizes[0] + 1, blocks.rdd.getNumPartitions()
    while live := [(i, n) for i, n in enumerate(networks) if n.live]:
        sent = [(i, replace(n, best_flat=None)) for i, n in live]  # the best weights stay on the driver

        def local(batches):
            from pyspark import TaskContext

            total: dict[int, np.ndarray] = {}
            scratch = _Scratch()
            for batch in batches:
                for values, folds, held, turn in zip(*(batch.column(c).to_pylist() for c in ("values", "folds", "held", "share"))):
                    z = np.frombuffer(values).reshape(-1, width)
                    with np.errstate(all="ignore"):
                        for i, row in _block_pass(sent[turn::shares], z, np.frombuffer(folds, np.int32), np.frombuffer(held, bool), scratch):
                            total[i] = row if i not in total else _added(total[i], row)
            slot = TaskContext.get().partitionId() % 64
            for i, row in total.items():
                yield pa.RecordBatch.from_pydict(
                    {"net": pa.array([i], pa.int32()), "slot": pa.array([slot], pa.int32()), "body": pa.array([row.tobytes()], pa.binary())}
                )

        schema = "net int, slot int, body binary"
        sums = blocks.mapInArrow(local, schema)
        if tasks > 64:  # added up on the cluster until no network has more than 64 states
            sums = sums.groupBy("net", "slot").applyInArrow(_add_rows, schema)
        parts: dict[int, list[bytes]] = {}
        for r in sums.select("net", "body").collect():
            parts.setdefault(r["net"], []).append(bytes(r["body"]))
        found = {i: _sum_rows(bodies) for i, bodies in parts.items()}
        for i, net in live:
            if i not in found:
                net.live = False
                continue
            state, (n, y, yy, sse) = found[i][:-4].view(np.int64) / STEPS, found[i][-4:]
            spread = yy - y * y / n if n else 0.0
            net.scored(1 - sse / spread if spread > 0 else -math.inf)
            if not net.live or net.epochs >= int(net.params["max_iter"]):
                net.live = False
            elif state[-1] > 0:
                mean = state[:-1] / state[-1]
                net.flat, net.speed = mean[: len(net.flat)], mean[len(net.flat) :]
                net.epochs += 1
            else:
                net.live = False


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number states and sums of two parts."""
    state = a[:-4].view(np.int64) + b[:-4].view(np.int64)
    return np.concatenate([state.view(np.float64), a[-4:] + b[-4:]])


def _sum_rows(bodies: list[bytes]) -> np.ndarray:
    bodies = sorted(bodies)  # sums of scores in one order
    row = np.frombuffer(bodies[0])
    for body in bodies[1:]:
        row = _added(row, np.frombuffer(body))
    return row


def _add_rows(table: pa.Table) -> pa.Table:
    row = _sum_rows([b.as_py() for b in table.column("body")])
    return pa.table({"net": table.column("net").slice(0, 1), "slot": table.column("slot").slice(0, 1), "body": pa.array([row.tobytes()], pa.binary())})


def _fitted(name: str, features: Sequence[str], net: Network) -> PerceptronFit:
    return PerceptronFit(name, list(features), net.sizes, net.best_flat.tolist(), dict(net.params), net.epochs)


def fit_perceptron(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: Sequence[str],
    params: Mapping | None = None,
    seed=SPLIT_SEED,
    name: str = "MLP",
) -> PerceptronFit:
    """Train one network with momentum and early stopping on a held-out hash bucket.

    Training stops when the held-out R2 has not improved by the tolerance for ten
    epochs; the best weights are kept. ``adaptive`` divides the rate by five instead,
    until it is very small.
    """
    net = Network.of(params or {}, -2, len(features), seed)
    train(lay_rows(df, features, label, key, None, seed), [net])
    return _fitted(name, features, net)


def _fold_scores(blocks: DataFrame, networks: Sequence[Network]) -> DataFrame:
    """``net, test, train``: R2 of each network on its held-out fold and on its own rows, in one scan."""
    width = networks[0].sizes[0] + 1
    work = [(n.skip, n.best_flat, n.sizes, n.params["activation"]) for n in networks]

    def emit(batches):
        total = np.zeros((len(work), 2, 4))
        scratch = _Scratch()
        for batch in batches:
            for values, folds in zip(*(batch.column(c).to_pylist() for c in ("values", "folds"))):
                z, fold = np.frombuffer(values).reshape(-1, width), np.frombuffer(folds, np.int32)
                x, y = _turned(z[:, :-1]), z[:, -1]
                for i, (skip, flat, sizes, activation) in enumerate(work):
                    with np.errstate(all="ignore"):
                        e = (_outputs(x, flat, sizes, activation, scratch) - y) ** 2
                    for side, rows in enumerate((fold == skip, fold != skip)):
                        total[i, side] += [rows.sum(), y[rows].sum(), (y[rows] ** 2).sum(), e[rows].sum()]
        flat = total.reshape(-1, 4)
        at = np.arange(len(flat))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at // 2, pa.int32()), pa.array(at % 2 == 1), *(pa.array(flat[:, k]) for k in range(4))],
            ["net", "own", "n", "y", "yy", "sse"],
        )

    sums = blocks.mapInArrow(emit, "net int, own boolean, n double, y double, yy double, sse double")
    sums = sums.groupBy("net", "own").agg(*[F.sum(c).alias(c) for c in ("n", "y", "yy", "sse")])
    spread = F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    r2 = F.when((F.col("n") > 0) & (spread > 1e-12 * F.col("yy")), 1 - F.col("sse") / spread)
    return sums.groupBy("net").agg(F.max(F.when(~F.col("own"), r2)).alias("test"), F.max(F.when(F.col("own"), r2)).alias("train"))


def search_perceptron(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    key: Sequence[str],
    grid: Mapping[str, Sequence] | None = None,
    n_iter: int = 10,
    folds: int = CV_FOLDS,
    seed=SPLIT_SEED,
    name: str = "MLP",
) -> tuple[PerceptronFit, DataFrame]:
    """Randomised search with cross-validation; every point is also fitted on all rows, and the best of these is kept.

    All points and folds share the passes over the rows.
    """
    points = draw_points(grid or GRID, n_iter, seed)
    blocks = lay_rows(fold_rows(df, key, folds, seed, "_fold"), features, label, key, "_fold", seed)
    fits = [(i, fold) for i in range(len(points)) for fold in range(folds)]
    networks = [Network.of(points[i], fold, len(features), seed) for i, fold in fits]
    whole = [Network.of(p, -2, len(features), seed) for p in points]
    train(blocks, [*networks, *whole])
    spark = df.sparkSession
    of_net = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(fits)], "net int, point int")
    listed = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(points)], "point int, params string")
    table = (
        _fold_scores(blocks, networks)
        .join(F.broadcast(of_net), "net")  # points times folds
        .groupBy("point")
        .agg(
            F.avg("test").alias("mean_test_score"), F.stddev_pop("test").alias("std_test_score"),
            F.avg("train").alias("mean_train_score"), F.stddev_pop("train").alias("std_train_score"),
        )
        .join(F.broadcast(listed), "point")
        .withColumn("model", F.lit(name))
    )
    table = materialise(table, "search")
    best = table.orderBy(F.col("mean_test_score").desc_nulls_last(), "point").first()["point"]
    return _fitted(name, features, whole[best]), table
