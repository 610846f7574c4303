"""Exact k-means on whole numbers, with heaps of bounds that tell which vectors to look at.

Vectors are packed into blocks of ``BLOCK`` in the order they are read, so copies
and hot ids spread evenly. Every block keeps, for each cluster, a heap of its
vectors ordered by their gap: distance to the second nearest centroid less
distance to the nearest. When centroids move, a gap shrinks by at most the own
centroid's drift plus the largest drift of another one; the sum of these since the
start is the cluster's offset. A heap entry is the gap plus the offset of the
moment it was pushed, so it expires when the offset reaches it and nothing needs
to be rewritten in between. A round pops the expired entries, compares exactly
these vectors with all centroids and pushes them again where they belong.

Distances are sums of squares of whole numbers and exact. Gaps are floating point
and lowered by far more than their rounding error, so a vector may be looked at
once too often, never too seldom: the result is that of comparing every vector in
every round.

Blocks and states are tables bucketed by block in the shared folder: the join of a
round needs no shuffle, a state is written before the next round reads it, and
older states are dropped. Only sums of moved vectors leave a task, and only
centroids (``k`` times ``dims`` numbers) are on the driver.

Results for odd input: vectors that are null, have not exactly ``dims``
components, or have a null or non-finite one, take no part; every row with a vector
takes part, also when its id repeats or is null (a null id is never a first centroid
as long as others are there); with fewer than ``k`` vectors each is a first centroid;
an empty table gives an empty result; equal vectors go to the centroid with the
smaller number. A component of more than ``LARGEST`` after scaling is an error,
because its squared distances are not 64-bit numbers. Other columns than ``vec_id``
and ``embedding`` are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, scratch_path, spread

#: Vectors of a block.
BLOCK = 4096
#: Blocks of a bucket.
BUCKET_BLOCKS = 64
SCALE = 1024
#: Largest component for which squared distances of 64 components fit into 63 bits.
LARGEST = 1 << 27
#: Share of the numbers involved by which gaps are lowered; their rounding error is a thousandth of it.
SLACK = 1e-12


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """``vec_id`` and the whole-number ``vector`` of the rows that take part."""
    parts = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("x")).where(F.size("x") == dims)
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(~bad).select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("vector"))


def seeds(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors whose ``seed:vec_id`` has the smallest SHA-256, in its order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select("vector", key.alias("key")).orderBy(F.col("key").asc_nulls_last(), "vector").limit(k)
    return [[int(x) for x in row.vector] for row in first.collect()]  # k rows


def _block_rows(dims: int):
    def emit(batches):
        first, number = TaskContext.get().partitionId() << 32, 0
        ids, parts, have = [], [], 0

        def closed(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, parts, have, number
            if not have:
                return
            all_ids, matrix = pa.concat_arrays(ids), np.concatenate(parts)
            for low in range(0, have, BLOCK):
                high = min(low + BLOCK, have)
                if high - low < BLOCK and not last:
                    ids, parts, have = [all_ids.slice(low)], [matrix[low:]], have - low
                    return
                row = {
                    "block": pa.array([first + number], pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), all_ids.slice(low, high - low)),
                    "matrix": pa.array([matrix[low:high].tobytes()], pa.binary()),
                }
                number += 1
                yield pa.RecordBatch.from_pydict(row)
            ids, parts, have = [], [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten().to_numpy()
            # the smallest 64-bit number has no absolute value
            if flat.max() > LARGEST or flat.min() < -LARGEST:
                raise ValueError(f"a vector has a component beyond {LARGEST}")
            ids.append(batch.column("vec_id"))
            parts.append(flat.reshape(-1, dims).astype(np.int32))
            have += batch.num_rows
            if have >= BLOCK:
                yield from closed(False)
        yield from closed(True)

    return emit


class Model:
    """Centroids and the clusters' offsets, as they go to the tasks."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        self.offsets = [0.0] * len(centroids)

    def move(self, sums: list[list[int]], counts: list[int]) -> None:
        """New centroids, floors of the means, and what every gap loses by it."""
        new = [[s // n for s in own] if n else old for own, n, old in zip(sums, counts, self.centroids)]
        drift = [float(sum((x - y) ** 2 for x, y in zip(a, b))) ** 0.5 for a, b in zip(self.centroids, new)]
        for c in range(len(new)):
            self.offsets[c] += drift[c] + max(drift[:c] + drift[c + 1 :], default=0.0)
        self.centroids = new

    def expired(self, cluster: int) -> float:
        offset = self.offsets[cluster]
        return offset + SLACK * (1 + offset)

    def scan(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid of each vector, and the heap key of its gap."""
        far = np.empty((len(self.centroids), len(vectors)), np.int64)
        for c, centroid in enumerate(self.centroids):
            far[c] = np.square(vectors.astype(np.int64) - np.array(centroid, np.int64)).sum(axis=1)
        near = far.argmin(axis=0)  # the smaller number of equal ones
        if len(far) == 1:
            return near, np.full(len(vectors), np.inf)
        first, second = np.sqrt(np.partition(far, 1, axis=0)[:2].astype(np.float64))
        offset = np.array(self.offsets)[near]
        return near, second - first + offset - SLACK * (first + second + offset)


class State:
    """A block's clusters and heaps."""

    def __init__(self, near: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.near, self.heaps = near, heaps

    @classmethod
    def first(cls, model: Model, matrix: np.ndarray) -> State:
        near, keys = model.scan(matrix)
        heaps = []
        for c in range(len(model.centroids)):
            own = np.flatnonzero(near == c)
            heaps.append(list(zip(keys[own].tolist(), own.tolist())))
            heapq.heapify(heaps[-1])
        return cls(near.astype(np.int32), heaps)

    def step(self, model: Model, matrix: np.ndarray) -> np.ndarray:
        """Pops what has expired, compares it and pushes it again; gives the popped vectors."""
        popped = []
        for c, heap in enumerate(self.heaps):
            limit = model.expired(c)
            while heap and heap[0][0] <= limit:
                popped.append(heapq.heappop(heap)[1])
        popped = np.array(popped, np.int64)
        if len(popped):
            near, keys = model.scan(matrix[popped])
            for i, c, key in zip(popped.tolist(), near.tolist(), keys.tolist()):
                heapq.heappush(self.heaps[c], (key, i))
            self.near[popped] = near
        return popped

    def packed(self) -> dict[str, bytes]:
        flat = [entry for heap in self.heaps for entry in heap]
        return {
            "near": self.near.tobytes(),
            "sizes": np.array([len(h) for h in self.heaps], np.int32).tobytes(),
            "keys": np.array([e[0] for e in flat]).tobytes(),
            "order": np.array([e[1] for e in flat], np.int32).tobytes(),
        }

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> State:
        keys, order = np.frombuffer(row["keys"]), np.frombuffer(row["order"], np.int32)
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int32))
        # a heap is stored in its own order, so it is one again
        heaps = [list(zip(k.tolist(), o.tolist())) for k, o in zip(np.split(keys, ends[:-1]), np.split(order, ends[:-1]))]
        return cls(np.frombuffer(row["near"], np.int32).copy(), heaps)


STATE = "block long, near binary, sizes binary, keys binary, order binary, moved binary, n_scanned long"


def _moved(before: np.ndarray | None, after: np.ndarray, matrix: np.ndarray, k: int) -> np.ndarray:
    """Sums and counts that the clusters win and lose."""
    out = np.zeros((k, matrix.shape[1] + 1), np.int64)
    rows = np.ones((len(matrix), matrix.shape[1] + 1), np.int64)
    rows[:, :-1] = matrix
    for c in range(k):
        out[c] += rows[after == c].sum(axis=0)
        if before is not None:
            out[c] -= rows[before == c].sum(axis=0)
    return out


def _step_rows(model: Model, dims: int):
    """A round over some blocks; without a state, the first one."""

    def emit(batches):
        names = [f.split()[0] for f in STATE.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                matrix = np.frombuffer(row["matrix"], np.int32).reshape(-1, dims)
                if row.get("near") is None:
                    state, before, seen = State.first(model, matrix), None, np.arange(len(matrix))
                else:
                    state = State.unpacked(row)
                    old = state.near.copy()
                    seen = state.step(model, matrix)
                    before = old[seen]
                moved = _moved(before, state.near[seen], matrix[seen], len(model.centroids))
                out = {"block": row["block"], **state.packed(), "moved": moved.tobytes(), "n_scanned": len(seen)}
                yield pa.RecordBatch.from_pylist([{n: out[n] for n in names}])

    return emit


def _last_rows(model: Model, dims: int):
    """The last assignment: every vector's cluster and squared distance."""

    def emit(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = np.frombuffer(row["matrix"], np.int32).reshape(-1, dims)
                state = State.unpacked(row)
                state.step(model, matrix)
                own = np.array(model.centroids, np.int64)[state.near]
                distance = np.square(matrix - own).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(state.near, pa.int32()), pa.array(distance, pa.int64())],
                    ["vec_id", "cluster", "distance"],
                )

    return emit


def _moved_rows(width: int):
    """Sums of the tasks' blocks, a row for each number that is not zero."""

    def emit(batches):
        total = None
        for batch in batches:
            for body in batch.column("moved"):
                found = np.frombuffer(body.as_py(), np.int64)
                total = found.copy() if total is None else total + found
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["slot", "value"])

    return emit


def _add_moved(state: DataFrame, sums: list[list[int]], counts: list[int]) -> None:
    width = len(sums[0]) + 1
    moved = state.select("moved").mapInArrow(_moved_rows(width), "slot long, value long")
    total = moved.groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    for slot, value in total.collect():  # clusters times components
        c, j = divmod(slot, width)
        if j == width - 1:
            counts[c] += int(value)
        else:
            sums[c][j] += int(value)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part."""
    spark = vectors.sparkSession
    rows = spread(kept(vectors, dims))
    model = Model(seeds(rows, k, seed))
    out = "vec_id long, cluster int, distance long"
    if not model.centroids:
        empty = out + ", cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    store = f"centroids_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {store} LOCATION '{scratch_path(spark, 'centroids')}'")
    try:
        packed = materialise(rows.mapInArrow(_block_rows(dims), "block long, ids array<bigint>, matrix binary"), "blocks")
        buckets = -(-packed.count() // BUCKET_BLOCKS)
        buckets = max(buckets, spark.sparkContext.defaultParallelism)

        def save(df: DataFrame, name: str) -> DataFrame:
            df.write.option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(f"{store}.{name}")
            return spark.table(f"{store}.{name}")

        blocks = save(packed.repartition(buckets, "block"), "blocks")
        sums, counts = [[0] * dims for _ in model.centroids], [0] * len(model.centroids)
        state = save(blocks.drop("ids").mapInArrow(_step_rows(model, dims), STATE), "state_0")
        for number in range(1, rounds + 1):
            _add_moved(state, sums, counts)
            model.move(sums, counts)
            both = blocks.join(state.drop("moved", "n_scanned").hint("merge"), "block")
            if number < rounds:
                state = save(both.drop("ids").mapInArrow(_step_rows(model, dims), STATE), f"state_{number}")
                spark.sql(f"DROP TABLE {store}.state_{number - 1}")
        found = materialise(both.mapInArrow(_last_rows(model, dims), out), "clusters")
    finally:
        spark.sql(f"DROP DATABASE {store} CASCADE")
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in model.centroids]
    names = spark.createDataFrame(list(enumerate(sha)), "cluster int, centroid_sha256 string")
    of_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    total = of_cluster.agg(F.sum("s").cast("long").alias("inertia"))
    known = names.join(of_cluster, "cluster").crossJoin(total)  # k rows and one row
    known = known.select("cluster", F.col("s").cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256")
    return found.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """The same by comparing every vector in every round."""
    far = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.v, c.v)])"
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT) for x in embedding] AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY key NULLS LAST, v) - 1 AS cluster, v
  FROM (SELECT sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS key, v FROM kept)
  QUALIFY cluster < {k})""",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': cluster}}) AS best
  FROM (SELECT p.r, p.vec_id, p.v, c.cluster, {far} AS d FROM kept p CROSS JOIN c{n} c) GROUP BY r)"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v
  FROM (SELECT best.c AS cluster, j, sum(v[j]) AS s, count(*) AS n
        FROM a{n} CROSS JOIN (SELECT unnest(range(1, {dims + 1})) AS j) GROUP BY 1, 2) GROUP BY cluster),
c{n + 1} AS MATERIALIZED (
  SELECT o.cluster, CAST(coalesce(m.v, o.v) AS HUGEINT[]) AS v FROM c{n} o LEFT JOIN m{n} m ON m.cluster = o.cluster)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.cluster = best.c"""
