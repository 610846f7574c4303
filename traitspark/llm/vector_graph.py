"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Vectors are dealt into shards by a hash of their id, at most about
``shard_rows`` each. In a shard, equal vectors are one vertex. Vertices are put
in by batches: a beam search from the vertex nearest the mean proposes
neighbours, relaxed pruning keeps those that no kept neighbour is ``slack``
times nearer to (so long edges stay), and the kept ones take a pruned edge back.
A shard's graph is one row of arrays, written to the shared folder.

Queries go in blocks of ``block_rows`` to every shard, where a beam search finds
each query's nearest; the shards' findings are merged by distance. Distances in
the result are computed in double precision from the original vectors.

Results for odd input: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without an id; vectors of another length
are searched among their own kind only; a query gets at most ``k`` rows, fewer
if there are fewer candidates; rows with the query's own id are no candidates;
a repeated row is one candidate, an id with different vectors is several, and
the smallest of these is the query; an empty table gives an empty result. Other
columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vector, size`` of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("vector"))
        .where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull())
        .select("vec_id", v.cast("array<double>").alias("vector"), F.size("vector").alias("size"))
    )


def _nearest(points: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int, limit: int | None = None):
    """Beam search of many queries at once: the beam's vertices and squared distances, nearest first, and what was visited."""
    n, q = len(points), len(queries)
    norms = np.einsum("ij,ij->i", points, points)
    rows = np.arange(q)
    ids = np.full((q, beam), -1, np.int64)
    far = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # a place for edges that are not there
    ids[:, 0], done[:, 0] = start, False
    far[:, 0] = norms[start] - 2 * queries @ points[start] + np.einsum("ij,ij->i", queries, queries)
    seen[:, start] = True
    own = np.einsum("ij,ij->i", queries, queries)
    visited = []
    for _ in range(limit or n):
        open_far = np.where(done, np.inf, far)
        at = open_far.argmin(1)
        live = np.isfinite(open_far[rows, at])
        if not live.any():
            break
        act = rows[live]
        vertex = ids[act, at[live]]
        done[act, at[live]] = True
        step = np.full(q, -1, np.int64)
        step[act] = vertex
        visited.append(step)
        near = edges[vertex]
        near = np.where(near < 0, n, near)
        fresh = ~seen[act[:, None], near]
        seen[act[:, None], near] = True
        safe = np.where(fresh, near, 0)
        d = norms[safe] - 2 * np.einsum("qej,qj->qe", points[safe], queries[act]) + own[act, None]
        d = np.where(fresh, d, np.inf).astype(np.float32)
        all_far = np.concatenate([far[act], d], 1)
        all_ids = np.concatenate([ids[act], np.where(fresh, near, -1)], 1)
        all_done = np.concatenate([done[act], ~fresh], 1)
        best = np.argsort(all_far, 1, kind="stable")[:, :beam]
        far[act], ids[act], done[act] = (np.take_along_axis(x, best, 1) for x in (all_far, all_ids, all_done))
    return ids, far, np.stack(visited, 1) if visited else np.zeros((q, 0), np.int64)


def _prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, slack: float) -> np.ndarray:
    """Of each row's candidates (-1: none), the nearest that no kept one is ``slack`` times nearer to."""
    q = len(own)
    none = (candidates < 0) | (candidates == own[:, None])
    safe = np.where(none, 0, candidates)
    place = points[safe]
    gap = place - points[own][:, None, :]
    far = np.where(none, np.inf, np.einsum("qcj,qcj->qc", gap, gap))
    order = np.argsort(far, 1, kind="stable")
    far, safe, place = np.take_along_axis(far, order, 1), np.take_along_axis(safe, order, 1), np.take_along_axis(place, order[:, :, None], 1)
    out, rows = np.full((q, degree), -1, np.int64), np.arange(q)
    left = np.isfinite(far)
    for j in range(degree):
        at = left.argmax(1)
        some = left[rows, at]
        if not some.any():
            break
        out[some, j] = safe[rows[some], at[some]]
        gap = place - place[rows, at][:, None, :]
        covered = slack * slack * np.einsum("qcj,qcj->qc", gap, gap) <= far
        left &= ~(covered & some[:, None])
        left[rows, at] = False
    return out


def build_graph(points: np.ndarray, degree: int, beam: int, slack: float, batch: int = 256) -> tuple[np.ndarray, int]:
    """Edges of every vertex (-1: none), and the vertex that searches start from."""
    n = len(points)
    middle = points.mean(0)
    gap = points - middle
    start = int(np.einsum("ij,ij->i", gap, gap).argmin())
    edges = np.full((n, degree), -1, np.int64)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    low = 1
    while low < n:
        # batches double until they are full, as a batch does not see itself
        some = order[low : low + min(batch, low)]
        low += len(some)
        ids, _, visited = _nearest(points, edges, start, points[some], beam)
        edges[some] = _prune(points, some, _unique(np.concatenate([ids, visited], 1)), degree, slack)
        target = edges[some].ravel()
        source = np.repeat(some, degree)[target >= 0]
        target = target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(target)))
        for width in np.unique(np.minimum(count, batch)):  # vertices that get as many edges, together
            of = np.flatnonzero(np.minimum(count, batch) == width)
            back = source[first[of][:, None] + np.arange(width)]
            vertex = target[first[of]]
            both = _unique(np.concatenate([edges[vertex], back], 1))
            free = (both >= 0).sum(1) <= degree
            fits = vertex[free]
            if len(fits):
                padded = np.full((len(fits), degree), -1, np.int64)
                kept = np.sort(both[free], 1)[:, ::-1][:, :degree]
                padded[:, : kept.shape[1]] = kept
                edges[fits] = padded
            if (~free).any():
                edges[vertex[~free]] = _prune(points, vertex[~free], both[~free], degree, slack)
    return edges, start


def _unique(ids: np.ndarray) -> np.ndarray:
    """Rows without repeated ids (-1 in their place)."""
    ids = np.sort(ids, 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    return ids


def _merge_equal(ids: np.ndarray, vectors: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different vectors; ids of each (the ``keep`` smallest), and where each one's begin."""
    order = np.lexsort((ids, *vectors.T[::-1]))
    ids, vectors = ids[order], vectors[order]
    new = np.ones(len(ids), bool)
    new[1:] = (vectors[1:] != vectors[:-1]).any(1)
    group = np.cumsum(new) - 1
    same = np.zeros(len(ids), bool)
    same[1:] = ~new[1:] & (ids[1:] == ids[:-1])
    ids, group = ids[~same], group[~same]
    first = np.searchsorted(group, np.arange(group[-1] + 1))
    some = np.arange(len(ids)) - first[group] < keep
    ids, group = ids[some], group[some]
    return vectors[new], ids, np.searchsorted(group, np.arange(group[-1] + 2))


def index(vectors: DataFrame, shard_rows: int, degree: int, beam: int, slack: float, keep: int) -> DataFrame:
    """``size, shard`` and the arrays of each shard's graph."""
    counts = {r["size"]: r["count"] for r in vectors.groupBy("size").count().collect()}  # lengths, not rows
    shards = F.lit(1)
    for size, count in counts.items():
        shards = F.when(F.col("size") == size, -(-count // shard_rows)).otherwise(shards)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        points, ids, first = _merge_equal(rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy()), keep)
        edges, start = build_graph(points.astype(np.float32), degree, beam, slack)
        cells = {"points": points.tobytes(), "ids": ids.tobytes(), "first": first.tobytes(), "edges": edges.astype(np.int32).tobytes()}
        return pd.DataFrame({"size": rows["size"].head(1).tolist(), "shard": rows["shard"].head(1).tolist(), "start": [start], **{k: [v] for k, v in cells.items()}})

    shard = F.pmod(F.xxhash64("vec_id"), shards).cast("int").alias("shard")
    return vectors.select("vec_id", "vector", "size", shard).groupBy("size", "shard").applyInPandas(
        build, "size int, shard int, start int, points binary, ids binary, first binary, edges binary"
    )


def search(graphs: DataFrame, queries: DataFrame, k: int, beam: int, block_rows: int) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` nearest that each shard finds for each query."""
    blocks = max(1, -(-queries.count() // block_rows))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(v=[tuple(v) for v in rows["vector"]]).sort_values(["vec_id", "v"]).drop_duplicates("vec_id")
        return pd.DataFrame(
            {"size": [rows["size"].iloc[0]], "block": [rows["block"].iloc[0]], "query_ids": [rows["vec_id"].to_numpy().tobytes()], "queries": [np.stack(rows["vector"].to_numpy()).tobytes()]}
        )

    packed = (
        queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        .groupBy("size", "block").applyInPandas(pack, "size int, block int, query_ids binary, queries binary")
    )
    every = graphs.select("size", "shard").distinct()
    packed = materialise(packed.join(every, "size"), "blocks")  # blocks times shards, not rows
    blocks_of = packed.select(*[F.col(c).alias(f"b_{c}") for c in ("size", "shard", "block")])
    opened = graphs.join(blocks_of, (F.col("size") == F.col("b_size")) & (F.col("shard") == F.col("b_shard"))).select(
        *graphs.columns, F.col("b_block").alias("block")
    )

    def find(key, graph: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if graph.empty or block.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        size, g, b = int(key[0]), graph.iloc[0], block.iloc[0]
        points = np.frombuffer(g["points"]).reshape(-1, size)
        ids, first = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["first"], np.int64)
        edges = np.frombuffer(g["edges"], np.int32).reshape(len(points), -1).astype(np.int64)
        query_ids, wanted = np.frombuffer(b["query_ids"], np.int64), np.frombuffer(b["queries"]).reshape(-1, size)
        out: list[pd.DataFrame] = []
        small = points.astype(np.float32)
        for low in range(0, len(wanted), 256):
            q, q_ids = wanted[low : low + 256], query_ids[low : low + 256]
            found, _, _ = _nearest(small, edges, int(g["start"]), q.astype(np.float32), beam)
            row, at = np.nonzero(found >= 0)
            vertex = found[row, at]
            score = np.sqrt(((q[row] - points[vertex]) ** 2).sum(1))
            copies = first[vertex + 1] - first[vertex]
            place = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            one = pd.DataFrame(
                {"query_id": np.repeat(q_ids[row], copies), "vec_id": ids[np.repeat(first[vertex], copies) + place], "score": np.repeat(score, copies)}
            )
            one = one[one["query_id"] != one["vec_id"]].sort_values(["query_id", "score", "vec_id"])
            out.append(one.groupby("query_id").head(k))
        return pd.concat(out)

    on = ["size", "shard", "block"]
    return opened.groupBy(*on).cogroup(packed.groupBy(*on)).applyInPandas(find, FOUND)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    shard_rows: int = 8192,
    degree: int = 32,
    beam: int = 96,
    slack: float = 1.2,
    block_rows: int = 4096,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row of ``queries`` among ``vectors``, by Euclidean distance."""
    points = usable(vectors, id_column, vector_column)
    graphs = materialise(index(points, shard_rows, degree, beam, slack, k + 1), "graphs")
    found = search(graphs, usable(queries, id_column, vector_column), k, max(beam, k + 1), block_rows)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
