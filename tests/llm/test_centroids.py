"""Heap-ordered k-means against the comparison of all vectors in all rounds."""

import hashlib
import math

import numpy as np
import pytest
from oracle_compare import compare, connect
from pyspark.sql import functions as F

from traitspark.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 9, 9) for i, v in rows], SCHEMA)


def plain(rows, k, rounds, dims, seed=3):
    good = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in good]
    key = [(i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in good]
    centres = [k_[2] for k_ in sorted(key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in good]
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(good, own) if o == c]
            if mine:
                centres[c] = tuple(sum(x) // len(mine) for x in zip(*mine))
    last = [(i, *nearest(v)[::-1]) for i, v in good]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    total = sum(d for *_, d in last)
    return sorted(((i, c, d, sum(e for _, o, e in last if o == c), total, sha[c]) for i, c, d in last), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]),
            (7, [float("inf"), 0.0]), (None, [-3.25, 2.0]), (8, [-3.3, 2.0]), (9, [0.0, 0.0]), (10, []), (11, [5.0, 5.0])]
    for k in (1, 2, 4, 8, 20):
        assert found(centroids.cluster(frame(spark, rows), k, 4, 2)) == plain(rows, k, 4, 2)


def test_empty_table(spark):
    assert centroids.cluster(frame(spark, [(1, None)]), 3, 2, 2).count() == 0


def test_ties_and_copies(spark):
    """Whole-number points at equal distances, each many times."""
    rows = [(i, [float(i % 4), float(i // 4 % 4)]) for i in range(400)]
    assert found(centroids.cluster(frame(spark, rows), 5, 6, 2)) == plain(rows, 5, 6, 2)


def test_component_too_large(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(frame(spark, [(1, [1e9, 0.0])]), 1, 1, 2).collect()


def test_heaps_look_at_few_vectors_and_stay_exact():
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (6, 8))
    matrix = (centres[rng.integers(0, 6, 3000)] + rng.integers(-900, 900, (3000, 8))).astype(np.int32)
    model = centroids.Model(matrix[:6].tolist())
    state = centroids.State.first(model, matrix)
    looked = 0
    for _ in range(12):
        counts = np.bincount(state.near, minlength=6)
        sums = [[int(x) for x in matrix[state.near == c].sum(axis=0, dtype=np.int64)] for c in range(6)]
        model.move(sums, counts.tolist())
        state = centroids.State.unpacked(state.packed())
        looked += len(state.step(model, matrix))
        assert (state.near == model.scan(matrix)[0]).all()
        assert sorted(i for heap in state.heaps for _, i in heap) == list(range(3000))
    assert looked < 12 * 3000 / 2


def test_sql(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("distance", F.lit("x"))
    assert compare(centroids.cluster(vectors), connect(sf_dir), centroids.sql()) == ""
