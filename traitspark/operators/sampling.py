"""Deterministic sampling, splitting and folding by salted key hashes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import (
    PRIME,
    draw_constants,
    draw_limit,
    hex_bound,
    hex_int,
    residue,
    salted_md5,
)
from .ranking import hash_rank, hash_smallest

# Share of test rows and seed of the train/test split, default folds.
TEST_SHARE = 0.3
SPLIT_SEED = 1010
CV_FOLDS = 10


def sample_rows(
    df: DataFrame, key: Sequence[str], k: int | None, seed=0, group: Sequence[str] = ()
) -> DataFrame:
    """Exactly ``k`` rows per group without replacement; ``None`` keeps all rows."""
    if k is None:
        return df
    hashed = df.withColumn("_hash", salted_md5(seed, *key))
    return hash_smallest(hashed, "_hash", k, group).drop("_hash")


def sample_keys(df: DataFrame, key: Sequence[str], k: int, seed=0) -> DataFrame:
    """The keys of an exact sample: at most ``k`` rows, to cut the same sample from several tables."""
    return sample_rows(df.select(*key), key, k, seed)


def paired_samples(
    frames: Sequence[DataFrame], key: Sequence[str], k: int, seed=0
) -> list[DataFrame]:
    """The same ``k`` sampled keys from every frame."""
    from .skew import lookup_join

    keys = sample_keys(frames[0], key, k, seed)
    return [lookup_join(f, keys, key, "left_semi") for f in frames]


def split_rows(
    df: DataFrame,
    key: Sequence[str],
    test_share: float = TEST_SHARE,
    seed=SPLIT_SEED,
    out: str = "is_test",
    exact: bool = False,
) -> DataFrame:
    """Mark test rows.

    By default a row is a test row when its hash falls below the share: no
    shuffle, stable when rows are added. ``exact`` takes the nearest whole
    number of rows (rounded up) by hash rank.
    """
    if not exact:
        return df.withColumn(out, salted_md5(seed, *key) < F.lit(hex_bound(test_share)))
    ranked = hash_rank(df.withColumn("_hash", salted_md5(seed, *key)), "_hash", out="_rank", size_out="_n")
    return ranked.withColumn(out, F.col("_rank") <= F.ceil(F.col("_n") * F.lit(test_share))).drop(
        "_hash", "_rank", "_n"
    )


def subsample_members(
    df: DataFrame,
    key: Sequence[str],
    n: int,
    fraction: float = 0.3,
    seed=0,
    out: str = "sample_id",
    exact: bool = False,
) -> DataFrame:
    """One row per (sample, member): ``n`` draws of ``fraction`` without replacement.

    Each draw is an affine function of one key hash, so the md5 is taken once
    per row and no shuffle is needed. ``exact`` draws ``floor(fraction*rows)``
    members per sample by hash rank instead.
    """
    if exact:
        spread = df.withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(n))))
        spread = spread.withColumn("_hash", salted_md5(seed, F.col(out), *[F.col(k) for k in key]))
        ranked = hash_rank(spread, "_hash", [out], "_rank", size_out="_n")
        return ranked.where(F.col("_rank") <= F.floor(F.col("_n") * F.lit(fraction))).drop(
            "_hash", "_rank", "_n"
        )
    draws = F.lit(np.array(draw_constants(seed, n), dtype="int64").ravel())
    member = F.filter(
        F.sequence(F.lit(1), F.lit(n)),
        lambda i: (
            F.col("_residue") * F.element_at(draws, i * 2 - 1) + F.element_at(draws, i * 2)
        ) % F.lit(PRIME) < F.lit(draw_limit(fraction)),
    )
    return (
        df.withColumn("_residue", residue(seed, *key))
        .withColumn(out, F.explode(member))
        .drop("_residue")
    )


def fold_rows(
    df: DataFrame,
    key: Sequence[str],
    folds: int = CV_FOLDS,
    seed=SPLIT_SEED,
    out: str = "fold",
    exact: bool = False,
) -> DataFrame:
    """Fold number ``0 .. folds-1`` of each row.

    Rows are taken in hash order, the order the split left them in; folds are
    consecutive stretches of it. By default the stretch is read from the hash
    itself (no shuffle); ``exact`` makes sizes differ by at most one, larger
    folds first.
    """
    h = salted_md5(seed, *key)
    if not exact:
        # hex text compares like the number: count the fold starts at or below it
        fold = F.lit(0)
        for k in range(1, folds):
            start = format(-(-k * 2**32 // folds), "08x")
            fold = fold + (F.col("_hash") >= F.lit(start)).cast("int")
        return df.withColumn("_hash", h).withColumn(out, fold).drop("_hash")
    ranked = hash_rank(df.withColumn("_hash", h), "_hash", out="_rank", size_out="_n")
    small = F.floor(F.col("_n") / folds)
    large_folds = F.col("_n") % folds
    edge = large_folds * (small + 1)
    position = F.col("_rank") - 1
    fold = F.when(position < edge, F.floor(position / (small + 1))).otherwise(
        large_folds + F.floor((position - edge) / small)
    )
    return ranked.withColumn(out, fold.cast("int")).drop("_hash", "_rank", "_n")


def child_seeds(df: DataFrame, counter: str, seed, out: str = "child_seed") -> DataFrame:
    """Independent child seed of each counter value: a hash of master seed and counter."""
    return df.withColumn(out, hex_int(salted_md5(seed, counter)))
