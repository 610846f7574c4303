"""Joins that stay balanced when a few keys hold most rows, and broadcasts behind a row count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def hot_keys(df: DataFrame, on: Sequence[str], share: float = 0.02) -> DataFrame:
    """Keys that hold at least ``share`` of all rows: never more than ``1/share`` of them.

    Reads the key columns only and combines before the shuffle.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("_total"))
    return (
        counts.crossJoin(F.broadcast(total))  # one row
        .where(F.col("_rows") >= F.col("_total") * F.lit(float(share)))
        .select(*on)
    )


def spread_hot(
    big: DataFrame, on: Sequence[str], hot: DataFrame, salts: int, salt_by: Sequence[str] | None
) -> DataFrame:
    """Add ``_salt``: a row hash for hot keys and for missing keys, else zero."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in salt_by or big.columns]), F.lit(salts)).cast("int")
    missing = F.lit(False)
    for key in on:
        missing = missing | F.col(key).isNull()
    return (
        big.join(hot, list(on), "left")
        .withColumn("_salt", F.when(F.col("_hot") | missing, salt).otherwise(F.lit(0)))
        .drop("_hot")
    )


def repeat_hot(small: DataFrame, on: Sequence[str], hot: DataFrame, salts: int) -> DataFrame:
    """Repeat the rows of hot keys once per salt."""
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return (
        small.join(hot, list(on), "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )


def marked_hot(big: DataFrame, on: Sequence[str], share: float) -> DataFrame:
    """Broadcast table of the hot keys of ``big``: at most ``1/share`` rows."""
    keys = hot_keys(big.select(*on).dropna(), on, share)
    return F.broadcast(keys.withColumn("_hot", F.lit(True)))


def skew_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    share: float | None = None,
    salts: int = 32,
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Equi-join whose hot keys do not end in one task.

    By default a plain join, whose large partitions adaptive execution splits at
    run time without a scan before it. With ``share``, keys of ``big`` with at least
    this share of the rows are counted first and spread over ``salts`` partitions.
    Only hot keys are salted; their few rows in ``small`` are repeated once per
    salt, all other rows of ``small`` are shuffled once. ``salt_by`` names
    columns of ``big`` that differ between rows of one key (default: all).
    Rows of ``big`` with a missing key cannot match and are spread as well.
    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    """
    return skew_join_all(big, [small], on, how, share, salts, salt_by)


def skew_join_all(
    big: DataFrame,
    smalls: Sequence[DataFrame],
    on: Sequence[str],
    how: str = "left",
    share: float | None = None,
    salts: int = 32,
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join several tables on the same key; ``big`` is shuffled once for all."""
    on = list(on)
    if share is None:
        out = big
        for small in smalls:
            out = out.join(small, on, how)
        return out
    hot = marked_hot(big, on, share)
    out = spread_hot(big, on, hot, salts, salt_by)
    for small in smalls:
        out = out.join(repeat_hot(small, on, hot, salts), on + ["_salt"], how)
    return out.drop("_salt")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    max_rows: int = 20_000,
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join with a table that is expected to be short.

    Its rows are counted first: up to ``max_rows`` it is broadcast, so the few
    keys of ``big`` are never gathered; beyond that hot keys are salted.
    """
    rows = small.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        local = small.sparkSession.createDataFrame(rows, small.schema)
        return big.join(F.broadcast(local), list(on), how)
    return skew_join(big, materialise(small), on, how, 0.02, salt_by=salt_by)
