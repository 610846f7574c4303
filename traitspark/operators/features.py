"""Scaling, indicator columns and the control feature."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import normal, salted_md5
from ..functions.scalars import indicator_label
from .clean import order_columns, typed_columns


def scale_numeric(
    df: DataFrame,
    columns: Sequence[str],
    fit_on: DataFrame | None = None,
    suffix: str = "",
) -> DataFrame:
    """Mean 0 and population standard deviation 1; a constant column is only centred.

    Statistics come from ``fit_on`` (default: all rows of ``df``) in one pass.
    """
    stats = (fit_on if fit_on is not None else df).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns],
    )
    scaled = {
        c + suffix: (F.col(c) - F.col(f"_m_{c}"))
        / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        for c in columns
    }
    return (
        df.crossJoin(F.broadcast(stats))  # one row
        .withColumns(scaled)
        .drop(*stats.columns)
    )


def category_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list]:
    """Sorted levels of each column, from one pass.

    Each level becomes a column, so the list is as long as the table is wide;
    :func:`one_hot_vector` keeps a column of very many levels as one vector.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"))
            for c in columns
        ]
    )
    rows = df.select(F.inline(pairs)).dropna().distinct().collect()
    return {c: sorted(r["level"] for r in rows if r["column"] == c) for c in columns}


def one_hot(
    df: DataFrame,
    columns: Sequence[str],
    levels: dict[str, list] | None = None,
    label: str | None = None,
    chromosome_column: str = "Chromosome",
) -> DataFrame:
    """A 0/1 column per level, all levels kept; a missing value is all zeros."""
    levels = levels or category_levels(df, columns)
    rest = [c for c in df.columns if c not in columns and c != label]
    flags = [
        F.coalesce((F.col(c).cast("string") == F.lit(v)).cast("int"), F.lit(0)).alias(
            indicator_label(c, v, chromosome_column)
        )
        for c in columns
        for v in levels[c]
    ]
    return df.select(*rest, *flags, *([label] if label else []))


def one_hot_vector(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Sparse indicator vector for columns with many levels."""
    indexed = [f"{c}_index" for c in columns]
    encoded = [f"{c}_flags" for c in columns]
    stages = [
        StringIndexer(inputCols=list(columns), outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        VectorAssembler(inputCols=encoded, outputCol=out),
    ]
    return Pipeline(stages=stages).fit(df).transform(df).drop(*indexed, *encoded)


def chromosome_order(columns: Sequence[str], prefix: str = "Chr") -> list[str]:
    """Column names with chromosome indicators last, in numeric order."""
    numbered = [(int(m.group(1)), c) for c in columns if (m := re.fullmatch(prefix + r"(\d+)", c))]
    names = [c for _, c in sorted(numbered)]
    return [c for c in columns if c not in names] + names


def order_chromosomes(df: DataFrame, label: str = "p_value") -> DataFrame:
    """Chromosome indicators in numeric order before the label."""
    names = chromosome_order([c for c in df.columns if c != label])
    return order_columns(df, names, [label])


def prepare_features(
    df: DataFrame, label: str = "p_value", key: Sequence[str] = (), fit_on: DataFrame | None = None
) -> DataFrame:
    """Scale numeric columns, expand nominal ones, order chromosomes, label last."""
    numeric, nominal = typed_columns(df, [label, *key])
    scaled = scale_numeric(df, numeric, fit_on)
    return order_chromosomes(one_hot(scaled, nominal, label=label), label)


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector for the tree and network estimators."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="skip").transform(df)


def control_feature(
    df: DataFrame,
    y: str,
    sigma: float | str,
    key: Sequence[str],
    seed=0,
    name: str = "control_variable",
) -> DataFrame:
    """Append ``y`` plus normal noise of standard deviation ``sigma`` (number or column)."""
    scale = F.col(sigma) if isinstance(sigma, str) else F.lit(float(sigma))
    return df.withColumn(name, F.col(y) + scale * normal(salted_md5(seed, *key)))
