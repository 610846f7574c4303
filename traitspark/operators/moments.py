"""Second moments of feature tables: the sufficient statistics of the linear family.

For rows ``z = [1, x - shift, y - shift]`` the sum of ``z z'`` per group is all
that least squares, penalised and partial-least-squares fits, their
cross-validation and their R2 need. Rows are read once per table; only p x p
numbers per group leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import PRIME, draw_constants, draw_limit, residue

# Up to this many columns the sums are built-in aggregates; beyond it they
# are matrix products over Arrow batches.
SQL_COLUMNS = 14


@dataclass
class Moments:
    """Sums of products for one group, around a common shift."""

    gram: np.ndarray  # (p + 2) x (p + 2), order: 1, features, label
    shift: np.ndarray  # p + 1 numbers, order: features, label

    @classmethod
    def from_upper(cls, upper: Sequence[float], shift: Sequence[float]) -> "Moments":
        m = len(shift) + 1
        gram = np.zeros((m, m))
        gram[np.triu_indices(m)] = upper
        return cls(gram + np.triu(gram, 1).T, np.asarray(shift, float))

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.gram + other.gram, self.shift)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.gram - other.gram, self.shift)

    def keep(self, columns: Sequence[int]) -> "Moments":
        """Moments of some features (by index) and the label."""
        idx = [0, *[c + 1 for c in columns], len(self.shift)]
        return Moments(self.gram[np.ix_(idx, idx)], self.shift[[i - 1 for i in idx[1:]]])

    @property
    def n(self) -> float:
        return self.gram[0, 0]

    def centred(self) -> tuple[np.ndarray, np.ndarray, float]:
        """``Sxx, Sxy, Syy`` around the group's own means."""
        s = self.gram[0, 1:]
        c = self.gram[1:, 1:] - np.outer(s, s) / self.n
        return c[:-1, :-1], c[:-1, -1], c[-1, -1]

    def intercept(self, coef: np.ndarray) -> float:
        """Intercept in original units for the given coefficients."""
        mean = self.gram[0, 1:] / self.n + self.shift
        return float(mean[-1] - mean[:-1] @ coef)

    def r2(self, intercept: float, coef: np.ndarray) -> float:
        """R2 on this group's rows of a model given in original units."""
        b0 = intercept - self.shift[-1] + self.shift[:-1] @ coef
        v = np.concatenate([[-b0], -np.asarray(coef, float), [1.0]])
        return float(1.0 - (v @ self.gram @ v) / self.centred()[2])


def column_means(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """Overall means, used as the shift that limits cancellation."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [float(v) if v is not None else 0.0 for v in row]


#: Rows that tell where a column lies.
SHIFT_ROWS = 1000


def column_shift(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """Means of some rows: any offset inside the data limits cancellation, and this one needs no scan."""
    return column_means(df.select(*columns).dropna().limit(SHIFT_ROWS), columns)


def _upper(m: int):
    return np.triu_indices(m)


def _shifted(df: DataFrame, columns: Sequence[str], shift: Sequence[float], extra) -> DataFrame:
    return df.select(
        *extra,
        *[(F.col(c).cast("double") - F.lit(float(s))).alias(f"_z{i}") for i, (c, s) in enumerate(zip(columns, shift))],
    ).dropna()


def _design(batch: pa.RecordBatch, first: int) -> np.ndarray:
    cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, batch.num_columns)]
    return np.column_stack([np.ones(batch.num_rows), *cols])


def _emit(keys: list[int], uppers: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "grp": pa.array(keys, pa.int64()),
            "gram": pa.array([u.tolist() for u in uppers], pa.list_(pa.float64())),
        }
    )


def _sum_arrays(parts: DataFrame, width: int) -> DataFrame:
    """Element-wise sum of the ``gram`` arrays per group, combined before the shuffle."""
    if width <= 300:
        return parts.groupBy("grp").agg(
            F.array(*[F.sum(F.col("gram")[i]) for i in range(width)]).alias("gram")
        )
    cells = parts.select("grp", F.posexplode("gram").alias("pos", "v")).groupBy("grp", "pos").agg(
        F.sum("v").alias("v")
    )
    # a group is one p x p array
    return cells.groupBy("grp").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("gram")
    )


def moment_table(
    df: DataFrame, columns: Sequence[str], shift: Sequence[float], group: str | None = None
) -> DataFrame:
    """``(grp, gram)``: upper triangle of the moments per integer group.

    ``columns`` ends with the label. Rows with a missing value are left out.
    """
    grp = (F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("grp")
    data = _shifted(df, columns, shift, [grp])
    m = len(columns) + 1
    iu, ju = _upper(m)
    if len(columns) <= SQL_COLUMNS:
        z = [F.lit(1.0), *[F.col(f"_z{i}") for i in range(len(columns))]]
        return data.groupBy("grp").agg(F.array(*[F.sum(z[i] * z[j]) for i, j in zip(iu, ju)]).alias("gram"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            z = _design(batch, 1)
            for k in np.unique(keys):
                part = z[keys == k]
                sums[int(k)] = sums.get(int(k), 0.0) + part.T @ part
        if sums:
            yield _emit(list(sums), [g[iu, ju] for g in sums.values()])

    parts = data.mapInArrow(partial, "grp long, gram array<double>")
    return _sum_arrays(parts, len(iu))


def group_moments(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    group: str | None = None,
    shift: Sequence[float] | None = None,
) -> dict[int, Moments]:
    """Moments per group on the driver: ``groups * p * p`` numbers."""
    columns = [*features, label]
    shift = list(shift) if shift is not None else column_shift(df, columns)
    rows = moment_table(df, columns, shift, group).collect()
    return {r["grp"]: Moments.from_upper(r["gram"], shift) for r in rows}


def target_moments(
    df: DataFrame, features: Sequence[str], labels: Sequence[str], group: str | None = None
) -> dict[str, dict[int, Moments]]:
    """Moments of every label and group from one scan; rows with a missing value in any column are left out."""
    columns = [*features, *labels]
    shift = column_shift(df, columns)
    rows = moment_table(df, columns, shift, group).collect()
    p = len(features)
    whole = {r["grp"]: Moments.from_upper(r["gram"], shift) for r in rows}
    # a label's moments are those of the features and of its own place
    return {label: {g: _with_label(m, p, p + k) for g, m in whole.items()} for k, label in enumerate(labels)}


def _with_label(m: Moments, p: int, at: int) -> Moments:
    places = [0, *range(1, p + 1), at + 1]
    return Moments(m.gram[np.ix_(places, places)], np.array([*m.shift[:p], m.shift[at]]))


def subsample_moments(
    df: DataFrame,
    columns: Sequence[str],
    shift: Sequence[float],
    key: Sequence[str],
    n: int,
    fraction: float,
    seed=0,
) -> DataFrame:
    """Moments of ``n`` hash-drawn subsamples in one pass over the rows.

    A row belongs to about ``fraction * n`` subsamples. Instead of repeating
    it that often, each batch builds the row-by-subsample membership matrix
    and multiplies it with the row products. Members are the same rows as in
    :func:`~traitspark.operators.sampling.subsample_members`.
    """
    data = _shifted(df, columns, shift, [residue(seed, *key).alias("_residue")])
    draws = np.array(draw_constants(seed, n), dtype=np.int64)
    limit = draw_limit(fraction)
    iu, ju = _upper(len(columns) + 1)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, len(iu)))
        seen = False
        for batch in batches:
            r = batch.column(0).to_numpy(zero_copy_only=False)
            z = _design(batch, 1)
            member = (r[:, None] * draws[:, 0] + draws[:, 1]) % PRIME < limit
            total += member.T.astype(float) @ (z[:, iu] * z[:, ju])
            seen = True
        if seen:
            yield _emit(list(range(1, n + 1)), list(total))

    # few, larger partitions bound the number of partial results
    wide = data.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism * 4))
    return _sum_arrays(wide.mapInArrow(partial, "grp long, gram array<double>"), len(iu))
