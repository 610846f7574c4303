"""Linear family: least squares, lasso, ridge, elastic net, partial least squares."""

from __future__ import annotations

import itertools
import json
import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import lin_space, log_space
from ..functions.special import t_quantile
from .moments import Moments, column_means, group_moments, subsample_moments, target_moments
from .sampling import CV_FOLDS, SPLIT_SEED, fold_rows

KINDS = ("ols", "lasso", "ridge", "enet", "pls")
MAX_SWEEPS = 10_000
# Sweeps between exact solutions of the active sets.
POLISH = 200
# Largest step of a sweep, relative to the label moments, at which descent stops.
TOLERANCE = 1e-10
# Up to this many p x p solves stay on the driver; more become Spark tasks.
LOCAL_SOLVES = 400


def default_grid(kind: str, n_features: int = 1) -> list[dict]:
    """Search grid of each model: 17 penalties, 41 mixing ratios, or 1..p components."""
    alphas = log_space(-8, 8, 17)
    if kind in ("lasso", "ridge"):
        return [{"alpha": a} for a in alphas]
    if kind == "enet":
        return [{"alpha": a, "l1_ratio": r} for r in lin_space(0, 1, 41) for a in alphas]
    if kind == "pls":
        return [{"n_components": k} for k in range(1, n_features + 1)]
    return [{}]


def solve(
    kind: str, m: Moments, params: Mapping | None = None, start: np.ndarray | None = None
) -> tuple[float, np.ndarray]:
    """Intercept and coefficients from moments.

    Penalties: ridge adds ``alpha * sum b^2`` to the sum of squares; lasso and
    elastic net add ``alpha * (l1 * sum|b| + (1 - l1)/2 * sum b^2)`` to half the
    mean square. ``start`` warm-starts the coordinate descent.
    """
    params = params or {}
    sxx, sxy, syy = m.centred()
    if kind == "ols":
        coef = np.linalg.pinv(sxx, rcond=1e-12, hermitian=True) @ sxy
    elif kind == "ridge":
        coef = np.linalg.solve(sxx + params["alpha"] * np.eye(len(sxy)), sxy)
    elif kind in ("lasso", "enet"):
        coef = _penalised(m, kind, [params], start)[0]
    elif kind == "pls":
        coef = _partial_least_squares(sxx, sxy, m.n, params["n_components"])
    else:
        raise ValueError(f"unknown model kind {kind}")
    return m.intercept(coef), coef


def _penalised(m: Moments, kind: str, points: Sequence[Mapping], start=None) -> np.ndarray:
    """Coefficients of several lasso or elastic-net points on the same moments."""
    sxx, sxy, _ = m.centred()
    alpha = np.array([p["alpha"] for p in points])
    l1 = np.array([1.0 if kind == "lasso" else p["l1_ratio"] for p in points])
    return _descend(sxx / m.n, sxy / m.n, alpha * l1, alpha * (1 - l1), start)


def _descend(c: np.ndarray, s: np.ndarray, l1: np.ndarray, l2: np.ndarray, start) -> np.ndarray:
    """Cyclic coordinate descent on the moment matrix, one row per penalty pair.

    Rows that have settled drop out of the sweeps. Collinear columns settle
    slowly, so every ``POLISH`` sweeps the equations of each row's active set are
    solved, and the solution is taken if it is optimal. Rows that do neither
    are reported by a warning.
    """
    b = np.zeros((len(l1), len(s))) if start is None else np.array(start, float).reshape(len(l1), -1)
    diag = np.diag(c)
    small = TOLERANCE * max(float(np.abs(s).max(initial=0.0)), 1e-300)
    live = np.arange(len(l1))
    for sweep in range(1, MAX_SWEEPS + 1):
        w, a1, a2 = b[live], l1[live], l2[live]
        slope = s - w @ c
        change = np.zeros(len(live))
        for j in range(len(s)):
            if diag[j] <= 0.0:
                continue
            rho = slope[:, j] + diag[j] * w[:, j]
            step = np.copysign(np.maximum(np.abs(rho) - a1, 0.0), rho) / (diag[j] + a2) - w[:, j]
            slope -= step[:, None] * c[j]
            w[:, j] += step
            change = np.maximum(change, np.abs(step) * diag[j])
        b[live] = w
        live = live[change > small]
        if sweep % POLISH == 0:
            exact = {i: _active_solution(c, s, l1[i], l2[i], b[i], 100 * small) for i in live}
            for i, solution in exact.items():
                if solution is not None:
                    b[i] = solution
            live = np.array([i for i in live if exact[i] is None], int)
        if not len(live):
            break
    else:
        warnings.warn(f"{len(live)} of {len(b)} penalty points did not settle in {MAX_SWEEPS} sweeps", stacklevel=2)
    return b


def _active_solution(c: np.ndarray, s: np.ndarray, l1: float, l2: float, b: np.ndarray, small: float):
    """The optimum with the signs of ``b``, if there is one: zero gradient where active, within the penalty elsewhere."""
    on = np.flatnonzero(b)
    sign = np.sign(b[on])
    found = np.zeros_like(b)
    found[on] = np.linalg.pinv(c[np.ix_(on, on)] + l2 * np.eye(len(on)), rcond=1e-12, hermitian=True) @ (s[on] - l1 * sign)
    slope = s - c @ found - l2 * found
    good = (
        (found[on] * sign >= 0).all() and (np.abs(slope[on] - l1 * sign) <= small).all() and (np.abs(slope) <= l1 + small).all()
    )
    return found if good else None


def _partial_least_squares(sxx: np.ndarray, sxy: np.ndarray, n: float, k: int) -> np.ndarray:
    """One-target PLS with scaled columns: least squares on a Krylov basis."""
    sd = np.sqrt(np.diag(sxx) / (n - 1))
    sd[sd == 0] = 1.0
    a = sxx / np.outer(sd, sd)
    v = sxy / sd
    basis: list[np.ndarray] = []
    w, size = v, np.linalg.norm(v)
    for _ in range(k):
        for q in basis + basis:  # twice, for orthogonality to working precision
            w = w - q * (q @ w)
        norm = np.linalg.norm(w)
        if norm <= 1e-10 * max(size, 1e-300):
            break
        basis.append(w / norm)
        w = a @ basis[-1]
        size = np.linalg.norm(w)
    if not basis:
        return np.zeros(len(sxy))
    q = np.column_stack(basis)
    return (q @ np.linalg.lstsq(q.T @ a @ q, q.T @ v, rcond=None)[0]) / sd


@dataclass
class LinearFit:
    """A fitted linear model; prediction is a plain column expression."""

    name: str
    kind: str
    features: list[str]
    intercept: float
    coef: list[float]
    params: dict = field(default_factory=dict)

    def column(self) -> Column:
        out = F.lit(float(self.intercept))
        for f, b in zip(self.features, self.coef):
            out = out + F.col(f) * F.lit(float(b))
        return out

    def predict_array(self, x: np.ndarray) -> np.ndarray:
        return x @ np.array(self.coef, float) + float(self.intercept)

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.column())

    def reset(self) -> "Untrained":
        return Untrained(self.name, self.kind, dict(self.params))


@dataclass
class Untrained:
    """A model without coefficients: kind and tuned parameters."""

    name: str
    kind: str
    params: dict = field(default_factory=dict)

    def fit(self, df: DataFrame, features: Sequence[str], label: str) -> LinearFit:
        return fit_linear(df, features, label, self.kind, self.params, self.name)


def fit_linear(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    kind: str = "ols",
    params: Mapping | None = None,
    name: str | None = None,
) -> LinearFit:
    """Fit one model: one scan for the moments and a p x p solve."""
    m = group_moments(df, features, label)[0]
    b0, coef = solve(kind, m, params)
    return LinearFit(name or kind, kind, list(features), b0, [float(c) for c in coef], dict(params or {}))


def fit_linear_targets(
    df: DataFrame,
    features: Sequence[str],
    labels: Sequence[str],
    kind: str = "ols",
    params: Mapping | None = None,
) -> dict[str, LinearFit]:
    """One model for each label, from one scan for all of them."""
    out = {}
    for label, moments in target_moments(df, features, labels).items():
        b0, coef = solve(kind, moments[0], params)
        out[label] = LinearFit(label, kind, list(features), b0, [float(c) for c in coef], dict(params or {}))
    return out


def search_linear_targets(
    df: DataFrame,
    features: Sequence[str],
    labels: Sequence[str],
    kind: str,
    grid: Sequence[Mapping] | None = None,
    key: Sequence[str] = (),
    folds: int = CV_FOLDS,
    seed=SPLIT_SEED,
) -> tuple[dict[str, LinearFit], DataFrame]:
    """Grid search and refit for each label; one scan gives the moments of all folds and labels."""
    grid = [dict(g) for g in (grid if grid is not None else default_grid(kind, len(features)))]
    data = fold_rows(df, key, folds, seed, "_fold")
    fits, tables = {}, None
    for label, by_fold in target_moments(data, features, labels, "_fold").items():
        fits[label], cv = _searched(df.sparkSession, kind, grid, by_fold, features, label)
        cv = cv.withColumnRenamed("model", "target_name")
        tables = cv if tables is None else tables.union(cv)
    return fits, tables


def _searched(
    spark: SparkSession, kind: str, grid: list[dict], by_fold: dict[int, Moments], features: Sequence[str], name: str
) -> tuple[LinearFit, DataFrame]:
    total = None
    for m in by_fold.values():
        total = m if total is None else total + m
    cv = _cv_scores(spark, kind, grid, by_fold, total, name)
    best = cv.orderBy(F.col("mean_test_score").desc(), "point").first()
    params = grid[best["point"]]
    b0, coef = solve(kind, total, params)
    return LinearFit(name, kind, list(features), b0, [float(c) for c in coef], params), cv


def search_linear(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    kind: str,
    grid: Sequence[Mapping] | None = None,
    key: Sequence[str] = (),
    folds: int = CV_FOLDS,
    seed=SPLIT_SEED,
    fold_column: str | None = None,
    name: str | None = None,
) -> tuple[LinearFit, DataFrame]:
    """Cross-validated grid search and refit on all rows.

    One scan gives the moments of every fold; training moments are total minus
    fold. The grid points are then solved from p x p numbers, one Spark task
    per fold (or on the driver for a small grid), warm-started from the
    strongest penalty down.
    """
    name = name or kind
    grid = [dict(g) for g in (grid if grid is not None else default_grid(kind, len(features)))]
    if fold_column is None:
        df, fold_column = fold_rows(df, key, folds, seed, "_fold"), "_fold"
    return _searched(df.sparkSession, kind, grid, group_moments(df, features, label, fold_column), features, name)


def _cv_scores(
    spark: SparkSession, kind: str, grid: list[dict], by_fold: dict[int, Moments], total: Moments, name: str
) -> DataFrame:
    # one task per fold; along it, equal penalties are solved together and the
    # next weaker penalty starts from their result
    ladder = [
        list(points)
        for _, points in itertools.groupby(
            sorted(range(len(grid)), key=lambda i: -grid[i].get("alpha", 0.0)),
            key=lambda i: grid[i].get("alpha", 0.0),
        )
    ]

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for fold in frame["fold"]:
                test = by_fold[int(fold)]
                train = total - test
                start = None
                for points in ladder:
                    if kind in ("lasso", "enet"):
                        if start is not None and len(start) != len(points):
                            start = None
                        start = _penalised(train, kind, [grid[p] for p in points], start)
                        solved = [(train.intercept(c), c) for c in start]
                    else:
                        solved = [solve(kind, train, grid[p]) for p in points]
                    for point, (b0, coef) in zip(points, solved):
                        rows.append((int(fold), point, test.r2(b0, coef), train.r2(b0, coef)))
            yield pd.DataFrame(rows, columns=["fold", "point", "test", "train"])

    folds = pd.DataFrame({"fold": [int(f) for f in by_fold]})
    if len(grid) * len(folds) <= LOCAL_SOLVES:
        solved = pd.concat(score(iter([folds])))
    else:
        tasks = spark.createDataFrame(folds, "fold long").repartition(len(folds), "fold")
        # one row per fold and grid point
        solved = tasks.mapInPandas(score, "fold long, point int, test double, train double").toPandas()
    scores = spark.createDataFrame(solved, "fold long, point int, test double, train double")
    table = scores.groupBy("point").agg(
        F.avg("test").alias("mean_test_score"),
        F.stddev_pop("test").alias("std_test_score"),
        F.avg("train").alias("mean_train_score"),
        F.stddev_pop("train").alias("std_train_score"),
    )
    names = sorted({k for g in grid for k in g})
    listed = spark.createDataFrame(
        [(i, json.dumps(g), *[float(g[k]) if k in g else None for k in names]) for i, g in enumerate(grid)],
        "point int, params string" + "".join(f", param_{k} double" for k in names),
    )
    # both sides have one row per grid point
    return table.join(listed, "point").withColumn("model", F.lit(name))


def ols_inference(
    df: DataFrame, features: Sequence[str], label: str, alpha: float = 0.05
) -> DataFrame:
    """Coefficients, standard errors and intervals; significant when both bounds share a sign."""
    m = group_moments(df, features, label)[0]
    b0, coef = solve("ols", m)
    sxx, _, syy = m.centred()
    p = len(features)
    dof = m.n - p - 1
    sigma2 = syy * (1 - m.r2(b0, coef)) / dof
    inverse = np.linalg.pinv(sxx, rcond=1e-12, hermitian=True)
    mean = m.gram[0, 1:-1] / m.n + m.shift[:-1]
    se = np.sqrt(sigma2 * np.concatenate([[1 / m.n + mean @ inverse @ mean], np.diag(inverse)]))
    q = t_quantile(1 - alpha / 2, dof)
    rows = [
        (f, float(b), float(s), float(b - q * s), float(b + q * s))
        for f, b, s in zip(["Intercept", *features], [b0, *coef], se)
    ]
    table = df.sparkSession.createDataFrame(
        rows, "feature string, coef double, std_error double, lower double, upper double"
    )
    return table.withColumn("signif", F.signum("lower") * F.signum("upper") > 0)


def coef_table(spark: SparkSession, models: Sequence[LinearFit]) -> DataFrame:
    """One row per model and feature."""
    rows = [(m.name, f, float(b)) for m in models for f, b in zip(m.features, m.coef)]
    return spark.createDataFrame(rows, "model string, feature string, coef double")


def coef_stability(
    df: DataFrame,
    models: Mapping[str, tuple[str, Mapping]],
    features: Sequence[str],
    label: str,
    key: Sequence[str],
    n_iters: int = 5,
    fraction: float = 0.3,
    seed=0,
    scale: bool = False,
) -> DataFrame:
    """Refit every model on ``n_iters`` subsamples: ``(model, iteration, feature, coef)``.

    The moments of all subsamples come from one scan; each refit is a solve on
    one row of moments. ``scale`` standardises the features first.
    """
    from .features import scale_numeric

    if scale:
        df = scale_numeric(df, list(features))
    columns = [*features, label]
    shift = column_means(df, columns)
    table = subsample_moments(df, columns, shift, key, n_iters, fraction, seed)
    names, models = list(features), {k: (v[0], dict(v[1])) for k, v in models.items()}

    def refit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for grp, gram in zip(frame["grp"], frame["gram"]):
                m = Moments.from_upper(gram, shift)
                for model, (kind, params) in models.items():
                    _, coef = solve(kind, m, params)
                    rows += [(model, int(grp), f, float(b)) for f, b in zip(names, coef)]
            yield pd.DataFrame(rows, columns=["model", "iteration", "feature", "coef"])

    return table.mapInPandas(refit, "model string, iteration int, feature string, coef double")


def predict_all(df: DataFrame, models: Sequence, truth: str, keep: Sequence[str] = ()) -> DataFrame:
    """One prediction column per model, truth last."""
    out = df
    for m in models:
        out = m.predict(out, m.name)
    return out.select(*keep, *[f"`{m.name}`" for m in models], F.col(truth).alias("Truths"))


def long_predictions(wide: DataFrame, models: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(model, truth, prediction)`` from the side-by-side table."""
    cells = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"`{m}`").alias("prediction")) for m in models]
    )
    return wide.select(*keep, F.col("Truths").alias("truth"), F.inline(cells))
