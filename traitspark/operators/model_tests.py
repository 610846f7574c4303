"""Shuffled-column and shuffled-label scores, importance and controls of any fitted model.

A model is anything with ``features`` and ``predict_array``; one may be given for each
sample. A batch carries, besides the rows, the donor column of one feature at a time:
it is put in place of the feature's own, predicted and scored, so rows are not copied
for features. A group of at most ``block_rows`` rows is scored where it is permuted, a
block of repeats per task; a larger one is dealt into ranges of places (with many groups
ranked across tasks and joined by place), only shuffled columns are repeated, and only
sums of each (group, repeat, feature) leave a batch. All pair the same rows.

A sample for which a model cannot be fitted or applied becomes rows with its reason and
a missing score; lost executors, full disks and errors of the code still fail the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.hashing import normal, place_order, salted_md5
from ..session import materialise
from . import permutation as P
from .forest import Binned, ForestFit, Own, grow
from .perceptron import Network, _fitted, lay_rows, train
from .ranking import null_safe_join
from .sampling import subsample_members

#: What a sample's data, not the code or the cluster, can cause.
DATA_ERRORS = (ArithmeticError, np.linalg.LinAlgError, ValueError)


class Metric:
    """A score from sums that add up over batches; ``finish`` works on numbers and on columns."""

    def __init__(self, name: str, terms: Callable[[np.ndarray, np.ndarray], list], finish: Callable, greater: bool):
        self.name, self.terms, self.finish, self.greater = name, terms, finish, greater
        self.size = len(terms(np.zeros(1), np.zeros(1)))

    def score(self, y: np.ndarray, p: np.ndarray) -> float:
        with np.errstate(divide="ignore", invalid="ignore"):
            value = float(self.finish(*(np.float64(x) for x in self.terms(y, p))))
        return round(value, P.SCORE_DIGITS) if np.isfinite(value) else np.nan


def _sums(y, p):
    e = y - p
    return [float(len(y)), e.sum(), e @ e, y.sum(), y @ y]


METRICS = {
    m.name: m
    for m in (
        Metric("r2", _sums, lambda n, e, ee, y, yy: 1 - ee / (yy - y * y / n), True),
        Metric("explained_variance", _sums, lambda n, e, ee, y, yy: 1 - (ee - e * e / n) / (yy - y * y / n), True),
        Metric("mse", _sums, lambda n, e, ee, y, yy: ee / n, False),
        Metric("rmse", _sums, lambda n, e, ee, y, yy: (ee / n) ** 0.5, False),
        Metric("mae", lambda y, p: [float(len(y)), np.abs(y - p).sum()], lambda n, a: a / n, False),
    )
}


def _model_of(models, row: Sequence) -> object:
    """The model of a group; a mapping goes by the group's first value."""
    if not isinstance(models, Mapping):
        return models
    model = models.get(row[0])
    if model is None:
        raise ValueError("no model for the sample")
    if isinstance(model, str):
        raise ValueError(model)
    return model


def _schema(df: DataFrame, group: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in group) + "feature string, repeat int, baseline double, score double, reason string"


def shuffled_scores(
    df: DataFrame,
    models,
    truth: str,
    key: Sequence[str],
    group: Sequence[str] = ("sample_id",),
    features: Sequence[str] | None = None,
    shuffled: Sequence[str] | None = None,
    n_repeats: int = 5,
    seed=0,
    metric: str = "r2",
    block_rows: int = P.BLOCK_ROWS,
) -> DataFrame:
    """``group, feature, repeat, baseline, score, reason``: scores with one column shuffled inside its group.

    ``shuffled`` names the columns to shuffle (default: all features); the name of
    ``truth`` among them shuffles the labels.
    """
    group = list(group)
    features = list(features or (models.features if not isinstance(models, Mapping) else next(iter(models.values())).features))
    shuffled = list(shuffled or features)
    measure = METRICS[metric]
    columns = [*features, truth]
    base = P._with_hashes(df, group, key, seed, [F.col(c).cast("double").alias(c) for c in columns])
    largest, groups = P._largest_group(base, group)
    schema = _schema(df, group)
    where = [columns.index(c) for c in shuffled]

    def scores(x: np.ndarray, donors: np.ndarray, model, still: np.ndarray) -> Iterator[tuple[str, list]]:
        """Truth and prediction with each column shuffled; ``still`` are the predictions of ``x``."""
        y = x[:, -1]
        for k, (name, j) in enumerate(zip(shuffled, where)):
            if j == len(columns) - 1:
                yield name, (donors[:, k], still)
                continue
            own = x[:, j].copy()
            x[:, j] = donors[:, k]
            yield name, (y, model.predict_array(x[:, :-1]))
            x[:, j] = own

    if largest <= block_rows:
        tasks = base.sparkSession.sparkContext.defaultParallelism * 2
        blocks = max(1, min(n_repeats, -(-tasks // max(groups, 1))))
        repeats = list(range(1, n_repeats + 1))

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            at = [frame[c].iloc[0] for c in group]
            rows: list[list] = []
            try:
                model = _model_of(models, at)
                h, t, g = (frame[c].to_numpy("int64") for c in ("_h", "_t", "_g"))
                raw = frame[columns].to_numpy(float)
                x = raw[np.argsort(place_order(h, t, g, 0))]
                still = model.predict_array(x[:, :-1])
                baseline = measure.score(x[:, -1], still)
                for repeat in repeats[int(frame["_block"].iloc[0]) :: blocks]:
                    donors = raw[np.argsort(place_order(h, t, g, repeat + 1))][:, where]
                    rows += [[*at, f, repeat, baseline, measure.score(*found), None] for f, found in scores(x, donors, model, still)]
            except DATA_ERRORS as error:
                rows = [[*at, f, None, None, None, f"{type(error).__name__}: {error}"] for f in shuffled]
            out = pd.DataFrame(rows, columns=[*group, "feature", "repeat", "baseline", "score", "reason"])
            out["repeat"] = out["repeat"].astype("Int32")
            return out

        spread = base.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return spread.groupBy(*group, "_block").applyInPandas(run, schema)

    names = [f"_s{k}" for k in range(measure.size)]
    both = [*names, *[f"{n}_" for n in names]]

    def summed(at: Sequence, x: np.ndarray, turned) -> Iterator[list]:
        """Sums of each repeat and feature; ``turned`` has the shuffled columns of each repeat."""
        try:
            model = _model_of(models, at)
            still = model.predict_array(x[:, :-1])
            own = measure.terms(x[:, -1], still)
        except DATA_ERRORS as error:
            for repeat, _ in turned:
                yield from ([repeat, f, *[None] * len(both), f"{type(error).__name__}: {error}"] for f in shuffled)
            return
        for repeat, donors in turned:
            try:
                rows = [[repeat, f, *map(float, own), *map(float, measure.terms(*found)), None] for f, found in scores(x, donors, model, still)]
            except DATA_ERRORS as error:
                rows = [[repeat, f, *[None] * len(both), f"{type(error).__name__}: {error}"] for f in shuffled]
            yield from rows

    ddl = "repeat int, feature string, " + ", ".join(f"{n} double" for n in both) + ", reason string"
    parts = P.range_rows(base, group, columns, shuffled, 1, n_repeats, summed, ddl)
    if parts is None:
        parts = _joined_sums(base, group, columns, shuffled, n_repeats, largest, summed, ddl)
    total = parts.groupBy(*group, "repeat", "feature")
    total = total.agg(*[F.sum(n).alias(n) for n in both], F.max("reason").alias("reason"))

    def finished(columns_: Sequence[str]) -> Column:
        value = measure.finish(*[F.col(c) for c in columns_])
        ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & F.col("reason").isNull()
        return F.when(ok, F.round(value, P.SCORE_DIGITS))

    return total.select(
        *group, "feature", F.col("repeat").cast("int").alias("repeat"),
        finished(names).alias("baseline"), finished([f"{n}_" for n in names]).alias("score"), "reason",
    )


def _joined_sums(
    base: DataFrame, group: list[str], columns: list[str], shuffled: list[str], n_repeats: int, largest: int, summed: Callable, ddl: str
) -> DataFrame:
    """Sums of batches whose rows are paired by a join of their places."""
    fixed = P._placed(base, group, F.lit(0), largest)
    donor = [f"_d_{c}" for c in shuffled]
    turned = P._turned(base.select(*group, "_h", "_t", "_g", *shuffled), group, 1, n_repeats, largest)
    turned = turned.select(*group, "repeat", "_place", *[F.col(c).alias(d) for c, d in zip(shuffled, donor)])
    mixed = null_safe_join(turned, fixed, [*group, "_place"]).select(*group, "repeat", *columns, *donor)
    schema = StructType([*mixed.select(*group).schema, *_parse(base, ddl)])
    arrow = to_arrow_schema(schema)

    def sums(batches):
        for batch in batches:
            frame = batch.to_pandas()
            rows = []
            for at, part in frame.groupby([*group, "repeat"], dropna=False, sort=False):
                turn = [(int(at[-1]), part[donor].to_numpy(float))]
                rows += [[*at[:-1], *row] for row in summed(at[:-1], part[columns].to_numpy(float), turn)]
            out = pd.DataFrame(rows, columns=schema.names)
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return mixed.mapInArrow(sums, schema)


def _parse(df: DataFrame, ddl: str) -> StructType:
    return df.sparkSession.createDataFrame([], ddl).schema


def tests_of(scores: DataFrame, group: Sequence[str], metric: str = "r2") -> DataFrame:
    """Rank p-values with the ``reason`` of groups that failed; an error has the lower tail for its own."""
    signed = F.lit(1.0 if METRICS[metric].greater else -1.0)
    scores = scores.withColumns({"_b": F.col("baseline") * signed, "_s": F.col("score") * signed})
    out = scores.groupBy(*group).agg(
        F.count("score").alias("n_repeats"),
        F.max("baseline").alias("baseline"),
        F.sum((F.col("_s") >= F.col("_b")).cast("long")).alias("_at_least"),
        F.max("reason").alias("reason"),
    )
    p = (F.col("_at_least") + 1) / (F.col("n_repeats") + 1)
    usable = (F.col("n_repeats") > 0) & F.col("baseline").isNotNull() & ~F.isnan("baseline") & F.col("reason").isNull()
    return out.select(*group, "n_repeats", "baseline", F.when(usable, p).alias("p_value"), "reason")


def importance_tests(
    df: DataFrame,
    model,
    truth: str,
    key: Sequence[str],
    n_samples: int = 3,
    n_repeats: int = 5,
    sample_size: float = 0.3,
    seed=0,
    sample_ids: Sequence[int] | None = None,
    metric: str = "r2",
) -> DataFrame:
    """``model, sample_id, feature, n_repeats, baseline, p_value, reason`` of any model; some samples on demand."""
    members = subsample_members(df, key, n_samples, sample_size, seed)
    if sample_ids is not None:
        members = members.where(F.col("sample_id").isin([int(i) for i in sample_ids]))
    scores = shuffled_scores(members, model, truth, key, ["sample_id"], n_repeats=n_repeats, seed=seed, metric=metric)
    return tests_of(scores, ["sample_id", "feature"], metric).withColumn("model", F.lit(model.name))


def negative_control(
    df: DataFrame, model, truth: str, key: Sequence[str], n_samples: int = 3, n_repeats: int = 5,
    sample_size: float = 0.3, seed=0, metric: str = "r2",
) -> DataFrame:
    """Label-permutation tests of any model and metric, a row per sample."""
    members = subsample_members(df, key, n_samples, sample_size, seed)
    scores = shuffled_scores(
        members, model, truth, key, ["sample_id"], shuffled=[truth], n_repeats=n_repeats, seed=seed, metric=metric
    )
    return tests_of(scores, ["sample_id"], metric).withColumn("model", F.lit(model.name))


def _refit_forests(members: DataFrame, features, truth, key, n_samples: int, params, seed) -> dict:
    data = Binned(members, features, truth, Own(n_samples + 1), F.col("sample_id"), key)
    found = grow(data, [(params, k) for k in range(1, n_samples + 1)], seed)
    return {
        k: ForestFit.of("Random Forest", data, trees, params) if data.counts[k] else "ValueError: empty sample"
        for k, trees in enumerate(found, 1)
    }


def _refit_networks(members: DataFrame, features, truth, key, n_samples: int, params, seed) -> dict:
    nets = [Network.of(params, -2, len(features), seed, own=k) for k in range(1, n_samples + 1)]
    train(lay_rows(members, features, truth, key, "sample_id", seed), nets)
    return {k: _fitted("MLP", features, net) for k, net in enumerate(nets, 1)}


#: How each kind of model is fitted to all samples at once.
REFITS = {"forest": _refit_forests, "perceptron": _refit_networks}


def positive_control(
    df: DataFrame,
    kind: str,
    params: Mapping,
    features: Sequence[str],
    truth: str,
    key: Sequence[str],
    sigmas: Sequence[float] = (0.0,),
    n_samples: int = 3,
    n_repeats: int = 5,
    sample_size: float = 0.3,
    seed=0,
    metric: str = "r2",
) -> DataFrame:
    """``model, sigma, sample_id, n_repeats, baseline, p_value, reason``: control-feature tests of a forest or network.

    Each sample gets a feature ``truth + sigma * noise``, the model is fitted to
    the sample with it, and the control is shuffled. All samples of a noise level
    are one training, in shared scans of the samples' rows.
    """
    members = subsample_members(df, key, n_samples, sample_size, seed)
    noise = normal(salted_md5(f"{seed}:noise", "sample_id", *key))
    members = materialise(members.select("sample_id", *key, *features, truth, noise.alias("_noise")), "members")
    out = None
    for sigma in sigmas:
        rows = members.withColumn("control", F.col(truth) + F.lit(float(sigma)) * F.col("_noise"))
        columns = [*features, "control"]
        models = REFITS[kind](rows, columns, truth, key, n_samples, params, seed)
        scores = shuffled_scores(
            rows, models, truth, key, ["sample_id"], columns, ["control"], n_repeats, seed, metric
        )
        tests = tests_of(scores, ["sample_id"], metric).withColumns({"model": F.lit(kind), "sigma": F.lit(float(sigma))})
        out = tests if out is None else out.union(tests)
    return out
