"""Model metrics and the tables behind the report figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from .ranking import exact_quantiles


def regression_metrics(
    df: DataFrame,
    truth: str = "truth",
    pred: str = "prediction",
    group: Sequence[str] = ("model",),
    dp: int = 4,
) -> DataFrame:
    """MSE, MAE, explained variance, median absolute error and R2 per group.

    All but the median are one aggregate; the median is an exact distributed
    rank, because the errors of one model may be the whole table.
    """
    group = list(group)
    errors = df.select(
        *group,
        F.col(truth).cast("double").alias("_y"),
        (F.col(truth) - F.col(pred)).cast("double").alias("_e"),
    ).withColumn("_abs", F.abs("_e"))
    sums = errors.groupBy(*group).agg(
        F.avg(F.col("_e") * F.col("_e")).alias("mse"),
        F.avg("_abs").alias("mae"),
        (1 - ratio(F.var_pop("_e"), F.var_pop("_y"))).alias("explained_variance"),
        (1 - ratio(F.avg(F.col("_e") * F.col("_e")), F.var_pop("_y"))).alias("r2"),
    )
    middle = exact_quantiles(errors, "_abs", {"median_absolute_error": 0.5}, group)
    joined = sums.join(middle, group) if group else sums.crossJoin(F.broadcast(middle))  # one row
    names = ["mse", "mae", "explained_variance", "median_absolute_error", "r2"]
    return joined.select(*group, *[F.round(n, dp).alias(n) for n in names])


def r2_score(
    df: DataFrame, truth: str = "truth", pred: str = "prediction", group: Sequence[str] = ("model",)
) -> DataFrame:
    """R2 per group in one aggregate; missing where the truth is constant."""
    e = F.col(truth) - F.col(pred)
    return df.groupBy(*group).agg(
        (1 - ratio(F.avg(e * e), F.var_pop(truth))).alias("r2"), F.count(F.lit(1)).alias("n_rows")
    )


def coef_mean_sd(coefs: DataFrame) -> DataFrame:
    """Mean and sample deviation of each coefficient over the iterations."""
    return coefs.groupBy("model", "feature").agg(
        F.avg("coef").alias("mean_coef"), F.stddev_samp("coef").alias("sd_coef")
    )


def coef_intervals(coefs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mean, sd, median and the central ``1 - alpha`` interval per coefficient.

    ``p0_5`` is the 0.5th percentile. A group is one coefficient over the
    iterations, whose number is an argument of the run.
    """
    q = F.percentile("coef", F.array(*[F.lit(p) for p in (0.5, alpha / 2, 1 - alpha / 2, 0.005)]))
    return (
        coefs.groupBy("model", "feature")
        .agg(F.avg("coef").alias("mean_coef"), F.stddev_samp("coef").alias("sd_coef"), q.alias("_q"))
        .select(
            "model", "feature", "mean_coef", "sd_coef",
            *[F.col("_q")[i].alias(n) for i, n in enumerate(("median", "lower", "upper", "p0_5"))],
        )
    )


def coef_limits(coefs: DataFrame, wide_spread: float = 20.0) -> DataFrame:
    """Largest upper quartile, smallest lower quartile and the colour limit per model."""
    per_feature = coefs.groupBy("model", "feature").agg(
        F.percentile("coef", F.lit(0.75)).alias("q3"),
        F.percentile("coef", F.lit(0.25)).alias("q1"),
        F.max(F.abs("coef")).alias("top"),
    )
    limits = per_feature.groupBy("model").agg(
        F.max("q3").alias("uq"), F.min("q1").alias("lq"), F.max("top").alias("_top")
    )
    limit = F.when(
        F.col("uq") - F.col("lq") > wide_spread, F.greatest(F.abs("uq"), F.abs("lq"))
    ).otherwise(F.col("_top") * 1.05)
    return limits.select("model", "uq", "lq", limit.alias("color_limit"))


def mean_coef_matrix(coefs: DataFrame, models: Sequence[str], clip: float = 1.3) -> DataFrame:
    """Features by models matrix of mean coefficients with the common colour limit."""
    means = coef_mean_sd(coefs)
    limit = means.agg((F.least(F.max(F.abs("mean_coef")), F.lit(clip)) * 1.05).alias("color_limit"))
    wide = means.groupBy("feature").pivot("model", list(models)).agg(F.first("mean_coef"))
    return wide.crossJoin(F.broadcast(limit))  # one row


def box_summary(coefs: DataFrame) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and the number of outliers per coefficient."""
    key = ["model", "feature"]
    quart = coefs.groupBy(*key).agg(
        F.percentile("coef", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q")
    ).select(
        *key, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3")
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("coef").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        coefs.join(quart, key)
        .groupBy(*key, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("coef"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("coef"))).alias("whisker_high"),
            F.sum((~inside).cast("long")).alias("n_outliers"),
        )
    )


def box_outliers(coefs: DataFrame) -> DataFrame:
    """The coefficients outside the whiskers."""
    box = box_summary(coefs).select("model", "feature", "whisker_low", "whisker_high")
    return coefs.join(box, ["model", "feature"]).where(
        (F.col("coef") < F.col("whisker_low")) | (F.col("coef") > F.col("whisker_high"))
    ).drop("whisker_low", "whisker_high")


def calibration_line(
    df: DataFrame, truth: str = "truth", pred: str = "prediction", group: Sequence[str] = ("model",)
) -> DataFrame:
    """Line of prediction on truth per model; axis limits over all models."""
    group = list(group)
    lines = df.groupBy(*group).agg(
        F.regr_slope(pred, truth).alias("slope"),
        F.regr_intercept(pred, truth).alias("intercept"),
        F.regr_r2(pred, truth).alias("line_r2"),
        F.least(F.min(truth), F.min(pred)).alias("_low"),
        F.greatest(F.max(truth), F.max(pred)).alias("_high"),
    )
    axis = lines.agg(
        (F.min("_low") * 1.05).alias("axis_low"), (F.max("_high") * 1.05).alias("axis_high")
    )
    return lines.drop("_low", "_high").crossJoin(F.broadcast(axis))  # one row


def rejection_rate(
    tests: DataFrame, group: Sequence[str] = ("model",), rejected: str = "rejected"
) -> DataFrame:
    """Share of valid tests that were rejected, with the number of failed ones."""
    return tests.groupBy(*group).agg(
        F.avg(F.col(rejected).cast("double")).alias("rate"),
        F.count(rejected).alias("n_tests"),
        F.sum(F.col(rejected).isNull().cast("long")).alias("n_failed"),
    )


def rate_table(rates: DataFrame, columns: str, values: Sequence, index: str = "model") -> DataFrame:
    """Rates side by side: one row per model, one column per noise level or version."""
    return rates.groupBy(index).pivot(columns, list(values)).agg(F.first("rate"))


def cv_rank(cv: DataFrame, group: Sequence[str] = ("model",), ordered: str | None = None) -> DataFrame:
    """Rank of each grid point by mean test score; a group is one parameter grid."""
    if ordered not in (None, "ascending", "descending"):
        raise ValueError("ordered must be None, 'ascending' or 'descending'")
    w = W.partitionBy(*group).orderBy(F.col("mean_test_score").desc())
    ranked = cv.withColumn("rank_test_score", F.rank().over(w))
    if ordered is None:
        return ranked
    by = F.col("rank_test_score")
    return ranked.orderBy(*group, by if ordered == "ascending" else by.desc())


def sort_importances(df: DataFrame, column: str = "importance", ordered: str | None = None) -> DataFrame:
    """Importances in reverse input order, ascending or descending."""
    if ordered is None:
        return df.orderBy(F.col("feature_index").desc())
    if ordered not in ("ascending", "descending"):
        raise ValueError("ordered must be None, 'ascending' or 'descending'")
    by = F.col(column)
    return df.orderBy(by if ordered == "ascending" else by.desc(), "feature_index")
