"""Cleaning, recoding, reordering and joining of result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import first_present, ratio
from .skew import lookup_join, skew_join

# Column names of the result files for one trait key.
RESULT_COLUMNS = {
    "ALLELE": "Allele",
    "NBETA-{trait}": "Beta",
    "NSE-{trait}": "SE",
    "PV-{trait}": "p_value",
    "HWE-P": "HWE_P",
}
LEADING_COLUMNS = ("Chromosome", "Position", "A1", "A2")
# Fixed value: floor of p-values in the report tables.
REPORT_FLOOR = 2e-30


def rename_results(df: DataFrame, trait: str = "50-0.0") -> DataFrame:
    """Rename trait-specific result columns to their short names."""
    return df.withColumnsRenamed({k.format(trait=trait): v for k, v in RESULT_COLUMNS.items()})


def integrate(
    results: DataFrame, variants: DataFrame, on: Sequence[str] = ("SNP", "Chromosome"), **skew
) -> DataFrame:
    """Inner join of results with variant info over all chromosomes at once.

    Replaces file-by-file matching: the chromosome is part of the key. Hot
    keys of the result side are salted; ``skew`` is passed to the join.
    """
    return skew_join(results, variants, on, "inner", **skew)


def fill_twin_score(df: DataFrame, keep: str = "iscores", twin: str = "iscore") -> DataFrame:
    """Fill ``keep`` from its twin where missing and drop the twin."""
    return df.withColumn(keep, first_present(keep, twin)).drop(twin)


def order_columns(df: DataFrame, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """Named columns first, label columns last, the rest as they came."""
    middle = [c for c in df.columns if c not in first and c not in last]
    return df.select([F.col(f"`{c}`") for c in [*first, *middle, *last]])


def tidy_integrated(df: DataFrame, trait: str = "50-0.0") -> DataFrame:
    """Rename, fill the twin score, drop spent columns, label last."""
    df = fill_twin_score(rename_results(df, trait)).drop("Allele")
    return order_columns(df, LEADING_COLUMNS, ("p_value",))


def append_frames(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; absent columns become missing."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def keep_first_chromosomes(
    results: DataFrame, variants: DataFrame, max_files: int | None, column: str = "Chromosome"
) -> DataFrame:
    """Results of the first chromosomes in name order, at most ``max_files``.

    The number kept is also bounded by the number of chromosomes on either
    side, as in a file-by-file loop. The kept names are a bounded list: there
    is one file per chromosome.
    """
    names = results.select(column).distinct()
    if max_files is None:
        n = variants.select(column).distinct().count()
    else:
        n = min(max_files, variants.select(column).distinct().count())
    return lookup_join(results, names.orderBy(column).limit(n), [column], "left_semi")


def zero_floor(df: DataFrame, column: str = "p_value") -> DataFrame:
    """Replace exact zeros by half the smallest non-zero value of the column."""
    low = df.agg(F.min(F.when(F.col(column) != 0, F.col(column))).alias("_low"))
    return (
        df.crossJoin(F.broadcast(low))  # one row
        .withColumn(column, F.when(F.col(column) == 0, F.col("_low") / 2).otherwise(F.col(column)))
        .drop("_low")
    )


def report_log_p(
    df: DataFrame, p_value: str = "p_value", out: str = "log_p", floor: float = REPORT_FLOOR
) -> DataFrame:
    """``-log10(p)`` with zeros set to half of the smaller of ``floor`` and the least positive p."""
    low = df.agg(F.min(F.when(F.col(p_value) > 0, F.col(p_value))).alias("_low"))
    floored = F.least(F.col("_low"), F.lit(floor)) / 2
    return (
        df.crossJoin(F.broadcast(low))  # one row
        .withColumn(
            out, -F.log10(F.when(F.col(p_value) == 0, floored).otherwise(F.col(p_value)))
        )
        .drop("_low")
    )


def flag_significant(
    df: DataFrame,
    p_value: str = "p_value",
    cutoff: float = 0.05,
    models: Sequence[str] | None = None,
    model_column: str = "model",
) -> DataFrame:
    """Mark p below the cutoff; ``models`` keeps a selection for a two-model view."""
    if models is not None:
        df = df.where(F.col(model_column).isin(*models))
    return df.withColumn("signif", F.col(p_value) < F.lit(float(cutoff)))


def stack_targets(
    df: DataFrame, targets: Mapping[str, str], name: str = "target_name", value: str = "y"
) -> DataFrame:
    """One row per (row, target): the long form for fitting every target at once."""
    pairs = F.array(
        *[
            F.struct(F.lit(label).alias(name), F.col(column).cast("double").alias(value))
            for label, column in targets.items()
        ]
    )
    keep = [c for c in df.columns if c not in targets.values()]
    return df.select(*keep, F.inline(pairs))


def add_intercept(df: DataFrame, name: str = "Intercept") -> DataFrame:
    """Constant column of ones in front."""
    return df.select(F.lit(1.0).alias(name), *df.columns)


def typed_columns(df: DataFrame, exceptions: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the nominal columns, exceptions left out."""
    numeric = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in exceptions
    ]
    nominal = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exceptions
    ]
    return numeric, nominal


def column_kinds(df: DataFrame, exceptions: Sequence[str] = ()) -> DataFrame:
    """Table form of :func:`typed_columns` with the number of present values."""
    numeric, nominal = typed_columns(df, exceptions)
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in numeric + nominal])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit("numeric" if c in numeric else "nominal").alias("kind"),
                F.col(c).alias("n_present"),
            )
            for c in numeric + nominal
        ]
    )
    return counts.select(F.inline(rows))


def missing_summary(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Share of missing values per column, optionally per group; one pass."""
    cols = [c for c in df.columns if c not in group]
    shares = df.groupBy(*group).agg(
        *[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in cols]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_share"))
            for c in cols
        ]
    )
    return shares.select(*group, F.inline(rows))


def drop_sparse(
    df: DataFrame, threshold: float | None = None, return_summary: bool = False
):
    """Drop columns whose missing share reaches ``threshold``.

    An absent threshold, or one above 1, drops columns without any value. The
    summary (one row per column) decides on the driver which names to drop.
    """
    if threshold is None or threshold > 1:
        threshold = 1.0
    summary = missing_summary(df)
    sparse = [r["column"] for r in summary.collect() if r["missing_share"] >= threshold]
    kept = df.drop(*sparse)
    return (kept, summary) if return_summary else kept


def outlier_rows(df: DataFrame, column: str, threshold: float = 8.0, out: str = "z") -> DataFrame:
    """Rows whose population z-score is at least ``threshold`` in size; a constant column has none."""
    stats = df.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_sd"))
    return (
        df.crossJoin(F.broadcast(stats))  # one row
        .withColumn(out, ratio(F.col(column) - F.col("_mean"), "_sd"))
        .where(F.abs(F.col(out)) >= threshold)
        .drop("_mean", "_sd")
    )


def threshold_share(df: DataFrame, column: str, bounds: Sequence[float]) -> DataFrame:
    """Share of all rows (missing ones included) with a value up to each bound."""
    aggs = [
        F.avg(F.when(F.col(column) <= F.lit(float(b)), 1.0).otherwise(0.0)).alias(f"s{i}")
        for i, b in enumerate(bounds)
    ]
    rows = F.array(
        *[
            F.struct(F.lit(float(b)).alias("bound"), F.col(f"s{i}").alias("share"))
            for i, b in enumerate(bounds)
        ]
    )
    return df.agg(*aggs).select(F.inline(rows))


# Function classes that are explored one by one.
FUNCTION_CLASSES = ("UTR3", "downstream", "exonic", "intergenic", "intronic", "ncRNA_intronic")


def by_function_class(
    df: DataFrame, column: str = "Func.refGene", classes: Sequence[str] = FUNCTION_CLASSES
) -> DataFrame:
    """Rows of the explored classes in one table, to be partitioned by class on write."""
    return df.where(F.col(f"`{column}`").isin(*classes))
