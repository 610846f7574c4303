"""Readers and writers of result, annotation and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File name patterns and column types of the input files.
RESULT_GLOB = "imputed.allWhites.*.chr[0-9]*.csv.gz"
VARIANT_GLOB = "snps.imputed.*.chr[0-9]*.csv{.gz,}"
CHROMOSOME_PATTERN = r"\.chr(\d+)\.csv(?:\.gz)?$"
RESULT_SCHEMA = (
    "SNP string, ALLELE string, iscores double, `NBETA-{trait}` double, "
    "`NSE-{trait}` double, `PV-{trait}` double"
)
VARIANT_SCHEMA = "SNP string, Position long, A1 string, A2 string, `HWE-P` double, iscore double"


def chromosome_of(path):
    """``chr`` plus the number in a file name; missing when it is not digits only."""
    c = F.col(path) if isinstance(path, str) else path
    number = F.regexp_extract(c, CHROMOSOME_PATTERN, 1)
    return F.when(number != "", F.concat(F.lit("chr"), number))


def read_headed(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Text table whose columns are found by their header names.

    Columns of ``schema`` get their types wherever they stand; a missing one is
    an error. Other columns are kept as text. Files of one folder must agree:
    a file with another header is an error, not a shift of columns.
    """
    types = {f.name: f.dataType for f in spark.createDataFrame([], schema).schema}
    names = spark.read.options(header=True, **options).csv(path).columns  # one header
    absent = [c for c in types if c not in names]
    if absent:
        raise ValueError(f"no column {', '.join(absent)} in {path}: it has {', '.join(names)}")
    found = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in names])
    # a nameless column is called by its place, which the check of names would refuse
    nameless = any(c == f"_c{i}" for i, c in enumerate(names))
    return (
        spark.read.schema(found).options(header=True, enforceSchema=nameless, mode="FAILFAST", **options).csv(path)
    )


def _by_chromosome(spark: SparkSession, folder: str, glob: str, schema: str) -> DataFrame:
    rows = read_headed(spark, folder, schema, sep=" ", pathGlobFilter=glob)
    # only digit-numbered files; the glob alone would let chr2x through
    return rows.withColumn("Chromosome", chromosome_of(F.col("_metadata.file_name"))).where(
        F.col("Chromosome").isNotNull()
    )


def read_results(spark: SparkSession, folder: str, trait: str = "50-0.0", schema: str | None = None) -> DataFrame:
    """All per-chromosome result files of a trait in one scan."""
    return _by_chromosome(spark, folder, RESULT_GLOB, schema or RESULT_SCHEMA.format(trait=trait))


def read_variants(spark: SparkSession, folder: str, schema: str = VARIANT_SCHEMA) -> DataFrame:
    """All per-chromosome variant-info files in one scan, compressed or not."""
    return _by_chromosome(spark, folder, VARIANT_GLOB, schema)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated table with a header."""
    return read_headed(spark, path, schema, sep="\t")


def read_integrated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Integrated table from CSV; a nameless leading row-number column is dropped."""
    df = read_headed(spark, path, schema)
    return df.drop(*[c for c in df.columns if c in ("_c0", "Unnamed: 0")])


def read_annotation(spark: SparkSession, path: str, schema: str, missing: str = ".") -> DataFrame:
    """Annotation CSV; the missing-value token becomes null in every column."""
    return read_headed(spark, path, schema, nullValue=missing)


def recode_missing(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Tokens become null in the text columns of a loaded table."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns(
        {c: F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")) for c in text}
    )


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, the main format."""
    df.write.partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header, for readers that need text."""
    df.write.options(header=True, sep=sep).csv(path)


def write_name_list(df: DataFrame, path: str, column: str = "SNP") -> None:
    """One column as plain lines without a header."""
    df.select(column).write.option("header", False).csv(path)


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """Results of one or more models into the shared dataset, one partition per model."""
    df.write.mode(mode).partitionBy("model").parquet(path)


def collect_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of all models in one read."""
    return spark.read.parquet(path)


def complete_prefix(results: DataFrame, names: Sequence[str]) -> DataFrame:
    """Results in registry order up to the first model that has none."""
    order = results.sparkSession.createDataFrame(list(enumerate(names)), "model_order int, model string")
    missing = order.join(results.select("model").distinct(), "model", "left_anti").agg(
        F.coalesce(F.min("model_order"), F.lit(len(names))).alias("_stop")
    )
    listed = order.crossJoin(F.broadcast(missing)).where(F.col("model_order") < F.col("_stop"))  # one row
    # the registry is a fixed short list
    return results.join(F.broadcast(listed.drop("_stop")), "model")


def missing_models(results: DataFrame, names: Sequence[str]) -> DataFrame:
    """Registered models without a result."""
    order = results.sparkSession.createDataFrame([(n,) for n in names], "model string")
    return order.join(results.select("model").distinct(), "model", "left_anti")


def results_matrix(
    results: DataFrame, names: Sequence[str], index: str = "feature", column: str = "model", value: str = "p_value"
) -> DataFrame:
    """Long results as one row per index value and one column per model or shard."""
    return results.groupBy(index).pivot(column, list(names)).agg(F.first(value))


def align_on_index(left: DataFrame, right: DataFrame, index: str = "feature") -> DataFrame:
    """Side-by-side table over the union of index values."""
    return left.join(right, index, "full_outer")
