"""Joins of variants with gene intervals, regions and allele tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .skew import skew_join, skew_join_all

# Function classes from highest to lowest precedence.
CLASS_PRECEDENCE = (
    "exonic",
    "splicing",
    "ncRNA_exonic",
    "ncRNA_splicing",
    "ncRNA_intronic",
    "UTR5",
    "UTR3",
    "intronic",
    "upstream",
    "downstream",
    "intergenic",
)
# Fixed value: text shown where an annotation is missing.
MISSING_TEXT = "-"


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """One row per position bin that an interval touches."""
    first, last = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    return df.withColumn("_bin", F.explode(F.sequence(first, last)))


def disjoint_segments(
    intervals: DataFrame, chrom: str, start: str, end: str, width: int
) -> DataFrame:
    """Cut overlapping intervals into segments over which the covering set is constant.

    Closed integer intervals. Work is on the annotation table only: end points
    are put in order inside position bins, the last point of a bin is followed by
    the first of the next bin in use, each stretch between neighbours becomes a
    segment, and segments are matched to the intervals that cover them.
    """
    points = intervals.select(
        F.col(chrom).alias("chrom"),
        F.explode(F.array(F.col(start).cast("long"), F.col(end).cast("long") + 1)).alias("seg_start"),
    ).distinct()
    points = points.withColumn("_bin", F.floor(F.col("seg_start") / width))
    inside = F.lead("seg_start").over(W.partitionBy("chrom", "_bin").orderBy("seg_start"))
    # one row per bin in use
    following = points.groupBy("chrom", "_bin").agg(F.min("seg_start").alias("_first")).select(
        "chrom", "_bin", F.lead("_first").over(W.partitionBy("chrom").orderBy("_bin")).alias("_next")
    )
    segments = (
        points.withColumn("_inside", inside)
        .join(following, ["chrom", "_bin"])
        .withColumn("seg_end", F.coalesce("_inside", "_next") - 1)
        .where(F.col("seg_end").isNotNull())
        .drop("_inside", "_next")
    )
    spans = _binned(intervals, start, end, width).withColumnRenamed(chrom, "chrom")
    # a covering interval contains the segment start, so only its bin is needed
    return (
        segments.join(spans, ["chrom", "_bin"])
        .where((F.col(start) <= F.col("seg_start")) & (F.col("seg_start") <= F.col(end)))
        .drop("_bin")
    )


def locate(
    variants: DataFrame,
    segments: DataFrame,
    chrom: str,
    position: str,
    width: int,
    **skew,
) -> DataFrame:
    """Left join of variants to the one segment that holds their position.

    Segments are spread over the bins they touch, so the join is an equi-join
    on (chromosome, bin) with a range condition; hot bins are salted. Variants
    outside every segment come from the rows without a hit.
    """
    binned = _binned(segments, "seg_start", "seg_end", width)
    fields = [c for c in segments.columns if c not in ("chrom", "seg_start", "seg_end")]
    # one row per (chromosome, bin): a bin holds a bounded number of segments,
    # at most `width`, because segments of a chromosome do not overlap
    packed = binned.groupBy("chrom", "_bin").agg(
        F.collect_list(F.struct("seg_start", "seg_end", *fields)).alias("_segments")
    ).withColumnRenamed("chrom", chrom)
    keyed = variants.withColumn("_bin", F.floor(F.col(position) / width))
    joined = skew_join(keyed, packed, [chrom, "_bin"], "left", **skew)
    hit = F.get(
        F.filter(
            "_segments",
            lambda s: (s["seg_start"] <= F.col(position)) & (F.col(position) <= s["seg_end"]),
        ),
        F.lit(0),
    )
    return (
        joined.withColumn("_hit", hit)
        .select(*variants.columns, *[F.col("_hit")[f].alias(f) for f in fields])
    )


def annotate_genes(
    variants: DataFrame,
    genes: DataFrame,
    chrom: str = "Chromosome",
    position: str = "Position",
    gene_start: str = "start",
    gene_end: str = "end",
    gene_name: str = "name",
    gene_class: str = "class",
    xref: DataFrame | None = None,
    width: int = 100_000,
    **skew,
) -> DataFrame:
    """Function class and gene names of each variant, with cross-reference text.

    Class precedence and the joined name list are settled per segment, on the
    gene table; the variants take one lookup and no aggregation. ``xref`` has
    columns ``name, xref``. Variants in no gene are ``intergenic``.
    """
    rank = F.array_position(F.lit(list(CLASS_PRECEDENCE)), F.col(gene_class))
    # copies of an interval add nothing
    distinct = genes.select(chrom, gene_start, gene_end, gene_name, gene_class).distinct()
    table = distinct.withColumn("_rank", F.when(rank == 0, F.lit(99)).otherwise(rank))
    if xref is not None:
        table = table.join(
            xref.select(F.col("name").alias(gene_name), F.col("xref").alias("_xref")), gene_name, "left"
        )
    else:
        table = table.withColumn("_xref", F.lit(None).cast("string"))
    covered = disjoint_segments(table, chrom, gene_start, gene_end, width)
    best = F.min("_rank").over(W.partitionBy("chrom", "seg_start"))
    segments = (
        covered.withColumn("_best", best)
        .where(F.col("_rank") == F.col("_best"))
        .groupBy("chrom", "seg_start", "seg_end")
        .agg(
            F.min(gene_class).alias("func_class"),
            F.array_join(F.sort_array(F.collect_set(gene_name)), ";").alias("gene_names"),
            F.array_join(F.sort_array(F.collect_set("_xref")), ";").alias("gene_xref"),
        )
    )
    out = locate(variants, segments, chrom, position, width, **skew)
    return out.withColumns(
        {
            "func_class": F.coalesce("func_class", F.lit("intergenic")),
            "gene_names": F.coalesce("gene_names", F.lit(MISSING_TEXT)),
            "gene_xref": F.coalesce(F.when(F.col("gene_xref") != "", F.col("gene_xref")), F.lit(MISSING_TEXT)),
        }
    )


def annotate_regions(
    variants: DataFrame,
    regions: DataFrame,
    chrom: str = "Chromosome",
    position: str = "Position",
    start: str = "start",
    end: str = "end",
    name: str = "name",
    out: str = "region",
    width: int = 100_000,
    **skew,
) -> DataFrame:
    """Names of the regions that hold each variant, joined by ``;``."""
    segments = (
        disjoint_segments(regions.select(chrom, start, end, name).distinct(), chrom, start, end, width)
        .groupBy("chrom", "seg_start", "seg_end")
        .agg(F.array_join(F.sort_array(F.collect_set(name)), ";").alias(out))
    )
    located = locate(variants, segments, chrom, position, width, **skew)
    return located.withColumn(out, F.coalesce(out, F.lit(MISSING_TEXT)))


def annotate_alleles(
    variants: DataFrame,
    databases: Mapping[str, DataFrame],
    on: Sequence[str] = ("Chromosome", "Position", "A1", "A2"),
    **skew,
) -> DataFrame:
    """Values of allele databases by exact match; ``-`` where a variant is absent.

    Each database holds the key columns and value columns; it must not repeat
    a key.
    """
    tables, filled = [], {}
    for prefix, table in databases.items():
        values = [c for c in table.columns if c not in on]
        tables.append(table.withColumnsRenamed({v: f"{prefix}_{v}" for v in values}))
        for v in values:
            name = f"{prefix}_{v}"
            filled[name] = F.coalesce(F.col(name).cast("string"), F.lit(MISSING_TEXT))
    # one salted shuffle of the variants serves every database
    return skew_join_all(variants, tables, on, "left", **skew).withColumns(filled)
