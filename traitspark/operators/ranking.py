"""Ranks, running totals and exact quantiles without one task per group.

A plain ``row_number() over (partition by g order by x)`` sorts a whole group
in one task. Here each group is cut into buckets; rows are numbered inside a
bucket and shifted by the total of the earlier buckets. The bucket totals are
a bounded number of rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialise

_BEFORE = (W.unboundedPreceding, -1)
_UPTO = (W.unboundedPreceding, W.currentRow)


def _by(group: Sequence[str]):
    return W.partitionBy(*group) if group else W.partitionBy(F.lit(0))


def rank_bits(largest_group: int, bucket_rows: int = 1_000_000) -> int:
    """Bucket bits that keep one sort near ``bucket_rows`` rows."""
    return min(24, max(4, (max(largest_group, 1) // bucket_rows).bit_length()))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner equi-join in which a missing value meets a missing value."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    both = same[0]
    for one in same[1:]:
        both = both & one
    return left.join(renamed, both).drop(*[f"_r_{c}" for c in on])


def hash_rank(
    df: DataFrame,
    order: str,
    group: Sequence[str] = (),
    out: str = "rank",
    bits: int = 12,
    size_out: str | None = None,
) -> DataFrame:
    """Rank ``1..n`` of each row in its group by a uniformly spread sort key.

    ``order`` is an md5 text or a positive 63-bit integer. Its leading ``bits``
    are the bucket, so buckets are equal in size even when one group holds most
    rows: the largest sort is ``n / 2**bits`` rows; see :func:`rank_bits`.
    ``size_out`` also returns the group size. A missing group is a group.
    """
    group = list(group)
    if dict(df.dtypes)[order] == "string":
        bucket = F.coalesce(F.substring(F.col(order), 1, max(1, bits // 4)), F.lit("0"))
    else:
        bucket = F.shiftright(F.col(order), 63 - bits).cast("int")
    keyed = df.withColumn("_bucket", bucket)
    totals = keyed.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # at most 2**bits rows per group
    shifts = totals.select(
        *group,
        "_bucket",
        F.coalesce(
            F.sum("_n").over(_by(group).orderBy("_bucket").rowsBetween(*_BEFORE)), F.lit(0)
        ).alias("_shift"),
        F.sum("_n").over(_by(group)).alias("_size"),
    )
    ranked = keyed.withColumn(
        "_local", F.row_number().over(W.partitionBy(*group, "_bucket").orderBy(order))
    )
    ranked = null_safe_join(ranked, shifts, group + ["_bucket"])
    ranked = ranked.withColumn(out, F.col("_shift") + F.col("_local"))
    if size_out:
        ranked = ranked.withColumn(size_out, F.col("_size"))
    return ranked.drop("_bucket", "_local", "_shift", "_size")


def hash_smallest(
    df: DataFrame, hash_col: str, k: int, group: Sequence[str] = (), digits: int = 3
) -> DataFrame:
    """The ``k`` rows of each group with the smallest hashes, exactly.

    A first pass counts rows per hash prefix and finds the prefix at which a
    group reaches ``k``; only rows up to that prefix are shuffled, about
    ``k + n/16**digits`` per group. They are cut to ``k`` per last hash digits
    first, in parallel, and then per group.
    """
    from .skew import lookup_join

    group = list(group)
    if group:  # a missing group is a group: its rows get a code of their own
        parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in group]
        df, group = df.withColumn("_group", F.concat_ws("\0", *parts)), ["_group"]
    prefix = F.substring(F.col(hash_col), 1, digits)
    totals = (
        df.select(*group, prefix.alias("_prefix"))
        .groupBy(*group, "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # at most 16**digits rows per group
    reached = totals.withColumn(
        "_before",
        F.coalesce(
            F.sum("_n").over(_by(group).orderBy("_prefix").rowsBetween(*_BEFORE)), F.lit(0)
        ),
    ).where(F.col("_before") < k)
    last = reached.groupBy(*group).agg(F.max("_prefix").alias("_last"))
    if not group:
        kept = df.crossJoin(F.broadcast(last)).where(prefix <= F.col("_last"))  # one row
        return kept.drop("_last").orderBy(hash_col).limit(k)
    kept = lookup_join(df, last, group, salt_by=[hash_col]).where(prefix <= F.col("_last")).drop("_last")
    kept = kept.withColumn("_part", F.substring(F.col(hash_col), 31, 2))
    for by in (W.partitionBy(*group, "_part"), W.partitionBy(*group)):
        kept = kept.withColumn("_rank", F.row_number().over(by.orderBy(hash_col))).where(F.col("_rank") <= k)
    return kept.drop("_rank", "_part", "_group")


def value_counts(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their counts: ties are combined before the shuffle."""
    return (
        df.dropna(subset=[*group, value])
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_count"))
        # always true; keeps the count in every reader so that all branches
        # share one exchange
        .where(F.col("_count") > 0)
    )


# Coarse and fine cuts of the ordered buckets: 16 * 16 buckets.
_SIDE = 16


def bucket_by_value(counts: DataFrame, value: str) -> DataFrame:
    """Ordered bucket number (0..255) of each distinct value, from the overall distribution.

    The cut points are one row, so they are broadcast. A bucket holds about
    1/256 of the distinct values over all groups, so no (group, bucket) pair is
    larger than that. The lookup goes through coarse and then fine cuts.
    """
    n = _SIDE * _SIDE
    probs = F.lit(np.arange(1, n) / n)  # one literal keeps the plan small
    cuts = counts.agg(F.percentile_approx(value, probs, 10 * n).alias("_cuts")).select(
        F.array(*[F.get("_cuts", F.lit(_SIDE * i - 1)) for i in range(1, _SIDE)]).alias("_coarse"),
        F.array(*[F.slice("_cuts", _SIDE * i + 1, _SIDE - 1) for i in range(_SIDE)]).alias("_fine"),
    )

    def below(array) -> Column:
        return F.size(F.filter(array, lambda c: c < F.col(value)))

    return (
        counts.crossJoin(F.broadcast(cuts))  # one row
        .withColumn("_block", below(F.col("_coarse")))
        .withColumn("_bucket", F.col("_block") * _SIDE + below(F.get("_fine", F.col("_block"))))
        .drop("_coarse", "_fine", "_block")
    )


#: Distinct values of all groups that are ordered in one bucket a group.
BUCKET_VALUES = 200_000


def running_counts(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Distinct values with ``_count``, ``_upto`` (rows with a value <= it) and ``_total``.

    Equal values are combined first and written once, because the totals, the
    running sums and what is built on them all read them. They are counted, and
    cut into buckets when there are many.
    """
    group = list(group)
    placed = materialise(value_counts(df, value, group), "values")
    if placed.count() > BUCKET_VALUES:
        placed = materialise(bucket_by_value(placed, value), "values")
    else:  # all distinct values fit into one bucket
        placed = placed.withColumn("_bucket", F.lit(0))
    totals = placed.groupBy(*group, "_bucket").agg(F.sum("_count").alias("_n"))
    # at most 256 rows per group
    shifts = totals.select(
        *group,
        "_bucket",
        F.coalesce(
            F.sum("_n").over(_by(group).orderBy("_bucket").rowsBetween(*_BEFORE)), F.lit(0)
        ).alias("_shift"),
        F.sum("_n").over(_by(group)).alias("_total"),
    )
    inside = W.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(*_UPTO)
    return (
        placed.withColumn("_local", F.sum("_count").over(inside))
        .join(shifts, group + ["_bucket"])
        .withColumn("_upto", F.col("_shift") + F.col("_local"))
        .drop("_local", "_shift")
    )


# Sketch accuracy, half-width of the bracket around a quantile as a share of
# the rows (ten times the sketch error), and the group size up to which every
# row is a candidate.
_ACCURACY, _MARGIN, _SMALL = 10_000, 0.001, 20_000


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], group: Sequence[str] = ()
) -> DataFrame:
    """Exact interpolated quantiles per group, one column per entry of ``probs``.

    The built-in exact percentile keeps every distinct value of a group in one
    task. Here a first pass brackets each quantile with a sketch; a second pass
    counts the rows below the bracket and ranks only the rows inside it, about
    0.2 percent of the group, by buckets. A rank outside its bracket would break
    the sketch's error bound and raises an error rather than a wrong value.
    """
    from .skew import lookup_join

    group = list(group)
    base = df.select(*group, F.col(value).cast("double").alias("_v")).dropna()
    wide = [p for q in probs.values() for p in (max(q - _MARGIN, 0.0), min(q + _MARGIN, 1.0))]
    sketch = base.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", wide, _ACCURACY).alias("_edge")
    )
    small = F.col("_n") <= _SMALL
    brackets = sketch.select(
        *group,
        "_n",
        F.array(
            *[
                F.struct(
                    F.when(small | F.lit(q <= _MARGIN), F.lit(float("-inf")))
                    .otherwise(F.col("_edge")[2 * i]).alias("low"),
                    F.when(small | F.lit(q >= 1 - _MARGIN), F.lit(float("inf")))
                    .otherwise(F.col("_edge")[2 * i + 1]).alias("high"),
                )
                for i, q in enumerate(probs.values())
            ]
        ).alias("_brackets"),
    )
    if group:
        marked = lookup_join(base, brackets, group, salt_by=[*group, "_v"])
    else:
        marked = base.crossJoin(F.broadcast(brackets))  # one row
    low = [F.col("_brackets")[i]["low"] for i in range(len(probs))]
    high = [F.col("_brackets")[i]["high"] for i in range(len(probs))]
    below = marked.groupBy(*group).agg(
        F.max("_n").alias("_n"),
        *[F.sum((F.col("_v") < low[i]).cast("long")).alias(f"_below{i}") for i in range(len(probs))],
    )
    inside = [F.col("_v").between(low[i], high[i]) for i in range(len(probs))]
    # the cheap test first: few rows are near any quantile
    near = marked.where(reduce(or_, inside))
    hits = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]))
    candidates = near.select(*group, "_v", F.explode(hits).alias("_q"))
    runs = running_counts(candidates, "_v", [*group, "_q"])
    levels = F.array(*[F.struct(F.lit(i).alias("_q"), F.col(f"_below{i}").alias("_below")) for i in range(len(probs))])
    ranked = runs.join(below.select(*group, "_n", F.inline(levels)), [*group, "_q"])
    last = F.col("_below") + F.col("_upto")
    first = last - F.col("_count") + 1
    aggs, out = [], []
    for i, (name, q) in enumerate(probs.items()):
        position = (F.col("_n") - 1) * F.lit(float(q))
        for end, rank in (("lo", F.floor(position) + 1), ("hi", F.ceil(position) + 1)):
            hit = (F.col("_q") == i) & (first <= rank) & (rank <= last)
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{name}_{end}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        found = F.when(lo.isNotNull() & hi.isNotNull(), lo + (hi - lo) * (position - F.floor(position)))
        out.append(
            F.coalesce(found, F.raise_error(F.lit("quantile outside its bracket")).cast("double")).alias(name)
        )
    picked = ranked.groupBy(*group).agg(F.max("_n").alias("_n"), *aggs)
    if not group:
        picked = picked.where(F.col("_n").isNotNull())
    return picked.select(*group, *out)


def step_up_adjust(
    df: DataFrame, p_value: str, group: Sequence[str] = (), out: str = "p_adjusted"
) -> DataFrame:
    """Step-up false-discovery adjustment of each distinct p-value in a group.

    The adjusted value is the smallest ``p' * m / rank(p')`` over all
    ``p' >= p``, capped at one. Tied p-values share the rank of their last
    member, so the work runs on distinct values; the running minimum is taken
    inside each bucket and combined with the minima of the later buckets.
    """
    group = list(group)
    runs = running_counts(df, p_value, group).withColumn(
        "_ratio", F.col(p_value) * F.col("_total") / F.col("_upto")
    )
    later = W.partitionBy(*(group or [F.lit(0)])).orderBy(F.col("_bucket").desc()).rowsBetween(*_BEFORE)
    minima = (
        runs.groupBy(*group, "_bucket")
        .agg(F.min("_ratio").alias("_low"))
        .select(*group, "_bucket", F.min("_low").over(later).alias("_later"))
    )
    inside = (
        W.partitionBy(*group, "_bucket").orderBy(F.col(p_value).desc()).rowsBetween(*_UPTO)
    )
    return (
        runs.withColumn("_own", F.min("_ratio").over(inside))
        .join(minima, group + ["_bucket"])
        .select(
            *group,
            p_value,
            F.col("_count").alias("n_tied"),
            F.least(F.lit(1.0), F.col("_own"), F.col("_later")).alias(out),
        )
    )
