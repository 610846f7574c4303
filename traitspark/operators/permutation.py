"""Permutations of columns and labels, rank p-values, controls and importance tests.

Scores of a linear prediction under a permutation need one cross product per
repeat: all other sums do not change. Rows are paired by rank: the row at
place i of a fixed order meets the row at place i of the repeat's own order.
A sample that fits a task is permuted there. A larger one is dealt into ranges of places:
counts of the sort keys by bin tell which range a row of a repeat can come to, a
task sorts what came to its range and pairs all repeats with the same fixed rows.
Many groups are ranked by hash buckets and joined by place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.hashing import PRIME, hex_int, normal, place_order, place_steps, residue, salted_md5
from ..functions.scalars import ratio
from ..functions.special import chi2_even_tail
from ..session import materialise
from .linear import LinearFit, solve
from .metrics import rejection_rate
from .moments import Moments, column_means, moment_table
from .ranking import hash_rank, null_safe_join, rank_bits, step_up_adjust
from .sampling import subsample_members
from .skew import lookup_join, skew_join

ALPHA = 0.05
# Scores are compared after rounding, so that the order of summation cannot
# turn a tie into a difference.
SCORE_DIGITS = 9


# Rows of a group up to which its permutations run on arrays in one task;
# larger groups are ranked across tasks.
BLOCK_ROWS = 500_000


#: Places a task pairs at once, bins of sort keys a range, and numbers of the table of all bins.
RANGE_ROWS = 1 << 16
RANGE_BINS = 16
BIN_NUMBERS = 1 << 20


def _with_hashes(df: DataFrame, group: Sequence[str], key: Sequence[str], seed, keep: Sequence[str]) -> DataFrame:
    h = salted_md5(seed, *key)
    return df.select(
        *group,
        *keep,
        (hex_int(h) % F.lit(PRIME)).alias("_h"),
        hex_int(h, 9).alias("_t"),
        residue(f"{seed}:group", *group).alias("_g"),
    )


def _largest_group(df: DataFrame, group: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and number of groups: one combined count."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    largest, groups = sizes.agg(F.max("_n"), F.count("_n")).first()
    return largest or 0, groups


def _placed(df: DataFrame, group: Sequence[str], turn: Column, largest: int) -> DataFrame:
    """Rank of each row in the order of its turn; turn 0 is the fixed order.

    The sort key is built in steps, so that no step repeats a long expression.
    """
    keyed = df
    for name, step in place_steps("_h", "_t", "_g", turn):
        keyed = keyed.withColumn(name, step)
    return hash_rank(
        keyed.select(*df.columns, "_order"), "_order", group, "_place", rank_bits(largest)
    ).drop("_order", "_h", "_t", "_g")


def _turned(df: DataFrame, group: Sequence[str], first: int, last: int, largest: int) -> DataFrame:
    spread = df.withColumn("repeat", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return _placed(spread, [*group, "repeat"], F.col("repeat") + 1, largest)


def permute_column(
    df: DataFrame,
    column: str,
    key: Sequence[str],
    group: Sequence[str] = (),
    n_repeats: int = 1,
    seed=0,
    out: str = "permuted",
) -> DataFrame:
    """Every row once per repeat with ``column`` shuffled inside its group."""
    rest = [c for c in df.columns if c not in group]
    largest, _ = _largest_group(df, group)
    receivers = _placed(_with_hashes(df, group, key, seed, rest), group, F.lit(0), largest)
    givers = _turned(_with_hashes(df, group, key, seed, [column]), group, 1, n_repeats, largest)
    givers = givers.select(*group, "repeat", "_place", F.col(column).alias(out))
    return null_safe_join(givers, receivers, [*group, "_place"]).drop("_place")


def _chunks(batches, rows: int = 1 << 18) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def range_rows(
    base: DataFrame,
    group: Sequence[str],
    still: Sequence[str],
    moved: Sequence[str],
    first: int,
    last: int,
    run: Callable,
    schema: str,
) -> DataFrame | None:
    """Rows of ``run`` for each range of places of each group, with the group's columns; None for too many groups.

    ``run(at, x, turned)`` gets the group's values, the ``still`` columns in the fixed
    order, and an iterator of (repeat, ``moved`` columns in the repeat's order). A row of
    a repeat travels once, as its sort key and moved values; only rows of a bin that
    lies across an edge go to both sides.
    """
    group, still, moved = list(group), list(still), list(moved)
    spark = base.sparkSession
    turns = [0, *[r + 1 for r in range(first, last + 1)]]  # the fixed order comes first
    sizes = base.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    found = sizes.limit(BIN_NUMBERS // (RANGE_BINS * len(turns)) + 1).collect()  # bounded
    if len(found) * RANGE_BINS * len(turns) > BIN_NUMBERS:
        return None
    if not found:
        return spark.createDataFrame([], ", ".join([f"`{c}` {t}" for c, t in base.select(*group).dtypes] + [schema]))
    ats, counts = [tuple(r[:-1]) for r in found], [r["_n"] for r in found]
    size = RANGE_ROWS
    bins = min(RANGE_BINS * -(-max(counts) // size), BIN_NUMBERS // (len(found) * len(turns)))
    codes = spark.createDataFrame([(*at, i) for i, at in enumerate(ats)], sizes.drop("_n").withColumn("_code", F.lit(0)).schema)
    base = base.select(*group, *sorted({*still, *moved}), "_h", "_t", "_g")
    coded = null_safe_join(base, F.broadcast(codes), group) if group else base.withColumn("_code", F.lit(0))
    coded = materialise(coded.drop(*group), "members")

    def ordered(table: pa.Table) -> Iterator[tuple[int, np.ndarray, int, np.ndarray, np.ndarray]]:
        """Code, its rows, the number of the turn, their sort keys and bins."""
        code, h, t, g = (table.column(c).to_numpy() for c in ("_code", "_h", "_t", "_g"))
        for c in np.unique(code):
            rows = np.flatnonzero(code == c)
            for k, turn in enumerate(turns):
                order = place_order(h[rows], t[rows], g[rows], turn)
                yield int(c), rows, k, order, (order >> 32) * bins // PRIME

    def count(batches):
        total = np.zeros((len(ats), len(turns), bins), np.int64)
        for table in _chunks(batches):
            for c, _, k, _, of in ordered(table):
                total[c, k] += np.bincount(of, minlength=bins)
        yield pa.RecordBatch.from_pydict({"body": pa.array([total.tobytes()], pa.binary())})

    # a table a core
    tables = coded.select("_code", "_h", "_t", "_g").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(count, "body binary")
    upto = np.zeros((len(ats), len(turns), bins), np.int64)
    for row in tables.toLocalIterator():
        upto += np.frombuffer(row["body"], np.int64).reshape(upto.shape)
    upto = upto.cumsum(axis=2)

    def deal(batches):
        for table in _chunks(batches):
            values = {True: np.column_stack([table.column(c).to_numpy() for c in still]), False: np.column_stack([table.column(c).to_numpy() for c in moved])}
            for c, rows, k, order, of in ordered(table):
                ends = upto[c, k]
                low = np.where(of > 0, ends[of - 1], 0) // size
                high = (ends[of] - 1) // size
                for ahead in range(int((high - low).max()) + 1):
                    at = np.flatnonzero(low + ahead <= high)
                    at = at[np.argsort(low[at], kind="stable")]
                    target = low[at] + ahead
                    body = np.column_stack([order[at].view(float), values[k == 0][rows[at]]])
                    edges = [0, *(np.flatnonzero(np.diff(target)) + 1), len(target)]
                    n = len(edges) - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([c] * n, pa.int32()),
                            pa.array(target[edges[:-1]], pa.int32()),
                            pa.array([k] * n, pa.int32()),
                            pa.array([body[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                        ],
                        ["_code", "_range", "_turn", "_body"],
                    )

    def pair(table: pa.Table) -> pa.Table:
        c, place = table.column("_code")[0].as_py(), table.column("_range")[0].as_py() * size
        bodies: dict[int, list] = {}
        for k, body in zip(table.column("_turn").to_pylist(), table.column("_body")):
            bodies.setdefault(k, []).append(body.as_buffer())

        def part(k: int) -> np.ndarray:
            width = 1 + len(moved if k else still)
            m = np.concatenate([np.frombuffer(b).reshape(-1, width) for b in bodies.pop(k)])
            order = np.ascontiguousarray(m[:, 0]).view(np.int64)
            before = np.searchsorted(upto[c, k], place, "right")  # the first bin that reaches into the range
            start = place - (upto[c, k, before - 1] if before else 0)
            return m[np.argsort(order)[start : start + size], 1:]

        rows = run(list(ats[c]), part(0), ((first + k - 1, part(k)) for k in range(1, len(turns))))
        return pa.Table.from_pylist([dict(zip(names, [c, *row])) for row in rows], schema=arrow)

    empty = spark.createDataFrame([], f"_code int, {schema}")
    names, arrow = empty.columns, to_arrow_schema(empty.schema)
    dealt = coded.mapInArrow(deal, "_code int, _range int, _turn int, _body binary")
    out = dealt.groupBy("_code", "_range").applyInArrow(pair, empty.schema)
    return (out.join(F.broadcast(codes), "_code") if group else out).drop("_code")


def permutation_products(
    df: DataFrame,
    still: Sequence[str],
    moved: Sequence[str],
    key: Sequence[str],
    group: Sequence[str],
    n_repeats: int,
    seed=0,
    first: int = 1,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``sum still_i * permuted(moved_i)`` for each i, group and repeat.

    All columns share the permutation of a repeat. The group sizes are checked
    first: groups of at most ``block_rows`` rows are permuted as arrays, a
    block of repeats per task; otherwise rows are dealt into ranges of places,
    with only the moved side repeated, or with many groups ranked across tasks
    and joined by place. All give the same permutations.
    """
    columns = sorted({*still, *moved})
    base = _with_hashes(df, group, key, seed, [F.col(c).cast("double").alias(c) for c in columns])
    largest, groups = _largest_group(base, group)
    if largest <= block_rows:
        return _products_by_block(base, still, moved, group, first, n_repeats, max(groups, 1))
    kept, dealt = sorted(set(still)), sorted(set(moved))
    pairs = [(kept.index(s), dealt.index(m)) for s, m in zip(still, moved)]

    def run(at, x, turned):
        return [[repeat, *[float(x[:, i] @ d[:, j]) for i, j in pairs]] for repeat, d in turned]

    names = [f"product_{i}" for i in range(len(pairs))]
    parts = range_rows(base, group, kept, dealt, first, n_repeats, run, ", ".join(["repeat int", *[f"{c} double" for c in names]]))
    if parts is not None:
        return parts.groupBy(*group, "repeat").agg(*[F.sum(c).alias(c) for c in names])
    fixed = _placed(base.select(*group, "_h", "_t", "_g", *sorted(set(still))), group, F.lit(0), largest)
    fixed = fixed.select(*group, "_place", *[F.col(c).alias(f"_s_{c}") for c in sorted(set(still))])
    turned = _turned(base.select(*group, "_h", "_t", "_g", *sorted(set(moved))), group, first, n_repeats, largest)
    turned = turned.select(
        *group, "repeat", "_place", *[F.col(c).alias(f"_m_{c}") for c in sorted(set(moved))]
    )
    sums = [
        F.sum(F.col(f"_s_{s}") * F.col(f"_m_{m}")).alias(f"product_{i}")
        for i, (s, m) in enumerate(zip(still, moved))
    ]
    return null_safe_join(turned, fixed, [*group, "_place"]).groupBy(*group, "repeat").agg(*sums)


def _products_by_block(
    base: DataFrame, still: Sequence[str], moved: Sequence[str], group: Sequence[str],
    first: int, last: int, groups: int,
) -> DataFrame:
    """Array form for groups whose size has been checked."""
    still, moved, group = list(still), list(moved), list(group)
    tasks = base.sparkSession.sparkContext.defaultParallelism * 2
    repeats = list(range(first, last + 1))
    blocks = max(1, min(len(repeats), -(-tasks // groups)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        h, t, g = (frame[c].to_numpy("int64") for c in ("_h", "_t", "_g"))
        fixed = np.argsort(place_order(h, t, g, 0))
        s = frame[still].to_numpy(float)[fixed]
        m = frame[moved].to_numpy(float)
        block = int(frame["_block"].iloc[0])
        rows = []
        for repeat in repeats[block::blocks]:
            turn = np.argsort(place_order(h, t, g, repeat + 1))
            rows.append([repeat, *np.einsum("ij,ij->j", s, m[turn])])
        out = pd.DataFrame(rows, columns=["repeat", *[f"product_{i}" for i in range(len(still))]])
        out["repeat"] = out["repeat"].astype("int32")
        for position, name in enumerate(group):
            out.insert(position, name, frame[name].iloc[0])
        return out

    types = dict(base.dtypes)
    schema = ", ".join(
        [f"`{c}` {types[c]}" for c in group] + ["repeat int"] + [f"product_{i} double" for i in range(len(still))]
    )
    spread = base.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.groupBy(*group, "_block").applyInPandas(run, schema)


def label_scores(
    df: DataFrame,
    truth: str,
    pred: str,
    key: Sequence[str],
    group: Sequence[str] = ("sample_id",),
    n_repeats: int = 5,
    seed=0,
    first: int = 1,
) -> DataFrame:
    """Baseline R2 and R2 with shuffled labels per group and repeat; any model's predictions."""
    group = list(group)
    y, p = F.col(truth), F.col(pred)
    sums = df.groupBy(*group).agg(
        F.sum(y * y).alias("_yy"), F.sum(y * p).alias("_yp"), F.sum(p * p).alias("_pp"),
        (F.var_pop(truth) * F.count(truth)).alias("_sst"),
    )
    products = permutation_products(df, [pred], [truth], key, group, n_repeats, seed, first)

    def r2(cross: str) -> Column:
        return F.round(
            1 - ratio(F.col("_yy") - 2 * F.col(cross) + F.col("_pp"), "_sst"), SCORE_DIGITS
        )

    # one row per group meets one row per group and repeat
    return products.join(sums, group).select(
        *group, "repeat", r2("_yp").alias("baseline"), r2("product_0").alias("score")
    )


def column_scores(
    df: DataFrame,
    model: LinearFit,
    truth: str,
    key: Sequence[str],
    group: Sequence[str] = ("sample_id",),
    features: Sequence[str] | None = None,
    n_repeats: int = 5,
    seed=0,
) -> DataFrame:
    """Baseline R2 and R2 with one feature shuffled: ``(group, feature, repeat, ...)``.

    Every feature uses the same permutations, so one pass over the repeats
    serves all of them.
    """
    group, features = list(group), list(features or model.features)
    weight = dict(zip(model.features, model.coef))
    parts = df.withColumn("_r", F.col(truth) - model.column()).select(
        *group, *key, truth, "_r", *features,
        *[(F.col("_r") + F.lit(float(weight[f])) * F.col(f)).alias(f"_u_{f}") for f in features],
    )
    sums = parts.groupBy(*group).agg(
        F.sum(F.col("_r") * F.col("_r")).alias("_sse"),
        (F.var_pop(truth) * F.count(truth)).alias("_sst"),
        *[F.sum(F.col(f"_u_{f}") * F.col(f"_u_{f}")).alias(f"_uu_{f}") for f in features],
        *[F.sum(F.col(f) * F.col(f)).alias(f"_xx_{f}") for f in features],
    )
    products = permutation_products(
        parts, [f"_u_{f}" for f in features], features, key, group, n_repeats, seed
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.round(1 - ratio("_sse", "_sst"), SCORE_DIGITS).alias("baseline"),
                F.round(
                    1
                    - ratio(
                        F.col(f"_uu_{f}")
                        - 2 * float(weight[f]) * F.col(f"product_{i}")
                        + float(weight[f]) ** 2 * F.col(f"_xx_{f}"),
                        "_sst",
                    ),
                    SCORE_DIGITS,
                ).alias("score"),
            )
            for i, f in enumerate(features)
        ]
    )
    return products.join(sums, group).select(*group, "repeat", F.inline(cells))


def model_column_scores(
    df: DataFrame,
    predict: Callable[[DataFrame], DataFrame],
    features: Sequence[str],
    truth: str,
    key: Sequence[str],
    group: Sequence[str] = ("sample_id",),
    n_repeats: int = 5,
    seed=0,
    pred: str = "prediction",
) -> DataFrame:
    """Shuffled-feature scores of any model, by predicting the shuffled rows.

    ``predict`` adds the column ``pred`` from the feature columns.
    """
    group, features = list(group), list(features)
    rows = df.select(*group, *key, truth, *features)
    largest, _ = _largest_group(rows, group)
    receivers = _placed(_with_hashes(rows, group, key, seed, [truth, *features]), group, F.lit(0), largest)
    givers = _turned(_with_hashes(rows, group, key, seed, features), group, 1, n_repeats, largest).select(
        *group, "repeat", "_place", *[F.col(f).alias(f"_g_{f}") for f in features]
    )
    mixed = givers.join(receivers, [*group, "_place"])
    variants = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                *[(F.col(f"_g_{c}") if c == f else F.col(c)).alias(f"_v_{c}") for c in features],
            )
            for f in features
        ]
    )
    spread = mixed.select(*group, "repeat", truth, F.inline(variants)).withColumnsRenamed(
        {f"_v_{c}": c for c in features}
    )

    def r2(table: DataFrame, by: Sequence[str], out: str) -> DataFrame:
        e = F.col(truth) - F.col(pred)
        return table.groupBy(*by).agg(
            F.round(1 - ratio(F.avg(e * e), F.var_pop(truth)), SCORE_DIGITS).alias(out)
        )

    scores = r2(predict(spread), [*group, "feature", "repeat"], "score")
    baseline = r2(predict(rows), group, "baseline")
    return scores.join(baseline, group) if group else scores.crossJoin(F.broadcast(baseline))


def rank_p_value(
    scores: DataFrame,
    group: Sequence[str],
    alternative: str = "greater",
    one_tailed: bool = True,
) -> DataFrame:
    """Rank of the baseline among its permuted scores as a p-value.

    Upper tail ``(1 + #{score >= baseline}) / (1 + n)``; lower tail
    ``#{score < baseline} / (1 + n)``; two-sided picks the upper tail when the
    baseline is at or above the median of all n + 1 values, which holds when
    fewer than half of them exceed it. Counts add up, so repeats can be run in blocks.
    """
    counts = scores.groupBy(*group).agg(
        F.count("score").alias("n_repeats"),
        F.first("baseline").alias("baseline"),
        F.sum((F.col("score") >= F.col("baseline")).cast("long")).alias("_at_least"),
        F.sum((F.col("score") > F.col("baseline")).cast("long")).alias("_above"),
        F.sum((F.col("score") < F.col("baseline")).cast("long")).alias("_below"),
    )
    size = F.col("n_repeats") + 1
    upper = (F.col("_at_least") + 1) / size
    lower = F.col("_below") / size
    if not one_tailed:
        # with half of the n + 1 values or more above it, the baseline is below the median
        p = F.when(F.col("_above") * 2 < size, upper).otherwise(lower)
    elif alternative == "greater":
        p = upper
    elif alternative == "less":
        p = lower
    else:
        raise ValueError("alternative must be 'greater' or 'less'")
    return counts.select(*group, "n_repeats", "baseline", p.alias("p_value"))


def adjust_p_values(
    tests: DataFrame,
    p_value: str = "p_value",
    group: Sequence[str] = ("model",),
    alpha: float = ALPHA,
    **skew,
) -> DataFrame:
    """False-discovery adjustment: ``p_adjusted`` and ``rejected`` per test.

    Missing and undefined p-values take no part and stay missing. Adjusted values are
    computed per distinct p and joined back with hot p-values salted.
    """
    group = list(group)
    tests = tests.withColumn(p_value, F.when(~F.isnan(p_value), F.col(p_value)))
    adjusted = step_up_adjust(tests.where(F.col(p_value).isNotNull()), p_value, group).drop("n_tied")
    return skew_join(tests, adjusted, [*group, p_value], "left", **skew).withColumn(
        "rejected", F.col("p_adjusted") <= F.lit(alpha)
    )


def fisher_combine(tests: DataFrame, group: Sequence[str], p_value: str = "p_value") -> DataFrame:
    """Fisher's combined p-value per group; missing values are left out, a zero gives zero."""
    p = F.col(p_value)
    sums = tests.where(p.isNotNull()).groupBy(*group).agg(
        (-F.sum(F.ln(F.when(p > 0, p)))).alias("_half"),
        F.count(F.lit(1)).alias("n_tests"),
        F.max((p <= 0).cast("int")).alias("_zero"),
    )
    half = F.coalesce("_half", F.lit(0.0))
    return sums.select(
        *group,
        "n_tests",
        (half * 2).alias("statistic"),
        F.when(F.col("_zero") == 1, F.lit(0.0)).otherwise(
            chi2_even_tail(half, F.col("n_tests"))
        ).alias("p_combined"),
    )


# -- controls ---------------------------------------------------------------


def negative_control_tests(
    df: DataFrame,
    predictions: Mapping[str, str],
    truth: str,
    key: Sequence[str],
    n_samples: int = 3,
    n_repeats: int = 5,
    sample_size: float = 0.3,
    seed=0,
) -> DataFrame:
    """Label-permutation p-value per model, version and sample.

    ``predictions`` maps model names to prediction columns, so every kind of
    model takes part in one pass. Version ``tpr`` scores the true labels,
    ``fpr`` scores labels shuffled by repeat 0.
    """
    members = subsample_members(df, key, n_samples, sample_size, seed)
    columns = list(predictions.values())
    y = F.col(truth)
    sums = members.groupBy("sample_id").agg(
        F.sum(y * y).alias("_yy"), (F.var_pop(truth) * F.count(truth)).alias("_sst"),
        *[F.sum(y * F.col(c)).alias(f"_yp{i}") for i, c in enumerate(columns)],
        *[F.sum(F.col(c) * F.col(c)).alias(f"_pp{i}") for i, c in enumerate(columns)],
    )
    # two readers, one computation
    products = materialise(
        permutation_products(members, columns, [truth] * len(columns), key, ["sample_id"], n_repeats, seed, first=0), "products"
    )
    shuffled = products.where(F.col("repeat") == 0).select(
        "sample_id", *[F.col(f"product_{i}").alias(f"_zero{i}") for i in range(len(columns))]
    )
    # bounded by samples x repeats
    joined = products.where(F.col("repeat") > 0).join(sums, "sample_id").join(shuffled, "sample_id")

    def r2(i: int, cross: str) -> Column:
        return F.round(
            1 - ratio(F.col("_yy") - 2 * F.col(cross) + F.col(f"_pp{i}"), "_sst"), SCORE_DIGITS
        )

    cells = F.array(
        *[
            F.struct(
                F.lit(model).alias("model"),
                F.lit(version).alias("version"),
                r2(i, f"_yp{i}" if version == "tpr" else f"_zero{i}").alias("baseline"),
                r2(i, f"product_{i}").alias("score"),
            )
            for i, model in enumerate(predictions)
            for version in ("tpr", "fpr")
        ]
    )
    scores = joined.select("sample_id", "repeat", F.inline(cells))
    return rank_p_value(scores, ["model", "version", "sample_id"])


def positive_control_tests(
    df: DataFrame,
    models: Mapping[str, tuple[str, Mapping]],
    features: Sequence[str],
    truth: str,
    key: Sequence[str],
    sigmas: Sequence[float] = (0.0,),
    n_samples: int = 3,
    n_repeats: int = 5,
    sample_size: float = 0.3,
    seed=0,
) -> DataFrame:
    """Control-feature permutation p-value per linear model, noise level and sample.

    Each sample gets a feature ``y + sigma * noise``; the model is refitted on
    the sample (from moments) and the control column is shuffled. All noise
    levels and models share one sampling and one set of permutations.
    """
    features, names = list(features), list(models)
    specs = [(models[n][0], dict(models[n][1])) for n in names]
    members = subsample_members(df, key, n_samples, sample_size, seed)
    noise = normal(salted_md5(f"{seed}:noise", "sample_id", *key))
    controls = [f"_c{s}" for s in range(len(sigmas))]
    members = members.withColumn("_noise", noise).select(
        "sample_id", *key, *features, truth,
        *[(F.col(truth) + F.lit(float(v)) * F.col("_noise")).alias(c) for c, v in zip(controls, sigmas)],
    )
    columns = [*features, *controls, truth]
    shift = column_means(df, [*features, truth])
    shift = [*shift[:-1], *[shift[-1]] * len(controls), shift[-1]]
    p = len(features)

    def refit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for grp, gram in zip(frame["grp"], frame["gram"]):
                m = Moments.from_upper(gram, shift)
                weights = []
                for kind, params in specs:
                    for s in range(len(sigmas)):
                        b0, coef = solve(kind, m.keep([*range(p), p + s]), params)
                        weights.append([float(b0), *[float(c) for c in coef]])
                rows.append((int(grp), weights))
            yield pd.DataFrame(rows, columns=["sample_id", "weights"])

    fits = moment_table(members, columns, shift, "sample_id").mapInPandas(
        refit, "sample_id int, weights array<array<double>>"
    )
    # one row per sample
    fitted = lookup_join(members, fits, ["sample_id"], salt_by=key)
    still, moved, scores = [], [], []
    rest = {}
    for i in range(len(names)):
        for s in range(len(sigmas)):
            w = F.col("weights")[i * len(sigmas) + s]
            u = F.col(truth) - w[0]
            for j, f in enumerate(features):
                u = u - w[j + 1] * F.col(f)
            rest[f"_u{i}_{s}"] = u
            still.append(f"_u{i}_{s}")
            moved.append(controls[s])
    rows = fitted.withColumns(rest)
    sums = rows.groupBy("sample_id").agg(
        F.first("weights").alias("_w"),
        (F.var_pop(truth) * F.count(truth)).alias("_sst"),
        *[F.sum(F.col(u) * F.col(u)).alias(f"_uu{k}") for k, u in enumerate(still)],
        *[F.sum(F.col(u) * F.col(c)).alias(f"_uc{k}") for k, (u, c) in enumerate(zip(still, moved))],
        *[F.sum(F.col(c) * F.col(c)).alias(f"_cc{s}") for s, c in enumerate(controls)],
    )
    products = permutation_products(rows, still, moved, key, ["sample_id"], n_repeats, seed)

    def r2(k: int, s: int, cross: str) -> Column:
        b = F.col("_w")[k][p + 1]
        sse = F.col(f"_uu{k}") - 2 * b * F.col(cross) + b * b * F.col(f"_cc{s}")
        return F.round(1 - ratio(sse, "_sst"), SCORE_DIGITS)

    for i, name in enumerate(names):
        for s, sigma in enumerate(sigmas):
            k = i * len(sigmas) + s
            scores.append(
                F.struct(
                    F.lit(name).alias("model"),
                    F.lit(float(sigma)).alias("sigma"),
                    r2(k, s, f"_uc{k}").alias("baseline"),
                    r2(k, s, f"product_{k}").alias("score"),
                )
            )
    table = products.join(sums, "sample_id").select("sample_id", "repeat", F.inline(F.array(*scores)))
    return rank_p_value(table, ["model", "sigma", "sample_id"])


def guarded_samples(
    run: Callable[[int], DataFrame], sample_ids: Sequence[int], schema: str
) -> DataFrame:
    """Run ``run(sample_id)`` per sample; a sample that fails becomes a row with its reason.

    For models that must be refitted by a Spark job per sample. Each sample's
    result goes into a written table of its own, whole and without passing the
    driver, so that its failure can be caught; ``schema`` is the schema of the
    result.
    """
    from pyspark.errors import IllegalArgumentException, PythonException
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    out = spark.createDataFrame([], f"sample_id int, {schema}")
    failed = []
    for i in sample_ids:
        try:
            out = out.union(materialise(run(i).select(F.lit(i).cast("int").alias("sample_id"), *columns), "sample"))
        except (ValueError, ArithmeticError, AttributeError, np.linalg.LinAlgError, IllegalArgumentException) as error:
            failed.append((i, str(error).split("\n")[0]))
        except PythonException as error:  # a sample's data can fail a task; a lost executor or a full disk is no sample's fault
            lines = [x.strip() for x in str(error).split("\n")]
            reasons = [x for x in lines if x.startswith(("ValueError", "ZeroDivisionError", "numpy.linalg", "FloatingPointError"))]
            if not reasons:
                raise
            failed.append((i, reasons[-1]))
    bad = spark.createDataFrame(failed, "sample_id int, reason string")
    return out.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


def control_rates(
    tests: DataFrame, by: Sequence[str], alpha: float = ALPHA
) -> DataFrame:
    """Adjust the sample p-values within each group and give the rejected share.

    The tests (one row per sample) are written out first, because the
    adjustment reads them several times.
    """
    tests = materialise(tests, "tests")
    return rejection_rate(adjust_p_values(tests, group=by, alpha=alpha), by)


# -- importance -------------------------------------------------------------


def permutation_importance(
    df: DataFrame,
    model: LinearFit,
    truth: str,
    key: Sequence[str],
    group: Sequence[str] = ("sample_id",),
    n_repeats: int = 5,
    seed=0,
) -> DataFrame:
    """p-value per feature: rank of the baseline among that feature's own scores."""
    scores = column_scores(df, model, truth, key, group, n_repeats=n_repeats, seed=seed)
    return rank_p_value(scores, [*group, "feature"])


def importance_shards(
    df: DataFrame,
    model: LinearFit,
    truth: str,
    key: Sequence[str],
    n_samples: int = 3,
    n_repeats: int = 5,
    sample_size: float = 0.3,
    seed=0,
    sample_id: int | None = None,
) -> DataFrame:
    """Feature p-values per sample; ``sample_id`` runs one shard only."""
    members = subsample_members(df, key, n_samples, sample_size, seed)
    if sample_id is not None:
        members = members.where(F.col("sample_id") == sample_id)
    tests = permutation_importance(members, model, truth, key, ["sample_id"], n_repeats, seed)
    return tests.withColumn("model", F.lit(model.name))


def merge_shards(
    shards: DataFrame, group: Sequence[str] = ("model",), feature: str = "feature", alpha: float = ALPHA
) -> DataFrame:
    """Combine the samples of each feature and adjust over the features of a model.

    The combined table is written out, because the adjustment reads it several
    times.
    """
    combined = materialise(fisher_combine(shards, [*group, feature]), "combined")
    return adjust_p_values(
        combined.withColumnRenamed("p_combined", "p_value"), group=group, alpha=alpha
    ).withColumnRenamed("p_value", "p_combined")


def combined_importance(
    df: DataFrame, model: LinearFit, truth: str, key: Sequence[str], alpha: float = ALPHA, **sampling
) -> DataFrame:
    """Importance per sample, combined over samples, adjusted over features."""
    return merge_shards(importance_shards(df, model, truth, key, **sampling), alpha=alpha)
