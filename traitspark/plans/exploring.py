"""Queries: features, association, densities, metrics and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explore, features, metrics
from ..operators.linear import coef_stability as refit_stability
from . import base as B
from .base import rnd, sql_rnd
from .registry import query

# -- features ------------------------------------------------------------------


@query(
    "standard_scale",
    f"""with {B.LI_SQL}, s as (select avg(l_quantity) as m1, stddev_pop(l_quantity) as s1,
      avg(l_extendedprice) as m2, stddev_pop(l_extendedprice) as s2 from li)
    select row_key, {sql_rnd('(l_quantity - m1) / s1')} as l_quantity, {sql_rnd('(l_extendedprice - m2) / s2')} as l_extendedprice,
      0.0::double as flat from li, s""",
)
def standard_scale(spark, sf):
    li = B.line_items(spark, sf).select("row_key", "l_quantity", "l_extendedprice", F.lit(3.0).alias("flat"))
    out = features.scale_numeric(li, ["l_quantity", "l_extendedprice", "flat"])
    return out.select("row_key", rnd("l_quantity").alias("l_quantity"), rnd("l_extendedprice").alias("l_extendedprice"), "flat")


@query(
    "scale_on_train",
    f"""with {B.ORD_SQL}, s as (select avg(y) as m, stddev_pop(y) as s from od where not is_test)
    select o_orderkey, {sql_rnd('(y - m) / s')} as y from od, s""",
)
def scale_on_train(spark, sf):
    rows = B.order_rows(spark, sf)
    return features.scale_numeric(rows, ["y"], fit_on=rows.where(~F.col("is_test"))).select(
        "o_orderkey", rnd("y").alias("y")
    )


_ONE_HOT_SQL = ", ".join(
    [f"cast(Chromosome is not distinct from 'chr{i}' as int) as \"Chr{i}\"" for i in range(1, 8)]
    + [f"cast(a1 is not distinct from '{v}' as int) as \"a1_{v}\"" for v in ("A", "N", "R")]
)


def _nominal_rows(spark, sf):
    li = B.line_items(spark, sf)
    return li.select(
        "row_key", "Chromosome",
        F.when(F.col("l_quantity") > 3, F.col("l_returnflag")).alias("a1"),
        "l_quantity", F.col("l_discount").alias("p_value"),
    )


_NOMINAL_SQL = f"{B.LI_SQL}, nm as (select row_key, Chromosome, case when l_quantity > 3 then l_returnflag end as a1, l_quantity, l_discount as p_value from li)"


@query("one_hot", f"with {_NOMINAL_SQL} select row_key, l_quantity, {_ONE_HOT_SQL}, p_value from nm")
def one_hot(spark, sf):
    return features.one_hot(_nominal_rows(spark, sf), ["Chromosome", "a1"], label="p_value")


@query("order_chromosomes", f"with {_NOMINAL_SQL} select row_key, l_quantity, {_ONE_HOT_SQL}, p_value from nm")
def order_chromosomes(spark, sf):
    flags = features.one_hot(_nominal_rows(spark, sf), ["Chromosome", "a1"], label="p_value")
    return features.order_chromosomes(flags)


@query(
    "one_hot_vector",
    f"""with {_NOMINAL_SQL} select coalesce(a1, '-') as a1, count(*) as n_rows, {sql_rnd('sum(case when a1 is null then 1.0::double else 2.0::double end)')} as n_flags
    from nm group by 1""",
)
def one_hot_vector(spark, sf):
    """Sparse indicator vectors: rows and set flags per level (a missing level sets none)."""
    from pyspark.ml.functions import vector_to_array

    rows = features.one_hot_vector(_nominal_rows(spark, sf), ["Chromosome", "a1"])
    flags = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, v: a + v)
    return rows.groupBy(F.coalesce("a1", F.lit("-")).alias("a1")).agg(
        F.count(F.lit(1)).alias("n_rows"), rnd(F.sum(flags)).alias("n_flags")
    )


@query(
    "process_data",
    f"""with {_NOMINAL_SQL}, s as (select avg(l_quantity) as m, stddev_pop(l_quantity) as s from nm)
    select row_key, {sql_rnd('(l_quantity - m) / s')} as l_quantity, {_ONE_HOT_SQL}, p_value from nm, s""",
)
def process_data(spark, sf):
    out = features.prepare_features(_nominal_rows(spark, sf), "p_value", key=["row_key"])
    return out.withColumn("l_quantity", rnd("l_quantity"))


def _noise_sql(seed: str, key: str) -> str:
    h = f"md5(concat_ws(':', '{seed}', {key}))"
    u = "cast('0x' || substr({h}, {at}, 8) as bigint) / 4294967296.0::double"
    return (
        f"sqrt(-2.0::double * ln({u.format(h=h, at=1)} + 1e-10::double)) * cos(2.0::double * pi() * ({u.format(h=h, at=9)}))"
    )


@query(
    "control_feature",
    f"""with {B.ORD_SQL} select o_orderkey, {sql_rnd('y + 2.5::double * ' + _noise_sql('3', 'o_orderkey'))} as control_variable from od""",
)
def control_feature(spark, sf):
    rows = B.order_rows(spark, sf).select("o_orderkey", "y")
    out = features.control_feature(rows, "y", 2.5, ["o_orderkey"], seed=3)
    return out.select("o_orderkey", rnd("control_variable").alias("control_variable"))


# -- exploration -----------------------------------------------------------------

_ALLELE_SQL = "al as (select l_returnflag as A1, case when l_linenumber < 7 then l_linestatus end as A2 from lineitem)"


@query(
    "allele_proportions",
    f"""with {_ALLELE_SQL}, c as (
      select A1, A2, count(*) as n, 0 as grouping_set from al where A1 is not null and A2 is not null group by 1, 2
      union all select A1, null, count(*), 1 from al where A1 is not null group by 1
      union all select null, A2, count(*), 2 from al where A2 is not null group by 2)
    select A1, A2, n, grouping_set, {sql_rnd('n / sum(n) over (partition by grouping_set)', 9)} as share from c""",
)
def allele_proportions(spark, sf):
    li = B.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("A1"),
        F.when(F.col("l_linenumber") < 7, F.col("l_linestatus")).alias("A2"),
    )
    return explore.proportions(li, "A1", "A2").withColumn("share", rnd("share", 9))


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NOM = ["l_returnflag", "l_linestatus"]


@query(
    "describe_mixed",
    " union all ".join(
        [
            f"""select '{c}' as "column", 'numeric' as kind, {sql_rnd(f'avg({c})')} as mean, {sql_rnd(f'median({c})')} as median,
            {sql_rnd(f'stddev_samp({c})')} as sd, min({c}) as min, max({c}) as max, null as top, null::bigint as freq from lineitem"""
            for c in _NUM
        ]
        + [
            f"""select * from (select '{c}', 'nominal', null, null, null, null, null, {c}, count(*) from lineitem
            group by {c} order by count(*) desc, {c} limit 1)"""
            for c in _NOM
        ]
    ),
)
def describe_mixed(spark, sf):
    out = explore.describe_mixed(B.table(spark, sf, "lineitem"), _NUM, _NOM)
    return out.withColumns({c: rnd(c) for c in ("mean", "median", "sd")})


@query(
    "single_value_cols",
    """select 'l_quantity' as "column", false as is_single from lineitem having count(*) > 0 union all select 'one', true union all select 'none', true
    union all select 'gap', false union all select 'l_linestatus', false""",
)
def single_value_cols(spark, sf):
    li = B.table(spark, sf, "lineitem").select(
        "l_quantity",
        F.lit("x").alias("one"),
        F.lit(None).cast("string").alias("none"),
        F.when(F.col("l_linenumber") > 2, F.lit(1)).alias("gap"),
        "l_linestatus",
    )
    return explore.single_value_columns(li, li.columns)


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]


@query(
    "pearson_pairs",
    " union all ".join(
        f"select '{a}' as row_feature, '{b}' as col_feature, {sql_rnd(f'corr({a}, {b})')} as value from lineitem"
        for a, b in _pairs(_NUM)
    ),
)
def pearson_pairs(spark, sf):
    return explore.pearson_pairs(B.table(spark, sf, "lineitem"), _NUM).withColumn("value", rnd("value"))


def _eta_sql(nominal: str, numeric: str, source: str) -> str:
    return f"""(select sqrt(sum(n * (mk - m) * (mk - m)) / max(sst)) from
      (select {nominal}, count(*) as n, avg({numeric}) as mk from {source} group by {nominal}),
      (select avg({numeric}) as m, var_pop({numeric}) * count(*) as sst from {source}))"""


def _u_sql(x: str, y: str, source: str) -> str:
    """U(x|y)."""
    return f"""(select case when hx = 0 then 1.0 else (hx - hxy) / hx end from
      (select -sum(p * ln(p)) as hx from (select count(*) / sum(count(*)) over () as p from {source} group by {x})),
      (select sum(pxy * ln(py / pxy)) as hxy from (
        select n / sum(n) over () as pxy, sum(n) over (partition by {y}) / sum(n) over () as py
        from (select {x}, {y}, count(*)::double as n from {source} group by {x}, {y}))))"""


_MIXED_SQL = f"{B.LI_SQL}, mx as (select l_quantity, l_extendedprice, y, l_returnflag, l_linestatus, Chromosome, case when l_quantity > 25 then 'hi' else 'lo' end as size_class, 'x' as one from li)"
_MIXED_NUM = ["l_quantity", "l_extendedprice", "y"]
_MIXED_NOM = ["l_returnflag", "l_linestatus", "Chromosome", "size_class", "one"]


def _mixed(spark, sf):
    return B.line_items(spark, sf).select(
        "l_quantity", "l_extendedprice", "y", "l_returnflag", "l_linestatus", "Chromosome",
        F.when(F.col("l_quantity") > 25, F.lit("hi")).otherwise(F.lit("lo")).alias("size_class"),
        F.lit("x").alias("one"),
    )


@query(
    "correlation_ratio",
    f"with {_MIXED_SQL} "
    + " union all ".join(
        f"select '{a}' as nominal, '{b}' as numeric, {sql_rnd(_eta_sql(a, b, 'mx'))} as value"
        for a in _MIXED_NOM[:4]
        for b in _MIXED_NUM
    ),
)
def correlation_ratio(spark, sf):
    return explore.correlation_ratios(_mixed(spark, sf), _MIXED_NOM[:4], _MIXED_NUM).withColumn(
        "value", rnd("value")
    )


def _h_sql(x: str, y: str) -> str:
    return f"""(select sum(pxy * ln(py / pxy)) from (
        select n / sum(n) over () as pxy, sum(n) over (partition by {y}) / sum(n) over () as py
        from (select {x}, {y}, count(*)::double as n from mx group by {x}, {y})))"""


@query(
    "cond_entropy",
    f"with {_MIXED_SQL} "
    + " union all ".join(
        f"select '{x}' as x_column, '{y}' as y_column, {sql_rnd(_h_sql(x, y))} as conditional_entropy"
        for x in _MIXED_NOM for y in _MIXED_NOM if x != y
    ),
)
def cond_entropy(spark, sf):
    _, given = explore.entropies(_mixed(spark, sf), _MIXED_NOM)
    return given.withColumn("conditional_entropy", rnd("conditional_entropy"))


@query(
    "theil_u",
    f"with {_MIXED_SQL} "
    + " union all ".join(
        f"select '{x}' as x_column, '{y}' as y_column, {sql_rnd(_u_sql(x, y, 'mx'))} as value"
        for x in _MIXED_NOM for y in _MIXED_NOM if x != y
    ),
)
def theil_u(spark, sf):
    return explore.theil_pairs(_mixed(spark, sf), _MIXED_NOM).withColumn("value", rnd("value"))


def _cell_sql(a: str, b: str) -> str:
    if "one" in (a, b):
        return "0.0::double"
    if a == b:
        return "1.0::double"
    if a in _MIXED_NUM and b in _MIXED_NUM:
        return f"(select corr({a}, {b}) from mx)"
    if a in _MIXED_NUM:
        return _eta_sql(b, a, "mx")
    if b in _MIXED_NUM:
        return _eta_sql(a, b, "mx")
    return _u_sql(b, a, "mx")


@query(
    "assoc_matrix",
    f"with {_MIXED_SQL} "
    + " union all ".join(
        f"select '{a}' as row_feature, '{b}' as col_feature, {sql_rnd(_cell_sql(a, b))} as value"
        for a in _MIXED_NUM + _MIXED_NOM
        for b in _MIXED_NUM + _MIXED_NOM
    ),
)
def assoc_matrix(spark, sf):
    return explore.association_matrix(_mixed(spark, sf), _MIXED_NUM).withColumn("value", rnd("value"))


@query("cluster_order")
def cluster_order(spark, sf):
    matrix = explore.association_matrix(_mixed(spark, sf), _MIXED_NUM, _MIXED_NOM)
    return explore.cluster_order(matrix, _MIXED_NUM + _MIXED_NOM)


@query(
    "cluster_order_property",
    f"""select {len(_MIXED_NUM) + len(_MIXED_NOM)}::bigint as n_columns, true as none_too_wide, true as none_to_merge, true as positions_in_order""",
)
def cluster_order_property(spark, sf):
    """No cluster is wider than the cut, and no two could be merged within it."""
    from ..session import materialise

    names = _MIXED_NUM + _MIXED_NOM
    matrix = materialise(explore.association_matrix(_mixed(spark, sf), _MIXED_NUM, _MIXED_NOM), "matrix")
    order = explore.cluster_order(matrix, names)
    a, b = matrix.alias("a"), matrix.alias("b")
    # cells of a small matrix
    far = (
        a.join(b, F.col("a.col_feature") == F.col("b.col_feature"))
        .groupBy(F.col("a.row_feature").alias("x"), F.col("b.row_feature").alias("y"))
        .agg(F.sqrt(F.sum((F.col("a.value") - F.col("b.value")) * (F.col("a.value") - F.col("b.value")))).alias("d"))
    )
    cx, cy = (order.select(F.col("feature").alias(n), F.col("cluster").alias(f"c{n}")) for n in ("x", "y"))
    widths = far.join(cx, "x").join(cy, "y").groupBy("cx", "cy").agg(F.max("d").alias("w"))
    cut = far.agg((F.max("d") * 0.5).alias("cut"))
    checks = widths.crossJoin(F.broadcast(cut)).agg(  # one row
        F.coalesce(F.bool_and(F.when(F.col("cx") == F.col("cy"), F.col("w") <= F.col("cut"))), F.lit(True)).alias("none_too_wide"),
        F.coalesce(F.bool_and(F.when(F.col("cx") != F.col("cy"), F.col("w") > F.col("cut"))), F.lit(True)).alias("none_to_merge"),
    )
    places = order.agg(
        F.count_distinct("position").alias("n_columns"), (F.max("position") == F.count(F.lit(1)) - 1).alias("positions_in_order")
    )
    return places.crossJoin(F.broadcast(checks))  # one row each


@query(
    "kde_pvalue",
    f"""with p as (select exp(-o_totalprice / 90000.0::double) / 3.0::double as v from orders), s as (
      select count(*) as n, stddev_samp(v) * pow(count(*), -0.2::double) as bw from p)
    select cast(g as int) as grid_id, {sql_rnd('g / 49.0::double')} as x,
      {sql_rnd('sum(exp(-0.5::double * ((g / 49.0::double - v) / bw) * ((g / 49.0::double - v) / bw))) / (max(n) * max(bw) * sqrt(2 * pi()))', 5)} as density
    from p, s, range(50) t(g) group by g""",
)
def kde_pvalue(spark, sf):
    p = B.table(spark, sf, "orders").select(
        (F.exp(-F.col("o_totalprice") / F.lit(90000.0)) / F.lit(3.0)).alias("v")
    )
    out = explore.kernel_density(p, "v", 0.0, 1.0, 50)
    return out.select("grid_id", rnd("x").alias("x"), rnd("density", 5).alias("density"))


# -- metrics -----------------------------------------------------------------------

_PRED_SQL = f"""{B.LI_SQL}, pr as (
    select 'A' as model, y as truth, 0.5::double * l_quantity + l_extendedprice / 12000.0::double as prediction from li
    union all select 'B', y, 0.4::double * l_quantity + 3.0::double from li)"""


def _predictions(spark, sf):
    li = B.line_items(spark, sf)
    a = F.lit(0.5) * F.col("l_quantity") + F.col("l_extendedprice") / F.lit(12000.0)
    b = F.lit(0.4) * F.col("l_quantity") + F.lit(3.0)
    cells = F.array(
        F.struct(F.lit("A").alias("model"), a.alias("prediction")),
        F.struct(F.lit("B").alias("model"), b.alias("prediction")),
    )
    return li.select(F.col("y").alias("truth"), F.inline(cells))


@query(
    "regression_metrics",
    f"""with {_PRED_SQL} select model, {sql_rnd('avg((truth - prediction) * (truth - prediction))', 4)} as mse,
      {sql_rnd('avg(abs(truth - prediction))', 4)} as mae,
      {sql_rnd('1 - var_pop(truth - prediction) / var_pop(truth)', 4)} as explained_variance,
      {sql_rnd('median(abs(truth - prediction))', 4)} as median_absolute_error,
      {sql_rnd('1 - avg((truth - prediction) * (truth - prediction)) / var_pop(truth)', 4)} as r2
    from pr group by model""",
)
def regression_metrics(spark, sf):
    return metrics.regression_metrics(_predictions(spark, sf))


@query(
    "calibration_line",
    f"""with {_PRED_SQL}, ax as (select least(min(truth), min(prediction)) * 1.05 as axis_low, greatest(max(truth), max(prediction)) * 1.05 as axis_high from pr)
    select model, {sql_rnd('regr_slope(prediction, truth)')} as slope, {sql_rnd('regr_intercept(prediction, truth)')} as intercept,
      {sql_rnd('regr_r2(prediction, truth)')} as line_r2, {sql_rnd('max(axis_low)')} as axis_low, {sql_rnd('max(axis_high)')} as axis_high
    from pr, ax group by model""",
)
def calibration_line(spark, sf):
    out = metrics.calibration_line(_predictions(spark, sf))
    return out.select("model", *[rnd(c).alias(c) for c in out.columns if c != "model"])


@query(
    "exact_quantiles",
    f"""with {_PRED_SQL} select model, {sql_rnd('quantile_cont(prediction, 0.25)')} as q1,
    {sql_rnd('quantile_cont(prediction, 0.5)')} as q2, {sql_rnd('quantile_cont(prediction, 0.975)')} as q975 from pr group by model""",
)
def exact_quantiles(spark, sf):
    from ..operators.ranking import exact_quantiles as quantiles

    out = quantiles(_predictions(spark, sf), "prediction", {"q1": 0.25, "q2": 0.5, "q975": 0.975}, ["model"])
    return out.select("model", *[rnd(c).alias(c) for c in ("q1", "q2", "q975")])


# -- coefficients over subsamples ------------------------------------------------------

COEF_ITERS, COEF_SEED = 8, 11
COEF_SQL = f"""{B.LI_SQL}, {B.sql_draws(COEF_SEED, COEF_ITERS)}, {B.sql_members('li', 'row_key', COEF_SEED)},
  o as ({B.sql_ols2('members', 'l_quantity', 'l_tax', 'y', 'sample_id')}),
  r as ({B.sql_ols2('members', 'l_quantity', 'l_tax', 'y', 'sample_id', ridge=1000.0)}),
  coefs as (
    select 'Linear Regression' as model, sample_id as iteration, 'l_quantity' as feature, b1 as coef from o
    union all select 'Linear Regression', sample_id, 'l_tax', b2 from o
    union all select 'Ridge', sample_id, 'l_quantity', b1 from r
    union all select 'Ridge', sample_id, 'l_tax', b2 from r)"""


def _coefs(spark, sf):
    li = B.line_items(spark, sf).select("row_key", "l_quantity", "l_tax", "y")
    return refit_stability(
        li,
        {"Linear Regression": ("ols", {}), "Ridge": ("ridge", {"alpha": 1000.0})},
        ["l_quantity", "l_tax"], "y", ["row_key"], n_iters=COEF_ITERS, seed=COEF_SEED,
    )


@query(
    "coef_stability",
    f"with {COEF_SQL} select model, iteration::int as iteration, feature, {sql_rnd('coef')} as coef from coefs",
)
def coef_stability(spark, sf):
    return _coefs(spark, sf).withColumn("coef", rnd("coef"))


@query(
    "coef_mean_sd",
    f"with {COEF_SQL} select model, feature, {sql_rnd('avg(coef)')} as mean_coef, {sql_rnd('stddev_samp(coef)')} as sd_coef from coefs group by 1, 2",
)
def coef_mean_sd(spark, sf):
    out = metrics.coef_mean_sd(_coefs(spark, sf))
    return out.select("model", "feature", rnd("mean_coef").alias("mean_coef"), rnd("sd_coef").alias("sd_coef"))


@query(
    "coef_intervals",
    f"""with {COEF_SQL} select model, feature, {sql_rnd('avg(coef)')} as mean_coef, {sql_rnd('stddev_samp(coef)')} as sd_coef,
    {sql_rnd('quantile_cont(coef, 0.5)')} as median, {sql_rnd('quantile_cont(coef, 0.025)')} as lower,
    {sql_rnd('quantile_cont(coef, 0.975)')} as upper, {sql_rnd('quantile_cont(coef, 0.005)')} as p0_5 from coefs group by 1, 2""",
)
def coef_intervals(spark, sf):
    out = metrics.coef_intervals(_coefs(spark, sf))
    return out.select("model", "feature", *[rnd(c).alias(c) for c in out.columns[2:]])


@query(
    "coef_limits",
    f"""with {COEF_SQL}, f as (select model, feature, quantile_cont(coef, 0.75) as q3, quantile_cont(coef, 0.25) as q1, max(abs(coef)) as top from coefs group by 1, 2)
    select model, {sql_rnd('max(q3)')} as uq, {sql_rnd('min(q1)')} as lq,
      {sql_rnd('case when max(q3) - min(q1) > 20 then greatest(abs(max(q3)), abs(min(q1))) else max(top) * 1.05::double end')} as color_limit from f group by 1""",
)
def coef_limits(spark, sf):
    out = metrics.coef_limits(_coefs(spark, sf))
    return out.select("model", *[rnd(c).alias(c) for c in out.columns[1:]])


@query(
    "mean_coef_matrix",
    f"""with {COEF_SQL}, m as (select model, feature, avg(coef) as c from coefs group by 1, 2)
    select feature, {sql_rnd("max(case when model = 'Linear Regression' then c end)")} as "Linear Regression",
      {sql_rnd("max(case when model = 'Ridge' then c end)")} as "Ridge",
      {sql_rnd('(select least(max(abs(c)), 1.3::double) * 1.05::double from m)')} as color_limit from m group by feature""",
)
def mean_coef_matrix(spark, sf):
    out = metrics.mean_coef_matrix(_coefs(spark, sf), ["Linear Regression", "Ridge"])
    return out.select("feature", *[rnd(F.col(f"`{c}`")).alias(c) for c in out.columns[1:]])


_BOX_SQL = f"""{COEF_SQL}, q as (select model, feature, quantile_cont(coef, 0.25) as q1, quantile_cont(coef, 0.5) as median,
      quantile_cont(coef, 0.75) as q3 from coefs group by 1, 2),
    b as (select c.*, q1, median, q3, coef between q1 - (q3 - q1) * 1.5 and q3 + (q3 - q1) * 1.5 as inside from coefs c join q using (model, feature))"""


@query(
    "box_summary",
    f"""with {_BOX_SQL} select model, feature, {sql_rnd('q1')} as q1, {sql_rnd('median')} as median, {sql_rnd('q3')} as q3,
      {sql_rnd('min(case when inside then coef end)')} as whisker_low, {sql_rnd('max(case when inside then coef end)')} as whisker_high,
      cast(sum(cast(not inside as int)) as bigint) as n_outliers from b group by model, feature, b.q1, b.median, b.q3""",
)
def box_summary(spark, sf):
    out = metrics.box_summary(_coefs(spark, sf))
    numbers = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return out.select("model", "feature", *[rnd(c).alias(c) for c in numbers], "n_outliers")


@query(
    "box_outliers",
    f"with {_BOX_SQL} select model, feature, iteration::int as iteration, {sql_rnd('coef')} as coef from b where not inside",
)
def box_outliers(spark, sf):
    return metrics.box_outliers(_coefs(spark, sf)).withColumn("coef", rnd("coef"))
