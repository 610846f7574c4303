"""Queries: linear family, forests, network, cross-validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, forest, linear, metrics, perceptron
from ..operators.sampling import fold_rows
from . import base as B
from .base import rnd, sql_rnd
from .registry import query

_TWO = ["l_quantity", "l_tax"]
_THREE = ["l_quantity", "l_tax", "l_discount"]


def _li(spark, sf):
    return B.line_items(spark, sf).select(
        "row_key", "Chromosome", "l_linenumber", "l_quantity", "l_tax", "l_discount", "l_extendedprice", "y"
    )


def _coef_rows(table: str, model: str) -> str:
    return (
        f"select '{model}' as model, 'l_quantity' as feature, {sql_rnd('b1')} as coef from {table} "
        f"union all select '{model}', 'l_tax', {sql_rnd('b2')} from {table} "
        f"union all select '{model}', 'Intercept', {sql_rnd('b0')} from {table}"
    )


def _fit_rows(spark, fit):
    rows = linear.coef_table(spark, [fit])
    first = spark.createDataFrame([(fit.name, "Intercept", float(fit.intercept))], rows.schema)
    return rows.union(first).withColumn("coef", rnd("coef"))


@query(
    "ols_two_feature",
    f"with {B.LI_SQL}, o as ({B.sql_ols2('li', 'l_quantity', 'l_tax', 'y')}) {_coef_rows('o', 'Linear Regression')}",
)
def ols_two_feature(spark, sf):
    return _fit_rows(spark, linear.fit_linear(_li(spark, sf), _TWO, "y", "ols", name="Linear Regression"))


@query(
    "ridge_two_feature",
    f"with {B.LI_SQL}, o as ({B.sql_ols2('li', 'l_quantity', 'l_tax', 'y', ridge=5000.0)}) {_coef_rows('o', 'Ridge')}",
)
def ridge_two_feature(spark, sf):
    fit = linear.fit_linear(_li(spark, sf), _TWO, "y", "ridge", {"alpha": 5000.0}, name="Ridge")
    return _fit_rows(spark, fit)


@query(
    "pls_one_component",
    f"""with {B.LI_SQL}, m as (select count(*)::double as n, avg(l_quantity) as m1, avg(l_tax) as m2, avg(y) as my,
        stddev_samp(l_quantity) as d1, stddev_samp(l_tax) as d2,
        covar_pop(l_quantity, y) * count(*) / stddev_samp(l_quantity) as v1, covar_pop(l_tax, y) * count(*) / stddev_samp(l_tax) as v2,
        corr(l_quantity, l_tax) * (count(*) - 1) as a12 from li),
    k as (select *, (v1 * v1 + v2 * v2) / (v1 * v1 * (n - 1) + v2 * v2 * (n - 1) + 2 * v1 * v2 * a12) as t from m),
    o as (select my - t * v1 / d1 * m1 - t * v2 / d2 * m2 as b0, t * v1 / d1 as b1, t * v2 / d2 as b2 from k)
    {_coef_rows('o', 'PLS')}""",
)
def pls_one_component(spark, sf):
    fit = linear.fit_linear(_li(spark, sf), _TWO, "y", "pls", {"n_components": 1}, name="PLS")
    return _fit_rows(spark, fit)


@query(
    "pls_full",
    f"with {B.LI_SQL}, o as ({B.sql_ols2('li', 'l_quantity', 'l_tax', 'y')}) {_coef_rows('o', 'PLS')}",
)
def pls_full(spark, sf):
    """With as many components as features, PLS is least squares."""
    fit = linear.fit_linear(_li(spark, sf), _TWO, "y", "pls", {"n_components": 2}, name="PLS")
    return _fit_rows(spark, fit)


_Z = 1.959963984540054
_T_SQL = f"({_Z} + ({_Z}**3 + {_Z}) / (4 * dof) + (5 * {_Z}**5 + 16 * {_Z}**3 + 3 * {_Z}) / (96 * dof * dof))"


@query(
    "ols_interval",
    f"""with {B.LI_SQL}, s as (select regr_slope(y, l_quantity) as b1, regr_intercept(y, l_quantity) as b0,
      count(*)::double - 2 as dof, count(*)::double as n, avg(l_quantity) as m, var_pop(l_quantity) * count(*) as sxx,
      var_pop(y) * count(*) * (1 - regr_r2(y, l_quantity)) / (count(*) - 2) as s2 from li),
    e as (select 'Intercept' as feature, b0 as coef, sqrt(s2 * (1 / n + m * m / sxx)) as se, dof from s
      union all select 'l_quantity', b1, sqrt(s2 / sxx), dof from s)
    select feature, {sql_rnd('coef')} as coef, {sql_rnd('se')} as std_error, {sql_rnd(f'coef - {_T_SQL} * se')} as lower,
      {sql_rnd(f'coef + {_T_SQL} * se')} as upper, sign(coef - {_T_SQL} * se) * sign(coef + {_T_SQL} * se) > 0 as signif from e""",
)
def ols_interval(spark, sf):
    out = linear.ols_inference(_li(spark, sf), ["l_quantity"], "y")
    return out.select(
        "feature", *[rnd(c).alias(c) for c in ("coef", "std_error", "lower", "upper")], "signif"
    )


@query(
    "coef_table",
    f"""with {B.LI_SQL}, o as ({B.sql_ols2('li', 'l_quantity', 'l_tax', 'y')}), r as ({B.sql_ols2('li', 'l_quantity', 'l_tax', 'y', ridge=100.0)})
    select 'Linear Regression' as model, 'l_quantity' as feature, {sql_rnd('b1')} as coef from o
    union all select 'Linear Regression', 'l_tax', {sql_rnd('b2')} from o
    union all select 'Ridge', 'l_quantity', {sql_rnd('b1')} from r union all select 'Ridge', 'l_tax', {sql_rnd('b2')} from r
    union all select 'Elastic Net', 'l_quantity', {sql_rnd('b1')} from o union all select 'Elastic Net', 'l_tax', {sql_rnd('b2')} from o
    union all select 'Lasso', 'l_quantity', {sql_rnd('b1')} from o union all select 'Lasso', 'l_tax', {sql_rnd('b2')} from o
    union all select 'PLS', 'l_quantity', {sql_rnd('b1')} from o union all select 'PLS', 'l_tax', {sql_rnd('b2')} from o""",
)
def coef_table(spark, sf):
    """The five linear models; without penalty all but ridge meet least squares."""
    li = _li(spark, sf)
    specs = {
        "Linear Regression": ("ols", {}),
        "Ridge": ("ridge", {"alpha": 100.0}),
        "Elastic Net": ("enet", {"alpha": 0.0, "l1_ratio": 0.5}),
        "Lasso": ("lasso", {"alpha": 0.0}),
        "PLS": ("pls", {"n_components": 2}),
    }
    m = linear.group_moments(li, _TWO, "y")[0]
    fits = []
    for name, (kind, params) in specs.items():
        b0, coef = linear.solve(kind, m, params)
        fits.append(linear.LinearFit(name, kind, _TWO, b0, [float(c) for c in coef], params))
    return linear.coef_table(spark, fits).withColumn("coef", rnd("coef"))


@query(
    "dual_target_fit",
    f"""with {B.LI_SQL}, low as (select min(l_discount) / 2 as low from lineitem where l_discount <> 0),
    t as (select l_quantity, case when l_discount = 0 then low else l_discount end as p from li, low)
    select 'p_value' as target_name, {sql_rnd('regr_slope(p, l_quantity)', 9)} as slope, {sql_rnd('regr_intercept(p, l_quantity)')} as intercept from t
    union all select '-log10_p', {sql_rnd('regr_slope(-log10(p), l_quantity)', 9)}, {sql_rnd('regr_intercept(-log10(p), l_quantity)')} from t""",
)
def dual_target_fit(spark, sf):
    """Both targets fitted from one scan."""
    fits = linear.fit_linear_targets(_two_targets(spark, sf), ["l_quantity"], ["p_value", "-log10_p"])
    rows = [(name, fit.coef[0], fit.intercept) for name, fit in fits.items()]
    table = spark.createDataFrame(rows, "target_name string, slope double, intercept double")
    return table.select("target_name", rnd("slope", 9).alias("slope"), rnd("intercept").alias("intercept"))


def _two_targets(spark, sf):
    from ..functions.scalars import neg_log10

    rows = clean.zero_floor(_li(spark, sf).select("row_key", "l_quantity", F.col("l_discount").alias("p_value")))
    return rows.withColumn("-log10_p", neg_log10("p_value"))


@query(
    "dual_target_stacked",
    f"""with {B.LI_SQL}, low as (select min(l_discount) / 2 as low from lineitem where l_discount <> 0),
    t as (select case when l_discount = 0 then low else l_discount end as p from li, low)
    select 'p_value' as target_name, count(*) as n, {sql_rnd('sum(p)', 4)} as total from t
    union all select '-log10_p', count(*), {sql_rnd('sum(-log10(p))', 4)} from t""",
)
def dual_target_stacked(spark, sf):
    """Every target in one long table."""
    both = clean.stack_targets(_two_targets(spark, sf), {"p_value": "p_value", "-log10_p": "-log10_p"})
    return both.groupBy("target_name").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("y"), 4).alias("total"))


@query("dual_target_cv")
def dual_target_cv(spark, sf):
    """Cross-validated ridge for both targets; the moments of all folds and targets come from one scan."""
    grid = [{"alpha": a} for a in (0.1, 10.0, 1000.0)]
    return linear.search_linear_targets(
        _two_targets(spark, sf), ["l_quantity"], ["p_value", "-log10_p"], "ridge", grid, ["row_key"], folds=5
    )[1]


# -- cross-validation with one feature: closed form in SQL --------------------------

_FOLD_SQL = f"""{B.LI_SQL}, fo as (select l_quantity as x, y,
    (cast('0x' || substr(md5(concat_ws(':', '1010', row_key)), 1, 8) as bigint) * 5) >> 32 as fold from li),
  sh as (select avg(x) as ax, avg(y) as ay from fo),
  fs as (select fold, count(*)::double as n, sum(x - ax) as sx, sum(y - ay) as sy, sum((x - ax) * (x - ax)) as xx,
      sum((x - ax) * (y - ay)) as xy, sum((y - ay) * (y - ay)) as yy from fo, sh group by fold),
  tr as (select a.fold, sum(b.n) as n, sum(b.sx) as sx, sum(b.sy) as sy, sum(b.xx) as xx, sum(b.xy) as xy, sum(b.yy) as yy
      from fs a join fs b on a.fold <> b.fold group by a.fold)"""


def _cv_sql(grid: str, slope: str, params: str, name: str) -> str:
    """Cross-validation table of a one-feature model whose slope is ``slope(cxx, cxy, n)``."""
    r2 = "1 - ({p}yy - 2 * c * {p}sy - 2 * b * {p}xy + {p}n * c * c + 2 * b * c * {p}sx + b * b * {p}xx) / ({p}yy - {p}sy * {p}sy / {p}n)"
    return f"""with {_FOLD_SQL}, gr as ({grid}),
    b as (select g.*, t.*, {slope} as b from (select *, xx - sx * sx / n as cxx, xy - sx * sy / n as cxy from tr) t, gr g),
    c as (select b.*, b.sy / b.n - b.b * b.sx / b.n as c, f.n as fn, f.sx as fsx, f.sy as fsy, f.xx as fxx, f.xy as fxy, f.yy as fyy
      from b join fs f using (fold)),
    sc as (select point, {params}, {r2.format(p='f')} as test, {r2.format(p='')} as train from c)
    select '{name}' as model, cast(point as int) as point, {params}, {sql_rnd('avg(test)')} as mean_test_score, {sql_rnd('stddev_pop(test)')} as std_test_score,
      {sql_rnd('avg(train)')} as mean_train_score, {sql_rnd('stddev_pop(train)')} as std_train_score,
      cast(rank() over (order by round(avg(test), 9) desc) as int) as rank_test_score from sc group by point, {params}"""


_ALPHAS = [0.001, 0.1, 10.0, 1000.0, 100000.0]
_RATIOS = [0.25, 0.75]


def _ranked(cv, params):
    scores = ["mean_test_score", "std_test_score", "mean_train_score", "std_train_score"]
    # ranked on nine digits, so that summation order cannot split a tie
    out = cv.select("model", "point", *params, *[rnd(c).alias(f"_{c}") for c in scores], rnd(scores[0], 9).alias(scores[0]))
    ranked = metrics.cv_rank(out)
    return ranked.select("model", "point", *params, *[F.col(f"_{c}").alias(c) for c in scores], "rank_test_score")


_ALPHA_GRID = " union all ".join(f"select {i} as point, {a}::double as param_alpha" for i, a in enumerate(_ALPHAS))
_SOFT = "sign(cxy) * greatest(abs(cxy) / n - {l1}, 0) / (cxx / n + {l2})"


@query("cv_table_ridge", _cv_sql(_ALPHA_GRID, "cxy / (cxx + param_alpha)", "param_alpha", "Ridge"))
def cv_table_ridge(spark, sf):
    _, cv = linear.search_linear(
        _li(spark, sf), ["l_quantity"], "y", "ridge", [{"alpha": a} for a in _ALPHAS], ["row_key"], folds=5, name="Ridge"
    )
    return _ranked(cv, ["param_alpha"])


@query("cv_table_lasso", _cv_sql(_ALPHA_GRID, _SOFT.format(l1="param_alpha", l2="0"), "param_alpha", "Lasso"))
def cv_table_lasso(spark, sf):
    _, cv = linear.search_linear(
        _li(spark, sf), ["l_quantity"], "y", "lasso", [{"alpha": a} for a in _ALPHAS], ["row_key"], folds=5, name="Lasso"
    )
    return _ranked(cv, ["param_alpha"])


_ENET_GRID = " union all ".join(
    f"select {i * len(_ALPHAS) + j} as point, {a}::double as param_alpha, {r}::double as param_l1_ratio"
    for i, r in enumerate(_RATIOS)
    for j, a in enumerate(_ALPHAS)
)


@query(
    "cv_table_enet",
    _cv_sql(
        _ENET_GRID,
        _SOFT.format(l1="param_alpha * param_l1_ratio", l2="param_alpha * (1 - param_l1_ratio)"),
        "param_alpha, param_l1_ratio",
        "Elastic Net",
    ),
)
def cv_table_enet(spark, sf):
    grid = [{"alpha": a, "l1_ratio": r} for r in _RATIOS for a in _ALPHAS]
    _, cv = linear.search_linear(
        _li(spark, sf), ["l_quantity"], "y", "enet", grid, ["row_key"], folds=5, name="Elastic Net"
    )
    return _ranked(cv, ["param_alpha", "param_l1_ratio"])


@query(
    "cv_rank",
    f"""with {B.LI_SQL}, c as (select l_linenumber as point, {sql_rnd('avg(l_discount)', 4)} as mean_test_score from li group by 1)
    select 'm' as model, point, mean_test_score, cast(rank() over (order by mean_test_score desc) as int) as rank_test_score from c""",
)
def cv_rank(spark, sf):
    table = _li(spark, sf).groupBy(F.col("l_linenumber").alias("point")).agg(
        rnd(F.avg("l_discount"), 4).alias("mean_test_score")
    )
    return metrics.cv_rank(table.withColumn("model", F.lit("m")), ordered="ascending")


@query(
    "test_r2",
    f"""with {B.ORD_SQL}, f as ({B.sql_ols2('(select * from od where not is_test)', 'f1', 'f2', 'y')})
    select 'Linear Regression' as model, {sql_rnd('1 - avg((y - b0 - b1 * f1 - b2 * f2) ** 2) / var_pop(y)')} as r2, count(*) as n_rows
    from od, f where is_test""",
)
def test_r2(spark, sf):
    rows = B.order_rows(spark, sf)
    fit = linear.fit_linear(rows.where(~F.col("is_test")), ["f1", "f2"], "y", name="Linear Regression")
    scored = fit.predict(rows.where("is_test")).withColumn("model", F.lit(fit.name))
    return metrics.r2_score(scored, "y").withColumn("r2", rnd("r2"))


_CHROM = [f"Chr{i}" for i in range(1, 8)]


def _wide(spark, sf):
    """Scaled numbers and chromosome indicators, written once: the design used for tuning."""
    from ..operators.features import prepare_features
    from ..session import materialise, spread

    li = _li(spark, sf).select("row_key", "Chromosome", "l_quantity", "l_tax", "l_discount", F.col("y").alias("p_value"))
    out = prepare_features(li, "p_value", key=["row_key"]).withColumnRenamed("p_value", "y")
    return materialise(spread(out, "row_key"), "design"), [c for c in out.columns if c not in ("row_key", "y")]


@query("lasso_cv")
def lasso_cv(spark, sf):
    """Full penalty grid, ten folds, scaled and one-hot features."""
    rows, names = _wide(spark, sf)
    return metrics.cv_rank(linear.search_linear(rows, names, "y", "lasso", key=["row_key"], name="Lasso")[1], ordered="ascending")


@query("ridge_cv")
def ridge_cv(spark, sf):
    rows, names = _wide(spark, sf)
    return metrics.cv_rank(linear.search_linear(rows, names, "y", "ridge", key=["row_key"], name="Ridge")[1], ordered="ascending")


@query("enet_cv")
def enet_cv(spark, sf):
    """Full grid of 697 points."""
    rows, names = _wide(spark, sf)
    return metrics.cv_rank(
        linear.search_linear(rows, names, "y", "enet", key=["row_key"], name="Elastic Net")[1], ordered="ascending"
    )


@query("pls_cv")
def pls_cv(spark, sf):
    rows, names = _wide(spark, sf)
    return metrics.cv_rank(linear.search_linear(rows, names, "y", "pls", key=["row_key"], name="PLS")[1], ordered="ascending")


_PENALTIES = [
    (kind, {"alpha": a} | ({"l1_ratio": 0.3} if kind == "enet" else {}))
    for kind in ("ridge", "lasso", "enet")
    for a in (0.001, 0.1, 10.0)
]


@query(
    "penalised_optimality",
    " union all ".join(
        f"select '{kind}' as kind, {params['alpha']}::double as alpha, true as optimal" for kind, params in _PENALTIES
    ),
)
def penalised_optimality(spark, sf):
    """Fits on the tuning design meet the conditions of an optimum, by the rows' own residuals."""
    rows, names = _wide(spark, sf)
    m = linear.group_moments(rows, names, "y")[0]
    fits = []
    for kind, params in _PENALTIES:
        b0, coef = linear.solve(kind, m, params)
        fits.append(linear.LinearFit(kind, kind, names, b0, [float(c) for c in coef], params))
    residuals = rows.select(*names, *[(F.col("y") - fit.column()).alias(f"_r{i}") for i, fit in enumerate(fits)])
    # covariances of features and residuals: the slopes of half the mean square
    slopes = residuals.agg(
        *[F.covar_pop(c, f"_r{i}").alias(f"_s{i}_{j}") for i in range(len(fits)) for j, c in enumerate(names)], F.count(F.lit(1)).alias("_n")
    ).first()
    out = []
    for i, fit in enumerate(fits):
        alpha, share = fit.params["alpha"], {"ridge": 0.0, "lasso": 1.0}.get(fit.kind, fit.params.get("l1_ratio"))
        weight = alpha / slopes["_n"] if fit.kind == "ridge" else alpha
        optimal = True
        for j, b in enumerate(fit.coef):
            slope = slopes[f"_s{i}_{j}"] - weight * (1 - share) * b
            bound = weight * share
            optimal &= abs(slope - bound * (1 if b > 0 else -1)) <= 1e-7 if b else abs(slope) <= bound + 1e-7
        out.append((fit.kind, float(alpha), bool(optimal)))
    return spark.createDataFrame(out, "kind string, alpha double, optimal boolean")


@query(
    "closed_form_predictions",
    f"""with {B.ORD_SQL}, tr as (select * from od where not is_test), o as ({B.sql_ols2('tr', 'f1', 'f2', 'y')}),
      r as ({B.sql_ols2('tr', 'f1', 'f2', 'y', ridge=10.0)})
    select o_orderkey, {sql_rnd('y', 8)} as truth, {sql_rnd('o.b0 + o.b1 * f1 + o.b2 * f2', 8)} as linear_regression,
      {sql_rnd('r.b0 + r.b1 * f1 + r.b2 * f2', 8)} as ridge from od, o, r where is_test""",
)
def closed_form_predictions(spark, sf):
    """The prediction columns that SQL can compute: least squares and ridge on the test rows."""
    rows = B.order_rows(spark, sf)
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    m = linear.group_moments(train, ["f1", "f2"], "y")[0]
    out = test.select("o_orderkey", rnd("y", 8).alias("truth"), "f1", "f2")
    for name, kind, params in (("linear_regression", "ols", {}), ("ridge", "ridge", {"alpha": 10.0})):
        b0, coef = linear.solve(kind, m, params)
        fit = linear.LinearFit(name, kind, ["f1", "f2"], b0, [float(c) for c in coef], params)
        out = out.withColumn(name, rnd(fit.column(), 8))
    return out.drop("f1", "f2")


_RF_POINT = {"n_estimators": 10, "max_features": "auto", "max_depth": 5, "min_samples_leaf": 0.01}


@query("rf_random_search")
def rf_random_search(spark, sf):
    """Ten points of the operator's own grid, five folds; all trees grow in shared scans."""
    _, table = forest.search_forest(B.order_rows(spark, sf), ["f1", "f2"], "y", ["o_orderkey"], n_iter=10, folds=5)
    return metrics.cv_rank(table, ordered="ascending")


@query(
    "forest_best_split",
    f"""with {B.LI_SQL}, s as (select l_quantity as x, count(*) as n, sum(y) as sy from li group by 1),
      c as (select x, sum(n) over w as ln, sum(sy) over w as ls, sum(n) over () as n, sum(sy) over () as sy from s window w as (order by x)),
      g as (select x, ln, n - ln as rn, ls / ln as lm, (sy - ls) / (n - ln) as rm from c where ln < n),
      b as (select *, ln * rn / (ln + rn) * (lm - rm) * (lm - rm) as gain from g order by gain desc, x limit 1)
    select x as threshold, {sql_rnd('gain', 4)} as gain, {sql_rnd('lm', 5)} as left_mean, {sql_rnd('rm', 5)} as right_mean,
      ln::double as left_rows, rn::double as right_rows from b""",
)
def forest_best_split(spark, sf):
    """One tree of one split on one feature, without bootstrap: the best of all cuts."""
    point = {"n_estimators": 1, "max_depth": 1, "bootstrap": False}
    tree = forest.fit_forest(_li(spark, sf), ["l_quantity"], "y", point, key=["row_key"]).trees[0]
    row = (tree["threshold"][0], tree["gain"][0], tree["value"][1], tree["value"][2], tree["weight"][1], tree["weight"][2])
    table = spark.createDataFrame([row], "threshold double, gain double, left_mean double, right_mean double, left_rows double, right_rows double")
    return table.withColumns({"gain": rnd("gain", 4), "left_mean": rnd("left_mean", 5), "right_mean": rnd("right_mean", 5)})


@query("rf_importances")
def rf_importances(spark, sf):
    rows = _li(spark, sf)
    return metrics.sort_importances(
        forest.forest_importances(rows, forest.fit_forest(rows, _THREE, "y", _RF_POINT)), ordered="ascending"
    )


@query("mlp_fit")
def mlp_fit(spark, sf):
    """Held-out R2 of a small network on scaled features."""
    from ..operators.features import scale_numeric

    rows = scale_numeric(B.order_rows(spark, sf), ["f1", "f2"])
    fit = perceptron.fit_perceptron(
        rows.where(~F.col("is_test")), ["f1", "f2"], "y", ["o_orderkey"],
        {"hidden_layer_sizes": (5,), "max_iter": 8},
    )
    scored = fit.predict(rows.where("is_test")).withColumn("model", F.lit(fit.name))
    return metrics.r2_score(scored, "y")


@query("mlp_random_search")
def mlp_random_search(spark, sf):
    """Ten points of the operator's own grid, five folds, up to their own number of epochs, in shared passes."""
    from ..operators.features import scale_numeric

    rows = scale_numeric(B.order_rows(spark, sf), ["f1", "f2"])
    _, table = perceptron.search_perceptron(rows, ["f1", "f2"], "y", ["o_orderkey"], n_iter=10, folds=5)
    return metrics.cv_rank(table, ordered="ascending")


@query(
    "mlp_least_squares",
    f"""with {B.ORD_SQL}, s as (select (f1 - avg(f1) over ()) / (stddev_pop(f1) over ()) as x, y from od)
    select {sql_rnd('regr_slope(y, x)', 6)} as slope, {sql_rnd('regr_intercept(y, x)', 6)} as intercept,
      true as slope_within_tolerance, true as intercept_within_tolerance from s""",
)
def mlp_least_squares(spark, sf):
    """An identity network without hidden layers comes within 0.1 of least squares."""
    from ..operators.features import scale_numeric

    rows = scale_numeric(B.order_rows(spark, sf), ["f1"])
    point = {"hidden_layer_sizes": (), "activation": "identity", "batch_size": 200, "max_iter": 200}
    w, b = perceptron.fit_perceptron(rows, ["f1"], "y", ["o_orderkey"], point).weights
    ols = linear.fit_linear(rows, ["f1"], "y")
    near = [abs(w - ols.coef[0]) < 0.1, abs(b - ols.intercept) < 0.1]
    table = spark.createDataFrame(
        [(float(ols.coef[0]), float(ols.intercept), *map(bool, near))],
        "slope double, intercept double, slope_within_tolerance boolean, intercept_within_tolerance boolean",
    )
    return table.withColumns({"slope": rnd("slope", 6), "intercept": rnd("intercept", 6)})


@query("all_predictions")
def all_predictions(spark, sf):
    """Test rows with one prediction column per model and the truth."""
    rows = B.order_rows(spark, sf)
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    m = linear.group_moments(train, ["f1", "f2"], "y")[0]
    fits = []
    for name, kind, params in (
        ("Linear Regression", "ols", {}), ("Lasso", "lasso", {"alpha": 0.01}), ("Ridge", "ridge", {"alpha": 10.0}),
        ("Elastic Net", "enet", {"alpha": 0.01, "l1_ratio": 0.5}), ("PLS", "pls", {"n_components": 1}),
    ):
        b0, coef = linear.solve(kind, m, params)
        fits.append(linear.LinearFit(name, kind, ["f1", "f2"], b0, [float(c) for c in coef], params))
    fits.append(forest.fit_forest(train, ["f1", "f2"], "y", _RF_POINT))
    fits.append(
        perceptron.fit_perceptron(
            train, ["f1", "f2"], "y", ["o_orderkey"], {"hidden_layer_sizes": (5,), "max_iter": 2}
        )
    )
    return linear.predict_all(test, fits, "y", keep=["o_orderkey"])


@query(
    "sorted_importance",
    f"""with {B.LI_SQL}, i as (select l_linenumber as feature_index, Chromosome as feature, {sql_rnd('avg(l_tax)', 9)} as importance from li group by 1, 2)
    select * from i order by importance desc, feature_index""",
)
def sorted_importance(spark, sf):
    table = _li(spark, sf).groupBy(
        F.col("l_linenumber").alias("feature_index"), F.col("Chromosome").alias("feature")
    ).agg(rnd(F.avg("l_tax"), 9).alias("importance"))
    return metrics.sort_importances(table, ordered="descending")
