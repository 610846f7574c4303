"""Queries: permutation tests, controls, importance, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forest, linear, metrics, perceptron
from ..operators import model_tests as M
from ..operators import permutation as P
from ..operators.sampling import subsample_members
from ..operators.skew import lookup_join
from ..session import scratch_path, spread
from ..sources.shards import ShardLedger
from . import base as B
from .base import rnd, sql_rnd
from .exploring import _noise_sql
from .registry import query

# -- corrections -----------------------------------------------------------------

_P_SQL = "ps as (select o_orderkey, o_orderpriority as model, round(exp(-o_totalprice / 90000.0::double) / 3.0::double, 4) as p_value from orders)"


def _p_rows(spark, sf):
    p = F.round(F.exp(-F.col("o_totalprice") / F.lit(90000.0)) / F.lit(3.0), 4)
    return B.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("model"), p.alias("p_value")
    )


@query(
    "bh_adjust",
    f"""with {_P_SQL}, a as ({B.sql_adjust('ps', 'model', 'o_orderkey, model')})
    select o_orderkey, model, p_value, {sql_rnd('p_adjusted', 9)} as p_adjusted, p_adjusted <= 0.05 as rejected from a""",
)
def bh_adjust(spark, sf):
    out = P.adjust_p_values(_p_rows(spark, sf), salt_by=["o_orderkey"])
    return out.withColumn("p_adjusted", rnd("p_adjusted", 9))


@query(
    "fisher_combine",
    """with p as (select l_orderkey, (l_discount + 0.001::double) / 1.2::double as p_value from lineitem),
    s as (select l_orderkey, count(*) as n_tests, -2 * sum(ln(p_value)) as statistic from p group by 1)
    select l_orderkey, n_tests, round(statistic, 6) + 0.0 as statistic,
      round(exp(-statistic / 2) * list_sum(list_transform(range(0, n_tests), lambda i: pow(statistic / 2, i) / gamma(i + 1))), 9) + 0.0 as p_combined from s""",
)
def fisher_combine(spark, sf):
    p = B.table(spark, sf, "lineitem").select(
        "l_orderkey", ((F.col("l_discount") + F.lit(0.001)) / F.lit(1.2)).alias("p_value")
    )
    out = P.fisher_combine(p, ["l_orderkey"])
    return out.select("l_orderkey", "n_tests", rnd("statistic").alias("statistic"), rnd("p_combined", 9).alias("p_combined"))


@query(
    "rank_pvalue",
    """with b as (select o_orderpriority, max(case when o_orderkey % 97 = 5 then o_totalprice end) as base from orders group by 1),
    s as (select o_orderpriority, o_totalprice as score, base * 0.9::double as baseline from orders join b using (o_orderpriority))
    select o_orderpriority, count(*) as n_repeats, round((1 + sum(cast(score >= baseline as int))) / (1 + count(*)), 9) as p_upper,
      round(sum(cast(score < baseline as int)) / (1 + count(*)), 9) as p_lower,
      round(case when sum(cast(score > baseline as int)) * 2 < 1 + count(*) then (1 + sum(cast(score >= baseline as int))) / (1 + count(*))
        else sum(cast(score < baseline as int)) / (1 + count(*)) end, 9) as p_two from s group by 1""",
)
def rank_pvalue(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    base = o.groupBy("o_orderpriority").agg(
        (F.max(F.when(F.col("o_orderkey") % 97 == 5, F.col("o_totalprice"))) * F.lit(0.9)).alias("baseline")
    )
    scores = lookup_join(o, base, ["o_orderpriority"]).withColumnRenamed("o_totalprice", "score")
    by = ["o_orderpriority"]
    up = P.rank_p_value(scores, by).select(*by, "n_repeats", rnd("p_value", 9).alias("p_upper"))
    low = P.rank_p_value(scores, by, "less").select(*by, rnd("p_value", 9).alias("p_lower"))
    two = P.rank_p_value(scores, by, one_tailed=False).select(*by, rnd("p_value", 9).alias("p_two"))
    return up.join(low, by).join(two, by)


# -- permutations ------------------------------------------------------------------


@query(
    "permute_groups",
    f"""with {B.sql_places('orders', 'o_orderstatus', 'o_orderkey', 9, 1, 2)}
    select f.o_orderkey, f.o_orderstatus, cast(t.repeat as int) as repeat, f.o_totalprice, t.o_totalprice as permuted
    from fixed f join turned t on f.o_orderstatus = t.o_orderstatus and f.place = t.place""",
)
def permute_groups(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return P.permute_column(o, "o_totalprice", ["o_orderkey"], ["o_orderstatus"], 2, seed=9)


_SAMPLES, _REPEATS, _SEED = 3, 19, 7
_TEST_SQL = f"""{B.ORD_SQL}, f as ({B.sql_ols2('(select * from od where not is_test)', 'f1', 'f2', 'y')}),
  te as (select od.*, b0 + b1 * f1 + b2 * f2 as pred, b1, b2 from od, f where is_test),
  {B.sql_draws(_SEED, _SAMPLES)}, {B.sql_members('te', 'o_orderkey', _SEED)}"""


def _fit(spark, sf):
    rows = spread(B.order_rows(spark, sf), "o_orderkey")
    fit = linear.fit_linear(rows.where(~F.col("is_test")), ["f1", "f2"], "y", name="Linear Regression")
    return fit, rows.where("is_test").select("o_orderkey", "f1", "f2", "y")


def _members(spark, sf):
    fit, test = _fit(spark, sf)
    rows = fit.predict(test, "pred")
    return fit, subsample_members(rows, ["o_orderkey"], _SAMPLES, 0.3, _SEED)


_LABEL_SQL = f"""{_TEST_SQL}, {B.sql_places('members', 'sample_id', 'o_orderkey', _SEED, 0, _REPEATS)},
  su as (select sample_id, sum(y * y) as yy, sum(y * pred) as yp, sum(pred * pred) as pp, var_pop(y) * count(*) as sst from members group by 1),
  pr as (select f.sample_id, t.repeat, sum(f.pred * t.y) as c from fixed f join turned t on f.sample_id = t.sample_id and f.place = t.place group by 1, 2),
  sc as (select pr.sample_id, pr.repeat, round(1 - (yy - 2 * yp + pp) / sst, 9) as tpr, round(1 - (yy - 2 * z.c + pp) / sst, 9) as fpr,
    round(1 - (yy - 2 * pr.c + pp) / sst, 9) as score
    from pr join su using (sample_id) join (select sample_id, c from pr where repeat = 0) z using (sample_id))"""


@query(
    "permuted_label_scores",
    f"with {_LABEL_SQL} select sample_id::int as sample_id, repeat::int as repeat, tpr + 0.0 as baseline, score + 0.0 as score from sc where repeat > 0",
)
def permuted_label_scores(spark, sf):
    _, members = _members(spark, sf)
    return P.label_scores(members, "y", "pred", ["o_orderkey"], n_repeats=_REPEATS, seed=_SEED)


_COLUMN_SQL = f"""{_TEST_SQL}, {B.sql_places('members', 'sample_id', 'o_orderkey', _SEED, 1, _REPEATS)},
  su as (select sample_id, sum((y - pred) ** 2) as sse, var_pop(y) * count(*) as sst,
    sum((y - pred + b1 * f1) ** 2) as uu1, sum((y - pred + b2 * f2) ** 2) as uu2, sum(f1 * f1) as xx1, sum(f2 * f2) as xx2,
    max(b1) as b1, max(b2) as b2 from members group by 1),
  pr as (select f.sample_id, t.repeat, sum((f.y - f.pred + f.b1 * f.f1) * t.f1) as c1, sum((f.y - f.pred + f.b2 * f.f2) * t.f2) as c2
    from fixed f join turned t on f.sample_id = t.sample_id and f.place = t.place group by 1, 2),
  sc as (select sample_id, 'f1' as feature, repeat, round(1 - sse / sst, 9) as baseline, round(1 - (uu1 - 2 * b1 * c1 + b1 * b1 * xx1) / sst, 9) as score from pr join su using (sample_id)
    union all select sample_id, 'f2', repeat, round(1 - sse / sst, 9), round(1 - (uu2 - 2 * b2 * c2 + b2 * b2 * xx2) / sst, 9) from pr join su using (sample_id)),
  pv as (select 'Linear Regression' as model, sample_id, feature, count(*) as n_repeats, max(baseline) as baseline,
    (1 + sum(cast(score >= baseline as int))) / (1 + count(*)) as p_value from sc group by 2, 3)"""


@query(
    "permuted_column_scores",
    f"with {_COLUMN_SQL} select sample_id::int as sample_id, feature, repeat::int as repeat, baseline + 0.0 as baseline, score + 0.0 as score from sc",
)
def permuted_column_scores(spark, sf):
    fit, members = _members(spark, sf)
    return P.column_scores(members, fit, "y", ["o_orderkey"], n_repeats=_REPEATS, seed=_SEED)


@query(
    "predicted_column_scores",
    f"with {_COLUMN_SQL} select sample_id::int as sample_id, feature, repeat::int as repeat, baseline + 0.0 as baseline, score + 0.0 as score from sc",
)
def predicted_column_scores(spark, sf):
    """The same scores by predicting every shuffled row, the path for trees and networks."""
    fit, members = _members(spark, sf)
    return P.model_column_scores(
        members, fit.predict, fit.features, "y", ["o_orderkey"], n_repeats=_REPEATS, seed=_SEED
    )


# -- controls --------------------------------------------------------------------------

_NEG_TESTS_SQL = f"""{_LABEL_SQL}, nt as (
    select 'Linear Regression' as model, 'tpr' as version, sample_id, count(*) as n_repeats, max(tpr) as baseline,
      (1 + sum(cast(score >= tpr as int))) / (1 + count(*)) as p_value from sc where repeat > 0 group by sample_id
    union all select 'Linear Regression', 'fpr', sample_id, count(*), max(fpr),
      (1 + sum(cast(score >= fpr as int))) / (1 + count(*)) from sc where repeat > 0 group by sample_id)"""


def _negative(spark, sf):
    fit, test = _fit(spark, sf)
    return P.negative_control_tests(
        fit.predict(test, "pred"), {fit.name: "pred"}, "y", ["o_orderkey"],
        n_samples=_SAMPLES, n_repeats=_REPEATS, seed=_SEED,
    )


@query(
    "validate_sample",
    f"with {_NEG_TESTS_SQL} select model, version, sample_id::int as sample_id, n_repeats, baseline + 0.0 as baseline, {sql_rnd('p_value', 9)} as p_value from nt",
)
def validate_sample(spark, sf):
    out = _negative(spark, sf)
    return out.withColumn("p_value", rnd("p_value", 9))


@query(
    "negative_control",
    f"""with {_NEG_TESTS_SQL}, adj as ({B.sql_adjust('nt', 'model, version', 'model, version, sample_id')})
    select model, version, {sql_rnd('avg(cast(p_adjusted <= 0.05 as int))', 9)} as rate, count(*) as n_tests, 0::bigint as n_failed from adj group by model, version""",
)
def negative_control(spark, sf):
    return P.control_rates(_negative(spark, sf), ["model", "version"]).withColumn("rate", rnd("rate", 9))


_SIGMAS = [0.0, 1.0, 25.0]
_SIGMA_LIST = ", ".join(f"{s}::double" for s in _SIGMAS)
_POS_SQL = f"""{B.ORD_SQL}, te as (select * from od where is_test), {B.sql_draws(_SEED, _SAMPLES)}, {B.sql_members('te', 'o_orderkey', _SEED)},
  mc as (select members.*, unnest([{_SIGMA_LIST}]) as sigma from members),
  cc as (select *, y + sigma * ({_noise_sql(f'{_SEED}:noise', 'sample_id, o_orderkey')}) as ctl from mc),
  fi as ({B.sql_ols2('cc', 'f1', 'ctl', 'y', 'sample_id, sigma')}),
  uu as (select cc.*, y - b0 - b1 * f1 as u, b2 from cc join fi using (sample_id, sigma)),
  {B.sql_places('uu', 'sample_id', 'o_orderkey', _SEED, 1, _REPEATS, 'sigma, ')},
  su as (select sigma, sample_id, sum(u * u) as suu, sum(u * ctl) as suc, sum(ctl * ctl) as scc, max(b2) as b, var_pop(y) * count(*) as sst from uu group by 1, 2),
  pr as (select f.sigma, f.sample_id, t.repeat, sum(f.u * t.ctl) as c from fixed f join turned t
    on f.sigma = t.sigma and f.sample_id = t.sample_id and f.place = t.place group by 1, 2, 3),
  sc as (select sigma, sample_id, repeat, round(1 - (suu - 2 * b * suc + b * b * scc) / sst, 9) as baseline,
    round(1 - (suu - 2 * b * c + b * b * scc) / sst, 9) as score from pr join su using (sigma, sample_id)),
  pt as (select 'Linear Regression' as model, sigma, sample_id, count(*) as n_repeats, max(baseline) as baseline,
    (1 + sum(cast(score >= baseline as int))) / (1 + count(*)) as p_value from sc group by 2, 3)"""


def _positive(spark, sf):
    test = B.order_rows(spark, sf).where("is_test").select("o_orderkey", "f1", "y")
    return P.positive_control_tests(
        test, {"Linear Regression": ("ols", {})}, ["f1"], "y", ["o_orderkey"], _SIGMAS,
        n_samples=_SAMPLES, n_repeats=_REPEATS, seed=_SEED,
    )


@query(
    "positive_control_tests",
    f"with {_POS_SQL} select model, sigma, sample_id::int as sample_id, n_repeats, baseline + 0.0 as baseline, {sql_rnd('p_value', 9)} as p_value from pt",
)
def positive_control_tests(spark, sf):
    out = _positive(spark, sf)
    return out.withColumn("p_value", rnd("p_value", 9))


_POS_RATES_SQL = f"""{_POS_SQL}, adj as ({B.sql_adjust('pt', 'model, sigma', 'model, sigma, sample_id')}),
    rt as (select model, sigma, avg(cast(p_adjusted <= 0.05 as int)) as rate, count(*) as n_tests, 0::bigint as n_failed from adj group by model, sigma)"""


@query(
    "positive_control",
    f"with {_POS_RATES_SQL} select model, sigma, {sql_rnd('rate', 9)} as rate, n_tests, n_failed from rt",
)
def positive_control(spark, sf):
    return P.control_rates(_positive(spark, sf), ["model", "sigma"]).withColumn("rate", rnd("rate", 9))


@query(
    "rate_by_noise",
    f"with {_POS_RATES_SQL} select model, "
    + ", ".join(f"{sql_rnd(f'max(case when sigma = {s} then rate end)', 9)} as \"{s}\"" for s in _SIGMAS)
    + " from rt group by model",
)
def rate_by_noise(spark, sf):
    table = metrics.rate_table(P.control_rates(_positive(spark, sf), ["model", "sigma"]), "sigma", _SIGMAS)
    return table.select("model", *[rnd(F.col(f"`{s}`"), 9).alias(f"{s}") for s in _SIGMAS])


@query(
    "rejection_rate",
    f"""with {_P_SQL}, a as ({B.sql_adjust('ps', 'model', 'o_orderkey, model')})
    select model, {sql_rnd('avg(cast(p_adjusted <= 0.02 as int))', 9)} as rate, count(*) as n_tests, 0::bigint as n_failed from a group by model""",
)
def rejection_rate(spark, sf):
    tests = P.adjust_p_values(_p_rows(spark, sf), alpha=0.02, salt_by=["o_orderkey"])
    return metrics.rejection_rate(tests).withColumn("rate", rnd("rate", 9))


@query("guarded_samples")
def guarded_samples(spark, sf):
    """A refit per sample for models without closed form; failures become rows with a reason."""
    rows = subsample_members(B.order_rows(spark, sf).where("is_test"), ["o_orderkey"], 2, 0.3, _SEED)

    def run(i):
        if i > 2:
            raise ValueError("no such sample")
        part = rows.where(F.col("sample_id") == i)
        fit = forest.fit_forest(part, ["f1", "f2"], "y", {"n_estimators": 3, "max_depth": 3})
        return metrics.r2_score(fit.predict(part), "y", group=[]).select("r2")

    return P.guarded_samples(run, [1, 2, 3], "r2 double")


# -- importance ---------------------------------------------------------------------------


@query(
    "permutation_importance",
    f"with {_COLUMN_SQL} select sample_id::int as sample_id, feature, n_repeats, baseline + 0.0 as baseline, {sql_rnd('p_value', 9)} as p_value from pv",
)
def permutation_importance(spark, sf):
    fit, members = _members(spark, sf)
    out = P.permutation_importance(members, fit, "y", ["o_orderkey"], n_repeats=_REPEATS, seed=_SEED)
    return out.withColumn("p_value", rnd("p_value", 9))


@query(
    "importance_shard",
    f"with {_COLUMN_SQL} select model, sample_id::int as sample_id, feature, n_repeats, {sql_rnd('p_value', 9)} as p_value from pv where sample_id = 2",
)
def importance_shard(spark, sf):
    fit, test = _fit(spark, sf)
    out = P.importance_shards(
        test, fit, "y", ["o_orderkey"], n_samples=_SAMPLES, n_repeats=_REPEATS, seed=_SEED, sample_id=2
    )
    return out.select("model", "sample_id", "feature", "n_repeats", rnd("p_value", 9).alias("p_value"))


_FISHER_SQL = f"""cb as (select model, feature, n, st, exp(-st / 2) * list_sum(list_transform(range(0, n), lambda i: pow(st / 2, i) / gamma(i + 1))) as p_value
    from (select model, feature, count(*) as n, -2 * sum(ln(p_value)) as st from pv group by 1, 2)),
  ca as ({B.sql_adjust('cb', 'model', 'model, feature, n, st')})"""
_IMPORTANCE_OUT = f"""select model, feature, n as n_tests, {sql_rnd('st')} as statistic, {sql_rnd('p_value', 9)} as p_combined,
    {sql_rnd('p_adjusted', 9)} as p_adjusted, p_adjusted <= 0.05 as rejected from ca"""


def _importance_table(out):
    return out.select(
        "model", "feature", "n_tests", rnd("statistic").alias("statistic"), rnd("p_combined", 9).alias("p_combined"),
        rnd("p_adjusted", 9).alias("p_adjusted"), "rejected",
    )


@query("combined_importance", f"with {_COLUMN_SQL}, {_FISHER_SQL} {_IMPORTANCE_OUT}")
def combined_importance(spark, sf):
    fit, test = _fit(spark, sf)
    return _importance_table(
        P.combined_importance(
            test, fit, "y", ["o_orderkey"], n_samples=_SAMPLES, n_repeats=_REPEATS, seed=_SEED
        )
    )


_SHARD_SQL = """pv as (select 'Random Forest' as model, 'shard' || l_linenumber as sample_id, l_returnflag as feature,
    avg(l_discount) * 4 - 0.15::double as p_value from lineitem group by 2, 3)"""


@query("merge_shards", f"with {_SHARD_SQL}, {_FISHER_SQL} {_IMPORTANCE_OUT}")
def merge_shards(spark, sf):
    """Shard columns of one model, combined over shards and corrected over features."""
    shards = (
        B.table(spark, sf, "lineitem")
        .groupBy(F.concat(F.lit("shard"), F.col("l_linenumber")).alias("sample_id"), F.col("l_returnflag").alias("feature"))
        .agg((F.avg("l_discount") * 4 - F.lit(0.15)).alias("p_value"))
        .withColumn("model", F.lit("Random Forest"))
    )
    return _importance_table(P.merge_shards(shards))


# -- any model ------------------------------------------------------------------------------


def _general(spark, sf, model, test):
    tests = M.importance_tests(test, model, "y", ["o_orderkey"], _SAMPLES, _REPEATS, seed=_SEED)
    return _importance_table(P.merge_shards(tests))


@query("importance_any_linear", f"with {_COLUMN_SQL}, {_FISHER_SQL} {_IMPORTANCE_OUT}")
def importance_any_linear(spark, sf):
    """The linear model on the path for any model: the rows of ``combined_importance``."""
    fit, test = _fit(spark, sf)
    return _general(spark, sf, fit, test)


def _split(spark, sf):
    rows = spread(B.order_rows(spark, sf), "o_orderkey")
    return rows.where(~F.col("is_test")), rows.where("is_test").select("o_orderkey", "f1", "f2", "y")


_FOREST = {"n_estimators": 100, "max_depth": 25, "min_samples_split": 0.01, "min_samples_leaf": 0.01}
_NETWORK = {"hidden_layer_sizes": (10,), "activation": "relu", "batch_size": 200, "max_iter": 200}


@query("importance_forest")
def importance_forest(spark, sf):
    """``f1`` moves the label, ``f2`` does not."""
    train, test = _split(spark, sf)
    return _general(spark, sf, forest.fit_forest(train, ["f1", "f2"], "y", _FOREST, key=["o_orderkey"]), test)


@query("importance_mlp")
def importance_mlp(spark, sf):
    train, test = _split(spark, sf)
    return _general(spark, sf, perceptron.fit_perceptron(train, ["f1", "f2"], "y", ["o_orderkey"], _NETWORK), test)


@query(
    "importance_ignored_feature",
    f"""with {_TEST_SQL} select 'Random Forest' as model, sample_id::int as sample_id, 'f2' as feature,
      {_REPEATS}::bigint as n_repeats, 1.0::double as p_value from members group by sample_id""",
)
def importance_ignored_feature(spark, sf):
    """A forest that never saw ``f2`` keeps its score however ``f2`` is shuffled: p is 1."""
    train, test = _split(spark, sf)
    fit = forest.fit_forest(train.withColumn("f2", F.lit(0.0)), ["f1", "f2"], "y", _FOREST, key=["o_orderkey"])
    tests = M.importance_tests(test, fit, "y", ["o_orderkey"], _SAMPLES, _REPEATS, seed=_SEED)
    return tests.where("feature = 'f2'").select("model", "sample_id", "feature", "n_repeats", "p_value")


_MAE_SQL = f"""{_TEST_SQL}, {B.sql_places('members', 'sample_id', 'o_orderkey', _SEED, 1, _REPEATS)},
  sc as (select f.sample_id, t.repeat, avg(abs(f.y - f.pred)) as baseline, avg(abs(t.y - f.pred)) as score
    from fixed f join turned t on f.sample_id = t.sample_id and f.place = t.place group by 1, 2)"""


@query(
    "permuted_label_scores_mae",
    f"with {_MAE_SQL} select sample_id::int as sample_id, repeat::int as repeat, {sql_rnd('round(baseline, 9)', 6)} as baseline, {sql_rnd('round(score, 9)', 6)} as score from sc",
)
def permuted_label_scores_mae(spark, sf):
    """Label permutation under another metric than R2."""
    fit, test = _fit(spark, sf)
    members = subsample_members(test, ["o_orderkey"], _SAMPLES, 0.3, _SEED)
    out = M.shuffled_scores(members, fit, "y", ["o_orderkey"], shuffled=["y"], n_repeats=_REPEATS, seed=_SEED, metric="mae")
    return out.select("sample_id", "repeat", rnd("baseline", 6).alias("baseline"), rnd("score", 6).alias("score"))


@query("positive_control_forest")
def positive_control_forest(spark, sf):
    """All samples' refits are one training a noise level."""
    _, test = _split(spark, sf)
    return M.positive_control(
        test, "forest", _FOREST, ["f1", "f2"], "y", ["o_orderkey"], (0.0, 25.0), _SAMPLES, _REPEATS, seed=_SEED
    )


@query("positive_control_mlp")
def positive_control_mlp(spark, sf):
    _, test = _split(spark, sf)
    return M.positive_control(
        test, "perceptron", _NETWORK, ["f1", "f2"], "y", ["o_orderkey"], (0.0, 25.0), _SAMPLES, _REPEATS, seed=_SEED
    )


_DEGENERATE_SQL = f"""{_MAE_SQL}, pv as (select sample_id, count(*) as n_repeats, max(baseline) as baseline,
    (1 + sum(cast(round(score, 9) <= round(baseline, 9) as int))) / (1 + count(*)) as p_value from sc group by 1)"""


@query(
    "negative_control_degenerate",
    f"""with {_DEGENERATE_SQL}
    select sample_id::int as sample_id, case when sample_id = 2 then 0 else n_repeats end as n_repeats,
      case when sample_id <> 2 then {sql_rnd('p_value', 9)} end as p_value,
      case when sample_id = 2 then 'ValueError: singular sample' end as reason,
      1::bigint as n_failed from pv""",
)
def negative_control_degenerate(spark, sf):
    """A sample whose model could not be fitted is a row with its reason and leaves the others alone."""
    fit, test = _fit(spark, sf)
    members = subsample_members(test, ["o_orderkey"], _SAMPLES, 0.3, _SEED)
    models = {i: fit if i != 2 else "singular sample" for i in range(1, _SAMPLES + 1)}
    scores = M.shuffled_scores(
        members, models, "y", ["o_orderkey"], shuffled=["y"], n_repeats=_REPEATS, seed=_SEED, metric="mae"
    )
    tests = M.tests_of(scores, ["sample_id"], "mae")
    failed = tests.agg(F.count("reason").alias("n_failed"))
    return tests.crossJoin(F.broadcast(failed)).select(  # one row
        "sample_id", "n_repeats", rnd("p_value", 9).alias("p_value"), "reason", "n_failed"
    )


@query(
    "importance_resumed",
    f"with {_COLUMN_SQL} select sample_id::int as sample_id, feature, n_repeats, {sql_rnd('p_value', 9)} as p_value, 0::bigint as n_absent from pv",
)
def importance_resumed(spark, sf):
    """Two partial runs and a rerun give what one whole run gives; finished samples are not computed again."""
    fit, test = _fit(spark, sf)
    ledger = ShardLedger(spark, scratch_path(spark, "shards"))

    def compute(ids):
        return M.importance_tests(test, fit, "y", ["o_orderkey"], _SAMPLES, _REPEATS, seed=_SEED, sample_ids=ids)

    for ids in ([2], list(range(1, _SAMPLES + 1)), [1, 2]):
        ledger.run(compute, ids)
    rows, absent = ledger.read(list(range(1, _SAMPLES + 1)))
    return rows.select(
        "sample_id", "feature", "n_repeats", rnd("p_value", 9).alias("p_value"), F.lit(len(absent)).cast("long").alias("n_absent")
    )


@query(
    "permute_groups_null",
    f"""with {B.sql_places("(select * replace (nullif(o_orderstatus, 'F') as o_orderstatus) from orders)", 'o_orderstatus', 'o_orderkey', 9, 1, 2)}
    select f.o_orderkey, f.o_orderstatus, cast(t.repeat as int) as repeat, f.o_totalprice, t.o_totalprice as permuted
    from fixed f join turned t on f.o_orderstatus is not distinct from t.o_orderstatus and f.place = t.place""",
)
def permute_groups_null(spark, sf):
    """A missing group is a group."""
    o = B.table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"), "o_totalprice")
    return P.permute_column(o, "o_totalprice", ["o_orderkey"], ["o_orderstatus"], 2, seed=9)
