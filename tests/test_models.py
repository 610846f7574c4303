"""Models, resampling tests and controls."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from traitspark.functions.hashing import place_order, place_steps
from traitspark.operators import forest, linear, moments, perceptron
from traitspark.operators import permutation as P
from traitspark.operators.sampling import subsample_members
from traitspark.sources import models as store

FEATURES = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1, 10, 0.1] + [5, 1000, 0]
    y = 2 * x[:, 0] - 0.3 * x[:, 1] + rng.normal(size=400)
    pdf = pd.DataFrame(x, columns=FEATURES).assign(y=y, id=range(400))
    return pdf, spark.createDataFrame(pdf).persist()


def _centred(pdf):
    x, y = pdf[FEATURES].to_numpy(), pdf["y"].to_numpy()
    return x - x.mean(0), y - y.mean(), x, y


def test_least_squares_ridge(data):
    pdf, df = data
    xc, yc, x, y = _centred(pdf)
    fit = linear.fit_linear(df, FEATURES, "y")
    np.testing.assert_allclose(fit.coef, np.linalg.lstsq(xc, yc, rcond=None)[0], rtol=1e-8)
    assert fit.intercept == pytest.approx(y.mean() - x.mean(0) @ np.array(fit.coef))
    ridge = linear.fit_linear(df, FEATURES, "y", "ridge", {"alpha": 50.0})
    np.testing.assert_allclose(ridge.coef, np.linalg.solve(xc.T @ xc + 50 * np.eye(3), xc.T @ yc), rtol=1e-8)


def test_lasso_matches_the_built_in_learner(data):
    pdf, df = data
    fit = linear.fit_linear(df, FEATURES, "y", "lasso", {"alpha": 0.3})
    built_in = LinearRegression(
        featuresCol="v", labelCol="y", regParam=0.3, elasticNetParam=1.0, standardization=False, tol=1e-12, maxIter=1000
    ).fit(VectorAssembler(inputCols=FEATURES, outputCol="v").transform(df))
    np.testing.assert_allclose(fit.coef, built_in.coefficients.toArray(), atol=1e-4)


@pytest.mark.parametrize("l1", [0.0, 0.25, 0.9])
@pytest.mark.parametrize("alpha", [0.01, 0.5, 30.0])
def test_elastic_net_is_optimal(data, alpha, l1):
    """The subgradient of the objective vanishes at the solution."""
    pdf, df = data
    xc, yc, *_ = _centred(pdf)
    b = np.array(linear.fit_linear(df, FEATURES, "y", "enet", {"alpha": alpha, "l1_ratio": l1}).coef)
    slope = xc.T @ (yc - xc @ b) / len(yc) - alpha * (1 - l1) * b
    scale = np.abs(xc.T @ yc / len(yc)).max()
    on = b != 0
    np.testing.assert_allclose(slope[on], alpha * l1 * np.sign(b[on]), atol=1e-6 * scale)
    assert (np.abs(slope[~on]) <= alpha * l1 + 1e-6 * scale).all()


def test_pls_components(data):
    pdf, df = data
    xc, yc, *_ = _centred(pdf)
    full = linear.fit_linear(df, FEATURES, "y", "pls", {"n_components": 3})
    np.testing.assert_allclose(full.coef, np.linalg.lstsq(xc, yc, rcond=None)[0], rtol=1e-6)
    # two components by deflation
    sd = xc.std(0, ddof=1)
    e, f, w_all, p_all, q_all = xc / sd, yc.copy(), [], [], []
    for _ in range(2):
        w = e.T @ f
        w /= np.linalg.norm(w)
        t = e @ w
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        w_all.append(w), p_all.append(p), q_all.append(q)
    w, p = np.array(w_all).T, np.array(p_all).T
    want = w @ np.linalg.inv(p.T @ w) @ np.array(q_all) / sd
    np.testing.assert_allclose(linear.fit_linear(df, FEATURES, "y", "pls", {"n_components": 2}).coef, want, rtol=1e-8)


def test_collinear_columns_get_the_shortest_solution(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2, 200)
    pdf = pd.DataFrame({"u": a, "v": 1 - a, "y": 3.0 * a + rng.normal(size=200)})
    fit = linear.fit_linear(spark.createDataFrame(pdf), ["u", "v"], "y")
    assert fit.coef[0] == pytest.approx(-fit.coef[1])


def test_moments_paths_agree_and_add_up(data, monkeypatch):
    _, df = data
    folded = df.withColumn("fold", (F.col("id") % 4).cast("int"))
    sql = moments.group_moments(folded, FEATURES, "y", "fold")
    monkeypatch.setattr(moments, "SQL_COLUMNS", 1)
    arrow = moments.group_moments(folded, FEATURES, "y", "fold")
    whole = moments.group_moments(df, FEATURES, "y")[0]
    total = None
    for k in sql:
        np.testing.assert_allclose(sql[k].gram, arrow[k].gram, rtol=1e-9, atol=1e-8)
        total = sql[k] if total is None else total + sql[k]
    np.testing.assert_allclose(total.gram, whole.gram, rtol=1e-9, atol=1e-8)


def test_inference(data):
    pdf, df = data
    _, _, x, y = _centred(pdf)
    d = np.column_stack([np.ones(len(x)), x])
    b = np.linalg.lstsq(d, y, rcond=None)[0]
    s2 = ((y - d @ b) ** 2).sum() / (len(y) - 4)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(d.T @ d)))
    got = linear.ols_inference(df, FEATURES, "y").toPandas().set_index("feature")
    np.testing.assert_allclose(got["std_error"], se, rtol=1e-6)
    assert got.loc["x1", "signif"] and got.loc["x2", "signif"]
    assert (got["signif"] == (np.sign(got["lower"]) * np.sign(got["upper"]) > 0)).all()


@pytest.mark.parametrize("kind,grid", [
    ("lasso", [{"alpha": a} for a in (1e-3, 1.0, 100.0)]),
    ("enet", [{"alpha": a, "l1_ratio": r} for r in (0.2, 0.8) for a in (1e-3, 1.0)]),
    ("pls", [{"n_components": k} for k in (1, 2, 3)]),
])
def test_search_scores_by_refitting(data, kind, grid, monkeypatch):
    pdf, df = data
    folded = df.withColumn("fold", (F.col("id") % 3).cast("int"))
    best, cv = linear.search_linear(folded, FEATURES, "y", kind, grid, fold_column="fold")
    rows = {r["point"]: r for r in cv.collect()}
    for i, params in enumerate(grid):
        scores = []
        for k in range(3):
            fit = linear.fit_linear(folded.where(F.col("fold") != k), FEATURES, "y", kind, params)
            part = pdf[pdf["id"] % 3 == k]
            e = part["y"] - fit.intercept - part[FEATURES].to_numpy() @ np.array(fit.coef)
            scores.append(1 - (e**2).sum() / ((part["y"] - part["y"].mean()) ** 2).sum())
        assert rows[i]["mean_test_score"] == pytest.approx(np.mean(scores), abs=1e-6)
        assert rows[i]["std_test_score"] == pytest.approx(np.std(scores), abs=1e-6)
    assert best.params == grid[max(rows, key=lambda i: (rows[i]["mean_test_score"], -i))]
    monkeypatch.setattr(linear, "LOCAL_SOLVES", 0)  # as Spark tasks
    _, spread = linear.search_linear(folded, FEATURES, "y", kind, grid, fold_column="fold")
    for r in spread.collect():
        assert r["mean_test_score"] == pytest.approx(rows[r["point"]]["mean_test_score"], abs=1e-9)


def test_stability_refits_the_drawn_rows(data):
    pdf, df = data
    coefs = linear.coef_stability(df, {"OLS": ("ols", {}), "PLS": ("pls", {"n_components": 3})}, FEATURES, "y", ["id"], 4, 0.4, seed=9)
    members = subsample_members(df, ["id"], 4, 0.4, 9).toPandas()
    got = coefs.toPandas()
    assert len(got) == 2 * 4 * 3
    for i, part in members.groupby("sample_id"):
        xc, yc, *_ = _centred(part)
        want = np.linalg.lstsq(xc, yc, rcond=None)[0]
        for model in ("OLS", "PLS"):
            mine = got[(got["iteration"] == i) & (got["model"] == model)].set_index("feature").loc[FEATURES, "coef"]
            np.testing.assert_allclose(mine, want, rtol=1e-5)


def test_forest_and_store(spark, data, tmp_path):
    _, df = data
    fit = forest.fit_forest(df, FEATURES, "y", {"n_estimators": 4, "max_features": "auto", "max_depth": 250, "min_samples_leaf": 0.05})
    imp = forest.forest_importances(df, fit).toPandas()
    assert imp["importance"].sum() == pytest.approx(1.0) and imp["importance"].idxmax() == 1
    ols = linear.fit_linear(df, FEATURES, "y", name="Linear Regression")
    net = perceptron.PerceptronFit("MLP", FEATURES, [3, 2, 1], [0.1] * 11, {"activation": "relu"})
    store.save_models(spark, str(tmp_path), [ols, fit, net])
    back = store.load_models(spark, str(tmp_path))
    assert list(back) == ["Linear Regression", "Random Forest", "MLP"]
    for a, b in ((ols, back["Linear Regression"]), (fit, back["Random Forest"]), (net, back["MLP"])):
        x, y = a.predict(df).select("prediction"), b.predict(df).select("prediction")
        np.testing.assert_allclose(x.toPandas(), y.toPandas())
    untrained = store.load_models(spark, str(tmp_path), fitted=False)
    assert untrained["Linear Regression"].fit(df, FEATURES, "y").coef == pytest.approx(ols.coef)
    assert untrained["Random Forest"].params["max_depth"] == 250
    again = untrained["Random Forest"].fit(df, FEATURES, "y")
    np.testing.assert_allclose(again.predict(df).select("prediction").toPandas(), fit.predict(df).select("prediction").toPandas())
    short = perceptron.UntrainedPerceptron("MLP", {"hidden_layer_sizes": (2,), "max_iter": 2})
    assert len(short.fit(df, FEATURES, "y", ["id"]).weights) == 11


def test_grid_sizes():
    assert len(forest.draw_points(forest.GRID, 10**9)) == 960
    assert len(forest.draw_points(perceptron.GRID, 10**9)) == 155 * 2 * 3 * 3 * 2
    some = forest.draw_points(forest.GRID, 20, seed=1)
    assert len({str(p) for p in some}) == 20 and some == forest.draw_points(forest.GRID, 20, seed=1)
    assert len(linear.default_grid("enet")) == 697 and len(linear.default_grid("pls", 9)) == 9


def test_network_gradient_and_fit(spark):
    rng = np.random.default_rng(0)
    sizes = [2, 3, 1]
    flat = perceptron._start(sizes, "relu", 3)
    x, y = rng.normal(size=(20, 2)), rng.normal(size=20)

    def loss(w):
        e = perceptron._predict_flat(x, w, sizes, "relu") - y
        weights = np.concatenate([a.ravel() for a, _ in perceptron._unpack(w, sizes)])
        return (e @ e) / (2 * len(y)) + perceptron.L2 * (weights @ weights) / (2 * len(y))

    grad = perceptron._gradient(x, y, flat, sizes, "relu")
    for j in range(len(flat)):
        h = np.zeros_like(flat)
        h[j] = 1e-6
        assert grad[j] == pytest.approx((loss(flat + h) - loss(flat - h)) / 2e-6, abs=1e-6)
    x = rng.normal(size=(3000, 2))
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": x[:, 0] - 0.5 * x[:, 1], "id": range(3000)})
    df = spark.createDataFrame(pdf)
    fit = perceptron.fit_perceptron(df, ["a", "b"], "y", ["id"], {"hidden_layer_sizes": (4,), "activation": "identity", "batch_size": 50, "max_iter": 12})
    e = fit.predict(df).toPandas()
    assert 1 - ((e["y"] - e["prediction"]) ** 2).mean() / e["y"].var() > 0.8


# -- permutations --------------------------------------------------------------------------


def test_sort_key_is_the_same_on_columns_and_arrays(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"h": rng.integers(0, 2**31 - 1, 300), "t": rng.integers(0, 2**32, 300), "g": rng.integers(0, 2**31 - 1, 300)})
    df = spark.createDataFrame(pdf)
    for name, step in place_steps("h", "t", "g", F.lit(5)):
        df = df.withColumn(name, step)
    want = place_order(pdf["h"].to_numpy(), pdf["t"].to_numpy(), pdf["g"].to_numpy(), 5)
    assert df.toPandas()["_order"].tolist() == want.tolist()


def test_permutation_keeps_the_values_of_a_group(data):
    _, df = data
    out = P.permute_column(df.withColumn("g", F.col("id") % 3).select("id", "g", "y"), "y", ["id"], ["g"], 2, seed=1).toPandas()
    assert len(out) == 800
    for _, part in out.groupby(["g", "repeat"]):
        assert sorted(part["y"]) == sorted(part["permuted"])
        assert (part["y"] != part["permuted"]).mean() > 0.9


def test_products_by_array_and_by_rank_agree(data):
    _, df = data
    rows = df.withColumn("g", (F.col("id") % 3).cast("int"))
    args = (rows, ["x1", "x2"], ["y", "y"], ["id"], ["g"], 6)
    a = P.permutation_products(*args, seed=4, first=0).toPandas().sort_values(["g", "repeat"])
    b = P.permutation_products(*args, seed=4, first=0, block_rows=0).toPandas().sort_values(["g", "repeat"])
    assert len(a) == 21
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9)


def test_permutations_look_uniform(spark):
    """Place of one row over many repeats is spread evenly; two rows are not tied together."""
    rng = np.random.default_rng(1)
    h, t = rng.integers(0, 2**31 - 1, 50), rng.integers(0, 2**32, 50)
    g = np.full(50, 12345)
    places = np.array([np.argsort(np.argsort(place_order(h, t, g, r))) for r in range(1, 4001)])
    counts = np.bincount(places[:, 0], minlength=50)
    assert ((counts - 80) ** 2 / 80).sum() < 100  # 49 degrees of freedom
    assert abs(np.corrcoef(places[:, 0], places[:, 1])[0, 1]) < 0.08
    assert abs(np.corrcoef(places[:-1, 0], places[1:, 0])[0, 1]) < 0.08


def test_rank_p_value(spark):
    rows = [("above", 9.5, s) for s in range(9)] + [("below", -1.0, s) for s in range(9)] + [("tied", 4.0, s) for s in range(9)]
    df = spark.createDataFrame([(g, float(b), float(s)) for g, b, s in rows], "g string, baseline double, score double")
    up = {r["g"]: r["p_value"] for r in P.rank_p_value(df, ["g"]).collect()}
    assert up == {"above": pytest.approx(0.1), "below": pytest.approx(1.0), "tied": pytest.approx(0.6)}
    low = {r["g"]: r["p_value"] for r in P.rank_p_value(df, ["g"], "less").collect()}
    assert low == {"above": pytest.approx(0.9), "below": 0.0, "tied": pytest.approx(0.4)}
    two = {r["g"]: r["p_value"] for r in P.rank_p_value(df, ["g"], one_tailed=False).collect()}
    assert two == {"above": pytest.approx(0.1), "below": 0.0, "tied": pytest.approx(0.4 if 4.0 < 4.0 else 0.6)}
    with pytest.raises(ValueError):
        P.rank_p_value(df, ["g"], "sideways")


def test_column_scores_equal_prediction(data):
    _, df = data
    fit = linear.fit_linear(df, FEATURES, "y")
    rows = df.withColumn("sample_id", (F.col("id") % 2).cast("int"))
    a = P.column_scores(rows, fit, "y", ["id"], n_repeats=4, seed=2).toPandas()
    b = P.model_column_scores(rows, fit.predict, FEATURES, "y", ["id"], n_repeats=4, seed=2).toPandas()
    key = ["sample_id", "feature", "repeat"]
    a, b = a.sort_values(key), b.sort_values(key)
    np.testing.assert_allclose(a["score"], b["score"], atol=1e-7)
    np.testing.assert_allclose(a["baseline"], b["baseline"], atol=1e-7)


def test_controls(spark):
    """Without noise the control is always found; shuffled labels are rarely rejected."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=1500)
    pdf = pd.DataFrame({"x": x, "y": 0.6 * x + rng.normal(size=1500), "id": range(1500)})
    df = spark.createDataFrame(pdf)
    pos = P.positive_control_tests(df, {"OLS": ("ols", {}), "Ridge": ("ridge", {"alpha": 1.0})}, ["x"], "y", ["id"], [0.0, 200.0], n_samples=8, n_repeats=99, seed=1)
    rates = {(r["model"], r["sigma"]): r["rate"] for r in P.control_rates(pos, ["model", "sigma"]).collect()}
    assert rates["OLS", 0.0] == rates["Ridge", 0.0] == 1.0
    assert rates["OLS", 200.0] < 0.5
    fit = linear.fit_linear(df, ["x"], "y")
    neg = P.negative_control_tests(fit.predict(df, "p"), {"OLS": "p"}, "y", ["id"], n_samples=12, n_repeats=99, seed=3)
    rates = {r["version"]: r["rate"] for r in P.control_rates(neg, ["model", "version"]).collect()}
    assert rates["tpr"] == 1.0 and rates["fpr"] <= 0.25


def test_importance_and_shards(data):
    _, df = data
    fit = linear.fit_linear(df, FEATURES, "y", name="OLS")
    whole = P.combined_importance(df, fit, "y", ["id"], n_samples=3, n_repeats=49, seed=5)
    got = {r["feature"]: r for r in whole.collect()}
    assert got["x1"]["rejected"] and got["x2"]["rejected"] and not got["x3"]["rejected"]
    parts = None
    for i in (1, 2, 3):
        shard = P.importance_shards(df, fit, "y", ["id"], n_samples=3, n_repeats=49, seed=5, sample_id=i)
        parts = shard if parts is None else parts.unionByName(shard)
    for r in P.merge_shards(parts).collect():
        assert r["p_adjusted"] == pytest.approx(got[r["feature"]]["p_adjusted"])


def test_fisher_handles_zero_and_missing(spark):
    rows = [("a", 0.5), ("a", 0.1), ("b", 0.0), ("b", 0.9), ("c", None), ("c", 0.3)]
    got = {r["g"]: r for r in P.fisher_combine(spark.createDataFrame(rows, "g string, p_value double"), ["g"]).collect()}
    x = -np.log(0.05)
    assert got["a"]["p_combined"] == pytest.approx(np.exp(-x) * (1 + x))
    assert got["b"]["p_combined"] == 0.0
    assert got["c"]["n_tests"] == 1 and got["c"]["p_combined"] == pytest.approx(0.3)


def test_failed_samples_become_rows(spark):
    def run(i):
        if i == 2:
            raise ValueError("too small")
        return spark.createDataFrame([(0.5,)], "p_value double")

    rows = {r["sample_id"]: r for r in P.guarded_samples(run, [1, 2], "p_value double").collect()}
    assert rows[1]["p_value"] == 0.5 and rows[1]["reason"] is None
    assert rows[2]["p_value"] is None and rows[2]["reason"] == "too small"


def test_large_sample_results_are_whole(spark):
    def run(i):
        return spark.range(15_000).select(F.lit(0.1).alias("p_value"))

    assert P.guarded_samples(run, [1, 2], "p_value double").count() == 30_000


def test_constant_labels_become_failed_tests(spark):
    df = spark.range(60).select("id", F.lit(1.0).alias("y"), (F.col("id") % 7).cast("double").alias("m"))
    tests = P.negative_control_tests(df, {"m": "m"}, "y", ["id"], n_samples=2, n_repeats=3)
    assert all(r["p_value"] is None for r in tests.collect())
    rates = P.control_rates(tests, ["model", "version"]).collect()
    assert all(r["n_failed"] == 2 and r["n_tests"] == 0 and r["rate"] is None for r in rates)


def test_weak_penalty_on_collinear_columns_settles():
    rng = np.random.default_rng(3)
    level = rng.integers(0, 7, 4000)
    x = np.column_stack([np.eye(7)[level], rng.normal(size=4000)])
    y = level * 0.3 + x[:, -1] + rng.normal(size=4000)
    x, y = x - x.mean(0), y - y.mean()
    c, s = x.T @ x / len(y), x.T @ y / len(y)
    for alpha in (1e-8, 1e-4, 0.1):
        b = linear._descend(c, s, np.array([alpha]), np.array([0.0]), None)[0]
        slope = s - c @ b
        assert np.abs(slope[b != 0] - alpha * np.sign(b[b != 0])).max(initial=0) < 1e-8
        assert np.abs(slope).max() <= alpha + 1e-8


def test_targets_together_are_targets_alone(data):
    _, df = data
    both = df.withColumn("z", F.col("y") * 2 - F.col(FEATURES[0]))
    fits = linear.fit_linear_targets(both, FEATURES, ["y", "z"], "ridge", {"alpha": 2.0})
    for label in ("y", "z"):
        alone = linear.fit_linear(both, FEATURES, label, "ridge", {"alpha": 2.0})
        assert fits[label].coef == pytest.approx(alone.coef) and fits[label].intercept == pytest.approx(alone.intercept)
    grid = [{"alpha": 0.1}, {"alpha": 50.0}]
    fits, table = linear.search_linear_targets(both, FEATURES, ["y", "z"], "ridge", grid, ["id"], folds=4)
    found = {(r["target_name"], r["point"]): r["mean_test_score"] for r in table.collect()}
    for label in ("y", "z"):
        fit, alone = linear.search_linear(both, FEATURES, label, "ridge", grid, ["id"], folds=4)
        assert fits[label].params == fit.params
        for r in alone.collect():
            assert found[label, r["point"]] == pytest.approx(r["mean_test_score"], abs=1e-9)


def test_complete_linkage_is_the_greedy_one():
    from traitspark.operators.explore import complete_linkage

    rng = np.random.default_rng(4)
    for n in (1, 2, 9, 25):
        x = rng.normal(size=(n, 3))
        dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        cut = 0.5 * dist.max() if n > 1 else 0.0
        clusters = [[i] for i in range(n)]
        while len(clusters) > 1:
            gap, a, b = min(
                (dist[np.ix_(clusters[i], clusters[j])].max(), i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters))
            )
            if gap > cut:
                break
            clusters[a] = clusters[a] + clusters[b]
            del clusters[b]
        names = [f"c{i}" for i in range(n)]
        assert complete_linkage(dist, cut, names) == [[names[i] for i in c] for c in sorted(sorted(c) for c in clusters)]
