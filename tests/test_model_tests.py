"""Any-model scores on both paths, error rows, and the ledger of shards."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from traitspark.operators import forest, linear, perceptron
from traitspark.operators import model_tests as M
from traitspark.operators import permutation as P
from traitspark.sources.shards import ShardLedger


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=600), "b": rng.normal(size=600), "id": range(600)})
    pdf["y"] = 2 * pdf["a"] + rng.normal(size=600)
    pdf["sample_id"] = pdf["id"] % 3
    df = spark.createDataFrame(pdf)
    return df.withColumn("sample_id", F.expr("nullif(sample_id, 2)").cast("int")).cache()


@pytest.mark.parametrize("metric", sorted(M.METRICS))
def test_both_paths_agree_also_on_a_missing_group(rows, metric):
    fit = linear.LinearFit("m", "ols", ["a", "b"], 0.1, [1.5, 0.2])
    kinds = {}
    for block_rows in (10**6, 10):
        out = M.shuffled_scores(rows, fit, "y", ["id"], shuffled=["a", "b", "y"], n_repeats=3, metric=metric, block_rows=block_rows)
        kinds[block_rows] = {(r.sample_id, r.feature, r.repeat): (r.baseline, r.score) for r in out.collect()}
    large, small = kinds[10], kinds[10**6]
    assert set(large) == set(small) and len(small) == 3 * 3 * 3
    for k in small:
        assert small[k] == pytest.approx(large[k], abs=1e-8)


def test_metrics_are_the_plain_ones():
    y, p = np.array([1.0, 2.0, 4.0]), np.array([1.5, 2.0, 3.0])
    e = y - p
    assert M.METRICS["r2"].score(y, p) == pytest.approx(1 - (e @ e) / ((y - y.mean()) ** 2).sum())
    assert M.METRICS["explained_variance"].score(y, p) == pytest.approx(1 - e.var() / y.var())
    assert M.METRICS["mae"].score(y, p) == pytest.approx(0.5)
    assert M.METRICS["rmse"].score(y, p) == pytest.approx(np.sqrt((e @ e) / 3))
    assert np.isnan(M.METRICS["r2"].score(np.ones(3), p))


def test_failing_samples_are_rows_and_code_errors_are_not(rows):
    fit = linear.LinearFit("m", "ols", ["a", "b"], 0.1, [1.5, 0.2])
    for block_rows in (10**6, 10):
        scores = M.shuffled_scores(rows.where("sample_id is not null"), {0: fit, 1: "empty"}, "y", ["id"], n_repeats=3, block_rows=block_rows)
        tests = {(r.sample_id, r.feature): r for r in M.tests_of(scores, ["sample_id", "feature"]).collect()}
        assert tests[0, "a"].p_value == 0.25 and tests[0, "a"].reason is None
        assert tests[1, "a"].p_value is None and tests[1, "a"].reason == "ValueError: empty"

    class Broken:
        features = ["a", "b"]

        def predict_array(self, x):
            raise KeyError("a fault of the code")

    with pytest.raises(Exception, match="fault of the code"):
        M.shuffled_scores(rows, Broken(), "y", ["id"], n_repeats=1).collect()


def test_members_refit_like_their_rows_alone(spark, rows):
    """A fit of a sample in a training of all is the fit of the sample's own rows."""
    df = rows.where("sample_id is not null").select(F.col("sample_id") + 1, "id", "a", "b", "y").toDF("sample_id", "id", "a", "b", "y")
    point = {"n_estimators": 6, "max_depth": 4}
    both = M._refit_forests(df, ["a", "b"], "y", ["id"], 3, point, 3)
    assert both[3] == "ValueError: empty sample"
    alone = M._refit_forests(df.where("sample_id = 2"), ["a", "b"], "y", ["id"], 2, point, 3)
    x = np.array(df.where("sample_id = 2").select("a", "b").collect())
    # the cuts come from all samples' rows, so predictions are close, not equal
    assert np.corrcoef(both[2].predict_array(x), alone[2].predict_array(x))[0, 1] > 0.97
    nets = M._refit_networks(df, ["a", "b"], "y", ["id"], 2, {"hidden_layer_sizes": (3,), "max_iter": 5}, 3)
    own = M._refit_networks(df.where("sample_id = 2"), ["a", "b"], "y", ["id"], 2, {"hidden_layer_sizes": (3,), "max_iter": 5}, 3)
    np.testing.assert_allclose(nets[2].weights, own[2].weights, atol=1e-6)


def test_network_does_not_depend_on_cores(spark, rows, monkeypatch):
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 100)
    point = {"hidden_layer_sizes": (4,), "max_iter": 4, "batch_size": 20}
    one = perceptron.fit_perceptron(rows.coalesce(1), ["a", "b"], "y", ["id"], point)
    many = perceptron.fit_perceptron(rows.repartition(7), ["a", "b"], "y", ["id"], point)
    assert one.weights == many.weights


def test_controls_and_importance_of_forests(spark, rows):
    df = rows.drop("sample_id")
    point = {"n_estimators": 20, "max_depth": 5, "min_samples_leaf": 0.02}
    tests = {(r.sigma, r.sample_id): r for r in M.positive_control(df, "forest", point, ["b"], "y", ["id"], (0.0, 1000.0), 2, 19).collect()}
    assert tests[0.0, 1].p_value == 0.05 and tests[0.0, 2].p_value == 0.05
    fit = forest.fit_forest(df, ["a", "b"], "y", point, key=["id"])
    found = {(r.sample_id, r.feature): r.p_value for r in M.importance_tests(df, fit, "y", ["id"], 2, 19).collect()}
    assert found[1, "a"] == 0.05 and found[2, "a"] == 0.05
    only = M.importance_tests(df, fit, "y", ["id"], 2, 19, sample_ids=[2]).collect()
    assert {r.sample_id for r in only} == {2}
    control = M.negative_control(df, fit, "y", ["id"], 2, 19, metric="mse").collect()
    assert [r.p_value for r in control] == [0.05, 0.05]


def test_ledger_computes_what_is_missing(spark, tmp_path):
    ledger = ShardLedger(spark, str(tmp_path / "runs"))
    asked = []

    def compute(ids):
        asked.append(ids)
        return spark.createDataFrame([(i, i * 10) for i in ids if i != 4], "sample_id int, v int")

    assert ledger.run(compute, [1, 2]) == [1, 2]
    assert ledger.run(compute, [2, 3, 4]) == [3, 4]
    assert ledger.run(compute, [1, 4]) == []
    assert asked == [[1, 2], [3, 4]]
    table, absent = ledger.read([1, 2, 3, 4, 5])
    assert sorted(map(tuple, table.collect())) == [(1, 10), (2, 20), (3, 30)] and absent == [5]


def test_forest_split_is_the_best_of_all(spark, rows):
    df = rows.withColumn("k", F.floor(F.col("a") * 3).cast("double"))
    tree = forest.fit_forest(df, ["k"], "y", {"n_estimators": 1, "max_depth": 1, "bootstrap": False}).trees[0]
    pdf = df.toPandas()
    best = max(
        (len(lo) * len(hi) / len(pdf) * (lo.mean() - hi.mean()) ** 2, c)
        for c in sorted(pdf["k"].unique())[:-1]
        for lo, hi in [(pdf["y"][pdf["k"] <= c], pdf["y"][pdf["k"] > c])]
    )
    assert tree["threshold"][0] == best[1] and tree["gain"][0] == pytest.approx(best[0], rel=1e-6)


def test_split_and_leaf_shares(spark, rows):
    n = rows.count()
    fit = forest.fit_forest(rows, ["a", "b"], "y", {"n_estimators": 8, "min_samples_split": 0.2, "min_samples_leaf": 0.05}, key=["id"])
    for t in fit.trees:
        for i, left in enumerate(t["left"]):
            assert t["weight"][i] >= 0.05 * n
            if left != i:
                assert t["weight"][i] >= 0.2 * n


@pytest.mark.parametrize("groups", ["folds", "own"])
def test_trees_from_cells_are_the_trees_from_rows(spark, rows, monkeypatch, groups):
    """Sums by combination of bins give every tree of the row scans, with fewer jobs."""
    df = rows.withColumn("g", F.pmod(F.col("id"), F.lit(3)))
    made = forest.Folds(3) if groups == "folds" else forest.Own(4)
    points = [
        {"n_estimators": 7, "max_depth": 4, "max_features": "sqrt"},
        {"n_estimators": 3, "min_samples_leaf": 0.02, "bootstrap": False},
    ]
    fits = [(p, k) for p in points for k in range(made.groups)]
    found = {}
    for numbers in (forest.CELL_NUMBERS, 0):
        monkeypatch.setattr(forest, "CELL_NUMBERS", numbers)
        data = forest.Binned(df, ["a", "b"], "y", made, F.col("g"), ["id"])
        assert data.by_cell == (numbers > 0)
        trees = forest.grow(data, fits, 5)
        found[numbers] = [[t.pack() for t in some] for some in trees], forest.group_scores(data, trees, [k for _, k in fits]).orderBy("fit").collect()
    (cells, scores), (plain, row_scores) = found.values()
    assert cells == plain and any(len(t) > 7 * 8 for some in cells for t in some)
    for one, other in zip(scores, row_scores):
        assert [x and round(x, 12) for x in one] == [x and round(x, 12) for x in other]


@pytest.mark.parametrize("size, numbers", [(7, 1 << 20), (50, 300), (64, 0)])
def test_ranges_of_places_pair_the_same_rows(rows, monkeypatch, size, numbers):
    """Many small ranges, few bins, and no ranges at all: the scores and products of whole groups."""
    fit = linear.LinearFit("m", "ols", ["a", "b"], 0.1, [1.5, 0.2])
    monkeypatch.setattr(P, "RANGE_ROWS", size)
    monkeypatch.setattr(P, "BIN_NUMBERS", numbers)
    made = []
    monkeypatch.setattr(P, "range_rows", lambda *a, _made=P.range_rows: made.append(_made(*a)) or made[-1])
    found, products = [], []
    for block_rows in (10**6, 10):
        out = M.shuffled_scores(rows, fit, "y", ["id"], shuffled=["b", "y"], n_repeats=3, block_rows=block_rows)
        found.append({(r.sample_id, r.feature, r.repeat): (r.baseline, r.score) for r in out.collect()})
        out = P.permutation_products(rows, ["a", "y", "a"], ["b", "b", "a"], ["id"], ["sample_id"], 2, 3, first=0, block_rows=block_rows)
        products.append({(r.sample_id, r.repeat): (r.product_0, r.product_1, r.product_2) for r in out.collect()})
    assert len(found[0]) == 18 and set(found[0]) == set(found[1]) and len(products[0]) == 9
    assert [m is None for m in made] == [numbers == 0] * 2
    for one, other in (found, products):
        for k in one:
            assert one[k] == pytest.approx(other[k], abs=1e-8)


def test_shuffled_columns_alone_are_dealt(rows, monkeypatch):
    """A row of a repeat travels as its sort key and what is shuffled, once."""
    seen = []
    monkeypatch.setattr(P, "range_rows", lambda *a, _made=P.range_rows: seen.append(a[2:4]) or _made(*a))
    fit = linear.LinearFit("m", "ols", ["a", "b"], 0.1, [1.5, 0.2])
    out = M.shuffled_scores(rows, fit, "y", ["id"], shuffled=["b"], n_repeats=2, block_rows=10)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert seen == [(["a", "b", "y"], ["b"])] and "explode" not in plan and "row_number" not in plan


def test_kept_predictions_are_the_trees_own(spark, rows, monkeypatch):
    fit = forest.fit_forest(rows, ["a", "b"], "y", {"n_estimators": 8, "max_depth": 6}, key=["id"])
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(5000, 2)), [[np.nan, 0.0], [np.inf, -np.inf]], [[t, t] for t in fit._prepared()[1][0]]])
    plain = np.where(np.isnan(x).any(axis=1), np.nan, fit._through(x, fit._arrays()))
    calls = []
    monkeypatch.setattr(forest.ForestFit, "_through", lambda self, part, arrays, _made=forest.ForestFit._through: calls.append(len(part)) or _made(self, part, arrays))
    for _ in range(2):
        np.testing.assert_array_equal(fit.predict_array(x), plain)
    assert sum(calls) < len(x) and "_made" not in fit.__getstate__()
    monkeypatch.setattr(forest, "KEPT_CELLS", 0)
    np.testing.assert_array_equal(forest.ForestFit("f", fit.features, fit.trees).predict_array(x), plain)


def test_few_blocks_are_dealt_by_networks(spark, rows, monkeypatch):
    """One block keeps all cores busy, and the networks are those of one task."""
    blocks = perceptron.lay_rows(rows, ["a", "b"], "y", ["id"], None, 3)
    found = []
    for units in (4, 0):
        monkeypatch.setattr(perceptron, "UNITS_A_CORE", units)
        nets = [perceptron.Network.of({"hidden_layer_sizes": (k,), "max_iter": 3, "batch_size": 50}, -2, 2, 3) for k in (1, 2, 3, 4, 5)]
        dealt, shares = perceptron._deal(blocks, len(nets))
        assert shares == (5 if units else 1) and dealt.count() == shares * blocks.count()
        perceptron.train(blocks, nets)
        found.append([(n.epochs, n.flat.tolist(), n.best) for n in nets])
    assert found[0] == found[1]


def test_blocks_are_dealt_evenly(spark, rows, monkeypatch):
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 10)
    monkeypatch.setattr(perceptron, "UNITS_A_CORE", 0)
    blocks = perceptron.lay_rows(rows, ["a", "b"], "y", ["id"], None, 3)
    dealt, shares = perceptron._deal(blocks, 1)
    sizes = [len(part) for part in dealt.select("block").rdd.glom().collect()]
    assert shares == 1 and sum(sizes) == blocks.count() and max(sizes) - min(sizes) <= 1


def _plain_pass(net, z, fold, held):
    """Weights, speed and squared errors of a block, row by row as the formulas say."""
    own = net.rows(fold)
    relu, w, v = net.params["activation"] == "relu", net.flat, net.speed
    part, size = z[own & ~held], net.params["batch_size"]
    for low in range(0, len(part), size):
        x, y = part[low : low + size, :-1], part[low : low + size, -1:]
        layers = perceptron._unpack(w, net.sizes)
        inputs = perceptron._forward(x, layers, net.params["activation"])
        back, found = (inputs[-1] - y) / len(y), []
        for i in range(len(layers) - 1, -1, -1):
            found = [(inputs[i].T @ back + perceptron.L2 * layers[i][0] / len(y)).ravel(), back.sum(0), *found]
            back = back @ layers[i][0].T * ((inputs[i] > 0) if relu else 1.0)
        push = net.rate * np.concatenate(found)
        v = perceptron.MOMENTUM * v - push
        w = w + perceptron.MOMENTUM * v - push
    test = z[own & held]
    e = perceptron._predict_flat(test[:, :-1], net.flat, net.sizes, net.params["activation"]) - test[:, -1]
    return w, v, e @ e


def test_networks_of_a_block_step_like_each_alone(monkeypatch):
    """All kinds of networks, folds of unlike numbers of mini-batches, one without training rows, one that lost its way."""
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(4)
    z, fold, held = rng.normal(size=(100, 3)) + [1.0, 0.0, 5.0], rng.choice(4, 100, p=[0.55, 0.3, 0.1, 0.05]).astype(np.int32), rng.random(100) < 0.2
    held |= fold == 3
    nets = []
    for sizes in ((), (1,), (4, 3), (6, 5, 2)):
        for activation in ("identity", "relu"):
            for size in (2, 7, 100):
                point = {"hidden_layer_sizes": sizes, "activation": activation, "batch_size": size}
                nets += [perceptron.Network.of(point, skip, 2, 3) for skip in (-2, 0, 1)]
                nets += [perceptron.Network.of(point, -2, 2, 3, own=k) for k in (1, 3, 9)]
    for n, net in enumerate(nets):
        net.speed, net.rate = rng.normal(size=len(net.flat)) * 0.01, 0.001 * (1 + n % 3)
    rows_seen = []
    monkeypatch.setattr(perceptron, "_slopes", lambda *a, _made=perceptron._slopes: rows_seen.append(a[4]) or _made(*a))
    found = dict(perceptron._block_pass(list(enumerate(nets)), z, fold, held, perceptron._Scratch()))
    assert set(found) == {n for n, net in enumerate(nets) if net.own != 9}
    for n, row in found.items():
        w, v, sse = _plain_pass(nets[n], z, fold, held)
        state = row[:-4].view(np.int64) / perceptron.STEPS
        assert state[-1] == pytest.approx((nets[n].rows(fold) & ~held).sum() / 100, abs=1e-9)
        if state[-1]:
            np.testing.assert_allclose(state[:-1] / state[-1], np.concatenate([w, v]), atol=1e-8)
        assert row[-1] == pytest.approx(sse, rel=1e-9)
    # mini-batches of at least as many rows as a row has numbers pass a network without activation as moments
    assert rows_seen.count("identity") == sum(-(-int((net.rows(fold) & ~held).sum()) // 2) for net in nets if net.params["activation"] == "identity" and net.params["batch_size"] == 2)
    lost = perceptron.Network.of({"hidden_layer_sizes": (4,), "activation": "identity", "batch_size": 20}, -2, 2, 3)
    lost.flat = lost.flat * 1e200
    with np.errstate(all="ignore"):
        row = dict(perceptron._block_pass([(0, lost)], z, fold, held, perceptron._Scratch()))[0]
    assert row[-1] == 1e300 and np.abs(row[:-4].view(np.int64) / perceptron.STEPS).max() <= 16384


def test_loops_of_epochs_train_the_same_networks(spark, rows, monkeypatch):
    """Kinds are dealt to the loops, results are those of one loop, an error in one ends the others."""
    blocks = perceptron.lay_rows(rows, ["a", "b"], "y", ["id"], None, 3)

    def nets(epochs):
        kinds = [((4,), "relu"), ((2, 2), "relu"), ((3,), "identity"), ((), "identity")]
        return [perceptron.Network.of({"hidden_layer_sizes": k, "activation": a, "max_iter": epochs, "batch_size": 50}, skip, 2, 3) for k, a in kinds for skip in (-2, 7)]

    found = []
    for loops in (1, 2):
        monkeypatch.setattr(perceptron, "LOOPS", loops)
        made = nets(3)
        assert [len(part) for part in perceptron._parts(made)] == [8 // loops] * loops
        perceptron.train(blocks, made)
        found.append([(n.epochs, n.flat.tolist(), n.best) for n in made])
    assert found[0] == found[1] and all(n[0] == 3 for n in found[0])

    def scored(self, score):
        if self.sizes[1] == 4:
            raise KeyError("a fault of the code")
        seen.append(score)

    seen: list = []
    monkeypatch.setattr(perceptron.Network, "scored", scored)
    with pytest.raises(KeyError, match="fault of the code"):
        perceptron.train(blocks, nets(500))
    assert len(seen) < 500
