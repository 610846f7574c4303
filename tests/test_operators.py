"""Hand-made frames, with values worked out by NumPy or by hand."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traitspark.functions import hashing as H
from traitspark.functions import special
from traitspark.operators import annotate, clean, explore, features, metrics, ranking, sampling, skew


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- joins under skew --------------------------------------------------------


@pytest.mark.parametrize("share", [None, 0.02])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_plain_join(spark, how, share):
    # one key holds a third of the rows, some keys are missing, some have no partner
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
        F.col("id").alias("v"),
    )
    small = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    got = skew.skew_join(big, small, ["k"], how, share, salts=4).toPandas()
    want = big.join(small, "k", how).toPandas()
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(
        got.sort_values("v").reset_index(drop=True), want.sort_values("v").reset_index(drop=True)
    )


def test_hot_keys_are_bounded(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    assert [r["k"] for r in skew.hot_keys(df, ["k"], 0.1).collect()] == [0]


def test_lookup_join_with_and_without_broadcast(spark):
    big = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 60).alias("k"), "id")
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") + 1).alias("w"))
    want = sorted(map(tuple, big.join(small, "k").collect()))
    for limit in (10, 100):
        assert sorted(map(tuple, skew.lookup_join(big, small, ["k"], max_rows=limit).collect())) == want


# -- ranks and quantiles --------------------------------------------------------


def test_hash_rank_equals_window(spark):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("g"),
        H.salted_md5(4, "id").alias("h"),
    )
    got = ranking.hash_rank(df, "h", ["g"], size_out="n")
    want = df.withColumn("w", F.row_number().over(W.partitionBy("g").orderBy("h"))).withColumn(
        "m", F.count("*").over(W.partitionBy("g"))
    )
    assert got.join(want, "id").where("rank <> w or n <> m").count() == 0
    assert got.count() == 5000


@pytest.mark.parametrize("bucket_values", [0, 10**6])
@pytest.mark.parametrize("n", [3, 1000, 60000])
def test_quantiles_equal_numpy(spark, n, bucket_values, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_VALUES", bucket_values)
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.rand(3) * 20).alias("v"),
        (F.col("id") % 2).alias("g"),
    ).persist()
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.975, "e": 1.0}
    got = {r["g"]: r for r in ranking.exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g, part in df.toPandas().groupby("g"):
        for name, q in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part["v"], q), abs=1e-12)
    whole = ranking.exact_quantiles(df, "v", {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.median(df.toPandas()["v"]), abs=1e-12)
    df.unpersist()


def _step_up(p):
    p = np.asarray(p)
    order = np.argsort(p)
    ratio = p[order] * len(p) / np.arange(1, len(p) + 1)
    adj = np.minimum.accumulate(ratio[::-1])[::-1].clip(max=1)
    out = np.empty(len(p))
    out[order] = adj
    return out


@pytest.mark.parametrize("bucket_values", [0, 10**6])
def test_step_up_adjustment(spark, bucket_values, monkeypatch):
    monkeypatch.setattr(ranking, "BUCKET_VALUES", bucket_values)
    from traitspark.operators.permutation import adjust_p_values

    p = [0.0, 0.01, 0.01, 0.02, 0.2, 0.2, 0.2, 1.0, 1.0, 0.04, None, float("nan")]
    df = frame(spark, [(i, "m", v) for i, v in enumerate(p)], "id int, model string, p_value double")
    want = _step_up(p[:10])
    got = {r["id"]: r for r in adjust_p_values(df).collect()}
    for i, w in enumerate(want):
        assert got[i]["p_adjusted"] == pytest.approx(w)
        assert got[i]["rejected"] == (w <= 0.05)
    assert all(got[i]["p_adjusted"] is None and got[i]["rejected"] is None for i in (10, 11))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=40))
def test_adjusted_is_monotone_and_not_smaller(spark, ps):
    df = frame(spark, [(float(p),) for p in ps], "p double")
    rows = sorted((r["p"], r["q"]) for r in ranking.step_up_adjust(df, "p", out="q").collect())
    assert all(q >= p - 1e-15 for p, q in rows)
    assert all(a[1] <= b[1] + 1e-15 for a, b in zip(rows, rows[1:]))


# -- sampling --------------------------------------------------------------------


def test_sample_is_exact_and_stable(spark):
    df = spark.range(4000).withColumn("g", F.col("id") % 2)
    a = {r["id"] for r in sampling.sample_rows(df, ["id"], 100, 3, ["g"]).collect()}
    b = {r["id"] for r in sampling.sample_rows(df.repartition(5), ["id"], 100, 3, ["g"]).collect()}
    assert a == b and len(a) == 200
    assert sampling.sample_rows(df, ["id"], None).count() == 4000
    assert sampling.sample_rows(df.where("id < 10"), ["id"], 100, 3, ["g"]).count() == 10


def test_split_and_folds(spark):
    df = spark.range(5000)
    test = sampling.split_rows(df, ["id"]).where("is_test").count()
    assert abs(test / 5000 - 0.3) < 0.03
    assert sampling.split_rows(df, ["id"], exact=True).where("is_test").count() == 1500
    sizes = [r["count"] for r in sampling.fold_rows(df, ["id"], 7, exact=True).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [715, 715, 714, 714, 714, 714, 714]
    loose = sampling.fold_rows(df, ["id"], 10).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in loose) == list(range(10))


def test_subsamples_differ_and_have_the_share(spark):
    df = spark.range(4000)
    rows = sampling.subsample_members(df, ["id"], 5, 0.3, seed=2).toPandas()
    sets = [set(g["id"]) for _, g in rows.groupby("sample_id")]
    assert all(abs(len(s) / 4000 - 0.3) < 0.05 for s in sets)
    overlap = len(sets[0] & sets[1]) / len(sets[0])
    assert abs(overlap - 0.3) < 0.08
    exact = sampling.subsample_members(df, ["id"], 3, 0.3, seed=2, exact=True).groupBy("sample_id").count()
    assert {r["count"] for r in exact.collect()} == {1200}


# -- features ----------------------------------------------------------------------


def test_scaling_and_one_hot(spark):
    df = frame(
        spark,
        [("chr10", "A", 1.0, 5.0, 0.1), ("chr2", None, 3.0, 5.0, 0.2), ("chr1", "T", 5.0, 5.0, 0.3)],
        "Chromosome string, A1 string, x double, flat double, p_value double",
    )
    out = features.prepare_features(df)
    assert out.columns == ["x", "flat", "A1_A", "A1_T", "Chr1", "Chr2", "Chr10", "p_value"]
    got = out.toPandas()
    np.testing.assert_allclose(got["x"], (np.array([1, 3, 5]) - 3) / np.std([1, 3, 5]))
    assert got["flat"].tolist() == [0, 0, 0]
    assert got[["A1_A", "A1_T"]].values.tolist() == [[1, 0], [0, 0], [0, 1]]
    assert got["p_value"].tolist() == [0.1, 0.2, 0.3]


def test_one_hot_of_many_levels(spark):
    df = spark.range(1200).select(F.col("id").cast("string").alias("A1"))
    assert len(features.category_levels(df, ["A1"])["A1"]) == 1200


def test_surplus_parts_are_kept(spark):
    from traitspark.functions import scalars

    df = frame(spark, [("a;b;c",), ("a",), (None,)], "g string")
    got = [tuple(r) for r in df.select(*scalars.split_fixed("g", ";", ["x", "y"])).collect()]
    assert got == [("a", "b;c"), ("a", None), (None, None)]
    got = [tuple(r) for r in df.select("g", scalars.split_parts("g", ";").alias("pos", "part")).collect()]
    assert got == [("a;b;c", 0, "a"), ("a;b;c", 1, "b"), ("a;b;c", 2, "c"), ("a", 0, "a"), (None, None, None)]


def test_constant_columns_give_missing_values(spark):
    from traitspark.operators import clean, metrics

    df = frame(spark, [(1.0, 1.0, "m"), (1.0, 2.0, "m")], "truth double, prediction double, model string")
    assert metrics.r2_score(df).first()["r2"] is None
    assert metrics.regression_metrics(df).first()["r2"] is None
    assert clean.outlier_rows(df, "truth").count() == 0


def test_control_feature_without_noise_is_the_label(spark):
    df = spark.range(50).withColumn("y", F.col("id") * 2.0)
    out = features.control_feature(df, "y", 0.0, ["id"]).toPandas()
    assert (out["y"] == out["control_variable"]).all()
    noisy = features.control_feature(spark.range(4000).withColumn("y", F.lit(0.0)), "y", 3.0, ["id"]).toPandas()
    assert abs(noisy["control_variable"].std() - 3.0) < 0.15


# -- exploration -----------------------------------------------------------------------


def _mixed():
    return pd.DataFrame(
        {
            "a": [1.0, 2, 3, 4, 5, 6, 7, 8, 9, 10],
            "b": [2.0, 1, 4, 3, 6, 5, 8, 7, 10, 9],
            "u": list("xxyyxxyyzz"),
            "v": list("pppqqqpqpq"),
            "k": ["one"] * 10,
        }
    )


def _entropy(s):
    p = s.value_counts(normalize=True)
    return -(p * np.log(p)).sum()


def _u(x, y):
    n = len(x)
    pairs = pd.Series(list(zip(x, y))).value_counts()
    hxy = sum(c / n * np.log((y == k[1]).sum() / c) for k, c in pairs.items())
    return (_entropy(x) - hxy) / _entropy(x)


def test_association_matrix(spark):
    d = _mixed()
    m = explore.association_matrix(spark.createDataFrame(d), ["a", "b"])
    cell = {(r["row_feature"], r["col_feature"]): r["value"] for r in m.collect()}
    assert len(cell) == 25
    assert cell["a", "b"] == pytest.approx(np.corrcoef(d["a"], d["b"])[0, 1])
    assert cell["u", "v"] == pytest.approx(_u(d["v"], d["u"]))
    assert cell["v", "u"] == pytest.approx(_u(d["u"], d["v"]))
    means = d.groupby("u")["a"].agg(["mean", "count"])
    between = (means["count"] * (means["mean"] - d["a"].mean()) ** 2).sum()
    eta = np.sqrt(between / ((d["a"] - d["a"].mean()) ** 2).sum())
    assert cell["a", "u"] == cell["u", "a"] == pytest.approx(eta)
    assert all(v == 0 for k, v in cell.items() if "k" in k)
    assert cell["a", "a"] == 1 and all(0 <= abs(v) <= 1 + 1e-12 for v in cell.values())
    order = explore.cluster_order(m, ["a", "u", "b", "v", "k"]).orderBy("position").collect()
    cluster = {r["feature"]: r["cluster"] for r in order}
    assert cluster["a"] == cluster["b"] == 1 and cluster["k"] != 1
    assert [r["cluster"] for r in order] == sorted(cluster.values())


def test_describe_and_proportions(spark):
    df = frame(spark, [("A", "C", 1.0), ("A", None, 2.0), ("G", "C", 9.0), ("G", "T", 4.0), (None, "T", None)], "a string, b string, x double")
    d = {r["column"]: r for r in explore.describe_mixed(df, ["x"], ["a"]).collect()}
    assert (d["x"]["mean"], d["x"]["median"], d["x"]["min"], d["x"]["max"]) == (4.0, 3.0, 1.0, 9.0)
    assert (d["a"]["top"], d["a"]["freq"]) == ("A", 2)  # tie: smallest value
    p = {(r["grouping_set"], r["a"], r["b"]): r["share"] for r in explore.proportions(df, "a", "b").collect()}
    assert p[0, "A", "C"] == pytest.approx(1 / 3) and p[1, "A", None] == 0.5 and p[2, None, "T"] == 0.5
    assert (1, None, None) not in p


def test_density_integrates_to_one(spark):
    df = spark.range(500).select((F.col("id") / 500.0).alias("v"))
    d = explore.kernel_density(df, "v", -1.0, 2.0, 61).toPandas()
    assert d["density"].sum() * 0.05 == pytest.approx(1.0, abs=1e-3)


# -- annotation ---------------------------------------------------------------------------


def test_gene_annotation_by_brute_force(spark):
    rng = np.random.default_rng(1)
    genes = [
        ("chr1", int(s), int(s + w), f"g{i}", ["exonic", "UTR3", "intronic"][i % 3])
        for i, (s, w) in enumerate(zip(rng.integers(0, 900, 25), rng.integers(0, 150, 25)))
    ] + [("chr2", 10, 10, "dot", "UTR5"), ("chr2", 11, 400, "long", "strange")]
    variants = [(i, "chr1" if i % 2 else "chr2", int(p)) for i, p in enumerate(rng.integers(0, 1100, 400))]
    variants += [(1000, "chr2", 10), (1001, "chr2", 11), (1002, "chr3", 5)]
    out = annotate.annotate_genes(
        frame(spark, variants, "id int, Chromosome string, Position int"),
        frame(spark, genes, "Chromosome string, start int, end int, name string, class string"),
        xref=frame(spark, [("g1", "about g1"), ("dot", "about dot")], "name string, xref string"),
        width=60,
    )
    rank = {c: i for i, c in enumerate(annotate.CLASS_PRECEDENCE)}
    got = {r["id"]: (r["func_class"], r["gene_names"], r["gene_xref"]) for r in out.collect()}
    assert len(got) == len(variants)
    for i, chrom, pos in variants:
        hits = [g for g in genes if g[0] == chrom and g[1] <= pos <= g[2]]
        if not hits:
            assert got[i] == ("intergenic", "-", "-")
            continue
        best = min(rank.get(g[4], 99) for g in hits)
        top = [g for g in hits if rank.get(g[4], 99) == best]
        assert got[i][:2] == (top[0][4], ";".join(sorted({g[3] for g in top})))
    assert got[1000][2] == "about dot"


# -- metrics ------------------------------------------------------------------------------------


def test_regression_metrics(spark):
    y, p = np.array([1.0, 2, 3, 5, 8]), np.array([1.5, 2, 2, 6, 7])
    df = frame(spark, [("m", float(a), float(b)) for a, b in zip(y, p)], "model string, truth double, prediction double")
    r = metrics.regression_metrics(df, dp=6).first()
    e = y - p
    assert r["mse"] == pytest.approx(np.mean(e**2), abs=1e-6)
    assert r["median_absolute_error"] == pytest.approx(np.median(abs(e)))
    assert r["r2"] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-6)
    assert r["explained_variance"] == pytest.approx(1 - e.var() / y.var(), abs=1e-6)


def test_box_summary(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 30.0]
    df = frame(spark, [("m", i, "f", v) for i, v in enumerate(values)], "model string, iteration int, feature string, coef double")
    r = metrics.box_summary(df).first()
    assert (r["q1"], r["median"], r["q3"]) == (2.75, 4.5, 6.25)
    assert (r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (1.0, 7.0, 1)
    assert [x["coef"] for x in metrics.box_outliers(df).collect()] == [30.0]


def test_cv_rank_order_argument(spark):
    df = frame(spark, [("m", 1, 0.2), ("m", 2, 0.5), ("m", 3, 0.5)], "model string, point int, mean_test_score double")
    assert [r["rank_test_score"] for r in metrics.cv_rank(df, ordered="ascending").collect()] == [1, 1, 3]
    with pytest.raises(ValueError):
        metrics.cv_rank(df, ordered="up")


def test_report_floor(spark):
    df = frame(spark, [(0.0,), (1e-4,), (1.0,)], "p_value double")
    got = [r["log_p"] for r in clean.report_log_p(df).orderBy("p_value").collect()]
    np.testing.assert_allclose(got, [-np.log10(1e-30), 4.0, 0.0], atol=1e-12)


# -- distribution tails ----------------------------------------------------------------------------


def test_chi_square_tail(spark):
    import math

    cases = [(3.0, 1), (5.0, 4), (200.0, 180), (255.0, 256), (300.0, 257), (250.0, 300), (0.0, 5), (1e4, 3)]
    df = frame(spark, [(s, k) for s, k in cases], "s double, k int")
    got = [r[0] for r in df.select(special.chi2_even_tail(F.col("s"), F.col("k"))).collect()]
    for (s, k), g in zip(cases, got):
        terms = [-s + i * math.log(s) - math.lgamma(i + 1) for i in range(k)] if s else [0.0]
        assert g == pytest.approx(math.fsum(math.exp(t) for t in terms), rel=1e-9, abs=1e-300)


def test_t_quantile():
    # tabulated two-sided 5 percent points
    for dof, q in ((1, 12.706204736), (5, 2.570581836), (30, 2.042272456), (1000, 1.962339081)):
        assert special.t_quantile(0.975, dof) == pytest.approx(q, abs=1e-6)
    assert special.t_quantile(0.975, 1000.5) == pytest.approx(special.t_quantile(0.975, 1000), abs=1e-5)
