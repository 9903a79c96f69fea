import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictlab.operators import analysis, models

MERGED = "query_id string, doc_id_1 string, doc_id_2 string, model_pref int, n_presentations int, position_consistent boolean, rank_1 int, rank_2 int, rank_gap int, AX1 int, AX2 int"


def merged(spark, rows):
    return spark.createDataFrame([("q", f"a{i}", f"b{i}", pref, 2, True, 0, gap, gap, x, y) for i, (pref, gap, x, y) in enumerate(rows)], MERGED)


def test_agreement(spark):
    df = merged(spark, [(1, 1, 1, 1), (-1, 1, 1, -1), (0, 1, 1, 0)])
    got = {r["axiom"]: (r["coverage"], r["n_evaluable"], r["agreement"]) for r in analysis.agreement_table(df, ["AX1", "AX2"]).collect()}
    assert got == {"AX1": (1.0, 2, 0.5), "AX2": (0.666667, 2, 1.0)}
    ci = {r["axiom"]: r for r in analysis.agreement_intervals(df, ["AX1", "AX2"], 20).collect()}
    assert (ci["AX2"]["ci_lo"], ci["AX2"]["ci_hi"], ci["AX2"]["n_evaluable_queries"]) == (1.0, 1.0, 1)
    assert analysis.agreement_intervals(df, ["AX1"], 20, min_clusters=5).first()["ci_lo"] is None
    none = merged(spark, [(0, 1, 0, 0)])
    assert analysis.agreement_table(none, ["AX1"]).first()["agreement"] is None


def test_bins(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 101)], "rank_gap int")
    got = {r["gap_bin"]: r["count"] for r in analysis.gap_bins(df).groupBy("gap_bin").count().collect()}
    assert len(got) == 10 and set(got.values()) == {10} and max(got) == 100
    small = spark.createDataFrame([(i,) for i in (1, 3, 9, 15)], "rank_gap int")
    assert sorted(r["gap_bin"] for r in analysis.gap_bins(small).collect()) == [1, 3, 9, 15]


def test_gradient(spark):
    df = merged(spark, [(1, 1, 1, 0), (-1, 1, 1, 0), (1, 2, 1, 0), (0, 2, 1, 0)])
    got = {r["gap_bin"]: (r["n_pairs"], r["decisive_rate"], r["agreement"]) for r in analysis.gap_gradient(df, ["AX1"]).collect()}
    assert got == {1: (2, 1.0, 0.5), 2: (2, 0.5, 1.0)}


def test_covariates(spark):
    pairs = spark.createDataFrame([("q", "a", "b")], "query_id string, doc_id_1 string, doc_id_2 string")
    pool = spark.createDataFrame([("q", "a", 1, 10.0), ("q", "b", 4, 4.0)], "qid string, docno string, rank int, score double")
    topics = spark.createDataFrame([("q", "what cats?")], "qid string, query string")
    corpus = spark.createDataFrame([("a", "what cats do"), ("b", "cats do")], "docno string, text string")
    stored = spark.createDataFrame([("q", "a", "b", 0.75, 2.0, 1.0), ("q", "b", "a", 0.25, 1.0, 2.0)], "query_id string, doc_id_a string, doc_id_b string, prob_a double, score_a double, score_b double")
    r = analysis.covariates(pairs, pool, topics, corpus, stored).first()
    assert (r["d_rank"], r["d_score"], r["d_len"], r["len_ratio"], r["d_qcov"]) == (-3.0, 6.0, 1.0, 1.5, 0.5)
    assert (r["conf_margin_prob"], r["conf_margin_score"], r["query_is_question"], r["query_len"]) == (0.25, 1.0, 1.0, 2.0)
    assert analysis.covariates(pairs, pool, topics, corpus).first()["conf_margin_prob"] is None


def test_sensitivity(spark):
    rows = spark.createDataFrame([(1.0,), (0.5,), (0.4,), (None,), (0.75,)], "c double")
    got = [r[0] for r in rows.select(analysis.single_order_sensitivity(F.col("c"))).collect()]
    assert got[:4] == [1.0, 0.5, 0.5, None] and got[4] == pytest.approx(0.5 * (1 + math.sqrt(0.5)))


def test_auc_and_correlation(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 8, 200), rng.integers(0, 2, 200).astype(bool)
    df = spark.createDataFrame([(int(a), bool(b)) for a, b in zip(s, y, strict=True)], "s int, y boolean")
    want = np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in s[y] for b in s[~y]])
    assert analysis.auc(df, "s", "y").first()["auc"] == pytest.approx(want, abs=1e-6)
    assert analysis.auc(df.filter("y"), "s", "y").first()["auc"] is None
    pairs = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (3.0, 9.0), (3.0, 9.0)], "t double, p double")
    r = analysis.regression_fidelity(pairs, "t", "p").first()
    assert (r["spearman"], r["mae"]) == (1.0, 3.5)


def test_information(spark):
    df = spark.createDataFrame([(True, 0.9, 0.5), (False, 0.2, 0.5)], "y boolean, p double, n double")
    r = analysis.information(df, "y", "p", "n").first()
    assert r["null_log_loss"] == pytest.approx(math.log(2), abs=1e-6) and r["gain"] > 0 and 0 < r["pseudo_r2"] < 1


def feature_frame(spark, queries=6):
    rows = []
    for q in range(queries):
        for i, (pref, x) in enumerate([(1, 1), (-1, -1), (1, 1), (-1, -1), (0, 1)]):
            rows.append((f"q{q}", f"a{i}", f"b{i}", pref, x, 0))
    return spark.createDataFrame(rows, "query_id string, doc_id_1 string, doc_id_2 string, model_pref int, X int, Y int")


def test_fits(spark):
    df = feature_frame(spark)
    folds = {r["query_id"]: r["fold"] for r in models.assign_folds(df).collect()}
    assert len(folds) == 6 and set(folds.values()) == set(range(5))
    oof, found = models.joint_fit(df, ["X", "Y"])
    rows = oof.collect()
    assert len(rows) == 24 and all(r["oof_correct"] and r["vote_correct"] for r in rows) and found["full"][0] > 0
    predicted, found = models.surrogate(df, ["X", "Y"])
    r = models.fidelity(predicted).first()
    assert (r["n_decisive"], r["accuracy"], r["n_ties"], r["n_forced"]) == (24, 1.0, 6, 6)
    zero = {r["feature"]: (r["pairs"], r["queries"]) for r in models.feature_zero_effect(predicted, ["X", "Y"], found["fits"]).collect()}
    assert zero["X"][1] == 6 and zero["Y"] == (0, 0)
    with pytest.raises(ValueError, match="two groups"):
        models.assign_folds(df.filter("query_id = 'q0'"))
    with pytest.raises(ValueError, match="features"):
        models.joint_fit(df, [])


def test_null_is_out_of_fold(spark):
    rows = [("q0", f"a{i}", "z", 1, 0) for i in range(4)] + [("q1", f"a{i}", "z", -1, 0) for i in range(4)] + [("q2", "a0", "z", 1, 0), ("q2", "a1", "z", -1, 0)]
    df = spark.createDataFrame(rows, "query_id string, doc_id_1 string, doc_id_2 string, model_pref int, X int")
    got = models.joint_fit(df, ["X"], folds=3)[0].filter("query_id <> 'q2'").collect()
    assert not any(r["oof_null_correct"] for r in got)


def test_logistic_against_plain_descent():
    rng = np.random.default_rng(1)
    x, w = rng.integers(-1, 2, (60, 2)).astype(float), rng.integers(1, 4, 60).astype(float)
    y = (x[:, 0] + rng.normal(0, 1, 60) > 0).astype(float)
    theta, b = np.zeros(2), 0.0
    for _ in range(20_000):
        p = 1 / (1 + np.exp(-(x @ theta + b)))
        theta, b = theta - 0.01 * (x.T @ (w * (p - y)) + theta), b - 0.01 * float((w * (p - y)).sum())
    assert np.allclose(models.newton_logistic(x, y, w), [*theta, b], atol=1e-6)


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(f"q{i % 6}", f"d{i}", float(rng.normal()), float(rng.normal()), None if i % 7 == 0 else float(rng.integers(0, 4))) for i in range(90)]
    df = spark.createDataFrame(rows, "qid string, docno string, a double, b double, t double")
    got = models.ridge_out_of_fold(df, ["a", "b"], "t").collect()
    for r in got[:20]:
        train = [g for g in got if g["fold"] != r["fold"] and g["t"] is not None]
        x, y = np.array([[g["a"], g["b"]] for g in train]), np.array([g["t"] for g in train])
        m, s = x.mean(axis=0), x.std(axis=0)
        z = (x - m) / s
        beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
        want = float(np.clip(y.mean() + ((np.array([r["a"], r["b"]]) - m) / s) @ beta, 0, 3))
        assert r["predicted"] == pytest.approx(want, abs=1e-8)


def test_lifts(spark):
    df = feature_frame(spark).withColumns({"c": F.col("X") * 100.0 + 3, "none": F.lit(7.0)})
    r = analysis.residual_model(df, ["Y"], ["c", "none"], n_bootstrap=20).first()
    assert r["n_pairs"] == 24 and r["n_queries"] == 6 and r["cov_accuracy"] == 1.0 and r["lift"] > 0.4 and r["lift_ci_lo"] > 0 and r["pair_micro_lift"] > 0.4
    oof = spark.createDataFrame([(f"q{i}", True, 0.6, 0.9) for i in range(4)], "query_id string, y_true boolean, a double, b double")
    rows = {r["measure"]: (r["lift"], r["ci_lo"], r["ci_hi"]) for r in analysis.incremental_fidelity(oof, "a", "b", n_bootstrap=10).collect()}
    assert rows["accuracy"] == (0.0, 0.0, 0.0) and len(set(rows["log_loss"])) == 1


def test_fits_by_sums_equal_fits_by_counts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(f"q{i % 9}", f"a{i}", "z", int(rng.choice([-1, 1])), int(rng.integers(-1, 2)), int(rng.integers(-1, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "query_id string, doc_id_1 string, doc_id_2 string, model_pref int, X int, Y int")
    by_counts = models.joint_fit(df, ["X", "Y"])[1]
    monkeypatch.setattr(models, "MAX_PATTERNS", 3)
    by_sums = models.joint_fit(df, ["X", "Y"])[1]
    assert np.allclose(by_counts["full"], by_sums["full"], atol=1e-8) and by_counts["nulls"] == by_sums["nulls"]
    assert all(np.allclose(by_counts["fits"][k], by_sums["fits"][k], atol=1e-8) for k in by_counts["fits"])


def test_standardised_fit(spark):
    rng = np.random.default_rng(5)
    rows = [(f"q{i % 6}", f"a{i}", "z", int(rng.choice([-1, 1])), float(rng.normal(50, 9))) for i in range(120)]
    df = spark.createDataFrame(rows, "query_id string, doc_id_1 string, doc_id_2 string, model_pref int, c double")
    oof, found = models.joint_fit(df, ["c"], standardise=["c"])
    fold = {r["doc_id_1"]: r["fold"] for r in oof.collect()}
    for k, theta in found["fits"].items():
        train = [r for r in rows if fold[r[1]] != k]
        x, y = np.array([r[4] for r in train]), np.array([r[3] > 0 for r in train], float)
        want = models.newton_logistic(((x - x.mean()) / x.std())[:, None], y, np.ones(len(y)))
        assert np.allclose(theta, [want[0] / x.std(), want[1] - want[0] * x.mean() / x.std()], atol=1e-7)


def test_decomposition(spark):
    df = feature_frame(spark).withColumns({"n_presentations": F.lit(2), "position_consistent": F.lit(True)})
    r, oof = models.decompose(df, ["X", "Y"], nonlinear=True)
    r = r.first()
    assert (r["n_decisive_pairs"], r["cv_accuracy"], r["oof_error_fraction"], r["cv_auc"], r["single_order_accuracy_sensitivity"]) == (24, 1.0, 0.0, 1.0, 1.0)
    assert r["nonlinear_cv_accuracy"] == 1.0 and r["nonlinear_headroom"] == 0.0 and r["gain"] > 0.3
    assert oof.filter("is_residual").count() == 0
    terms = [x["term"] for x in models.coefficients(models.joint_fit(df, ["Y", "X"])[1], spark).orderBy("place").collect()]
    assert terms == ["X", "Y", "(intercept)"]
    both = models.paired_predictions(oof, oof).first()
    assert both["p_base"] == both["p_more"]


def test_folds_are_checked(spark):
    with pytest.raises(ValueError, match="fold"):
        models.check_folds(spark.createDataFrame([("q", 0), ("q", 1)], "query_id string, fold int"))
    with pytest.raises(ValueError, match="fold"):
        models.check_folds(spark.createDataFrame([("q", None)], "query_id string, fold int"))


def test_quantiles_and_sums_over_ranges(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 40, 500).astype(float), rng.normal(0, 1, 500)
    df = spark.createDataFrame([(float(x), float(y) if i % 9 else None) for i, (x, y) in enumerate(zip(a, b, strict=True))], "a double, b double").repartition(5)
    got = analysis.quantile_edges(df, ["a", "b"], 7)
    some = np.array([y for i, y in enumerate(b) if i % 9])
    for name, values in (("a", a), ("b", some)):
        assert np.allclose(got[name], sorted(set(np.quantile(values, np.arange(8) / 7))), atol=1e-12)
    counts = df.groupBy("a").agg(F.count("*").alias("n"))
    for r in analysis.sums_below(counts, ["a"], "n").collect():
        assert r["below"] == int((a < r["a"]).sum())
    assert analysis.quantile_edges(df.limit(0), ["a"], 3) == {"a": []}


def test_pool_ranks_are_needed(spark):
    pairs = spark.createDataFrame([("q", "a", "b")], "query_id string, doc_id_1 string, doc_id_2 string")
    pool = spark.createDataFrame([("q", "a", 1)], "qid string, docno string, rank int")
    with pytest.raises(Exception, match="not in the pool"):
        analysis.attach_rank_gap(pairs, pool).collect()
    assert analysis.attach_pool(pairs, pool, "rank").first()["rank_2"] is None


def test_candidates(spark):
    df = spark.createDataFrame([(f"q{i}", "a", "b", 1, 2, True, 0, 1, 1, (1 if i < 3 else 0), -1) for i in range(6)], MERGED)
    eligible = spark.createDataFrame([(f"q{i}", "AX1") for i in range(4)], "query_id string, axiom string")
    got = {r["axiom"]: r for r in analysis.candidate_agreement(df, ["AX1", "AX2"], eligible, 20).collect()}
    r = got["AX1"]
    assert (r["n_active_queries"], r["n_queries"], r["n_eligible_queries"], r["eligible_pair_coverage"], r["ci_lo"]) == (3, 6, 4, 0.75, None)
    r = got["AX2"]
    assert (r["n_eligible_queries"], r["eligible_pair_coverage"], r["n_negative"], r["ci_lo"], r["ci_hi"]) == (0, None, 6, 0.0, 0.0)
    joined = analysis.join_candidate(df, df.select(F.col("query_id").alias("qid"), "doc_id_1", "doc_id_2", F.lit(1).alias("NEW")), "c")
    assert {r["group_id"] for r in joined.collect()} == {f"c:q{i}" for i in range(6)}
    with pytest.raises(ValueError, match="one to one"):
        analysis.join_candidate(df, df.limit(2).select("query_id", "doc_id_1", "doc_id_2"), "c")
