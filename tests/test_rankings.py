import pytest

from verdictlab.operators import pairs, ranking

POOL = "qid string, docno string, rank int, score double"
VERDICTS = "query_id string, doc_id_1 string, doc_id_2 string, model_pref int"


def order(run, qid="q"):
    return [r["docno"] for r in sorted(run.filter(f"qid = '{qid}'").collect(), key=lambda r: r["rank"])]


@pytest.fixture(scope="module")
def pool(spark):
    return spark.createDataFrame([("q", d, i, 10.0 - i) for i, d in enumerate("dcbaxy")] + [("p", d, i, 1.0 - i) for i, d in enumerate("ab")], POOL)


def test_copeland(spark, pool):
    # a beats b, c, d; b beats c; b and d tie; d beats c; x and y are in no pair
    v = spark.createDataFrame([("q", "a", "b", 1), ("q", "a", "c", 1), ("q", "a", "d", 1), ("q", "b", "c", 1), ("q", "b", "d", 0), ("q", "c", "d", -1), ("p", "a", "b", -1)], VERDICTS)
    run = ranking.copeland(v, pool)
    assert order(run) == ["a", "d", "b", "c", "x", "y"]
    assert order(run, "p") == ["b", "a"]
    assert all(r["score"] == -r["rank"] for r in run.collect())


def test_rerank_scored(spark, pool):
    scores = spark.createDataFrame([("q", "d", 2.0), ("q", "c", 3.0), ("q", "b", 3.0), ("q", "y", 9.0)], "qid string, docno string, s double")
    only = pool.filter("qid = 'q'")
    # a scored document below the depth keeps its place there
    assert order(ranking.rerank_scored(only, scores, 3)) == ["c", "b", "d", "a", "x", "y"]
    with pytest.raises(ValueError, match="without a score"):
        ranking.rerank_scored(only, scores, 4)
    assert order(ranking.rerank_scored(only, scores, 4, strict=False)) == ["c", "b", "d", "a", "x", "y"]
    with pytest.raises(ValueError, match="positive"):
        ranking.rerank_scored(only, scores, 0)


def test_metrics(spark):
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "b", 0), ("lost", "z", 2), ("none", "z", 0)], "query_id string, doc_id string, relevance int")
    first = spark.createDataFrame([("q", "a", 0, 0.0), ("q", "b", 1, -1.0)], POOL)
    second = spark.createDataFrame([("q", "b", 0, 0.0), ("q", "a", 1, -1.0)], POOL)
    one = {r["query_id"]: (r["ndcg_10"], r["ap"]) for r in ranking.evaluate(first, qrels).collect()}
    two = {r["query_id"]: (r["ndcg_10"], r["ap"]) for r in ranking.evaluate(second, qrels).collect()}
    assert one == {"q": (1.0, 1.0), "lost": (0.0, 0.0), "none": (0.0, 0.0)}
    assert two["q"] == (round(1 / 1.5849625007211562, 6), 0.5)


def frame(spark, values):
    return spark.createDataFrame([(f"q{i}", v, v) for i, v in enumerate(values)], "query_id string, ndcg_10 double, ap double")


def test_comparison(spark):
    got = {r["metric"]: r for r in ranking.compare_runs(frame(spark, [0.2, 0.5, 0.7]), frame(spark, [0.4, 0.5, 0.5])).collect()}
    r = got["ap"]
    assert (r["wins"], r["ties"], r["losses"], r["mean_delta"]) == (1, 1, 1, 0.0) and r["delta_ci_lo"] < 0 < r["delta_ci_hi"]
    same = ranking.compare_runs(frame(spark, [0.2, 0.5, 0.7]), frame(spark, [0.3, 0.6, 0.8])).first()
    assert (same["delta_ci_lo"], same["delta_ci_hi"]) == (0.1, 0.1)
    with pytest.raises(ValueError, match="one to one"):
        ranking.compare_runs(frame(spark, [0.1]), frame(spark, [0.1, 0.2]))


def test_contrasts(spark):
    runs = {"bm25": frame(spark, [0.2, 0.5]), "llm": frame(spark, [0.4, 0.5]), "a": frame(spark, [0.3, 0.7]), "b": frame(spark, [0.1, 0.9])}
    wanted = ranking.contrasts_of(["a", "b"], "a", "llm")
    assert [name for name, *_ in wanted] == ["llm_vs_bm25", "a_vs_bm25", "b_vs_bm25", "a_vs_llm", "b_vs_llm", "b_vs_a"]
    got = {(r["contrast"], r["metric"]): r["mean_delta"] for r in ranking.comparison_matrix(runs, wanted, 20).collect()}
    assert len(got) == 12 and got["b_vs_a", "ap"] == 0.0 and got["llm_vs_bm25", "ap"] == 0.1


def stored(spark, rows):
    return spark.createDataFrame([("q", a, b, v) for a, b, v in rows], "query_id string, doc_id_a string, doc_id_b string, verdict string")


def test_collapse(spark):
    s = stored(spark, [("a", "b", "a"), ("b", "a", "b"), ("a", "c", "a"), ("c", "a", "a"), ("d", "a", "b"), ("b", "c", "tie"), ("c", "b", "tie")])
    got = {(r["doc_id_1"], r["doc_id_2"]): (r["model_pref"], r["n_presentations"], r["position_consistent"], r["collapse_reason"]) for r in pairs.collapse_verdicts(s).collect()}
    assert got == {("a", "b"): (1, 2, True, "decisive"), ("a", "c"): (0, 2, False, "order_disagreement"), ("a", "d"): (1, 1, None, "decisive"), ("b", "c"): (0, 2, True, "model_tie")}
    stats = pairs.consistency_stats(pairs.collapse_verdicts(s)).first()
    assert (stats["n_pairs"], stats["n_both_orders"], stats["position_consistency"], stats["decisive_rate"]) == (4, 3, 0.666667, 0.5)


def test_triangles(spark):
    rows = [("t", "a", "b", 1), ("t", "a", "c", 1), ("t", "b", "c", 1), ("u", "a", "b", 1), ("u", "b", "c", 1), ("u", "a", "c", -1)]
    r = pairs.triangles(spark.createDataFrame(rows, VERDICTS)).first()
    assert (r["n_triangles_sampled"], r["n_complete_triangles"], r["n_cyclic"], r["nontransitivity_rate"]) == (2, 2, 1, 0.5)
    r = pairs.triangles(spark.createDataFrame([("t", "a", "b", 0), *rows[1:3]], VERDICTS)).first()
    assert (r["n_triangles_sampled"], r["n_complete_triangles"], r["nontransitivity_rate"]) == (1, 0, None)


def test_pair_samples(spark):
    pool = spark.createDataFrame([(q, d, i, 0.0) for q in ("q1", "q2") for i, d in enumerate("dbcae")], POOL)
    top = pairs.sample_pairs(pool, k=4).collect()
    assert len(top) == 12 and all(r["doc_id_1"] < r["doc_id_2"] for r in top)
    one, again, other = (sorted(map(tuple, pairs.sample_pairs(pool, "uniform", per_query=3, seed=s).collect())) for s in (1, 1, 2))
    assert one == again != other and len(one) == 6
    assert pairs.sample_pairs(pool, "uniform", per_query=99, max_queries=1).count() == 10
    with pytest.raises(ValueError, match="strategy"):
        pairs.sample_pairs(pool, "other")


def test_missing_and_wanted(spark):
    p = spark.createDataFrame([("q", "a", "b"), ("q", "a", "c")], "qid string, doc_id_1 string, doc_id_2 string")
    s = stored(spark, [("b", "a", "a"), ("a", "c", "b"), ("x", "y", "a")])
    assert sorted((r["doc_a"], r["doc_b"]) for r in pairs.missing_presentations(pairs.presentations(p), s).collect()) == [("a", "b"), ("c", "a")]
    assert pairs.wanted_rows(s, p.limit(1)).count() == 1


def test_exact_join(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string"), spark.createDataFrame([(1, "u"), (1, "v")], "k int, b string")
    for how in ("inner", "full", "left"):
        with pytest.raises(ValueError, match="one to one"):
            pairs.exact_join(a, b, ["k"], how)
    assert pairs.exact_join(a, b.limit(1), ["k"], "left").count() == 2


def test_mock_verdicts(spark):
    import hashlib

    topics = spark.createDataFrame([("q", "hello")], "qid string, query string")
    corpus = spark.createDataFrame([("a", "one"), ("b", "two")], "docno string, text string")
    shown = pairs.presentations(spark.createDataFrame([("q", "a", "b")], "qid string, doc_id_1 string, doc_id_2 string"))
    s = {d: int.from_bytes(hashlib.sha256(f"hello\0{t}".encode()).digest()[:8], "big") / 2**64 for d, t in (("a", "one"), ("b", "two"))}
    for r in pairs.mock_verdicts(shown, topics, corpus).collect():
        assert r["score_a"] == s[r["doc_id_a"]] and r["verdict"] == ("a" if s[r["doc_id_a"]] > s[r["doc_id_b"]] else "b")
        assert r["prob_a"] == pytest.approx(s[r["doc_id_a"]] / sum(s.values()))
