import duckdb
import numpy as np
import pytest

from verdictlab.llm import mixing

from .fixtures import ODD_ROWS, SCHEMA, TEXTS, documents


def test_rake_meets_margins():
    rng = np.random.default_rng(0)
    strata = [rng.integers(0, k, 200) for k in (6, 4, 3)]
    tokens = rng.integers(1, 1000, 200).astype(float)
    shares = [mixing.tempered(tokens, of, power) for of, power in zip(strata, (0.7, 0.7, 0.85), strict=True)]
    w = mixing.rake(tokens, strata, shares, rounds=200)
    for of, share in zip(strata, shares, strict=True):
        assert np.bincount(of, tokens * w) / tokens.sum() == pytest.approx(share, rel=1e-6)


def test_weights_at_the_most_are_made_up_for():
    """A cell that may not be kept more than whole: the others of its strata take what it lacks, and all shares hold."""
    tokens, strata = np.array([10.0, 90, 100, 300]), [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])]
    shares = [np.array([0.35, 0.65]), np.array([0.3, 0.7])]
    free, held = (mixing.rake(tokens, strata, shares, 400, most) for most in (np.inf, 2.0))
    assert free.max() > 2.5 and held.max() == 2
    for of, share in zip(strata, shares, strict=True):
        assert np.bincount(of, tokens * held) / tokens.sum() == pytest.approx(share, rel=1e-3)


def test_rake_without_tokens():
    tokens, strata = np.array([0.0, 5.0]), [np.array([0, 1]), np.array([0, 0])]
    assert mixing.rake(tokens, strata, [mixing.tempered(tokens, of, 0.7) for of in strata]).tolist() == [1.0, 1.0]


def test_given_targets(spark):
    rows = [(i if i % 7 else None, f"w{i} " * 50, ("en", "de", None)[i % 3], "big" if i % 4 else "small", 0, 0, "", "") for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    targets = {"source": {"big": 2, "small": 1}, "lang": {"en": 0.5, "de": 0.25, None: 0.25}, "topic": {"even": 0.5, "odd": 0.5}}
    topic = lambda text, n: mixing.F.when(mixing.F.substring(text, 2, 1).cast("int") % 2 == 0, "even").otherwise("odd")
    out, x = mixing.mixed(docs, 0.4, targets=targets, topic=topic)
    assert x == "x_"
    rows = out.select("source", "lang", "x_topic", "x_tokens", "x_probability", "x_sampled").collect()
    for axis, at in (("source", 0), ("lang", 1), ("topic", 2)):
        total = sum(r[3] * r[4] for r in rows)
        for k, v in targets[axis].items():
            share = v / sum(targets[axis].values())
            assert sum(r[3] * r[4] for r in rows if r[at] == k) / total == pytest.approx(share, rel=1e-4)
            assert sum(r[3] for r in rows if r[at] == k and r[5]) / sum(r[3] for r in rows if r[5]) == pytest.approx(share, abs=0.04)
    assert total == pytest.approx(0.4 * 6000 * 50, rel=1e-4)
    for bad in ({"source": {"big": 1}}, {"source": {"big": -1, "small": 2}}, {"color": {"red": 1}}):
        with pytest.raises(ValueError, match="target|axes"):
            mixing.mixed(docs, 0.4, targets=bad)


def test_mixture_equals_sql(spark, tmp_path):
    texts = [*TEXTS, *["#a *b <c>"] * 3, *[f"mail a{i}@b.co and text " * (1 + i) for i in range(40)], *["plain words only " * (10 * i) for i in range(40)]]
    docs = documents(spark, texts, ODD_ROWS).repartition(3)
    docs.select("doc_id", "text", "source", "lang").write.parquet(f"{tmp_path}/d")
    got = mixing.raked_mixture(docs)
    want = duckdb.sql(mixing.sql(f"'{tmp_path}/d/*.parquet'")).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r) for r in want), key=repr)
    assert mixing.raked_mixture(spark.createDataFrame([], SCHEMA)).count() == 0


def test_expected_shares(spark):
    rows = [(i, f"w{i} " * 150, "en", "big" if i % 4 else "small", 0, 0, "", "") for i in range(4000)]
    out, _ = mixing.mixed(spark.createDataFrame(rows, SCHEMA))
    shares = {r["source"]: r["n"] for r in out.filter("x_sampled").groupBy("source").agg({"x_tokens": "sum"}).withColumnRenamed("sum(x_tokens)", "n").collect()}
    total = sum(shares.values())
    target = 0.75**0.7 / (0.75**0.7 + 0.25**0.7)
    assert shares["big"] / total == pytest.approx(target, abs=0.03)
    assert total == pytest.approx(4000 * 150 * mixing.KEEP, rel=0.06)


def test_too_many_cells(spark):
    with pytest.raises(ValueError, match="cells"):
        mixing.mixed(documents(spark, ["a"] * 3), max_cells=2)


def test_extra_columns_stay(spark):
    docs = documents(spark, TEXTS).selectExpr("*", "text AS x_weight", "1 AS X__tokens")
    assert mixing.sampled(docs).columns == docs.columns
