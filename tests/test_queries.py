import duckdb
import pytest

from verdictlab.plans.queries import ORACLE, QUERIES

TABLES = ("documents", "benchmark", "labels", "pages", "conversations")


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    at = [names.index(c) for c in sorted(df.columns)]
    clean = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    want = sorted((tuple(clean(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert len(names) == len(df.columns)
    assert sorted((tuple(clean(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_partitions_change_nothing(spark, sf_dir, partitions):
    first = sorted(map(tuple, QUERIES["g7_metrics_copeland"](spark, sf_dir).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert sorted(map(tuple, QUERIES["g7_metrics_copeland"](spark, sf_dir).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_works_without_llm(spark, monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module

    def lost(name):
        if name.startswith("verdictlab.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}")
        return real(name)

    monkeypatch.setattr(importlib, "import_module", lost)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE)
    assert entry.entry(spark).count() == 2
