import corpus_pipeline
from verdictlab.llm import pii, simhash
from verdictlab.llm.common import staged
from verdictlab.llm.fertility import fertility_rules

from .test_fertility import PATHS, brute
from .test_simhash import brute_components
from .test_tokens import check_packing


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "personal_data", "mixture", "packing"]
    kept = staged(stages["quality"](spark, docs, sf_dir), "t")
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    verdict = {r["doc_id"]: r["kept"] for r in fertility_rules(docs, *PATHS).collect()}
    assert kept.columns == docs.columns and set(texts) == {d for d, k in verdict.items() if k}
    assert not any(brute(t)[-1] for t in texts.values())
    assert len(texts) >= 0.97 * sum(not brute(r["text"])[-1] for r in docs.collect())

    one = staged(stages["near_dedup"](spark, kept, sf_dir), "t")
    want = {d for d, _, c in brute_components(list(texts.items())) if d == c}
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == want

    clean = staged(stages["personal_data"](spark, one, sf_dir), "t")
    after = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == docs.columns and set(after) == want
    for d, r in after.items():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert pii.base_spans(texts[d]) or pii.spans_of(pii.trained(), [texts[d]])[0][1] or r["text"] == texts[d]

    mixed = staged(stages["mixture"](spark, clean, sf_dir), "t")
    some = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert mixed.columns == docs.columns and 0 < len(some) < len(after) and all(after[d]["text"] == t for d, t in some.items())

    rows = stages["packing"](spark, mixed, sf_dir).collect()
    check_packing(rows, 2048)
    assert {r["doc_id"] for r in rows} == set(some)


def test_run_equals_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    again = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    check_packing(rows, 2048)


def test_null_ids_and_repeats(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i} other{i * 7 % 13}" for i in range(80))
    docs = spark.createDataFrame([(None, long, "en", "a", 1), (5, long, "en", "a", 1), (5, long, "en", "a", 1), (3, None, None, None, None), (9, long + " and more", "en", "b", 1)], schema)
    kept = corpus_pipeline.quality(spark, docs, "")
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 5, 5, 9]
    one = corpus_pipeline.near_dedup(spark, kept, "").collect()
    assert [r["doc_id"] for r in one].count(5) == 1 and None not in {r["doc_id"] for r in one}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    assert simhash.fingerprint("") == 0


def test_rows_are_judged_apart(spark):
    """Rows that share a doc_id, or have none, go or stay by their own texts; columns may have any name."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _kept long, key string, shard int, fp long, x_row string, root int, row int"
    text = lambda k: " ".join(f"word{i * k % 101} other{i * 7 % 13 + k}" for i in range(80))
    rest = ("en", "a", 1, 0, "k", 1, 2, "r", 3, 4)
    docs = spark.createDataFrame([(1, text(1), *rest), (1, "short", *rest), (None, text(2), *rest), (None, None, *rest), (None, text(2), *rest), (2, text(3), *rest), (2, text(4), *rest)], schema)
    kept = staged(corpus_pipeline.quality(spark, docs, ""), "t")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, text(1)), (0, text(2)), (0, text(2)), (2, text(3)), (2, text(4))])
    one = staged(corpus_pipeline.near_dedup(spark, kept, ""), "t")
    want = {c for _, _, c in brute_components([(i, t) for i, t in enumerate([text(1), text(2), text(3), text(4)])])}
    assert one.columns == docs.columns and {r["text"] for r in one.collect()} == {text(i + 1) for i in want} and one.count() == len(want)
    clean = staged(corpus_pipeline.personal_data(spark, one, ""), "t")
    assert clean.columns == docs.columns and clean.count() == one.count()
    mixed = staged(corpus_pipeline.mixture(spark, clean, ""), "t")
    assert mixed.columns == docs.columns
    assert corpus_pipeline.packing(spark, mixed, "").count() >= mixed.count()
