import json
from itertools import product
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdictlab.operators import distil, pairs, rankers, reversals
from verdictlab.plans import measurement
from verdictlab.plans.frames import Cell
from verdictlab.sources.config import Ranker

PAIRS = "qid string, doc_id_1 string, doc_id_2 string"


@pytest.fixture(scope="module")
def texts(spark):
    topics = spark.createDataFrame([("q", "hello"), ("p", "bye")], "qid string, query string")
    corpus = spark.createDataFrame([(d, f"text of {d} " * 3) for d in "abc"], "docno string, text string")
    return topics, corpus


def test_collection(spark, tmp_path, texts):
    path, protocols, settings = f"{tmp_path}/store", f"{tmp_path}/protocols.json", Ranker(max_chars=10**6)
    some, every = (spark.createDataFrame(rows, PAIRS) for rows in ([("q", "a", "b")], [("q", "a", "b"), ("q", "a", "c"), ("p", "b", "c")]))
    first = rankers.collect_verdicts("d", settings, some, *texts, path, protocols)
    assert first.count() == 2
    with pytest.raises(RuntimeError, match="4 of 6"):
        rankers.collect_verdicts("d", settings, every, *texts, path, protocols, allow_new=False)
    got = rankers.collect_verdicts("d", settings, every, *texts, path, protocols, flush=1).collect()
    assert len(got) == 6 and {r["created_at"] for r in first.collect()} <= {r["created_at"] for r in got}
    want = {(r["query_id"], r["doc_id_a"], r["doc_id_b"]): (r["verdict"], r["prob_a"]) for r in pairs.mock_verdicts(pairs.presentations(every), *texts).collect()}
    assert {(r["query_id"], r["doc_id_a"], r["doc_id_b"]): (r["verdict"], r["prob_a"]) for r in got} == want and all(r["latency_ms"] >= 0 for r in got)
    # nothing is asked again, in either order
    files = sorted(p.name for p in Path(path).glob("*.parquet"))
    assert rankers.collect_verdicts("d", settings, every, *texts, path, protocols, allow_new=False).count() == 6
    assert sorted(p.name for p in Path(path).glob("*.parquet")) == files
    with pytest.raises(ValueError, match="signature"):
        rankers.collect_verdicts("d", Ranker(max_chars=5), every, *texts, path, protocols)
    lost = spark.createDataFrame([("q", "a", "nowhere")], PAIRS)
    with pytest.raises(Exception, match="no text for nowhere"):
        rankers.collect_verdicts("d", settings, lost, *texts, path)


def test_one_order_and_short_passages(spark, tmp_path, texts):
    cut = {"longest": 0}

    def seen(prompt, label):
        return -float(len(prompt)) if label == "A" else -300.0

    settings = Ranker(backend="hf", model="m/x", order_swap=False, max_chars=7)
    got = rankers.collect_verdicts("d", settings, spark.createDataFrame([("q", "a", "b")], PAIRS), *texts, f"{tmp_path}/s", call=seen).collect()
    prompt = rankers.PROMPTS["v0"].format(query="hello", passage_a="text of", passage_b="text of")
    assert len(got) == 1 and got[0]["score_a"] == -float(len(prompt)) and got[0]["model"] == "m/x" and cut["longest"] == 0


def test_rankers():
    likely = {"A": -1.0, "B": -2.0}
    r = rankers.LabelRanker("m", lambda prompt, label: likely[label])
    v = r.compare("q", "x", "y")
    assert v.verdict == "a" and v.prob_a == pytest.approx(1 / (1 + 2.718281828 ** -1), abs=1e-6)
    assert rankers.LabelRanker("m", lambda *a: -3.0).compare("q", "x", "y") == ("tie", 0.5, -3.0, -3.0)
    first = rankers.FirstTokenRanker("m", lambda prompt: {" a": -0.5, "A": -2.0, "B": -1.0, "z": 0.0}).compare("q", "x", "y")
    assert (first.verdict, first.score_a, first.score_b) == ("a", -0.5, -1.0)
    assert rankers.FirstTokenRanker("m", lambda prompt: {"z": 0.0}).compare("q", "x", "y").verdict == "tie"
    assert rankers.FirstTokenRanker("m", lambda prompt: {"b": -1.0}).compare("q", "x", "y")[:2] == ("b", 0.0)
    assert isinstance(rankers.make_ranker(Ranker()), rankers.HashRanker)
    for bad, words in ((Ranker(backend="other"), "backend"), (Ranker(backend="hf"), "model"), (Ranker(backend="openai", model="m"), "base_url"), (Ranker(backend="hf", model="m"), "function")):
        with pytest.raises(ValueError, match=words):
            rankers.make_ranker(bad)


def test_signatures():
    one = rankers.protocol_signature(Ranker())
    assert one == rankers.protocol_signature(Ranker(batch_flush=7, order_swap=False)) and json.loads(one)["scoring"] == "hash"
    assert len({one, *(rankers.protocol_signature(r) for r in (Ranker(max_chars=5), Ranker(backend="hf", model="m"), Ranker(backend="hf", model="n")))}) == 4


def test_sanity_gate():
    class Reads:
        name = "reads"

        def compare(self, query, a, b):
            score = [len(set(query.split()) & set(p.lower().replace(",", " ").split())) for p in (a, b)]
            return rankers.decided(*map(float, score), 0.9 if score[0] > score[1] else 0.1)

    class First:
        name = "first"

        def compare(self, query, a, b):
            return rankers.Verdict("a", 0.9, 1.0, 0.0)

    assert rankers.passes(Reads()) and len(rankers.sanity_gate(Reads())) == 4
    assert [ok for *_, ok in rankers.sanity_gate(First())] == [True, False, True, False] and not rankers.passes(First())


def test_measured_cell(spark, sf_dir, tmp_path):
    cell = Cell(spark, sf_dir, axioms=["TFC1", "VERB", "QCOV", "DIV"])
    kept = measurement.feature_set(cell.merged, cell.axiom_names, later=("DIV",))
    assert "DIV" not in kept and set(kept) <= {"TFC1", "VERB", "QCOV"}
    out = measurement.measure_cell(cell, [Ranker(), Ranker(backend="hf", model="other")], f"{tmp_path}/store", "d", {"all": kept}, "all", only_model="mock", folder=f"{tmp_path}/out", n_bootstrap=50)
    report = out["mock"]
    assert set(out) == {"mock"} and set(report) == {"agreement", "consistency", "joint_fit", "gradient"}
    assert report["consistency"].first()["position_consistency"] == 1.0 and report["consistency"].first()["mean_latency_ms"] > 0
    assert "joint_cv_accuracy" in report["gradient"].columns and report["agreement"].count() == 4
    files = {p.name for p in Path(f"{tmp_path}/out/mock").iterdir()}
    assert files == {"agreement.csv", "consistency.json", "joint_fit.json", "gradient.csv"}
    assert len(pd.read_csv(f"{tmp_path}/out/mock/agreement.csv")) == 4 and json.loads(Path(f"{tmp_path}/out/mock/consistency.json").read_text())["n_pairs"] > 0
    with pytest.raises(ValueError, match="no ranker"):
        measurement.chosen_rankers([Ranker()], "gpt")
    with pytest.raises(ValueError, match="axioms"):
        measurement.measured(cell, cell.stored, {}, names=["NOPE"])


def test_scores_are_resumed(spark, tmp_path):
    scope = spark.createDataFrame([("q", f"d{i}") for i in range(20)], "qid string, docno string")
    asked = []

    def score(some):
        asked.append(sorted(r["docno"] for r in some.collect()))
        return some.withColumn("s", F.length("docno").cast("double"))

    path, schema = f"{tmp_path}/s", "qid string, docno string, s double"
    assert distil.resumed(spark, scope.limit(6), path, score, schema, 1).count() == 6
    assert distil.resumed(spark, scope, path, score, schema, 3).count() == 20
    assert sorted(d for part in asked for d in part) == sorted(f"d{i}" for i in range(20))
    assert distil.resumed(spark, scope, path, lambda some: pytest.fail("asked again"), schema).count() == 20
    with pytest.raises(ValueError, match="lacks"):
        distil.resumed(spark, scope, path, score, schema + ", t int")
    with pytest.raises(ValueError, match="one to one"):
        distil.whole_scope(scope.limit(3), scope)


def test_transfer_and_adaptation(spark):
    rows = [(f"q{i % 5}", f"d{i}", float(i), float(i % 3), 0.01 * i + 0.5 * (i % 3)) for i in range(60)]
    frame = spark.createDataFrame(rows, "qid string, docno string, a double, b double, adequacy double")
    other = spark.createDataFrame([("z", "x", 10.0, 2.0), ("z", "y", 900.0, 2.0), ("z", "w", -900.0, 0.0)], "qid string, docno string, a double, b double")
    got = {r["docno"]: r["predicted"] for r in distil.transfer(frame, other, ["a", "b"])[0].collect()}
    assert got["x"] == pytest.approx(1.1, abs=0.05) and (got["y"], got["w"]) == (3.0, 0.0)
    held = distil.adapted(frame, ["a", "b"], 2)
    assert held.select("qid").distinct().count() == 3 and held.filter("in_train").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        distil.adapted(frame, ["a", "b"], 5)
    with pytest.raises(ValueError, match="without a label"):
        distil.adapted(frame.withColumn("adequacy", F.lit(None).cast("double")), ["a", "b"], 2)
    pool = frame.select("qid", "docno", (F.row_number().over(distil_window()) - 1).alias("rank"), F.lit(0.0).alias("score"))
    qrels = frame.select(F.col("qid").alias("query_id"), F.col("docno").alias("doc_id"), (F.col("b") > 1).cast("int").alias("relevance"))
    assert {r["n_queries"] for r in distil.effect(pool, held, qrels, 12, n_bootstrap=20).collect()} == {3}


def distil_window():
    from pyspark.sql import Window

    return Window.partitionBy("qid").orderBy("docno")


def test_gate_diagnostics(spark):
    rows = [(3.0, 3, 0.3, 0.9, 1.0), (2.6, 3, 0.5, 0.1, 2.0), (1.0, 1, 0.1, 0.2, 3.0), (None, None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "adequacy double, argmax int, relevance_probability double, nli_entailment double, mrc_margin double")
    got = {r["argmax"]: r for r in distil.gate_diagnostics(df).collect()}
    assert (got[None]["n_documents"], got[None]["n_high"], got[None]["relevance_false_negative_rate"], got[None]["nli_false_negative_rate"]) == (3, 2, 0.5, 0.5)
    assert got[1]["relevance_false_negative_rate"] is None and got[3]["mean_mrc_margin"] == 1.5


def test_reversals_in_order(spark, tmp_path):
    docs = "abcd"
    merged = spark.createDataFrame([("q", x, y, 1, 1) for x, y in product("ab", "cd")], "query_id string, doc_id_1 string, doc_id_2 string, pred int, AX int")
    run = lambda order: spark.createDataFrame([("q", d, i) for i, d in enumerate(order)], "qid string, docno string, rank int")
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], "query_id string, doc_id string, relevance int")
    gains = spark.createDataFrame([("q", 0.5)], "query_id string, gain double")
    found = reversals.reversals(merged, ["AX"], run("cdba"), run("abcd"), qrels, gains=gains)
    assert [(r["winner_doc"], r["loser_doc"]) for r in found.collect()] == [("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")]
    assert reversals.reversals(merged, ["AX"], run("cdba"), run("abcd"), qrels, n=3).count() == 3
    topics = spark.createDataFrame([("q", "what")], "qid string, query string")
    corpus = spark.createDataFrame([(d, f"text {d}\nmore") for d in docs], "docno string, text string")
    page = reversals.inspection(found, topics, corpus, ["AX"], 2)
    assert page.count("## ") == 2 and "Winner `a`" in page and "> more" in page and page.index("Loser `c`") < page.index("Loser `d`")
    Path(f"{tmp_path}/a.csv").write_text("case_id,query_id,winner_doc,loser_doc,note\n1,q,a,c,good\n")
    notes = reversals.read_annotations(spark, f"{tmp_path}/a.csv")
    assert reversals.annotated(notes, found).first()["note"] == "good"
    Path(f"{tmp_path}/b.csv").write_text("case_id,query_id,winner_doc,loser_doc\n7,q,c,a\n")
    with pytest.raises(ValueError, match="'7'"):
        reversals.annotated(reversals.read_annotations(spark, f"{tmp_path}/b.csv"), found)
