import json
import os
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from verdictlab.functions.markup import prepared_query, prose
from verdictlab.operators import gates
from verdictlab.plans.frames import Cell
from verdictlab.sources import config, store
from verdictlab.sources.index import Index, index_ref
from verdictlab.sources.retrieval import checked_pool


def row(q="q", a="x", b="y", verdict="a", at="2024-01-01T00:00:00", model="m"):
    return ("d", q, a, b, model, "v0", verdict, 0.9, 1.0, float("-inf"), 3.0, at)


def test_store(spark, tmp_path):
    path = f"{tmp_path}/store"
    assert store.load(spark, path).count() == 0
    store.append(spark.createDataFrame([row(verdict="b", at="2024-01-02T00:00:00")], store.SCHEMA), path)
    store.append(spark.createDataFrame([row(), row(q="p", model="n")], store.SCHEMA), path)
    got = {(r["query_id"], r["model"]): r["verdict"] for r in store.load(spark, path).collect()}
    assert got == {("q", "m"): "a", ("p", "n"): "a"}
    assert store.load(spark, path, model="n").count() == 1
    with pytest.raises(Exception, match="unknown verdict"):
        store.append(spark.createDataFrame([row(verdict="c")], store.SCHEMA), path)
    # further columns are left out
    store.append(spark.createDataFrame([(*row(q="r"), 1)], store.SCHEMA + ", more int"), path)
    assert store.load(spark, path).count() == 3 and "more" not in store.load(spark, path).columns
    with pytest.raises(ValueError, match="missing"):
        store.append(spark.createDataFrame([row()], store.SCHEMA).drop("verdict"), path)
    with pytest.raises(ValueError, match="key"):
        store.load(spark, path, verdict="a")


def test_rows(spark):
    made = store.new_row(dataset="d", query_id="q", doc_id_a="x", doc_id_b="y", model="m", prompt_version="v0", verdict="tie")
    assert len(made) == len(store.SCHEMA.split(", ")) and made[-1].endswith("+00:00") and made[7] is None
    with pytest.raises(ValueError, match="verdict"):
        store.new_row(dataset="d", query_id="q", doc_id_a="x", doc_id_b="y", model="m", prompt_version="v0", verdict="c")
    stamp = store.stamped(spark.range(1)).first()["created_at"]
    assert stamp[:13] == datetime.now(timezone.utc).isoformat()[:13] and len(stamp) == 25


def test_protocols(tmp_path):
    path = f"{tmp_path}/protocols.json"
    store.register_protocol(path, "m", "v0", "s")
    store.register_protocol(path, "m", "v0", "s")
    with pytest.raises(ValueError, match="signature"):
        store.register_protocol(path, "m", "v0", "t")
    # many writers wait for each other, and none is lost
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda i: store.register_protocol(path, f"m{i}", "v0", "s"), range(24)))
    assert len(json.loads((tmp_path / "protocols.json").read_text())) == 25
    # the lock of a writer that died is taken over, that of one at work is waited for
    lock = tmp_path / "protocols.json.lock"
    lock.write_text("")
    with pytest.raises(TimeoutError):
        store.register_protocol(path, "n", "v0", "s", patience=0.1)
    os.utime(lock, (0, 0))
    store.register_protocol(path, "n", "v0", "s", patience=0.1)
    assert not lock.exists()


def test_adequacy_store(spark, tmp_path):
    path = f"{tmp_path}/a"
    one = lambda d, value, at: ("q", d, "m", "v0", value, None, None, None, None, None, 1, at)
    store.append_adequacy(spark.createDataFrame([one("x", 1.0, "1"), one("y", 2.0, "1")], store.ADEQUACY), path)
    store.append_adequacy(spark.createDataFrame([one("x", 3.0, "2"), one("y", None, "2"), one("z", float("nan"), "2")], store.ADEQUACY), path)
    got = {r["doc_id"]: r["adequacy"] for r in store.load_scores(spark, path, store.ADEQUACY, ["query_id", "doc_id"], "adequacy").collect()}
    assert got == {"x": 3.0, "y": 2.0}
    with pytest.raises(ValueError, match="missing"):
        store.append_adequacy(spark.createDataFrame([("q",)], "query_id string"), path)
    with pytest.raises(ValueError, match="lacks"):
        store.load_scores(spark, path, store.ADEQUACY + ", other int", ["query_id", "doc_id"], "adequacy")


def test_cache(spark, tmp_path):
    path, calls = f"{tmp_path}/frame", []

    def compute(n):
        return lambda: calls.append(n) or spark.range(n)

    for mark, n, want in (("x", 3, 3), ("x", 4, 3), ("y", 5, 5)):
        assert store.cached_frame(spark, path, mark, compute(n)).count() == want
    assert store.cached_frame(spark, path, "y", compute(6), refresh=True).count() == 6
    assert calls == [3, 5, 6]
    old = f"{tmp_path}/old"
    spark.range(2).write.parquet(old)
    assert store.cached_frame(spark, old, "z", compute(9), old_is_valid=lambda df: True).count() == 2
    assert store.cached_frame(spark, old, "z", compute(9)).count() == 2
    # a writer that finds its frame published by another takes that
    race = f"{tmp_path}/race"

    def late():
        store.cached_frame(spark, race, "m", lambda: spark.range(4))
        return spark.range(4)

    assert store.cached_frame(spark, race, "m", late).count() == 4
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("race")) == ["race"]


def test_index(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "Red red blue"), ("b", "blue"), ("c", "")], "docno string, text string")
    found = index_ref(spark, str(tmp_path), corpus, "mark")
    assert found.size == (3, 4 / 3) and {r["term"]: r["df"] for r in found.terms.collect()} == {"red": 1, "blue": 2}
    r = found.postings.filter("docno = 'a' AND term = 'red'").first()
    assert (r["tf"], r["first"], r["places"], r["dl"]) == (2, 0, [0, 1], 3)
    # it is read again, by name too, and built anew for other tables
    again = index_ref(spark, str(tmp_path), spark.createDataFrame([], "docno string, text string"), "mark")
    assert again.path == found.path and again.size[0] == 3
    assert index_ref(spark, "", corpus, "", built={"x": found.path}, name="x").size[0] == 3
    assert index_ref(spark, str(tmp_path), corpus.limit(1), "other").path != found.path
    with pytest.raises(FileNotFoundError):
        index_ref(spark, "", corpus, "", name=f"{tmp_path}/none")
    words = Index.of(corpus, lambda text: F.split(F.lower(text), "e"))
    assert {r["term"] for r in words.terms.collect()} >= {"r", "d r", "d blu"}


def test_stages_follow_their_inputs(spark, tmp_path, sf_dir):
    """Stages are kept under a folder, found again by another session's cell, and computed anew where something before them changed."""
    import shutil

    for t in ("benchmark", "documents", "labels"):
        shutil.copy(f"{sf_dir}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    cell = lambda **more: Cell(spark, str(tmp_path), cache=f"{tmp_path}/cache", **more)
    names = lambda: sorted(p.name for p in (tmp_path / "cache").iterdir() if p.name.startswith("pairs"))
    n = cell().pairs.count()
    assert cell().pairs.count() == n and len(names()) == 1
    assert cell(k=5).pairs.count() < n and len(names()) == 2
    os.utime(tmp_path / "documents.parquet", (1, 1))
    assert cell().pairs.count() == n and len(names()) == 3
    assert cell(only_kept=True).pairs.count() == n
    with pytest.raises(FileNotFoundError):
        cell(only_kept=True).verdicts.count()
    with pytest.raises(Exception, match="more than 3 documents"):
        checked_pool(cell().pool, 3).count()


def test_guard(tmp_path):
    with pytest.raises(PermissionError, match="read"):
        store.check_allowed("d", f"{tmp_path}/none.json")
    (tmp_path / "m.json").write_text(json.dumps({"locked": ["d"]}))
    with pytest.raises(PermissionError, match="locked"):
        store.check_allowed("d", f"{tmp_path}/m.json")
    store.check_allowed("d", f"{tmp_path}/m.json", unlocked=True)
    store.check_allowed("e", f"{tmp_path}/m.json")


def test_snapshots(tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a").write_text("1")
    (tmp_path / "r/b").write_text("2")
    store.snapshot(f"{tmp_path}/r", f"{tmp_path}/s")
    assert store.verify_snapshot(f"{tmp_path}/s") == {"missing": [], "extra": [], "changed": []}
    (tmp_path / "s/files/a").write_text("x")
    (tmp_path / "s/files/b").unlink()
    (tmp_path / "s/files/c").write_text("")
    assert store.verify_snapshot(f"{tmp_path}/s") == {"missing": ["b"], "extra": ["c"], "changed": ["a"]}
    found = store.write_manifest(f"{tmp_path}/m.json", {"k": 1}, [f"{tmp_path}/r/a"], [], ["none.lock"])
    assert found["locks"] == {"none.lock": None} and json.loads((tmp_path / "m.json").read_text()) == found
    assert found["environment"]["python"] and found["environment"]["pyspark"]


def test_restore(spark, tmp_path):
    (tmp_path / "r").mkdir()
    spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/r/t")
    store.snapshot(f"{tmp_path}/r", f"{tmp_path}/s")
    assert list(store.restore_test(f"{tmp_path}/s", spark).values()) == [7]
    (tmp_path / "s/files/more").write_text("")
    with pytest.raises(ValueError, match="inventory"):
        store.restore_test(f"{tmp_path}/s", spark)


def test_config(tmp_path):
    tree = {"experiment": "e", "dataset": {"irds_id": "d"}, "pairs": {"k": 5}, "axioms": {"lexical": ["TF-LNC", {"name": "TFC1", "alias": "T@2-x", "params": {"margin": 0.2}}]}, "rankers": [{"backend": "hf", "model": "m"}], "sources": ["a.yaml"]}
    c = config.from_dict(tree)
    assert c.pairs.k == 5 and [config.column_name(a) for a in c.axioms] == ["TF_LNC", "T@2_x"] and c.dataset.irds_id == "d"
    assert [r.model for r in config.rankers_of(c)] == ["m"] and config.rankers_of(config.from_dict({"experiment": "e"}))[0].backend == "mock"
    config.dump(c, f"{tmp_path}/out/c.yaml")
    assert config.load(f"{tmp_path}/out/c.yaml") == c
    for bad in ({"oops": 1}, {"pairs": {"oops": 1}}, {"axioms": {"lexical": ["AND", "AND"]}}, {"first_stage": {"retriever": "other"}}, {"pairs": {"k": "five"}}, {"dataset": {}}, {"rankers": {"backend": "hf"}}, {"seed": True}):
        with pytest.raises(ValueError):
            config.from_dict({"experiment": "e", **bad})


def test_prose():
    html = "<html><header>Top</header><nav>Menu <b>x</b></nav><p>Use <code>sorted</code> in&nbsp;Python.</p><script>var a;</script><footer>End</footer>"
    assert prose(html) == "Use sorted in Python." and prose(None) is None and prose("plain  text") == "plain text"
    # nested and unmatched ends: each end of a hidden element closes the innermost one
    assert prose("a<nav>b<nav>c</nav>d</nav>e</nav>f<header>g</footer>h") == "a e f h"


def test_prepared_query(spark):
    q = spark.createDataFrame([("parse JSON in Python lang:python site:docs.example",), ("plain",)], "q string")
    a, b = (r[0] for r in q.select(prepared_query(F.col("q"))).collect())
    assert (a["text"], a["constraints"]) == ("parse JSON in Python", ["python", "docs.example"]) and (b["text"], b["constraints"]) == ("plain", [])


def test_gates(spark):
    docs = spark.createDataFrame([("q", "in python", "a", "0.39 0.9"), ("q", "in python", "b", "0.40 0.64"), ("q", "in python", "c", "0.9 0.65"), ("q", "in python", "d", "0.9 0.9 python"), ("q", "plain", "e", "0.5 0.7")], "qid string, query string, docno string, text string")
    number = lambda i: lambda *cs: F.try_element_at(F.split([c for c in cs][0 if i else 1], " "), F.lit(i + 1)).cast("double")
    same = lambda c, words: F.when(F.array_contains(words, c), 1.0).otherwise(0.0)
    got = {r["docno"]: (r["score"], r["entailment"] is None, r["similarity"]) for r in gates.gated(docs, number(0), number(1), same).collect()}
    assert got == {"a": (0, True, None), "b": (1, False, None), "c": (2, False, 0.0), "d": (3, False, 1.0), "e": (3, False, None)}
    with pytest.raises(ValueError, match="thresholds"):
        gates.gated(docs, number(0), number(1), same, (0.4, 1.2, 0.5))
    with pytest.raises(Exception, match="relevance must be"):
        gates.gated(docs, lambda q, p: F.lit(1.5), number(1), same).collect()


def test_labels(spark):
    kind = "id int, e array<struct<token: string, logprob: double>>"
    rows = [(0, [("A", -2.0), (" a", -0.5), ("B", -1.0)]), (1, [("A", -2.0), ("z", 0.0)]), (2, [("z", 0.0)]), (3, [("B", -1.0), ("A", -1.0)])]
    got = {r["id"]: r["v"] for r in spark.createDataFrame(rows, kind).select("id", gates.label_verdict(F.col("e")).alias("v")).collect()}
    assert [got[i]["verdict"] for i in range(4)] == ["a", "a", "tie", "tie"]
    assert got[0]["score_a"] == -0.5 and got[1]["prob_a"] == 1.0 and got[2]["prob_a"] == 0.5
    rows = [(0, [("0", -1.0), (" 3", -1.0), ("x", 0.0)]), (1, [("x", 0.0)])]
    got = {r["id"]: r["v"] for r in spark.createDataFrame(rows, kind).select("id", gates.adequacy(F.col("e")).alias("v")).collect()}
    assert (got[0]["adequacy"], got[0]["argmax"], got[0]["n_label_logprobs"]) == (1.5, 0, 2) and got[1]["adequacy"] is None and got[1]["argmax"] == -1


def test_adapters(spark):
    import numpy as np

    from verdictlab.operators import adapters

    df = spark.createDataFrame([([0.5], [1.0, 3.0, 2.0], [1.0, 0.0], [[0.0, 2.0], [3.0, 3.0]])], "one array<double>, three array<double>, v array<double>, vs array<array<double>>")
    r = df.select(adapters.relevance_of(F.col("one")), adapters.entailment_of(F.col("three"), 1), adapters.similarity_of(F.col("v"), F.col("vs")), adapters.similarity_of(F.col("v"), F.slice("vs", 1, 0))).first()
    assert r[0] == pytest.approx(1 / (1 + np.exp(-0.5))) and r[1] == pytest.approx(np.exp(3) / np.exp([1, 3, 2]).sum()) and r[2] == pytest.approx(np.sqrt(0.5)) and r[3] == 0
    with pytest.raises(Exception, match="one logit"):
        df.select(adapters.relevance_of(F.col("three"))).collect()
    rng = np.random.default_rng(0)
    for n, most in ((1, 30), (5, 2), (40, 3), (40, 30)):
        starts, ends = rng.normal(size=(2, n + 2))
        context = np.arange(2, n + 2)
        want = max(starts[i] + ends[j] for i in context for j in context if i <= j < i + most) - starts[0] - ends[0]
        row = spark.createDataFrame([(starts.tolist(), ends.tolist(), context.tolist())], "s array<double>, e array<double>, c array<int>")
        assert row.select(adapters.margin_of(F.col("s"), F.col("e"), F.col("c"), most)).first()[0] == pytest.approx(want)
        assert adapters.answer_margin(starts, ends, context, most) == pytest.approx(want)
    empty = spark.createDataFrame([([1.0], [1.0], [])], "s array<double>, e array<double>, c array<int>")
    assert empty.select(adapters.margin_of(F.col("s"), F.col("e"), F.col("c"))).first()[0] == float("-inf") == adapters.answer_margin(np.ones(1), np.ones(1), np.zeros(0, int))
    score = adapters.scorer(lambda: lambda a, b: [len(x) / len(y) for x, y in zip(a, b, strict=True)])
    assert spark.createDataFrame([("ab", "abcd")], "a string, b string").select(score("a", "b")).first()[0] == 0.5
