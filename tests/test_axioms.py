import pytest

from verdictlab.operators import axioms
from verdictlab.operators.answers import answer_preferences


def preferences(spark, query, one, two, scores=(1.0, 1.0), names=None):
    """The axioms' preferences in both orders of the documents, which must be opposite."""
    topics = spark.createDataFrame([("q", query)], "qid string, query string")
    filler = [(f"z{i}", "unrelated filler words about nothing") for i in range(6)] + [("y0", "alpha again")]
    corpus = spark.createDataFrame([("a", one), ("b", two), *filler], "docno string, text string")
    pool = spark.createDataFrame([("q", "a", 0, scores[0]), ("q", "b", 1, scores[1])], "qid string, docno string, rank int, score double")
    frame = spark.createDataFrame([("q", "a", "b"), ("q", "b", "a")], "qid string, doc_id_1 string, doc_id_2 string")
    rows = {r["doc_id_1"]: r.asDict() for r in axioms.axiom_preferences(pool, frame, topics, corpus, names).collect()}
    keys = [k for k in rows["a"] if k not in ("qid", "doc_id_1", "doc_id_2")]
    assert all(rows["a"][k] == -rows["b"][k] for k in keys)
    return {k: rows["a"][k] for k in keys}


def test_frequency_and_length(spark):
    got = preferences(spark, "alpha beta", "alpha alpha beta x", "alpha beta x y")
    assert (got["TFC1"], got["QCOV"], got["AND_"], got["VERB"], got["DIV"]) == (1, 0, 0, 0, -1)
    assert preferences(spark, "alpha beta", "alpha alpha", "alpha x y z u v w", names=["TFC1"]) == {"TFC1": 0}
    got = preferences(spark, "alpha", "alpha x", "alpha x y z", names=["LNC1", "VERB", "TF_LNC"])
    assert got == {"LNC1": 1, "VERB": -1, "TF_LNC": 0}
    assert preferences(spark, "alpha", "alpha alpha x y", "alpha x y", names=["TF_LNC", "TF_LNC_R"]) == {"TF_LNC": 1, "TF_LNC_R": 1}


def test_coverage(spark):
    got = preferences(spark, "alpha beta", "alpha beta z", "alpha z z", names=["AND_", "QCOV", "VERB", "VERB_R", "LB1", "DIV"])
    assert got == {"AND_": 1, "QCOV": 1, "VERB": 0, "VERB_R": 0, "LB1": 1, "DIV": -1}
    assert preferences(spark, "alpha beta", "alpha beta z", "alpha z z", scores=(9.0, 1.0), names=["LB1"]) == {"LB1": 0}


def test_proximity(spark):
    names = ["PROX1", "PROX2", "PROX3", "PROX4", "PROX5"]
    got = preferences(spark, "alpha beta", "alpha beta x y z", "x alpha y z beta", names=names)
    assert got == dict.fromkeys(names, 1)
    # adjacent terms are at no distance, whichever comes first
    assert preferences(spark, "alpha beta", "x alpha beta", "x beta alpha", names=["PROX1"]) == {"PROX1": 0}
    assert preferences(spark, "alpha beta", "alpha x", "alpha beta", names=names) == {"PROX1": 0, "PROX2": 0, "PROX3": -1, "PROX4": 0, "PROX5": 0}
    assert preferences(spark, "alpha", "x alpha", "y y alpha", names=["PROX1", "PROX2"]) == {"PROX1": 0, "PROX2": 1}


def test_discrimination(spark):
    # beta is rarer than alpha, which a filler document holds too
    got = preferences(spark, "alpha beta", "beta beta alpha", "alpha alpha beta", names=["M_TDC", "M_TDC_R"])
    assert got == {"M_TDC": 1, "M_TDC_R": 1}
    assert preferences(spark, "gamma beta", "gamma beta x y", "gamma gamma x y", names=["TFC3"])["TFC3"] in (0, 1)


def test_empty_texts_and_unknown_names(spark):
    assert set(preferences(spark, "alpha beta", "", "").values()) == {0}
    with pytest.raises(ValueError, match="unknown"):
        preferences(spark, "alpha", "a", "b", names=["NOPE"])
    assert axioms.with_margin("TFC1", 0.2) == axioms.AXIOMS["TFC1_len0_2"]
    with pytest.raises(ValueError, match="margin"):
        axioms.with_margin("AND_", 0.1)


def answers(spark, query, one, two):
    topics = spark.createDataFrame([("q", query)], "qid string, query string")
    corpus = spark.createDataFrame([("a", one), ("b", two)], "docno string, text string")
    frame = spark.createDataFrame([("q", "a", "b"), ("q", "b", "a")], "qid string, doc_id_1 string, doc_id_2 string")
    rows = {r["doc_id_1"]: r.asDict() for r in answer_preferences(frame, topics, corpus).collect()}
    got = {k: rows["a"][k] for k in ("DEFANS", "NUMANS", "COMPARE", "CBP")}
    assert all(rows["b"][k] == -v for k, v in got.items())
    return got


def test_definitions(spark):
    assert answers(spark, "define osmosis", "Osmosis is the movement of water.", "We like osmosis here.")["DEFANS"] == 1
    assert answers(spark, "define osmosis", "Osmosis is associated with water.", "We like osmosis here.")["DEFANS"] == 0
    assert answers(spark, "osmosis", "Osmosis is the movement of water.", "We like osmosis here.")["DEFANS"] == 0


def test_numbers(spark):
    assert answers(spark, "how many bones", "There are 206 bones in the body.", "The bones are hard and many.")["NUMANS"] == 1
    assert answers(spark, "how many bones", "In 1999 we saw how hard all the bones are.", "The bones are hard.")["NUMANS"] == 0
    assert answers(spark, "how long do eggs boil", "Eggs boil for ten minutes.", "Eggs boil in water.")["NUMANS"] == 1
    assert answers(spark, "how much money do nurses make", "Nurses earn $40,000.", "Nurses earn little.")["NUMANS"] == 1


def test_comparisons(spark):
    q = "difference between cats and dogs"
    assert answers(spark, q, "Cats are small while dogs are large.", "Cats sleep. Then nothing. Dogs run.")["COMPARE"] == 1


def test_boilerplate(spark):
    assert answers(spark, "blue whales", "Blue whales are huge.", "Blue whales. Click here. Contact us. www.x.org")["CBP"] == 1
    assert answers(spark, "who is john smith", "John Smith is a man.", "John Smith. Click here. Contact us.")["CBP"] == 0
    assert answers(spark, "list of blue whales", "Blue whales are huge.", "Blue whales. Click here. Contact us.")["CBP"] == 0
