"""Document pairs of a query, their presentations to a ranker, and stored verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictlab.functions.text import hash_score
from verdictlab.sources.staging import staged

PAIR = ("qid", "doc_id_1", "doc_id_2")
#: What the biased mock ranker adds to the passage shown first, and the margin within which it calls a tie.
POSITION_BIAS, TIE_MARGIN = 0.15, 0.02


def exact_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of one row to one row. ``inner`` and ``full`` fail unless both sides hold the same keys, ``left`` unless the right side's are unique.

    The check is one aggregate over keys, before the join.
    """
    keys = left.select(*on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*on, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    seen = keys.groupBy(*on).agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    bad = (F.col("r") > 1) | (F.col("l") > 1) | ((F.col("l") != F.col("r")) if how != "left" else F.lit(False))
    n = seen.filter(bad).count()
    if n:
        raise ValueError(f"{n} keys of {on} don't match one to one")
    return left.join(right, on, "left" if how == "left" else "inner")


def canonical(qid: str, a: Column, b: Column) -> list[Column]:
    return [F.col(qid), F.least(a, b).alias("doc_id_1"), F.greatest(a, b).alias("doc_id_2")]


def top_k_pairs(pool: DataFrame, k: int = 10) -> DataFrame:
    """All pairs of a query's ``k`` best documents."""
    top = pool.filter(F.col("rank") < k).select("qid", "docno", "rank")
    a, b = top.alias("a"), top.alias("b")
    both = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.rank") < F.col("b.rank")))
    return both.select(F.col("a.qid").alias("qid"), F.least("a.docno", "b.docno").alias("doc_id_1"), F.greatest("a.docno", "b.docno").alias("doc_id_2")).distinct()


def uniform_pairs(pool: DataFrame, per_query: int, seed: int = 42, max_queries: int | None = None) -> DataFrame:
    """``per_query`` pairs of each query's pool by the order of a seeded hash; of the first ``max_queries`` queries by id."""
    if max_queries is not None:
        first = pool.select("qid").distinct().orderBy("qid").limit(max_queries)
        pool = pool.join(first, "qid", "left_semi")
    every = top_k_pairs(pool, 2**31 - 1)
    order = Window.partitionBy("qid").orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), *PAIR)), "doc_id_1", "doc_id_2")
    return every.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_query).select(*PAIR)


def sample_pairs(pool: DataFrame, strategy: str = "top_k_all_pairs", k: int = 10, per_query: int = 200, seed: int = 42, max_queries: int | None = None) -> DataFrame:
    if strategy == "top_k_all_pairs":
        return top_k_pairs(pool, k)
    if strategy == "uniform":
        return uniform_pairs(pool, per_query, seed, max_queries)
    raise ValueError(f"unknown strategy {strategy!r}")


def presentations(pairs: DataFrame, order_swap: bool = True) -> DataFrame:
    """doc_a shown first; swapped too with ``order_swap``."""
    one = pairs.select("qid", F.col("doc_id_1").alias("doc_a"), F.col("doc_id_2").alias("doc_b"))
    return one.unionByName(pairs.select("qid", F.col("doc_id_2").alias("doc_a"), F.col("doc_id_1").alias("doc_b"))) if order_swap else one


def with_texts(docs: DataFrame, topics: DataFrame, corpus: DataFrame) -> DataFrame:
    """``docs`` (qid, docno) with query and text; one that has none fails in flight."""
    both = docs.join(topics.select("qid", "query"), "qid", "left").join(corpus.select("docno", "text"), "docno", "left")
    lost = lambda what, *key: F.raise_error(F.concat_ws(" ", F.lit(f"no {what} for"), *key)).cast("string")
    return both.withColumns({"query": F.coalesce("query", lost("query", "qid")), "text": F.coalesce("text", lost("text", "docno"))})


def pool_documents(pool: DataFrame, pairs: DataFrame, topics: DataFrame, corpus: DataFrame, depth: int) -> DataFrame:
    """qid, docno, query, text of the documents above ``depth`` and of those in a pair, each once; one without a text is an error."""
    sides = [pairs.select("qid", F.col(f"doc_id_{i}").alias("docno")) for i in (1, 2)]
    return with_texts(pool.filter(F.col("rank") < depth).select("qid", "docno").union(sides[0]).union(sides[1]).distinct(), topics, corpus)


def mock_verdicts(shown: DataFrame, topics: DataFrame, corpus: DataFrame, biased: bool = False) -> DataFrame:
    """query_id, doc_id_a, doc_id_b, verdict, prob_a, score_a, score_b by hashes of query and passage.

    The plain ranker doesn't mind the order; the biased one favours what is shown first and ties within a margin.
    Each passage is hashed once a query, before the pairs are joined. A presentation without a text or query is an error.
    """
    needed = shown.select("qid", F.col("doc_a").alias("docno")).union(shown.select("qid", F.col("doc_b").alias("docno"))).distinct()
    score = staged(with_texts(needed, topics, corpus).select("qid", "docno", hash_score(F.col("query"), F.col("text")).alias("s")), "scores")
    a = score.select("qid", F.col("docno").alias("doc_a"), F.col("s").alias("score_a"))
    b = score.select("qid", F.col("docno").alias("doc_b"), F.col("s").alias("score_b"))
    out = shown.join(a, ["qid", "doc_a"]).join(b, ["qid", "doc_b"])
    if biased:
        out = out.withColumn("score_a", F.col("score_a") + POSITION_BIAS)
    gap, margin = F.col("score_a") - F.col("score_b"), F.lit(TIE_MARGIN if biased else 0.0)
    verdict = F.when(F.abs(gap) <= margin, "tie").when(gap > 0, "a").otherwise("b")
    total = F.col("score_a") + F.col("score_b")
    prob = F.when(verdict == "tie", 0.5).when(total > 0, F.col("score_a") / total).otherwise(0.5)
    return out.select(F.col("qid").alias("query_id"), F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"), verdict.alias("verdict"), prob.alias("prob_a"), "score_a", "score_b")


def collapse_verdicts(stored: DataFrame) -> DataFrame:
    """One row a canonical pair: model_pref (1 for doc_id_1), n_presentations, position_consistent, collapse_reason."""
    flip = F.col("doc_id_b") < F.col("doc_id_a")
    pref = F.when(F.col("verdict") == "tie", 0).when(F.col("verdict") == "a", 1).otherwise(-1)
    rows = stored.select("query_id", F.least("doc_id_a", "doc_id_b").alias("doc_id_1"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_2"), F.when(flip, -pref).otherwise(pref).alias("pref"))
    out = rows.groupBy("query_id", "doc_id_1", "doc_id_2").agg(F.min("pref").alias("low"), F.max("pref").alias("high"), F.count("*").cast("int").alias("n_presentations"))
    same = F.col("low") == F.col("high")
    return out.select(
        "query_id", "doc_id_1", "doc_id_2",
        F.when(same, F.col("low")).otherwise(0).cast("int").alias("model_pref"), "n_presentations",
        F.when(F.col("n_presentations") > 1, same).alias("position_consistent"),
        F.when(~same, "order_disagreement").when(F.col("low") == 0, "model_tie").otherwise("decisive").alias("collapse_reason"),
    )


def consistency_stats(verdicts: DataFrame) -> DataFrame:
    """One row: pairs, pairs shown twice, their consistency, the decisive rate, and the reasons' counts."""
    count = lambda reason: F.count_if(F.col("collapse_reason") == reason)
    return verdicts.agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col("n_presentations") >= 2).alias("n_both_orders"), F.round(F.avg(F.col("position_consistent").cast("int")), 6).alias("position_consistency"),
        F.round(F.avg((F.col("model_pref") != 0).cast("int")), 6).alias("decisive_rate"), *[count(r).alias(f"n_{r}") for r in ("decisive", "model_tie", "order_disagreement")],
    )


def missing_presentations(shown: DataFrame, stored: DataFrame) -> DataFrame:
    """Presentations without a stored verdict."""
    done = stored.select(F.col("query_id").alias("qid"), F.col("doc_id_a").alias("doc_a"), F.col("doc_id_b").alias("doc_b"))
    return shown.join(done, ["qid", "doc_a", "doc_b"], "left_anti")


def wanted_rows(stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored rows of the canonical pairs, whichever document they show first."""
    keyed = stored.withColumns({"qid": F.col("query_id"), "doc_id_1": F.least("doc_id_a", "doc_id_b"), "doc_id_2": F.greatest("doc_id_a", "doc_id_b")})
    return keyed.join(pairs.select(*PAIR), list(PAIR), "left_semi").select(*stored.columns)


def triangles(verdicts: DataFrame) -> DataFrame:
    """One row: triangles with all pairs judged, those all decisive, the cyclic ones, and the rates (null over nothing)."""
    e = verdicts.select("query_id", "doc_id_1", "doc_id_2", "model_pref")
    xy = e.select("query_id", F.col("doc_id_1").alias("x"), F.col("doc_id_2").alias("y"), F.col("model_pref").alias("xy"))
    xz = e.select("query_id", F.col("doc_id_1").alias("x"), F.col("doc_id_2").alias("z"), F.col("model_pref").alias("xz"))
    yz = e.select("query_id", F.col("doc_id_1").alias("y"), F.col("doc_id_2").alias("z"), F.col("model_pref").alias("yz"))
    three = xy.join(xz, ["query_id", "x"]).join(yz, ["query_id", "y", "z"])
    whole = (F.col("xy") != 0) & (F.col("xz") != 0) & (F.col("yz") != 0)
    cyclic = whole & (F.col("xy") == -F.col("xz")) & (F.col("yz") == F.col("xy"))
    out = three.agg(F.count("*").alias("n_triangles_sampled"), F.count_if(whole).alias("n_complete_triangles"), F.count_if(cyclic).alias("n_cyclic"))
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return out.select("*", rate("n_complete_triangles", "n_triangles_sampled").alias("triangle_survival"), rate("n_cyclic", "n_complete_triangles").alias("nontransitivity_rate"))
