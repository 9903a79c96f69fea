"""Pointwise scores of a pool that can be resumed, the features that a small model learns them from, and how that model is judged."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlab.functions.markup import clean_passage, prepared_query
from verdictlab.functions.text import tokens
from verdictlab.operators.models import adaptation_split, ridge_fit, ridge_out_of_fold, ridge_predict
from verdictlab.operators.pairs import exact_join, with_texts
from verdictlab.operators.ranking import compare_runs, evaluate, rerank_scored
from verdictlab.sources.staging import Files, staged

#: Words that don't count for coverage.
STOP = ("a", "an", "and", "are", "be", "by", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "the", "to", "was", "what", "when", "where", "which", "who", "why", "with")
#: Fixed value: what an NLI model is asked about a passage, before the query.
HYPOTHESIS = "This text provides an answer or explanation to the question: "
BASE = ["bm25_score", "bm25_rank", "log_length", "query_coverage"]
SIGNALS = ["relevance_probability", "nli_entailment", "mrc_margin"]
Score = Callable[[Column, Column], Column]


def content_coverage(query: Column, words: Column) -> Column:
    """The share of the query's distinct words outside STOP among ``words``; 0 without any."""
    asked = F.array_except(F.array_distinct(tokens(query)), F.array(*map(F.lit, STOP)))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words)) / F.size(asked)).otherwise(0.0)


def unscored(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """The documents (qid, docno) of ``wanted`` that ``done`` hasn't."""
    return wanted.join(done.select("qid", "docno"), ["qid", "docno"], "left_anti")


def whole_scope(cached: DataFrame, scope: DataFrame) -> DataFrame:
    """The cached rows of the documents in ``scope``; a document without a row, or with two, is an error."""
    return exact_join(scope.select("qid", "docno"), cached.join(scope.select("qid", "docno"), ["qid", "docno"], "left_semi"), ["qid", "docno"])


def resumed(spark: SparkSession, scope: DataFrame, path: str, score: Callable[[DataFrame], DataFrame], schema: str, parts: int = 8) -> DataFrame:
    """A score of every document in ``scope`` (qid, docno), kept at ``path``: what is there is read, the rest scored and appended, ``parts`` appends in all.

    A run that stops is resumed by the next; the last written row of a document counts. The result is checked to be whole.
    """
    from verdictlab.sources.store import keep_one

    def load() -> DataFrame:
        if not Files(spark, path).exists(path):
            return spark.createDataFrame([], schema)
        rows = spark.read.parquet(path)
        if lost := sorted({c.split()[0] for c in schema.split(", ")} - set(rows.columns)):
            raise ValueError(f"{path} lacks {lost}")
        rows = spark.read.schema(schema).parquet(path).withColumns({"_time": F.col("_metadata.file_modification_time"), "_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
        return keep_one(rows, ["qid", "docno"], F.desc("_time"), F.desc("_file"), F.desc("_row")).drop("_time", "_file", "_row")

    todo = staged(unscored(scope.select("qid", "docno"), load()), "todo")
    if not todo.isEmpty():
        for k in range(parts):
            some = todo.filter(F.pmod(F.xxhash64("qid", "docno"), F.lit(parts)) == k)
            score(some).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]).write.mode("append").parquet(path)
    return whole_scope(load(), scope)


GATED = "qid string, docno string, score int, relevant boolean, answers boolean, constrained boolean, relevance double, entailment double, similarity double"


def score_pool(pool: DataFrame, topics: DataFrame, corpus: DataFrame, path: str, relevance: Score, entailment: Score, similarity: Score, depth: int, html: bool = True, parts: int = 8) -> DataFrame:
    """The three gates' score of every document above ``depth``, kept at ``path`` and resumed from there."""
    from verdictlab.operators.gates import gated

    scope = pool.filter(F.col("rank") < depth).select("qid", "docno")
    score = lambda some: gated(with_texts(some, topics, corpus), relevance, entailment, similarity, html=html)
    return resumed(pool.sparkSession, scope, path, score, GATED, parts)


def features(pool: DataFrame, topics: DataFrame, corpus: DataFrame, relevance: Score, entailment: Score, margin: Score, depth: int, html: bool = True) -> DataFrame:
    """qid, docno and BASE and SIGNALS of every document above ``depth``: the models' signals come in as expressions over (prepared query, passage)."""
    docs = pool.filter(F.col("rank") < depth).select("qid", "docno", F.col("rank").cast("double").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    rows = with_texts(docs.select("qid", "docno"), topics, corpus)
    q, passage = prepared_query(F.col("query"))["text"], clean_passage(F.col("text")) if html else F.col("text")
    rows = rows.select("qid", "docno", q.alias("q"), passage.alias("passage")).withColumn("words", tokens(F.col("passage")))
    asked = F.concat(F.lit(HYPOTHESIS), "q")
    rows = rows.select("qid", "docno", F.log1p(F.size("words").cast("double")).alias("log_length"), content_coverage(F.col("q"), F.col("words")).alias("query_coverage"), relevance(F.col("q"), F.col("passage")).alias("relevance_probability"), entailment(F.col("passage"), asked).alias("nli_entailment"), margin(F.col("q"), F.col("passage")).alias("mrc_margin"))
    return exact_join(docs, rows, ["qid", "docno"]).select("qid", "docno", *BASE, *SIGNALS)


def labelled(frame: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """``frame`` with the columns of ``labels`` (one row a document at most); documents without a label have nulls."""
    return exact_join(frame, labels.select("qid", "docno", *columns), ["qid", "docno"], "left")


def gate_diagnostics(frame: DataFrame, label: str = "adequacy", argmax: str = "argmax", high: float = 2.5, thresholds: tuple[float, float] = (0.40, 0.65)) -> DataFrame:
    """A row for every argmax, and one (null) for all: documents, of which of high adequacy, the shares of those that each gate turns away, and the signals' means."""
    known = frame.filter(F.col(label).isNotNull() & F.col(argmax).isNotNull())
    great = F.col(label) >= high
    lost = lambda c, t: F.round(F.avg(F.when(great, (F.col(c) < t).cast("int"))), 6)
    out = [F.count("*").alias("n_documents"), F.count_if(great).alias("n_high"), lost("relevance_probability", thresholds[0]).alias("relevance_false_negative_rate"), lost("nli_entailment", thresholds[1]).alias("nli_false_negative_rate"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in SIGNALS]]
    return known.groupBy(F.col(argmax).cast("int").alias("argmax")).agg(*out).unionByName(known.agg(*out).withColumn("argmax", F.lit(None).cast("int")))


def reranked_by(pool: DataFrame, predicted: DataFrame, depth: int) -> DataFrame:
    """The pool with the documents above ``depth`` in the order of their predicted adequacy."""
    return rerank_scored(pool, predicted.select("qid", "docno", F.col("predicted").alias("s")), depth)


def distilled(frame: DataFrame, names: list[str], label: str = "adequacy") -> DataFrame:
    """Out-of-fold ridge predictions of the label."""
    return ridge_out_of_fold(frame, names, label)


def transfer(source: DataFrame, target: DataFrame, names: list[str], label: str = "adequacy") -> tuple[DataFrame, np.ndarray]:
    """(``target``, another collection's features, with predictions by the fit on all labels of ``source`` as it is; the fit)."""
    theta = ridge_fit(source, names, label)
    return ridge_predict(target, names, theta), theta


def adapted(frame: DataFrame, names: list[str], n_train: int, label: str = "adequacy", seed: int = 42) -> DataFrame:
    """Predictions for the queries beyond the ``n_train`` that the fit learned from; those are left out. A training document without a label is an error."""
    rows = staged(adaptation_split(frame, n_train, seed), "split")
    train = rows.filter("in_train")
    if lost := train.filter(F.col(label).isNull()).limit(3).collect():
        raise ValueError(f"training documents without a label: {[(r['qid'], r['docno']) for r in lost]}")
    return ridge_predict(rows.filter("NOT in_train"), names, ridge_fit(train, names, label))


def effect(pool: DataFrame, predicted: DataFrame, qrels: DataFrame, depth: int, n_bootstrap: int = 10_000) -> DataFrame:
    """The comparison of the reranked pool with the first stage over the queries that ``predicted`` holds."""
    held = predicted.select("qid").distinct()
    some = pool.join(held, "qid", "left_semi")
    judged = qrels.join(held.select(F.col("qid").alias("query_id")), "query_id", "left_semi")
    return compare_runs(evaluate(some, judged), evaluate(reranked_by(some, predicted, depth), judged), n_bootstrap=n_bootstrap)
