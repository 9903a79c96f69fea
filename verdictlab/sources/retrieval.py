"""BM25 candidate pools over an inverted index kept as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictlab.functions.text import tokens
from verdictlab.sources.index import SENT_TERMS, Index

K1, B = 1.2, 0.75
#: What is put before a topic's words, by its number modulo eight, so that every query intent occurs.
OPENINGS = ("", "define ", "how many ", "how much do ", "difference between ", "who is ", "what does ", "list of ")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, query: five words of every benchmark item behind an opening by its number."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("item_id is not null")
    words = F.slice(tokens(F.coalesce("text", F.lit(""))), 1, 5)
    opening = F.get(F.array(*map(F.lit, OPENINGS)), (F.col("item_id") % 8).cast("int"))
    # comparisons need an "and", definitions by "what does" an end
    body = (
        F.when(F.col("item_id") % 8 == 4, F.concat(F.array_join(F.slice(words, 1, 2), " "), F.lit(" and "), F.array_join(F.slice(words, 3, 2), " ")))
        .when(F.col("item_id") % 8 == 6, F.concat(F.array_join(F.slice(words, 1, 2), " "), F.lit(" mean")))
        .otherwise(F.array_join(words, " "))
    )
    return items.select(F.lpad(F.col("item_id").cast("string"), 6, "0").alias("qid"), F.concat(opening, body).alias("query"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docno, text."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id is not null").select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("docno"), F.coalesce("text", F.lit("")).alias("text"))


def query_terms(topics_: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> DataFrame:
    """qid, term, qtf."""
    return topics_.select("qid", F.explode(tokenize(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(index: Index, topics_: DataFrame) -> DataFrame:
    """qid, docno, score (rounded to six places) of every document that shares a term with the query."""
    _, mean = index.size
    terms = query_terms(topics_, index.tokenize)
    weight = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    # a row a query and term: sent to the terms and then to the postings, which stay where they are, while they are few
    few = terms.limit(SENT_TERMS + 1).count() <= SENT_TERMS
    weighted = index.idf().join(F.broadcast(terms) if few else terms, "term")
    weighted = F.broadcast(weighted) if few else weighted
    return index.postings.select("docno", "term", "tf", "dl").join(weighted, "term").groupBy("qid", "docno").agg(F.round(F.sum(weight), 6).alias("score"))


def bm25_pool(index: Index, topics_: DataFrame, depth: int = 100) -> DataFrame:
    """qid, docno, rank (from 0), score: the ``depth`` best documents of each query; ties by docno.

    The rank's limit is pushed below the shuffle, so that a query that matches everything moves only ``depth`` rows a task.
    """
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "docno")
    return bm25_scores(index, topics_).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= depth).select("qid", "docno", (F.col("place") - 1).alias("rank"), "score")


def checked_pool(pool: DataFrame, depth: int) -> DataFrame:
    """``pool``, failing in flight where a query has more than ``depth`` documents."""
    n = F.count("*").over(Window.partitionBy("qid"))
    return pool.withColumn("_n", n).filter(F.when(F.col("_n") <= depth, True).otherwise(F.raise_error(F.concat(F.lit(f"more than {depth} documents for query "), "qid")).cast("boolean"))).drop("_n")
