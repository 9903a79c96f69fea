"""The frames that queries start from, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlab.operators import analysis, pairs, ranking
from verdictlab.operators.axioms import AXIOMS, axiom_preferences
from verdictlab.sources import retrieval
from verdictlab.sources.index import Index, index_ref
from verdictlab.sources.staging import cached_frame, fingerprint, fresh, importable, inputs_mark

#: Where a session keeps its stages, by application.
_roots: dict[str, str] = {}
LAYOUT = "cell-2"


def session_root(spark: SparkSession) -> str:
    """A folder in the shared one that lasts as long as the session."""
    key = spark.sparkContext.applicationId
    if key not in _roots:
        _roots[key] = fresh(spark, "cells")
    return _roots[key]


class Cell:
    """One collection with one ranker. Every stage is computed once from the stages before it and kept under ``cache`` (by default as long as the session).

    A stage's mark names its configuration, the stages that it came from, and the input files with their sizes and times; a stage under another mark is computed anew.
    With ``only_kept`` nothing is: an analysis that finds a stage missing fails.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, biased: bool = True, depth: int = 100, k: int = 10, axioms: list[str] | None = None, cache: str | None = None, only_kept: bool = False):
        self.spark, self.dir, self.biased, self.depth, self.k = importable(spark), sf_dir, biased, depth, k
        self.axiom_names = list(axioms or AXIOMS)
        self.root, self.only_kept = cache or session_root(spark), only_kept
        self.mark = fingerprint(LAYOUT, inputs_mark(spark, *(f"{sf_dir}/{t}.parquet" for t in ("benchmark", "documents"))))

    def _stage(self, name: str, compute: Callable[[], DataFrame], *config: object) -> DataFrame:
        mark = fingerprint(self.mark, name, *config)
        return cached_frame(self.spark, f"{self.root}/{name}-{mark[:16]}", mark, compute, only_kept=self.only_kept)

    @cached_property
    def topics(self) -> DataFrame:
        return self._stage("topics", lambda: retrieval.topics(self.spark, self.dir))

    @cached_property
    def corpus(self) -> DataFrame:
        return retrieval.corpus(self.spark, self.dir)

    @cached_property
    def index(self) -> Index:
        return index_ref(self.spark, self.root, self.corpus, self.mark)

    @cached_property
    def pool(self) -> DataFrame:
        return self._stage("pool", lambda: retrieval.checked_pool(retrieval.bm25_pool(self.index, self.topics, self.depth), self.depth), self.depth)

    @cached_property
    def pairs(self) -> DataFrame:
        return self._stage("pairs", lambda: pairs.top_k_pairs(self.pool, self.k), self.depth, self.k)

    @cached_property
    def stored(self) -> DataFrame:
        return self._stage("stored", lambda: pairs.mock_verdicts(pairs.presentations(self.pairs), self.topics, self.corpus, self.biased), self.depth, self.k, self.biased)

    @cached_property
    def verdicts(self) -> DataFrame:
        return self._stage("verdicts", lambda: pairs.collapse_verdicts(self.stored), self.depth, self.k, self.biased)

    @cached_property
    def axioms(self) -> DataFrame:
        return self._stage("axioms", lambda: axiom_preferences(self.pool, self.pairs, self.topics, self.corpus, self.axiom_names, self.index), self.depth, self.k, self.axiom_names)

    @cached_property
    def merged(self) -> DataFrame:
        """Verdicts, axioms and the rank gap of every pair."""
        return self._stage("merged", lambda: analysis.attach_rank_gap(analysis.merge_pairs(self.verdicts, self.axioms), self.pool), self.depth, self.k, self.biased, self.axiom_names)

    @cached_property
    def covariates(self) -> DataFrame:
        return self._stage("covariates", lambda: analysis.covariates(self.verdicts.select(*analysis.KEY), self.pool, self.topics, self.corpus, self.stored), self.depth, self.k, self.biased)

    @cached_property
    def copeland(self) -> DataFrame:
        return self._stage("copeland", lambda: ranking.copeland(self.verdicts, self.pool), self.depth, self.k, self.biased)

    @cached_property
    def qrels(self) -> DataFrame:
        """Grades of pooled documents from the labels; a hash tells which documents of a pool were judged."""
        return self._stage("qrels", self._qrels, self.depth, inputs_mark(self.spark, f"{self.dir}/labels.parquet"))

    def _qrels(self) -> DataFrame:
        labels = self.spark.read.parquet(f"{self.dir}/labels.parquet").filter("doc_id is not null and quality is not null and toxic is not null")
        grades = labels.select(F.lpad(F.col("doc_id").cast("string"), 8, "0").alias("docno"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("relevance"))
        judged = self.pool.select("qid", "docno").filter(F.substring(F.md5(F.concat_ws("-", "qid", "docno")), 1, 1) < "8")
        return judged.join(grades, "docno").groupBy(F.col("qid").alias("query_id"), F.col("docno").alias("doc_id")).agg(F.max("relevance").alias("relevance"))
