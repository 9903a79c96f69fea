"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing and packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet in the shared folder and gives it to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlab.llm.common import numbered, staged, table, tokenizer_path
from verdictlab.llm.fertility import fertility_rules
from verdictlab.llm.mixing import sampled
from verdictlab.llm.packing import best_fit_packing
from verdictlab.llm.pii import redacted
from verdictlab.llm.simhash import near_duplicates

BYTE_BPE, FALLBACK_BPE, SEQUENCE = "byte_bpe_50k.json", "piece_bpe_32k.model", 2048


def _only(docs: DataFrame, row: str, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row`` is among ``rows``, without that column."""
    return docs.join(rows.select(row), row, "left_semi").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that the base rule or a fertility band rejects, each by its own text: null and short texts go, rows that share a doc_id or have none are judged apart.

    Equal rows share their fate. Long texts are measured whole. An empty table stays empty, whatever further columns there are stay as they are.
    """
    docs, row = numbered(docs)
    return _only(docs, row, fertility_rules(docs, tokenizer_path(BYTE_BPE), tokenizer_path(FALLBACK_BPE), carry=row).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every component of near-duplicates: that with the least doc_id (null last), and of rows that share it the first by file and place.

    Null and empty texts are a component like any other. Long texts are read whole. An empty table stays empty, further columns stay as they are.
    """
    docs, row = numbered(docs)
    marked = near_duplicates(docs, carry=row)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    return _only(docs, row, marked.groupBy("root").agg(F.min(order)[row].alias(row)))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind; n_chars follows. No row goes: null texts stay null, equal rows stay equal, long texts are read whole."""
    return redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics meet their target shares of tokens. Rows with one doc_id (of those without, one text) share their fate;
    null texts have no token and go by the weight of their cell. An empty table stays empty, further columns stay as they are."""
    return sampled(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; the columns are those of ``best_fit_packing``. Null texts are a lone end id, equal rows are packed each, long texts are cut, an empty table gives no row."""
    return best_fit_packing(docs, tokenizer_path(BYTE_BPE), SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: Token ids, fingerprints and the model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
