"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, mixing
from .common import spread, table, tokenizer_path
from .fertility import fertility_rules
from .packing import best_fit_packing
from .pii import personal_data
from .sharding import balanced_shards
from .simhash import near_duplicates
from .tiff import text_media
from .tokenfile import token_files
from .toxicity import toxicity

BYTE_BPE, FALLBACK_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


#: A table of fewer bytes is often one row group, which one task would read and work on alone; it is dealt out first.
ONE_GROUP = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), ONE_GROUP)


def op1_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), tokenizer_path(FALLBACK_BPE))


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(table(spark, sf_dir, "documents"), 16)


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), 2048)


def op5_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.raked_mixture(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op8_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op10_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_arc_to_warc": archives.SQL, "op5_raked_mixture": mixing.sql()}
