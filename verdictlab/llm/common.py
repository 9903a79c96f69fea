"""What the operators of this subpackage share: staging, worker set-up and small helpers."""

from __future__ import annotations

import os
import re
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlab.sources.staging import fresh, importable, shared_dir, spread, staged

__all__ = ["fresh", "numbered", "ready", "shared_dir", "spread", "staged", "table", "tokenizer_path", "unused"]

#: An Arrow batch ends at so many rows or so many bytes; a longer text is a batch of its own, so that a worker holds a few MB beside its longest text.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches (never beyond what the session asks for) and let Python workers import this package."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub("[^0-9-]", "", spark.conf.get(f"spark.sql.execution.arrow.{name}")) or 0)
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return importable(spark)


def unused(df: DataFrame, start: str = "x_") -> str:
    """A prefix that no column of ``df`` begins with."""
    while any(c.lower().startswith(start) for c in df.columns):
        start += "_"
    return start


def numbered(df: DataFrame, name: str = "rows") -> tuple[DataFrame, str]:
    """``df`` with a column that tells its rows apart, whatever they hold, and the column's name.

    Rows of Parquet files are known by file and place there; others are written to the shared folder first, as a number given in flight could change when a task runs again.
    """
    x = unused(df) + "row"
    try:
        return df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(x)), x
    except AnalysisException:
        return staged(df.select("*", F.monotonically_increasing_id().alias(x)), name), x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cpu_threads_off() -> None:
    """One thread a worker: Spark already runs a task on every core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2000))
