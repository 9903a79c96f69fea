"""Frames written to the folder that driver and executors share, so that plans end there and a lost executor costs a task."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The file beside a frame's parts that names what the frame was computed from.
MARK = "_mark"
ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a session on one machine has a temporary folder, and a cluster an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or (sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="verdictlab-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package. A cluster normally gets it by ``--py-files`` or an image; in local runs the workers learn its place here."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


class Files:
    """The file system that a path is on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)

    def rename(self, old: str, new: str) -> bool:
        """Whether ``old``, if it is there, is now ``new``; a ``new`` that was there before stays."""
        return self.exists(old) and not self.exists(new) and self.fs.rename(self.path(old), self.path(new))

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.path(path), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def listing(self, path: str) -> list[tuple[str, int, int]]:
        """(name, bytes, time) of a file, or of the files in a folder."""
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self.fs.listStatus(self.path(path)))


def fingerprint(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def inputs_mark(spark: SparkSession, *paths: str) -> str:
    """What names tables as they are now: their files with sizes and times."""
    return fingerprint([Files(spark, p).listing(p) for p in paths])


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files = Files(spark, where)
    files.fs.deleteOnExit(files.path(where))
    return where


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    where = fresh(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


#: Tables of fewer bytes are dealt out before heavy work.
SMALL = 256 << 20


def spread(df: DataFrame, small: int = SMALL) -> DataFrame:
    """``df``, dealt out over all cores if it is small: such a table often has one row group, which one task would read and work on alone."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < small else df


def cached_frame(spark: SparkSession, path: str, mark: str, compute: Callable[[], DataFrame], refresh: bool = False, old_is_valid: Callable[[DataFrame], bool] | None = None, only_kept: bool = False) -> DataFrame:
    """The frame at ``path`` if it was computed under ``mark``, else computed and written. A frame without a mark is taken if ``old_is_valid`` says so.

    A new frame is written beside the old one with its mark, then takes its place by a rename: readers find a whole frame or none,
    and of two writers of one mark the later takes what the earlier has published. With ``only_kept`` nothing is computed: a frame that isn't there is an error.
    """
    files = Files(spark, path)
    if not refresh and files.exists(path):
        if files.exists(f"{path}/{MARK}"):
            if files.read(f"{path}/{MARK}") == mark:
                return spark.read.parquet(path)
        elif old_is_valid is not None and old_is_valid(spark.read.parquet(path)):
            files.write(f"{path}/{MARK}", mark)
            return spark.read.parquet(path)
    if only_kept:
        raise FileNotFoundError(f"no frame at {path} under this mark")
    tag = uuid.uuid4().hex
    new, old = f"{path}.new-{tag}", f"{path}.old-{tag}"
    compute().write.parquet(new)
    files.write(f"{new}/{MARK}", mark)
    files.rename(path, old)
    if not files.rename(new, path):
        if not files.exists(f"{path}/{MARK}") or files.read(f"{path}/{MARK}") != mark:
            raise RuntimeError(f"another writer has put a different frame at {path}")
        files.delete(new)
    files.delete(old)
    return spark.read.parquet(path)
