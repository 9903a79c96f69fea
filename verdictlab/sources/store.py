"""The append-only stores of verdicts and scores, protocols, the dataset guard, and file manifests."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import shutil
import subprocess
import time
import uuid
from datetime import datetime, timezone
from pathlib import Path

import pyspark
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdictlab.sources.staging import cached_frame, fingerprint

__all__ = ["append", "append_adequacy", "cached_frame", "check_allowed", "environment", "fingerprint", "inventory", "keep_one", "load", "load_scores", "new_row", "register_protocol", "restore_test", "snapshot", "stamped", "verify_snapshot", "write_manifest"]

KEY = ["dataset", "query_id", "doc_id_a", "doc_id_b", "model", "prompt_version"]
SCHEMA = ", ".join(f"{c} string" for c in KEY) + ", verdict string, prob_a double, score_a double, score_b double, latency_ms double, created_at string"
VERDICTS = ("a", "b", "tie")


def keep_one(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of every key by an order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_place = 1").drop("_place")


def new_row(*, dataset: str, query_id: str, doc_id_a: str, doc_id_b: str, model: str, prompt_version: str, verdict: str, prob_a: float | None = None, score_a: float | None = None, score_b: float | None = None, latency_ms: float | None = None) -> tuple:
    """A row of the store in the order of SCHEMA, stamped with the time in UTC."""
    if verdict not in VERDICTS:
        raise ValueError(f"unknown verdict {verdict!r}")
    return (dataset, query_id, doc_id_a, doc_id_b, model, prompt_version, verdict, prob_a, score_a, score_b, latency_ms, datetime.now(timezone.utc).isoformat(timespec="seconds"))


def stamped(df: DataFrame) -> DataFrame:
    """``df`` with ``created_at``, the time of the query in UTC."""
    return df.withColumn("created_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def append(df: DataFrame, path: str) -> None:
    """Add verdicts as new part files; missing columns are an error, further columns are left out, an unknown verdict fails the write."""
    wanted = [c.split()[0] for c in SCHEMA.split(", ")]
    if lost := sorted(set(wanted) - set(df.columns)):
        raise ValueError(f"missing {lost}")
    known = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("unknown verdict "), F.coalesce("verdict", F.lit("null")))))
    rows = df.withColumn("verdict", known)
    rows.selectExpr(*[f"CAST(`{c.split()[0]}` AS {c.split()[1]}) AS `{c.split()[0]}`" for c in SCHEMA.split(", ")]).write.mode("append").parquet(path)


ADEQUACY = "query_id string, doc_id string, model string, prompt_version string, adequacy double, p0 double, p1 double, p2 double, p3 double, argmax int, n_label_logprobs int, created_at string"


def append_adequacy(df: DataFrame, path: str) -> None:
    """Add pointwise scores as new part files, in fixed columns."""
    names = [c.split()[0] for c in ADEQUACY.split(", ")]
    if lost := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing {lost}")
    df.selectExpr(*[f"CAST(`{c.split()[0]}` AS {c.split()[1]}) AS `{c.split()[0]}`" for c in ADEQUACY.split(", ")]).write.mode("append").parquet(path)


def load_scores(spark: SparkSession, path: str, schema: str, key: list[str], value: str) -> DataFrame:
    """The last written score of every key; rows without a value don't count. Columns that the files lack are an error."""
    if lost := sorted({c.split()[0] for c in schema.split(", ")} - set(spark.read.parquet(path).columns)):
        raise ValueError(f"{path} lacks {lost}")
    rows = spark.read.schema(schema).parquet(path).filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    return keep_one(rows, key, F.desc("created_at"), F.desc("_file"), F.desc("_row")).drop("_file", "_row")


def load(spark: SparkSession, path: str, **equal: str) -> DataFrame:
    """All verdicts, the first written of every key (by time, then file and row); ``equal`` filters key columns and so reaches the scan."""
    if unknown := set(equal) - set(KEY):
        raise ValueError(f"not key columns: {sorted(unknown)}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path)
    for c, v in equal.items():
        if v is not None:
            rows = rows.filter(F.col(c) == v)
    rows = rows.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    return keep_one(rows, KEY, F.col("created_at"), F.col("_file"), F.col("_row")).drop("_file", "_row")


class _Lock:
    """One writer at a time by a lock file. A writer waits up to ``patience`` seconds; a lock older than ``stale`` seconds was left by a writer that died."""

    def __init__(self, path: str, patience: float = 30.0, stale: float = 120.0):
        self.path, self.patience, self.stale = f"{path}.lock", patience, stale

    def __enter__(self) -> None:
        until = time.monotonic() + self.patience
        while True:
            try:
                os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return
            except FileExistsError:
                try:
                    if time.time() - os.stat(self.path).st_mtime > self.stale:
                        os.replace(self.path, f"{self.path}.{os.getpid()}")
                        os.unlink(f"{self.path}.{os.getpid()}")
                        continue
                except FileNotFoundError:
                    continue
                if time.monotonic() > until:
                    raise TimeoutError(f"{self.path} is held by another writer") from None
                time.sleep(0.02)

    def __exit__(self, *_: object) -> None:
        os.unlink(self.path)


def register_protocol(path: str, model: str, prompt_version: str, signature: str, patience: float = 30.0) -> None:
    """Bind (model, prompt version) to a scoring signature; another signature for them is an error."""
    with _Lock(path, patience):
        known = json.loads(Path(path).read_text()) if os.path.exists(path) else {}
        key = f"{model}|{prompt_version}"
        if known.setdefault(key, signature) != signature:
            raise ValueError(f"{key} is bound to another signature")
        _write_whole(path, known)


def _write_whole(path: str, tree: object) -> None:
    """JSON that readers find whole or not at all."""
    new = Path(f"{path}.new-{uuid.uuid4().hex}")
    new.write_text(json.dumps(tree, indent=1, sort_keys=True, default=str))
    os.replace(new, path)


def check_allowed(dataset: str, manifest: str, unlocked: bool = False) -> None:
    """Refuse a locked dataset. Without a readable manifest everything is refused."""
    try:
        locked = set(json.loads(Path(manifest).read_text())["locked"])
    except (OSError, ValueError, KeyError, TypeError) as e:
        raise PermissionError(f"the lock manifest can't be read: {e}") from e
    if dataset in locked and not unlocked:
        raise PermissionError(f"{dataset} is locked")


def inventory(root: str) -> dict[str, str]:
    """{relative path: SHA-256} of the files below a folder."""
    base = Path(root)
    return {str(p.relative_to(base)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(base.rglob("*")) if p.is_file()}


def snapshot(root: str, to: str) -> dict[str, str]:
    """Copy a folder and write its inventory beside the copy."""
    shutil.copytree(root, f"{to}/files")
    found = inventory(f"{to}/files")
    Path(to, "inventory.json").write_text(json.dumps(found, indent=1, sort_keys=True))
    return found


def verify_snapshot(to: str) -> dict[str, list[str]]:
    """Paths that are missing, extra or changed."""
    want, got = json.loads(Path(to, "inventory.json").read_text()), inventory(f"{to}/files")
    return {"missing": sorted(set(want) - set(got)), "extra": sorted(set(got) - set(want)), "changed": sorted(p for p in set(want) & set(got) if want[p] != got[p])}


def restore_test(to: str, spark: SparkSession) -> dict[str, int]:
    """Read a Parquet file of a snapshot again: its name and rows. A snapshot that doesn't verify, or holds none, is an error."""
    if any(verify_snapshot(to).values()):
        raise ValueError(f"{to} doesn't match its inventory")
    for name in sorted(json.loads(Path(to, "inventory.json").read_text())):
        if name.endswith(".parquet"):
            return {name: spark.read.parquet(f"file://{Path(to, 'files', name).resolve()}").count()}
    raise ValueError(f"{to} holds no Parquet file")


def _state(*command: str) -> str | None:
    try:
        return subprocess.run(command, capture_output=True, text=True, timeout=20, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def environment(root: str = ".") -> dict[str, object]:
    """The code's commit and whether files differ from it (null without git), and the versions of Python, Spark and the platform."""
    changed = _state("git", "-C", root, "status", "--porcelain")
    return {"commit": _state("git", "-C", root, "rev-parse", "HEAD"), "changed": None if changed is None else bool(changed), "python": platform.python_version(), "pyspark": pyspark.__version__, "platform": platform.platform()}


def write_manifest(path: str, config: dict, inputs: list[str], outputs: list[str], locks: list[str] | None = None, sources: list[str] | None = None, root: str = ".") -> dict:
    """Digests of the configuration and of all files that took part, and the state of code and environment, written in one step. Files that aren't there have null."""
    digest = lambda p: hashlib.sha256(Path(p).read_bytes()).hexdigest() if os.path.exists(p) else None
    found = {"config": fingerprint(config), "environment": environment(root), **{k: {p: digest(p) for p in ps} for k, ps in (("inputs", inputs), ("outputs", outputs), ("locks", locks or []), ("sources", sources or []))}}
    _write_whole(path, found)
    return found
