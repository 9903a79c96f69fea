"""The inverted index of a collection: written once, then read by every query."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlab.functions.text import tokens
from verdictlab.sources.staging import Files, cached_frame, fingerprint, fresh, importable, spread

#: Changes with what an index holds.
LAYOUT = "index-4"
#: Queries' terms up to so many rows are sent to all executors; more are joined by term.
SENT_TERMS = 500_000


POSTINGS = "docno string, term string, dl long, tf long, first long, places array<int>"


def postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of documents (docno, words), and for each document a row without a term, with its length and (as tf) its number of distinct terms.

    Each is made where its document is, by one sort of a batch's words, so that no posting is shuffled.
    """
    for b in batches:
        words = b.column(1)
        ends = words.offsets.to_numpy()
        sizes = np.diff(ends)
        flat = words.flatten().dictionary_encode()
        doc = np.repeat(np.arange(b.num_rows), sizes)
        pos = np.arange(len(doc), dtype=np.int32) - np.repeat(ends[:-1] - ends[0], sizes)
        key = doc * max(1, len(flat.dictionary)) + flat.indices.to_numpy()
        order = np.argsort(key, kind="stable")
        key, pos = key[order], pos[order].astype(np.int32)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        of, term = key[starts] // max(1, len(flat.dictionary)), key[starts] % max(1, len(flat.dictionary))
        places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)).astype(np.int32)), pa.array(pos))
        names = [c.split()[0] for c in POSTINGS.split(", ")]
        columns = [b.column(0).take(pa.array(of)), flat.dictionary.take(pa.array(term)), pa.array(sizes[of].astype(np.int64)), pa.array(np.diff(np.append(starts, len(key)))), pa.array(pos[starts].astype(np.int64)), places]
        yield pa.RecordBatch.from_arrays(columns, names)
        distinct = np.bincount(of, minlength=b.num_rows).astype(np.int64)
        nulls = [pa.nulls(b.num_rows, t) for t in (pa.string(), pa.int64(), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([b.column(0), nulls[0], pa.array(sizes.astype(np.int64)), pa.array(distinct), nulls[1], nulls[2]], names)


class Index:
    """Tables of a collection (docno, text) under a folder.

    ``postings``: docno, term, tf, first (position), places (positions), dl; ``documents``: docno, dl, n_unique (rows of the same files); ``terms``: term, df; ``stats``: n, mean.
    Postings stay with their documents and are sorted by term within files, so that a frequent term is no single partition and rare ones are found by
    the files' statistics. Queries' terms come to the postings, not the other way round.
    """

    def __init__(self, spark: SparkSession, path: str, tokenize: Callable[[Column], Column] = tokens):
        self.spark, self.path, self.tokenize = spark, path, tokenize

    @property
    def complete(self) -> bool:
        return Files(self.spark, self.path).exists(f"{self.path}/stats/_SUCCESS")

    def build(self, corpus: DataFrame, mark: str) -> Index:
        """Write the tables that aren't there under ``mark``."""
        importable(self.spark)
        table = lambda name, compute: cached_frame(self.spark, f"{self.path}/{name}", fingerprint(LAYOUT, name, mark), compute)
        words = spread(corpus.select("docno", "text")).select("docno", self.tokenize(F.col("text")).alias("words"))
        table("postings", lambda: words.mapInArrow(postings_of, POSTINGS).sortWithinPartitions("term", "docno"))
        table("terms", lambda: self.postings.groupBy("term").agg(F.count("*").alias("df")))
        table("stats", lambda: self.documents.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).coalesce(1))
        return self

    @classmethod
    def of(cls, corpus: DataFrame, tokenize: Callable[[Column], Column] = tokens) -> Index:
        """An index for this session only."""
        spark = corpus.sparkSession
        return cls(spark, fresh(spark, "index"), tokenize).build(corpus, "")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @cached_property
    def postings(self) -> DataFrame:
        return self._table("postings").filter("term IS NOT NULL")

    @cached_property
    def documents(self) -> DataFrame:
        return self._table("postings").filter("term IS NULL").select("docno", "dl", F.col("tf").alias("n_unique"))

    @cached_property
    def terms(self) -> DataFrame:
        return self._table("terms")

    @cached_property
    def size(self) -> tuple[int, float]:
        """(documents, mean length)."""
        row = self._table("stats").first()
        return row["n"], row["mean"] or 1.0

    def idf(self) -> DataFrame:
        """term, df, idf."""
        n = F.lit(float(self.size[0]))
        return self.terms.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))

    def matches(self, terms: DataFrame) -> DataFrame:
        """The postings of ``terms`` (a column ``term``), which are sent to all executors while they are few."""
        wanted = terms.select("term").distinct()
        few = wanted.limit(SENT_TERMS + 1).count() <= SENT_TERMS
        return self.postings.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")


def index_ref(spark: SparkSession, where: str, corpus: DataFrame, mark: str, built: dict[str, str] | None = None, name: str | None = None) -> Index:
    """The index to use: one that ``name`` gives by path or by its entry in ``built``; else that of the collection under ``where``, built if it isn't there."""
    if name is not None:
        found = Index(spark, (built or {}).get(name, name))
        if not found.complete:
            raise FileNotFoundError(f"no index at {found.path}")
        return found
    return Index(spark, f"{where}/index-{mark[:16]}").build(corpus, mark)
