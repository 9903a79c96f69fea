"""Token ids in fixed-width bit-packed binary files.

A file holds one segment. All numbers are little-endian:

    8 bytes   b"VLTOKEN1"
    8 x u64   bits an id, ids a block, range partition, ids before it in that partition, documents, ids, blocks, flags (1: null document ids follow)
    i64 x d   document ids
    u32 x d   ids a document
    u8 x d    1 where the document id is null (only with the flag)
    u64 x b   byte offset of every block, from the start of the packed part
    packed    blocks; id i of a block has the bits [i * bits, (i + 1) * bits), least significant first

Spark's text writer commits the files, so any store that Spark reaches will do; it ends each with one line feed, which readers ignore.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import fresh, ready, staged, text_or_empty

MAGIC = b"VLTOKEN1"
BLOCK_IDS = 4096
#: A segment is closed once it has so many ids.
SEGMENT_IDS = 1_000_000
END_ID = 0


def bits_for(vocab_size: int) -> int:
    """The fewest bits that hold every id of a vocabulary."""
    return max(1, (vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids at ``bits`` bits each, least significant bit first, padded to whole bytes."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if ids.size and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):  # the same layout, without going by single bits
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    raw = np.frombuffer(data, np.uint8, count=(n * bits + 7) // 8)
    if bits in (8, 16, 32):
        return raw.view(f"<u{bits // 8}").astype("<u4")
    each = np.unpackbits(raw, bitorder="little", count=n * bits).reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = each
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def segment(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, vocab_size: int, partition: int = 0, before: int = 0) -> bytes:
    """The bytes of one segment."""
    bits = bits_for(vocab_size)
    blocks = [pack_bits(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")[:-1]
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = MAGIC + struct.pack("<8Q", bits, BLOCK_IDS, partition, before, len(doc_ids), len(ids), len(blocks), int(null.any()))
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(counts, "<u4").tobytes(), null.tobytes() if null.any() else b"", offsets.tobytes(), *blocks])


class Segment:
    """Reads a segment; ``ids(start, n)`` unpacks only the blocks that hold the asked ids."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, self.partition, self.before, d, self.n_ids, b, flags = struct.unpack_from("<8Q", data, 8)
        at = 72
        self.doc_ids = np.frombuffer(data, "<i8", d, at)
        self.counts = np.frombuffer(data, "<u4", d, at + 8 * d)
        at += 12 * d
        self.null = np.frombuffer(data, np.uint8, d, at) if flags & 1 else np.zeros(d, np.uint8)
        at += d if flags & 1 else 0
        self.offsets = np.frombuffer(data, "<u8", b, at)
        self.packed = memoryview(data)[at + 8 * b :]

    def ids(self, start: int = 0, n: int | None = None) -> np.ndarray:
        end = self.n_ids if n is None else min(self.n_ids, start + n)
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        got = [unpack_bits(self.packed[int(self.offsets[k]) :], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(first, last + 1)]
        return np.concatenate(got)[start - first * self.block : end - first * self.block]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every document's ids and ``END_ID`` to ``path`` in ascending ``id_col`` order (null first; equal ids by their texts' CRC-32, then text).

    A null text is empty. Range partitions are sorted and written one by one, so no task holds more than one segment.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids, counts, held, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([segment(doc_ids, counts, np.concatenate(held), enc.vocab_size, part, before)], pa.binary())], ["segment"])

        for b in batches:
            ids, ends = enc.encode_ended(b.column(1).to_pylist(), END_ID)
            whose, start = b.column(0).to_pylist(), 0
            while start < len(whose):
                # the document with which the segment has enough
                stop = min(len(whose), int(np.searchsorted(ends, ends[start] + SEGMENT_IDS - n, "left")))
                stop = max(stop, start + 1)
                doc_ids += whose[start:stop]
                counts += np.diff(ends[start : stop + 1]).tolist()
                held.append(ids[ends[start] : ends[stop]])
                n += int(ends[stop] - ends[start])
                start = stop
                if n >= SEGMENT_IDS:
                    yield flush()
                    before += n
                    doc_ids, counts, held, n = [], [], [], 0
        if n:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # the sample that sets the ranges goes to the driver, so it holds checksums instead of texts
    rows = rows.withColumn("check", F.crc32(F.col("text").cast("binary"))).repartitionByRange("doc_id", "check").sortWithinPartitions("doc_id", "check", "text").select("doc_id", "text")
    packed = rows.mapInArrow(run, "segment binary")
    packed.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark, path: str) -> DataFrame:
    """One row a document, from the files: doc_id, part, at (ids before it in the range partition), n_tokens, ids_crc32 of the little-endian unsigned 32-bit ids."""
    ready(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                seg = Segment(b.column(0)[i].as_buffer().to_pybytes())
                ids = seg.ids()
                ends = np.cumsum(seg.counts, dtype=np.int64)
                starts = ends - seg.counts
                crc = [zlib.crc32(ids[s:e].data) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seg.doc_ids, mask=seg.null.astype(bool)), pa.array(np.full(n, seg.partition, np.int64)), pa.array(starts + int(seg.before)), pa.array(seg.counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "at", "n_tokens", "ids_crc32"],
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "doc_id long, part long, at long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write ``docs`` as token files, read them back, and give one row a document: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. Only one total a range partition reaches the driver.
    An empty table gives no file and no row. Repeated rows are each written. Other columns of ``docs`` are left out.
    """
    spark = docs.sparkSession
    path = path or fresh(spark, "tokens")
    write_token_files(docs, path, tokenizer)
    rows = staged(read_token_files(spark, path), "token-rows")
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n
    places = spark.createDataFrame(bases, "part long, base long")
    return rows.join(F.broadcast(places), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
