"""Sharding by minimax contiguous partition of atomic groups.

Documents with equal texts are one group. Groups stand in the order of a 60-bit hash of their text; contiguous runs of them make the shards.
The smallest feasible shard capacity is found by binary search, each capacity checked greedily.

The driver never sees all groups. It holds cells (ranges of the hash with their total size), at first CELLS of equal width.
Where a cut could fall within a cell, the cell is split, until each such cell holds one group; then the capacity is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, staged, text_or_empty

KEY_BITS = 60
CELL_BITS = 14
SPLIT_BITS = 8

#: (first key, bits of the cell's width, total size, groups), in key order.
Cells = list[tuple[int, int, int, int]]


def text_key(text: Column) -> Column:
    """The first 60 bits of the text's SHA-256. Texts that share them are kept together like equal ones."""
    return F.conv(F.substring(F.sha2(text, 256), 1, KEY_BITS // 4), 16, 10).cast("long")


class Line:
    """Cells on a line of bytes; cuts are positions (bytes before them)."""

    def __init__(self, cells: Cells):
        self.cells = cells
        self.ends = np.cumsum([c[2] for c in cells], dtype=np.int64) if cells else np.zeros(0, np.int64)
        self.starts = self.ends - np.array([c[2] for c in cells], np.int64)
        self.atomic = np.array([c[3] == 1 for c in cells], bool)
        self.total = int(self.ends[-1]) if cells else 0

    def cut(self, position: int, capacity: int, whole: bool) -> int:
        """The furthest cut from ``position``: at a cell's end, or (not ``whole``) also within a cell of several groups."""
        reach = position + capacity
        if reach >= self.total:
            return self.total
        i = int(np.searchsorted(self.ends, reach, "right"))  # the cell that holds it
        return int(self.starts[i]) if whole or self.atomic[i] else reach

    def cuts(self, capacity: int, shards: int, whole: bool = True) -> list[int] | None:
        """Greedy cuts after each shard; None if the shards don't hold everything."""
        out, at = [], 0
        for _ in range(shards):
            nxt = self.cut(at, capacity, whole)
            if nxt <= at and at < self.total:
                return None
            out.append(at := nxt)
        return out if at >= self.total else None

    def smallest(self, shards: int, whole: bool) -> int:
        low, high = max(-(-self.total // shards), 0), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, whole) is None:
                low = mid + 1
            else:
                high = mid
        return low

    def unsure(self, shards: int) -> tuple[int, list[int]]:
        """The smallest capacity with cuts at cell ends, and the cells within which the cuts of a smaller one could fall."""
        high, low = self.smallest(shards, True), self.smallest(shards, False)
        a = b = 0
        found: set[int] = set()
        for _ in range(shards):
            a, b = self.cut(a, low, True), self.cut(b, high, False)
            i, j = np.searchsorted(self.ends, a, "right"), np.searchsorted(self.ends, b, "left")
            found.update(k for k in range(int(i), min(int(j) + 1, len(self.cells))) if not self.atomic[k])
        return high, sorted(found) if low < high else []

    def even(self, capacity: int, shards: int) -> list[int]:
        """Cuts within the capacity that keep what is left near equal shares: each at the cell end nearest to an equal share of the rest, where the rest still fits."""
        greedy = self.cuts(capacity, shards)
        latest_start = [self.total]  # from the end: the least position from which so many shards do
        for _ in range(shards):
            need = latest_start[-1] - capacity
            i = int(np.searchsorted(self.ends, need, "left"))
            latest_start.append(0 if need <= 0 else int(self.ends[i]))
        out, at = [], 0
        for left in range(shards, 0, -1):
            want = at + (self.total - at) / left
            most, least = self.cut(at, capacity, True), latest_start[left - 1]
            options = self.ends[np.searchsorted(self.ends, least, "left") : np.searchsorted(self.ends, most, "right")]
            options = options[options > at] if at < self.total else options
            if left == 1 or at >= self.total:
                out.append(at := self.total)
            elif not len(options):
                return greedy
            else:
                out.append(at := int(options[np.argmin(np.abs(options - want))]))
        sizes = np.diff([0, *out])
        return out if sizes.max(initial=0) <= capacity else greedy


def minimax(cells: Cells, split: Callable[[list[tuple[int, int]]], Cells], shards: int) -> tuple[int, list[int]]:
    """(the smallest capacity, the first key after each shard but the last). ``split`` gives the parts of cells (first key, bits), each narrower by SPLIT_BITS."""
    line = Line(cells)
    while True:
        capacity, unsure = line.unsure(shards)
        unsure = [k for k in unsure if line.cells[k][1] > 0]
        if not unsure:
            break
        gone = set(unsure)
        parts = split([line.cells[k][:2] for k in unsure])
        line = Line(sorted([c for k, c in enumerate(line.cells) if k not in gone] + parts))
    keys = []
    for cut in line.even(capacity, shards)[:-1]:
        i = int(np.searchsorted(line.starts, cut, "left"))
        keys.append(line.cells[i][0] if i < len(line.cells) else 1 << KEY_BITS)
    return capacity, keys


def _cells(groups: DataFrame, first: Column, bits: Column) -> Cells:
    return sorted(tuple(r) for r in groups.groupBy(first.alias("first"), bits.alias("bits")).agg(F.sum("size"), F.count("*")).collect())


def balanced_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row's shard under the law ``bytes``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A row's size is its text's UTF-8 bytes plus one; a null text is empty, and equal to an empty one. Equal texts, repeated rows included, share a shard,
    so a group of copies larger than an equal share has a shard to itself. Slots follow the order of the files that Spark reads.
    An empty table gives no row; other columns are left out. ``grown_shard`` is null: it belongs to the law ``key``.
    """
    spark = ready(docs.sparkSession)
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(text).alias("key"))
    rows = staged(rows, "sizes")
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    bits = KEY_BITS - CELL_BITS
    cells = _cells(groups, F.shiftleft(F.shiftright("key", bits), bits), F.lit(bits))

    def split(wanted: list[tuple[int, int]]) -> Cells:
        table = spark.createDataFrame(wanted, "first long, bits int")
        out = []
        for width in sorted({b for _, b in wanted}):
            narrow = max(0, width - SPLIT_BITS)
            some = table.filter(F.col("bits") == width).select(F.col("first").alias("of"))
            inside = groups.withColumn("of", F.expr(f"shiftleft(shiftright(key, {width}), {width})")).join(F.broadcast(some), "of", "left_semi")
            out += _cells(inside, F.expr(f"shiftleft(shiftright(key, {narrow}), {narrow})"), F.lit(narrow))
        return out

    _, keys = minimax(cells, split, shards)
    shard = F.lit(0)
    for k in keys:
        shard = shard + (F.col("key") >= k).cast("int")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            of = b.column("shard").to_numpy()
            order = np.argsort(of, kind="stable")
            counts = np.bincount(of, minlength=shards)
            ordinal = np.empty(len(of), np.int64)
            ordinal[order] = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + seen[of[order]]
            seen += counts
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(of), part, np.int64)), pa.array(ordinal)], ["doc_id", "size", "text_crc32", "shard", "part", "ordinal"])

    placed = staged(rows.select("doc_id", "size", "text_crc32", shard.alias("shard")).mapInArrow(place, "doc_id long, size long, text_crc32 long, shard int, part long, ordinal long"), "placed")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("part", "shard").agg(F.count("*").alias("n")).select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return placed.join(bases, ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("ordinal")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
