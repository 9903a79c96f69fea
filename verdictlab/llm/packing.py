"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Only the lengths matter to a packing, and there are at most ``capacity`` of them.
So the driver packs the histogram of lengths: bins with the same lengths form a class with a count, and every step moves whole classes.
Its work depends on the capacity, not on the number of documents. Pieces then find their place by their rank among those of their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import ready, staged, text_or_empty

END_ID = 0
#: Local search may make so many exchanges of classes for every underfull class of bins.
EXCHANGES_PER_CLASS = 50

Classes = dict[tuple[int, ...], int]


def best_fit(hist: dict[int, int], capacity: int) -> Classes:
    """Best-fit decreasing over a histogram of lengths; gives bins as {lengths, descending: how many such bins}."""
    if any(not 0 < n <= capacity for n in hist):
        raise ValueError("a length is outside 1 to the capacity")
    by_room: dict[int, Classes] = defaultdict(dict)

    def put(bin_: tuple[int, ...], count: int) -> None:
        room = capacity - sum(bin_)
        if count:
            by_room[room][bin_] = by_room[room].get(bin_, 0) + count

    for n in sorted(hist, reverse=True):
        left = hist[n]
        while left:
            room = min((r for r, c in by_room.items() if r >= n and c), default=None)
            if room is None:
                k = capacity // n
                put((n,) * k, left // k)
                put((n,) * (left % k), 1 if left % k else 0)
                break
            bin_, count = by_room[room].popitem()
            k = room // n
            full = min(count, left // k)
            left -= full * k
            put(bin_ + (n,) * k, full)
            if full < count:
                put(bin_ + (n,) * left, 1 if left else 0)
                put(bin_, count - full - (1 if left else 0))
                left = 0
    out: Classes = {}
    for classes in by_room.values():
        out |= {b: out.get(b, 0) + c for b, c in classes.items()}
    return out


class _Open:
    """The underfull classes of bins, with all that each can give (a piece or two) and take for it: nothing, a piece, or two for one.

    A class with room r that hands back y takes any x in (y, y + r], which raises the sum of squared fills if it is then fuller than the giver was.
    Gives and takes stand in arrays, so that one comparison asks all classes at once; those of classes that are gone stay until they are half.
    """

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.fill = capacity, [], np.zeros(64, np.int64)
        self.ids: dict[tuple[int, ...], int] = {}
        self.alive = np.zeros(64, bool)
        self.gives, self.takes = np.zeros((256, 3), np.int64), np.zeros((256, 4), np.int64)  # (x, pieces, class) and (y, y + room, pieces, class)
        self.n_gives = self.n_takes = 0

    @staticmethod
    def _put(table: np.ndarray, n: int, rows: list[tuple[int, ...]]) -> tuple[np.ndarray, int]:
        while n + len(rows) > len(table):
            table = np.concatenate([table, np.zeros_like(table)])
        table[n : n + len(rows)] = rows
        return table, n + len(rows)

    def add(self, bin_: tuple[int, ...]) -> int:
        k = self.ids[bin_] = len(self.bins)
        self.bins.append(bin_)
        if k >= len(self.fill):
            self.fill, self.alive = np.concatenate([self.fill, np.zeros_like(self.fill)]), np.concatenate([self.alive, np.zeros_like(self.alive)])
        self.fill[k], self.alive[k] = sum(bin_), True
        room, ones = self.capacity - sum(bin_), sorted(set(bin_))
        sums = [(x, 1) for x in ones] + [(x, 2) for x in sorted({x + y for i, x in enumerate(ones) for y in ones[i:] if x != y or bin_.count(x) > 1})]
        self.gives, self.n_gives = self._put(self.gives, self.n_gives, [(x, n, k) for x, n in sums])
        self.takes, self.n_takes = self._put(self.takes, self.n_takes, [(y, y + room, n, k) for y, n in [(0, 0), *sums]])
        return k

    def drop(self, bin_: tuple[int, ...]) -> None:
        self.alive[self.ids.pop(bin_)] = False
        if len(self.bins) > 2 * len(self.ids) + 64:
            left, self.bins, self.n_gives, self.n_takes = list(self.ids), [], 0, 0
            self.alive[:] = False
            self.ids = {}
            for b in left:
                self.add(b)

    def step(self, bin_: tuple[int, ...], count: dict[tuple[int, ...], int]) -> tuple | None:
        """(giver, taker, x, pieces of x, y, pieces of y) of the exchange of ``bin_`` with any class, itself included, that moves the most."""
        k, best = self.ids[bin_], None
        takes, gives = self.takes[: self.n_takes], self.gives[: self.n_gives]
        lo, hi, back, taker = takes.T
        x_, many, giver = gives.T
        alone = count[bin_] < 2
        taker_ok = self.alive[taker] & ((taker != k) if alone else True)
        giver_ok = self.alive[giver] & ((giver != k) if alone else True)
        for x, n in self.gives[: self.n_gives][giver == k][:, :2].tolist():
            at = np.flatnonzero(taker_ok & (lo < x) & (hi >= x) & ((back < 2) if n == 2 else True) & ((back > 0) if n == 2 else True) & (self.fill[taker] + x - lo > self.fill[k]))
            if len(at):
                i = at[np.argmin(lo[at])]
                if best is None or x - lo[i] > best[0]:
                    best = (x - lo[i], k, taker[i], x, n, lo[i], back[i])
        for y, top, n, _ in self.takes[: self.n_takes][taker == k].tolist():
            at = np.flatnonzero(giver_ok & (x_ > y) & (x_ <= top) & ((many == 1) if n != 1 else True) & (self.fill[k] + x_ - y > self.fill[giver]))
            if len(at):
                i = at[np.argmax(x_[at])]
                if best is None or x_[i] - y > best[0]:
                    best = (x_[i] - y, giver[i], k, x_[i], many[i], y, n)
        return None if best is None else (self.bins[best[1]], self.bins[best[2]], *map(int, best[3:]))


def _without(bin_: tuple[int, ...], total: int, n: int) -> tuple[list[int], list[int]]:
    """``bin_`` split into the rest and ``n`` pieces of ``total`` altogether."""
    rest = list(bin_)
    if n == 0:
        return rest, []
    out = [total] if n == 1 else next([x, total - x] for x in bin_ if total - x in bin_ and (2 * x != total or bin_.count(x) > 1))
    for x in out:
        rest.remove(x)
    return rest, out


def improve(classes: Classes, capacity: int, max_exchanges: int | None = None) -> Classes:
    """Exchange pieces between underfull bins, a move, one for one, two for one or one for two, while any exchange raises the sum of squared fills; emptied bins go.

    Whole classes of bins are exchanged at once, the emptiest first. It ends where no pair of classes has an exchange left, at the least possible number of bins,
    or after ``max_exchanges`` (by default EXCHANGES_PER_CLASS for every underfull class that there is at first, so that it grows with the instance).
    """
    classes = dict(classes)
    total = sum(sum(b) * c for b, c in classes.items())
    least, bins = -(-total // capacity), sum(classes.values())
    open_ = _Open(capacity)
    work = [(sum(b), b) for b in classes if sum(b) < capacity]
    for _, b in work:
        open_.add(b)
    heapq.heapify(work)
    left = EXCHANGES_PER_CLASS * len(work) if max_exchanges is None else max_exchanges
    while work and bins > least and left:
        _, bin_ = heapq.heappop(work)
        if bin_ not in open_.ids or (step := open_.step(bin_, classes)) is None:
            continue
        left -= 1
        a, b, x, n, y, m = step
        times = classes[a] // 2 if a == b else min(classes[a], classes[b])
        rest_a, out = _without(a, x, n)
        rest_b, back = _without(b, y, m)
        for old in (a, b):
            classes[old] -= times
        for old in {a, b}:
            if classes[old]:
                heapq.heappush(work, (sum(old), old))
            else:
                del classes[old]
                open_.drop(old)
        for new in (rest_a + back, rest_b + out):
            key = tuple(sorted(new, reverse=True))
            if not key:
                bins -= times
                continue
            classes[key] = classes.get(key, 0) + times
            if sum(key) < capacity:
                if key not in open_.ids:
                    open_.add(key)
                heapq.heappush(work, (sum(key), key))
    return classes


def places(classes: Classes) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, pieces of this length a bin, offset of the first) in rank order."""
    out: dict[int, list] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for bin_, count in sorted(classes.items(), reverse=True):
        offset = 0
        for n in dict.fromkeys(bin_):
            k = bin_.count(n)
            out[n].append((ranks[n], sequence, k, offset))
            ranks[n] += k * count
            offset += k * n
        sequence += count
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """Cut documents into pieces: doc_id, piece, start, length, ids_crc32, part, ordinal (among the pieces of this length in this partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            ids, ends = enc.encode_ended(b.column(1).to_pylist(), END_ID)
            raw, ends = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), ends.tolist()
            for d, at, stop in zip(b.column(0).to_pylist(), ends[:-1], ends[1:], strict=True):
                n, start = stop - at, 0
                first = n % capacity or capacity
                for piece, upto in enumerate(range(first, n + 1, capacity)):
                    length = upto - start
                    rows.append((d, piece, start, length, zlib.crc32(raw[4 * (at + start) : 4 * (at + upto)]), part, int(seen[length])))
                    seen[length] += 1
                    start = upto
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "ordinal"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long, part long, ordinal long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``END_ID``; a null or empty text is that one id. Only longer documents are cut, and then all pieces but the first are full.
    Repeated rows are packed each; an empty table gives no row; columns besides doc_id and text are left out. A long text is encoded whole, then cut.
    The driver gets at most ``capacity`` counts. On sf0.1 best-fit alone meets the lower bound; where it doesn't, the search goes on until nothing improves.
    """
    spark = ready(docs.sparkSession)
    pieces = staged(token_pieces(docs, tokenizer, capacity), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(improve(best_fit(hist, capacity), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shared = spark.sparkContext.broadcast(where)  # at most capacity classes of lengths, each with few rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at, rows = np.flatnonzero(length == n), table[int(n)]
                i = np.searchsorted(rows[:, 0], rank[at], "right") - 1
                first, seq, k, off = rows[i].T
                sequence[at] = seq + (rank[at] - first) // k
                offset[at] = off + (rank[at] - first) % k * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", (F.col("base") + F.col("ordinal")).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
