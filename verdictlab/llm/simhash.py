"""SimHash near-duplicates, joined in the space of per-segment bit counts.

A fingerprint's 64 bits are 32 segments of two bits. The counts of set bits by segment are a point in {0, 1, 2}^32,
and the Manhattan distance of two points is a lower bound of the Hamming distance of their fingerprints.
The segments are dealt over six blocks. Points within distance 3 differ in three segments at most, hence in three blocks at most,
so they agree in three blocks: for each choice of three blocks, a point falls in the grid cell of its counts there, and only points of a cell are compared,
first by Manhattan distance, then exactly. A cell gives a spanning forest of its links, never all pairs.
A cell of too many points is dealt anew by the segments that it leaves free, and one that shares nearly all counts by the bits themselves, in the same way,
until every cell is small: at the latest where all but three bits agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, staged

MAX_BITS = 3
#: Cells with more fingerprints are cut again by counts of the segments that the cell leaves free.
CELL_ROWS = 4096
#: So many times by counts, then by bits.
COUNT_LEVELS = 3
_LOW = np.uint64(0x5555555555555555)
_ONE = np.uint64(1)


def fingerprint(text: str) -> int:
    """The unsigned SimHash of a text's three-word shingles under XXH64 with seed 42; zero without a word."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) < 3:
        return h(b" ".join(words), 42)  # one shingle: each bit is set in all or none of it
    joined, lengths = b" ".join(words), list(map(len, words))
    starts = np.cumsum([0, *lengths[:-1]]) + np.arange(len(words))
    ends = starts[2:] + lengths[2:]
    hashes = np.array([h(joined[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=False)], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and the columns to carry of every row."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or "") for t in b.column(1).to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), *b.columns[2:]], ["doc_id", "fp", *carry])

    schema = "doc_id long, fp long" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).mapInArrow(run, schema)


def counts_of(fps: np.ndarray) -> np.ndarray:
    """The point of each fingerprint, a count in unary (00, 01 or 11) by two bits, so that xor and popcount give the Manhattan distance."""
    low, high = fps & _LOW, (fps >> _ONE) & _LOW
    return (low | high) | ((low & high) << _ONE)


def _masks(free: np.ndarray, width: int = 2) -> list[tuple[np.uint64, np.ndarray]]:
    """For each choice of three of six blocks of the free segments (of ``width`` bits): a mask of their bits, and the segments still free.

    Of fewer than six free segments each is a block, and all but three (or none) are chosen.
    """
    blocks = [b for b in np.array_split(free, 6) if len(b)]
    out = []
    for chosen in combinations(range(len(blocks)), max(0, len(blocks) - MAX_BITS)):
        taken = [int(s) for k in chosen for s in blocks[k]]
        out.append((np.uint64(sum(((1 << width) - 1) << width * s for s in taken)), np.array([s for s in free if s not in taken])))
    return out


def cells(fps: np.ndarray, free: np.ndarray, parent: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, choice) of each fingerprint in each grid cell below its parent's. Keys that collide only cause comparisons."""
    points = counts_of(fps) if width == 2 else fps
    keys, choice = [], []
    for k, (mask, _) in enumerate(_masks(free, width)):
        x = (points & mask) ^ (parent * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((k + 1) * 0xD1B54A32D192ED03 & (2**64 - 1))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        keys.append((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB))
        choice.append(np.full(len(fps), k, np.int64))
    return np.concatenate(keys), np.tile(fps, len(keys)), np.concatenate(choice)


def _close(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """Positions of the pairs within MAX_BITS: the lower bound first, then exactly."""
    at = np.flatnonzero(np.bitwise_count(pa_ ^ pb) <= MAX_BITS)
    return at[np.bitwise_count(a[at] ^ b[at]) <= MAX_BITS]


def small_cells(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, least of its component in the cell) over cells in key order."""
    n, point = len(fp), counts_of(fp)
    idx, lefts, rights = np.arange(n), [], []
    d = 1
    while True:
        idx = idx[idx + d < n]
        idx = idx[key[idx] == key[idx + d]]
        if not len(idx):
            break
        hit = idx[_close(fp[idx], fp[idx + d], point[idx], point[idx + d])]
        lefts.append(hit)
        rights.append(hit + d)
        d += 1
    if not lefts:
        return fp[:0], fp[:0]
    left, right = np.concatenate(lefts), np.concatenate(rights)
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def large_cell(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one cell, a row of comparisons at a time."""
    point, left, a, b = counts_of(fp), np.arange(len(fp)), [], []
    while len(left):
        root, todo = left[0], [left[0]]
        left = left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = _close(fp[left], np.broadcast_to(fp[i], len(left)), point[left], np.broadcast_to(point[i], len(left)))
            if len(hit):
                found = left[hit]
                a.append(fp[found])
                b.append(np.full(len(found), fp[root]))
                todo += found.tolist()
                left = np.delete(left, hit)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view("<i8"), pa.int64())


def _free(path: int) -> tuple[np.ndarray, int]:
    """The segments that the choices of a path (two decimal digits each, from one) leave free, and their width: two bits, and one after COUNT_LEVELS choices."""
    digits = str(path) if path else ""
    digits = digits.zfill(len(digits) + len(digits) % 2)
    free, width = np.arange(32), 2
    for level in range(len(digits) // 2 + 1):
        if level == COUNT_LEVELS:
            free, width = np.arange(64), 1
        if level < len(digits) // 2:
            free = _masks(free, width)[int(digits[2 * level : 2 * level + 2]) - 1][1]
    return free, width


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, parent = (batch.column(i).to_numpy().view("<u8") for i in range(2))
        paths = batch.column(2).to_numpy()
        for path in np.unique(paths).tolist():
            at = np.flatnonzero(paths == path)
            free, width = _free(path)
            key, of, choice = cells(fp[at], free, parent[at], width)
            yield pa.RecordBatch.from_arrays([_signed(key), _signed(of), pa.array(path * 100 + choice + 1)], ["key", "fp", "path"])


def _compare(batches: Iterator[pa.RecordBatch], cell_rows: float) -> Iterator[pa.RecordBatch]:
    """Links of the cells of a partition sorted by key, with path 0. Rows of a cell of more than ``cell_rows`` pass through: (fp, key, path)."""

    def rows(a: np.ndarray, b: np.ndarray, path: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_signed(a), _signed(b), pa.array(np.zeros(len(a), np.int64) if path is None else path)], ["a", "b", "path"])

    def whole(key: np.ndarray, fp: np.ndarray, path: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
        sizes = np.diff(np.append(starts, len(key)))
        small = np.ones(len(key), bool)
        for s, n in zip(starts[sizes > 256].tolist(), sizes[sizes > 256].tolist(), strict=True):
            small[s : s + n] = False
            yield rows(fp[s : s + n], key[s : s + n], path[s : s + n]) if n > cell_rows else rows(*large_cell(fp[s : s + n]))
        yield rows(*small_cells(key[small], fp[small]))

    held, over = [np.zeros(0, "<u8"), np.zeros(0, "<u8"), np.zeros(0, np.int64)], None
    for batch in batches:
        new = [batch.column(0).to_numpy().view("<u8"), batch.column(1).to_numpy().view("<u8"), batch.column(2).to_numpy()]
        if over is not None:
            n = int((new[0] == over).sum())  # they come first
            yield rows(new[1][:n], new[0][:n], new[2][:n])
            new = [x[n:] for x in new]
            if not len(new[0]):
                continue
            over = None
        key, fp, path = (np.concatenate(x) for x in zip(held, new, strict=True))
        cut = int(np.argmax(key == key[-1]))  # the last cell may go on
        yield from whole(key[:cut], fp[:cut], path[:cut])
        held = [key[cut:], fp[cut:], path[cut:]]
        if len(held[0]) > cell_rows:
            over = key[-1]
            yield rows(held[1], held[0], held[2])
            held = [x[:0] for x in held]
    yield from whole(*held)


def links(fps: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) over distinct fingerprints ``fp`` whose components are those of all pairs within MAX_BITS.

    A task compares ``cell_rows`` fingerprints of a cell at most; those of larger cells are dealt anew over smaller cells, until none is larger.
    Eight levels end at cells that agree in all but three bits, which hold eight fingerprints.
    """
    ready(fps.sparkSession)
    rows, out, cell_rows = fps.select("fp", F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("path")), None, max(cell_rows, 8)
    while True:
        dealt = rows.mapInArrow(_spread, "key long, fp long, path long").repartition("key").sortWithinPartitions("key")
        got = staged(dealt.mapInArrow(lambda batches: _compare(batches, cell_rows), "a long, b long, path long"), "links")
        found = got.filter("path = 0").select("a", "b")
        out = found if out is None else out.union(found)
        rows = got.filter("path > 0").select(F.col("a").alias("fp"), F.col("b").alias("parent"), "path").distinct()
        if rows.isEmpty():
            return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root the least node reachable, by alternating large and small stars until nothing changes.

    The least neighbours are staged, so that both sides of each join are read from files and Spark can split the rows of a node with very many edges.
    """
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = staged(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        edges = staged(small, "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def near_duplicates(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the least doc_id reachable over links of at most MAX_BITS bits) of every row.

    Null, empty and white texts have fingerprint zero and are linked like others. Repeated rows give repeated results. A long text is hashed whole, in parts.
    A null doc_id is never a component's least unless it has no other. An empty table gives no row; columns besides doc_id and text are left out,
    but for ``carry``, a column by which rows can be told apart; with it comes ``root``, which tells components apart that have null doc_ids only.
    """
    more = [carry] if carry else []
    marked = staged(fingerprints(docs, *more), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp")))
    rooted = staged(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    whole = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = staged(rooted.select("fp", "root").join(whole, "root").select("fp", "component_id", "root"), "named")
    columns = ["doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"]
    return marked.join(named, "fp").select(*columns, *(["root", carry] if carry else []))
