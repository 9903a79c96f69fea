import random

import numpy as np
import pytest
import xxhash

from verdictlab.llm import simhash

from .fixtures import ODD_ROWS, SCHEMA, TEXTS, documents


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs)) if hs else 0


def brute_components(rows):
    ids = [(d, brute_fingerprint(t)) for d, t in rows]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (ids[i][1] ^ ids[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return sorted((d if d is not None else -99, f"{fp:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, fp) in enumerate(ids))


def got(docs):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())


def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = documents(spark, [*TEXTS, "ONE Two three", "É é", "é É"], ODD_ROWS).repartition(3)
    assert got(docs) == brute_components([(r[0], r[1]) for r in docs.collect()])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(docs) == brute_components([(r[0], r[1]) for r in docs.collect()])
    assert got(spark.createDataFrame([], SCHEMA)) == []


def random_fps(seed):
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(6):  # chains and dense balls
        x = rng.getrandbits(64)
        for _ in range(60):
            y = x
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randrange(64)
            out.add(y)
            x = y if rng.random() < 0.3 else x
    return np.array(sorted(out), "<u8")


def brute_roots(fps):
    left, out = set(range(len(fps))), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            i = todo.pop()
            seen.append(i)
            near = [j for j in left if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3]
            left.difference_update(near)
            todo += near
        out.append(frozenset(int(fps[i]) for i in seen))
    return {c for c in out if len(c) > 1}


@pytest.mark.parametrize(("seed", "cell_rows"), [(1, 4096), (2, 4), (3, 1)])
def test_links_lose_nothing(spark, seed, cell_rows):
    fps = random_fps(seed)
    df = spark.createDataFrame([(int(x),) for x in fps.view("<i8")], "fp long").repartition(3)
    groups = {}
    for r in simhash.components(simhash.links(df, cell_rows)).collect():
        groups.setdefault(r["root"], set()).add(r["node"] & (2**64 - 1))
    assert {frozenset(g) for g in groups.values()} == brute_roots(fps)


def test_links_among_equal_counts(spark):
    """Every segment has one bit set, so that counts can't tell these apart and cells are cut by bits."""
    rng, out = random.Random(9), set()
    for _ in range(40):
        x = rng.getrandbits(32)
        for _ in range(12):
            out.add(sum((1 << (x >> k & 1)) << 2 * k for k in range(32)))
            x ^= 1 << rng.randrange(32)
            x ^= (1 << rng.randrange(32)) * (rng.random() < 0.4)
    fps = np.array(sorted(out), "<u8")
    assert len(np.unique(simhash.counts_of(fps))) == 1
    df = spark.createDataFrame([(int(x),) for x in fps.view("<i8")], "fp long").repartition(3)
    groups = {}
    for r in simhash.components(simhash.links(df, 100)).collect():
        groups.setdefault(r["root"], set()).add(r["node"] & (2**64 - 1))
    assert {frozenset(g) for g in groups.values()} == brute_roots(fps)


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    low = np.bitwise_count(simhash.counts_of(a) ^ simhash.counts_of(b))
    fields = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * k)) & np.uint64(3)).astype(int) for k in range(32)])
    assert (low == np.abs(fields(a) - fields(b)).sum(axis=0)).all()
    assert (low <= np.bitwise_count(a ^ b)).all()


def test_large_cell_equals_small_cells():
    fps = random_fps(5)
    key = np.zeros(len(fps), "<u8")

    def groups(edges):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for x, y in zip(*edges, strict=True):
            root[find(int(x))] = find(int(y))
        out = {}
        for x in list(root):
            out.setdefault(find(x), set()).add(x)
        return {frozenset(g) for g in out.values() if len(g) > 1}

    assert groups(simhash.large_cell(fps)) == groups(simhash.small_cells(key, fps)) == brute_roots(fps)
