import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from verdictlab.llm import sharding

from .fixtures import ODD_ROWS, SCHEMA, TEXTS, documents


def brute(sizes, shards):
    """The smallest capacity for which greedy runs of the sizes make at most ``shards``."""

    def fits(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(12))
def test_capacity_is_the_smallest(seed):
    rng = random.Random(seed)
    bits = 20
    keys = sorted(rng.sample(range(1 << bits), rng.randint(1, 400)))
    sizes = [rng.choice([1, rng.randint(1, 50), rng.randint(1, 3000) if rng.random() < 0.05 else 3]) for _ in keys]
    shards = rng.choice([1, 3, 16])
    asked = []

    def cells(first_bits):
        out = defaultdict(lambda: [0, 0])
        for k, s in zip(keys, sizes, strict=True):
            for first, b in first_bits:
                if first <= k < first + (1 << b):
                    narrow = max(0, b - 3)
                    at = (k >> narrow << narrow, narrow)
                    out[at][0] += s
                    out[at][1] += 1
        return [(f, b, s, n) for (f, b), (s, n) in out.items()]

    def split(wanted):
        asked.append(len(wanted))
        return cells(wanted)

    capacity, cuts = sharding.minimax(sorted(cells([(0, bits)])), split, shards)
    assert capacity == brute(sizes, shards)
    fill = np.zeros(shards, int)
    for k, s in zip(keys, sizes, strict=True):
        fill[sum(k >= c for c in cuts)] += s
    assert len(cuts) == shards - 1 and cuts == sorted(cuts) and fill.max() <= capacity


def test_a_large_group_leaves_the_rest_even():
    cells = sorted([(i * 10, 0, 10, 1) for i in range(1000)] + [(5005, 0, 4000, 1)])
    capacity, cuts = sharding.minimax(cells, lambda w: [], 16)
    fill = np.zeros(16, int)
    for k, _, s, _ in cells:
        fill[sum(k >= c for c in cuts)] += s
    rest = sorted(fill)[:-1]
    assert capacity == 4000 and fill.max() == 4000 and rest[0] > 500 and rest[-1] < 900, fill


def check(docs, shards):
    rows = sharding.balanced_shards(docs, shards).collect()
    texts = defaultdict(list)
    for d, t, *_ in docs.collect():
        texts[d].append(t or "")
    by, groups, crcs = defaultdict(list), defaultdict(set), {}
    for d, ts in texts.items():
        for t in ts:
            crcs.setdefault(zlib.crc32(t.encode()), set()).add(t)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        groups[r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
        assert any(r["text_crc32"] == zlib.crc32(t.encode()) and r["size"] == len(t.encode()) + 1 for t in texts[r["doc_id"]])
    assert len(rows) == docs.count()
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and all(0 <= k < shards for k in by)
    assert all(len(s) == 1 for c, s in groups.items() if len(crcs[c]) == 1)
    return rows


def test_shards(spark, sf_dir):
    check(documents(spark, TEXTS, ODD_ROWS).repartition(3), 4)
    rows = check(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5), 16)
    fill = defaultdict(int)
    for r in rows:
        fill[r["shard"]] += r["size"]
    # the capacity is the least for the order of the hash
    by_key = defaultdict(int)
    import hashlib

    for _, t, *_ in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        by_key[int(hashlib.sha256(t.encode()).hexdigest()[:15], 16)] += len(t.encode()) + 1
    assert max(fill.values()) <= brute([by_key[k] for k in sorted(by_key)], 16)
    assert sharding.balanced_shards(spark.createDataFrame([], SCHEMA), 16).count() == 0
