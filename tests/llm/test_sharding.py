import hashlib
import random
import zlib

import numpy as np
import pytest

from stopdelay.llm import sharding as s


def brute_capacity(sizes, k):
    """Least largest sum over all ways to cut sizes into k runs."""
    best = {0: 0}
    n = len(sizes)
    ends = [0, *np.cumsum(sizes).tolist()]
    best = [0] + [float("inf")] * n
    for _ in range(k):
        best = [0] + [min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(1, n + 1)]
    return best[n]


@pytest.mark.parametrize("seed", range(20))
def test_smallest_capacity(seed):
    r = random.Random(seed)
    sizes = [r.choice([1, 5, 20, 100]) for _ in range(r.randrange(1, 30))]
    k = r.randrange(1, 8)
    assert s.smallest_capacity(np.array(sizes), k) == brute_capacity(sizes, k)


def rows_of(spark, texts, shards, **bits):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df, s.shard(df, shards).collect()


@pytest.mark.parametrize("seed", range(3))
def test_cuts_are_those_of_all_groups(spark, seed):
    r = random.Random(seed)
    texts = ["".join(r.choices("ab ", k=r.choice([0, 3, 40, 300]))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d = s.digested(df)
    groups = sorted((tuple(x) for x in d.groupBy("_hi", "_lo").agg({"size": "sum"}).collect()))
    for first, more in ((2, 2), (14, 8)):
        cuts = s.plan_cuts(d, 7, first, more)
        shard_of = lambda g: sum(g[:2] >= c for c in cuts)
        sums = [0] * 7
        for g in groups:
            sums[shard_of(g)] += g[2]
        assert max(sums) == s.smallest_capacity(np.array([g[2] for g in groups]), 7)


def test_rows_slots_and_groups(spark):
    texts = ["same"] * 500 + [f"text {i}" for i in range(300)] + [None, None, "", "é" * 5000]
    df, rows = rows_of(spark, texts, 8)
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for k in range(8):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))
    by = {}
    for r in rows:
        t = texts[r.doc_id]
        assert r.size == (len(t.encode()) if t is not None else 0) + 16
        assert r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        by.setdefault(t, set()).add(r.shard)
    assert all(len(x) == 1 for x in by.values())
    assert {r.shard for r in rows} <= set(range(8))
    # shards are runs of the digests' order, also around groups that are larger than an even share
    order = sorted(by, key=lambda t: "" if t is None else hashlib.md5(t.encode()).hexdigest())
    runs = [next(iter(by[t])) for t in order]
    assert runs == sorted(runs)
    sizes = [sum(r.size for r in rows if texts[r.doc_id] == t) for t in order]
    sums = [sum(n for n, k in zip(sizes, runs) if k == shard) for shard in range(8)]
    assert max(sums) == brute_capacity(sizes, 8) == max(sizes)


def test_large_groups_of_the_smallest_table(spark):
    """Five groups of this table are larger than a fortieth of it; shards are runs of groups and none is larger than it must be."""
    rows = s.op8_minimax_shards(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    groups = {}
    for r in rows:
        text = docs[r.doc_id]
        g = groups.setdefault("" if text is None else hashlib.md5(text.encode()).hexdigest(), [0, set()])
        g[0] += r.size
        g[1].add(r.shard)
    ordered = [groups[k] for k in sorted(groups)]
    runs = [next(iter(k)) for _, k in ordered]
    assert all(len(k) == 1 for _, k in ordered) and runs == sorted(runs)
    sizes = [n for n, _ in ordered]
    assert sum(n * 40 > sum(sizes) for n in sizes) == 5
    sums = [sum(n for n, k in zip(sizes, runs) if k == shard) for shard in range(40)]
    assert max(sums) == s.smallest_capacity(np.array(sizes), 40) == brute_capacity(sizes, 40)


def test_rows_that_repeat_an_id(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    rows = s.shard(df, 2).collect()
    assert len(rows) == 6
    for k in range(2):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_empty_and_fewer_groups_than_shards(spark):
    assert rows_of(spark, [], 4)[1] == []
    assert {r.shard for r in rows_of(spark, ["a", "a"], 4)[1]} < set(range(4))
    df = spark.createDataFrame([(1, "a", 2, "x")], "doc_id long, text string, size long, shard string")
    assert s.shard(df, 3).count() == 1


@pytest.mark.parametrize("seed", range(20))
def test_even_cuts_keep_the_least_capacity(seed):
    r = random.Random(seed)
    sizes = np.array([r.choice([1, 5, 20, 100]) for _ in range(r.randrange(1, 200))])
    k = r.randrange(1, 12)
    capacity = s.smallest_capacity(sizes, k)
    cuts = s._even(np.cumsum(sizes), capacity, k)
    assert len(cuts) == k and cuts == sorted(cuts) and cuts[-1] == len(sizes)
    sums = [int(x.sum()) for x in np.split(sizes, cuts[:-1])]
    assert max(sums) <= capacity


def test_no_shard_is_short(spark):
    r = random.Random(3)
    _, rows = rows_of(spark, ["x" * r.randrange(1, 400) + str(i) for i in range(4000)], 12)
    sums = {}
    for x in rows:
        sums[x.shard] = sums.get(x.shard, 0) + x.size
    assert len(sums) == 12 and max(sums.values()) - min(sums.values()) < 1000
