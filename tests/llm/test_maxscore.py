import math

import numpy as np
import pytest

from stopdelay.llm import maxscore as m


def brute(rows, queries, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    out = []
    for i, v in queries:
        if i is None or not ok(v):
            continue
        q = [math.floor(1024 * x) for x in v]
        found = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in whole if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["dense", "sparse", "copies", "negative"])
def test_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(m, "SHARD_ROWS", 150)
    monkeypatch.setattr(m, "BLOCK_QUERIES", 10)
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 12))
    if kind == "sparse":
        x *= r.random(x.shape) < 0.15
    if kind == "copies":
        x[200:500] = x[0]
    if kind == "negative":
        x = -np.abs(x) * np.where(np.arange(600) % 20 == 0, -1, 1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = m.top_k(df, df.where("vec_id % 20 = 0"), 7)
    assert sorted(map(tuple, got.collect())) == brute(rows, [z for z in rows if z[0] % 20 == 0], 7)


def test_odd_rows(spark):
    rows = [(0, [1.0, -1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [0.0, 0.0]), (7, [0.5]), (8, [0.25, 9.0, 3.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (200, None)]
    df = spark.createDataFrame([(*x, 1, "s") for x in rows], "vec_id long, embedding array<double>, score int, query_id string")
    got = m.top_k(df, df.where("vec_id % 100 = 0"))
    assert sorted(map(tuple, got.collect())) == brute(rows, [z for z in rows if z[0] is not None and z[0] % 100 == 0], 10)
    assert m.top_k(df.limit(0), df).count() == 0
    assert m.top_k(df, df.limit(0)).count() == 0


def test_large_components_are_not_cut(spark):
    """Components of 65,536 and more, up to where scores just fit in 64 bits or cancel, against plain whole numbers."""
    rows = [(1, [1.0, 2.0]), (2, [65536.0, 1.0]), (3, [70000.5, -3.0]), (4, [2.0**25, 0.5]), (5, [-(2.0**26), 7.0]), (6, [2.0**60, -(2.0**60)]), (7, [1e300, 0.0])]
    queries = [(100, [1.0, 1.0]), (101, [65537.0, -2.0]), (102, [0.0, 5.0]), (103, [-1.0, 2.0**41])]
    schema = "vec_id long, embedding array<double>"
    for own in (rows[:3], rows[:4], rows[:5]):
        for qs in (queries[:1], queries[:2], queries[:3]):
            whole = lambda v: [int(x * 1024 // 1) for x in v]
            want = sorted((q, i, sum(a * b for a, b in zip(whole(x), whole(y)))) for q, x in qs for i, y in own)
            got = m.top_k(spark.createDataFrame(own, schema), spark.createDataFrame(qs, schema)).collect()
            assert sorted((r.query_id, r.vec_id, r.score) for r in got) == want
    from pyarrow import array

    same = m.matrix(array([x for _, x in rows]))
    assert same[6, 0] == int(1e300) * 1024 and same[2].tolist() == [71680512, -3072]
    shard = m.Shard(np.array([x for x, _ in rows]), same)
    ids, scores = shard.best(0, m.matrix(array([[1.0, 1.0]]))[0], 3)
    assert ids.tolist() == [7, 4, 3] and scores[0] == int(1e300) << 20
