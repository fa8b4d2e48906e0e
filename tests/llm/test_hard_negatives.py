import math

import numpy as np
import pytest

import __spark_entry__ as entry
from stopdelay.llm import hard_negatives as h
from tests.oracle import compare


def brute(rows, anchors, positives=5, k=10):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, g, [math.floor(256 * x) for x in v]) for i, v, g in rows if i is not None and g is not None and ok(v)]
    out = []
    for a, g, x in {(i, g, tuple(v)) for i, g, v in whole if i % anchors == 0}:
        score = sorted((-sum(p * q for p, q in zip(x, y)), i, own == g) for i, own, y in whole if i != a)
        for s, p, _ in [z for z in score if z[2]][:positives]:
            window = [z for z in score if not z[2] and 30 * -s <= 100 * -z[0] <= 90 * -s][:k]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i, _) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["dense", "sparse", "copies", "negative", "clusters", "one label"])
def test_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(h, "SHARD_ROWS", 150)
    monkeypatch.setattr(h, "BLOCK_ANCHORS", 10)
    r = np.random.default_rng(3)
    x, label = r.normal(size=(600, 12)), r.integers(0, 4, 600)
    if kind == "sparse":
        x *= r.random(x.shape) < 0.15
    if kind == "copies":
        x[200:500] = x[0]
    if kind == "negative":
        x = -np.abs(x) * np.where(np.arange(600) % 20 == 0, -1, 1)[:, None]
    if kind == "clusters":
        x = r.normal(size=(4, 12))[r.integers(0, 4, 600)] + 0.3 * x
    if kind == "one label":
        label[:] = 1
    rows = [(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, h.hard_negatives(df, lambda c: c % 20 == 0).collect())) == brute(rows, 20)


def test_odd_rows(spark):
    rows = [(0, [1.0, -1.0, 2.0], 1), (1, None, 1), (2, [None, 1.0], 1), (3, [float("nan"), 1.0], 2), (4, [float("inf"), 0.0], 2), (5, [], 1), (6, [0.0, 0.0], 2), (7, [0.5], 1), (8, [0.25, 9.0, 3.0], 1)]
    rows += [(9, [0.5, 0.25, 0.0, 0.0, 1.0], 2), (9, [0.5, 0.25, 0.0, 0.0, 1.0], 2), (10, [0.5], None), (None, [1.0, 1.0], 1), (100, [1.0, -2.0], 2), (100, [1.0, -2.0], 2), (100, [1.0, 3.0], 1), (200, None, 1), (11, [3.0, 1.0], 1), (12, [1.0, 1.0], 2), (13, [0.4, 0.0, 0.1], 2)]
    df = spark.createDataFrame([(*x, 1, "s", 2) for x in rows], "vec_id long, embedding array<double>, label int, row int, anchor string, id int")
    assert sorted(map(tuple, h.hard_negatives(df, lambda c: c % 100 == 0).collect())) == brute(rows, 100)
    assert h.hard_negatives(df.limit(0), lambda c: c % 100 == 0).count() == 0
    assert h.hard_negatives(df, lambda c: c < 0).count() == 0


def test_large_components_are_not_cut(spark):
    rows = [(0, [2.0**23, -3.0], 1), (1, [2.0**22, 1.0], 1), (2, [2.0**21, 9.0], 2), (3, [2.0**21 + 0.5, -9.0], 2), (4, [-(2.0**23), 1.0], 2), (5, [1.0, 1.0], 2), (6, [0.0, 1e6], 1), (7, [2.0**60, 0.0], 3)]
    for own in (rows[:6], rows[:7]):
        df = spark.createDataFrame(own, "vec_id long, embedding array<double>, label int")
        assert sorted(map(tuple, h.hard_negatives(df, lambda c: c % 100 == 0).collect())) == brute(own, 100)
    from pyarrow import array

    assert h.matrix(array([[1e300, 2.5]]), 256).tolist() == [[int(1e300) * 256, 640]]
    shard = h.Shard(np.arange(3), np.array([1, 2, 2]), h.matrix(array([[2.0**60, 1.0], [2.0**59, 3.0], [2.0**58, 0.0]]), 256))
    query = h.matrix(array([[2.0**30, 1.0]]), 256)
    ((ids, scores),) = shard.best(np.array([1, 2]), query[0], [(m[0], d[0]) for m, d in h.summaries(query)], 1)
    assert ids.tolist() == [1] and scores[0] == (1 << 67) * (1 << 38) + 768 * 256


def test_bounds_hold_and_spare_rows():
    """Each level's bounds hold the exact score, finer ones lie within coarser ones, and few rows of clusters are scored."""
    r = np.random.default_rng(1)
    x = np.repeat(r.normal(size=(2000, 8)), 8, axis=1) * 100 + r.normal(size=(2000, 64)) * 5
    whole = np.floor(x).astype(np.int64)
    shard = h.Shard(np.arange(2000), r.integers(0, 3, 2000), whole)
    before = None
    for mean, deviation in shard.levels:
        centre, spread = mean @ mean[0], deviation @ deviation[0]
        exact = whole @ whole[0]
        assert (exact <= centre + spread + 1e-3).all() and (exact >= centre - spread - 1e-3).all()
        assert before is None or (spread <= before + 1e-3).all()
        before = spread if before is None else np.minimum(spread, before)
    shard.best(np.arange(1, 2000), whole[0], [(m[0], d[0]) for m, d in shard.levels], 10)
    assert shard.exact < 200


def test_query(spark):
    ok, what = compare(spark, "/root/testdata/sf0.01", entry.queries()["op12_hard_negatives"], entry.oracle_sql()["op12_hard_negatives"])
    assert ok, what
