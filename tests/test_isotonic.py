"""The isotonic fit by merged pools."""

import random
from fractions import Fraction

import pandas as pd
import pytest

from stopdelay.operators import calibration as k


def plain(points):
    """The fit by its formula: the greatest over a of the least over b of the mean of points a to b."""
    xs = sorted({p for p, _ in points})
    w = [sum(1 for p, _ in points if p == x) for x in xs]
    s = [sum(y for p, y in points if p == x) for x in xs]
    mean = lambda a, b: Fraction(sum(s[a : b + 1]), sum(w[a : b + 1]))
    fit = [max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i in range(len(xs))]
    pools = {}
    for x, y in zip(xs, fit):
        pools.setdefault(y, []).append(x)
    return [(v[0], v[-1], y) for y, v in sorted(pools.items())]


def frame(spark, points, parts=7):
    return spark.createDataFrame([(p, 9 if y else 0) for p, y in points] or [], "model_probability double, actual_delay_min long").repartition(parts)


@pytest.mark.parametrize("seed", range(3))
def test_pools(spark, seed):
    rng = random.Random(seed)
    points = [(round(rng.random(), 2), rng.random()) for _ in range(400)]
    points = [(p, int(u < p)) for p, u in points]
    got = [(r.lo, r.hi, Fraction(r.s, r.w)) for r in k.isotonic_blocks(frame(spark, points)).orderBy("lo").collect()]
    assert got == plain(points)


@pytest.mark.parametrize("points, knots", [
    ([], ([], [])), ([(0.5, 1)], ([0.5], [1.0])), ([(0.1, 1), (0.2, 0)], ([0.1, 0.2], [0.5, 0.5])), ([(0.1, 0), (0.2, 1)], ([0.1, 0.2], [0.0, 1.0])),
    ([(None, 1), (float("nan"), 1), (0.0, 0), (-0.0, 1)], ([0.0], [0.5])), ([(0.3, 0)] * 5, ([0.3], [0.0])),
])
def test_small_curves(spark, points, knots):
    assert k.isotonic_curve(frame(spark, points, 3)) == knots


def test_merging_pools_of_ranges_is_pooling_all():
    rng = random.Random(9)
    rows = [(i / 500, i / 500, 1, int(rng.random() < i / 500)) for i in range(500)]
    pool = lambda rows: list(next(k.pooled([pd.DataFrame(rows, columns=["lo", "hi", "w", "s"])])).itertuples(index=False, name=None))
    whole = pool(rows)
    for cuts in ([250], [1, 2, 499], range(25, 500, 25)):
        ends = [0, *cuts, 500]
        assert pool([b for i, j in zip(ends, ends[1:]) for b in pool(rows[i:j])]) == whole
