"""Boosted trees against searches by hand, exact quantiles against numpy."""

import itertools
import json
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stopdelay.operators.quantiles import from_keys, grouped_quantile, ordered_keys
from stopdelay.plans import boosting as b
from stopdelay.plans import models as pm
from stopdelay.queries import QUERIES, SQL
from tests.oracle import compare

HOME = {"numeric": ["x", "z"], "categorical": ["name"]}


def rows_of(seed, n=400):
    r = random.Random(seed)
    names = ["a", "b", "c", "d", "e", "f", "g", "h", None]
    lift = {x: r.random() for x in names}
    out = []
    for _ in range(n):
        x, z, name = r.choice([None, *range(12)]), r.choice([None, r.gauss(0, 1), float("nan")]), r.choice(names)
        out.append((x, z, name, int(r.random() < 0.5 * lift[name] + (0.3 if x is None or x > 7 else 0.0)), r.choice([0, 0, 3, 5, -2]) + (x or 0) * r.choice([0, 1, 3])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "x int, z double, name string, late int, delay int")


def part(g, h, l2):
    g, w = g / b.UNIT, h / b.UNIT + l2
    return g * g / w if w > 0 else 0.0


def split_by_hand(bins, g, h, numeric, l2, min_rows):
    """Every cut of every feature, one by one; the best, of equals the first feature, the first cut, missing to the right."""
    n, (all_g, all_h), best = len(bins), (int(g.sum()), int(h.sum())), None
    for f in range(bins.shape[1]):
        own = bins[:, f]
        codes = sorted(set(own.tolist()))
        if f < numeric:
            cuts = [(c, side) for c in codes for side in (False, True)]
        else:
            ratio = {c: int(g[own == c].sum()) / b.UNIT / (int(h[own == c].sum()) / b.UNIT + l2) for c in codes}
            codes.sort(key=lambda c: (ratio[c], c))
            cuts = [(codes[: i + 1], None) for i in range(len(codes))]
        for place, (cut, side) in enumerate(cuts):
            left = np.isin(own, cut) if side is None else np.where(own == 0, side, own <= cut)
            if min(left.sum(), n - left.sum()) < min_rows:
                continue
            lg, lh = int(g[left].sum()), int(h[left].sum())
            gain = part(lg, lh, l2) + part(all_g - lg, all_h - lh, l2) - part(all_g, all_h, l2)
            if gain > b.LEAST_GAIN and (best is None or gain > best[0]):
                best = (gain, f, cut if side is not None else cut[-1], bool(side), sorted(cut) if side is None else None, left)
    return best


def tree_by_hand(boost, bins, y, f, numeric):
    g, h = boost.gradients(y, f)
    tree, open_ = b.Tree(), {1: np.arange(len(y))}
    sums = {}
    for _ in range(boost.depth):
        nxt = {}
        for node, own in sorted(open_.items()):
            best = split_by_hand(bins[own], g[own], h[own], numeric, boost.l2, boost.min_rows)
            if best:
                tree.splits.append((node, best[1], int(best[2]), best[3], best[4]))
                for child, rows in ((2 * node, own[best[5]]), (2 * node + 1, own[~best[5]])):
                    sums[child] = rows
                    if len(rows) >= 2 * boost.min_rows:
                        nxt[child] = rows
        open_ = nxt
    for node in set(sums) - {s[0] for s in tree.splits}:
        own = sums[node]
        if boost.loss == "logistic":
            tree.values[node] = -boost.step * (int(g[own].sum()) / b.UNIT) / (int(h[own].sum()) / b.UNIT + boost.l2)
        else:
            tree.values[node] = boost.step * float(np.quantile(y[own] - f[own], boost.loss))
    return tree


@pytest.mark.parametrize("loss,target", [("logistic", "late"), (0.9, "delay")])
def test_trees_equal_those_found_by_hand(spark, loss, target):
    """Exactly, however the rows are dealt: splits, directions of what is missing, sets of categories and leaves."""
    rows = rows_of(3)
    df = frame(spark, rows).repartition(5)
    binning = b.Binning.fit(df, **HOME, category_rows=1)
    binned = binning.apply(df)
    boost = b.Boost(loss, rounds=4, depth=3, step=0.3, l2=1.0 if loss == "logistic" else 0.0, min_rows=10)
    boost.fit(binned, target, binning.widths, 2)
    local = binning.apply(frame(spark, rows).coalesce(1)).select("bins", F.col(target).cast("double").alias("y")).toArrow()
    bins, y = b.bins_of(local.column("bins").combine_chunks(), 3), local.column("y").to_numpy()
    f = np.full(len(y), boost.base)
    assert len(boost.trees) == 4
    for tree in boost.trees:
        want = tree_by_hand(boost, bins, y, f, 2)
        assert [(s[0], s[1], s[2], s[3], s[4]) for s in tree.splits] == want.splits
        assert {k: round(v, 9) for k, v in tree.values.items()} == {k: round(v, 9) for k, v in want.values.items()}
        f = f + tree.score(bins)
    again = b.Boost(loss, rounds=4, depth=3, step=0.3, l2=boost.l2, min_rows=10).fit(binned.repartition(2), target, binning.widths, 2)
    assert again.state() == boost.state()


@pytest.mark.parametrize("seed", range(4))
def test_categories_split_as_the_best_of_all_subsets(spark, seed):
    r = np.random.default_rng(seed)
    code, n = r.integers(0, 9, 600), 600
    g = np.rint((r.random(n) - r.random(9)[code]) * b.UNIT).astype(np.int64)
    h = np.rint(r.uniform(0.05, 0.25, n) * b.UNIT).astype(np.int64)
    df = spark.createDataFrame([(1, 0, int(c), int(x), int(w), 1) for c, x, w in zip(code, g, h)], "node long, feature int, bin int, g long, h long, n long")
    got = b.best_splits(df, 0, 0.0, 1).first()
    sums = {c: (int(g[code == c].sum()), int(h[code == c].sum())) for c in range(9)}
    every = (sum(x for x, _ in sums.values()), sum(w for _, w in sums.values()))

    def gain(left):
        lg, lh = sum(sums[c][0] for c in left), sum(sums[c][1] for c in left)
        return part(lg, lh, 0.0) + part(every[0] - lg, every[1] - lh, 0.0) - part(*every, 0.0)

    best = max(gain(left) for k in range(1, 9) for left in itertools.combinations(range(9), k))
    assert abs(got["gain"] - best) < 1e-9 and abs(gain(got["left"]) - best) < 1e-9


def test_bins_of_unseen_rare_and_missing(spark):
    train = spark.createDataFrame([(float(i % 4), "often" if i % 2 else "also", None) for i in range(100)] + [(None, "rare", None)], "x double, name string, bins string")
    binning = b.Binning.fit(train, ["x"], ["name"])
    assert binning.names == [["also", "often"]] and binning.widths == [len(binning.edges[0]) + 2, 3]
    new = spark.createDataFrame([(0.0, "also"), (2.5, "often"), (3.0, "rare"), (99.0, "never"), (None, None), (float("nan"), "also")], "x double, name string")
    got = b.bins_of(binning.apply(new).toArrow().column("bins").combine_chunks(), 2).tolist()
    assert got == [[1, 1], [4, 2], [4, 0], [5 if 3.0 in binning.edges[0] else 4, 0], [0, 0], [0, 1]]
    same = b.Binning(**json.loads(json.dumps(binning.state())))
    assert same.apply(new).select("bins").collect() == binning.apply(new).select("bins").collect()
    empty = b.Binning.fit(train.limit(0), ["x"], ["name"])
    assert empty.widths == [2, 1] and empty.apply(new).count() == 6


def test_no_split_and_no_rows(spark):
    flat = frame(spark, [(1, 1.0, "a", 1, 2)] * 50)
    binning = b.Binning.fit(flat, **HOME)
    boost = b.Boost("logistic", 3).fit(binning.apply(flat), "late", binning.widths, 2)
    assert boost.trees == [] and b.scored(binning.apply(flat), {"p": boost}, 3).first()["p"] > 0.98
    assert b.Boost("logistic", 3).fit(binning.apply(flat.limit(0)), "late", binning.widths, 2).trees == []
    assert b.Boost(0.5, 3).fit(binning.apply(flat.limit(0)), "delay", binning.widths, 2).base == 0.0
    none = binning.apply(flat.withColumn("late", F.lit(None).cast("int")))
    assert b.Boost("logistic", 2).fit(none, "late", binning.widths, 2).base == 0.0


def test_scores_are_written_between_trees(spark, monkeypatch):
    """As many trees with scores written after each two as without."""
    df = frame(spark, rows_of(8))
    binning = b.Binning.fit(df, **HOME, category_rows=1)
    one = b.Boost("logistic", 5, 2, min_rows=10).fit(binning.apply(df), "late", binning.widths, 2)
    monkeypatch.setattr(b, "WRITTEN", 2)
    two = b.Boost("logistic", 5, 2, min_rows=10).fit(binning.apply(df), "late", binning.widths, 2)
    assert one.state() == two.state() and len(one.trees) == 5
    text = json.dumps(one.state())
    assert json.dumps(b.Boost.of(json.loads(text)).state()) == text


def test_log_loss_beside_mllib(spark):
    """On the same rows and rounds, no worse than Spark's own boosted trees with categories hashed and a mark for null."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = frame(spark, rows_of(5, 3000)).withColumns({"label": F.col("late").cast("double"), "z": F.nanvl("z", F.lit(None).cast("double"))})
    train, rest = df.where(F.col("delay") != 3), df.where(F.col("delay") == 3)
    filled = lambda d: d.withColumns({"x": F.coalesce(F.col("x").cast("double"), F.lit(-999.0)), "z": F.coalesce("z", F.lit(-999.0))})
    pipe = Pipeline(stages=[StringIndexer(inputCol="name", outputCol="ix", handleInvalid="keep"), VectorAssembler(inputCols=["x", "z", "ix"], outputCol="features"), GBTClassifier(maxIter=6, stepSize=0.5, maxDepth=4, minInstancesPerNode=20, maxBins=256, seed=7)]).fit(filled(train))
    theirs = pipe.transform(filled(rest)).select("label", vector_to_array("probability")[1].alias("p"))
    binning = b.Binning.fit(train, **HOME)
    boost = b.Boost("logistic", 6, 4, 0.5).fit(binning.apply(train), "late", binning.widths, 2)
    own = b.scored(binning.apply(rest), {"p": boost}, 3)
    loss = lambda d: -d.agg(F.avg(F.when(F.col("label") == 1, F.log("p")).otherwise(F.log(1 - F.col("p"))))).first()[0]
    assert loss(own) <= loss(theirs)


def test_bundle_is_the_same_when_loaded(spark, tmp_path):
    df = frame(spark, rows_of(6)).select("x", "z", F.col("name").alias("train_number"), (F.col("late") == 1).alias("target_delayed6"), F.col("delay").alias("target_delay_min"))
    bundle = pm.Bundle("v2", ["x", "z", "train_number"]).fit(df, rounds=2, boost_rounds=1)
    bundle.save(str(tmp_path))
    pm.Bundle("v10", ["x"]).fit(df, rounds=1, boost_rounds=1).save(str(tmp_path))
    assert pm.Bundle.load(spark, str(tmp_path)).version == "v10"
    loaded = pm.Bundle.load(spark, str(tmp_path), "v2")
    key = lambda d: sorted(map(str, d.collect()))
    assert loaded.features == bundle.features and key(loaded.score(df)) == key(bundle.score(df))
    assert set(loaded.score(df).columns) >= {*df.columns, "delay_probability", "p50", "p90"}


def test_order_of_keys():
    x = np.array([float("-inf"), -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1e300, float("inf")])
    k = ordered_keys(x)
    assert (np.diff(k) >= 0).all() and k[4] == k[5] and (from_keys(k) == x).all()


def test_grouped_quantiles_equal_numpy(spark):
    r = np.random.default_rng(4)
    values = {
        "ties": [2.0] * 50 + [3.0] * 50, "single": [7.25], "two": [-1.0, 4.0], "floats": r.normal(size=999).tolist(), "close": (1 + r.random(500) * 1e-13).tolist(), "signs": [-0.0, 0.0, -1e-300, 1e-300, -5.0],
        "wide": [-1e300, 1e300, 0.0, 2.0], None: [1.0, 2.0, 10.0],
    }
    df = spark.createDataFrame([(g, x) for g, xs in values.items() for x in xs] + [("ties", None), ("nothing", None), ("single", float("nan"))], "g string, v double").repartition(6)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {x.g: x.v for x in grouped_quantile(df, ["g"], "v", q).collect()}
        assert set(got) == set(values)
        for g, xs in values.items():
            assert got[g] == pytest.approx(float(np.quantile(xs, q)), rel=1e-12, abs=1e-300), (g, q)
    assert grouped_quantile(df.limit(0), ["g"], "v", 0.5).count() == 0
    assert [x.v for x in grouped_quantile(df.where("g = 'two'"), [], "v", 0.5).collect()] == [1.5]


def test_more_categories_than_sixteen_bits_tell_apart(spark):
    """Every name that has rows enough has its own bin, and a split finds the names that 16 bits would have cut off."""
    n = 70_000
    df = spark.range(n).select("id", F.format_string("%06d", "id").alias("name"), (F.col("id") >= 66_000).cast("int").alias("late"))
    binning = b.Binning.fit(df, [], ["name"], category_rows=1)
    assert binning.widths == [n + 1]
    got = binning.apply(df.where("id IN (0, 65535, 69999)").coalesce(1)).orderBy("name").toArrow().column("bins").combine_chunks()
    assert b.bins_of(got, 1)[:, 0].tolist() == [1, 65_536, n]
    boost = b.Boost("logistic", 1, 1, min_rows=20).fit(binning.apply(df), "late", binning.widths, 0)
    (split,) = boost.trees[0].splits
    assert split[4] == list(range(66_001, n + 1))


def test_root_split_of_more_names_than_sixteen_bits_tell_apart(spark, tmp_path):
    """The query beside its SQL: 66,000 train numbers with 20 or 21 stops each, all of them for training."""
    d, names = "/root/testdata/sf0.001", 66_000
    for x in os.listdir(d):
        if x != "events.parquet":
            os.symlink(f"{d}/{x}", tmp_path / x)
    rows = f"SELECT i AS event_id, TIMESTAMP '2024-01-02 00:00:00' + to_seconds(i % 1500000) AS ts, i % {names} AS user_id, 'view' AS event_type, (i * 7919 % 1009) / 10 AS value FROM range({21 * names}) r(i)"
    duckdb.sql(f"COPY ({rows}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    ok, what = compare(spark, str(tmp_path), QUERIES["root_split"], SQL["root_split"])
    assert ok, what


@pytest.mark.parametrize("run", [1, 70])
def test_wide_features_have_the_same_trees(spark, monkeypatch, run):
    """Features whose sums are made by runs of rows against those that are added up in place."""
    df = frame(spark, rows_of(9)).repartition(3)
    binning = b.Binning.fit(df, **HOME, category_rows=1)
    fit = lambda: b.Boost("logistic", 3, 3, min_rows=10).fit(binning.apply(df), "late", binning.widths, 2).state()
    one = fit()
    monkeypatch.setattr(b, "CELLS", 12)
    monkeypatch.setattr(b, "RUN", run)
    assert fit() == one


def test_bins_keep_only_what_is_asked_for(spark):
    df = frame(spark, rows_of(10))
    binning = b.Binning.fit(df, **HOME, category_rows=1)
    some = binning.apply(df, only=["late"])
    assert some.columns == ["late", "bins"] and sorted(map(str, some.collect())) == sorted(map(str, binning.apply(df).select("late", "bins").collect()))


@pytest.mark.parametrize("loss,target", [("logistic", "late"), (0.9, "delay")])
@pytest.mark.parametrize("leaves", [None, 6])
def test_rows_dealt_to_tasks_have_the_trees_of_one_task(spark, monkeypatch, loss, target, leaves):
    """In blocks of seven rows, with sums side by side and with those that occur, and written after each two trees."""
    df = frame(spark, rows_of(11)).repartition(3)
    binning = b.Binning.fit(df, **HOME, category_rows=1)
    fit = lambda: b.Boost(loss, 5, 4, 0.3, min_rows=10, leaves=leaves).fit(binning.apply(df), target, binning.widths, 2).state()
    one = fit()
    monkeypatch.setattr(b, "ALONE", 0)
    monkeypatch.setattr(b, "RUN", 7)
    monkeypatch.setattr(b, "WRITTEN", 2)
    for cells in (12, 1 << 14):
        monkeypatch.setattr(b, "CELLS", cells)
        assert json.dumps(fit()) == json.dumps(one)
    assert len(one["trees"]) == 5 and all(t["splits"] for t in one["trees"])


def test_leaves_are_split_best_first(spark):
    """Against splitting one leaf after the other, the best one each time; no depth limits it."""
    df = frame(spark, rows_of(12, 900))
    binning = b.Binning.fit(df, **HOME, category_rows=1)
    boost = b.Boost("logistic", 3, None, 0.3, min_rows=10, leaves=9).fit(binning.apply(df), "late", binning.widths, 2)
    local = binning.apply(df.coalesce(1)).select("bins", F.col("late").cast("double").alias("y")).toArrow()
    bins, y = b.bins_of(local.column("bins").combine_chunks(), 3), local.column("y").to_numpy()
    f, nodes = np.full(len(y), boost.base), set()
    for tree in boost.trees:
        g, h = boost.gradients(y, f)
        best = lambda rows: split_by_hand(bins[rows], g[rows], h[rows], 2, boost.l2, boost.min_rows)
        leaves = {1: (np.arange(len(y)), best(np.arange(len(y))))}
        splits = []
        while len(leaves) < 9 and any(x for _, x in leaves.values()):
            node = max((n for n, (_, x) in leaves.items() if x), key=lambda n: (leaves[n][1][0], -n))
            rows, x = leaves.pop(node)
            splits.append((node, x[1], int(x[2]), x[3], x[4]))
            for child, own in ((2 * node, rows[x[5]]), (2 * node + 1, rows[~x[5]])):
                leaves[child] = own, best(own)
        assert tree.splits == sorted(splits) and len(tree.splits) == 8
        nodes |= {s[0] for s in splits}
        for node, (rows, _) in leaves.items():
            assert tree.values[node] == pytest.approx(-0.3 * (int(g[rows].sum()) / b.UNIT) / (int(h[rows].sum()) / b.UNIT + 1.0), abs=1e-12)
        f = f + tree.score(bins)
    assert len(boost.trees) == 3 and max(nodes) > 8  # not level by level


def test_no_bins_and_slices():
    import pyarrow as pa

    rows = np.arange(12, dtype=np.uint32).reshape(4, 3)
    column = pa.array([x.tobytes() for x in rows], pa.binary())
    assert (b.bins_of(column, 3) == rows).all() and (b.bins_of(column.slice(1, 2), 3) == rows[1:3]).all()
    assert b.bins_of(column.slice(4), 3).shape == (0, 3)


def jobs(spark, name, run):
    """What run returns, with the number of Spark jobs that it started."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_of_a_championship(spark):
    """Few rows are fitted without a job a level, and the verdict is there when it's read, nothing is scored again."""
    df = frame(spark, rows_of(13)).select("x", "z", F.col("name").alias("train_number"), (F.col("late") == 1).alias("target_delayed6"), F.col("delay").alias("target_delay_min"), F.when(F.col("x") % 3 == 0, "eval").otherwise("train").alias("fold_month"))
    binning = pm.fit_binning(df, ["x", "z"])
    binned = binning.apply(df)
    boost, n = jobs(spark, "fit", lambda: pm.fit_classifier(binned, binning, 10, depth=3, min_rows=20))
    assert len(boost.trees) == 10 and n < 10
    champion = pm.Bundle("v1", ["x"]).fit(df.where("fold_month = 'train'"), 1, 1)
    verdict, _ = pm.championship(champion, df, ["train"], "eval", ["train", "eval"], ["x", "z", "train_number"], 1, 1)
    rows, n = jobs(spark, "verdict", verdict.collect)
    assert len(rows) == 1 and n == 1


def test_clf_scores_come_from_the_whole_classifier(spark, monkeypatch):
    """300 trees of 127 leaves at most, none with fewer than 100 rows."""
    from stopdelay.queries import models as q

    n, fitted, fit = 3000, [], b.Boost.fit

    def record(self, *args):
        fitted.append(fit(self, *args))
        return self

    columns = [F.when(F.col("id") % 3 == 0, "eval").otherwise("train").alias("fold_month"), (F.hash("id") % 3 == 0).alias("target_delayed6")]
    df = spark.range(n).select(F.col("id").cast("string").alias("id"), F.sin("id").alias("x"), (F.col("id") % 12).cast("string").alias("station_name"), *columns)
    monkeypatch.setattr(q, "FEATURES", ["x", "station_name"])
    monkeypatch.setattr(q, "frame", lambda spark, d: df)
    monkeypatch.setattr(b.Boost, "fit", record)
    assert q.clf_scores(spark, "").count() == n // 3
    (boost,) = fitted
    assert (boost.rounds, boost.leaves, boost.min_rows, boost.depth) == (300, 127, 100, None) and len(boost.trees) == 300
    local = q.pm.fit_binning(df.where("fold_month = 'train'"), q.FEATURES).apply(df.where("fold_month = 'train'")).toArrow().column("bins").combine_chunks()
    cols = list(np.ascontiguousarray(b.bins_of(local, 2).T))
    leaves = [[len(x) for x in b.routed(cols, len(cols[0]), t.packed()).values()] for t in boost.trees]
    assert all(min(x) >= 100 and sum(x) == 2 * n // 3 for x in leaves) and max(len(x) for x in leaves) > 8
