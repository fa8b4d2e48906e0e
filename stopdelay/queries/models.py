"""Queries of folds, baselines and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions.times import holidays
from ..operators import baseline as b
from ..operators.quantiles import grouped_quantile
from ..plans import models as pm
from ..plans.features import FEATURES, build_feature_frame
from ..sources import adapters as a
from ..sources import tables as t
from .cleaning import nearest
from .history import rounded
from .live import auc_sql, ece_sql, fixed, fixed_sql, mean_sql, pinball_sql
from .registry import query

VAL = ["2000-01", "2000-02", "2000-03"]
FOLDS = "folds AS (SELECT v.val_month, strftime(CAST(v.val_month || '-01' AS DATE) - to_months(CAST(k AS INTEGER)), '%Y-%m') AS train_month FROM (VALUES ('2000-01'), ('2000-02'), ('2000-03')) AS v(val_month), range(1, 13) AS r(k))"


@query("folds", f"""WITH {a.TRAINING}, {FOLDS}, months AS (SELECT fold_month AS train_month, count(*) AS n FROM training GROUP BY 1)
  SELECT val_month, train_month, coalesce(n, 0) AS n FROM folds LEFT JOIN months USING (train_month)""")
def folds(spark, d):
    """Each fold's months with the rows that the table has of them."""
    months = a.training_rows(spark, d).groupBy(F.col("fold_month").alias("train_month")).agg(F.count(F.lit(1)).alias("n"))
    return b.walk_forward_folds(spark, VAL).join(months, "train_month", "left").select("val_month", "train_month", F.coalesce("n", F.lit(0)).alias("n"))


@query("fold_sizes", f"WITH {a.TRAINING}, {FOLDS} SELECT val_month, count(*) AS n FROM folds JOIN training ON fold_month = train_month GROUP BY 1")
def fold_sizes(spark, d):
    f = b.walk_forward_folds(spark, VAL).withColumnRenamed("train_month", "fold_month")
    return a.training_rows(spark, d).join(F.broadcast(f), "fold_month").groupBy("val_month").agg(F.count(F.lit(1)).alias("n"))  # 12 rows a fold


@query("load_split", f"WITH {a.TRAINING} SELECT station_name, train_type, target_delayed6, target_delay_min FROM training WHERE fold_month IN ('2000-01', '2000-02')")
def load_split(spark, d):
    path = t.write_features(a.training_rows(spark, d), t.shared_path(spark, "features"))
    return t.load_split(spark.read.parquet(path), ["2000-01", "2000-02"], ["station_name", "train_type", "target_delayed6", "target_delay_min"])


@query("latest_version", "SELECT max(strftime(o_orderdate, '%Y-%m')) AS version FROM orders")
def latest_version(spark, d):
    return t.latest_version(spark.read.parquet(f"{d}/orders.parquet").select(F.date_format("o_orderdate", "yyyy-MM").alias("version")))


def fit_sql(src):
    cols = f"avg(target_delayed6::INT) AS rate, {nearest(0.5, 'target_delay_min')} AS p50, {nearest(0.9, 'target_delay_min')} AS p90"
    return f"""fitted AS (SELECT 'group' AS level, station_name, train_type, {cols} FROM {src} GROUP BY ALL UNION ALL
  SELECT 'fallback', NULL, train_type, {cols} FROM {src} GROUP BY ALL UNION ALL SELECT 'global', NULL, NULL, {cols} FROM {src})"""


@query("baseline_fit", f"WITH {a.TRAINING}, {fit_sql('training')} SELECT level, station_name, train_type, round(rate, 6) AS rate, p50, p90 FROM fitted")
def baseline_fit(spark, d):
    return rounded(b.fit_baseline(a.training_rows(spark, d)))


PREDICTED = """predicted AS (
  SELECT v.*, coalesce(g.rate, f.rate, x.rate) AS baseline_prob, coalesce(g.p50, f.p50, x.p50) AS baseline_p50, coalesce(g.p90, f.p90, x.p90) AS baseline_p90
  FROM val v LEFT JOIN fitted g ON g.level = 'group' AND g.station_name = v.station_name AND g.train_type = v.train_type LEFT JOIN fitted f ON f.level = 'fallback' AND f.train_type = v.train_type, (SELECT * FROM fitted WHERE level = 'global') x
)"""
SPLIT = f"{a.TRAINING}, train AS (SELECT * FROM training WHERE fold_month < '1999-01' AND station_name NOT IN ('S5', 'S6')), val AS (SELECT * FROM training WHERE fold_month = '2000-01'), {fit_sql('train')}, {PREDICTED}"


def predicted(spark, d):
    rows = a.training_rows(spark, d)
    tables = b.fit_baseline(rows.where((F.col("fold_month") < "1999-01") & ~F.col("station_name").isin("S5", "S6")))
    return b.predict_baseline(tables, rows.where("fold_month = '2000-01'"))


@query("baseline_predict", f"WITH {SPLIT} SELECT station_name, train_type, target_delay_min, round(baseline_prob, 6) AS baseline_prob, baseline_p50, baseline_p90 FROM predicted")
def baseline_predict(spark, d):
    return rounded(predicted(spark, d).select("station_name", "train_type", "target_delay_min", "baseline_prob", "baseline_p50", "baseline_p90"))


CV = {"pinball_p50": pinball_sql("target_delay_min", "baseline_p50", 0.5), "pinball_p90": pinball_sql("target_delay_min", "baseline_p90", 0.9), "mae_p50": mean_sql("abs(target_delay_min - baseline_p50)"), "coverage_p90": "avg((target_delay_min <= baseline_p90)::INT)"}


def fold_sql(month):
    src = f"""WITH {a.TRAINING}, {FOLDS}, train AS (SELECT t.* FROM training t JOIN folds ON fold_month = train_month AND val_month = '{month}'), val AS (SELECT * FROM training WHERE fold_month = '{month}'), {fit_sql('train')}, {PREDICTED},
  p AS (SELECT *, target_delayed6::INT::DOUBLE AS y FROM predicted), {auc_sql('p', '', prob='baseline_prob')}, {ece_sql('p', '', prob='baseline_prob')}"""
    return f"""(SELECT '{month}' AS val_month, * FROM ({src} SELECT roc_auc AS baseline_roc_auc, pr_auc AS baseline_pr_auc, ece AS baseline_ece, q.* FROM ranked, eces_ece,
  (SELECT {mean_sql('(baseline_prob - y) * (baseline_prob - y)')} AS baseline_brier, {mean_sql('y')} AS baseline_base_rate, {", ".join(f"{v} AS baseline_{c}" for c, v in CV.items())} FROM p) q))"""


CV_COLUMNS = [f"baseline_{c}" for c in ("roc_auc", "pr_auc", "brier", "base_rate", "ece", *CV)]


@query("cv_baseline_metrics", f"WITH f AS ({' UNION ALL '.join('SELECT * FROM ' + fold_sql(x) for x in VAL)}) SELECT coalesce(val_month, 'mean') AS val_month, {', '.join(f'{fixed_sql(mean_sql(c), 5)} AS {c}' for c in CV_COLUMNS)} FROM f GROUP BY GROUPING SETS ((val_month), ())")
def cv_baseline_metrics(spark, d):
    """Baseline metrics of each fold and their mean; folds are a list of months, a few jobs each. The folds' months are
    written once, by month, and a fold's predictions once for all metrics."""
    months: dict[str, list[str]] = {}
    out = None
    for r in b.walk_forward_folds(spark, VAL).collect():
        months.setdefault(r["val_month"], []).append(r["train_month"])
    needed = a.training_rows(spark, d).where(F.col("fold_month").isin(sorted({*months, *sum(months.values(), [])})))
    rows = spark.read.schema(needed.schema).parquet(t.write_features(needed, t.shared_path(spark, "months")))
    for val, train in months.items():
        p = b.predict_baseline(b.fit_baseline(rows.where(F.col("fold_month").isin(train))), rows.where(F.col("fold_month") == val)).withColumn("y", F.col("target_delayed6").cast("double"))
        p = t.written(p.select("y", "target_delay_min", "baseline_prob", "baseline_p50", "baseline_p90"), "predicted")
        y = F.col("target_delay_min").cast("double")
        one = m.classification_metrics(p, "y", "baseline_prob").join(p.agg(*[c.alias(k) for k, c in m.quantile_metrics(y, F.col("baseline_p50"), F.col("baseline_p90")).items()]))
        one = one.select(F.lit(val).alias("val_month"), *[F.col(c.removeprefix("baseline_")).alias(c) for c in CV_COLUMNS])
        out = one if out is None else out.union(one)
    out = t.written(out, "folds")
    each = [m.mean(F.col(c)).alias(c) for c in CV_COLUMNS]
    return fixed(out.groupBy("val_month").agg(*each).union(out.agg(*each).select(F.lit("mean").alias("val_month"), *CV_COLUMNS)), 5)


@query("promotion", f"""WITH {SPLIT}, p AS (SELECT *, target_delayed6::INT::DOUBLE AS y, least(1.0, baseline_prob * 1.5::DOUBLE) AS worse FROM predicted), {auc_sql('p', '', prob='baseline_prob')}, {ece_sql('p', '', prob='baseline_prob')}, {auc_sql('p', '', prob='worse', name='_worse')}, {ece_sql('p', '', prob='worse', name='worse_ece')},
  l AS (SELECT {CV['pinball_p90']} AS a, {CV['pinball_p90'].replace('baseline_p90', '(baseline_p90 + 9)')} AS b FROM p), v AS (
  SELECT concat_ws('; ', CASE WHEN w.pr_auc < r.pr_auc - 0.002::DOUBLE THEN 'pr_auc' END, CASE WHEN b > a * 1.02 THEN 'pinball_p90' END, CASE WHEN worse_ece > ece + 0.01 THEN 'ece' END) AS failures FROM l, eces_ece, eces_worse_ece, ranked r, ranked_worse w)
  SELECT failures, failures = '' AS promote FROM v""")
def promotion(spark, d):
    """The baseline against one that overstates."""
    p = predicted(spark, d).withColumn("y", F.col("target_delayed6").cast("double")).withColumn("worse", F.least(F.lit(1.0), F.col("baseline_prob") * 1.5))
    p = t.written(p.select("y", "target_delay_min", "baseline_prob", "baseline_p90", "worse"), "predicted")  # read once a metric

    def of(prob, p90):
        w = m.classification_metrics(p, "y", prob).join(p.agg(m.pinball(F.col("target_delay_min").cast("double"), p90, 0.9).alias("pinball_p90")))
        return w.unpivot([], w.columns, "metric", "value")

    return b.promotion_verdict(b.compare_metrics(of("baseline_prob", F.col("baseline_p90")), of("worse", F.col("baseline_p90") + 9)))


def frame(spark, d):
    """The feature frame, written, with the first 20 days for training."""
    path = t.shared_path(spark, "frame")
    build_feature_frame(a.stops_events(spark, d), holidays(spark, a.HORIZON_YEAR)).withColumn("fold_month", F.when(F.col("scheduled_time") < a.now(), "train").otherwise("eval")).write.parquet(path)
    return spark.read.parquet(path)


#: Whole numbers of the schedule; their bins are few.
HOURS = ["train_line_station_num", "scheduled_hour", "weekday"]
CATEGORIES = "FROM (SELECT {c} AS name, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 HAVING n >= 20)"
#: The training rows of the frame's schedule, with the bins of HOURS and the places of the categories, as the binning has them.
BINNED = a.PLANNED + f""", rows AS (
  SELECT id, station_name, train_type, train_number, train_line_station_num, hour(scheduled_time) AS scheduled_hour, isodow(scheduled_time) - 1 AS weekday, delay_in_min, delay_in_min >= 6 AS late,
    scheduled_time < TIMESTAMP '{a.NOW}' AS training FROM planned
), known AS (SELECT * FROM rows WHERE training), edges AS (
  SELECT {", ".join(f"list_sort(list_distinct(quantile_disc({c}, list_transform(range(1, 255), lambda i: i / 255.0::DOUBLE)))) AS {c}" for c in HOURS)} FROM known
), {", ".join(f"{c}_names AS (SELECT name, row_number() OVER (ORDER BY n DESC, name) AS place {CATEGORIES.format(c=c, t='known')})" for c in pm.CATEGORICAL)}, binned AS (
  SELECT rows.*, {", ".join(f"len(list_filter(edges.{c}, lambda e: e < rows.{c})) + 1 AS {c}_bin" for c in HOURS)}, {", ".join(f"coalesce({c}_names.place, 0) AS {c}_bin" for c in pm.CATEGORICAL)}
  FROM rows {" ".join(f"LEFT JOIN {c}_names ON {c}_names.name = rows.{c}" for c in pm.CATEGORICAL)}, edges
)"""
BIN_COLUMNS = [f"{c}_bin" for c in (*HOURS, *pm.CATEGORICAL)]


def binned_schedule(spark, d):
    """The frame with the bins of the schedule, fitted on its training rows."""
    df = frame(spark, d)
    binning = pm.fit_binning(df.where("fold_month = 'train'"), [*HOURS, *pm.CATEGORICAL])
    return binning.apply(df, only=["id", "fold_month", "target_delayed6"]), binning


@query("encoded_features", f"WITH {BINNED} SELECT id, {', '.join(BIN_COLUMNS)} FROM binned")
def encoded_features(spark, d):
    """Bins of all rows; names that training has fewer than 20 times, or never, are 0."""
    df, _ = binned_schedule(spark, d)
    digits = lambda i: F.hex(F.substring("bins", 4 * i + 1, 4))  # noqa: E731  four bytes, the low one first
    place = lambda i: F.conv(F.concat(*[F.substring(digits(i), at, 2) for at in (7, 5, 3, 1)]), 16, 10).cast("long")
    return df.select("id", *[place(i).alias(c) for i, c in enumerate(BIN_COLUMNS)])


FEATURE_ROWS = " UNION ALL ".join(f"SELECT {i} AS feature, {c} AS bin, g, h FROM r" for i, c in enumerate(BIN_COLUMNS))
SIDE = "CASE WHEN {h} + 1 > 0 THEN {g} * {g} / ({h} + 1) ELSE 0 END"


@query("root_split", f"""WITH {BINNED}, base AS (SELECT 1 / (1 + exp(-ln((sum(late::INT) + 0.5) / (count(*) - sum(late::INT) + 0.5)))) AS p FROM binned WHERE training),
  r AS (SELECT *, round_even((p - late::INT) * 67108864, 0)::BIGINT AS g, round_even(p * (1 - p) * 67108864, 0)::BIGINT AS h FROM binned, base WHERE training), f AS ({FEATURE_ROWS}),
  s AS (SELECT feature, bin, sum(g) / 67108864.0::DOUBLE AS g, sum(h) / 67108864.0::DOUBLE AS h, count(*) AS n FROM f GROUP BY ALL),
  c AS (SELECT feature, bin, sum(g) OVER w AS g, sum(h) OVER w AS h, sum(n) OVER w AS n, sum(g) OVER k AS all_g, sum(h) OVER k AS all_h, sum(n) OVER k AS all_n FROM s
    WINDOW k AS (PARTITION BY feature), w AS (PARTITION BY feature ORDER BY CASE WHEN feature < 3 THEN bin ELSE g / (h + 1) END, bin)),
  b AS (SELECT feature, {SIDE.format(g="g", h="h")} + {SIDE.format(g="(all_g - g)", h="(all_h - h)")} - {SIDE.format(g="all_g", h="all_h")} AS gain, n FROM c WHERE n >= 20 AND all_n - n >= 20)
  SELECT feature, round(max(gain), 6) AS gain, arg_max(n, round(gain, 9)) AS n_left FROM b WHERE gain > 0 GROUP BY ALL""")
def root_split(spark, d):
    """Of each feature alone, the best first split of the classifier: its gain and the rows that go left."""
    df, binning = binned_schedule(spark, d)
    out = None
    boost = pm.Boost("logistic", depth=1)
    train = df.where("fold_month = 'train'").select("bins", F.col("target_delayed6").cast("double").alias("y"))
    n, late = train.agg(F.count(F.lit(1)), F.sum("y")).first()
    sums = t.written(boost.level(train.withColumn("f", F.lit(pm.log_odds(n, late))), binning.widths), "sums")
    for i in range(len(binning.widths)):
        one = pm.best_splits(sums.where(F.col("feature") == i), len(HOURS), boost.l2, boost.min_rows).select("feature", F.round("gain", 6).alias("gain"), F.col("left_n").alias("n_left"))
        out = one if out is None else out.union(one)
    return out


@query("group_quantiles", f"""WITH {a.PLANNED} SELECT station_name, train_type, round(quantile_cont(delay_in_min - (id::BIGINT % 7) / 8.0::DOUBLE, 0.9), 6) AS v FROM planned GROUP BY ALL""")
def group_quantiles(spark, d):
    """Interpolated quantiles of all stations and types at once."""
    rows = a.stops_events(spark, d).where(~F.col("is_canceled")).withColumn("x", F.col("delay_in_min") - (F.col("id").cast("long") % 7) / F.lit(8.0))
    return grouped_quantile(rows, ["station_name", "train_type"], "x", 0.9).withColumn("v", F.round("v", 6))


@query("clf_scores")
def clf_scores(spark, d):
    df = frame(spark, d)
    train = df.where("fold_month = 'train'")
    binning = pm.fit_binning(train, FEATURES)
    model = pm.fit_classifier(binning.apply(train, only=["target_delayed6"]), binning)
    rows = pm.scored(binning.apply(df.where("fold_month = 'eval'"), only=["id", "target_delayed6"]), {"delay_probability": model}, len(binning.widths))
    return rows.select("id", "delay_probability", F.col("target_delayed6").cast("int").alias("late"))


@query("quantile_scores")
def quantile_scores(spark, d):
    df = frame(spark, d)
    train = df.where("fold_month = 'train'")
    binning = pm.fit_binning(train, FEATURES)
    boost = pm.fit_quantile(binning.apply(train, only=["target_delay_min"]), binning, 0.9, rounds=3)
    return pm.scored(binning.apply(df.where("fold_month = 'eval'"), only=["id", "target_delay_min"]), {"p90": boost}, len(binning.widths)).select("id", "p90", "target_delay_min")


@query("championship")
def championship(spark, d):
    """The schedule alone against all features, both with the same rounds."""
    df = frame(spark, d)
    names = ["station_name", "train_type", "scheduled_hour", "weekday"]
    champion = pm.Bundle("v1", names).fit(df.where("fold_month = 'train'"), 4, 2)
    verdict, refitted = pm.championship(champion, df, ["train"], "eval", ["train", "eval"], FEATURES, 4, 2)
    return verdict.withColumn("refitted", F.lit(refitted is not None))


#: What the small registered bundles are trained on.
BUNDLE_FEATURES = ["station_name", "train_type", "scheduled_hour", "weekday", "train_mean_delay_14d", "station_live_mean_delay_60m"]


@query("saved_bundle")
def saved_bundle(spark, d):
    """Scores of a bundle before it is saved and after it is loaded, for every stop of the last days."""
    df = frame(spark, d)
    path = t.shared_path(spark, "bundles")
    bundle = pm.Bundle("v1", BUNDLE_FEATURES).fit(df.where("fold_month = 'train'"), rounds=2, boost_rounds=2)
    bundle.save(path)
    rows = df.where("fold_month = 'eval'").select("id", *BUNDLE_FEATURES)
    old, new = (x.score(rows).select("id", *[F.col(c).alias(f"{c}{end}") for c in ("delay_probability", "p50", "p90")]) for x, end in ((bundle, ""), (pm.Bundle.load(spark, path), "_loaded")))
    return old.join(new, "id")


@query("train_cv")
def train_cv(spark, d):
    """A fold of the frame: the models' metrics beside the baseline's."""
    return pm.train_cv(frame(spark, d), {"eval": ["train"]}, BUNDLE_FEATURES, rounds=5, boost_rounds=3)
