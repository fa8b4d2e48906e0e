"""Baselines, folds, promotion and the lookup of statistics at serving time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written
from .history import GRANULARITIES, stat_columns

LEVELS = {"group": ["station_name", "train_type"], "fallback": ["train_type"], "global": []}


def fit_baseline(df: DataFrame) -> DataFrame:
    """Late rate and nearest-rank p50 and p90 by station and type, by type, and over all: one table, a row per level and
    group. The levels are sums over one written histogram of delays, so all come from one pass over the rows."""
    h = written(df.groupBy("station_name", "train_type", "target_delay_min", "target_delayed6").agg(F.count(F.lit(1)).alias("_c")), "delays")
    keys = ["station_name", "train_type"]
    level = F.when(F.col("_g") == 0, "group").when(F.col("_g") == 2, "fallback").otherwise("global")
    rates = h.groupingSets([keys, ["train_type"], []], *keys).agg(F.grouping_id().alias("_g"), (F.sum(F.col("target_delayed6").cast("double") * F.col("_c")) / F.sum(F.when(F.col("target_delayed6").isNotNull(), F.col("_c")))).alias("rate"))
    rates = rates.select(level.alias("level"), *keys, "rate")
    sets = [h.where(F.col("target_delay_min").isNotNull()).groupBy(*by, "target_delay_min").agg(F.sum("_c").alias("_c")).select(F.lit(k).alias("level"), *[F.col(c) if c in by else F.lit(None).cast("string").alias(c) for c in keys], "target_delay_min", "_c") for k, by in LEVELS.items()]
    both = sets[0].union(sets[1]).union(sets[2])
    q = _weighted_quantiles(both, "target_delay_min", (0.5, 0.9), ["level", *keys])
    on = (rates["level"] == q["level"]) & rates["station_name"].eqNullSafe(q["station_name"]) & rates["train_type"].eqNullSafe(q["train_type"])
    return rates.join(q, on, "left").select(rates["level"], rates["station_name"], rates["train_type"], "rate", F.col("q50").alias("p50"), F.col("q90").alias("p90"))


def _weighted_quantiles(h: DataFrame, value: str, qs, by) -> DataFrame:
    w = W.partitionBy(*by)
    h = h.withColumns({"_upto": F.sum("_c").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)), "_n": F.sum("_c").over(w)})
    return h.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") > F.round((F.col("_n") - 1) * q), F.col(value))).alias(f"q{round(100 * q)}") for q in qs])


def predict_baseline(tables: DataFrame, df: DataFrame) -> DataFrame:
    """df with baseline_prob, baseline_p50 and baseline_p90: the finest level that knows each. The tables are written once
    for the three levels and whatever reads the result."""
    names = ("rate", "p50", "p90")
    out, tables = df, written(tables, "baseline")
    for level, keys in LEVELS.items():
        t = tables.where(F.col("level") == level).select(*keys, *[F.col(c).alias(f"_{level}_{c}") for c in names])
        out = out.join(t, keys, "left") if keys else out.join(F.broadcast(t), F.lit(True), "left")  # the global level is one row
    for name, c in zip(("prob", "p50", "p90"), names):
        out = out.withColumn(f"baseline_{name}", F.coalesce(*[F.col(f"_{level}_{c}") for level in LEVELS]))
    return out.drop(*[f"_{level}_{c}" for level in LEVELS for c in names])


def walk_forward_folds(spark: SparkSession, val_months: list[str], window: int = 12) -> DataFrame:
    """(val_month, train_month): the `window` months before each validation month."""
    v = spark.createDataFrame([(m,) for m in val_months], "val_month string").withColumn("_d", F.to_date(F.concat("val_month", F.lit("-01"))))
    months = F.sequence(F.add_months("_d", -window), F.add_months("_d", -1), F.expr("interval 1 month"))
    return v.select("val_month", F.explode(F.transform(months, lambda m: F.date_format(m, "yyyy-MM"))).alias("train_month"))


#: What a challenger may lose.
PR_AUC_LOSS, PINBALL_RATIO, ECE_GAIN = 0.002, 1.02, 0.01


def promotion_verdict(metrics: DataFrame) -> DataFrame:
    """metrics(metric, champion, challenger), a row per metric of either: one row with the verdict and its reasons."""
    of = lambda m, who: F.max(F.when(F.col("metric") == m, F.col(who)))
    old, new = (lambda m: of(m, "champion")), (lambda m: of(m, "challenger"))
    rules = [
        F.when(new("pr_auc") < old("pr_auc") - PR_AUC_LOSS, F.lit("pr_auc")),
        F.when(new("pinball_p90") > old("pinball_p90") * PINBALL_RATIO, F.lit("pinball_p90")),
        F.when(new("ece") > old("ece") + ECE_GAIN, F.lit("ece")),
    ]
    return metrics.agg(F.concat_ws("; ", *rules).alias("failures")).withColumn("promote", F.col("failures") == "")


def compare_metrics(champion: DataFrame, challenger: DataFrame) -> DataFrame:
    a, b = (x.select("metric", F.col("value").alias(who)) for x, who in ((champion, "champion"), (challenger, "challenger")))
    return a.join(b, "metric", "full_outer")


def snapshot(df: DataFrame, latest) -> DataFrame:
    """Latest statistics of all granularities as one table (granularity, key1, key2, join_date, m14, r14, m30, r30, n30)."""
    out = None
    for prefix, keys in GRANULARITIES.items():
        s = latest(df, keys, prefix)
        cols = [F.lit(prefix).alias("granularity"), F.col(keys[0]).alias("key1"), (F.col(keys[1]) if len(keys) > 1 else F.lit(None).cast("string")).alias("key2"), "join_date"]
        part = s.select(*cols, *[F.col(c).alias(a) for c, a in zip(stat_columns(prefix), ("m14", "r14", "m30", "r30", "n30"))])
        out = part if out is None else out.union(part)
    return out


def snapshot_lookup(df: DataFrame, snap: DataFrame, overlay: DataFrame | None = None, max_age: int = 30, versions: tuple[str, ...] = ()) -> DataFrame:
    """df(event_date, keys) with the statistics that are fresh enough, the overlay's before the snapshot's, and coverage:
    the finest granularity that answered, else cold. Unlike the live service, a join_date after the day isn't used.

    versions: columns of df that name, for each table, the published_at of the version that counts; without them a table
    is one version."""
    out = df
    answers = []
    for prefix, keys in GRANULARITIES.items():
        found = []
        for i, table in enumerate(x for x in (overlay, snap) if x is not None):
            t = table.where(F.col("granularity") == prefix).select(F.col("key1").alias("_1"), F.col("key2").alias("_2"), F.struct("join_date", "m14", "r14", "m30", "r30", "n30").alias(f"_{prefix}{i}"), *([F.col("published_at").alias("_v")] if versions else []))
            on: Column = F.col(keys[0]) == F.col("_1")
            if len(keys) > 1:
                on = on & (F.col(keys[1]) == F.col("_2"))
            if versions:
                on = on & (F.col(versions[i]) == F.col("_v"))
            out = out.join(t, on, "left").drop("_1", "_2", "_v")
            entry = F.col(f"_{prefix}{i}")
            age = F.date_diff("event_date", entry["join_date"])
            found.append(F.when((age <= max_age) & (age >= 0), entry))
        out = out.withColumn(f"_{prefix}", F.coalesce(*found)).drop(*[f"_{prefix}{i}" for i in range(len(found))])
        answers.append(F.when(F.col(f"_{prefix}").isNotNull(), F.lit(prefix)))
        out = out.withColumns({c: F.col(f"_{prefix}")[a] for c, a in zip(stat_columns(prefix), ("m14", "r14", "m30", "r30", "n30"))})
    return out.withColumn("coverage", F.coalesce(*answers, F.lit("cold"))).drop(*[f"_{p}" for p in GRANULARITIES])


def freshness(snap: DataFrame, overlay: DataFrame, today: Column) -> DataFrame:
    """One row: the snapshot's age in days, and the age of the fresher of snapshot and overlay."""
    a = snap.agg(F.date_diff(today, F.max("join_date")).alias("stats_age_days"))
    b = overlay.agg(F.greatest(F.lit(0), F.date_diff(today, F.max("join_date"))).alias("_o"))
    return a.join(b).select("stats_age_days", F.least("stats_age_days", F.coalesce("_o", "stats_age_days")).alias("feature_freshness_days"))


def score_postprocess(df: DataFrame, mode: str = "serve") -> DataFrame:
    """serve: quantiles from 0, p90 not under p50. championship: p90 not under p50. cv: as they are."""
    p50, p90 = F.col("p50"), F.col("p90")
    if mode == "serve":
        p50, p90 = F.greatest(p50, F.lit(0.0)), F.greatest(p90, F.lit(0.0))
    if mode in ("serve", "championship"):
        p90 = F.greatest(p90, p50)
    return df.withColumns({"p50": p50, "p90": p90})


