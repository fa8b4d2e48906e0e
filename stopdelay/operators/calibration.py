"""Recalibration of sealed outputs that has to beat doing nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import coverage, expected_calibration_error
from ..functions.times import minutes
from ..sources.tables import version_order, write_calibration, written
from .logs import ground_truth, outcome

#: How much evidence, how old, and the target.
LOOKBACK_DAYS, MIN_PAIRS, TARGET, SETTLED_HOURS = 7, 2000, 0.90, 3


def current_model(df: DataFrame) -> DataFrame:
    """Rows of the newest model_version: the greatest number in it, then the greatest text, so that v10 follows v9."""
    newest = df.agg(F.max_by("model_version", version_order("model_version")).alias("_newest"))  # one row
    return df.join(F.broadcast(newest), F.col("model_version") == F.col("_newest")).drop("_newest")


def collect_pairs(predictions: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Raw outputs beside outcomes: predictions of the last days before today, settled, not canceled, newest model."""
    today = F.to_date(now)
    p = predictions.where(F.col("day").between(F.date_sub(today, LOOKBACK_DAYS), F.date_sub(today, 1)))
    c = changes.where(F.col("day").between(F.date_sub(today, LOOKBACK_DAYS), today))
    for col in ("raw_delay_probability", "raw_delay_p90_min"):
        if col not in p.columns:
            p = p.withColumn(col, F.lit(None).cast("double"))
    t = ground_truth(p, c).where(~F.col("is_canceled") & (F.col("scheduled_time") < now - minutes(F.lit(60 * SETTLED_HOURS))))
    return current_model(
        t.select("model_version", "scheduled_time", F.coalesce("raw_delay_probability", "delay_probability").alias("model_probability"), F.coalesce("raw_delay_p90_min", F.col("delay_p90_min").cast("double")).alias("model_p90_min"), "actual_delay_min")
    )


def linear_quantile(df: DataFrame, value: Column, q: float) -> DataFrame:
    """One row, v: the linearly interpolated quantile. Values are counted by whole part, then only those two parts that
    hold the neighbouring ranks are looked into; no task holds all values."""
    h = df.select(value.cast("double").alias("x")).where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.floor("x"))
    up = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = h.groupBy("part").agg(F.sum("n").alias("m"))  # a row a minute
    total = parts.agg(F.sum("m").alias("all"))
    rank = (F.col("all") - 1) * F.lit(q)
    parts = parts.withColumn("before", F.coalesce(F.sum("m").over(up), F.lit(0))).join(F.broadcast(total)).withColumns({"low": F.floor(rank), "high": F.ceil(rank), "share": rank - F.floor(rank)})
    held = lambda r: (F.col(r) >= F.col("before")) & (F.col(r) < F.col("before") + F.col("m"))
    inside = h.join(F.broadcast(parts.where(held("low") | held("high"))), "part")  # two rows at most
    upto = F.col("before") + F.sum("n").over(W.partitionBy("part").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    at = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("x")))
    both = inside.withColumn("upto", upto).agg(at("low").alias("a"), at("high").alias("b"), F.max("share").alias("share"))
    return both.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("v"))


def conformal_offset(pairs: DataFrame, target: float = TARGET) -> DataFrame:
    """One row: the linear quantile of what outcomes exceed p90 by; negative if p90 covers too much."""
    return linear_quantile(pairs, F.col("actual_delay_min") - F.col("model_p90_min"), target).select(F.round("v", 2).alias("p90_delta_min"))


BLOCK = "lo double, hi double, w long, s long"


def pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks by ascending range, each with its rows w and late ones s, to blocks of strictly rising s / w: a block that
    isn't above the one before is pooled with it. Whole numbers are compared, so blocks don't depend on the order of merges."""
    stack: list[list] = []
    for f in frames:
        for lo, hi, w, s in zip(f["lo"].tolist(), f["hi"].tolist(), f["w"].tolist(), f["s"].tolist()):
            while stack and stack[-1][3] * w >= s * stack[-1][2]:
                left = stack.pop()
                lo, w, s = left[0], w + left[2], s + left[3]
            stack.append([lo, hi, w, s])
    yield pd.DataFrame(stack, columns=["lo", "hi", "w", "s"])


def isotonic_blocks(pairs: DataFrame) -> DataFrame:
    """(lo, hi, w, s): the pools of the isotonic fit of outcomes on exact probabilities.

    Probabilities are summed by value, dealt out by range and pooled there; what is left of the ranges is pooled once
    more. N rows make at most some N^(2/3) blocks of strictly rising shares, as those are different fractions whose
    denominators sum to N, so the last step holds few rows whatever comes in. Null and NaN probabilities take no part.
    """
    p = F.col("model_probability").cast("double")
    one = pairs.where(p.isNotNull() & ~F.isnan(p)).groupBy((p + 0.0).alias("lo")).agg(F.count(F.lit(1)).alias("w"), F.sum(outcome().cast("long")).alias("s"))
    one = one.select("lo", F.col("lo").alias("hi"), "w", "s")
    ranges = one.repartitionByRange("lo").sortWithinPartitions("lo").mapInPandas(pooled, BLOCK)
    return ranges.repartition(1).sortWithinPartitions("lo").mapInPandas(pooled, BLOCK)


def isotonic_curve(pairs: DataFrame) -> tuple[list[float], list[float]]:
    """Knots of the isotonic fit: both ends of each pool, at its share of late stops; to 6 digits."""
    knots = [(x, r["s"] / r["w"]) for r in isotonic_blocks(pairs).orderBy("lo").collect() for x in sorted({r["lo"], r["hi"]})]
    return [round(x, 6) for x, _ in knots], [round(y, 6) for _, y in knots]


def along(p: Column, knots: Column) -> Column:
    """The piecewise linear curve through the knots, an array of (x, y) by ascending x, level beyond them."""
    low = F.filter(knots, lambda k: k["x"] <= p)
    a, b = F.try_element_at(low, F.lit(-1)), F.try_element_at(knots, F.size(low) + 1)
    return F.when(p.isNull(), None).when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (p - a["x"]) / (b["x"] - a["x"]))


def interpolate(p: Column, xs: list[float], ys: list[float]) -> Column:
    return along(p, F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in zip(xs, ys)]))


def apply_calibration(df: DataFrame, xs: list[float] | None, ys: list[float] | None, delta: float = 0.0, model_version: str | None = None) -> DataFrame:
    """delay_probability through the curve, p90 moved but not under p50. No curve, or another model's rows: unchanged."""
    if not xs:
        return df
    own = F.lit(True) if model_version is None else F.col("model_version") == model_version
    return df.withColumns({
        "delay_probability": F.when(own, interpolate(F.col("delay_probability"), xs, ys)).otherwise(F.col("delay_probability")),
        "delay_p90_min": F.when(own, F.greatest(F.col("delay_p50_min").cast("double"), F.col("delay_p90_min") + F.lit(float(delta)))).otherwise(F.col("delay_p90_min")),
    })


def validate_correction(holdout: DataFrame, xs: list[float], ys: list[float], delta: float) -> DataFrame:
    """One row: calibration error and coverage with the correction and without, and which half helps."""
    h = holdout.withColumns({"_y": outcome(), "_c": interpolate(F.col("model_probability"), xs, ys)})
    raw = expected_calibration_error(h, "_y", "model_probability").withColumnRenamed("ece", "ece_raw")
    new = expected_calibration_error(h, "_y", "_c").withColumnRenamed("ece", "ece_corrected")
    actual, p90 = F.col("actual_delay_min"), F.col("model_p90_min")
    cov = h.agg(F.count(F.lit(1)).alias("n_holdout"), coverage(actual, p90).alias("coverage_raw"), coverage(actual, p90 + delta).alias("coverage_corrected"))
    return raw.join(new).join(cov).withColumns({
        "probability_correction_helps": F.col("ece_corrected") < F.col("ece_raw"),
        "p90_correction_helps": F.abs(F.col("coverage_corrected") - TARGET) < F.abs(F.col("coverage_raw") - TARGET),
    })


def fit_calibration(pairs: DataFrame, now: Column, min_pairs: int = MIN_PAIRS) -> dict | None:
    """The correction that helped on the last day, refitted on all pairs; None if there is too little or none helps.

    Only knots and sums come to the driver.
    """
    recent = F.col("scheduled_time") >= now - minutes(F.lit(24 * 60))
    n = pairs.agg(F.count(F.lit(1)).alias("all"), F.sum(recent.cast("long")).alias("late"), F.max("model_version").alias("version")).first()
    if n["all"] < min_pairs or n["all"] - n["late"] < min_pairs // 2 or n["late"] < min_pairs // 4:
        return None
    old, new = pairs.where(~recent), pairs.where(recent)
    xs, ys = isotonic_curve(old)
    checks = validate_correction(new, xs, ys, conformal_offset(old).first()[0]).first().asDict()
    if not (checks["probability_correction_helps"] or checks["p90_correction_helps"]):
        return None
    xs, ys = isotonic_curve(pairs) if checks["probability_correction_helps"] else ([0.0, 1.0], [0.0, 1.0])
    delta = conformal_offset(pairs).first()[0] if checks["p90_correction_helps"] else 0.0
    return {"model_version": n["version"], "n_samples": n["all"], "curve_x": xs, "curve_y": ys, "p90_delta_min": float(delta), "validation": checks}


def rebuild(predictions: DataFrame, changes: DataFrame, now: Column, created_at: str, path: str, min_pairs: int = MIN_PAIRS) -> dict | None:
    """Logs to the published calibration of the newest model: pairs, fit, gate; what doesn't help or has too little
    evidence takes the model's calibration away. Returns what is published."""
    pairs = written(collect_pairs(predictions, changes, now), "pairs")  # read again and again below
    version = pairs.agg(F.max("model_version")).first()[0]
    if version is None:
        newest = current_model(predictions.select("model_version").distinct()).first()
        version = newest["model_version"] if newest else None
        if version is None:
            return None
        out = None
    else:
        out = fit_calibration(pairs, now, min_pairs)
    write_calibration(predictions.sparkSession, out, version, created_at, path)
    return out


def latest_calibration(table: DataFrame, version: str) -> DataFrame:
    """The newest calibration of that model; no row means identity."""
    return table.where(F.col("model_version") == version).withColumn("_i", F.row_number().over(W.partitionBy("model_version").orderBy(F.desc("created_at")))).where("_i = 1").drop("_i")
