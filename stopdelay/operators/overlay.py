"""The overlay of live statistics, kept by increments.

One table of parts holds, for every day of the prediction log, what is known of each sealed stop (`stops-DAY`) and the
sums that follow from it by finest entity and date (`sums-DAY`), and beside them the changes of stops that nobody has
sealed yet (`early`). A batch of the logs takes the old contribution of the stops that it changes from the sums and adds
the new one: both are appended rows, published by the same commit, so readers never see a stop without its sums. What a
batch does depends on what the table holds, so the same rows once more change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import LATE_MIN, whole_minutes
from ..sources.parts import commit, entries, load
from ..sources.tables import written
from .baseline import snapshot
from .clean import first_of
from .history import FEW_ROWS, latest_of_daily
from .logs import latest_changes

#: Days of the prediction log that count, and the folders of a part from which merge_overlay merges it.
LOOKBACK_DAYS, FOLDERS = 35, 8

KEYS = ("station_name", "train_type", "train_number")
CHANGE = ("observed_at", "changed_time", "is_canceled")
SUMS = ("delay_sum", "delayed_sum", "n")
ROW = (
    "part string, stop_id string, station_name string, train_type string, train_number string, scheduled_time timestamp, "
    "observed_at timestamp, changed_time timestamp, is_canceled boolean, event_date date, delay_sum long, delayed_sum long, n long"
)


def held_rows(spark: SparkSession, path: str, part: Column) -> DataFrame:
    out = load(spark, path, part)
    return spark.createDataFrame([], ROW) if out is None else out


def as_rows(df: DataFrame) -> DataFrame:
    """df with all columns of the table, null where it has none."""
    fields = [f.split() for f in ROW.split(", ")]
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields])


def newest_rows(stops: DataFrame) -> DataFrame:
    """Each stop's row of its latest change; a stop that changed has a row for every batch that changed it."""
    rest = [c for c in stops.columns if c not in ("stop_id", *CHANGE)]
    last = F.max(F.struct(*CHANGE, *rest)).alias("_r")
    return stops.groupBy("stop_id").agg(last).select("stop_id", "_r.*")


def of_stops(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The newest row of each of these stops that the table holds. Ids alone are read of all days, then the days' parts."""
    stops = F.col("part").startswith("stops-")
    days = held_rows(spark, path, stops).select("part", "stop_id").join(ids, "stop_id", "left_semi").select("part").distinct()
    names = [r[0] for r in days.collect()]  # days of the lookback at most
    return newest_rows(held_rows(spark, path, F.col("part").isin(names)).join(ids, "stop_id", "left_semi"))


def few(ids: DataFrame) -> DataFrame:
    """ids as a written table, broadcast where it is counted to be small."""
    ids = written(ids, "ids")
    return F.broadcast(ids) if ids.count() <= FEW_ROWS else ids


def refresh_overlay(predictions: DataFrame, changes: DataFrame, path: str) -> int:
    """Takes new rows of both logs into the overlay's table; returns the commit's number.

    predictions(stop_id, day, station_name, train_type, train_number, scheduled_time, predicted_at), changes(stop_id,
    observed_at, changed_time, is_canceled), each in any order and repeated at will. A stop's first seal counts, in the
    first batch that has one; among changes the latest one does, of equal moments the greatest row, also where it
    comes before the seal or after weeks. Rows without a stop, a day or a moment of observation are left out. Empty
    batches are fine, null keys are entities of their own. One writer at a time.
    """
    spark = predictions.sparkSession
    p = predictions.where("stop_id IS NOT NULL AND day IS NOT NULL").select("stop_id", "predicted_at", "scheduled_time", *KEYS, F.date_format("day", "yyyy-MM-dd").alias("day"))
    sealed = written(first_of(p, ["stop_id"], F.col("predicted_at"), F.struct("scheduled_time", *KEYS, "day")).drop("predicted_at"), "sealed")
    new = written(latest_changes(changes.where("stop_id IS NOT NULL AND observed_at IS NOT NULL").select("stop_id", *CHANGE)), "changed")
    ids = few(sealed.select("stop_id").union(new.select("stop_id")).distinct())
    held = written(of_stops(spark, path, ids).withColumn("day", F.substring("part", len("stops-") + 1, 10)).select("stop_id", "day", "scheduled_time", *KEYS, *CHANGE), "held")
    waiting = held_rows(spark, path, F.col("part") == "early").select("stop_id", *CHANGE).join(ids, "stop_id", "left_semi")
    waiting = written(latest_changes(waiting), "waiting")

    fresh = sealed.join(held.select("stop_id"), "stop_id", "left_anti").join(latest_changes(new.unionByName(waiting)), "stop_id", "left")
    now, old = F.struct(*[F.col(f"_new.{c}") for c in CHANGE]), F.struct(*CHANGE)
    moved = held.join(new.select("stop_id", F.struct(*CHANGE).alias("_new")), "stop_id").where(now > old)
    after = moved.select("stop_id", "day", "scheduled_time", *KEYS, *[F.col(f"_new.{c}").alias(c) for c in CHANGE])
    steps = fresh.unionByName(after).withColumn("_sign", F.lit(1)).unionByName(moved.drop("_new").withColumn("_sign", F.lit(-1)))
    steps = written(steps.withColumn("event_date", F.to_date("scheduled_time")), "steps")

    stops = steps.where("_sign = 1").withColumn("part", F.concat(F.lit("stops-"), "day")).drop("_sign", "day", "event_date")
    delay = F.coalesce(whole_minutes(F.col("scheduled_time"), F.col("changed_time")), F.lit(0)).cast("long")
    counted = steps.where(~F.coalesce("is_canceled", F.lit(False))).withColumns({"_delay": delay, "part": F.concat(F.lit("sums-"), "day")})
    late = (F.col("_delay") >= LATE_MIN).cast("long")
    sums = counted.groupBy("part", *KEYS, "event_date").agg(
        F.sum(F.col("_sign") * F.col("_delay")).alias("delay_sum"), F.sum(F.col("_sign") * late).alias("delayed_sum"), F.sum(F.col("_sign").cast("long")).alias("n")
    ).where("delay_sum <> 0 OR delayed_sum <> 0 OR n <> 0")
    early = new.join(held.select("stop_id").union(sealed.select("stop_id")), "stop_id", "left_anti")
    early = early.join(waiting.select("stop_id", F.struct(*CHANGE).alias("_old")), "stop_id", "left").where(F.col("_old").isNull() | (old > F.col("_old")))
    early = early.drop("_old").withColumn("part", F.lit("early"))
    out = as_rows(stops).unionByName(as_rows(sums)).unionByName(as_rows(early))
    return commit(out.hint("rebalance", "part"), path, "part", "append")


def overlay_sums(spark: SparkSession, path: str, now: Column, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Sums by finest entity and date, of completed days; only the parts with sums of the lookback are opened."""
    first = F.concat(F.lit("sums-"), F.date_format(F.date_sub(F.to_date(now), lookback_days), "yyyy-MM-dd"))
    sums = held_rows(spark, path, F.col("part").startswith("sums-") & (F.col("part") >= first))
    sums = sums.where(F.col("event_date") < F.to_date(now))
    return sums.groupBy(*KEYS, "event_date").agg(*[F.sum(c).alias(c) for c in SUMS]).where("n > 0")


def overlay_statistics(spark: SparkSession, path: str, now: Column, lookback_days: int = LOOKBACK_DAYS) -> DataFrame:
    """Latest statistics of all entities (see snapshot), from a sum for each of an entity's days. No log is read."""
    finest = written(overlay_sums(spark, path, now, lookback_days), "sums")

    def latest(daily: DataFrame, keys: list[str], prefix: str) -> DataFrame:
        return latest_of_daily(daily.groupBy(*keys, "event_date").agg(*[F.sum(c).alias(c) for c in SUMS]), keys, prefix)

    return snapshot(finest, latest)


def merge_overlay(spark: SparkSession, path: str, now: Column, lookback_days: int = LOOKBACK_DAYS, folders: int = FOLDERS) -> None:
    """Merges parts of more than so many folders, each on its own, and drops days before the lookback.

    Early changes leave with the days of the lookback, or when their stop has been sealed."""
    day = F.regexp_extract("part", r"^(?:stops|sums)-(.*)$", 1)
    first = F.date_format(F.date_sub(F.to_date(now), lookback_days), "yyyy-MM-dd")
    _, table = entries(spark, path)
    parts = table.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("_old", (day != "") & (day < first))
    parts = parts.where(F.col("_old") | (F.col("n") > folders)).collect()  # days, not rows
    gone = [r["part"] for r in parts if r["_old"]]
    crowded = [r["part"] for r in parts if not r["_old"]]
    if not parts:
        return
    rows = held_rows(spark, path, F.col("part").isin(crowded))
    stops = newest_rows(rows.where(F.col("part").startswith("stops-")))
    sums = rows.where(F.col("part").startswith("sums-")).groupBy("part", *KEYS, "event_date").agg(*[F.sum(c).alias(c) for c in SUMS])
    sums = sums.where("delay_sum <> 0 OR delayed_sum <> 0 OR n <> 0")
    early = latest_changes(rows.where("part = 'early'").select("stop_id", *CHANGE)).where(F.col("observed_at") >= F.date_sub(F.to_date(now), lookback_days + 1))
    ids = few(early.select("stop_id"))
    known = held_rows(spark, path, F.col("part").startswith("stops-")).select("stop_id").join(ids, "stop_id", "left_semi")
    early = early.join(known, "stop_id", "left_anti").withColumn("part", F.lit("early"))
    out = as_rows(stops).unionByName(as_rows(sums)).unionByName(as_rows(early))
    commit(out.hint("rebalance", "part"), path, "part", "replace", [*crowded, *gone])
