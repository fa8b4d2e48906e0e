"""The live side as structured streams. Event times are TIMESTAMP columns, as watermarks ask for."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import minutes, whole_minutes
from ..operators.logs import anti_append, daily_report, ground_truth, latest_changes, uncorrected_report
from ..operators.netstate import late
from ..sources.parts import commit, entries, load
from ..sources.tables import read_log, replace_days, written


def first_seal_stream(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """The first seal of every stop within the watermark."""
    return stream.withWatermark("predicted_at", delay).dropDuplicatesWithinWatermark(["stop_id"])


#: Batches that may lie beside the merged rows, and how long a stop's change may be followed by others, as a rule.
BATCHES, OPEN_DAYS = 8, 3


def latest_change_stream(stream: DataFrame, table_path: str, checkpoint: str, batches: int = BATCHES, open_days: int = OPEN_DAYS) -> None:
    """What has come so far as a table of parts: each micro-batch's latest changes of its stops are a part, and every
    `batches` of them are merged with the stops that are still open. latest_so_far reads the table.

    A batch that is repeated replaces its part, or adds rows that change nothing where it was merged meanwhile."""

    def write(batch: DataFrame, number: int) -> None:
        part = f"b{number:012d}"
        commit(latest_changes(batch).withColumn("part", F.lit(part)), table_path, "part", "replace", [part])
        merge_changes(batch.sparkSession, table_path, batches, open_days)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def merge_changes(spark: SparkSession, table_path: str, batches: int = BATCHES, open_days: int = OPEN_DAYS) -> None:
    """Merges batches, once there are so many, with the part `open`. Changes that are open_days older than the newest go
    to a part of their own that is never rewritten, so a merge reads and writes these days and the batches and no more. A
    change that comes later still counts: readers compare all parts."""
    _, now = entries(spark, table_path)
    new = [r[0] for r in now.where(F.col("part").startswith("b")).select("part").distinct().orderBy("part").collect()]
    if len(new) < batches:
        return
    rows = latest_changes(load(spark, table_path, F.col("part").isin("open", *new)).drop("part"))
    newest = rows.agg(F.max("observed_at")).first()[0]
    if newest is None:
        part = F.lit("open")
    else:
        since = F.lit(newest) - F.expr(f"interval {open_days} days")
        part = F.when(F.col("observed_at") < since, F.lit(f"settled-{new[-1]}")).otherwise(F.lit("open"))
    commit(rows.withColumn("part", part), table_path, "part", "replace", ["open", *new])


def latest_so_far(spark: SparkSession, table_path: str) -> DataFrame:
    """Each stop's latest change, among equal times the greatest row."""
    return latest_changes(load(spark, table_path).drop("part"))


def network_state_stream(stream: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Sliding hours, every 5 minutes, of observed stops that weren't canceled.

    Stops are summed by panes of 5 minutes first, and a pane, not a stop, goes into its twelve hours. An hour comes when
    the watermark has passed it."""
    s = stream.where(~F.col("is_canceled")).withWatermark("time", delay)
    panes = s.groupBy(F.window("time", "5 minutes").alias("pane"), *keys).agg(F.sum("delay_in_min").alias("_delay"), F.count("delay_in_min").alias("_known"), F.sum(late()).alias("_late"), F.count(F.lit(1)).alias("_n"))
    g = panes.groupBy(F.window(F.window_time("pane"), "60 minutes", "5 minutes").alias("_w"), *keys)
    g = g.agg(F.try_divide(F.sum("_delay"), F.sum("_known")).alias("mean_delay_60m"), (F.sum("_late") / F.sum("_n")).alias("delayed_share_60m"), F.sum("_n").alias("n_60m"))
    return g.select(F.col("_w.end").alias("window_end"), *keys, "mean_delay_60m", "delayed_share_60m", "n_60m")


def ground_truth_stream(predictions: DataFrame, changes: DataFrame, delay: str = "1 day") -> DataFrame:
    """Predictions with each observed change of their stop from 2 days before to 2 days after; those without one come once
    both watermarks have passed. settled_truth reduces several changes of a stop to the latest."""
    p = predictions.withWatermark("predicted_at", delay)
    c = changes.select(F.col("stop_id").alias("_stop"), "changed_time", "is_canceled", "observed_at").withWatermark("observed_at", delay)
    near = F.col("observed_at").between(F.col("predicted_at") - F.expr("interval 2 days"), F.col("predicted_at") + F.expr("interval 2 days"))
    out = p.join(c, (F.col("stop_id") == F.col("_stop")) & near, "left_outer").drop("_stop")
    return out.withColumn("actual_delay_min", F.coalesce(whole_minutes(F.col("scheduled_time"), F.col("changed_time")), F.lit(0)))


def settled_truth(emitted: DataFrame) -> DataFrame:
    """What ground_truth_stream has written so far, a row per seal: its stop's latest change, among equal times the greatest."""
    keys = ["stop_id", "predicted_at", "scheduled_time"]
    last = F.max(F.struct("observed_at", "changed_time", "is_canceled", "actual_delay_min")).alias("_r")
    out = emitted.groupBy(*keys).agg(last).select(*keys, "_r.changed_time", "_r.is_canceled", "_r.actual_delay_min")
    return out.withColumn("is_canceled", F.coalesce("is_canceled", F.lit(False)))


def daily_scores(spark: SparkSession, log_path: str, progress: str, report: Callable[[list], DataFrame], table_path: str) -> None:
    """One run of the daily job: days of the log at log_path that got rows since the last run are reported anew and
    replace what table_path has of them. report: from days to a frame with a column day; it reads what it needs, such as
    the next day's changes. A run that is repeated writes the same days again."""
    log = spark.readStream.schema(spark.read.parquet(log_path).schema).parquet(log_path)

    def write(batch: DataFrame, _: int) -> None:
        days = [r["day"] for r in batch.select("day").distinct().collect()]  # a batch's days are few
        if days:
            replace_days(report(days), table_path)

    log.select("day").writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def whole_report(spark: SparkSession, log_path: str, changes: DataFrame) -> Callable[[list], DataFrame]:
    """What daily_scores writes of days of the log: the daily report, and beside it what the outputs before correction would
    have been, null in days of an era without raw outputs. Changes count from the day before to two days after the days asked for."""

    def report(days: list) -> DataFrame:
        low, high = min(days), max(days)
        own = read_log(spark, log_path, str(low), str(high)).where(F.col("day").isin(days))
        own = own.withColumns({c: F.lit(None).cast("double") for c in ("raw_delay_probability", "raw_delay_p90_min") if c not in own.columns})
        truth = ground_truth(own, changes.where(F.col("day").between(F.date_sub(F.lit(low), 1), F.date_add(F.lit(high), 2))))
        return daily_report(truth).join(uncorrected_report(truth), "day", "left")

    return report


def seal_stream(plan: DataFrame, lookup: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], predicted_at: Column, lead_minutes: int = 120) -> DataFrame:
    """Planned stops to sealed predictions: static joins (lookup), a model (score), rows without a score dropped, and of
    every stop the first seal. Only stops that are still ahead are sealed."""
    ahead = plan.where(F.col("scheduled_time") >= predicted_at - minutes(F.lit(lead_minutes)))
    out = score(lookup(ahead)).where(F.col("delay_probability").isNotNull()).withColumn("predicted_at", predicted_at)
    return first_seal_stream(out)


def seal_batches(plan: DataFrame, seal: Callable[[DataFrame], DataFrame], table_path: str, checkpoint: str) -> None:
    """Planned stops to a table of sealed predictions, a part a day of the seal and a commit a batch. seal: from a batch's
    stops to rows with stop_id, predicted_at and delay_probability; it reads the logs as they are then. Rows without a
    score are dropped; of a stop that was sealed on one of the batch's days or the day before, nothing is sealed again,
    and so a batch that is repeated adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = written(seal(batch).where(F.col("delay_probability").isNotNull()).withColumn("day", F.to_date("predicted_at")), "sealed")
        days = rows.agg(F.min("day").alias("first"), F.max("day").alias("last")).first()
        if days["first"] is None:
            return
        before = load(spark, table_path, F.col("part").between(str(days["first"] - dt.timedelta(days=1)), str(days["last"])))
        logged = spark.createDataFrame([], "stop_id string") if before is None else before.select("stop_id")
        commit(anti_append(rows, logged), table_path, "day", "append")

    plan.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_available(stream: DataFrame, sink_path: str, checkpoint: str, mode: str = "append") -> None:
    """All that has come so far into a Parquet table, then the stream ends; the next call goes on from there."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", sink_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
