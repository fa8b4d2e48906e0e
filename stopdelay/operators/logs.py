"""Event logs: sealed predictions (the first wins), observed changes (the latest wins), daily metrics (upsert by day)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import classification_metrics, coverage, expected_calibration_error, quantile_metrics
from ..functions.times import LATE_MIN, minutes, whole_minutes
from .clean import first_of


def union_logs(logs: Sequence[DataFrame]) -> DataFrame:
    """Logs of different eras as one: columns by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def latest_changes(log: DataFrame) -> DataFrame:
    """A stop's change of the latest observation; among equal times the greatest row."""
    rest = [c for c in log.columns if c not in ("stop_id", "observed_at")]
    last = F.max(F.struct("observed_at", *rest)).alias("_r")
    return log.groupBy("stop_id").agg(last).select("stop_id", *[F.col("_r")[c].alias(c) for c in ("observed_at", *rest)])


def anti_append(new: DataFrame, logged: DataFrame) -> DataFrame:
    """The stops of `new` that aren't logged yet, once each: the earliest seal."""
    fresh = new.join(logged.select("stop_id").distinct(), "stop_id", "left_anti")
    return first_of(fresh, ["stop_id"], F.col("predicted_at"), F.struct(*[c for c in new.columns if c not in ("stop_id", "predicted_at")]))


def ground_truth(predictions: DataFrame, changes: DataFrame) -> DataFrame:
    """predictions with changed_time, is_canceled and actual_delay_min of the stop's latest change.

    No change is on time; an unknown cancellation is none; delays are whole minutes, cut towards zero.
    """
    latest = latest_changes(changes).select("stop_id", "changed_time", F.col("is_canceled").alias("_canceled"))
    out = predictions.join(latest, "stop_id", "left")
    delay = F.coalesce(whole_minutes(F.col("scheduled_time"), F.col("changed_time")), F.lit(0)).cast("long")
    return out.withColumns({"is_canceled": F.coalesce("_canceled", F.lit(False)), "actual_delay_min": delay}).drop("_canceled")


def outcome() -> Column:
    return (F.col("actual_delay_min") >= LATE_MIN).cast("double")


def daily_report(truth: DataFrame, by: str = "day") -> DataFrame:
    """A day's counts, shares and metrics, all days in one job; metrics that need both classes are null without them."""
    usable = F.col("is_canceled") == F.lit(False)
    t = truth.withColumn("_y", outcome())
    share = lambda c: F.avg(F.when(usable, c.cast("double")))
    counts = t.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_predictions"), F.sum((~usable).cast("long")).alias("n_canceled"), F.sum(usable.cast("long")).alias("n_evaluated"),
        F.coalesce(share(F.col("changed_time").isNotNull()), F.lit(0.0)).alias("share_with_observed_change"),
        F.coalesce(share(F.col("coverage") == "train"), F.lit(0.0)).alias("coverage_train_share"),
    )
    u = t.where(usable)
    y = F.col("actual_delay_min").cast("double")
    quantiles = u.groupBy(by).agg(*[c.alias(k) for k, c in quantile_metrics(y, F.col("delay_p50_min").cast("double"), F.col("delay_p90_min").cast("double")).items()])
    classes = classification_metrics(u, "_y", "delay_probability", [by])
    both = F.col("roc_auc").isNotNull()
    out = counts.join(quantiles, by, "left").join(classes, by, "left")
    return out.withColumns({c: F.when(both, F.col(c)) for c in ("pr_auc", "brier", "ece")})


def uncorrected_report(truth: DataFrame, by: str = "day", min_rows: int = 100) -> DataFrame:
    """What a day would have been without the correction, over rows that carry raw outputs; only with enough of them."""
    raw = truth.where(~F.col("is_canceled") & F.col("raw_delay_probability").isNotNull()).withColumn("_y", outcome())
    base = raw.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_corrected"), coverage(F.col("actual_delay_min"), F.col("raw_delay_p90_min")).alias("coverage_p90_raw"), F.avg("_y").alias("_rate")
    ).where(F.col("n_corrected") >= min_rows)
    ece = expected_calibration_error(raw, "_y", "raw_delay_probability", [by]).withColumnRenamed("ece", "ece_raw")
    mixed = (F.col("_rate") > 0) & (F.col("_rate") < 1)
    return base.join(ece, by, "left").withColumn("ece_raw", F.when(mixed, F.col("ece_raw"))).drop("_rate")


def upsert_daily_metrics(series: DataFrame, new_rows: DataFrame) -> DataFrame:
    """series with new_rows in place of rows of their days; new columns are null elsewhere."""
    return series.join(new_rows.select("day"), "day", "left_anti").unionByName(new_rows, allowMissingColumns=True)


#: The retraining rules.
ECE_LIMIT, AUC_FLOOR, RULE_DAYS, FRESHNESS_LIMIT = 0.08, 0.70, 3, 45


def trigger_reasons(series: DataFrame, freshness_days: int | None = None) -> DataFrame:
    """One row: the reasons to retrain by the last days of the series, and whether there is one."""
    tail = series.orderBy(F.desc("day")).limit(RULE_DAYS)
    rules = []
    enough = F.count(F.lit(1)) >= RULE_DAYS
    if "ece" in series.columns:
        rules.append(F.when(enough & F.every(F.coalesce(F.col("ece") > ECE_LIMIT, F.lit(False))), F.lit(f"ece > {ECE_LIMIT} for {RULE_DAYS} consecutive days")))
    if "roc_auc" in series.columns:
        rules.append(F.when(enough & F.every(F.coalesce(F.col("roc_auc") < AUC_FLOOR, F.lit(False))), F.lit(f"roc_auc < {AUC_FLOOR} for {RULE_DAYS} consecutive days")))
    if freshness_days is not None and freshness_days > FRESHNESS_LIMIT:
        rules.append(F.lit(f"feature freshness {freshness_days}d > {FRESHNESS_LIMIT}d"))
    rules.append(F.lit(None).cast("string"))
    out = tail.agg(F.concat_ws("; ", *rules).alias("trigger_reasons"))
    return out.withColumn("retraining_recommended", F.col("trigger_reasons") != "")


def monitoring_tail(series: DataFrame, n: int = 30) -> DataFrame:
    return series.orderBy(F.desc("day")).limit(n)


def since(log: DataFrame, now: Column, days: int) -> DataFrame:
    """The log's rows of so many days before now and of today and later, by its day column, where it has one."""
    return log.where(F.col("day") >= F.date_sub(F.to_date(now), days)) if "day" in log.columns else log


def live_state(predictions: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The hour before now by station, by type and over all (scope), in one pass: mean delay, late share, rows. Of the
    logs today and yesterday are read."""
    t = ground_truth(since(predictions, now, 1), since(changes, now, 1)).withColumn("obs_time", F.coalesce("changed_time", "scheduled_time"))
    t = t.where(~F.col("is_canceled") & (F.col("obs_time") >= now - minutes(F.lit(60))) & (F.col("obs_time") < now))
    g = t.groupingSets([["station_name"], ["train_type"], []], "station_name", "train_type").agg(
        F.grouping_id().alias("_g"), F.avg("actual_delay_min").alias("mean_delay_60m"), F.avg(outcome()).alias("delayed_share_60m"), F.count(F.lit(1)).alias("n_60m")
    )
    scope = F.when(F.col("_g") == 1, "station").when(F.col("_g") == 2, "type").otherwise("network")
    return g.where("n_60m > 0").select(scope.alias("scope"), F.coalesce("station_name", "train_type").alias("key"), "mean_delay_60m", "delayed_share_60m", "n_60m")


def live_features(requests: DataFrame, state: DataFrame) -> DataFrame:
    """requests with the network state at their station, for their type and over all; null and 0 where nothing is."""
    out = requests
    for scope, key, name in (("station", "station_name", "station_live"), ("type", "train_type", "type_live"), ("network", None, "network_live")):
        s = state.where(F.col("scope") == scope).select(F.col("key").alias("_k"), *[F.col(c).alias(f"{name}_{c}") for c in ("mean_delay_60m", "delayed_share_60m", "n_60m")])
        out = out.join(s, F.col(key) == F.col("_k"), "left") if key else out.join(F.broadcast(s), F.lit(True), "left")  # the network is one row
        out = out.drop("_k") if scope == "station" else out.drop("_k", f"{name}_n_60m")
    return out.withColumn("station_live_n_60m", F.coalesce("station_live_n_60m", F.lit(0)))


def live_summary(state: DataFrame) -> DataFrame:
    of = lambda s, c: F.max(F.when(F.col("scope") == s, F.col(c)))
    count = lambda s: F.sum((F.col("scope") == s).cast("long"))
    return state.agg(
        F.coalesce(count("station"), F.lit(0)).alias("stations_with_state"), F.coalesce(count("type"), F.lit(0)).alias("types_with_state"),
        F.round(of("network", "mean_delay_60m"), 2).alias("mean_delay_60m"), F.round(of("network", "delayed_share_60m"), 4).alias("delayed_share_60m"),
    )


def board(predictions: DataFrame, changes: DataFrame, now: Column, limit: int = 25, station: str | None = None) -> DataFrame:
    """Every station's board in one job: the next and the last `limit` trains (side upcoming or departed).

    A stop's first seal counts; trains that share type, number and time are one. actual_delay_min is 0 without a report,
    db_live_delay_min is null. Departed trains stay a day.
    """
    p = since(predictions, now, 2)
    p = p if station is None else p.where(F.col("station_name") == station)
    p = first_of(p, ["stop_id"], F.col("predicted_at"), F.col("scheduled_time"))
    p = first_of(p, ["station_name", "train_type", "train_number", "scheduled_time"], F.col("predicted_at"), F.col("stop_id"))
    p = p.where(F.col("scheduled_time") >= now - minutes(F.lit(24 * 60)))
    t = ground_truth(p, since(changes, now, 3)).withColumn("db_live_delay_min", whole_minutes(F.col("scheduled_time"), F.col("changed_time")))
    t = t.withColumn("side", F.when(F.col("scheduled_time") >= now, "upcoming").otherwise("departed"))
    near = F.abs(F.unix_micros("scheduled_time") - F.unix_micros(now))
    place = F.row_number().over(W.partitionBy("station_name", "side").orderBy(near, "stop_id"))
    prob, p90 = F.col("delay_probability"), F.col("delay_p90_min")
    return t.withColumn("place", place).where(F.col("place") <= limit).withColumns(
        {"risk": F.when(prob >= 0.4, "high").when(prob >= 0.2, "mid").otherwise("low"), "within_p90": F.col("actual_delay_min") <= F.round(p90)}
    )


def observed_stops(predictions: DataFrame, changes: DataFrame, now: Column, lookback_days: int = 35) -> DataFrame:
    """The live log as stops, of completed days only."""
    t = ground_truth(since(predictions, now, lookback_days), since(changes, now, lookback_days + 1))
    out = t.withColumns({"delay_in_min": F.col("actual_delay_min").cast("int"), "event_date": F.to_date("scheduled_time")})
    return out.where(F.col("event_date") < F.to_date(now)).select("station_name", "train_type", "train_number", "delay_in_min", "is_canceled", "event_date")
