"""What was known when a prediction was sealed: the network's state, statistics and the calibration of that time.

Seals stand at five past the hour (seal_time). An observation is in the hour before exactly one seal, so whether it was
known by then is a comparison in its own row, and no stop meets another in an as-of join. A stop whose change was
observed between two seals is in both their hours, each time as it was known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import minutes, seal_time, whole_minutes
from ..sources.tables import written
from .baseline import snapshot_lookup
from .calibration import along
from .clean import first_of
from .history import FEW_ROWS, asof_join
from .netstate import add_network_state


def seal_after(time: Column) -> Column:
    """The seal whose hour holds that time: the first one after it."""
    return F.date_trunc("HOUR", time - minutes(F.lit(5))) + minutes(F.lit(65))


def known_by_seal(predictions: DataFrame, changes: DataFrame) -> DataFrame:
    """Observations (station_name, train_type, time, delay_in_min, is_canceled) as they were known at the seal after them.

    A stop counts from its first seal on, as on time until a change was observed, then by that change until the next one;
    among changes of one moment the greatest row counts. One shuffle by stop.
    """
    p = first_of(predictions.select("stop_id", "station_name", "train_type", "scheduled_time", "predicted_at"), ["stop_id"], F.col("predicted_at"), F.col("scheduled_time"))
    own = ("changed_time", "is_canceled")
    c = changes.groupBy("stop_id", "observed_at").agg(F.max(F.struct(*own)).alias("_c")).select("stop_id", "observed_at", *[F.col("_c")[x].alias(x) for x in own])
    none = p.select("stop_id", F.lit(None).cast("timestamp").alias("observed_at"), F.lit(None).cast("timestamp").alias("changed_time"), F.lit(False).alias("is_canceled"))
    until = F.lead("observed_at").over(W.partitionBy("stop_id").orderBy(F.col("observed_at").asc_nulls_first()))
    spans = c.where(F.col("observed_at").isNotNull()).unionByName(none).withColumn("_until", until)
    out = p.join(spans, "stop_id").withColumn("time", F.coalesce("changed_time", "scheduled_time")).withColumn("_seal", seal_after(F.col("time")))
    out = out.where((F.greatest("predicted_at", "observed_at") <= F.col("_seal")) & (F.col("_until").isNull() | (F.col("_until") > F.col("_seal"))))
    delay = F.coalesce(whole_minutes(F.col("scheduled_time"), F.col("changed_time")), F.lit(0))
    return out.select("station_name", "train_type", "time", delay.cast("long").alias("delay_in_min"), F.coalesce("is_canceled", F.lit(False)).alias("is_canceled"))


def newest_at(seals: DataFrame, versions: DataFrame, since: str, by: list[str], name: str) -> DataFrame:
    """seals(by, _seal) with `name`: the greatest `since` of versions that isn't after the seal, null if there is none."""
    v = versions.where(F.col(since).isNotNull()).select(*by, F.col(since).alias(name)).distinct()
    return asof_join(seals, v, "_seal", name, by, every="DAY")


def joined(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """df with the table's columns by keys that may be null; the table is broadcast where its rows are few, as counted."""
    table = written(table, "known")
    few = table.count() <= FEW_ROWS
    t = (F.broadcast(table) if few else table).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [df[k].eqNullSafe(t[f"_r_{k}"]) for k in keys]
    return df.join(t, on, "left").drop(*[f"_r_{k}" for k in keys])


def features_at_seal(stops: DataFrame, predictions: DataFrame, changes: DataFrame, snapshots: DataFrame, overlays: DataFrame) -> DataFrame:
    """Planned stops (event_date, names, scheduled_time) with history, coverage and network state as of their seals.

    snapshots, overlays: statistics of all versions, with published_at; a seal sees the newest version that was published
    by then, and none before the first.
    """
    df = stops.withColumn("_seal", seal_time(F.col("scheduled_time")))
    seals = written(df.select("_seal").distinct(), "seals")
    for table, name in ((overlays, "_overlay_at"), (snapshots, "_snap_at")):
        df = joined(df, newest_at(seals, table, "published_at", [], name), ["_seal"])
    df = snapshot_lookup(df, snapshots, overlays, versions=("_overlay_at", "_snap_at")).drop("_seal", "_overlay_at", "_snap_at")
    return add_network_state(df, source=known_by_seal(predictions, changes))


def calibrated_at_seal(scored: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Model outputs (model_version, predicted_at, delay_probability, delay_p50_min, delay_p90_min) through the calibration
    that their model had at predicted_at, with what the model said in raw_delay_probability and raw_delay_p90_min, which
    are null where no calibration was in force. calibrations: created_at (a timestamp), curves and offset by model."""
    df = scored.withColumn("_seal", F.col("predicted_at"))
    seals = written(df.select("model_version", "_seal").distinct(), "seals")
    keys = ["model_version", "created_at"]
    which = newest_at(seals, calibrations, "created_at", ["model_version"], "created_at")
    curves = calibrations.select(*keys, F.arrays_zip(F.col("curve_x").alias("x"), F.col("curve_y").alias("y")).alias("_knots"), F.col("p90_delta_min").alias("_delta"))
    curves = first_of(curves, keys, F.col("_knots"), F.col("_delta"))
    df = joined(df, which.join(curves, keys), ["model_version", "_seal"])
    active = F.col("_knots").isNotNull() & (F.size("_knots") > 0)
    probability, p90 = F.col("delay_probability"), F.col("delay_p90_min").cast("double")
    moved = F.greatest(F.col("delay_p50_min").cast("double"), p90 + F.coalesce("_delta", F.lit(0.0)))
    return df.withColumns({
        "raw_delay_probability": F.when(active, probability), "raw_delay_p90_min": F.when(active, p90),
        "delay_probability": F.when(active, along(probability, F.col("_knots"))).otherwise(probability), "delay_p90_min": F.when(active, moved).otherwise(p90),
    }).drop("_seal", "_knots", "_delta", "created_at")
