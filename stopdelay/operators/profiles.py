"""Profiles of a stops table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import nearest_quantiles
from ..functions.times import LATE_MIN, month_key, wall_clock


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def _late() -> Column:
    return F.col("delay_in_min") >= LATE_MIN


def monthly_profile(df: DataFrame) -> DataFrame:
    return df.groupBy(month_key(F.col("time")).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("station_name").alias("stations"), share(F.col("is_canceled")).alias("cancel_rate"), share(_late()).alias("late_rate")
    )


def delay_distribution(df: DataFrame) -> DataFrame:
    base = df.agg(F.count(F.lit(1)).alias("n"), F.min("delay_in_min").alias("lowest"), F.max("delay_in_min").alias("highest"), share(F.col("delay_in_min") < 0).alias("negative_share"), share(_late()).alias("late_share"))
    q = nearest_quantiles(df, "delay_in_min", (0.5, 0.9, 0.99))
    return base.join(q.select(F.col("q50").alias("p50"), F.col("q90").alias("p90"), F.col("q99").alias("p99")))


def delay_histogram(df: DataFrame, low: int = -10, high: int = 60) -> DataFrame:
    return df.groupBy(F.least(F.greatest("delay_in_min", F.lit(low)), F.lit(high)).alias("delay")).agg(F.count(F.lit(1)).alias("n"))


def profile_by_type(df: DataFrame, top: int = 12) -> DataFrame:
    g = df.groupBy("train_type").agg(F.count(F.lit(1)).alias("n"), F.avg("delay_in_min").alias("mean_delay"), share(_late()).alias("late_rate"), share(F.col("is_canceled")).alias("cancel_rate"))
    return g.orderBy(F.desc("n"), "train_type").limit(top)


def canceled_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("is_canceled").agg(F.count(F.lit(1)).alias("n"), share(F.col("delay_in_min") == 0).alias("zero_delay_share"), F.avg("delay_in_min").alias("mean_delay"))


def null_rates(df: DataFrame) -> DataFrame:
    """A row per column, from one pass."""
    rates = df.agg(*[share(F.col(c).isNull()).alias(c) for c in df.columns])
    return rates.unpivot([], df.columns, "column", "null_rate")


def endpoint_nulls(df: DataFrame, ride: str = "train_line_ride_id") -> DataFrame:
    first = F.min("train_line_station_num").over(W.partitionBy(ride))
    g = df.withColumn("is_first", F.col("train_line_station_num") == first).groupBy("is_first")
    return g.agg(F.count(F.lit(1)).alias("n"), share(F.col("arrival_planned_time").isNull()).alias("arrival_null"), share(F.col("departure_planned_time").isNull()).alias("departure_null"))


def hourly_counts(df: DataFrame, day: str, zone: str | None = None) -> DataFrame:
    """Rows of a day's hours, on the zone's clocks (as written without one): a skipped hour has none, a repeated one twice as many."""
    at = F.col("time") if zone is None else wall_clock(F.col("time"), zone)
    return df.where(F.to_date(at) == F.lit(day).cast("date")).groupBy(F.hour(at).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def feature_null_rate(df: DataFrame, features: list[str]) -> DataFrame:
    """Features that are null in some row, and in what share of rows."""
    return null_rates(df.select(*features)).where("null_rate > 0").select(F.col("column").alias("feature"), F.round("null_rate", 3).alias("null_rate"))
