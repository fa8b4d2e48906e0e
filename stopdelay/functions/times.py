"""Clock and calendar functions. Times are UTC instants; sessions run in UTC (see stopdelay.queries.registry)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"
DELAY_MIN, DELAY_MAX, LATE_MIN = -60, 1440, 6
FIRST_HOLIDAY_YEAR = 2024


def minutes(c: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), c, F.lit(0))


def whole_minutes(start: Column, end: Column) -> Column:
    """Minutes from start to end, cut towards zero."""
    return F.timestamp_diff("MINUTE", start, end)


def zone_to_utc(c: Column, zone: str = ZONE) -> Column:
    """A wall clock time (timestamp_ntz) of `zone` as an instant: the first of two in autumn, null in the spring gap."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), c)
    return F.when(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc) == c, utc).cast("timestamp")


def wall_clock(c: Column, zone: str = ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz"))


def to_zone_time(df: DataFrame, cols: list[str], zone: str = ZONE) -> DataFrame:
    return df.withColumns({c: zone_to_utc(F.col(c), zone) for c in cols})


def add_scheduled_time(df: DataFrame) -> DataFrame:
    """Planned departure, else planned arrival, else the time less the delay."""
    return df.withColumn("scheduled_time", F.coalesce("departure_planned_time", "arrival_planned_time", F.col("time") - minutes(F.col("delay_in_min"))))


def _easter(year: Column) -> Column:
    """Easter Sunday by the Gregorian rule."""
    div = lambda a, b: F.floor(a / b)
    golden, century = year % 19, div(year, 100)
    moon = (19 * golden + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15) % 30
    week = (32 + 2 * (century % 4) + 2 * div(year % 100, 4) - moon - (year % 100) % 4) % 7
    late = div(golden + 11 * moon + 22 * week, 451)
    day = moon + week - 7 * late + 114
    return F.make_date(year.cast("int"), div(day, 31).cast("int"), (day % 31 + 1).cast("int"))


def holidays(spark: SparkSession, last_year: int, first_year: int = FIRST_HOLIDAY_YEAR) -> DataFrame:
    """German national holidays: 9 rows a year, made from the year alone."""
    y = spark.range(first_year, last_year + 1).withColumn("easter", _easter(F.col("id")))
    moving = [F.date_add("easter", n) for n in (-2, 1, 39, 50)]
    fixed = [F.make_date(F.col("id").cast("int"), F.lit(m), F.lit(d)) for m, d in ((1, 1), (5, 1), (10, 3), (12, 25), (12, 26))]
    return y.select(F.explode(F.array(*moving, *fixed)).alias("holiday"))


def add_calendar_features(df: DataFrame, days: DataFrame, zone: str | None = None) -> DataFrame:
    """Hour, weekday (1 Monday to 7), month, weekend, holiday and date of scheduled_time.

    zone None takes instants as wall clock. `days` (see holidays) has 9 rows a year and is broadcast for that.
    """
    at = F.col("scheduled_time") if zone is None else wall_clock(F.col("scheduled_time"), zone)
    df = df.withColumns({"scheduled_hour": F.hour(at), "weekday": F.weekday(at) + 1, "month": F.month(at), "event_date": F.to_date(at)})
    df = df.withColumn("is_weekend", F.col("weekday") >= 6)
    known = F.broadcast(days.select(F.col("holiday").alias("_holiday")))
    return df.join(known, F.col("event_date") == F.col("_holiday"), "left").withColumn("is_holiday", F.col("_holiday").isNotNull()).drop("_holiday")


def seal_time(c: Column, lead_minutes: int | None = None) -> Column:
    """When a stop's prediction is sealed: at :05 two hours before its hour, or a fixed lead before its time."""
    if lead_minutes is not None:
        return c - minutes(F.lit(lead_minutes))
    return F.date_trunc("HOUR", c) - minutes(F.lit(115))


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")
