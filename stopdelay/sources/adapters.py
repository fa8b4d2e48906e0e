"""Stops and logs as views of the general test tables, in Spark and, for the oracles, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import minutes

NOW = "2024-01-20 12:00:00"
HORIZON_YEAR = 2027


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stops_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops at minutes of 30 days, from events."""
    e = _table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("time"), "user_id", "event_type", F.floor(F.col("value") / 10).cast("int").alias("_v"))
    e = e.withColumn("delay_in_min", F.col("_v") - 2)
    planned = F.col("time") - minutes(F.col("delay_in_min"))
    i = F.col("event_id")
    return e.select(
        i.cast("string").alias("id"), F.concat(F.lit("S"), (F.col("user_id") % 12).cast("string")).alias("station_name"), F.col("event_type").alias("train_type"),
        F.col("user_id").cast("string").alias("train_number"), (i % 20).cast("int").alias("train_line_station_num"), "delay_in_min", "time",
        F.when(i % 4 != 0, planned).alias("departure_planned_time"), F.when((i % 4 == 0) & (i % 8 != 0), planned).alias("arrival_planned_time"), (i % 23 == 0).alias("is_canceled"),
    )


STOPS = """stops AS (
  SELECT CAST(event_id AS VARCHAR) AS id, 'S' || (user_id % 12) AS station_name, event_type AS train_type, CAST(user_id AS VARCHAR) AS train_number,
         CAST(event_id % 20 AS INTEGER) AS train_line_station_num, CAST(floor(value / 10) AS INTEGER) - 2 AS delay_in_min, ts AS time,
         CASE WHEN event_id % 4 <> 0 THEN ts - to_minutes(CAST(floor(value / 10) AS INTEGER) - 2) END AS departure_planned_time,
         CASE WHEN event_id % 4 = 0 AND event_id % 8 <> 0 THEN ts - to_minutes(CAST(floor(value / 10) AS INTEGER) - 2) END AS arrival_planned_time,
         event_id % 23 = 0 AS is_canceled
  FROM events
)"""
#: Stops with the scheduled time and its date, canceled ones left out.
PLANNED = STOPS + """, planned AS (
  SELECT *, coalesce(departure_planned_time, arrival_planned_time, time - to_minutes(delay_in_min)) AS scheduled_time,
         CAST(coalesce(departure_planned_time, arrival_planned_time, time - to_minutes(delay_in_min)) AS DATE) AS event_date
  FROM stops WHERE NOT is_canceled
)"""


def stops_events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stops_events with defects: missing stations, impossible delays, repeated rows."""
    i = F.col("id").cast("long")
    s = stops_events(spark, sf_dir).withColumns({"station_name": F.when(i % 97 != 0, F.col("station_name")), "delay_in_min": F.when(i % 211 == 0, F.lit(5000)).otherwise(F.col("delay_in_min"))})
    return s.union(s.where(i % 50 == 0))


RAW = STOPS + """, one AS (
  SELECT id, CASE WHEN CAST(id AS BIGINT) % 97 <> 0 THEN station_name END AS station_name, train_type, train_number, train_line_station_num,
         CASE WHEN CAST(id AS BIGINT) % 211 = 0 THEN 5000 ELSE delay_in_min END AS delay_in_min, time, departure_planned_time, arrival_planned_time, is_canceled
  FROM stops
), raw AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE CAST(id AS BIGINT) % 50 = 0)"""


def stops_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops of 83 months, from lineitem."""
    x = _table(spark, sf_dir, "lineitem")
    time = x["l_shipdate"].cast("timestamp") + minutes((x["l_orderkey"] % 1440).cast("int"))
    out = x.select(
        F.concat_ws("-", x["l_orderkey"].cast("string"), x["l_linenumber"].cast("string")).alias("id"), F.concat(F.lit("S"), x["l_suppkey"].cast("string")).alias("station_name"),
        F.concat("l_returnflag", "l_linestatus").alias("train_type"), (x["l_partkey"] % 500).cast("string").alias("train_number"), x["l_linenumber"].cast("int").alias("train_line_station_num"),
        (x["l_quantity"].cast("int") - 36).alias("delay_in_min"), time.alias("time"), (x["l_linenumber"] == 7).alias("is_canceled"),
    )
    return out.withColumn("departure_planned_time", F.col("time") - minutes(F.col("delay_in_min"))).withColumn("arrival_planned_time", F.lit(None).cast("timestamp"))


LINES = """lines AS (
  SELECT l_orderkey || '-' || l_linenumber AS id, 'S' || l_suppkey AS station_name, l_returnflag || l_linestatus AS train_type, CAST(l_partkey % 500 AS VARCHAR) AS train_number,
         l_linenumber AS train_line_station_num, CAST(l_quantity AS INTEGER) - 36 AS delay_in_min, l_shipdate + to_minutes(CAST(l_orderkey % 1440 AS INTEGER)) AS time,
         l_linenumber = 7 AS is_canceled
  FROM lineitem
)"""


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows for folds and baselines, from stops_lineitem."""
    s = stops_lineitem(spark, sf_dir).where(~F.col("is_canceled"))
    return s.select("station_name", "train_type", (F.col("delay_in_min") >= 6).alias("target_delayed6"), F.col("delay_in_min").alias("target_delay_min"), F.date_format("departure_planned_time", "yyyy-MM").alias("fold_month"))


TRAINING = LINES + """, training AS (
  SELECT station_name, train_type, delay_in_min >= 6 AS target_delayed6, delay_in_min AS target_delay_min, strftime(time - to_minutes(delay_in_min), '%Y-%m') AS fold_month
  FROM lines WHERE NOT is_canceled
)"""


def predictions_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of sealed predictions."""
    i = F.col("id").cast("long")
    s = stops_events(spark, sf_dir).withColumn("scheduled_time", F.col("time") - minutes(F.col("delay_in_min")))
    s = s.withColumns({"delay_probability": ((i * 7919) % 1000) / F.lit(1000.0), "delay_p50_min": i % 7})
    s = s.withColumn("delay_p90_min", F.col("delay_p50_min") + 5 + i % 13)
    predicted = F.col("scheduled_time") - minutes(F.lit(120))
    return s.select(
        F.col("id").alias("stop_id"), "station_name", "train_type", "train_number", "scheduled_time", predicted.alias("predicted_at"), "delay_probability", "delay_p50_min", "delay_p90_min",
        F.when(i % 4 != 0, F.col("delay_probability") * 0.8).alias("raw_delay_probability"), F.when(i % 4 != 0, (F.col("delay_p90_min") - 2).cast("double")).alias("raw_delay_p90_min"),
        F.element_at(F.array(*[F.lit(x) for x in ("train", "station_type", "type", "cold")]), (i % 4 + 1).cast("int")).alias("coverage"),
        F.when(i % 3 == 0, "v1").otherwise("v2").alias("model_version"), F.to_date(predicted).alias("day"),
    )


def changes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of observed changes; every second stop has a superseded one as well."""
    i = F.col("id").cast("long")
    s = stops_events(spark, sf_dir).withColumn("scheduled_time", F.col("time") - minutes(F.col("delay_in_min"))).where(i % 5 != 0)
    last = s.select(F.col("id").alias("stop_id"), F.when(~F.col("is_canceled"), F.col("time")).alias("changed_time"), "is_canceled", (F.col("time") + minutes((i % 30).cast("int"))).alias("observed_at"))
    first = s.where(i % 2 == 0).select(F.col("id").alias("stop_id"), F.col("scheduled_time").alias("changed_time"), F.lit(False).alias("is_canceled"), (F.col("scheduled_time") - minutes(F.lit(60))).alias("observed_at"))
    return last.union(first).withColumn("day", F.to_date("observed_at"))


LOGS = STOPS + """, logged AS (SELECT *, CAST(id AS BIGINT) AS i, time - to_minutes(delay_in_min) AS scheduled_time FROM stops
), predictions AS (
  SELECT id AS stop_id, station_name, train_type, train_number, scheduled_time, scheduled_time - INTERVAL 2 HOUR AS predicted_at,
         ((i * 7919) % 1000) / 1000.0::DOUBLE AS delay_probability, i % 7 AS delay_p50_min, i % 7 + 5 + i % 13 AS delay_p90_min,
         CASE WHEN i % 4 <> 0 THEN ((i * 7919) % 1000) / 1000.0::DOUBLE * 0.8::DOUBLE END AS raw_delay_probability, CASE WHEN i % 4 <> 0 THEN (i % 7 + 3 + i % 13)::DOUBLE END AS raw_delay_p90_min,
         (['train', 'station_type', 'type', 'cold'])[i % 4 + 1] AS coverage, CASE WHEN i % 3 = 0 THEN 'v1' ELSE 'v2' END AS model_version,
         CAST(scheduled_time - INTERVAL 2 HOUR AS DATE) AS day
  FROM logged
), changes AS (
  SELECT *, CAST(observed_at AS DATE) AS day FROM (
    SELECT id AS stop_id, CASE WHEN NOT is_canceled THEN time END AS changed_time, is_canceled, time + to_minutes(CAST(i % 30 AS INTEGER)) AS observed_at FROM logged WHERE i % 5 <> 0
    UNION ALL
    SELECT id, scheduled_time, false, scheduled_time - INTERVAL 1 HOUR FROM logged WHERE i % 5 <> 0 AND i % 2 = 0)
), latest AS (
  SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY observed_at DESC, changed_time DESC NULLS LAST) = 1
), truth AS (
  SELECT p.*, l.changed_time, coalesce(l.is_canceled, false) AS is_canceled,
         coalesce(trunc(epoch_us(l.changed_time - p.scheduled_time) / 60000000.0), 0)::BIGINT AS actual_delay_min
  FROM predictions p LEFT JOIN latest l USING (stop_id)
)"""
