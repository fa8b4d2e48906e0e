"""Scans and sinks: monthly files, partitioned stops and features, logs by day, snapshots, calibrations, registries."""

from __future__ import annotations

import datetime as dt
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import month_key
from .parts import commit, found, load


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: what comes before it isn't computed again, also if an executor is lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_monthly(spark: SparkSession, path: str) -> DataFrame:
    """Files data-YYYY-MM.parquet, or folders month=YYYY-MM, with the month from the name.

    Times in nanoseconds, which Spark doesn't read as such, come as longs and are cut to microseconds.
    """
    legacy = "spark.sql.legacy.parquet.nanosAsLong"
    before = spark.conf.get(legacy)
    spark.conf.set(legacy, "true")  # for the schema only: nothing is read here, and the reader goes by the schema
    try:
        df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    finally:
        spark.conf.set(legacy, before)
    times = {c: F.timestamp_micros(F.floor(F.col(c) / 1000)).cast("timestamp_ntz") for c, t in df.dtypes if t == "bigint" and (c == "time" or c.endswith("_time"))}
    month = F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2})[^/]*(?:/part-[^/]*)?$", 1)
    return df.withColumn("month", month).withColumns(times)


def write_monthly(df: DataFrame, path: str | None = None) -> str:
    return write_stops(df, path or shared_path(df.sparkSession, "monthly"))


def write_stops(df: DataFrame, path: str) -> str:
    """Parquet by month; a day's rows go to one task, so that a month has a file a day at most, however they came."""
    out = df.withColumn("month", month_key(F.col("time")))
    out.repartition("month", F.to_date("time")).write.mode("overwrite").partitionBy("month").parquet(path)
    return path


def write_features(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").partitionBy("fold_month").parquet(path)
    return path


def load_split(features: DataFrame, months: list[str], columns: list[str], limit: int | None = None) -> DataFrame:
    """Columns of the months' rows; on a table by fold_month only their partitions are read."""
    out = features.where(F.col("fold_month").isin(months)).select(*columns)
    return out if limit is None else out.limit(limit)


def write_log(df: DataFrame, path: str) -> str:
    df.write.mode("append").partitionBy("day").parquet(path)
    return path


def read_log(spark: SparkSession, path: str, first_day: str, last_day: str) -> DataFrame:
    """The days' rows of a log; days without a folder are fine, columns of some of these days only are null in others.
    Only the days' own folders are listed and opened. No day there at all: no rows, with the whole log's columns."""
    first, last = (dt.date.fromisoformat(str(x)) for x in (first_day, last_day))
    days = ",".join(str(first + dt.timedelta(days=i)) for i in range((last - first).days + 1))
    read = spark.read.option("mergeSchema", "true").option("basePath", path)
    own = found(read, f"{path}/day={{{days}}}") if days else None
    return read.parquet(path).where(F.lit(False)) if own is None else own.withColumn("day", F.col("day").cast("date"))


def write_snapshot(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").partitionBy("granularity").parquet(path)
    return path


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_days(df: DataFrame, path: str) -> None:
    """Publishes df's days in place of those of the table, other days stay; readers (load of parts) see all days or none."""
    commit(df, path, "day")


CALIBRATION = T.StructType([
    T.StructField("created_at", T.StringType()), T.StructField("model_version", T.StringType()), T.StructField("n_samples", T.LongType()),
    T.StructField("curve_x", T.ArrayType(T.DoubleType())), T.StructField("curve_y", T.ArrayType(T.DoubleType())), T.StructField("p90_delta_min", T.DoubleType()),
])


def write_calibration(spark: SparkSession, calibration: dict | None, version: str, created_at: str, path: str) -> None:
    """Publishes the model's calibration beside those it had; None takes all of the model's away."""
    rows = [] if calibration is None else [(created_at, version, calibration["n_samples"], calibration["curve_x"], calibration["curve_y"], calibration["p90_delta_min"])]
    df = spark.createDataFrame(rows, CALIBRATION).coalesce(1)
    commit(df, path, "model_version", "append" if rows else "replace", [version])


def read_calibrations(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """All calibrations, or a model's; one that a newer one follows held until that one's created_at."""
    out = load(spark, path, None if version is None else F.col("part") == version)
    return spark.createDataFrame([], CALIBRATION) if out is None else out


def read_calibration(spark: SparkSession, path: str, version: str) -> dict | None:
    """The model's newest calibration; None, which means identity, if there is none for this model."""
    row = read_calibrations(spark, path, version).orderBy(F.desc("created_at")).limit(1).collect()
    return row[0].asDict() if row else None


def new_months(have: DataFrame, available: DataFrame) -> DataFrame:
    return available.select("month").distinct().join(have.select("month").distinct(), "month", "left_anti").orderBy("month")


def version_order(version: str) -> Column:
    """What versions are ordered by: the first number in them, then the text, so that v10 follows v9."""
    return F.struct(F.coalesce(F.regexp_extract(version, r"\d+", 0).try_cast("long"), F.lit(-1)), F.col(version))


def latest_version(registry: DataFrame) -> DataFrame:
    """One row: the newest version, see version_order."""
    return registry.agg(F.max_by("version", version_order("version")).alias("version"))


def rename_stations(stops: DataFrame, stations: DataFrame) -> DataFrame:
    """stops under the station dimension's own names, by eva; a station that it lacks has none. The dimension's size is
    that of a rail network; Spark broadcasts it where that is below its limit."""
    return stops.drop("station_name").join(stations.select("eva", "station_name"), "eva", "left")
