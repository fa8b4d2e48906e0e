"""Timetable documents (XML) as planned stops and changes; batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import ZONE, zone_to_utc

EVENT = "struct<_pt: string, _ct: string, _cs: string, _ppth: string, _l: string>"
DOCUMENT = f"struct<_station: string, s: array<struct<_id: string, tl: struct<_c: string, _n: string>, ar: {EVENT}, dp: {EVENT}>>>"


def _stops(docs: DataFrame, xml: str) -> DataFrame:
    """A row per stop of the documents in column `xml`; documents that can't be read have none."""
    parsed = docs.select(F.from_xml(F.col(xml), DOCUMENT, {"rowTag": "timetable", "mode": "PERMISSIVE"}).alias("_d"))
    return parsed.select(F.col("_d._station").alias("_station"), F.explode("_d.s").alias("_s"))


def _instant(c: Column, zone: str) -> Column:
    return zone_to_utc(F.try_to_timestamp(c, F.lit("yyMMddHHmm")).cast("timestamp_ntz"), zone)


def parse_plan(docs: DataFrame, xml: str = "xml", zone: str = ZONE) -> DataFrame:
    """Planned stops: the departure's time and line, else the arrival's; stops without train, event or time are left out.

    station_num is 1 without an arrival, else one more than the stations of its path, null if it has none.
    """
    s = _stops(docs, xml)
    ar, dp = F.col("_s.ar"), F.col("_s.dp")
    event = F.coalesce(dp, ar)
    path = F.when(F.length(ar["_ppth"]) > 0, ar["_ppth"])
    out = s.where(F.col("_s.tl").isNotNull() & event.isNotNull() & (F.length(event["_pt"]) > 0))
    return out.select(
        F.col("_s._id").alias("stop_id"), F.coalesce("_station", F.lit("")).alias("station_name"), F.coalesce("_s.tl._c", F.lit("")).alias("train_type"), F.coalesce("_s.tl._n", F.lit("")).alias("train_number"),
        _instant(event["_pt"], zone).alias("scheduled_time"), dp.isNotNull().alias("has_departure"), event["_l"].alias("line"),
        F.when(ar.isNull(), F.lit(1)).otherwise(F.size(F.split(path, r"\|")) + F.lit(1)).alias("_num"), path.isNull().alias("_none"), ar.isNull().alias("_origin"),
    ).withColumn("station_num", F.when(F.col("_origin") | ~F.col("_none"), F.col("_num"))).drop("_num", "_none", "_origin")


def parse_changes(docs: DataFrame, xml: str = "xml", zone: str = ZONE) -> DataFrame:
    """Changes: the departure's changed time, else the arrival's, else null; canceled if either event is."""
    s = _stops(docs, xml)
    ar, dp = F.col("_s.ar"), F.col("_s.dp")
    changed = F.coalesce(*[F.when(F.length(e["_ct"]) > 0, e["_ct"]) for e in (dp, ar)])
    gone = F.coalesce(dp["_cs"] == "c", F.lit(False)) | F.coalesce(ar["_cs"] == "c", F.lit(False))
    return s.where(ar.isNotNull() | dp.isNotNull()).select(F.col("_s._id").alias("stop_id"), _instant(changed, zone).alias("changed_time"), gone.alias("is_canceled"))
