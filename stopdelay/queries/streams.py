"""Queries that run the streams over the logs, as written, to their end, and of timetable documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import adapters as a
from ..sources import tables as t
from ..sources import timetable as x
from ..sources.parts import load
from ..streaming import streams as st
from .history import naive, rounded
from .live import fixed
from .registry import SQL, query


#: Files of a part; a micro-batch reads one part.
FILES = 8


def as_stream(parts: list[DataFrame]) -> DataFrame:
    """The parts, written one after the other, as a stream of a part a batch."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = t.shared_path(spark, "stream")
    for part in parts:
        part.repartition(FILES).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(path)


def halves(df: DataFrame, order: str, *more: DataFrame) -> list[DataFrame]:
    """What is before now, and the rest, of df and of each further frame."""
    return [x.where(c) for c in (F.col(order) < a.now(), F.col(order) >= a.now()) for x in (df, *more)]


def clock(df: DataFrame, order: str) -> DataFrame:
    """Rows of a stop and station called clock, from two months on: they let the watermark pass all others."""
    later = a.now() + F.make_dt_interval(days=F.lit(60))
    row = [later.alias(f.name) if f.name == order else F.lit({"is_canceled": False, "stop_id": "clock", "station_name": "clock"}.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema]
    return df.sparkSession.range(FILES).select(*row)


def drained(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    sink, checkpoint = t.shared_path(spark, "sink"), t.shared_path(spark, "progress")
    st.run_available(stream, sink, checkpoint)
    return spark.read.schema(stream.schema).parquet(sink)


@query("stream_first_seal", f"WITH {a.LOGS} SELECT stop_id, predicted_at, delay_probability FROM predictions")
def stream_first_seal(spark, d):
    """Every prediction sealed again an hour later with another score; the stream keeps the first."""
    p = a.predictions_events(spark, d).select("stop_id", "predicted_at", "delay_probability")
    again = p.withColumns({"predicted_at": F.col("predicted_at") + F.make_dt_interval(hours=F.lit(1)), "delay_probability": F.lit(2.0)})
    return naive(drained(st.first_seal_stream(as_stream(halves(p, "predicted_at", again)))), "predicted_at")


@query("stream_latest_change", f"WITH {a.LOGS} SELECT stop_id, observed_at, changed_time, is_canceled FROM latest")
def stream_latest_change(spark, d):
    c = a.changes_events(spark, d).drop("day")
    table, progress = (t.shared_path(spark, x) for x in ("latest", "progress"))
    st.latest_change_stream(as_stream(halves(c, "observed_at")), table, progress)
    return naive(st.latest_so_far(spark, table), "observed_at", "changed_time")


@query("stream_netstate", f"""WITH {a.STOPS} SELECT station_name, time_bucket(INTERVAL 5 MINUTE, time) + to_minutes(5 * k) AS window_end, round(avg(delay_in_min), 6) AS mean_delay_60m,
  round(avg((delay_in_min >= 6)::INT), 6) AS delayed_share_60m, count(*) AS n_60m FROM stops, range(1, 13) AS r(k) WHERE NOT is_canceled GROUP BY ALL""".replace("5 * k", "CAST(5 * k AS INTEGER)"))
def stream_netstate(spark, d):
    s = a.stops_events(spark, d).select("station_name", "time", "delay_in_min", "is_canceled")
    return rounded(naive(drained(st.network_state_stream(as_stream([*halves(s, "time"), clock(s, "time")]), ["station_name"])), "window_end")).where("station_name <> 'clock'")


@query("stream_ground_truth", f"WITH {a.LOGS} SELECT stop_id, predicted_at, changed_time, is_canceled, actual_delay_min FROM truth")
def stream_ground_truth(spark, d):
    p, c = a.predictions_events(spark, d).select("stop_id", "scheduled_time", "predicted_at"), a.changes_events(spark, d).drop("day")
    emitted = drained(st.ground_truth_stream(*[as_stream([*halves(df, at), clock(df, at)]) for df, at in ((p, "predicted_at"), (c, "observed_at"))]))
    return naive(st.settled_truth(emitted.where("stop_id <> 'clock'")), "predicted_at", "changed_time").drop("scheduled_time")


@query("stream_daily_scores", f"SELECT * FROM ({SQL['daily_report']}) LEFT JOIN ({SQL['daily_report_raw']}) USING (day)")
def stream_daily_scores(spark, d):
    """The daily job with its whole report, run twice over a log that grows between the runs; days are partitions of its table."""
    p, c = a.predictions_events(spark, d), a.changes_events(spark, d)
    log, progress, table = (t.shared_path(spark, x) for x in ("log", "progress", "scores"))
    for part in halves(p, "predicted_at"):
        t.write_log(part, log)
        st.daily_scores(spark, log, progress, st.whole_report(spark, log, c), table)
    return fixed(load(spark, table))


@query("stream_seal", f"WITH {a.LOGS} SELECT stop_id, station_name, predicted_at, delay_probability FROM predictions WHERE CAST(stop_id AS BIGINT) % 4 <> 0")
def stream_seal(spark, d):
    """Planned stops against a table of scores; stops that it lacks aren't sealed."""
    p = a.predictions_events(spark, d)
    scores = p.where(F.col("raw_delay_probability").isNotNull()).select("stop_id", "delay_probability")
    plan = as_stream(halves(p.select("stop_id", "station_name", "scheduled_time"), "scheduled_time"))
    sealed = st.seal_stream(plan, lambda s: s.join(scores, "stop_id", "left"), lambda s: s, F.col("scheduled_time") - F.make_dt_interval(hours=F.lit(2)))
    return naive(drained(sealed).select("stop_id", "station_name", "predicted_at", "delay_probability"), "predicted_at")


def documents(spark, d, changes: bool = False):
    """A timetable document for each station and hour, as the service has them, written from the stops."""
    s = a.stops_events(spark, d).withColumn("at", F.date_format(F.col("time"), "yyMMddHHmm"))
    i = F.col("id").cast("long")
    time = F.concat(F.lit(' ct="' if changes else ' pt="'), F.col("at"), F.lit('"'))
    event = F.concat(time, F.when(F.col("is_canceled"), F.lit(' cs="c"')).otherwise(F.lit("")), F.lit(' l="7"'))
    path = F.when(i % 6 != 0, F.concat(F.lit(' ppth="'), F.array_join(F.array_repeat(F.lit("x"), (i % 4 + 1).cast("int")), "|"), F.lit('"'))).otherwise(F.lit(""))
    stop = F.concat(
        F.lit('<s id="'), F.col("id"), F.lit('"><tl c="'), F.col("train_type"), F.lit('" n="'), F.col("train_number"), F.lit('"/>'),
        F.when(i % 3 != 1, F.concat(F.lit("<ar"), event, path, F.lit("/>"))).otherwise(F.lit("")), F.when(i % 3 != 2, F.concat(F.lit("<dp"), event, F.lit("/>"))).otherwise(F.lit("")), F.lit("</s>"),
    )
    g_ = s.groupBy("station_name", F.date_trunc("HOUR", "time").alias("hour")).agg(F.concat_ws("", F.collect_list(stop)).alias("body"))
    return g_.select(F.concat(F.lit('<timetable station="'), "station_name", F.lit('">'), "body", F.lit("</timetable>")).alias("xml"))


WALL = "CAST((date_trunc('minute', time) AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS TIMESTAMP)"


@query("xml_plan", f"""WITH {a.STOPS}, s AS (SELECT *, CAST(id AS BIGINT) AS i FROM stops) SELECT id AS stop_id, station_name, train_type, train_number, {WALL} AS scheduled_time, i % 3 <> 2 AS has_departure, '7' AS line,
  CASE WHEN i % 3 = 1 THEN 1 WHEN i % 6 <> 0 THEN (i % 4 + 2)::INTEGER END AS station_num FROM s""")
def xml_plan(spark, d):
    return naive(x.parse_plan(documents(spark, d)), "scheduled_time")


@query("xml_changes", f"WITH {a.STOPS} SELECT id AS stop_id, {WALL} AS changed_time, is_canceled FROM stops")
def xml_changes(spark, d):
    return naive(x.parse_changes(documents(spark, d, True)), "changed_time")


