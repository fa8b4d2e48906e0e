"""Queries of scans, cleaning, validation and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import month_key, zone_to_utc
from ..operators import clean as c
from ..operators import profiles as p
from ..sources import adapters as a
from ..sources import tables as t
from .history import naive, rounded
from .registry import query

COLUMNS = "id, station_name, train_type, train_number, train_line_station_num, delay_in_min, time, departure_planned_time, arrival_planned_time, is_canceled"
TIMES = ("time", "departure_planned_time", "arrival_planned_time")


@query("scan_monthly", f"WITH {a.LINES} SELECT strftime(time, '%Y-%m') AS month, count(*) AS n, sum(delay_in_min)::BIGINT AS delay FROM lines GROUP BY ALL")
def scan_monthly(spark, d):
    """Monthly files, as written and scanned again: the month is the file's."""
    path = t.write_monthly(a.stops_lineitem(spark, d))
    return t.read_monthly(spark, path).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("delay_in_min").alias("delay"))


@query("panel_names", f"WITH {a.LINES} SELECT DISTINCT station_name FROM lines")
def panel_names(spark, d):
    return a.stops_lineitem(spark, d).select("station_name").distinct().orderBy("station_name")


@query("berlin_time", "SELECT event_id, CAST((ts AT TIME ZONE 'Europe/Berlin') AT TIME ZONE 'UTC' AS TIMESTAMP) AS utc FROM events")
def berlin_time(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return naive(e.select("event_id", zone_to_utc(F.col("ts").cast("timestamp_ntz")).alias("utc")), "utc")


GOOD = "station_name IS NOT NULL AND train_type IS NOT NULL AND time IS NOT NULL AND delay_in_min BETWEEN -60 AND 1440"


@query("drop_bad_rows", f"WITH {a.RAW} SELECT {COLUMNS} FROM raw WHERE {GOOD}")
def drop_bad_rows(spark, d):
    return naive(c.drop_bad_rows(a.stops_events_raw(spark, d)), *TIMES)


@query("dedupe_stops", f"WITH {a.RAW} SELECT DISTINCT {COLUMNS} FROM raw")
def dedupe_stops(spark, d):
    return naive(c.dedupe(a.stops_events_raw(spark, d)), *TIMES).select(*COLUMNS.split(", "))


PANEL = f"""WITH {a.LINES}, panel AS (SELECT station_name FROM lines GROUP BY 1 HAVING count(DISTINCT strftime(time, '%Y-%m')) >= (SELECT count(DISTINCT strftime(time, '%Y-%m')) FROM lines))"""


@query("station_panel", PANEL + " SELECT station_name FROM panel")
def station_panel(spark, d):
    return c.station_panel(a.stops_lineitem(spark, d))


@query("panel_filter", PANEL + " SELECT station_name, count(*) AS n FROM lines WHERE station_name IN (SELECT station_name FROM panel) GROUP BY 1")
def panel_filter(spark, d):
    s = a.stops_lineitem(spark, d)
    return c.restrict_to_panel(s, c.station_panel(s)).groupBy("station_name").agg(F.count(F.lit(1)).alias("n"))


@query("build_stops", f"""WITH {a.RAW}, panel AS (SELECT station_name FROM raw WHERE station_name IS NOT NULL GROUP BY 1
  HAVING count(DISTINCT strftime(time, '%Y-%m')) >= (SELECT count(DISTINCT strftime(time, '%Y-%m')) FROM raw WHERE station_name IS NOT NULL))
SELECT DISTINCT {COLUMNS} FROM raw WHERE {GOOD} AND station_name IN (SELECT station_name FROM panel)""")
def build_stops(spark, d):
    return naive(c.build_stops(a.stops_events_raw(spark, d)), *TIMES).select(*COLUMNS.split(", "))


def schema_sql():
    """The raw stops' own types beside the expected ones: times are instants here, and some columns are missing."""
    own = {**{c: ("string", c) for c in ("station_name", "train_type", "train_number", "id")}, "delay_in_min": ("int", "delay_in_min"), "train_line_station_num": ("int", "train_line_station_num"), "is_canceled": ("boolean", "is_canceled"), **{c: ("timestamp", c) for c in TIMES}}
    rows = []
    for col, kind in c.RAW_SCHEMA.items():
        found, value = own.get(col, (None, "NULL"))
        rows.append(f"SELECT '{col}' AS \"column\", '{kind}' AS expected, {f"'{found}'" if found else 'NULL::VARCHAR'} AS found, {str(found == kind).lower()} AS passed, count({value}) AS \"values\" FROM raw")
    return f"WITH {a.RAW} " + " UNION ALL ".join(rows)


@query("check_schema", schema_sql())
def check_schema(spark, d):
    return c.check_schema(a.stops_events_raw(spark, d))


START, END = "2024-01-05", "2024-01-25"
NULLS = "greatest(avg((station_name IS NULL)::INT), avg((train_type IS NULL)::INT), avg((time IS NULL)::INT), avg((id IS NULL)::INT))"
BAD = "avg(coalesce(delay_in_min NOT BETWEEN -60 AND 1440, false)::INT)"
DUPLICATES = "(count(*) - count(DISTINCT id) - max((id IS NULL)::INT))"
OUTSIDE = f"count(*) FILTER (time NOT BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}')"


def _check(name, passed, value, d_sql):
    return f"WITH {a.RAW} SELECT '{name}' AS \"check\", {passed} AS passed, round(({value})::DOUBLE, 6) AS value FROM raw"


def _run(spark, d, name, **kw):
    return rounded(c.check(a.stops_events_raw(spark, d), name, **kw))


@query("check_not_null", _check("required_not_null", f"count(*) > 0 AND {NULLS} <= 0.03", NULLS, ""))
def check_not_null(spark, d):
    return _run(spark, d, "required_not_null", max_null_rate=0.03)


@query("check_delay_range", _check("delay_range", f"{BAD} <= 0.0001", BAD, ""))
def check_delay_range(spark, d):
    return _run(spark, d, "delay_range", max_bad_share=0.0001)


@query("check_duplicates", _check("duplicate_ids", f"{DUPLICATES} = 0", DUPLICATES, ""))
def check_duplicates(spark, d):
    return _run(spark, d, "duplicate_ids")


@query("check_time_range", _check("time_range", f"{OUTSIDE} = 0", OUTSIDE, ""))
def check_time_range(spark, d):
    return _run(spark, d, "time_range", start=F.lit(START).cast("timestamp"), end=F.lit(END).cast("timestamp"))


@query("validation_report", f"""WITH {a.RAW}, g AS (
  SELECT event_day, {NULLS} AS nn, {BAD} AS bad, {DUPLICATES} AS dup, {OUTSIDE} AS outside FROM (SELECT *, CAST(time AS DATE) AS event_day FROM raw) GROUP BY event_day
) SELECT event_day, u.* FROM g, LATERAL (VALUES ('required_not_null', nn <= 0.03, round(nn, 6)), ('delay_range', bad <= 0.0001, round(bad, 6)), ('duplicate_ids', dup = 0, dup::DOUBLE), ('time_range', outside = 0, outside::DOUBLE)) AS u("check", passed, value)""")
def validation_report(spark, d):
    s = a.stops_events_raw(spark, d).withColumn("event_day", F.to_date("time"))
    return rounded(c.validate(s, F.lit(START).cast("timestamp"), F.lit(END).cast("timestamp"), 0.03, 0.0001, ["event_day"]))


@query("monthly_profile", f"""WITH {a.LINES} SELECT strftime(time, '%Y-%m') AS month, count(*) AS n, count(DISTINCT station_name) AS stations,
  round(avg(is_canceled::INT), 6) AS cancel_rate, round(avg((delay_in_min >= 6)::INT), 6) AS late_rate FROM lines GROUP BY 1""")
def monthly_profile(spark, d):
    return rounded(p.monthly_profile(a.stops_lineitem(spark, d)))


def nearest(q, value="delay_in_min"):
    return f"list_sort(list({value}) FILTER ({value} IS NOT NULL))[CAST(round((count({value}) - 1) * {q}) AS INTEGER) + 1]"


@query("delay_distribution", f"""WITH {a.STOPS} SELECT count(*) AS n, {nearest(0.5)} AS p50, {nearest(0.9)} AS p90, {nearest(0.99)} AS p99, min(delay_in_min) AS lowest, max(delay_in_min) AS highest,
  round(avg((delay_in_min < 0)::INT), 6) AS negative_share, round(avg((delay_in_min >= 6)::INT), 6) AS late_share FROM stops""")
def delay_distribution(spark, d):
    return rounded(p.delay_distribution(a.stops_events(spark, d)))


@query("delay_histogram", f"WITH {a.STOPS} SELECT least(greatest(delay_in_min, -10), 60) AS delay, count(*) AS n FROM stops GROUP BY 1")
def delay_histogram(spark, d):
    return p.delay_histogram(a.stops_events(spark, d))


@query("profile_by_type", f"""WITH {a.STOPS} SELECT train_type, count(*) AS n, round(avg(delay_in_min), 6) AS mean_delay, round(avg((delay_in_min >= 6)::INT), 6) AS late_rate, round(avg(is_canceled::INT), 6) AS cancel_rate
  FROM stops GROUP BY 1 ORDER BY n DESC, train_type LIMIT 12""")
def profile_by_type(spark, d):
    return rounded(p.profile_by_type(a.stops_events(spark, d)))


@query("canceled_profile", f"""WITH {a.STOPS} SELECT is_canceled, count(*) AS n, round(avg((delay_in_min = 0)::INT), 6) AS zero_delay_share, round(avg(delay_in_min), 6) AS mean_delay FROM stops GROUP BY 1""")
def canceled_profile(spark, d):
    return rounded(p.canceled_profile(a.stops_events(spark, d)))


ALL = COLUMNS.split(", ")


@query("null_rates", f"WITH {a.RAW} " + " UNION ALL ".join(f"SELECT '{x}' AS \"column\", round(avg(({x} IS NULL)::INT), 6) AS null_rate FROM raw" for x in ALL))
def null_rates(spark, d):
    return rounded(p.null_rates(a.stops_events_raw(spark, d)))


@query("endpoint_nulls", f"""WITH {a.STOPS}, w AS (SELECT *, min(train_line_station_num) OVER (PARTITION BY train_number) AS first_stop FROM stops)
  SELECT train_line_station_num = first_stop AS is_first, count(*) AS n, round(avg((arrival_planned_time IS NULL)::INT), 6) AS arrival_null, round(avg((departure_planned_time IS NULL)::INT), 6) AS departure_null FROM w GROUP BY 1""")
def endpoint_nulls(spark, d):
    return rounded(p.endpoint_nulls(a.stops_events(spark, d), "train_number"))


@query("hourly_counts", f"WITH {a.STOPS} SELECT hour(time)::INTEGER AS hour, count(*) AS n FROM stops WHERE CAST(time AS DATE) = DATE '2024-01-14' GROUP BY 1")
def hourly_counts(spark, d):
    return p.hourly_counts(a.stops_events(spark, d), "2024-01-14")


@query("station_rename", "SELECT s.s_suppkey, s.s_nationkey, upper(n.n_name) AS station_name FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey")
def station_rename(spark, d):
    """A feed's names replaced by the panel's, by the station's number."""
    feed = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.col("s_nationkey").alias("eva"), F.lit("feed name").alias("station_name"))
    dim = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("eva"), F.upper("n_name").alias("station_name"))
    return t.rename_stations(feed, dim).select("s_suppkey", F.col("eva").alias("s_nationkey"), "station_name")


@query("new_months", f"WITH {a.LINES}, {a.STOPS} SELECT DISTINCT strftime(time, '%Y-%m') AS month FROM lines WHERE strftime(time, '%Y-%m') NOT IN (SELECT strftime(l.time, '%Y-%m') FROM lines l WHERE l.station_name = 'S1')")
def new_months(spark, d):
    s = a.stops_lineitem(spark, d).withColumn("month", month_key(F.col("time")))
    return t.new_months(s.where("station_name = 'S1'").select("month"), s.select("month"))


