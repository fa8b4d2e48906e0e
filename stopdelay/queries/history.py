"""Queries of history, network state and the feature frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import ZONE, add_calendar_features, add_scheduled_time, holidays
from ..operators import history as h
from ..operators import netstate as n
from ..plans.features import build_feature_frame
from ..sources import adapters as a
from .registry import query


def planned(spark, d):
    s = a.stops_events(spark, d).where(~F.col("is_canceled")).transform(add_scheduled_time)
    return s.withColumn("event_date", F.to_date("scheduled_time"))


def rounded(df, *keep):
    """df with doubles of 6 digits: sums of doubles differ in the last ones by the order of the rows."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def rolled(prefix, keys, cte="daily"):
    """DuckDB: stats of each active day by range windows."""
    k = ", ".join(keys)
    cols = ", ".join(f"sum(delay_sum) OVER w{w} / sum(n) OVER w{w} AS {prefix}_mean_delay_{w}d, sum(delayed_sum) OVER w{w} / sum(n) OVER w{w} AS {prefix}_delayed_rate_{w}d" for w in (14, 30))
    windows = ", ".join(f"w{w} AS (PARTITION BY {k} ORDER BY event_date RANGE BETWEEN INTERVAL {w - 1} DAY PRECEDING AND CURRENT ROW)" for w in (14, 30))
    return f"""daily_{prefix} AS (
  SELECT {k}, event_date, sum(delay_in_min)::DOUBLE AS delay_sum, count(*) FILTER (delay_in_min >= 6)::DOUBLE AS delayed_sum, count(*) AS n FROM planned GROUP BY {k}, event_date
), rolling_{prefix} AS (
  SELECT {k}, event_date, event_date + 1 AS join_date, {cols}, (sum(n) OVER w30)::BIGINT AS {prefix}_count_30d FROM daily_{prefix} WINDOW {windows}
)"""


def round_sql(cols):
    return ", ".join(f"round({c}, 6) AS {c}" if "count" not in c and not c.endswith("_n_60m") else c for c in cols)


for prefix, keys in h.GRANULARITIES.items():
    k = ", ".join(keys)

    @query(f"daily_{prefix}", f"WITH {a.PLANNED} SELECT {k}, event_date, sum(delay_in_min)::BIGINT AS delay_sum, count(*) FILTER (delay_in_min >= 6) AS delayed_sum, count(*) AS n FROM planned GROUP BY {k}, event_date")
    def daily(spark, d, keys=keys):
        return h.daily_aggregates(planned(spark, d), keys)

    @query(f"rolling_stats_{prefix}", f"WITH {a.PLANNED}, {rolled(prefix, keys)} SELECT {k}, event_date, join_date, {round_sql(h.stat_columns(prefix))} FROM rolling_{prefix}")
    def stats(spark, d, keys=keys, prefix=prefix):
        return rounded(h.rolling_from_daily(h.daily_aggregates(planned(spark, d), keys), keys, prefix))

    @query(
        f"rolling_{prefix}",
        f"""WITH {a.PLANNED}, {rolled(prefix, keys)}, hit AS (
  SELECT p.id, r.* EXCLUDE (event_date), p.event_date - r.join_date AS age
  FROM planned p ASOF LEFT JOIN rolling_{prefix} r ON {" AND ".join(f"p.{x} = r.{x}" for x in keys)} AND p.event_date >= r.join_date
) SELECT id, {", ".join(f"CASE WHEN age <= {c.rsplit('_', 1)[1][:-1]} THEN {'' if 'count' in c else 'round('}{c}{'' if 'count' in c else ', 6)'} END AS {c}" for c in h.stat_columns(prefix))} FROM hit""",
    )
    def rolling(spark, d, keys=keys, prefix=prefix):
        return rounded(h.attach_rolling(planned(spark, d), prefix, keys).select("id", *h.stat_columns(prefix)))

    @query(f"snapshot_{prefix}", f"WITH {a.PLANNED}, {rolled(prefix, keys)} SELECT {k}, join_date, {round_sql(h.stat_columns(prefix))} FROM rolling_{prefix} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY join_date DESC) = 1")
    def snap(spark, d, keys=keys, prefix=prefix):
        return rounded(h.latest_stats(planned(spark, d), keys, prefix))


ASOF = f"""WITH {a.LOGS}
SELECT p.stop_id, p.predicted_at, c.observed_at, c.change_delay FROM predictions p ASOF LEFT JOIN (
  SELECT l.station_name, c.observed_at, max(l.delay_in_min) AS change_delay FROM changes c JOIN logged l ON c.stop_id = l.id GROUP BY ALL
) c ON p.station_name = c.station_name AND p.predicted_at >= c.observed_at"""


@query("asof_backward", ASOF)
def asof_backward(spark, d):
    """The last change observed at the station before each seal; the stations' rows are dealt out by day as well."""
    p = a.predictions_events(spark, d).select("stop_id", "station_name", "predicted_at")
    c = a.changes_events(spark, d).join(a.stops_events(spark, d).select(F.col("id").alias("stop_id"), "station_name", "delay_in_min"), "stop_id")
    c = c.groupBy("station_name", "observed_at").agg(F.max("delay_in_min").alias("change_delay"))
    out = h.asof_join(p, c, "predicted_at", "observed_at", ["station_name"], every="DAY")
    return out.select("stop_id", F.col("predicted_at").cast("timestamp_ntz").alias("predicted_at"), F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), "change_delay")


def state_sql(scope, keys):
    """DuckDB: the hour before each seal, by a range join."""
    on = "".join(f" AND o.{x} = s.{x}" for x in keys)
    count = f", count(o.delay_in_min) AS {scope}_n_60m" if scope == "station_live" else ""
    return f"""{scope} AS (
  SELECT s.id, avg(o.delay_in_min) AS {scope}_mean_delay_60m, avg(CASE WHEN o.delay_in_min >= 6 THEN 1.0 WHEN o.delay_in_min < 6 THEN 0.0 END) AS {scope}_delayed_share_60m{count}
  FROM (SELECT *, date_trunc('hour', scheduled_time) - INTERVAL 115 MINUTE AS seal FROM planned) s
  LEFT JOIN planned o ON o.time >= s.seal - INTERVAL 60 MINUTE AND o.time < s.seal{on} GROUP BY s.id
)"""


for scope, keys in n.SCOPES.items():

    @query(f"netstate_{scope.removesuffix('_live')}", f"WITH {a.PLANNED}, {state_sql(scope, keys)} SELECT id, {round_sql(n.state_columns(scope))} FROM {scope}")
    def netstate(spark, d, scope=scope):
        return rounded(n.add_network_state(planned(spark, d), scopes=[scope]).select("id", *n.state_columns(scope)))


@query("netstate_lead30", f"""WITH {a.PLANNED} SELECT s.id, round(avg(o.delay_in_min), 6) AS station_live_mean_delay_60m, count(o.delay_in_min) AS station_live_n_60m
  FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, scheduled_time - INTERVAL 30 MINUTE) AS seal FROM planned) s
  LEFT JOIN planned o ON o.time >= s.seal - INTERVAL 60 MINUTE AND o.time < s.seal AND o.station_name = s.station_name GROUP BY s.id""")
def netstate_lead30(spark, d):
    return rounded(n.add_network_state(planned(spark, d), 30, ["station_live"]).select("id", "station_live_mean_delay_60m", "station_live_n_60m"))


BUCKETS = "SELECT station_name, time_bucket(INTERVAL 5 MINUTE, time) + INTERVAL 5 MINUTE AS avail, sum(delay_in_min)::BIGINT AS delay, count(*) FILTER (delay_in_min >= 6) AS delayed, count(*) AS n FROM planned GROUP BY ALL"


def naive(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("buckets_5m", f"WITH {a.PLANNED} {BUCKETS}")
def buckets_5m(spark, d):
    return naive(n.bucketed(planned(spark, d), ["station_name"]), "avail")


@query("cumulative_buckets", f"WITH {a.PLANNED}, b AS ({BUCKETS}) SELECT station_name, avail, (sum(delay) OVER w)::BIGINT AS delay, (sum(delayed) OVER w)::BIGINT AS delayed, (sum(n) OVER w)::BIGINT AS n FROM b WINDOW w AS (PARTITION BY station_name ORDER BY avail)")
def cumulative_buckets(spark, d):
    return naive(n.cumulative(n.bucketed(planned(spark, d), ["station_name"]), ["station_name"]), "avail")


#: The nine national holidays of the adapters' years, as the calendar has them.
HOLIDAYS = """(VALUES (DATE '2024-01-01'), (DATE '2024-03-29'), (DATE '2024-04-01'), (DATE '2024-05-01'), (DATE '2024-05-09'), (DATE '2024-05-20'), (DATE '2024-10-03'), (DATE '2024-12-25'), (DATE '2024-12-26')) AS hol(holiday)"""
CALENDAR = f"""hour(scheduled_time)::INTEGER AS scheduled_hour, isodow(scheduled_time)::INTEGER AS weekday, month(scheduled_time)::INTEGER AS month, isodow(scheduled_time) >= 6 AS is_weekend,
         event_date IN (SELECT holiday FROM {HOLIDAYS}) AS is_holiday"""


@query("calendar_features", f"WITH {a.PLANNED} SELECT id, event_date, {CALENDAR} FROM planned")
def calendar_features(spark, d):
    s = add_calendar_features(planned(spark, d).drop("event_date"), holidays(spark, a.HORIZON_YEAR))
    return s.select("id", "event_date", "scheduled_hour", "weekday", "month", "is_weekend", "is_holiday")


def frame_sql(local: bool = False):
    """local: of the calendar of Berlin, which the adapters' month keeps an hour ahead."""
    source, calendar, wall = a.PLANNED, CALENDAR, "p.scheduled_time"
    if local:
        wall = "CAST(timezone('Europe/Berlin', timezone('UTC', p.scheduled_time)) AS TIMESTAMP)"
        source += f", local AS (SELECT p.* EXCLUDE (event_date), CAST({wall} AS DATE) AS event_date FROM planned p)"
        calendar = CALENDAR.replace("scheduled_time", wall)
    parts = [rolled(p, k) for p, k in h.GRANULARITIES.items()] + [state_sql(s, k) for s, k in n.SCOPES.items()]
    joins = "".join(f"\n  ASOF LEFT JOIN rolling_{p} {p} ON {' AND '.join(f'p.{x} = {p}.{x}' for x in k)} AND p.event_date >= {p}.join_date" for p, k in h.GRANULARITIES.items())
    hist = []
    for p in h.GRANULARITIES:
        for c in h.stat_columns(p):
            v = f"{p}.{c}" if "count" in c else f"round({p}.{c}, 6)"
            hist.append(f"CASE WHEN p.event_date - {p}.join_date <= {c.rsplit('_', 1)[1][:-1]} THEN {v} END AS {c}")
    state = [f"{s}.{c}" if c.endswith("_n_60m") else f"round({s}.{c}, 6) AS {c}" for s in n.SCOPES for c in n.state_columns(s)]
    sql = f"""WITH {source}, {", ".join(parts)}
SELECT p.id, p.station_name, p.train_type, p.train_number, p.train_line_station_num, p.scheduled_time, {calendar.replace("event_date", "p.event_date")}, {", ".join(hist)}, {", ".join(state)},
  p.delay_in_min >= 6 AS target_delayed6, p.delay_in_min AS target_delay_min, strftime({wall}, '%Y-%m') AS fold_month
FROM planned p{joins}
  JOIN station_live USING (id) JOIN type_live USING (id) JOIN network_live USING (id)"""
    return sql if not local else sql.replace("FROM planned GROUP BY", "FROM local GROUP BY").replace("FROM planned p\n", "FROM local p\n")


@query("feature_frame", frame_sql())
def feature_frame(spark, d):
    return naive(rounded(build_feature_frame(a.stops_events(spark, d), holidays(spark, a.HORIZON_YEAR))), "scheduled_time")


@query("feature_frame_local", frame_sql(local=True))
def feature_frame_local(spark, d):
    """The frame by the calendar of Berlin, whose days begin at 23:00 UTC here."""
    return naive(rounded(build_feature_frame(a.stops_events(spark, d), holidays(spark, a.HORIZON_YEAR), zone=ZONE)), "scheduled_time")
