"""Queries of what was known at the seal, and of the stream that seals by it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import add_calendar_features, holidays
from ..operators import baseline as b
from ..operators import history as h
from ..operators import sealing as s
from ..plans import models as pm
from ..sources import adapters as a
from ..sources import tables as t
from ..sources.parts import load
from ..streaming import streams as st
from .history import naive, round_sql, rounded
from .live import CURVE_X, CURVE_Y, HISTORY, INTERPOLATED, LIVE_COLUMNS, latest_sql, lookup_sql
from .models import BUNDLE_FEATURES, frame
from .registry import query
from .streams import as_stream

#: When versions of the statistics were published; each holds the stops of the days before.
SNAPSHOTS = ("2024-01-10 03:00:00", "2024-01-18 03:00:00")
OVERLAYS = ("2024-01-12 04:00:00", "2024-01-20 04:00:00")


def versions(spark, d, published):
    """Statistics of several versions, stored, as the lookups read them."""
    stops = a.stops_events(spark, d).where(~F.col("is_canceled")).withColumn("event_date", F.to_date("time"))
    out = None
    for at in published:
        one = b.snapshot(stops.where(F.col("event_date") < F.lit(at[:10]).cast("date")), h.latest_stats).withColumn("published_at", F.lit(at).cast("timestamp"))
        out = one if out is None else out.unionByName(one)
    return t.written(out, "versions")


def plan(spark, d):
    p = a.predictions_events(spark, d)
    return p.select("stop_id", "station_name", "train_type", "train_number", "scheduled_time", F.to_date("scheduled_time").alias("event_date"))


def versions_sql(name, published):
    """DuckDB: the versions as one table, each with the time that it was the newest."""
    ends = [*published[1:], "9999-01-01 00:00:00"]
    ctes, rows = [], []
    for i, (at, end) in enumerate(zip(published, ends)):
        src = f"{name}_stops{i}"
        ctes.append(f"{src} AS (SELECT *, CAST(time AS DATE) AS event_date FROM stops WHERE NOT is_canceled AND CAST(time AS DATE) < DATE '{at[:10]}')")
        ctes.append(latest_sql(f"{name}{i}", src))
        rows.append(f"SELECT *, TIMESTAMP '{at}' AS since, TIMESTAMP '{end}' AS until FROM {name}{i}")
    return f"{', '.join(ctes)}, {name} AS ({' UNION ALL '.join(rows)})"


PLAN = "requests AS (SELECT stop_id AS id, *, CAST(scheduled_time AS DATE) AS event_date, date_trunc('hour', scheduled_time) - INTERVAL 115 MINUTE AS seal FROM predictions)"
KNOWN = """one AS (
  SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY stop_id, observed_at ORDER BY changed_time DESC NULLS LAST, is_canceled DESC) = 1
), told AS (
  SELECT stop_id, observed_at, changed_time, is_canceled FROM one
  UNION ALL SELECT stop_id, NULL, NULL, false FROM predictions
), spans AS (
  SELECT *, lead(observed_at) OVER (PARTITION BY stop_id ORDER BY observed_at NULLS FIRST) AS known_until FROM told
), seen AS (
  SELECT p.station_name, p.train_type, greatest(p.predicted_at, coalesce(s.observed_at, p.predicted_at)) AS known_from, known_until, s.is_canceled,
         coalesce(s.changed_time, p.scheduled_time) AS time, coalesce(trunc(epoch_us(s.changed_time - p.scheduled_time) / 60000000.0), 0)::BIGINT AS delay_in_min
  FROM predictions p JOIN spans s USING (stop_id)
), sealed AS (
  SELECT *, date_trunc('hour', time - INTERVAL 5 MINUTE) + INTERVAL 65 MINUTE AS seal FROM seen
), known AS (
  SELECT * FROM sealed WHERE known_from <= seal AND (known_until IS NULL OR known_until > seal)
)"""
STATE_AT = """state_at AS (
  SELECT seal, station_name, train_type, grouping(station_name, train_type) AS g, avg(delay_in_min) AS m, avg((delay_in_min >= 6)::INT) AS s, count(*) AS n
  FROM known WHERE NOT is_canceled GROUP BY GROUPING SETS ((seal, station_name), (seal, train_type), (seal))
)"""
AT = " AND r.seal >= {table}.since AND r.seal < {table}.until"


@query("known_by_seal", f"WITH {a.LOGS}, {KNOWN} SELECT station_name, train_type, time, delay_in_min, coalesce(is_canceled, false) AS is_canceled FROM known")
def known_by_seal(spark, d):
    return naive(s.known_by_seal(a.predictions_events(spark, d), a.changes_events(spark, d)), "time")


@query("seal_features", f"""WITH {a.LOGS}, {PLAN}, {KNOWN}, {STATE_AT}, {versions_sql('snap', SNAPSHOTS)}, {versions_sql('overlay', OVERLAYS)}, x AS ({lookup_sql(AT)}), live AS (
  SELECT r.id, s.m AS station_live_mean_delay_60m, s.s AS station_live_delayed_share_60m, coalesce(s.n, 0) AS station_live_n_60m, y.m AS type_live_mean_delay_60m, y.s AS type_live_delayed_share_60m,
         n.m AS network_live_mean_delay_60m, n.s AS network_live_delayed_share_60m
  FROM requests r LEFT JOIN state_at s ON s.g = 1 AND s.seal = r.seal AND s.station_name = r.station_name LEFT JOIN state_at y ON y.g = 2 AND y.seal = r.seal AND y.train_type = r.train_type
  LEFT JOIN state_at n ON n.g = 3 AND n.seal = r.seal
) SELECT x.id AS stop_id, x.* EXCLUDE (id), {round_sql(LIVE_COLUMNS)} FROM x JOIN live USING (id)""")
def seal_features(spark, d):
    """Every stop's features as of its own seal, from four versions of the statistics and the logs."""
    out = s.features_at_seal(plan(spark, d), a.predictions_events(spark, d), a.changes_events(spark, d), versions(spark, d, SNAPSHOTS), versions(spark, d, OVERLAYS))
    return rounded(out.select("stop_id", "coverage", *HISTORY, *LIVE_COLUMNS))


#: Fixed calibrations for the queries: model, since when, curve, offset.
CALIBRATIONS = [("v2", "2024-01-10 00:00:00", CURVE_X, CURVE_Y, 3.0), ("v1", "2024-01-12 00:00:00", [0.0, 1.0], [0.2, 0.7], 2.0), ("v2", "2024-01-15 00:00:00", [0.0, 1.0], [0.1, 0.9], -1.0)]


def calibrations(spark, path=None):
    """The calibrations as published, with their times."""
    path = path or t.shared_path(spark, "calibrations")
    for version, at, xs, ys, delta in CALIBRATIONS:
        t.write_calibration(spark, {"n_samples": 1, "curve_x": xs, "curve_y": ys, "p90_delta_min": delta}, version, at, path)
    return t.read_calibrations(spark, path).withColumn("created_at", F.col("created_at").cast("timestamp"))


@query("seal_calibration", f"""WITH {a.LOGS}, c AS (
  SELECT *, CASE WHEN model_version = 'v2' AND predicted_at >= TIMESTAMP '2024-01-15' THEN 3 WHEN model_version = 'v2' AND predicted_at >= TIMESTAMP '2024-01-10' THEN 1
                 WHEN model_version = 'v1' AND predicted_at >= TIMESTAMP '2024-01-12' THEN 2 END AS c FROM predictions
) SELECT stop_id, CASE WHEN c IS NOT NULL THEN round(delay_probability, 6) END AS raw_delay_probability, CASE WHEN c IS NOT NULL THEN delay_p90_min::DOUBLE END AS raw_delay_p90_min,
  round(CASE c WHEN 1 THEN {INTERPOLATED.format(p='delay_probability')} WHEN 2 THEN 0.2 + 0.5 * delay_probability WHEN 3 THEN 0.1 + 0.8 * delay_probability ELSE delay_probability END, 6) AS delay_probability,
  CASE WHEN c IS NULL THEN delay_p90_min ELSE greatest(delay_p50_min, delay_p90_min + CASE c WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE -1 END) END::DOUBLE AS delay_p90_min FROM c""")
def seal_calibration(spark, d):
    p = a.predictions_events(spark, d).drop("raw_delay_probability", "raw_delay_p90_min")
    return rounded(s.calibrated_at_seal(p, calibrations(spark)).select("stop_id", "raw_delay_probability", "raw_delay_p90_min", "delay_probability", "delay_p90_min"))


SEALED = ["stop_id", "predicted_at", "coverage", "model_version", *BUNDLE_FEATURES, "delay_probability", "delay_p50_min", "delay_p90_min", "raw_delay_probability", "raw_delay_p90_min"]


def sealer(spark, d):
    """From planned stops to what is sealed of them: features and calibration as of the seal, scores of a bundle that was
    saved and loaded again."""
    f, path = frame(spark, d), t.shared_path(spark, "bundles")
    pm.Bundle("v2", BUNDLE_FEATURES).fit(f.where("fold_month = 'train'"), rounds=2, boost_rounds=2).save(path)
    bundle, curves, days = pm.Bundle.load(spark, path), calibrations(spark), holidays(spark, a.HORIZON_YEAR)
    logs, stats = (a.predictions_events(spark, d), a.changes_events(spark, d)), (versions(spark, d, SNAPSHOTS), versions(spark, d, OVERLAYS))

    def seal(stops):
        known = s.features_at_seal(add_calendar_features(stops.drop("event_date"), days), *logs, *stats)
        out = bundle.score(known).withColumnsRenamed({"p50": "delay_p50_min", "p90": "delay_p90_min"})
        out = out.withColumns({"model_version": F.lit(bundle.version), "predicted_at": s.seal_time(F.col("scheduled_time"))})
        return s.calibrated_at_seal(out, curves).select(*SEALED)

    return seal


def sealed(spark, d, seal):
    """The planned stops after now, as a stream of two batches with stops that come twice, sealed; some of the second
    batch's are in the first."""
    stops = plan(spark, d).where(F.col("scheduled_time") >= a.now())
    first, second = (stops.where(c) for c in (F.col("stop_id").cast("long") % 2 == 0, F.col("stop_id").cast("long") % 3 == 0))
    rest = stops.where((F.col("stop_id").cast("long") % 2 != 0) & (F.col("stop_id").cast("long") % 3 != 0))
    path = t.shared_path(spark, "sealed")
    st.seal_batches(as_stream([first, second.unionByName(rest)]), seal, path, t.shared_path(spark, "progress"))
    return load(spark, path)


@query("stream_seal_bundle")
def stream_seal_bundle(spark, d):
    """Planned stops, as a stream, sealed once each by what was known at their seals, raw outputs kept."""
    return naive(sealed(spark, d, sealer(spark, d)), "predicted_at")
