"""Sealing by what was known at the seal."""

import datetime as dt

from pyspark.sql import functions as F

from stopdelay.operators import sealing as s
from stopdelay.queries import sealing as q
from stopdelay.sources import adapters as a
from stopdelay.sources import parts
from stopdelay.streaming import streams

D = "/root/testdata/sf0.001"
PRED = "stop_id string, station_name string, train_type string, scheduled_time timestamp, predicted_at timestamp"
CHANGE = "stop_id string, observed_at timestamp, changed_time timestamp, is_canceled boolean"
STATS = "granularity string, key1 string, key2 string, join_date date, m14 double, r14 double, m30 double, r30 double, n30 long, published_at timestamp"


def at(text):
    return dt.datetime.fromisoformat(f"2024-01-10 {text}")


def known(spark, predictions, changes):
    out = s.known_by_seal(spark.createDataFrame(predictions, PRED), spark.createDataFrame(changes, CHANGE))
    return sorted((r.time, r.delay_in_min, r.is_canceled) for r in out.collect())


def test_what_was_known(spark):
    p = [("a", "S", "T", at("10:00"), at("08:05"))]
    assert known(spark, p, []) == [(at("10:00"), 0, False)]  # on time until something else is known
    assert known(spark, p, [("a", at("10:04"), at("10:20"), False)]) == [(at("10:20"), 20, False)]
    # first known at half past: on time for the seal before, late for the one after
    assert known(spark, p, [("a", at("10:30"), at("10:20"), False)]) == [(at("10:00"), 0, False), (at("10:20"), 20, False)]
    assert known(spark, p, [("a", at("11:06"), at("10:20"), False)]) == [(at("10:00"), 0, False)]  # after both seals
    assert known(spark, p, [("a", at("10:04"), at("10:20"), False), ("a", at("11:06"), at("10:25"), False)]) == [(at("10:20"), 20, False)]
    # observed at the very seal counts, and the greater of two of one moment
    assert known(spark, p, [("a", at("10:05"), at("10:20"), False), ("a", at("10:05"), at("10:25"), False)]) == [(at("10:25"), 25, False)]
    # moved into the next seal's hour, where it is late by then
    assert known(spark, p, [("a", at("10:04"), at("11:10"), False)]) == [(at("11:10"), 70, False)]
    # a cancellation without a time stands at the schedule; nulls of the stop or moment are no change
    assert known(spark, p, [("a", at("09:00"), None, True), (None, at("09:00"), None, True), ("a", None, at("10:09"), False)]) == [(at("10:00"), 0, True)]
    # sealed after its own hour's seal: not in any state before; the first seal counts
    assert known(spark, [("a", "S", "T", at("10:00"), at("11:30"))], []) == []
    assert known(spark, [("a", "S", "T", at("10:00"), at("11:30")), ("a", "S", "T", at("10:00"), at("08:05"))], []) == [(at("10:00"), 0, False)]


def test_nothing_after_the_seal_is_seen(spark):
    """What comes to the logs and versions after a seal alters none of its features; what comes before does."""
    stops = spark.createDataFrame([("x", "S", "T", "1", at("13:20"), at("13:20").date())], "stop_id string, station_name string, train_type string, train_number string, scheduled_time timestamp, event_date date")
    p, c = [("a", "S", "T", at("10:30"), at("08:05")), ("b", "S", "T", at("10:40"), at("08:05"))], [("a", at("10:20"), at("10:50"), False)]
    stat = lambda mean, when: ("train", "T", "1", at("00:00").date(), mean, 0.5, mean, 0.5, 3, when)
    snap, over = [stat(1.0, at("02:00"))], [stat(2.0, at("03:00"))]

    def features(p=p, c=c, snap=snap, over=over):
        return s.features_at_seal(stops, spark.createDataFrame(p, PRED), spark.createDataFrame(c, CHANGE), spark.createDataFrame(snap, STATS), spark.createDataFrame(over, STATS)).first().asDict()

    base = features()  # the seal is at 11:05
    assert (base["train_mean_delay_14d"], base["coverage"]) == (2.0, "train")
    assert (base["station_live_mean_delay_60m"], base["station_live_n_60m"]) == (10.0, 2)
    later = features([*p, ("c", "S", "T", at("10:45"), at("11:06"))], [*c, ("b", at("11:06"), at("11:00"), False)], [*snap, stat(8.0, at("11:06"))], [*over, stat(9.0, at("11:06"))])
    assert later == base
    before = features(p, [*c, ("b", at("11:05"), at("11:00"), False)], snap, [*over, stat(9.0, at("11:05"))])
    assert (before["train_mean_delay_14d"], before["station_live_mean_delay_60m"]) == (9.0, 20.0)
    assert features(over=[stat(9.0, at("11:06"))])["train_mean_delay_14d"] == 1.0
    assert features(snap=[], over=[])["coverage"] == "cold"


def test_calibration_of_the_time(spark):
    rows = [("a", "v1", at("10:05"), 0.5, 2.0, 9.0), ("b", "v1", at("08:05"), 0.5, 2.0, 9.0), ("c", "v2", at("10:05"), 0.5, 2.0, 9.0), ("d", None, at("10:05"), None, None, None), ("e", "v1", at("12:05"), 0.0, 8.0, 9.0)]
    scored = spark.createDataFrame(rows, "stop_id string, model_version string, predicted_at timestamp, delay_probability double, delay_p50_min double, delay_p90_min double")
    form = "created_at timestamp, model_version string, n_samples long, curve_x array<double>, curve_y array<double>, p90_delta_min double"
    curves = [(at("09:00"), "v1", 1, [0.0, 1.0], [0.2, 0.4], 3.0), (at("12:00"), "v1", 1, [0.1], [0.7], -5.0)]

    def got(curves):
        out = s.calibrated_at_seal(scored, spark.createDataFrame(curves, form))
        return {r.stop_id: (r.delay_probability and round(r.delay_probability, 6), r.delay_p90_min, r.raw_delay_probability, r.raw_delay_p90_min) for r in out.collect()}

    assert got(curves) == {"a": (0.3, 12.0, 0.5, 9.0), "b": (0.5, 9.0, None, None), "c": (0.5, 9.0, None, None), "d": (None, None, None, None), "e": (0.7, 8.0, 0.0, 9.0)}
    assert got([])["a"] == (0.5, 9.0, None, None)


def test_batches_seal_as_one_job_does(spark, tmp_path):
    """The stream's rows are those of all stops at once; a run from the start over the same table adds nothing."""
    curves, path = q.calibrations(spark), str(tmp_path / "sealed")
    logs = a.predictions_events(spark, D), a.changes_events(spark, D)
    stats = q.versions(spark, D, q.SNAPSHOTS), q.versions(spark, D, q.OVERLAYS)

    def seal(stops):
        out = s.features_at_seal(stops, *logs, *stats)
        score = F.coalesce(F.col("train_delayed_rate_14d"), F.lit(0.3))
        out = out.withColumns({"delay_probability": F.when(F.col("stop_id").cast("long") % 7 != 0, score), "delay_p50_min": F.lit(1.0), "delay_p90_min": F.col("station_live_n_60m") + 5.0})
        out = out.withColumns({"model_version": F.lit("v2"), "predicted_at": s.seal_time(F.col("scheduled_time"))})
        return s.calibrated_at_seal(out, curves)

    stops = q.plan(spark, D)
    want = {r.stop_id: r for r in seal(stops).where("delay_probability is not null").collect()}
    odd = F.col("stop_id").cast("long") % 2 != 0
    stream = q.as_stream([stops.where(odd), stops])
    for run in ("one", "two"):
        streams.seal_batches(stream, seal, path, str(tmp_path / run))
    got = parts.load(spark, path).drop("day").collect()
    assert len(got) == len(want) > 500
    assert all(r.asDict() == want[r.stop_id].asDict() for r in got)
