"""Cases worked out by hand, and properties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stopdelay.functions import metrics as m
from stopdelay.functions import times as ti
from stopdelay.operators import baseline as b
from stopdelay.operators import calibration as k
from stopdelay.operators import clean as c
from stopdelay.operators import history as h
from stopdelay.operators import logs as g
from stopdelay.plans.features import FEATURES, build_feature_frame
from stopdelay.sources import adapters as a
from stopdelay.sources import tables as t
from stopdelay.sources import timetable as x

T = dt.datetime.fromisoformat
STOP = "id string, station_name string, train_type string, train_number string, train_line_station_num int, delay_in_min int, time timestamp, departure_planned_time timestamp, arrival_planned_time timestamp, is_canceled boolean"


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def stops(spark, *rows):
    """(id, station, type, delay, time[, canceled])"""
    full = [(str(r[0]), r[1], r[2], "1", 1, r[3], T(r[4]), None, None, r[5] if len(r) > 5 else False) for r in rows]
    return spark.createDataFrame(full, STOP)


def test_zone(spark):
    rows = [("2025-06-01 08:30",), ("2025-10-26 02:30",), ("2025-03-30 02:30",)]
    df = spark.createDataFrame(rows, "s string").select(F.col("s").cast("timestamp_ntz").alias("at"))
    got = [r.u for r in df.select(ti.zone_to_utc(F.col("at")).cast("timestamp_ntz").alias("u")).collect()]
    assert got == [T("2025-06-01 06:30"), T("2025-10-26 00:30"), None]
    wall = df.limit(1).select(ti.wall_clock(ti.zone_to_utc(F.col("at"))).alias("w")).first().w
    assert wall == T("2025-06-01 08:30")


def test_scheduled_time_and_calendar(spark):
    s = ti.add_scheduled_time(stops(spark, (1, "S", "ICE", 10, "2025-01-01 08:30"), (2, "S", "ICE", 0, "2025-01-04 08:30")))
    rows = ti.add_calendar_features(s, ti.holidays(spark, 2026)).orderBy("id").collect()
    assert rows[0].scheduled_time == T("2025-01-01 08:20")
    assert [(r.is_holiday, r.is_weekend) for r in rows] == [(True, False), (False, True)]
    known = {r.holiday.isoformat() for r in ti.holidays(spark, 2026).collect()}
    assert {"2024-03-29", "2025-04-21", "2025-05-29", "2026-05-25", "2026-04-03"} <= known and len(known) == 27


def test_cleaning(spark):
    s = stops(spark, ("a", "S", "X", 1, "2025-01-01"), ("b", None, "X", 1, "2025-01-01"), ("c", "S", "X", 10000, "2025-01-01"), ("d", "S", "X", -500, "2025-01-01"))
    assert [r.id for r in c.drop_bad_rows(s).collect()] == ["a"]
    s = stops(spark, ("a", "S", "X", 1, "2025-01-02"), ("a", "S", "X", 9, "2025-01-01"), ("b", "S", "X", 1, "2025-01-01"))
    assert sorted((r.id, r.delay_in_min) for r in c.dedupe(s).collect()) == [("a", 9), ("b", 1)]
    s = stops(spark, (1, "Always", "X", 0, "2025-01-01"), (2, "Always", "X", 0, "2025-02-01"), (3, "OnlyFeb", "X", 0, "2025-02-01"))
    assert [r.station_name for r in c.station_panel(s).collect()] == ["Always"]
    assert c.restrict_to_panel(s, c.station_panel(s, 0.5)).count() == 3


def passed(df, name, **kw):
    return c.check(df, name, **kw).first().passed


def test_checks(spark):
    ten = stops(spark, *[(i, "S", "X", 5000 if i == 0 else 1, "2025-01-01") for i in range(10)])
    assert not passed(ten, "delay_range", max_bad_share=0.01)
    many = stops(spark, *[(i, "S", "X", 5000 if i == 0 else 1, "2025-01-01") for i in range(1000)])
    assert passed(many, "delay_range", max_bad_share=0.01)
    half = stops(spark, (1, None, "X", 1, "2025-01-01"), (2, "S", "X", 1, "2025-01-01"))
    assert not passed(half, "required_not_null") and passed(half, "required_not_null", max_null_rate=0.6)
    assert not passed(half.limit(0), "required_not_null") and not passed(half.limit(0), "delay_range")
    assert not passed(half.union(half), "duplicate_ids") and passed(half, "duplicate_ids")
    end = F.lit("2025-01-01").cast("timestamp")
    assert passed(half, "time_range", start=end, end=end)
    assert {r["column"] for r in c.check_schema(half).where("not passed").collect()} >= {"eva", "xml_station_name"}


def features(spark, *rows):
    return {r.id: r for r in build_feature_frame(stops(spark, *rows), ti.holidays(spark, 2026)).collect()}


def test_history_sees_no_same_day(spark):
    got = features(spark, (1, "S", "ICE", 4, "2025-01-10 10:00"), (2, "S", "ICE", 100, "2025-01-11 10:00"))
    assert got["1"].train_mean_delay_14d is None and got["2"].train_mean_delay_14d == 4.0
    got = features(spark, (1, "S", "ICE", 60, "2025-01-01 10:00"), (2, "S", "ICE", 0, "2025-01-21 10:00"))
    assert got["2"].train_mean_delay_14d is None and got["2"].train_mean_delay_30d == 60.0
    got = features(spark, (1, "S", "ICE", 50, "2025-01-10 10:00", True), (2, "S", "ICE", 2, "2025-01-10 11:00"), (3, "S", "ICE", 0, "2025-01-11 10:00"))
    assert set(got) == {"2", "3"} and got["3"].train_mean_delay_14d == 2.0
    assert set(FEATURES) <= set(got["2"].asDict())


#: A train at 16:42, sealed at 14:05.
TRAIN = (0, "M", "ICE", 0, "2025-01-10 16:42")


def test_network_state_windows(spark):
    got = features(spark, TRAIN, (1, "M", "ICE", 20, "2025-01-10 13:30"))["0"]
    assert (got.station_live_mean_delay_60m, got.station_live_delayed_share_60m, got.station_live_n_60m) == (20, 1, 1)
    got = features(spark, TRAIN, (1, "M", "ICE", 90, "2025-01-10 14:10"))["0"]
    assert (got.station_live_mean_delay_60m, got.station_live_n_60m, got.network_live_mean_delay_60m) == (None, 0, None)
    got = features(spark, TRAIN, (1, "M", "ICE", 99, "2025-01-10 13:04"), (2, "M", "ICE", 10, "2025-01-10 13:06"), (3, "M", "ICE", 20, "2025-01-10 14:04"))["0"]
    assert (got.station_live_mean_delay_60m, got.station_live_n_60m) == (15, 2)
    got = features(spark, TRAIN, (1, "M", "ICE", 50, "2025-01-10 13:30", True), (2, "M", "ICE", 4, "2025-01-10 13:30"))["0"]
    assert (got.station_live_mean_delay_60m, got.station_live_delayed_share_60m, got.station_live_n_60m) == (4, 0, 1)
    got = features(spark, (0, "B", "ICE", 0, "2025-01-10 16:42"), (1, "M", "ICE", 30, "2025-01-10 13:30"), (2, "K", "RE", 12, "2025-01-10 13:30"))["0"]
    assert (got.station_live_n_60m, got.type_live_mean_delay_60m, got.network_live_mean_delay_60m) == (0, 30, 21)


def test_no_leak(spark):
    """Raising what happened at or after the seal never changes a row."""
    rows = [(i, f"S{i % 2}", "ICE", i % 30, f"2025-01-{9 + i % 3:02} {6 + i % 14:02}:{i * 7 % 60:02}") for i in range(120)]
    before = features(spark, *rows, TRAIN)["0"]
    raised = [(i, s, y, 500 if at >= "2025-01-10 14:05" else d, at) for i, s, y, d, at in rows]
    assert features(spark, *raised, TRAIN)["0"] == before


def test_fast_paths_equal_general_ones(spark):
    s = a.stops_events(spark, "/root/testdata/sf0.001").where(~F.col("is_canceled")).transform(ti.add_scheduled_time).withColumn("event_date", F.to_date("scheduled_time"))
    keys = h.GRANULARITIES["train"]
    stats = h.rolling_from_daily(h.daily_aggregates(s, keys), keys, "train").drop("event_date")
    for w in (14, 30):
        col = f"train_mean_delay_{w}d"
        near = F.date_diff("event_date", "join_date") <= w
        general = h.asof_join(s.select("id", *keys, "event_date"), stats.select(*keys, "join_date", col), "event_date", "join_date", keys, near)
        fast = h.attach_rolling(s, "train", keys).select("id", col)
        assert {(r.id, r[col]) for r in general.collect()} == {(r.id, r[col]) for r in fast.collect()}


@pytest.mark.parametrize("every", [None, "DAY"])
def test_asof_ties_nulls_tolerance(spark, every):
    left = spark.createDataFrame([("a", T("2025-01-01 10:00")), ("a", T("2025-01-03 10:00")), ("b", T("2025-01-01 10:00")), (None, T("2025-01-01 10:00"))], "k string, t timestamp")
    right = spark.createDataFrame([("a", T("2025-01-01 10:00"), 1), ("a", T("2025-01-01 09:00"), 2), (None, T("2025-01-01 09:00"), 3)], "k string, u timestamp, v int")
    get = lambda **kw: sorted((r.k or "", r.t.day, r.v) for r in h.asof_join(left, right, "t", "u", ["k"], every=every, **kw).collect())
    assert get() == [("", 1, None), ("a", 1, 1), ("a", 3, 1), ("b", 1, None)]
    assert get(allow_exact=False) == [("", 1, None), ("a", 1, 2), ("a", 3, 1), ("b", 1, None)]
    assert get(tolerance=F.col("t") <= F.col("u") + F.expr("interval 1 day")) == [("", 1, None), ("a", 1, 1), ("a", 3, None), ("b", 1, None)]


PRED = "stop_id string, station_name string, train_type string, train_number string, scheduled_time timestamp, predicted_at timestamp, delay_probability double, delay_p50_min double, delay_p90_min double, raw_delay_probability double, raw_delay_p90_min double, coverage string, model_version string, day date"
CHANGE = "stop_id string, changed_time timestamp, is_canceled boolean, observed_at timestamp"


def pred(stop, at="2025-01-10 12:00", p=0.3, p50=4.0, p90=20.0, seal="2025-01-10 10:00", raw=None, number=None, version="v1", station="S", kind="ICE"):
    return (stop, station, kind, number or stop, T(at), T(seal), p, p50, p90, raw[0] if raw else None, raw[1] if raw else None, "train", version, T(seal).date())


def test_logs(spark):
    new = spark.createDataFrame([pred("a"), pred("b"), pred("c"), pred("c", seal="2025-01-10 09:00")], PRED)
    logged = spark.createDataFrame([pred("a"), pred("b")], PRED)
    assert [(r.stop_id, r.predicted_at.hour) for r in g.anti_append(new, logged).collect()] == [("c", 9)]
    changes = spark.createDataFrame([("a", T("2025-01-10 12:30"), False, T("2025-01-10 11:00")), ("a", T("2025-01-10 12:59"), False, T("2025-01-10 11:30"))], CHANGE)
    assert g.latest_changes(changes).first().changed_time == T("2025-01-10 12:59")
    old = logged.drop("raw_delay_probability")
    both = g.union_logs([old, new])
    assert both.count() == 6 and both.where("raw_delay_probability is null").count() == 6


def test_daily_report(spark):
    p = spark.createDataFrame([pred("a"), pred("b"), pred("c")], PRED)
    ch = spark.createDataFrame([("b", T("2025-01-10 12:12"), False, T("2025-01-10 12:00")), ("c", None, True, T("2025-01-10 12:00"))], CHANGE)
    r = g.daily_report(g.ground_truth(p, ch)).first()
    assert (r.n_predictions, r.n_canceled, r.n_evaluated, r.base_rate, r.coverage_p90, r.mae_p50) == (3, 1, 2, 0.5, 1.0, 6.0)
    rows = [pred(str(i), p=0.5, p90=25.0, raw=(0.2, 5.0)) for i in range(200)]
    late = [(str(i), T("2025-01-10 12:20"), False, T("2025-01-10 12:00")) for i in range(0, 200, 2)]
    truth = g.ground_truth(spark.createDataFrame(rows, PRED), spark.createDataFrame(late, CHANGE))
    day, raw = g.daily_report(truth).first(), g.uncorrected_report(truth).first()
    assert day.coverage_p90 == 1.0 and day.ece < 0.01 and raw.coverage_p90_raw == 0.5 and abs(raw.ece_raw - 0.3) < 1e-9


def test_metrics(spark):
    one = lambda rows, schema, *cols: spark.createDataFrame(rows, schema).agg(*cols).first()
    assert one([(10.0, 0.0)], "y double, q double", m.pinball(F.col("y"), F.col("q"), 0.9))[0] == pytest.approx(9)
    assert one([(10.0, 20.0)], "y double, q double", m.pinball(F.col("y"), F.col("q"), 0.9))[0] == pytest.approx(1)
    assert one([(1, 2), (5, 4), (10, 15), (20, 25)], "y int, q int", m.coverage(F.col("y"), F.col("q")))[0] == 0.75
    df = spark.createDataFrame([(1.0, 0.8), (0.0, 0.5), (1.0, 0.5), (0.0, 0.2)], "y double, p double")
    r = m.rank_metrics(df, "y", "p").first()
    assert r.roc_auc == pytest.approx(0.875) and r.pr_auc == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert m.rank_metrics(df.where("y = 1"), "y", "p").first().roc_auc is None
    q = m.nearest_quantiles(spark.createDataFrame([(0,), (0,), (10,), (20,)], "v int"), "v", [0.5, 0.9]).first()
    assert (q.q50, q.q90) == (10, 20)


@pytest.mark.parametrize("ece,fires", [([0.02, 0.09, 0.10, 0.09], True), ([0.02, 0.09, 0.10], False), ([0.09, 0.10], False)])
def test_triggers(spark, ece, fires):
    s = spark.createDataFrame([(f"2025-01-{i + 1:02}", e, 0.8) for i, e in enumerate(ece)], "day string, ece double, roc_auc double")
    assert g.trigger_reasons(s).first().retraining_recommended == fires
    assert g.trigger_reasons(s, 50).first().retraining_recommended and g.trigger_reasons(s, 10).first().retraining_recommended == fires


@pytest.mark.parametrize("new,ok", [((0.49, 1.6, 0.02), False), ((0.499, 1.6, 0.02), True), ((0.5, 1.7, 0.02), False), ((0.5, 1.6, 0.05), False)])
def test_promotion(spark, new, ok):
    names = ("pr_auc", "pinball_p90", "ece")
    rows = [(x, y, z) for x, y, z in zip(names, (0.5, 1.6, 0.02), new)]
    assert b.promotion_verdict(spark.createDataFrame(rows, "metric string, champion double, challenger double")).first().promote == ok


def test_baseline_and_folds(spark):
    train = spark.createDataFrame([("A", "ICE", True, 10), ("A", "ICE", False, 0), ("B", "RE", False, 1)], "station_name string, train_type string, target_delayed6 boolean, target_delay_min int")
    val = spark.createDataFrame([("A", "ICE"), ("Z", "ICE"), ("Z", "U")], "station_name string, train_type string")
    got = {(r.station_name, r.train_type): r.baseline_prob for r in b.predict_baseline(b.fit_baseline(train), val).collect()}
    assert got["A", "ICE"] == 0.5 and got["Z", "ICE"] == 0.5 and got["Z", "U"] == pytest.approx(1 / 3)
    months = sorted(r.train_month for r in b.walk_forward_folds(spark, ["2026-02"]).collect())
    assert months[0] == "2025-02" and months[-1] == "2026-01" and len(months) == 12
    have, there = (spark.createDataFrame([(x,) for x in y], "month string") for y in (["2026-05", "2026-06"], ["2026-05", "2026-06", "2026-07"]))
    assert [r.month for r in t.new_months(have, there).collect()] == ["2026-07"]


def pairs(spark, rows):
    return spark.createDataFrame(rows, "model_version string, scheduled_time timestamp, model_probability double, model_p90_min double, actual_delay_min long")


def test_calibration(spark):
    now = F.lit("2025-01-10 12:00").cast("timestamp")
    rows = [("v1", T("2025-01-09 00:00") + dt.timedelta(minutes=6 * i), 0.2, 10.0, 20 if i % 2 else 0) for i in range(300)]
    out = k.fit_calibration(pairs(spark, rows), now, 100)
    assert out["p90_delta_min"] == pytest.approx(10, abs=1) and out["curve_y"][0] == pytest.approx(0.5, abs=0.01)
    good = [("v1", r[1], 0.5, 20.0, r[4]) for r in rows[:-30]] + [("v1", r[1], 0.5, 20.0, 0 if i % 2 else 20) for i, r in enumerate(rows[-30:])]
    assert k.fit_calibration(pairs(spark, rows), now, 1000) is None
    assert k.fit_calibration(pairs(spark, good), now, 100) is None or not k.fit_calibration(pairs(spark, good), now, 100)["validation"]["probability_correction_helps"]
    p = spark.createDataFrame([pred("a", p=0.5, p50=4.0, p90=10.0), pred("b", p=0.5, p50=4.0, p90=10.0, version="v2")], PRED)
    got = {r.stop_id: (r.delay_probability, r.delay_p90_min) for r in k.apply_calibration(p, [0.0, 1.0], [0.1, 0.9], 5.0, "v1").collect()}
    assert got["a"] == (pytest.approx(0.5), 15.0) and got["b"] == (0.5, 10.0)
    log = spark.createDataFrame([pred("a", "2025-01-09 12:00", seal="2025-01-09 10:00"), pred("b", "2025-01-09 12:00", seal="2025-01-09 10:00", version="v2")], PRED)
    changes = spark.createDataFrame([("a", T("2025-01-09 12:10"), False, T("2025-01-09 12:00"), T("2025-01-09").date())], CHANGE + ", day date")
    assert [r.model_version for r in k.collect_pairs(log, changes, now).collect()] == ["v2"]


def test_calibration_table(spark, tmp_path):
    path = str(tmp_path / "cal")
    assert t.read_calibration(spark, path, "v1") is None
    t.write_calibration(spark, {"n_samples": 5, "curve_x": [0.0, 1.0], "curve_y": [0.1, 0.9], "p90_delta_min": 2.0}, "v1", "2025-01-01", path)
    assert t.read_calibration(spark, path, "v1")["p90_delta_min"] == 2.0 and t.read_calibration(spark, path, "v2") is None
    t.write_calibration(spark, None, "v1", "2025-01-02", path)
    assert t.read_calibration(spark, path, "v1") is None


def test_board(spark):
    now = F.lit("2025-01-10 12:00").cast("timestamp")
    rows = [pred("w1", "2025-01-10 13:00", number="7"), pred("w2", "2025-01-10 13:00", number="7"), pred("x", "2025-01-10 14:00"), pred("x", "2025-01-10 14:00", p=0.9, seal="2025-01-10 11:00"), pred("y", "2025-01-10 11:00"), pred("old", "2025-01-08 11:00")]
    changes = [("x", T("2025-01-10 14:25"), False, T("2025-01-10 11:50"))]
    got = {r.stop_id: r for r in g.board(spark.createDataFrame(rows, PRED), spark.createDataFrame(changes, CHANGE), now).collect()}
    assert set(got) == {"w1", "x", "y"}
    assert (got["x"].db_live_delay_min, got["x"].delay_probability, got["x"].side) == (25, 0.3, "upcoming")
    assert (got["y"].db_live_delay_min, got["y"].actual_delay_min, got["y"].side) == (None, 0, "departed")


def test_coverage_and_overlay(spark):
    day = dt.date(2025, 1, 20)
    snap = spark.createDataFrame([("train", "ICE", "1", day), ("station_type", "S", "ICE", day), ("type", "ICE", None, day), ("type", "OLD", None, dt.date(2024, 1, 1))], "granularity string, key1 string, key2 string, join_date date").withColumns({c: F.lit(1.0) for c in ("m14", "r14", "m30", "r30")}).withColumn("n30", F.lit(3).cast("long"))
    asks = spark.createDataFrame([("S", "ICE", "1", day), ("S", "ICE", "9", day), ("Z", "ICE", "9", day), ("Z", "OLD", "9", day)], "station_name string, train_type string, train_number string, event_date date")
    got = {(r.station_name, r.train_type, r.train_number): r.coverage for r in b.snapshot_lookup(asks, snap).collect()}
    assert got == {("S", "ICE", "1"): "train", ("S", "ICE", "9"): "station_type", ("Z", "ICE", "9"): "type", ("Z", "OLD", "9"): "cold"}
    over = snap.where("granularity = 'train'").withColumn("m14", F.lit(9.0))
    assert b.snapshot_lookup(asks.limit(1), snap, over).first().train_mean_delay_14d == 9.0
    now = F.lit("2025-01-10 12:00").cast("timestamp")
    p = spark.createDataFrame([pred("a", "2025-01-08 12:00", seal="2025-01-08 10:00", number="1"), pred("b", "2025-01-09 12:00", seal="2025-01-09 10:00", number="1"), pred("c", "2025-01-10 08:00", seal="2025-01-10 06:00", number="1")], PRED)
    ch = spark.createDataFrame([("a", T("2025-01-08 12:10"), False, T("2025-01-08 12:00")), ("b", T("2025-01-09 12:20"), False, T("2025-01-09 12:00"))], CHANGE)
    s = h.latest_stats(g.observed_stops(p, ch, now), h.GRANULARITIES["train"], "train").first()
    assert (s.train_mean_delay_14d, s.train_delayed_rate_14d, s.join_date) == (15.0, 1.0, dt.date(2025, 1, 10))


def test_live_state(spark):
    now = F.lit("2025-01-10 12:30").cast("timestamp")
    p = spark.createDataFrame([pred("a"), pred("b", "2025-01-10 11:50"), pred("c", "2025-01-10 12:10", station="T", kind="RE"), pred("d", "2025-01-10 12:30")], PRED)
    ch = spark.createDataFrame([("b", T("2025-01-10 12:20"), False, T("2025-01-10 12:00"))], CHANGE)
    got = {(r.scope, r.key): (r.mean_delay_60m, r.delayed_share_60m, r.n_60m) for r in g.live_state(p, ch, now).collect()}
    assert got["station", "S"] == (15, 0.5, 2) and got["network", None] == (10, pytest.approx(1 / 3), 3)


PLAN = """<timetable station="Hamburg">
<s id="1"><tl c="ICE" n="10"/><ar pt="2507011830" ppth="a|b|c"/><dp pt="2507011835" l="7"/></s>
<s id="2"><tl c="RE" n="11"/><ar pt="2507011840" ppth="a"/></s>
<s id="3"><tl c="S" n="12"/><dp pt="2507011845"/></s>
<s id="4"><tl c="S" n="13"/><ar pt="2507011850"/></s>
<s id="5"><dp pt="2507011845"/></s><s id="6"><tl c="S" n="1"/></s><s id="7"><tl c="S" n="1"/><dp ct="2507011845"/></s></timetable>"""
CHANGES = """<timetable station="Hamburg"><s id="1"><ar ct="2507011850"/><dp ct="2507011859"/></s><s id="2"><ar cs="c"/></s><s id="3"><dp l="7"/></s><s id="4"/></timetable>"""


def test_timetables(spark):
    docs = spark.createDataFrame([(PLAN,), ("not xml",), (None,)], "xml string")
    rows = {r.stop_id: r for r in x.parse_plan(docs).collect()}
    assert set(rows) == {"1", "2", "3", "4"}
    assert [rows[i].station_num for i in "1234"] == [4, 2, 1, None] and rows["1"].line == "7" and rows["2"].line is None
    assert rows["1"].scheduled_time == T("2025-07-01 16:35") and not rows["2"].has_departure and rows["1"].station_name == "Hamburg"
    got = {r.stop_id: (r.changed_time, r.is_canceled) for r in x.parse_changes(spark.createDataFrame([(CHANGES,)], "xml string")).collect()}
    assert got == {"1": (T("2025-07-01 16:59"), False), "2": (None, True), "3": (None, False)}


def test_nanoseconds_are_read(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    at = pa.array([1_735_689_600_000_000_123], pa.timestamp("ns"))
    pq.write_table(pa.table({"time": at, "id": ["a"]}), tmp_path / "data-2025-01.parquet", version="2.6")
    r = t.read_monthly(spark, str(tmp_path)).first()
    assert r.time == T("2025-01-01 00:00") and r.month == "2025-01"


def test_champion_and_challenger_have_the_same_rounds(spark, monkeypatch):
    import inspect

    from stopdelay.plans import models as pm
    from stopdelay.queries import models as q

    rounds, fit = [], pm.Bundle.fit

    def record(self, *args, **named):
        bound = inspect.signature(fit).bind(self, *args, **named)
        bound.apply_defaults()
        rounds.append(bound.arguments["rounds"])
        return self

    frame = spark.createDataFrame([("train",), ("eval",)], "fold_month string")
    monkeypatch.setattr(pm.Bundle, "fit", record)
    monkeypatch.setattr(pm.Bundle, "score", lambda self, df, mode: df)
    monkeypatch.setattr(pm, "load_split", lambda df, months, columns: df)
    monkeypatch.setattr(pm, "model_metrics", lambda df: df)
    monkeypatch.setattr(pm, "compare_metrics", lambda old, new: old)
    monkeypatch.setattr(pm, "promotion_verdict", lambda df: spark.createDataFrame([(False,)], "promote boolean"))
    monkeypatch.setattr(q, "frame", lambda spark, d: frame)
    q.championship(spark, "")
    assert len(rounds) == 2 and rounds[0] == rounds[1]


def test_frame_in_local_time(spark):
    """Days begin at midnight in Berlin, before and after both changes of the clock."""
    rows = [(1, "S", "ICE", 8, "2025-03-29 22:59"), (2, "S", "ICE", 0, "2025-03-29 23:00"), (3, "S", "ICE", 0, "2025-03-30 22:00"), (4, "S", "ICE", 0, "2025-10-25 21:59"), (5, "S", "ICE", 0, "2025-10-25 22:00"), (6, "S", "ICE", 0, "2025-10-26 22:59"), (7, "S", "ICE", 0, "2025-10-26 23:00"), (8, "S", "ICE", 0, "2025-12-31 23:30")]
    s = stops(spark, *rows).withColumn("departure_planned_time", F.col("time"))
    got = {r.id: r for r in build_feature_frame(s, ti.holidays(spark, 2026), zone=ti.ZONE).collect()}
    assert [(got[str(i)].scheduled_hour, got[str(i)].weekday) for i in range(1, 8)] == [(23, 6), (0, 7), (0, 1), (23, 6), (0, 7), (23, 7), (0, 1)]
    assert got["1"].train_mean_delay_14d is None and got["2"].train_mean_delay_14d == 8.0  # the day barrier is the local midnight
    assert (got["8"].fold_month, got["8"].is_holiday, got["8"].month) == ("2026-01", True, 1)
    utc = {r.id: r for r in build_feature_frame(s, ti.holidays(spark, 2026)).collect()}
    assert utc["2"].train_mean_delay_14d is None and utc["8"].fold_month == "2025-12"


def test_versions_are_numbers(spark):
    df = spark.createDataFrame([("v9",), ("v10",), ("v2",)], "model_version string")
    assert [r.model_version for r in k.current_model(df).collect()] == ["v10"]
    assert t.latest_version(df.withColumnRenamed("model_version", "version")).first().version == "v10"


@pytest.mark.parametrize("values,q", [([1.0], 0.9), ([3.0, 1.0, 2.0], 0.5), ([0.25, 0.5, 0.75, 7.0], 0.9), ([-3.5, -3.25, 10.0, 10.0, 11.0], 0.3)])
def test_linear_quantile(spark, values, q):
    import numpy as np

    df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
    assert k.linear_quantile(df, F.col("x"), q).first().v == pytest.approx(np.quantile(values, q))


def test_rebuild_publishes_and_stands_down(spark, tmp_path):
    now, path = F.lit("2025-01-10 12:00").cast("timestamp"), str(tmp_path / "cal")
    at = [T("2025-01-08 00:00") + dt.timedelta(minutes=6 * i) for i in range(480)]
    rows = [pred(str(i), str(x + dt.timedelta(hours=2)), p=0.2, p90=10.0, seal=str(x)) for i, x in enumerate(at)]
    late = [(str(i), x + dt.timedelta(hours=2, minutes=20), False, x + dt.timedelta(hours=2), x.date()) for i, x in enumerate(at) if i % 2]
    p, c_ = spark.createDataFrame(rows, PRED), spark.createDataFrame(late, CHANGE + ", day date")
    out = k.rebuild(p, c_, now, "2025-01-10", path, 100)
    assert out["p90_delta_min"] == pytest.approx(10, abs=1) and t.read_calibration(spark, path, "v1")["curve_y"] == out["curve_y"]
    assert k.rebuild(p, c_, now, "2025-01-11", path, 10_000) is None and t.read_calibration(spark, path, "v1") is None


def test_metrics_do_not_depend_on_order(spark):
    rows = [(i % 2 * 1.0, (i * 7919 % 1000) / 1000.0) for i in range(32)]
    results = set()
    for order in (rows, rows[::-1], sorted(rows)):
        df = spark.createDataFrame(order, "y double, p double").repartition(5)
        results.add((m.expected_calibration_error(df, "y", "p").first().ece, m.classification_metrics(df, "y", "p").first().brier, df.agg(m.pinball(F.col("y"), F.col("p"), 0.9)).first()[0]))
    assert len(results) == 1


def test_saved_bundles(spark):
    from stopdelay.queries import QUERIES

    rows = QUERIES["saved_bundle"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r[c] == r[f"{c}_loaded"] for r in rows for c in ("delay_probability", "p50", "p90"))
    sealed = {r.stop_id: r for r in QUERIES["stream_seal_bundle"](spark, "/root/testdata/sf0.001").collect()}
    assert {r.id for r in rows} == set(sealed)
    assert all(abs(sealed[r.id].delay_probability - r.delay_probability) < 1e-9 for r in rows)
    got = {(r.val_month, r.metric): (r.model, r.baseline) for r in QUERIES["train_cv"](spark, "/root/testdata/sf0.001").collect()}
    assert got["eval", "pr_auc"] == got["mean", "pr_auc"] and None not in got["eval", "roc_auc"]


def test_hours_of_a_day_on_which_clocks_change(spark):
    """Stops every half hour, UTC: the hour that spring skips has none, the one that autumn repeats twice as many."""
    from stopdelay.operators.profiles import hourly_counts

    for day, hours in (("2026-03-29", {2: 0}), ("2026-10-25", {2: 4})):
        df = spark.sql(f"SELECT explode(sequence(timestamp_ntz'{day} 00:00:00' - interval 1 day, timestamp_ntz'{day} 00:00:00' + interval 2 days, interval 30 minutes)) AS time")
        got = {r.hour: r.n for r in hourly_counts(df, day, ti.ZONE).collect()}
        assert {h: got.get(h, 0) for h in range(24)} == {h: hours.get(h, 2) for h in range(24)}


def test_latest_changes_of_a_stream(spark, tmp_path):
    """Runs over a log that grows: ties go to the greatest row, late rows change nothing, earlier folders stay as they are."""
    from stopdelay.sources import parts
    from stopdelay.streaming import streams

    log, table, progress = (str(tmp_path / x) for x in ("log", "table", "progress"))
    schema = "stop_id string, observed_at long, changed_time long, is_canceled boolean"
    runs = [[("a", 1, 5, False), ("a", 2, 6, False), ("b", 1, None, True)], [("a", 2, 7, False), ("b", 0, 9, False), ("c", 3, 3, None)]]
    for rows in runs:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(log)
        streams.latest_change_stream(spark.readStream.schema(schema).parquet(log), table, progress)
    assert sorted(tuple(r) for r in streams.latest_so_far(spark, table).collect()) == [("a", 2, 7, False), ("b", 1, None, True), ("c", 3, 3, None)]
    assert parts.load(spark, table, F.col("part") == "b000000000000").count() == 2


def test_queries_without_the_pipeline(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    full = set(entry.queries())
    try:
        monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # import raises ModuleNotFoundError of that name
        assert set(importlib.reload(entry).queries()) <= full
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
    assert set(entry.queries()) == full
