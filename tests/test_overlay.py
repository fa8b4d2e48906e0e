"""The overlay by increments against the one that is made of the whole logs."""

import datetime as dt
import random

from pyspark.sql import functions as F

from stopdelay.operators import baseline, history, logs
from stopdelay.operators import overlay as o
from stopdelay.sources import parts

PRED = "stop_id string, station_name string, train_type string, train_number string, scheduled_time timestamp, predicted_at timestamp, day date"
CHANGED = "stop_id string, observed_at timestamp, changed_time timestamp, is_canceled boolean, day date"


def now():
    return F.lit("2024-03-01 12:00:00").cast("timestamp")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def recomputed(spark, predictions, changes):
    stops = logs.observed_stops(spark.createDataFrame(predictions, PRED), spark.createDataFrame(changes, CHANGED), now())
    return rows(baseline.snapshot(stops, history.latest_stats))


def take(spark, path, predictions, changes):
    return o.refresh_overlay(spark.createDataFrame(predictions, PRED), spark.createDataFrame(changes, CHANGED), path)


def made_logs(seed=5, n=150):
    """Stops of 25 days with null keys, and up to four changes each, some long before the seal, some weeks after."""
    r, start, predictions, changes = random.Random(seed), dt.datetime(2024, 2, 6), [], []
    for i in range(n):
        at = start + dt.timedelta(minutes=r.randrange(25 * 1440))
        seal = at - dt.timedelta(hours=2)
        predictions.append((f"s{i}", r.choice(["A", "B", None]), r.choice(["X", "Y"]), r.choice(["1", "2", None]), at, seal, seal.date()))
        for _ in range(r.randrange(5)):
            seen = at + dt.timedelta(hours=r.choice([-30, -1, 1, 1, 400]))
            changes.append((f"s{i}", seen, r.choice([None, at, at + dt.timedelta(minutes=r.randrange(-3, 40))]), r.choice([True, False, None]), seen.date()))
    return predictions, changes


def test_batches_in_any_order_give_what_the_whole_logs_give(spark, tmp_path):
    path, (predictions, changes) = str(tmp_path / "t"), made_logs()
    r = random.Random(1)
    r.shuffle(predictions), r.shuffle(changes)
    take(spark, path, predictions[:60], changes[:100])
    assert rows(o.overlay_statistics(spark, path, now())) == recomputed(spark, predictions[:60], changes[:100])
    last = predictions[60:] + predictions[:10], changes[100:] + changes[:20]
    take(spark, path, *last)
    o.merge_overlay(spark, path, now(), folders=1)
    want = recomputed(spark, predictions, changes)
    assert rows(o.overlay_statistics(spark, path, now())) == want
    _, table = parts.entries(spark, path)
    assert table.groupBy("part").count().where("count > 1").count() == 0
    before = parts.load(spark, path).count()
    take(spark, path, *last)  # the batch comes again
    assert parts.load(spark, path).count() == before
    assert rows(o.overlay_statistics(spark, path, now())) == want


def test_what_one_change_does(spark, tmp_path):
    """A late change opens the rows of its day only; a cancellation takes the stop out; a later seal doesn't count."""
    path, days = str(tmp_path / "t"), [dt.datetime(2024, 2, d, 10) for d in (10, 11, 12)]
    seals = [(f"s{d.day}", "A", "X", "1", d, d - dt.timedelta(hours=2), d.date()) for d in days]
    take(spark, path, seals, [])
    week = days[0] + dt.timedelta(days=8)
    ids = spark.createDataFrame([("s10",)], "stop_id string")
    assert {f.split("part=")[1][:16] for f in o.of_stops(spark, path, ids).inputFiles()} == {"stops-2024-02-10"}
    take(spark, path, [], [("s10", week, days[0] + dt.timedelta(minutes=30), False, week.date())])
    daily = lambda: [(r.event_date.day, r.delay_sum, r.delayed_sum, r.n) for r in o.overlay_sums(spark, path, now()).orderBy("event_date").collect()]
    assert daily() == [(10, 30, 1, 1), (11, 0, 0, 1), (12, 0, 0, 1)]
    later = week + dt.timedelta(hours=1)
    again = ("s11", "B", "Y", "2", days[1], days[1], days[1].date())
    take(spark, path, [again, (None, "A", "X", "1", days[0], days[0], days[0].date())], [("s10", later, None, True, later.date()), ("s12", None, days[2], True, None)])
    assert daily() == [(11, 0, 0, 1), (12, 0, 0, 1)]
    assert o.overlay_sums(spark, path, now(), lookback_days=18).count() == 1  # from the 12th on
