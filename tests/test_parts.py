"""Tables of parts: commits that are seen whole or not at all, logs by day, the merged table of changes."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from stopdelay.sources import parts, tables
from stopdelay.streaming import streams


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_commits(spark, tmp_path):
    path = str(tmp_path / "t")
    assert parts.load(spark, path) is None
    parts.commit(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long"), path, "k")
    old = parts.load(spark, path)
    parts.commit(spark.createDataFrame([("b", 3)], "k string, v long"), path, "k")
    assert rows(old) == [("a", 1), ("b", 2)]  # a reader from before the commit
    assert rows(parts.load(spark, path)) == [("a", 1), ("b", 3)]
    parts.commit(spark.createDataFrame([("b", 4, "x")], "k string, v long, w string"), path, "k", "append")
    assert sorted((r.k, r.v, r.w) for r in parts.load(spark, path).collect()) == [("a", 1, None), ("b", 3, None), ("b", 4, "x")]
    only_a = parts.load(spark, path, F.col("part") == "a")
    assert [(r.k, r.v, r.w) for r in only_a.collect()] == [("a", 1, None)] and len(only_a.inputFiles()) == 1
    parts.commit(spark.createDataFrame([], "k string, v long"), path, "k", "replace", ["a"])
    assert {r.k for r in parts.load(spark, path).collect()} == {"b"}
    parts.commit(spark.createDataFrame([], "k string, v long"), path, "k", "replace", ["b"])
    assert parts.load(spark, path) is None or parts.load(spark, path).count() == 0
    with pytest.raises(ValueError):
        parts.commit(spark.createDataFrame([(None, 1)], "k string, v long"), path, "k")


def test_a_failed_commit_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    parts.commit(spark.createDataFrame([("a", 1)], "k string, v long"), path, "k")
    bad = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v long").withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        parts.commit(bad, path, "k")
    assert rows(parts.load(spark, path)) == [("a", 1)]


def test_what_is_replaced_goes_after_a_while(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(parts, "KEEP", 3)
    path = str(tmp_path / "t")
    for i in range(6):
        parts.commit(spark.createDataFrame([("a", i)], "k string, v long"), path, "k")
    assert rows(parts.load(spark, path)) == [("a", 5)]
    assert len(glob.glob(f"{path}/manifest/*")) == 3 and len(glob.glob(f"{path}/data/k=a/*")) == 3


def test_a_log_opens_the_days_that_are_asked_for(spark, tmp_path):
    path = str(tmp_path / "log")
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    tables.write_log(spark.createDataFrame([(f"s{d}", d) for d in days], "stop_id string, day date"), path)
    for day in days[:30]:
        for f in glob.glob(f"{path}/day={day}/*.parquet"):
            open(f, "w").write("no footer here")
    got = tables.read_log(spark, path, "2024-01-31", "2024-02-02")
    assert [r.stop_id for r in got.orderBy("day").collect()] == ["s2024-01-31", "s2024-02-01", "s2024-02-02"]
    assert {f.split("day=")[1][:10] for f in got.inputFiles()} == {"2024-01-31", "2024-02-01", "2024-02-02"}
    assert dict(got.dtypes)["day"] == "date"


def test_a_log_without_the_days(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.write_log(spark.createDataFrame([("a", dt.date(2024, 1, 1))], "stop_id string, day date"), path)
    assert tables.read_log(spark, path, "2025-01-01", "2025-01-03").count() == 0
    assert tables.read_log(spark, path, "2025-01-03", "2025-01-01").count() == 0


def test_merged_changes(spark, tmp_path):
    """Twenty batches of 30 days: the table holds few parts, settled rows are written once, a change after weeks counts."""
    log, table, progress = (str(tmp_path / x) for x in ("log", "table", "progress"))
    schema = "stop_id string, observed_at timestamp, changed_time timestamp, is_canceled boolean"
    start, want = dt.datetime(2024, 1, 1), {}
    for i in range(20):
        at = start + dt.timedelta(hours=36 * i)
        batch = [(f"s{i}", at, at, False), (f"s{i}", at + dt.timedelta(hours=1), None, True), ("again", at, at, i % 2 == 0)]
        batch += [(f"s{i - 1}", at, at, False)] if i else []
        batch += [("s0", at, at, True)] if i == 18 else []
        batch += [("s0", start - dt.timedelta(days=9), at, True)] if i == 19 else []
        for r in batch:
            key = lambda x: (x[1], x[2] is not None, x[2] or start, x[3])
            want[r[0]] = max(want.get(r[0], r), r, key=key)
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(log)
        if i in (6, 19):  # the stream stops between
            streams.latest_change_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(log), table, progress, batches=4, open_days=3)
    assert rows(streams.latest_so_far(spark, table)) == sorted(want.values(), key=str)
    _, now = parts.entries(spark, table)
    names = sorted(r.part for r in now.collect())
    assert sum(n.startswith("b") for n in names) < 4 and names.count("open") == 1
    per_part = parts.load(spark, table).groupBy("part").count()
    assert {r["part"]: r["count"] for r in per_part.collect()}["open"] <= 8
    settled = [n for n in names if n.startswith("settled")]
    assert len(settled) == len(set(settled)) >= 3
    # the last batch comes again
    last = spark.read.schema(schema).parquet(log).where(F.col("observed_at") >= F.lit(start + dt.timedelta(hours=36 * 19)))
    parts.commit(streams.latest_changes(last).withColumn("part", F.lit("b000000000019")), table, "part")
    streams.merge_changes(spark, table, batches=1)
    assert rows(streams.latest_so_far(spark, table)) == sorted(want.values(), key=str)


def test_merging_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "stop_id string, observed_at timestamp, changed_time timestamp, is_canceled boolean"
    parts.commit(spark.createDataFrame([], schema).withColumn("part", F.lit("b0")), path, "part", "replace", ["b0"])
    streams.merge_changes(spark, path, batches=1)
    unseen = [(None, None, None, None)]
    parts.commit(spark.createDataFrame(unseen, schema).withColumn("part", F.lit("b1")), path, "part")
    streams.merge_changes(spark, path, batches=1)
    assert rows(streams.latest_so_far(spark, path)) == unseen


def test_reports_of_an_era_without_raw_outputs(spark, tmp_path):
    path, day = str(tmp_path / "log"), dt.date(2024, 1, 1)
    at = dt.datetime(2024, 1, 1, 10)
    form = "stop_id string, scheduled_time timestamp, predicted_at timestamp, delay_probability double, delay_p50_min double, delay_p90_min double, coverage string, day date"
    tables.write_log(spark.createDataFrame([("a", at, at, 0.5, 1.0, 5.0, "train", day), ("b", at, at, 0.2, 1.0, 5.0, "cold", day)], form), path)
    changes = spark.createDataFrame([("a", at, at + dt.timedelta(minutes=9), False, day)], "stop_id string, observed_at timestamp, changed_time timestamp, is_canceled boolean, day date")
    got = [r.asDict() for r in streams.whole_report(spark, path, changes)([day]).collect()]
    assert [(r["n_predictions"], r["roc_auc"], r["ece_raw"]) for r in got] == [(2, 1.0, None)]
