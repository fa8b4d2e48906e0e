"""Queries of the logs, their evaluation, recalibration and the live products."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics as m
from ..functions.times import add_calendar_features, holidays
from ..operators import baseline as b
from ..operators import calibration as k
from ..operators import history as h
from ..operators import logs as g
from ..operators import overlay as o
from ..operators import profiles as p
from ..sources import adapters as a
from ..sources import tables as t
from .history import CALENDAR, naive, rolled, round_sql, rounded
from .registry import query

NOW = f"TIMESTAMP '{a.NOW}'"
TODAY = f"CAST({NOW} AS DATE)"


def truth(spark, d):
    return g.ground_truth(a.predictions_events(spark, d), a.changes_events(spark, d))


def scored(spark, d):
    """Evaluated rows with the outcome as 0 or 1."""
    return truth(spark, d).where(~F.col("is_canceled")).withColumn("y", g.outcome())


SCORED = a.LOGS + ", scored AS (SELECT *, (actual_delay_min >= 6)::INT::DOUBLE AS y FROM truth WHERE NOT is_canceled)"


@query("latest_change", f"WITH {a.LOGS} SELECT stop_id, observed_at, changed_time, is_canceled FROM latest")
def latest_change(spark, d):
    return naive(g.latest_changes(a.changes_events(spark, d)), "observed_at", "changed_time").select("stop_id", "observed_at", "changed_time", "is_canceled")


@query("ground_truth", f"WITH {a.LOGS} SELECT stop_id, changed_time, is_canceled, actual_delay_min FROM truth")
def ground_truth(spark, d):
    return naive(truth(spark, d), "changed_time").select("stop_id", "changed_time", "is_canceled", "actual_delay_min")


@query("log_union_drift", f"WITH {a.LOGS} SELECT stop_id, day, CASE WHEN day >= DATE '2024-01-15' THEN raw_delay_probability END AS raw_delay_probability, CASE WHEN day >= DATE '2024-01-15' THEN 'line ' || train_number END AS line FROM predictions")
def log_union_drift(spark, d):
    """Two eras of the log; the older one lacks two columns."""
    log = a.predictions_events(spark, d).select("stop_id", "day", "raw_delay_probability", F.concat(F.lit("line "), F.col("train_number")).alias("line"))
    new = F.col("day") >= F.lit("2024-01-15").cast("date")
    return g.union_logs([log.where(~new).drop("raw_delay_probability", "line"), log.where(new)])


@query("log_read_days", f"WITH {a.LOGS} SELECT day, count(*) AS n, count(line) AS lines FROM (SELECT day, CASE WHEN day >= DATE '2024-01-15' THEN train_number END AS line FROM predictions WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-19') GROUP BY day")
def log_read_days(spark, d):
    """The log as written in two eras into folders by day, and some of its days read."""
    log = a.predictions_events(spark, d).select("stop_id", "day", F.col("train_number").alias("line"))
    new = F.col("day") >= F.lit("2024-01-15").cast("date")
    path = t.shared_path(spark, "log")
    t.write_log(log.where(~new).drop("line"), path)
    t.write_log(log.where(new), path)
    return t.read_log(spark, path, "2024-01-10", "2024-01-19").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count("line").alias("lines"))


@query("first_seal", f"""WITH {a.LOGS}, resealed AS (SELECT * FROM predictions UNION ALL SELECT * REPLACE (predicted_at + INTERVAL 1 HOUR AS predicted_at) FROM predictions WHERE i9 = 0)
SELECT stop_id, min(predicted_at) AS predicted_at FROM resealed WHERE day >= DATE '2024-01-15' AND stop_id NOT IN (SELECT stop_id FROM predictions WHERE day < DATE '2024-01-15') GROUP BY 1""".replace("WHERE i9 = 0", "WHERE CAST(stop_id AS BIGINT) % 9 = 0"))
def first_seal(spark, d):
    log = a.predictions_events(spark, d)
    again = log.where(F.col("stop_id").cast("long") % 9 == 0).withColumn("predicted_at", F.col("predicted_at") + F.make_dt_interval(hours=F.lit(1)))
    old = F.col("day") < F.lit("2024-01-15").cast("date")
    return naive(g.anti_append(log.union(again).where(~old), log.where(old)), "predicted_at").select("stop_id", "predicted_at")



def total_sql(x):
    """DuckDB: an exact sum, in whole billionths as the operators have it."""
    return f"(sum(round(({x}) * 1e9)::HUGEINT)::DOUBLE / 1e9)"


def mean_sql(x):
    return f"({total_sql(x)} / count({x}))"


def fixed(df, digits=6):
    """df with doubles of so many digits, by the same arithmetic as fixed_sql."""
    unit = 10.0**digits
    return df.select(*[(F.floor(F.col(c) * unit + 0.5).cast("double") / unit).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def fixed_sql(x, digits=6):
    return f"(floor(({x}) * {10**digits}::DOUBLE + 0.5) / {10**digits}::DOUBLE)"


def auc_sql(src, by, y="y", prob="delay_probability", name=""):
    """DuckDB: rank metrics over distinct scores."""
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""scores{name} AS (SELECT {k}{prob} AS s, sum({y}) AS pos, count(*) - sum({y}) AS neg FROM {src} GROUP BY ALL
), cum{name} AS (
  SELECT *, sum(neg) OVER ({part}ORDER BY s) - neg AS below, sum(pos) OVER ({part}ORDER BY s DESC) AS tp, sum(neg) OVER ({part}ORDER BY s DESC) AS fp FROM scores{name}
), ranked{name} AS (
  SELECT {k}sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc, {total_sql("pos * (tp / (tp + fp))")} / sum(pos) AS pr_auc, sum(pos) > 0 AND sum(neg) > 0 AS mixed FROM cum{name} {f'GROUP BY {by}' if by else ''}
)"""


def ece_sql(src, by, y="y", prob="delay_probability", name="ece"):
    k = f"{by}, " if by else ""
    return f"""bins_{name} AS (SELECT {k}least(greatest(CAST(trunc({prob} * 10) AS INTEGER), 0), 9) AS bin, count(*) AS n, sum(round({prob} * 1e9)::HUGEINT) AS p, sum(round({y} * 1e9)::HUGEINT) AS o FROM {src} GROUP BY ALL
), eces_{name} AS (SELECT {k}sum(abs(p - o))::DOUBLE / 1e9 / sum(n) AS {name} FROM bins_{name} {f'GROUP BY {by}' if by else ''})"""


@query("roc_auc", f"WITH {SCORED}, {auc_sql('scored', '')} SELECT {fixed_sql('roc_auc')} AS roc_auc FROM ranked")
def roc_auc(spark, d):
    return fixed(m.rank_metrics(scored(spark, d), "y", "delay_probability").select("roc_auc"))


@query("average_precision", f"WITH {SCORED}, {auc_sql('scored', '')} SELECT {fixed_sql('pr_auc')} AS pr_auc FROM ranked")
def average_precision(spark, d):
    return fixed(m.rank_metrics(scored(spark, d), "y", "delay_probability").select("pr_auc"))


@query("brier", f"WITH {SCORED} SELECT {fixed_sql(mean_sql('(delay_probability - y) * (delay_probability - y)'))} AS brier, {fixed_sql(mean_sql('y'))} AS base_rate FROM scored")
def brier(spark, d):
    return fixed(m.classification_metrics(scored(spark, d), "y", "delay_probability").select("brier", "base_rate"))


@query("ece", f"WITH {SCORED}, {ece_sql('scored', '')} SELECT {fixed_sql('ece')} AS ece FROM eces_ece")
def ece(spark, d):
    return fixed(m.expected_calibration_error(scored(spark, d), "y", "delay_probability"))


@query("reliability", f"WITH {SCORED}, {ece_sql('scored', '')} SELECT bin, n, {fixed_sql('p::DOUBLE / 1e9 / n')} AS mean_prob, {fixed_sql('o::DOUBLE / 1e9 / n')} AS observed FROM bins_ece")
def reliability(spark, d):
    return fixed(m.reliability_table(scored(spark, d), "y", "delay_probability"))


def pinball_sql(y, q, alpha):
    return mean_sql(f"greatest({alpha}::DOUBLE * ({y} - {q}), ({alpha}::DOUBLE - 1) * ({y} - {q}))")


QUANTILES = {"pinball_p50": pinball_sql("actual_delay_min", "delay_p50_min", 0.5), "pinball_p90": pinball_sql("actual_delay_min", "delay_p90_min", 0.9), "mae_p50": mean_sql("abs(actual_delay_min - delay_p50_min)"), "coverage_p90": "avg((actual_delay_min <= delay_p90_min)::INT)"}


@query("quantile_metrics", f"WITH {SCORED} SELECT " + ", ".join(f"{fixed_sql(v)} AS {c}" for c, v in QUANTILES.items()) + " FROM scored")
def quantile_metrics(spark, d):
    y = F.col("actual_delay_min").cast("double")
    return fixed(scored(spark, d).agg(*[v.alias(c) for c, v in m.quantile_metrics(y, F.col("delay_p50_min"), F.col("delay_p90_min")).items()]))


REPORT = f"""WITH {SCORED}, {auc_sql('scored', 'day')}, {ece_sql('scored', 'day')}, counts AS (
  SELECT day, count(*) AS n_predictions, count(*) FILTER (is_canceled) AS n_canceled, count(*) FILTER (NOT is_canceled) AS n_evaluated,
         coalesce(avg((changed_time IS NOT NULL)::INT) FILTER (NOT is_canceled), 0) AS share_with_observed_change, coalesce(avg((coverage = 'train')::INT) FILTER (NOT is_canceled), 0) AS coverage_train_share
  FROM truth GROUP BY day
), q AS (SELECT day, {mean_sql('(delay_probability - y) * (delay_probability - y)')} AS brier, {mean_sql('y')} AS base_rate, {", ".join(f"{v} AS {c}" for c, v in QUANTILES.items())} FROM scored GROUP BY day)"""


@query("daily_report", f"""{REPORT} SELECT day, n_predictions, n_canceled, n_evaluated, {", ".join(f"{fixed_sql(c)} AS {c}" for c in ("share_with_observed_change", "coverage_train_share", *QUANTILES, "base_rate"))},
  {", ".join(f"CASE WHEN mixed THEN {fixed_sql(c)} END AS {c}" for c in ("roc_auc", "pr_auc", "brier", "ece"))} FROM counts LEFT JOIN q USING (day) LEFT JOIN ranked USING (day) LEFT JOIN eces_ece USING (day)""")
def daily_report(spark, d):
    return fixed(g.daily_report(truth(spark, d)))


@query("daily_report_raw", f"""WITH {SCORED}, raw AS (SELECT * FROM scored WHERE raw_delay_probability IS NOT NULL), {ece_sql('raw', 'day', prob='raw_delay_probability', name='ece_raw')}
SELECT day, count(*) AS n_corrected, {fixed_sql('avg((actual_delay_min <= raw_delay_p90_min)::INT)')} AS coverage_p90_raw, CASE WHEN avg(y) > 0 AND avg(y) < 1 THEN {fixed_sql('any_value(ece_raw)')} END AS ece_raw
FROM raw JOIN eces_ece_raw USING (day) GROUP BY day HAVING count(*) >= 100""")
def daily_report_raw(spark, d):
    return fixed(g.uncorrected_report(truth(spark, d)))


SERIES = f"""{REPORT}, series AS (SELECT day, CASE WHEN mixed THEN {fixed_sql('ece')} END AS ece, CASE WHEN mixed THEN {fixed_sql('roc_auc')} END AS roc_auc FROM counts LEFT JOIN ranked USING (day) LEFT JOIN eces_ece USING (day))"""


def series(spark, d):
    return fixed(g.daily_report(truth(spark, d)).select("day", "ece", "roc_auc"))


@query("metrics_upsert", f"{SERIES} SELECT day, CASE WHEN day >= DATE '2024-01-25' THEN 0.5::DOUBLE ELSE ece END AS ece, CASE WHEN day < DATE '2024-01-25' THEN roc_auc END AS roc_auc, CASE WHEN day >= DATE '2024-01-25' THEN 'new' END AS note FROM series")
def metrics_upsert(spark, d):
    s = series(spark, d)
    fresh = s.where(F.col("day") >= F.lit("2024-01-25").cast("date")).select("day", F.lit(0.5).alias("ece"), F.lit("new").alias("note"))
    return g.upsert_daily_metrics(s, fresh)


@query("triggers", f"""{SERIES}, tail AS (SELECT * FROM series ORDER BY day DESC LIMIT 3), r AS (
  SELECT concat_ws('; ', CASE WHEN count(*) >= 3 AND bool_and(coalesce(ece > 0.08, false)) THEN 'ece > 0.08 for 3 consecutive days' END,
    CASE WHEN count(*) >= 3 AND bool_and(coalesce(roc_auc < 0.70, false)) THEN 'roc_auc < 0.7 for 3 consecutive days' END, 'feature freshness 50d > 45d') AS trigger_reasons FROM tail
) SELECT trigger_reasons, trigger_reasons <> '' AS retraining_recommended FROM r""")
def triggers(spark, d):
    return g.trigger_reasons(series(spark, d), 50)


@query("monitoring_tail", f"{SERIES} SELECT * FROM series ORDER BY day DESC LIMIT 30")
def monitoring_tail(spark, d):
    return g.monitoring_tail(series(spark, d))


STATE = f"""{a.LOGS}, seen AS (SELECT *, coalesce(changed_time, scheduled_time) AS obs_time FROM truth WHERE NOT is_canceled AND coalesce(changed_time, scheduled_time) >= {NOW} - INTERVAL 60 MINUTE AND coalesce(changed_time, scheduled_time) < {NOW}
), state AS (
  SELECT CASE grouping(station_name, train_type) WHEN 1 THEN 'station' WHEN 2 THEN 'type' ELSE 'network' END AS scope, coalesce(station_name, train_type) AS key,
         avg(actual_delay_min) AS mean_delay_60m, avg((actual_delay_min >= 6)::INT) AS delayed_share_60m, count(*) AS n_60m
  FROM seen GROUP BY GROUPING SETS ((station_name), (train_type), ()) HAVING count(*) > 0
)"""


def state(spark, d):
    return g.live_state(a.predictions_events(spark, d), a.changes_events(spark, d), a.now())


@query("live_state", f"WITH {STATE} SELECT scope, key, round(mean_delay_60m, 6) AS mean_delay_60m, round(delayed_share_60m, 6) AS delayed_share_60m, n_60m FROM state")
def live_state(spark, d):
    return rounded(state(spark, d))


@query("live_summary", f"WITH {STATE} SELECT count(*) FILTER (scope = 'station') AS stations_with_state, count(*) FILTER (scope = 'type') AS types_with_state, round(max(mean_delay_60m) FILTER (scope = 'network'), 2) AS mean_delay_60m, round(max(delayed_share_60m) FILTER (scope = 'network'), 4) AS delayed_share_60m FROM state")
def live_summary(spark, d):
    return g.live_summary(state(spark, d))


def requests(spark, d):
    """A request for every stop, some of stations and trains that are unknown."""
    i = F.col("id").cast("long")
    s = a.stops_events(spark, d).withColumn("scheduled_time", F.col("time"))
    return s.select("id", F.when(i % 70 == 0, "S99").otherwise(F.col("station_name")).alias("station_name"), "train_type", F.when(i % 30 == 0, "none").otherwise(F.col("train_number")).alias("train_number"), "train_line_station_num", "scheduled_time", F.to_date("time").alias("event_date"))


REQUESTS = """requests AS (
  SELECT id, CASE WHEN CAST(id AS BIGINT) % 70 = 0 THEN 'S99' ELSE station_name END AS station_name, train_type, CASE WHEN CAST(id AS BIGINT) % 30 = 0 THEN 'none' ELSE train_number END AS train_number,
         train_line_station_num, time AS scheduled_time, CAST(time AS DATE) AS event_date FROM stops
)"""
LIVE_COLUMNS = ["station_live_mean_delay_60m", "station_live_delayed_share_60m", "station_live_n_60m", "type_live_mean_delay_60m", "type_live_delayed_share_60m", "network_live_mean_delay_60m", "network_live_delayed_share_60m"]
LIVE = f"""{STATE}, {REQUESTS}, live AS (
  SELECT r.*, s.mean_delay_60m AS station_live_mean_delay_60m, s.delayed_share_60m AS station_live_delayed_share_60m, coalesce(s.n_60m, 0) AS station_live_n_60m, y.mean_delay_60m AS type_live_mean_delay_60m,
         y.delayed_share_60m AS type_live_delayed_share_60m, n.mean_delay_60m AS network_live_mean_delay_60m, n.delayed_share_60m AS network_live_delayed_share_60m
  FROM requests r LEFT JOIN state s ON s.scope = 'station' AND s.key = r.station_name LEFT JOIN state y ON y.scope = 'type' AND y.key = r.train_type LEFT JOIN state n ON n.scope = 'network'
)"""


@query("live_features", f"WITH {LIVE} SELECT id, {round_sql(LIVE_COLUMNS)} FROM live")
def live_features(spark, d):
    return rounded(g.live_features(requests(spark, d), state(spark, d)).select("id", *LIVE_COLUMNS))


def stored(df, name):
    """A snapshot as the table that lookups read, so that its statistics are made once."""
    return t.read_snapshot(df.sparkSession, t.write_snapshot(df, t.shared_path(df.sparkSession, name)))


def snap(spark, d):
    """Statistics as of the 12th, from the stops themselves, stored."""
    s = a.stops_events(spark, d).where(~F.col("is_canceled")).withColumn("event_date", F.to_date("time"))
    return stored(b.snapshot(s.where(F.col("event_date") < F.lit("2024-01-12").cast("date")), h.latest_stats), "snapshot")


def overlay(spark, d):
    return stored(b.snapshot(g.observed_stops(a.predictions_events(spark, d), a.changes_events(spark, d), a.now()), h.latest_stats), "overlay")


def latest_sql(cte, src):
    """DuckDB: snapshot table of all granularities from stops with event_date."""
    parts, unions = [], []
    for prefix, keys in h.GRANULARITIES.items():
        parts.append(rolled(prefix, keys).replace("planned", src).replace(f"daily_{prefix}", f"{cte}_daily_{prefix}").replace(f"rolling_{prefix}", f"{cte}_rolling_{prefix}"))
        cols = ", ".join(f"{c} AS {x}" for c, x in zip(h.stat_columns(prefix), ("m14", "r14", "m30", "r30", "n30")))
        second = keys[1] if len(keys) > 1 else "CAST(NULL AS VARCHAR)"
        unions.append(f"SELECT '{prefix}' AS granularity, {keys[0]} AS key1, {second} AS key2, join_date, {cols} FROM {cte}_rolling_{prefix} QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY join_date DESC) = 1")
    return f"{', '.join(parts)}, {cte} AS ({' UNION ALL '.join(unions)})"


SNAP = f"dated AS (SELECT *, CAST(time AS DATE) AS event_date FROM stops WHERE NOT is_canceled AND CAST(time AS DATE) < DATE '2024-01-12'), {latest_sql('snap', 'dated')}"
OBSERVED = f"""observed AS (SELECT station_name, train_type, train_number, actual_delay_min::INT AS delay_in_min, is_canceled, CAST(scheduled_time AS DATE) AS event_date FROM truth WHERE day >= {TODAY} - 35 AND CAST(scheduled_time AS DATE) < {TODAY})"""
OVERLAY = f"{OBSERVED}, seenstops AS (SELECT * FROM observed WHERE NOT is_canceled), {latest_sql('overlay', 'seenstops')}"
STATS = ", ".join(f"round({c}, 6) AS {c}" for c in ("m14", "r14", "m30", "r30"))


@query("observed_stops", f"WITH {a.LOGS}, {OBSERVED} SELECT * FROM observed")
def observed_stops(spark, d):
    return g.observed_stops(a.predictions_events(spark, d), a.changes_events(spark, d), a.now())


for granularity in h.GRANULARITIES:

    @query(f"overlay_{granularity}", f"WITH {a.LOGS}, {OVERLAY} SELECT key1, key2, join_date, {STATS}, n30 FROM overlay WHERE granularity = '{granularity}'")
    def overlay_of(spark, d, granularity=granularity):
        return rounded(overlay(spark, d).where(F.col("granularity") == granularity).drop("granularity"))


@query("overlay_increments", f"WITH {a.LOGS}, {OVERLAY} SELECT granularity, key1, key2, join_date, {STATS}, n30 FROM overlay")
def overlay_increments(spark, d):
    """The overlay kept by increments: changes of the first days before their seals, the rest in two batches, the last
    one twice, and its parts merged between."""
    path, early = t.shared_path(spark, "overlay_parts"), F.lit("2024-01-08").cast("timestamp")
    p, c = a.predictions_events(spark, d), a.changes_events(spark, d)
    last = p.where(F.col("predicted_at") >= early), c.where(F.col("observed_at") >= a.now())
    batches = [(p.where(F.lit(False)), c.where(F.col("observed_at") < early)), (p.where(F.col("predicted_at") < early), c.where((F.col("observed_at") >= early) & (F.col("observed_at") < a.now()))), last, last]
    for i, batch in enumerate(batches):
        o.refresh_overlay(*batch, path)
        if i == 2:
            o.merge_overlay(spark, path, a.now(), folders=1)
    return rounded(o.overlay_statistics(spark, path, a.now()))


@query("snapshot_entities", f"WITH {a.STOPS}, {SNAP} SELECT granularity, count(*) AS n FROM snap GROUP BY 1")
def snapshot_entities(spark, d):
    return snap(spark, d).groupBy("granularity").agg(F.count(F.lit(1)).alias("n"))


def lookup_sql(also=""):
    joins, cols, cover = [], [], []
    for prefix, keys in h.GRANULARITIES.items():
        for x in ("overlay", "snap"):
            on = f"{prefix}_{x}.key1 = r.{keys[0]}" + (f" AND {prefix}_{x}.key2 = r.{keys[1]}" if len(keys) > 1 else "")
            joins.append(f"LEFT JOIN {x} {prefix}_{x} ON {prefix}_{x}.granularity = '{prefix}' AND {on} AND r.event_date - {prefix}_{x}.join_date BETWEEN 0 AND 30" + also.format(table=f"{prefix}_{x}"))
        hit = f"{prefix}_overlay.join_date IS NOT NULL"
        for c, v in zip(h.stat_columns(prefix), ("m14", "r14", "m30", "r30", "n30")):
            e = f"CASE WHEN {hit} THEN {prefix}_overlay.{v} ELSE {prefix}_snap.{v} END"
            cols.append(f"{e} AS {c}" if v == "n30" else f"round({e}, 6) AS {c}")
        cover.append(f"WHEN coalesce({prefix}_overlay.join_date, {prefix}_snap.join_date) IS NOT NULL THEN '{prefix}'")
    return f"SELECT r.id, CASE {' '.join(cover)} ELSE 'cold' END AS coverage, {', '.join(cols)} FROM requests r {' '.join(joins)}"


HISTORY = [c for x in h.GRANULARITIES for c in h.stat_columns(x)]


@query("snapshot_lookup", f"WITH {a.LOGS}, {REQUESTS}, {SNAP}, {OVERLAY} {lookup_sql()}")
def snapshot_lookup(spark, d):
    return rounded(b.snapshot_lookup(requests(spark, d), snap(spark, d), overlay(spark, d)).select("id", "coverage", *HISTORY))


@query("coverage_mix", f"WITH {a.LOGS}, {REQUESTS}, {SNAP}, {OVERLAY}, x AS ({lookup_sql()}) SELECT coverage, count(*) AS n FROM x GROUP BY 1")
def coverage_mix(spark, d):
    return b.snapshot_lookup(requests(spark, d), snap(spark, d), overlay(spark, d)).groupBy("coverage").agg(F.count(F.lit(1)).alias("n"))


def assembled(spark, d):
    r = add_calendar_features(requests(spark, d).drop("event_date"), holidays(spark, a.HORIZON_YEAR))
    return g.live_features(b.snapshot_lookup(r, snap(spark, d), overlay(spark, d)), state(spark, d))


CAL = ["scheduled_hour", "weekday", "month", "is_weekend", "is_holiday"]


@query("assembled_features", f"WITH {LIVE}, {SNAP}, {OVERLAY}, x AS ({lookup_sql()}) SELECT x.*, {round_sql(LIVE_COLUMNS)}, {CALENDAR} FROM x JOIN live USING (id)")
def assembled_features(spark, d):
    return rounded(assembled(spark, d).select("id", "coverage", *HISTORY, *LIVE_COLUMNS, *CAL))


@query("feature_null_rate", f"WITH {a.LOGS}, {REQUESTS}, {SNAP}, {OVERLAY}, x AS ({lookup_sql()}) SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(({c} IS NULL)::INT), 3) AS null_rate FROM x" for c in HISTORY) + ") WHERE null_rate > 0")
def feature_null_rate(spark, d):
    return p.feature_null_rate(b.snapshot_lookup(requests(spark, d), snap(spark, d), overlay(spark, d)), HISTORY)


@query("freshness", f"WITH {a.LOGS}, {SNAP}, {OVERLAY} SELECT {TODAY} - max(s.join_date) AS stats_age_days, least({TODAY} - max(s.join_date), greatest(0, {TODAY} - (SELECT max(join_date) FROM overlay))) AS feature_freshness_days FROM snap s")
def freshness(spark, d):
    return b.freshness(snap(spark, d), overlay(spark, d), F.to_date(a.now())).select(*[F.col(c).cast("long").alias(c) for c in ("stats_age_days", "feature_freshness_days")])


BOARD = f"""WITH {a.LOGS}, one AS (SELECT * FROM truth QUALIFY row_number() OVER (PARTITION BY station_name, train_type, train_number, scheduled_time ORDER BY predicted_at, stop_id) = 1
), placed AS (
  SELECT *, trunc(epoch_us(changed_time - scheduled_time) / 60000000.0)::BIGINT AS db_live_delay_min, row_number() OVER (PARTITION BY station_name, scheduled_time >= {NOW} ORDER BY abs(epoch_us(scheduled_time - {NOW})), stop_id)::INTEGER AS place
  FROM one WHERE scheduled_time >= {NOW} - INTERVAL 24 HOUR
) SELECT station_name, place, stop_id, scheduled_time, actual_delay_min, db_live_delay_min, is_canceled, CASE WHEN delay_probability >= 0.4 THEN 'high' WHEN delay_probability >= 0.2 THEN 'mid' ELSE 'low' END AS risk, actual_delay_min <= delay_p90_min AS within_p90
FROM placed WHERE place <= 25 AND scheduled_time @ {NOW}"""


def board(spark, d, side):
    out = g.board(a.predictions_events(spark, d), a.changes_events(spark, d), a.now()).where(F.col("side") == side)
    return naive(out, "scheduled_time").select("station_name", "place", "stop_id", "scheduled_time", "actual_delay_min", "db_live_delay_min", "is_canceled", "risk", "within_p90")


@query("board_upcoming", BOARD.replace("@", ">="))
def board_upcoming(spark, d):
    return board(spark, d, "upcoming")


@query("board_departed", BOARD.replace("@", "<"))
def board_departed(spark, d):
    return board(spark, d, "departed")


PAIRS = f"""{a.LOGS}, cal AS (
  SELECT p.*, l.changed_time, coalesce(l.is_canceled, false) AS is_canceled, coalesce(trunc(epoch_us(l.changed_time - p.scheduled_time) / 60000000.0), 0)::BIGINT AS actual_delay_min
  FROM predictions p LEFT JOIN (SELECT * FROM changes WHERE day BETWEEN {TODAY} - 7 AND {TODAY} QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY observed_at DESC, changed_time DESC NULLS LAST) = 1) l USING (stop_id)
  WHERE p.day BETWEEN {TODAY} - 7 AND {TODAY} - 1
), settled AS (
  SELECT model_version, scheduled_time, coalesce(raw_delay_probability, delay_probability) AS model_probability, coalesce(raw_delay_p90_min, delay_p90_min)::DOUBLE AS model_p90_min, actual_delay_min
  FROM cal WHERE NOT is_canceled AND scheduled_time < {NOW} - INTERVAL 3 HOUR
), pairs AS (SELECT * FROM settled WHERE model_version = (SELECT max(model_version) FROM settled))"""


def pairs(spark, d):
    return k.collect_pairs(a.predictions_events(spark, d), a.changes_events(spark, d), a.now())


@query("calibration_pairs", f"WITH {PAIRS} SELECT model_version, scheduled_time, round(model_probability, 6) AS model_probability, model_p90_min, actual_delay_min FROM pairs")
def calibration_pairs(spark, d):
    return rounded(naive(pairs(spark, d), "scheduled_time"))


@query("current_model_pairs", f"WITH {a.LOGS} SELECT stop_id, model_version FROM predictions WHERE model_version = (SELECT max(model_version) FROM predictions)")
def current_model_pairs(spark, d):
    return k.current_model(a.predictions_events(spark, d)).select("stop_id", "model_version")


@query("conformal_offset", f"WITH {PAIRS} SELECT round(quantile_cont(actual_delay_min - model_p90_min, 0.9), 2) AS p90_delta_min FROM pairs")
def conformal_offset(spark, d):
    return k.conformal_offset(pairs(spark, d))


CURVE_X, CURVE_Y, DELTA = [0.1, 0.4, 0.9], [0.05, 0.3, 0.6], 3.0
INTERPOLATED = "CASE WHEN {p} <= 0.1 THEN 0.05 WHEN {p} >= 0.9 THEN 0.6 WHEN {p} < 0.4 THEN 0.05 + 0.25 * ({p} - 0.1) / 0.3 ELSE 0.3 + 0.3 * ({p} - 0.4) / 0.5 END"


@query("apply_calibration", f"""WITH {a.LOGS} SELECT stop_id, round(CASE WHEN model_version = 'v2' THEN {INTERPOLATED.format(p='delay_probability')} ELSE delay_probability END, 6) AS delay_probability,
  CASE WHEN model_version = 'v2' THEN greatest(delay_p50_min, delay_p90_min + 3.0)::DOUBLE ELSE delay_p90_min::DOUBLE END AS delay_p90_min FROM predictions""")
def apply_calibration(spark, d):
    return rounded(k.apply_calibration(a.predictions_events(spark, d), CURVE_X, CURVE_Y, DELTA, "v2").select("stop_id", "delay_probability", F.col("delay_p90_min").cast("double").alias("delay_p90_min")))


@query("calibration_gate", f"""WITH {PAIRS}, h AS (SELECT *, (actual_delay_min >= 6)::INT::DOUBLE AS y, {INTERPOLATED.format(p='model_probability')}::DOUBLE AS c FROM pairs WHERE scheduled_time >= {NOW} - INTERVAL 1 DAY),
  {ece_sql('h', '', prob='model_probability', name='ece_raw')}, {ece_sql('h', '', prob='c', name='ece_corrected')}, cov AS (SELECT count(*) AS n_holdout, avg((actual_delay_min <= model_p90_min)::INT) AS coverage_raw, avg((actual_delay_min <= model_p90_min + 3)::INT) AS coverage_corrected FROM h)
  SELECT n_holdout, round(ece_raw, 6) AS ece_raw, round(ece_corrected, 6) AS ece_corrected, round(coverage_raw, 6) AS coverage_raw, round(coverage_corrected, 6) AS coverage_corrected, ece_corrected < ece_raw AS probability_correction_helps,
    abs(coverage_corrected - 0.9) < abs(coverage_raw - 0.9) AS p90_correction_helps FROM cov, eces_ece_raw, eces_ece_corrected""")
def calibration_gate(spark, d):
    recent = F.col("scheduled_time") >= a.now() - F.make_dt_interval(days=F.lit(1))
    return rounded(k.validate_correction(pairs(spark, d).where(recent), CURVE_X, CURVE_Y, DELTA))


@query("isotonic_curve", f"""WITH {PAIRS}, points AS (
  SELECT model_probability AS p, count(*) AS w, sum((actual_delay_min >= 6)::INT) AS s FROM pairs GROUP BY 1
), sums AS (
  SELECT *, row_number() OVER (ORDER BY p) AS i, sum(w) OVER (ORDER BY p) AS cw, sum(s) OVER (ORDER BY p) AS cs FROM points
), means AS (
  SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s)::DOUBLE / (b.cw - a.cw + a.w)::DOUBLE AS m FROM sums a JOIN sums b ON b.i >= a.i
), least_mean AS (
  SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS m FROM means
), fit AS (SELECT i, max(m) AS y FROM least_mean GROUP BY i
), pools AS (SELECT y, min(p) AS lo, max(p) AS hi FROM fit JOIN sums USING (i) GROUP BY y)
SELECT round(lo, 6) AS x, round(y, 6) AS y FROM pools UNION SELECT round(hi, 6), round(y, 6) FROM pools""")
def isotonic_curve(spark, d):
    """The pools against the greatest of the least means over all ranges that hold a point."""
    xs, ys = k.isotonic_curve(pairs(spark, d))
    return spark.createDataFrame(list(zip(xs, ys)), "x double, y double")


@query("calibration_result")
def calibration_result(spark, d):
    """The correction that is published, read back; no row if none helps."""
    path = t.shared_path(spark, "calibration")
    k.rebuild(a.predictions_events(spark, d), a.changes_events(spark, d), a.now(), a.NOW, path, 500)
    back = t.read_calibration(spark, path, "v2")
    rows = [] if back is None else [(back["model_version"], back["n_samples"], back["curve_x"], back["curve_y"], back["p90_delta_min"])]
    return spark.createDataFrame(rows, "model_version string, n_samples long, curve_x array<double>, curve_y array<double>, p90_delta_min double")


@query("score_postprocess", f"WITH {a.LOGS}, s AS (SELECT stop_id, delay_p50_min - 3.0::DOUBLE AS p50, delay_p90_min - 9.0::DOUBLE AS p90 FROM predictions) SELECT stop_id, greatest(p50, 0) AS p50, greatest(p90, p50, 0) AS p90 FROM s")
def score_postprocess(spark, d):
    s = a.predictions_events(spark, d).select("stop_id", (F.col("delay_p50_min") - 3.0).alias("p50"), (F.col("delay_p90_min") - 9.0).alias("p90"))
    return b.score_postprocess(s)
