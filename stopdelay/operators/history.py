"""Trailing history of entities, free of leaks: a stop sees days before its own only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import LATE_MIN
from ..sources.tables import written

#: Days of a window, and the entities that have a history.
WINDOWS = (14, 30)
GRANULARITIES = {"train": ["train_type", "train_number"], "station_type": ["station_name", "train_type"], "type": ["train_type"]}


#: Rows up to which a table that was counted is broadcast.
FEW_ROWS = 200_000


def stat_columns(prefix: str, windows: Sequence[int] = WINDOWS) -> list[str]:
    return [f"{prefix}_{s}_{w}d" for w in windows for s in ("mean_delay", "delayed_rate")] + [f"{prefix}_count_{windows[-1]}d"]


def daily_aggregates(df: DataFrame, keys: Sequence[str], threshold: int = LATE_MIN) -> DataFrame:
    """Sums of a day's delays and late stops, and its rows (those without a delay too), canceled ones left out."""
    late = F.coalesce((F.col("delay_in_min") >= threshold).cast("long"), F.lit(0).cast("long"))
    return df.where(~F.col("is_canceled")).groupBy(*keys, "event_date").agg(F.coalesce(F.sum("delay_in_min"), F.lit(0)).alias("delay_sum"), F.sum(late).alias("delayed_sum"), F.count(F.lit(1)).alias("n"))


def rolling_from_daily(daily: DataFrame, keys: Sequence[str], prefix: str, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Stats of the w days up to each active day, known from the next day (join_date) on."""
    out = {}
    for w in windows:
        span = W.partitionBy(*keys).orderBy(F.unix_date("event_date")).rangeBetween(-(w - 1), 0)
        n = F.sum("n").over(span)
        out[f"{prefix}_mean_delay_{w}d"] = F.sum("delay_sum").over(span) / n
        out[f"{prefix}_delayed_rate_{w}d"] = F.sum("delayed_sum").over(span) / n
    out[f"{prefix}_count_{windows[-1]}d"] = n
    return daily.withColumns(out).withColumn("join_date", F.date_add("event_date", 1)).select(*keys, "event_date", "join_date", *stat_columns(prefix, windows))


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str], tolerance: Column | None = None, allow_exact: bool = True, every: str | None = None) -> DataFrame:
    """left with the columns of right's last row at or before it with equal `by`; all of left stays.

    tolerance is a condition over left_on and right_on (inclusive as written); rows with a null key or time find nothing.
    Among rows of right that tie in time the one with the greatest remaining columns counts. One shuffle and sort by key
    serves all rows; `every` ('DAY', 'HOUR', ...) deals a key's rows out by time as well, for keys that hold a large
    share of all rows: each piece then takes what the pieces before it end with.
    """
    values = [c for c in right.columns if c not in by]
    keys = [f"_k{i}" for i in range(len(by))]
    of = lambda df, ts: [F.col(c).alias(k) for c, k in zip(by, keys)] + [F.col(ts).alias("_t")]
    r = right.dropna(subset=[*by, right_on]).select(*of(right, right_on), F.struct(F.col(right_on).alias("_at"), *[F.col(c) for c in values]).alias("_r"), F.lit(None).cast(left.schema.simpleString()).alias("_l"))
    l = left.select(*of(left, left_on), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*[F.col(c) for c in left.columns]).alias("_l"))  # noqa: E741
    both = r.unionByName(l).withColumn("_side", F.col("_l").isNotNull().cast("int"))
    piece = [F.date_trunc(every, "_t").alias("_piece")] if every else []
    if every:
        both = both.withColumn("_piece", piece[0])
    parts = keys + (["_piece"] if every else [])
    order = [F.col("_t"), F.col("_side") if allow_exact else F.col("_side").desc(), F.col("_r")]
    span = W.partitionBy(*parts).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = both.withColumn("_hit", F.last("_r", ignorenulls=True).over(span)).where("_side = 1")
    if every:
        ends = both.where("_side = 0").groupBy(*parts).agg(F.max(F.struct("_t", "_r"))["_r"].alias("_end"))
        pieces = both.select(*parts).distinct().join(ends, parts, "left")
        before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
        carried = pieces.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select(*parts, "_carried")
        out = out.join(carried, parts, "left").withColumn("_hit", F.coalesce("_hit", "_carried"))
    ok = F.lit(True)
    for k in (*keys, "_t"):
        ok = ok & F.col(k).isNotNull()
    out = out.select("_l.*", F.when(ok, F.col("_hit")).alias("_hit"))
    if tolerance is not None:
        out = out.withColumn(right_on if right_on not in left.columns else "_at", F.col("_hit._at"))
        out = out.withColumn("_hit", F.when(tolerance, F.col("_hit")))
    return out.select(*left.columns, *[F.col("_hit")[c].alias(c) for c in values])


def rolling_before(daily: DataFrame, prefix: str, keys: Sequence[str], windows: Sequence[int] = WINDOWS) -> DataFrame:
    """For each active day of an entity the stats of its last active day before, null where they are older than the window."""
    stats = rolling_from_daily(daily, keys, prefix, windows)
    cols = stat_columns(prefix, windows)
    last = F.lag(F.struct("join_date", *cols)).over(W.partitionBy(*keys).orderBy("event_date"))
    prior = stats.select(*keys, "event_date", last.alias("_s"))
    age = F.date_diff("event_date", F.col("_s.join_date"))
    # the column's own window is its tolerance
    known = [F.when(age <= int(c.rsplit("_", 1)[1][:-1]), F.col("_s")[c]).alias(c) for c in cols]
    return prior.select(*keys, "event_date", *known)


def attach_rolling(df: DataFrame, prefix: str, keys: Sequence[str], windows: Sequence[int] = WINDOWS, daily: DataFrame | None = None, few: bool = False) -> DataFrame:
    """Stats of the entity's last active day before the stop's.

    Every stop's own day is in the daily table, so "the last day before" is the row before in that small table, and
    the stops themselves need an equi-join only. daily: the entity's daily sums, if they are there already; few: whether
    they are known to be few enough to be broadcast.
    """
    table = rolling_before(daily_aggregates(df, keys) if daily is None else daily, prefix, keys, windows)
    return df.join(F.broadcast(table) if few else table, [*keys, "event_date"], "left")


def add_rolling_stats(df: DataFrame, windows: Sequence[int] = WINDOWS, source: DataFrame | None = None) -> DataFrame:
    """df with the stats of all entities. source: the stops without what was joined to df before; sums are of these.

    The sums of the coarse entities are written once, by station and type; those by type are summed from them.
    """
    source = (df if source is None else source).select("station_name", "train_type", "train_number", "event_date", "delay_in_min", "is_canceled")
    daily = written(daily_aggregates(source, GRANULARITIES["station_type"]), "daily")
    few = daily.count() <= FEW_ROWS
    by_type = daily.groupBy(*GRANULARITIES["type"], "event_date").agg(*[F.sum(c).alias(c) for c in ("delay_sum", "delayed_sum", "n")])
    tables = {"train": (daily_aggregates(source, GRANULARITIES["train"]), False), "station_type": (daily, few), "type": (by_type, few)}
    for prefix, keys in GRANULARITIES.items():
        df = attach_rolling(df, prefix, keys, windows, *tables[prefix])
    return df


def latest_of_daily(daily: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """An entity's stats as of its last active day, from its daily sums."""
    stats = rolling_from_daily(daily, keys, prefix)
    cols = ["join_date", *stat_columns(prefix)]
    return stats.groupBy(*keys).agg(F.max_by(F.struct(*cols), "join_date").alias("_s")).select(*keys, *[F.col("_s")[c].alias(c) for c in cols])


def latest_stats(df: DataFrame, keys: Sequence[str], prefix: str) -> DataFrame:
    """An entity's stats as of its last active day."""
    return latest_of_daily(daily_aggregates(df, keys), keys, prefix)
