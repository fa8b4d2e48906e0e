"""The state of the network in the hour before a prediction was sealed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import LATE_MIN, seal_time
from ..sources.tables import written
from .history import FEW_ROWS

SCOPES = {"station_live": ["station_name"], "type_live": ["train_type"], "network_live": []}


def state_columns(scope: str) -> list[str]:
    return [f"{scope}_mean_delay_60m", f"{scope}_delayed_share_60m"] + ([f"{scope}_n_60m"] if scope == "station_live" else [])


NETWORK_STATE_COLUMNS = [c for s in SCOPES for c in state_columns(s)]


def late(threshold: int = LATE_MIN) -> Column:
    return F.coalesce((F.col("delay_in_min") >= threshold).cast("long"), F.lit(0).cast("long"))


def bucketed(obs: DataFrame, keys: Sequence[str], every: str = "5 minutes", time: str = "time") -> DataFrame:
    """Sums by bucket, known from the bucket's end (avail) on."""
    g = obs.groupBy(*keys, F.window(time, every).alias("_w")).agg(F.sum("delay_in_min").alias("delay"), F.sum(late()).alias("delayed"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("_w.end").alias("avail"), "delay", "delayed", "n")


def cumulative(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running sums of buckets by key; for keys that hold few buckets each."""
    up = W.partitionBy(*keys).orderBy("avail").rowsBetween(W.unboundedPreceding, 0)
    return buckets.withColumns({c: F.sum(c).over(up) for c in ("delay", "delayed", "n")})


def hourly_sums(obs: DataFrame, slide: str) -> DataFrame:
    """Sums by station, type and hour (_end); hours begin every `slide`, at 5 past if hourly. Sliding hours are summed from
    panes of one slide each, so that a pane and not a stop is in several hours."""
    keys = ("station_name", "train_type")
    sums = lambda df, span: df.groupBy(*keys, span.alias("_w")).agg(F.sum("delay").alias("delay"), F.sum("delayed").alias("delayed"), F.sum("known").alias("known"), F.sum("n").alias("n"))
    one = obs.select(*keys, "time", F.col("delay_in_min").cast("long").alias("delay"), late().alias("delayed"), F.col("delay_in_min").isNotNull().cast("long").alias("known"), F.lit(1).cast("long").alias("n"))
    if slide == "1 hour":
        out = sums(one, F.window("time", "1 hour", "1 hour", "5 minutes"))
    else:
        panes = sums(one, F.window("time", slide)).withColumn("time", F.col("_w.start"))
        out = sums(panes.drop("_w"), F.window("time", "1 hour", slide))
    return out.withColumn("_end", F.col("_w.end")).drop("_w")


def hourly_state(sums: DataFrame, keys: Sequence[str], scope: str) -> DataFrame:
    """Mean delay, late share and rows of every hour of hourly_sums."""
    g = sums.groupBy(*keys, "_end").agg((F.try_divide(F.sum("delay"), F.sum("known"))).alias("_m"), (F.sum("delayed") / F.sum("n")).alias("_s"), F.sum("n").alias("_n"))
    return g.select(*keys, "_end", *[F.col(a).alias(b) for a, b in zip(("_m", "_s", "_n"), state_columns(scope))])


def add_network_state(df: DataFrame, lead_minutes: int | None = None, scopes: Sequence[str] = tuple(SCOPES), source: DataFrame | None = None) -> DataFrame:
    """The hour before the seal, by station, type and network, over what had happened by then (`time`), canceled stops
    left out. Nothing happened: null, and 0 for the station's count.

    Seals stand at 5 past, so an observation belongs to one seal's hour and the state is an equi-join with hours that
    are aggregated once. With another lead the hours slide by 5 minutes and the seal is taken down to those. source: the
    stops without what was joined to df before. Their sums by station, type and hour are written once, for all scopes.
    """
    obs = (df if source is None else source).where(~F.col("is_canceled")).select("station_name", "train_type", "time", "delay_in_min")
    seal = seal_time(F.col("scheduled_time"), lead_minutes)
    slide = "1 hour" if lead_minutes is None else "5 minutes"
    if lead_minutes is not None:
        seal = F.window(seal, "5 minutes")["start"]
    out = df.withColumn("_end", seal)
    sums = written(hourly_sums(obs, slide), "hours")
    few = sums.select("train_type", "_end").distinct().count() <= FEW_ROWS  # those of the network are fewer still
    for scope in scopes:
        keys = SCOPES[scope]
        state = hourly_state(sums, keys, scope)
        out = out.join(F.broadcast(state) if few and scope != "station_live" else state, [*keys, "_end"], "left")
    if "station_live" in scopes:
        out = out.withColumn("station_live_n_60m", F.coalesce("station_live_n_60m", F.lit(0)))
    return out.drop("_end")
