"""Exact quantiles of many groups at once, whatever a group's size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written

#: Bits of a number that one pass tells apart, so that a group's histogram has 65,536 buckets at most.
BITS = 16


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the floating point numbers (-0.0 is 0.0), one for each."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def from_keys(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ np.int64(0x7FFFFFFFFFFFFFFF), keys).view(np.float64)


def _mapped(df: DataFrame, columns: Sequence[str], kind: str, arrow: pa.DataType, function) -> DataFrame:
    """df with the columns put through a function of numpy arrays."""
    schema = df.select([F.col(c).cast(kind).alias(c) if c in columns else F.col(c) for c in df.columns]).schema

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(function(b.column(c).to_numpy(zero_copy_only=False)), arrow) if c in columns else b.column(c) for c in b.schema.names], names=b.schema.names)

    return df.mapInArrow(run, schema)


def grouped_quantile(df: DataFrame, groups: Sequence[str], value: str, q: float) -> DataFrame:
    """groups and v: the linearly interpolated quantile of each group's values, nulls and NaN left out.

    Values are counted once by group. Of the two ranks that a quantile lies between, each pass finds the bucket by the
    next BITS bits of the value's order and looks into that one only, so that no task ever holds a group's values. Null
    is a group like others; without groups there is one row, null if no value is left.
    """
    own = [f"_g{i}" for i in range(len(groups))]
    x = df.select(*[F.col(g).alias(o) for g, o in zip(groups, own)], F.col(value).cast("double").alias("_k")).where("_k is not null and not isnan(_k)")
    counts = written(_mapped(x, ["_k"], "long", pa.int64(), ordered_keys).groupBy(*own, "_k").agg(F.count(F.lit(1)).alias("_n")), "counts")
    rank = (F.sum("_n") - 1) * F.lit(float(q))
    wanted = counts.groupBy(*own).agg(rank.alias("_rank")).select(*own, (F.col("_rank") - F.floor("_rank")).alias("_share"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("_rank").alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil("_rank").alias("rank")))).alias("_t"))
    wanted = wanted.select(*[F.col(o).alias(f"{o}_") for o in own], "_share", F.col("_t.side").alias("_side"), F.col("_t.rank").alias("_rank"), F.lit(None).cast("long").alias("_head"))
    for left in range(64 - BITS, -1, -BITS):
        same = F.lit(True) if left == 64 - BITS else F.shiftright("_k", left + BITS) == F.col("_head")
        for o in own:
            same = same & F.col(o).eqNullSafe(F.col(f"{o}_"))
        keys = [*[f"{o}_" for o in own], "_side"]
        bucket = F.shiftright("_k", left).alias("_bucket")
        hits = counts.join(wanted, same).groupBy(*keys, bucket).agg(F.sum("_n").alias("_m"), F.first("_rank").alias("_rank"), F.first("_share").alias("_share"))
        upto = F.sum("_m").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
        hits = hits.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_m") <= F.col("_rank")))
        wanted = hits.select(*keys, "_share", (F.col("_rank") - F.col("_upto") + F.col("_m")).alias("_rank"), F.col("_bucket").alias("_head"))
    both = _mapped(wanted.drop("_rank"), ["_head"], "double", pa.float64(), from_keys)
    at = lambda side: F.max(F.when(F.col("_side") == side, F.col("_head")))
    out = both.groupBy(*[f"{o}_" for o in own]).agg(at(0).alias("_a"), at(1).alias("_b"), F.max("_share").alias("_s"))
    return out.select(*[F.col(f"{o}_").alias(g) for o, g in zip(own, groups)], (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_s")).alias("v"))
