"""Sharding by minimax contiguous partition.

Documents of equal text are one atomic group; groups stand in the order of their 128-bit text digests. The smallest
capacity for which a greedy pass fits the groups into the shards is found by binary search. Within that capacity the
groups are cut as near to even shares as it allows, so that no shard is larger than the least possible and the last one
isn't left short. The search needs the sizes of groups only around the cuts: elsewhere it works on bins, runs of
groups whose digests share leading bits, and it splits the bins that a cut may fall into until none is left to split.
So the driver holds a bounded number of bins however many groups there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import rows_wanted, staged, table

SLOT_ROWS = 20_000
ROW_BYTES = 16


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 (null for null text), and the group's digest in two longs; written."""
    text = F.col(text_col)
    binary = F.coalesce(text, F.lit("")).cast("binary")
    digest = F.md5(binary)
    part = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("long")  # noqa: E731  60 bits, never negative
    return staged(
        docs.select(
            F.col(id_col), (F.length(binary) + ROW_BYTES).cast("long").alias("size"), F.when(text.isNotNull(), F.crc32(binary)).alias("text_crc32"),
            F.when(text.isNull(), F.lit(-1)).otherwise(part(1)).alias("_hi"), F.when(text.isNull(), F.lit(-1)).otherwise(part(16)).alias("_lo"),
        )
    )


def _bins(groups: DataFrame, bits: int) -> np.ndarray:
    """Per bin of leading bits: first digest, size, groups."""
    at = F.shiftright("_hi", 60 - bits)
    rows = groups.groupBy(at.alias("b")).agg(F.min("_hi"), F.sum("bytes"), F.count(F.lit(1))).orderBy("b").toArrow()
    return np.stack([rows.column(i).to_numpy().astype(np.int64) for i in range(1, 4)], 1) if rows.num_rows else np.zeros((0, 3), np.int64)


def _greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Cuts (unit indexes where shards end) of a greedy pass, or None if it needs more shards. ends: running sizes."""
    cuts, at, n = [], 0, len(ends)
    for _ in range(shards):
        start = ends[at - 1] if at else 0
        nxt = int(np.searchsorted(ends, start + capacity, side="right"))
        if nxt == at and at < n:
            return None
        at = nxt
        cuts.append(at)
        if at == n:
            return cuts + [n] * (shards - len(cuts))
    return None


def smallest_capacity(sizes: np.ndarray, shards: int, low: int | None = None) -> int:
    """The least capacity at which a greedy pass over sizes, in their order, needs no more than `shards` shards."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    low = max(-(-total // shards), int(sizes.max()) if len(sizes) else 0, low or 0)
    high = max(low, total)
    while low < high:
        mid = (low + high) // 2
        if _greedy(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _even(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts nearest to even shares such that no shard exceeds a capacity that a greedy pass can do with."""
    n, total = len(ends), int(ends[-1])
    starts = np.concatenate([[0], ends])
    # earliest[i]: the first place from which the last i shards hold all that is left
    earliest = [n]
    for _ in range(shards - 1):
        earliest.append(int(np.searchsorted(starts, starts[earliest[-1]] - capacity, side="left")))
    cuts, at = [], 0
    for i in range(1, shards):
        share = total * i // shards
        near = int(np.searchsorted(starts, share, side="left"))
        if near and share - starts[near - 1] < starts[near] - share:
            near -= 1
        most = int(np.searchsorted(starts, starts[at] + capacity, side="right")) - 1
        at = max(at, min(max(near, earliest[shards - i]), most))
        cuts.append(at)
    return [*cuts, n]


def _doubtful(sizes: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """Which bins a cut may fall into, for any capacity from low to high. Bins' borders are groups' borders, so a greedy
    cut is never before the last border within low of the least start, nor beyond high from the greatest."""
    ends = np.cumsum(sizes)
    out = np.zeros(len(sizes), bool)
    least = most = 0
    for _ in range(shards):
        i = int(np.searchsorted(ends, least + low, side="right"))
        least = int(ends[i - 1]) if i else 0
        most = min(most + high, int(ends[-1]))
        j = int(np.searchsorted(ends, most, side="left"))
        out[i : j + 1] = True
        most = int(ends[min(j, len(ends) - 1)])
    return out


def plan_cuts(digests: DataFrame, shards: int, first_bits: int = 14, more_bits: int = 8) -> list[tuple[int, int]]:
    """Digests at which shards 1.. begin. A group larger than an even share makes the least capacity its own size; the
    groups around it are cut as near to even shares as before."""
    groups = staged(digests.groupBy("_hi", "_lo").agg(F.sum("size").alias("bytes")))
    left, bits = shards, first_bits
    # units: first digest (two longs), size, groups, leading bits; a bin's second long is -2, before all that share the first
    binned = lambda df, n: (lambda x: np.column_stack([x[:, 0], np.full(len(x), -2), x[:, 1:], np.full(len(x), n)]))(_bins(df, n))
    units = binned(groups, bits)
    while len(units):
        # bins kept whole fit this capacity, and groups can do no better than the even share
        high, low = smallest_capacity(units[:, 2], left), -(-int(units[:, 2].sum()) // left)
        sizes, ends = units[:, 2], np.cumsum(units[:, 2])
        doubt = _doubtful(sizes, low, high, left) | _doubtful(sizes[::-1], low, high, left)[::-1]
        even = np.searchsorted(ends, [int(ends[-1]) * i // left for i in range(1, left)])
        doubt[np.minimum(even, len(units) - 1)] = True
        doubt &= units[:, 3] > 1
        if not doubt.any():
            break
        opened = F.lit(False)
        for n in np.unique(units[doubt, 4]).tolist():
            own = units[doubt & (units[:, 4] == n), 0] >> (60 - n)
            opened = opened | F.shiftright("_hi", 60 - n).isin(own.tolist())
        inside, bits = groups.where(opened), bits + more_bits
        if units[doubt, 3].sum() <= 200_000 or bits > 52:
            rows = inside.select("_hi", "_lo", "bytes").toArrow()
            fine = np.column_stack([rows.column(i).to_numpy().astype(np.int64) for i in range(3)] + [np.full(rows.num_rows, x, np.int64) for x in (1, 60)])
        else:
            fine = binned(inside, bits)
        units = np.concatenate([units[~doubt], fine])
        units = units[np.lexsort((units[:, 1], units[:, 0]))]
    if not len(units):
        return []
    cuts = _even(np.cumsum(units[:, 2]), smallest_capacity(units[:, 2], left), left)
    last = (1 << 61, 0)
    return [(int(units[i, 0]), int(units[i, 1])) if i < len(units) else last for i in cuts[:-1]]


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every document, under the law that shards' bytes are near equal.

    Size is the text's UTF-8 bytes (null: none) plus 16; text_crc32 of a null text is null. Equal texts share a shard; null texts are equal to one another
    and to nothing else. Shards are runs of groups in the order of their digests, also around a
    group that is larger than an even share. Slots count from 0 in each shard without gaps. Repeated rows get slots of their own; an empty
    table gives no rows; other columns are not read.
    """
    d = digested(docs, id_col, text_col)
    cuts = plan_cuts(d, shards)
    hi, lo = F.col("_hi"), F.col("_lo")
    number = F.lit(0)
    for a, b in cuts:
        number = number + ((hi > a) | ((hi == a) & (lo >= b))).cast("int")
    out = d.withColumn("shard", number.cast("int"))
    # slots: each shard in pieces, numbered inside and offset by the pieces before; a shard is never one task
    pieces = rows_wanted(d, SLOT_ROWS * max(1, shards // 2), 1)
    out = out.withColumn("_piece", F.pmod(F.xxhash64(id_col, "size"), F.lit(pieces)).cast("int"))
    counts = out.groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("shard").alias("_s"), F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("shard", "_piece").orderBy(id_col, "_hi", "_lo")
    out = out.withColumn("_i", F.row_number().over(inside))
    return out.join(offsets, (out["shard"] == offsets["_s"]) & (out["_piece"] == offsets["_p"])).select(
        id_col, "size", "text_crc32", "shard", (F.col("_base") + F.col("_i") - 1).cast("long").alias("slot")
    )


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
