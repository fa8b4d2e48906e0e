"""Hard-negative mining by segment summary filtering.

Vectors of whole numbers are cut into segments, and of each segment the mean and the deviation are stored, for one
segment, two, four and so on. In a segment of length L two vectors' product lies within L * (means' product) plus or
minus L * (deviations' product), so that sums over segments bound the score. A shard's rows are bounded by one segment
first; those whose bounds still reach what is asked for are bounded by segments half as long, down to exact scores.

Positives are mined first. The scores that an anchor's negatives may have follow from each positive's score, and the
second search looks for the best rows of other labels within such a window.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import discard, staged, table

#: Rows of a shard and anchors of a block, on average; a cell holds one of each.
SHARD_ROWS, BLOCK_ANCHORS = 8_192, 8_192
#: Components and sums of products of up to this size are held in 64 bits; larger ones are Python's whole numbers.
LARGEST = 1 << 61
#: Bounds are floating point numbers; this share of what they sum is far more than their rounding.
SLACK = 1e-9


def matrix(column: pa.Array, scale: int, least_width: int = 1) -> np.ndarray:
    """floor(scale x) as rows, of Python's whole numbers if any is larger than LARGEST; zeros fill up to a power of two."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()[offsets[0] : offsets[-1]]
    if np.abs(flat).max(initial=0) > LARGEST / scale:
        flat = np.array([int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in flat.tolist()], object)
    else:
        flat = np.floor(flat * scale).astype(np.int64)
    lengths = np.diff(offsets)
    width = 1 << (max(int(lengths.max(initial=1)), least_width, 1) - 1).bit_length()
    out = np.zeros((len(lengths), width), flat.dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = flat
    return out


def summaries(rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Means and deviations of 1, 2, 4, ... segments, each times the root of the segment's length, down to segments of two."""
    x, out, parts = rows.astype(np.float64), [], 1
    while parts * 2 <= x.shape[1]:
        cut = x.reshape(len(x), parts, -1)
        mean = cut.mean(axis=2)
        deviation = np.sqrt(((cut - mean[:, :, None]) ** 2).mean(axis=2))
        root = math.sqrt(cut.shape[2])
        out.append((mean * root, deviation * root))
        parts *= 2
    return out


class Shard:
    """One shard's vectors with their segments' summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.rows = ids[order], labels[order], np.ascontiguousarray(rows[order])
        self.levels = summaries(self.rows)
        self.most = np.abs(self.rows).max(axis=0, initial=0)
        self.exact = 0  # rows scored exactly

    def scores(self, found: np.ndarray, vector: np.ndarray) -> np.ndarray:
        self.exact += len(found)
        if self.rows.dtype == object or vector.dtype == object or sum(int(a) * int(b) for a, b in zip(self.most, np.abs(vector))) > LARGEST:
            return self.rows[found].astype(object) @ vector.astype(object)
        return self.rows[found] @ vector

    def best(self, found: np.ndarray, vector: np.ndarray, levels: list, k: int, windows=((None, None),)) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window, ids and scores of the k best of the rows `found` with scores from its low to its high (None: no
        such bound), ties to smaller ids. A row is bounded and scored once for all windows.

        levels: the vector's own summaries.
        """
        bounds = [(-math.inf if low is None else low, math.inf if high is None else high) for low, high in windows]
        for (mean, deviation), (m, d) in zip(self.levels, levels):
            if len(found) <= k:
                break
            all_rows = len(found) == len(self.ids)
            means, deviations = (mean, deviation) if all_rows else (mean[found], deviation[found])
            centre, spread = means @ m, deviations @ d
            spread += SLACK * (np.abs(means) @ np.abs(m) + spread) + 1
            lowest, highest = centre - spread, centre + spread
            wanted = np.zeros(len(found), bool)
            for low, high in bounds:
                # k rows that are surely within the window are at least as good as the k-th of their lower bounds
                sure = lowest[(highest <= high) & (lowest >= low)]
                least = float(low) - abs(low) * SLACK - 1 if len(sure) < k else np.partition(sure, len(sure) - k)[len(sure) - k]
                wanted |= (highest >= least) & (lowest <= float(high) + abs(high) * SLACK + 1)
            found = found[wanted]
        score, out = self.scores(found, vector), []
        for low, high in bounds:
            on = np.flatnonzero((score >= low) & (score <= high)) if len(found) else np.zeros(0, int)
            if score.dtype == object:
                order = on[np.array(sorted(range(len(on)), key=lambda i: (-score[on[i]], self.ids[found[on[i]]]))[:k], int)]
            else:
                order = on[np.lexsort((self.ids[found[on]], -score[on]))[:k]]
            out.append((self.ids[found[order]], score[order]))
        return out


def _cells(search, schema: str, values: list[pa.DataType], scale: int):
    """A function of a cell's rows and anchors: what search(shard, anchor's columns, vector, levels) yields, as a table."""

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            x, y = left.combine_chunks(), right.combine_chunks()
            one = lambda t: t.column("v").chunk(0) if t.column("v").num_chunks == 1 else t.column("v").combine_chunks()
            longest = max(int(np.diff(one(t).cast(pa.large_list(pa.float64())).offsets.to_numpy()).max(initial=1)) for t in (x, y))
            shard = Shard(x.column("id").to_numpy(), x.column("label").to_numpy(), matrix(one(x), scale, longest))
            vectors = matrix(one(y), scale, longest)
            levels = summaries(vectors)
            rest = [y.column(c).to_pylist() for c in y.column_names if c not in ("v", "s", "b")]
            names = [c for c in y.column_names if c not in ("v", "s", "b")]
            for i, row in enumerate(zip(*rest)):
                out.extend(search(shard, dict(zip(names, row)), vectors[i], [(m[i], d[i]) for m, d in levels]))
        columns = list(zip(*out)) or [[]] * len(values)
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip((x.split()[0] for x in schema.split(", ")), columns, values)})

    return cell


def _dealt(vectors: DataFrame, anchors: DataFrame, shards: int, blocks: int):
    """Cells of a shard of the vectors and a block of the anchors, as cogroups."""
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v = vectors.withColumn("s", F.pmod(F.xxhash64("id", "row"), F.lit(shards))).withColumn("b", each(blocks))
    a = anchors.withColumn("b", F.pmod(F.xxhash64("anchor"), F.lit(blocks))).withColumn("s", each(shards))
    return v.select("id", "label", "v", "s", "b").groupBy("s", "b").cogroup(a.groupBy("s", "b"))


def hard_negatives(
    rows: DataFrame, anchors, positives: int = 5, k: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), scale: int = 256,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    anchors: a condition that picks rows. An anchor's positives are its best rows of the same label, its negatives for
    each of them the k best of other labels whose score is between the shares low and high (numerator, denominator) of
    the positive's. Scores are inner products of floor(scale x), exact for components of any size; one in the result that
    doesn't fit in 64 bits fails. Ties go to smaller ids; where vectors differ in length the longer one's end counts as 0.

    Rows without an id or a label, and vectors that are null or hold null or non-finite components, take no part. Rows
    that repeat an id are candidates each, but not for an anchor of their own id; of anchors that repeat an id each row
    with other contents is one of its own. Rows are dealt by number into shards, anchors into blocks, and each pair of a
    shard and a block is one bounded group whatever the labels are. Other columns are not read.
    """
    finite = F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(x))
    fine = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & finite
    picked = anchors(F.col(id_col))
    v = rows.where(fine).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"), F.monotonically_increasing_id().alias("row"))
    a = rows.where(fine & picked).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")).distinct()
    a = staged(a.withColumn("anchor", F.monotonically_increasing_id()))
    shards, blocks = max(1, -(-v.count() // SHARD_ROWS)), max(1, -(-a.count() // BLOCK_ANCHORS))

    def same(shard: Shard, anchor: dict, vector, levels):
        found = np.flatnonzero((shard.labels == anchor["label"]) & (shard.ids != anchor["id"]))
        ((ids, scores),) = shard.best(found, vector, levels, positives)
        return [(anchor["anchor"], i, s) for i, s in zip(ids.tolist(), scores.tolist())]

    schema = "anchor long, id long, score long"
    found = _dealt(v, a, shards, blocks).applyInArrow(_cells(same, schema, [pa.int64()] * 3, scale), schema)
    best = W.partitionBy("anchor").orderBy(F.desc("score"), "id")
    pairs = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    # an anchor's windows: `positives` at most
    windows = pairs.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("windows"))
    asked = staged(a.join(windows, "anchor"))

    def other(shard: Shard, anchor: dict, vector, levels):
        found = np.flatnonzero((shard.labels != anchor["label"]) & (shard.ids != anchor["id"]))
        # whole scores between the shares of each positive's
        asked = [(w, -(-low[0] * w["score"] // low[1]), high[0] * w["score"] // high[1]) for w in anchor["windows"]]
        asked = [x for x in asked if x[1] <= x[2]]
        if not asked:
            return []
        best = shard.best(found, vector, levels, k, [x[1:] for x in asked])
        return [(anchor["anchor"], anchor["id"], w["place"], w["id"], w["score"], i, s) for (w, _, _), (ids, scores) in zip(asked, best) for i, s in zip(ids.tolist(), scores.tolist())]

    schema = "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
    found = _dealt(v, asked, shards, blocks).applyInArrow(_cells(other, schema, kinds, scale), schema)
    best = W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    out = staged(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    discard(a, asked)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(rows, lambda c: c % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
