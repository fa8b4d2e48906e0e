"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's documents stand in a seeded order and form one stream of tokens, which is cut into blocks of equal tokens.
Blocks are seats: for each output shard they go to the sources with the highest quotients target / (2k + 1), and a
source's shard takes its next blocks from the stream, which begins again when it is used up. All of it is DataFrame
functions; the prefix sums along a stream are made in buckets, so that a source of any size is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import SPACES, WORD, staged, table

#: Rows of a source's bucket at most, and buckets of a source, whose sums are one task's window.
BUCKET_ROWS, BUCKETS = 1_000, 1 << 17


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """sources(source, source_size) with _rank and target.

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes. A target stops at cap
    times its source's size and the excess is reshared by weight: with sources ordered by cap / weight, a source is
    capped exactly if its cap is within its weight's share of what the sources before it leave.
    """
    everything = W.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    out = sources.withColumn("_rank", F.row_number().over(by_name)).withColumn("_weight", w).withColumn("_cap", F.col("source_size").cast("double") * cap)
    by_cap = everything.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before, since = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    out = out.withColumn("_level", left / F.sum("_weight").over(since)).withColumn("_capped", F.col("_cap") <= F.col("_weight") * F.col("_level"))
    level = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(everything)
    # among sources that aren't capped the first has the highest level, which is the one that holds for all of them
    return out.withColumn("target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_weight") * level)).select("source", "source_size", "_rank", "target")


def apportioned(aims: DataFrame, block: int = 16, shards: int = 8) -> DataFrame:
    """aims(source, _rank, target, ...) with _cuts: for each source the blocks that shards 0..j have, as an array of shards + 1.

    Sainte-Lague over all blocks of the first j shards, for every j; as seats only ever grow with the house, the
    differences are each shard's integer quotas. Seats a source surely has are given at once: the quotients that can
    decide lie within share * (seats +- sources / 2), so the table of quotients stays near 4 rows a source and shard.
    """
    everything = W.partitionBy(F.lit(0))
    a = aims.withColumn("_sum", F.sum("target").over(everything)).withColumn("_n", F.count(F.lit(1)).over(everything))
    a = a.withColumn("_shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("_seats", F.floor(F.floor(F.col("_sum") / block) * F.col("_shard") / shards))
    share = F.col("target") / F.col("_sum")
    low = F.greatest(F.lit(0), F.floor(share * (F.col("_seats") - F.col("_n") / 2) - 0.5) - 1).cast("long")
    high = (F.ceil(share * (F.col("_seats") + F.col("_n") / 2) + 0.5) + 1).cast("long")
    a = a.where("_sum > 0").withColumn("_low", low).withColumn("_k", F.explode(F.sequence(low, high)))
    by_shard = W.partitionBy("_shard")
    given = F.sum(F.when(F.col("_k") == F.col("_low"), F.col("_low"))).over(by_shard)
    place = F.row_number().over(by_shard.orderBy((F.col("target") / (2 * F.col("_k") + 1)).desc(), "_rank", "_k"))
    a = a.withColumn("_won", (place <= F.col("_seats") - given) & (F.col("target") > 0))
    seats = a.groupBy("source", "_shard").agg((F.max("_low") + F.sum(F.col("_won").cast("long"))).alias("_blocks"))
    cuts = seats.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("_shard", "_blocks"))).alias("_c")).select(F.col("source").alias("_s"), F.transform("_c", lambda x: x["_blocks"]).alias("_c"))
    zero = F.array_repeat(F.lit(0).cast("long"), shards)
    return aims.join(cuts, aims["source"].eqNullSafe(cuts["_s"]), "left").select(*aims.columns, F.concat(F.array(F.lit(0).cast("long")), F.coalesce("_c", zero)).alias("_cuts"))


def mix(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int = 16, shards: int = 8, seed: int = 11) -> DataFrame:
    """sized(source, size, _order, ...) with source_size, target, taken, and _spans: the tokens that each shard takes.

    sized must be a written table, since it is read more than once; _order is a long that puts a source's documents in
    their seeded order. A stream ends after `cap` rounds, so no document gives more than cap times its size. Ties in
    _order, as repeated rows have, keep the streams' lengths whole: rows of equal order take turns by size. Null sources
    are one source; documents of size 0 take nothing; a corpus without words has targets of 0.
    """
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    plan = apportioned(aims, block, shards)
    n = sized.count()
    buckets = min(BUCKETS, max(1, n // BUCKET_ROWS))
    # by the order's high bits: bucket numbers rise with the order
    spread = sized.withColumn("_bucket", F.floor((F.col("_order").cast("double") / 2.0**64 + 0.5) * buckets).cast("long"))
    sums = spread.groupBy("source", "_bucket").agg(F.sum("size").alias("_in"))
    up = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_in").over(up), F.lit(0)).alias("_base"))
    key = plan.join(sums, plan["source"].eqNullSafe(sums["_s"])).select("_s", "_b", "_base", "source_size", "target", "_cuts")
    inside = W.partitionBy("source", "_bucket").orderBy("_order", "size").rowsBetween(W.unboundedPreceding, -1)
    out = spread.withColumn("_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(key, out["source"].eqNullSafe(key["_s"]) & (out["_bucket"] == key["_b"])).withColumn("_start", F.col("_start") + F.col("_base"))
    upto = F.transform("_cuts", lambda c: _upto(F.least(c * block, cap * F.col("source_size"))))
    out = out.select(*sized.columns, "source_size", "target", upto.alias("_upto"))
    spans = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.get("_upto", j) - F.get("_upto", j - 1))
    return out.select(*sized.columns, "source_size", "target", F.element_at("_upto", -1).alias("taken"), spans.alias("_spans"))


def _upto(tokens):
    """Tokens of a document among the first `tokens` of its source's stream."""
    rounds = F.when(F.col("source_size") > 0, F.floor(tokens / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = tokens - rounds * F.col("source_size")
    return rounds * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_start")))


def sized_docs(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, source, size and the seeded order of all documents, written."""
    text = F.coalesce("text", F.lit(""))
    return staged(docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("_order")))


def mixed_documents(docs: DataFrame, seed: int = 11) -> DataFrame:
    """The mix as documents, with the columns of docs, whatever their names: a row for each whole round that takes a
    document, and one with the first words of a document whose last round ends within it. Documents that the mix doesn't
    take are gone; rows of one source that repeat an id and its text are taken together, as rounds of the least of them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # one key for the rows and what is taken of them, so that texts are shuffled once
    key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("of"), F.col("source").isNull().alias("of_none"), "_order"]
    names = ["id", "none", "of", "of_none", "_order"]
    taken = mix(sized_docs(docs, seed)).select(*key, "size", "taken").groupBy(*names).agg(F.first("size").alias("size"), F.sum("taken").alias("taken"))
    own = docs.select(F.struct(*docs.columns).alias("own"), F.xxhash64(F.lit(seed), "doc_id", text).alias("_order"))
    out = own.select("own", "own.doc_id", "own.source", "_order").select("own", *key).groupBy(*names).agg(F.min("own").alias("own"))
    out = out.join(taken, names).where("taken > 0")
    part = F.col("taken") % F.col("size")
    whole = F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    out = out.select("own", F.explode(F.when(part > 0, F.array_append(whole, part)).otherwise(whole)).alias("words"))
    own, words = F.col("own"), F.col("words")
    pieces = F.regexp_extract_all(F.coalesce(own["text"], F.lit("")), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    fields = {"text": F.when(words < 0, own["text"]).otherwise(cut)}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(words < 0, own["n_chars"]).otherwise(F.length(cut).cast("long"))
    return out.select(*[fields.get(c, own[c]).alias(c) for c in docs.columns])


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(sized_docs(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken")
