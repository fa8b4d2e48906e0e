"""Line dedup: lines that many documents share stay only in the document with the largest id.

Lines are exploded and normalised, hashed to 128 bits, and counted by distinct documents; only hashes are shuffled
for that. Lines over the threshold are marked by document and position, and each text is put together again from the
positions that stay. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, ascii_lower, free, staged, table

#: So many common lines at most, some 30 MB, go to all tasks; with more, lines are shuffled to them.
BROADCAST_LINES = 500_000


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `text_col` rewritten, and the columns _n_lines and _n_dropped.

    A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. Keys of at least
    min_chars code points in at least min_docs distinct ids lose their lines except in the largest id that holds them.

    Null or empty text is one empty line (the text becomes ""). Documents without an id don't count towards min_docs
    and keep no common line. Repeated rows of one id are one document: all of them keep or lose a line. Texts that
    lose all lines become "". Other columns pass through, whatever their names; those that are called like the two added
    ones are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    marks = (
        docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("print"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .withColumn("line", F.btrim("line", F.lit(SPACES)))
        .where(F.length("line") >= min_chars)
        .select("id", "print", "pos", F.unhex(F.md5(ascii_lower(F.col("line")))).alias("key"))
    )
    marks = staged(marks)  # read twice, without the texts
    common = (
        marks.groupBy("key", "id").agg(F.lit(1).alias("one"))
        .groupBy("key").agg(F.count("id").alias("n"), F.max("id").alias("last"))
        .where(F.col("n") >= min_docs).select("key", "last")
    )
    common = staged(common)
    if common.count() <= BROADCAST_LINES:
        common = F.broadcast(common)
    drops = (
        marks.join(common, "key").where(F.col("id").isNull() | (F.col("id") < F.col("last")))
        .groupBy("id", "print").agg(F.collect_set("pos").alias("drop"))
    )
    print_, other, lines, drop, id_ = free(docs.columns, "print", "print_of", "lines", "drop", "id")
    drops = drops.select(F.col("id").alias(id_), F.col("print").alias(other), F.col("drop").alias(drop))
    # the lines are split below the join, so that the positions above pick from an array that is there once
    left = docs.select("*", F.xxhash64(text).alias(print_), F.split(text, "\n", -1).alias(lines))
    on = left[id_col].eqNullSafe(drops[id_]) & (left[print_] == drops[other])
    n = F.size(lines)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), drop), lambda p: F.col(lines)[p])
    return left.join(drops, on, "left").select(
        *[(F.when(F.col(drop).isNull(), text).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else left[c]) for c in docs.columns if c not in ADDED],
        n.cast("long").alias("_n_lines"),
        F.greatest(F.coalesce(F.size(drop), F.lit(0)), F.lit(0)).cast("long").alias("_n_dropped"),
    )


ADDED = ("_n_lines", "_n_dropped")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, line, pos, common.key IS NOT NULL AND doc_id < last AS dropped
  FROM keyed LEFT JOIN common USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
