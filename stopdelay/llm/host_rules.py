"""Quality rules with a verdict by host.

Every text is measured; documents that break a base rule fail. Failures are summed by host (here: `source`), each
host's rate is shrunk towards the corpus by a beta prior that is fitted to all hosts by moments, and hosts whose shrunk
rate is above the limit take all their documents with them. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, free, staged, table, words

#: What counts as a symbol.
SYMBOL = r"[#*$%&|<>]"
#: So many rejected hosts at most, some MB, go to all tasks.
BROADCAST_HOSTS = 100_000
#: The same of documents that are left out.
BROADCAST_GONE = 300_000


MEASURES = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words")


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words (all long); columns so called are replaced.

    Three-word windows are compared as 64-bit hashes within one text: sorted beside their positions, equal neighbours
    are repeats. No row leaves its task. Null and empty texts measure 0.
    """
    own = F.struct(*docs.columns).alias("own")
    wordy = lambda text: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(own, text.alias("t"), words(F.col(text_col)).alias("w"), wordy(text).alias("l"))
    w, n = F.col("w"), F.size("w")
    # each step below is a column of its own that is used more than once, so that Spark keeps it as one
    out = out.select(
        "own", n.cast("long").alias("_n_words"), F.length(F.array_join(w, "")).cast("long").alias("_word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("_n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("_n_dup_lines"),
        F.when(n < 4, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).alias("h"),
    )
    h, s = F.col("h"), F.col("s")
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.select("own", *MEASURES[:4], F.when(F.size(F.array_distinct(h)) < F.size(h), pairs).otherwise(none).alias("s"))
    last = F.size(s) - 1
    twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))
    out = out.select("own", *MEASURES[:4], F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p"))
    covered = F.aggregate(F.col("p"), F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")), lambda a: a["n"])
    return out.select(*[F.col("own")[c].alias(c) for c in docs.columns if c not in MEASURES], *MEASURES[:4], covered.cast("long").alias("_n_repeat_words"))


def base_failed(min_words: int = 50, max_repeat_percent: int = 50):
    return (F.col("_n_words") < min_words) | (100 * F.col("_n_repeat_words") > max_repeat_percent * F.col("_n_words"))


def host_verdicts(measured: DataFrame, host_col: str, max_rate: float = 0.5, least_strength: float = 1.0, most_strength: float = 1e6) -> DataFrame:
    """A row per host: _host, _host_docs, _host_failed, _host_rate (shrunk), _host_ok.

    The prior has the corpus's rate m as its mean and the strength m(1-m)/v - 1, held within the two strengths; v is the
    variance of the rates over hosts, weighted by documents, less the part m(1-m) hosts / documents that chance alone
    makes. Without variance the strength is the largest. Null is a host.
    """
    hosts = measured.groupBy(F.col(host_col).alias("_host")).agg(F.count(F.lit(1)).alias("_host_docs"), F.sum(F.col("_base_failed").cast("long")).alias("_host_failed"))
    rate = F.col("_host_failed") / F.col("_host_docs")
    prior = hosts.agg(
        F.sum("_host_docs").alias("n"), F.sum("_host_failed").alias("f"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("_host_failed") * rate).alias("sq"),
    ).select((F.col("f") / F.col("n")).alias("m"), (F.col("sq") / F.col("n")).alias("m2"), (F.col("hosts") / F.col("n")).alias("c"))
    v = F.col("m2") - F.col("m") * F.col("m") - F.col("m") * (1 - F.col("m")) * F.col("c")
    strength = F.when(v > 1e-12, F.least(F.lit(most_strength), F.greatest(F.lit(least_strength), F.col("m") * (1 - F.col("m")) / v - 1))).otherwise(F.lit(most_strength))
    prior = prior.select("m", strength.alias("k"))
    shrunk = (F.col("_host_failed") + F.col("m") * F.col("k")) / (F.col("_host_docs") + F.col("k"))
    # the prior is one row, an ungrouped aggregate
    return hosts.join(F.broadcast(prior)).select("_host", "_host_docs", "_host_failed", shrunk.alias("_host_rate"), (shrunk <= max_rate).alias("_host_ok"))


def judged(measured: DataFrame, host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """measured with _base_failed and _kept: hosts' verdicts joined back to their documents.

    Only hosts that were rejected are joined. An empty table gives an empty result.
    """
    if "_base_failed" not in measured.columns:
        measured = measured.withColumn("_base_failed", base_failed())
    host, bad = free(measured.columns, "bad_host", "bad")
    rejected = staged(host_verdicts(measured, host_col, max_rate).where(~F.col("_host_ok")).select(F.col("_host").alias(host), F.lit(True).alias(bad)))
    if rejected.count() <= BROADCAST_HOSTS:  # else documents are shuffled to the hosts
        rejected = F.broadcast(rejected)
    out = measured.join(rejected, measured[host_col].eqNullSafe(rejected[host]), "left")
    return out.withColumn("_kept", ~F.col("_base_failed") & F.col(bad).isNull()).drop(host, bad)


def quality_filter(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The documents that pass, with the columns they came with, whatever their names.

    Texts are measured once, into a table of ids, texts' hashes and verdicts. Documents that fail are left out by those;
    rows of one id and one text stay or go by their host and that text, null ids and hosts included.
    """
    text_print = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    plain = docs.select(F.col(id_col).alias("id"), text_print.alias("print"), F.col(host_col).alias("host"), "text")
    # the rule's result goes through an array of one, as it would else be made again for each use
    measured = text_measures(plain).select("id", "print", "host", F.inline(F.array(F.struct(base_failed().alias("_base_failed")))))
    measured = staged(measured)
    gone = staged(judged(measured, "host").where(~F.col("_kept")).select("id", "print", "host").distinct())
    id_, print_, host = free(docs.columns, "id", "print", "host")
    gone = gone.toDF(id_, print_, host)
    if gone.count() <= BROADCAST_GONE:  # else texts are shuffled to them
        gone = F.broadcast(gone)
    on = docs[id_col].eqNullSafe(F.col(id_)) & (text_print == F.col(print_)) & docs[host_col].eqNullSafe(F.col(host))
    return docs.join(gone, on, "left_anti")


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = staged(text_measures(docs).drop("text"))  # two passes follow, and texts are dear to measure
    out = judged(measured)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *[F.col(f"_{x}").alias(x) for x in names])


OP6_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), tokens AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
), windows AS (
  SELECT doc_id, i, word AS a, lead(word, 1) OVER d AS b, lead(word, 2) OVER d AS c
  FROM tokens WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows WHERE c IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, i + k AS i FROM twice, (VALUES (0), (1), (2)) AS o(k) WHERE n >= 2
), repeats AS (
  SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id
), measured AS (
  SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
         - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM docs LEFT JOIN repeats USING (doc_id)
), ruled AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM ruled GROUP BY source
), moments AS (
  SELECT sum(f) / sum(n) AS m, sum(f * (f / n)) / sum(n) AS m2, count(*) / sum(n) AS c FROM hosts
), spread AS (
  SELECT m, m2 - m * m - m * (1 - m) * c AS v FROM moments
), prior AS (
  SELECT m, CASE WHEN v > 1e-12 THEN least(1e6, greatest(1.0, m * (1 - m) / v - 1)) ELSE 1e6 END AS k FROM spread
), verdicts AS (
  SELECT source, (f + m * k) / (n + k) <= 0.5 AS ok FROM hosts, prior
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND ok AS kept
FROM ruled JOIN verdicts ON ruled.source IS NOT DISTINCT FROM verdicts.source
"""
