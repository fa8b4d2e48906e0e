"""A training corpus from raw documents, stage by stage.

Quality rules by host, line dedup, near-duplicate removal by the n-gram join, mixing of sources to target weights, and
SentencePiece encoding. A stage reads what the stage before it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopdelay.llm.host_rules import quality_filter
from stopdelay.llm.line_dedup import line_dedup
from stopdelay.llm.mixing import mixed_documents
from stopdelay.llm.ngram_join import near_duplicate_filter
from stopdelay.llm.pieces import encode
from stopdelay.llm.shared import discard, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no base rule and whose host isn't rejected."""
    return quality_filter(docs)


def common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; n_chars follows the text. Null texts become empty."""
    out = line_dedup(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more; the least id stays."""
    return near_duplicate_filter(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, a row for each time that it takes a document."""
    return mixed_documents(docs)


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the ids of the text's pieces."""
    return encode(docs.select("doc_id", "source", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", common_lines),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentence_pieces),
]

#: The order of the mix and the pieces can't be put in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
