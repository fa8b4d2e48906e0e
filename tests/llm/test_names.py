"""Columns of callers may be called like anything that an operator uses inside."""

from pyspark.sql import functions as F

from stopdelay.llm.host_rules import quality_filter, text_measures
from stopdelay.llm.line_dedup import line_dedup
from stopdelay.llm.mixing import mixed_documents
from stopdelay.llm.ngram_join import near_duplicate_filter
from stopdelay.llm.pieces import decode, encode
from stopdelay.llm.ppm_langid import predict, train
from stopdelay.llm.shared import arrow_batches, free

NAMES = (
    "_print print _lines lines _drop drop id one key last _w _l _h _p _s _bad _base_failed _kept _host own w t l h s p host bad none _order _id _o _taken _size _words words taken size _text _ids "
    "node n rep letters parts bad_host print_ drop_ TEXT_"
).split()
LINE = "a line of more than forty characters that many documents of this small table share"


def table(spark):
    rows = [(i, f"w{i} " * 60 + f"\n{LINE}\nend {i}", "en", f"s{i % 3}", 5) for i in range(8)] + [(8, None, None, None, None), (None, "x " * 70, "de", "s1", 1), (9, "short", "de", "s1", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in NAMES})


def same(df, columns):
    assert df.columns == columns
    rows = df.collect()
    for r in rows:
        for c in NAMES:
            assert r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}", c
    return rows


def test_free():
    assert free(["a", "A_", "b"], "a", "a", "c") == ["a__", "a___", "c"]


def test_clashing_names(spark):
    docs = table(spark)
    out = line_dedup(docs)
    rows = same(out.drop("_n_lines", "_n_dropped"), docs.columns)
    assert {r.doc_id: LINE in r.text for r in rows if r.doc_id is not None and r.doc_id < 8} == {i: i == 7 for i in range(8)}
    again = line_dedup(out)
    assert again.columns == out.columns and again.agg(F.sum("_n_dropped")).first()[0] == 0
    kept = same(quality_filter(docs), docs.columns)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == []  # one word sixty times
    varied = docs.withColumn("text", F.when(F.col("doc_id") < 8, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.concat(F.lit("w"), i * (F.col("doc_id") + 2))), " ")).otherwise(F.col("text")))
    assert sorted(r.doc_id for r in same(quality_filter(varied), docs.columns)) == list(range(8))
    assert len(same(mixed_documents(docs), docs.columns)) >= 9
    assert len(same(near_duplicate_filter(docs), docs.columns)) == 11
    coded = encode(docs)
    assert set(coded.columns) == set(docs.columns) - {"text"} | {"ids"}
    assert {r.doc_id: r.text for r in decode(coded).collect()} == {r.doc_id: r.text or "" for r in docs.collect()}
    named = docs.select(*[F.col("doc_id").alias(c) for c in ("text_", "letters", "key", "parts")], F.col("text").alias("body"), "lang")
    got = predict(named, train(named, "body"), ("text_", "letters", "key", "parts"), "body")
    assert got.columns == ["text_", "letters", "key", "parts", "lang_pred", "score"] and got.count() == 11
    assert dict(text_measures(docs.withColumn("_n_words", F.lit("old"))).dtypes)["_n_words"] == "bigint"


def test_settings_come_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with arrow_batches(spark, 7):
        assert spark.conf.get(name) == "7"
    assert spark.conf.get(name) == before
