"""Every stage of the pipeline against a plain version over the stage's own input."""

import random

import corpus_pipeline as c
from stopdelay.llm import pieces
from stopdelay.llm.shared import staged

from .test_host_rules import verdicts
from .test_line_dedup import plain
from .test_mixing import seats, waterfill
from .test_ngram_join import brute


def corpus(spark):
    r = random.Random(4)
    vocab = [f"word{i}" for i in range(300)]
    shared = "A line that stands in many of the documents of this corpus."
    rows, doc = [], 0
    for group in range(40):
        base = r.choices(vocab, k=r.choice([30, 70, 120, 200]))
        for _ in range(r.choice([1, 1, 2, 4])):
            words = list(base)
            for _ in range(r.choice([0, 1, 3])):
                words[r.randrange(len(words))] = r.choice(vocab)
            cut = len(words) // 2
            text = " ".join(words[:cut]) + ("\n" + shared + "\n" if r.random() < 0.4 else "\n") + " ".join(words[cut:])
            rows.append((doc, text, "en", f"src{group % 4}" if r.random() < 0.9 else None, len(text)))
            doc += 1
    rows += [(doc, None, "en", "src0", 0), (doc + 1, "", None, "src1", 0), (doc + 2, "spam " * 80, "en", "src2", 400), (doc + 3, "short", "en", "src3", 5)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    rows, docs = corpus(spark)
    names = [n for n, _ in c.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "sentencepiece"]
    outs, at = {}, docs
    for name, stage in c.STAGES:
        at = staged(stage(spark, at, ""))
        outs[name] = [tuple(x) for x in at.collect()]
        if name != "sentencepiece":
            assert at.columns == docs.columns
    keep = verdicts([(x[3], x[1]) for x in rows])
    good = [x for x, k in zip(rows, keep) if k]
    assert sorted(outs["quality_rules"]) == sorted(good) and 0 < len(good) < len(rows)

    lines = {i: t for i, t, _, _ in plain([(x[0], x[1]) for x in good])}
    assert sorted((x[0], x[1], x[4]) for x in outs["line_dedup"]) == sorted((i, t, len(t)) for i, t in lines.items())
    assert any(lines[x[0]] != x[1] for x in good)

    deduped = sorted(outs["line_dedup"])
    found = brute([x[1] for x in deduped], 5, 80)
    kept = [x for i, x in enumerate(deduped) if found[i][1] == i or not found[i][0]]
    assert sorted(outs["near_duplicates"]) == kept and len(kept) < len(deduped)

    words = lambda t: len((t or "").split())
    sources = sorted({x[3] for x in kept}, key=lambda s: (s is None, s))
    sizes = [sum(words(x[1]) for x in kept if x[3] == s) for s in sources]
    blocks = seats(waterfill(sizes, [[5, 2, 1][i % 3] for i in range(len(sources))]), sum(sizes) // 16)
    texts = {x[0]: x[1] for x in kept}
    for s, n, size in zip(sources, blocks, sizes):
        assert sum(words(x[1]) for x in outs["mix_sources"] if x[3] == s) == min(16 * n, 3 * size)
    assert all(texts[x[0]].startswith(x[1]) and x[4] == len(x[1]) for x in outs["mix_sources"])

    p = pieces.Pieces(pieces.load_model())
    import numpy as np

    coded = sorted((x[0], tuple(x[2])) for x in outs["sentencepiece"])
    assert coded == sorted((x[0], tuple(np.frombuffer(p.encode(x[1]), "<i4").tolist())) for x in outs["mix_sources"])


def test_run_and_odd_tables(spark, tmp_path):
    rows, docs = corpus(spark)
    docs.withColumnsRenamed({"lang": "size"}).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert c.run(spark, f"{tmp_path}/a").count() > 0
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert c.run(spark, f"{tmp_path}/b").count() == 0
