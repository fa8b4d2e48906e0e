import itertools
import random

import numpy as np
import sentencepiece

from stopdelay.llm import pieces as s

ODD = ["", " ", "  two  spaces ", "▁ a mark ▁▁", "\n\n\tx \n", "漢字 𠀀 é ñ", "word" * 500, " lead", "trail ", "a\u0000b", "<0x41> </s> <s>", "🙂🙂"]


def best_by_search(word, normal, unknown):
    """The best score over all ways to cut the word."""
    scores = {}
    for p, x in normal:
        scores.setdefault(p, x)
    best = [0.0] + [float("-inf")] * len(word)
    for i in range(1, len(word) + 1):
        for j in range(i):
            if word[j:i] in scores:
                best[i] = max(best[i], best[j] + scores[word[j:i]])
        if word[i - 1] not in scores:
            best[i] = max(best[i], best[i - 1] + unknown)
    return best[-1]


def test_paths_are_best_small_vocabulary():
    r = random.Random(5)
    for _ in range(60):
        vocab = {"".join(r.choices("ab" + s.MARK, k=r.randrange(1, 5))) for _ in range(12)}
        scores = {p: -r.randrange(1, 30) for p in vocab}
        model = {"pieces": ["<unk>", *vocab], "scores": [0, *scores.values()], "kinds": [2] + [1] * len(vocab), "prefix": False}
        p = s.Pieces(model)
        for n in range(1, 6):
            for word in map("".join, itertools.product("abc", repeat=n)):
                ids = p.best_path(word)
                got = sum(p.unknown_score if i == 0 else model["scores"][i] for i in ids)
                assert got == best_by_search(word, scores.items(), p.unknown_score)
        # cutting into words changes no score
        for text in ("a b", " a  bab ab ", "ab " * 5):
            ids = np.frombuffer(p.encode(text), "<i4")
            got = sum(p.unknown_score if i == 0 else model["scores"][i] for i in ids)
            assert got == best_by_search(text.replace(" ", s.MARK), scores.items(), p.unknown_score)


def test_real_model_round_trip_and_library_decodes():
    model = s.load_model()
    p = s.Pieces(model)
    lib = sentencepiece.SentencePieceProcessor(model_file=s.MODEL)
    normal = [(x, y) for x, y, k in zip(model["pieces"], model["scores"], model["kinds"]) if k in (1, 4)]
    for t in ODD + ["The quick brown fox jumps over the lazy dog."]:
        ids = np.frombuffer(p.encode(t), "<i4").tolist()
        assert p.decode(np.array(ids, np.int32), np.array([0, len(ids)])).to_pylist() == [t]
        if s.MARK not in t and "\0" not in t:
            assert lib.decode(ids) == t
    for w in ("▁jumps", "▁internationalization", "xyz▁▁▁q"):
        got = sum(model["scores"][i] for i in p.best_path(w))
        assert got == best_by_search(w, normal, p.unknown_score)


def test_ids_that_are_no_text():
    p = s.Pieces(s.load_model())
    lone = p.byte_ids[0xE6]
    got = p.decode(np.array([lone, lone, p.byte_ids[0xA1], p.byte_ids[0x61]], np.int32), np.array([0, 1, 1, 4]))
    assert got.to_pylist() == ["\ufffd", "", "\ufffda"]


def test_spark_round_trip(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, None, *ODD])], "doc_id long, text string, _ids string")
    coded = s.encode(df)
    assert coded.columns == ["doc_id", "_ids", "ids"]
    want = {i: t or "" for i, t in enumerate([*ODD, None, *ODD])}
    assert {r.doc_id: r.text for r in s.decode(coded.drop("_ids")).collect()} == want
    assert s.encode(df.limit(0)).count() == 0
    rows = s.op5_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.round_trip for r in rows)
