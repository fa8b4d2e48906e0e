import math
import random
import zlib

import numpy as np

from stopdelay.llm import ppm_langid as p


def naive(train: dict[str, list[bytes]], text: bytes) -> dict[str, float]:
    """Code lengths in bits, byte by byte, from plain dictionaries."""
    out = {}
    for lang, texts in train.items():
        tree: dict[bytes, dict[int, int]] = {}
        for t in texts:
            t = b"\0\0\0" + t
            for i in range(3, len(t)):
                for k in range(4):
                    node = tree.setdefault((k, t[i - k : i]), {})
                    node[t[i]] = node.get(t[i], 0) + 1
        bits, padded = 0.0, b"\0\0\0" + text
        for i in range(3, len(padded)):
            excluded: set[int] = set()
            for k in (3, 2, 1, 0):
                node = tree.get((k, padded[i - k : i]))
                if node is None:
                    continue
                rest = {s: c for s, c in node.items() if s not in excluded}
                total, kinds = sum(rest.values()), len(rest)
                if padded[i] in rest:
                    bits -= math.log2(rest[padded[i]] / (total + kinds))
                    break
                if kinds:
                    bits -= math.log2(kinds / (total + kinds))
                excluded |= set(node)
            else:
                bits += math.log2(max(1, 256 - len(excluded)))
        out[lang] = bits
    return out


def tree_of(train):
    counts = {}
    for lang, texts in train.items():
        data = np.frombuffer(b"".join(texts), np.uint8)
        g = p.grams(data, np.cumsum([0, *map(len, texts)])[:-1])
        counts[lang] = np.unique(g, return_counts=True)
    return p.Tree(counts)


def test_code_lengths_are_exact(monkeypatch):
    r = random.Random(1)
    make = lambda alphabet, n: bytes(r.choices(alphabet, k=n))
    train = {"aa": [make(b"abc ", r.randrange(0, 60)) for _ in range(30)], "bb": [make(b"bcde", r.randrange(0, 60)) for _ in range(30)], "cc": [b"x", b"", b"xy"]}
    t = tree_of(train)
    texts = [make(b"abcdexyz ", r.randrange(0, 40)) for _ in range(40)] + [b"", b"", bytes(range(256))]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = t.score(data, offsets)
    for text, row in zip(texts, whole):
        want = naive(train, text)
        assert np.allclose(row / p.UNIT, [want[x] for x in t.langs], atol=1e-5 * (1 + len(text)))
    monkeypatch.setattr(p, "CHUNK", 7)
    assert (t.score(data, offsets) == whole).all()


def test_held_out_accuracy_and_learning(spark):
    d = "/root/testdata/sf0.01"
    rows = p.op1_ppm_langid(spark, d).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_spark_counts_equal_plain_counts(spark):
    train = {"a": ["hello there", "", "héllo"], "b": ["xyz xyz", "x"]}
    df = spark.createDataFrame([(t, k) for k, v in train.items() for t in v] + [(None, "a"), ("zzz", None)], "text string, lang string")
    t, want = p.train(df), tree_of({k: [x.encode() for x in v] for k, v in train.items()})
    assert t.langs == want.langs and (t.table == want.table).all()


def test_nulls_no_letters_empty_tables(spark):
    labelled = spark.createDataFrame([("hello world", "en"), ("bonjour le monde", "fr")], "text string, lang string")
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (None, "hello", "x"), (5, "bonjour " * 300_000, "x"), (5, "漢字", "x")], "doc_id long, text string, lang_pred string")
    got = [(r.doc_id, r.lang_pred) for r in p.predict(docs, p.train(labelled)).collect()]
    assert got[:5] == [(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "fr")] and got[5][1] in ("en", "fr")
    empty = p.train(labelled.limit(0))
    assert {(r.lang_pred, r.score) for r in p.predict(docs, empty).collect()} == {("und", 0.0)}
    assert p.predict(docs.limit(0), empty).count() == 0


def test_nothing_is_cut_however_many_leaves(spark, monkeypatch):
    """A model in parts, of groups of languages and of one language's contexts, gives what one tree of all counts gives."""
    r = random.Random(4)
    make = lambda alphabet, n: "".join(r.choices(alphabet, k=n))
    train = {"big": [make("abcdefgh é", 200) for _ in range(40)], **{f"l{k}": [make("abcdé"[k : k + 2] + " ", 30) for _ in range(3)] for k in range(4)}}
    df = spark.createDataFrame([(t, k) for k, v in train.items() for t in v], "text string, lang string")
    texts = [make("abcdefghéz ", r.randrange(1, 40)) for _ in range(60)] + ["", None, "12", "aé", "aé"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = tree_of({k: [x.encode() for x in v] for k, v in train.items()})
    want = sorted(tuple(x) for x in p.predict(docs, whole).collect())
    monkeypatch.setattr(p, "LEAVES", 500)
    monkeypatch.setattr(p, "CELLS", 500)
    model = p.train(df)
    assert model.langs == whole.langs and len(model.parts) > 10 and sum(len(x) > 1 for x, _ in model.parts) >= 1
    assert sorted(tuple(x) for x in p.predict(docs, model).collect()) == want


def test_languages_keep_all_their_leaves(spark):
    """More than 2^17 kinds of grams in one language, and many languages."""
    r = np.random.default_rng(5)
    rows = [("".join(map(chr, r.integers(33, 127, 4000))), "a") for _ in range(60)] + [("".join(map(chr, r.integers(33, 127, 7000))), f"b{k}") for k in range(60)]
    t = p.train(spark.createDataFrame(rows, "text string, lang string"))
    want = tree_of({k: [x.encode() for x, y in rows if y == k] for _, k in rows})
    trees = [x.value for _, x in t.parts] if isinstance(t, p.Forest) else [t]
    got = {x: per for tree in trees for x, per in zip(tree.langs, tree.levels)}
    assert sorted(got) == want.langs and len(got["a"][3][0]) > 1 << 17
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for x, per in zip(want.langs, want.levels) for a, b in zip(got[x], per))
