import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from stopdelay.llm import byte_pairs as b

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.load_ranks(), special_tokens={})


@pytest.fixture(scope="module")
def pairs():
    return b.BytePairs(b.load_ranks())


def merged(data, ranks):
    """Merging as it is defined: the leftmost pair of the least rank, again and again."""
    parts = [bytes([x]) for x in data]
    while True:
        rank, at = min(((ranks.get(x + y, b.NEVER), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))), default=(b.NEVER, 0))
        if rank == b.NEVER:
            return [ranks[x] for x in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def some_ranks(r, letters):
    """Ranks as no training gives them: any strings in any order, some that merging never makes."""
    more = {bytes(r.choices(letters, k=r.randint(2, 5))) for _ in range(r.randint(0, 25))}
    tokens = [*sorted(more), *[bytes([x]) for x in range(256)]]
    r.shuffle(tokens)
    return {t: i for i, t in enumerate(tokens)}


def test_last_tokens_appends_and_edits_of_any_ranks():
    for seed in range(150):
        r = random.Random(seed)
        letters = b"ab" if seed % 3 else b"abc"
        p = b.BytePairs(some_ranks(r, letters))
        data = bytes(r.choices(letters, k=r.randint(0, 60)))
        last = p.last_tokens(data)
        for n in range(len(data) + 1):
            assert p.path(last[: n + 1]) == merged(data[:n], p.ranks)
        more = bytes(r.choices(letters, k=9))
        assert p.last_tokens(data + more, last) == p.last_tokens(data + more)
        for _ in range(5):
            start = r.randint(0, len(data))
            stop = r.randint(start, len(data))
            new = bytes(r.choices(letters, k=r.randint(0, 4)))
            assert p.edit(data, last, start, stop, new) == (data[:start] + new + data[stop:], p.last_tokens(data[:start] + new + data[stop:]))


def test_edit_reads_only_what_is_near(pairs):
    data = b"abracadabra" * 3000
    last = pairs.last_tokens(data)
    read, plain = [], pairs.last_tokens
    pairs.last_tokens = lambda d, known=(): (read.append(len(d) - len(known)), plain(d, known))[1]
    try:
        out, new = pairs.edit(data, last, 5000, 5003, b"xyz")
    finally:
        del pairs.last_tokens
    assert new == pairs.last_tokens(out) and sum(read) < 500


def words(r):
    kinds = ["abcdefgh", "  \n\t", "äöüßéñ", "0123456789", "'’.,!?-", "你好世界漢字", "  　", "👍🏽é́", "the and 're's'll"]
    return "".join(r.choice(r.choice(kinds)) for _ in range(r.randint(0, 60)))


def test_texts_as_the_library_does(pairs, library):
    r = random.Random(5)
    for _ in range(3000):
        t = words(r)
        assert list(memoryview(pairs.encode(t)).cast("i")) == library.encode_ordinary(t), t
        start = r.randint(0, len(t))
        stop = r.choice([start, r.randint(start, len(t)), len(t)])
        new = words(r)[: r.randint(0, 12)]
        assert pairs.reencode(t, library.encode_ordinary(t), start, stop, new) == library.encode_ordinary(t[:start] + new + t[stop:]), (t, start, stop, new)


def test_every_token_and_long_words(pairs, library):
    for word in ["a" * 20_000, " " * 5000 + "x", "漢字" * 4000, "ab" * 9000 + "'re", "<|endoftext|>" * 50]:
        assert list(memoryview(pairs.encode(word)).cast("i")) == library.encode_ordinary(word)


def test_frames(spark, library):
    long = "wörter und zahlen 123 " * 20_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x"), (4, long, "x"), (5, "it's  ", "y"), (None, "null id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, data string").withColumn("ids_", b.F.lit(7))
    coded = b.encode(df)
    assert coded.columns == ["doc_id", "data", "ids_", "ids"]
    got = sorted((str(x.doc_id), x.ids) for x in coded.collect())
    assert got == sorted((str(i), library.encode_ordinary(t or "")) for i, t, _ in rows)
    back = b.decode(coded)
    assert sorted((str(x.doc_id), bytes(x.data)) for x in back.collect()) == sorted((str(i), (t or "").encode()) for i, t, _ in rows)
    assert b.encode(df.limit(0)).count() == 0 and b.decode(coded.limit(0)).count() == 0
    kept = df.join(coded.select("doc_id", "ids").dropDuplicates(["doc_id"]), df["doc_id"].eqNullSafe(coded["doc_id"])).select(df["doc_id"], "text", "data", "ids")
    grown = b.append(kept, "data")
    assert all(x.text == (y := {str(i): (t or "") + (d or "") for i, t, d in rows}[str(x.doc_id)]) and x.ids == library.encode_ordinary(y) for x in grown.collect())
    cut = b.replace(kept, b.F.lit(2), b.F.lit(6), b.F.lit("'ll "))
    assert all(x.ids == library.encode_ordinary(x.text) for x in cut.collect())
    assert {x.text for x in cut.where("doc_id = 3").collect()} == {"he'll world"}


def test_ids_that_are_none(spark):
    df = spark.createDataFrame([(1, [50, None])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="ranks"):
        b.decode(df).collect()
    assert b.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().data == b""


def test_query_against_the_library(spark, library):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted(map(tuple, b.op13_byte_bpe(spark, D).collect())) == sorted(want)


def test_short_words_from_their_ends(pairs):
    """The same encodings with few prefixes looked at, of any ranks too."""
    for seed in range(150):
        r = random.Random(seed)
        letters = b"ab" if seed % 3 else b"abc"
        p = b.BytePairs(some_ranks(r, letters))
        for _ in range(20):
            data = bytes(r.choices(letters, k=r.randint(0, 40)))
            assert p.short_path(data) == p.path(p.last_tokens(data)) == merged(data, p.ranks)
    known = {0: -1}
    pairs.last_token(b" internationalisations", 22, known)
    assert len(known) < 12
    for word in ["x" * b.SHORT, "9f" * (b.SHORT // 2), "漢字" * 42, "a" * (b.SHORT + 1)]:
        assert pairs.short_path(word.encode()) == pairs.path(pairs.last_tokens(word.encode()))
