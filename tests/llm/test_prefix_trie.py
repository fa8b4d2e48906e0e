import hashlib
import random
import zlib

import pytest

import __spark_entry__ as entry
from stopdelay.llm import prefix_trie as t
from tests.oracle import compare

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    """convs: {conv_id: list of (turn, chars)}"""
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = lambda p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(path))
        out.append((
            members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), len(kids(path)), sum(not kids(p) for p in below),
            sum((len(nodes[p]) - 1) * p[-1][1] for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def frame(spark, convs):
    rows = [(c, b"".join(hashlib.md5(str(x).encode()).digest() for x in turns), [x[1] for x in turns]) for c, turns in convs.items()]
    return spark.createDataFrame(rows, "conv_id long, key binary, chars array<long>")


def found(df):
    return sorted((tuple(r[x] for x in NAMES) for r in df.collect()), key=str)


def some(r, n, kinds, longest):
    letters = [(x, r.randint(0, 9)) for x in range(kinds)]
    return {i * 7 - 20: r.choices(letters, k=r.randint(0, longest)) for i in range(n)}


@pytest.mark.parametrize("kind", ["few turns", "deep", "copies", "wide", "one", "turnless"])
def test_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(t, "RANGE_TURNS", 25)
    monkeypatch.setattr(t, "MERGED", 3)
    monkeypatch.setattr(t, "CHUNK", 50)
    r = random.Random(4)
    convs = {"few turns": lambda: some(r, 120, 2, 6), "deep": lambda: some(r, 40, 1, 30), "copies": lambda: {i: [(1, 5), (2, 3)] if i % 3 else [(1, 5)] * (i % 7) for i in range(200)}, "wide": lambda: some(r, 300, 300, 2), "one": lambda: {7: [(1, 2), (3, 4)]}, "turnless": lambda: {1: [], 2: []}}[kind]()
    assert found(t.prefix_trie(frame(spark, convs))) == brute(convs)


def test_radix_tree_layouts_and_lookups():
    r = random.Random(2)
    for size, letters in ((3, 2), (4, 20), (4, 60), (8, 256), (0, 1)):
        keys = sorted({bytes(r.randrange(letters) for _ in range(r.randint(0, size))) for _ in range(700)})
        tree = t.RadixTree()
        for i in r.sample(range(len(keys)), len(keys)):
            tree.insert(keys[i], i)
        assert [tree.find(k) for k in keys] == list(range(len(keys)))
        assert tree.find(b"\x00" * 20) == -1 and tree.find(b"\xff" * 3 + b"\x01") == -1
        walked = [x[0] for x in tree.walk()]
        assert [x.row for x in walked if x.row >= 0] == list(range(len(keys)))  # in key order
        for x in walked:
            n = len(x.children())
            assert n <= x.room and type(x) is (t.Node4 if n <= 4 else t.Node16 if n <= 16 else t.Node48 if n <= 48 else t.Node256)
            assert n != 1 or x.row >= 0  # a path without branches is one node


def test_common_beginnings():
    r = random.Random(3)
    for _ in range(500):
        a, b = (bytes(r.choices(b"ab", k=r.randint(0, 9))) for _ in range(2))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert t.common(a, b) == n


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), len(text)))
    own = {c: [x[2:] for x in sorted(turns, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, turns in own.items()}
    out = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100 if c > 0 else -(abs(c) % 100))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def test_odd_rows(spark):
    r = random.Random(9)
    rows = [(c, r.choice([None, 0, 1, 1, 2, 7]), r.choice([None, "", "user", "assistant"]), r.choice([None, "", "a", "ä\n", "x" * 500])) for c in [*range(0, 12), *range(95, 130), 300, 205, -3, -100, -205] for _ in range(r.randint(1, 8))]
    rows += [(None, 1, "user", "no conversation"), (3, 1, "user", "twice"), (3, 1, "user", "twice"), (310, 0, "user", "long " * 100_000)]
    df = spark.createDataFrame([(*x, "a", 1, None) for x in rows], "conv_id long, turn long, role string, text string, hundred string, id int, turns string")
    got = t.prefix_trie(t.keyed(t.with_shared_heads(t.turn_lists(df))))
    assert found(got) == brute(rebuilt(rows))
    assert t.prefix_trie(t.keyed(t.turn_lists(df.limit(0)))).collect() == []
    first = {r["turn_id"] for r in t.prefix_trie(t.keyed(t.turn_lists(df.where("conv_id = 310")))).collect()}
    assert first == {None, hashlib.md5(b"4:user" + b"long " * 100_000).hexdigest()}


def test_query(spark):
    ok, what = compare(spark, "/root/testdata/sf0.01", entry.queries()["op11_prefix_trie"], entry.oracle_sql()["op11_prefix_trie"])
    assert ok, what
