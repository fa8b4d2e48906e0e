import random
from fractions import Fraction

import pytest

from stopdelay.llm import mixing as m


def waterfill(sizes, weights, cap=3):
    """Targets by resharing the excess until none is above its cap."""
    total, targets, open_ = Fraction(sum(sizes)), [Fraction(0)] * len(sizes), set(range(len(sizes)))
    left = total
    while open_ and left:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / w >= cap * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / w
            break
        for i in over:
            targets[i] = Fraction(cap * sizes[i])
        open_ -= over
        left = total - sum(targets)
    return targets


def seats(targets, n):
    """Sainte-Lague, seat by seat; ties to the earlier source."""
    out = [0] * len(targets)
    for _ in range(n):
        i = max(range(len(targets)), key=lambda k: (targets[k] / (2 * out[k] + 1), -k))
        if not targets[i]:
            break
        out[i] += 1
    return out


def table_of(spark, sizes):
    rows = [(k, n) for k, n in sizes.items()]
    return spark.createDataFrame(rows, "source string, source_size long")


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_seats(spark, seed):
    r = random.Random(seed)
    names = [*[f"s{i:02}" for i in range(r.randrange(1, 12))], None]
    sizes = {k: r.choice([0, 3, 50, 400, 5000]) for k in names}
    weights = [[5, 2, 1][i % 3] for i in range(len(names))]
    want = waterfill(list(sizes.values()), weights)
    got = {x.source: x for x in m.apportioned(m.targets(table_of(spark, sizes)), 4, 3).collect()}
    for k, t in zip(names, want):
        assert abs(got[k].target - float(t)) < 1e-6 * (1 + float(t))
    total = sum(sizes.values())
    for j in range(4):
        assert [got[k]._cuts[j] for k in names] == seats(want, total // 4 * j // 3)


def test_many_small_sources(spark):
    """House sizes where rounding to the even share is seats away from the right one."""
    sizes = {f"s{i:03}": 40 + i % 7 for i in range(60)} | {"zz": 3000}
    aims = m.targets(table_of(spark, sizes))
    rows = sorted(aims.collect(), key=lambda x: x._rank)
    got = {x.source: x._cuts for x in m.apportioned(aims, 16, 2).collect()}
    for j in (1, 2):
        assert [got[x.source][j] for x in rows] == seats([Fraction(x.target) for x in rows], sum(sizes.values()) // 16 * j // 2)


def docs_of(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 30, 200])), r.choice(["a", "a", "a", "b", "c", None, "d"])) for i in range(n)]
    rows += [(1, rows[1][1], rows[1][2])] * 3 + [(n, None, "a"), (None, "x y", "e"), (n + 1, "z " * 3000, "f")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_taken_is_a_prefix_of_each_stream(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_ROWS", 50)
    rows, df = docs_of(spark)
    sized = m.sized_docs(df)
    got = m.mix(sized, shards=4).collect()
    assert len(got) == len(rows)
    again = sorted((x.doc_id or -1, x.size, x.taken) for x in m.mix(m.sized_docs(df.repartition(5)), shards=4).collect())
    assert again == sorted((x.doc_id or -1, x.size, x.taken) for x in got)
    for source in {x.source for x in got}:
        own = sorted((x for x in got if x.source == source), key=lambda x: (x._order, x.size))
        total, target = sum(x.size for x in own), own[0].target
        assert all(x.source_size == total and x.target == target for x in own)
        taken = sum(x.taken for x in own)
        assert abs(taken - target) <= 16 and all(x.taken <= 3 * x.size and sum(x._spans) == x.taken for x in own)
        stream = [x.doc_id for x in own for _ in range(x.size)] * 3
        want = {}
        for d in stream[:taken]:
            want[d] = want.get(d, 0) + 1
        have = {}
        for x in own:
            have[x.doc_id] = have.get(x.doc_id, 0) + x.taken
        assert {k: v for k, v in have.items() if v} == want


def test_mixed_documents_hold_the_words_taken(spark):
    df = spark.createDataFrame([(i, f"  a{i}\tb{i}\n c{i}  " * (i % 5), ["x", "y", "z"][i % 3], 0) for i in range(60)], "doc_id long, text string, source string, n_chars long")
    out = m.mixed_documents(df)
    assert out.columns == df.columns
    rows, words = out.collect(), {}
    for r in rows:
        assert len(r.text.split()) > 0
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {x.doc_id: x.taken for x in m.mix(m.sized_docs(df)).collect() if x.taken}
    texts = {r.doc_id: r.text for r in df.collect()}
    assert all(texts[r.doc_id].startswith(r.text) for r in rows)


def test_repeated_rows_are_taken_with_their_own_source(spark):
    """The same id and text in two sources: each source's words come from its own row, from the least of repeated ones."""
    rows = [(i, "w " * 40, s, n) for i in range(30) for s, n in (("s1", 5), ("s2", 7), ("s2", 6), (None, 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int")
    got = {}
    for r in m.mixed_documents(df).collect():
        assert r["rank"] == {"s1": 5, "s2": 6, None: 1}[r.source]
        got[r.source] = got.get(r.source, 0) + len(r.text.split())
    want = {}
    for r in m.mix(m.sized_docs(df)).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    assert got == want and len(want) == 3


def test_empty(spark):
    _, df = docs_of(spark, 3)
    assert m.mix(m.sized_docs(df.limit(0))).count() == 0
    none = df.where("text is null")
    assert [(x.target, x.taken) for x in m.mix(m.sized_docs(none)).collect()] == [(0.0, 0)]
    assert m.mixed_documents(none).count() == 0
