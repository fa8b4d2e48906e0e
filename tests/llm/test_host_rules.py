import re

from stopdelay.llm import host_rules as h

WORD, SPACE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x20\x09-\x0D]")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    hit = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def verdicts(rows, max_rate=0.5):
    """Kept or not, by the stated prior, in plain arithmetic. rows: (host, text)."""
    m = [measures(t) for _, t in rows]
    bad = [a < 50 or 100 * e > 50 * a for a, _, _, _, e in m]
    hosts = {}
    for (host, _), b in zip(rows, bad):
        x = hosts.setdefault(host, [0, 0])
        x[0] += 1
        x[1] += b
    n, f = sum(x for x, _ in hosts.values()), sum(y for _, y in hosts.values())
    if not n:
        return []
    mean = f / n
    v = sum(y * y / x for x, y in hosts.values()) / n - mean * mean - mean * (1 - mean) * len(hosts) / n
    k = min(1e6, max(1.0, mean * (1 - mean) / v - 1)) if v > 1e-12 else 1e6
    ok = {host: (y + mean * k) / (x + k) <= max_rate for host, (x, y) in hosts.items()}
    return [not b and ok[host] for (host, _), b in zip(rows, bad)]


LONG = " ".join(f"word{i}" for i in range(60))


def test_measures(spark):
    texts = ["", None, "a", "a b c a b c", "x x x x", "x x x", "#a *b $ % & | < >", "l\nl\n \n \nm\nl", "a b c", "é漢 𠀀\tz", LONG, LONG + "\n" + LONG, "go " * 30_000]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: (r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words) for r in h.text_measures(df).collect()}
    assert got == {i: measures(t) for i, t in enumerate(texts)}


def test_host_verdicts(spark):
    rows = [(f"good{i % 7}", LONG + f" {i}") for i in range(210)] + [("bad", "short")] * 45 + [("bad", LONG)] * 5 + [(None, LONG)] * 3 + [("tiny", "short"), ("tiny", LONG)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, source string, text string")
    got = {r.doc_id: r._kept for r in h.judged(h.text_measures(df)).collect()}
    assert got == dict(enumerate(verdicts(rows)))
    assert not any(got[i] for i, x in enumerate(rows) if x[0] == "bad") and all(got[i] for i in range(210))
    kept = h.quality_filter(df)
    assert kept.columns == df.columns and kept.count() == sum(got.values())


def test_empty_and_uniform(spark):
    df = spark.createDataFrame([(1, "a", LONG)], "doc_id long, source string, text string")
    assert h.quality_filter(df.limit(0)).count() == 0
    assert h.quality_filter(df).count() == 1
    assert h.quality_filter(df.union(df)).count() == 2
