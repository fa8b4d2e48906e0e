
from stopdelay.llm import line_dedup as d

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    docs = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and i is not None:
                docs.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(docs.get(key(x), ())) >= min_docs and (i is None or i < max(docs[key(x)])))]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def test_against_plain_python(spark):
    line, other = "This line is common to many of the documents É", "Another common line that has forty characters"
    rows = [(i, f"own {i}\n{line if i % 2 else '  ' + line.replace('T', 't') + chr(9)}\n{line}\nend") for i in range(8)]
    rows += [(10 + i, other) for i in range(4)] + [(20 + i, f"{other.upper()}\n\n") for i in range(3)]
    rows += [(30, None), (31, ""), (32, "\n\n"), (None, f"{line}\nx"), (7, f"{line}\nrepeated id"), (7, rows[7][1]), (33, "x" * 45), (34, ("x" * 45 + "\n") * 5000)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, key string, pos string")
    got = d.line_dedup(df)
    assert got.columns == [*df.columns, "_n_lines", "_n_dropped"]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.text, r._n_lines, r._n_dropped) for r in got.collect()), key=order) == sorted(plain(rows), key=order)
    assert d.line_dedup(df.limit(0)).count() == 0
