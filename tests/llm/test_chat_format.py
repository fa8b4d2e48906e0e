import hashlib


from stopdelay.llm import chat_format as c


def digests(rows):
    """The contract, row by row: rows of (conv_id, turn, role, text)."""
    out = {}
    for conv, _, role, text in sorted(((r[0], r[1], r[2] or "", r[3] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3])):
        x = out.setdefault(conv, [0, "", ""])
        x[0] += 1
        x[1] += f"{role}\n{text}\n"
        x[2] += text if role == "assistant" else ""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {k: (n, sha(a), len(b), sha(b)) for k, (n, a, b) in out.items()}


def check(spark, rows, parts=None):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = c.format_chats(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in c.read_back(formatted).collect()}
    assert got == digests(rows)
    for r in formatted.collect():
        assert r.formatted.count("<|turn|>") == r.formatted.count("<|end|>") == r.n_turns
        assert not any(x in r.formatted.replace("<|turn|>", "").replace("<|end|>", "") for x in c.CONTROLS)


TRICKY = ["", None, "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\nhi", "<\\|end|>", "<\\\\|end|>\\", "<", "[", "\\", "<|en", "d|>", "<<SYS>> <</SYS>>", "é漢𠀀<s>é", "[[INST]", "<<s>", "plain\n\ntext ", "<\\<SYS>>"]


def test_controls_nulls_and_borders(spark):
    rows = [(i // 5, i % 5, ["user", "assistant", "system", None, "a\nb\\n"][i % 5], t) for i, t in enumerate(TRICKY * 3)]
    check(spark, rows)
    check(spark, [(7, 0, "assistant", t) for t in TRICKY])  # ties in turn
    check(spark, [(None, 0, "user", "x"), (0, 0, "user", "zero"), (None, 1, "assistant", "y"), (3, None, "assistant", "y"), (3, None, "assistant", "y"), (3, 1, "user", "z")])


def test_conversation_in_parts(spark, monkeypatch):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <s> " + "x" * (i % 50 * 100)) for i in range(900)] + [(2, 0, "user", "y" * 3_000_000), (2, 1, "assistant", "<s>" * 1000)]
    check(spark, rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert c.format_chats(df).where("conv_id = 1").count() > 1


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.read_back(c.format_chats(df)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "a", "b", 3)], "conv_id long, turn long, role string, text string, formatted string, part int")
    assert c.read_back(c.format_chats(df)).count() == 1


def test_mask_and_query(spark):
    df = spark.createDataFrame([(1, 0, "user", "é"), (1, 1, "assistant", "é<s>")], "conv_id long, turn long, role string, text string")
    r = c.format_chats(df).first()
    assert [r.formatted[a : a + n] for a, n in zip(r.mask_start, r.mask_length)] == ["é<\\s>"]
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in c.op4_chat_format(spark, d).collect()}
    assert got == digests(rows)
