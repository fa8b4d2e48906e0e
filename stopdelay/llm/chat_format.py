"""Chat formatting by columnar byte assembly.

Turns are dealt by conversation and stand in order; each Arrow batch is one flat byte buffer. Segment lengths,
cumulative offsets and scatter indices come from numpy, and headers and contents are copied into one preallocated
buffer, which becomes the Arrow column. No Python string is made for a text.

The template of a turn is  HEAD role NL content TAIL,  with HEAD "<|turn|>" and TAIL "<|end|>\\n". A control string in a
content gets a backslash behind its first character, as does one that already has backslashes there, so that no content
holds a control string and taking one backslash away gives the text back.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sliced, table

HEAD, TAIL = b"<|turn|>", b"<|end|>\n"
#: The strings that no content may hold, the template's own and those of common chat templates.
CONTROLS = ("<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>")
ESCAPED = re.compile("|".join(rf"(?<={re.escape(c[0])})\\+{re.escape(c[1:])}" for c in CONTROLS))
TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)

SCHEMA = "conv_id long, part int, n_turns int, formatted string, mask_start array<int>, mask_length array<int>"
PART_BYTES = 1 << 20


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][1:], text)


def _escape_role(role: str | None) -> bytes:
    """Roles take no line breaks: backslashes double and a line break is \\n; control strings are escaped as in texts."""
    r = (role or "").replace("\\", "\\\\").replace("\n", "\\n")
    for c in CONTROLS:
        r = re.sub(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]), lambda m: m[0][0] + "\\" + m[0][1:], r)
    return r.encode()


def _unescape_role(r: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(r))


def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in a flat buffer a backslash goes in, and in which content: behind the first byte of each control string,
    whatever backslashes follow it. A control string lies within one content."""
    at = np.flatnonzero((data == ord("<")) | (data == ord("[")))
    if not len(at):
        return at, at
    solid = np.flatnonzero(data != ord("\\"))  # the byte that follows the backslashes, if any, behind a first byte
    k = np.searchsorted(solid, at + 1)
    after = np.where(k < len(solid), solid[np.minimum(k, len(solid) - 1)], len(data))
    owner = np.searchsorted(offsets, at, side="right") - 1
    hit = np.zeros(len(at), bool)
    for c in CONTROLS:
        rest = np.frombuffer(c[1:].encode(), np.uint8)
        ok = (data[at] == ord(c[0])) & ~hit & (after + len(rest) <= offsets[owner + 1])
        idx = np.flatnonzero(ok)
        for j, byte in enumerate(rest):
            idx = idx[data[after[idx] + j] == byte]
        hit[idx] = True
    return at[hit] + 1, owner[hit]


def assemble(conv: np.ndarray, roles: list[bytes], role_of: np.ndarray, offsets: np.ndarray, data: np.ndarray, learn: np.ndarray, first_part: int, nameless: int = 0) -> pa.RecordBatch:
    """One batch of turns, in order, as a row per run of one conversation. The first `nameless` turns have no conv_id.

    offsets, data: the contents as one buffer.
    """
    n = len(conv)
    marks, owner = _marks(data, offsets)
    size = np.diff(offsets) + np.bincount(owner, minlength=n)[:n]
    role_len = np.array([len(r) for r in roles], np.int64)[role_of]
    turn_len = len(HEAD) + role_len + 1 + size + len(TAIL)
    start = np.concatenate([[0], np.cumsum(turn_len)])
    body = start[:-1] + len(HEAD) + role_len + 1
    out = np.empty(int(start[-1]), np.uint8)

    def put(where: np.ndarray, piece: bytes) -> None:
        out[(where[:, None] + np.arange(len(piece))).ravel()] = np.tile(np.frombuffer(piece, np.uint8), len(where))

    put(start[:-1], HEAD)
    for i, r in enumerate(roles):
        put(start[:-1][role_of == i] + len(HEAD), r + b"\n")
    put(body + size, TAIL)
    pushed = np.zeros(len(data) + 1, np.int64)
    np.add.at(pushed, marks, 1)
    before = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n)[:n])])[:-1]
    shift = np.repeat(body - offsets[:-1] - before, np.diff(offsets))
    to = np.arange(len(data)) + shift + np.cumsum(pushed)[: len(data)]
    out[to] = data
    if len(marks):
        # a mark's place is just before the byte that it precedes; marks never stand at a content's end
        out[to[marks] - 1] = ord("\\")
    # rows: runs of one conversation; mask spans in code points of the row's string
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    new = np.concatenate([[True], conv[1:] != conv[:-1]])
    if 0 < nameless < n:
        new[nameless] = True
    run = np.flatnonzero(new)
    ends = np.concatenate([run[1:], [n]])
    row_of = np.repeat(np.arange(len(run)), ends - run)
    base = points[start[run]]
    spans = np.flatnonzero(learn)
    s0 = points[body[spans]] - base[row_of[spans]]
    length = points[body[spans] + size[spans]] - points[body[spans]]
    per = np.concatenate([[0], np.cumsum(np.bincount(row_of[spans], minlength=len(run)))]).astype(np.int32)
    ints = lambda x: pa.ListArray.from_arrays(pa.array(per), pa.array(x.astype(np.int32)))
    text_offsets = np.append(start[run], start[-1]).astype(np.int32)
    part = np.zeros(len(run), np.int32)
    part[0] = first_part
    formatted = pa.StringArray.from_buffers(len(run), pa.py_buffer(text_offsets), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays(
        [pa.array(conv[run], mask=run < nameless), pa.array(part), pa.array((ends - run).astype(np.int32)), formatted, ints(s0), ints(length)],
        names=["conv_id", "part", "n_turns", "formatted", "mask_start", "mask_length"],
    )


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _format(batches):
    """Turns in order to formatted rows; a conversation that goes on in the next piece goes on in the next part."""
    last, part = None, 0
    for batch in batches:
        offsets, data = _flat(batch.column("text"))
        ids = batch.column("conv_id")
        conv, none = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.null_count  # nulls stand first
        role = batch.column("role").dictionary_encode()
        names = role.dictionary.to_pylist()
        roles, role_of = [_escape_role(x) for x in names], role.indices.to_numpy(zero_copy_only=False)
        learn = np.array([x == "assistant" for x in names], bool)[role_of]
        at = 0
        while at < len(conv):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, side="right")) - 1)
            first = (at < none, conv[at])
            part = part + 1 if first == last else 0
            piece = assemble(conv[at:to], roles, role_of[at:to], offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]], learn[at:to], part, max(0, none - at))
            last, at = (to - 1 < none, conv[to - 1]), to
            if last != first:
                part = 0
            yield piece


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations of turns(conv_id, turn, role, text): SCHEMA, a conversation's parts in order in one partition.

    A conversation is one row, or some rows (parts) of about a MB where it is longer or goes over a batch; a part holds
    whole turns, and mask_start and mask_length are the code points of its assistants' contents. Null text and null
    role are empty. Turns stand by turn, then role, then text, nulls first; repeated rows are repeated turns. Turns
    without a conv_id are one conversation without a number. A very long text is a part of its own. Other columns are not read.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format, SCHEMA)


def _read_back(batches):
    """Digests of conversations, from their formatted parts alone."""
    state = None

    def row():
        conv, turns, n, loss, loss_n, chars = state
        return conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars

    def out(rows):
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in sliced(batches):
        rows = []
        for conv, part, text, starts, lengths in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]):
            if part == 0:
                if state is not None:
                    rows.append(row())
                state = [conv, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, content in TURN.findall(text):
                state[1].update(f"{_unescape_role(role)}\n{unescape(content)}\n".encode())
                state[2] += 1
            for a, n in zip(starts, lengths):
                learnt = unescape(text[a : a + n])
                state[3].update(learnt.encode())
                state[4] += len(learnt)
            state[5] += len(text)
        if rows:
            yield out(rows)
    if state is not None:
        yield out([row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation of format_chats' result, read from the formatted strings and masks."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_chats(turns.unionByName(extra)))


def _sql_role(role: str) -> str:
    return f"replace(replace({role}, '\\', '\\\\'), chr(10), '\\n')"


#: A control string with any backslashes behind its first character.
_SQL_CONTROL = "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS)
OP4_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, {len(HEAD) + 1 + len(TAIL)} + length({_sql_role("role")}) + len(regexp_extract_all({_sql_role("role")}, '{_SQL_CONTROL}'))
    + length(text) + len(regexp_extract_all(text, '{_SQL_CONTROL}')) AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
