"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Of the tokens that end a text's prefix exactly one can be the last of the prefix's encoding: the one that fits behind
the last token of what stands before it. So a table with one token a prefix holds the encodings of all prefixes; a text is
read once, an append goes on where the table ends, and an edit makes the table anew only until it agrees with the old one.

Two tokens fit if merging their bytes together gives these two again. A list of tokens is an encoding exactly if each
fits behind the one before it: merges that no neighbour crosses go on inside of each token as if it stood alone.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from itertools import accumulate
from struct import pack

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free, sliced, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
NEVER = 1 << 60
#: Encodings of words that a worker remembers, twice so many at most, of at most so many characters; pairs of tokens likewise.
REMEMBERED, WORD_CHARS, PAIRS = 1 << 18, 48, 1 << 20
#: Bytes of a word up to which only the prefixes are looked at that its encoding may need.
SHORT = 256
SPACE = regex.compile(r"\s")


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    """Tokens and their ranks, which are their ids too. All 256 bytes must be there, so that every text has an encoding."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("the ranks lack a byte")
    return ranks


class BytePairs(dict):
    """Encoder and decoder; as a dict it remembers words: their tokens' ids as little-endian 32-bit numbers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        super().__init__()
        self.ranks, self.older, self.words = ranks, {}, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.begins = {token[:n] for token in ranks for n in range(1, len(token) + 1)}
        self.ends = dict.fromkeys((token[n:] for token in ranks for n in range(1, len(token))), -1) | ranks
        self.longest = max(map(len, ranks))
        self.fitting: dict[int, bool] = {}
        self.grown: dict[int, tuple[list, list] | None] = {}
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes = np.array([len(x) for x in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def growth(self, token: int) -> tuple[list, list] | None:
        """How merging makes a token from its bytes: its leftmost part, and its rightmost, each with the rank of the merge
        that comes next. None if merging doesn't end in this token."""
        if token not in self.grown:
            ranks, parts, left, right = self.ranks, [bytes([b]) for b in self.tokens[token]], [], []
            while True:
                rank, at = min(((ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
                left.append((parts[0], rank))
                right.append((parts[-1], rank))
                if rank == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.grown[token] = (left, right) if len(parts) == 1 else None
        return self.grown[token]

    def fits(self, last: int, token: int) -> bool:
        """Whether token can stand behind last (-1: at the start). Of two merges of one rank the left one comes first."""
        key = (last + 1 << 32) | token
        known = self.fitting.get(key)
        if known is None:
            if len(self.fitting) >= PAIRS:
                self.fitting.clear()
            known = self.fitting[key] = self._fits(last, token)
        return known

    def _fits(self, last: int, token: int) -> bool:
        own = self.growth(token)
        if own is None or last < 0:
            return own is not None
        (right, left), i, j, ranks = (self.growth(last)[1], own[0]), 0, 0, self.ranks
        while True:
            (a, of_last), (b, of_token) = right[i], left[j]
            across = ranks.get(a + b, NEVER)
            if across < of_last and across <= of_token:
                return False
            if of_last == of_token == NEVER:
                return True
            if of_last <= of_token:
                i += 1
            else:
                j += 1

    def last_tokens(self, data: bytes, known: list[int] = ()) -> list[int]:
        """The last token of each prefix's encoding, from the empty one (-1) on. known: those of the first prefixes."""
        begins, ranks, fitting, n = self.begins, self.ranks, self.fitting, len(data)
        last = [-1, *[None] * n]
        last[: len(known)] = known
        for at in range(max(0, len(known) - self.longest), n):
            before = last[at]
            for to in range(at + 1, n + 1):
                piece = data[at:to]
                if piece not in begins:
                    break
                token = ranks.get(piece)
                if token is not None and last[to] is None:  # a longer token that fits was found before a shorter one
                    fit = fitting.get((before + 1 << 32) | token)
                    if fit or (fit is None and self.fits(before, token)):
                        last[to] = token
        return last

    def last_token(self, data: bytes, n: int, known: dict[int, int]) -> int:
        """The last token of the prefix of n bytes, by those of the shorter prefixes that it may stand behind; known takes
        what was found, {0: -1} at first. Just one token fits, so the longest is tried first and the others seldom."""
        ends, fitting, found = self.ends, self.fitting, []
        for at in range(n - 1, -1, -1):
            token = ends.get(data[at:n])
            if token is None:
                break
            if token >= 0:
                found.append((at, token))
        for at, token in reversed(found):
            before = known.get(at)
            if before is None:
                before = self.last_token(data, at, known)
            fit = fitting.get((before + 1 << 32) | token)
            if fit or (fit is None and self.fits(before, token)):
                known[n] = token
                return token
        raise ValueError("no token fits")

    def short_path(self, data: bytes) -> list[int]:
        """path(last_tokens(data)) of a short word, from its end."""
        known, at, ids = {0: -1}, len(data), []
        if at:
            self.last_token(data, at, known)
        while at:
            ids.append(known[at])
            at -= len(self.tokens[known[at]])
        ids.reverse()
        return ids

    def path(self, last: list[int]) -> list[int]:
        """The encoding of the whole, from the last tokens of its prefixes."""
        at, ids = len(last) - 1, []
        while at:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        ids.reverse()
        return ids

    def edit(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """data[start:stop] replaced by new: the data and its last tokens. Prefixes are read from start on until, behind
        the edit, as many in a row as the longest token has bytes end as they did before; the others are as they were."""
        out = data[:start] + new + data[stop:]
        known, moved, at = last[: start + 1], len(new) - (stop - start), start + len(new)
        while len(known) <= len(out):
            to = min(len(out), max(at, len(known) - 1) + 4 * self.longest)
            known = self.last_tokens(out[:to], known)
            tail = range(max(at, to - self.longest) + 1, to + 1)
            # the next prefix's last token begins within these, and all its bytes stand behind the edit
            if len(tail) == self.longest and all(known[i] == last[i - moved] for i in tail):
                known += last[to - moved + 1 :]
                break
        return out, known

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            data = word.encode()
            whole = self.ranks.get(data)  # a word that is a token is that one, whatever merging gives
            path = [whole] if whole is not None else self.short_path(data) if len(data) <= SHORT else self.path(self.last_tokens(data))
            ids = pack(f"<{len(path)}i", *path)
        if len(word) <= WORD_CHARS:
            if len(self) >= REMEMBERED:  # words of the last two rounds are known
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        return b"".join(map(self.__getitem__, self.words.findall(text)))

    def reencode(self, text: str, ids: list[int], start: int, stop: int, new: str) -> list[int]:
        """The ids of text with text[start:stop] replaced by new, from the text's ids. Only what stands between the word
        ends around the edit is encoded again: a word never goes on from another character into white space, and how
        words are split is seen from what follows them alone."""
        cut = lambda p: SPACE.match(text, p) and not SPACE.match(text, p - 1)
        a = next((p for p in range(start - 1, 0, -1) if cut(p)), 0)
        b = next((p for p in range(stop + 1, len(text)) if cut(p)), len(text))
        ends = [0, *accumulate(len(self.tokens[i]) for i in ids)]
        head, tail = bisect_left(ends, len(text[:a].encode())), bisect_left(ends, ends[-1] - len(text[b:].encode()))
        mid = np.frombuffer(self.encode(text[a:start] + new + text[stop:b]), "<i4").tolist()
        return [*ids[:head], *mid, *ids[tail:]]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of lists of ids, offsets[i] to offsets[i + 1] in one array, put together as one buffer."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.sizes) and self.sizes[ids].all()):
            raise ValueError("an id that the ranks don't have")
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = self.flat[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(ends[offsets].astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


_built: dict[int, BytePairs] = {}


def _ready(model) -> BytePairs:
    """The encoder of broadcast ranks, built once in a worker."""
    key, ranks = model.value
    if key not in _built:
        _built.clear()
        _built[key] = BytePairs(ranks)
    return _built[key]


def _shared(spark: SparkSession, path: str):
    ranks = load_ranks(path)  # as large as the vocabulary, some 50,000 tokens
    return spark.sparkContext.broadcast((hash((path, len(ranks))), ranks))


def _lists(coded: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *[len(x) // 4 for x in coded]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def encode(df: DataFrame, path: str = RANKS, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col, an array of token ids, in text_col's place.

    Null and empty texts have no ids. Texts are encoded whole; a word without a break, however long, takes memory in
    proportion to it. Special tokens' strings are ordinary text. Repeated rows stay; other columns pass through; one that
    is called like ids_col is replaced.
    """
    model = _shared(df.sparkSession, path)
    keep = [c for c in df.columns if c not in (text_col, ids_col)]
    (own,) = free(keep, "text")
    src = df.select(*keep, F.col(text_col).alias(own))
    schema = src.select(*keep).withColumn(ids_col, F.array().cast("array<int>")).schema

    def run(batches):
        p = _ready(model)
        for batch in sliced(batches):
            ids = _lists([p.encode(t or "") for t in batch.column(own).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], ids], names=[*keep, ids_col])

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, path: str = RANKS, ids_col: str = "ids", data_col: str = "data") -> DataFrame:
    """df with the bytes of ids_col in its place, as binary: any list of ids has bytes, but not each is UTF-8.

    Null ids are no bytes; an id that the ranks don't have, or a null among them, fails. A column called like data_col is
    replaced.
    """
    model = _shared(df.sparkSession, path)
    keep = [c for c in df.columns if c not in (ids_col, data_col)]
    (own,) = free(keep, "ids")
    src = df.select(*keep, F.transform(ids_col, lambda x: F.coalesce(x, F.lit(-1))).alias(own))
    schema = src.select(*keep).withColumn(data_col, F.lit(b"")).schema

    def run(batches):
        p = _ready(model)
        for batch in sliced(batches):
            ids = batch.column(own).cast(pa.large_list(pa.int32())).fill_null([])
            offsets = ids.offsets.to_numpy()
            data = p.decode(ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], data], names=[*keep, data_col])

    return src.mapInArrow(run, schema)


def replace(df: DataFrame, start, stop, new, path: str = RANKS, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col brought up to date for an edit of text_col: characters start to stop (from 0, columns or names;
    beyond the text: its end) give way to new. text_col has the edited text. Encodes only the words around the edit.

    Null texts, ids and new are empty; a null start or stop is the text's end, and a stop before its start is its start.
    """
    model = _shared(df.sparkSession, path)
    keep = [c for c in df.columns if c not in (text_col, ids_col)]
    text, ids, a, b, z = free(keep, "text", "ids", "start", "stop", "new")
    as_col = lambda x: F.col(x) if isinstance(x, str) else x
    src = df.select(*keep, F.col(text_col).alias(text), F.col(ids_col).alias(ids), as_col(start).cast("long").alias(a), as_col(stop).cast("long").alias(b), as_col(new).alias(z))
    schema = src.select(*keep).withColumn(text_col, F.lit("")).withColumn(ids_col, F.array().cast("array<int>")).schema

    def run(batches):
        p = _ready(model)
        for batch in sliced(batches):
            texts, coded = [], []
            for t, old, i, j, x in zip(*[batch.column(c).to_pylist() for c in (text, ids, a, b, z)]):
                t, x = t or "", x or ""
                i = len(t) if i is None else min(max(i, 0), len(t))
                j = max(i, len(t) if j is None else min(j, len(t)))
                texts.append(t[:i] + x + t[j:])
                coded.append(np.array(p.reencode(t, old or [], i, j, x), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), _lists(coded)], names=[*keep, text_col, ids_col])

    return src.mapInArrow(run, schema)


def append(df: DataFrame, tail, path: str = RANKS, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """replace() at the text's end: text_col and ids_col go on with tail, a column or its name."""
    return replace(df, F.lit(None), F.lit(None), tail, path, text_col, ids_col)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, with digests of its ids and of the decoded bytes."""
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    coded = coded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(listed, 256)})
    return decode(coded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("data", 256).alias("decoded_sha256"))
