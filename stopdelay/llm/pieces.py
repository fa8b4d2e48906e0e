"""SentencePiece encoding and decoding over a given model file.

An Aho-Corasick automaton over the pieces reads a text once; at each position the output links lead to all pieces that
end there, and each relaxes the best score of the position. The best path's pieces are the encoding; characters that no
piece covers become byte pieces, so that decoding gives every text back.

The score of a path is the sum of its pieces' scores as the model file states them. Files of the BPE kind state ranks,
so the result is the path of the best ranks, which need not be the one that merging would give.
"""

from __future__ import annotations

import re
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free, sliced, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Encodings of words that a worker remembers, twice so many at most, of at most so many characters.
REMEMBERED, WORD_CHARS = 1 << 17, 48


def load_model(path: str = MODEL) -> dict:
    """Pieces, scores and kinds of a model file, read on the driver."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the model normalises texts, which would not come back")
    return {"pieces": [p.piece for p in m.pieces], "scores": [p.score for p in m.pieces], "kinds": [p.type for p in m.pieces], "prefix": n.add_dummy_prefix}


class Pieces(dict):
    """Encoder and decoder; as a dict it remembers words: their pieces' ids as little-endian 32-bit numbers."""

    def __init__(self, model: dict):
        super().__init__()
        pieces, scores, kinds = model["pieces"], model["scores"], model["kinds"]
        self.prefix, self.older = model["prefix"], {}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 6}
        self.unknown = next((i for i, k in enumerate(kinds) if k == 2), 0)
        normal = [(p, s, i) for i, (p, s, k) in enumerate(zip(pieces, scores, kinds)) if k in (1, 4)]
        self.unknown_score = min((s for _, s, _ in normal), default=0.0) - 10
        # the automaton: state 0 is the root
        go: list[dict[str, int]] = [{}]
        ends: list[tuple[int, float, int] | None] = [None]
        for p, s, i in normal:
            at = 0
            for ch in p:
                nxt = go[at].get(ch)
                if nxt is None:
                    nxt = go[at][ch] = len(go)
                    go.append({})
                    ends.append(None)
                at = nxt
            if ends[at] is None:
                ends[at] = (len(p), s, i)
        fail, link = [0] * len(go), [0] * len(go)
        queue = list(go[0].values())
        for at in queue:
            for ch, nxt in go[at].items():
                f = fail[at]
                while f and ch not in go[f]:
                    f = fail[f]
                fail[nxt] = go[f].get(ch, 0)
                queue.append(nxt)
            # nearest shorter suffix that is a piece; its own links are there, as it is less deep
            link[at] = fail[at] if ends[fail[at]] is not None else link[fail[at]]
        # the pieces that end in a state, longest first: the state's own and those along its output links
        outs: list[tuple] = [()] * len(go)
        for at in queue:
            outs[at] = ((ends[at],) if ends[at] is not None else ()) + outs[link[at]]
        self.go, self.fail, self.outs = go, fail, outs
        self.covered = [bool(x) and x[-1][0] == 1 for x in outs]
        # a text may be cut before a mark that follows another character, and around line ends, if no piece goes over
        longer = [p for p, _, _ in normal if len(p) > 1]
        whole = any(MARK in p.lstrip(MARK) for p in longer)
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in longer))
        self.words = re.compile(".+" if whole else f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        pieces_bytes = [bytes([int(p[1:-1], 16)]) if k == 6 else b"" if k == 3 else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds)]

        self.flat = np.frombuffer(b"".join(pieces_bytes), np.uint8)
        self.sizes = np.array([len(x) for x in pieces_bytes], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def best_path(self, word: str) -> list[int]:
        """Ids of the best path, in one pass; ties go to the longer last piece."""
        go, fail, outs, covered, unknown = self.go, self.fail, self.outs, self.covered, self.unknown_score
        best, back, state, i = [0.0], [(0, 0.0, 0)], 0, 0
        for ch in word:
            i += 1
            nxt = go[state].get(ch)
            while nxt is None and state:
                state = fail[state]
                nxt = go[state].get(ch)
            state = nxt or 0
            top, last = float("-inf"), None
            for one in outs[state]:
                score = best[i - one[0]] + one[1]
                if score > top:
                    top, last = score, one
            if not covered[state] and best[i - 1] + unknown > top:
                top, last = best[i - 1] + unknown, (1, unknown, -1)
            best.append(top)
            back.append(last)
        ids: list[int] = []
        while i:
            size, _, one = back[i]
            if one >= 0:
                ids.append(one)
            else:
                ids.extend(reversed(self.byte_pieces(word[i - 1])))
            i -= size
        ids.reverse()
        return ids

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def byte_pieces(self, ch: str) -> list[int]:
        return [self.byte_ids[b] for b in ch.encode()] if self.byte_ids else [self.unknown]

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            path = self.best_path(word)
            ids = pack(f"<{len(path)}i", *path)
        if len(word) <= WORD_CHARS:
            if len(self) >= REMEMBERED:  # words of the last two rounds are known
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers. A mark in the text itself is written in byte pieces, as it isn't a space."""
        if not text:
            return b""
        text = (" " if self.prefix else "") + text
        if MARK in text:
            mark = np.array(self.byte_pieces(MARK), "<i4").tobytes()
            return mark.join(b"".join(map(self.__getitem__, self.words.findall(part.replace(" ", MARK)))) for part in text.split(MARK))
        return b"".join(map(self.__getitem__, self.words.findall(text.replace(" ", MARK))))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of lists of ids, offsets[i] to offsets[i + 1] in one array, put together as one buffer of bytes."""
        sizes = self.sizes[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = self.flat[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = ends[offsets]
        if self.prefix:  # the space that stands before a text goes again
            lead = bounds[:-1][bounds[1:] > bounds[:-1]]
            lead = lead[out[lead] == 32]
            keep = np.ones(len(out), bool)
            keep[lead] = False
            bounds, out = bounds - np.searchsorted(lead, bounds), out[keep]
        whole = out.tobytes()
        begins = bounds[:-1][bounds[:-1] < len(out)]
        try:
            whole.decode()
            if not ((out[begins] & 0xC0) == 0x80).any():
                return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(whole)).cast(pa.string())
        except UnicodeDecodeError:
            pass
        return pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string())


_built: dict[int, Pieces] = {}


def _ready(model) -> Pieces:
    """The encoder of a broadcast model, built once in a worker."""
    if model.value["key"] not in _built:
        _built.clear()
        _built[model.value["key"]] = Pieces(model.value)
    return _built[model.value["key"]]


def _shared(spark: SparkSession, path: str):
    model = load_model(path)
    return spark.sparkContext.broadcast(model | {"key": hash((path, len(model["pieces"]), model["pieces"][-1]))})


def encode(df: DataFrame, path: str = MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col, an array of piece ids, in text_col's place.

    Null and empty texts have no ids. Texts are encoded whole, and a very long word in memory in proportion to it.
    Other columns pass through; one that is called like ids_col is replaced.
    """
    model = _shared(df.sparkSession, path)
    keep = [c for c in df.columns if c not in (text_col, ids_col)]
    (own,) = free(keep, "text")
    src = df.select(*keep, F.col(text_col).alias(own))
    schema = src.select(*keep).withColumn(ids_col, F.array().cast("array<int>")).schema

    def run(batches):
        p = _ready(model)
        for batch in sliced(batches):
            coded = [p.encode(t or "") for t in batch.column(own).to_pylist()]
            offsets = np.cumsum([0, *[len(x) // 4 for x in coded]]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], ids], names=[*keep, ids_col])
        p.forget()  # the worker lives on

    return src.mapInArrow(run, schema)


def decode(df: DataFrame, path: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with the text of ids_col in its place; null ids are the empty text. A column called like text_col is replaced."""
    model = _shared(df.sparkSession, path)
    keep = [c for c in df.columns if c not in (text_col, ids_col)]
    (own,) = free(keep, "ids")
    src = df.select(*keep, F.col(ids_col).alias(own))
    schema = src.select(*keep).withColumn(text_col, F.lit("")).schema

    def run(batches):
        p = _ready(model)
        for batch in sliced(batches):
            ids = batch.column(own).cast(pa.large_list(pa.int32())).fill_null([])
            offsets = ids.offsets.to_numpy()
            texts = p.decode(ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], texts], names=[*keep, text_col])

    return src.mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: its pieces' number and hash, and the decoded text's digest beside the text's own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text")
    coded = encode(docs).withColumns({"n_ids": F.size("ids").cast("long"), "ids_xxhash64": F.xxhash64("ids")})
    out = decode(coded).withColumn("decoded_sha256", F.sha2("text", 256))
    return out.select("doc_id", "n_ids", "ids_xxhash64", "decoded_sha256", (F.coalesce("text_sha256", F.sha2(F.lit(""), 256)) == F.col("decoded_sha256")).alias("round_trip"))
