"""Language identification by prediction by partial matching.

For every language a tree of byte contexts of orders 0 to 3 holds how often each byte followed. A text's code length
under a language is the sum over its bytes: the longest known context predicts, or escapes to the next shorter one with
the probability of an escape (method C, seen symbols excluded), down to a uniform guess. The counts are frozen after
training, so code lengths are tables, kept as whole numbers of 2^-16 bits: sums are exact, whatever the batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_batches, free, sliced, staged, table

ORDER = 3
UNIT = 1 << 16
CHUNK = 1 << 20
#: Bounds of a part of the model, which is broadcast: leaves of its languages, and cells (those leaves x languages).
LEAVES, CELLS = 1 << 20, 1 << 24
#: Contexts of order 2 are dealt by this odd number into the parts of a language that is too large for one.
SPREAD = 40503


def grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in its text, as one number; before a text stand zeros."""
    g = data.astype(np.uint32)
    out = g.copy()
    for k in (1, 2, 3):
        out[k:] |= g[:-k] << np.uint32(8 * k)
    for k, keep in ((0, 0xFF), (1, 0xFFFF), (2, 0xFFFFFF)):
        at = starts + k  # where a text is shorter, this falls into the next one, whose own masks keep less
        out[at[at < len(out)]] &= np.uint32(keep)
    return out


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _count(batches):
    """Partial counts of grams by language: rows (lang, gram, n)."""
    names: dict[str, int] = {}
    keys, counts, held = [], [], 0

    def flush():
        k, c = _merged(keys, counts)
        langs = np.array(list(names), object)[k >> np.uint64(32)] if len(k) else []
        for i in range(0, len(k), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(langs[part], pa.string()), pa.array((k[part] & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(c[part].astype(np.int64))], names=["lang", "gram", "n"])

    for batch in batches:
        offsets, data = text_buffer(batch.column("text"))
        enc = batch.column("lang").dictionary_encode()
        ids = np.array([names.setdefault(x, len(names)) for x in enc.dictionary.to_pylist()], np.uint64)[enc.indices.to_numpy(zero_copy_only=False)]
        lengths = np.diff(offsets)
        g = grams(data, offsets[:-1]).astype(np.uint64) | (np.repeat(ids, lengths) << np.uint64(32))
        g.sort()
        if len(g):
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            keys.append(g[first])
            counts.append(np.diff(np.append(first, len(g))).astype(np.int64))
            held += len(first)
        if held > 2_000_000:
            k, c = _merged(keys, counts)
            keys, counts, held = [k], [c], len(k)
            if held > 1_000_000:
                yield from flush()
                keys, counts, held = [], [], 0
    if keys:
        yield from flush()


class Tree:
    """Context trees of some languages, with code lengths.

    counts: {lang: (grams of 4 bytes, sorted; how often each)}. Inner nodes are sums of the leaves. With place (b, n) the
    leaves are those of the b-th of n parts of the contexts of order 2, and scores count the bytes in such contexts only;
    lower has the (grams of 2 bytes, counts) of each language, from which orders 0 and 1 are summed.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], place: tuple[int, int] = (0, 1), lower: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        self.place = place
        self.langs = sorted(counts, key=lambda x: x.encode())
        self.levels = []
        for lang in self.langs:
            leaves, n = counts[lang]
            per = []
            for order in range(ORDER + 1):
                size = 8 * (order + 1)
                nodes, times = lower[lang] if lower and order < 2 else (leaves, n)
                grams_, sums = _merged([nodes.astype(np.uint64) & np.uint64((1 << size) - 1)], [times.astype(np.int64)])
                contexts, first = np.unique(grams_ >> np.uint64(8), return_index=True)
                total = np.add.reduceat(sums, first) if len(first) else sums
                kinds = np.diff(np.append(first, len(grams_)))
                per.append([grams_, sums, contexts, total, kinds])
            # what an escape excludes one order below: the shorter context's counts of the bytes seen here
            for order in range(1, ORDER + 1):
                grams_, _, contexts, _, kinds = per[order]
                shorter, below = per[order - 1][:2]
                there = below[np.searchsorted(shorter, grams_ & np.uint64((1 << (8 * order)) - 1))]
                per[order].append(np.add.reduceat(there, np.cumsum(kinds) - kinds) if len(kinds) else kinds)
            self.levels.append(per)
        union = np.unique(np.concatenate([counts[x][0] for x in self.langs]).astype(np.uint32)) if self.langs else np.zeros(0, np.uint32)
        self.table = self.code_lengths(union).astype(np.int32)
        bits = max(4, int(4 * len(union) + 1).bit_length())
        self.shift = np.uint32(32 - bits)
        self.mask = np.uint32((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint32)
        self.rows = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(union))
        slot = self._slot(union)
        while len(left):
            free = self.rows[slot] < 0
            where, one = np.unique(slot[free], return_index=True)
            won = left[free][one]
            self.keys[where], self.rows[where] = union[won], won
            lost = np.ones(len(left), bool)
            lost[np.flatnonzero(free)[one]] = False
            left, slot = left[lost], (slot[lost] + np.uint32(1)) & self.mask

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint32(2654435769)) >> self.shift

    def code_lengths(self, g: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte in each language, in 2^-16 bits: grams x languages."""
        g = g.astype(np.uint64)
        out = np.zeros((len(g), len(self.langs)))
        find = lambda a, x: (lambda i: (i, a[i] == x))(np.minimum(np.searchsorted(a, x), max(0, len(a) - 1))) if len(a) else (np.zeros(len(x), np.int64), np.zeros(len(x), bool))
        for col, per in enumerate(self.levels):
            open_ = np.ones(len(g), bool)
            minus_t, minus_k = np.zeros(len(g)), np.zeros(len(g))
            for order in range(ORDER, -1, -1):
                grams_, sums, contexts, total, kinds = per[order][:5]
                if not len(contexts):
                    continue
                here = g & np.uint64((1 << (8 * (order + 1))) - 1)
                i, known = find(contexts, here >> np.uint64(8))
                known &= open_
                j, seen = find(grams_, here)
                seen &= known
                t, k = total[i] - minus_t, kinds[i] - minus_k
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[seen, col] -= np.log2(sums[j[seen]] / (t + k)[seen])
                    esc = known & ~seen
                    cost = np.where(k > 0, -np.log2(k / (t + k)), 0.0)  # with nothing left to see an escape is certain
                out[esc, col] += cost[esc]
                open_ &= ~seen
                minus_t[esc] = per[order][5][i[esc]] if order else 0
                minus_k[esc] = kinds[i[esc]]
            left = 256 - minus_k[open_]
            out[open_, col] += np.log2(np.maximum(1, left))
        return np.rint(out * UNIT).astype(np.int64)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every text under every language, exact: texts x languages."""
        sums = np.zeros((len(offsets) - 1, len(self.langs)), np.int64)
        for a in range(0, len(data), CHUNK):
            b, lead = min(a + CHUNK, len(data)), min(a, ORDER)
            lo, hi = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b, side="left")
            starts = offsets[np.searchsorted(offsets, a - lead) : hi] - (a - lead)
            g = grams(data[a - lead : b], starts)[lead:]
            row = self._lookup(g)
            cost = self.table[row]
            own = self._own(g)
            cost[~own] = 0
            out = np.flatnonzero((row < 0) & own)
            if len(out):
                kinds, which = np.unique(g[out], return_inverse=True)
                cost[out] = self.code_lengths(kinds)[which]
            # one entry per text that has bytes here: an empty text has the offset of the next
            own = np.arange(lo, hi)
            own = own[(offsets[own + 1] > a) & (offsets[own + 1] > offsets[own])]
            sums[own] += np.add.reduceat(cost, np.maximum(offsets[own], a) - a, axis=0, dtype=np.int64)
        return sums

    def _own(self, g: np.ndarray) -> np.ndarray:
        b, n = self.place
        return (((g >> np.uint32(8) & np.uint32(0xFFFF)) * np.uint32(SPREAD) & np.uint32(0xFFFF)).astype(np.int64) * n >> 16) == b

    def _lookup(self, g: np.ndarray) -> np.ndarray:
        slot = self._slot(g)
        row = self.rows[slot]
        todo = np.flatnonzero((row >= 0) & (self.keys[slot] != g))
        slot = slot[todo]
        while len(todo):
            slot = (slot + np.uint32(1)) & self.mask
            r = self.rows[slot]
            row[todo] = np.where((r >= 0) & (self.keys[slot] == g[todo]), r, -1)
            more = (r >= 0) & (self.keys[slot] != g[todo])
            todo, slot = todo[more], slot[more]
        return row


class Forest:
    """A model in parts, each a broadcast Tree: of a group of languages, or of one language and some of its contexts."""

    def __init__(self, langs: list[str], parts: list):
        self.langs, self.parts = langs, parts


def _arrays(top: pa.Table, langs: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of rows (lang, gram, n): the grams of each language, sorted, and their counts."""
    place = {x: k for k, x in enumerate(langs)}
    enc = top.column("lang").combine_chunks().dictionary_encode()
    enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
    at = np.array([place[x] for x in enc.dictionary.to_pylist()], np.int64)[enc.indices.to_numpy(zero_copy_only=False)] if top.num_rows else np.zeros(0, np.int64)
    gram, n = top.column("gram").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((gram, at))
    ends = np.searchsorted(at[order], np.arange(len(langs) + 1))
    return {x: (gram[order[ends[k] : ends[k + 1]]].astype(np.uint32), n[order[ends[k] : ends[k + 1]]]) for k, x in enumerate(langs)}


def _groups(leaves: dict[str, int]) -> list[tuple[list[str], int]]:
    """Languages by parts of the model: (languages, 1), or (one language, into how many parts its contexts are dealt)."""
    out, group = [], []
    for x in sorted(leaves, key=lambda x: x.encode()):
        if leaves[x] > LEAVES:
            out.append(([x], -(-2 * leaves[x] // LEAVES)))  # half full on average, as contexts differ in size
            continue
        held = sum(leaves[y] for y in group) + leaves[x]
        if group and (held > LEAVES or held * (len(group) + 1) > CELLS):
            out.append((group, 1))
            group = []
        group.append(x)
    return [*out, (group, 1)] if group or not out else out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Tree | Forest:
    """Trees from all rows of labelled whose language isn't null.

    Counts are made in tasks and summed in a shuffle, and all of them are kept. Where they pass LEAVES or CELLS, the model
    is made and broadcast in parts of at most about that size, one after the other.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    with arrow_batches(spark):
        counts = staged(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    groups = _groups({r.lang: r.k for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).collect()})
    if len(groups) == 1 and groups[0][1] == 1:
        return Tree(_arrays(counts.toArrow(), groups[0][0]))
    context = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)) * F.lit(SPREAD)
    parts = []
    for langs, n in groups:
        own, lower = counts.where(F.col("lang").isin(langs)), None
        if n > 1:
            pairs = own.groupBy("lang", F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("n").alias("n"))  # 65,536 rows at most
            lower = _arrays(pairs.toArrow(), langs)
        for b in range(n):
            part = own.where(F.shiftright(context.bitwiseAND(F.lit(0xFFFF)) * F.lit(n), 16) == b) if n > 1 else own
            parts.append((langs, spark.sparkContext.broadcast(Tree(_arrays(part.toArrow(), langs), (b, n), lower))))
    return Forest(sorted({x for langs, _ in groups for x in langs}, key=lambda x: x.encode()), parts)


def _decide(langs: list[str], length: np.ndarray, letters: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Language and score of each text from its code lengths (texts x languages)."""
    best, share = np.full(len(letters), len(langs)), np.zeros(len(letters))
    if langs and letters.any():
        first = length.argmin(1)
        odds = np.exp2(np.maximum(-1000.0, (length[np.arange(len(first)), first][:, None] - length) / UNIT)).sum(1)
        best, share = np.where(letters, first, best), np.where(letters, 1 / odds, 0.0)
    return pa.array(np.array([*langs, "und"], object)[best], pa.string()), pa.array(share)


def _lengths(docs: DataFrame, forest: Forest) -> DataFrame:
    """_key and _parts: (part, code lengths of its languages) of each text of docs(_key, _text), once however often it stands there."""
    out = None
    for k, (_, shared) in enumerate(forest.parts):

        def run(batches, k=k, shared=shared):
            t = shared.value
            for batch in sliced(batches):
                offsets, data = text_buffer(batch.column("_text"))
                length = t.score(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array([k] * len(length), pa.int32()), pa.array(length.tolist(), pa.list_(pa.int64()))], names=["_key", "part", "bits"])

        one = docs.mapInArrow(run, "_key string, part int, bits array<long>")
        out = one if out is None else out.union(one)
    return out.groupBy("_key").agg(F.collect_set(F.struct("part", "bits")).alias("_parts"))


def predict(docs: DataFrame, tree: Tree | Forest, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """id_cols with lang_pred and score for every row of docs.

    The language with the shortest code wins, ties by code point; the score is its share of the probability, in 0 to 1.
    Texts that are null or have no letter (Unicode L) are `und` with score 0, as are all texts of a tree without
    languages. Texts are read whole, however long. Repeated rows are predicted each. With a model in parts texts are read
    once a part and only code lengths are shuffled, by a digest of the text.
    """
    text_, letters_, key_, parts_ = free(list(id_cols), "text", "letters", "key", "parts")
    cols = docs.select(*id_cols, F.col(text_col).alias(text_), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(letters_))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.select(*id_cols).schema)
    langs = tree.langs
    if isinstance(tree, Forest):
        keyed = cols.withColumn(key_, F.when(F.col(letters_), F.sha2(F.col(text_), 256)))
        lengths = _lengths(keyed.where(F.col(letters_)).select(F.col(key_).alias("_key"), F.col(text_).alias("_text")), tree).toDF(key_, parts_)
        cols = keyed.drop(text_).join(lengths, key_, "left").select(*id_cols, letters_, parts_)
        places = [np.array([langs.index(x) for x in own]) for own, _ in tree.parts]

        def length_of(batch):
            out = np.zeros((batch.num_rows, len(langs)), np.int64)
            for row, found in zip(out, batch.column(parts_).to_pylist()):
                for x in found or ():
                    row[places[x["part"]]] += np.array(x["bits"], np.int64)
            return out
    else:
        shared = docs.sparkSession.sparkContext.broadcast(tree)

        def length_of(batch):
            offsets, data = text_buffer(batch.column(text_))
            return shared.value.score(data, offsets)

    def run(batches):
        for batch in sliced(batches):
            letters = batch.column(letters_).to_numpy(zero_copy_only=False).astype(bool)
            length = length_of(batch) if langs and letters.any() else np.zeros((len(letters), len(langs)), np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in id_cols], *_decide(langs, length, letters)], names=[*id_cols, "lang_pred", "score"])

    return cols.mapInArrow(run, f"{fields}, lang_pred string, score double")


def op1_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id's crc32 leaves 2 by 4 are held out; a document without an id isn't."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    tree = train(docs.where(~held_out))
    out = predict(docs.select("doc_id", "text", held_out.alias("held_out")), tree, ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")
