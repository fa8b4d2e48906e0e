"""N-gram Jaccard join with filtering under several global token orders.

A document is its set of word n-grams, as 64-bit hashes. Two sets that reach the threshold share a token among the first
few of each under any total order of all tokens; three orders are used:

    A  rarest first, by a sketch of document frequencies that is summed over all documents (ties by hash)
    B  ascending hash
    C  descending hash

Order A makes the candidates: its prefixes are postings, and documents meet in a token's postings if sizes and places in
the prefix allow the overlap. Candidate pairs then meet their prefixes under B and under C: they must share a token in
both, and what the two prefixes leave open must still allow the overlap. Only pairs that pass all three orders get their
whole sets and are verified, exactly.

Copies don't make pairs: equal sets, by 128-bit hashes, are one node. In every posting list the node with the commonest
tokens is verified against the others first; nodes it links with are one label, and what is left to compare are nodes of
different labels. So a group of near copies costs about one pair a member, and yet no link between two different sets
can be lost, as far as it would join two components. A pass over whole texts makes the sets of those nodes only that a
candidate pair has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_batches, discard, shuffles_dropped, staged, table

#: Cells of the frequency sketch: as many as there are documents, within these bounds. The sketch orders the work and
#: never decides a result.
LEAST_CELLS, MOST_CELLS, SLICES = 1 << 20, 1 << 24, 16
#: Ids that a filter of 32 bits an id is made for, 32 MB at most; more ids are joined instead.
FILTER_IDS = 1 << 23
#: Pairs of one node that meet in one place; a node with more of them is dealt out.
NODE_PAIRS, HOT_NODES = 1_000, 100_000
PIECE_BYTES = 1 << 18
#: So many ids of documents to leave out, some MB, go to all tasks; with more, texts are shuffled to them.
BROADCAST_IDS = 500_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE, _SHINGLE = np.uint64(0x9E3779B97F4A7C15), _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _powers[i] = np.multiply.accumulate(full)
    return _powers


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of every text in a flat buffer: (offsets, hashes).

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer than k words are one shingle, none is none.
    """
    bounds, tokens, at = [np.zeros(1, np.int64)], [], 0
    while at < len(offsets) - 1:  # some texts at a time, so that the memory follows the longest one
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1)
        b, t = _piece(offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]], k)
        bounds.append(b[1:] + bounds[-1][-1])
        tokens.append(t)
        at = to
    return np.concatenate(bounds), np.concatenate([np.zeros(0, np.uint64), *tokens])


def _piece(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(n_docs + 1, np.int64), np.zeros(0, np.uint64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]])))
    last = np.flatnonzero(solid & (edge[1:] | np.concatenate([~solid[1:], [True]])))
    up, down = _power(len(data))
    running = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[_LOWER[data]] * up[: len(data)], dtype=np.uint64)])
    word = _mix((running[last + 1] - running[first]) * down[first] + (last - first).astype(np.uint64))
    at = np.searchsorted(first, offsets)  # each text's words in `word`
    m = np.diff(at)
    count = np.where(m >= k, m - k + 1, (m > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(at[:-1], count) + np.arange(bounds[-1]) - np.repeat(bounds[:-1], count)
    size = np.repeat(np.minimum(m, k), count)
    total = size.astype(np.uint64) * _SHINGLE[-1]
    word = np.append(word, np.zeros(k, np.uint64))
    for j in range(k):
        part = word[start + j] * _SHINGLE[j]
        total = total + np.where(size > j, part, np.uint64(0))
    token = _mix(total)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            token[a:b].sort()
    keep = np.ones(len(token), bool)
    keep[1:] = token[1:] != token[:-1]
    keep[bounds[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return kept[bounds], token[keep]


def _texts(batch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("text").cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _hashes(bounds: np.ndarray, token: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit numbers for each set, equal for equal sets; 0 for the empty set."""
    n, full, out = np.diff(bounds), np.flatnonzero(np.diff(bounds)), []
    for salt in (_SHINGLE[-2], _SHINGLE[-3]):
        h = np.zeros(len(n), np.uint64)
        if len(full):
            h[full] = _mix(np.add.reduceat(_mix(token ^ salt), bounds[full]) + n[full].astype(np.uint64))
        out.append(pa.array(h.view(np.int64)))
    return out[0], out[1]


def _cells(token: np.ndarray, cells: int) -> np.ndarray:
    return (token & np.uint64(cells - 1)).astype(np.int64)


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first tokens of a set must hold a shared one, whatever the order."""
    return n - (percent * n + 99) // 100 + 1


def _binaries(bounds: np.ndarray, numbers: np.ndarray) -> pa.Array:
    """Lists of 64-bit numbers as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((8 * bounds).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(numbers))])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lists of a binary column: bounds and numbers."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    numbers = np.frombuffer(raw, np.uint64, int(at[-1] - at[0]) // 8, int(at[0])) if raw is not None else np.zeros(0, np.uint64)
    return (at - at[0]) // 8, numbers


def _packed(counts: np.ndarray) -> bytes:
    """A slice's counts in the smallest whole numbers that hold them; the first byte tells their width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(counts.max()) < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _measure(k: int, cells: int):
    def run(batches):
        sketch, one = np.zeros(cells, np.int32), np.int32(1)
        names = ["doc_id", "n", "h1", "h2", "slice", "cells"]
        for batch in batches:
            bounds, token = shingle_sets(*_texts(batch), k)
            np.add.at(sketch, _cells(token, cells), one)
            m = len(bounds) - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), *_hashes(bounds, token), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        if sketch.any():
            none = pa.nulls(1, pa.int64())
            for i, part in enumerate(sketch.reshape(SLICES, -1)):
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([i], pa.int32()), pa.array([_packed(part)], pa.binary())], names=names)

    return run


def _added(finish):
    """Sums of a partition's slices, one array a slice however many rows come."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column("cells")
            for j, i in enumerate(batch.column("slice").to_pylist()):
                blob = cells[j].as_buffer()
                part = np.frombuffer(blob, f"<u{blob[0]}", offset=1)
                if i in total:
                    total[i] += part.astype(np.int64)
                else:
                    total[i] = part.astype(np.int64)
        for i, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([finish(counts)], pa.binary())], names=["slice", "cells"])

    return run


def _levels(counts: np.ndarray) -> bytes:
    return np.minimum(255, np.round(8 * np.log2(1 + counts))).astype(np.uint8).tobytes()


def _frequency_levels(measured: DataFrame, cells: int) -> np.ndarray:
    """The sketch as logarithmic levels, a byte a cell. Tasks' counts are summed in two steps, the first one salted."""
    kind = "slice int, cells binary"
    parts = measured.where(F.col("slice").isNotNull()).select("slice", "cells", F.pmod(F.monotonically_increasing_id(), F.lit(16)).alias("salt"))
    sums = parts.repartition("slice", "salt").select("slice", "cells").mapInArrow(_added(_packed), kind)
    out = np.zeros((SLICES, cells // SLICES), np.uint8)
    for r in sums.repartition("slice").mapInArrow(_added(_levels), kind).collect():  # cells bytes in all
        out[r["slice"]] = np.frombuffer(r["cells"], np.uint8)
    return out.ravel()


def _filter(ids: DataFrame, bit, n: int) -> np.ndarray:
    """A bitmap of 32 bits for each of n ids and 2^28 at most; bit(bits) is the column of an id's place."""
    bits = 1 << max(16, min(28, (32 * n).bit_length()))
    at = bit(bits) + 1
    rows = ids.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows:
        out[r["b"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def _held(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _wanted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Texts of docs with a place `bit` in a bitmap that has all of ids(rep) and few others, or of those in ids alone
    where they are too many for a bitmap."""
    n = ids.count()
    if n > FILTER_IDS:
        own = docs.join(ids.select("rep").distinct(), docs["doc_id"].eqNullSafe(F.col("rep")), "left_semi")
        return own.select("text", F.lit(0).cast("long").alias("bit")), np.full(1, 255, np.uint8)
    place = lambda c: lambda bits: F.pmod(F.xxhash64(c), F.lit(bits))
    bitmap = _filter(ids, place("rep"), n)
    return docs.select("text", place("doc_id")(8 * len(bitmap)).alias("bit")), bitmap


def _chosen(batch, bitmap: np.ndarray):
    return batch.filter(pa.array(_held(bitmap, batch.column("bit").to_numpy())))


def _postings(k: int, percent: int, shared):
    """Of every set its hashes, size, mean level of its tokens, and prefix under A. A set that is too small to link with
    any other has none."""

    def run(batches):
        levels, bitmap = shared.value
        for batch in batches:
            bounds, token = shingle_sets(*_texts(_chosen(batch, bitmap)), k)
            n = np.diff(bounds)
            level = levels[_cells(token, len(levels))]
            rank = (level.astype(np.uint64) << np.uint64(56)) | (token >> np.uint64(8))
            p = np.where(100 * n >= percent * (n + 1), _prefix(n, percent), 0)
            picks = [a + np.argsort(rank[a:b], kind="stable")[:q] for a, b, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), p.tolist()) if q]
            sums = np.concatenate([[0], np.cumsum(level, dtype=np.int64)])
            common = 16 * (sums[bounds[1:]] - sums[bounds[:-1]]) // np.maximum(1, n)
            prefix = _binaries(np.concatenate([[0], np.cumsum(p)]), token[np.concatenate(picks)] if picks else token[:0])
            ints = lambda x: pa.array(x.astype(np.int32))
            out = pa.RecordBatch.from_arrays([*_hashes(bounds, token), ints(n), ints(common), ints(p), prefix], names=["h1", "h2", "n", "common", "p", "prefix"])
            yield out.filter(pa.array(p > 0))

    return run


def _sliced(slices: int):
    """Tokens in slices of their range, each once, or twice if this task has met it more than once."""

    def out(held):
        token, count = np.unique(np.concatenate(held), return_counts=True)
        token = np.repeat(token, np.minimum(count, 2))
        of = (token >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
        full, first = np.unique(of, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), _binaries(np.append(first, len(token)), token)], names=["slice", "tokens"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(_numbers(batch.column("prefix"))[1])
            size += len(held[-1])
            if size > 500_000:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    return run


def _met_twice(batches):
    """The tokens that came more than once, slice by slice, as the rows are in their order."""
    now, held = None, []

    def out():
        token, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token[count > 1].view(np.int64))], names=["token"])

    for batch in batches:
        bounds, token = _numbers(batch.column("tokens"))
        for j, i in enumerate(batch.column("slice").to_pylist()):
            if i != now and held:
                yield out()
                held = []
            now = i
            held.append(token[bounds[j] : bounds[j + 1]])
    if held:
        yield out()


def _thinned(shared):
    """Prefixes as lists of the tokens that stand in the filter, with their places."""

    def run(batches):
        bitmap = shared.value
        for batch in batches:
            bounds, token = _numbers(batch.column("prefix"))
            keep = _held(bitmap, _cells(token, 8 * len(bitmap)))
            kept = np.concatenate([[0], np.cumsum(keep)])[bounds].astype(np.int32)
            place = (np.arange(len(token)) - np.repeat(bounds[:-1], np.diff(bounds)))[keep].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(kept), pa.array(x)) for x in (token[keep].view(np.int64), place)]
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("h1", "h2", "n", "common")], *lists], names=["h1", "h2", "n", "common", "tokens", "places"])
            yield out.filter(pa.array(np.diff(kept) > 0))

    return run


def _shared_tokens(post: DataFrame, nodes: DataFrame) -> DataFrame:
    """Postings (token, node, n, pos, common) without most of the tokens that stand in one set only, written.

    Tokens are counted in packed slices of some 100,000, without what belongs to them. Those that came twice make a
    filter for the prefixes; what it lets through beside them falls out by the exact count that follows. A set comes
    once, however many rows passed the filter of its document.
    """
    spark = post.sparkSession
    slices = max(SLICES, (post.agg(F.sum("p")).first()[0] or 0) // 200_000)
    packed = post.select("prefix").mapInArrow(_sliced(slices), "slice long, tokens binary")
    twice = staged(packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(_met_twice, "token long"))
    bitmap = spark.sparkContext.broadcast(_filter(twice, lambda bits: F.col("token").bitwiseAND(F.lit(bits - 1).cast("long")), twice.count()))
    lists = post.mapInArrow(_thinned(bitmap), "h1 long, h2 long, n int, common int, tokens array<long>, places array<int>")
    sets = lists.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("n", "common", "tokens", "places")])
    rows = sets.join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("node", "n", "common", F.inline(F.arrays_zip("tokens", "places")))
    out = staged(rows.select(F.col("tokens").alias("token"), "node", "n", F.col("places").alias("pos"), "common"))
    bitmap.destroy()
    discard(twice)
    return out


def _sets(k: int, percent: int, shared):
    """Of every set its hashes, size, its prefixes under B and C, and the whole, each ascending."""

    def run(batches):
        for batch in batches:
            bounds, token = shingle_sets(*_texts(_chosen(batch, shared.value)), k)
            n = np.diff(bounds)
            p = np.where(n > 0, _prefix(n, percent), 0)
            ends = [token[x:y] for a, b, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), p.tolist()) for x, y in ((a, a + q), (b - q, b))]
            both = _binaries(np.concatenate([[0], np.cumsum(2 * p)]), np.concatenate([token[:0], *ends]))
            out = pa.RecordBatch.from_arrays([*_hashes(bounds, token), pa.array(n.astype(np.int32)), both, _binaries(bounds, token)], names=["h1", "h2", "n", "ends", "whole"])
            yield out.filter(pa.array(n > 0))

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def may_link(x: np.ndarray, y: np.ndarray, nx: int, ny: int, percent: int) -> bool:
    """Whether sets of sizes nx and ny may reach the threshold; x and y hold their prefixes under B and C, one after the
    other. They must share a token under either order, and with all that the prefixes leave open the overlap must do."""
    p, q = len(x) // 2, len(y) // 2
    (xb, xc), (yb, yc) = (x[:p], x[p:]), (y[:q], y[q:])
    low, high = _overlap(xb, yb), _overlap(xc, yc)
    if not low or not high:
        return False
    # tokens up to t and from u on are known of both sets
    t, u = min(xb[-1], yb[-1]), max(xc[0], yc[0])
    ix, iy = np.searchsorted(xb, t, "right"), np.searchsorted(yb, t, "right")
    jx, jy = p - np.searchsorted(xc, u), q - np.searchsorted(yc, u)
    if t < u:
        most = low + high + min(nx - ix - jx, ny - iy - jy)
    else:
        most = min(low + min(nx - ix, ny - iy), high + min(nx - jx, ny - jy))
    return bool((100 + percent) * most >= percent * (nx + ny))


def links(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two whole sets reach the threshold."""
    return (100 + percent) * _overlap(x, y) >= percent * (len(x) + len(y))


def _tested(test):
    """The pairs (a, b) whose sets x and y of sizes xn and yn pass a test."""

    def run(batches):
        for batch in batches:
            (xs, x), (ys, y) = _numbers(batch.column("x")), _numbers(batch.column("y"))
            sizes = zip(batch.column("xn").to_pylist(), batch.column("yn").to_pylist())
            yes = [test(x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]], *n) for i, n in enumerate(sizes)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return run


def _beside(pairs: DataFrame, sets: DataFrame, hot: DataFrame, column: str) -> DataFrame:
    """pairs with the sets of both ends. A node of many pairs comes in copies, and its pairs are dealt over them."""
    sets = sets.select(F.col("node"), F.col("n"), F.col(column))
    copies = sets.join(hot, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1)))
    for end, other, x in (("b", "a", "y"), ("a", "b", "x")):
        dealt = pairs.join(hot.withColumnRenamed("node", end), end, "left").withColumn("salt", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1).cast("long"))))
        own = copies.select(F.col("node").alias(end), "salt", F.col("n").alias(f"{x}n"), F.col(column).alias(x))
        pairs = dealt.drop("copies").join(own, [end, "salt"]).drop("salt")
    return pairs


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that reach the threshold, written."""
    spark = docs.sparkSession
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("many"))
    ends = staged(ends.join(nodes, "node"))
    hot = ends.where(F.col("many") > NODE_PAIRS).select("node", F.ceil(F.col("many") / NODE_PAIRS).alias("copies"))
    if hot.count() <= HOT_NODES:
        hot = F.broadcast(hot)
    texts, bitmap = _wanted(docs, ends)
    shared = spark.sparkContext.broadcast(bitmap)
    sets = texts.mapInArrow(_sets(k, percent, shared), "h1 long, h2 long, n int, ends binary, whole binary")
    sets = sets.groupBy("h1", "h2").agg(*[F.first(c).alias(c) for c in ("n", "ends", "whole")])
    sets = staged(sets.join(ends.select("h1", "h2", "node"), ["h1", "h2"]).drop("h1", "h2"))
    shared.destroy()
    some = staged(_beside(pairs, sets, hot, "ends").mapInArrow(_tested(lambda x, y, nx, ny: may_link(x, y, nx, ny, percent)), "a long, b long"))
    out = staged(_beside(some, sets, hot, "whole").mapInArrow(_tested(lambda x, y, nx, ny: links(x, y, percent)), "a long, b long"))
    discard(ends, sets, some)
    return out


def _components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node on an edge; the root is the component's least node. A large-star and a small-star step
    by turns until nothing changes, with a table written for each round."""
    edges, state = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before, edges = edges, staged(small)
        if state is not None:
            discard(before)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        state = now


def _across(shared: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different labels, by token and size, written.

    The smaller set of a pair is looked up: its token stands within the shorter prefix that sets of its size or more
    need. The larger one looks into the sizes that its own place in the prefix still allows. In each list the label with
    the most rows is set apart, so that its rows never meet one another.
    """
    label = links.groupBy(F.col("b").alias("node")).agg(F.max("a").alias("label"))
    s = shared.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # a token that one label has to itself, as most have in groups of near copies, leads to nothing new
    mixed = staged(s.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token"))
    s = staged(s.join(mixed, "token"))
    discard(mixed)
    whole = 100 + percent
    bin_of = lambda n: F.floor(F.log(n.cast("double")) * 12).cast("int")
    index = s.where(whole * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n")).withColumn("bin", bin_of(F.col("n")))
    index = index.select("token", "bin", F.col("node").alias("y"), F.col("n").alias("yn"), F.col("pos").alias("yp"), F.col("label").alias("yl"))
    main = index.groupBy("token", "bin", "yl").agg(F.count(F.lit(1)).alias("c")).groupBy("token", "bin").agg(F.max(F.struct("c", "yl")).alias("m")).select("token", "bin", F.col("m.yl").alias("main"))
    index = index.join(main, ["token", "bin"]).withColumn("side", (F.col("yl") == F.col("main")).cast("int")).drop("main")
    low = F.ceil(percent * F.col("n") / 100).cast("int")
    high = F.least(F.col("n"), F.floor(whole * (F.col("n") - F.col("pos")) / percent - F.col("n")).cast("int"))
    probe = s.withColumn("low", low).withColumn("high", high).where("low <= high and low > 0")
    probe = probe.withColumn("bin", F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("high")))))
    probe = probe.select("token", "bin", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xp"), F.col("label").alias("xl"))
    probe = probe.join(main, ["token", "bin"]).withColumn("side", F.explode(F.when(F.col("xl") == F.col("main"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    fits = (
        (F.col("xl") != F.col("yl")) & ((F.col("yn") < F.col("xn")) | ((F.col("yn") == F.col("xn")) & (F.col("y") < F.col("x"))))
        & (whole * F.least(F.col("xn") - F.col("xp"), F.col("yn") - F.col("yp")) >= percent * (F.col("xn") + F.col("yn")))
    )
    out = staged(probe.join(index, ["token", "bin", "side"]).where(fits).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    discard(s)
    return out


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, n_shingles and component_id.

    Documents link if 100 x intersection >= percent x union of their shingle sets; component_id is the least id that
    links reach. Null and empty texts, and texts without a word, link with nothing. Rows
    are documents: one that repeats another's id is another document; one without an id has its component's least id,
    null if there is none. Other columns are not read.
    """
    with arrow_batches(docs.sparkSession), shuffles_dropped(docs.sparkSession):
        out, tables = _found(docs, k, percent, id_col, text_col)
        out = staged(out)
    discard(*tables)
    return out


def _found(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """jaccard_components' result, and the tables that it reads."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << docs.count().bit_length()))
    measured = staged(docs.mapInArrow(_measure(k, cells), "doc_id long, n long, h1 long, h2 long, slice int, cells binary"))
    rows = measured.where(F.col("slice").isNull()).select("doc_id", "n", "h1", "h2")
    nodes = rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()))  # numbers that hold once they are written
    texts, bitmap = _wanted(docs, nodes)
    model = spark.sparkContext.broadcast((_frequency_levels(measured, cells), bitmap))
    post = staged(texts.mapInArrow(_postings(k, percent, model), "h1 long, h2 long, n int, common int, p int, prefix binary"))
    model.destroy()
    kept = _shared_tokens(post, nodes)
    discard(post)
    heads = kept.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max(F.struct("common", "n", "node", "pos")).alias("head")).where("lo <> hi").select("token", "head")
    heads = staged(heads)  # a table of its own, so that Spark can split the join where one token has many rows
    shared = staged(kept.join(heads, "token"))
    discard(kept, heads)
    whole = 100 + percent
    fits = whole * F.least(F.col("n") - F.col("pos"), F.col("head.n") - F.col("head.pos")) >= percent * (F.col("n") + F.col("head.n"))
    stars = staged(shared.where((F.col("node") != F.col("head.node")) & fits).select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct())
    first = _links(docs, nodes, stars, k, percent)
    across = _across(shared.drop("head"), first, percent)
    discard(shared, stars)
    more = _links(docs, nodes, across, k, percent)
    roots = _components(first.union(more))
    joined = nodes.join(roots, "node")
    ids = joined.groupBy("root").agg(F.min("rep").alias("least"))
    of_node = staged(joined.join(ids, "root").select("node", "least"))
    discard(first, across, more)
    # sets without links have their own documents' least id
    alone = nodes.join(of_node, "node", "left").select("h1", "h2", F.coalesce("least", "rep").alias("component_id"))
    out = rows.where("n > 0").join(alone, ["h1", "h2"], "left").select("doc_id", "n", "component_id")
    out = out.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"), [measured, nodes, of_node]


def near_duplicate_filter(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that have a near copy of a smaller id in their component. Columns stay as they are.

    Documents without an id stay, as do texts without words; repeated rows of one id stay or go together.
    """
    found = jaccard_components(docs, k, percent)
    gone = found.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), listed AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM worded
), sets AS (
  SELECT list_sort(s) AS s, len(s) AS n, min(doc_id) AS node FROM listed WHERE len(s) > 0 GROUP BY ALL
), shingles AS (
  SELECT node, n, hash(unnest(s)) AS x FROM sets
), pairs AS (
  SELECT a.node AS a, b.node AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.node < b.node AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach(node, root) AS (
  SELECT node, node FROM sets UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.node WHERE r.root < e.b
), least AS (
  SELECT node, min(root) AS root FROM reach GROUP BY node
)
SELECT doc_id, len(l.s)::BIGINT AS n_shingles, coalesce(least.root, doc_id) AS component_id
FROM listed l LEFT JOIN sets ON sets.s = list_sort(l.s) LEFT JOIN least USING (node)
"""
