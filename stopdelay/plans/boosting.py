"""Boosted trees for a late-arrival probability and for delay quantiles.

Rows are binned once: a number by the quantiles of its column, a category by its place among the common ones, what is
missing or unseen as 0. They are kept in memory in blocks, a column an array. A job looks at many nodes of a tree: tasks add
up their rows' gradients by node, feature and bin, these sums are summed by node, and what is best is found there. Gradients
are whole numbers, so a tree is the same however rows are dealt. What reaches the driver is a split a node.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import BITS, from_keys, ordered_keys
from ..sources.tables import shared_path, written

#: Bins of a number; rows that a category must have, rarer ones are as unseen.
BINS, CATEGORY_ROWS = 255, 20
#: Cells (bins x 64 nodes) of a feature up to which all are kept, of wider ones only those that occur; rows of a block.
CELLS, RUN = 1 << 14, 1 << 18
#: Rows up to which one task grows all trees, as one partition (some 60 bytes a row): a job a level would cost more.
ALONE = 1 << 20
#: Gradients are multiples of 1 / UNIT; sums of 2^37 rows fit in 64 bits.
UNIT = 1 << 26
#: Trees after which the rows with their scores are written, so that a lost executor costs so many trees at most.
WRITTEN = 32
LEAST_GAIN = 1e-9


class Binning:
    """How columns become bins: numbers first, then categories. Bin 0: null, NaN, unseen or rare."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str], edges: Sequence[Sequence[float]], names: Sequence[Sequence[str]]):
        self.numeric, self.categorical, self.edges, self.names = list(numeric), list(categorical), [list(x) for x in edges], [list(x) for x in names]

    @classmethod
    def fit(cls, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], bins: int = BINS, category_rows: int = CATEGORY_ROWS) -> Binning:
        """Quantiles of all numbers by one job of mergeable sketches, and each category's counts by a job of its own."""
        shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        row = df.agg(F.lit(0).alias("_"), *[F.percentile_approx(number(c), shares).alias(f"q{i}") for i, c in enumerate(numeric)]).first()
        edges = [sorted(set(row[f"q{i}"] or [])) for i in range(len(numeric))]
        names = []
        for c in categorical:
            counted = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= category_rows)
            names.append([r["name"] for r in counted.orderBy(F.desc("n"), "name").collect()])  # a part of the model, a name for 20 rows at most
        return cls(numeric, categorical, edges, names)

    @property
    def widths(self) -> list[int]:
        """Bins of each feature, bin 0 included."""
        return [*[len(x) + 2 for x in self.edges], *[len(x) + 1 for x in self.names]]

    def apply(self, df: DataFrame, name: str = "bins", only: Sequence[str] | None = None) -> DataFrame:
        """df with its bins, 32 bits each, as one binary column (a column of that name is replaced). only: the
        other columns that are kept, all by default; what isn't kept doesn't go through Python."""
        keep = [c for c in (df.columns if only is None else only) if c != name]
        src = df.select(*keep, *[F.col(c).cast("double").alias(f"_bin{i}") for i, c in enumerate(self.numeric)], *[F.col(c).cast("string").alias(f"_cat{i}") for i, c in enumerate(self.categorical)])
        schema = src.select(*keep).withColumn(name, F.lit(b"")).schema
        edges = [np.array(x, float) for x in self.edges]
        places = [{x: i + 1 for i, x in enumerate(names)} for names in self.names]

        def run(batches):
            for b in batches:
                out = np.zeros((b.num_rows, len(edges) + len(places)), np.uint32)
                for i, e in enumerate(edges):
                    x = b.column(f"_bin{i}").to_numpy(zero_copy_only=False).astype(float)
                    out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(e, x, side="left") + 1)
                for i, place in enumerate(places):
                    coded = b.column(f"_cat{i}").dictionary_encode()
                    codes = np.array([*[place.get(v, 0) for v in coded.dictionary.to_pylist()], 0], np.uint32)
                    out[:, len(edges) + i] = codes[coded.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)]
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * (4 * out.shape[1])
                packed = pa.BinaryArray.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())])
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], packed], names=[*keep, name])

        return src.mapInArrow(run, schema)

    def state(self) -> dict:
        return {"numeric": self.numeric, "categorical": self.categorical, "edges": self.edges, "names": self.names}


def bins_of(column: pa.Array, features: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, features), np.uint32)
    _, ends, data = column.buffers()
    first = int(np.frombuffer(ends, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset])
    return np.frombuffer(data, np.uint32, len(column) * features, first).reshape(len(column), features)


#: Columns of bins, targets, scores so far.
Block = tuple[list[np.ndarray], np.ndarray, np.ndarray]


def blocks_of(batches: Iterable[pa.RecordBatch], widths: Sequence[int]) -> Iterator[Block]:
    """Batches(bins, y, f) as blocks of at least RUN rows, the last one aside; a bin takes the bytes that its feature needs."""
    kinds, held, n = [np.min_scalar_type(max(x - 1, 0)) for x in widths], [], 0

    def block():
        cols = [np.concatenate([bins[:, i] for bins, _, _ in held]).astype(kind) for i, kind in enumerate(kinds)]
        return cols, np.concatenate([y for _, y, _ in held]), np.concatenate([f for _, _, f in held])

    for b in batches:
        if b.num_rows:
            held.append((bins_of(b.column("bins"), len(widths)), b.column("y").to_numpy(), b.column("f").to_numpy()))
            n += b.num_rows
        if n >= RUN:
            yield block()
            held, n = [], 0
    if held:
        yield block()


def bits_of(numbers: Sequence[int] | np.ndarray) -> np.ndarray:
    """A set of small numbers, a bit each."""
    return np.packbits(np.bincount(numbers, minlength=1) > 0, bitorder="little")


def has(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = x >> 3
    return (at < len(bits)) & (bits[np.minimum(at, len(bits) - 1)] >> (x & 7).astype(np.uint8) & 1 > 0)


def numbers_of(bits: np.ndarray) -> list[int]:
    return np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()


def routed(cols: Sequence[np.ndarray], n: int, splits: Sequence[tuple], at: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """The rows of each leaf; splits: parents first. at: the leaves of some of the splits, which become those of all."""
    at = {1: np.arange(n)} if at is None else at
    for node, feature, cut, missing_left, left in splits:
        if node not in at:
            continue
        rows = at.pop(node)
        own = cols[feature][rows]
        goes = has(left, own) if left is not None else (own <= cut) & ((own > 0) | missing_left)
        at[2 * node], at[2 * node + 1] = rows[goes], rows[~goes]
    return at


class Tree:
    """splits: (node, feature, cut, whether what is missing goes left, categories that go left or None), nodes by heap
    order from 1; values: of the leaves. sides: the splits with a bit a category, which is how a grown tree is kept."""

    def __init__(self, splits: Sequence[tuple] = (), values: dict[int, float] | None = None, sides: list[tuple] | None = None):
        if sides is None:
            self.splits = list(splits)
        self.sides, self.values = sides, dict(values or {})

    def __getattr__(self, name):
        if name != "splits":
            raise AttributeError(name)
        return [(*s[:4], None if s[4] is None else numbers_of(s[4])) for s in self.sides]

    def __getstate__(self):
        return self.packed(), self.values

    def __setstate__(self, state):
        self.sides, self.values = state

    def packed(self) -> list[tuple]:
        """The splits, parents first, with a bit a category."""
        return [(*s[:4], None if s[4] is None else bits_of(s[4])) for s in self.splits] if "splits" in vars(self) else self.sides

    def score(self, bins: np.ndarray | Sequence[np.ndarray]) -> np.ndarray:
        """bins: a row a row, or a list of columns."""
        cols = bins if isinstance(bins, list) else list(np.ascontiguousarray(bins.T))
        out = np.zeros(len(cols[0]))
        for node, rows in routed(cols, len(out), self.packed()).items():
            out[rows] = self.values[node]
        return out

    def state(self) -> dict:
        return {"splits": self.splits, "values": sorted(self.values.items())}


def best_split(feature: np.ndarray, bins: np.ndarray, sums: np.ndarray, n_numeric: int, l2: float, min_rows: int) -> dict | None:
    """The best split of a node by the sums (g, h, n) of its features' bins, see best_splits; by feature, numbers by bin."""
    at = np.searchsorted(feature, n_numeric)
    if at < len(feature):
        w = sums[1, at:] / UNIT + l2
        ratio = np.divide(sums[0, at:] / UNIT, w, out=np.zeros(len(w)), where=w > 0)
        order = np.concatenate([np.arange(at), at + np.lexsort((bins[at:], ratio, feature[at:]))])
        feature, bins, sums = feature[order], bins[order], sums[:, order]
    if not len(feature):
        return None
    first = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
    sizes = np.diff(np.append(first, len(feature)))
    each = lambda x: np.repeat(x, sizes, axis=1)  # noqa: E731  of a feature, at each of its bins
    missing = sums * ((feature < n_numeric) & (bins == 0))
    every, none = np.add.reduceat(sums, first, axis=1), each(np.add.reduceat(missing, first, axis=1))
    low = np.cumsum(sums - missing, axis=1)
    low -= each(low[:, first] - (sums - missing)[:, first])

    def part(g, h):
        g, w = g / UNIT, h / UNIT + l2
        return np.divide(g * g, w, out=np.zeros(len(w)), where=w > 0)

    whole, every = np.repeat(part(every[0], every[1]), sizes), each(every)

    def gain(left):
        right = every - left
        return np.where((left[2] >= min_rows) & (right[2] >= min_rows), part(left[0], left[1]) + part(right[0], right[1]) - whole, -1.0)

    to_right, to_left = gain(low), gain(low + none)
    gains = np.maximum(to_left, to_right)
    i = int(np.argmax(gains))  # of equals the first
    if not gains[i] > LEAST_GAIN:
        return None
    missing_left = bool(to_left[i] > to_right[i])
    left = low[:, i] + none[:, i] if missing_left else low[:, i]
    start = first[np.searchsorted(first, i, side="right") - 1]
    return {
        "feature": int(feature[i]), "cut": int(bins[i]), "missing_left": missing_left, "gain": float(gains[i]), "left": bits_of(bins[start : i + 1]) if feature[i] >= n_numeric else None,
        **{f"left_{c}": int(x) for c, x in zip("ghn", left)}, **{f"right_{c}": int(x) for c, x in zip("ghn", every[:, i] - left)},
    }


SPLITS = "node long, feature int, cut int, missing_left boolean, gain double, left array<int>, left_g long, left_h long, left_n long, right_g long, right_h long, right_n long"


def best_splits(sums: DataFrame, n_numeric: int, l2: float, min_rows: int) -> DataFrame:
    """The best split of each node of sums(node, feature, bin, g, h, n): feature, cut, missing_left, left (categories) and
    both sides' sums. No row for a node that no split helps.

    Numbers are cut between bins, with what is missing on either side; categories stand by gradient over weight, so that
    the best of all subsets is among the cuts of that order. Ties go to the first feature, then to the first cut, and of
    both ways for what is missing to the right. A node has as many sums as there are bins at most.
    """
    schema = sums.sparkSession.createDataFrame([], SPLITS).schema
    names = [*schema.names[1:5], *schema.names[6:]]

    def run(key, table):
        table = table.sort_by([("feature", "ascending"), ("bin", "ascending")])
        feature, bins, *rest = (table.column(c).to_numpy() for c in ("feature", "bin", "g", "h", "n"))
        found = best_split(feature, bins, np.stack(rest), n_numeric, l2, min_rows)
        row = {} if found is None else {"node": key[0].as_py(), **{c: found[c] for c in names}, "left": [] if found["left"] is None else numbers_of(found["left"])}
        kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<int>": pa.list_(pa.int32())}
        return pa.table({c: pa.array([row[c]] if row else [], kinds[k]) for c, k in (x.split() for x in SPLITS.split(", "))})

    return sums.groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"]).groupBy("node").applyInArrow(run, schema)


def log_odds(n: int, late: float) -> float:
    return math.log((late + 0.5) / (n - late + 0.5))


def compact(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of equal keys, by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(sums[:, order], first, axis=1) if len(keys) else sums


class Sums:
    """Sums of gradients, weights and rows of a node: of narrow features all bins side by side, of wide ones those that occur."""

    def __init__(self, narrow: np.ndarray, wide: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.narrow, self.wide = narrow, wide

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.narrow + other.narrow, {i: compact(np.concatenate([k, other.wide[i][0]]), np.concatenate([x, other.wide[i][1]], axis=1)) for i, (k, x) in self.wide.items()})

    def __sub__(self, other: Sums) -> Sums:
        rest = self + Sums(-other.narrow, {i: (k, -x) for i, (k, x) in other.wide.items()})
        return Sums(rest.narrow, {i: (k[x[2] > 0], x[:, x[2] > 0]) for i, (k, x) in rest.wide.items()})

    def cells(self, widths: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """feature, bin and sums of what occurs, by feature and bin."""
        narrow = [i for i in range(len(widths)) if i not in self.wide]
        own = np.array([widths[i] for i in narrow], np.int64)
        on = np.flatnonzero(self.narrow[2])
        ends = np.cumsum(own)
        at = np.searchsorted(ends, on, side="right")
        feature, bins, sums = np.array(narrow, np.int64)[at], on - (ends - own)[at], self.narrow[:, on]
        if not self.wide:
            return feature, bins, sums
        feature = np.concatenate([feature, *[np.full(len(k), i) for i, (k, _) in self.wide.items()]])
        bins, sums = np.concatenate([bins, *[k for k, _ in self.wide.values()]]), np.concatenate([sums, *[x for _, x in self.wide.values()]], axis=1)
        order = np.argsort(feature, kind="stable")
        return feature[order], bins[order], sums[:, order]


class Boost:
    """loss: "logistic", or a share between 0 and 1 for the quantile of that share. Nodes are split as long as a split helps,
    down to a depth, or best first up to so many leaves, or both (None: no limit)."""

    def __init__(self, loss: str | float, rounds: int = 50, depth: int | None = 5, step: float = 0.1, l2: float = 1.0, min_rows: int = 20, leaves: int | None = None):
        self.loss, self.rounds, self.depth, self.step, self.l2, self.min_rows, self.leaves = loss, rounds, depth, step, l2, min_rows, leaves
        self.base, self.trees = 0.0, []

    def gradients(self, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of the loss, in 1 / UNIT."""
        if self.loss == "logistic":
            p = 1 / (1 + np.exp(-f))
            return np.rint((p - y) * UNIT).astype(np.int64), np.rint(p * (1 - p) * UNIT).astype(np.int64)
        return np.rint(np.where(y > f, -self.loss, 1 - self.loss) * UNIT).astype(np.int64), np.full(len(y), UNIT, np.int64)

    def fit(self, binned: DataFrame, target: str, widths: Sequence[int], n_numeric: int) -> Boost:
        """binned: rows with bins and the target; rows whose target is null don't count."""
        y, widths = F.col(target).cast("double"), list(widths)

        def run(batches):
            for block in blocks_of(batches, widths):
                yield pa.RecordBatch.from_pydict({"block": pa.array([pickle.dumps(block)], pa.binary()), "n": [len(block[1])], "late": [float(block[1].sum())]})

        rows = binned.select("bins", y.alias("y"), F.lit(0.0).alias("f")).where(y.isNotNull())
        blocks = written(rows.mapInArrow(run, "block binary, n long, late double"), "rows")
        n, late = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("late"), F.lit(0.0))).first()
        self.base, self.trees = log_odds(n, late) if self.loss == "logistic" else 0.0, []
        if not n:
            return self
        data = blocks.select("block").rdd.map(lambda r: pickle.loads(r[0]))
        if n <= ALONE:
            (self.base, self.trees), = data.coalesce(1).mapPartitions(lambda held: [self._boosted(Held(held, self, widths, n_numeric))]).collect()
        else:
            if not data.context.getCheckpointDir():
                data.context.setCheckpointDir(shared_path(binned.sparkSession, "scores"))
            self.base, self.trees = self._boosted(Dealt(data, self, widths, n_numeric))
        return self

    def _boosted(self, rows: Held | Dealt) -> tuple[float, list[Tree]]:
        trees = []
        base = self.base if self.loss == "logistic" else rows.quantiles([]).get(1, 0.0)
        rows.add(Tree([], {1: base}))
        for _ in range(self.rounds):
            tree = self._grown(rows)
            if not tree.packed():
                break
            trees.append(tree)
            rows.add(tree)
        rows.done()
        return base, trees

    def _grown(self, rows: Held | Dealt) -> Tree:
        """All nodes whose split isn't known yet are looked at together, also such that may turn out not to be among the
        best; the tree is that of splitting one node after the other, as it's done when all that it meets are known."""
        found, asked, chosen = {}, [1], []
        while asked:
            above = {x >> i for x in asked for i in range(1, x.bit_length())}
            fewer = {x: x if x == 1 else x & ~1 | (found[x >> 1]["left_n"] > found[x >> 1]["right_n"]) for x in asked}
            found |= dict.fromkeys(asked) | rows.best(self._tree(found, above).packed(), fewer)
            chosen, asked = self._chosen(found)
        tree = self._tree(found, chosen)
        sums = {2 * x + i: [found[x][f"{side}_{c}"] for c in "gh"] for x in chosen for i, side in enumerate(("left", "right"))}
        leaves = set(sums) - set(chosen)
        if self.loss == "logistic":
            tree.values = {x: -self.step * (sums[x][0] / UNIT) / (sums[x][1] / UNIT + self.l2) if sums[x][1] or self.l2 else 0.0 for x in leaves}
        elif leaves:
            tree.values = {x: 0.0 for x in leaves} | {x: self.step * v for x, v in rows.quantiles(tree.packed()).items()}  # a number a leaf
        return tree

    def _tree(self, found: dict[int, dict], nodes: Iterable[int]) -> Tree:
        return Tree(sides=[(x, *[found[x][c] for c in ("feature", "cut", "missing_left", "left")]) for x in sorted(nodes)])

    def _chosen(self, found: dict[int, dict]) -> tuple[list[int], list[int]]:
        """Nodes to split, best first, as far as known, and those to look at before it's known."""
        heap, chosen, unknown = [(-found[1]["gain"], 1)] if found[1] else [], [], []
        while heap and (self.leaves is None or len(chosen) < self.leaves - 1):
            _, node = heapq.heappop(heap)
            chosen.append(node)
            for child, side in ((2 * node, "left"), (2 * node + 1, "right")):
                if found[node][f"{side}_n"] < 2 * self.min_rows or (self.depth is not None and child.bit_length() > self.depth):
                    continue
                if child not in found:
                    unknown.append(child)
                elif found[child]:
                    heapq.heappush(heap, (-found[child]["gain"], child))
        return chosen, unknown if self.leaves is None or len(chosen) < self.leaves - 1 else [x for x in unknown if x >> 1 != chosen[-1]]

    def level(self, data: DataFrame, widths: Sequence[int], tree: Tree | None = None, frontier: Sequence[int] = (1,)) -> DataFrame:
        """Sums of gradients of rows(bins, y, f) by node, feature and bin, for the nodes of a tree that is being grown."""
        splits, nodes, widths = (tree or Tree()).packed(), list(frontier), list(widths)

        def run(batches):
            for block in blocks_of(batches, widths):
                for node, sums in self.sums([(block, routed(block[0], len(block[1]), splits))], nodes, widths):
                    feature, bins, values = sums.cells(widths)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), node)), pa.array(feature.astype(np.int32)), pa.array(bins.astype(np.int32)), *map(pa.array, values)], names=["node", "feature", "bin", "g", "h", "n"])

        return data.mapInArrow(run, "node long, feature int, bin int, g long, h long, n long")

    def sums(self, blocks: Iterable[tuple[Block, dict[int, np.ndarray]]], nodes: Sequence[int], widths: Sequence[int]) -> Iterator[tuple[int, Sums]]:
        """Sums of gradients of the nodes that have rows in these blocks, each with its nodes' rows."""
        count = len(nodes)
        wide = {i: ([], []) for i, width in enumerate(widths) if 64 * width > CELLS}
        narrow = [i for i in range(len(widths)) if i not in wide]
        offsets = np.cumsum([0, *[widths[i] for i in narrow]])
        total = np.zeros((count, 3, offsets[-1]), np.int64)
        sizes = np.zeros(count, np.int64)
        for (cols, y, f), at in blocks:
            own = [at[x] for x in nodes]
            rows, lengths = np.concatenate(own), [len(x) for x in own]
            sizes += lengths
            place = np.repeat(np.arange(count), lengths)
            starts = {width: place * width for width in {*widths}}
            g, h = (x.astype(float) for x in self.gradients(y[rows], f[rows]))

            def added(key, size):  # a block's sums are exact in floating point
                n = np.bincount(key, None, size)
                return [np.rint(np.bincount(key, g, size)).astype(np.int64), np.rint(np.bincount(key, h, size)).astype(np.int64) if self.loss == "logistic" else n * UNIT, n]

            for i, start, end in zip(narrow, offsets, offsets[1:]):
                for j, part in enumerate(added(starts[widths[i]] + cols[i][rows], count * widths[i])):
                    total[:, j, start:end] += part.reshape(count, -1)
            for i, (keys, values) in wide.items():
                key, size = starts[widths[i]] + cols[i][rows], count * widths[i]
                if size > 2 * len(key):
                    own, place_of = np.unique(key, return_inverse=True)
                    value = np.stack(added(place_of, len(own)))
                else:
                    value = np.stack(added(key, size))
                    own = np.flatnonzero(value[2])
                    value = value[:, own]
                keys.append(own)
                values.append(value)
        merged = {i: compact(np.concatenate(keys), np.concatenate(values, axis=1)) for i, (keys, values) in wide.items() if keys}
        for k, node in enumerate(nodes):
            if sizes[k]:
                spans = {i: np.searchsorted(keys, [k * widths[i], (k + 1) * widths[i]]) for i, (keys, _) in merged.items()}
                yield node, Sums(total[k], {i: (merged[i][0][a:z] - k * widths[i], merged[i][1][:, a:z]) for i, (a, z) in spans.items()})

    def state(self) -> dict:
        return {"loss": self.loss, "rounds": self.rounds, "depth": self.depth, "step": self.step, "l2": self.l2, "min_rows": self.min_rows, "leaves": self.leaves, "base": self.base, "trees": [t.state() for t in self.trees]}

    @classmethod
    def of(cls, state: dict) -> Boost:
        out = cls(*[state[x] for x in ("loss", "rounds", "depth", "step", "l2", "min_rows")], state.get("leaves"))
        out.base, out.trees = state["base"], [Tree([tuple(s) for s in t["splits"]], dict(map(tuple, t["values"]))) for t in state["trees"]]
        return out


def buckets(blocks: Iterable[Block], splits: Sequence[tuple], heads: dict[tuple[int, int], int], left: int) -> Iterator[tuple[tuple[int, int], tuple]]:
    """Rows of each bucket of what a leaf's targets lack, by its order from bit left on; heads: the bits before, or None."""
    for cols, y, f in blocks:
        for leaf, rows in routed(cols, len(y), splits).items():
            rest = (y - f)[rows]
            keys = ordered_keys(rest[~np.isnan(rest)])
            for side in (0, 1):
                head = heads.get((leaf, side))
                own = keys if head is None else keys[keys >> (left + BITS) == head]
                if len(own):
                    yield (leaf, side), np.unique(own >> left, return_counts=True)


def joined(a: tuple, b: tuple) -> tuple:
    keys, sums = compact(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])[None])
    return keys, sums[0]


def ranked(counts: tuple, rank: int | None, side: int, q: float) -> tuple[int, int, float]:
    """The bucket with that rank, the rank in it and, if the rank isn't known yet, the share of the next one."""
    keys, n = counts
    exact = (int(n.sum()) - 1) * float(q)
    share, rank = exact - math.floor(exact), rank if rank is not None else math.ceil(exact) if side else math.floor(exact)
    upto = np.cumsum(n)
    i = int(np.searchsorted(upto, rank, side="right"))
    return int(keys[i]), rank - int(upto[i] - n[i]), share


class Held:
    """Rows that a task holds, see ALONE."""

    def __init__(self, blocks: Iterable[Block], boost: Boost, widths: Sequence[int], n_numeric: int):
        self.blocks, self.boost, self.widths, self.n_numeric = list(blocks), boost, widths, n_numeric
        self.at, self.kept = [], {}

    def best(self, splits: Sequence[tuple], nodes: dict[int, int]) -> dict[int, dict | None]:
        """nodes: each with the one of it and its sibling that has fewer rows. That one's sums are made, the other's are what
        is left of their parent's."""
        self.at = [routed(cols, len(y), splits, at) for (cols, y, _), at in zip(self.blocks, self.at or [None] * len(self.blocks))]
        made = dict(self.boost.sums(zip(self.blocks, self.at), sorted({*nodes.values()}), self.widths))
        for x in sorted({*nodes.values()} - {1}):
            made[x ^ 1] = self.kept.pop(x >> 1) - made[x]
        self.kept |= {x: made[x] for x in nodes}
        return {x: best_split(*made[x].cells(self.widths), self.n_numeric, self.boost.l2, self.boost.min_rows) for x in nodes}

    def add(self, tree: Tree) -> None:
        self.blocks = [(cols, y, f + tree.score(cols)) for cols, y, f in self.blocks]
        self.at, self.kept = [], {}

    def chosen(self, splits: Sequence[tuple], heads: dict, ranks: dict, left: int) -> dict[tuple[int, int], tuple]:
        counts = {}
        for key, x in buckets(self.blocks, splits, heads, left):
            counts[key] = joined(counts[key], x) if key in counts else x
        return {key: ranked(x, ranks.get(key), key[1], self.boost.loss) for key, x in counts.items()}

    def quantiles(self, splits: Sequence[tuple]) -> dict[int, float]:
        """The linearly interpolated quantile of what each leaf's targets lack, as grouped_quantile finds it."""
        heads, ranks, shares = {}, {}, {}
        for left in range(64 - BITS, -1, -BITS):
            found = self.chosen(splits, heads, ranks, left)
            shares = shares or {key: x[2] for key, x in found.items()}
            heads, ranks = {key: x[0] for key, x in found.items()}, {key: x[1] for key, x in found.items()}
        value = lambda key: float(from_keys(np.array([heads[key]], np.int64))[0])
        return {leaf: value((leaf, 0)) + (value((leaf, 1)) - value((leaf, 0))) * shares[leaf, 0] for leaf, side in heads if not side}

    def done(self) -> None:
        self.blocks = []


class Dealt(Held):
    """Rows dealt to tasks, in memory as far as they fit. A job a call."""

    def __init__(self, blocks: RDD, boost: Boost, widths: Sequence[int], n_numeric: int):
        self.blocks, self.boost, self.widths, self.n_numeric, self.added, self.older = blocks, boost, widths, n_numeric, 0, None

    def best(self, splits: Sequence[tuple], nodes: dict[int, int]) -> dict[int, dict | None]:
        """The sums of all nodes are made: keeping their parents' costs a job more shuffles than it saves."""
        boost, widths, n_numeric, made = self.boost, self.widths, self.n_numeric, list(nodes)
        sums = self.blocks.mapPartitions(lambda held: boost.sums(((x, routed(x[0], len(x[1]), splits)) for x in held), made, widths)).reduceByKey(lambda a, b: a + b, min(len(made), self.blocks.getNumPartitions()))
        out = sums.mapValues(lambda x: best_split(*x.cells(widths), n_numeric, boost.l2, boost.min_rows)).collectAsMap()  # a split a node
        self._kept()
        return out

    def chosen(self, splits: Sequence[tuple], heads: dict, ranks: dict, left: int) -> dict[tuple[int, int], tuple]:
        q = self.boost.loss
        counts = self.blocks.mapPartitions(lambda held: buckets(held, splits, heads, left)).reduceByKey(joined)
        out = counts.map(lambda x: (x[0], ranked(x[1], ranks.get(x[0]), x[0][1], q))).collectAsMap()  # two buckets a leaf
        self._kept()
        return out

    def add(self, tree: Tree) -> None:
        """The rows with their new scores, kept by the next job that reads them."""
        self._kept()
        self.older, self.added = self.blocks, self.added + 1
        self.blocks = self.blocks.map(lambda x: (x[0], x[1], x[2] + tree.score(x[0]))).persist(StorageLevel.MEMORY_AND_DISK)
        if self.added % WRITTEN == 0:
            self.blocks.checkpoint()

    def _kept(self) -> None:
        """After a job that read all rows: those with older scores aren't needed."""
        if self.older is not None:
            self.older.unpersist()
            self.older = None

    def done(self) -> None:
        self._kept()
        self.blocks.unpersist()


def scored(df: DataFrame, models: dict[str, Boost], features: int, bins: str = "bins") -> DataFrame:
    """df without its bins and with each model's score under its name: a probability, or the quantile."""
    parts = [(name, m.trees, m.base, m.loss == "logistic") for name, m in models.items()]
    keep = [c for c in df.columns if c not in models and c != bins]
    src = df.select(*keep, bins)
    schema = src.select(*keep, *[F.lit(0.0).alias(name) for name in models]).schema

    def run(batches):
        for b in batches:
            own, out = list(np.ascontiguousarray(bins_of(b.column(bins), features).T)), []
            for _, trees, base, logistic in parts:
                f = base + sum((t.score(own) for t in trees), np.zeros(b.num_rows))
                out.append(pa.array(1 / (1 + np.exp(-f)) if logistic else f))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *out], names=[*keep, *[x[0] for x in parts]])

    return src.mapInArrow(run, schema)
