"""Conversation prefix trie by adaptive radix trees.

A turn's id is a fixed number of bytes, a conversation's key its turns' ids one after another. Distinct keys are dealt by
ranges, and each task builds an adaptive radix tree of its range: nodes have one of four layouts, which grow with their
children, and a path without branches is one node. The tree's bytes are walked, but only depths at which whole turns end
are nodes of the trie.

A range's nodes are whole but for those that hold its first or its last key, as their members may go on in the next
range. These two paths of each range go up, are merged with those of the ranges beside it, and what is then inside is
whole; two paths go on, until one group is left. So a task holds its range, or two paths of some hundred ranges.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, sliced, staged, table

#: Bytes of a turn's id, turns of a range, ranges that are merged at once, conversation ids of a chunk of an id list.
WIDTH, RANGE_TURNS, MERGED, CHUNK = 16, 100_000, 512, 8_192
OUT_ROWS = 20_000


class Node4:
    """Up to `room` children beside their bytes, in order of these. prefix: the bytes that all keys below go on with;
    row: which key ends here, -1 for none."""

    room = 4
    __slots__ = ("prefix", "row", "bytes", "below")

    def __init__(self, prefix: bytes = b"", row: int = -1):
        self.prefix, self.row, self.bytes, self.below = prefix, row, bytearray(), []

    def get(self, byte: int):
        at = self.bytes.find(byte)
        return self.below[at] if at >= 0 else None

    def put(self, byte: int, child):
        """This node with the child, or the larger one that takes its place."""
        at = self.bytes.find(byte)
        if at >= 0:
            self.below[at] = child
            return self
        if len(self.below) == self.room:
            return self.larger().put(byte, child)
        at = sum(b < byte for b in self.bytes)
        self.bytes.insert(at, byte)
        self.below.insert(at, child)
        return self

    def larger(self):
        out = Node16(self.prefix, self.row)
        out.bytes, out.below = self.bytes, self.below
        return out

    def children(self):
        return self.below


class Node16(Node4):
    room = 16
    __slots__ = ()

    def larger(self):
        out = Node48(self.prefix, self.row)
        for byte, child in zip(self.bytes, self.below):
            out.put(byte, child)
        return out


class Node48(Node4):
    """A place for each byte that says which of the children is its own (0: none)."""

    room = 48
    __slots__ = ()

    def __init__(self, prefix: bytes = b"", row: int = -1):
        super().__init__(prefix, row)
        self.bytes = bytearray(256)

    def get(self, byte: int):
        at = self.bytes[byte]
        return self.below[at - 1] if at else None

    def put(self, byte: int, child):
        at = self.bytes[byte]
        if at:
            self.below[at - 1] = child
        elif len(self.below) == self.room:
            return self.larger().put(byte, child)
        else:
            self.below.append(child)
            self.bytes[byte] = len(self.below)
        return self

    def larger(self):
        out = Node256(self.prefix, self.row)
        for byte, at in enumerate(self.bytes):
            if at:
                out.below[byte] = self.below[at - 1]
        return out

    def children(self):
        return [self.below[at - 1] for at in self.bytes if at]


class Node256(Node4):
    """A child for each byte."""

    room = 256
    __slots__ = ()

    def __init__(self, prefix: bytes = b"", row: int = -1):
        super().__init__(prefix, row)
        self.below = [None] * 256

    def get(self, byte: int):
        return self.below[byte]

    def put(self, byte: int, child):
        self.below[byte] = child
        return self

    def children(self):
        return [x for x in self.below if x is not None]


def common(a: bytes, b: bytes) -> int:
    """How many bytes two keys begin with alike; found by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class RadixTree:
    """An adaptive radix tree of byte strings; each key has a row number."""

    def __init__(self):
        self.root = None

    def insert(self, key: bytes, row: int) -> None:
        if self.root is None:
            self.root = Node4(key, row)
            return
        node, above, edge, at = self.root, None, 0, 0
        while True:
            prefix, child = node.prefix, None
            if not key.startswith(prefix, at):
                same = common(prefix, key[at : at + len(prefix)])
                node.prefix = prefix[same + 1 :]
                new = Node4(prefix[:same])
                new.put(prefix[same], node)
                at += same
            else:
                new, at = node, at + len(prefix)
            if at == len(key):
                new.row = row
            else:
                child = new.get(key[at]) if new is node else None
                if child is None:
                    new = new.put(key[at], Node4(key[at + 1 :], row))
            if new is not node:
                if above is None:
                    self.root = new
                else:
                    above.put(edge, new)
            if child is None:
                return
            above, edge, node, at = new, key[at], child, at + 1

    def find(self, key: bytes) -> int:
        """The key's row number, -1 if it isn't there."""
        node, at = self.root, 0
        while node is not None:
            if not key.startswith(node.prefix, at):
                return -1
            at += len(node.prefix)
            if at == len(key):
                return node.row
            node, at = node.get(key[at]), at + 1
        return -1

    def walk(self):
        """(node, bytes before its edge, bytes at its end, the node above's number) from the root down, in key order."""
        stack = [(self.root, -1, -1)] if self.root is not None else []
        number = 0
        while stack:
            node, before, above = stack.pop()
            end = before + 1 + len(node.prefix)
            yield node, before, end, above
            stack += [(child, end, number) for child in reversed(node.children())]
            number += 1


def turn_id(role: Column, text: Column) -> Column:
    """A turn's id in WIDTH bytes, as hex digits: a digest of role and text."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def turn_lists(turns: DataFrame) -> DataFrame:
    """conv_id and turns, a list of (turn, id, chars), of turns(conv_id, turn, role, text), dealt by hundreds of conv_id.

    Turns stand by turn, nulls first, then by id. A null role or text is empty. Rows without a conv_id belong to no
    conversation and take no part; repeated rows are repeated turns. A conversation's ids fit in a task (some 70 bytes a
    turn); its texts are never gathered. Other columns are not read.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    t = turns.where("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % 100).alias("hundred"), "conv_id", F.struct("turn", turn_id(role, text).alias("id"), F.length(text).cast("long").alias("chars")).alias("t")
    )
    return t.repartition("hundred").groupBy("hundred", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def keyed(lists: DataFrame) -> DataFrame:
    """conv_id, key and chars (code points of each turn's text) of turn_lists' rows."""
    return lists.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def _ends(batches):
    """Chunks of id lists, in order, to a row for each key: with the digest of its whole list."""
    state = None

    def row():
        return [*state[1:5], state[5].hexdigest()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()))], names=["key", "chars", "n", "least", "ends"])

    for batch in sliced(batches):
        rows = []
        for mark, key, chars, n, least, ids in zip(*[batch.column(c).to_pylist() for c in ("mark", "key", "chars", "n", "least", "ids")]):
            if state is not None and state[0] == mark:
                state[3] += n
                state[4] = min(state[4], least)
                state[5].update(b"," + ids.encode())
            else:
                if state is not None:
                    rows.append(row())
                state = [mark, key, chars, n, least, hashlib.sha256(ids.encode())]
        if rows:
            yield out(rows)
    if state is not None:
        yield out([row()])


def distinct_keys(convs: DataFrame) -> DataFrame:
    """A row for each key: chars, n (conversations that have it), least (of their ids), ends (digest of these in order)."""
    chunks = convs.groupBy(F.md5("key").alias("mark"), F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(
        F.first("key").alias("key"), F.first("chars").alias("chars"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"),
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"),
    )
    return chunks.repartition("mark").sortWithinPartitions("mark", "chunk").mapInArrow(_ends, "key binary, chars array<long>, n long, least long, ends string")


NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn_id string"
#: kind 0: a whole node. 1: a whole node whose parent is one of the range's two paths, `above` names it. 2: a path, with
#: what it has gathered at each depth from `start` on, without what goes up in paths.
PART = f"kind int, range long, {NODE}, mark binary, above binary, side int, start int, key binary, marks array<binary>, n array<long>, least array<long>, kids array<long>, leaves array<long>, saved array<long>, chars array<long>, ends array<string>"
FIELDS = {x.split()[0]: x.split()[1] for x in PART.split(", ")}
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}


def _parts(rows: list[dict]) -> pa.Table:
    return pa.table({name: pa.array([r.get(name) for r in rows], KINDS[kind]) for name, kind in FIELDS.items()})


def _marks(key: bytes) -> list[bytes]:
    """Digests of the key's first 0, 1, 2, ... turns."""
    h, out = hashlib.md5(), [hashlib.md5().digest()]
    for at in range(0, len(key), WIDTH):
        h.update(key[at : at + WIDTH])
        out.append(h.digest())
    return out


def _new_path(range_: int, side: int, start: int, key: bytes) -> dict:
    size = len(key) // WIDTH + 1
    return {"kind": 2, "range": range_, "side": side, "start": start, "key": key, "marks": _marks(key), "least": [None] * size, "ends": [None] * size} | {x: [0] * size for x in ("n", "kids", "leaves", "saved", "chars")}


def range_parts(range_: int, keys: list[bytes], chars: list[list[int]], n: list[int], least: list[int], ends: list[str]):
    """The parts (see PART) of one range of distinct keys, in order."""
    tree = RadixTree()
    for row, key in enumerate(keys):
        tree.insert(key, row)
    walked = list(tree.walk())
    size = len(keys)
    # from the leaves up: rows that a node holds, its members and least id, and what its whole children hand up
    low, high, members, smallest = [size] * len(walked), [0] * len(walked), [0] * len(walked), [None] * len(walked)
    kids, leaves, saved = ([0] * len(walked) for _ in range(3))
    # its own figures at its last whole depth, for the way down
    own: list[tuple] = [()] * len(walked)
    for i in range(len(walked) - 1, -1, -1):
        node, before, end, above = walked[i]
        if node.row >= 0:
            r = node.row
            low[i], high[i], members[i] = min(low[i], r), max(high[i], r + 1), members[i] + n[r]
            smallest[i] = least[r] if smallest[i] is None else min(smallest[i], least[r])
        depths = range(before // WIDTH + 1, end // WIDTH + 1)
        spine = low[i] == 0 or high[i] == size
        up = (kids[i], leaves[i], saved[i])
        if depths:
            if spine:
                own[i], up = up, (0, 0, 0)
            else:
                own[i] = (kids[i], leaves[i] or 1, saved[i])
                up = (1, own[i][1], saved[i] + (members[i] - 1) * sum(chars[low[i]][d - 1] for d in depths))
        if above >= 0:
            low[above], high[above], members[above] = min(low[above], low[i]), max(high[above], high[i]), members[above] + members[i]
            smallest[above] = smallest[i] if smallest[above] is None else min(smallest[above], smallest[i])
            kids[above], leaves[above], saved[above] = kids[above] + up[0], leaves[above] + up[1], saved[above] + up[2]
    # from the root down: a node's parent is a whole one (its least id) or one of a path (its mark)
    paths = [_new_path(range_, 0, 0, keys[0])]
    if size > 1:
        paths.append(_new_path(range_, 1, common(keys[0], keys[-1]) // WIDTH + 1, keys[-1]))
    parent: list[tuple] = [()] * len(walked)
    rows = []
    for i, (node, before, end, above) in enumerate(walked):
        up = parent[above] if above >= 0 else (None, None)
        depths = range(before // WIDTH + 1, end // WIDTH + 1)
        if depths:
            last, ended = depths[-1], ends[node.row] if node.row >= 0 else None
            path = paths[0] if low[i] == 0 else paths[1] if high[i] == size else None
            own_chars = chars[low[i]]
            if path is not None:
                for d in depths:
                    path["n"][d], path["least"][d], path["chars"][d] = members[i], smallest[i], own_chars[d - 1] if d else 0
                path["kids"][last], path["leaves"][last], path["saved"][last] = own[i]
                path["ends"][last] = ended
                up = (None, path["marks"][last])
            else:
                n_kids, n_leaves, total = own[i]
                total += (members[i] - 1) * sum(own_chars[d - 1] for d in depths)
                for d in depths:
                    rows.append({
                        "kind": 0 if up[1] is None else 1, "range": range_, "depth": d, "conv_id": smallest[i], "parent_conv_id": up[0], "above": up[1], "n_convs": members[i], "n_children": n_kids if d == last else 1,
                        "n_leaves": n_leaves, "saved_tokens": total, "ends_sha256": ended if d == last else None, "turn_id": keys[low[i]][(d - 1) * WIDTH : d * WIDTH].hex(),
                    })
                    total -= (members[i] - 1) * own_chars[d - 1]
                    up = (smallest[i], None)
                    if len(rows) >= OUT_ROWS:
                        yield _parts(rows)
                        rows = []
        parent[i] = up
    yield _parts(rows + paths)


def _range(batches):
    """A range's rows to its parts."""
    tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if tables:
        t = pa.concat_tables(tables)
        columns = [t.column(c).to_pylist() for c in ("key", "chars", "n", "least", "ends")]
        for part in range_parts(t.column("range")[0].as_py(), *columns):
            yield from part.to_batches()


def merge_paths(paths: list[dict], to: int, last: bool) -> list[dict]:
    """Parts of the paths of neighbouring ranges, in key order: nodes that are whole now, and the two paths that go on
    as those of range `to` (none if this is the last group). A whole node here names itself by mark and its parent by above."""
    nodes: list[dict] = []
    ids: list[list[int]] = []
    for path in paths:
        same = common(paths[len(ids) - 1]["key"], path["key"]) // WIDTH + 1 if ids else 0
        own = ids[-1][:same] if ids else []
        for d in range(len(own), len(path["marks"])):
            nodes.append({"depth": d, "mark": path["marks"][d], "up": own[-1] if own else None, "n": 0, "least": None, "kids": 0, "leaves": 0, "saved": 0, "chars": 0, "ends": None, "turn": path["key"][(d - 1) * WIDTH : d * WIDTH].hex() if d else None})
            own.append(len(nodes) - 1)
        ids.append(own)
        for d in range(path["start"], len(own)):
            node = nodes[own[d]]
            for x in ("n", "kids", "leaves", "saved"):
                node[x] += path[x][d]
            node["least"] = path["least"][d] if node["least"] is None else min(node["least"], path["least"][d])
            node["chars"], node["ends"] = path["chars"][d], node["ends"] or path["ends"][d]
    going = set() if last else {*ids[0], *ids[-1]}
    out = []
    for i in range(len(nodes) - 1, -1, -1):  # a node stands before its children
        node = nodes[i]
        if i in going:
            continue
        if not node["kids"]:
            node["leaves"] = 1
        node["saved"] += (node["n"] - 1) * node["chars"]
        if node["up"] is not None:
            up = nodes[node["up"]]
            up["kids"], up["leaves"], up["saved"] = up["kids"] + 1, up["leaves"] + node["leaves"], up["saved"] + node["saved"]
        out.append({
            "kind": 0, "range": to, "depth": node["depth"], "conv_id": node["least"], "n_convs": node["n"], "n_children": node["kids"], "n_leaves": node["leaves"], "saved_tokens": node["saved"], "ends_sha256": node["ends"],
            "turn_id": node["turn"], "mark": node["mark"], "above": None if node["up"] is None else nodes[node["up"]]["mark"],
        })
    if not last:
        sides = [(0, 0)] + ([(1, common(paths[0]["key"], paths[-1]["key"]) // WIDTH + 1)] if len(paths) > 1 else [])
        for side, start in sides:
            own = ids[-side]
            path = _new_path(to, side, start, paths[-side]["key"])
            for d in range(start, len(own)):
                for x in ("n", "least", "kids", "leaves", "saved", "chars", "ends"):
                    path[x][d] = nodes[own[d]][x]
            out.append(path)
    return out


def _merging(last: bool):
    merged = MERGED

    def group(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["range"], r["side"]))
        return _parts(merge_paths(rows, rows[0]["range"] // merged, last))

    return group


def prefix_trie(convs: DataFrame) -> DataFrame:
    """NODE's columns, a row for each distinct prefix of convs(conv_id, key, chars), from the root (depth 0) on.

    conv_id is the node's least member, parent_conv_id its parent's (null at the root), turn_id the last turn's id
    (null at the root). n_convs: members; n_children: children; n_leaves: childless nodes of the subtree; saved_tokens:
    over the subtree, (members - 1) x code points of the last turn; ends_sha256: of the members that end here, in order of
    their ids. Copies of a conversation are counted before they move. A conversation without turns ends at the root; an
    empty table has no nodes; conv_id is unique in convs. A key is held whole: WIDTH bytes a turn.
    """
    spark = convs.sparkSession
    keys = staged(distinct_keys(convs))
    turns, rows = keys.agg(F.sum(F.size("chars") + 1), F.count(F.lit(1))).first()
    if not rows:
        discard(keys)
        return spark.createDataFrame([], NODE)
    ranges = max(12, -(-turns // RANGE_TURNS))
    dealt = keys.repartitionByRange(ranges, "key").sortWithinPartitions("key").withColumn("range", F.spark_partition_id().cast("long"))
    parts = staged(dealt.mapInArrow(_range, PART))
    discard(keys)
    paths, merged, tables = parts.where("kind = 2"), [], [parts]
    groups = parts.agg(F.max("range")).first()[0] + 1
    while True:
        last = groups <= MERGED
        tables.append(staged(paths.groupBy(F.floor(F.col("range") / MERGED).alias("group")).applyInArrow(_merging(last), PART)))
        merged.append(tables[-1].where("kind = 0"))
        if last:
            break
        paths, groups = tables[-1].where("kind = 2"), -(-groups // MERGED)
    inner = reduce(DataFrame.union, merged)
    least = inner.select(F.col("mark").alias("_mark"), F.col("conv_id").alias("_least"))
    names = [x.split()[0] for x in NODE.split(", ")]
    with_parent = lambda df: df.withColumn("parent_conv_id", F.col("_least")).select(*names)
    # the nodes of each range's own two paths, so that a node finds its parent among its range's and not among all ranges'
    occurring = parts.where("kind = 2").select(F.col("range").alias("_range"), F.explode(F.slice("marks", F.col("start") + 1, F.size("marks"))).alias("_on"))
    occurring = occurring.join(least, F.col("_on") == F.col("_mark")).drop("_mark")
    below = parts.where("kind = 1").join(occurring, (F.col("range") == F.col("_range")) & (F.col("above") == F.col("_on")))
    nodes = parts.where("kind = 0").select(*names).union(with_parent(below)).union(with_parent(inner.join(least, F.col("above") == F.col("_mark"), "left")))
    out = staged(nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))))
    discard(*tables)
    return out


def with_shared_heads(lists: DataFrame, most: int = 5) -> DataFrame:
    """turn_lists' rows with the first h turns taken from the conversation that begins its hundred (all if that has fewer,
    none if it isn't there) and own turns after the first h; h is the unsigned crc32 of the id's digits modulo most + 1."""
    heads = lists.where(F.col("conv_id") == F.col("hundred")).select(F.col("hundred").alias("_hundred"), F.slice("turns", 1, most).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    head = F.coalesce(F.slice("_head", F.lit(1), h), F.slice("turns", 1, 0))
    return lists.join(heads, F.col("hundred") == F.col("_hundred"), "left").select("hundred", "conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nodes = prefix_trie(keyed(with_shared_heads(turn_lists(turns))))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: crc32 in SQL, from a table of 256 entries that the polynomial makes.
_CRC = """
step(n, k, c) AS (
  SELECT n, 0, n FROM range(256) AS r(n)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM step WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY n) AS t FROM step WHERE k = 8)
"""
OP11_SQL = f"""
WITH RECURSIVE {_CRC}, own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id FROM conversations WHERE conv_id IS NOT NULL
), listed AS (
  SELECT conv_id, list({{'id': id, 'chars': length(text)}} ORDER BY turn NULLS FIRST, id) AS turns FROM own GROUP BY conv_id
), hashed AS (
  SELECT conv_id, turns, xor(list_reduce(list_transform(range(0, length(conv_id::VARCHAR) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii((conv_id::VARCHAR)[i])::BIGINT END),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM listed, crc_table
), rebuilt AS (
  SELECT c.conv_id, coalesce(b.turns, [])[1:c.h] || c.turns[c.h + 1:] AS turns FROM hashed c LEFT JOIN listed b ON b.conv_id = c.conv_id - c.conv_id % 100
), prefixes AS (
  SELECT conv_id, d, len(turns) AS length, list_transform(turns[1:d], lambda t: t.id) AS path, CASE WHEN d > 0 THEN turns[d].chars ELSE 0 END AS chars
  FROM rebuilt, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)
), nodes AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = d), '')) AS ends_sha256
  FROM prefixes GROUP BY path, d
), families AS (SELECT path[1:len(path) - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(f.n, 0) AS n_children FROM nodes n LEFT JOIN families f USING (path)),
sums AS (
  SELECT path[1:a] AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM full_nodes, LATERAL (SELECT unnest(range(0, depth + 1)) AS a) GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]
"""
