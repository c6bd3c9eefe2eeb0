"""Prefix trie of conversations by a splitter skeleton.

A conversation is a path of turns, each named by the digest of role and text. Paths are sorted by a range partitioning
into shards, so the members of a node are neighbours. The last path of a shard and the first of the next one are the
splitters: only a node on what both share can have members in two shards. The trie of the splitters, kept as the number of
turns that each shard shares with the shards before and after it (two numbers a shard), is broadcast. A pass over each
sorted shard then finishes all other nodes with a stack of the open ones; of the skeleton nodes it emits partial
aggregates. These are combined by reduction and completed in one pass over the skeleton in path order, whose rows are a
shard's splitter turns at most.

Copies of one conversation are sorted by conv_id too, so they may fill many shards; their nodes are skeleton nodes. The
digest of the conversations that end in a node runs over their ids in sorted order and never holds them.

Turns are ordered by number (null first), then by digest. A path holds a digest and a length per turn, and is the only
thing that is gathered of a conversation: its texts are not. A shard's pass keeps the open nodes and the rows below
nodes that are still open, which the shard's size bounds.

Edge cases: null roles and texts are empty; a conversation of null id is one conversation, takes no turns from another,
counts as a member and is not named; repeated rows are turns of their own; a conversation that keeps no turn is a member of
the root; an empty table has no nodes; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import CRC_TABLE, crc_sql, ranged, settled, small_side, table, written

#: Conversations to a shard.
SHARD = 20_000
#: Turns a conversation takes from its family's first one at most, and the size of a family.
TAKEN, FAMILY = 6, 100
#: Digits of a turn's digest in a path.
DIGITS = 32
#: Result columns of a node.
MEASURES = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
#: Rows of a batch that the passes return.
BATCH = 10_000


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array of (token, size)) of the conversations as they are."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    # The length keeps role and text apart.
    token = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.select("conv_id", F.struct("turn", token.alias("token"), F.char_length(text).alias("size")).alias("t"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.transform("t", lambda t: F.struct(t["token"].alias("token"), t["size"].alias("size"))).alias("turns"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Paths whose first turns come from the first conversation of their family of 100."""
    own = settled(own)
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, TAKEN).alias("head"))
    taken = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN, F.lit(0)).cast("int")
    joined = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", taken).join(heads, "family", "left")
    none = F.slice("turns", 1, 0)
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _shared(a: str, b: str) -> int:
    """Turns that two paths share from the start."""
    n = min(len(a), len(b)) // DIGITS
    return next((k for k in range(n) if a[k * DIGITS:(k + 1) * DIGITS] != b[k * DIGITS:(k + 1) * DIGITS]), n)


def _splitters(rows: DataFrame) -> DataFrame:
    """(part, left, right): how many turns a shard's first and last path share with its neighbours; -1 beside none."""
    ends = settled(rows.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last")))
    by_part = Window.orderBy("part")  # one row per shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, first, last, before, after = (batch.column(k).to_pylist() for k in range(5))
            left = [-1 if b is None else _shared(b, f) for b, f in zip(before, first)]
            right = [-1 if a is None else _shared(x, a) for a, x in zip(after, last)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=["part", "left", "right"])

    both = ends.select("part", "first", "last", F.lag("last").over(by_part).alias("before"), F.lead("first").over(by_part).alias("after"))
    return settled(both.mapInArrow(run, "part int, left int, right int"))


class _Node:
    """An open node: its aggregates over the rows seen so far."""

    __slots__ = ("children", "convs", "depth", "ends", "first", "key", "leaves", "left", "pending", "saved", "size")

    def __init__(self, depth: int, key: bytes, size: int, left: bool):
        self.depth, self.key, self.size, self.left = depth, key, size, left
        self.first, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.pending = None, []


#: A pass returns finished nodes, partial aggregates of skeleton nodes, and the members that end in those.
FINISHED, PARTIAL, END = 0, 1, 2
NODE_SCHEMA = (
    "kind int, part int, key binary, parent binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, size long, ends_sha256 string"
)
_FIELDS = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("size", pa.int64()), ("ends_sha256", pa.string()),
])
_EMPTY = hashlib.sha256(b"").hexdigest()


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class _Shard:
    """The pass over one sorted shard: rows go in, node rows come out through `out`."""

    def __init__(self, part: int, left: int, right: int, out: list[tuple]):
        self.part, self.left, self.right, self.out = part, left, right, out
        self.stack: list[_Node] = []
        self.path: str | None = None

    def add(self, conv: int | None, path: str, sizes: list[int]) -> None:
        shared = -1 if self.path is None else _shared(self.path, path)
        self._close(shared)
        first = self.path is None
        for depth in range(len(self.stack), len(sizes) + 1):
            above = self.stack[-1].key if self.stack else b""
            key = hashlib.md5(above + path[(depth - 1) * DIGITS:depth * DIGITS].encode()).digest() if depth else b""
            self.stack.append(_Node(depth, key, sizes[depth - 1] if depth else 0, first and depth <= self.left))
        for node in self.stack:
            node.convs += 1
            node.first = _least(node.first, conv)
        self.path = path
        if conv is not None:
            self._end(self.stack[-1], conv)

    def _end(self, node: _Node, conv: int) -> None:
        if node.ends is None:
            node.ends = hashlib.sha256(str(conv).encode())
        else:
            node.ends.update(b",%d" % conv)
        # Whether the node reaches into the next shard is only known at the end of this one.
        self.out.append((END, self.part, node.key, None, node.depth, conv, *[None] * 7))

    def _close(self, depth: int, last: int = -1) -> None:
        """Close the open nodes below a depth; those on the last path down to depth `last` go on in the next shard."""
        while self.stack and self.stack[-1].depth > depth:
            node = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            partial = node.left or node.depth <= last
            if partial:
                for row in node.pending:  # their parent is known after the reduction only
                    self.out.append((FINISHED, self.part, None, node.key, *row))
                values = (node.first, None, node.convs, node.children, node.leaves, node.saved, node.size, None)
                self.out.append((PARTIAL, self.part, node.key, above and above.key, node.depth, *values))
                if above:  # what is not of the skeleton counts for all above
                    above.leaves += node.leaves
                    above.saved += node.saved
                continue
            for row in node.pending:
                self.out.append((FINISHED, self.part, None, None, row[0], row[1], node.first, *row[3:]))
            leaves, saved = node.leaves if node.children else 1, node.saved + (node.convs - 1) * node.size
            row = (node.depth, node.first, None, node.convs, node.children, leaves, saved, None, node.ends.hexdigest() if node.ends else _EMPTY)
            if above:
                above.children += 1
                above.leaves += leaves
                above.saved += saved
                above.pending.append(row)
            else:
                self.out.append((FINISHED, self.part, None, None, *row))

    def close(self) -> None:
        self._close(-1, self.right)


def _batches(rows: list[tuple], least: int) -> Iterator[pa.RecordBatch]:
    """Takes rows off a list while there are enough for a batch."""
    while len(rows) >= least and rows:
        take, rows[:BATCH] = rows[:BATCH], []
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*take), _FIELDS)], schema=_FIELDS)


def _shard_pass(sorted_rows: DataFrame) -> DataFrame:
    """Node rows of rows (part, left, right, path, sizes, conv_id) that lie shard by shard in path order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        shard = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                columns = (batch.slice(at, 1000).column(c).to_pylist() for c in ("part", "left", "right", "path", "sizes", "conv_id"))
                for part, left, right, path, sizes, conv in zip(*columns):
                    if shard is None or shard.part != part:
                        if shard:
                            shard.close()
                        shard = _Shard(part, left, right, out)
                    shard.add(conv, path, sizes)
                    yield from _batches(out, BATCH)
        if shard:
            shard.close()
        yield from _batches(out, 1)

    return sorted_rows.select("part", "left", "right", "path", "sizes", "conv_id").mapInArrow(run, NODE_SCHEMA)


def _digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of ids (key, conv_id): each key's ids in order, one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found = None, None
        for batch in batches:
            keys, values = [], []
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if k != key:
                    if found:
                        keys.append(key)
                        values.append(found.hexdigest())
                    key, found = k, hashlib.sha256(str(conv).encode())
                else:
                    found.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.string())], names=["key", "ends_sha256"])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([found.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return ends.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends_sha256 string")


def _completed(skeleton: DataFrame) -> DataFrame:
    """Skeleton rows (part, depth, ...) in path order with their subtrees' sums and their parents, by one pass with a stack.

    A node that is new in a shard lies on its last path, so (part, depth) orders the skeleton by path.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[dict] = []
        out: list[tuple] = []

        def close(depth: int) -> None:
            while stack and stack[-1]["depth"] >= depth:
                node, above = stack.pop(), stack[-1] if stack else None
                leaves = node["own_leaves"] + (node["n_children"] == 0)
                saved = node["own_saved"] + (node["n_convs"] - 1) * node["size"]
                if above:
                    above["own_leaves"] += leaves
                    above["own_saved"] += saved
                # What other shards found below a node is in its sums already, and in those of all above it.
                out.append((FINISHED, node["part"], node["key"], None, node["depth"], node["conv_id"], node["above"], node["n_convs"], node["n_children"],
                            node["n_leaves"] + leaves, node["saved_tokens"] + saved, None, node["ends_sha256"]))

        for batch in batches:
            for row in batch.to_pylist():
                close(row["depth"])
                row |= {"own_leaves": 0, "own_saved": 0, "above": stack[-1]["conv_id"] if stack else None}
                if stack:
                    stack[-1]["n_children"] += 1
                stack.append(row)
            yield from _batches(out, BATCH)
        close(-1)
        yield from _batches(out, 1)

    return skeleton.repartition(1).sortWithinPartitions("part", "depth").mapInArrow(run, NODE_SCHEMA)


def nodes(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie over paths (conv_id, turns): conv_id, depth, parent_conv_id, MEASURES, ends_sha256."""
    token = F.array_join(F.transform("turns", lambda t: t["token"]), "")
    flat = written(conversations.select("conv_id", token.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "paths")
    rows = ranged(flat, ["path", "conv_id"], SHARD, "shards")
    splitters = small_side(_splitters(rows))
    shards = rows.drop("place").join(splitters, "part").repartition("part").sortWithinPartitions("part", "path", "conv_id")
    found = written(_shard_pass(shards), "nodes")
    partial = found.where(F.col("kind") == PARTIAL)
    reduced = settled(partial.groupBy("key").agg(
        F.min("part").alias("part"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in MEASURES], F.min("size").alias("size")))
    keys = small_side(settled(reduced.select("key")))
    ends = _digests(found.where(F.col("kind") == END).select("key", "conv_id").join(keys, "key", "left_semi"))
    skeleton = settled(_completed(reduced.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))))
    result = ["conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", *MEASURES, "ends_sha256"]
    heads = small_side(settled(skeleton.select(F.col("key").alias("parent"), F.col("conv_id").alias("head"))))
    local = found.where(F.col("kind") == FINISHED)
    below = local.where("parent is not null").drop("parent_conv_id").join(heads, "parent").withColumnRenamed("head", "parent_conv_id")
    return local.where("parent is null").select(*result).unionByName(below.select(*result)).unionByName(skeleton.select(*result))


def op13_prefix_trie(spark, folder: str) -> DataFrame:
    """The trie over all rebuilt conversations of the `conversations` table."""
    return nodes(rebuilt(paths(table(spark, folder, "conversations"))))


def oracle() -> str:
    """DuckDB SQL of op13_prefix_trie: every prefix as a list, subtrees by comparing lists."""
    return rf"""
WITH {CRC_TABLE},
o AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t FROM conversations GROUP BY conv_id),
h AS (SELECT o.*, {crc_sql('conv_id')} % {TAKEN} AS h FROM o, crc),
r AS (SELECT h.conv_id, coalesce(b.t, [])[1:h.h::INT] || h.t[h.h::INT + 1:] AS path FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % {FAMILY}),
m AS (SELECT conv_id, len(path) AS n, d, path[1:d] AS node FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM r)),
g AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY ALL),
k AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
c AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN g.d > 0 THEN (n_convs - 1) * length(g.node[g.d].text) ELSE 0 END AS saved FROM g LEFT JOIN k USING (node, d)),
up AS (SELECT node[1:e] AS node, e AS d, n_children, saved FROM (SELECT *, unnest(range(d + 1)) AS e FROM c)),
s AS (SELECT node, d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY ALL)
SELECT c.conv_id, c.d::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM c JOIN s USING (node, d) LEFT JOIN g p ON c.d > 0 AND p.d = c.d - 1 AND p.node = c.node[1:c.d - 1]
"""
