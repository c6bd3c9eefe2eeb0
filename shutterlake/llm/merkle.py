"""Merkle manifest of a dataset, and inclusion proofs by multiproofs of whole leaf partitions.

Each document is a leaf. The leaves of a source, in the order of doc_id, are hashed in runs of `ARITY` up to the
source's subroot; the subroots, in the order of the sources, are hashed alike up to the root. Leaves are numbered by a
range partitioning: a leaf's number is its place in its range plus what the ranges before hold of its source, so no
source is ordered in one task.

A leaf partition is a range of about `PART` leaves. It computes the least set of node coordinates that its leaves do not
determine themselves (those beside its ends, level by level, up to the root), fetches them once by a join with the node
table, derives the interior nodes that its leaves share, and expands each leaf's own proof from them. A partition keeps
about that many digests in memory, whatever the size of a source.

Edge cases: null fields count as `-`; a null source is a source of its own before all others, and a null doc_id comes
before all others; documents with equal ids are ordered by their leaves, and repeated rows are leaves of their own;
a source of one document has that leaf as subroot, a table of one source that subroot as root; an empty table has no
root and no proofs; columns other than doc_id, source, lang, n_chars and text are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import CRC_TABLE, crc_sql, ranged, settled, small_side, table, written

ARITY = 16
PART = 20_000
#: Hexadecimal digits of a digest.
DIGITS = 64
#: Number of the tree of subroots; those of the sources count from 0 in their order.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    """The leaf of a row of documents that shows this text."""
    return F.sha2(F.concat(*[_field(F.col(c)) for c in FIELDS[:-1]], _field(text)), 256)


@dataclass(frozen=True)
class Manifest:
    """leaves: (doc_id, leaf, presented, part, tree, pos, size); nodes: (tree, level, pos, hash) below subroots and root."""

    leaves: DataFrame
    nodes: DataFrame
    root: str | None
    sources: int


def _numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Ranged leaves with the number of their tree, their place in it and its size; and the number of trees."""
    runs = settled(rows.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("place").alias("first")))
    sources = runs.groupBy("source").agg(F.min("part").alias("begins"), F.sum("n").alias("size"))
    # One row per range in the window without a partition.
    upto = Window.orderBy("begins").rowsBetween(Window.unboundedPreceding, -1)
    begun = sources.groupBy("begins").count().withColumn("trees", F.coalesce(F.sum("count").over(upto), F.lit(0))).drop("count")
    trees = settled(
        sources.join(begun, "begins")
        .withColumn("tree", F.col("trees") + F.row_number().over(Window.partitionBy("begins").orderBy("source")) - 1)
        .select(F.col("source").alias("of"), "tree", "size"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.withColumn("shift", before - F.col("first")).join(trees, F.col("source").eqNullSafe(F.col("of")))
    placed = placed.select(F.col("part").alias("in_part"), "of", "shift", "tree", "size")
    found = rows.join(placed, (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of")))
    return found.withColumn("pos", F.col("place") + F.col("shift")).drop("place", "source", "in_part", "of", "shift"), trees.count()


def _levels(size: int) -> int:
    """Levels above the leaves of a tree of so many."""
    n = 0
    while size > 1:
        size, n = -(-size // ARITY), n + 1
    return n


def _grown(nodes: DataFrame) -> list[DataFrame]:
    """(tree, level, pos, hash, size) of all levels over (tree, pos, hash, size), where size counts the tree's nodes of a level."""
    found = [nodes.select("tree", F.lit(0).alias("level"), "pos", "hash", "size")]
    most = nodes.agg(F.max("size")).first()[0] or 0
    for level in range(_levels(most)):
        runs = found[-1].where("size > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("run"), F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"))
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]), "")
        above = runs.agg(F.sha2(joined, 256).alias("hash"))
        found.append(settled(above.select("tree", F.lit(level + 1).alias("level"), F.col("run").alias("pos"), "hash", "size")))
    return found


def manifest(documents: DataFrame, presented: Column | None = None) -> Manifest:
    """The tree over the documents. `presented`: the text that someone shows for each row, whose proofs are to be checked."""
    text = F.col("text")
    other = F.lit(None).cast("string") if presented is None else F.when(~presented.eqNullSafe(text), leaf_hash(presented))
    hashed = documents.select("doc_id", "source", leaf_hash(text).alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("row"))
    rows = ranged(written(hashed, "leaves"), ["source", "doc_id", "leaf", "row"], PART, "ranged")
    numbered, sources = _numbered(rows.withColumn("presented", F.coalesce("other", "leaf")).drop("row", "other"))
    leaves = written(numbered, "numbered")
    levels = _grown(leaves.select("tree", "pos", F.col("leaf").alias("hash"), "size"))
    done = [level.where("size = 1") for level in levels]
    subroots = settled(_union(done).select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash", F.lit(sources).cast("long").alias("size")))
    top = _grown(subroots)
    root = _union([level.where("size = 1") for level in top]).first()
    return Manifest(leaves, _union(levels + top).drop("size"), root and root["hash"], sources)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _climb(size: int, known: np.ndarray):
    """Per level of a tree: the level's size, the known places, and all places of their runs."""
    while size > 1:
        runs = np.unique(known // ARITY)
        places = (runs[:, None] * ARITY + np.arange(ARITY)).reshape(-1)
        yield size, known, places[places < size]
        size, known = -(-size // ARITY), runs


def _trees(rows: pa.Table, sources: int) -> list[tuple[int, int, np.ndarray]]:
    """(tree, size, distinct places) of the leaves of a partition, the tree of subroots last."""
    trees, pos, sizes = (rows.column(c).to_numpy() for c in ("tree", "pos", "size"))
    found = []
    for tree in np.unique(trees):
        own = trees == tree
        found.append((int(tree), int(sizes[own][0]), np.unique(pos[own])))
    return [*found, (TOP, sources, np.unique(trees))]


def missing_nodes(wanted: DataFrame, sources: int) -> DataFrame:
    """(part, tree, level, pos): the least set of nodes that each partition needs besides its own leaves."""
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = [
            (tree, level, place) for tree, size, known in _trees(rows, sources)
            for level, (_, held, places) in enumerate(_climb(size, known)) for place in np.setdiff1d(places, held).tolist()
        ]
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.table({
            "part": pa.array([key[0].as_py()] * len(out), pa.int32()), "tree": pa.array(columns[0], pa.int64()),
            "level": pa.array(columns[1], pa.int32()), "pos": pa.array(columns[2], pa.int64())})

    return wanted.select("part", "tree", "pos", "size").groupBy("part").applyInArrow(run, "part int, tree long, level int, pos long")


def _hash(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def _derived(rows: pa.Table, fetched: pa.Table, sources: int) -> tuple[dict, dict, str]:
    """The subroots by tree; by (tree, level) and run the joined hashes of the run's nodes; and the root."""
    nodes: dict[tuple[int, int], dict[int, str]] = defaultdict(dict)
    for tree, level, pos, value in zip(*(fetched.column(c).to_pylist() for c in ("of", "level", "at", "hash"))):
        nodes[tree, level][pos] = value
    for tree, pos, value in zip(*(rows.column(c).to_pylist() for c in ("tree", "pos", "leaf"))):
        nodes[tree, 0][pos] = value
    runs: dict[tuple[int, int], dict[int, str]] = defaultdict(dict)

    def derive(tree: int, size: int, known: np.ndarray) -> str:
        level = 0
        for level, (width, _, places) in enumerate(_climb(size, known), 1):
            below = nodes[tree, level - 1]
            for run in np.unique(places // ARITY).tolist():
                joined = "".join([below[k] for k in range(run * ARITY, min(run * ARITY + ARITY, width))])
                runs[tree, level - 1][run], nodes[tree, level][run] = joined, _hash(joined)
        return nodes[tree, level][0]

    *own, top = _trees(rows, sources)
    for tree, size, known in own:
        nodes[TOP, 0][tree] = derive(tree, size, known)
    return nodes[TOP, 0], runs, derive(*top)


def _around(runs: dict, tree: int, pos: int, size: int):
    """Per level from a node up: the joined hashes before and after it in its run."""
    level = 0
    while size > 1:
        joined, at = runs[tree, level][pos // ARITY], pos % ARITY * DIGITS
        yield joined[:at], joined[at + DIGITS:]
        pos, size, level = pos // ARITY, -(-size // ARITY), level + 1


def proofs(tree: Manifest, wanted: DataFrame | None = None, siblings: bool = True) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of leaves of the manifest, all of them by default.

    folded_root is recomputed from the presented leaf and the proof. With `siblings` the proof itself is added: the hashes
    beside the leaf and its ancestors, level by level up to the root, left to right.
    """
    wanted = tree.leaves if wanted is None else wanted
    sources = tree.sources
    needed = small_side(settled(missing_nodes(wanted, sources)))
    fetched = tree.nodes.join(needed, ["tree", "level", "pos"]).select("part", "tree", "level", "pos", "hash").toDF("for_part", "of", "level", "at", "hash")
    extra = ", siblings array<string>" if siblings else ""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        subroots, runs, whole = _derived(rows, found, sources)
        out = defaultdict(list)
        for of, leaf, shown, pos, size in zip(*(rows.column(c).to_pylist() for c in ("tree", "leaf", "presented", "pos", "size"))):
            path = [*_around(runs, of, pos, size), *_around(runs, TOP, of, sources)]
            proof = [x for pair in path for x in pair]
            out["subroot"].append(subroots[of])
            out["proof_sha256"].append(_hash("".join(proof)))
            folded = whole
            if shown != leaf:
                folded = shown
                for left, right in path:
                    folded = _hash(left + folded + right)
            out["folded_root"].append(folded)
            if siblings:
                out["siblings"].append([x[k:k + DIGITS] for x in proof for k in range(0, len(x), DIGITS)])
        columns = {"doc_id": rows.column("doc_id"), "leaf": rows.column("leaf")} | {c: pa.array(v, pa.string()) for c, v in out.items() if c != "siblings"}
        return pa.table(columns | ({"siblings": pa.array(out["siblings"], pa.list_(pa.string()))} if siblings else {}))

    leaves = wanted.select("part", "doc_id", "leaf", "presented", "tree", "pos", "size")
    kind = leaves.schema["doc_id"].dataType.simpleString()
    found = leaves.groupBy("part").cogroup(fetched.groupBy("for_part")).applyInArrow(
        run, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string{extra}")
    root = F.lit(tree.root).cast("string")
    return found.withColumn("root", root).withColumn("verified", F.col("folded_root") == root)


def tampered(text: Column, key: Column) -> Column:
    """The text with A-Z in lower case where 5 divides the checksum of the key's digits."""
    hit = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return F.when(hit, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def op11_merkle_manifest(spark, folder: str) -> DataFrame:
    """Proofs of all rows of the `documents` table, some of them shown with tampered texts."""
    documents = table(spark, folder, "documents")
    return proofs(manifest(documents, tampered(F.col("text"), F.col("doc_id"))), siblings=False)


def oracle() -> str:
    """DuckDB SQL of op11_merkle_manifest: all levels by recursion, each proof from all nodes."""
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*(field(c) for c in FIELDS[:-1]), field(text)]) + ")"
    up = lambda name, first: f"""{name} AS ({first} UNION ALL
  SELECT tree, lvl + 1, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, n, pos // {ARITY})"""  # noqa: E731
    return rf"""
WITH RECURSIVE {CRC_TABLE},
t AS (SELECT *, CASE WHEN coalesce({crc_sql('doc_id')} % 5 = 0, false) THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS shown FROM documents, crc),
l AS (SELECT doc_id, source, {leaf('text')} AS leaf, {leaf('shown')} AS presented FROM t),
p AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
       row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
{up('low', 'SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM p')},
{up('high', 'SELECT -1 AS tree, 100 AS lvl, tree AS pos, (SELECT max(tree) + 1 FROM p) AS n, h FROM low WHERE n = 1')},
steps AS (SELECT p.doc_id, p.tree, p.pos AS leaf_pos, k.lvl, k.pos, k.h, false AS done FROM p JOIN low k USING (tree) WHERE k.pos // {ARITY} = p.pos // ({ARITY} ** (k.lvl + 1))::BIGINT AND k.n > 1
  UNION ALL SELECT p.doc_id, p.tree, p.pos, k.lvl, k.pos, k.h, false FROM p JOIN high k ON k.pos // {ARITY} = p.tree // ({ARITY} ** (k.lvl - 99))::BIGINT AND k.n > 1),
own AS (SELECT *, CASE WHEN lvl < 100 THEN leaf_pos // ({ARITY} ** lvl)::BIGINT ELSE tree // ({ARITY} ** (lvl - 100))::BIGINT END AS here FROM steps),
proof AS (SELECT tree, leaf_pos, sha256(coalesce(string_agg(h, '' ORDER BY lvl, pos) FILTER (pos <> here), '')) AS proof_sha256 FROM own GROUP BY ALL),
sides AS (SELECT *, row_number() OVER (PARTITION BY tree, leaf_pos ORDER BY lvl) AS step FROM (SELECT tree, leaf_pos, lvl, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < here), '') AS lo, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > here), '') AS hi FROM own GROUP BY ALL)),
fold AS (SELECT tree, pos, 0 AS step, presented AS h FROM p UNION ALL
  SELECT f.tree, f.pos, s.step, sha256(s.lo || f.h || s.hi) FROM fold f JOIN sides s ON s.tree = f.tree AND s.leaf_pos = f.pos AND s.step = f.step + 1),
last AS (SELECT tree, pos, arg_max(h, step) AS folded_root FROM fold GROUP BY ALL)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, last.folded_root, last.folded_root = r.h AS verified
FROM p JOIN low s ON s.tree = p.tree AND s.n = 1 JOIN high r ON r.n = 1 JOIN last ON last.tree = p.tree AND last.pos = p.pos
  LEFT JOIN proof q ON q.tree = p.tree AND q.leaf_pos = p.pos
"""
