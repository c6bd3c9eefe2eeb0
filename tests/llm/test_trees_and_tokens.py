"""Merkle proofs, token ids and the conversation trie against plain versions."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from shutterlake.llm import bpe, merkle, trie
from tests.conftest import DATA
from tests.llm.test_edges import DOCUMENTS, ROWS
from tests.test_registered_queries import table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """All levels of a list of digests."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_proof(levels, pos):
    out = []
    for level in levels[:-1]:
        run = level[pos // 16 * 16:pos // 16 * 16 + 16]
        out += run[:pos % 16], run[pos % 16 + 1:]
        pos //= 16
    return out


def plain_proofs(rows):
    """Per row (doc_id, text, lang, source, n_chars): doc_id, leaf, subroot, root, siblings, folded root after tampering."""
    def leaf(row, text):
        values = (row[0], row[3], row[2], row[4], text)
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tampered(row):
        if row[0] is None or row[1] is None or zlib.crc32(str(row[0]).encode()) % 5:
            return row[1]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])

    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append((row[0], leaf(row, row[1]), leaf(row, tampered(row))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[1] for x in sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for pos, (doc, own, shown) in enumerate(sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))):
            parts = plain_proof(trees[s], pos) + plain_proof(top, k)
            folded = shown
            for left, right in zip(parts[::2], parts[1::2]):
                folded = sha("".join(left) + folded + "".join(right))
            out.append((doc, own, trees[s][-1][0], top[-1][0], [x for p in parts for x in p], folded))
    return out


@pytest.mark.parametrize("part", [7, 64, 100_000])
def test_proofs_match_plain_version(spark, monkeypatch, part):
    monkeypatch.setattr(merkle, "PART", part)
    rng = random.Random(part)
    rows = [*ROWS, *[(k, f"Text {k}" if k % 7 else None, "en", "hot", k) for k in range(600)], *[(k, "T", None, f"s{rng.randrange(40)}", None) for k in range(200)]]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    tree = merkle.manifest(docs, merkle.tampered(F.col("text"), F.col("doc_id")))
    got = sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["siblings"], r["folded_root"]) for r in merkle.proofs(tree).collect()), key=repr)
    expected = sorted(plain_proofs(rows), key=repr)
    assert got == expected
    assert sum(x[5] != x[3] for x in expected) > 50
    digests = {(r["doc_id"], r["leaf"]): (r["proof_sha256"], r["verified"]) for r in merkle.proofs(tree, siblings=False).collect()}
    assert all(digests[x[0], x[1]][1] == (x[5] == x[3]) for x in expected)
    assert {digests[x[0], x[1]][0] for x in expected} <= {sha("".join(x[4])) for x in expected}


def test_a_partition_fetches_what_it_cannot_derive(spark):
    rows = [(k, "x", "en", "hot" if k % 3 else "cold", 1) for k in range(3000)]
    tree = merkle.manifest(spark.createDataFrame(rows, DOCUMENTS))
    some = tree.leaves.where("doc_id % 500 = 7 or doc_id between 100 and 130")
    fetched = {tuple(r) for r in merkle.missing_nodes(some, tree.sources).drop("part").collect()}
    known = {(r["tree"], r["pos"]) for r in some.collect()}
    sizes = {r["tree"]: r["size"] for r in tree.leaves.select("tree", "size").distinct().collect()}
    needed = set()
    for t, size in [*sizes.items(), (merkle.TOP, tree.sources)]:
        held = {p for u, p in known if u == t} if t != merkle.TOP else {u for u, _ in known}
        level = 0
        while size > 1 and held:
            needed |= {(t, level, p) for r in {p // 16 for p in held} for p in range(r * 16, min(r * 16 + 16, size)) if p not in held}
            held, size, level = {p // 16 for p in held}, -(-size // 16), level + 1
    assert fetched == needed
    everything = {(r["doc_id"], r["proof_sha256"]) for r in merkle.proofs(tree, siblings=False).collect()}
    alone = merkle.proofs(tree, some, siblings=False).collect()
    assert len(alone) == some.count() and {(r["doc_id"], r["proof_sha256"]) for r in alone} <= everything and all(r["verified"] for r in alone)


def test_one_leaf_is_its_own_root(spark):
    row = merkle.proofs(merkle.manifest(spark.createDataFrame([(1, "x", None, "s", 1)], DOCUMENTS))).collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] == sha("1:11:s-1:11:x") and row["siblings"] == [] and row["proof_sha256"] == sha("") and row["verified"]


def plain_encoding():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as file:
        return bpe.Codec(file.read())


def test_tokens_match_the_library(spark):
    plain = plain_encoding()
    rows = {r["doc_id"]: r for r in bpe.op12_byte_bpe(spark, DATA).collect()}
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc, text in texts:
        ids = plain.encode_ordinary(text or "")
        assert tuple(rows[doc]) == (doc, len(ids), sha(",".join(map(str, ids))), sha(text or ""))


@pytest.mark.parametrize("alphabet", [
    ["a", "Z", "9", "'s", " ", "  ", "\n", "é", "漢字", "。", "，", ".", "!", "'", "\t", "\x1c", "🙂", "'re", " ", "3a", "ℵ", "ٳ", "<|endoftext|>"],
    [" ", "\n", " " * 6, "\t" * 9, "a", "9 ", "'s", "　"],
])
def test_long_texts_are_split_where_matches_end(codec, monkeypatch, alphabet):
    plain, rng = plain_encoding(), random.Random(3)
    monkeypatch.setattr(bpe, "LONG", 15)
    monkeypatch.setattr(bpe, "RUN", 5)
    monkeypatch.setattr(bpe, "_RUN", regex.compile(r"\s{5,}"))
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 150)))
        ids = codec.encode(text)
        assert ids.tolist() == plain.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_white_space_that_overflows_the_matcher(codec):
    text = "a" + " " * 1_200_000 + "b" + "\n" * 300_000
    ids = codec.encode(text)
    assert codec.decode(ids) == text.encode() and ids[0] == codec.encode("a")[0]
    short = "a" + " " * 20_000 + "b" + "\n" * 12_000
    assert codec.encode(short).tolist() == plain_encoding().encode_ordinary(short)


def test_white_space_is_the_same_to_both_matchers():
    """A text is only split where both agree: at white space, which Unicode has not extended."""
    signs = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    encoding = tiktoken.Encoding("bytes", pat_str=r"\s", mergeable_ranks={bytes([k]): k for k in range(256)}, special_tokens={})
    assert encoding.decode(encoding.encode_ordinary(signs)) == "".join(regex.findall(r"\s", signs))


def test_decoding_gives_raw_bytes(spark, codec):
    first = [int(x) for x in codec.encode("é")]
    cut = [k for k in range(256) if codec.decode(np.array([k])) == b"\xc3"]
    df = spark.createDataFrame([(1, cut), (2, first), (3, []), (4, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: (bytes(r["bytes"]), r["ids_sha256"]) for r in bpe.decode(df).collect()}
    assert got == {1: (b"\xc3", sha(str(cut[0]))), 2: ("é".encode(), sha(",".join(map(str, first)))), 3: (b"", sha("")), 4: (b"", sha(""))}


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = []
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6 if conv is not None else 0
        head = own.get(conv - conv % 100, []) if conv is not None else []
        paths.append((conv, (*head[:h], *turns[h:])))
    members, ends = defaultdict(list), defaultdict(list)
    for conv, path in paths:
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
        ends[path].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    least = lambda node: min((c for c in members[node] if c is not None), default=None)
    out = []
    for node in members:
        below = [n for n in members if n[:len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ids = ",".join(map(str, sorted(c for c in ends[node] if c is not None)))
        out.append((least(node), len(node), least(node[:-1]) if node else None, len(members[node]), len(children[node]), sum(not children[n] for n in below), saved, sha(ids)))
    return out


def made_conversations(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", None]), rng.choice(["a", "bb", "Übung", None])) for c in range(90) for t in range(rng.randint(1, 5))]
    rows += [(1000 + c, t, "user", f"same {t}") for c in range(60) for t in range(4)]  # copies fill many shards
    rows += [(1000 + c, 9, "user", "and then") for c in range(0, 60, 3)] + [(5000, t, "user", f"long {t}") for t in range(300)]
    rows += [(None, t, "user", "same 0") for t in range(3)] + [(299, 0, "user", "gone"), (7, None, "user", "no number"), (7, None, None, None), (8, 0, "user", "twice"), (8, 0, "user", "twice")]
    return rows


@pytest.mark.parametrize("shard", [1, 4, 25, 100_000])
def test_trie_matches_plain_version(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD", shard)
    rows = [r for r in made_conversations(shard) if r[1] is not None or r[0] != 7]
    got = trie.nodes(trie.rebuilt(trie.paths(spark.createDataFrame(rows, CONVERSATIONS).repartition(6))))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain_trie(rows)))


def test_trie_on_edge_rows(spark):
    df = spark.createDataFrame(made_conversations(1), CONVERSATIONS)
    build = lambda d: trie.nodes(trie.rebuilt(trie.paths(d)))
    plain = build(df)
    clashing = df.withColumns({c: F.lit("own") for c in ("path", "part", "place", "turns", "key", "family", "h", "size", "token", "depth", "kind")})
    assert sorted(map(repr, build(clashing).collect())) == sorted(map(repr, plain.collect()))
    assert build(df.limit(0)).collect() == []
    root = [r for r in plain.collect() if r["depth"] == 0]
    assert len(root) == 1 and root[0]["n_convs"] == df.select(F.coalesce("conv_id", F.lit(-1))).distinct().count() and root[0]["parent_conv_id"] is None
    turnless = build(spark.createDataFrame([(101, 0, "user", "x")], CONVERSATIONS))  # takes 4 turns of nothing
    assert [tuple(r)[:6] for r in turnless.collect()] == [(101, 0, None, 1, 0, 1)] and zlib.crc32(b"101") % 6 > 0


def test_trie_of_given_conversations_in_small_shards(spark, duck, monkeypatch):
    monkeypatch.setattr(trie, "SHARD", 3)
    df = trie.op13_prefix_trie(spark, DATA)
    result = duck.execute(trie.oracle())
    assert table(df.columns, df.collect()) == table([c[0] for c in result.description], result.fetchall())
