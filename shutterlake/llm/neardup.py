"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of its five-word shingles: sublinear term frequency times inverse document frequency. The
documents of a shingle are counted in a table of fixed size, indexed by the shingle's hash, over all distinct texts; a
frequency saturates at one tenth of the texts, so ordinary shingles weigh alike and only those in a large part of the
collection weigh less. Improved consistent weighted sampling draws `SAMPLES` samples per text, each of which two
texts share with a probability equal to their weighted Jaccard similarity. Bands of samples, with the text's total
weight in steps of the threshold, are the bucket keys; candidates are verified by the exact weighted Jaccard
similarity and joined to classes (see cluster). 12 bands of 4 find a pair of similarity 0.8 with probability 0.998.

Copies of one text are one item throughout. Texts of two to four words are one shingle.

Edge cases: a null text or one without words is a class of its own; a null doc_id counts as larger than any other, and a
class of null ids only has a null class_id; repeated rows are in one class, and `keep_one` keeps one row of
them; an empty table gives an empty result; columns other than doc_id and text are not read and are kept by `keep_one`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.cluster import similar_classes
from shutterlake.llm.common import settled, slices, small_side, table

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
CELLS = 1 << 16
COMMON_SHARE = 0.1

_WORD = re.compile(r"\w+")
#: The code points below 256 that are not part of words, as blanks.
_LATIN = bytes(c if _WORD.match(chr(c)) else 0x20 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well mixing bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Vocabulary(dict):
    """Hash of each word, given as text or in Latin-1, kept while there are few enough of them."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest((word if isinstance(word, str) else word.decode("latin-1")).encode())
        return value


def words_of(text: str) -> list[str] | list[bytes]:
    """The words of a text in lower case; in Latin-1 where that can tell them, which is several times faster."""
    lower = text.lower()
    try:
        return lower.encode("latin-1").translate(_LATIN).split()
    except UnicodeEncodeError:
        return _WORD.findall(lower)


def word_hashes(text: str, vocabulary: Vocabulary) -> np.ndarray:
    """Hash of each word of a text in order."""
    words = words_of(text)
    return np.fromiter(map(vocabulary.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(text: str, vocabulary: Vocabulary, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of a text, sorted, and how often each occurs."""
    return np.unique(shingle_hashes(word_hashes(text, vocabulary), size), return_counts=True)


def shingle_hashes(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of `size` words in order; a shorter text is one run."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    rolled = np.zeros(len(hashes) - size + 1, dtype=np.uint64)
    for k in range(size):
        rolled = rolled * _MULTIPLIER + hashes[k:len(hashes) - size + 1 + k]
    return mix(rolled)


def _quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of CELLS equal parts."""
    p = (np.arange(CELLS) + 0.5) / CELLS
    low, high = np.zeros(CELLS), np.full(CELLS, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


class Sampler:
    """Improved consistent weighted sampling with draws looked up by the hash of shingle and sample number.

    A draw is (r, beta, c): r and beta are one cell of a table of pairs, c a cell of another. Most shingles of a text
    have the weight `usual`, for which the part of the formula that depends on r and beta is tabulated too.
    """

    def __init__(self, usual: float, samples: int = SAMPLES):
        gamma = _quantiles()
        self.log_c = np.log(gamma).astype(np.float32)
        self.r = gamma[np.argsort(mix(np.arange(CELLS, dtype=np.uint64)), kind="stable")].astype(np.float32)
        self.beta = ((np.arange(CELLS) + 0.5) / CELLS).astype(np.float32)
        self.usual = np.float32(usual)
        self.level, self.part = self._parts(np.float32(np.log(self.usual)), slice(None))
        seeds = mix(np.arange(1, 2 * samples + 1, dtype=np.uint64) * _MULTIPLIER)
        self.seeds, self.factors = seeds[:samples, None], seeds[samples:, None] | np.uint64(1)

    def _parts(self, log_weight, cells) -> tuple[np.ndarray, np.ndarray]:
        r, beta = self.r[cells], self.beta[cells]
        level = np.floor(log_weight / r + beta)
        return level, r * (level - beta + 1)

    def sample(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit value per sample."""
        best = np.full(len(self.seeds), np.inf, dtype=np.float32)
        out = np.zeros(len(self.seeds), dtype=np.uint64)
        rows = np.arange(len(self.seeds))
        for at in range(0, len(hashes), 4096):  # very long texts in pieces
            h, w = hashes[at:at + 4096], weights[at:at + 4096].astype(np.float32)
            u = ((h ^ self.seeds) * self.factors).view(np.uint16).reshape(len(rows), len(h), 4)
            pair, c = u[:, :, 2], u[:, :, 3]
            a = self.log_c.take(c, mode="clip")  # no index is out of bounds; this saves the check
            a -= self.part.take(pair, mode="clip")
            odd = np.flatnonzero(w != self.usual)
            if len(odd):
                a[:, odd] = self.log_c.take(c[:, odd]) - self._parts(np.log(w[odd])[None, :], pair[:, odd])[1]
            k = a.argmin(axis=1)
            value = a[rows, k]
            level = np.floor(np.log(w[k]) / self.r[pair[rows, k]] + self.beta[pair[rows, k]])
            better = value < best
            best = np.where(better, value, best)
            out = np.where(better, mix(h[k] ^ (level.astype(np.int64).view(np.uint64) * _MULTIPLIER)), out)
        return out


def band_keys(samples: np.ndarray, bands: int, rows: int, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Bucket keys of each row of samples: each band with the steps of size below and above, of which true pairs share one."""
    by_band = samples.reshape(len(samples), bands, rows)
    keys = np.zeros((len(samples), bands), dtype=np.uint64)
    for k in range(rows):
        keys = mix(keys * _MULTIPLIER + by_band[:, :, k])
    keys = mix(keys ^ np.arange(bands, dtype=np.uint64))
    step = np.floor(np.log(np.maximum(sizes, 1e-9)) / -np.log(threshold)).astype(np.int64) + 1000
    steps = np.stack([step, step + 1], axis=1).astype(np.uint64) * _MULTIPLIER
    return mix(keys[:, None, :] ^ steps[:, :, None]).reshape(len(samples), 2 * bands)


def weights(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of shingles."""
    return (1 + np.log(counts)) * idf[(hashes & np.uint64(len(idf) - 1)).astype(np.int64)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted weighted sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)) if len(i) else 0.0


def distinct_texts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, text) of one row per distinct text that has a word, and (id, first, copies) of all of them."""
    keyed = documents.select("doc_id", "text").where(F.col("text").rlike(r"(?U)\w")).withColumn("id", F.unhex(F.md5("text")))
    groups = keyed.groupBy("id").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    groups = settled(groups)
    doubled = small_side(groups.where("copies > 1").select("id", "first", F.lit(True).alias("doubled")))
    # Rows that repeat doc_id and text both stay; later steps take them as one item.
    texts = keyed.join(doubled, "id", "left").where(F.col("doubled").isNull() | F.col("doc_id").eqNullSafe(F.col("first")))
    return texts.select("id", "text"), groups


def document_frequency(texts: DataFrame, n: int) -> np.ndarray:
    """Inverse document frequency by cell: one count per cell leaves each task, whatever the task reads."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, vocabulary = np.zeros(CELLS, dtype=np.int64), Vocabulary()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                cells = np.sort((shingle_hashes(word_hashes(text, vocabulary)) & np.uint64(CELLS - 1)).astype(np.uint16))
                sums[cells[np.diff(cells, prepend=-1) != 0]] += 1
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(sums[used])], names=["cell", "n"])

    rows = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    sums = np.zeros(CELLS)
    for cell, m in rows.collect():  # at most CELLS rows, whatever the input
        sums[cell] = m
    share = np.clip(sums / max(n, 1), COMMON_SHARE, 0.5)
    return -np.log(share)


def sketches(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(id, size, sketch, bands): total weight, the low bits of the samples, and the bucket keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, vocabulary = Sampler(float(idf.max())), Vocabulary()
        for batch in slices(batches):
            sizes, drawn = np.zeros(batch.num_rows), np.zeros((batch.num_rows, SAMPLES), dtype=np.uint64)
            has = np.zeros(batch.num_rows, dtype=bool)
            for row, text in enumerate(batch.column("text").to_pylist()):
                found, counts = shingles(text, vocabulary)
                if len(found):
                    w = weights(found, counts, idf)
                    sizes[row], drawn[row], has[row] = w.sum(), sampler.sample(found, w), True
            keys = band_keys(drawn, BANDS, ROWS, sizes, THRESHOLD).view(np.int64)
            shorts = (drawn & np.uint64(0x7FFF)).astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.float32()), _lists(shorts, has, pa.int16()), _lists(keys, has, pa.int64())],
                names=["id", "size", "sketch", "bands"],
            )

    return texts.mapInArrow(run, "id binary, size float, sketch array<short>, bands array<bigint>")


def _lists(rows: np.ndarray, has: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows as lists, those without any content as empty ones."""
    offsets = np.concatenate([[0], np.cumsum(has * rows.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[has].reshape(-1), kind))


def verifier(texts: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD):
    """A function that keeps the pairs (a, b) of ids whose texts reach the exact similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        recent: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

        def item(key: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            if key not in recent:
                if len(recent) > 500:
                    recent.clear()
                found, counts = shingles(text, vocabulary)
                recent[key] = found, weights(found, counts, idf)
            return recent[key]

        for batch in slices(batches):
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            near = [k for k in range(len(a)) if similarity(item(a[k], ta[k]), item(b[k], tb[k])) >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in near], pa.binary()), pa.array([b[k] for k in near], pa.binary())], names=["a", "b"])

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")

    return verify


def listing(texts: DataFrame, idf: np.ndarray):
    """A function that lists the weighted shingles (id, element, weight, total) of the texts with given ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in slices(batches):
            found = [shingles(text, vocabulary) for text in batch.column("text").to_pylist()]
            held = [weights(h, c, idf) for h, c in found]
            counts = np.array([len(h) for h, _ in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(np.concatenate([h for h, _ in found]).view(np.int64)),
                 pa.array(np.concatenate(held)), pa.array(np.repeat([w.sum() for w in held], counts))],
                names=["id", "element", "weight", "total"],
            )

    def contents(ids: DataFrame) -> DataFrame:
        return texts.join(small_side(ids), "id", "left_semi").select("id", "text").mapInArrow(run, "id binary, element long, weight double, total double")

    return contents


def classes(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, class_id, class_size, representatives, root) of every distinct text with words; id is the text's digest."""
    texts, groups = distinct_texts(documents)
    idf = document_frequency(texts, groups.count())
    drawn = settled(sketches(texts, idf).dropDuplicates(["id"]))
    # Only texts that share a bucket are ever compared; they are settled once for all rounds.
    bands = drawn.select("id", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).where("n > 1")
    in_two = shared.select(F.col("low").alias("id")).union(shared.select(F.col("high").alias("id")))
    in_more = bands.join(shared.where("n > 2").select("band"), "band", "left_semi").select("id")
    needed = small_side(settled(in_two.union(in_more).distinct()))
    compared = settled(texts.join(needed, "id", "left_semi").dropDuplicates(["id"]))
    found = similar_classes(drawn.join(needed, "id", "left_semi"), verifier(compared, idf, threshold), listing(compared, idf), threshold)
    rooted = groups.join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sums = rooted.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    return rooted.select("id", "root").join(sums, "root")


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of documents: class_id (the smallest doc_id of the class), class_size, and whether it is that document."""
    keyed = documents.select("doc_id", F.when(F.col("text").rlike(r"(?U)\w"), F.unhex(F.md5("text"))).alias("id"))
    found = classes(documents, threshold).select("id", "class_id", "class_size")
    out = keyed.join(found, "id", "left")
    return out.select(
        "doc_id", F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (F.col("id").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def keep_one(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that with the smallest doc_id, with the columns as given."""
    names = documents.columns
    found = settled(classes(documents, threshold))
    keyed = documents.select(
        F.struct(*[documents[c] for c in names]).alias("row"), F.col("doc_id").alias("own"),
        F.when(F.col("text").rlike(r"(?U)\w"), F.unhex(F.md5("text"))).alias("id"),
    )
    kept = keyed.join(found, "id", "left").where(F.col("id").isNull() | F.col("own").eqNullSafe(F.col("class_id")))
    # A class whose smallest id stands on several rows still keeps one of them.
    heads = documents.select("doc_id", F.unhex(F.md5("text")).alias("id")).join(found, "id").where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    doubled = small_side(settled(heads.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root", F.lit(True).alias("doubled"))))
    marked = kept.join(doubled, "root", "left")
    out = marked.where("doubled is null").unionByName(marked.where("doubled").dropDuplicates(["root"]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names])


def op7_near_duplicates(spark, folder: str) -> DataFrame:
    """Near-duplicate classes of the whole `documents` table."""
    return near_duplicates(table(spark, folder, "documents"))
