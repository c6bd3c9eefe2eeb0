"""Toxicity severity by cumulative-link ordinal regression.

Grades are ordered: 0 is not toxic; toxic documents are graded 1 to 3 by the thirds of the density of indicative words,
since labels only say toxic or not. The model is P(grade <= k) = logistic(threshold_k - w.x) with one weight vector w for
all ordered thresholds. x holds sparse text features: the words and word beginnings of four and five letters
that are indicative of the label by support, ratio and likelihood, as log(1 + count), and their density; copies of
one document count once for that. The result of a document is its expected severity, the sum over k of P(grade >= k).

Fitting uses a bounded sample: labelled documents are drawn by a hash of their id so that about `sample` of each class
are expected, and weighted back to their share. Scoring reads every word of every document in one pass without a shuffle.

Edge cases: a null or empty text has no features and is scored by the thresholds alone; labels that are null or name no
document are not used, and of repeated labels the highest counts; without labels of both classes every document has
severity 0; repeated rows get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import slices, table
from shutterlake.llm.neardup import Vocabulary, mix, shingles

GRADES = 4
SAMPLE = 3000
FEATURES = 512
PREFIXES = (4, 5)
#: A feature stands in at least this share of the toxic documents of the sample.
SUPPORT = 0.02
#: And its share among them is at least so many times that among the others.
RATIO = 5
_WORD = regex.compile(r"\p{L}+")


def counted(text: str | None) -> tuple[Counter, int]:
    """How often each word (lower case) of a text occurs, and the number of words."""
    words = _WORD.findall((text or "").lower())
    return Counter(words), len(words)


def names(word: str) -> list[str]:
    """The features of a word: itself and its beginnings."""
    return [word, *(word[:n] + "-" for n in PREFIXES if len(word) > n)]


def named(words: Counter) -> Counter:
    """How often each feature occurs."""
    out: Counter = Counter()
    for word, n in words.items():
        for name in names(word):
            out[name] += n
    return out


@dataclass(frozen=True)
class Model:
    """Weights by feature, the weight of the density, and the ordered thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    density: float = 0.0
    thresholds: tuple[float, ...] = (50.0,) * (GRADES - 1)

    def exceed(self, words: Counter, n: int) -> np.ndarray:
        """P(grade >= k) for k = 1 and up."""
        found: Counter = Counter()
        for word, count in words.items():
            for name in names(word):
                if name in self.weights:
                    found[name] += count
        x, hits = sum(self.weights[k] * np.log1p(c) for k, c in found.items()), sum(found.values())
        x += self.density * np.log1p(100 * hits / max(n, 1))
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - x, -50, 50)))


def _root_ratio(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """Signed root of the likelihood ratio that a feature's share differs between classes of na and nb documents."""
    def log_likelihood(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    pooled = (a + b) / (na + nb)
    ratio = log_likelihood(a, na, a / na) + log_likelihood(b, nb, b / nb) - log_likelihood(a, na, pooled) - log_likelihood(b, nb, pooled)
    return np.sign(a / na - b / nb) * np.sqrt(np.maximum(2 * ratio, 0))


def _originals(texts: list[str]) -> list[bool]:
    """Whether a text of the sample is the first of those that resemble it."""
    vocabulary, seeds = Vocabulary(), mix(np.arange(1, 9, dtype=np.uint64))[:, None]
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        hashes, _ = shingles(text or "", vocabulary)
        keys = {(k, int(v)) for k, v in enumerate(mix(hashes[None, :] ^ seeds).min(axis=1))} if len(hashes) else set()
        out.append(not keys & seen)
        seen |= keys
    return out


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, steps: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by full gradients with momentum and scaling."""
    w, t = np.zeros(x.shape[1]), np.array([0.5] + [0.0] * (GRADES - 2))  # t: first threshold and logs of the gaps
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, t)]
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        theta = t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])
        z = x @ w
        upper = 1 / (1 + np.exp(np.clip(z[:, None] - theta[None, :], -40, 40)))  # P(grade <= k)
        full = np.concatenate([np.zeros((len(x), 1)), upper, np.ones((len(x), 1))], axis=1)
        rows = np.arange(len(x))
        p = np.maximum(full[rows, grade + 1] - full[rows, grade], 1e-9)
        slope = full * (1 - full)
        g_z = weight * (slope[rows, grade + 1] - slope[rows, grade]) / p
        g_theta = np.zeros(GRADES + 1)
        np.add.at(g_theta, grade + 1, -weight * slope[rows, grade + 1] / p)
        np.add.at(g_theta, grade, weight * slope[rows, grade] / p)
        g_theta = g_theta[1:-1]
        g_t = np.concatenate([[g_theta.sum()], [g_theta[k:].sum() * np.exp(t[k]) for k in range(1, GRADES - 1)]])
        for value, gradient, (m, v) in ((w, x.T @ g_z + decay * w, moments[0]), (t, g_t, moments[1])):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient ** 2 - v)
            value -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        np.maximum(w, 0, out=w)  # every feature was chosen as a sign of toxicity
    return w, t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray, features: int = FEATURES) -> Model:
    """Fit the model on the texts, labels (0 or 1) and row weights of a bounded sample."""
    if not 0 < toxic.sum() < len(toxic):
        return Model()
    words = [counted(t) for t in texts]
    found_in = [named(w) for w, _ in words]
    seen, bad = Counter(), Counter()
    first = np.array(_originals(texts))
    for found, label, counts in zip(found_in, toxic, first):
        if not counts:
            continue
        seen.update(found.keys())
        if label:
            bad.update(found.keys())
    known = sorted(k for k, n in bad.items() if n >= max(5, SUPPORT * toxic[first].sum()))
    if not known:
        return Model()
    a = np.array([bad[k] for k in known], dtype=float)
    b = np.array([seen[k] for k in known], dtype=float) - a
    na, nb = int(toxic[first].sum()), int(first.sum() - toxic[first].sum())
    score = _root_ratio(a, b, max(na, 1), max(nb, 1))
    score = np.where((a + 0.5) / (na + 0.5) >= RATIO * (b + 0.5) / (nb + 0.5), score, 0)
    kept = [known[i] for i in np.argsort(-score, kind="stable")[:features] if score[i] > 4]
    index = {k: i for i, k in enumerate(kept)}
    x = np.zeros((len(texts), len(kept) + 1))
    for row, (found, (_, n)) in enumerate(zip(found_in, words)):
        hits = 0
        for k, count in found.items():
            if k in index:
                x[row, index[k]] = np.log1p(count)
                hits += count
        x[row, -1] = np.log1p(100 * hits / max(n, 1))
    dense = x[toxic == 1, -1]
    grade = np.where(toxic == 1, 1 + np.searchsorted(np.quantile(dense, [1 / 3, 2 / 3]), x[:, -1]), 0)
    w, theta = fit_ordinal(x, grade, weight)
    return Model({k: float(v) for k, v in zip(kept, w)}, float(w[-1]), tuple(float(v) for v in theta))


def sampled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic, weight): about `sample` documents of each class, by a hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count("*").alias("n")).collect() if row["toxic"] in (0, 1)}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit, weight = F.lit(0), F.lit(1.0)
    for label, n in counts.items():
        share = min(1.0, sample / n)
        limit = F.when(F.col("toxic") == label, int(share * (1 << 30))).otherwise(limit)
        weight = F.when(F.col("toxic") == label, 1 / share).otherwise(weight)
    chosen = known.where(place < limit).withColumn("weight", weight)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most about twice `sample` rows


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model fitted on the bounded sample."""
    rows = sampled(documents, labels, sample).dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], np.array([r["toxic"] for r in rows], dtype=int), np.array([r["weight"] for r in rows], dtype=float))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per row of documents (doc_id, text): expected severity, P(toxic), the likeliest grade, and toxic or not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            above = [model.exceed(*counted(text)) for text in batch.column("text").to_pylist()]
            p = np.array(above).reshape(len(above), GRADES - 1)
            each = np.concatenate([1 - p[:, :1], p[:, :-1] - p[:, 1:], p[:, -1:]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(each.argmax(axis=1), pa.int32()), pa.array(p[:, 0] >= 0.5)],
                names=["doc_id", "severity", "p_toxic", "grade", "toxic"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def op9_toxicity(spark, folder: str) -> DataFrame:
    """Severity of every document, by a model fitted on a sample of `labels`."""
    documents = table(spark, folder, "documents")
    return score(documents, train(documents, table(spark, folder, "labels")))
