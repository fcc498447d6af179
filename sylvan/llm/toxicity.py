"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased words and prefixes of words. A linear model adds their weights; the
machine also learns a factor vector for each term, whose inner products weigh pairs such as
an insult with the group it is aimed at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import table
from sylvan.llm.training import in_order, labelled_sample, scored, sigmoid

BITS = 20
#: Bytes kept by the tokenizer: a-z and those of longer characters; others part words.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
CACHE = 200_000


@dataclass(frozen=True)
class Settings:
    """sample bounds the labelled documents used; terms bounds the model's size.

    A term is kept if `least` sampled documents hold it and its count among positive ones
    is `screen` standard deviations from expectation, in all sampled documents or in those
    that hold a term of which positives have too many: a term that matters only in company,
    such as a group mention, is as common in clean texts at large. Pairs have `pairs` of the
    places at most.
    """

    sample: int = 6000
    terms: int = 4096
    least: int = 4
    screen: float = 4.0
    pairs: int = 1024
    factors: int = 4
    epochs: int = 10
    batch: int = 128
    rate: float = 0.1
    decay: float = 1e-4
    seed: int = 0


def words_of(text: str) -> set[bytes]:
    """Distinct lower-cased words, letters only."""
    return set(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split())


def terms_of(word: bytes) -> list[int]:
    """Hashed terms of a word: itself and its first 4, 5 and 6 characters if it is longer."""
    text = word.decode("utf-8", "ignore")
    parts = [word, *(b"^%d" % n + text[:n].encode() for n in (4, 5, 6) if len(text) > n)]
    return [zlib.crc32(p) & ((1 << BITS) - 1) for p in parts]


def _sample_terms(batches):
    import pyarrow as pa

    for batch in batches:
        ids, values = [], []
        for text in batch.column("text").to_pylist():
            counts = Counter(t for w in words_of(text) for t in terms_of(w))
            ids.append(np.fromiter(counts.keys(), np.int32, len(counts)).tobytes())
            values.append(np.fromiter(counts.values(), np.int32, len(counts)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "label", "ids", "counts"])


@dataclass
class Machine:
    """place: hashed term -> row of weights and factors."""

    place: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, rows: np.ndarray, values: np.ndarray) -> float:
        """The machine's sum for one document's terms."""
        own = self.factors[rows] * values[:, None]
        return float(self.bias + self.weights[rows] @ values + 0.5 * ((own.sum(0) ** 2).sum() - (own**2).sum()))

    def scorer(self):
        """Scores lists of texts; remembers which words have terms, up to CACHE words."""
        known: dict[bytes, tuple[int, ...]] = {}

        def score(texts: list[str]) -> list[float]:
            out = []
            for text in texts:
                counts: Counter = Counter()
                for w in words_of(text):
                    rows = known.get(w)
                    if rows is None:
                        if len(known) >= CACHE:
                            known.clear()
                        rows = known[w] = tuple(self.place[t] for t in terms_of(w) if t in self.place)
                    if rows:
                        counts.update(rows)
                rows = np.array(sorted(counts), dtype=np.int64)
                out.append(float(sigmoid(self.raw(rows, np.log2(1 + np.array([counts[r] for r in rows], dtype=float))))))
            return out

        return score


def fit(documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings = Settings()) -> Machine:
    """Learns from (term ids, term counts) of each document by AdaGrad on the logistic loss.

    Without documents every score is 0; with labels of one value it is their smoothed share.
    """
    n, share = len(labels), (labels.sum() + 0.5) / (len(labels) + 1)
    empty = np.zeros((0, s.factors))
    if not n:
        return Machine({}, -30.0, np.zeros(0), empty)
    prior = float(np.log(share / (1 - share)))
    if labels.min() == labels.max():
        return Machine({}, prior, np.zeros(0), empty)
    lengths = np.array([len(ids) for ids, _ in documents])
    ids = np.concatenate([ids for ids, _ in documents])
    values = np.log2(1 + np.concatenate([c for _, c in documents]))
    owner_of = np.repeat(np.arange(n), lengths)

    def deviation(documents: np.ndarray) -> np.ndarray:
        """How far each term's count among positives is from expectation, in some documents."""
        mine = documents[owner_of]
        held = np.bincount(ids[mine], minlength=1 << BITS)
        share = labels[documents].mean() if documents.any() else 0.0
        apart = np.bincount(ids[mine], labels[owner_of[mine]], minlength=1 << BITS) - held * share
        apart /= np.sqrt(np.maximum(held, 1) * max(share * (1 - share), 1e-9))
        apart[held < s.least] = 0
        return apart

    def best(apart: np.ndarray, most: int) -> np.ndarray:
        chosen = np.lexsort((np.arange(len(apart)), -np.abs(apart)))[:most]
        return chosen[np.abs(apart[chosen]) >= s.screen]

    alone = deviation(np.ones(n, bool))
    chosen = best(alone, s.terms - s.pairs)
    marks = chosen[alone[chosen] > 0]
    with_mark = np.bincount(owner_of[np.isin(ids, marks)], minlength=n) > 0
    chosen = np.union1d(chosen, best(deviation(with_mark), s.pairs))
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))

    # Rows of kept terms; the last row is a constant zero, so that no document is empty.
    none = len(chosen)
    owner = np.repeat(np.arange(n), lengths)
    kept = place[ids] >= 0
    owner, rows, values = np.append(owner[kept], np.arange(n)), np.append(place[ids[kept]], np.full(n, none)), np.append(values[kept], np.zeros(n))
    order = np.argsort(owner, kind="stable")
    rows, values = rows[order], values[order]
    size = np.bincount(owner, minlength=n)
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])

    rng = np.random.default_rng(s.seed)
    bias, weights = prior, np.zeros(none + 1)
    factors = rng.normal(0, 0.05, (none + 1, s.factors))
    factors[none] = 0
    bias_sum, weight_sum, factor_sum = 1e-8, np.full(none + 1, 1e-8), np.full(factors.shape, 1e-8)
    for _ in range(s.epochs):
        shuffled = rng.permutation(n)
        for start in range(0, n, s.batch):
            batch = shuffled[start : start + s.batch]
            length = size[batch]
            at = np.concatenate([[0], np.cumsum(length)[:-1]])
            pick = np.repeat(begin[batch] - at, length) + np.arange(length.sum())
            r, x = rows[pick], values[pick]
            own = factors[r] * x[:, None]
            total = np.add.reduceat(own, at, axis=0)
            raw = bias + np.add.reduceat(weights[r] * x, at) + 0.5 * (total**2 - np.add.reduceat(own**2, at, axis=0)).sum(1)
            error = (sigmoid(raw) - labels[batch]) / len(batch)
            each = np.repeat(error, length) * x
            u, back = np.unique(r, return_inverse=True)
            g_weight = np.bincount(back, each, len(u)) + s.decay * weights[u]
            pull = each[:, None] * (np.repeat(total, length, axis=0) - own)
            g_factor = np.stack([np.bincount(back, pull[:, f], len(u)) for f in range(s.factors)], 1) + s.decay * factors[u]
            weight_sum[u] += g_weight**2
            factor_sum[u] += g_factor**2
            bias_sum += error.sum() ** 2
            weights[u] -= s.rate * g_weight / np.sqrt(weight_sum[u])
            factors[u] -= s.rate * g_factor / np.sqrt(factor_sum[u])
            bias -= s.rate * error.sum() / np.sqrt(bias_sum)
            factors[none] = weights[none] = 0
    return Machine({int(t): i for i, t in enumerate(chosen)}, float(bias), weights, factors)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "toxic") -> Machine:
    """Fits a machine on a bounded sample of labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, label, s.sample).mapInArrow(_sample_terms, "doc_id long, label int, ids binary, counts binary")
    rows = in_order(sample.collect())
    documents = [(np.frombuffer(r.ids, np.int32), np.frombuffer(r.counts, np.int32)) for r in rows]
    return fit(documents, np.array([r.label for r in rows], dtype=float), s)


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text).

    Only texts enter a score. Null and empty texts get the model's bias. Repeated rows get
    the same score, each returned; an empty labels table gives scores of 0.
    """
    model = train(docs, labels, s)

    def score(texts, cached=[]):  # noqa: B006  one scorer for each Python worker
        if not cached:
            cached.append(model.scorer())
        return cached[0](texts)

    return scored(docs, score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document's toxicity."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
