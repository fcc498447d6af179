"""Quality classifier: Bradley-Terry ranking from preference pairs.

Any document labelled good is preferred to any labelled bad. The score is linear in a
document's features and learned by the logistic loss on the difference of a pair's
features; the share of pairs decides, not the share of labels. Scores are then mapped to
probabilities, and documents are kept from the quantile at which the scores reach a ceiling.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import slices, table
from sylvan.llm.training import in_order, labelled_sample, scored, sigmoid

#: Common words by language: fixed values.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were all there one we been has when who will no more if out so said what up its about into than them can only other",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son ou elle mais comme on tout nous sa cette ont être leur aux fait si deux même ses d l",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi",
}
COMMON = frozenset(w.encode() for text in COMMON_WORDS.values() for w in text.split())
#: Characters counted together; one more class is the start of a character beyond ASCII.
GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"#", b"$", b"%", b"&", b"*", b"|", b"<>", b"{}[]", b"()", b"'\"`", b":;", b"/\\", b"=+~^", b"_-", b"@"]
GROUP_OF_BYTE = np.zeros((256, len(GROUPS) + 1))
for _i, _g in enumerate(GROUPS):
    GROUP_OF_BYTE[list(_g), _i] = 1
GROUP_OF_BYTE[0xC0:, -1] = 1


@dataclass(frozen=True)
class Settings:
    """sample bounds the labelled documents used; pairs are drawn anew in each of `steps`."""

    sample: int = 6000
    steps: int = 2000
    pairs: int = 256
    rate: float = 0.1
    decay: float = 1e-3
    seed: int = 0


def features(text: str) -> list[float]:
    """Shares of character groups, of word kinds and of repeats, and sizes."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, m = len(words), max(len(words), 1)
    groups = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ GROUP_OF_BYTE
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        *np.sqrt(groups / (groups.sum() or 1)),
        np.log1p(n),
        min(n, 20) / 20,
        min(n, 60) / 60,
        len(counts) / m,
        len(counts) / m**0.8,
        max(counts.values(), default=0) / m,
        sum(c for w, c in counts.items() if w.lower() in COMMON) / m,
        (groups[0] + groups[1] + groups[-1]) / m / 10,
        sum(c for w, c in counts.items() if w.isupper()) / m,
        sum(c for w, c in counts.items() if len(w) == 1) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        np.log1p(len(lines)),
        1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)),
    ]


N_FEATURES = len(features(""))


@dataclass
class Ranker:
    """Standardised features, bent at their means so that either extreme can count; then a line."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float
    offset: float

    def bend(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -5, 5)
        return np.concatenate([z, np.minimum(z, 0) ** 2, np.maximum(z, 0) ** 2, (z > 1).astype(float)], axis=-1)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return sigmoid(self.slope * (self.bend(np.array([features(t) for t in texts])) @ self.weights) + self.offset)


def fit(x: np.ndarray, labels: np.ndarray, s: Settings = Settings()) -> Ranker:
    """Learns a ranker; without both labels every score is the labels' smoothed share (0.5 of none)."""
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    ranker = Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(4 * N_FEATURES), 1.0, float(np.log(share / (1 - share))))
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return ranker
    ranker.mean, ranker.spread = x.mean(0), x.std(0) + 1e-6
    bent = ranker.bend(x)
    rng = np.random.default_rng(s.seed)
    weights, sums = ranker.weights, np.full(len(ranker.weights), 1e-8)
    for _ in range(s.steps):
        ahead = bent[rng.choice(good, s.pairs)] - bent[rng.choice(bad, s.pairs)]
        gradient = s.decay * weights - (ahead * sigmoid(-(ahead @ weights))[:, None]).mean(0)
        sums += gradient**2
        weights -= s.rate * gradient / np.sqrt(sums)
    # Score differences fix no zero point: a line through the labels maps scores to probabilities.
    strength = bent @ weights
    line, target = np.array([1.0, 0.0]), np.where(labels == 1, (len(good) + 1) / (len(good) + 2), 1 / (len(bad) + 2))
    design = np.stack([strength, np.ones(len(strength))], 1)
    for _ in range(50):
        p = sigmoid(design @ line)
        line = line - np.linalg.solve((design * (p * (1 - p) + 1e-6)[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (p - target))
    ranker.slope, ranker.offset = map(float, line)
    return ranker


def _sample_features(batches):
    import pyarrow as pa

    for batch in batches:
        values = [np.array(features(t)).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(values, pa.binary())], ["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "quality") -> Ranker:
    """Fits a ranker on a bounded sample of labelled documents outside the held-out fold."""
    rows = in_order(labelled_sample(docs, labels, label, s.sample).mapInArrow(_sample_features, "doc_id long, label int, x binary").collect())
    x = np.array([np.frombuffer(r.x) for r in rows]) if rows else np.zeros((0, N_FEATURES))
    return fit(x, np.array([r.label for r in rows], dtype=float), s)


def quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every row of docs(doc_id, text).

    Only texts enter a score, whole texts however long. Null text is scored as empty text.
    Repeated rows get the same score, each returned; ties in score are left as they are. An
    empty labels table gives scores of 0.5, an empty docs table no rows; other columns are
    ignored.
    """
    model = train(docs, labels, s)
    return scored(docs, lambda texts: model.score(texts).tolist()).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def keep_by_quality(docs: DataFrame, labels: DataFrame, ceiling: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """Rows of docs, all their columns, without those of low quality.

    Every document that scores below `ceiling` goes, however large a share of the corpus that
    is: these are the rows up to the quantile of the scores at which they reach the ceiling.
    Null and empty texts are judged like any other, repeated rows alike, and an empty table
    gives no rows. Columns of any name pass through.
    """
    import pyarrow as pa

    model = train(docs, labels, s)

    def run(batches):
        for batch in slices(batches):
            scores = model.score([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(scores >= ceiling, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document's quality."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
