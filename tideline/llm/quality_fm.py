"""Quality scores by a factorisation machine over hashed words, structure statistics and the text's size.

Features of a text: its words, hashed into word_buckets and weighted by 1 + log(count) at unit length, and one bin out
of BINS for each statistic in STATISTICS. The score is a logistic of bias + linear weights + pairwise interactions, where
the weight of a pair is the dot product of two factors; the sum over all pairs is half of (sum squared - sum of squares).

fit() learns from at most most_rows labelled rows, chosen by the hash of their id. Rows with a null label or null
id teach nothing; a doc_id with several labels counts with the lowest; without any labelled row every score is 0.5.
Null texts count as empty; an empty text has statistics of zero and no words, and gets the score that follows from them.
Texts are read whole. Repeated rows get equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import learnable

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digits", "symbols", "marks", "spaces", "other_bytes",
    "distinct_words", "next_equal", "line_words", "distinct_lines", "short_words",
)
BINS = 12
WORD_BUCKETS = 4096

#: Words whose bucket a worker remembers before it starts anew.
MEMO = 150_000

_SYMBOLS, _MARKS = list(b"#*$%&|<>@^~_=+{}[]\\"), list(b"!?.,;:")


class Buckets(dict):
    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = bucket = zlib.crc32(word.encode()) % self.n
        return bucket


def statistics(text: str, words: list[str], ids: np.ndarray) -> np.ndarray:
    data = text.encode()
    seen = np.bincount(np.frombuffer(data, "u1"), minlength=256)
    n, chars, lines = len(words), max(1, len(data)), text.split("\n")
    lengths = np.fromiter(map(len, words), "i4", n)
    return np.array(
        [
            np.log1p(len(text)), np.log1p(n), lengths.mean() if n else 0.0, seen[65:91].sum() / chars, seen[48:58].sum() / chars,
            seen[_SYMBOLS].sum() / chars, seen[_MARKS].sum() / chars, seen[[9, 10, 13, 32]].sum() / chars, seen[128:].sum() / chars,
            len(set(words)) / max(1, n), (ids[1:] == ids[:-1]).sum() / max(1, n), n / len(lines), len(set(lines)) / len(lines),
            (lengths == 1).sum() / max(1, n),
        ]
    )


class Featurizer:
    def __init__(self, word_buckets: int = WORD_BUCKETS):
        self.buckets = Buckets(word_buckets)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, their weights, and the statistics."""
        words = text.split()
        ids = np.fromiter(map(self.buckets.__getitem__, words), "i4", len(words))
        counts = np.bincount(ids, minlength=self.buckets.n)
        hit = np.flatnonzero(counts)
        weights = 1 + np.log(counts[hit])
        return hit, weights / max(1e-9, np.sqrt((weights**2).sum())), statistics(text, words, ids)


@dataclass
class Model:
    """edges: bin borders of each statistic. linear and factors: the word buckets first, then the bins."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    word_buckets: int

    def row(self, hit: np.ndarray, weights: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers and values: the words, then one bin of each statistic."""
        bins = (self.edges <= stats[:, None]).sum(axis=1) + np.arange(len(stats)) * BINS + self.word_buckets
        return np.concatenate([hit, bins]), np.concatenate([weights, np.full(len(stats), len(stats) ** -0.5)])

    def score(self, index: np.ndarray, value: np.ndarray) -> float:
        factors = self.factors[index]
        summed, squares = value @ factors, (value**2) @ (factors**2)
        z = self.bias + value @ self.linear[index] + 0.5 * (summed @ summed - squares.sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], rank: int = 8, epochs: int = 20, rate: float = 0.15, decay: float = 1e-5, word_buckets: int = WORD_BUCKETS) -> Model:
    """AdaGrad on the logistic loss over (label, hit, weights, stats); both labels weigh the same in sum."""
    stats = np.array([r[3] for r in rows]) if rows else np.zeros((1, len(STATISTICS)))
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    size, rng = word_buckets + BINS * len(STATISTICS), np.random.default_rng(7)
    model = Model(edges, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, rank)), word_buckets)
    labels = np.array([r[0] for r in rows], float)
    if not rows or labels.min() == labels.max():
        model.factors[:] = 0
        model.bias = 0.0 if not rows else float(4 * labels[0] - 2)
        return model
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    data = [model.row(*r[1:]) for r in rows]
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 32)):
            g_linear, g_factors, g_bias = np.zeros(size), np.zeros((size, rank)), 0.0
            for i in batch:
                index, value = data[i]
                g = weight[i] * (model.score(index, value) - labels[i]) / len(batch)
                factors = model.factors[index]
                g_linear[index] += g * value
                g_factors[index] += g * value[:, None] * (value @ factors - value[:, None] * factors)
                g_bias += g
            touched = np.flatnonzero(g_linear)
            g_linear[touched] += decay * model.linear[touched]
            g_factors[touched] += decay * model.factors[touched]
            seen_linear[touched] += g_linear[touched] ** 2
            seen_factors[touched] += g_factors[touched] ** 2
            seen_bias += g_bias**2
            model.linear[touched] -= rate * g_linear[touched] / np.sqrt(seen_linear[touched])
            model.factors[touched] -= 0.3 * rate * g_factors[touched] / np.sqrt(seen_factors[touched])
            model.bias -= rate * g_bias / np.sqrt(seen_bias)
    return model


_FEATURES = pa.struct([("hit", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64())), ("stats", pa.list_(pa.float64()))])


def _features(text: Column) -> Column:
    @F.arrow_udf("struct<hit: array<int>, weights: array<double>, stats: array<double>>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        featurize = Featurizer()
        for batch in batches:
            yield pa.array((dict(zip(("hit", "weights", "stats"), featurize(t.as_py() or ""))) for t in batch), _FEATURES, size=len(batch))

    return features(text)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most_rows: int = 4000) -> Model:
    """Learns from at most most_rows labelled rows that learnable() allows; only those are sent to the driver."""
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label"))
    marks = marks.where(learnable() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # at most most_rows small rows, so the documents needn't be shuffled
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(marks), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(most_rows)
    chosen = rows.select("label", _features(F.col("text")).alias("f")).collect()
    return train([(r["label"], np.array(r["f"]["hit"], "i4"), np.array(r["f"]["weights"]), np.array(r["f"]["stats"])) for r in chosen])


def score(spark: SparkSession, text: Column, model: Model) -> Column:
    """A score from 0 to 1 for each whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, featurize = shared.value, Featurizer(shared.value.word_buckets)
        for batch in batches:
            yield pa.array((model.score(*model.row(*featurize(t.as_py() or ""))) for t in batch), pa.float64(), size=len(batch))

    return scores(text)


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score at least threshold, with the columns they came with."""
    return docs.where(score(docs.sparkSession, F.col(text), model) >= threshold)
