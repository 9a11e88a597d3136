"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates, scored as sparse dot products.

A text's features are its words, runs of punctuation, and marks of words in
capitals and of words said again, one and two in a row, hashed into ``2 ** BITS`` places; a place's value
is the root of its share, so every text has length one.  The model is fitted on
a bounded sample of labelled rows (``max_rows``, the least hashes of the ids) in one task: each update is
the FTRL-proximal step of McMahan et al. (2013) with per-coordinate rates.  The
weights (at most ``2 ** BITS`` numbers) are broadcast and every text is scored
whole, row by row, without a shuffle.

Defined cases: null counts as empty; texts without words score by the bias alone;
labels that are null or of unknown documents teach nothing; of several labels of a document the greatest counts;
of several texts of a document the one of least hash teaches; without any label all scores are 0.5; repeated rows get a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import text_of

BITS = 18
#: Labelled rows that the model is fitted on, at most.
MAX_ROWS = 8192
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: Marks that stand among the words: the next word is in capitals, it is the last one again.
CAPS, AGAIN = (xxhash.xxh64_intdigest(m, 1) for m in ("capitals", "again"))
#: Distinct tokens whose hashes a task remembers.
HELD = 1 << 19


class Hasher:
    """Sparse vector of a text."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > HELD:
            self.known.clear()
        known, codes, last = self.known, [], None
        for token in TOKEN.findall(text):
            code = known.get(token)
            if code is None:
                own = xxhash.xxh64_intdigest(token.lower(), 1)
                code = known[token] = (CAPS, own) if len(token) > 1 and token.isupper() else (own,)
            codes += (AGAIN, *code) if token == last else code
            last = token
        one = np.array(codes, np.uint64)
        two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
        two ^= two >> np.uint64(29)
        places = np.concatenate([one, two * np.uint64(0xBF58476D1CE4E5B9)]) >> np.uint64(64 - BITS)
        place, times = np.unique(places.astype(np.int32), return_counts=True)
        return place, np.sqrt(times / max(len(places), 1)).astype(np.float32)


class Ftrl:
    """FTRL-proximal logistic regression; the last place is the bias."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, place: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[place], self.n[place]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, place: np.ndarray, value: np.ndarray, label: float) -> None:
        weights = self.weights(place)
        gradient = (1 / (1 + np.exp(-np.clip(weights @ value, -35, 35))) - label) * value
        grown = self.n[place] + gradient ** 2
        self.z[place] += gradient - (np.sqrt(grown) - np.sqrt(self.n[place])) / self.alpha * weights
        self.n[place] = grown


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, alpha: float = 2.0, beta: float = 1.0,
          l1: float = 0.0, l2: float = 0.05, seed: int = 0) -> np.ndarray:
    model, order = Ftrl(alpha, beta, l1, l2), np.random.default_rng(seed)
    biased = [(np.append(p, 1 << BITS), np.append(v, 1.0), y) for p, v, y in rows]
    for _ in range(epochs):
        for i in order.permutation(len(biased)):
            model.learn(*biased[i])
    return model.weights()


def score(weights: np.ndarray, place: np.ndarray, value: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[place] @ value + weights[-1], -35, 35))))


def held_out(id_: Column) -> Column:
    """Every third document by checksum is for measuring and teaches nothing (a null id teaches nothing either)."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        found = [hasher(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([p for p, _ in found], pa.list_(pa.int32())),
             pa.array([v for _, v in found], pa.list_(pa.float32()))], names=["turn", "label", "place", "value"])


def _fit(options: dict):
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(np.asarray(p.values), np.asarray(v.values), y.as_py())
                for b in batches for y, p, v in zip(b.column(1), b.column(2), b.column(3))]
        weights = train(rows, **options) if rows else np.zeros(0)
        place = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(weights[place], pa.float64())],
                                         names=["place", "weight"])
    return fit


def fit_quality(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column, id_col: str = "doc_id",
                text_col: str = "text", max_rows: int = MAX_ROWS, **options) -> np.ndarray:
    """Weights learnt from the labelled rows that ``learn_from`` admits, the ``max_rows`` least hashes of them."""
    known = (labels.where(learn_from & F.col(label).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(label).cast("int").alias("__label")))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("__doc"), text_of(text_col).alias("__text"))
    rows = (texts.join(F.broadcast(sample), F.col("__doc") == F.col("__id")).groupBy("__id")
            .agg(F.min("__label").alias("label"), F.min_by("__text", F.struct(F.xxhash64("__text"), "__text")).alias("text"))
            .select(F.xxhash64("__id").alias("turn"), "label", "text"))
    found = rows.mapInArrow(_features, "turn long, label int, place array<int>, value array<float>")
    table = (found.repartition(1).sortWithinPartitions("turn", "label", F.size("place"))
             .mapInArrow(_fit(options), "place int, weight double").toPandas())
    weights = np.zeros((1 << BITS) + 1)
    weights[table["place"].to_numpy()] = table["weight"].to_numpy()
    return weights


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text", column: str = "score") -> DataFrame:
    """The documents with their score, 0 to 1, as one more column."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher, own = Hasher(), held.value
        for texts in parts:
            yield pd.Series([score(own, *hasher(t)) for t in texts], dtype="float64")
    return docs.withColumn(column, scored(text_of(text_col)))
