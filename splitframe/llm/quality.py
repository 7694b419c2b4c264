"""Quality by logistic regression on hashed word n-grams, trained with FTRL-proximal updates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Vocabulary, mixed

#: Labelled rows that a model is fitted on at most.
LABELLED = 12_000

#: Bytes of words that a task keeps.
KEPT_BYTES = 16_000_000

_RUN = re.compile(r"(.)\1{2,}", re.DOTALL)
_CLASSES = ((regex.compile(r"\p{Lu}"), "A"), (regex.compile(r"[\p{L}\p{M}]"), "a"), (regex.compile(r"\p{N}"), "9"))


class _Letters(dict):
    """Code points to what they are in a shape, found when first met."""

    def __missing__(self, code: int) -> str:
        self[code] = next((letter for pattern, letter in _CLASSES if pattern.match(chr(code))), chr(code))
        return self[code]


_LETTERS = _Letters()


def word_shape(word: bytes) -> str:
    """Letters as A or a, digits as 9, other characters as they are, runs as two."""
    return _RUN.sub(r"\1\1", word.decode("utf-8", "replace").translate(_LETTERS))


class _Words(Vocabulary):
    """Also the hash of each word's shape; ``hashes`` are of the lower-cased word.

    Starts anew when its words take ``KEPT_BYTES`` as well. One for each task, and gone with it.
    """

    def __init__(self):
        super().__init__()
        self.shapes = np.empty(1024, np.uint64)
        self.known: dict[str, int] = {}
        self.weight = 0

    def __missing__(self, word: bytes) -> int:
        n = super().__missing__(word)
        if len(self.shapes) < len(self.hashes):
            self.shapes = np.concatenate([self.shapes, np.empty(len(self.hashes) - len(self.shapes), np.uint64)])
        self.hashes[n] = xxhash.xxh64_intdigest(word.lower())
        shape = word_shape(word)
        digest = self.known.get(shape)
        if digest is None:
            digest = xxhash.xxh64_intdigest(shape.encode(), 3)
            if len(self.known) < self.limit and len(shape) < 100:
                self.known[shape] = digest
        self.shapes[n] = digest
        self.weight += len(word)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if self.weight > KEPT_BYTES:
            self.clear()
        if not self:
            self.weight = 0
        return super().numbers(words)


_SAME = np.uint64(0x5851F42D4C957F2D)


def features(text: bytes, words: _Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: words, word pairs, and one to three word shapes in a row.

    Values are square roots of shares, so those of each kind have length one. A word that
    repeats the one before has a shape of its own. A text without words has no features.
    """
    numbers = words.numbers(text.split())
    if not len(numbers):
        return np.empty(0, np.int64), np.empty(0)
    h, s = words.hashes[numbers], words.shapes[numbers]
    s[1:][numbers[1:] == numbers[:-1]] ^= _SAME
    pairs = mixed(s[:-1], s[1:])
    keys, values = [], []
    for kind, grams in enumerate((h, mixed(h[:-1], h[1:]), s, pairs, mixed(pairs[:-1], s[2:]))):
        if len(grams):
            found, counts = np.unique((grams + np.uint64(kind)) >> np.uint64(64 - bits), return_counts=True)
            keys.append(found.astype(np.int64))
            values.append(np.sqrt(counts / len(grams)))
    keys, values = np.concatenate(keys), np.concatenate(values)
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, values)


def train_ftrl(
    examples: list[tuple[np.ndarray, np.ndarray, int]], size: int, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05
) -> tuple[np.ndarray, float]:
    """Weights and bias by follow-the-regularised-leader, one example at a time in the given order."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        over = np.abs(z[at]) - l1 * (at < size)
        return np.where(over > 0, -np.sign(z[at]) * over / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, values, label in examples:
            at, values = np.append(at, size), np.append(values, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    final = weights(np.arange(size + 1))
    return final[:-1], float(final[-1])


@dataclass(frozen=True)
class QualityModel:
    """``weights`` of 2**bits buckets (four bytes each) and a bias: all that is broadcast."""

    bits: int
    weights: np.ndarray
    bias: float

    def score(self, text: Column) -> Column:
        """Probability of label 1 of each whole text: a sparse dot product. Null counts as empty;
        an empty text gets the bias alone."""
        bits, bias = self.bits, self.bias
        from pyspark.sql import SparkSession

        weights = SparkSession.active().sparkContext.broadcast(self.weights)

        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            words, w = _Words(), weights.value
            for texts in batches:
                out = np.empty(len(texts))
                for i, x in enumerate(texts):
                    at, values = features(x, words, bits)
                    out[i] = w[at] @ values + bias
                yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

        return scored(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(order, text, label) of the ``most`` labelled documents whose ids hash lowest.

    ``labels`` is (id, label); null ids and labels are left out, of several labels of an id one
    counts. The sample is bounded by ``most``, so it may be broadcast.
    """
    drawn = (
        labels.where("id is not null and label is not null")
        .groupBy("id")
        .agg(F.max("label").cast("int").alias("label"))
        .withColumn("order", F.xxhash64(F.lit(5), "id"))
        .orderBy("order", "id")
        .limit(most)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return texts.join(F.broadcast(drawn), "id").select("order", "text", "label")


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 18, most: int = LABELLED
) -> QualityModel:
    """Fit on at most ``most`` labelled documents; ``labels`` is (id, label) with label 0 or 1.

    Features are made where the documents are; the updates, which depend on each other, run in
    one task on the bounded sample, in an order that the ids decide. Without labelled documents
    every score is one half.
    """

    def sparse(batches):
        words = _Words()
        for batch in batches:
            found = [features(x.as_py(), words, bits) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())),
                    pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())),
                    batch.column(2),
                ],
                names=["order", "at", "values", "label"],
            )

    def fitted(batches):
        rows = []
        for batch in batches:
            rows += zip(batch.column(0).to_pylist(), *([x.values.to_numpy() for x in batch.column(i)] for i in (1, 2)), batch.column(3).to_pylist())
        rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[3]))
        weights, bias = train_ftrl([(a, v, y) for _, a, v, y in rows], 1 << bits)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    sample = sample_labelled(docs, labels, id_col, text_col, most).mapInArrow(sparse, "order bigint, at array<int>, values array<float>, label int")
    row = sample.repartition(1).mapInArrow(fitted, "weights binary, bias double").first()
    if row is None:
        return QualityModel(bits, np.zeros(1 << bits, np.float32), 0.0)
    return QualityModel(bits, np.frombuffer(row["weights"], np.float32), row["bias"])
