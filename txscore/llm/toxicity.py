"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

The model is fitted in one task on a bounded sample of the labelled texts (TRAIN_ROWS label rows, chosen by the hash of
doc_id); its per-coordinate rates and L1 term leave few weights other than zero, and only these are sent to the driver
and broadcast. All documents are scored, over their whole texts, without a shuffle.

Defined results: null and empty texts have no features and get the score of the bias; label rows with a null label or
doc_id aren't learnt from; without any labelled row every score is 0.5. Labels other than 0 count as 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txscore.llm._common import as_bytes, bounded_sample, small_batches
from txscore.llm.features import SkipGrams

#: At most so many label rows are learnt from.
TRAIN_ROWS = 16_000
BITS = 20
FOLDS = 5


class Ftrl:
    """Follow the regularized leader, proximal, with a rate for each coordinate; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, l1 = self.z[at], np.full(np.shape(self.z[at]), self.l1)
        if len(l1):
            l1[-1] = 0  # the bias isn't shrunk
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / self.alpha * w


def _fit(bits: int, epochs: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, rows = SkipGrams(bits), []
        for batch in batches:
            for doc, text, label in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                rows.append((doc, label, np.unique(grams.all(text)).astype(np.int32)))
        rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        model = Ftrl(1 << bits)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                model.learn(rows[k][2].astype(np.int64), rows[k][1])
        w = model.weights(np.arange((1 << bits) + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["at", "w"])

    return run


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, rows: int = TRAIN_ROWS, epochs: int = 6, seed: int = 7) -> DataFrame:
    """labels (doc_id, label int) -> the weights (at, w) other than zero."""
    small_batches(docs.sparkSession)
    chosen = labels.select("doc_id", (F.col("label") != 0).cast("int").alias("label")).where("label is not null")
    sample = bounded_sample(chosen, docs, rows, seed).select(F.col("doc_id").cast("long"), "text", "label")
    return sample.repartition(1).mapInArrow(_fit(bits, epochs, seed), "at long, w double")


def _score(bits: int, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = SkipGrams(bits)
        at, value = weights.value
        w = np.zeros((1 << bits) + 1)
        w[at] = value
        live = w != 0
        for batch in batches:
            out = []
            for text in as_bytes(batch.column(batch.schema.get_field_index("text"))):
                f = grams.all(text)
                out.append(1 / (1 + np.exp(-np.clip(w[-1] + w[np.unique(f[live[f]])].sum(), -35, 35))))
            keep = [c for c in batch.schema.names if c not in ("text", "score")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out, pa.float64())], names=[*keep, "score"])

    return run


def score(docs: DataFrame, weights: DataFrame, bits: int = BITS) -> DataFrame:
    """docs without text, and with score."""
    small_batches(docs.sparkSession)
    found = weights.toArrow()  # the weights that L1 left, 2**bits + 1 at most
    sent = docs.sparkSession.sparkContext.broadcast((found["at"].to_numpy(), found["w"].to_numpy()))
    kept = docs.select(*[c for c in docs.columns if c not in ("text", "score")])
    return docs.drop("score").mapInArrow(_score(bits, sent), kept.schema.add("score", "double"))


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(FOLDS))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Rows of fold 0 are never learnt from."""
    train = labels.select("doc_id", F.col("toxic").alias("label")).where(fold() != 0)
    docs = docs.select("doc_id", "text")
    out = score(docs, fit(docs, train))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
