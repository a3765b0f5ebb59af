"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its value s into grades:
P(grade <= k) = 1 / (1 + exp(s - threshold[k])). It is fitted in one task on a bounded sample of the rated texts
(TRAIN_ROWS rows, chosen by the hash of doc_id); the weights and thresholds, of fixed size, are broadcast, and every
document is graded over its whole text, without a shuffle.

Defined results: null and empty texts are graded by the features that an empty text has; rating rows with a null rating
or doc_id aren't learnt from. Without a rated row, or with one grade only, every document has that grade (0 without
any) with probability 1. Repeated documents get equal grades. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txscore.llm._common import as_bytes, bounded_sample, released, small_batches
from txscore.llm.features import Surface
from txscore.llm.toxicity import fold

#: At most so many rating rows are learnt from.
TRAIN_ROWS = 12_000
BITS = 16


class Ordinal:
    """Shared weights and ordered thresholds, fitted by AdaGrad on the likelihood of the grades."""

    def __init__(self, size: int, grades: list[int], rate: float = 0.3, shrink: float = 1e-5):
        self.w, self.seen, self.grades = np.zeros(size), np.full(size, 1e-8), grades
        self.cuts = np.arange(len(grades) - 1, dtype=float) - (len(grades) - 2) / 2
        self.cuts_seen = np.full(len(self.cuts), 1e-8)
        self.rate, self.shrink = rate, shrink

    def below(self, s: float) -> np.ndarray:
        """P(grade <= k) for each k, with 0 before and 1 after."""
        return np.concatenate([[0.0], 1 / (1 + np.exp(np.clip(s - self.cuts, -35, 35))), [1.0]])

    def learn(self, at: np.ndarray, x: np.ndarray, k: int) -> None:
        p = self.below(self.w[at] @ x)
        slope = p * (1 - p)
        least = max(p[k + 1] - p[k], 1e-12)
        g = (slope[k + 1] - slope[k]) / least * x + self.shrink * self.w[at]
        self.seen[at] += g * g
        self.w[at] -= self.rate * g / np.sqrt(self.seen[at])
        for j, sign in ((k, -1), (k - 1, 1)):
            if 0 <= j < len(self.cuts):
                h = sign * slope[j + 1] / least
                self.cuts_seen[j] += h * h
                self.cuts[j] -= self.rate * h / np.sqrt(self.cuts_seen[j])
        self.cuts = np.maximum.accumulate(self.cuts)


def _fit(bits: int, epochs: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface, rows = Surface(bits), []
        for batch in batches:
            for doc, text, label in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                at, x = surface.vector(text)
                rows.append((doc, label, at.astype(np.int32), x.astype(np.float32)))
        rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        grades = sorted({r[1] for r in rows})
        model = Ordinal(1 << bits, grades or [0])
        order = np.random.default_rng(seed)
        if len(grades) > 1:
            for e in range(epochs):
                model.rate = 0.3 / (1 + e)
                for k in order.permutation(len(rows)):
                    model.learn(rows[k][2].astype(np.int64), rows[k][3].astype(float), grades.index(rows[k][1]))
        live = np.flatnonzero(model.w)
        parts = [("w", live, model.w[live]), ("cut", np.arange(len(model.cuts)), model.cuts), ("grade", np.arange(len(model.grades)), np.array(model.grades, float))]
        for kind, at, v in parts:
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(v, pa.float64())], names=["kind", "at", "value"])

    return run


def fit(docs: DataFrame, ratings: DataFrame, bits: int = BITS, rows: int = TRAIN_ROWS, epochs: int = 4, seed: int = 11) -> DataFrame:
    """ratings (doc_id, grade int) -> the model as rows (kind, at, value)."""
    small_batches(docs.sparkSession)
    rated = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).where("grade is not null")
    sample = bounded_sample(rated, docs, rows, seed).select(F.col("doc_id").cast("long"), "text", "grade")
    return sample.repartition(1).mapInArrow(released(_fit(bits, epochs, seed)), "kind string, at long, value double")


_NEW = [("expected_grade", pa.float64(), "double"), ("tail_probability", pa.float64(), "double"), ("predicted_grade", pa.int32(), "integer")]


def _grade(bits: int, sent, text_at: int, tail: int | None, least: float | None):
    """least: only documents with at least this tail probability pass, and no column is added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = Surface(bits)
        at, w, cuts, grades = sent.value
        model = Ordinal(1 << bits, list(map(int, grades)))
        model.w[at], model.cuts = w, cuts
        cut = grades >= (tail if tail is not None else grades[-1])
        for batch in batches:
            out: list[tuple] = []
            for text in as_bytes(batch.column(text_at)):
                f, x = surface.vector(text)
                p = np.diff(model.below(model.w[f] @ x))
                out.append((float(p @ grades), float(p[cut].sum()), int(grades[int(p.argmax())])))
            if least is not None:
                yield batch.filter(pa.array([r[1] >= least for r in out], pa.bool_()))
                continue
            keep = [c for c in batch.schema.names if c not in {n for n, _, _ in _NEW} | {"text"}]
            new = [pa.array([r[j] for r in out], kind) for j, (_, kind, _) in enumerate(_NEW)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *new], names=[*keep, *(n for n, _, _ in _NEW)])

    return run


def _model(docs: DataFrame, model: DataFrame):
    rows = model.toPandas()  # 2**bits weights, thresholds and grades at most
    part = {k: rows[rows.kind == k].sort_values("at") for k in ("w", "cut", "grade")}
    grades = part["grade"]["value"].to_numpy() if len(part["grade"]) else np.zeros(1)  # without a rated row
    return docs.sparkSession.sparkContext.broadcast((part["w"]["at"].to_numpy(), part["w"]["value"].to_numpy(), part["cut"]["value"].to_numpy(), grades))


def grade(docs: DataFrame, model: DataFrame, tail: int | None = None, bits: int = BITS) -> DataFrame:
    """docs without text, with expected_grade, tail_probability (of grade `tail` or more; the best by default), predicted_grade."""
    kept = docs.select(*[c for c in docs.columns if c not in {n for n, _, _ in _NEW} | {"text"}]).schema
    for name, _, kind in _NEW:
        kept = kept.add(name, kind)
    return docs.mapInArrow(_grade(bits, _model(docs, model), docs.columns.index("text"), tail, None), kept)


def select(docs: DataFrame, model: DataFrame, tail: int | None = None, least: float = 0.5, bits: int = BITS) -> DataFrame:
    """The documents whose tail probability is at least `least`, with all their columns."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # Arrow functions take no names with dots
    return plain.mapInArrow(released(_grade(bits, _model(docs, model), docs.columns.index("text"), tail, least)), plain.schema).toDF(*docs.columns)


def quality_model(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The model of labels.quality. Rows of fold 0 are left out, to measure accuracy on."""
    return fit(docs, labels.select("doc_id", F.col("quality").alias("grade")).where(fold() != 0))
