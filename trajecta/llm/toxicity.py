"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, and L1 keeps the weights of uninformative features
at exactly zero; what is left is a short list that is sent to every task.  The model is fitted
on a sample of labelled documents whose size is a parameter; every document is scored, whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.columns import unused
from trajecta.llm.learning import labelled_sample, remainder
from trajecta.llm.words import mixed, plain_hashes_and_stems, shingle_hashes

BUCKET_BITS = 20
STEM = 4
PER_CLASS = 4000  # labelled documents of each class that the model is fitted on
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 16.0, 1.0  # L1 for PER_CLASS documents of the rarer class
FOLDS, HELD = 5, 0


def features(text: bytes | None) -> np.ndarray:
    """Distinct buckets of a text's words, their stems (the first bytes of a longer word), word
    pairs and pairs with one or two words between."""
    h, stems = plain_hashes_and_stems(text, STEM)
    parts = [mixed(h, 1), mixed(stems, 5), mixed(shingle_hashes(h, 2), 2)]
    for gap in (2, 3):
        if len(h) > gap:
            with np.errstate(over="ignore"):
                parts.append(mixed(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) ^ h[gap:], 1 + gap))
    return np.unique((np.concatenate(parts) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))


@dataclass(frozen=True)
class Weights:
    """Non-zero coordinates; ``trained`` is false if no document of one class was seen."""

    buckets: np.ndarray
    values: np.ndarray
    bias: float
    trained: bool = True

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BUCKET_BITS, np.float32)
        out[self.buckets] = self.values
        return out


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Weights:
    """Fit on ``(buckets, label)`` pairs in the order given.

    Both classes weigh as much as the rarer one, and L1 grows with the root of its size up to
    ``PER_CLASS``, as the noise in a coordinate does.
    """
    sizes = np.bincount([y for _, y in examples], minlength=2)
    if not sizes.all():
        return Weights(np.empty(0, np.int32), np.empty(0, np.float32), 0.0, False)
    weight = sizes.min() / sizes
    bound = L1 * min(1.0, sizes.min() / PER_CLASS) ** 0.5
    bias_at = 1 << BUCKET_BITS
    z, n = np.zeros(bias_at + 1), np.zeros(bias_at + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == bias_at, 0.0, bound)
        held = z[at]
        return np.where(
            np.abs(held) <= l1, 0.0, (np.sign(held) * l1 - held) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        )

    for _ in range(epochs):
        for buckets, label in examples:
            at = np.append(buckets, bias_at)
            w = weights(at)
            gradient = (_logistic(w.sum()) - label) * weight[label]
            old = n[at]
            rate = (np.sqrt(old + gradient * gradient) - np.sqrt(old)) / ALPHA
            z[at] += gradient - rate * w
            n[at] = old + gradient * gradient
    w = weights(np.arange(bias_at + 1))
    kept = np.flatnonzero(w[:-1]).astype(np.int32)
    return Weights(kept, w[kept].astype(np.float32), float(w[-1]))


def _logistic(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Weights:
    """Weights learned from labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "toxic", FOLDS, HELD, per_class)

    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        return pd.Series([features(x).tobytes() for x in column], dtype=object)

    # At most 2 * per_class rows.
    rows = sample.select(
        F.xxhash64("doc_id", F.lit(1)).alias("spot"), "doc_id", "label", packed(F.col("text").cast("binary")).alias("x")
    ).toPandas()
    rows = rows.sort_values(["spot", "doc_id", "x"])
    return ftrl([(np.frombuffer(x, np.int32), int(y)) for x, y in zip(rows["x"], rows["label"])])


def with_score(docs: DataFrame, model: Weights, name: str) -> DataFrame:
    """``docs`` with the probability of label 1 as column ``name``."""

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        dense = model.dense()
        if not model.trained:
            return pd.Series(np.zeros(len(column)))
        return pd.Series([float(_logistic(model.bias + dense[features(x)].sum(dtype=np.float64))) for x in column])

    return docs.withColumn(name, score(F.col("text").cast("binary")))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Scores use the text alone.  A null, empty or wordless text scores as the bias alone, equal
    texts score equally, repeated rows come back repeated.  Without labelled documents of both
    classes every score is 0.  Other columns are ignored.
    """
    model = fit(docs, labels, per_class)
    scored = with_score(docs.select("doc_id", "text"), model, "score")
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs``, columns and all, that are not predicted toxic."""
    score = unused(docs, "score")
    return with_score(docs, fit(docs, labels, per_class), score).filter(F.col(score) < 0.5).drop(score)
