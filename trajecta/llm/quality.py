"""Quality by Bradley-Terry pairwise ranking.

Documents get a score that is linear in their features, learned from pairs of a good and a bad
document by logistic loss on the difference of their features.  The scores of all documents are
then cut at the quantile that the share of bad documents gives.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.learning import labelled_sample, remainder
from trajecta.llm.words import shingle_hashes, word_hashes
from trajecta.operators.quantiles import exact_quantiles
from trajecta.session import materialise

FOLDS, HELD = 5, 0
PER_CLASS = 4000  # labelled documents of each class that the model is fitted on
PAIRS = 15_000
CUT = 0.3  # score at the quantile
_BINS = 12
_RIDGE = 1e-3
_SEED = 5

_KIND = np.zeros(256, np.int64)  # other printable ASCII 0
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 11, 12, 13, 32]] = 4
_KIND[10] = 5
_KIND[list(b".,;:'\"?()-")] = 6
_KIND[128:] = 7
_KIND[[*range(9), *range(14, 32), 127]] = 8
FEATURES = 18


def features(text: bytes | None) -> np.ndarray:
    """Length, character kinds, word and line statistics and repetition of a whole text."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    n = len(text)
    kinds = np.bincount(_KIND, np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=9)
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[0] = np.log1p(n)
    out[1:9] = kinds[[0, 2, 3, 4, 5, 6, 7, 8]] / n
    out[9] = kinds[2] / max(1.0, kinds[1] + kinds[2])
    h = word_hashes(text)
    w = len(h)
    if w:
        distinct, counts = np.unique(h, return_counts=True)
        out[10] = (n - kinds[4] - kinds[5]) / w
        out[11] = len(distinct) / w
        out[12] = counts.max() / w
        grams = shingle_hashes(h, 3)
        if len(grams):
            out[13] = 1 - len(np.unique(grams)) / len(grams)
        out[14] = np.log1p(w)
        out[15] = float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0
    if lines:
        out[16] = 1 - len(set(lines)) / len(lines)
        out[17] = np.log1p(w / len(lines))
    return out


@dataclass(frozen=True)
class Ranking:
    """Bin edges of each feature, a weight for each bin, and the raw score at the cut."""

    edges: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _binned(x, self.edges) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``CUT`` at the quantile."""
        return self.shifted(self.raw(x))

    def shifted(self, raw: np.ndarray) -> np.ndarray:
        z = np.clip(raw - self.cut + np.log(CUT / (1 - CUT)), -35, 35)
        return 1 / (1 + np.exp(-z))


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Place of each feature between its edges, as rising steps; linear in the weights."""
    return (x[:, :, None] >= edges[None]).reshape(len(x), -1).astype(np.float64)


def bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float = _RIDGE, rounds: int = 25) -> np.ndarray:
    """Weights w that minimise the mean of log(1 + exp(-w.(good - bad))) over the pairs."""
    x = good - bad
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(x @ w, -35, 35)))
        slope = ridge * w - x.T @ p / len(x)
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def rank(x: np.ndarray, y: np.ndarray, bad_share: float) -> Ranking | None:
    """Ranking of feature rows by preference for label 1; None without both labels."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return None
    levels = np.linspace(0, 1, _BINS + 1)[1:-1]
    # Edges between the classes as well as inside them.
    edges = np.sort(np.concatenate([np.quantile(good, levels, axis=0), np.quantile(bad, levels, axis=0)]).T, axis=1)
    rng = np.random.default_rng(_SEED)
    i, j = rng.integers(len(good), size=PAIRS), rng.integers(len(bad), size=PAIRS)
    b_good, b_bad = _binned(good, edges), _binned(bad, edges)
    w = bradley_terry(b_good[i], b_bad[j])
    # Quantile of the sample, with the classes in their true proportions.
    raw = np.concatenate([b_good @ w, b_bad @ w])
    mass = np.concatenate([np.full(len(good), (1 - bad_share) / len(good)), np.full(len(bad), bad_share / len(bad))])
    order = np.argsort(raw, kind="stable")
    at = int(np.searchsorted(np.cumsum(mass[order]), bad_share * (1 - 1e-9)))
    above = raw[order][min(at + 1, len(raw) - 1)]
    return Ranking(edges, w, float((raw[order][at] + above) / 2))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[Ranking | None, float]:
    """Ranking learned from labelled documents outside the held-out fold, and the share of bad ones."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD, per_class)

    def measured(column: pd.Series) -> pd.Series:
        return pd.Series([features(x) for x in column], dtype=object)

    # At most 2 * per_class rows of eighteen numbers.
    rows = sample.select(
        F.xxhash64("doc_id", F.lit(1)).alias("spot"), "doc_id", "label",
        F.pandas_udf(measured, "array<double>")(F.col("text").cast("binary")).alias("x"),
    ).toPandas()
    if not len(rows):
        return None, 0.0
    rows["tie"] = [tuple(x) for x in rows["x"]]
    rows = rows.sort_values(["spot", "doc_id", "tie"])
    known = labels.filter(F.col("quality").isin(0, 1)).filter(remainder(F.col("doc_id"), FOLDS) != HELD)
    share = known.agg(F.avg(1 - F.col("quality"))).first()[0]
    return rank(np.stack(rows["x"].to_numpy()), rows["label"].to_numpy(), float(share)), float(share)


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Scores use the text alone, all of it.  A null text scores as an empty one, equal texts score
    equally, repeated rows come back repeated.  Without labelled documents of both classes every
    score is 0.5.  The cut is the exact quantile of the scores of all rows at the share of bad
    documents among the labels.  Other columns are ignored; texts are not shuffled.
    """
    model, share = fit(docs, labels, per_class)

    def raw(column: pd.Series) -> pd.Series:
        if model is None or not len(column):
            return pd.Series(np.zeros(len(column)))
        out = [model.raw(np.stack([features(x) for x in column[k : k + 256]])) for k in range(0, len(column), 256)]
        return pd.Series(np.concatenate(out))

    ranked = docs.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        F.pandas_udf(raw, "double")(F.col("text").cast("binary")).alias("raw"),
    )
    score = F.lit(0.5)
    if model is not None:
        ranked = materialise(ranked, "ranked")
        found = exact_quantiles(ranked, "raw", {"cut": share}).first()
        placed = replace(model, cut=found["cut"]) if found else model

        @F.pandas_udf("double")
        def shifted(column: pd.Series) -> pd.Series:
            return pd.Series(placed.shifted(column.to_numpy()))

        score = shifted("raw")
    return ranked.select("doc_id", "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
