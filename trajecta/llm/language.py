"""Language identification by a bidirectional gated recurrent network over bytes.

Two small GRUs read a text forwards and backwards, a softmax over both states labels every
byte, and a document's probabilities are the means over its bytes.  The network is trained in
numpy by backpropagation through time.  Texts are read whole, in segments of fixed length, so
that thousands of segments advance together, one byte at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.llm.learning import one_text, remainder

FOLDS, HELD = 3, 1
PER_LANGUAGE = 400  # documents of each language that the network is trained on
SEGMENTS_EACH = 6  # training segments of a document, evenly spaced over its text
SEGMENT = 96
STATES = 8
STEPS = 300
BATCH = 96
UNDETERMINED = "und"
_SEED = 3
_ROWS = 4096  # segments that advance together
_READ_BYTES = 1 << 20
_SLICES = 16
_PAD = 256
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)] + [_PAD], np.int64)


@dataclass(frozen=True)
class Network:
    """Per direction: a row of gate inputs for each byte, and the recurrent weights; the output layer."""

    languages: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def segments(text: bytes) -> np.ndarray:
    """Bytes of a text in rows of ``SEGMENT``, the last one padded."""
    data = np.frombuffer(text, np.uint8)
    rows = np.full(-(-len(data) // SEGMENT) * SEGMENT, _PAD, np.int16)
    rows[: len(data)] = data
    return _LOWER[rows].reshape(-1, SEGMENT)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _run(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: bool = False):
    """States after each step of ``x`` (steps, rows); with ``keep`` also what the way back needs."""
    n = u.shape[0]
    steps, rows = x.shape
    h = np.zeros((rows, n), np.float32)
    states = np.empty((steps, rows, n), np.float32)
    kept = []
    for t in range(steps):
        g = table[x[t]]
        hu = h @ u
        zr = _sigmoid(g[:, : 2 * n] + hu[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        new = np.tanh(g[:, 2 * n :] + r * hu[:, 2 * n :])
        if keep:
            kept.append((h, zr, hu[:, 2 * n :], new))
        h = new + z * (h - new)
        states[t] = h
    return states, kept


def _run_back(x, table, u, kept, d_states):
    """Gradients of table and recurrent weights from those of the states."""
    n = u.shape[0]
    d_table, d_u = np.zeros_like(table), np.zeros_like(u)
    d_h = np.zeros_like(d_states[0])
    for t in range(len(x) - 1, -1, -1):
        h, zr, hun, new = kept[t]
        z, r = zr[:, :n], zr[:, n:]
        d_h = d_h + d_states[t]
        d_new = d_h * (1 - z) * (1 - new * new)
        d_z = d_h * (h - new) * z * (1 - z)
        d_r = d_new * hun * r * (1 - r)
        d_gate = np.concatenate([d_z, d_r, d_new], axis=1)
        np.add.at(d_table, x[t], d_gate)
        d_hu = np.concatenate([d_z, d_r, d_new * r], axis=1)
        d_u += h.T @ d_hu
        d_h = d_h * z + d_hu @ u.T
    return d_table, d_u


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def loss_and_gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray):
    """Mean cross entropy of all bytes of ``x`` (rows, steps) with label ``y`` of their row."""
    tables, us, out, bias = params[0:2], params[2:4], params[4], params[5]
    forth = x.T
    back = forth[::-1]
    f, kept_f = _run(forth, tables[0], us[0], True)
    b, kept_b = _run(back, tables[1], us[1], True)
    both = np.concatenate([f, b[::-1]], axis=2)
    p = _softmax(both @ out + bias)
    real = (forth != _PAD)[:, :, None]
    count = max(1, int(real.sum()))
    at = p[np.arange(len(forth))[:, None], np.arange(len(x))[None], y[None]]
    loss = -np.log(np.maximum(at, 1e-9))[real[:, :, 0]].sum() / count
    d = p.copy()
    d[np.arange(len(forth))[:, None], np.arange(len(x))[None], y[None]] -= 1
    d = (d * real / count).astype(np.float32)
    d_both = d @ out.T
    n = us[0].shape[0]
    d_tf, d_uf = _run_back(forth, tables[0], us[0], kept_f, d_both[:, :, :n])
    d_tb, d_ub = _run_back(back, tables[1], us[1], kept_b, d_both[::-1, :, n:])
    flat = both.reshape(-1, both.shape[2])
    return loss, [d_tf, d_tb, d_uf, d_ub, flat.T @ d.reshape(-1, d.shape[2]), d.sum(axis=(0, 1))]


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = STEPS, states: int = STATES) -> Network:
    """Fit on segments ``x`` with language numbers ``y`` by Adam over balanced batches."""
    rng = np.random.default_rng(_SEED)
    params = [
        *(rng.normal(0, 0.3, (_PAD + 1, 3 * states)).astype(np.float32) for _ in range(2)),
        *(rng.normal(0, 0.3, (states, 3 * states)).astype(np.float32) for _ in range(2)),
        rng.normal(0, 0.3, (2 * states, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    ]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    of = [np.flatnonzero(y == c) for c in range(len(languages))]
    for step in range(1, steps + 1):
        classes = rng.integers(len(languages), size=BATCH)
        rows = np.array([of[c][rng.integers(len(of[c]))] for c in classes])
        _, grads = loss_and_gradients(params, x[rows], y[rows])
        rate = 0.02 * (1 - step / (steps + 1))
        for p, g, m, v in zip(params, grads, mean, square):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(languages, params[0:2], params[2:4], params[4], params[5])


def probabilities(network: Network, x: np.ndarray) -> np.ndarray:
    """Sum of the byte probabilities of each segment row of ``x``."""
    forth = np.ascontiguousarray(x.T)
    f, _ = _run(forth, network.inputs[0], network.recurrent[0])
    b, _ = _run(forth[::-1], network.inputs[1], network.recurrent[1])
    n = f.shape[2]
    logits = f @ network.out[:n]
    logits += b[::-1] @ network.out[n:]
    logits += network.bias
    p = np.exp(logits, out=logits)  # states lie in (-1, 1), so nothing overflows
    p *= (forth != _PAD)[:, :, None] / p.sum(axis=2, keepdims=True)
    return p.sum(axis=0, dtype=np.float64)


def _documents(texts: list[bytes | None], network: Network) -> tuple[list[str], list[float]]:
    """Label and probability of each text; texts are read together."""
    rows = [segments(t) if t else np.empty((0, SEGMENT), np.int64) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
    x = np.concatenate(rows) if rows else np.empty((0, SEGMENT), np.int64)
    pooled = np.zeros((len(texts), len(network.languages)))
    for start in range(0, len(x), _ROWS):
        np.add.at(pooled, owner[start : start + _ROWS], probabilities(network, x[start : start + _ROWS]))
    lengths = np.array([max(1, len(t or b"")) for t in texts])
    pooled /= lengths[:, None]
    best = pooled.argmax(axis=1)
    return [network.languages[k] for k in best], np.clip(pooled.max(axis=1), 0, 1).tolist()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, segments_each: int = SEGMENTS_EACH) -> Network | None:
    """Network learned from documents outside the held-out fold; None without a language.

    ``per_language`` ids of each language are chosen by a hash, each gives one text, and of that
    ``segments_each`` segments are read, evenly spaced.
    """
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(
        remainder(F.col("doc_id"), FOLDS) != HELD
    )
    ids = known.select("doc_id", "lang").distinct().withColumn("spot", F.xxhash64("doc_id"))
    order = Window.partitionBy("lang").orderBy("spot", "doc_id")
    # First within slices of a language, so that no task sees more than the slices' first ids.
    sliced = Window.partitionBy("lang", "slice").orderBy("spot", "doc_id")
    chosen = (
        ids.withColumn("slice", F.pmod(F.xxhash64("spot"), F.lit(_SLICES)))
        .withColumn("place", F.row_number().over(sliced))
        .filter(F.col("place") <= per_language)
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= per_language)
        .select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang"), "place")
    )

    def spread(column: pd.Series) -> pd.Series:
        out = []
        for text in column:
            starts = np.unique(np.linspace(0, max(0, len(text) - SEGMENT), segments_each).astype(int))
            out.append([text[s : s + SEGMENT] for s in starts if text[s : s + SEGMENT].strip()])
        return pd.Series(out, dtype=object)

    # One text of each chosen id: at most per_language rows of a few segments for each language.
    rows = (
        known.select("doc_id", "lang", "text")
        .join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang")))
        .groupBy("lang", "place")
        .agg(one_text())
        .select("lang", "place", F.pandas_udf(spread, "array<binary>")(F.col("text").cast("binary")).alias("x"))
        .toPandas()
    )
    pairs = sorted((lang, place, bytes(s)) for lang, place, x in rows.itertuples(index=False) for s in x)
    if not pairs:
        return None
    languages = sorted({lang for lang, _, _ in pairs})
    x = np.concatenate([segments(s) for _, _, s in pairs])
    return train(x, np.array([languages.index(lang) for lang, _, _ in pairs]), languages)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``.

    Predictions use the text alone, all of it; lang is only read to learn.  A text that is null or
    has no letter is ``und`` with score 0, as is every text if no language is known.  ``score`` is
    the mean probability of the predicted language over the text's bytes; ties go to the language
    that sorts first.  Repeated rows come back repeated, other columns are ignored, and texts are
    not shuffled.
    """
    network = fit(docs, per_language)

    def label(column: pd.Series) -> pd.DataFrame:
        labels: list[str] = []
        scores: list[float] = []
        held, size = [], 0
        for k, text in enumerate(column):
            held.append(text)
            size += len(text or b"")
            if size >= _READ_BYTES or k + 1 == len(column):
                a, b = _documents(held, network)
                labels, scores, held, size = labels + a, scores + b, [], 0
        return pd.DataFrame({"lang_pred": labels, "score": scores})

    held_out = (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out")
    if network is None:
        return docs.select("doc_id", held_out, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    readable = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = F.pandas_udf(label, "lang_pred string, score double")(F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("binary")))
    return docs.select("doc_id", held_out, readable.alias("readable"), found.alias("found")).select(
        "doc_id",
        "held_out",
        F.when(F.col("readable"), F.col("found.lang_pred")).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(F.col("readable"), F.col("found.score")).otherwise(F.lit(0.0)).alias("score"),
    )
