"""Toxicity: FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Features are hashed words, the beginnings of longer words, word bigrams and
word pairs that skip one word, each counted once for a document. Beginnings
let an insult be known in a form that training hasn't seen. Coordinates have rates of their own, and L1
drives most weights to exact zero, so the model is a short sorted list of
(bucket, weight) that is small enough to broadcast at any corpus size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams as G
from .common import frugal

U64 = np.uint64
TRAIN_ROWS = 30_000
HOLD_OUT = 5
PREFIXES = (4, 5, 6, 7, 8)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float
    bits: int


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each row, as row << bits | bucket, and row offsets."""
    starts, ends, rows = G.spans(data, offsets)
    h = G.span_hashes(data, starts, ends)
    parts, at = [h], [rows]
    for k in PREFIXES:
        longer = ends - starts > k
        parts.append(G.mix(G.span_hashes(data, starts[longer], starts[longer] + k) + U64(k)))
        at.append(rows[longer])
    for gap in (1, 2):
        if len(h) > gap:
            same = rows[gap:] == rows[:-gap]
            parts.append(G.mix(h[:-gap][same] * U64(2 * gap + 1) + h[gap:][same] * G._STEP[gap + 8]))
            at.append(rows[gap:][same])
    key = (np.concatenate(at).astype(np.uint64) << U64(bits)) | (np.concatenate(parts) >> U64(64 - bits))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key, np.searchsorted(key, np.arange(len(offsets), dtype=np.uint64) << U64(bits))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = 8, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of 2**bits buckets and the bias. Rows are visited in a seeded order, the same each time."""
    z, n, bias = np.zeros(1 << bits), np.zeros(1 << bits), [0.0, 0.0]
    rng = np.random.Generator(np.random.PCG64(seed))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        return w

    def bias_weight() -> float:
        zb, nb = bias
        return 0.0 if abs(zb) <= l1 else -(zb - math.copysign(l1, zb)) / ((beta + math.sqrt(nb)) / alpha + l2)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i = rows[k]
            ni = n[i]
            w, wb = weights(z[i], ni), bias_weight()
            p = 1 / (1 + math.exp(-min(max(w.sum() + wb, -35), 35)))
            g = float(p - labels[k])
            if abs(g) < 1e-4:
                continue
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] += g - sigma * w
            n[i] = ni + g * g
            zb, nb = bias
            bias[:] = zb + g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * wb, nb + g * g
    return weights(z, n), bias_weight()


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """Midpoint of the score gap with the best F1 on held-out rows; 0 where one class is missing."""
    if len(np.unique(labels)) < 2:
        return 0.0
    o = np.argsort(-scores, kind="stable")
    s, y = scores[o], labels[o]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(s[:-1] != s[1:], True)
    k = int(np.flatnonzero(last)[np.argmax(f1[last])])
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


MODEL = "buckets array<int>, weights array<double>, bias double, threshold double"


def _lowered(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
    """The texts of a batch alone, lower-cased; nulls stay."""
    return pa.RecordBatch.from_arrays([pc.utf8_lower(batch.column(at))], ["text"])


def _train(bits: int):
    """Features are held once, as views of the arrays that each chunk of texts gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, labels = [], [], []
        for batch in batches:
            for a, b, data, offsets in G.text_chunks(_lowered(batch, 1)):
                key, cuts = features(data, offsets, bits)
                bucket = (key & U64((1 << bits) - 1)).astype(np.int32)
                rows += [bucket[s:e] for s, e in zip(cuts[:-1], cuts[1:])]
                ids.append(batch.column(0).slice(a, b - a).to_numpy())
                labels.append(batch.column(2).slice(a, b - a).to_numpy())
        if rows:
            y, order = np.concatenate(labels).astype(float), np.argsort(np.concatenate(ids), kind="stable")
            rows, y = [rows[i] for i in order], y[order]
            held = np.arange(len(rows)) % HOLD_OUT == 0
            w, bias = fit([r for r, h in zip(rows, held) if not h], y[~held], bits)
            score = np.array([w[r].sum() + bias for r, h in zip(rows, held) if h])
            threshold = best_threshold(score, y[held]) if len(score) else 0.0
            kept = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([kept], pa.list_(pa.int32())), pa.array([w[kept]], pa.list_(pa.float64())), pa.array([bias]), pa.array([threshold])], ["buckets", "weights", "bias", "threshold"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = TRAIN_ROWS, bits: int = 20) -> Model:
    """Fits on at most ``max_rows`` labelled rows, those first in hash order of the id.

    Null labels, ids and texts are skipped. Without labelled rows the model
    has no weights and rejects nothing.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).dropna().join(F.broadcast(known), "id")
    got = rows.select("id", "text", "y").repartition(1).mapInArrow(frugal(_train(bits)), MODEL)
    model = got.first()
    if model is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf, 0.0, bits)
    return Model(np.array(model["buckets"], np.int64), np.array(model["weights"]), model["bias"], model["threshold"], bits)


def scores(texts: pa.RecordBatch, model: Model, dense: np.ndarray) -> np.ndarray:
    """Log-odds of each text of a batch of lower-cased ones."""
    out = [np.zeros(0)]
    for _, _, data, offsets in G.text_chunks(texts):
        key, cuts = features(data, offsets, model.bits)
        total = np.concatenate([[0], np.cumsum(dense[(key & U64((1 << model.bits) - 1)).astype(np.int64)], dtype=np.float64)])
        out.append(total[cuts[1:]] - total[cuts[:-1]] + model.bias)
    return np.concatenate(out)


def _judged(held, at: int, keep: bool):
    """Rows of a batch with the texts in column ``at``: those that aren't toxic, or (id, toxicity, toxic) of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        dense = np.zeros(1 << model.bits, np.float32)
        dense[model.buckets] = model.weights
        for batch in batches:
            score = scores(_lowered(batch, at), model, dense)
            toxic = pa.array(score > model.threshold)
            if keep:
                yield batch.filter(pc.invert(toxic))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(score, -700, 700)))), toxic], ["doc_id", "toxicity", "toxic"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxicity, toxic) of every row, repeated rows each.

    An empty or null text has the bias alone for evidence. A null id stays
    null. Texts of any length are read whole; a score that equals the
    threshold is not toxic. Other columns are ignored; an empty table gives no
    rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(_judged(held, 1, False)), "doc_id long, toxicity double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't toxic, all columns kept, judged and let through in one pass.

    Each row is judged by its own text, whatever its id; see ``score``.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    return docs.mapInArrow(frugal(_judged(held, at, True)), docs.schema)
