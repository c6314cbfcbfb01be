"""Quality by hierarchical empirical Bayes over sites.

A logistic regression on the shape of a whole text gives each document's
evidence. Grouped aggregation gives the mean evidence of each host and of each
path below it; a path is shrunk towards its host and a host towards the whole
corpus, the more the fewer documents it has, by strengths that are themselves
estimated from the spread between sites. A document's posterior log-odds are
its own evidence plus what its path adds to the global prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams as G
from .common import cut, frugal

TRAIN_ROWS = 30_000
FEATURES = ("log_words", "upper", "digit", "symbol", "pipe", "space", "other_script", "newline", "word_length", "distinct_words", "distinct_bigrams", "short")
CLIP = 1e-6


def _lookup(test) -> np.ndarray:
    return np.array([test(i) for i in range(256)], np.float64)


_LETTER = [65 <= i < 91 or 97 <= i < 123 or i >= 0xC0 for i in range(256)]
_CLASSES = np.stack([
    _lookup(lambda i: 65 <= i < 91), _lookup(lambda i: 48 <= i < 58), _lookup(lambda i: 33 <= i < 127 and not _LETTER[i] and not 48 <= i < 58 and chr(i) not in ".,'\"-|"),
    _lookup(lambda i: i == 124), _lookup(lambda i: i in (9, 32)), _lookup(lambda i: i >= 128), _lookup(lambda i: i == 10),
])


def _distinct(keys: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each of n rows."""
    both = (rows.astype(np.uint64) << np.uint64(48)) | (keys >> np.uint64(16))
    return np.bincount((np.unique(both) >> np.uint64(48)).astype(np.int64), minlength=n)[:n]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; zeros for one without a byte."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    length = np.diff(offsets).astype(float)
    some = np.maximum(length, 1)
    if len(data):
        for k, table in enumerate(_CLASSES):
            total = np.concatenate([[0], np.cumsum(table[data])])
            out[:, k + 1] = (total[offsets[1:]] - total[offsets[:-1]]) / some
    starts, ends, rows = G.spans(data, offsets)
    words = np.bincount(rows, minlength=n)[:n].astype(float)
    if len(starts):
        h = G.span_hashes(data, starts, ends)
        out[:, 8] = np.bincount(rows, ends - starts, minlength=n)[:n] / np.maximum(words, 1)
        # Distinct words fall off with length, so they count against the square root.
        out[:, 9] = np.log1p(_distinct(h, rows, n)) - 0.8 * np.log1p(words)
        pair, at = G.ngrams(h, rows, 2)
        out[:, 10] = _distinct(pair, at, n) / np.maximum(np.bincount(at, minlength=n)[:n], 1)
    out[:, 0] = np.log1p(words)
    out[:, 11] = words < 20
    out[length == 0] = 0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.column_stack([z, z[:, :11] ** 2, np.ones(len(z))])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Model:
    """Logistic regression with squares, by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = _design(x, mean, scale)
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step * min(1.0, 3 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, w)


def evidence(model: Model, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(x, model.mean, model.scale) @ model.weights, -13, 13)))


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(data, offsets) for _, _, data, offsets in G.text_chunks(batch)]
        x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], ["id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = TRAIN_ROWS) -> Model | None:
    """Fits on at most ``max_rows`` labelled rows, those first in hash order of the id; None without any."""
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).dropna().join(F.broadcast(known), "id").select("id", "text", "y")
    got = rows.mapInArrow(frugal(_columns), "id long, y int, x array<double>").orderBy("id", "x").toArrow()
    if not got.num_rows:
        return None
    x = np.array(got.column("x").combine_chunks().flatten()).reshape(got.num_rows, -1)
    return fit(x, got.column("y").to_numpy().astype(float))


def _evidence(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            rows = [features(data, offsets) for _, _, data, offsets in G.text_chunks(batch)]
            x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
            p = evidence(model, x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(p)], ["doc_id", "host", "path", "evidence"])

    return run


def strength(sites: DataFrame, prior: str, within: float) -> float:
    """Prior documents of a Beta prior by the method of moments.

    The spread of site means about their prior, less what sampling explains,
    against ``within``, the variance of one document's evidence.
    """
    row = sites.agg(F.sum("n"), F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(prior)) ** 2), F.count("*")).first()
    n, spread, k = (float(x or 0) for x in row)
    if n == 0 or k < 2:
        return 1e6
    between = max((spread - k * within) / n, 0.0)
    return min(within / between, 1e6) if between > 0 else 1e6


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = 0.5) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, quality, keep) of every row.

    A null host or path is the site "". Null and empty texts count as texts
    without words; texts of any length are read whole. A quality that equals
    the threshold is kept. Ids may be null or repeat; other columns are
    ignored; an empty table gives no rows. Documents are read once: their evidence is kept
    as a narrow table, and site posteriors are joined to it.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), blank(host_col).alias("host"), blank(path_col).alias("path"))
    marks = cut(rows.mapInArrow(frugal(_evidence(held)), "doc_id long, host string, path string, evidence double"))
    paths = cut(marks.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("q")))
    n, s, q = (float(x or 0) for x in paths.agg(F.sum("n"), F.sum("s"), F.sum("q")).first())
    mean = min(max(s / n, CLIP), 1 - CLIP) if n else 0.5
    within = max(q / n - mean * mean, 1e-9) if n else 1.0
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("mean", F.lit(mean))
    k = strength(hosts, "mean", within)
    hosts = hosts.select("host", ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_posterior"))
    paths = paths.join(hosts, "host")
    k = strength(paths, "host_posterior", within)
    sites = paths.select("host", "path", "host_posterior", ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"))
    logit = lambda p: F.log(p / (1 - p))
    squeeze = lambda c: F.least(F.greatest(F.col(c), F.lit(CLIP)), F.lit(1 - CLIP))
    odds = logit(squeeze("evidence")) + logit(squeeze("path_posterior")) - F.lit(float(np.log(mean / (1 - mean))))
    out = marks.join(sites, ["host", "path"]).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= threshold).alias("keep"))
