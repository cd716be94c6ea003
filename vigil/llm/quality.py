"""Quality classifier by positive-unlabelled learning.

A linear model on byte and word statistics minimises the non-negative unbiased risk: trusted positives (label 1) stand
against unlabelled documents, with a class prior estimated from the two samples. Rows labelled 0 are never used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm.common import read, sample_ids, span_hashes, text_slices, word_bounds

#: Bounds of the training sample (documents with the smallest hashes of their ids): trusted positives, unlabelled documents.
MAX_POSITIVES = 6000
MAX_UNLABELLED = 10000

BIGRAMS = 1024
STATS = 8
#: Standardised features are scaled so that a row has about this length.
SPREAD = 20
#: Decay of weights: the least, and what is divided by the number of positives.
LEAST_DECAY, DECAY = 1e-5, 0.1
WIDTH = 256 + BIGRAMS + STATS

_KIND = np.zeros(256, np.uint8)
_KIND[np.arange(ord("A"), ord("Z") + 1)] = 1
_KIND[np.arange(ord("0"), ord("9") + 1)] = 2
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of WIDTH features for each text: root frequencies of bytes and of hashed byte pairs, then word statistics."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    row = np.repeat(np.arange(n, dtype=np.int64), sizes)
    single = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    out[:, :256] = np.sqrt(single / np.maximum(sizes, 1)[:, None])
    wide = data.astype(np.uint32)
    pair = (((wide[:-1] * 257 + wide[1:]) * np.uint32(2654435761)) >> np.uint32(22)).astype(np.int64)
    same = row[:-1] == row[1:]
    both = np.bincount((row[:-1] * BIGRAMS + pair)[same], minlength=n * BIGRAMS).reshape(n, BIGRAMS)
    out[:, 256 : 256 + BIGRAMS] = np.sqrt(both / np.maximum(sizes - 1, 1)[:, None])
    kinds = np.bincount(row * 4 + _KIND[data], minlength=n * 4).reshape(n, 4)[:, 1:]
    stats = out[:, 256 + BIGRAMS :]
    stats[:, 0:3] = kinds / np.maximum(sizes, 1)[:, None]
    starts, ends, first = word_bounds(data, offsets)
    words = np.diff(first)
    at = np.repeat(np.arange(n, dtype=np.uint64), words)
    hashes = span_hashes(data, starts, ends)
    keys = np.sort((at << np.uint64(40)) | (hashes >> np.uint64(24)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    some = np.maximum(words, 1)
    stats[:, 3] = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=n) / some
    again = (hashes[1:] == hashes[:-1]) & (at[1:] == at[:-1])
    stats[:, 4] = np.bincount(at[1:][again].astype(np.int64), minlength=n) / some
    last = _KIND[data[ends - 1]] == 3
    stats[:, 5] = np.bincount(at[last].astype(np.int64), minlength=n) / some
    stats[:, 6] = np.log1p(sizes / some) / 5
    stats[:, 7] = np.log1p(words) / 10
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 700, rate: float = 0.05) -> np.ndarray:
    """Weights and bias that minimise prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1)) with the logistic loss, by Adam.
    Where the second term is negative its gradient is turned round, as the non-negative estimator asks. The fewer positives, the
    stronger weights decay: few can be told from the rest by chance."""
    decay = max(LEAST_DECAY, DECAY / max(1, len(positive)))
    w = np.zeros(positive.shape[1] + 1, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    grad = lambda x, g: np.append(g @ x, g.sum()) / len(x)
    for step in range(1, steps + 1):
        zp, zu = positive @ w[:-1] + w[-1], unlabelled @ w[:-1] + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        rest = grad(unlabelled, _sigmoid(zu)) - prior * grad(positive, _sigmoid(zp))
        g = prior * grad(positive, -_sigmoid(-zp)) + rest if negative >= 0 else -rest
        g = g.astype(np.float32)
        g[:-1] += np.float32(decay) * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(v / np.float32(1 - 0.999**step)) + np.float32(1e-8))
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of tail masses over score thresholds that keep at least
    half of the positives, each ratio raised by two standard errors."""
    cuts = np.quantile(positive, np.linspace(0, 0.5, 51))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    error = np.sqrt(u * (1 - u) / len(unlabelled)) + np.sqrt(p * (1 - p) / len(positive))
    return float(np.clip(((u + 2 * error) / p).min(), 0.02, 0.98))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])


def train(positive: np.ndarray, unlabelled: np.ndarray) -> QualityModel:
    """Standardise (in place), fit with an even prior on half of the rows, estimate the prior on the other half, then fit on all."""
    if not len(positive) or not len(unlabelled):  # nothing to learn from: every text gets the same even score
        return QualityModel(np.zeros(WIDTH + 1), np.zeros(WIDTH), np.ones(WIDTH), 0.5)
    mean, scale = unlabelled.mean(0), (unlabelled.std(0) + 1e-2) * np.sqrt(WIDTH) / SPREAD
    p, u = positive, unlabelled
    for part in (p, u):
        part -= mean
        part /= scale
    w, prior = fit_risk(p[::2], u[::2], 0.5), 0.5
    if min(len(p), len(u)) > 20:
        for _ in range(2):
            prior = estimate_prior(p[1::2] @ w[:-1], u[1::2] @ w[:-1])
            w = fit_risk(p[::2], u[::2], prior)
    w = fit_risk(p, u, prior)
    return QualityModel(w.astype(float), mean, scale, prior)


def fold(id_col: str = "doc_id"):
    """crc32 of the id's text modulo 5; fold 0 is held out of training. A null id falls in no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit_quality(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> QualityModel:
    """Learn from a bounded sample. Ids and labels only are sorted for it; whole texts of the sample alone become features.

    Trusted positives: documents whose label is 1, unlabelled: any documents, both outside fold 0. Null labels and ids are no
    positives; an id that is labelled both ways counts as labelled 1.
    """
    open_ids = lambda df, n: sample_ids(df.where(fold() != 0), "doc_id", n)
    chosen = open_ids(labels.where("quality = 1"), max_positives).withColumn("kind", F.lit(1)).union(open_ids(docs, max_unlabelled).withColumn("kind", F.lit(0)))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("kind", "text")

    def measured(batches):
        for b in batches:
            for first, end, data, offsets in text_slices(b.column(1)):
                yield pa.record_batch([b.column(0).slice(first, end - first), pa.array([r.tobytes() for r in features(data, offsets)], pa.binary())], names=["kind", "x"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.empty((len(rows), WIDTH), np.float32)
        for k, raw in enumerate(rows.x):
            x[k] = np.frombuffer(raw, np.float32)
        order = np.lexsort(x[:, ::-37].T)  # the same order whatever tasks the rows came from
        order = order[np.random.default_rng(7).permutation(len(order))]
        kind = rows.kind.to_numpy()[order]
        model = train(x[order[kind == 1]], x[order[kind == 0]])
        return pd.DataFrame({"weights": [model.weights.tolist()], "mean": [model.mean.tolist()], "scale": [model.scale.tolist()], "prior": [model.prior]})

    got = sample.mapInArrow(measured, "kind int, x binary").withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, "weights array<double>, mean array<double>, scale array<double>, prior double").first()
    if got is None:
        return train(np.zeros((0, WIDTH)), np.zeros((0, WIDTH)))
    return QualityModel(np.array(got.weights), np.array(got.mean), np.array(got.scale), got.prior)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col (0 to 1, higher: better) behind its own columns; a column of that name is replaced. Null and empty
    texts get the model's score of an empty text."""
    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            scores = [model.score(features(data, offsets)) for _, _, data, offsets in text_slices(b.column(at))]
            yield pa.record_batch([*b.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*b.schema.names, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """score_quality() of all documents by a model of fit_quality(); odd rows as there."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
