"""Anomaly scores of sources from their behaviour: an isolation forest, or an autoencoder.

Trees are built in parallel from bounded samples and sent to all tasks (a few thousand numbers each); the network has 76 weights.
Scores are scaled to 0..1 over all sources and rounded to four digits.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.shared import stored
from vigil.operators.features import FEATURES, MIN_SOURCES, behaviour

TREES = 200
SAMPLE = 256
SEED = 42


def _average_path(n: np.ndarray | float):
    """Expected depth of an unsuccessful search in a tree of n leaves."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """Random splits down to single rows or the depth limit, as arrays: feature (-1: leaf), threshold, left, right, depth."""
    limit = max(1, math.ceil(math.log2(max(len(x), 2))))
    tree: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "depth")}
    todo = [(np.arange(len(x)), 0, -1, "left")]
    while todo:
        rows, depth, parent, side = todo.pop()
        node = len(tree["feature"])
        if parent >= 0:
            tree[side][parent] = node
        part = x[rows]
        spread = np.flatnonzero(part.max(0) > part.min(0)) if len(rows) > 1 else np.zeros(0, int)
        leaf = depth >= limit or not len(spread)
        f = -1 if leaf else int(rng.choice(spread))
        cut = 0.0 if leaf else float(rng.uniform(part[:, f].min(), part[:, f].max()))
        for k, v in (("feature", f), ("threshold", cut), ("left", -1), ("right", -1), ("depth", depth + float(_average_path(len(rows))))):
            tree[k].append(v)
        if not leaf:
            below = part[:, f] <= cut
            todo += [(rows[below], depth + 1, node, "left"), (rows[~below], depth + 1, node, "right")]
    return tree


def path_depths(tree: dict[str, list], x: np.ndarray) -> np.ndarray:
    feature, cut, left, right = (np.array(tree[k]) for k in ("feature", "threshold", "left", "right"))
    at = np.zeros(len(x), int)
    while (inner := feature[at] >= 0).any():
        f = np.where(inner, feature[at], 0)
        step = np.where(x[np.arange(len(x)), f] <= cut[at], left[at], right[at])
        at = np.where(inner, step, at)
    return np.array(tree["depth"])[at]


def scaled(raw: DataFrame) -> DataFrame:
    """source_ip and anomaly_score from source_ip and raw (higher: stranger)."""
    ends = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return raw.crossJoin(F.broadcast(ends)).select("source_ip", F.when(span > 0, F.round((F.col("raw") - F.col("lo")) / span, 4)).otherwise(0.0).alias("anomaly_score"))


def _enough(features: DataFrame) -> int:
    return features.count()


def _nothing(features: DataFrame) -> DataFrame:
    return features.sparkSession.createDataFrame([], "source_ip string, anomaly_score double")


def isolation_forest(features: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """source_ip and anomaly_score. Each tree sees the sources with the smallest hashes of (address, tree), so that results don't
    depend on partitions. Fewer than three sources give no rows."""
    n = _enough(features)
    if n < MIN_SOURCES:
        return _nothing(features)
    scale = 1_000_000
    share = min(scale, math.ceil(scale * 1.5 * sample / n) + 1)
    hashed = lambda t: F.pmod(F.xxhash64("source_ip", t), F.lit(scale))
    drawn = features.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: hashed(t) < share))).withColumn("h", F.xxhash64("source_ip", "tree"))

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        part = rows.sort_values(["h", "source_ip"]).head(sample)
        tree = grow_tree(part[list(FEATURES)].to_numpy(float), np.random.default_rng(seed + int(key[0])))
        return pd.DataFrame({"tree": [int(key[0])], "size": [len(part)], "nodes": [json.dumps(tree)]})

    made = drawn.groupBy("tree").applyInPandas(build, "tree int, size int, nodes string").orderBy("tree").collect()  # `trees` rows
    forest, size = [json.loads(r.nodes) for r in made], float(np.mean([r["size"] for r in made]))

    @F.pandas_udf("double")
    def strangeness(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], 1)
        depth = np.mean([path_depths(t, x) for t in forest], axis=0) if len(x) else np.zeros(0)
        return pd.Series(2.0 ** (-depth / max(float(_average_path(size)), 1e-9)))

    return scaled(features.select("source_ip", strangeness(*FEATURES).alias("raw")))


def _start(d: int, hidden: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    bound = lambda n: 1 / np.sqrt(n)
    return [rng.uniform(-bound(d), bound(d), (d, hidden)), rng.uniform(-bound(d), bound(d), hidden), rng.uniform(-bound(hidden), bound(hidden), (hidden, d)), rng.uniform(-bound(hidden), bound(hidden), d)]


def _gradients(x: np.ndarray, w: list[np.ndarray], size: int) -> tuple[np.ndarray, ...]:
    """Of the squared error over size values, the share of the rows x."""
    z = x @ w[0] + w[1]
    h = np.maximum(z, 0)
    error = 2 * (h @ w[2] + w[3] - x) / size
    back = (error @ w[2].T) * (z > 0)
    return x.T @ back, back.sum(0), h.T @ error, error.sum(0)


def _adam(w: list[np.ndarray], gradients: Callable[[list[np.ndarray]], Iterable[np.ndarray]], epochs: int, rate: float) -> list[np.ndarray]:
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, epochs + 1):
        for k, g in enumerate(gradients(w)):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def train_autoencoder(x: np.ndarray, hidden: int = 4, epochs: int = 200, rate: float = 1e-3, seed: int = SEED) -> list[np.ndarray]:
    """Weights of a hidden layer of rectified units and a linear one, fitted to give back x (standardised) by Adam on all rows."""
    return _adam(_start(x.shape[1], hidden, seed), lambda w: _gradients(x, w, x.size), epochs, rate)


def train_spread(rows: DataFrame, n: int, mean: np.ndarray, spread: np.ndarray, hidden: int = 4, epochs: int = 200, rate: float = 1e-3, seed: int = SEED) -> list[np.ndarray]:
    """train_autoencoder() on all n rows of features wherever they are: in each epoch every partition sums its rows' gradients, and
    the driver adds up one row of 76 numbers a partition."""
    d = len(FEATURES)
    edges = np.cumsum([d * hidden, hidden, hidden * d])

    def gradients(w: list[np.ndarray]) -> list[np.ndarray]:
        def part(batches):
            total = np.zeros(2 * d * hidden + hidden + d)
            for b in batches:
                if b.num_rows:
                    x = (np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], 1) - mean) / spread
                    total += np.concatenate([g.ravel() for g in _gradients(x, w, n * d)])
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

        sums = rows.mapInArrow(part, "g array<double>").collect()
        flat = np.sort(np.array([r.g for r in sums]), axis=0).sum(0)  # in one order, whichever task ends first
        return [g.reshape(p.shape) for g, p in zip(np.split(flat, edges), w, strict=True)]

    return _adam(_start(d, hidden, seed), gradients, epochs, rate)


def autoencoder(features: DataFrame, seed: int = SEED) -> DataFrame:
    """source_ip and anomaly_score, the scaled mean squared error of each source's rebuilt features. The network is trained on all
    sources, where they are. Fewer than three sources give no rows."""
    n = _enough(features)
    if n < MIN_SOURCES:
        return _nothing(features)
    stats = features.agg(*(F.avg(c).alias(f"m_{c}") for c in FEATURES), *(F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES)).first()
    mean = np.array([stats[f"m_{c}"] for c in FEATURES])
    spread = np.array([stats[f"s_{c}"] or 1.0 for c in FEATURES])
    flat = np.concatenate([p.ravel() for p in train_spread(stored(features.select(*FEATURES)), n, mean, spread, seed=seed)])
    d = len(FEATURES)
    w1, b1, w2, b2 = np.split(flat, [4 * d, 4 * d + 4, 8 * d + 4])

    @F.pandas_udf("double")
    def error(*columns: pd.Series) -> pd.Series:
        x = (np.stack([c.to_numpy(float) for c in columns], 1) - mean) / spread
        out = np.maximum(x @ w1.reshape(d, 4) + b1, 0) @ w2.reshape(4, d) + b2
        return pd.Series(((out - x) ** 2).mean(1))

    return scaled(features.select("source_ip", error(*FEATURES).alias("raw")))


DETECTORS = {"isolation_forest": isolation_forest, "autoencoder": autoencoder}


def score_sources(events: DataFrame, detector: str = "isolation_forest") -> DataFrame:
    """source_ip and anomaly_score of the sources in events."""
    return DETECTORS[detector](behaviour(events))
