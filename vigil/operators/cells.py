"""A stored inverted file for vector search: vectors in folders of their nearest centres, searched by visiting a few of them.

Centres come from a bounded sample, every usable vector is filed. A search reads the folders of the cells that its queries visit and no
others; inside a cell, queries and items meet in blocks that each keep the best k, so a cell's size or its number of queries bounds no task.
How many cells are visited is set from the sample's own neighbours, and the answer says what share of the cells that was.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.operators.vectors import ITEM_ROWS, QUERY_ROWS, best_of, cosine, moderate, usable

#: Vectors that centres are fitted on, and of these the ones whose neighbours among the sample set the number of visits.
SAMPLE, TRIED = 20_000, 500


@dataclass(frozen=True)
class CellIndex:
    """path: the filed vectors (item_id, v, cell); centres: a unit vector for each cell; probes: cells that a search visits."""

    path: str
    centres: np.ndarray
    probes: int

    @property
    def share(self) -> float:
        """The share of cells that a search visits."""
        return self.probes / len(self.centres)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _centres(x: np.ndarray, cells: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty cell gets the vector that its own centre fits least."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=cells) == 0)
        if len(empty):
            sums[empty] = x[np.argsort((x * c[near]).sum(1))[: len(empty)]]
        c = _unit(np.where(np.linalg.norm(sums, axis=1)[:, None] > 0, sums, c))
    return c


def _visits(x: np.ndarray, c: np.ndarray, k: int, target: float, tried: int) -> int:
    """The least number of visited cells that hold the target share of the k nearest of tried vectors among x."""
    q = x[:tried]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -2
    nearest = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1)  # of each cell in the order of visits
    needed = np.take_along_axis(place, (x @ c.T).argmax(1)[nearest], 1)
    return int(np.quantile(needed, target, method="higher")) + 1


def build_cells(corpus: DataFrame, path: str, cells: int, item_id: str = "item_id", vector: str = "embedding", target: float = 0.97, k: int = 10, sample: int = SAMPLE, seed: int = 42) -> CellIndex:
    """File the usable vectors of corpus, which have one length, under path. Fewer vectors than cells make a cell each."""
    spark = corpus.sparkSession
    rows = corpus.where(usable(F.col(vector))).select(F.col(item_id).alias("item_id"), moderate(F.col(vector)).alias("v"))
    n = rows.count()
    share = min(1.0, 1.5 * sample / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64("item_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("v"), "item_id").limit(sample)
    x = np.array([r.v for r in drawn.select("v").collect()], float)
    if not len(x):
        raise ValueError("no usable vectors")
    x = _unit(x)
    centres = _centres(x, min(cells, len(x)), seed)
    probes = min(len(centres), _visits(x, centres, min(k, max(1, len(x) - 1)), target, TRIED))

    def file(batches):
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((_unit(v) @ centres.T).argmax(1).astype(np.int32))], names=["item_id", "v", "cell"])

    kind = rows.schema["item_id"].dataType.simpleString()
    filed = rows.mapInArrow(file, f"item_id {kind}, v array<double>, cell int")
    part = F.pmod(F.xxhash64("item_id"), F.lit(max(1, n // (len(centres) * ITEM_ROWS)))).cast("int")  # a large cell is written by several tasks
    filed.repartition("cell", part).write.mode("overwrite").partitionBy("cell").parquet(f"{path.rstrip('/')}/vectors")
    meta = json.dumps({"centres": centres.tolist(), "probes": probes})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/centres")
    return CellIndex(path, centres, probes)


def open_cells(spark: SparkSession, path: str) -> CellIndex:
    """An index that build_cells() stored."""
    meta = json.loads("".join(r.value for r in spark.read.text(f"{path.rstrip('/')}/centres").collect()))  # one line
    return CellIndex(path, np.array(meta["centres"]), meta["probes"])


def search_cells(queries: DataFrame, index: CellIndex, k: int = 3, probes: int | None = None, query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """query_id, item_id, similarity (3 digits), rank: like vectors.similar(), among the items of the cells that each query visits.

    Queries that are not usable, or of another length, have no rows. The folders of cells that no query visits are not read."""
    spark, centres = queries.sparkSession, index.centres
    visits = min(len(centres), probes or index.probes)
    asked = queries.where(usable(F.col(vector)) & (F.size(vector) == centres.shape[1])).select(F.col(query_id).alias("query_id"), moderate(F.col(vector)).alias("v"))

    def visit(batches):
        for b in batches:
            if b.num_rows:
                v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                near = np.argpartition(-(_unit(v) @ centres.T), visits - 1, axis=1)[:, :visits]
                rows = np.repeat(np.arange(b.num_rows), visits)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(near.ravel().astype(np.int32))], names=["query_id", "v", "cell"])

    kind = lambda df, name: df.schema[name].dataType.simpleString()
    visiting = asked.mapInArrow(visit, f"query_id {kind(asked, 'query_id')}, v array<double>, cell int")
    items = spark.read.parquet(f"{index.path.rstrip('/')}/vectors")
    loads = visiting.groupBy("cell").agg(F.count("*").alias("n")).collect()  # a row for each cell
    blocks = {r.cell: -(-r.n // QUERY_ROWS) for r in loads}
    items = items.where(F.col("cell").isin(sorted(blocks)))
    parts = {r.cell: -(-r.n // ITEM_ROWS) for r in items.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    number = lambda table: F.coalesce(F.get(F.lit([table.get(c, 1) for c in range(len(centres))]), F.col("cell")), F.lit(1))
    deal = lambda name, n: F.pmod(F.xxhash64(name, "v"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q = visiting.select("*", deal("query_id", number(blocks)).alias("block"), every(number(parts)).alias("part"))
    c = items.select("*", deal("item_id", number(parts)).alias("part"), every(number(blocks)).alias("block"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        r, at = (np.zeros(0, int), np.zeros(0, int))
        if a.num_rows and b.num_rows:
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            r, at = best_of(matrix(a), matrix(b), k)
        mine, found = a.take(r), b.take(at)
        return pa.table({"query_id": mine.column("query_id"), "item_id": found.column("item_id"), "q": mine.column("v"), "c": found.column("v")})

    near = q.groupBy("cell", "block", "part").cogroup(c.groupBy("cell", "block", "part")).applyInArrow(best, f"query_id {kind(q, 'query_id')}, item_id {kind(c, 'item_id')}, q array<double>, c array<double>")
    scored = near.select("query_id", "item_id", cosine(F.col("q"), F.col("c")).alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "item_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "item_id", F.round("s", 3).alias("similarity"), "rank")
