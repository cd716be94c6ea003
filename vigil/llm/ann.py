"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample. Every vector is filed under its centroid with the code of
its residual. A query visits the lists of its best centroids and ranks their vectors by asymmetric distance tables; those that the
sample's scores say may be among the best are scored again exactly. Some queries are compared with all vectors first: their true
neighbours set how many lists are visited and how far down the guessed scores exact ones are computed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import cut, read, sample_ids

#: Bound of the sample the index is fitted on (rows with the smallest hashes of their ids), and of its lists.
SAMPLE_ROWS = 20_000
MAX_LISTS = 4096
CODES = 256
PART_DIMS = 8
#: Queries that are compared with all vectors, share of their neighbours whose lists must be visited, and share that must reach a limit.
TRIED = 256
TARGET = 0.96
REACHED = 0.99
#: Vectors in a cell (some short lists or a block of a long one) as long as there are at most MAX_CELLS cells, queries per block, and
#: components of candidates that are scored exactly at once.
CELL_ROWS = 1024
MAX_CELLS = 4096
QUERY_ROWS = 200_000
SCORED = 1 << 22
#: Sample rows whose scores tell a query what is worth scoring exactly or returning, how many candidates each query expects to score
#: exactly in all at least, and by how much more of the sample than its share is taken for safety.
JUDGES = 4096
EXPECTED = 1024
SPARE = 1.5


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's rounds; empty ones are drawn anew."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, 1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x dims
    books: list[np.ndarray]  # for each part of the dims: codes x width
    parts: list[tuple[int, int]]
    probes: int
    judges: np.ndarray  # vectors of the sample
    rows: int  # vectors in all
    spread: tuple[float, float] = (1.0, 1.0)  # by how much more than expected must reach the guessed and the exact limit

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and residual codes of each vector."""
        lists = _nearest(x, self.centroids)
        rest = x - self.centroids[lists]
        return lists, np.stack([_nearest(rest[:, a:b], book) for (a, b), book in zip(self.parts, self.books, strict=True)], 1).astype(np.uint8)

    def restored(self, x: np.ndarray) -> np.ndarray:
        """What the codes of vectors say they are."""
        lists, codes = self.code(x)
        return self.centroids[lists] + np.concatenate([book[c] for book, c in zip(self.books, codes.T, strict=True)], 1)

    def limits(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the guessed score that about EXPECTED vectors reach and the exact one that more than k reach, as far as the
        sample can tell, or the multiples of both in `spread`; half a millionth below, so that rounding decides nothing. Where that is
        all of the sample there is no limit."""
        out = []
        for x, wanted, spread in ((self.restored(self.judges), EXPECTED, self.spread[0]), (self.judges, k, self.spread[1])):
            n = spread * (SPARE * wanted * len(x) / max(self.rows, 1) + 8)
            if n >= len(x):
                out.append(np.full(len(q), -np.inf))
                continue
            n = int(np.ceil(n))
            edge = np.concatenate([np.partition(q[i : i + 256] @ x.T, len(x) - n, axis=1)[:, len(x) - n] for i in range(0, len(q), 256)] or [np.zeros(0)])
            out.append(edge - 5e-7 * np.abs(edge))
        return out[0], out[1]

    def visits(self, q: np.ndarray) -> np.ndarray:
        """The lists that each query visits, best first."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]

    def guessed(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The guessed score of a filed vector for each query."""
        return (q * (self.centroids[lists] + np.concatenate([book[c] for book, c in zip(self.books, codes.T, strict=True)], 1))).sum(1)

    def fitted(self, q: np.ndarray, places: np.ndarray, who: np.ndarray, guess: np.ndarray, score: np.ndarray, k: int) -> Index:
        """The index with as many visits and such limits as the true neighbours of some queries need. places: of a neighbour's list in
        the order of visits; who: its query; guess and score: its guessed and exact score."""
        index = replace(self, probes=min(len(self.centroids), int(np.quantile(places, TARGET, method="higher")) + 1))
        for side, reached in enumerate((guess, score)):
            while index.spread[side] < len(self.judges) and (reached >= index.limits(q, k)[side][who]).mean() < REACHED:  # there is no limit at last
                spread = list(index.spread)
                spread[side] *= 2
                index = replace(index, spread=tuple(spread))
        return index


def fit_index(sample: np.ndarray, rows: int, k: int = 20, seed: int = 11) -> Index:
    """Fit centroids, codebooks and the number of visited lists on the sample; rows: how many vectors there are in all."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    lists = int(min(MAX_LISTS, max(1, 2 ** round(np.log2(max(rows, 1)) / 2 - 1)), max(1, len(sample) // 4)))
    centroids = _kmeans(sample, lists, rng)
    own = _nearest(sample, centroids)
    rest = sample - centroids[own]
    parts = [(a, min(a + PART_DIMS, dims)) for a in range(0, dims, PART_DIMS)]
    books = [_kmeans(rest[:, a:b], CODES, rng, 6) for a, b in parts]
    who = rng.choice(len(sample), min(400, len(sample)), replace=False)
    ask = sample[who]
    score = ask @ sample.T
    score[np.arange(len(who)), who] = -np.inf  # none is its own neighbour
    top = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
    rank = np.argsort(np.argsort(-(ask @ centroids.T), axis=1), axis=1)
    need = np.take_along_axis(rank, own[top], 1).ravel()
    probes = int(np.quantile(need, TARGET)) + 1 if len(need) else len(centroids)
    judges = sample[rng.choice(len(sample), min(JUDGES, len(sample)), replace=False)]
    return Index(centroids, books, parts, min(probes, len(centroids)), judges, rows)


def search_cell(index: Index, q: np.ndarray, q_ids: np.ndarray, visits: list[np.ndarray], limits: tuple[np.ndarray, np.ndarray], v: np.ndarray, ids: np.ndarray, lists: np.ndarray, codes: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best vectors of a cell at most for each query, as far as they reach its limits: query, vector and score arrays. Vectors
    stand in order of their ids."""
    out = [[], [], []]
    rows_of = {int(m): np.flatnonzero(lists == m) for m in np.unique(lists)}
    step = max(1, SCORED // v.shape[1])
    for first in range(0, len(q), 64):
        part = q[first : first + 64]
        guess = np.full((len(part), len(v)), -np.inf)
        coarse = part @ index.centroids.T
        tables = [part[:, a:b] @ book.T for (a, b), book in zip(index.parts, index.books, strict=True)]
        wanted: dict[int, list[int]] = {}
        for i, seen in enumerate(visits[first : first + 64]):
            for m in seen.tolist():
                if m in rows_of:
                    wanted.setdefault(m, []).append(i)
        for m, who in wanted.items():
            rows, who = rows_of[m], np.array(who)
            score = np.repeat(coarse[who, m][:, None], len(rows), 1)
            for table, code in zip(tables, codes[rows].T, strict=True):
                score += table[who][:, code]
            guess[np.ix_(who, rows)] = score
        least, lowest = (x[first : first + 64] for x in limits)
        near = (guess >= least[:, None]) & np.isfinite(guess) & (ids != q_ids[first : first + 64, None])
        i, at = np.nonzero(near)
        exact = np.concatenate([(v[at[a : a + step]] * part[i[a : a + step]]).sum(axis=1) for a in range(0, len(i), step)] or [np.zeros(0)])
        reach = exact >= lowest[i]
        i, at, exact = i[reach], at[reach], exact[reach]
        order = np.lexsort((ids[at], -exact, i))
        i, at, exact = i[order], at[order], exact[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        for x, y in zip(out, (q_ids[first : first + 64][i], ids[at], exact), strict=True):
            x.append(y[best])
    return [np.concatenate(x) if x else np.zeros(0) for x in out]


def _usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not zero."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return F.coalesce(fine & F.exists(x, lambda a: a != 0), F.lit(False))


def _judged(index: Index, filed: DataFrame, asked: DataFrame, k: int) -> Index:
    """The index with visits and limits set from the true neighbours, among all filed vectors, of the TRIED asked rows with the smallest
    hashes of their ids. One pass over the vectors; each task sends k rows for each of these queries."""
    tried = asked.orderBy(F.xxhash64("id"), "id").limit(TRIED).toArrow()
    if not tried.num_rows:
        return index
    q_ids, q = tried.column("id").to_numpy(), np.asarray(tried.column("v").combine_chunks().flatten()).reshape(tried.num_rows, -1)
    places = np.argsort(np.argsort(-(q @ index.centroids.T), axis=1, kind="stable"), axis=1)

    def compare(batches):
        best = None  # of each query: scores, places and guesses
        for b in batches:
            if not b.num_rows:
                continue
            v, lists = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1), b.column(2).to_numpy()
            codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(b.num_rows, len(index.parts))
            score = q @ v.T
            score[b.column(0).to_numpy() == q_ids[:, None]] = -np.inf
            at = np.argpartition(-score, min(k, b.num_rows) - 1, axis=1)[:, :k]
            who = np.repeat(np.arange(len(q)), at.shape[1])
            guess = index.guessed(q[who], lists[at.ravel()], codes[at.ravel()]).reshape(at.shape)
            new = np.stack([np.take_along_axis(score, at, 1), np.take_along_axis(places, lists[at], 1), guess])
            best = new if best is None else np.concatenate([best, new], axis=2)
            top = np.argsort(-best[0], axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(best, top[None], 2)
        if best is not None:
            who = np.repeat(np.arange(len(q)), best.shape[2])
            real = np.isfinite(best[0].ravel())
            yield pa.record_batch([pa.array(who[real]), *(pa.array(x.ravel()[real]) for x in best)], names=["who", "score", "place", "guess"])

    order = Window.partitionBy("who").orderBy(F.desc("score"), "place")
    found = filed.select("id", "v", "list", "code").mapInArrow(compare, "who long, score double, place double, guess double")
    true = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).toArrow()  # TRIED * k rows at most
    if not true.num_rows:
        return index
    who, score, place, guess = (true.column(c).to_numpy() for c in ("who", "score", "place", "guess"))
    return index.fitted(q, place, who, guess, score, k)


def nearest(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows found for each row that `queries` (a condition on the id) selects.

    Rows with a null id, or a vector that is null, zero, holds null or non-finite components, or has another length than most,
    take no part. Repeated rows of a query count as one query, and none of its own id is its neighbour; other repeated rows are
    neighbours each. Equal scores go to the smaller id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    common = whole.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if common is None:
        return spark.createDataFrame([], schema)
    dims, total = common["dims"], common["count"]
    rows = whole.where(F.size("v") == dims)
    chosen = rows.join(F.broadcast(sample_ids(rows, "id", SAMPLE_ROWS)), "id", "left_semi").limit(SAMPLE_ROWS)
    sample = chosen.orderBy("id").select("v").toArrow().column(0).combine_chunks()
    index = fit_index(np.asarray(sample.flatten()).reshape(-1, dims), total, k)

    def matrix(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(column.flatten()).reshape(-1, dims)

    def file(batches):
        for b in batches:
            lists, codes = index.code(matrix(b.column(1)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(lists, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "v", "list", "code"])

    filed = cut(rows.mapInArrow(file, "id long, v array<double>, list int, code binary"))
    sizes = {r.list: r.n for r in filed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row for each list
    first, blocks, cell, load = {}, {}, 0, 0
    cell_rows = max(CELL_ROWS, -(-total // MAX_CELLS))
    for m in range(len(index.centroids)):
        n = sizes.get(m, 0)
        if load and load + n > cell_rows:
            cell, load = cell + 1, 0
        first[m], blocks[m] = cell, max(1, -(-n // cell_rows))
        cell, load = (cell + blocks[m], 0) if blocks[m] > 1 else (cell, load + n)

    def visit(batches):
        for b in batches:
            q = matrix(b.column(1))
            who, cells, seen = [], [], []
            for i, lists in enumerate(index.visits(q)):
                by_cell: dict[int, list[int]] = {}
                for m in lists.tolist():
                    for c in range(first[m], first[m] + blocks[m]):
                        by_cell.setdefault(c, []).append(m)
                who += [i] * len(by_cell)
                cells += by_cell
                seen += by_cell.values()
            at = pa.array(who, pa.int64())
            edges = [pa.array(x).take(at) for x in index.limits(q, k)]
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(cells, pa.int32()), pa.array(seen, pa.list_(pa.int32())), *edges], names=["query_id", "q", "cell", "lists", "least", "lowest"])

    names = "query_id long, q array<double>, cell int, lists array<int>, least double, lowest double"
    table = lambda d: F.create_map(*(F.lit(x) for m in d.items() for x in m))
    block = F.pmod(F.xxhash64("id"), F.element_at(table(blocks), F.col("list"))).cast("int")
    held = filed.withColumn("cell", F.element_at(table(first), F.col("list")) + block)

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = [[]] * 3
        if len(asked) and len(held):
            held = held.sort_by("id")
            codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(held), len(index.parts))
            visits = [np.array(x) for x in asked.column("lists").to_pylist()]
            limits = tuple(asked.column(c).to_numpy() for c in ("least", "lowest"))
            found = search_cell(index, matrix(asked.column("q")), asked.column("query_id").to_numpy(), visits, limits, matrix(held.column("v")), held.column("id").to_numpy(), held.column("list").to_numpy(), codes, k)
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    def best(sent: DataFrame, queries: int) -> DataFrame:
        """The best of all cells for each query; queries meet a cell in blocks."""
        turns = queries // QUERY_ROWS + 1
        sent = sent.withColumn("turn", F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int"))
        kept = held.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        found = sent.groupBy("cell", "turn").cogroup(kept.groupBy("cell", "turn")).applyInArrow(search, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return cut(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))

    asked = cut(rows.where(queries).dropDuplicates(["id"]).select("id", "v"))
    index = _judged(index, filed, asked, k)
    found = best(asked.mapInArrow(visit, names), asked.count())
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = cut(asked.join(full, "id", "left_anti"))  # queries whose lists or limits held too few: these see all
    if lacking := short.count():
        every = sorted({c for m in first for c in range(first[m], first[m] + blocks[m])})
        lists = {c: [m for m in first if first[m] <= c < first[m] + blocks[m]] for c in every}
        seen = F.element_at(F.create_map(*(x for c, ms in lists.items() for x in (F.lit(c), F.array(*map(F.lit, ms))))), F.col("cell"))
        sent = short.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.explode(F.array(*map(F.lit, every))).alias("cell"))
        sent = sent.select("*", seen.alias("lists"), F.lit(float("-inf")).alias("least"), F.lit(float("-inf")).alias("lowest"))
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(best(sent, lacking))
    return found.select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nearest() for every twentieth row of embeddings, against all; odd rows as there."""
    return nearest(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
