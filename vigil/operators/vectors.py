"""Similar techniques: cosine neighbours, mean query vectors, embeddings of texts."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and items of a group of similar(), about.
QUERY_ROWS = 1_000
ITEM_ROWS = 10_000
#: Queries of a group of similar_in_cells(), about: every item of a cell goes to each group of its queries.
CELL_QUERIES = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def mean_vector(rows: DataFrame, vector: str = "embedding", keys: tuple[str, ...] = ()) -> DataFrame:
    """The component-wise mean vector of each group."""
    parts = rows.select(*keys, F.posexplode(vector).alias("p", "x")).groupBy(*keys, "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    pack = F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias(vector)
    return parts.groupBy(*keys).agg(pack) if keys else parts.agg(pack)


def usable(vector: Column) -> Column:
    """Whether a vector takes part in searches: not null, not empty, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def moderate(vector: Column) -> Column:
    """The vector divided by the power of two below its largest component: cosines stay the same to the last bit, and the squares of very
    large or small components stay in range."""
    v = vector.cast("array<double>")
    power = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform(v, F.abs)))))
    return F.get(F.transform(F.array(power), lambda s: F.transform(v, lambda x: x / s)), F.lit(0))


def similar(queries: DataFrame, corpus: DataFrame, k: int = 3, query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding", query_rows: int = QUERY_ROWS, item_rows: int = ITEM_ROWS) -> DataFrame:
    """query_id, item_id, similarity (3 digits), rank: the k nearest items of each query by exact cosine; of equal ones the smaller ids.

    Vectors that usable() leaves out take no part, and a query meets items of its own length only. Queries and items are dealt
    into blocks of about query_rows and item_rows, and each pair of blocks meets in a group, which keeps all items that may be among
    the k best of a query; their cosine is then taken by the built-in functions. Every item goes to each block of queries: for a number
    of queries that grows with the items, search a stored index (search_cells) instead."""
    whole = lambda df, name, short: df.where(usable(F.col(vector))).select(F.col(name).alias(short), moderate(F.col(vector)).alias("v"), F.size(vector).alias("dim"))
    q, c = whole(queries, query_id, "query_id"), whole(corpus, item_id, "item_id")
    blocks, parts = max(1, math.ceil(q.count() / query_rows)), max(1, math.ceil(c.count() / item_rows))
    deal = lambda name, n: F.pmod(F.xxhash64(name, "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("*", deal("query_id", blocks).alias("block"), every(parts).alias("part"))
    c = c.select("*", deal("item_id", parts).alias("part"), every(blocks).alias("block"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        r, at = best_of(_matrix(a), _matrix(b), k) if a.num_rows and b.num_rows else (np.zeros(0, int), np.zeros(0, int))
        mine, found = a.take(r), b.take(at)
        return pa.table({"query_id": mine.column("query_id"), "item_id": found.column("item_id"), "q": mine.column("v"), "c": found.column("v")})

    kind = lambda df, name: df.schema[name].dataType.simpleString()
    near = q.groupBy("dim", "block", "part").cogroup(c.groupBy("dim", "block", "part")).applyInArrow(run, f"query_id {kind(q, 'query_id')}, item_id {kind(c, 'item_id')}, q array<double>, c array<double>")
    return _ranked(near.select("query_id", "item_id", cosine(F.col("q"), F.col("c")).alias("s")), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "item_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "item_id", F.round("s", 3).alias("similarity"), "rank")


def _matrix(t: pa.Table, column: str = "v") -> np.ndarray:
    return t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)


def best_of(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y whose cosine is among the k highest of x's row, or as high as the last of these."""
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    x, y = unit(x), unit(y)
    rows, items = [np.zeros(0, int)], [np.zeros(0, int)]
    for i in range(0, len(x), 64):
        scores = x[i : i + 64] @ y.T
        least = np.partition(scores, -min(k, len(y)), axis=1)[:, -min(k, len(y))]
        r, at = np.nonzero(scores >= least[:, None] - 1e-9)  # equal ones too: the exact cosine decides
        rows, items = [*rows, r + i], [*items, at]
    return np.concatenate(rows), np.concatenate(items)


def technique_text(name: Column, description: Column) -> Column:
    return F.concat(name, F.lit(": "), F.substring(description, 1, 500))


def context_text(found: DataFrame) -> DataFrame:
    """One row, context: a heading and a line for each technique (technique_id, tactic, name, rank) of a short list."""
    line = F.concat(F.lit("  "), "technique_id", F.lit(" ("), "tactic", F.lit("): "), "name")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"])
    return found.agg(F.when(F.count("*") > 0, F.array_join(F.concat(F.array(F.lit("Relevant ATT&CK techniques:")), lines), "\n")).otherwise("").alias("context"))


def embed(rows: DataFrame, text: str, dims: int = 384, vector: str = "embedding") -> DataFrame:
    """rows with a unit vector of hashed, inverse-document-frequency weighted words; callers with an embedding model bring their
    own vector column instead."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
    from pyspark.ml.functions import vector_to_array

    named = rows.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    steps = [Tokenizer(inputCol="__text", outputCol="__words"), HashingTF(numFeatures=dims, inputCol="__words", outputCol="__tf"), IDF(inputCol="__tf", outputCol="__idf"), Normalizer(inputCol="__idf", outputCol="__unit")]
    out = Pipeline(stages=steps).fit(named).transform(named)
    return out.withColumn(vector, vector_to_array("__unit", "float32")).drop("__text", "__words", "__tf", "__idf", "__unit")


def similar_in_cells(queries: DataFrame, corpus: DataFrame, k: int = 3, cells: int = 50, probes: int = 8, query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding", sample: float = 1.0) -> DataFrame:
    """Like similar(), over the nearest k-means cells of each query only; for corpora too large to score in full. The centres come
    from a share of the corpus. In a cell, blocks of queries and items meet in groups that keep what may be among the k best of a query, as
    in similar(); pairs are never rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    length = F.array(F.sqrt(dot(F.col(vector), F.col(vector))))  # computed once for each vector, not for each component
    rows = lambda df: df.withColumn("__v", array_to_vector(F.get(F.transform(length, lambda n: F.transform(vector, lambda x: x.cast("double") / n)), F.lit(0))))
    held = rows(corpus.where(dot(F.col(vector), F.col(vector)) > 0))
    model = KMeans(k=cells, seed=42, maxIter=10, featuresCol="__v", predictionCol="__cell").fit(held if sample >= 1 else held.sample(sample, seed=42))
    centres = np.array(model.clusterCenters())
    distance = lambda c: -dot(F.col(vector), F.array(*map(F.lit, c.tolist()))) / F.sqrt(dot(F.col(vector), F.col(vector))) + float(c @ c) / 2
    near = F.slice(F.array_sort(F.array(*(F.struct(distance(c).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(centres)))), 1, probes)
    q = queries.where(dot(F.col(vector), F.col(vector)) > 0).select(F.col(query_id).alias("query_id"), F.col(vector).alias("v"), F.explode(near["cell"]).alias("cell"))
    c = model.transform(held).select(F.col(item_id).alias("item_id"), F.col(vector).alias("v"), F.col("__cell").alias("cell"))
    blocks = max(1, math.ceil(q.count() / (cells * CELL_QUERIES)))
    parts = max(1, math.ceil(c.count() / (cells * ITEM_ROWS)))
    deal = lambda name, n: F.pmod(F.xxhash64(name, "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("*", deal("query_id", blocks).alias("block"), every(parts).alias("part"))
    c = c.select("*", deal("item_id", parts).alias("part"), every(blocks).alias("block"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        r, at = best_of(_matrix(a), _matrix(b), k) if a.num_rows and b.num_rows else (np.zeros(0, int), np.zeros(0, int))
        mine, found = a.take(r), b.take(at)
        return pa.table({"query_id": mine.column("query_id"), "item_id": found.column("item_id"), "q": mine.column("v"), "c": found.column("v")})

    kind = lambda df, name: df.schema[name].dataType.simpleString()
    best = q.groupBy("cell", "block", "part").cogroup(c.groupBy("cell", "block", "part")).applyInArrow(run, f"query_id {kind(q, 'query_id')}, item_id {kind(c, 'item_id')}, q {kind(q, 'v')}, c {kind(c, 'v')}")
    return _ranked(best.select("query_id", "item_id", cosine(F.col("q"), F.col("c")).alias("s")), k)


def similar_techniques(incidents: DataFrame, techniques: DataFrame, k: int = 3, vector: str = "embedding") -> DataFrame:
    """incident_type, technique_id, similarity, rank: for each type of incident the k techniques (technique_id, name, description,
    vector) nearest to the mean vector of those that its own incidents have (mitre.id). Types are few, techniques bounded."""
    own = incidents.select("incident_type", F.col("mitre.id").alias("technique_id")).distinct()
    asked = mean_vector(own.join(techniques.select("technique_id", vector), "technique_id"), vector, ("incident_type",))
    found = similar(asked.withColumnRenamed("incident_type", "query_id"), techniques.select(F.col("technique_id").alias("item_id"), vector), k, vector=vector)
    return found.select(F.col("query_id").alias("incident_type"), F.col("item_id").alias("technique_id"), "similarity", "rank")
