"""The stored inverted file: recall beside the share of visited cells, pruned folders, odd vectors, a hot cell."""

import numpy as np

from vigil.operators import cells, vectors


def clustered(spark, n, dims=24, groups=40, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dims)) * 3
    x = middle[rng.integers(groups, size=n)] + rng.normal(size=(n, dims))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, embedding array<double>").repartition(6)


def pairs(df):
    return {(r.query_id, r.item_id) for r in df.collect()}


def test_recall_beside_visited_cells(spark, tmp_path):
    corpus = clustered(spark, 6000)
    asked = corpus.where("item_id % 60 = 0").withColumnRenamed("item_id", "query_id")
    index = cells.build_cells(corpus, str(tmp_path / "index"), 40)
    assert index.share < 0.5
    again = cells.open_cells(spark, str(tmp_path / "index"))
    assert again.probes == index.probes and np.allclose(again.centres, index.centres)
    exact, found = pairs(vectors.similar(asked, corpus, 5)), pairs(cells.search_cells(asked, again, 5))
    assert len(found) == len(exact) == 500 and len(exact & found) >= 0.9 * len(exact)
    whole = cells.search_cells(asked, again, 5, probes=40)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, vectors.similar(asked, corpus, 5).collect()))


def test_only_visited_folders_are_read(spark, tmp_path):
    corpus = clustered(spark, 2000)
    index = cells.build_cells(corpus, str(tmp_path / "index"), 30)
    one = corpus.where("item_id = 7").withColumnRenamed("item_id", "query_id")
    found = cells.search_cells(one, index, 3, probes=2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cell#") and len({r.item_id for r in found.collect()}) == 3 and found.orderBy("rank").first().item_id == 7
    assert "PartitionFilters" in found._jdf.queryExecution().executedPlan().toString()


def test_odd_vectors_and_a_hot_cell(spark, tmp_path, monkeypatch):
    """A third of all vectors are copies of one; nulls, zeros, other lengths; blocks of few rows."""
    monkeypatch.setattr(cells, "ITEM_ROWS", 50)
    monkeypatch.setattr(cells, "QUERY_ROWS", 20)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(200)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(400)] + [(5000, None), (5001, [0.0, 0.0, 0.0]), (5002, [float("nan"), 1.0, 1.0])]
    corpus = spark.createDataFrame(rows, "item_id long, embedding array<double>").repartition(4)
    index = cells.build_cells(corpus, str(tmp_path / "index"), 8)
    asked = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(50)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(50)] + [(900, None), (901, [1.0, 2.0]), (902, [0.0, 0.0, 0.0])], "query_id long, embedding array<double>")
    found = cells.search_cells(asked, index, 4, probes=8)
    usable = corpus.where("item_id < 5000")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, vectors.similar(asked.where("query_id < 900"), usable, 4).collect()))
    few = cells.build_cells(corpus.where("item_id in (1, 1001)"), str(tmp_path / "few"), 8)
    assert len(few.centres) == 2 and cells.search_cells(asked, few, 4).where("query_id = 0").count() >= 1
