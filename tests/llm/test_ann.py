"""Neighbours against brute force: order, exact scores and recall."""

import numpy as np
from pyspark.sql import functions as F

from vigil.llm import ann
from vigil.llm.common import read


def brute(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def recall(got, want):
    hit = total = 0
    for q, best in want.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hit += len({m[1] for m in mine} & {b[0] for b in best})
        total += len(best)
    return hit / total


def test_recall_and_scores(spark, sf):
    table = read(spark, sf.replace("sf0.001", "sf0.1"), "embeddings")
    rows = sorted((r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = ann.nearest(table, F.col("id") % 20 == 0).collect()
    want = brute(ids, x)
    assert {r.query_id for r in got} == set(want)
    for r in got[:500]:
        assert abs(r.score - float((x[ids == r.query_id][0] * x[ids == r.vec_id][0]).sum())) < 1e-12
    assert recall(got, want) >= 0.9


def test_clusters_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 10))
    x = centre[rng.integers(0, 12, 3000)] + 0.1 * rng.normal(size=(3000, 10))
    x[1000:2000] = x[0]  # a very common vector
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    odd = [(4000, None, "a"), (4020, [0.0] * 10, "a"), (4040, [float("nan")] * 10, "a"), (4060, [1.0, None] + [0.0] * 8, "a"), (4080, [1.0], "a"), (None, [1.0] * 10, "a"), (4100, [float("inf")] * 10, "a")]
    got = ann.nearest(spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<double>, rank string"), F.col("id") % 20 == 0).collect()
    assert {r.query_id for r in got} == set(range(0, 3000, 20)) and not {r.vec_id for r in got} & {r[0] for r in odd}
    assert recall([r for r in got if r.query_id not in (0,) and not 1000 <= r.query_id < 2000], {q: b for q, b in brute(np.append(np.arange(3000), 0), np.vstack([x, x[:1]])).items() if q and not 1000 <= q < 2000}) >= 0.9
    mine = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1500]
    ties = [b[0] for b in brute(np.append(np.arange(3000), 0), np.vstack([x, x[:1]]))[1500]]
    assert mine == ties


def test_queries_that_lack_neighbours_see_all(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(2000, 8)), 100 + rng.normal(size=(5, 8)), -100 + rng.normal(size=(5, 8))])
    monkeypatch.setattr(ann.Index, "limits", lambda index, q, k: (np.full(len(q), 1e3), np.full(len(q), 1e3)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(rows, F.col("id") % 20 == 0).collect()
    assert recall(got, brute(np.arange(len(x)), x)) >= 0.9


def test_recall_where_few_vectors_or_one_group_decide(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 600)
    monkeypatch.setattr(ann, "JUDGES", 600)
    monkeypatch.setattr(ann, "EXPECTED", 64)
    rng = np.random.default_rng(6)
    huge, group = rng.normal(size=(6000, 16)), rng.normal(size=(6000, 16))
    huge[:20] *= 50
    blob = rng.random(6000) < 0.3
    group[blob] = 2 * group[0] + 1e-3 * rng.normal(size=(blob.sum(), 16))
    for x in (huge, group):
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
        assert recall(ann.nearest(rows, F.col("id") % 20 == 0).collect(), brute(np.arange(6000), x)) >= 0.9


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(few, F.col("id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert ann.nearest(few.limit(0), F.col("id") % 20 == 0).count() == 0
