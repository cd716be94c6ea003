"""The classifier's held-out accuracy, its prior, and odd rows."""

import zlib

import numpy as np

from vigil.llm import quality
from vigil.llm.common import read


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect()}
    rows = quality.op2_quality(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [p for y, p in held if y], [p for y, p in held if not y]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.15


def test_prior_and_risk():
    rng = np.random.default_rng(3)
    p, n = rng.normal(1.5, 1, (4000, 6)), rng.normal(-1.5, 1, (4000, 6))
    positive, unlabelled = p[:2000].astype(np.float32), np.concatenate([p[2000:4000], n[:1000]]).astype(np.float32)
    w = quality.fit_risk(positive, unlabelled, 2 / 3)
    assert (p @ w[:-1] + w[-1] > 0).mean() > 0.95 and (n @ w[:-1] + w[-1] < 0).mean() > 0.95
    assert abs(quality.estimate_prior(positive @ w[:-1], unlabelled @ w[:-1]) - 2 / 3) < 0.05


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (2, "", 5.0), (None, "word " * 50_000, 5.0), (4, "a b", 5.0), (4, "a b", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(4, 1, "x"), (4, 0, "x"), (None, 1, "x"), (1, None, "x")], "doc_id long, quality int, text string")
    for table in (labels, labels.limit(0)):
        model = quality.fit_quality(docs, table)
        got = quality.score_quality(docs, model).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.text in (None, "")}) == 1
    empty = quality.score_quality(docs.limit(0), quality.fit_quality(docs.limit(0), labels))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "score"]
