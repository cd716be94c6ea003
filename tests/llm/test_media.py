"""Media columns: exact round trips, shared chunks, odd texts."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa

from vigil.llm import media
from vigil.llm.common import read


def test_round_trip_of_documents(spark, sf):
    texts = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    rng = random.Random(1)
    long = " ".join(rng.choice("alpha beta gamma delta épsilon".split()) + str(rng.randrange(10**6)) for _ in range(40_000))
    texts += [(5001, None), (5002, ""), (5003, "x" * 64), (5004, "é" * 50_000), (5005, long), (5006, "new start. " + long), (5006, "new start. " + long), (None, "no id"), (5007, "\0" * 100)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, media int").repartition(5)
    got = media.media_columns(docs).collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got}
    for i, t in texts:
        raw, r = (t or "").encode(), by_id[i]
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.to_wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(stored))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.feature == media._features(payload)
    assert by_id[5005].n_chunks > 20


def test_shifted_content_shares_chunks():
    rng = np.random.default_rng(2)
    body = "".join(map(chr, rng.integers(32, 127, 300_000)))
    (_, m1, a), (_, m2, b) = media._media(pa.array([body, "some words before. " + body]))
    assert b"".join(a) == m1 and b"".join(b) == m2 and media.from_wav(m1).rstrip(b"\0").decode() == body
    assert all(media.MIN_CHUNK <= len(c) <= media.MAX_CHUNK for c in a[:-1])
    assert len(set(a) & set(b)) > 0.8 * len(a)


def test_gear_hash_is_the_rolling_one():
    data = np.random.default_rng(3).integers(0, 256, 5000).astype(np.uint8)
    h, want = 0, []
    for i, x in enumerate(data.tolist()):
        h = (2 * h + int(media._GEAR[x])) % 2**16  # only these bits are looked at
        if i >= 16 and h >> media.CUT_SHIFT & media.CUT_MASK == 0:
            want.append(i + 1)
    assert [c for c in media.gear_cuts(data).tolist() if c > 16] == want


def test_common_chunks_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT_USES", 3)
    rng = np.random.default_rng(5)
    body = "".join(map(chr, rng.integers(32, 127, 60_000)))
    docs = spark.createDataFrame([(i, body + str(i)) for i in range(8)], "doc_id long, text string")
    got = {r.doc_id: r.payload_sha256 for r in media.media_columns(docs).collect()}
    assert got == {i: hashlib.sha256(media.padded((body + str(i)).encode())).hexdigest() for i in range(8)}
    assert media.media_columns(docs.limit(0)).count() == 0
