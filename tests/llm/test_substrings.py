"""Substring deduplication against brute force over all windows."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from vigil.llm import substrings
from vigil.llm.common import read
from vigil.llm.fmindex import FMIndex, WaveletMatrix, suffix_array


def brute(rows, window=20):
    """rows: id, text; ids None come last. Returns a sorted list of (id, n_words, n_removed, sha)."""
    order = lambda i: float("inf") if i is None else i
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), ws in zip(rows, words):
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s : s + window])
            first[key] = min(first.get(key, (order(i), s)), (order(i), s))
    out = []
    for (i, _), ws in zip(rows, words):
        gone = set()
        for s in range(len(ws) - window + 1):
            if first[tuple(ws[s : s + window])] != (order(i), s):
                gone.update(range(s, s + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((order(i), len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, h string").repartition(7)
    got = substrings.dedup_substrings(docs).collect()
    return sorted((float("inf") if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got)


def planted(seed, vocabulary=300, texts=250):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)] + ["é", "日本", "a" * 90]
    passages = [[rng.choice(words) for _ in range(rng.randint(15, 70))] for _ in range(12)]
    rows = []
    for i in range(texts):
        ws = []
        for _ in range(rng.randint(0, 5)):
            ws += [rng.choice(words) for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.7:
                p = rng.choice(passages)
                a = rng.randint(0, 10)
                ws += p[a : a + rng.randint(10, 70)]
        rows.append((i * 3, rng.choice([" ", "\n", " \t "]).join(ws)))
    return rows


def test_planted_passages(spark, monkeypatch):
    rows = planted(1) + [(5, None), (7, ""), (8, "one two"), (9001, "z " * 3000), (9002, "ab cd " * 40), (None, planted(1)[3][1]), (None, planted(2)[9][1])]
    rows += rows[:4] + [(rows[6][0], rows[6][1])]
    want = brute(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(substrings, "ROUTE_ROWS", 1)
    monkeypatch.setattr(substrings, "SHARD_ROWS", 50)
    assert run(spark, rows) == want


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    assert run(spark, rows) == brute(rows)


def test_rewritten_texts_and_empty_table(spark):
    rows = planted(4, texts=60)
    docs = spark.createDataFrame([(t, i, "en", 0) for i, t in rows], "text string, doc_id long, others string, n_chars int")
    out = substrings.remove_substrings(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest()) for r in out.collect())
    assert got == [(i, h) for i, _, _, h in brute(rows)]
    assert substrings.dedup_substrings(docs.where(F.lit(False))).count() == 0 and substrings.remove_substrings(docs.where(F.lit(False))).count() == 0


def test_texts_of_one_id_and_checksum(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    heads = [passage + " and then k", "some other words first " + passage + " k"]
    end = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:12]
    seen = {zlib.crc32((heads[0] + end(i)).encode()): i for i in range(300_000)}
    b, a = next((i, seen[k]) for i in range(300_000, 900_000) if (k := zlib.crc32((heads[1] + end(i)).encode())) in seen)
    texts = [f"{heads[0]}{end(a)}", f"{heads[1]}{end(b)}"]
    assert zlib.crc32(texts[0].encode()) == zlib.crc32(texts[1].encode())
    rows = [(1, "x " + passage), *((7, t) for t in texts)]
    assert run(spark, rows) == brute(rows)


def test_index_parts():
    rng = np.random.default_rng(6)
    text = rng.integers(0, 9, 700)
    got = suffix_array(text, 20).tolist()
    assert sorted(got) == list(range(700)) and [text[k : k + 20].tolist() for k in got] == sorted(text[k : k + 20].tolist() for k in range(700))
    assert suffix_array(text).tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())
    wavelet = WaveletMatrix(text, np.bincount(text))
    c, at = rng.integers(0, 9, 300), rng.integers(0, 701, 300)
    assert wavelet.rank(c, at).tolist() == [int((text[:p] == s).sum()) for s, p in zip(c, at)]
    text = np.concatenate([rng.integers(1, 4, 300), [0]])
    order = np.arange(301)
    index = FMIndex(text, order, 300)
    who, lo, hi = index.matches(text, order, np.array([0]), np.array([300]), 6)
    covered = {s for a, b in zip(lo, hi) for s in range(a, b - 5)}
    tuples = [tuple(text[s : s + 6]) for s in range(295)]
    assert covered == {s for s in range(295) if tuples.index(tuples[s]) < s} and not who.any()
    found = index.occur(text, order, np.arange(295), np.arange(6, 301))
    assert found.tolist() == [tuples.index(tuples[s]) < s for s in range(295)]


def test_index_is_compressed():
    rng = np.random.default_rng(7)
    text = np.concatenate([rng.zipf(1.5, 20_000) % 3000 + 1, [0]])
    counts = np.bincount(text)
    share = counts[counts > 0] / len(text)
    entropy = -(share * np.log2(share)).sum()
    assert WaveletMatrix(text, counts).bits() < len(text) * (entropy + 1) + 64 * 20 < len(text) * int(text.max()).bit_length()
