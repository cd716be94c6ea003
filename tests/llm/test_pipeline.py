"""The pipeline's stages, each against brute force on its own input."""

import re
import zlib
from pathlib import Path

import corpus_pipeline
from test_pii import brute as pii_brute
from test_simhash import copy_names
from test_substrings import brute as repeats_brute

from vigil.llm import packing, pii
from vigil.llm.common import cut, cuts_made, read, shared_dir


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    labels = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect()}
    stage = dict(corpus_pipeline.STAGES)
    all_rows = {r.doc_id: r for r in docs.collect()}

    good = cut(stage["quality"](spark, docs, sf))
    assert good.columns == docs.columns
    one = {r.doc_id: r for r in good.collect()}
    assert all(one[i] == all_rows[i] for i in one)
    rejected = set(all_rows) - set(one)
    assert sum(labels.get(i) == 1 for i in rejected) <= 0.05 * sum(v == 1 for v in labels.values())

    unique = cut(stage["near duplicates"](spark, good, sf))
    two = {r.doc_id: r for r in unique.collect()}
    names, _ = copy_names([(i, r.text) for i, r in sorted(one.items())])
    assert sorted(two) == sorted(set(names.values())) and all(two[i] == one[i] for i in two) and unique.columns == docs.columns

    fresh = cut(stage["repeated passages"](spark, unique, sf))
    three = {r.doc_id: r for r in fresh.collect()}
    want = {i: (n, gone) for i, n, gone, _ in repeats_brute([(i, r.text) for i, r in two.items()])}
    for i, (n, gone) in want.items():
        assert len(re.findall(r"[^\x20\x09-\x0D]+", three[i].text)) == n - gone and (gone or three[i] == two[i]) and three[i].n_chars == len(three[i].text)
    assert set(three) == set(two) and fresh.columns == docs.columns

    clean = cut(stage["personal data"](spark, fresh, sf))
    four = {r.doc_id: r for r in clean.collect()}
    spans = {r.doc_id: r.spans for r in pii.find_pii(fresh).collect()}
    for i, r in three.items():
        found = sorted((int(a), -int(b), kind) for kind, a, b in (s.split(":") for s in spans[i].split(",") if s))
        assert {s for s in pii_brute(r.text)} <= set(spans[i].split(","))
        at, out = 0, []
        for a, b, kind in found:
            if a >= at:
                out += [r.text[at:a], f"<{kind}>"]
            at = max(at, -b)
        assert four[i].text == "".join(out) + r.text[at:] and four[i].n_chars == len(four[i].text)
    assert set(four) == set(three) and clean.columns == docs.columns

    check_packing(stage["packing"](spark, clean, sf).collect(), {i: r.text for i, r in four.items()})


def check_packing(pieces, texts, window=1024):
    enc = packing.encoder()._exact
    sequences, by_doc = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        by_doc.setdefault(p.doc_id, []).append(p)
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids, at = enc.encode(text or "", add_special_tokens=False).ids + [0], 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[p.start : at]))
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or at & (at - 1) == 0 and at < window


def test_packing_of_odd_documents(spark):
    texts = ["", None, "a", "  two  spaces ", "a<|endoftext|>b", "line\n\nbreak \n x", "é 漢字 😀", "word " * 30_000, "x" * 5000] + [f"short text {k}" for k in range(200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(6)
    check_packing(packing.pack(docs).collect(), dict(enumerate(texts)))
    some = docs.where("doc_id < 5")
    once, twice = packing.pack(some).collect(), packing.pack(some.union(some)).collect()
    assert sum(p.length for p in twice) == 2 * sum(p.length for p in once)
    assert {i: sum(p.length for p in twice if p.doc_id == i) for i in range(5)} == {i: 2 * sum(p.length for p in once if p.doc_id == i) for i in range(5)}
    assert packing.pack(docs.limit(0)).count() == 0


LONG = " ".join(f"long{i % 977}x{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (None, "no id at all but some words"), (None, None), (3, "mail me at someone@example.org now"), (3, "mail me at someone@example.org now"), (3, "another text under the same number"), (4, LONG), (5, " \t\n "), (6, "é 漢字 😀 +49 30 1234567 890"), (2**40, "far away number")]
EXTRA = ("__node", "__text", "__score", "__bands", "__size", "score", "held", "id", "a.b", "others", "row", "spans", "length")


def odd_documents(spark):
    rows = [(i, t, None if t is None else len(t), *(f"{name}{k}" for name in EXTRA)) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars int, " + ", ".join(f"`{c}` string" for c in EXTRA)).repartition(3)


def by_place(df):
    return {r["__node"]: r for r in df.collect()}


def test_stages_on_odd_rows(spark, sf):
    docs, stage = odd_documents(spark), dict(corpus_pipeline.STAGES)
    all_rows = by_place(docs)
    for name in ("quality", "near duplicates", "repeated passages", "personal data"):
        got = stage[name](spark, docs, sf)
        assert got.schema == docs.schema, name
        for place, r in by_place(got).items():  # no column but text and n_chars changes
            assert [r[c] for c in ("doc_id", *EXTRA)] == [all_rows[place][c] for c in ("doc_id", *EXTRA)], name
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    unique = stage["near duplicates"](spark, docs, sf).collect()
    assert sorted(str(r.doc_id) for r in unique) == sorted(map(str, [1, None, None, 3, 3, 4, 6, 2**40]))  # the texts without words are one group
    assert len({(r.doc_id, r.text) for r in unique}) == len(unique)
    for name in ("repeated passages", "personal data"):
        assert ids(stage[name](spark, docs, sf)) == ids(docs), name
    fresh = by_place(stage["repeated passages"](spark, docs, sf))
    assert all(r.text == (all_rows[p].text or "") and r.n_chars == len(r.text) for p, r in fresh.items())
    clean = by_place(stage["personal data"](spark, docs, sf))
    assert clean["__node0"].text is None and clean["__node4"].text == clean["__node5"].text == "mail me at <email> now" and clean["__node7"].text == LONG
    assert sum(p.length for p in stage["packing"](spark, docs, sf).collect() if p.doc_id == 1) == 1


def test_stages_on_empty_tables(spark, sf):
    docs = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        assert got.count() == 0 and (name == "packing" or got.schema == docs.schema), name


def test_run(spark, sf):
    """The whole pipeline equals its stages one after the other, and what they wrote on their way is gone."""
    docs = read(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, sf))
    folder = Path(shared_dir(spark).removeprefix("file://"))
    there = set(folder.iterdir())
    with cuts_made() as made:
        pieces = corpus_pipeline.run(spark, sf).collect()
    check_packing(pieces, {r.doc_id: r.text for r in docs.collect()})
    left = {p.name for p in set(folder.iterdir()) - there}
    assert left < {path.rsplit("/", 1)[1] for path in made} and len(left) < len(made) / 3  # of most stages nothing is left; the last one's rows are read from the rest
