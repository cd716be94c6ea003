"""SimHash near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vigil.llm import simhash
from vigil.llm.common import read


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, min(len(words), 1)))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(ids, fps, budget=3):
    names = sorted(set(fps))
    label = {f: f for f in names}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    a = np.array(names, np.uint64)
    for i, f in enumerate(names):
        for g in a[i + 1 :][np.bitwise_count(a[i + 1 :] ^ a[i]) <= budget].tolist():
            label[find(f)] = find(g)
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [least.get(find(f)) for f in fps]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(6)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [fingerprint(t) for _, t, _ in rows]
    want = sorted((i if i is not None else -1, f"{f:016x}", c) for (i, _, _), f, c in zip(rows, fps, closure([r[0] for r in rows], fps)))
    assert got == want


def test_documents_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text, "x") for r in read(spark, sf, "documents").collect()]
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    extra = [None, "", " \t\n", "One", "one", "Two words", "two WORDS", "É a b", "é a b", "a\tb\n\nc  d", "a b c d", long, long + " tail"]
    check(spark, rows + [(10_000 + i, t, None) for i, t in enumerate(extra)] + rows[:5] + [(None, "alone here now", "x"), (None, rows[0][1], "x")])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == [] and simhash.near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"]


def test_links_reach_all_that_brute_force_links(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(400)]
    for _ in range(1500):  # chains and dense groups
        f = rng.choice(fps[:200])
        for _ in range(rng.randint(1, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps += [0xABCD << 48 | rng.getrandbits(24) for _ in range(1500)]  # one full bucket
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for limit in (20_000, 200):
        got = {r.u % 2**64: r.v % 2**64 for r in simhash.components(simhash.near_links(nodes, bucket_rows=limit)).collect()}
        want = closure(list(range(len(fps))), fps)
        groups, mine = {}, {}
        for k, f in enumerate(fps):
            groups.setdefault(want[k], []).append(f)
            mine.setdefault(got.get(f, f), []).append(f)
        assert sorted(map(tuple, groups.values())) == sorted(map(tuple, mine.values()))


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1)))}


def copy_names(rows):
    """Of rows (id, text): the least id of each one's component over all pairs of similarity 0.8 or more; and how many pairs link
    different sets."""
    sets = [shingles(t) for _, t in rows]
    name = list(range(len(rows)))
    pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if a == b or common and common >= 0.8 * len(a | b):
                pairs += a != b
                name = [name[j] if n == name[i] else n for n in name]
    least = {}
    for (i, _), n in zip(rows, name):
        least[n] = min(i, least.get(n, i))
    return {i: least[n] for (i, _), n in zip(rows, name)}, pairs


def test_near_copies_against_all_pairs(spark, sf):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    for i in range(150):  # planted copies with edited words
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(60, 400))]
        rows.append((10_000 + 10 * i, " ".join(words)))
        for c in range(1, 4):
            edited = [f"new{rng.random()}" if rng.random() < 0.004 * c * c else w for w in words]
            rows.append((10_000 + 10 * i + c, " ".join(edited)))
    rows += [(20_000, None), (20_001, " "), (20_002, "one two"), (20_003, "ONE  two"), (20_004, "two one")]
    want, pairs = copy_names(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert pairs > 200 and got == want
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(want.values()))
    nodes = simhash._noted(docs, ["doc_id"], 5, bands=True).dropDuplicates(["__node"])
    linked = {r.u: r.v for r in simhash.components(simhash.copy_links(docs, nodes, 5, 0.8, block_rows=2)).collect()}
    name_of = {r.doc_id: linked.get(r["__node"], r["__node"]) for r in simhash._noted(docs, ["doc_id"], 5).collect()}
    assert len({(want[i], n) for i, n in name_of.items()}) == len(set(want.values())) == len(set(name_of.values()))


def test_fingerprints_find_copies_that_share_no_band(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(12):
        words = [f"v{rng.randrange(5000)}" for _ in range(3000)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:1500], "edited", *words[1501:]]))]
    noted = simhash._noted
    no_bands = lambda *a, **k: (lambda df: df.withColumn("__bands", F.array().cast("array<long>")) if "__bands" in df.columns else df)(noted(*a, **k))
    monkeypatch.setattr(simhash, "_noted", no_bands)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(docs, k=simhash.COPY_SHINGLE).collect()}
    near = {i for i in range(0, 24, 2) if (fps[i] ^ fps[i + 1]).bit_count() <= simhash.BUDGET}
    assert len(near) > 6
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {i: i - i % 2 if i - i % 2 in near else i for i in range(24)}


def test_keep_one_where_an_id_has_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b), (3, c), (1, a), (4, c), (None, c)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (1, b), (3, c), (0, c)])
