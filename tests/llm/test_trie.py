"""Conversation tries against a plain one built in Python, tree contraction against recursion, and odd rows."""

import hashlib
import random
import zlib

import duckdb
import pytest

from vigil.llm import queries, trie
from vigil.llm.common import read

SCHEMA = "conv_id long, turn long, role string, text string"


def turns_of(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    return {c: [(x[2], x[4]) for x in sorted(own)] for c, own in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, own in convs.items():
        for d in range(len(own) + 1):
            members.setdefault(tuple(own[:d]), []).append(c)
    out = set()
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        out.add((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(df):
    got = list(map(tuple, df.collect()))
    assert len(got) == len(set(got))
    return set(got)


def test_whole_table(spark, sf):
    rows = list(map(tuple, read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()))
    df = trie.op13_trie(spark, sf)
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    assert rows_of(df) == brute(rebuilt(turns_of(rows)))


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = trie.op13_trie(spark, sf)
    got = con.sql(queries.ORACLES["op13_trie"])
    assert got.columns == df.columns
    assert rows_of(df) == set(got.fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed, monkeypatch):
    """Few different turns, so that many share heads; odd values; blocks of three turns and ids, so that long ones are cut."""
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "ID_BITS", 2)
    rng = random.Random(seed)
    rows = []
    for c in (*range(-6, 40), 2**40, None):
        for t in range(rng.choice((1, 2, 3, 5, 9, 30))):
            rows.append((c, rng.choice((t, t, t, None, 1)), rng.choice(("user", "user", None, "")), rng.choice(("a", "a", "b", "é" * 40, "", None))))
    rows += rows[:7]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(trie.conversation_trie(df, rebuild=True)) == brute(rebuilt(turns_of(rows)))
    assert rows_of(trie.conversation_trie(df)) == brute(turns_of(rows))


def test_hot_conversation_and_first_turn(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(300)] + [(7, 5, "user", "again")] * 200
    rows += [(c, 0, "system", "the same") for c in range(100, 400)] + [(c, 1, "user", str(c % 7)) for c in range(100, 400, 2)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], f"{SCHEMA}, id int, a int, depth int").repartition(6)
    assert rows_of(trie.conversation_trie(df)) == brute(turns_of(rows))


def test_nothing(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA), rebuild=True).count() == 0
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_contraction_equals_recursion(spark):
    rng = random.Random(3)
    parents = [None]
    for i in range(1, 400):  # chains with side branches, a star, random growth
        parents.append(i - 1 if i < 150 else 3 if i < 220 else rng.randrange(max(0, i - 4), i) if i < 330 else rng.randrange(i))
    parents += [None, 400, 401]
    names = rng.sample(range(10**9), len(parents))
    depth = []
    for p in parents:
        depth.append(0 if p is None else depth[p] + 1)
    value = [rng.randrange(100) for _ in parents]
    total = value[:]
    for i in reversed(range(len(parents))):
        if parents[i] is not None:
            total[parents[i]] += total[i]
    df = spark.createDataFrame([(names[i], None if p is None else names[p], depth[i], value[i]) for i, p in enumerate(parents)], "id long, parent long, depth long, v long")
    assert sorted(map(tuple, trie.contract(df, ("v",)).collect())) == sorted(zip(names, total, strict=True))
