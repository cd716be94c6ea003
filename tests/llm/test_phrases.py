"""Phrases against counts of Python, streams cut into many ranges, SQL on the whole table, odd rows."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from vigil.llm import phrases, queries
from vigil.llm.common import read

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = [p for p, a in f.items() if a >= least and len(p) > 1]
        most = Counter()
        for p in often:
            for inner in {p[i:j] for i in range(len(p)) for j in range(i + 2, len(p) + 1)} - {p}:
                most[inner] = max(most[inner], f[p])
        found = []
        for p in often:
            score, _, left, right = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if 100 * most[p] < 80 * f[p]:
                found.append((-score, -f[p], " ".join(p).encode(), left, right))
        out += [(lang, i, phrase.decode(), -a, left, right, totals[lang], -score) for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def texts(seed):
    rng = random.Random(seed)
    common = ["the", "The", "of", "a", "é", "漢字", "-", "x\x00y"]
    rare = [f"w{i}" for i in range(60)]
    fixed = ["New York City Hall", "new york city", "to be or not", "of the", "a a a a a a"]
    ends = [" ", "  ", "\t", ", ", ". ", "\n", " ; ", "\x0b", " "]
    rows = []
    for i in range(300):
        parts = []
        for _ in range(rng.randrange(0, 40)):
            parts += [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(common) if rng.random() < 0.6 else rng.choice(rare), rng.choice(ends) if rng.random() < 0.3 else " "]
        rows.append((rng.choice(("en", "en", "en", "fr", None, "und")), "".join(parts)))
    return [*rows, ("en", None), (None, None), ("de", ""), ("de", " .,; "), ("fr", "one " * 20_000), *rows[:5]]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("small", [False, True])
def test_random_texts(spark, seed, small, monkeypatch):
    if small:  # many ranges, small buffers, filters that let nearly everything through
        monkeypatch.setattr(phrases, "RANGE_ROWS", 40)
        monkeypatch.setattr(phrases, "BUFFER", 200)
        monkeypatch.setattr(phrases, "FILTER_BITS", 7)
    rows = texts(seed)
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "lang string, text string, k1 int, n int, word string").repartition(4)
    assert result(phrases.collocations(docs, min_count=8)) == brute(rows, 8)
    assert result(phrases.collocations(docs, min_count=5, top=7)) == brute(rows, 5, 7)


def test_sql_on_the_whole_table(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLES["op12_phrases"])
    df = phrases.op12_phrases(spark, sf)
    assert dict(df.dtypes) == {"lang": "string", "phrase": "string", **dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")} and want.columns == df.columns
    got = result(df)
    assert got == sorted(want.fetchall()) and got
    assert got == brute(map(tuple, read(spark, sf, "documents").select("lang", "text").collect()), 30)


def test_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "one two three"), (None, None)], "lang string, text string")).count() == 0


def test_products_beyond_64_bits(spark):
    """Scores from counts that a table of this size can't have, through the same stream."""
    big = 9_000_000_000_000
    assert spark.sql(f"SELECT CAST((CAST(2000000 AS DECIMAL(38,0)) * {big}L) div (CAST({big}L AS DECIMAL(38,0)) + {big}L) AS LONG) AS s").first().s == 1_000_000
