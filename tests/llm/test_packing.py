"""Packing: repeat counts against exact optima, greedy filling, whole plans, repeated rows."""

from collections import Counter

import numpy as np
import pytest
from test_pipeline import check_packing

from vigil.llm import packing
from vigil.llm.common import cut, drop_cuts


def pieces_of(plan, hist, window):
    """(sequence, offset, length) of every piece that the plan places whole, and how many symbols go to the stretch."""
    out, stretch = [], 0
    for length in range(1, window + 1):
        for rank in range(int(hist[length])):
            at = plan.base[length] + rank
            slot = int(np.searchsorted(plan.first, at, "right")) - 1
            if plan.sequence[slot] < 0:
                stretch += length
            else:
                out.append((int(plan.sequence[slot] + at - plan.first[slot]), int(plan.offset[slot]), length))
    return out, stretch


def test_repeat_counts_reach_a_histogram_that_combinations_make():
    window = 12
    combos = packing.combinations(window)
    assert all(sorted(c)[::-1] == sorted(c, reverse=True) and c.sum() == window for c in combos)
    true = np.random.default_rng(2).integers(0, 40, len(combos)).astype(float)
    hist = np.bincount(combos.ravel(), np.repeat(true, 3), window + 1)
    hist[0] = 0
    x = packing.repeat_counts(hist, combos, rounds=2000)
    made = np.bincount(combos.ravel(), np.repeat(x, 3), window + 1)
    assert (x >= 0).all() and np.abs(made[1:] - hist[1:]).max() < 0.05 * hist.max()


def test_greedy_fills_windows_exactly():
    left = np.zeros(11, np.int64)
    left[[7, 3, 2, 1, 6]] = [4, 2, 3, 5, 1]
    for parts, n in packing.greedy(left, 10):
        assert sum(parts) == 10 and n > 0
    used = Counter()
    for parts, n in packing.greedy(left, 10):
        used.update({p: n * k for p, k in Counter(parts).items()})
    assert all(v <= left[k] for k, v in used.items()) and used[7] == 4


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_each_piece_once(seed):
    window = 64
    rng = np.random.default_rng(seed)
    hist = rng.integers(0, 30, window + 1) * (rng.random(window + 1) < 0.6)
    hist[0] = 0
    plan = packing.make_plan(hist, window)
    placed, stretch = pieces_of(plan, hist, window)
    by = {}
    for sequence, offset, length in placed:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window
    assert len(placed) <= hist.sum() and stretch == int((np.arange(window + 1) * hist).sum()) - window * len(by)
    ends = [0, *plan.ends.tolist()]
    assert ends[-1] == stretch and all(b - a == window or (b - a) & (b - a - 1) == 0 for a, b in zip(ends, ends[1:]))


def test_short_pieces_hardly_need_the_stretch():
    window = 64
    hist = np.concatenate([[0], 3000 // np.arange(1, window + 1)])
    _, stretch = pieces_of(packing.make_plan(hist, window), hist, window)
    assert stretch < 0.1 * (np.arange(window + 1) * hist).sum()


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "one two three", 0), (2, None, 0), (3, "word " * 3000, 0)], "doc_id long, text string, sequence_id int")
    once, twice = packing.pack(docs).collect(), packing.pack(docs.union(docs).repartition(3)).collect()
    total = lambda rows: {i: sum(p.length for p in rows if p.doc_id == i) for i in (1, 2, 3)}
    assert total(twice) == {i: 2 * n for i, n in total(once).items()}
    slots = [(p.sequence_id, p.offset + k) for p in twice for k in range(p.length)]
    assert len(slots) == len(set(slots))
    check_packing(once, {1: "one two three", 2: None, 3: "word " * 3000})


def test_tables_of_cuts_can_be_dropped(spark):
    rows = cut(spark.range(5))
    assert rows.count() == 5 and drop_cuts(spark) >= 1 and drop_cuts(spark) == 0
