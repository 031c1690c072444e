import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkweave.llm import hard_negatives as hn
from tests.oracle import assert_same


def plain(rows, positives=5, negatives=5, low=80, high=100):
    """Every anchor with every row; rows are (id, label, whole numbers)."""
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, label, q in rows:
        if i % 100:
            continue
        scored = sorted(((-dot(q, v), j, m) for j, m, v in rows if j != i), key=lambda t: t[:2])
        for minus, j, _ in [s for s in scored if s[2] == label][:positives]:
            near = [s for s in scored if s[2] != label and low * -minus <= 100 * -s[0] <= high * -minus][:negatives]
            out += [(i, j, k + 1, n[1], -minus, -n[0]) for k, n in enumerate(near)]
    return sorted(out)


def clustered(seed, n=900, width=12, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    near = r.integers(0, 6, n)
    x = centres[near] + r.normal(scale=0.15, size=(n, width))
    return [(int(k * 5), int((near[k] + (r.random() < 0.3)) % labels), [math.floor(40 * c) for c in x[k]]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, v array<int>").repartition(3, "id")


def got(spark, rows, **how):
    return sorted(map(tuple, hn.mined(frame(spark, rows), F.col("id") % 100 == 0, **how).collect()))


@pytest.mark.parametrize("how", [{}, {"block": 9}, {"positives": 2, "negatives": 7, "low": 50, "high": 95}])
def test_same_as_every_pair(spark, monkeypatch, how):
    monkeypatch.setattr(hn, "SOME_ROWS", 64)
    rows = clustered(2)
    want = plain(rows, **{k: v for k, v in how.items() if k != "block"})
    assert got(spark, rows, **how) == want and len(want) > 100


def test_hot_vector_ties_and_repeats(spark):
    r = random.Random(1)
    rows = [(k, r.randrange(3), [3, -1, 2] if k % 3 else [r.randrange(-4, 5) for _ in range(3)]) for k in range(0, 2000, 4)]
    rows += rows[:40] + [(100, 2, [0, 0, 0]), (7, 1, [2]), (9, 0, []), (200, 1, [1])]
    assert got(spark, rows) == plain(rows)


def test_brackets_hold_and_prune():
    r = np.random.default_rng(5)
    rows = clustered(3, 3000)
    x = np.array([v for _, _, v in rows], float)
    x[:200] = r.integers(-50, 50, (200, x.shape[1]))
    top = (x * x).sum(axis=1).max()
    pivots = hn.chosen_pivots(hn.lifted(x[:500], top), 16)
    q = x[r.integers(0, len(x), 60)]
    low, high = hn.bracket(hn.distances(np.hstack([q, np.zeros((60, 1))]), pivots), hn.distances(hn.lifted(x, top), pivots), top + (q * q).sum(axis=1))
    score = q @ x.T
    assert (low <= score).all() and (score <= high).all()
    fifth = np.sort(score, axis=1)[:, -5]
    assert (high >= fifth[:, None]).mean() < 0.5  # the others need no exact check


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([1.0, -0.001],), ([nan, 1.0],), ([1.0, inf],), ([1.0, -inf],), ([None, 1.0],), (None,), ([],), ([1e30],), ([0.5, 20000.0],)]
    found = [r[0] for r in spark.createDataFrame(rows, "e array<float>").select(hn.quantised(F.col("e"))).collect()]
    assert found == [[256, -1], None, None, None, None, None, [], None, None]
    assert got(spark, [(0, 1, [10]), (1, 1, [10]), (2, 2, [9]), (None, 2, [9]), (4, None, [9]), (5, 2, None)]) == [(0, 1, 1, 2, 100, 90)]


def test_no_rows(spark):
    assert got(spark, []) == [] and got(spark, [(0, 1, [2])]) == [] and got(spark, [(1, 1, [2]), (2, 2, [2])]) == []
    assert got(spark, [(0, 1, [2]), (1, 1, [-2]), (2, 2, [-2])]) == []


def test_whole_tables(spark, sf):
    assert assert_same(hn.op13_pivot_negatives(spark, sf), sf, hn.SQL) > 100
