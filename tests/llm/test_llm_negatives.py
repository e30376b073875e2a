"""Hard negatives and the cover tree against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweave.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score int"


def brute(rows, divisor, positives=5, negs=3):
    """rows: {id: (label, list of ints)}"""
    out = []
    for a, (label, v) in rows.items():
        if a % divisor:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in rows.items() if i != a and len(w) == len(v)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == label][:positives]:
            fit = [i for i in order if rows[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:negs]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, data, divisor=10):
    forest = negatives.Forest(negatives.quantised(spark.createDataFrame(data, SCHEMA)))
    out = forest.mine(forest.rows.where(F.col("id") % divisor == 0))
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def taking_part(data):
    rows = {}
    for i, v, label, *_ in data:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        rows[i] = min(rows.get(i, (label, q)), (label, q))
    return rows


def clustered(n, dim, seed, labels=5):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((8, dim))
    v = centers[rng.integers(0, 8, n)] + 0.3 * rng.standard_normal((n, dim))
    return [(i, x.astype(np.float32).tolist(), int(k), "x", 1) for i, (x, k) in enumerate(zip(v, rng.integers(0, labels, n)))]


def test_against_brute_force(spark, monkeypatch):
    data = clustered(700, 16, 0)
    want = brute(taking_part(data), 10)
    assert mined(spark, data) == want and len(want) > 500
    monkeypatch.setattr(negatives, "TREE_ROWS", 40)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(negatives, "WIDTH", 2)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    assert mined(spark, data) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = clustered(60, 4, 1, 3)
    data += [(100, None, 1, "", 0), (101, [1.0] * 4, None, "", 0), (None, [1.0] * 4, 1, "", 0), (102, [nan] + [1.0] * 3, 1, "", 0),
             (103, [inf] * 4, 2, "", 0), (104, [None, 1.0, 1.0, 1.0], 2, "", 0), (10, [9.0] * 4, 0, "", 0), (20, data[20][1], data[20][2], "", 0),
             (110, [1.0, 2.0], 0, "", 0), (111, [1.0, 2.5], 0, "", 0), (112, [0.75, 2.0], 1, "", 0), (120, [], 1, "", 0), (121, [], 1, "", 0),
             (122, [], 2, "", 0), (130, [0.0] * 4, 1, "", 0), (131, [0.0] * 4, 1, "", 0)]
    want = brute(taking_part(data), 10)
    assert mined(spark, data) == want
    assert {(110, 111, 1, 112), (120, 121, 1, 122)} <= {w[:4] for w in want}


def test_equal_vectors_and_ties(spark):
    data = [(i, [1.0, 0.5] if i % 3 else [0.8, 0.5], i % 2, "", 0) for i in range(300)]
    assert mined(spark, data) == brute(taking_part(data), 10)
    assert mined(spark, [(i, [1.0], 7, "", 0) for i in range(50)]) == []  # one label: no negatives


def test_large_values(spark):
    data = [(i, [s * 3e5, s * 1e5 + i], i % 2, "", 0) for i, s in enumerate([1.0, 0.9, 0.8, 0.7, 0.9, 0.85, 0.6, 0.5, 0.95, 0.75, 1.0])]
    data += [(50, [1e30, 1.0], 0, "", 0), (60, [3e38, -3e38], 1, "", 0)]  # past a long: take no part
    want = brute(taking_part(data[:-2]), 10)
    assert mined(spark, data) == want and max(w[4] for w in want) > 1 << 45


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1, "", 0)]) == []


@pytest.mark.parametrize("dim, spread", [(2, 1.0), (3, 0.05), (24, 1.0)])
def test_tree_holds_every_row_once_within_its_radii(dim, spread):
    rng = np.random.default_rng(dim)
    x = np.floor(256 * (rng.integers(0, 4, (300, dim)) + spread * rng.standard_normal((300, dim)))).astype(np.int32)
    x[100:120] = x[0]
    tree = negatives.Tree.build(np.arange(300), rng.integers(0, 3, 300), x)
    tree = negatives.Tree.unpack(tree.pack())
    assert sorted(tree.center[tree.fresh].tolist()) == list(range(300))
    top = negatives.lengths(x).max()
    lifted = np.concatenate([x, np.sqrt(np.maximum(top ** 2 - (x.astype(float) ** 2).sum(1), 0))[:, None]], axis=1)

    def below(i):
        return {int(tree.center[i])}.union(*(below(j) for j in range(tree.begin[i], tree.begin[i + 1])))

    for i in range(len(tree.center)):
        rows = sorted(below(i))
        assert np.sqrt(((lifted[rows] - lifted[tree.center[i]]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-3
        assert tree.least[i] == tree.labels[rows].min() and tree.most[i] == tree.labels[rows].max()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10 ** 6))
def test_descent_skips_nothing_that_counts(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(40 * rng.standard_normal((80, 3))).astype(np.int32)
    labels = rng.integers(0, 3, 80)
    tree = negatives.Tree.build(np.arange(80), labels, x)
    q = x[:9].astype(np.int64)
    low = rng.integers(-3000, 1000, (9, 2))
    high = low + rng.integers(0, 3000, (9, 2))
    search = negatives.Search(np.arange(9), labels[:9], x[:9], low, high, 2, False)
    search.descend(tree)
    got = sorted(zip(*(c.tolist() for c in search.best())))
    s = q @ x.T
    want = []
    for a in range(9):
        for w in range(2):
            fit = sorted((-s[a, i], i) for i in range(80) if labels[i] != labels[a] and low[a, w] <= s[a, i] <= high[a, w])[:2]
            want += [(a, w, i, -v) for v, i in fit]
    assert got == sorted(want)


def test_pruning_visits_few_rows():
    """On clustered rows most products are never taken."""
    rng = np.random.default_rng(3)
    centers = 256 * rng.standard_normal((40, 8))
    x = np.floor(np.repeat(centers, 50, axis=0) + 4 * rng.standard_normal((2000, 8))).astype(np.int32)
    tree = negatives.Tree.build(np.arange(2000), np.arange(2000) % 4, x)
    anchors = np.arange(0, 2000, 50)
    search = negatives.Search(anchors, tree.labels[anchors], x[anchors], np.full((40, 1), -(1 << 62)), np.full((40, 1), 1 << 62), 5, True)
    seen = 0
    visit = search._visit

    def counted(t, rows, a_rows, a, node):
        nonlocal seen
        seen += len(a)
        return visit(t, rows, a_rows, a, node)

    search._visit = counted
    search.descend(tree)
    assert seen < 0.3 * 40 * 2000
