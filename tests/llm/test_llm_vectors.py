"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import vectors


def brute(rows, queries, k):
    out = []
    for q in queries:
        d = sorted((float(np.sqrt(((rows[q] - v) ** 2).sum())), i) for i, v in rows.items() if i != q)[:k]
        out += [(q, r, i, s) for r, (s, i) in enumerate(d, 1)]
    return out


def search(spark, data, k=10, divisor=100, schema="vec_id long, embedding array<float>, score int"):
    index = vectors.Index(spark.createDataFrame(data, schema), "vec_id", "embedding")
    found = index.search(index.table.where(F.col("id") % divisor == 0).select("id", "vector"), k)
    return [tuple(r) for r in found.orderBy("query_id", "rank").collect()]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((20, 32))
    rows = {i: (centers[i % 20] + 0.7 * rng.standard_normal(32)).astype(np.float32).astype(float) for i in range(3000)}
    rows[201], rows[301] = rows[200], rows[200]  # exact ties
    got = search(spark, [(i, v.tolist(), 1) for i, v in rows.items()])
    want = brute(rows, range(0, 3000, 100), 10)
    assert len(got) == len(want)
    assert len({g[::2][:2] for g in got} & {w[::2][:2] for w in want}) >= 0.95 * len(want)
    exact = {(w[0], w[2]): w[3] for w in brute(rows, range(0, 3000, 100), 2999)}
    assert all(abs(g[3] - exact[g[0], g[2]]) < 1e-12 for g in got)
    assert [g[2] for g in got if g[0] == 200][:2] == [201, 301]


def test_unusable_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [2.0, 0.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1),
            (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (100, None, 1), (2, [2.0, 5.0], 1), (9, [], 1)]
    got = search(spark, data)
    assert [(g[0], g[1], g[2]) for g in got] == [(0, 1, 2), (0, 2, 1)]  # fewer candidates than k; the least of the rows of id 2
    assert got[0][3] == 1.0


def test_empty_and_single(spark):
    assert search(spark, []) == []
    assert search(spark, [(0, [1.0, 2.0], 1)]) == []
    assert search(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]) == []


def test_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    data = [(i, rng.standard_normal(8).astype(np.float32).tolist(), 1) for i in range(120)]
    whole = search(spark, data, 5, 10)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    assert search(spark, data, 5, 10) == whole and len(whole) == 60


@pytest.mark.parametrize("dim", [1, 7, 64, 100])
def test_popcounts_give_the_inner_product_with_the_signs(dim):
    rng = np.random.default_rng(dim)
    queries, signs = rng.standard_normal((9, dim)), rng.random((50, dim)) < 0.5
    queries[0] = 0.25  # no spread to cut
    planes = vectors.Planes(queries)
    words = vectors._words(np.packbits(signs, axis=1))
    ones = np.bitwise_count(words).sum(axis=1)
    exact = queries @ (2.0 * signs - 1).T / np.sqrt(dim)
    for j in range(len(queries)):
        assert np.abs(planes.inner(j, words, ones) - exact[j]).max() <= planes.error[j] + 1e-9


def test_length_of_most_rows_counts(spark):
    """The index takes the length of most rows, wherever the smallest hashes lie."""
    data = [(i, [float(i), 1.0], 1) for i in range(30)] + [(100 + i, [1.0, 2.0, float(i)], 1) for i in range(29)]
    assert vectors.Index(spark.createDataFrame(data, "vec_id long, embedding array<float>, score int"), "vec_id", "embedding").dim == 2
