"""Shared helpers: words, shingles and components against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import shingles as S
from riskweave.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=30), max_size=8))
def test_words_match_the_pattern(texts):
    data, offsets = S.text_buffers(pa.array(texts, pa.string()))
    start, end, doc = S.word_spans(data, offsets)
    got = [[] for _ in texts]
    for a, b, d in zip(start, end, doc):
        got[d].append(bytes(data[a:b]).decode())
    assert got == [WORD.findall(t) for t in texts]


def test_hash_depends_on_the_bytes_alone(monkeypatch):
    text = " ".join(random.Random(1).choices(["alpha", "be", "c" * 40, "Alpha"], k=400))
    data, offsets = S.text_buffers(pa.array([text]))
    start, end, _ = S.word_spans(data, offsets)
    whole = S.span_hashes(data, start, end)
    monkeypatch.setattr(S, "_HASH_BYTES", 64)
    assert np.array_equal(whole, S.span_hashes(data, start, end))
    by_word = {}
    for a, b, h in zip(start, end, whole):
        assert by_word.setdefault(bytes(data[a:b]).lower(), h) == h
    assert len(set(by_word.values())) == len(by_word) == 3


@pytest.mark.parametrize("size", [4, 5])
def test_shingle_sets_count_distinct_shingles(size):
    rng = random.Random(size)
    texts = [" ".join(rng.choices("abcd", k=k)) for k in (0, 1, 2, 3, 4, 5, 6, 40, 300)] + [None, "  \n"]
    want = []
    for t in texts:
        w = WORD.findall(t or "")
        want.append(len({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))}) if w else 0)
    assert [len(s) for s in S.shingle_sets(pa.array(texts, pa.string()), size)] == want


def test_components_of_stars_chains_and_noise(spark):
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: top(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_regular_words_do_not_collide():
    """Thue-Morse words and their complements, the classic collision of polynomial hashes modulo a power of two."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    words = [word[:k] for k in (64, 256, 1024, 2048)]
    words += [w.translate(str.maketrans("ab", "ba")) for w in words] + ["ab" * 600, "ba" * 600, "a" * 65, "a" * 64 + "b"]
    data, offsets = S.text_buffers(pa.array([" ".join(words)]))
    start, end, _ = S.word_spans(data, offsets)
    assert len(set(S.span_hashes(data, start, end).tolist())) == len(words)
