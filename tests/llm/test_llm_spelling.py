"""Spelling variants against brute-force edit distance."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np

from riskweave.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)):] == b[p + 1:]


def brute(counts: dict[str, int]) -> dict[str, tuple]:
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def groups(spark, counts, **options):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = spelling.variant_groups(words, **options).collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def random_words(seed, letters, lengths, size):
    rng = random.Random(seed)
    words = {"".join(rng.choices(letters, k=rng.choice(lengths))) for _ in range(size)}
    for w in list(words)[::2]:
        i = rng.randrange(len(w) + 1)
        words.add(rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:]]))
    return {w: rng.choice([3, 3, 6, 7, 14, 40, 100]) for w in words if w}


def test_against_brute_force(spark):
    counts = random_words(0, "abcé", range(1, 9), 500)
    assert groups(spark, counts) == brute(counts)


def test_large_lists_are_split(spark):
    # half of all words share a long head or tail; lists are cut down to a few words
    counts = random_words(1, "abc", range(3, 6), 150)
    counts = {**counts, **{"zzzzzzzz" + w: n + 1 for w, n in counts.items()}, **{w + "yyyyyyyy": n + 2 for w, n in counts.items()}}
    want = brute(counts)
    assert groups(spark, counts, block=8) == want
    assert groups(spark, counts) == want


def test_lists_keep_each_pair_once(spark):
    counts = {"aaaaa": 3, "aaaa": 6, "aaaaaa": 12, "aabaa": 3, "baaaa": 24, "aaaab": 3}
    pairs = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert Counter((r.word, r.near) for r in pairs) == Counter((a, b) for a in counts for b in counts if one_edit(a, b))
    assert groups(spark, counts) == brute(counts)


def test_ties_chains_and_roots(spark):
    counts = {"aaaaaa": 1, "aaaaab": 2, "aaaabb": 4, "aaabbb": 8, "aabbbb": 16, "abbbbb": 32, "bbbbbb": 64, "aaaaac": 2}
    got = groups(spark, counts)
    assert got == brute(counts)
    assert got["aaaaaa"] == ("aaaaab", "bbbbbb", 1, 2, 2)  # equal counts: the smaller word


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=7), min_size=2, max_size=30, unique=True))
def test_scan_of_one_list(words):
    words = sorted(words)
    length = np.array([len(w) for w in words])
    start = np.cumsum(length) - length
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    first = np.arange(len(words)) == 0
    shared = np.zeros(len(words), np.int64)
    lcp = spelling.adjacent_prefixes(codes, start, length, shared, first)
    a, b = spelling.near_pairs(codes, start, length, shared, first, lcp, np.arange(len(words)))
    assert sorted(zip(a.tolist(), b.tolist())) == [(i, j) for i, v in enumerate(words) for j, w in enumerate(words) if one_edit(v, w)]


def plain_counts(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def test_vocabulary(spark):
    rng = random.Random(5)
    words = ["Hello", "wörld", "ÀÉÎÕÜ", "straße", "x", "ab", "Ünïcode", "plain", "PLAINS", "don't", "a×b÷c", "日本語text", "naïve-ly"]
    docs = [(i, " ".join(rng.choices(words, k=30))) for i in range(60)]
    docs += [(None, "nulls nulls nulls"), (7, None), (8, ""), (9, "12 34 !"), (3, docs[3][1]), (3, docs[3][1])]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in spelling.vocabulary(df).collect()}
    assert got == plain_counts(docs)
    assert got["nulls"] == 3 and "ÀÉÎÕÜ" in got  # only A-Z is lower-cased


def test_long_words(spark):
    long = "ab" * 20_000
    docs = [(i, f"{long} {long}x short") for i in range(4)]
    words = spelling.vocabulary(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {r.word: (r.form, r.root, r.n, r.n_near) for r in spelling.variant_groups(words).collect()}
    want = {w: v[:4] for w, v in brute(plain_counts(docs)).items()}
    assert got == want and max(map(len, got)) > 39_000


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = spelling.variant_groups(spelling.vocabulary(docs))
    assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
