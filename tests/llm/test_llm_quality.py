"""Quality: label model against planted accuracies, scorer on held data, edge cases."""

import numpy as np
import pytest

from riskweave.llm import quality


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    true = np.array([0.95, 0.9, 0.85, 0.9, 0.95, 0.9, 0.8, 0.9, 0.97, 0.95, 0.96])
    # a vote is right with the heuristic's accuracy: bad heuristics vote on bad texts, and seldom on good ones
    cast = np.zeros((len(good), len(true)), np.int8)
    for k, (p, a) in enumerate(zip(quality.POLARITY, true)):
        fitting = good if p > 0 else ~good
        share = 0.6
        wrong = share * fitting.mean() * (1 - a) / a / max((~fitting).mean(), 1e-9)
        cast[:, k] = rng.random(len(good)) < np.where(fitting, share, wrong)
    patterns, counts = np.unique(cast, axis=0, return_counts=True)
    model = quality.fit_labels(patterns, counts.astype(float))
    assert abs(model.prior - 0.8) < 0.08
    assert np.mean((model.posterior(cast) >= 0.5) == good) > 0.95


def test_junk_is_rejected_and_prose_kept(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(300)]

    def prose(k):
        return ". ".join(" ".join(rng.choice(words, 9)).capitalize() for _ in range(k)) + "."

    def junk(i):
        w = list(rng.choice(words, 60))
        return [" ".join(x + "***" for x in w), " | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join([w[0]] * 30 + [w[1]] * 30)][i % 4]

    rows = [(i, prose(1 + i % 7), "clash", 1.0) for i in range(160)] + [(1000 + i, junk(i), "clash", 1.0) for i in range(40)]
    rows += [(5, rows[5][1], "clash", 1.0), (None, prose(3), "clash", 1.0), (2000, None, None, None), (2001, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, votes string, quality double")
    kept = quality.keep_good(spark, docs, "")
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in got if x is not None and x < 1000) == sorted([*range(160), 5])
    assert not [x for x in got if x is not None and 1000 <= x < 2000]
    assert None in got


def test_empty_table_and_one_sided_corpus(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.keep_good(spark, empty, "").count() == 0
    same = spark.createDataFrame([(i, "A plain line of words here. And one more line.") for i in range(5)], "doc_id long, text string")
    assert quality.keep_good(spark, same, "").count() == 5


@pytest.mark.parametrize("text, name", [("A** B** C** D** " * 9, "marks"), ("go go go go " * 9, "repeats"), ("HEY!! YOU!! " * 9, "shouts")])
def test_heuristics(text, name):
    import pyarrow as pa
    from riskweave.llm.shingles import text_buffers
    cast = quality.votes(quality.text_counts(*text_buffers(pa.array([text, "Some words make a sentence here. So do these others.", ""]))))
    assert cast[0, quality.HEURISTICS.index(name)] == 1
    assert cast[1].tolist() == [0] * 8 + [1] * 3
    assert not cast[2].any()


def test_agreement_with_labels(spark):
    """Held-out check: no label is used in training."""
    sf = "/root/testdata/sf0.01"
    from riskweave.llm.queries import QUERIES
    kept = {r["doc_id"]: r["keep"] for r in QUERIES["op2_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    right = [kept[r["doc_id"]] == (r["quality"] == 1) for r in labels if r["quality"] is not None and r["doc_id"] in kept]
    assert np.mean(right) > 0.95


def test_long_repetitive_text_is_voted_bad():
    import pyarrow as pa
    from riskweave.llm.shingles import text_buffers
    rng = np.random.default_rng(0)
    stale = " ".join(rng.choice([f"word{i}" for i in range(60)], 30_000))
    varied = " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 30_000) % 100_000)
    cast = quality.votes(quality.text_counts(*text_buffers(pa.array([stale, varied]))))
    assert cast[:, quality.HEURISTICS.index("stale")].tolist() == [1, 0]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_repeated_ids_keep_their_own_texts(spark, parts):
    """Junk under the ids of good documents, or under null ids, scores as junk under ids of its own."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(300)]
    good = [". ".join(" ".join(rng.choice(words, 9)).capitalize() for _ in range(4)) + "." for _ in range(330)]
    junk = [" ".join(x.upper() + "!!" for x in rng.choice(words, 60)) for _ in range(110)]
    rows = [(i, t) for i, t in enumerate(good[:300])] + [(i if i % 2 else None, t) for i, t in enumerate(junk[:100])]
    _, scorer = quality.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts))
    fresh = spark.createDataFrame([(i, t) for i, t in enumerate(good[300:] + junk[100:])], "doc_id long, text string")
    score = [r["quality"] for r in quality.score_documents(fresh, scorer).orderBy("doc_id").collect()]
    assert min(score[:30]) > 0.9 and max(score[30:]) < 0.1


def test_em_against_a_plain_version():
    """The label model of a few votes, step by step in plain Python."""
    import math
    patterns = np.zeros((6, 11), np.int8)
    patterns[1, [0, 3]], patterns[2, [8, 9]], patterns[3, [8, 10]], patterns[4, [1]], patterns[5, [0, 9]] = 1, 1, 1, 1, 1
    counts = np.array([3.0, 10, 40, 20, 5, 2])
    prior, acc = 0.5, [0.8] * 11

    def post():
        out = []
        for row in patterns:
            z = math.log(prior / (1 - prior)) + sum(int(p) * math.log(a / (1 - a)) for v, p, a in zip(row, quality.POLARITY, acc) if v)
            out.append(1 / (1 + math.exp(-z)))
        return out
    for _ in range(7):
        p = post()
        acc = [min(max((sum(c * (q if pol > 0 else 1 - q) for c, q, row in zip(counts, p, patterns) if row[k]) + 4)
                       / (sum(c for c, row in zip(counts, patterns) if row[k]) + 5), 0.6), 0.99) for k, pol in enumerate(quality.POLARITY)]
        prior = min(max((sum(c * q for c, q in zip(counts, p)) + 1) / (sum(counts) + 2), 0.01), 0.99)
    model = quality.fit_labels(patterns, counts, steps=7)
    assert abs(model.prior - prior) < 1e-12 and np.allclose(model.accuracy, acc) and np.allclose(model.posterior(patterns), post())


def test_very_long_text_and_clashing_columns(spark):
    rows = [(1, "Some words make a sentence here. " * 20_000, "x", 2.0), (2, "One more line of words.", "x", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string, shares double")
    kept = quality.keep_good(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() <= 2
