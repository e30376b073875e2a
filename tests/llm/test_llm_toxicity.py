"""Toxicity: exact forward-backward, gradients by behaviour, held-out accuracy, edge cases."""

import zlib

import numpy as np
import pyarrow as pa

from riskweave.llm import toxicity as tox
from riskweave.llm.shingles import text_buffers


def slow_marginals(odds, trans, start):
    m = np.exp(trans)
    n = len(odds)
    fwd, back = np.zeros((n, 2)), np.ones((n, 2))
    fwd[0] = [1, odds[0] * np.exp(start)]
    for t in range(1, n):
        fwd[t] = (fwd[t - 1] @ m) * [1, odds[t]]
        fwd[t] /= fwd[t].sum()
    for t in range(n - 2, -1, -1):
        back[t] = m @ (back[t + 1] * [1, odds[t + 1]])
        back[t] /= back[t].sum()
    both = fwd * back
    return both[:, 1] / both.sum(axis=1)


def test_marginals_equal_the_plain_recursion():
    rng = np.random.default_rng(0)
    lengths = [1, 2, 700, 3, 1, 41]
    odds = np.exp(rng.normal(-1, 3, sum(lengths)))
    first = np.zeros(len(odds), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    field = tox.Field(np.zeros(1), np.array([[1.0, -2.0], [-1.0, 0.5]]), -1.5)
    fwd, back = field.forward_backward(odds, first)
    p = fwd * back / (1 + fwd * back)
    at = 0
    for n in lengths:
        assert np.allclose(p[at:at + n], slow_marginals(odds[at:at + n], field.trans, field.start), atol=1e-12)
        at += n


def corpus(n=400, seed=1):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("bcdfgaeiou"), rng.integers(3, 9))) for _ in range(400)]
    bad = ["zzvile", "zzrotten", "qxvicious"]
    texts, toxic = [], []
    for i in range(n):
        w = list(rng.choice(vocab, rng.integers(5, 80)))
        if i % 5 == 0:
            for _ in range(1 + i % 3):
                w.insert(rng.integers(0, len(w) + 1), str(rng.choice(bad)) + ("!" if i % 2 else ""))
        texts.append(" ".join(w).capitalize() + ".")
        toxic.append(i % 5 == 0)
    return texts, np.array(toxic)


def test_learns_spans_from_document_labels():
    texts, toxic = corpus()
    field = tox.train([(texts, toxic)])
    fresh, truth = corpus(200, 2)
    score, spans = tox.score_block(field, *text_buffers(pa.array(fresh)))
    assert np.mean((score >= 0.3) == truth) > 0.97
    for text, t, found in zip(fresh, truth, spans):
        for s in found:
            assert any(x in text[s["start"]:s["end"]].lower() for x in ("zz", "qx")) or not t
    shouted, _ = tox.score_block(field, *text_buffers(pa.array(["Fine words. ZZVILE\u00a0é zzrottenest", ""])))
    assert shouted[0] > 0.3 and shouted[1] == 0.0


def test_span_offsets_are_code_points():
    texts, toxic = corpus()
    text = "éé 漢 zzvile x"
    _, spans = tox.score_block(tox.train([(texts, toxic)]), *text_buffers(pa.array([text])))
    assert [text[s["start"]:s["end"]] for s in spans[0]] == ["zzvile"]


def frames(spark):
    texts, toxic = corpus(300)
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in enumerate(texts)] + [(900, None, "c", 1.0), (901, "", "c", 1.0), (None, "zzvile", "c", 1.0),
                                 (0, texts[0], "clash", 1.0)], "doc_id long, text string, spans string, score double")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)] + [(5, 1, 1), (None, 1, 1), (7, None, None), (12345, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels, toxic


def test_fit_score_and_stage(spark, tmp_path):
    docs, labels, toxic = frames(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = tox.keep_clean(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    clean = {i for i, t in enumerate(toxic) if not t}
    assert clean <= set(got) and {900, 901} <= set(got) and None not in got
    assert len(set(got) & {i for i, t in enumerate(toxic) if t}) <= 2


def test_held_out_rows_are_never_learnt_from(spark):
    rows = spark.range(200).select("id", tox.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
    docs, labels, _ = frames(spark)
    flipped = labels.withColumn("toxic", __import__("pyspark.sql.functions", fromlist=["F"]).when(tox.held_out("doc_id"), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    a, b = tox.fit(docs, labels), tox.fit(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_nothing_to_learn(spark):
    docs, labels, _ = frames(spark)
    for none in (labels.where("toxic = 5"), labels.where("toxic = 0")):
        scored = tox.score_documents(docs.select("doc_id", "text"), tox.fit(docs, none)).collect()
        assert len(scored) == docs.count() and max(r["score"] for r in scored) < 1e-6
    empty = docs.where("doc_id = -1")
    assert tox.score_documents(empty.select("doc_id", "text"), tox.fit(empty, labels)).count() == 0


def test_training_in_batches_is_training_on_the_whole():
    texts, toxic = corpus()
    whole = tox.train([(texts, toxic)])
    parts = tox.train([(texts[:7], toxic[:7]), ([], toxic[:0]), (texts[7:], toxic[7:])])
    assert np.allclose(whole.weights, parts.weights) and np.allclose(whole.trans, parts.trans)


def test_ids_that_repeat_with_other_texts_and_long_texts(spark):
    docs, labels, _ = frames(spark)
    more = docs.union(docs.selectExpr("doc_id", "concat('zz ', text, ' other')", "spans", "score")).union(
        spark.createDataFrame([(1, "long words here " * 40_000, "c", 1.0)], docs.schema))
    a, b = tox.fit(more.repartition(7), labels), tox.fit(more.repartition(2), labels)
    assert np.array_equal(a.weights, b.weights) and a.start == b.start
    assert tox.score_documents(more.select("doc_id", "text"), a).count() == more.count()
