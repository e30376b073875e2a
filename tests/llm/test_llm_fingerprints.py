"""Fingerprints against exact sets of shingles."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from riskweave.llm import fingerprints as fp


def exact(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    out = [" ".join(rng.choices(vocab, k=k)) for k in (0, 1, 3, 5, 6, 50, 200, 3000, 3000)]
    return out + [out[5], out[6] + " more words at the end", "é ü 漢字 " * 30, None, ""]


def check(rows, docs):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), jaccard(exact(t), exact(edited)), jaccard(exact(t), exact(after))))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in rows), key=key)
    want.sort(key=key)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert abs(g[3] - w[3]) < 0.13 and abs(g[4] - w[4]) < 0.13


def test_every_text_beside_the_next(spark):
    docs = [(100 - 3 * i, t) for i, t in enumerate(texts())]
    frame = spark.createDataFrame([(i, t, "x", 9) for i, t in docs], "doc_id long, text string, fingerprint string, n_chars long")
    check(fp.compare_with_next(frame.repartition(5)).collect(), docs)


def test_few_rows_ties_and_nulls(spark):
    for docs in ([], [(1, "only one text here to see")], [(1, "a b c"), (1, "a b d"), (2, "z")], [(None, "n u l l"), (5, "a"), (5, "a")]):
        frame = spark.createDataFrame(docs, "doc_id long, text string")
        rows = fp.compare_with_next(frame).collect()
        assert len(rows) == len(docs)
        if docs:
            check(rows, docs)


def test_estimates_and_merging(spark):
    values = texts()
    frame = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(values)], "id int, part int, text string").withColumn(
        "fingerprint", fp.fingerprint(F.col("text")))
    rows = {r["id"]: r for r in frame.withColumn("n", fp.distinct_shingles(F.col("fingerprint"))).collect()}
    assert rows[5]["fingerprint"] == rows[9]["fingerprint"] and rows[0]["fingerprint"] == rows[12]["fingerprint"] == ""
    for i, t in enumerate(values):
        n = len(exact(t))
        assert abs(rows[i]["n"] - n) <= (0 if n < fp.SKETCH else 0.25 * n)
    pair = frame.where("id = 6").select(F.col("fingerprint").alias("a")).crossJoin(frame.where("id = 10").select(F.col("fingerprint").alias("b")))
    r = pair.select(fp.resemblance(F.col("a"), F.col("b")).alias("r"), fp.containment(F.col("a"), F.col("b")).alias("c")).first()
    assert abs(r["r"] - jaccard(exact(values[6]), exact(values[10]))) < 1e-9 and abs(r["c"] - 1.0) < 1e-9
    merged = {r["part"]: fp.unpack(r["fingerprint"]) for r in fp.merge_fingerprints(frame.repartition(4), "part").collect()}
    for part in (0, 1):
        parts = [fp.unpack(rows[i]["fingerprint"]) for i in rows if i % 2 == part]
        assert np.array_equal(merged[part], np.unique(np.concatenate(parts))[:fp.SKETCH])


def test_pack_round_trip():
    s = np.array([0, 1, (1 << 48) - 1], np.uint64)
    assert np.array_equal(fp.unpack(fp.pack(s)), s) and fp.pack(s[:0]) == "" and len(fp.unpack(None)) == 0
