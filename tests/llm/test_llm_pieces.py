"""SentencePiece: equality with the library on whole texts."""

import hashlib
import random

from riskweave.llm import pieces


def expected(text):
    sp = pieces._processor(pieces.default_model())
    ids = sp.encode(text or "")
    return ids, sp.decode(ids)


def test_equals_the_library(spark, monkeypatch):
    rng = random.Random(6)
    parts = ["word", " ", "  ", "\n", "\t", "▁", "é", "漢字", "\x00", "ﬁ", "<s>", "a" * 50, "🙂", "’", "   x", "1234.5", "e\u0301"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 60))) for _ in range(300)] + [None, "", " ", "▁", "x" * 20_000, "ab " * 9000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    encoded = pieces.encode(frame).collect()
    assert len(encoded) == len(rows)
    for r in encoded:
        assert list(r["ids"]) == expected(r["text"])[0]
    for r in pieces.round_trip(frame).collect():
        ids, back = expected(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_table_starts_anew_when_full(monkeypatch):
    import pyarrow as pa
    from riskweave.llm.shingles import text_buffers
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 5)
    table = pieces.ChunkTable(pieces.default_model())
    for t in ("one two three four five six seven", "two three nine", "one two three four five six seven"):
        ids, _ = table.encode(*text_buffers(pa.array([t])))
        assert ids.tolist() == expected(t)[0]


def test_every_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: list(r["ids"]) for r in pieces.encode(docs).collect()}
    sp = pieces._processor(pieces.default_model())
    assert all(got[r["doc_id"]] == sp.encode(r["text"] or "") for r in docs.collect())


def test_empty_table(spark):
    assert pieces.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
