"""The pipeline's shape, and its SQL-checked neighbours."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from oracle import compare, duck
from riskweave.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    report = compare(QUERIES[name](spark, sf), duck(sf), ORACLES[name])
    assert report["ok"] and "type_diff" not in report, report


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_stages_take_effect(spark, tmp_path):
    given = docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "mixing", "encoding"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "encoding":
            assert docs.columns == given.columns
        n = docs.count()
        if k < 3:
            assert n < before and docs.join(given, "doc_id", "left_anti").count() == 0
        before = n
    mixed = spark.read.parquet(f"{tmp_path}/3")
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in docs.collect())
    whole = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, docs.collect()))


def test_odd_and_empty_documents(spark, tmp_path):
    """Nulls, empty and very long texts, repeated ids and rows and clashing names pass all stages; no documents give no rows."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    prose = "Some words make a sentence here, number {}. And one more line of plain words follows it."
    rows = [(i, prose.format(i) * 3, "en", "a", 10, "x") for i in range(12)]
    rows += [(1, "Another text under a known id. It has words of its own.", "en", "a", 1, "x"), (2, rows[2][1], "en", "a", 10, "x"),
             (None, "A text without an id stands here. It is as good as others.", None, None, None, None), (50, None, "en", "b", None, "x"),
             (51, "", "en", "b", 0, "x"), (52, "Long words go on. " * 30_000, "en", "b", 9, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mx_copies string"
    for name, data in (("odd", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
        got = out.collect()
        assert (len(got) > 0) == (name == "odd")
        assert {r["doc_id"] for r in got} <= {d[0] for d in data}
