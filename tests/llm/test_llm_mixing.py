"""Mixing: targets against the resharing loop, bounds, determinism, edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from riskweave.llm import mixing

SCHEMA = "doc_id long, text string, source string, mx_size string, copies string"


def run(spark, rows):
    return mixing.mix(spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).select("doc_id", "text", "source"))


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_targets_and_shares(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.choice([1, 3]) for _ in range(int(rng.paretovariate(1.2) * 5) % 900)),
             rng.choices(["a", "b", "Z", "é", None], [30, 5, 3, 2, 2])[0]) for i in range(3000)]
    rows += [(5000 + i, "same text of five words", "a") for i in range(1500)]  # a third alike
    out = run(spark, rows).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall("[^\x20\x09-\x0d]+", t))
    want = targets(sizes)
    taken, largest = Counter(), Counter()
    for r in out:
        s = r["source"]
        assert r["mx_source_size"] == sizes[s] and abs(r["mx_target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["mx_copies"] <= 2
        taken[s] += r["mx_copies"] * r["mx_size"]
        largest[s] = max(largest[s], r["mx_size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2 * largest[s], 0.02 * want[s])
    again = run(spark, rows[::-1]).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_edge_cases(spark):
    assert run(spark, []).count() == 0
    rows = [(1, None, "a"), (None, "x y", "a"), (2, "", None), (3, " \n ", None), (4, "q", "b"), (4, "q", "b")]
    got = run(spark, rows).collect()
    assert sorted((r["doc_id"] or 0, r["mx_size"]) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1)]
    assert {r["source"]: r["mx_target"] for r in got}[None] == 0.0
    only_empty = run(spark, [(1, "", "a"), (2, None, "b")]).collect()
    assert [(r["mx_target"], r["mx_copies"]) for r in only_empty] == [(0.0, 0), (0.0, 0)]


def test_emit_repeats_rows(spark):
    docs = spark.createDataFrame([(i, f"w{i} x", "s", "keep") for i in range(20)], "doc_id long, text string, source string, copies string")
    out = mixing.mix_documents(spark, docs, "")
    assert out.columns == docs.columns
    assert out.count() == 30 and {r["copies"] for r in out.collect()} == {"keep"}


def test_plan_stays_in_expressions(spark):
    plan = mixing.op8_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_ids_with_a_pattern_still_spread(spark):
    from pyspark.sql import functions as F
    salts = spark.range(4096).select(mixing.id_salt(F.col("id") * 64, 64).alias("s")).groupBy("s").count().collect()
    assert len(salts) == 64 and max(r["count"] for r in salts) < 3 * 64


def test_sums_do_not_grow_with_the_corpus(spark):
    """Expectations that add up past a long: the copies are those of exact integers."""
    from pyspark.sql import functions as F
    n, rate = 2000, 2.0 ** 30 - 0.3  # as many copies in all as billions of documents would have
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(7).cast("long").alias("size"), F.lit(rate).alias("rate"))
    got = [r["mx_copies"] for r in mixing.systematic_copies(df, "source", "size", "rate", "doc_id").collect()]
    assert abs(sum(got) - n * rate) <= 1 and set(got) <= {2 ** 30 - 1, 2 ** 30}


def test_very_long_text(spark):
    got = run(spark, [(1, "w " * 1_000_000, "a"), (2, "w", "a")]).collect()
    assert {r["doc_id"]: r["mx_size"] for r in got} == {1: 1_000_000, 2: 1}
