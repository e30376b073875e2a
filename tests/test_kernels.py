"""Distributed kernels against brute force on small inputs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.operators import curves as cv
from riskweave.operators import drift as dr
from riskweave.operators import split as sp
from riskweave.operators import windows as wn
from riskweave.operators.ranking import exact_quantiles, prefix_sums, value_bucket
from conftest import SF_SMALL
from riskweave.sources.tables import transactions


def _auc_brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap_brute(scores, labels):
    thr = sorted(set(scores), reverse=True)
    P = sum(labels)
    ap, prev_r = 0.0, 0.0
    for t in thr:
        tp = sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)
        k = sum(1 for s in scores if s >= t)
        r = tp / P
        ap += (r - prev_r) * (tp / k)
        prev_r = r
    return ap


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(7)
    rows = [(i, round(rnd.random(), 2), 1 if rnd.random() < 0.3 else 0) for i in range(400)]  # many ties
    return rows, spark.createDataFrame(rows, "id long, s double, y int")


def test_auc_and_ap_match_brute_force(scored):
    rows, df = scored
    s, y = [r[1] for r in rows], [r[2] for r in rows]
    assert cv.roc_auc(df, "s", "y").first()[0] == pytest.approx(_auc_brute(s, y), abs=1e-12)
    assert cv.average_precision(df, "s", "y").first()[0] == pytest.approx(_ap_brute(s, y), abs=1e-12)


def test_auc_flips_under_negation(scored):
    _, df = scored
    a = cv.roc_auc(df, "s", "y").first()[0]
    b = cv.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first()[0]
    assert a + b == pytest.approx(1.0)


def test_threshold_example(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 0, 1, 1, 1, 1], [.1, .2, .3, .4, .6, .7, .8, .9])), "y int, p double")
    r = cv.tune_threshold(df, "p", "y", 0.95).first()
    assert (r.threshold, r.precision, r.recall, r.target_reached) == (0.6, 1.0, 1.0, True)
    none = cv.recall_at_precision(df.withColumn("y", F.lit(0)).union(df.limit(1).withColumn("y", F.lit(1))),
                                  "p", "y", 1.01).first()
    assert none.threshold_at_target is None


def test_value_bucket_is_monotone(spark):
    import random
    rng = random.Random(2)
    vals = [s * m * 10.0 ** e for e in range(-9, 12) for m in (1, 1.0000001, 9.9999999, 9.99, 5, rng.random()) for s in (1, -1)]
    vals += [0.0, -0.0, float("inf"), float("-inf"), float("nan"), 999.9999999999999, 1000.0, 1e300, 5e-324, None]
    rows = spark.createDataFrame([(v,) for v in vals], "v double").select("v", value_bucket(F.col("v")).alias("b")).orderBy("v").collect()
    got = [r.b for r in rows if r.v is not None]
    assert got == sorted(got) and len(set(got)) > 100


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_keep_null_groups(spark, descending):
    rows = [(g, float(v) if v % 11 else None, 1) for v in range(200) for g in ("a", None, "")]
    df = spark.createDataFrame(rows, "g string, k double, x int")
    got = {(r.g, r.k): r.cum_c for r in prefix_sums(df, "k", {"c": F.lit(1)}, by=["g"], descending=descending).collect()}
    want = {}
    for g in ("a", None, ""):
        keys = sorted({k for h, k, _ in rows if h == g}, key=lambda k: (k is not None, k or 0), reverse=descending)
        total = 0
        for k in keys:
            total += sum(1 for h, j, _ in rows if h == g and j == k)
            want[g, k] = total
    assert got == want


def test_prefix_sums_equal_plain_window(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 7).alias("g"), ((F.col("id") * 37) % 101).alias("k"))
    got = prefix_sums(df, "k", {"c": F.lit(1)}, by=["g"])
    plain = df.groupBy("g", "k").agg(F.count("*").alias("c")).withColumn(
        "ref", F.sum("c").over(Window.partitionBy("g").orderBy("k")))
    j = got.join(plain, ["g", "k"])
    assert j.count() == plain.count()
    assert j.where(F.col("cum_c") != F.col("ref")).count() == 0


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [float(x) for x in np.random.default_rng(3).exponential(100, 501).round(2)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    probs = [0, .1, .25, .5, .75, .95, 1]
    got = {r.prob: r.quantile for r in exact_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.percentile(vals, p * 100)), rel=1e-12)


def test_ks_and_psi_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    a = rng.normal(0, 1, 300).round(3)
    b = rng.normal(0.3, 1.2, 200).round(3)
    ref = spark.createDataFrame([(float(x),) for x in a], "x double")
    cur = spark.createDataFrame([(float(x),) for x in b], "x double")
    rl, cl = dr.to_long(ref, ["x"]), dr.to_long(cur, ["x"])
    ks = dr.ks_statistics(rl, cl).first().ks_statistic
    grid = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert ks == pytest.approx(float(np.max(np.abs(fa - fb))), abs=1e-12)
    edges = np.unique(np.percentile(a, np.linspace(0, 100, 11)))
    rc, cc = [], []
    for i in range(len(edges) - 1):
        last = i == len(edges) - 2
        ma = (edges[i] <= a) & ((a <= edges[i + 1]) if last else (a < edges[i + 1]))
        mb = (edges[i] <= b) & ((b <= edges[i + 1]) if last else (b < edges[i + 1]))
        rc.append(ma.sum() / len(a))
        cc.append(mb.sum() / len(b))
    rc = np.where(np.array(rc) == 0, 1e-4, rc)
    cc = np.where(np.array(cc) == 0, 1e-4, cc)
    psi = float(np.sum((cc - rc) * np.log(cc / rc)))
    assert dr.psi_numeric(rl, cl).first().psi == pytest.approx(psi, rel=1e-9)
    assert dr.psi_numeric(rl, rl).first().psi == pytest.approx(0.0, abs=1e-12)


def test_grouped_quantiles_match_the_percentile_aggregate(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1013 / 10).alias("v"))
    a = {(r.g, p): q for r in df.groupBy("g").agg(F.percentile("v", [.1, .5, .9]).alias("q")).collect() for p, q in zip([.1, .5, .9], r.q)}
    b = {(r.g, r.prob): r.quantile for r in exact_quantiles(df, "v", [.1, .5, .9], ["g"]).collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-12)


def test_no_job_runs_while_a_plan_is_built(spark):
    group = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    exact_quantiles(spark.range(100).select(F.col("id").cast("double").alias("v")), "v", [.5])
    prefix_sums(spark.range(100).withColumn("s", F.lit(1)), "id", {"n": F.lit(1)})
    assert len(group.getJobIdsForGroup("building")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_psi_constant_reference_is_zero(spark):
    ref = spark.createDataFrame([(5.0,)] * 10, "x double")
    cur = spark.createDataFrame([(1.0,), (9.0,)], "x double")
    assert dr.psi_numeric(dr.to_long(ref, ["x"]), dr.to_long(cur, ["x"])).first().psi == 0.0


def test_drift_report_edge_rows(spark):
    ref = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, b double")
    cur = spark.createDataFrame([(None,)], "a double")
    rows = {r.feature: r for r in dr.drift_report(ref, cur, ["a", "b"]).collect()}
    assert rows["b"].drift_detected and rows["b"].drift_score == 1.0       # missing column
    assert not rows["a"].drift_detected and rows["a"].drift_score == 0.0   # empty side after nulls
    assert dr.overall_drift(dr.drift_report(ref, cur, ["a", "b"])).first().max_drift_score == 1.0


def test_split_distributed_path(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 < 3).cast("int").alias("y"))
    sizes = {r.split: r["count"] for r in sp.stratified_split(df, "y", "id").groupBy("split").count().collect()}
    assert sizes == {"train": 600, "val": 200, "test": 200}


def test_split_sizes_and_no_leakage(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 < 3).cast("int").alias("y"))
    s = sp.stratified_split(df, "y", "id", seed=42)
    sizes = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes == {"train": 600, "val": 200, "test": 200}
    per = {(r.split, r.y): r["count"] for r in s.groupBy("split", "y").count().collect()}
    assert per[("train", 1)] == 180 and per[("test", 1)] == 60
    assert sp.split_overlap(s, "id").count() == 0


def test_folds_k3(spark):
    df = spark.createDataFrame([(i, 1 if i >= 5 else 0) for i in range(10)], "id long, y int")
    f = {(r.fold, r.y): r["count"] for r in sp.stratified_folds(df, "y", "id", k=3).groupBy("fold", "y").count().collect()}
    assert sorted(f.values()) == [1, 1, 2, 2, 2, 2]


def test_chunked_trailing_window_equals_plain(spark):
    tx = transactions(spark, SF_SMALL)
    got = wn.trailing_window(tx, ["user_id"], "created_at", 3_600_000_000, {"n": F.count(F.lit(1))},
                             chunk_us=1_800_000_000)  # look-back spans two chunks
    w = Window.partitionBy("user_id").orderBy(wn.micros("created_at")).rangeBetween(-3_600_000_000, 0)
    ref = tx.withColumn("ref", F.count(F.lit(1)).over(w))
    j = got.join(ref.select("transaction_id", "ref"), "transaction_id")
    assert j.count() == tx.count()
    assert j.where(F.col("n") != F.col("ref")).count() == 0


def test_prior_user_stats_distributed_path(spark):
    tx = transactions(spark, SF_SMALL)
    plain = wn.prior_user_stats(tx).select("transaction_id", "prior_count", "prior_avg_amount")
    dist = wn.prior_user_stats(tx).select("transaction_id", F.col("prior_count").alias("c2"),
                                          F.col("prior_avg_amount").alias("a2"))
    j = plain.join(dist, "transaction_id")
    assert j.count() == tx.count()
    assert j.where((F.col("prior_count") != F.col("c2"))
                   | (F.abs(F.coalesce(F.col("prior_avg_amount"), F.lit(0.0))
                            - F.coalesce(F.col("a2"), F.lit(0.0))) > 1e-9)).count() == 0


def test_trailing_window_with_a_hot_user(spark):
    """A user holding a third of all rows: exact counts, spread over many chunks."""
    from conftest import SF_ORACLE
    tx = transactions(spark, SF_ORACLE).withColumn(
        "user_id", F.when(F.col("transaction_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id")))
    got = wn.velocity(tx)
    w = Window.partitionBy("user_id").orderBy(wn.micros("created_at")).rangeBetween(-3_600_000_000, 0)
    ref = tx.withColumn("ref", F.count(F.lit(1)).over(w))
    j = got.join(ref.select("transaction_id", "ref"), "transaction_id")
    assert j.count() == tx.count()
    assert j.where(F.col("tx_count_last_hour") != F.col("ref")).count() == 0
    chunks = tx.where(F.col("user_id") == 1).select(
        F.floor(wn.micros("created_at") / F.lit(86_400_000_000)).alias("c")).distinct().count()
    assert chunks >= 25  # the hot user's window work is split per day


def test_sampled_edges_spread_a_narrow_range(spark):
    """10^6 epoch seconds beside scores within a thousandth of one: no bucket holds 5 % of a group, no job at build."""
    from riskweave.operators.ranking import edge_bucket, sampled_edges
    base = spark.range(1_000_000).select(F.when(F.col("id") % 2 == 0, F.col("id") + 1_700_000_000.0).otherwise(1 - 1e-9 * F.col("id")).alias("v"),
                                         (F.col("id") % 2).alias("g"))
    edges = sampled_edges(base, "v", ["g"])
    dealt = base.join(F.broadcast(edges), "g").groupBy("g", edge_bucket(F.col("v"), F.col("_edges"), 64).alias("b")).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("g", "b").collect()
    assert len(dealt) == 128 and max(r.n for r in dealt) < 0.05 * 500_000
    assert all(a.hi < b.lo for a, b in zip(dealt, dealt[1:]) if a.g == b.g)
    assert [r.asDict() for r in edges.orderBy("g").collect()] == [r.asDict() for r in sampled_edges(base.repartition(7), "v", ["g"]).orderBy("g").collect()]


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums_with_edges_equal_plain_window(spark, descending):
    nan, inf = float("nan"), float("inf")
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(5000)) / 7 + 1e9).alias("k"))
    df = df.union(spark.createDataFrame([(0, v) for v in (nan, inf, -inf, 0.0, None)] + [(None, 1.5)], "g long, k double"))
    w = Window.partitionBy("g").orderBy(F.col("k").desc() if descending else F.col("k").asc())
    want = df.groupBy("g", "k").agg(F.count("*").alias("c")).withColumn("cum", F.sum("c").over(w))
    for by in (["g"], []):
        if not by:
            want = df.groupBy("k").agg(F.count("*").alias("c")).withColumn("cum", F.sum("c").over(
                Window.orderBy(F.col("k").desc() if descending else F.col("k").asc())))
        got = prefix_sums(df, "k", {"c": F.lit(1)}, by=by, descending=descending)
        rows = lambda d, c: sorted(str((*[r[b] for b in by], r.k, r[c])) for r in d.collect())
        assert rows(got, "cum_c") == rows(want, "cum")


def test_prefix_sums_groups_beyond_the_edge_bound(spark, monkeypatch):
    from riskweave.operators import ranking
    monkeypatch.setattr(ranking, "MOST_GROUPS", 1)
    df = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("k"))
    got = prefix_sums(df, "k", {"c": F.lit(1)}, by=["g"])
    assert got.where(F.col("cum_c") != F.floor(F.col("k") / 3) + 1).isEmpty() and got.count() == 30_000


def test_approximate_quantiles_keep_their_rank_error(spark):
    from riskweave.operators.ranking import approx_quantiles
    df = spark.range(400_000).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 2).cast("double").alias("v")).union(
        spark.createDataFrame([(0, None), (2, None)], "g long, v double"))
    got = approx_quantiles(df, "v", [0.1, 0.5, 0.75, 0.99], ["g"]).collect()
    assert len(got) == 8 and all(abs(r.quantile / 200_000 - r.prob) < 0.003 for r in got)


def test_auc_of_counts_whose_product_passes_a_long(spark):
    from riskweave.operators.curves import auc_of_table
    pos, neg = 5_000_000_000, 6_000_000_000
    rows = [(0.9, pos - 10, pos, pos - 10, pos, pos, pos + neg), (0.1, 10, neg + 10 - 10, pos, pos + neg, pos, pos + neg)]
    t = spark.createDataFrame(rows, "threshold double, pos long, n long, cum_pos long, cum_n long, total_pos long, total_n long")
    high, low = (pos - 10) / pos, 10 / neg  # shares of positives above, negatives above
    want = high * (1 - low) + 0.5 * (high * low + (1 - high) * (1 - low))
    assert abs(auc_of_table(t).first().roc_auc - want) < 1e-12
