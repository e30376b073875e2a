"""Second-order boosting against a plain NumPy version, split by split."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from riskweave.operators import boosting as bo

FEATURES = ["a", "b", "c"]
PARAMS = bo.BoostingParams(rounds=7, depth=4, max_bins=31, keep_every=3)


@pytest.fixture(scope="module")
def table(spark):
    """2,000 rows: a misses values that lean to label 0, b has many ties and misses some that lean to label 1, c is noise."""
    rng = np.random.default_rng(5)
    a, b, c = rng.normal(size=2000), rng.integers(0, 6, 2000).astype(float), rng.random(2000)
    y = (a + 0.5 * b + rng.normal(scale=0.7, size=2000) > 2.0).astype(int)
    gone = rng.random(2000) < np.where(y == 1, 0.3, 0.05)
    lost = rng.random(2000) < np.where(y == 0, 0.3, 0.02)
    rows = [(None if lost[i] else float(a[i]), None if gone[i] else float(b[i]), float(c[i]), int(y[i]), 3.0 if y[i] else 1.0) for i in range(2000)]
    return spark.createDataFrame(rows, "a double, b double, c double, y int, w double")


def plain_tree(x, edges, y, w, margin, params):
    """{node: (feature, cut, missing left)} and the leaf value of every row, by masks over the rows themselves."""
    g, h = bo.derivatives(y, w, margin)
    g, h = g / bo.UNIT, h / bo.UNIT
    lam, splits, value = params.reg_lambda, {}, np.zeros(len(y))

    def grow(node, rows, depth):
        best = (params.min_gain, None)
        if depth < params.depth:
            for f in range(x.shape[1]):
                for cut, edge in enumerate(list(edges[f]) + [np.inf], 1):
                    if not (rows & (np.searchsorted(edges[f], x[:, f], "left") == cut - 1) & ~np.isnan(x[:, f])).any():
                        continue  # cuts are bins that occur in the node
                    for left_missing in (False, True):
                        left = rows & np.where(np.isnan(x[:, f]), left_missing, x[:, f] <= edge)
                        right = rows & ~left
                        if h[left].sum() < params.min_child_weight or h[right].sum() < params.min_child_weight:
                            continue
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + lam) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + lam)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut, left_missing, left, right))
        if best[1] is None:
            value[rows] = -params.learning_rate * g[rows].sum() / (h[rows].sum() + lam)
            return
        f, cut, left_missing, left, right = best[1]
        splits[node] = (f, cut, left_missing)
        grow(2 * node + 1, left, depth + 1)
        grow(2 * node + 2, right, depth + 1)

    grow(0, np.ones(len(y), bool), 0)
    return splits, value


def as_splits(tree):
    return {int(n): (int(tree.feature[n]), int(tree.cut[n]), bool(tree.missing_left[n])) for n in np.nonzero(tree.feature >= 0)[0]}


def test_matches_the_plain_version_split_by_split(table):
    trees, edges = bo.grow_trees(table, FEATURES, "y", "w", PARAMS)
    data = table.toPandas()
    x, y, w = data[FEATURES].to_numpy(float), data["y"].to_numpy(float), data["w"].to_numpy(float)
    assert len(trees) == PARAMS.rounds
    margin = np.zeros(len(y))
    for tree in trees:
        splits, value = plain_tree(x, edges, y, w, margin, PARAMS)
        assert as_splits(tree) == splits
        margin = margin + value
    assert any(left for t in trees for _, _, left in as_splits(t).values()), "no split sends missing values left"
    assert any(f == 1 and not left for t in trees for f, _, left in as_splits(t).values())
    model = bo.BoostedTreesModel.of(FEATURES, trees, edges)
    got = np.array([r.probability[1] for r in model.transform(table).select("probability").collect()])
    assert np.abs(np.sort(got) - np.sort(1 / (1 + np.exp(-margin)))).max() < 1e-9
    assert got[y == 1].mean() > got[y == 0].mean() + 0.2


def test_trees_do_not_depend_on_partitioning_or_where_margins_are_written(table):
    few = bo.BoostingParams(rounds=4, depth=3, max_bins=31, keep_every=10)
    often = bo.BoostingParams(rounds=4, depth=3, max_bins=31, keep_every=1)
    one, edges = bo.grow_trees(table.coalesce(1), FEATURES, "y", "w", few)
    many, other = bo.grow_trees(table.repartition(7, "c"), FEATURES, "y", "w", often)
    assert [e.tolist() for e in edges] == [e.tolist() for e in other]
    assert [as_splits(t) for t in one] == [as_splits(t) for t in many]
    assert all(np.array_equal(s.value, t.value) for s, t in zip(one, many))


def test_edges_are_near_their_ranks_and_bounded(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_000).cast("double").alias("x"), F.lit(1.0).alias("k"),
                                     F.lit(None).cast("double").alias("n"), F.lit(float("nan")).alias("z"))
    x, k, n, z = bo.bin_edges(df, ["x", "k", "n", "z"])
    assert len(x) == 254 and np.abs(x - np.arange(1, 255) / 255 * 100_000).max() <= 100_000 / bo.EDGE_ACCURACY + 1
    assert k.tolist() == [1.0] and not len(n) and not len(z)


def test_one_exchange_and_no_rows_at_the_driver(table):
    edges = bo.bin_edges(table, FEATURES, 31)
    hist = bo._histogram(bo._binned(table, FEATURES, "y", "w", edges), 3, [], bo.Tree(4), [0])
    best = bo.best_splits(hist, PARAMS, 3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    assert best.count() == 3  # a row per open node and feature


def test_saved_in_a_pipeline_and_odd_input(spark, table, tmp_path):
    model = bo.fit_boosted(table, FEATURES, "y", "w", bo.BoostingParams(rounds=2, depth=2))
    path = str(tmp_path / "model")
    PipelineModel(stages=[model]).write().save(path)
    back = PipelineModel.load(path)
    odd = spark.createDataFrame([(None, None, None), (float("nan"), float("inf"), float("-inf")), (0.0, 1.0, 2.0)],
                                "a double, b double, c double")
    want = [r.probability.toArray().tolist() for r in model.transform(odd).collect()]
    assert [r.probability.toArray().tolist() for r in back.transform(odd).collect()] == want
    assert all(0 < p[1] < 1 and abs(sum(p) - 1) < 1e-12 for p in want)
    assert abs(sum(back.stages[0].featureImportances) - 1) < 1e-9

    empty = bo.fit_boosted(table.limit(0), FEATURES, "y", "w", PARAMS)
    assert [r.probability[1] for r in empty.transform(odd).collect()] == [0.5] * 3
    assert list(empty.featureImportances) == [0.0] * 3
    nulls = table.withColumn("y", F.lit(None).cast("int"))
    mixed = bo.fit_boosted(table.unionByName(nulls), FEATURES, "y", "w", bo.BoostingParams(rounds=2, depth=2, max_bins=31))
    alone = bo.fit_boosted(table, FEATURES, "y", "w", bo.BoostingParams(rounds=2, depth=2, max_bins=31))
    assert [as_splits(t) for t in mixed.stored()[0]] == [as_splits(t) for t in alone.stored()[0]]


def test_bundles_give_each_features_own_sums():
    rng = np.random.default_rng(3)
    sizes = [256, 3, 2, 3, 5, 100, 1, 2, 16]
    bins = np.stack([rng.integers(0, k, 5000).astype(np.uint8) for k in sizes] + [np.zeros(5000, np.uint8)] * 2)
    bins[0, :2] = 0, 255
    bins = np.vstack([bins, bins[5:6]])  # the same bytes as feature 5
    slot, w = rng.integers(0, 4, 5000), rng.integers(-1 << 20, 1 << 20, 5000).astype(float)
    bundles, seen = bo._bundles(bins), []
    assert len(bundles) < len(sizes) // 2 + 1
    for b in bundles:
        sums = np.bincount(slot * 256 + b.codes, w, 4 * 256).astype(np.int64).reshape(4, 256)
        for f, part in b.parts(sums):
            want = np.bincount(slot * 256 + bins[f], w, 4 * 256).astype(np.int64).reshape(4, 256)
            assert np.array_equal(part, want[:, :part.shape[1]]) and not want[:, part.shape[1]:].any()
            seen.append(f)
    assert sorted(seen) == list(range(len(bins)))


def test_rows_are_kept_in_blocks_and_a_job_walks_one_tree(table, monkeypatch):
    edges = bo.bin_edges(table, FEATURES, 31)
    blocks = bo._binned(table.coalesce(1), FEATURES, "y", "w", edges)
    assert blocks.count() == 1  # 2,000 rows
    first = blocks.first()
    assert len(first.label) == 2000 * 8 and len(first.bins) == 2000 * 3
    monkeypatch.setattr(bo, "BLOCK_ROWS", 300)
    assert bo._binned(table.coalesce(1), FEATURES, "y", "w", edges).count() >= 7
    walked, plain = [], bo._histogram
    monkeypatch.setattr(bo, "_histogram", lambda rows, width, trees, *rest: walked.append(len(trees)) or plain(rows, width, trees, *rest))
    bo.grow_trees(table, FEATURES, "y", "w", bo.BoostingParams(rounds=4, depth=2, max_bins=31))
    assert walked and max(walked) == 0
