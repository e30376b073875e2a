"""Second-order gradient boosting of trees for a 0/1 label.

Newton boosting with histogram split search. Every feature is cut into at most
255 bins; a row is kept as one byte per feature, its label, weight and margin, and
tens of thousands of rows are one block of arrays, which tasks read without a copy per row.
A level of a tree is one job: tasks sum first and second derivatives of the
logistic loss by (node, feature, bin), the sums meet in one exchange, and running
sums over the bins give every split's gain. Only the best split of each (node,
feature) reaches the driver: at most 2^(depth-1) rows per feature, whatever the input.

Derivatives are summed as whole numbers of 2^-20, so a tree doesn't depend on
partitioning, row order or recomputed tasks. Sums stay in range up to a total
weight of 8e12. Bin edges come from one sketch aggregate (rank error 1/10,000).

Every round adds its tree to the margins in cached blocks, so a job walks through one
tree only. Every few rounds the blocks are written to the shared folder, so a lost
executor costs no more than those rounds' trees.

Defined cases: null and NaN are missing values, and each split learns the side they
take (right if equal). Rows with a null label or weight are left out of the fit. No
rows: no trees, every score is 0.5. A column without values is never split.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.session import scratch_path, shuffle_partitions

MISSING = 0          # bin of null and NaN
BINS = 256           # a bin is one byte
UNIT = float(1 << 20)
EDGE_ACCURACY = 10_000
GROUPS_PER_TASK = 32  # (node, feature) pairs, of at most 256 sums from every task
BLOCK_ROWS = 1 << 16
BLOCKS_PER_BATCH = 4  # blocks that a task holds at once
EXACT = 1 << 33       # whole units of 2^-20 that doubles add without rounding
BLOCKS = "label binary, weight binary, margin binary, bins binary"


@dataclass(frozen=True)
class BoostingParams:
    """The defaults are the reference's settings and its library's published defaults."""

    rounds: int = 100
    depth: int = 6
    learning_rate: float = 0.1
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0  # must be positive: a side without rows is no split
    min_gain: float = 1e-6
    max_bins: int = 255
    keep_every: int = 10


class Tree:
    """One tree as arrays in heap order: the children of node i are 2i+1 and 2i+2; feature -1 marks a leaf."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature = np.full(size, -1, np.int32)
        self.cut = np.zeros(size, np.int32)          # rows with a larger bin go right
        self.missing_left = np.zeros(size, bool)
        self.value = np.zeros(size)
        self.gain = np.zeros(size)
        self.depth = depth

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node each row of bins (features by rows) ends in.

        A split compares its feature's bytes of all rows at once. Where missing values go right,
        bytes are compared less one: the bin of missing values wraps to the largest."""
        node = np.zeros(bins.shape[1], np.uint8 if self.depth < 8 else np.int32)
        one = node.dtype.type(1)
        for i in np.flatnonzero(self.feature >= 0):  # ascending: a parent comes before its children
            b, cut = bins[self.feature[i]], int(self.cut[i])
            right = b > np.uint8(cut) if self.missing_left[i] else (b - np.uint8(1)) > np.uint8(cut - 1)
            here = node == i
            node += here * node.dtype.type(i + 1)
            node += (here & right) * one
        return node

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(bins)]


def bin_codes(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """One byte per value, features by rows: 0 if missing, else 1 + the number of the feature's edges below it."""
    codes = np.empty((len(columns), len(columns[0])), np.uint8)
    for f, x in enumerate(columns):
        codes[f] = np.where(np.isnan(x), MISSING, 1 + np.searchsorted(edges[f], x, "left"))
    return codes


def bin_edges(df: DataFrame, features: Sequence[str], max_bins: int = BoostingParams.max_bins) -> list[np.ndarray]:
    """Ascending distinct cut values per feature, at most ``max_bins`` - 1 (one row of sketches to the driver)."""
    if not 2 <= max_bins <= BINS - 1:
        raise ValueError(f"max_bins must be from 2 to {BINS - 1}, not {max_bins}")
    probs = [i / max_bins for i in range(1, max_bins)]

    def known(c):
        x = F.col(c).cast("double")
        return F.when(~F.isnan(x), x)

    row = df.agg(*[F.percentile_approx(known(c), probs, EDGE_ACCURACY).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(e if e is not None else [], float)) for e in row]


def _binned(df: DataFrame, features: Sequence[str], label: str, weight: str, edges: list[np.ndarray]) -> DataFrame:
    """Rows of the fit in the schema ``BLOCKS``, margin 0."""
    def block(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts)]
        return _packed(columns[0], columns[1], np.zeros(len(columns[0])), bin_codes(columns[2:], edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                if held + part.num_rows > BLOCK_ROWS:
                    yield block(parts)
                    parts, held = [], 0
                parts.append([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in part.columns])
                held += part.num_rows
        if held:
            yield block(parts)

    fit = df.where(F.col(label).isNotNull() & F.col(weight).isNotNull())
    doubles = fit.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([label, weight, *features])])
    return doubles.mapInArrow(run, BLOCKS)


def _packed(label: np.ndarray, weight: np.ndarray, margin: np.ndarray, bins: np.ndarray) -> pa.RecordBatch:
    """One block in the schema ``BLOCKS``."""
    return pa.RecordBatch.from_arrays([pa.array([memoryview(np.ascontiguousarray(a)).cast("B")], pa.binary()) for a in (label, weight, margin, bins)],
                                      names=["label", "weight", "margin", "bins"])


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(label, weight, margin, bins by features and rows) of every block of ``BLOCKS``."""
    for batch in batches:
        for i in range(batch.num_rows):
            label, weight, margin, bins = (np.frombuffer(c[i].as_buffer(), kind) for c, kind in zip(batch.columns, (float, float, float, np.uint8)))
            yield label, weight, margin, bins.reshape(width, len(label))


def derivatives(label: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted logistic loss, in whole units of 2^-20."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint(weight * (p - label) * UNIT), np.rint(weight * p * (1.0 - p) * UNIT)


@dataclass
class _Bundle:
    """Features whose bins together number 256 at most, as one code per row: one count serves them all."""

    features: list[list[int]]  # a list holds features with the same byte in every row
    sizes: list[int]
    codes: np.ndarray

    def parts(self, sums: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(feature, sums by node and its bins) from the sums by node and code."""
        total = int(np.prod(self.sizes))
        cube = sums[:, :total].reshape(len(sums), *self.sizes[::-1])
        for i, same in enumerate(self.features):
            axis = len(self.sizes) - i
            alone = cube.sum(axis=tuple(a for a in range(1, cube.ndim) if a != axis))
            for f in same:
                yield f, alone


def _bundles(bins: np.ndarray) -> list[_Bundle]:
    """The features of some rows in as few bundles as first fit finds, widest first."""
    same: dict[bytes, list[int]] = {}
    for f in range(len(bins)):
        same.setdefault(bins[f].tobytes(), []).append(f)
    sized = sorted(((int(bins[fs[0]].max(initial=0)) + 1, fs) for fs in same.values()), key=lambda x: -x[0])
    found: list[_Bundle] = []
    for size, fs in sized:
        room = next((b for b in found if int(np.prod(b.sizes)) * size <= BINS), None)
        if room is None:
            found.append(_Bundle([fs], [size], bins[fs[0]]))
        else:
            room.codes = room.codes + bins[fs[0]] * np.uint8(np.prod(room.sizes))
            room.features.append(fs)
            room.sizes.append(size)
    return found


def _histogram(rows: DataFrame, width: int, trees: list[Tree], tree: Tree, open_nodes: list[int]) -> DataFrame:
    """Per task the sums of both derivatives by (node, feature, bin), over rows that lie in an open node of ``tree``;
    ``trees`` are those not yet in the margins."""
    slot_of = np.full(len(tree.feature), -1, np.int64)
    slot_of[open_nodes] = np.arange(len(open_nodes))
    nodes = np.array(open_nodes, np.int32)
    shape = (len(open_nodes), BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width, *shape), np.int64)
        for label, weight, margin, bins in _blocks(batches, width):
            for t in trees:
                margin = margin + t.margins(bins)
            pair = derivatives(label, weight, margin)
            slot = slot_of[tree.leaves(bins)]
            lies = np.flatnonzero(slot >= 0)
            if len(lies) < len(slot):
                slot, bins, pair = slot.take(lies), bins.take(lies, axis=1), [d.take(lies) for d in pair]
            cell = slot * BINS
            step = max(1, int(min(BLOCK_ROWS, EXACT // max(1.0, np.abs(weight).max(initial=1.0)))))
            for at in range(0, len(cell), step):
                some = slice(at, at + step)
                for group in _bundles(bins[:, some]):
                    where = cell[some] + group.codes
                    for k in (0, 1):
                        found = np.bincount(where, pair[k][some], shape[0] * BINS).astype(np.int64).reshape(shape)
                        for f, at_bins in group.parts(found):
                            sums[k, f, :, :at_bins.shape[1]] += at_bins
        feature, slot, b = np.nonzero((sums[0] != 0) | (sums[1] != 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[slot]), pa.array(feature.astype(np.int32)), pa.array(b.astype(np.int32)),
             pa.array(sums[0][feature, slot, b]), pa.array(sums[1][feature, slot, b])],
            names=["node", "feature", "bin", "g", "h"])

    return rows.mapInArrow(run, "node int, feature int, bin int, g long, h long")


def best_splits(histogram: DataFrame, params: BoostingParams, groups: int) -> DataFrame:
    """The best split of each of ``groups`` (node, feature) pairs: gain (null if no split is allowed), cut, side of missing
    values, both derivatives' sums of the left side and of the node. Cuts are bins that occur in the node;
    ties go to the smaller cut, then to missing values on the right.

    Written as one SQL text, because it is analysed once for every level of every tree."""
    lam, least = float(params.reg_lambda), float(params.min_child_weight)

    def side(missing_left: bool) -> str:
        g, h = ("gl + gm", "hl + hm") if missing_left else ("gl", "hl")
        gain = (f"pow({g}, 2) / ({h} + {lam}D) + pow(gn - ({g}), 2) / (hn - ({h}) + {lam}D) - pow(gn, 2) / (hn + {lam}D)")
        return (f"named_struct('gain', if(bin <> {MISSING} AND {h} >= {least}D AND hn - ({h}) >= {least}D, {gain}, null), "
                f"'less', -bin, 'right', {str(not missing_left).lower()}, 'g', {g}, 'h', {h})")

    def sums(k: str) -> str:
        return (f"coalesce(sum(if(bin <> {MISSING}, {k}, null)) OVER upto, 0) / {UNIT}D AS {k}l, "
                f"coalesce(sum(if(bin = {MISSING}, {k}, null)) OVER whole, 0) / {UNIT}D AS {k}m, "
                f"sum({k}) OVER whole / {UNIT}D AS {k}n")

    tasks = max(1, min(shuffle_partitions(histogram.sparkSession), groups // GROUPS_PER_TASK))
    # dealt by (node, feature) once: the sums, the running sums and the best need no other exchange;
    # structs compare field by field, nulls first
    return histogram.sparkSession.sql(f"""
        SELECT node, feature, b.gain, -b.less AS cut, NOT b.right AS missing_left, b.g AS left_g, b.h AS left_h, g, h FROM (
          SELECT node, feature, max(greatest({side(False)}, {side(True)})) AS b, max(gn) AS g, max(hn) AS h FROM (
            SELECT node, feature, bin, {sums("g")}, {sums("h")} FROM (
              SELECT node, feature, bin, sum(g) AS g, sum(h) AS h FROM {{cells}} GROUP BY node, feature, bin)
            WINDOW whole AS (PARTITION BY node, feature),
              upto AS (PARTITION BY node, feature ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
          GROUP BY node, feature)""", cells=histogram.repartition(tasks, "node", "feature"))


def _grow(rows: DataFrame, width: int, params: BoostingParams) -> Tree | None:
    """The next tree, a job per level; None if there are no rows."""
    tree, open_nodes = Tree(params.depth), [0]

    def leaf(g: float, h: float) -> float:
        return -params.learning_rate * g / (h + params.reg_lambda)

    for level in range(params.depth):
        # at most one row per open node and feature
        found = best_splits(_histogram(rows, width, [], tree, open_nodes), params, len(open_nodes) * width).collect()
        if not found and level == 0:
            return None
        if level == 0:
            tree.value[0] = leaf(found[0]["g"], found[0]["h"])
        best = {}
        for s in sorted(found, key=lambda s: s["feature"]):  # ties go to the first feature
            if s["gain"] is not None and s["gain"] > max(params.min_gain, best[s["node"]]["gain"] if s["node"] in best else 0.0):
                best[s["node"]] = s
        open_nodes = []
        for node, s in sorted(best.items()):
            tree.feature[node], tree.cut[node], tree.gain[node] = s["feature"], s["cut"], s["gain"]
            tree.missing_left[node] = s["missing_left"]
            left, right = 2 * node + 1, 2 * node + 2
            for child, g, h in ((left, s["left_g"], s["left_h"]), (right, s["g"] - s["left_g"], s["h"] - s["left_h"])):
                tree.value[child] = leaf(g, h)
                if h >= 2 * params.min_child_weight:  # else no two sides could both weigh enough
                    open_nodes.append(child)
        if not open_nodes:
            break
    return tree


def _advanced(rows: DataFrame, width: int, tree: Tree) -> DataFrame:
    """The rows with the tree's values added to their margins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, weight, margin, bins in _blocks(batches, width):
            yield _packed(label, weight, margin + tree.margins(bins), bins)

    return rows.mapInArrow(run, BLOCKS)


class _Kept:
    """The newest state of the rows, cached while it is in use; the states before are removed.

    The levels' jobs run in a session of their own: each exchanges a few rows per node and feature,
    which adaptive execution has nothing to gain from."""

    def __init__(self, spark: SparkSession):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.adaptive.enabled", "false")
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCKS_PER_BATCH))
        self.base, self.path = scratch_path(spark, f"boosting-{uuid.uuid4().hex[:12]}"), None
        self.version, self.cached = 0, []

    def write(self, rows: DataFrame) -> DataFrame:
        path, self.version = f"{self.base}/{self.version}", self.version + 1
        rows.write.parquet(path)
        self.release()
        self.path = path
        return self.cache(self.spark.read.schema(BLOCKS).parquet(path))

    def cache(self, rows: DataFrame) -> DataFrame:
        self.cached.append(rows.persist())
        return rows

    def forget(self) -> None:
        """Drop all cached states but the newest, which a job has read by now."""
        while len(self.cached) > 1:
            self.cached.pop(0).unpersist()

    def release(self) -> None:
        for rows in self.cached:
            rows.unpersist()
        self.cached = []
        if self.path is not None:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.path = None


def grow_trees(df: DataFrame, features: Sequence[str], label: str, weight: str,
               params: BoostingParams = BoostingParams()) -> tuple[list[Tree], list[np.ndarray]]:
    """(trees, bin edges per feature) of a boosted model of ``label``."""
    if params.min_child_weight <= 0:
        raise ValueError("min_child_weight must be positive")
    features = list(features)
    edges = bin_edges(df, features, params.max_bins)
    kept = _Kept(df.sparkSession)
    try:
        rows = kept.write(_binned(df, features, label, weight, edges))
        done: list[Tree] = []
        for _ in range(params.rounds):
            tree = _grow(rows, len(features), params)
            if tree is None:
                break
            kept.forget()
            done.append(tree)
            if len(done) < params.rounds:
                rows = _advanced(rows, len(features), tree)
                rows = kept.write(rows) if len(done) % params.keep_every == 0 else kept.cache(rows)
        return done, edges
    finally:
        kept.release()


class BoostedTreesModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A pipeline stage that adds ``probability`` (of 0 and of 1) from the feature columns by name."""

    inputCols = Param(Params._dummy(), "inputCols", "feature columns", TypeConverters.toListString)
    trees = Param(Params._dummy(), "trees", "trees and cut values as JSON", TypeConverters.toString)

    @classmethod
    def of(cls, features: Sequence[str], trees: list[Tree], edges: list[np.ndarray]) -> BoostedTreesModel:
        stored = {"edges": [e.tolist() for e in edges],
                  "trees": [{"depth": t.depth, "feature": t.feature.tolist(), "cut": t.cut.tolist(), "value": t.value.tolist(),
                             "missing_left": t.missing_left.astype(int).tolist(), "gain": t.gain.tolist()} for t in trees]}
        return cls()._set(inputCols=list(features), trees=json.dumps(stored))

    def stored(self) -> tuple[list[Tree], list[np.ndarray]]:
        """(trees, bin edges per feature)."""
        doc, trees = json.loads(self.getOrDefault(self.trees)), []
        for d in doc["trees"]:
            t = Tree(d["depth"])
            t.feature, t.cut = np.array(d["feature"], np.int32), np.array(d["cut"], np.int32)
            t.missing_left, t.value, t.gain = np.array(d["missing_left"], bool), np.array(d["value"]), np.array(d["gain"])
            trees.append(t)
        return trees, [np.array(e, float) for e in doc["edges"]]

    @property
    def featureImportances(self) -> DenseVector:
        """Mean gain of a feature's splits, scaled to sum 1 (zeros without a split)."""
        trees, edges = self.stored()
        total, count = np.zeros(len(edges)), np.zeros(len(edges))
        for t in trees:
            split = t.feature >= 0
            np.add.at(total, t.feature[split], t.gain[split])
            np.add.at(count, t.feature[split], 1)
        mean = total / np.maximum(count, 1)
        return DenseVector(mean / mean.sum() if mean.sum() > 0 else mean)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, edges = self.stored()

        @F.pandas_udf("double")
        def positive(*columns: pd.Series) -> pd.Series:
            bins = bin_codes([c.to_numpy(float) for c in columns], edges)
            return pd.Series(1.0 / (1.0 + np.exp(-sum((t.margins(bins) for t in trees), np.zeros(bins.shape[1])))))

        p = positive(*[F.col(f"`{c}`").cast("double") for c in self.getOrDefault(self.inputCols)])
        return dataset.withColumn("_positive", p).withColumn(
            "probability", array_to_vector(F.array(1 - F.col("_positive"), F.col("_positive")))).drop("_positive")


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, weight: str,
                params: BoostingParams = BoostingParams()) -> BoostedTreesModel:
    return BoostedTreesModel.of(features, *grow_trees(df, features, label, weight, params))
