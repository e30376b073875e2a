"""Hard negatives by best-first descent of cover trees over norm-augmented vectors.

Index. A vector x becomes (x, sqrt(M^2 - |x|^2)): all lie on one sphere of
radius M, an anchor gets a last component of zero, and inner products become
angles. Rows are dealt in order of length, label and nearest pivot to trees of
bounded size; ``Forest.table`` holds one row per tree in the shared folder.
In a tree the nodes of a level cover their descendants within that level's
radius, half of the level above; a node keeps the exact radius that its
descendants need, and the least and largest label among them.

Search. The angle of an anchor with a node's centre and the node's covering
angle bound every inner product below it from both sides. The descent expands
the nodes of largest upper bound first and skips those that lie outside all of
an anchor's windows, that can't beat the rows found so far, or that hold no
label that counts. Centres are rows, so expanding a node verifies its children
exactly: products of integers, in the narrowest number type that holds them
without rounding. A task keeps ``k`` rows per window; a window over the tasks'
rows merges them.

Anchors go in blocks of at most ``BLOCK_BYTES``; every block meets every tree,
which is the stated query set against all rows.

Rows without id, label or vector, or with a null or non-finite component, take
no part, nor do those whose integer vector's squared length reaches 2^62 (a
product might not fit a long). Of rows that share an id the least (label,
vector) stands. Rows meet only rows of their own length; ties go to the
smaller id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.scratch import materialize

TREE_BYTES = 1 << 20  # vectors of one tree
TREE_ROWS = 2048
BLOCK_BYTES = 1 << 21  # anchors of one block
PIVOTS = 64  # rows of smallest id hash that order the others; they change no result
WIDTH = 64  # nodes of an anchor expanded at once
ANCHORS = 512  # anchors that descend a tree together
PAIRS = 1 << 16  # products computed at once
LEVELS = 48

_NONE = 1 - (1 << 63)  # no score, below all others
_ANY = (-(1 << 62), 1 << 62)
_TREE = "dim int, " + ", ".join(f"{c} binary" for c in (
    "ids", "labels", "vectors", "center", "radius", "begin", "fresh", "least", "most"))


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, vector of ints ``floor(scale * x)``) of the rows that take part, one per id."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    square = F.aggregate(whole, F.lit(0.0), lambda a, v: a + v * v)
    taking = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine, F.lit(False))
    # a case, so that the length is only taken of vectors that are fine
    return rows.where(F.when(taking, square < float(1 << 62)).otherwise(F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.transform(whole, lambda v: v.cast("int")).alias("vector")).groupBy("id").agg(
        F.min(F.struct("label", "vector")).alias("_r")).select("id", "_r.label", "_r.vector")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int32).reshape(len(column), dim)


def exact_type(most: float) -> type:
    """Number type in which sums of products up to ``most`` are exact."""
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64


def lengths(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt((x * x).sum(axis=1))


class Tree:
    """A cover tree over rows (ids, labels, vectors), in flat arrays.

    Node ``i`` has the row ``center[i]``, the children ``begin[i]`` to
    ``begin[i + 1]`` (nodes are numbered level by level), the covering radius
    ``radius[i]`` of all rows below it on the sphere and their labels' range.
    A node whose centre is its parent's is not ``fresh``; every row is the
    centre of exactly one fresh node.
    """

    def __init__(self, ids, labels, vectors, center, radius, begin, fresh, least, most):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.center, self.radius, self.begin, self.fresh, self.least, self.most = center, radius, begin, fresh, least, most
        self.sphere = float(lengths(vectors).max()) if len(ids) else 0.0
        angle = 2 * np.arcsin(np.minimum(1.0, radius / max(2 * self.sphere, 1e-300)))
        self.cos, self.sin, self.wide = np.cos(angle), np.sin(angle), angle >= np.pi / 2

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
        x = vectors.astype(np.float64)
        squares = (x * x).sum(axis=1)
        top = squares.max()
        x = np.concatenate([x, np.sqrt(top - squares)[:, None]], axis=1)
        far = np.sqrt(np.maximum(2 * top - 2 * (x @ x.T), 0))
        cover = float(far[0].max())
        center, below, fresh, begin = [0], [np.arange(1, len(x))], [True], []
        for _ in range(LEVELS):
            cover /= 2
            for i in range(len(begin), len(center)):
                begin.append(len(center))
                rest = below[i]
                pick, again = center[i], True
                if cover <= 1e-9 * top ** 0.5:  # rows at one place: each its own child
                    center.extend(rest), below.extend([rest[:0]] * len(rest)), fresh.extend([True] * len(rest))
                    continue
                while len(rest):
                    inside = far[pick, rest] <= cover
                    if not again or inside.any():
                        center.append(pick), below.append(rest[inside]), fresh.append(not again)
                        rest = rest[~inside]
                    again = False
                    if len(rest):
                        pick, rest = rest[0], rest[1:]
                        if not len(rest):
                            center.append(pick), below.append(rest), fresh.append(True)
            if cover <= 1e-9 * top ** 0.5:
                break
        begin += [len(center)] * (len(center) + 1 - len(begin))
        slack = 1e-6 * top ** 0.5  # above the rounding of the distances
        spans = [np.append(b, c) for c, b in zip(center, below)]
        return cls(ids, labels, vectors, np.array(center, np.int32),
                   np.array([far[c, b].max() + slack if len(b) else 0.0 for c, b in zip(center, below)]),
                   np.array(begin, np.int32), np.array(fresh, bool),
                   np.array([labels[s].min() for s in spans], np.int64), np.array([labels[s].max() for s in spans], np.int64))

    def pack(self) -> dict:
        return {"dim": self.vectors.shape[1], **{c: getattr(self, c).tobytes() for c in _KINDS}}

    @classmethod
    def unpack(cls, row: dict) -> Tree:
        parts = {c: np.frombuffer(row[c], kind) for c, kind in _KINDS.items()}
        parts["vectors"] = parts["vectors"].reshape(len(parts["ids"]), row["dim"])
        return cls(**parts)


_KINDS = {"ids": np.int64, "labels": np.int64, "vectors": np.int32, "center": np.int32, "radius": np.float64,
          "begin": np.int32, "fresh": bool, "least": np.int64, "most": np.int64}


class Search:
    """Windows of anchors of one length, and the best ``k`` rows found in each.

    ``low`` and ``high`` (anchors x windows) bound the scores that count; rows
    count whose label is the anchor's (``same``) or is not.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.ids, self.labels, self.vectors, self.low, self.high, self.k, self.same = ids, labels, vectors, low, high, k, same
        self.length = lengths(vectors)
        self.score = np.full((low.size, k), _NONE, np.int64)
        self.found = np.full((low.size, k), np.iinfo(np.int64).max, np.int64)

    def _floor(self) -> np.ndarray:
        """The least score that can still enter each window."""
        return np.maximum(self.low, self.score[:, -1].reshape(self.low.shape))

    def _offer(self, a: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        """Rows (anchor, score, id) with a label that counts: the best of them enter the windows."""
        fits = (score[:, None] >= self._floor()[a]) & (score[:, None] <= self.high[a])
        pair, window = np.nonzero(fits)
        slot = a[pair] * self.low.shape[1] + window
        score, row_id = score[pair], row_id[pair]
        last = self.score[slot, -1]
        better = (score > last) | (row_id < self.found[slot, -1])
        slot, score, row_id = slot[better], score[better], row_id[better]
        if not len(slot):
            return
        touched = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        row_id = np.concatenate([row_id, self.found[touched].ravel()])
        order = np.lexsort((row_id, -score, slot))
        slot, score, row_id = slot[order], score[order], row_id[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = place < self.k
        self.score[slot[keep], place[keep]] = score[keep]
        self.found[slot[keep], place[keep]] = row_id[keep]

    def _useful(self, tree: Tree, a: np.ndarray, node: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Nodes that may hold a row for one of the anchor's windows."""
        label = self.labels[a]
        least, most = tree.least[node], tree.most[node]
        ok = (least <= label) & (label <= most) if self.same else (least != label) | (most != label)
        return ok & ((upper[:, None] >= self._floor()[a]) & (lower[:, None] <= self.high[a])).any(axis=1)

    def _visit(self, tree: Tree, rows: np.ndarray, anchors: np.ndarray, a: np.ndarray, node: np.ndarray):
        """Verify the nodes' centres; the nodes among them to be expanded, with their bounds."""
        center = tree.center[node]
        score = np.einsum("ij,ij->i", anchors[a], rows[center])
        exact = score.astype(np.int64)
        label = tree.labels[center] == self.labels[a]
        new = tree.fresh[node] & (tree.ids[center] != self.ids[a]) & (label if self.same else ~label)
        self._offer(a[new], exact[new], tree.ids[center[new]])
        inner = tree.begin[node] < tree.begin[node + 1]
        a, node, s = a[inner], node[inner], score[inner].astype(np.float64)
        reach = self.length[a] * tree.sphere
        across = np.sqrt(np.maximum(reach * reach - s * s, 0)) * tree.sin[node]
        along = s * tree.cos[node]
        slack = 1e-7 * reach
        cos = tree.cos[node] * reach
        upper = np.where(s >= cos, reach, along + across) + slack  # the anchor's direction lies inside the cap
        lower = np.where(s <= -cos, -reach, along - across) - slack
        ok = self._useful(tree, a, node, upper, lower)
        return a[ok], node[ok], upper[ok], lower[ok]

    def descend(self, tree: Tree) -> None:
        """Meet the rows of a tree."""
        kind = exact_type(self.length.max(initial=0.0) * tree.sphere)
        rows, anchors = tree.vectors.astype(kind), self.vectors.astype(kind)
        for lo in range(0, len(self.ids), ANCHORS):
            self._descend(tree, rows, anchors, np.arange(lo, min(lo + ANCHORS, len(self.ids))))

    def _descend(self, tree: Tree, rows: np.ndarray, anchors: np.ndarray, some: np.ndarray) -> None:
        """Best first, for some anchors at once: each round expands the ``WIDTH`` most promising nodes of every anchor."""
        a, node, upper, lower = self._visit(tree, rows, anchors, some, np.zeros(len(some), np.int64))
        while len(a):
            order = np.lexsort((-upper, a))
            a, node, upper, lower = a[order], node[order], upper[order], lower[order]
            now = np.arange(len(a)) - np.searchsorted(a, a) < WIDTH
            count = (tree.begin[node + 1] - tree.begin[node])[now].astype(np.int64)
            whose = np.repeat(a[now], count)
            child = np.arange(len(whose)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(tree.begin[node[now]], count)
            parts = [(a[~now], node[~now], upper[~now], lower[~now])]
            for lo in range(0, len(whose), PAIRS):
                parts.append(self._visit(tree, rows, anchors, whose[lo:lo + PAIRS], child[lo:lo + PAIRS]))
            a, node, upper, lower = (np.concatenate(c) for c in zip(*parts))
            ok = self._useful(tree, a, node, upper, lower)
            a, node, upper, lower = a[ok], node[ok], upper[ok], lower[ok]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, window, id, score) of all rows held."""
        slot, place = np.nonzero(self.score != _NONE)
        return slot // self.low.shape[1], slot % self.low.shape[1], self.found[slot, place], self.score[slot, place]


def _cells(rows: DataFrame) -> DataFrame:
    """Adds ``dim`` and ``cell``, the nearest of ``PIVOTS`` rows of its length: rows near each other share trees."""
    pivots: dict[int, list] = {}
    for v in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).toPandas()["vector"]:
        pivots.setdefault(len(v), []).append(v)
    known = {dim: np.array(vs, np.float64).reshape(len(vs), dim) for dim, vs in pivots.items()}

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column(2)
            dims = np.asarray(vector.value_lengths(), np.int32)
            cell = np.zeros(len(batch), np.int32)
            for dim in np.unique(dims).tolist():
                if dim in known:
                    at = np.flatnonzero(dims == dim)
                    x = _matrix(vector.take(pa.array(at)), dim).astype(np.float64)
                    p = known[dim]
                    cell[at] = np.argmin((p * p).sum(axis=1)[None, :] - 2 * (x @ p.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cell)],
                                             ["id", "label", "vector", "dim", "cell"])

    return rows.mapInArrow(nearest, "id long, label long, vector array<int>, dim int, cell int")


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of consecutive sorted rows of one length; a new label starts a tree unless the last is small."""
    names = [f.split()[0] for f in _TREE.split(", ")]

    def emit(dim: int, ids: list, labels: list, vectors: list) -> pa.RecordBatch:
        row = Tree.build(np.array(ids, np.int64), np.array(labels, np.int64), np.concatenate(vectors).reshape(len(ids), dim)).pack()
        return pa.RecordBatch.from_arrays([pa.array([row[c]], pa.int32() if c == "dim" else pa.binary()) for c in names], names)

    held = ([], [], [])
    dim = -1
    for batch in batches:
        ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        flat, ends = np.asarray(batch.column(2).flatten(), np.int32), np.cumsum(np.asarray(batch.column(2).value_lengths()))
        for i, (row_id, label, end) in enumerate(zip(ids, labels, ends)):
            size = int(end - (ends[i - 1] if i else 0))
            most = max(16, min(TREE_ROWS, TREE_BYTES // (4 * size + 1)))
            full = len(held[0]) >= most or (len(held[0]) >= most // 4 and held[1][-1] != label)
            if held[0] and (size != dim or full):
                yield emit(dim, *held)
                held = ([], [], [])
            dim = size
            held[0].append(row_id), held[1].append(label), held[2].append(flat[end - size:end])
    if held[0]:
        yield emit(dim, *held)


class Forest:
    """Cover trees over ``rows`` (id, label, vector of ints): ``rows`` and ``table`` are kept in the shared folder."""

    def __init__(self, rows: DataFrame):
        self.rows = materialize(rows, "vectors")
        dealt = _cells(self.rows).repartitionByRange("dim", "label", "cell", F.xxhash64("id"))
        self.table = materialize(dealt.sortWithinPartitions("dim", "label", "cell", "id").mapInArrow(_plant, _TREE), "trees")

    def _scan(self, anchors: list[tuple], k: int, same: bool) -> DataFrame:
        """Every task's best ``k`` rows per window of ``anchors`` (id, label, vector, [(low, high), ...])."""
        groups: dict[int, list] = {}
        for one in anchors:
            groups.setdefault(len(one[2]), []).append(one)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searches = {}
            for dim, own in groups.items():
                wide = max(len(w) for *_, w in own)
                bounds = np.array([[*w, *[(1, 0)] * (wide - len(w))] for *_, w in own], np.int64).reshape(len(own), wide, 2)
                searches[dim] = Search(
                    np.array([o[0] for o in own], np.int64), np.array([o[1] for o in own], np.int64),
                    np.array([o[2] for o in own], np.int32).reshape(len(own), dim), bounds[:, :, 0], bounds[:, :, 1], k, same)
            for batch in batches:
                for row in batch.to_pylist():
                    if row["dim"] in searches:
                        searches[row["dim"]].descend(Tree.unpack(row))
            for search in searches.values():
                a, window, row_id, score = search.best()
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(search.ids[a]), pa.array(window.astype(np.int32)), pa.array(row_id), pa.array(score)],
                                                     ["anchor_id", "window", "id", "score"])

        return self.table.mapInArrow(run, "anchor_id long, window int, id long, score long")

    def _best(self, anchors: list[tuple], k: int, same: bool) -> DataFrame:
        order = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "id")
        return self._scan(anchors, k, same).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def mine(self, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
        """Per anchor (rows of ``rows``) and positive, its best different-label rows scoring ``least`` to ``most`` percent of it.

        Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
        """
        spark = self.rows.sparkSession
        size = anchors.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
        blocks = -(-size // BLOCK_BYTES)
        out = None
        for b in range(blocks):
            part = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "label", "vector")
            own = {r["id"]: (r["id"], r["label"], r["vector"]) for r in part.collect()}  # at most about BLOCK_BYTES
            near = self._best([(*o, [_ANY]) for o in own.values()], positives, True)
            windows: dict[int, list] = {i: [] for i in own}
            named = []
            for r in near.collect():  # at most ``positives`` per anchor
                if r["score"] >= 0:  # no score lies between parts of a negative one
                    named.append((r["anchor_id"], len(windows[r["anchor_id"]]), r["id"], r["score"]))
                    windows[r["anchor_id"]].append((-(-least * r["score"] // 100), most * r["score"] // 100))
            asked = [(*own[i], w) for i, w in windows.items() if w]
            if not asked:
                continue
            names = spark.createDataFrame(named, "anchor_id long, window int, positive_id long, positive_score long")
            part = self._best(asked, negatives, False).join(F.broadcast(names), ["anchor_id", "window"]).select(
                "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"))
            if blocks > 1:  # each block is finished before the next begins
                part = materialize(part, "negatives")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every row whose vec_id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    shifted = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    forest = Forest(quantised(shifted))
    return forest.mine(forest.rows.where(F.col("id") % 50 == 0))


OP12_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
anchors AS (SELECT * FROM usable WHERE vec_id % 50 = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM anchors a JOIN usable c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same QUALIFY r <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
