"""Nearest neighbours by randomly rotated one-bit codes.

Index. A vector is taken relative to a centre, scaled to length one and turned
by a random rotation; its code is the signs of the turned components, packed,
with two scalars: its distance from the centre and the inner product of the
vector with its own code's direction. Every row is indexed and the index is a
table in the shared folder; only the centre is fitted, on the ``SAMPLE`` rows
with the smallest id hashes.

Search. A query is turned, too, and its components are cut to ``PLANES`` bits.
Its inner product with a code is then a weighted sum of popcounts of the code's
64-bit words against the query's bit planes; codes are never unpacked. Divided
by the second scalar it estimates the inner product with the vector, within an
error bound that holds with high probability (``EPSILON`` deviations, and the
most that the cut components can be off). Per query and batch of codes, the
exact distances of the best estimates give a limit, and every vector whose
lower bound is within it is reranked on its original components. A task keeps
``k`` rows per query; a window merges those of all tasks.

Queries run in blocks of about ``QUERY_BLOCK``, so what a task is sent is
bounded; every block scans the whole index.

Vectors that are null, zero, of another length than most rows have, or hold
null or non-finite components take no part, nor do rows with a null id. Of
rows that share an id the least vector in array order stands. Ties in distance
go to the smaller id. No queries or no other vectors: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.scratch import materialize

SAMPLE = 10_000
QUERY_BLOCK = 512
EPSILON = 2.5
PLANES = 6
FIRST_LOOK = 4  # estimates reranked at once, as a multiple of k


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _turned(vectors: np.ndarray, center: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors from the centre, rotated; distances from the centre)."""
    away = vectors - center
    length = np.sqrt((away * away).sum(axis=1))
    return (away / np.where(length > 0, length, 1.0)[:, None]) @ rotation, length


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of packed bytes as rows of 64-bit words, padded with zeros."""
    spare = -bits.shape[1] % 8
    padded = np.pad(bits, ((0, 0), (0, spare))) if spare else np.ascontiguousarray(bits)
    return padded.view(np.uint64)


class Planes:
    """Turned queries (rows x components) as bit planes, for inner products with sign codes."""

    def __init__(self, turned: np.ndarray):
        levels = (1 << PLANES) - 1
        self.dim = turned.shape[1]
        self.low = turned.min(axis=1)
        self.step = np.maximum(turned.max(axis=1) - self.low, 1e-30) / levels
        cut = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, levels).astype(np.uint8)
        self.planes = [_words(np.packbits((cut >> p) & 1, axis=1)) for p in range(PLANES)]
        self.total = self.low * self.dim + self.step * cut.sum(axis=1)
        self.error = self.step / 2 * np.sqrt(self.dim)  # the most that cutting can move an inner product with a code's direction

    def inner(self, j: int, words: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products of query ``j`` with the directions of codes (``ones``: their popcounts)."""
        weighted = np.zeros(len(words), np.int64)
        for p, plane in enumerate(self.planes):
            weighted += np.bitwise_count(words & plane[j]).sum(axis=1, dtype=np.int64) << p
        return (2 * (self.low[j] * ones + self.step[j] * weighted) - self.total[j]) / np.sqrt(self.dim)


class Index:
    """Codes of all usable rows: ``table`` (id, bits, length, agreement, vector), ``center``, ``rotation``."""

    def __init__(self, rows: DataFrame, vec_id: str, vector: str, seed: int = 0):
        one = rows.where(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
            F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).groupBy("id").agg(
            F.min("vector").alias("vector"))
        rows = materialize(one, "vectors")
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["vector"]
        usual = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
        self.dim = usual["dim"] if usual else 0  # the length of most of all rows
        fitted = [v for v in sample if len(v) == self.dim]
        self.center = np.mean(np.array(fitted), axis=0) if fitted else np.zeros(0)
        self.rotation = _rotation(self.dim, seed)
        dim, center, rotation = self.dim, self.center, self.rotation

        def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    turned, length = _turned(_matrix(batch.column(1), dim), center, rotation)
                    bits = np.packbits(turned > 0, axis=1)
                    agreement = np.abs(turned).sum(axis=1) / np.sqrt(dim)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length),
                        pa.array(agreement), batch.column(1)], ["id", "bits", "length", "agreement", "vector"])

        same = rows.where(F.size("vector") == self.dim)
        self.table = materialize(same.mapInArrow(
            codes, "id long, bits binary, length double, agreement double, vector array<double>"), "codes")

    def _block(self, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
        """Every task's best ``k`` rows for each query of a block."""
        dim, center, rotation = self.dim, self.center, self.rotation
        turned, away = _turned(queries, center, rotation)
        planes = Planes(turned)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            for batch in batches:
                for lo in range(0, len(batch), 4096):
                    part = batch.slice(lo, 4096)
                    rows = len(part)
                    if not rows:
                        continue
                    own = part.column(0).to_numpy()
                    packed = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(rows, -1)
                    words = _words(packed)
                    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
                    length, agreement = part.column(2).to_numpy(), part.column(3).to_numpy()
                    agreement = np.where(length > 0, agreement, 1.0)
                    vectors = _matrix(part.column(4), dim)
                    bound = EPSILON * np.sqrt(np.maximum(0.0, 1 - agreement ** 2)) / agreement / np.sqrt(max(dim - 1, 1))
                    squares = length ** 2
                    for j in range(len(ids)):
                        reach = 2 * length * away[j]
                        base = squares + away[j] ** 2
                        inner = planes.inner(j, words, ones) / agreement
                        low = base - reach * np.minimum(1.0, inner + bound + planes.error[j] / agreement)
                        limit = best[j][0][-1] if len(best[j][0]) >= k else np.inf
                        if limit == np.inf:  # exact distances of the best estimates give a first limit
                            guess = base - reach * inner
                            look = min(rows, FIRST_LOOK * k)
                            first = np.argpartition(guess, look - 1)[:look]
                            exact = np.sqrt(((vectors[first] - queries[j]) ** 2).sum(axis=1))[own[first] != ids[j]]
                            if len(exact) >= k:
                                limit = np.partition(exact, k - 1)[k - 1]
                        near = np.flatnonzero((low <= limit * limit * (1 + 1e-9)) & (own != ids[j]))
                        if len(near):
                            score = np.concatenate([best[j][0], np.sqrt(((vectors[near] - queries[j]) ** 2).sum(axis=1))])
                            name = np.concatenate([best[j][1], own[near]])
                            order = np.lexsort((name, score))[:k]
                            best[j] = score[order], name[order]
            counts = [len(b[0]) for b in best]
            if sum(counts):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(ids, counts)), pa.array(np.concatenate([b[1] for b in best])),
                    pa.array(np.concatenate([b[0] for b in best]))], ["query_id", "vec_id", "score"])

        return self.table.mapInArrow(scan, "query_id long, vec_id long, score double")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, vec_id, score) of the ``k`` nearest rows other than the query's own.

        ``queries`` has id and vector, as ``table`` has.
        """
        spark = self.table.sparkSession
        count = queries.count()
        blocks = -(-count // QUERY_BLOCK)
        found = spark.createDataFrame([], "query_id long, vec_id long, score double")
        for b in range(blocks):
            own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "vector").toPandas()
            if len(own):
                part = self._block(own["id"].to_numpy(np.int64), np.array(own["vector"].tolist(), np.float64), k)
                # with several blocks, each is finished before the next begins
                found = part if blocks == 1 else found.union(materialize(part, "neighbours"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score")


def op4_vectors(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every row whose vec_id is divisible by 100, by Euclidean distance."""
    index = Index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return index.search(index.table.where(F.col("id") % 100 == 0).select("id", "vector"), 10)


OP4_SQL = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
