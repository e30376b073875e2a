"""Document fingerprints: mergeable bottom-k sketches of shingle hashes.

A fingerprint holds the ``SKETCH`` smallest 48-bit hashes of a text's distinct
five-word shingles (A-Z lower-cased), as base64 of six big-endian bytes each.
Sketches of parts merge into the sketch of their union, and two sketches
estimate resemblance, containment and the number of distinct shingles; a text
with fewer shingles than ``SKETCH`` is held whole and all estimates are exact
up to hash collisions.

A null text counts as empty; its fingerprint is the empty string. Two empty
fingerprints are alike (1.0), an empty and another one are not (0.0). Rows
with one doc_id are ordered by text, a null doc_id sorts first; an empty table
gives an empty result. Texts of any length are hashed whole, block by block.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.shingles import shingle_sets, text_groups

SHINGLE_WORDS = 5
SKETCH = 256
HASH_BITS = 48


# --- sketches as arrays ---------------------------------------------------

def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """Bottom-k sketch of sorted distinct 64-bit hashes."""
    kept = hashes[:SKETCH] >> np.uint64(64 - HASH_BITS)
    return kept if len(kept) < 2 else kept[np.concatenate([[True], kept[1:] != kept[:-1]])]


def pack(sketch: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(sketch.astype(">u8")[:, None].view(np.uint8)[:, 2:])).decode()


def unpack(text: str | None) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text or ""), np.uint8).reshape(-1, HASH_BITS // 8)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.view(">u8")[:, 0].astype(np.uint64)


def merge_sketches(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts))[:SKETCH] if parts else np.zeros(0, np.uint64)


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(sketch size of the union, how many of it both hold)."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 0, 0
    again = both[1:] == both[:-1]
    rank = np.cumsum(np.concatenate([[True], ~again]))
    size = min(int(rank[-1]), SKETCH)
    return size, int(np.count_nonzero(again & (rank[1:] <= size)))


def resemblance_of(a: np.ndarray, b: np.ndarray) -> float:
    size, shared = overlap(a, b)
    return shared / size if size else 1.0


def distinct_of(a: np.ndarray) -> float:
    """Number of distinct shingles: exact for a sketch that isn't full."""
    return float(len(a)) if len(a) < SKETCH else (SKETCH - 1) * 2.0 ** HASH_BITS / float(a[-1])


def containment_of(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's shingles that b holds."""
    if not len(a):
        return 1.0
    joint = resemblance_of(a, b) * distinct_of(merge_sketches([a, b]))
    return min(1.0, joint / distinct_of(a))


# --- on columns -----------------------------------------------------------

def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column."""
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([pack(sketch_of(s)) for s in shingle_sets(pa.array(texts, pa.large_string()), SHINGLE_WORDS)])
    return run(text)


def _pair(measure, a: Column, b: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([measure(unpack(p), unpack(q)) for p, q in zip(x, y)], dtype=float)
    return run(a, b)


def resemblance(a: Column, b: Column) -> Column:
    return _pair(resemblance_of, a, b)


def containment(a: Column, b: Column) -> Column:
    return _pair(containment_of, a, b)


def distinct_shingles(a: Column) -> Column:
    return _pair(lambda p, _: distinct_of(p), a, a)


def merge_fingerprints(df: DataFrame, by: str, column: str = "fingerprint") -> DataFrame:
    """(by, column): the merged fingerprint of every group.

    Each task merges what it has of a group before the shuffle, so a hot group
    arrives as one sketch per task.
    """
    schema = T.StructType([df.schema[by], T.StructField(column, T.StringType())])
    rows = df.select(by, column)

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            merged = frame.groupby(by, dropna=False, sort=False)[column].agg(lambda s: pack(merge_sketches([unpack(x) for x in s])))
            yield merged.reset_index()

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: frame[by].iloc[:1], column: [pack(merge_sketches([unpack(x) for x in frame[column]]))]})

    return rows.mapInPandas(parts, schema).groupBy(by).applyInPandas(whole, schema)


# --- every text beside the next one ---------------------------------------

_LEAST = -(1 << 63)


def with_next(docs: DataFrame, apply, schema: T.StructType, cells_per_task: int = 8) -> DataFrame:
    """Apply ``apply(doc_ids, texts, next_texts) -> RecordBatch`` to all rows in order of doc_id.

    The next text of the last row is the first row's. Rows are dealt out by
    quantiles of doc_id to cells, the texts move once, and the first row of
    each cell goes to the cell before as well, as that one's next.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce("doc_id", F.lit(_LEAST)).alias("_k"))
    cells = tasks * cells_per_task
    cuts = rows.approxQuantile("doc_id", [i / cells for i in range(1, cells)], 0.2 / cells) if cells > 1 else []
    cuts = np.unique(np.array(cuts, float)).astype(np.int64)

    @F.pandas_udf(T.IntegerType())
    def cell(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), "right").astype(np.int32))

    # one row per cell: the cells' least ids, and of which cell each is the continuation
    least = {r["c"]: r["k"] for r in rows.select("_k").withColumn("c", cell("_k")).groupBy("c").agg(F.min("_k").alias("k")).collect()}
    order = sorted(least)
    heads = np.array([least[c] for c in order], np.int64)
    before = np.array([order[i - 1] for i in range(len(order))], np.int32)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def goes_to(k: pd.Series) -> pd.Series:
        k = k.to_numpy()
        own = np.searchsorted(cuts, k, "right")
        at = np.minimum(np.searchsorted(heads, k), max(len(heads) - 1, 0))
        head = heads[at] == k if len(heads) else np.zeros(len(k), bool)
        return pd.Series([[int(c), -1 - int(before[i])] if h else [int(c)] for c, i, h in zip(own, at, head)])

    dealt = rows.withColumn("_to", F.explode(goes_to("_k"))).withColumns({
        "_tail": F.col("_to") < 0, "_cell": F.when(F.col("_to") < 0, -1 - F.col("_to")).otherwise(F.col("_to"))})
    placed = dealt.select("_cell", "_tail", "_k", "doc_id", "text").repartition(tasks, "_cell").sortWithinPartitions(
        "_cell", "_tail", "_k", "text").select("_cell", "_tail", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next: cell, doc_id, text
        for batch in batches:
            where, tail = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = batch.column(3).buffers()[1]
            offsets = np.frombuffer(sizes, np.int32, batch.column(3).offset + len(batch) + 1)[batch.column(3).offset:].astype(np.int64)
            for lo, hi in text_groups(offsets - offsets[0]):
                ids, texts = batch.column(2).slice(lo, hi - lo).to_pylist(), batch.column(3).slice(lo, hi - lo).to_pylist()
                got = []
                for c, t, i, x in zip(where[lo:hi], tail[lo:hi], ids, texts):
                    if held is not None and held[0] == c:
                        got.append((held[1], held[2], x))
                        held = None
                    if not t:
                        held = (c, i, x)
                if got:
                    yield apply(*map(list, zip(*got)))

    return placed.mapInArrow(run, schema)


_FIELDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
                        T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
                        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
                        T.StructField("near_next", T.DoubleType()), T.StructField("n_shingles", T.DoubleType())])


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of the code points, replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Each text's fingerprint beside those of its edited text and of the next text."""
    edited = [edited_text(t, f) for t, f in zip(texts, following)]

    def sketches(values):
        return [sketch_of(s) for s in shingle_sets(pa.array(values, pa.large_string()), SHINGLE_WORDS)]

    own, changed = sketches(texts), sketches(edited)
    # a row's next is the row after it, unless that one is in another batch or cell
    after = [own[i + 1] if i + 1 < len(own) and following[i] is texts[i + 1] else sketches([following[i]])[0]
             for i in range(len(own))]
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        pa.array([pack(s) for s in own]), pa.array([pack(s) for s in changed]),
        pa.array([resemblance_of(a, b) for a, b in zip(own, changed)]),
        pa.array([resemblance_of(a, b) for a, b in zip(own, after)]),
        pa.array([distinct_of(s) for s in own])], names=_FIELDS.names)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (half replaced by the next document's start)."""
    return with_next(docs, _compare, _FIELDS)


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles (estimate)."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
