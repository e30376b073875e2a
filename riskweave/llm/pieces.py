"""SentencePiece encoding by a distinct-chunk table.

In the marked text (one marker in front, markers for blanks) no piece of the
model crosses from another character into a marker, so merges never cross such
a place and every chunk (markers, then other characters) is segmented alone.
Each task cuts its texts into chunks, numbers the distinct ones with Arrow's
dictionary encoding, segments every distinct chunk once with the library, and
joins the ids back by position with one gather. The table lives as long as the
task and starts anew beyond ``TABLE_ENTRIES``, so memory is bounded while every
chunk is still segmented.

Results equal the library's on the whole text (without begin and end ids and
without sampling). A null text counts as empty and has no ids. Repeated rows
and extra columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.shingles import text_buffers, text_groups

TABLE_ENTRIES = 300_000
_GROUP_BYTES = 1 << 20
_MARK = "▁"


def default_model() -> str:
    """Path of the installed public 32k BPE model."""
    import public_tokenizers
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _processor(model: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=model)


def check_model(model: str) -> None:
    """Raise unless chunks of this model can be segmented alone."""
    sp = _processor(model)
    crossing = [p for p in map(sp.id_to_piece, range(sp.get_piece_size())) if _MARK in p.lstrip(_MARK)]
    if crossing or sp.encode(" a  b ", out_type=str) != sp.encode(f"{_MARK}a{_MARK}{_MARK}b{_MARK}", out_type=str):
        raise ValueError(f"pieces of {model} cross markers or blanks are changed: {crossing[:5]}")


class ChunkTable:
    """Distinct chunk -> ids, each segmented once."""

    def __init__(self, model: str):
        self.sp = _processor(model)
        self.blank = self.sp.piece_to_id(_MARK)
        self._clear()

    def _clear(self):
        self.index: dict[str, int] = {}
        self.ids, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def lookup(self, chunks: list[str]) -> np.ndarray:
        """Rows of the chunks in the table; new ones are segmented and added."""
        if len(self.index) > TABLE_ENTRIES:
            self._clear()
        new = [c for c in chunks if c not in self.index]
        if new:
            # the library puts one marker in front, so the chunk's own first one is left off
            got = self.sp.encode([c[1:] for c in new], num_threads=1)
            got = [x or [self.blank] for x in got]
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, got), np.int64, len(got))])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), np.int32)])
            self.starts = np.cumsum(self.lengths) - self.lengths
        return np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text's ids)."""
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes > 0)
        if not len(full):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        # one marker in front of each text that isn't empty
        marked = np.insert(data, offsets[full], 0x20)
        begin = offsets[full] + np.arange(len(full))
        blank = marked == 0x20
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[begin] = True
        cut = np.flatnonzero(first)
        chunks = pa.Array.from_buffers(pa.large_string(), len(cut), [
            None, pa.py_buffer(np.append(cut, len(marked)).astype(np.int64)), pa.py_buffer(marked)]).dictionary_encode()
        rows = self.lookup(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        lengths = self.lengths[rows]
        total = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.starts[rows] - (total - lengths), lengths) + np.arange(total[-1])]
        chunk_bound = np.searchsorted(cut, begin)
        per_text = np.zeros(len(sizes), np.int64)
        per_text[full] = np.add.reduceat(lengths, chunk_bound)
        return ids, np.concatenate([[0], np.cumsum(per_text)])


def _encoded(batches: Iterator[pa.RecordBatch], text: int, model: str, ids: str) -> Iterator[pa.RecordBatch]:
    """The batches with a column of ids; ``text`` is the text column's place."""
    table = ChunkTable(model)
    for batch in batches:
        data, offsets = text_buffers(batch.column(text))
        for lo, hi in text_groups(offsets, _GROUP_BYTES):
            own, part = offsets[lo:hi + 1], batch.slice(lo, hi - lo)
            group, bound = data[own[0]:own[-1]], own - own[0]
            if _MARK.encode() in group.tobytes():  # the library takes it for a blank
                group, bound = text_buffers(pa.array([t and t.replace(_MARK, " ") for t in part.column(text).to_pylist()], pa.large_string()))
            flat, ends = table.encode(group, bound)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*batch.schema.names, ids])


def _decoded(batches: Iterator[pa.RecordBatch], ids: str, model: str, text: str) -> Iterator[pa.RecordBatch]:
    """The batches with a column of decoded texts."""
    sp = _processor(model)
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            texts = [None if x is None else sp.decode(x) for x in part.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])


def _with(frame: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*frame.schema.fields, *fields])


def encode(docs: DataFrame, text: str = "text", model: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array of int, empty for a null or empty text)."""
    model, at = model or default_model(), docs.columns.index(text)
    check_model(model)
    return docs.mapInArrow(lambda batches: _encoded(batches, at, model, ids),
                           _with(docs, T.StructField(ids, T.ArrayType(T.IntegerType()))))


def decode(rows: DataFrame, ids: str = "ids", model: str | None = None, text: str = "decoded") -> DataFrame:
    """Adds ``text``: the library's decode of each id list (null for a null list)."""
    model = model or default_model()
    return rows.mapInArrow(lambda batches: _decoded(batches, ids, model, text), _with(rows, T.StructField(text, T.StringType())))


def encode_and_decode(docs: DataFrame, text: str = "text", model: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` one after the other in one pass, so a task needs one Python worker."""
    model, at = model or default_model(), docs.columns.index(text)
    check_model(model)
    return docs.mapInArrow(lambda batches: _decoded(_encoded(batches, at, model, ids), ids, model, decoded), _with(
        docs, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())))


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, through its ids and their decoded text."""
    both = encode_and_decode(docs.select("doc_id", "text"), "text", model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def encode_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row of ``docs`` encoded and decoded again."""
    return round_trip(docs)


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded again."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
