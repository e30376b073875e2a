"""WARC archives: writing, reading, segment reassembly and chunked-transfer decoding.

Writing. Rows become ``response`` records whose block is an HTTP response in
chunked transfer framing; rows that repeat a payload become ``revisit`` records
of the row with the largest id. A block over ``segment_bytes`` is split: the
first part is the record itself (segment 1), the rest are ``continuation``
records that name their origin, and the last one states the total length.
Files are gzip streams of at most about ``FILE_BYTES`` of records, written
by Spark's text writer, whose line separator is the blank lines that end a
record.

Reading. Every file is parsed in the task that reads it, by the stated lengths
and never by searching for separators. Whole records are decoded there; only
segments are shuffled, grouped by origin, ordered by number, checked (numbers
1..n without a gap, stated total length) and joined. A record that fails a
check comes back with a null payload and the reason in ``problem``; segments
whose first one is missing come back as one such row under their origin's id.

Nulls: a null payload is empty, a null url an empty target, null ids are kept
(a null id never is the largest). Rows tied on the largest id of a payload are
all responses. Rows repeated with id and payload have one record id and come
back as often as they were written. No rows, no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.scratch import new_folder

FILE_BYTES = 16 << 20
SEGMENT_BYTES = 4 << 10  # of the query's archives: larger blocks are segmented
CHUNK_BYTES = 16 << 10
_EOL = b"\r\n"
_BETWEEN = b"\r\n\r\n"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("doc_id", T.LongType()), T.StructField("target_uri", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
    T.StructField("problem", T.StringType())])
_PART = T.StructType([
    T.StructField("origin", T.StringType()), T.StructField("number", T.LongType()),
    T.StructField("total", T.LongType()), T.StructField("header", T.BinaryType()), T.StructField("block", T.BinaryType())])


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from five hexadecimal digits to four letters at a time."""
    digits = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(rows: DataFrame, doc_id: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Adds payload_digest, payload_bytes, record_type and refers_to.

    Of rows with equal payloads of at least ``least_bytes`` bytes the largest
    ``doc_id`` is the response. The table of largest ids holds one row per
    repeated payload and is summed up before the shuffle; the join with it is
    one that adaptive execution can split.
    """
    digested = rows.withColumns({"payload_digest": base32_sha1(F.col(payload)),
                                 "payload_bytes": F.octet_length(payload).cast("long")})
    repeated = digested.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(
        F.max(doc_id).alias("_wa_head"), F.count("*").alias("_wa_n")).where(F.col("_wa_n") > 1).drop("_wa_n")
    again = F.col("_wa_head").isNotNull() & ~F.coalesce(F.col(doc_id) >= F.col("_wa_head"), F.lit(False))
    return digested.join(repeated, "payload_digest", "left").select(
        *rows.columns, "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_wa_head")).alias("refers_to"))


# --- records as bytes -----------------------------------------------------

def record_id(doc_id, digest: str, kind: str = "response") -> str:
    h = hashlib.md5(f"{doc_id}/{digest}/{kind}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing (RFC 9112, 7.1)."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i:i + size]
        parts += [b"%x\r\n" % len(piece), piece, _EOL]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Undo chunked framing; ValueError if it is broken or cut off."""
    out, at = [], 0
    while True:
        end = body.find(_EOL, at)
        if end < 0:
            raise ValueError("chunk size cut off")
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size < 0 or (size and body[at + size:at + size + 2] != _EOL):
            raise ValueError("chunk cut off")
        if size == 0:
            return b"".join(out)
        out.append(body[at:at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP response, with its transfer framing undone."""
    head, found, body = block.partition(_BETWEEN)
    if not found or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(_EOL)[1:])}
    return dechunked(body) if fields.get(b"transfer-encoding", b"") == b"chunked" else body


def _header(kind: str, ident: str, fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ident}", *[f"{k}: {v}" for k, v in fields if v is not None],
             f"Content-Length: {length}"]
    return "\r\n".join(lines).encode() + _BETWEEN


def records(doc_id, url, payload: bytes, digest: str, length: int, kind: str, head, date: str,
            segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record of a row and its continuations, each without the blank lines at its end.

    A revisit has no payload (None) but states its ``length``."""
    ident = record_id(doc_id, digest, kind)
    uri = "".join(c for c in (url or "") if c.isprintable()).strip()
    shared = [("WARC-Date", date), ("WARC-Target-URI", uri or None), ("X-Doc-Id", doc_id),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", length)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if kind == "revisit":
        shared += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(head, digest)), ("X-Refers-To-Doc-Id", head)]
        yield _header(kind, ident, [*shared, ("Content-Type", "application/http; msgtype=response")], len(http)) + http
        return
    block = http + chunked(payload)
    shared.append(("Content-Type", "application/http; msgtype=response"))
    if len(block) <= segment_bytes:
        yield _header(kind, ident, shared, len(block)) + block
        return
    for number, at in enumerate(range(0, len(block), segment_bytes), 1):
        part = block[at:at + segment_bytes]
        if number == 1:
            yield _header(kind, ident, [*shared, ("WARC-Segment-Number", 1)], len(part)) + part
            continue
        last = at + segment_bytes >= len(block)
        yield _header("continuation", record_id(doc_id, digest, f"segment {number}"), [
            ("WARC-Date", date), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if last else None)], len(part)) + part


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(fields with lower-cased names, raw header, block) of every record, found by stated lengths."""
    at = 0
    while at < len(data):
        end = data.find(_BETWEEN, at)
        if not data.startswith(b"WARC/1.", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        raw = data[at:end]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}
        size = int(fields["content-length"])
        begin = end + len(_BETWEEN)
        yield fields, raw, data[begin:begin + size]
        at = begin + size + len(_BETWEEN)


def inflate(data: bytes) -> bytes:
    """Content of a file: plain, one gzip stream, or a member per record."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        stream = zlib.decompressobj(31)
        out.append(stream.decompress(data))
        data = stream.unused_data
    return b"".join(out)


# --- jobs -----------------------------------------------------------------

def write_archives(rows: DataFrame, path: str, doc_id: str, url: str, payload: str, date: str = "2024-01-01T00:00:00Z",
                   segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``rows`` as WARC files under ``path``. ``payload`` is a string (UTF-8) or binary column."""
    source = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(url).alias("url"),
                         F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    marked = mark_revisits(source, "doc_id", "payload").select(
        "doc_id", "url", F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"), "payload_digest",
        "payload_bytes", "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([_BETWEEN.join(held)], pa.binary())], ["value"])

        for batch in batches:
            for i in range(len(batch)):
                ident, uri, body, digest, length, kind, head = (c[i].as_py() for c in batch.columns)
                for record in records(ident, uri, body, digest, length, kind, head, date, segment_bytes):
                    held.append(record)
                    size += len(record)
                    if size >= FILE_BYTES:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    files = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    files.write.option("lineSep", _BETWEEN.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).option(
        "zlib.compress.level", "BEST_SPEED").text(path)


def _parsed(spark: SparkSession, path: str, segments: bool) -> DataFrame:
    """Records of the files: whole ones decoded (RECORD), or the segments (_PART)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = _PART if segments else RECORD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([pa.field(f.name, pa.int64() if f.dataType == T.LongType() else
                                    pa.binary() if f.dataType == T.BinaryType() else pa.string()) for f in schema])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, raw, block in parse_records(inflate(content.as_py())):
                    if ("warc-segment-number" in fields) != segments:
                        continue
                    rows.append(_segment(fields, raw, block) if segments else decoded(fields, block))
                    size += len(block)
                    if size > FILE_BYTES // 4:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.mapInArrow(run, schema)


def _segment(fields: dict[str, str], raw: bytes, block: bytes) -> dict:
    number = int(fields["warc-segment-number"])
    total = fields.get("warc-segment-total-length")
    return {"origin": fields["warc-record-id"] if number == 1 else fields["warc-segment-origin-id"], "number": number,
            "total": int(total) if total else None, "header": raw if number == 1 else None, "block": block}


def decoded(fields: dict[str, str], block: bytes, problem: str | None = None) -> dict:
    """A whole record as a row; revisits have no payload of their own."""
    kind = fields["warc-type"]
    ident, head, length = fields.get("x-doc-id"), fields.get("x-refers-to-doc-id"), fields.get("x-payload-length")
    row = {"record_id": fields["warc-record-id"], "record_type": kind, "doc_id": int(ident) if ident else None,
           "target_uri": fields.get("warc-target-uri"), "payload_digest": fields.get("warc-payload-digest", "")[5:] or None,
           "payload_bytes": int(length) if length else None, "refers_to": int(head) if head else None,
           "payload": None, "problem": problem}
    if kind != "response" or problem:
        return row
    try:
        payload = http_payload(block)
    except ValueError as e:
        return row | {"problem": str(e)}
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if row["payload_digest"] not in (None, digest):
        return row | {"problem": f"payload has digest {digest}"}
    return row | {"payload": payload, "payload_digest": digest, "payload_bytes": len(payload)}


def reassembled(origin: str, parts: list[tuple]) -> dict:
    """The row of one origin from its (number, total, header, block), one per number, in order."""
    numbers, header, total = [p[0] for p in parts], parts[0][2], parts[-1][1]
    if numbers[0] != 1 or header is None:  # nothing tells what the rest belongs to
        return dict.fromkeys(RECORD.names) | {"record_id": origin, "record_type": "continuation", "problem": "first segment missing"}
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in bytes(header).decode().split("\r\n")[1:])}
    block = b"".join(p[3] for p in parts)
    problem = None
    if numbers != list(range(1, len(numbers) + 1)):
        problem = "segments missing"
    elif total != len(block):
        problem = f"segments hold {len(block)} bytes of {total}"
    return decoded(fields, block, problem)


def reassemble(parts: DataFrame) -> DataFrame:
    """Segments (origin, number, total, header, block) as whole, checked and decoded records.

    Segments of rows that repeat are the same: each number is kept once, with
    the count of its copies, before a record's segments meet, so what a task
    holds is bounded by the largest payload. A record comes back once per copy
    of its first segment.
    """
    # equal origins and numbers have equal blocks: any of them will do, and the least is the same on a rerun
    one = parts.groupBy("origin", "number").agg(F.max("total").alias("total"), F.min("header").alias("header"), F.min("block").alias("block"),
                                                F.count("*").alias("copies"))
    grouped = one.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "total", "header", "block"))).alias("parts"),
        F.coalesce(F.max(F.when(F.col("number") == 1, F.col("copies"))), F.lit(1)).alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([pa.field(f.name, pa.int64() if f.dataType == T.LongType() else
                                    pa.binary() if f.dataType == T.BinaryType() else pa.string()) for f in counted])
        for batch in batches:
            for origin, group, copies in zip(*batch.columns):
                row = reassembled(origin.as_py(), [(p["number"], p["total"], p["header"], p["block"]) for p in group.as_py()])
                yield pa.RecordBatch.from_pylist([row | {"copies": copies.as_py()}], arrow)

    counted = T.StructType([*RECORD.fields, T.StructField("copies", T.LongType())])
    whole = grouped.select("origin", "parts", "copies").mapInArrow(run, counted)
    return whole.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*RECORD.names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the WARC files under ``path``, segments put together (columns of RECORD)."""
    return _parsed(spark, path, False).union(reassemble(_parsed(spark, path, True)))


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Pages archived and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, problem."""
    path = new_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, "page_id", "url", "html")
    return read_archives(spark, path).select(F.col("doc_id").alias("page_id"), "payload_bytes", "payload_digest",
                                             "record_type", "refers_to", "problem")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS head FROM p)
SELECT page_id, payload_bytes,
       translate(""" + " || ".join(f"lpad(to_base(('0x' || substr(h, {i}, 5))::BIGINT, 32), 4, '0')" for i in range(1, 41, 5)) + """,
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < head THEN head END AS refers_to, NULL::VARCHAR AS problem
FROM d
"""
