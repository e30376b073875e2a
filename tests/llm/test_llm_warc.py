"""WARC: exact round trips, segments, framing, revisits, damaged records."""

import base64
import gzip
import hashlib

import pytest

from riskweave.llm import warc
from riskweave.llm.scratch import new_folder

SCHEMA = "page_id long, url string, html string, record_type string, problem string"


def archive(spark, rows, segment_bytes=warc.SEGMENT_BYTES):
    path = new_folder(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path, "page_id", "url", "html", segment_bytes=segment_bytes)
    return path, {}


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("segment_bytes", [200, 1000, 1 << 20])
def test_round_trip_with_revisits_and_segments(spark, segment_bytes):
    # record_type and problem are columns of the input that clash with the records' own
    texts = {1: "a", 2: "é" * 5000, 3: "a", 4: None, 5: "", 6: "\r\n\r\nWARC/1.1\r\n" * 50, 7: "a", 8: "x" * 100_000}
    rows = [(i, f"http://h/{i}\r\nX: y" if i != 3 else None, t, "clash", "clash") for i, t in texts.items()]
    path, _ = archive(spark, rows, segment_bytes)
    got = {r["doc_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert sorted(got) == sorted(texts)
    for i, t in texts.items():
        r = got[i]
        assert r["problem"] is None
        assert (r["payload_bytes"], r["payload_digest"]) == (len((t or "").encode()), digest(t))
        head = max(j for j, x in texts.items() if (x or "") == (t or ""))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if head == i else ("revisit", head))
        if head == i:
            assert bytes(r["payload"]).decode() == (t or "")


def test_null_ids_ties_and_repeated_rows(spark):
    rows = [(None, "u", "same", "", ""), (2, "u", "same", "", ""), (2, "u", "same", "", ""), (None, "u", "alone" * 100, "", ""),
            (1, "v", "same", "", "")]
    path, _ = archive(spark, rows, 120)
    got = sorted((r["doc_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_archives(spark, path).collect())
    assert got == [(0, "response", None, 500), (0, "revisit", 2, 4), (1, "revisit", 2, 4), (2, "response", None, 4), (2, "response", None, 4)]


def test_empty_table(spark):
    path, _ = archive(spark, [])
    assert warc.read_archives(spark, path).count() == 0


def test_framing():
    for body in (b"", b"x", b"y" * 100_000, b"0\r\n\r\n"):
        assert warc.dechunked(warc.chunked(body, 7)) == body
    assert warc.dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


def test_segments_are_checked():
    parts = list(warc.records(1, "u", b"q" * 1000, digest("q" * 1000), 1000, "response", None, "2024-01-01T00:00:00Z", 300))
    rows = []
    for p in parts:
        for fields, raw, block in warc.parse_records(p + b"\r\n\r\n"):
            s = warc._segment(fields, raw, block)
            rows.append((s["number"], s["total"], s["header"], s["block"]))
    assert len(rows) > 2
    whole = warc.reassembled("o", rows)
    assert whole["payload"] == b"q" * 1000 and whole["problem"] is None
    gap = warc.reassembled("o", rows[:1] + rows[2:])
    assert gap["payload"] is None and gap["problem"] == "segments missing"
    short = warc.reassembled("o", rows[:-1])
    assert short["payload"] is None and short["problem"].startswith("segments hold")
    orphan = warc.reassembled("o", rows[1:])
    assert (orphan["record_id"], orphan["payload"], orphan["problem"]) == ("o", None, "first segment missing")


def test_files_of_record_members_or_one_stream():
    a, b = b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n", b"WARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    for data in (a + b, gzip.compress(a + b), gzip.compress(a) + gzip.compress(b)):
        assert [x[2] for x in warc.parse_records(warc.inflate(data))] == [b"x", b""]
    with pytest.raises(ValueError):
        list(warc.parse_records(b"junk"))


def test_orphans_and_copies_in_the_job(spark):
    parts = list(warc.records(1, "u", b"q" * 1000, digest("q" * 1000), 1000, "response", None, "2024-01-01T00:00:00Z", 300))
    rows = [warc._segment(f, raw, block) for p in parts for f, raw, block in warc.parse_records(p + b"\r\n\r\n")]
    lost = [r | {"origin": "lost"} for r in rows[1:]]
    frame = spark.createDataFrame([tuple(r[f] for f in warc._PART.names) for r in rows * 40 + lost], warc._PART)
    got = warc.reassemble(frame).collect()
    assert len(got) == 41 and sum(r["payload"] == b"q" * 1000 for r in got) == 40
    assert [(r["record_id"], r["payload"]) for r in got if r["problem"]] == [("lost", None)]


def test_the_given_pages_are_segmented(spark):
    sf = "/root/testdata/sf0.01"
    path = new_folder(spark, "test-pages")
    warc.write_archives(spark.read.parquet(f"{sf}/pages.parquet"), path, "page_id", "url", "html")
    pieces = warc._parsed(spark, path, True).groupBy("origin").count().where("count > 1").count()
    pages = spark.read.parquet(f"{sf}/pages.parquet").count()
    assert pieces > 0.1 * pages
    back = warc.read_archives(spark, path)
    assert back.count() == pages and back.where("problem is not null").isEmpty()
