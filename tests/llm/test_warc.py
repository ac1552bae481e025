import gzip
import hashlib

import pytest

from txlake.llm import warc_revisit

HTML = "<p>" + "x" * 120 + "</p>\r\n\r\nWARC/1.1\r\n\r\n é"
ROWS = [
    (5, "http://a/5", HTML), (3, "http://a/3", HTML), (9, "http://a\r\n/9", HTML), (1, None, None), (2, "http://a/2", ""), (4, "u", "short"), (6, "u", "short"),
    (None, "http://a/n", HTML), (7, "u", HTML + "!"), (8, "u", "\r\n\r\n" + HTML), (3, "http://a/3", HTML), (10, "u", "y" * 200_000)]


def test_archives_read_back(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "z", 1) for r in ROWS], "page_id long, url string, html string, record_type string, _first int")
    folder = str(tmp_path / "archives")
    warc_revisit.write_archives(warc_revisit.resolve_revisits(pages), folder, records_per_file=3)
    rows = warc_revisit.read_archives(spark, folder)
    payloads = sorted((r.page_id or 0, r.record_type, r.payload, r.refers_to) for r in rows.collect())
    assert payloads == sorted(
        (i or 0, "revisit", None, 3) if h == HTML and i in (5, 9) else (i or 0, "response", h or "", None) for i, _, h in ROWS)
    found = sorted((r.page_id or 0, r.payload_bytes, r.payload_digest) for r in warc_revisit.resolved_lengths(rows).collect())
    assert found == sorted((i or 0, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in ROWS)


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = str(tmp_path / "archives")
    warc_revisit.write_archives(warc_revisit.resolve_revisits(pages), folder)
    assert warc_revisit.resolved_lengths(warc_revisit.read_archives(spark, folder)).collect() == []


def test_parser_takes_members_and_refuses_torn_files():
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\na\r\n\r\n\r\n\r\n"
    packed = gzip.compress(record) + gzip.compress(record)
    assert [r["body"] for r in warc_revisit.parse(warc_revisit.unpacked(memoryview(packed)))] == [b"a\r\n\r\n"] * 2
    with pytest.raises(ValueError):
        list(warc_revisit.parse(iter([record[:-6]])))
    with pytest.raises(ValueError):
        list(warc_revisit.parse(iter([b"HTTP/1.1 200\r\n\r\n"])))
