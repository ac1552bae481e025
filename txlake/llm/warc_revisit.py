"""Web archives in which a payload is stored once: later captures of it become revisit records.

The record headers (digest, id, length; never the payload) are shuffled by payload digest to find each payload's first
capture. Revisits are joined to it, and all records are written with fresh headers as gzip-compressed WARC 1.1 files by
Spark's own text writer, whose line end is the blank lines that end a record. Reading parses the files by the lengths
in their headers and joins revisits to the responses they name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txlake.llm.schema_guard import pick

MIN_PAYLOAD = 100
RECORDS_PER_FILE = 4000
_ID = "urn:page:"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"
_READ_BYTES = 1 << 18


def resolve_revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Captures with ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    Of captures with equal payloads of at least ``min_payload`` bytes the one with the smallest ``page_id`` is the
    response and the others revisit it; rows that repeat that id are responses too, as are rows with a null id. Smaller
    payloads are always responses. A null ``html`` is an empty payload. Only digests seen more than once are joined, so
    a payload that a third of the captures share is one row of the joined side.
    """
    rows = pick(pages, page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn(
        "payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    first = rows.where((F.col("payload_bytes") >= min_payload) & F.col("page_id").isNotNull()).groupBy(
        F.col("payload_digest").alias("_digest")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_count")).where("_count > 1")
    joined = rows.join(first, rows.payload_digest == first._digest, "left")
    revisit = F.col("_first") < F.col("page_id")
    return joined.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"))


def _record_id(page: Column) -> Column:
    """``<urn:page:N>``; without a number for a null id."""
    return F.concat(F.lit(f"<{_ID}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value.cast("string")), F.lit(""))


def records(captures: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """One column ``value``: each capture as a WARC record, without the two line ends that close it."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(_END))
    body = F.when(F.col("record_type") == "response", F.concat(http, F.col("html"))).otherwise(http)
    address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    revisit = F.col("record_type") == "revisit"
    return captures.withColumn("_body", body).select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        _header("WARC-Record-ID", _record_id(F.col("page_id"))), F.lit(f"\r\nWARC-Date: {date}"),
        _header("WARC-Target-URI", address),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        _header("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        F.lit("\r\nContent-Type: application/http; msgtype=response"),
        _header("Content-Length", F.octet_length("_body")), F.lit(_END), F.col("_body")).alias("value"))


def write_archives(captures: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the records under ``folder``, which every executor must reach; a retried task replaces its own files."""
    records(captures).write.option("lineSep", _END).option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_file).text(folder)


def parse(blocks: Iterator[bytes]) -> Iterator[dict]:
    """Records of an unpacked archive: header names in lower case, and ``body``. Only the record at hand is held."""
    held = bytearray()

    def more(size: int) -> bool:
        while len(held) < size:
            block = next(blocks, None)
            if block is None:
                return False
            held.extend(block)
        return True

    while True:
        while more(1) and held[:1] in b"\r\n":
            del held[:1]
        if not held:
            return
        size = 0
        while (end := held.find(_END.encode(), size)) < 0:
            size = max(0, len(held) - 3)
            if not more(len(held) + 1):
                raise ValueError("an archive ends inside a record's header")
        lines = bytes(held[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        found = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
        at = end + 4
        if not more(at + int(found["content-length"])):
            raise ValueError("an archive ends inside a record")
        found["body"] = bytes(held[at:at + int(found["content-length"])])
        del held[:at + int(found["content-length"])]
        yield found


def unpacked(data: memoryview) -> Iterator[bytes]:
    """Blocks of a gzip file of one or more members."""
    state, at = zlib.decompressobj(31), 0
    rest = b""
    while rest or at < len(data):
        part = rest or bytes(data[at:at + _READ_BYTES])
        at += 0 if rest else len(part)
        if block := state.decompress(part):
            yield block
        rest = state.unused_data
        if state.eof:
            state = zlib.decompressobj(31)
    if block := state.flush():
        yield block


def _page(text: str | None) -> int | None:
    digits = (text or "").strip("<>").removeprefix(_ID)
    return int(digits) if digits else None


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: ids, kind, digest, the response it refers to, and the payload (null for a revisit).

    ``payload_bytes`` is the length of the payload as stored, of a revisit that of the response it is joined to. A
    response whose payload doesn't match its digest is an error.
    """
    def work(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for found in parse(unpacked(memoryview(content.as_buffer()))):
                    digest = found["warc-payload-digest"].removeprefix("sha256:")
                    payload = None
                    if found["warc-type"] == "response":
                        payload = found["body"].partition(_END.encode())[2]
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {found['warc-record-id']} doesn't match its digest")
                    rows.append({
                        "page_id": _page(found["warc-record-id"]), "url": found.get("warc-target-uri"),
                        "record_type": found["warc-type"], "payload_digest": digest,
                        "payload_bytes": None if payload is None else len(payload),
                        "refers_to": _page(found.get("warc-refers-to")),
                        "payload": None if payload is None else payload.decode()})
                    if len(rows) >= 200:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(work, _FIELDS)


def resolved_lengths(records_read: DataFrame) -> DataFrame:
    """The records' headers, revisits with the length of the response they name; payloads are left behind."""
    headers = records_read.select("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to")
    revisits, responses = headers.where("record_type = 'revisit'"), headers.where("record_type = 'response'")
    # A payload of any number of revisits is one row here: lengths are joined to the few distinct targets.
    wanted = revisits.groupBy("refers_to").agg(F.count("*").alias("_n")).select(F.col("refers_to").alias("_target"))
    lengths = responses.select(F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes")).join(
        wanted, F.col("_page") == F.col("_target"), "left_semi").groupBy("_page").agg(F.min("_bytes").alias("_bytes"))
    joined = revisits.join(lengths, revisits.refers_to == lengths._page, "left")
    return responses.unionByName(joined.select(
        "page_id", "record_type", F.col("_bytes").alias("payload_bytes"), "payload_digest", "refers_to"))
