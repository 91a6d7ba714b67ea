"""WARC archives: written one record at a time, read back, and assembled into captures.

A page becomes a request, a response (or a revisit of an equal payload) and a metadata record; the
request and the metadata name the capture they belong to in WARC-Concurrent-To.  Reading parses every
archive once into an index of records; request, capture and metadata records are then joined through
those identifiers, which gives one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.files import whole_file
from quern.llm.storage import materialize, new_folder, small_batches

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT_BYTES = 0
#: Bytes of payload in an archive, about.
ARCHIVE_BYTES = 16_000_000
#: Compressed bytes that are read at a time.
PIECE = 4096
#: The same for all records: archives of equal pages are equal.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Host and rest of a url that has a host.
AUTHORITY = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)(.*)", re.DOTALL)
_SPACE = uuid.UUID("6f0f1f6c-7c1f-5d0e-9a53-3a6a4cf0b001")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member that holds one WARC record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _line(value: str) -> str:
    """A header value: no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def capture_records(number: str, page_id: str | None, url: str | None, payload: bytes, first_id: str | None, first_url: str | None, revisit: bool) -> Iterator[bytes]:
    """The records of one page.  ``number`` is unique among all captures."""
    ids = {kind: f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind} {number}')}>" for kind in ("capture", "request", "metadata")}
    uri = _line(url) if url else f"urn:page:{page_id}"
    parts = AUTHORITY.match(uri)
    host, path = (parts[1], parts[2] or "/") if parts else ("", "/")
    common = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    yield record([("WARC-Type", "request"), ("WARC-Record-ID", ids["request"]), ("WARC-Concurrent-To", ids["capture"]), *common, ("Content-Type", "application/http;msgtype=request")], f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    digest = ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}")
    kind = ("Content-Type", "application/http;msgtype=response")
    if revisit:
        more = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", _line(first_url) if first_url else f"urn:page:{first_id}"), ("WARC-Refers-To-Date", DATE)]
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", ids["capture"]), *common, digest, *more, kind], head + b"\r\n")
    else:
        yield record([("WARC-Type", "response"), ("WARC-Record-ID", ids["capture"]), *common, digest, kind], head + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload)
    fields = b"" if page_id is None else f"page-id: {_line(page_id)}\r\n".encode()
    yield record([("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), ("WARC-Concurrent-To", ids["capture"]), *common, ("Content-Type", "application/warc-fields")], fields)


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, folder: str | None = None) -> str:
    """Write the pages as archives and return their folder; every task writes one archive.

    Of equal payloads of at least ``least_bytes`` bytes the row with the smallest id is the response and
    the others are revisits; rows that share that id are all responses, and so are all rows where every
    id is null.  A null payload is empty, a null url becomes ``urn:page:<id>``.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    small_batches(spark)
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # Only payloads that occur again: as a rule a short table, and joined without a shuffle then.
    again = slim.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url"))).alias("first")).where("n > 1 and first is not null").select("digest", "first")
    again = materialize(again, "warc-again")
    total = slim.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    marked = slim.join(again, "digest", "left").select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("first.id").cast("string").alias("first_id"), F.col("first.url").alias("first_url"), F.coalesce(~F.col("first.id").eqNullSafe(F.col("id")) & F.col("first").isNotNull(), F.lit(False)).alias("revisit"))
    dealt = marked.repartition(max(1, -(-total // archive_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        with whole_file(folder, f"part-{part:08d}.warc.gz") as stream:
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    for page_id, url, data, first_id, first_url, revisit in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns), strict=True):
                        for piece in capture_records(f"{part} {n}", page_id, url, data, first_id, first_url, revisit):
                            stream.write(piece)
                        n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["captures"])

    dealt.mapInArrow(run, "captures long").agg(F.count("*")).collect()
    return folder


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers in lower case, block) of the records of an archive, one gzip member each."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unpacker, parts, start = zlib.decompressobj(31), [], at
        # By pieces: what a call does not use it copies, which must not be the rest of the archive.
        while not unpacker.eof:
            piece = view[at : at + PIECE]
            if not piece:
                raise ValueError("the archive ends inside of a record")
            parts.append(unpacker.decompress(piece))
            at += len(piece)
        at -= len(unpacker.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield start, headers, rest[: int(headers["content-length"])]


RECORD = "archive string, offset long, kind string, record_id string, concurrent_to string, uri string, date string, digest string, refers_to_uri string, page_id string, payload_bytes long, seen_digest string, request_line string"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The index of all records, parsed once; payloads stay in the archives at (archive, offset)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "content")
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for offset, headers, block in parse_records(content.as_py()):
                    kind, page_id, size, seen, line = headers["warc-type"], None, None, None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size, seen = len(payload), payload_digest(payload)
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                        page_id = fields.get("page-id")
                    elif kind == "request":
                        line = block.partition(b"\r\n")[0].decode()
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    rows.append((path, offset, kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-date"), digest, headers.get("warc-refers-to-target-uri"), page_id, size, seen, line))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return materialize(files.mapInArrow(run, RECORD), "warc-records")


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, capture and metadata joined by WARC-Concurrent-To.

    Rows (record_id, request struct, capture struct, metadata struct); the request or the metadata is
    null where an archive has none.  A record without an identifier belongs to no capture.
    """
    captures = records.where("kind in ('response', 'revisit')").select("record_id", F.struct("kind", "archive", "offset", "uri", "date", "digest", "refers_to_uri", "payload_bytes", "seen_digest").alias("capture"))
    requests = records.where("kind = 'request'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "archive", "offset", "request_line").alias("request"))
    metadata = records.where("kind = 'metadata'").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("id"), "archive", "offset", "page_id").alias("metadata"))
    return captures.join(requests, "record_id", "left").join(metadata, "record_id", "left").select("record_id", "request", "capture", "metadata")


def capture_digests(captures: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) of assembled captures.

    A revisit has the length of the response with its payload digest, and refers to that page.
    """
    flat = captures.select(F.col("metadata.page_id").cast(id_type).alias("page_id"), F.coalesce("capture.seen_digest", "capture.digest").alias("payload_digest"), F.col("capture.kind").alias("record_type"), F.col("capture.payload_bytes").alias("payload_bytes"))
    wanted = flat.where("record_type = 'revisit'").select("payload_digest").distinct()
    responses = flat.where("record_type = 'response'").join(wanted, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.min("payload_bytes").alias("first_bytes"))
    revisits = flat.where("record_type = 'revisit'").join(responses, "payload_digest", "left")
    return flat.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(id_type).alias("refers_to")).union(revisits.select("page_id", "first_bytes", "payload_digest", "record_type", "first_id"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as archives, read back and assembled."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    key = pages.schema["page_id"].dataType.simpleString()
    captures = materialize(assemble_captures(read_records(spark, write_archives(pages))), "warc-captures")
    return capture_digests(captures, key)


OP6_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS hx FROM pages),
f AS (
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY hx) AS first,
         array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((('0x' || substr(hx, CAST(5 * g + 1 AS BIGINT), 5))::BIGINT >> (15 - 5 * k)::INTEGER) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
