"""WARC archives: records written by Spark, read back, and joined to one nested row per capture."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from answerlens.session import shared_dir

#: Payloads from this size on are written once; equal ones revisit.
LEAST_BYTES = 1000
PAGES_PER_FILE = 4096
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"
_READ = 1 << 20
_VERSION = re.compile(rb"WARC/\d+\.\d+")

RECORD_SCHEMA = (
    "record_id string, warc_type string, concurrent_to string, target_uri string, warc_date string, refers_to string, "
    "content_type string, header_digest string, http_status int, payload_bytes long, payload_digest string, "
    "fields map<string,string>"
)


def record_id(kind: str, page: Column) -> Column:
    """URN of a page's record of a kind."""
    digest = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("null"))))
    dashed = F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(kind: str | Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the two line ends that close it; headers that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    named = [("WARC-Type", kind), ("WARC-Date", F.lit(DATE)), *headers, ("Content-Length", F.octet_length(block).cast("string"))]
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(_END)) for name, value in named]
    return F.concat(F.lit(f"WARC/1.1{_END}"), F.concat_ws("", *lines), F.lit(_END), block)


def with_originals(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Add digest, size and, where an equal large payload has a larger page_id, that page_id as ``original``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select(
        "page_id", F.coalesce(F.regexp_replace("url", r"[\r\n]", "%0A"), F.lit("")).alias("url"), payload.alias("payload"),
        F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"),
    )
    last = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")).filter(
        F.col("bytes") >= least_bytes
    ).groupBy("digest").agg(F.max("page_id").alias("last"))
    revisits = (F.col("bytes") >= least_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return sized.join(last, "digest", "left").withColumn("original", F.when(revisits, F.col("last"))).drop("last")


def records(captures: DataFrame) -> DataFrame:
    """Request, response or revisit, and metadata record of each capture, as text."""
    page = F.col("page_id")
    main = F.when(F.col("original").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    own = record_id("response", page)
    path = F.regexp_replace("url", r"^[a-z+]*:?//[^/]*", "")
    host = F.regexp_extract("url", r"^[a-z+]*:?//([^/?#]*)", 1)
    request = F.concat(
        F.lit("GET "), F.when(path == "", F.lit("/")).otherwise(path), F.lit(f" HTTP/1.1{_END}Host: "), host, F.lit(_END * 2)
    )
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
        F.col("bytes").cast("string"), F.lit(_END * 2),
    )
    body = F.when(F.col("original").isNull(), F.concat(head, F.col("payload"))).otherwise(head)
    target = ("WARC-Target-URI", F.when(F.col("url") != "", F.col("url")))
    fields = F.concat(F.lit("pageId: "), F.coalesce(page.cast("string"), F.lit("")), F.lit(_END))
    return captures.select(F.explode(F.array(
        _record("request", [
            ("WARC-Record-ID", record_id("request", page)), ("WARC-Concurrent-To", own), target,
            ("Content-Type", F.lit("application/http;msgtype=request")),
        ], request),
        _record(main, [
            ("WARC-Record-ID", own), target,
            ("WARC-Refers-To", F.when(F.col("original").isNotNull(), record_id("response", F.col("original")))),
            ("WARC-Profile", F.when(
                F.col("original").isNotNull(),
                F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            )),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ], body),
        _record("metadata", [
            ("WARC-Record-ID", record_id("metadata", page)), ("WARC-Concurrent-To", own), target,
            ("Content-Type", F.lit("application/warc-fields")),
        ], fields),
    )).alias("value"))


def write_archives(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> str:
    """Write gzipped WARC files, each of a bounded number of captures; returns their folder.

    Spark's text writer ends each row with its line separator, here the two line ends that close a record.
    """
    path = path or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc/{uuid.uuid4().hex}"
    rows = records(with_originals(pages, least_bytes))
    rows.write.option("lineSep", _END * 2).option("compression", "gzip").option(
        "maxRecordsPerFile", 3 * PAGES_PER_FILE
    ).text(path)
    return path


def _stream(raw: bytes) -> Iterator[bytes]:
    """Decompressed pieces of a file of one or more gzip members, or the bytes of a plain one."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        member = zlib.decompressobj(31)
        while not member.eof:
            piece = member.decompress(raw, _READ)
            raw = member.unconsumed_tail or member.unused_data
            if piece:
                yield piece
            if not raw and not member.eof:
                yield member.flush()
                return


class _Buffer:
    """Bytes read so far from a place on; what lies before it is dropped when more is read."""

    def __init__(self, raw: bytes):
        self.pieces, self.data, self.at = _stream(raw), b"", 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.data, self.at = self.data[self.at:] + piece, 0
        return True

    def starts(self, mark: bytes) -> bool:
        while len(self.data) - self.at < len(mark):
            if not self.more():
                return False
        return self.data.startswith(mark, self.at)

    def until(self, mark: bytes) -> bytes | None:
        seen = self.at
        while (end := self.data.find(mark, seen)) < 0:
            seen = max(0, len(self.data) - self.at - len(mark))
            if not self.more():
                return None
        out, self.at = self.data[self.at:end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        if len(self.data) - self.at >= n:
            out, self.at = self.data[self.at:self.at + n], self.at + n
            return out
        parts, have = [self.data[self.at:]], len(self.data) - self.at
        while have < n and (piece := next(self.pieces, None)) is not None:
            parts.append(piece)
            have += len(piece)
        if have < n:
            raise ValueError(f"a record ends after {have} of {n} bytes")
        self.data, self.at = b"".join(parts), n
        return self.data[:n]


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; continued lines belong to the one before."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of an archive's records."""
    buffer = _Buffer(raw)
    while True:
        while buffer.starts(b"\r\n"):
            buffer.at += 2
        if buffer.at == len(buffer.data) and not buffer.more():
            return
        head = buffer.until(b"\r\n\r\n")
        if head is None or not _VERSION.match(head):
            raise ValueError(f"not a record: {buffer.data[:40] if head is None else head[:40]!r}")
        headers = _fields(head.partition(b"\r\n")[2])
        yield headers, buffer.take(int(headers.get("content-length", 0)))


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type")
    status = size = digest = payload = None
    fields: dict[str, str] = {}
    stored = headers.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
    if kind in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        line, _, rest = head.partition(b"\r\n")
        http = _fields(rest)
        number = line.split(b" ")[1:2]
        status = int(number[0]) if number and number[0].isdigit() else None
        if kind == "response":
            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        else:
            size, digest = int(http.get("content-length", 0)), stored
    elif kind == "metadata":
        fields = _fields(block)
    get = headers.get
    row = (
        get("warc-record-id"), kind, get("warc-concurrent-to"), get("warc-target-uri"), get("warc-date"), get("warc-refers-to"),
        get("content-type"), stored, status, size, digest, list(fields.items()),
    )
    return (*row, payload if kind == "response" else None) if with_payload else row


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of all files below a folder.  ``with_payload`` adds the response payloads."""
    schema = [
        *((n, pa.string()) for n in ("record_id", "warc_type", "concurrent_to", "target_uri", "warc_date", "refers_to",
                                     "content_type", "header_digest")),
        ("http_status", pa.int32()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())), *([("payload", pa.binary())] if with_payload else []),
    ]
    arrow = pa.schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in parse_records(content.as_py()):
                    rows.append(_row(headers, block, with_payload))
                    held += len(block) if with_payload else 0
                    if len(rows) == 2000 or held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, RECORD_SCHEMA + ", payload binary" * with_payload)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit record, its request, its metadata fields.

    Requests and metadata find their capture through WARC-Concurrent-To; a capture without them keeps nulls.  They are
    reduced to one per capture before the join, so repeated captures do not multiply.
    """
    main = records.filter(F.col("warc_type").isin("response", "revisit"))
    rest = [c for c in main.columns if c not in ("concurrent_to", "fields", "record_id")]
    main = main.select("record_id", F.struct(*rest).alias("response"))
    requests = records.filter("warc_type = 'request' and concurrent_to is not null").groupBy("concurrent_to").agg(
        F.min(F.struct("record_id", "target_uri", "warc_date")).alias("request")
    )
    metadata = records.filter("warc_type = 'metadata' and concurrent_to is not null").groupBy("concurrent_to").agg(
        F.min_by(F.struct("record_id", "fields"), "record_id").alias("metadata")
    )
    for side in (requests, metadata):
        main = main.join(side.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left")
    return main


def page_captures(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, read them back, and give one row per page.

    Null html is an empty payload, a null url leaves the target out.  Rows that share a page_id share record ids; each
    keeps its row.  A null page_id is original only if no other page has the payload.  An empty table writes no record.
    Further columns are ignored.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    assembled = captures(read_archives(spark, write_archives(pages)))
    number = F.element_at("metadata.fields", F.lit("pageid"))
    found = assembled.select(
        F.when(number != "", number).cast(kind).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.warc_type").alias("record_type"),
        F.col("response.refers_to").alias("refers_id"), "record_id",
    )
    named = found.filter("record_type = 'response'").select("record_id", F.col("page_id").alias("page")).groupBy("record_id").agg(
        F.min("page").alias("page")
    )
    # A response looks itself up, so that rows without a reference do not meet on one null key.
    keyed = found.withColumn("key", F.coalesce("refers_id", "record_id")).drop("record_id")
    return keyed.join(named.withColumnRenamed("record_id", "key"), "key", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_id").isNotNull(), F.col("page")).alias("refers_to"),
    )
