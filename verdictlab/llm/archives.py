"""Legacy web archives (ARC, versions 1 and 2) and their conversion to WARC.

An ARC file starts with a version block, whose body names the version and the fields of the header lines that follow;
each record is a header line, as many bytes as its last field declares, and a line feed. A WARC record is a block of named fields, then as many bytes
as Content-Length declares, then two line ends. Spark's text writer commits the files (a file a row, the last record's end as line separator), gzip-compressed.

Which record is a response is decided on light rows (file, place, page, digest). Blocks stay where they are: every ARC file is then converted with its own decisions.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from gzip import GzipFile
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, ready, staged

#: Fields of a header line by version (fixed values of the format).
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: A file ends with so many records or so many bytes (a longer record has a file of its own), since readers hold a file at a time.
FILE_RECORDS, FILE_BYTES = 2000, 16 << 20
#: So many revisits are sent to all executors (some 20 MB); more are joined to their files.
SENT_REVISITS = 200_000
CRLF = b"\r\n"
EPOCH = "20000101000000"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_block(payload: bytes, headers: dict[str, str]) -> bytes:
    lines = ["HTTP/1.1 200 OK", *(f"{k}: {v}" for k, v in headers.items())]
    return "\r\n".join(lines).encode() + CRLF + CRLF + payload


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of an HTTP response; a block that is none is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, payload = block.partition(CRLF + CRLF)
    return dict(x.split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x), payload


def arc_version_block(version: int, name: str, date: str = EPOCH) -> bytes:
    body = f"{version} 0 verdictlab\n{ARC_FIELDS[version]}\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, ip: str, date: str, mime: str, block: bytes, offset: int = 0, name: str = "-") -> bytes:
    """A record without its final line feed."""
    url = quote(url, safe="!#$%&'()*+,/:;=?@[]~") or "unknown:"
    extra = f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{extra} {len(block)}\n".encode() + block


def read_arc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by name, block) of each record. Declared lengths rule; a line that doesn't fit the version's fields is an error."""
    line = stream.readline()
    if not line:
        return
    if not line.startswith(b"filedesc:"):
        raise ValueError("an ARC file starts with a version block")
    body = stream.read(int(line.split(b" ")[-1]))
    version, *_ = body.split(b" ", 1)
    fields = body.split(b"\n")[1].decode().split(" ")
    if fields != ARC_FIELDS.get(int(version), "").split(" "):
        raise ValueError(f"version {version!r} with fields {fields}")
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\n", CRLF):  # between records
            continue
        values = line.rstrip(b"\r\n").decode("latin-1").split(" ")
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"not a header line of version {version!r}: {line[:100]!r}")
        n = int(values[-1])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("a record ends before its declared length")
        yield dict(zip(fields, values, strict=True)), block


def warc_date(arc_date: str) -> str:
    """14 digits (or fewer: the start of a date) as an ISO time; what is no date is the epoch of the format."""
    digits = (arc_date + EPOCH[len(arc_date) :])[:14]
    try:
        at = datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
    except ValueError:
        at = datetime(1970, 1, 1, tzinfo=timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(*parts: object) -> str:
    """A URN that the same record always gets."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1('|'.join(map(str, parts)).encode()).digest()[:16], version=5)}>"


def warc_record(fields: dict[str, object], block: bytes) -> bytes:
    """A record without its two final line ends."""
    head = b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}".encode() + CRLF for k, v in fields.items() if v is not None)
    return head + f"Content-Length: {len(block)}".encode() + CRLF + CRLF + block


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8").strip().partition(": ")
            fields[k] = v
        n = int(fields["Content-Length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("a record ends before its declared length")
        yield fields, block


def _files(rows: DataFrame, path: str, line_end: str) -> None:
    """Write each row's bytes (column ``content``) as a gzip file that ends in ``line_end``."""
    out = rows.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", line_end).text(path)


class _Roll:
    """Gathers records into files."""

    def __init__(self, between: bytes):
        self.between, self.held, self.size = between, [], 0

    def full(self, record: int) -> bool:
        """Whether a record of so many bytes begins a new file."""
        return bool(self.held) and (len(self.held) >= FILE_RECORDS or self.size + record > FILE_BYTES)

    def add(self, record: bytes) -> None:
        self.held.append(record)
        self.size += len(record) + len(self.between)

    def close(self) -> pa.RecordBatch:
        data, self.held, self.size = self.between.join(self.held), [], 0
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["content"])


def write_arc_files(pages: DataFrame, path: str) -> None:
    """Write page_id, url, html as ARC files, version 1 and 2 by turns of the partitions. Null html is empty, a null url unknown."""
    ready(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, roll, files = TaskContext.get().partitionId(), _Roll(b"\n"), 0
        version = 1 + part % 2
        name = f"part-{part}-0.arc"
        for b in batches:
            for page, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                headers = {"Content-Type": "text/html; charset=utf-8"} | ({} if page is None else {"X-Page-Id": str(page)})
                block = http_block((html or "").encode("utf-8", "surrogatepass"), headers)
                if roll.full(len(block)):
                    yield roll.close()
                    files += 1
                    name = f"part-{part}-{files}.arc"
                if not roll.held:
                    roll.add(arc_version_block(version, name)[:-1])
                roll.add(arc_record(version, url or "", "0.0.0.0", EPOCH, "text/html", block, roll.size, name))
        if roll.held:
            yield roll.close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    _files(rows.mapInArrow(run, "content binary"), path, "\n")


def _arc_files(spark: SparkSession, path: str) -> DataFrame:
    """file (its name), content."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _arc_rows(file: str, content: pa.Scalar) -> Iterator[tuple[int, int | None, str, dict[str, str], bytes, int]]:
    """(ordinal, page, record id, fields, block, where the payload begins) of the records of a gzip-compressed ARC file."""
    for k, (fields, block) in enumerate(read_arc(GzipFile(fileobj=io.BytesIO(content.as_buffer())))):
        headers, payload = split_http(block)
        page = headers.get("X-Page-Id")
        page = None if page is None else int(page)
        yield k, page, record_id(page, file, k), fields, block, len(block) - len(payload)


def arc_entries(spark: SparkSession, path: str) -> DataFrame:
    """What tells the records of ARC files apart: file, ordinal, page_id, record_id, digest, payload_bytes."""
    ready(spark)
    names = ["file", "ordinal", "page_id", "record_id", "digest", "payload_bytes"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = [(file, k, page, rid, digest32(block[at:]), len(block) - at) for k, page, rid, _, block, at in _arc_rows(file, content)]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return _arc_files(spark, path).mapInArrow(run, "file string, ordinal int, page_id long, record_id string, digest string, payload_bytes long")


def revisits(entries: DataFrame) -> DataFrame:
    """file, of (ordinal, the response's page and record id, for every record of the file that revisits another).

    Of equal payloads the record with the least page_id (then file and place) is the response. Both sides of the join are read from files,
    so that Spark can deal out the rows of a payload that very many records share.
    """
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "ordinal", "record_id")
    firsts = entries.groupBy("digest", "payload_bytes").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = entries.join(staged(firsts, "firsts"), ["digest", "payload_bytes"]).filter(F.col("record_id") != F.col("first.record_id"))
    # a file has FILE_RECORDS records at most
    return joined.groupBy("file").agg(F.collect_list(F.struct("ordinal", F.col("first.page_id").alias("page_id"), F.col("first.record_id").alias("record_id"))).alias("of"))


def convert(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Write the records of ARC files as WARC, a file for a file: responses with their blocks, revisits with their headers only."""
    entries = staged(arc_entries(spark, arc_path), "entries")
    decided = staged(revisits(entries), "revisits")
    few = (decided.agg(F.sum(F.size("of"))).first()[0] or 0) <= SENT_REVISITS
    files = _arc_files(spark, arc_path).join(F.broadcast(decided) if few else decided, "file", "left").select("file", "content", "of.ordinal", "of.page_id", "of.record_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content, *of in zip(b.column(0).to_pylist(), b.column(1), *(c.to_pylist() for c in b.columns[2:]), strict=True):
                first = {k: (page, rid) for k, page, rid in zip(*(x or [] for x in of), strict=True)}
                roll = _Roll(CRLF + CRLF)
                for k, page, rid, f, block, at in _arc_rows(file, content):
                    if roll.full(len(block)):
                        yield roll.close()
                    if not roll.held:
                        info = b"software: verdictlab\r\nformat: WARC File Format 1.1\r\n"
                        roll.add(warc_record({"WARC-Type": "warcinfo", "WARC-Date": warc_date(EPOCH), "WARC-Record-ID": record_id("info", file, k), "Content-Type": "application/warc-fields"}, info))
                    fields = {"WARC-Type": "revisit" if k in first else "response", "WARC-Record-ID": rid, "WARC-Date": warc_date(f["Archive-date"]), "WARC-Target-URI": f["URL"], "WARC-IP-Address": f["IP-address"], "WARC-Payload-Digest": f"sha1:{digest32(block[at:])}", "X-Page-Id": page, "X-Payload-Length": len(block) - at, "Content-Type": "application/http; msgtype=response"}
                    if k in first:
                        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": first[k][1], "X-Refers-To-Page-Id": first[k][0]}
                        block = block[:at]
                    roll.add(warc_record(fields | {"WARC-Block-Digest": f"sha1:{digest32(block)}"}, block))
                if roll.held:
                    yield roll.close()

    _files(files.mapInArrow(run, "content binary"), warc_path, "\r\n\r\n")


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to, url, date, record_id.

    Digests are checked against the bytes that are there: each block's, and a response's payload.
    """
    ready(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, record_id string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for f, block in read_warc(GzipFile(fileobj=io.BytesIO(b.column(0)[i].as_buffer()))):
                    kind = f["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = split_http(block)[1]
                    if f"sha1:{digest32(block)}" != f["WARC-Block-Digest"] or kind == "response" and digest32(payload) != digest:
                        raise ValueError(f"the digest of {f['WARC-Record-ID']} doesn't hold")
                    size = len(payload) if kind == "response" else int(f["X-Payload-Length"])
                    rows.append((number(f.get("X-Page-Id")), size, digest, kind, number(f.get("X-Refers-To-Page-Id")), f["WARC-Target-URI"], f["WARC-Date"], f["WARC-Record-ID"]))
                columns = list(zip(*rows, strict=True)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as ARC, convert that to WARC, and read the WARC files: a row a page.

    Null html is empty; empty payloads are equal to each other. Repeated rows are records of their own, of which one is the response.
    A long page is one record, in a file of its own from FILE_BYTES on, which a task holds whole.
    An empty table gives no file and no row. Columns besides page_id, url and html are left out.
    """
    spark = pages.sparkSession
    folder = folder or fresh(spark, "archives")
    write_arc_files(pages, f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    return warc_records(spark, f"{folder}/warc")


#: The first five columns in DuckDB's SQL.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '00' AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
    (((strpos('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 + (5 * i) // 4, 1)) - 1) >> (3 - (5 * i) % 4)) & 31) AS BIGINT), 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
