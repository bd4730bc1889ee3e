"""Legacy archives to WARC: ARC files are parsed by their version's header line and declared
lengths, and equivalent WARC records are synthesised.

ARC: a file opens with a version block (`filedesc://`), whose first body line names the
version; version 1 record lines have 5 fields, version 2 lines have 10, the last one is the
length of what follows. The converter maps filedesc to warcinfo, http to response (revisit
where another record has the same payload), anything else to resource; the 14-digit time
becomes an ISO time, identifiers are UUIDs made from the record's number, digests are
base32 SHA-1.

Files are written and read by Spark only: an archive of bounded size is one row, written
with the text sink (its line separator is the archive's record end), read as a binary file.
A record is never split, so a single larger record makes a larger file.

Defined cases: null html is an empty payload; a null or empty url is `-`, white space in it is
percent-encoded; a null page_id gives a record without number: it is never the smallest id
unless all copies lack one; rows that repeat a page_id and its payload are all response, or
revisit the same smaller id; an empty table writes no archive; other columns are ignored.
A declared length beyond the end of the file or a line with too few fields is an error.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.common import prepare, raw_bytes
from orderlens.session import new_work_dir

ARCHIVE_BYTES = 8 << 20
ARCHIVE_DATE = "20240101000000"
LEAST_REVISIT_BYTES = 0
# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ARC_END, WARC_END = b"\n", b"\r\n\r\n"
NUMBER = b"X-Record-Number"

ARC_ROWS = "number long, url string, kind string, date string, ip string, mime string, head binary, payload binary, digest string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uuid(number: int | None, salt: bytes = b"") -> uuid.UUID:
    """A version-8 UUID that holds the 64-bit record number, or a hash where there is none."""
    if number is None:
        mixed = int.from_bytes(hashlib.sha1(salt).digest()[:16], "big")
        top, low = 0xFFFFFFFFFFFF, mixed & ((1 << 64) - 1)
    else:
        top, low = 0, number & ((1 << 64) - 1)
    value = (top << 80) | (8 << 76) | ((low >> 62) << 64) | (2 << 62) | (low & ((1 << 62) - 1))
    return uuid.UUID(int=value)


def record_number(identifier: uuid.UUID) -> int | None:
    if identifier.int >> 80:
        return None
    low = (((identifier.int >> 64) & 3) << 62) | (identifier.int & ((1 << 62) - 1))
    return low - (1 << 64) if low >> 63 else low


def http_block(number: int | None, payload: bytes) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
    if number is not None:
        head += NUMBER + b": %d\r\n" % number
    return head + b"\r\n" + payload


def header_of(block: bytes) -> dict[bytes, bytes]:
    """Field names in lower case; the first line is left out."""
    fields = {}
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


def arc_version_block(name: str, date: str, version: int = 1) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    extra = " 0 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def arc_record(url: str | None, date: str, block: bytes, version: int = 1, name: str = "-") -> bytes:
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "-")
    extra = f" 200 - - 0 {name}" if version == 2 else ""
    return f"{clean} 0.0.0.0 {date} text/html{extra} {len(block)}\n".encode() + block


def parse_arc(data: bytes) -> Iterator[tuple[list[str], bytes]]:
    """(fields of the record line, content) of every record. Only the first record of a file can
    be its version block; a later one of that scheme is an ordinary page."""
    version, at, opening = 1, 0, True
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : len(data) if end < 0 else end].decode("utf-8", "replace").rstrip("\r")
        fields = line.split(" ")
        opening = opening and line.startswith("filedesc://")
        if end < 0 or not fields[-1].isdigit() or (len(fields) < 5 if opening else len(fields) != len(ARC_FIELDS[version].split())):
            raise ValueError(f"no ARC record line of version {version} at byte {at}: {line[:80]!r}")
        begin, length = end + 1, int(fields[-1])
        if begin + length > len(data):
            raise ValueError(f"the record at byte {at} declares {length} bytes, {len(data) - begin} are left")
        content = data[begin : begin + length]
        if opening:
            version = int(content.split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
        opening = False
        yield fields, content
        at = begin + length


def warc_record(kind: str, identifier: uuid.UUID, date: str, block: bytes, mime: str, **more: str | None) -> bytes:
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{identifier}>",
        "WARC-Date": date,
        **{k.replace("_", "-"): v for k, v in more.items() if v is not None},
        "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
        "Content-Type": mime,
        "Content-Length": str(len(block)),
    }
    return "".join(["WARC/1.0\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode() + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = header_of(data[at:end])
        begin, length = end + 4, int(fields[b"content-length"])
        if begin + length > len(data):
            raise ValueError(f"the record at byte {at} declares {length} bytes")
        yield fields, data[begin : begin + length]
        at = begin + length
        if data[at : at + 4] != WARC_END:
            raise ValueError(f"the record at byte {at} has no end")
        at += 4


def iso_time(arc_date: str) -> str:
    d = arc_date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _archives(records: Iterable[bytes], opening: Callable[[int], bytes], end: bytes, most: int) -> Iterator[bytes]:
    """Records put together to archives of at most `most` bytes, or of one record; the last
    record's end is left to the sink."""
    parts: list[bytes] = []
    size = number = 0
    for record in records:
        if parts and size + len(record) > most:
            yield end.join(parts)
            parts, size = [], 0
        if not parts:
            parts, number = [opening(number)], number + 1
            size = len(parts[0])
        parts.append(record)
        size += len(record)
    if parts:
        yield end.join(parts)


def _write(archives: DataFrame, end: bytes, path: str) -> None:
    text = archives.select(F.col("archive").cast("string"))
    text.write.option("lineSep", end.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def _unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = ARCHIVE_BYTES) -> Iterator[pa.RecordBatch]:
    pending, size = [], 0
    for row in rows:
        pending.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes)) + 64
        if size >= most:
            yield _batch(pending, schema)
            pending, size = [], 0
    if pending:
        yield _batch(pending, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ARCHIVE = pa.schema([("archive", pa.binary())])


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = ARCHIVE_DATE) -> None:
    """Pages (page_id, url, html) as ARC files below `path`."""
    prepare(pages.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for number, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield arc_record(url, date, http_block(number, html), version)

        opening = lambda k: arc_version_block(f"{k:05d}.arc", date, version)
        yield from _batches(((a,) for a in _archives(records(), opening, ARC_END, ARCHIVE_BYTES)), _ARCHIVE, 1)

    frame = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), raw_bytes("html").alias("html"))
    _write(frame.mapInArrow(build, "archive binary"), ARC_END, path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ARC files below `path`, version blocks left out: ARC_ROWS."""
    prepare(spark)
    types = [pa.int64(), *[pa.string()] * 5, pa.binary(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in ARC_ROWS.split(", ")]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column(0):
                for place, (fields, block) in enumerate(parse_arc(_unpacked(content.as_py()))):
                    url, ip, date, mime = fields[:4]
                    if place == 0 and url.startswith("filedesc://"):
                        continue
                    kind, head, payload, number = "resource", b"", block, None
                    if block.startswith(b"HTTP/"):
                        kind = "response"
                        head, _, payload = block.partition(b"\r\n\r\n")
                        number = header_of(head).get(NUMBER.lower())
                    yield (None if number is None else int(number), url, kind, date, ip, mime, head, payload, payload_digest(payload))

    return _read(spark, path).mapInArrow(lambda batches: _batches(rows(batches), schema), ARC_ROWS)


def convert(spark: SparkSession, arc: str, warc: str, least_revisit: int = LEAST_REVISIT_BYTES) -> None:
    """The ARC files below `arc` as WARC files below `warc`.

    Of the http records with equal payloads the one with the smallest number keeps it. Only
    digests are grouped; payloads travel once, to meet the number their copy stands under.
    """
    records = read_arc(spark, arc)
    large = (F.col("kind") == "response") & (F.length("payload") >= least_revisit)
    first = records.where(large).groupBy("digest").agg(F.min("number").alias("first"), F.count("*").alias("copies"))
    first = first.where("copies > 1").select("digest", "first").checkpoint()
    joined = records.join(first, "digest", "left").select(*records.columns, F.when(large, F.col("first")).alias("first"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[bytes]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield _converted(row)

        def opening(k: int) -> bytes:
            body = b"software: legacy archive converter\r\nformat: WARC File Format 1.0\r\n"
            identifier = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo-{k}")
            return warc_record("warcinfo", identifier, iso_time(ARCHIVE_DATE), body, "application/warc-fields")

        yield from _batches(((a,) for a in _archives(out(), opening, WARC_END, ARCHIVE_BYTES)), _ARCHIVE, 1)

    _write(joined.mapInArrow(build, "archive binary"), WARC_END, warc)


def _converted(row: dict) -> bytes:
    number, first = row["number"], row["first"]
    salt = f"{row['url']} {row['date']} {row['digest']}".encode()
    identifier, date = record_uuid(number, salt), iso_time(row["date"])
    common = {"WARC_Target_URI": row["url"], "WARC_IP_Address": row["ip"], "WARC_Payload_Digest": f"sha1:{row['digest']}"}
    if row["kind"] == "resource":
        return warc_record("resource", identifier, date, row["payload"], row["mime"], **common)
    mime, head = "application/http; msgtype=response", row["head"] + b"\r\n\r\n"
    if first is not None and first != number:
        more = {"WARC_Refers_To": f"<urn:uuid:{record_uuid(first)}>", "WARC_Profile": REVISIT_PROFILE}
        return warc_record("revisit", identifier, date, head, mime, **common, **more)
    return warc_record("response", identifier, date, head + row["payload"], mime, **common)


WARC_ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files below `path`, warcinfo left out. The length of a revisited
    payload is that of its http header."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(field: bytes | None) -> int | None:
        return None if field is None else record_number(uuid.UUID(field.decode()[len("<urn:uuid:") : -1]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column(0):
                for fields, block in parse_warc(_unpacked(content.as_py())):
                    kind = fields[b"warc-type"].decode()
                    if kind == "warcinfo":
                        continue
                    size = len(block)
                    if kind != "resource":
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = len(payload) if kind == "response" else int(header_of(head)[b"content-length"])
                    digest = fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    yield (number(fields[b"warc-record-id"]), size, digest, kind, number(fields.get(b"warc-refers-to")))

    return _read(spark, path).mapInArrow(lambda batches: _batches(rows(batches), schema), WARC_ROWS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC, and read back from there."""
    spark = prepare(pages.sparkSession)
    if pages.isEmpty():
        return spark.createDataFrame([], WARC_ROWS)
    arc, warc = new_work_dir(spark, "arc"), new_work_dir(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    return read_warc(spark, warc)
