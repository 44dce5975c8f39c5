"""Legacy archive conversion: ARC records (versions 1 and 2) to WARC, and WARC reading.

An ARC record is one header line, whose last field declares the block's length,
and the block.  Version 1 lines are `URL IP date type length`; version 2 lines
put result code, checksum, location, offset and file name before the length.  The
converter makes WARC identifiers (a UUID of the page and its payload digest),
ISO timestamps from the 14-digit dates, record types and SHA-1 digests.

Archives are rows (archive, warc) of a Parquet table in the shared folder; a row
holds some megabytes of records.  Pages with equal payloads: that with the
smallest id is a response, the others revisit it and carry no payload.

Rules: a null html is an empty payload; a null url becomes `urn:page:<id>`; spaces
in a url are escaped; rows of one id with equal payloads are all responses or all
revisits, those with other payloads are judged by theirs; a null id is never a
revisit and nothing refers to it; very long pages are records of their own size; an
empty table gives no rows; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import sparkkit

ARCHIVE_BYTES = 4 << 20
_VERSIONS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_file(name: str, date: str, version: int, records: list[tuple[str, bytes]]) -> bytes:
    """An ARC file of (url, block) records."""
    about = b"%d 0 Collection\n%s\n" % (version, _VERSIONS[version])
    out: list[bytes] = []

    def add(url: str, kind: str, block: bytes) -> None:
        middle = "" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - {sum(map(len, out))} {name}"
        out.append(f"{url} 0.0.0.0 {date} {kind}{middle} {len(block)}\n".encode() + block + b"\n")

    add(f"filedesc://{name}", "text/plain", about)
    for url, block in records:
        add(url, "text/html", block)
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record but the file's own description."""
    at, names = 0, None
    while at < len(data):
        end = data.index(b"\n", at)
        fields = data[at:end].decode().split(" ")
        size = int(fields[-1])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError("an ARC record is shorter than it declares")
        at = end + 1 + size + 1
        if names is None:
            version = int(block.split(b" ", 1)[0])
            names = _VERSIONS[version].decode().split(" ")
            continue
        if len(fields) != len(names):
            raise ValueError(f"an ARC header line has {len(fields)} fields, not {len(names)}")
        yield dict(zip(names, fields, strict=True)), block


def _http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line), head + b"\r\n\r\n", payload


def warc_record(fields: dict[str, str], block: bytes, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit where it refers to another page."""
    http, head, payload = _http(block)
    url, d = fields["URL"], fields["Archive-date"]
    code = digest(payload)
    page = http.get("X-Page-Id", url)
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {code}')}>",
        f"WARC-Payload-Digest: sha1:{code}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to} {code}')}>",
            f"X-Refers-To-Page: {refers_to}",
        ]
        block = head
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        http, _, payload = _http(data[end + 4 : end + 4 + size])
        yield fields, http, payload
        at = end + 4 + size + 4


def _block(page_id, html: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page_id}\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html


def write_archives(pages: DataFrame, place: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> None:
    """Convert pages, by way of ARC files of both versions, to WARC archives at place."""
    pages = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    code = pages.select("id", F.sha1(F.col("html").cast("binary")).alias("code"))
    first = code.groupBy("code").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("code", "first")
    again = sparkkit.cut(code.join(first, "code").where("id > first").select("id", "code", "first").distinct())
    some = sparkkit.reduced(pages, again).withColumn("code", F.sha1(F.col("html").cast("binary"))).join(again, ["id", "code"], "left").select("id", "url", "html", "first")
    rest = sparkkit.reduced(pages, again, inverse=True).withColumn("first", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = made = 0

        def archive() -> pa.RecordBatch:
            version = 1 + made % 2
            name = f"part-{made:05d}.arc"
            arc = arc_file(name, date, version, [((u if u else f"urn:page:{i}").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D"), _block(i, h.encode("utf-8", "surrogatepass"))) for i, u, h, _ in held])
            warc = b"".join(warc_record(fields, block, None if to is None else str(to)) for (fields, block), (*_, to) in zip(read_arc(arc), held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([warc], pa.binary())], names=["archive", "warc"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size, made = [], 0, made + 1
        if held:
            yield archive()

    sparkkit.mapped(some.union(rest), run, "archive string, warc binary").write.option("compression", "zstd").parquet(place)


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), a row for each record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(0).to_pylist():
                for fields, http, payload in read_warc(data):
                    revisit = fields["WARC-Type"] == "revisit"
                    code = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and digest(payload) != code:
                        raise ValueError("a payload does not have its digest")
                    page = http["X-Page-Id"]
                    rows.append((None if page == "None" else int(page), fields["WARC-Target-URI"], int(http["Content-Length"]) if revisit else len(payload), code, fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if revisit else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return sparkkit.mapped(archives.select("warc"), run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def convert(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives of pages to a new place in the shared folder, and read them back."""
    spark = pages.sparkSession
    place = f"{sparkkit.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, place, id_col, url_col, html_col)
    return read_archives(spark.read.schema("archive string, warc binary").parquet(place))
