"""WARC: a converter of legacy ARC archives, and WARC files written and read by Spark.

An ARC file begins with a version block that says which header line its records
have: five fields (version 1) or ten (version 2); the last field is the length of
what follows. The converter reads by these declared lengths, and makes up what ARC
lacks: record identifiers (name-based, so a repeated task gives the same ones), ISO
timestamps, record types, and payload and block digests.

WARC files are written by Spark's text sink, one record per row with the two blank
lines of the format as line separator, one gzip stream a file (the sink has no
stream a record), and read back with the binary source by declared lengths, so any
file system of Spark's will do. A reader holds a compressed file and one record.

Payloads of at least ``least`` bytes that occur more than once are stored once, by
the row with the largest page_id (all rows with that id, if it repeats); others
refer to it. Null html is an empty payload, null urls are written as an empty
target; a row with a null page_id is a response unless an equal payload has an id.
Payloads are told apart by SHA-1 and length. Rows that repeat are records that
repeat and share their identifier. A very long page is one record within its task.
Other columns are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm import kernels as K

LEAST = 1000
FILE_BYTES = 16 << 20
# Fixed values of the two formats.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "20240101000000"
IP = "0.0.0.0"


def sha1(data: bytes) -> str:
    return hashlib.sha1(data, usedforsecurity=False).hexdigest()


@dataclass
class Record:
    """A WARC record: headers in order and block."""

    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def to_bytes(self) -> bytes:
        """Without the two blank lines that end a record."""
        lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in self.headers.items()), f"Content-Length: {len(self.block)}", "", ""]
        return "\r\n".join(lines).encode() + self.block

    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers, by lower-case name, and body of an HTTP block."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])), body


def arc_file(version: int, records: list[tuple[str, bytes]], name: str = "pages.arc") -> bytes:
    """An ARC file of the version: (url, network document) records."""
    about = f"{version} 0 Stratafold\n{' '.join(ARC_FIELDS[version])}\n".encode()
    out = []

    def add(url: str, kind: str, body: bytes) -> None:
        more = [str(sum(map(len, out))), name] if version == 2 else []
        fields = [url, IP, DATE, kind, *(["200", hashlib.md5(body, usedforsecurity=False).hexdigest(), "-", *more] if version == 2 else []), str(len(body))]
        out.append(" ".join(fields).encode() + b"\n" + body + b"\n")

    add(f"filedesc://{name}", "text/plain", about)
    for url, body in records:
        add(url, "text/html", body)
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record after the version block; a header without its fields or beyond the end raises ValueError."""
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at : stop if stop >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if names is None:
            # the version block's own line has the fields of version 1 or of version 2
            size = int(line.rsplit(" ", 1)[1])
            about = data[stop + 1 : stop + 1 + size].decode("ascii", "replace").split("\n")
            names = ARC_FIELDS[int(about[0].split()[0])]
        else:
            # an address may hold spaces, the other fields may not
            fields = line.rsplit(" ", len(names) - 1)
            if len(fields) != len(names):
                raise ValueError(f"not an ARC header line: {line[:200]!r}")
            size = int(fields[-1])
            if stop + 1 + size > len(data):
                raise ValueError("an ARC record is longer than its file")
            yield dict(zip(names, fields)), data[stop + 1 : stop + 1 + size]
        at = stop + 1 + size


def record_id(page_id: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def iso(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def to_warc(header: dict[str, str], body: bytes, least: int = LEAST, largest: int | None = None) -> Record:
    """The WARC record of an ARC record; ``largest`` is the largest page_id with this payload, None if the payload is not shared."""
    http = body[:5] == b"HTTP/"
    out = Record(block=body)
    fields, payload = out.http() if http else ({}, body)
    digest = sha1(payload)
    page = fields.get("x-page-id", "")
    revisit = largest is not None and len(payload) >= least and page != str(largest)
    out.headers = {
        "WARC-Type": "revisit" if revisit else "response" if http else "resource",
        "WARC-Record-ID": record_id(page or header["URL"], digest),
        "WARC-Date": iso(header["Archive-date"]),
        "WARC-Target-URI": header["URL"],
        "WARC-IP-Address": header["IP-address"],
        "WARC-Payload-Digest": f"sha1:{_b32(payload)}",
        "Content-Type": "application/http; msgtype=response" if http else header["Content-type"],
    }
    if revisit:
        out.block = body[: len(body) - len(payload)]
        out.headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(str(largest), digest), "X-Refers-To-Page-Id": str(largest)}
    out.headers["WARC-Block-Digest"] = f"sha1:{_b32(out.block)}"
    return out


def warc_records(data: bytes) -> Iterator[Record]:
    """The records of a WARC file, gzip-compressed or not, by their declared lengths."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:80]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        size = int(headers.pop("Content-Length"))
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a WARC record is longer than its file")
        yield Record(headers, block)
        stream.read(4)


def _network_document(page_id: int | None, html: bytes) -> bytes:
    number = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}Content-Length: {len(html)}\r\n\r\n".encode() + html


def write(pages: DataFrame, path: str, scratch: K.Scratch, least: int = LEAST, file_bytes: int = FILE_BYTES) -> None:
    """A WARC record per row of pages, by way of ARC files of either version."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A").alias("url"), body.cast("binary").alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    size = F.octet_length("html")
    shared = scratch.put(rows.where(size >= least).groupBy("digest", size.alias("bytes")).agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 and largest is not null").select("digest", "largest"))
    count, total = rows.agg(F.count("*"), F.sum(size + F.lit(600))).first()
    per_file = max(1, int(file_bytes * count / (total or 1)))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1
        for batch in batches:
            for part, block in K.blocks(batch, "html"):
                ids, urls, largest = (part.column(k).to_pylist() for k in (0, 1, 3))
                raw = block.data.tobytes()
                archive = arc_file(version, [(u, _network_document(i, raw[a:b])) for i, u, a, b in zip(ids, urls, block.offsets[:-1], block.offsets[1:])])
                out = [to_warc(header, body, least, top).to_bytes() for (header, body), top in zip(arc_records(archive), largest)]
                version = 3 - version
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    joined = rows.join(shared, "digest", "left").select("page_id", "url", "html", "largest")
    K.map_arrow(joined, convert, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read(spark, path: str) -> DataFrame:
    """Per record of the WARC files under path: page_id, payload_bytes, payload_digest (hexadecimal), record_type, refers_to."""

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def described(r: Record) -> tuple:
        fields, body = r.http()
        digest = base64.b32decode(r.headers["WARC-Payload-Digest"].partition(":")[2]).hex()
        if r.headers["WARC-Type"] == "response" and sha1(body) != digest:
            raise ValueError(f"the payload of {r.headers['WARC-Record-ID']} does not fit its digest")
        number, top = fields.get("x-page-id"), r.headers.get("X-Refers-To-Page-Id")
        return int(number) if number else None, int(fields["content-length"]), digest, r.headers["WARC-Type"], int(top) if top else None

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = [described(r) for r in warc_records(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kinds[k]) for k in range(5)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return K.map_arrow(files, parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as WARC, read the archives back, and remove them."""
    with K.Scratch(pages.sparkSession) as scratch:
        write(pages, f"{scratch.folder}/warc", scratch)
        return K.settled(read(pages.sparkSession, f"{scratch.folder}/warc"))
