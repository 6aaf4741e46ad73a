"""WARC records in ZIP packages: writer, and a reader that range-reads without extraction.

A package is a ZIP whose members are all stored: `archive/data.warc.gz` (one gzip member a record)
and `indexes/index.cdx` (a JSON line a record with its offset and length in the archive member).
The reader parses the end record, the ZIP64 locator and directory where present, the central
directory and the members' local headers, and then reads single records by byte range.

Packages are written by tasks to the shared folder under a name of their own attempt; only the
names that successful tasks return are read, so lost executors and repeated attempts do no harm.

Defined results: a null html is an empty payload; a null id is written and read back as null; rows
that repeat an id are separate records, and all rows with the id that answers for a payload are
responses; an empty table gives an empty result; other columns of the table are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocks

MIN_REVISIT_BYTES = 1000
ARCHIVE = "archive/data.warc.gz"
INDEX = "indexes/index.cdx"
DATE = "2024-01-01T00:00:00Z"
#: Index lines that one read task takes.
READ_RECORDS = 4096
#: Payloads with copies (about 100 bytes each) that may be broadcast.
BROADCAST_COPIES = 500_000
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_BIG = 0xFFFFFFFF


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class StoredZip:
    """Writes a ZIP of stored members to a stream; ZIP64 fields wherever a value needs them or `force64`."""

    def __init__(self, out: BinaryIO, force64: bool = False):
        self.out, self.at, self.force64 = out, 0, force64
        self.members: list[tuple[bytes, int, int, int]] = []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """The sizes follow the data in a descriptor (flag bit 3), so that members can be streamed."""
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        head = struct.pack("<4sHHHHHIIIHH", _LOCAL, 45, 0x0808, 0, 0, 0x21, 0, _BIG, _BIG, len(self.name), len(extra))
        self._write(head + self.name + extra)

    def add(self, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._write(data)

    def finish(self) -> None:
        self._write(struct.pack("<4sIQQ", b"PK\x07\x08", self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        begin = self.at
        for name, crc, size, start in self.members:
            big = self.force64 or size >= _BIG or start >= _BIG
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if big else b""
            size32, start32 = (_BIG, _BIG) if big else (size, start)
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, size32, size32, len(name), len(extra), 0, 0, 0, 0, start32) + name + extra)
        length, n = self.at - begin, len(self.members)
        if self.force64 or begin >= _BIG or length >= _BIG or n >= 0xFFFF:
            end64 = self.at
            self._write(struct.pack("<4sQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, length, begin))
            self._write(struct.pack("<4sIQI", _LOCATOR, 0, end64, 1))
            begin, length, n = _BIG, _BIG, 0xFFFF
        self._write(struct.pack("<4sHHHHIIH", _END, 0, 0, n, n, length, begin, 0))


def _read(source, at: int, size: int) -> bytes:
    source.seek(at)
    data = source.read(size)
    if len(data) != size:
        raise ValueError("package is cut short")
    return data


def members(source, total: int) -> dict[str, tuple[int, int]]:
    """Stored members of a package: name to (offset of its data, size)."""
    tail_at = max(0, total - 65_557)
    tail = _read(source, tail_at, total - tail_at)
    at = tail.rfind(_END)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, begin, _ = struct.unpack_from("<4sHHHHIIH", tail, at)
    if n == 0xFFFF or length == _BIG or begin == _BIG:
        locator = _read(source, tail_at + at - 20, 20)
        if locator[:4] != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        end64 = struct.unpack("<4sIQI", locator)[2]
        fields = struct.unpack("<4sQHHIIQQQQ", _read(source, end64, 56))
        if fields[0] != _END64:
            raise ValueError("no ZIP64 end record")
        n, length, begin = fields[7], fields[8], fields[9]
    directory, found, p = _read(source, begin, length), {}, 0
    for _ in range(n):
        (sign, _, _, _, method, _, _, _, packed, size, n_name, n_extra, n_note, _, _, _, start) = struct.unpack_from("<4sHHHHHHIIIHHHHHII", directory, p)
        if sign != _CENTRAL:
            raise ValueError("broken central directory")
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        p += 46 + n_name + n_extra + n_note
        if method != 0:
            continue  # only stored members can be range-read
        q = 0
        while q + 4 <= len(extra):
            kind, room = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                at64 = q + 4
                if size == _BIG:
                    size, at64 = struct.unpack_from("<Q", extra, at64)[0], at64 + 8
                if packed == _BIG:
                    packed, at64 = struct.unpack_from("<Q", extra, at64)[0], at64 + 8
                if start == _BIG:
                    start = struct.unpack_from("<Q", extra, at64)[0]
            q += 4 + room
        local = _read(source, start, 30)
        if local[:4] != _LOCAL:
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        found[name] = (start + 30 + n_name + n_extra, size)
    return found


def record_urn(page_id: int | str | None, salt: str = "") -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{salt}')}"


def digest_header(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def build_record(page_id: int | str | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | str | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; extension headers keep the page ids and the size."""
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record_urn(page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "about:blank").split()) or "about:blank"),
        ("WARC-Payload-Digest", digest_header(sha1)),
        *([] if page_id is None else [("X-Page-ID", json.dumps(page_id))]),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{record_urn(refers_to)}>"),
            ("X-Refers-To-Page-ID", json.dumps(refers_to)),
        ]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record; the digest of a response is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    body = rest[: int(headers["content-length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response" and digest_header(hashlib.sha1(payload).digest()) != headers["warc-payload-digest"]:
        raise ValueError("payload digest differs")
    return headers, payload


def write_package(out: BinaryIO, rows: Iterator[tuple]) -> list[int]:
    """Writes rows (page_id, url, html, refers_to, revisit) as one package; where in its index every
    READ_RECORDS-th record starts, and the index's end."""
    package = StoredZip(out)
    package.begin(ARCHIVE)
    lines, at, starts = io.BytesIO(), 0, []
    for n, (page_id, url, html, refers_to, revisit) in enumerate(rows):
        if n % READ_RECORDS == 0:
            starts.append(lines.tell())
        payload = (html or "").encode()
        sha1 = hashlib.sha1(payload).digest()
        data = gzip.compress(build_record(page_id, url, payload, sha1, refers_to, revisit), 3, mtime=0)
        lines.write(json.dumps({"id": page_id, "offset": at, "length": len(data)}).encode() + b"\n")
        package.add(data)
        at += len(data)
    package.finish()
    package.begin(INDEX)
    package.add(lines.getvalue())
    package.finish()
    package.close()
    return [*starts, lines.tell()]


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Packages of rows (page_id, url, html, refers_to, revisit): one a partition. Rows (path, first, size):
    byte ranges of a package's index, of READ_RECORDS records each."""

    def run(batches):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name = f"pages-{uuid.uuid4().hex}.wacz"

        def rows():
            for batch in blocks(batches, "html"):
                yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True)

        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            done = write_package(out, rows())
        if len(done) == 1:
            store.delete_file(f"{root}/{name}")
            return
        yield pa.RecordBatch.from_pydict({"path": [name] * (len(done) - 1), "first": pa.array(done[:-1], pa.int64()), "size": pa.array(np.diff(done), pa.int64())})

    return pages.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(run, "path string, first long, size long")


def read_packages(manifest: DataFrame, folder: str) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to), from byte ranges of packages."""

    def run(batches):
        store, root = open_store(folder)
        for batch in batches:
            for path, first, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out = [[], [], [], [], []]
                with store.open_input_file(f"{root}/{path}") as source:
                    where = members(source, source.size())
                    at, size = where[INDEX]
                    if first + length > size:
                        raise ValueError("index is cut short")
                    index = [json.loads(x) for x in _read(source, at + first, length).splitlines()]
                    at, _ = where[ARCHIVE]
                    for entry in index:
                        headers, payload = parse_record(gzip.decompress(_read(source, at + entry["offset"], entry["length"])))
                        revisit = headers["warc-type"] == "revisit"
                        page, answer = (None if h is None else str(json.loads(h)) for h in (headers.get("x-page-id"), headers.get("x-refers-to-page-id")))
                        sha1 = base64.b32decode(headers["warc-payload-digest"].partition(":")[2])
                        out[0].append(page)
                        out[1].append(int(headers["x-payload-length"]) if revisit else len(payload))
                        out[2].append(sha1.hex())
                        out[3].append(headers["warc-type"])
                        out[4].append(answer)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)

    return manifest.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def mark_revisits(pages: DataFrame, scratch: Scratch, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds refers_to and revisit: of equal payloads of at least `least` bytes the largest id answers.

    Payloads are grouped by their digests alone; only those that occur more than once are joined back,
    without moving the pages while there are BROADCAST_COPIES of them or fewer. Equality is by SHA-256.
    A null id never answers for others, and revisits the largest id of its payload if there is one.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.octet_length(html).alias("size"), F.sha2(html, 256).alias("key"))
    copies = (
        keyed.where(F.col("size") >= least)
        .groupBy("key")
        .agg(F.max("page_id").alias("answer"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("answer").isNotNull())
        .select("key", "answer")
    )
    copies = scratch.put(copies, "copies")
    few = copies.count() <= BROADCAST_COPIES
    joined = keyed.join(F.broadcast(copies) if few else copies, "key", "left")
    revisit = F.col("answer").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("answer")))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("answer")).alias("refers_to"), revisit.alias("revisit"))


def warc_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages as packages in the shared folder, then reads every record back."""
    scratch = Scratch(spark, "warc")
    folder = scratch.path("packages")
    kind = pages.schema["page_id"].dataType
    page_id = F.col("page_id") if isinstance(kind, T.IntegralType) else F.col("page_id").cast("string").alias("page_id")
    marked = mark_revisits(pages.select(page_id, "url", "html"), scratch)
    manifest = scratch.put(write_packages(marked, folder), "manifest")
    tasks = max(1, manifest.count())
    found = read_packages(manifest.repartition(tasks), folder)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
