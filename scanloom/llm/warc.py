"""WARC records in ZIP packages, written and read back by ranges.

A package is a ZIP file with stored members: ``archive/data.warc.gz`` (a gzip member a record), ``indexes/index.cdxj`` (a line
a record with its offset and length in the archive member) and ``datapackage.json``. The reader parses the end record, the
ZIP64 locator and record where they are needed, and the central directory, all by range reads from the file's end. It reads the
index by its range, and then ranges of records, which are spread over the tasks: nothing is extracted, and no
task reads a package whole.

Of records with equal payloads of ``min_bytes`` or more, the one with the smallest id is a response and the others are revisits
that refer to it and carry no payload. Equal payloads are found on narrow (id, hash) rows; a payload is shuffled once, by id.

Each task writes packages under names of its own and reports them; packages of failed attempts are never in the report.

Defined results: null html counts as an empty payload; rows with a null id are responses and never referred to; rows
that repeat the smallest id of a payload are all responses; an empty table gives no package and no record.
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
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import shared_folder, small_batches, stored

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri)) if ":" in uri else (pafs.LocalFileSystem(), uri)


def package_folder(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    return f"{shared_folder(spark)}/packages-{uuid.uuid4().hex}"


# Records


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """What a record says; a response's digest is taken from its payload and must agree with its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(re.search(rb"(?i)\r\nContent-Length: (\d+)", http)[1])
    kind, sha = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != declared or digest(payload) != sha):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't agree with its digest")

    def number(name: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(\d+|-\d+)>", fields.get(name, ""))
        return int(m[1]) if m else None

    return {
        "page_id": number("warc-record-id"),
        "url": fields.get("warc-target-uri"),
        "payload": payload if kind == "response" else None,
        "payload_bytes": declared,
        "payload_digest": sha,
        "record_type": kind,
        "refers_to": number("warc-refers-to"),
    }


# Packages


def pack(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ``zip64`` forces the large forms of their headers."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members:
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


class Package:
    """The members of a ZIP file that can be sought and read, found from its directories."""

    def __init__(self, file):
        self.file = file
        size = file.size() if callable(getattr(file, "size", None)) else file.seek(0, 2)
        tail_at = max(0, size - 65_557)
        tail = self.read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP file, or cut off")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = self.read(tail_at + end - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            large = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if large[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", large, 32)
        self.members: dict[str, tuple[int, int]] = {}
        directory, at = self.read(start, length), 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", directory, at + 10)[0]
            packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
            header = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                tag, n = struct.unpack_from("<HH", extra)
                if tag == 1:  # the large values, in this order, of those that are saturated
                    large, k = extra[4 : 4 + n], 0
                    if full == 0xFFFFFFFF:
                        full, k = struct.unpack_from("<Q", large, k)[0], k + 8
                    if packed == 0xFFFFFFFF:
                        packed, k = struct.unpack_from("<Q", large, k)[0], k + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", large, k)[0]
                extra = extra[4 + n :]
            if method == 0:
                local = self.read(header, 30)
                if local[:4] != b"PK\x03\x04":
                    raise ValueError(f"no local header of {name}")
                n_name_here, n_extra_here = struct.unpack_from("<HH", local, 26)
                self.members[name] = (header + 30 + n_name_here + n_extra_here, packed)
            at += 46 + n_name + n_extra + n_note

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        data = self.file.read(length)
        if len(data) != length:
            raise ValueError("the file ends early")
        return data


# Jobs


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, key, refers_to) of the records that only refer to an equal payload."""
    narrow = pages.where("page_id is not null and octet_length(payload) >= " + str(int(min_bytes))).select("page_id", "key")
    first = narrow.groupBy("key").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return narrow.join(first, "key").where("page_id <> refers_to").distinct()


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = 32 << 20) -> DataFrame:
    """Write (page_id, url, html) to ZIP packages in ``folder``; returns (path, n_records, n_bytes) of each, already written."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    known = revisits(rows, min_bytes).withColumnsRenamed({"page_id": "_id", "key": "_key"})
    rows = rows.join(known, (F.col("page_id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        held, size, index, written = [], 0, [], []

        def close() -> None:
            nonlocal held, size, index
            if held:
                name = f"{path}/{uuid.uuid4().hex}.wacz"
                about = json.dumps({"profile": "data-package", "resources": ["archive/data.warc.gz", "indexes/index.cdxj"]}).encode()
                data = pack([("archive/data.warc.gz", b"".join(held)), ("indexes/index.cdxj", "".join(index).encode()), ("datapackage.json", about)], zip64=True)
                with fs.open_output_stream(name) as f:
                    f.write(data)
                written.append((name, len(index), len(data)))
                held, size, index = [], 0, []

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                made = gzip.compress(record(page_id, url, payload, refers_to), 6, mtime=0)
                index.append(json.dumps({"id": page_id, "offset": size, "length": len(made)}) + "\n")
                held.append(made)
                size += len(made)
                if size >= package_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in written], pa.string()), *(pa.array([x[i] for x in written], pa.int64()) for i in (1, 2))], names=["path", "n_records", "n_bytes"])

    return stored(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "path string, n_records long, n_bytes long"))


def read_packages(packages: DataFrame, folder: str, range_bytes: int = 4 << 20, partitions: int | None = None) -> DataFrame:
    """Records of the packages in ``path``: (page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Ranges are dealt to ``partitions`` tasks by number, not by key: as many as there are ranges, but no more than the session has cores or 64 MB of
    archive ask for. A range's descriptor is tiny, so adaptive execution would fold any other shuffle of them into one task.
    """
    if partitions is None:
        cores, total = packages.sparkSession.sparkContext.defaultParallelism, packages.agg(F.sum("n_bytes")).first()[0] or 0
        partitions = max(1, min(-(-total // range_bytes), max(2 * cores, -(-total // (64 << 20)))))

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(folder)
        out = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    package = Package(f)
                    start, _ = package.members["archive/data.warc.gz"]
                    lengths, size = [], 0
                    for line in package.read(*package.members["indexes/index.cdxj"]).splitlines():
                        at = json.loads(line)
                        if not lengths:
                            first = at["offset"]
                        lengths.append(at["length"])
                        size += at["length"]
                        if size >= range_bytes:
                            out.append((path, start + first, lengths))
                            lengths, size = [], 0
                    if lengths:
                        out.append((path, start + first, lengths))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["path", "start", "lengths"]
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(folder)
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as f:
                    f.seek(start)
                    data = f.read(sum(lengths))
                rows, at = [], 0
                for n in lengths:
                    rows.append(parse_record(zlib.decompress(data[at : at + n], 31)))
                    at += n
                yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    spread = packages.select("path").mapInArrow(ranges, "path string, start long, lengths array<long>")
    return spread.repartition(partitions).mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


_ROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def op8_warc(pages: DataFrame) -> DataFrame:
    """Write every page, read the packages back."""
    folder = package_folder(pages.sparkSession)
    records = read_packages(write_packages(pages, folder), folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
