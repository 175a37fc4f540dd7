"""WARC records in ZIP packages: a writer, and a reader that takes records by range without extracting anything.

An archive is a ZIP file with two stored members: `archive/data.warc.gz`, one gzip member per WARC record, and
`indexes/index.cdxj`, a line per record with its offset and length in the data member. The reader parses the end of the
central directory (and its ZIP64 form), the central directory and the local headers, which locate the stored members; it
then reads the index and the records as ranges of the archive file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of compressed records after which a task begins another archive, and those after which another task reads on;
#: bytes that the reader asks for at once; read tasks at most.
ARCHIVE_BYTES, PART_BYTES, READ_BYTES, READERS = 256 << 20, 32 << 20, 4 << 20, 1 << 16
_DATE = "1970-01-01T00:00:00Z"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record. A revisit has no payload; it names the record it refers to and the full payload's size."""
    urn = lambda i: f"<urn:page:{'' if i is None else i}>"
    uri = (url or "urn:page:unknown").replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    if revisit:
        head += [("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", str(len(payload)))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record, by its Content-Length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]):
        raise ValueError("a WARC record is cut short")
    return headers, block.partition(b"\r\n\r\n")[2]


def members(file, size: int) -> dict[str, tuple[int, int]]:
    """{name: (first byte, length)} of the stored members of a ZIP file that can seek and read; other members are errors.

    Sizes and offsets that don't fit 32 bits, and counts that don't fit 16, come from the ZIP64 records.
    """

    def at(offset: int, length: int) -> bytes:
        file.seek(offset)
        return bytes(file.read(length))

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    if tail_at + end >= 20 and (locator := at(tail_at + end - 20, 20))[:4] == b"PK\6\7":
        end64 = at(struct.unpack("<Q", locator[8:16])[0], 56)
        if end64[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of a central directory")
        count, length, offset = struct.unpack("<QQQ", end64[32:56])
    directory, p, out = at(offset, length), 0, {}
    for _ in range(count):
        if directory[p : p + 4] != b"PK\1\2":
            raise ValueError("a central directory is damaged")
        method, packed, full, n_name, n_extra, n_comment = *struct.unpack("<H", directory[p + 10 : p + 12]), *struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        header = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[q + 4 : q + 4 + n // 8 * 8]))
                full, packed, header = (next(wide) if v == 0xFFFFFFFF else v for v in (full, packed, header))
            q += 4 + n
        if method != 0 or full != packed:
            raise ValueError(f"{name} is not stored")
        local = at(header, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError(f"no local header of {name}")
        out[name] = (header + 30 + sum(struct.unpack("<HH", local[26:30])), full)
        p += 46 + n_name + n_extra + n_comment
    return out


class _Archive:
    """A ZIP package under way. Its index is written when the records are complete."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, part_bytes: int = PART_BYTES):
        self.path, self.index, self.written, self.part_bytes = path, [], 0, part_bytes
        #: of each part: where it begins in the index, its bytes there, its records
        self.parts, self.full = [], 0
        self.file = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, key: int | None, raw: bytes) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        self.data.write(packed)
        line = json.dumps({"page_id": key, "offset": self.written, "length": len(packed)}).encode() + b"\n"
        self.index.append(line)
        if not self.parts or self.written >= self.full:
            self.parts.append([sum(self.parts[-1][:2]) if self.parts else 0, 0, 0])
            self.full = self.written + self.part_bytes
        self.parts[-1][1] += len(line)
        self.parts[-1][2] += 1
        self.written += len(packed)

    def close(self) -> list[tuple[str, int, int, int]]:
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as out:
            out.writelines(self.index)
        self.zip.close()
        self.file.close()
        return [(self.path, *part) for part in self.parts]


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes pages (page_id, url, payload, sha1, refers_to, revisit) to archives in a folder that all executors share.

    Each task writes archives under names of its own; a task that runs again writes others, and only the names that the
    returned rows hold count. These are the parts that a reader's task takes: path, at and length in the index, records.
    The result must be kept (not evaluated twice).
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for page_id, url, payload, sha1, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    fs.create_dir(root, recursive=True)
                    archive = _Archive(fs, f"{root}/{uuid.uuid4().hex}.zip", part_bytes)
                archive.add(page_id, record(page_id, url, payload, sha1, refers_to, revisit))
                if archive.written >= archive_bytes:
                    done += archive.close()
                    archive = None
        if archive:
            done += archive.close()
        columns = list(zip(*done, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "at", "length", "records"])

    return pages.select("page_id", "url", "payload", "sha1", "refers_to", "revisit").mapInArrow(task, "path string, at long, length long, records long")


def records(path: str, fs: pyarrow.fs.FileSystem, read_bytes: int = READ_BYTES, part: tuple[int, int] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one archive, or of a part of its index (at, length): neighbouring ranges are read together, and nothing is extracted."""
    with fs.open_input_file(path) as file:
        found = members(file, file.size())
        start, length = found[INDEX]
        if part:
            start, length = start + part[0], part[1]
        entries, rest, at = [], b"", start
        while at < start + length or rest:
            file.seek(at)
            chunk = bytes(file.read(min(read_bytes, start + length - at))) if at < start + length else b"\n"
            at += len(chunk) if at < start + length else 0
            *lines, rest = (rest + chunk).split(b"\n")
            entries += [(e["offset"], e["length"]) for e in map(json.loads, filter(None, lines))]
        base, i = found[DATA][0], 0
        while i < len(entries):
            j, first = i + 1, entries[i][0]
            while j < len(entries) and entries[j][0] == sum(entries[j - 1]) and sum(entries[j]) - first <= read_bytes:
                j += 1
            file.seek(base + first)
            ranged = memoryview(bytes(file.read(sum(entries[j - 1]) - first)))
            for offset, n in entries[i:j]:
                yield parse(zlib.decompress(ranged[offset - first : offset - first + n], 31))
            i = j


def read(archives: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of parts of archives (path, at, length).

    A response's size and digest are taken from its payload, and must agree with its header; a revisit's are its header's.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        page = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None
        for batch in batches:
            for path, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for head, payload in records(path, fs, part=part):
                    revisit, sha1 = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and digest(payload) != sha1:
                        raise ValueError(f"a payload in {path} doesn't have its digest")
                    rows.append((page(head["WARC-Record-ID"]), int(head["X-Payload-Length"]) if revisit else len(payload), sha1, head["WARC-Type"], page(head["WARC-Refers-To"]) if revisit else None))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return archives.select("path", "at", "length").mapInArrow(task, _RECORD)


def with_revisits(pages: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """pages as write() takes them. Of equal payloads of `least` bytes or more, that with the largest page_id is a response."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("_hex"))
    largest = scratch.write(rows.where(F.octet_length("payload") >= least).groupBy("_hex").agg(F.max("page_id").alias("_largest"), F.count("*").alias("_n")).where("_n > 1"), "equal")
    rows = rows.join(largest, "_hex", "left")
    revisit = F.col("_n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_largest"))
    b32 = _base32(F.col("_hex"))
    return rows.select("page_id", "url", "payload", b32.alias("sha1"), F.when(revisit, F.col("_largest")).alias("refers_to"), revisit.alias("revisit"))


def _base32(hex_digest):
    """40 hexadecimal digits as 32 of base32 (upper case, bare): 5 digits are 4."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for i in range(8):
        value = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substr(F.lit(letters), (F.shiftright(value, 15 - 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(4)]
    return F.concat(*parts)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Writes a record per row of pages to archives, then reads them: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The payload is the html in UTF-8 (null: empty). Revisits have the response's page_id in refers_to, responses null. Rows
    that share the largest page_id of a payload are all responses; a null page_id is less than any other. Null urls get a
    placeholder; other columns are not read; no rows give no archives and no rows. Archives stay in the shared folder.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = f"{scratch.root}/archives"
    rows = with_revisits(pages, scratch, page_id, url, html, least)
    archives = scratch.write(write(rows, folder), "archives")
    # a task for each part; a number that is asked for isn't lowered because the rows are small
    return read(archives.repartition(min(READERS, max(1, archives.count()))), folder)


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS largest FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, i // 4 * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31) + 1, 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM m
"""
