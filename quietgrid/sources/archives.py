"""Members of archives and files of folders as the same rows, read by ranges of bytes in as many tasks as there are ranges."""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an archive that a task reads; bytes read at once; tasks at most; bytes that hold the end of any archive.
PART_BYTES, READ_BYTES, READERS, TAIL = 32 << 20, 4 << 20, 1 << 16, 65_557
_MEMBERS = "path string, part long, name string, method int, packed long, size long, crc long, header long"


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """values, in which all ones stand for what the ZIP64 field of an extra part holds."""
    at = 0
    while at + 4 <= len(extra):
        tag, n = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            return [next(wide) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + n
    return values


def directory(file, size: int, read_bytes: int = READ_BYTES) -> Iterator[tuple[str, int, int, int, int, int]]:
    """(name, method, packed bytes, bytes, CRC, where its local header is) of an archive's members, in its directory's order.

    The directory is read piece by piece. Offsets and sizes beyond 32 bits, and more than 65,535 members, come from ZIP64
    records. ValueError if it isn't such an archive.
    """
    file.seek(start := max(0, size - TAIL))
    tail = bytes(file.read(size - start))
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no archive: its end is not there")
    count, _, at = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        file.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        count, _, at = struct.unpack_from("<QQQ", bytes(file.read(56)), 32)
    held, cursor = b"", 0
    file.seek(at)

    def need(n: int) -> None:
        nonlocal held, cursor
        if len(held) - cursor < n:
            held, cursor = held[cursor:] + bytes(file.read(max(read_bytes, n))), 0
        if len(held) < n:
            raise ValueError("an archive's directory is cut short")

    for _ in range(count):
        need(46)
        if held[cursor : cursor + 4] != b"PK\x01\x02":
            raise ValueError("an archive's directory is damaged")
        method, crc, packed, full = *struct.unpack_from("<H", held, cursor + 10), *struct.unpack_from("<III", held, cursor + 16)
        names, extras, notes = struct.unpack_from("<HHH", held, cursor + 28)
        header = struct.unpack_from("<I", held, cursor + 42)[0]
        flags = struct.unpack_from("<H", held, cursor + 8)[0]
        need(46 + names + extras + notes)
        name = held[cursor + 46 : cursor + 46 + names].decode("utf-8" if flags & 2048 else "cp437")
        full, packed, header = _zip64(held[cursor + 46 + names : cursor + 46 + names + extras], [full, packed, header])
        cursor += 46 + names + extras + notes
        yield name, method, packed, full, crc, header


def member(file, name: str, method: int, packed: int, size: int, crc: int, header: int, read_bytes: int = READ_BYTES) -> bytes:
    """A stored or deflated member's bytes, checked against its size and CRC."""
    file.seek(header)
    local = bytes(file.read(30))
    if local[:4] != b"PK\x03\x04" or method not in (0, 8):
        raise ValueError(f"{name} is damaged, or packed in another way")
    file.seek(header + 30 + sum(struct.unpack_from("<HH", local, 26)))
    inflate, out = zlib.decompressobj(-15) if method else None, []
    for at in range(0, packed, read_bytes):
        piece = bytes(file.read(min(read_bytes, packed - at)))
        out.append(inflate.decompress(piece) if inflate else piece)
    content = b"".join(out) + (inflate.flush() if inflate else b"")
    if len(content) != size or zlib.crc32(content) != crc:
        raise ValueError(f"{name} is damaged")
    return content


def read_archives(spark: SparkSession, glob: str, pattern: str = ".*", part_bytes: int = PART_BYTES) -> DataFrame:
    """name, content of the members of ZIP archives whose names match, directories left out; a glob without files has no rows.

    One pass reads the directories, a task for some archives, and groups members whose headers are within a range of
    part_bytes; each range is then a row that a task reads. A damaged member or archive is an error.
    """
    files = spark.read.format("binaryFile").load(glob).select("path", "length")  # the contents aren't read

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, own = pyarrow.fs.FileSystem.from_uri(path)
                rows = []
                with fs.open_input_file(own) as file:
                    for name, method, packed, size, crc, header in directory(file, length):
                        rows.append((path, header // part_bytes, name, method, packed, size, crc, header))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    members = files.mapInArrow(listed, _MEMBERS).where(~F.col("name").endswith("/") & F.col("name").rlike(pattern))
    fields = F.struct("header", "name", "method", "packed", "size", "crc")
    parts = members.groupBy("path", "part").agg(F.sort_array(F.collect_list(fields)).alias("members"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, _, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as file:
                    for m in own:
                        yield pa.RecordBatch.from_arrays([pa.array([m["name"]]), pa.array([member(file, **m)], pa.binary())], names=["name", "content"])

    return parts.mapInArrow(read, "name string, content binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _MEMBERS.split(", ")])


def write_archives(members: DataFrame, root: str) -> DataFrame:
    """Writes members (name, content) to ZIP archives in a folder, deflated, an archive for each task; returns path, members.

    Archives get their names when they are complete, and those that the result names count: a task that runs again writes
    another. Tasks without rows write none.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        archive, n, at = None, 0, f"{base}/{uuid.uuid4().hex}.zip"
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive is None:
                    fs.create_dir(base, recursive=True)
                    file = fs.open_output_stream(f"{at}.part")
                    archive = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(name, content or b"")
                n += 1
        if archive:
            archive.close()
            file.close()
            fs.move(f"{at}.part", at)
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([n], pa.int64())], names=["path", "members"])

    rows = members.select("name", F.col("content").cast("binary")).mapInArrow(task, "path string, members long").collect()  # a row for each task
    return members.sparkSession.createDataFrame(rows, "path string, members long")


def read_folder(spark: SparkSession, root: str, pattern: str = ".*") -> DataFrame:
    """name (below the root), content of the files of a folder whose names match. Spark's reader passes over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].split(":", 1)[-1]
    name = F.regexp_replace(F.element_at(F.split("path", F.lit(_quoted(base) + "/"), 2), 2), "^/+", "")
    return files.select(name.alias("name"), "content").where(F.col("name").rlike(pattern))


def _quoted(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def read_members(spark: SparkSession, path: str, pattern: str = ".*", **options) -> DataFrame:
    """name, content: of an archive (or a glob of them) if the path ends in `.zip`, else of a folder; equal rows from either. Empty files have none."""
    rows = read_archives(spark, path, pattern, **options) if path.endswith(".zip") else read_folder(spark, path, pattern)
    return rows.where(F.octet_length("content") > 0)
