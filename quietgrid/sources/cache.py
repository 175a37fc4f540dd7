"""Frame caches as a data source: `.npy` videos scanned in ranges of bytes, in batch and as a stream, and a writer of them.

    spark.dataSource.register(FrameCache)
    spark.read.format("frame_cache").load("/data/cache")            # <root>/<scene>/<split>/<video>.npy
    spark.readStream.format("frame_cache").option("rate", "10").option("begin", "1700000000").load("/data/cache")

Files are reached through Arrow's file systems (local paths, hdfs, s3, ...); sources.frames.read_cache goes through Spark's
own reader instead, for stores that only Spark reaches.
"""

from __future__ import annotations

import io
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .frames import FRAMES

#: Bytes of frames that a task scans, and those that it reads at once; bytes that hold any header.
PART_BYTES, READ_BYTES, HEADER = 64 << 20, 8 << 20, 1 << 12
_SCHEMA = pa.schema([("scene", pa.string()), ("split", pa.string()), ("video", pa.string()), ("t", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("channels", pa.int32()), ("px", pa.binary())])


@dataclass
class FrameRange(InputPartition):
    """Frames first to stop - 1, `every` apart, of a file whose frames begin at a byte."""

    path: str
    name: tuple[str, str, str]
    shape: tuple[int, ...]
    begin: int
    first: int
    stop: int
    every: int = 1


def header(file) -> tuple[tuple[int, ...], int]:
    """(shape, first byte of the data) of an open `.npy` file of bytes in C order; ValueError for another."""
    start = io.BytesIO(bytes(file.read(HEADER)))
    version = np.lib.format.read_magic(start)
    shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(start)
    if kind != np.uint8 or by_column or len(shape) not in (3, 4):
        raise ValueError(f"frames are (N, H, W) or (N, H, W, 3) bytes, not {kind} of {shape}")
    return shape, start.tell()


def videos(root: str, split: str | None = None) -> list[FrameRange]:
    """The whole of each video under a root, by name. Headers alone are read."""
    fs, base = pyarrow.fs.FileSystem.from_uri(root)
    found = []
    for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True)), key=lambda i: i.path):
        parts = info.path[len(base) :].strip("/").split("/")
        if info.is_file and len(parts) == 3 and parts[2].endswith(".npy") and split in (None, parts[1]):
            with fs.open_input_file(info.path) as file:
                shape, begin = header(file)
            found.append(FrameRange(info.path, (parts[0], parts[1], parts[2][:-4]), shape, begin, 0, shape[0]))
    return found


def ranges(video: FrameRange, first: int, stop: int, part_bytes: int = PART_BYTES, every: int = 1) -> list[FrameRange]:
    """A video's frames first to stop - 1, in parts of so many bytes or of one frame."""
    size = max(1, int(np.prod(video.shape[1:])))
    step = max(1, part_bytes // size // every) * every
    first = -(-first // every) * every
    return [FrameRange(video.path, video.name, video.shape, video.begin, at, min(at + step, stop), every) for at in range(first, stop, step)]


def read_range(root: str, part: FrameRange, read_bytes: int = READ_BYTES) -> Iterator[pa.RecordBatch]:
    """A range's frames, a few at a time: memory doesn't grow with the file or the range."""
    fs, _ = pyarrow.fs.FileSystem.from_uri(root)
    h, w = part.shape[1:3]
    channels = part.shape[3] if len(part.shape) == 4 else 1
    size = h * w * channels
    with fs.open_input_file(part.path) as file:
        wanted = range(part.first, part.stop, part.every)
        at_once = max(1, read_bytes // max(1, size))
        for k in range(0, len(wanted), at_once):
            own = wanted[k : k + at_once]
            px = []
            for t in own:
                if part.every > 1 or t == own[0]:
                    file.seek(part.begin + t * size)
                px.append(bytes(file.read(size)))
                if len(px[-1]) != size:
                    raise ValueError(f"{part.path} is cut short")
            n = len(own)
            yield pa.RecordBatch.from_arrays([*(pa.array([v] * n, pa.string()) for v in part.name), pa.array(own, pa.int32()), *(pa.array([v] * n, pa.int32()) for v in (h, w, channels)), pa.array(px, pa.binary())], schema=_SCHEMA)


class FrameCache(DataSource):
    """Options: path; split (all by default); partBytes; every (each n-th frame); for streams rate (frames a second) and begin (seconds since 1970)."""

    @classmethod
    def name(cls) -> str:
        return "frame_cache"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Options:
    def __init__(self, options):
        self.root, self.split = options["path"], options.get("split")
        self.part_bytes, self.every = int(options.get("partBytes", PART_BYTES)), int(options.get("every", 1))
        self.rate, self.begin = float(options.get("rate", 0)), float(options.get("begin", 0))

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        return read_range(self.root, partition)


class _Reader(_Options, DataSourceReader):
    def partitions(self) -> Sequence[FrameRange]:
        return [r for v in videos(self.root, self.split) for r in ranges(v, 0, v.stop, self.part_bytes, self.every)]


class _Stream(_Options, DataSourceStreamReader):
    """Offsets are the frames that each video has given. With a rate, frame i of a video is there (i + 1) / rate seconds after `begin`.

    So what there is depends on the clock alone and never falls: a restart goes on from its checkpoint at the same rate.
    """

    def initialOffset(self) -> dict:
        return {}

    def _there(self, n: int) -> int:
        return n if not self.rate else max(0, min(n, int((time.time() - self.begin) * self.rate)))

    def latestOffset(self) -> dict:
        return {"/".join(v.name): self._there(v.stop) for v in videos(self.root, self.split)}

    def partitions(self, start: dict, end: dict) -> Sequence[FrameRange]:
        found = {"/".join(v.name): v for v in videos(self.root, self.split)}
        return [r for name, stop in end.items() for r in ranges(found[name], start.get(name, 0), stop, self.part_bytes, self.every)]


def write_cache(frames: DataFrame, root: str) -> DataFrame:
    """Writes `<root>/<scene>/<split>/<video>.npy` files; returns (scene, split, video, frames) of what was written.

    frames as read_cache() and the source return them; those of a video have one size, and t numbers them from 0 without
    gaps. A task writes one video after another and holds one frame. A file gets its name when it is complete, so a task
    that runs again replaces it with an equal one.
    """
    keys = ["scene", "split", "video"]
    sized = frames.join(frames.groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    dealt = sized.repartition(*keys).sortWithinPartitions(*keys, "t").select(*keys, "t", "h", "w", "channels", "px", "_n")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        now, file, at, done = None, None, "", []

        def close():
            if file is not None:
                file.close()
                fs.move(at, f"{base}/{'/'.join(now[:3])}.npy")

        for batch in batches:
            for scene, split, video, t, h, w, channels, px, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[:3] != (scene, split, video):
                    close()
                    now, folder = (scene, split, video, h, w, channels), f"{base}/{scene}/{split}"
                    fs.create_dir(folder, recursive=True)
                    at = f"{folder}/.{video}-{uuid.uuid4().hex}"
                    file, expected = fs.open_output_stream(at), 0
                    head = io.BytesIO()
                    np.lib.format.write_array_header_1_0(head, {"descr": "|u1", "fortran_order": False, "shape": (n, h, w, 3) if channels == 3 else (n, h, w)})
                    file.write(head.getvalue())
                    done.append((scene, split, video, n))
                if (h, w, channels) != now[3:] or t != expected:
                    raise ValueError(f"frame {t} of {video} has another size or place")
                file.write(px)
                expected += 1
        close()
        columns = list(zip(*done, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=[*keys, "frames"])

    rows = dealt.mapInArrow(task, "scene string, split string, video string, frames long").collect()  # a row for each video
    return frames.sparkSession.createDataFrame(rows, "scene string, split string, video string, frames long")
