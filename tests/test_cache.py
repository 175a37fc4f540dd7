"""Frame caches scanned by ranges, in batch and as a stream; archives and folders as the same rows; labels and results."""

import io
import json
import time
import zipfile

import numpy as np
import pytest

from quietgrid.sources import archives as A
from quietgrid.sources import cache as C
from quietgrid.sources.frames import FRAMES, read_cache, read_labels, read_results
from quietgrid.sources.sinks import write_json, write_labels, write_results


def frames(seed=0, sizes=(("s1", "train", "v1", 7), ("s1", "test", "v2", 3), ("s2", "train", "v1", 1))):
    rng = np.random.default_rng(seed)
    return [(scene, split, video, t, 4, 5, 1, bytes(rng.integers(0, 256, 20, np.uint8))) for scene, split, video, n in sizes for t in range(n)]


def rows(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=str)


def test_round_trip_in_ranges(spark, tmp_path):
    every, root = frames(), str(tmp_path / "cache")
    written = C.write_cache(spark.createDataFrame(every, FRAMES).repartition(3), root)
    assert sorted(tuple(r) for r in written.collect()) == [("s1", "test", "v2", 3), ("s1", "train", "v1", 7), ("s2", "train", "v1", 1)]
    assert np.load(f"{root}/s1/train/v1.npy").shape == (7, 4, 5)
    spark.dataSource.register(C.FrameCache)
    for part_bytes in (1, 45, 10**6):
        df = spark.read.format("frame_cache").option("partBytes", part_bytes).load(root)
        assert rows(df) == sorted(every, key=str)
    assert df.rdd.getNumPartitions() == 3
    assert spark.read.format("frame_cache").option("partBytes", 1).load(root).rdd.getNumPartitions() == 11
    assert rows(spark.read.format("frame_cache").option("split", "test").load(root)) == sorted((r for r in every if r[1] == "test"), key=str)
    assert rows(spark.read.format("frame_cache").option("every", 3).option("partBytes", 30).load(root)) == sorted((r for r in every if r[3] % 3 == 0), key=str)
    assert rows(read_cache(spark, root)) == sorted(every, key=str)
    assert C.write_cache(spark.createDataFrame([], FRAMES), str(tmp_path / "none")).count() == 0


def test_colour_and_odd_files(spark, tmp_path):
    (tmp_path / "s" / "train").mkdir(parents=True)
    np.save(tmp_path / "s" / "train" / "c.npy", np.arange(2 * 2 * 2 * 3, dtype=np.uint8).reshape(2, 2, 2, 3))
    spark.dataSource.register(C.FrameCache)
    got = rows(spark.read.format("frame_cache").load(str(tmp_path)))
    assert [r[3:7] for r in got] == [(0, 2, 2, 3), (1, 2, 2, 3)] and got[1][7] == bytes(range(12, 24))
    np.save(tmp_path / "s" / "train" / "f.npy", np.zeros((1, 2, 2)))
    with pytest.raises(ValueError, match="bytes"):
        C.videos(str(tmp_path))


def test_a_task_reads_its_range_of_a_large_file(tmp_path):
    """A file of 3 GB without data on disk: a range is read without the rest."""
    folder = tmp_path / "s" / "train"
    folder.mkdir(parents=True)
    large = np.lib.format.open_memmap(folder / "v.npy", mode="w+", dtype=np.uint8, shape=(3000, 1000, 1000))
    large[2990] = 7
    del large
    (video,) = C.videos(str(tmp_path))
    parts = C.ranges(video, 0, video.stop)
    assert len(parts) == -(-3000 // 67) and max(p.stop - p.first for p in parts) * 10**6 <= C.PART_BYTES
    (part,) = (p for p in parts if p.first <= 2990 < p.stop)
    for batch in C.read_range(str(tmp_path), part):
        assert batch.num_rows <= 8
        for t, px in zip(batch["t"].to_pylist(), batch["px"].to_pylist(), strict=True):
            assert len(px) == 10**6 and px[0] == (7 if t == 2990 else 0)


def test_stream_by_the_clock_and_over_restarts(spark, tmp_path):
    every, root = frames(1), str(tmp_path / "cache")
    C.write_cache(spark.createDataFrame(every, FRAMES), root)
    spark.dataSource.register(C.FrameCache)

    def run(**options):
        stream = spark.readStream.format("frame_cache").options(**options).load(root)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        return rows(spark.read.schema(FRAMES).parquet(str(tmp_path / "out")))

    began = time.time() - 240  # at a frame in 100 seconds two frames of each video are there
    first = run(rate=0.01, begin=began)
    assert {r for r in every if r[3] < 2} <= set(first) and len(first) == len(set(first)) < len(every)
    assert run(rate=0.01, begin=began - 6000) == sorted(every, key=str)
    C.write_cache(spark.createDataFrame([("s3", "test", "new", 0, 4, 5, 1, bytes(20))], FRAMES), root)
    assert len(run(rate=0.01, begin=began - 6000)) == len(every) + 1


def archive(path, names, method):
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("folder/", b"")
        for n, content in names.items():
            z.writestr(n, content)


NAMES = {"a.txt": b"", "folder/b.txt": b"bb" * 1000, "folder/deep/ü c.txt": bytes(range(256)) * 300, "d.bin": b"\x00\x01", "folder/e.txt": b"e"}


def test_folders_and_archives_give_equal_rows(spark, tmp_path):
    archive(tmp_path / "stored.zip", NAMES, zipfile.ZIP_STORED)
    archive(tmp_path / "packed.zip", NAMES, zipfile.ZIP_DEFLATED)
    want = sorted(NAMES.items())
    for name in ("stored.zip", "packed.zip"):
        for part_bytes in (100, 10**6):
            df = A.read_archives(spark, str(tmp_path / name), part_bytes=part_bytes)
            assert sorted((r["name"], bytes(r["content"])) for r in df.collect()) == want
    for n, content in NAMES.items():
        (tmp_path / "plain" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "plain" / n).write_bytes(content)
    for path in (tmp_path / "plain", tmp_path / "packed.zip"):
        got = sorted((r["name"], bytes(r["content"])) for r in A.read_members(spark, str(path), r"\.txt$").collect())
        assert got == [x for x in want if x[0].endswith(".txt") and x[1]]


def packed(method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = b"PK" * 100
        for n, content in NAMES.items():
            with z.open(n, "w", force_zip64=True) as f:
                f.write(content)
    return out


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
@pytest.mark.parametrize("limit", [None, 1])
def test_directories_of_every_form(monkeypatch, method, limit):
    if limit:  # every size, offset and count in its ZIP64 form
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", limit)
    out = packed(method)
    assert (b"PK\x06\x06" in out.getvalue()) == bool(limit)
    found = list(A.directory(out, len(out.getvalue()), read_bytes=50))
    assert {m[0]: A.member(out, *m, read_bytes=100) for m in found} == NAMES


def test_damaged_archives():
    with pytest.raises(ValueError, match="no archive"):
        list(A.directory(io.BytesIO(b"PK"), 2))
    raw = packed(zipfile.ZIP_STORED).getvalue()
    found = list(A.directory(io.BytesIO(raw), len(raw)))
    broken = bytearray(raw)
    broken[raw.index(b"bbbb")] = 0
    (member,) = (m for m in found if m[0] == "folder/b.txt")
    with pytest.raises(ValueError, match="damaged"):
        A.member(io.BytesIO(bytes(broken)), *member)
    with pytest.raises(ValueError, match="cut short|damaged"):
        list(A.directory(io.BytesIO(raw[:2000] + raw[-222:]), 2222))


def test_written_archives_come_back(spark, tmp_path):
    df = spark.createDataFrame([(n, c) for n, c in NAMES.items()], "name string, content binary").repartition(2)
    made = A.write_archives(df, str(tmp_path / "z"))
    assert sum(r["members"] for r in made.collect()) == len(NAMES)
    assert sorted((r["name"], bytes(r["content"])) for r in A.read_archives(spark, str(tmp_path / "z" / "*.zip")).collect()) == sorted(NAMES.items())
    assert A.write_archives(df.where("false"), str(tmp_path / "none")).count() == 0


def test_labels_and_results_come_back(spark, tmp_path):
    labels = [("s1", "v1", 0, 1), ("s1", "v1", 1, 0), ("s1", "v2", 0, 0), ("s2", "v1", 0, 1)]
    write_labels(spark.createDataFrame(labels, "scene string, video string, t int, y tinyint"), str(tmp_path))
    assert json.loads((tmp_path / "s1" / "gt.json").read_text()) == {"v1": [1, 0], "v2": [0]}
    assert sorted(tuple(r) for r in read_labels(spark, str(tmp_path / "*" / "gt.json")).collect()) == labels
    results = [("r1", "frx", "median", 0.9, 0.1), ("r1", "frx", "raw", 0.8, 0.2), ("r2", "rem", "raw", 0.5, None)]
    write_results(spark.createDataFrame(results, "run string, detector string, post string, auc double, eer double"), str(tmp_path / "runs"))
    got = sorted(tuple(r) for r in read_results(spark, str(tmp_path / "runs" / "*" / "eval" / "results.json")).collect())
    assert got == sorted(results)


def test_json_lines(spark, tmp_path):
    write_json(spark.createDataFrame([(1, "a\n"), (2, None)], "i int, s string"), str(tmp_path / "j"))
    assert sorted(tuple(r) for r in spark.read.schema("i int, s string").json(str(tmp_path / "j")).collect()) == [(1, "a\n"), (2, None)]
