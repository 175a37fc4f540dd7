import base64
import gzip
import hashlib
import io
import zipfile

import pyarrow.fs
import pytest

from quietgrid.llm import warc_zip as Z
from quietgrid.llm.common import Scratch

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/\r\n", "é" * 5000), (6, "http://f/", "a\r\n\r\nb"), (6, "http://f2/", "<p>x</p>"), (None, "http://g/", "<p>x</p>"), (7, "http://h/", "z" * 3_000_000), (7, "http://h/", "y"), (8, "u", "y"), (8, "u", "y")]


def want(pages, least=0):
    out = []
    for i, _, html in pages:
        body = (html or "").encode()
        same = [j for j, _, h in pages if (h or "").encode() == body]
        largest = max((j for j in same if j is not None), default=None)
        revisit = len(body) >= least and len(same) > 1 and i != largest
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", largest if revisit else None))
    return sorted(out, key=str)


def table(spark, pages=PAGES):
    return spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, payload string, sha1 string").repartition(3)


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(spark, least):
    assert sorted([tuple(r) for r in Z.round_trip(table(spark), least=least).collect()], key=str) == want(PAGES, least)
    assert Z.round_trip(table(spark, [])).count() == 0


def test_archives_are_plain_zip_files(spark):
    scratch = Scratch(spark, "warctest")
    folder = f"{scratch.root}/archives"
    parts = scratch.write(Z.write(Z.with_revisits(table(spark), scratch), folder, archive_bytes=1000, part_bytes=300), "list")
    fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
    found = 0
    archives = parts.groupBy("path").agg({"records": "sum"}).withColumnRenamed("sum(records)", "records")
    assert 3 < archives.count() < parts.count()
    for row in archives.collect():
        with fs.open_input_file(row["path"]) as f:
            raw = f.read()
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            assert z.testzip() is None and z.namelist() == [Z.DATA, Z.INDEX]
            text = gzip.decompress(z.read(Z.DATA))
            assert text.count(b"WARC/1.1\r\nWARC-Type") == row["records"]
        mine = Z.members(io.BytesIO(raw), len(raw))
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            for name, (at, n) in mine.items():
                assert raw[at : at + n] == z.read(name)
        for head, payload in Z.records(row["path"], fs, read_bytes=100):
            found += 1
            assert head["WARC-Type"] == "revisit" or Z.digest(payload) == head["WARC-Payload-Digest"][5:]
    assert found == len(PAGES)
    for part in parts.collect():
        assert len(list(Z.records(part["path"], fs, part=(part["at"], part["length"])))) == part["records"] > 0
    assert sorted([tuple(r) for r in Z.read(parts, folder).collect()], key=str) == want(PAGES)


def test_reading_is_dealt_to_a_task_for_each_part(spark):
    """However small the rows that name the parts are."""
    assert Z.round_trip(table(spark).repartition(3)).rdd.getNumPartitions() == 3


def test_zip64_and_comments(monkeypatch):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"c" * 500
        with z.open("a", "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr("b", b"world")
    assert Z.members(out, len(out.getvalue())) == {n: (out.getvalue().index(t), 5) for n, t in (("a", b"hello"), ("b", b"world"))}
    for name, value in (("ZIP64_LIMIT", 1), ("ZIP_FILECOUNT_LIMIT", 1)):  # every size, offset and count in its ZIP64 form
        monkeypatch.setattr(zipfile, name, value)
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w", allowZip64=True) as z:
        for n in "abc":
            z.writestr(n, n.encode() * 9)
    assert b"PK\6\6" in big.getvalue()
    assert {n: big.getvalue()[a : a + k] for n, (a, k) in Z.members(big, len(big.getvalue())).items()} == {n: n.encode() * 9 for n in "abc"}
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    with pytest.raises(ValueError, match="not stored"):
        Z.members(packed, len(packed.getvalue()))
    with pytest.raises(ValueError, match="central directory"):
        Z.members(io.BytesIO(b"PK"), 2)
