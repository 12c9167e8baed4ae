"""Archives read in place by seeks, and damage that stays in its row."""

import io
import resource
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sieveline.plans import fixtures
from sieveline.sources import archives, containers

METHODS = {"stored": zipfile.ZIP_STORED, "deflated": zipfile.ZIP_DEFLATED, "bzip2": zipfile.ZIP_BZIP2, "lzma": zipfile.ZIP_LZMA}


def zipped(members, method=zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def rows(df):
    return {(r.archive.rpartition("/")[2], r.path): r for r in df.collect()}


@pytest.fixture
def tree(tmp_path):
    body = bytes(range(256)) * 40
    for name, method in METHODS.items():
        (tmp_path / f"{name}.zip").write_bytes(zipped([("a/one.txt", b"one"), ("two.bin", body), ("dir/", b"")], method))
    for mode, name in (("w:", "plain.tar"), ("w:gz", "g.tar.gz"), ("w:xz", "x.tar.xz")):
        (tmp_path / name).write_bytes(fixtures.tarred([("n" * 150 + ".txt", "long name"), ("b.txt", "bee")], mode))
    (tmp_path / "bad.zip").write_bytes(b"PK\x03\x04 nothing more")
    (tmp_path / "empty.zip").write_bytes(zipped([]))
    (tmp_path / "other.txt").write_text("no archive")
    return tmp_path, body


def test_members_are_listed_and_read_in_place(spark, tree):
    root, body = tree
    got = rows(archives.archive_members(spark, f"file://{root}", content=True))
    for name in METHODS:
        assert got[f"{name}.zip", "a/one.txt"].content == b"one" and got[f"{name}.zip", "two.bin"].content == body
        assert got[f"{name}.zip", "dir/"].is_dir and got[f"{name}.zip", "dir/"].content is None
    for name in ("plain.tar", "g.tar.gz", "x.tar.xz"):
        assert got[name, "b.txt"].content == b"bee" and got[name, "n" * 150 + ".txt"].content == b"long name"
        assert (got[name, "b.txt"].byte_offset is None) == (name != "plain.tar")
    assert "BadZipFile" in got["bad.zip", None].error and len(got) == 4 * 3 + 3 * 2 + 1
    listed = archives.archive_members(spark, str(root)).collect()
    assert all(r.content is None for r in listed) and len(listed) == len(got)
    assert {r.path for r in archives.safe_members(archives.archive_members(spark, str(root))).collect()} >= {"a/one.txt", "b.txt"}


def test_large_archives_are_dealt_to_partitions(spark, tmp_path):
    body = [(f"m{i:03d}", bytes([i % 256]) * 3000) for i in range(100)]
    (tmp_path / "a.zip").write_bytes(zipped(body, zipfile.ZIP_STORED))
    (tmp_path / "b.tar").write_bytes(fixtures.tarred([(n, d.decode("latin-1") if d[0] < 128 else "x") for n, d in body] + [("z" * 200, "after")], "w:"))
    df = archives.archive_members(spark, str(tmp_path), content=True, part_bytes=40_000)
    assert df.rdd.getNumPartitions() > 10
    got = df.collect()
    assert [r.seq for r in sorted((r for r in got if r.archive.endswith("zip")), key=lambda r: r.path)] == list(range(100))
    assert sorted(r.path for r in got if r.archive.endswith("tar")) == sorted([n for n, _ in body] + ["z" * 200])
    assert {r.path: r.content for r in got if r.archive.endswith("zip")} == dict(body)
    assert [r.content for r in got if r.path == "z" * 200] == [b"after"]


def test_filters_on_names_are_pushed_down(spark, tree):
    root, _ = tree
    df = archives.archive_members(spark, str(root), content=True)
    assert df.filter("path = 'two.bin'").count() == 4
    assert df.filter(F.col("path").startswith("a/") & F.col("archive").endswith("lzma.zip")).count() == 1
    assert df.filter(F.col("path").isin("b.txt", "two.bin")).count() == 7
    reader = archives.ArchiveReader({"path": str(root), "content": "true"})
    list(reader.pushFilters([archives.EqualTo(("path",), "two.bin"), archives.StringEndsWith(("archive",), "stored.zip")]))
    parts = reader.partitions()
    assert [p.rpartition("/")[2] for part in parts for p in part.paths] == ["stored.zip"]
    assert sum(b.num_rows for part in parts for b in reader.read(part)) == 1


def test_ranges_of_members(spark, tree):
    root, body = tree
    m = archives.archive_members(spark, str(root))
    asks = m.filter("path in ('two.bin', 'b.txt')").select("archive", "path", F.explode(F.expr("array(named_struct('s', 3, 'e', 700), named_struct('s', 9000, 'e', int(null)), named_struct('s', 20000, 'e', 20005), named_struct('s', 0, 'e', 1))")).alias("a")).select("archive", "path", F.col("a.s").alias("start"), F.col("a.e").alias("end"))
    got = archives.read_ranges(m, asks).collect()
    assert len(got) == 4 * 5 and all(r.error is None for r in got)
    for r in got:
        whole = body if r.path == "two.bin" else b"bee"
        assert r.data == whole[r.start : r.end], (r.archive, r.start)


class Holes(io.FileIO):
    """Zeros are left out of the file."""

    def write(self, b):
        if len(b) > 4096 and not any(b[:64]) and bytes(b).count(0) == len(b):
            self.seek(len(b), io.SEEK_CUR)
            return len(b)
        return super().write(b)


def test_an_archive_of_five_gib_in_bounded_memory(spark, tmp_path):
    """Listed and one member read, without reading what lies before it."""
    path, zeros = tmp_path / "large.zip", bytes(1 << 24)
    with Holes(path, "w") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
        z.writestr("first.txt", b"first")
        with z.open("hole.bin", "w", force_zip64=True) as m:
            for _ in range(320):
                m.write(zeros)
        z.writestr("last.txt", b"last")
    assert path.stat().st_size > 5 << 30
    m = archives.archive_members(spark, str(path))
    listed = {r.path: r for r in m.collect()}
    assert listed["hole.bin"].size_bytes == 5 << 30 and listed["last.txt"].byte_offset > 5 << 30
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    e = listed["last.txt"].asDict() | {"zip": True}
    with archives.open_seekable(str(path)) as f:
        assert archives.member_range(f, e, 0, None) == b"last"
        assert archives.member_range(f, listed["hole.bin"].asDict() | {"zip": True}, (5 << 30) - 4, None) == bytes(4)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10
    asks = spark.createDataFrame([(str(path), "last.txt", 1, 3)], "archive string, path string, start long, end long")
    assert archives.read_ranges(m, asks).first().data == b"as"
    whole = archives.archive_members(spark, str(path), content=True).filter("path = 'last.txt'").first()
    assert whole.content == b"last"


# damage ------------------------------------------------------------------------------------------------------------


def flipped(data: bytes, at: int, n: int = 40) -> bytes:
    return data[:at] + bytes(b ^ 0xA5 for b in data[at : at + n]) + data[at + n :]


@pytest.mark.parametrize("name", METHODS)
def test_a_damaged_member_spares_its_neighbours(spark, name):
    body = bytes((i * 7919 >> 3) % 251 for i in range(9000))
    z = zipped([("before.txt", b"before"), ("bad.bin", body), ("after.txt", b"after")], METHODS[name])
    with zipfile.ZipFile(io.BytesIO(z)) as f:
        at = f.getinfo("bad.bin").header_offset + 30 + len("bad.bin") + 20
    files = spark.createDataFrame([("a.zip", flipped(z, at)), ("b.zip", z)], "uri string, content binary")
    got = {(r.container, r.member): r for r in containers.unpack(files.select("uri", "content")).collect()}
    assert got["a.zip", "bad.bin"].content is None and got["a.zip", "bad.bin"].error
    assert got["a.zip", "before.txt"].content == b"before" and got["a.zip", "after.txt"].content == b"after"
    assert got["b.zip", "bad.bin"].content == body and got["b.zip", "bad.bin"].error is None
    out = {r.uri: r for r in containers.expand(files).collect()}
    assert out["a.zip!bad.bin"].error and out["a.zip!after.txt"].content == b"after"
    read = containers.read_member(files, spark.createDataFrame([("a.zip", "bad.bin", 0, 5), ("b.zip", "after.txt", 0, 5)], "uri string, member string, start long, end long"))
    assert {r.uri: r.data for r in read.collect()} == {"a.zip": None, "b.zip": b"after"}


@pytest.mark.parametrize("mode", ["w:gz", "w:bz2", "w:xz"])
def test_a_damaged_tar_ends_in_a_row_and_others_come(spark, mode):
    import random

    noise = "".join(chr(random.Random(5).randint(33, 126)) for _ in range(1)) + "".join(random.Random(i).choice("abcdefghijklmnopqrstuvwxyz0123456789") for i in range(60_000))
    t = fixtures.tarred([("a.txt", "first"), ("b.txt", noise), ("c.txt", "last")], mode)
    files = spark.createDataFrame([("bad.tar", flipped(t, len(t) // 2)), ("cut.tar", t[: len(t) // 2]), ("ok.tar", t)], "uri string, content binary")
    got = containers.expand(files).filter("depth = 1").collect()
    assert {r.uri for r in got if r.container == "ok.tar" and r.error is None} == {"ok.tar!a.txt", "ok.tar!b.txt", "ok.tar!c.txt"}
    for bad in ("bad.tar", "cut.tar"):
        assert any(r.error for r in got if r.container == bad)
    assert containers.entries(files).filter("uri = 'ok.tar' and error is null").count() == 3


def test_what_is_neither_file_nor_folder_is_passed_over(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:") as t:
        pipe = tarfile.TarInfo("pipe")
        pipe.type = tarfile.FIFOTYPE
        t.addfile(pipe)
        info = tarfile.TarInfo("a.txt")
        info.size = 1
        t.addfile(info, io.BytesIO(b"a"))
    files = spark.createDataFrame([("x.tar", out.getvalue())], "uri string, content binary")
    assert [(r.member, r.content) for r in containers.unpack(files).collect()] == [("a.txt", b"a")]


def test_an_archive_that_is_none_says_so(spark):
    files = spark.createDataFrame([("cut.zip", zipped([("a", b"a" * 5000)])[:40]), ("ok.zip", zipped([("a", b"a")]))], "uri string, content binary")
    got = {r.uri: r for r in containers.expand(files, depth=1).filter("depth = 1").collect()}
    assert "BadZipFile" in got["cut.zip!"].error and got["ok.zip!a"].content == b"a"


def test_packed_bytes_that_are_like_an_office_name_make_no_document(spark):
    from sieveline.sources import files

    odd = zipped([("0.txt", b"one xl/ two ppt/ three word/"), ("b.txt", b"b")], zipfile.ZIP_STORED)
    mixed = zipped([("0.txt", b"bee\xa7\x86\xc2\xf0")], zipfile.ZIP_STORED)  # 786C2F across half bytes
    books = [("a.zip", odd), ("b.zip", mixed), *((f"{n}.bin", zipped([("[Content_Types].xml", b"<Types/>"), (f"{n}/x.xml", b"<x/>")])) for n in ("xl", "ppt", "word"))]
    f = spark.createDataFrame(books, "uri string, content binary")
    got = {r.uri: r.mime for r in f.select("uri", files.detect(F.substring("content", 1, files.HEAD), F.col("uri")).alias("mime")).collect()}
    assert got["a.zip"] == got["b.zip"] == "application/zip"
    assert [got[f"{n}.bin"].rpartition(".")[2] for n in ("xl", "ppt", "word")] == ["sheet", "presentation", "document"]
    assert {r.uri for r in containers.expand(f.filter("uri = 'a.zip'")).collect()} == {"a.zip", "a.zip!0.txt", "a.zip!b.txt"}
