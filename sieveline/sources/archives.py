"""Archives in place: a Python data source that lists and reads members by seeks.

    archive_members(spark, "file:///data/tree").filter("path = 'notes.txt'")

Planning reads names and sizes of archives only, but for those larger than a partition: of a zip its central directory is
read, of a tar its headers, by seeks, and its members are dealt to partitions by their bytes. A task reads the directory
again and then its own members, so no cell holds an archive and none is read whole but a compressed tar, which has no
places to seek to and is one partition. Filters on archive and path are pushed down: archives that cannot hold a row are
not planned and members that cannot be one are not inflated.
"""

from __future__ import annotations

import bz2
import fnmatch
import io
import lzma
import stat
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringEndsWith, StringStartsWith

from sieveline.functions.text import unsafe_member
from sieveline.sources.containers import _BROKEN, MEMBER_BYTES, RATIO, _bounded, _plain
from sieveline.sources.files import record_batch

FORMAT = "archive_members"
ROW = "archive string, seq long, path string, size_bytes long, compressed_bytes long, method int, byte_offset long, is_dir boolean, is_symlink boolean, content binary, error string"
RANGE = "archive string, path string, start long, end long, data binary, error string"
#: Names that are planned if no pattern is given; bytes of one partition; bytes of content in one batch; bytes inflated at once.
NAMES, PART_BYTES, OUT_BYTES, STEP = "*.zip,*.tar,*.tar.gz,*.tgz,*.tar.bz2,*.tar.xz", 128 << 20, 8 << 20, 1 << 20
#: Methods of a zip's members; a tar's are stored.
STORED, DEFLATED, BZIP2, LZMA = 0, 8, 12, 14


def _located(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if ":/" in path else (arrow_fs.LocalFileSystem(), path)


class _Seekable(io.BufferedReader):
    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        try:
            return super().seek(offset, whence)
        except ValueError as x:  # Arrow's word for a place before the file
            raise OSError(str(x)) from x


def open_seekable(path: str):
    """A file in any store that Arrow reaches, to be read by seeks."""
    f, p = _located(path)
    return _Seekable(f.open_input_file(p), 1 << 16)


def _listed(root: str, pattern: str) -> list[tuple[str, int]]:
    """Files at or below root whose names fit one of the patterns, with their sizes, by path."""
    f, p = _located(root)
    info = f.get_file_info(p)
    infos = [info] if info.type == arrow_fs.FileType.File else f.get_file_info(arrow_fs.FileSelector(p, recursive=True))
    scheme = root[: root.index(p)] if p in root else ""
    fits = lambda n: any(fnmatch.fnmatch(n, q) for q in pattern.split(","))
    return sorted((scheme + i.path, i.size) for i in infos if i.type == arrow_fs.FileType.File and fits(i.base_name))


def _zip_entry(seq: int, e: zipfile.ZipInfo) -> dict:
    link = e.create_system == 3 and stat.S_ISLNK(e.external_attr >> 16)
    return {"seq": seq, "path": e.filename, "size_bytes": e.file_size, "compressed_bytes": e.compress_size, "method": e.compress_type, "byte_offset": e.header_offset, "is_dir": e.is_dir(), "is_symlink": link}


def _tar_entry(seq: int, e: tarfile.TarInfo, solid: bool) -> dict:
    return {"seq": seq, "path": e.name, "size_bytes": e.size, "compressed_bytes": e.size, "method": STORED, "byte_offset": None if solid else e.offset_data, "is_dir": e.isdir(), "is_symlink": e.issym() or e.islnk()}


@dataclass
class Some(InputPartition):
    """Members first..last of one archive, or all of several; of a tar, where the first one's header is."""

    paths: list[str]
    first: int = 0
    last: int | None = None
    at: int = 0


def _runs(sizes: Iterator[tuple[int, int]], part_bytes: int) -> Iterator[tuple[int, int, int]]:
    """(first, end, where the first is) of runs of members (size, where) of about part_bytes."""
    first, begin, total, n = 0, 0, 0, 0
    for size, at in sizes:
        if n == first:
            begin = at
        total += size
        n += 1
        if total >= part_bytes:
            yield first, n, begin
            first, total = n, 0
    if n > first:
        yield first, n, begin


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", NAMES)
        self.content, self.part_bytes = options.get("content", "false") == "true", int(options.get("partitionbytes", PART_BYTES))
        self.wanted: dict[str, list] = {"archive": [], "path": []}

    def pushFilters(self, filters):
        """Note what narrows archives and paths; Spark asks every filter again."""
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute in (("archive",), ("path",)):
                self.wanted[f.attribute[0]].append((type(f).__name__, f.value))
            yield f

    def _fits(self, column: str, value: str) -> bool:
        tests = {"EqualTo": lambda w: value == w, "In": lambda w: value in w, "StringStartsWith": value.startswith, "StringEndsWith": value.endswith}
        return all(tests[kind](w) for kind, w in self.wanted[column])

    def partitions(self):
        out, few, size = [], [], 0
        for path, n in _listed(self.root, self.pattern):
            if not self._fits("archive", path):
                continue
            if n > self.part_bytes and (parts := self._split(path)):
                out += parts
                continue
            few.append(path)
            size += n
            if size >= self.part_bytes:
                out.append(Some(few))
                few, size = [], 0
        return [*out, Some(few)] if few or not out else out

    def _split(self, path: str) -> list[Some]:
        """Partitions of a large archive; none if it is compressed as a whole or cannot be read, which its task says."""
        try:
            with open_seekable(path) as f:
                mark = f.peek(6)[:6]
                if mark[:2] == b"PK":
                    with zipfile.ZipFile(f) as z:
                        return [Some([path], a, b) for a, b, _ in _runs(((e.compress_size, 0) for e in z.infolist()), self.part_bytes)]
                if mark[:2] == b"\x1f\x8b" or mark[:3] == b"BZh" or mark == b"\xfd7zXZ\x00":
                    return []
                with tarfile.open(fileobj=f, mode="r:") as t:
                    return [Some([path], a, b, at) for a, b, at in _runs(((e.size, e.offset) for e in _forgetting(t)), self.part_bytes)]
        except _BROKEN:
            return []

    def read(self, partition: Some) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.paths:
            try:
                with open_seekable(path) as f:
                    for e, open_ in self._members(f, partition):
                        if not self._fits("path", e["path"]):
                            continue
                        row = {"archive": path, **e}
                        if self.content and not e["is_dir"] and not e["is_symlink"]:
                            try:
                                row["content"] = _bounded(open_, e["size_bytes"], e["compressed_bytes"], MEMBER_BYTES, RATIO)
                            except _BROKEN as x:
                                row["error"] = f"{type(x).__name__}: {x}"
                        rows.append(row)
                        size += len(row.get("content") or b"")
                        if size > OUT_BYTES or len(rows) >= 10_000:
                            yield record_batch(rows, ROW)
                            rows, size = [], 0
            except _BROKEN as x:
                rows.append({"archive": path, "error": f"{type(x).__name__}: {x}"})
        yield record_batch(rows, ROW)

    @staticmethod
    def _members(f, part: Some) -> Iterator[tuple[dict, object]]:
        if f.peek(2)[:2] == b"PK":
            with zipfile.ZipFile(f) as z:
                for i, e in enumerate(z.infolist()[part.first : part.last], part.first):
                    if e.filename:
                        yield _zip_entry(i, e), (lambda e=e: z.open(e))
            return
        stream, solid = _plain(f)
        if part.at:
            f.seek(part.at)
        with tarfile.open(fileobj=stream, mode="r|" if solid else "r:") as t:
            for i, e in enumerate(_forgetting(t), part.first):
                if part.last is not None and i >= part.last:
                    break
                if e.isreg() or e.isdir() or e.issym() or e.islnk():
                    yield _tar_entry(i, e, solid), (lambda e=e: t.extractfile(e))


def _forgetting(t: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """A tar's headers, one at a time: the list of all that tarfile keeps is emptied."""
    while (e := t.next()) is not None:
        yield e
        t.members.clear()


class ArchiveMembers(DataSource):
    """spark.read.format("archive_members"): options path, pattern (file names by commas), content (false: null) and
    partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def archive_members(spark: SparkSession, root: str, pattern: str = NAMES, content: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows ROW of the archives at or below root. A damaged archive gives a row with its error alone, a damaged member one
    with its error and no content; the others come. The session's filter pushdown to Python sources is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format(FORMAT).option("pattern", pattern).option("content", str(content).lower()).option("partitionBytes", str(part_bytes)).load(root)


def safe_members(members: DataFrame) -> DataFrame:
    """Files whose paths stay in their archive, without folders and links."""
    return members.filter(F.col("path").isNotNull() & ~F.col("is_dir") & ~F.col("is_symlink") & ~unsafe_member(F.col("path")))


# ranges ------------------------------------------------------------------------------------------------------------


def _inflater(f, method: int):
    """A function of stored bytes that gives the member's."""
    if method == STORED:
        return lambda b: b
    if method == DEFLATED:
        return zlib.decompressobj(-15).decompress
    if method == BZIP2:
        return bz2.BZ2Decompressor().decompress
    if method == LZMA:
        size = struct.unpack("<2xH", f.read(4))[0]
        props = f.read(size)
        packed, dictionary = props[0], struct.unpack("<I", props[1:5])[0]
        return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "lc": packed % 9, "lp": packed // 9 % 5, "pb": packed // 45, "dict_size": dictionary}]).decompress
    raise NotImplementedError(f"compression method {method}")


def member_range(f, e: dict, start: int, end: int | None) -> bytes:
    """Bytes [start, end) of a member (its row), inflated up to its end or to end and no further, in steps."""
    stored = e["compressed_bytes"]
    f.seek(e["byte_offset"])
    if e["zip"]:
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("no member begins here")
        if struct.unpack("<6xH", head[:8])[0] & 1:
            raise RuntimeError("the member is encrypted")
        f.seek(e["byte_offset"] + 30 + sum(struct.unpack("<26x2H", head)))
        if e["method"] == LZMA:
            stored -= 4 + struct.unpack("<2xH", f.peek(4)[:4])[0]
    end = e["size_bytes"] if end is None else min(end, e["size_bytes"])
    if e["method"] == STORED:
        f.seek(start, io.SEEK_CUR)
        return f.read(max(0, end - start))
    inflate, out, at = _inflater(f, e["method"]), [], 0
    while at < end and stored > 0:
        piece = inflate(f.read(min(STEP // 16, stored)))
        stored -= STEP // 16
        out.append(piece[max(0, start - at) : max(0, end - at)])
        at += len(piece)
    if at < end:
        raise EOFError("the member ends early")
    return b"".join(out)


def read_ranges(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows RANGE for asked (archive, path, start, end; null: to its end) of members with a place. Each row seeks to its
    member: nothing before it in the archive is read, and of the member no more than up to its end."""
    spot = members.filter("byte_offset is not null").select("archive", "path", "size_bytes", "compressed_bytes", "method", "byte_offset")
    rows = asked.select("archive", "path", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.col("end").cast("long").alias("end")).join(spot, ["archive", "path"])

    def read(batches):
        for b in batches:
            for r in b.to_pylist():
                row = {k: r[k] for k in ("archive", "path", "start", "end")}
                try:
                    with open_seekable(r["archive"]) as f:
                        row["data"] = member_range(f, r | {"zip": f.peek(2)[:2] == b"PK"}, r["start"], r["end"])
                except _BROKEN as x:
                    row["error"] = f"{type(x).__name__}: {x}"
                yield record_batch([row], RANGE)

    return rows.mapInArrow(read, RANGE)
