"""Archives as nested sources: one row per member, expanded level by level.

Python opens an archive and lists or inflates its members; which archives are folders, which members are safe, what a
level deeper holds, is decided in the plan. Bytes are counted while they inflate, so a member cannot swell past its
limits whatever it declares.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import stat
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import join_uri, unsafe_member
from sieveline.operators.dispatch import ARCHIVES
from sieveline.sources.files import HEAD, NOT_A_FOLDER, detect, gathered, small_batches

ENTRY = "uri string, seq long, path string, size_bytes long, compressed_bytes long, is_dir boolean, is_symlink boolean, byte_offset long, error string"
READ = "uri string, member string, exists boolean, size_bytes long, data binary, error string"
MEMBER = "container string, member string, content binary, error string"
#: Limits of a container: levels, bytes of a member, bytes of a member for each stored byte, bytes of an archive.
DEPTH, MEMBER_BYTES, RATIO, TOTAL_BYTES = 3, 1 << 30, 200, 4 << 30
_STEP = 1 << 20


def _plain(data) -> tuple[io.BufferedIOBase, bool]:
    """A stream of a tar's own bytes, of bytes or of a file with peek; whether it was compressed as a whole."""
    raw = io.BytesIO(data) if isinstance(data, bytes) else data
    head = data if isinstance(data, bytes) else data.peek(6)
    for mark, open_ in ((b"\x1f\x8b", gzip.GzipFile), (b"BZh", bz2.BZ2File), (b"\xfd7zXZ\x00", lzma.LZMAFile)):
        if head.startswith(mark):
            return (open_(fileobj=raw) if open_ is gzip.GzipFile else open_(raw)), True
    return raw, False


def members(data: bytes) -> Iterator[tuple[dict, object]]:
    """Of an archive its entries in order, each with a function that opens it."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for e in z.infolist():
                if e.filename:
                    link = e.create_system == 3 and stat.S_ISLNK(e.external_attr >> 16)
                    yield {"path": e.filename, "size_bytes": e.file_size, "compressed_bytes": e.compress_size, "is_dir": e.is_dir(), "is_symlink": link, "byte_offset": e.header_offset}, (lambda e=e: z.open(e))
        return
    stream, solid = _plain(data)
    with tarfile.open(fileobj=stream, mode="r|" if solid else "r:") as t:
        for e in t:
            if not (e.isreg() or e.isdir() or e.issym() or e.islnk()):  # devices and pipes hold nothing to read
                continue
            yield {"path": e.name, "size_bytes": e.size, "compressed_bytes": e.size, "is_dir": e.isdir(), "is_symlink": e.issym() or e.islnk(), "byte_offset": None if solid else e.offset}, (lambda e=e: t.extractfile(e))


def _bounded(open_, declared: int, stored: int, member_bytes: int, ratio: int) -> bytes:
    """A member's bytes, or an error as soon as they pass a limit."""
    out, got = [], 0
    with open_() as f:
        while piece := f.read(_STEP):
            got += len(piece)
            if got > member_bytes or got > max(stored, 4096) * ratio:
                raise ValueError("member swells past its limit")
            out.append(piece)
    return b"".join(out)


#: What damage raises in the decoders that are used here; each member's and each archive's stays in its row.
_BROKEN = (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, RuntimeError, NotImplementedError, LookupError, lzma.LZMAError, zlib.error, struct.error)


def _opened(archives: DataFrame, content: str, openers: Mapping[str, Callable] | None):
    """The columns that a reader needs, and a function that gives the members of a row: by a caller's opener of its type
    (mime), if there is one, else by its bytes."""
    own = dict(openers or {})
    kind = F.col("mime") if own and "mime" in archives.columns else F.lit(None).cast("string")
    return archives.select("uri", F.col(content).alias("content"), kind.alias("mime")), lambda data, mime: own.get(mime, members)(data)


def entries(archives: DataFrame, content: str = "content", openers: Mapping[str, Callable] | None = None) -> DataFrame:
    """Rows ENTRY of archives (uri, content, mime if there are openers); one that cannot be read gives a row with its
    error alone. openers: type to a function of bytes that yields what members yields."""
    rows_in, opened = _opened(archives, content, openers)

    def read(batches):
        for b in batches:
            for uri, data, mime in zip(b["uri"].to_pylist(), b["content"].to_pylist(), b["mime"].to_pylist(), strict=True):
                rows = []
                try:
                    rows += [{"uri": uri, "seq": i, "error": None} | e for i, (e, _) in enumerate(opened(data, mime))]
                except _BROKEN as x:
                    rows.append({"uri": uri, "seq": len(rows), "error": f"{type(x).__name__}: {x}"})
                yield from rows

    return small_batches(rows_in).mapInArrow(lambda batches: gathered(read(batches), ENTRY), ENTRY)


def unpack(archives: DataFrame, member_bytes: int = MEMBER_BYTES, ratio: int = RATIO, total_bytes: int = TOTAL_BYTES, openers: Mapping[str, Callable] | None = None) -> DataFrame:
    """(container, member, content, error): the files in archives; folders and links are left out. An archive is read
    once, from front to back; what breaks a limit comes with an error instead of bytes."""

    rows_in, opened = _opened(archives, "content", openers)

    def read(batches):
        for b in batches:
            for uri, data, mime in zip(b["uri"].to_pylist(), b["content"].to_pylist(), b["mime"].to_pylist(), strict=True):
                total = 0
                try:
                    for e, open_ in opened(data, mime):
                        if e["is_dir"] or e["is_symlink"]:
                            continue
                        body, error = None, None
                        try:
                            body = _bounded(open_, e["size_bytes"], e["compressed_bytes"], member_bytes, ratio)
                            total += len(body)
                            if total > total_bytes:
                                body, error = None, "archive swells past its limit"
                        except _BROKEN as x:
                            error = f"{type(x).__name__}: {x}"
                        yield {"container": uri, "member": e["path"], "content": body, "error": error}
                except _BROKEN as x:
                    yield {"container": uri, "error": f"{type(x).__name__}: {x}"}

    return small_batches(rows_in).mapInArrow(lambda batches: gathered(read(batches), MEMBER), MEMBER)


def read_member(archives: DataFrame, asked: DataFrame, openers: Mapping[str, Callable] | None = None) -> DataFrame:
    """(uri, member, exists, size_bytes, data): for asked (uri, member, start, end) whether the archive holds such a file,
    its inflated size and its bytes [start, end). Members that are asked for are inflated, and no others; of the bytes no
    more are kept than were asked for."""
    asks = asked.groupBy("uri").agg(F.collect_list(F.struct("member", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("asks"))
    rows_in, opened = _opened(archives, "content", openers)

    def read(batches):
        for b in batches:
            for row in b.to_pylist():
                todo: dict[str, list] = {}
                for a in row["asks"]:
                    todo.setdefault(a["member"], []).append((a["start"] or 0, a["end"]))
                rows = []
                try:
                    for e, open_ in opened(row["content"], row["mime"]):
                        ranges = todo.pop(e["path"], None) if not (e["is_dir"] or e["is_symlink"]) else None
                        if ranges:
                            data = _bounded(open_, e["size_bytes"], e["compressed_bytes"], MEMBER_BYTES, RATIO)
                            rows += [{"uri": row["uri"], "member": e["path"], "exists": True, "size_bytes": len(data), "data": data[s:t]} for s, t in ranges]
                    rows += [{"uri": row["uri"], "member": m, "exists": False} for m, ranges in todo.items() for _ in ranges]
                except _BROKEN as x:
                    rows = [{"uri": row["uri"], "member": a["member"], "exists": None, "error": f"{type(x).__name__}: {x}"} for a in row["asks"]]
                yield from rows

    return small_batches(rows_in).join(asks, "uri").mapInArrow(lambda batches: gathered(read(batches), READ), READ)


def is_folder(uri, mime_type, more: Iterable[str] = ()):
    """Whether an archive is descended into: an archive by its bytes, not a document by its type or name."""
    ext = F.lower(F.regexp_extract(uri, r"\.([A-Za-z0-9]+)$", 1))
    return mime_type.isin(*ARCHIVES, *more) & ~ext.isin(*NOT_A_FOLDER)


def expand(files: DataFrame, depth: int = DEPTH, openers: Mapping[str, Callable] | None = None, detector: Callable | None = None, keep: Callable[[DataFrame], DataFrame] | None = None, **limits) -> DataFrame:
    """files (uri, content) and all that is inside their archives, down to so many levels: uri (nested, `a.zip!b`),
    container, depth, mime, content, error. Unsafe member paths come with an error and without bytes, damaged members
    likewise; an archive that cannot be read to its end gives, after what could be read, a row `a.zip!` with its error. Each level is one more step of the plan; levels are bounded. keep writes down what a level
    holds that was inside archives: then none is inflated twice, and a level without archives is the last. The files
    themselves stay where they are."""
    head = F.substring("content", 1, HEAD)
    kind = F.coalesce(detector(head, F.col("uri")), detect(head, F.col("uri"))) if detector else detect(head, F.col("uri"))
    level = files.select(join_uri(F.array("uri")).alias("uri"), F.lit(None).cast("string").alias("container"), F.lit(0).alias("depth"), F.col("content"), F.lit(None).cast("string").alias("error")).withColumn("mime", kind)
    out = level
    for d in range(1, depth + 1):
        if keep and level.filter(is_folder(F.col("uri"), F.col("mime"), openers or ())).isEmpty():
            break
        folders = level.filter(is_folder(F.col("uri"), F.col("mime"), openers or ())).select("uri", "content", "mime")
        inside = unpack(folders, openers=openers, **limits)
        bad = F.coalesce(unsafe_member(F.col("member")), F.lit(False))
        level = inside.select(
            F.concat("container", F.lit("!"), F.coalesce(join_uri(F.array("member")), F.lit(""))).alias("uri"), "container", F.lit(d).alias("depth"),
            F.when(~bad, F.col("content")).alias("content"), F.when(bad, "unsafe member path").otherwise(F.col("error")).alias("error"),
        ).withColumn("mime", kind)
        level = keep(level) if keep else level
        out = out.unionByName(level)
    return out
