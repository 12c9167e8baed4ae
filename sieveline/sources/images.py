"""Pictures: sizes from headers and segments of six formats; pixels of PNG and BMP, to cut regions out of them.

A region is given in parts of the picture from its upper left corner and answered with a PNG of its own. Other formats'
pixels need a decoder and answer with an error that says so.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.sources.archives import open_seekable

SIZES = "uri string, format string, width int, height int, decodable boolean, error string"
CROPS = "uri string, x double, y double, w double, h double, png binary, width int, height int, error string"
#: Channels of a PNG's colour types; bytes of pixels that are decoded at most.
CHANNELS, MOST = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}, 1 << 28
_PNG = b"\x89PNG\r\n\x1a\n"
_BROKEN = (OSError, EOFError, ValueError, LookupError, struct.error, OverflowError, zlib.error)


def _read(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise EOFError("the picture ends early")
    return data


def _jpeg(f) -> tuple[int, int]:
    """By its segments, up to the frame's."""
    f.seek(2)
    while True:
        b = _read(f, 1)
        while b != b"\xff":
            b = _read(f, 1)
        while b == b"\xff":
            b = _read(f, 1)
        mark = b[0]
        if mark in (0x01, *range(0xD0, 0xD9)):
            continue
        if mark in (0xD9, 0xDA):
            raise ValueError("no frame before the picture's data")
        n, = struct.unpack(">H", _read(f, 2))
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">xHH", _read(f, 5))
            return width, height
        f.seek(n - 2, io.SEEK_CUR)


def _webp(f) -> tuple[int, int]:
    f.seek(12)
    d = _read(f, 18)
    if d[:4] == b"VP8X":
        return int.from_bytes(d[12:15], "little") + 1, int.from_bytes(d[15:18], "little") + 1
    if d[:4] == b"VP8L":
        bits = int.from_bytes(d[9:13], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if d[:4] != b"VP8 " or d[11:14] != b"\x9d\x01\x2a":
        raise ValueError("no picture of WebP")
    return tuple(x & 0x3FFF for x in struct.unpack("<HH", d[14:18]))


def _tiff(f, mark: bytes) -> tuple[int, int]:
    """By the tags of its first directory."""
    o = "<" if mark == b"II" else ">"
    f.seek(4)
    f.seek(*struct.unpack(o + "I", _read(f, 4)))
    found = {}
    for _ in range(struct.unpack(o + "H", _read(f, 2))[0]):
        tag, kind = struct.unpack(o + "HH4x", (e := _read(f, 12))[:8])
        if tag in (256, 257):
            found[tag] = struct.unpack(o + ("H" if kind == 3 else "I"), e[8:10] if kind == 3 else e[8:])[0]
    return found[256], found[257]


def size(f) -> tuple[str, int, int]:
    """(format, width, height) of a picture."""
    f.seek(0)
    head = f.read(32)
    if head[:8] == _PNG:
        return "PNG", *struct.unpack(">II", head[16:24])
    if head[:4] == b"GIF8":
        return "GIF", *struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM":
        width, height = struct.unpack("<ii", head[18:26])
        return "BMP", width, abs(height)
    if head[:3] == b"\xff\xd8\xff":
        return "JPEG", *_jpeg(f)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "WEBP", *_webp(f)
    if head[:4] in (b"II*\0", b"MM\0*"):
        return "TIFF", *_tiff(f, head[:2])
    raise ValueError("no picture of a format that is read here")


# pixels ------------------------------------------------------------------------------------------------------------


def _unfiltered(data: bytes, height: int, row: int, step: int) -> np.ndarray:
    """The scanlines behind their predictors: left, above, the mean of both, or the nearest of three."""
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(height):
        line = np.frombuffer(data, np.uint8, row, y * (row + 1) + 1).copy()
        how = data[y * (row + 1)]
        if how == 1:
            for c in range(step):
                line[c::step] = np.cumsum(line[c::step], dtype=np.uint64).astype(np.uint8)
        elif how == 2:
            line += above
        elif how in (3, 4):
            now, up = line.tolist(), above.tolist()
            for i in range(row):
                a, b = now[i - step] if i >= step else 0, up[i]
                if how == 3:
                    guess = a + b >> 1
                else:
                    c = up[i - step] if i >= step else 0
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                now[i] = now[i] + guess & 255
            line = np.array(now, np.uint8)
        elif how:
            raise ValueError("an unknown predictor")
        out[y] = above = line
    return out


def pixels(data: bytes) -> tuple[np.ndarray, int, int, bytes]:
    """(rows of bytes, bit depth, colour type of a PNG, its palette chunks) of a PNG or BMP."""
    if data[:8] == _PNG:
        width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", data[16:29])
        if laced or depth < 8 or colour not in CHANNELS:
            raise NotImplementedError("interlaced pictures and less than eight bits a sample are not decoded")
        step = CHANNELS[colour] * depth // 8
        if height * (width * step + 1) > MOST:
            raise ValueError("the picture is too large")
        at, packed, palette = 8, [], b""
        while at + 8 <= len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"IDAT":
                packed.append(data[at + 8 : at + 8 + n])
            elif kind in (b"PLTE", b"tRNS"):
                palette += data[at : at + 12 + n]
            at += 12 + n
        raw = zlib.decompressobj().decompress(b"".join(packed), height * (width * step + 1))
        if len(raw) < height * (width * step + 1):
            raise EOFError("the picture ends early")
        return _unfiltered(raw, height, width * step, step).reshape(height, width, step), depth, colour, palette
    if data[:2] == b"BM":
        start, = struct.unpack("<I", data[10:14])
        width, height, _, bits, packing = struct.unpack("<iiHHI", data[18:34])
        if bits not in (24, 32) or packing not in (0, 3):
            raise NotImplementedError("packed or indexed BMP pictures are not decoded")
        row = (width * bits + 31) // 32 * 4
        rows = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
        x = rows[:: -1 if height > 0 else 1, : width * bits // 8].reshape(abs(height), width, bits // 8)
        return np.ascontiguousarray(x[:, :, 2::-1]), 8, 2, b""
    raise NotImplementedError("pixels of this format need a decoder")


def png(x: np.ndarray, depth: int, colour: int, palette: bytes = b"") -> bytes:
    """A PNG of rows of pixels."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = np.concatenate([np.zeros((x.shape[0], 1), np.uint8), x.reshape(x.shape[0], -1)], 1)
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], depth, colour, 0, 0, 0)) + palette + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def cropped(data: bytes, x: float, y: float, w: float, h: float) -> tuple[bytes, int, int]:
    """A region as a PNG, with its size: from the pixel that its upper left corner is in up to its lower right corner."""
    if not (0 <= x < 1 and 0 <= y < 1 and w > 0 and h > 0 and x + w <= 1 + 1e-9 and y + h <= 1 + 1e-9):
        raise ValueError("the region is not inside the picture")
    rows, depth, colour, palette = pixels(data)
    height, width = rows.shape[:2]
    left, top = int(x * width), int(y * height)
    part = rows[top : max(top + 1, int((y + h) * height)), left : max(left + 1, int((x + w) * width))]
    return png(part, depth, colour, palette), part.shape[1], part.shape[0]


# rows --------------------------------------------------------------------------------------------------------------


def _rows(files: DataFrame, schema: str, make) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                row = {k: r[k] for k in arrow.names if k in r}
                try:
                    row |= make(r)
                except _BROKEN + (NotImplementedError,) as x:
                    row["error"] = f"{type(x).__name__}: {x}"
                yield pa.RecordBatch.from_pylist([row], arrow)

    return files.mapInArrow(run, schema)


def read_sizes(files: DataFrame) -> DataFrame:
    """Rows SIZES of pictures (uri, and path or content): what cannot be read has decodable false and an error."""
    asked = files.select("uri", *(F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("content", "binary"))))

    def make(r: dict) -> dict:
        with open_seekable(r["path"]) if r["path"] else io.BytesIO(r["content"] or b"") as f:
            kind, width, height = size(f)
        return {"format": kind, "width": width, "height": height}

    out = _rows(asked, SIZES, make)
    return out.withColumn("decodable", F.col("format").isNotNull())


def crop_regions(files: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows CROPS for asked (uri, x, y, w, h) of pictures (uri, content)."""
    met = asked.select("uri", *(F.col(c).cast("double").alias(c) for c in "xywh")).join(files.select("uri", "content"), "uri")

    def make(r: dict) -> dict:
        made, width, height = cropped(bytes(r["content"] or b""), r["x"], r["y"], r["w"], r["h"])
        return {"png": made, "width": width, "height": height}

    return _rows(met, CROPS, make)
