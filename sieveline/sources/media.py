"""What media files say of themselves: length, streams and embedded captions, read from their containers by seeks.

ISO base media (MP4, MOV, M4A) by its boxes and sample tables, Matroska and WebM by EBML elements, WAVE, FLAC, Ogg and MP3
by their headers and frame chains. Nothing is decoded. A file comes as bytes or by its path: then headers are read and what
lies between them is not. Each reader yields flat rows; joining, ordering and cleaning them is for the plan.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import collapse
from sieveline.sources.archives import open_seekable
from sieveline.sources.files import gathered, small_batches

STREAM = "struct<kind:string,codec:string,width:int,height:int,fps:double,sample_rate:int,channels:int,language:string,is_text:boolean>"
FACTS = f"uri string, duration_s double, container string, streams array<{STREAM}>, error string"
CUES = "uri string, track int, place long, start_s double, end_s double, text string, language string, codec string, error string"
#: Boxes that hold boxes; handlers and EBML track types by kind; codecs whose samples are text.
BOXES = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"edts")
HANDLERS = {b"vide": "video", b"soun": "audio", b"text": "subtitle", b"sbtl": "subtitle", b"subt": "subtitle"}
TRACKS = {1: "video", 2: "audio", 17: "subtitle"}
TEXT_CODECS = ("tx3g", "text", "wvtt", "S_TEXT/UTF8", "S_TEXT/ASCII", "S_TEXT/ASS", "S_TEXT/SSA", "S_TEXT/WEBVTT")
#: EBML elements that are read, by id; those that hold others.
EBML, SEGMENT, INFO, SCALE, DURATION, TRACK_LIST, TRACK, CLUSTER = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0x1F43B675
NUMBER, TYPE, CODEC, LANGUAGE, LANGUAGE_TOO, FRAME_NS, VIDEO, WIDTH, HEIGHT, AUDIO, RATE, CHANNELS = 0xD7, 0x83, 0x86, 0x22B59C, 0x22B59D, 0x23E383, 0xE0, 0xB0, 0xBA, 0xE1, 0xB5, 0x9F
TIME, SIMPLE, GROUP, BLOCK, BLOCK_TIME, DOC_TYPE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0x4282
MASTERS = (SEGMENT, INFO, TRACK_LIST, TRACK, VIDEO, AUDIO, CLUSTER, GROUP, EBML)
#: Fixed values of MPEG audio: bits a second in thousands of layer III, samples a second, by version.
MP3_RATES = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MP3_SAMPLES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Bytes of a header box or element that are held at most.
HELD = 64 << 20
_BROKEN = (OSError, EOFError, ValueError, LookupError, struct.error, OverflowError, ZeroDivisionError)


def _read(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise EOFError("the file ends early")
    return data


# ISO base media ----------------------------------------------------------------------------------------------------


def _boxes(f, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of content, end) of the boxes in [at, end)."""
    while at + 8 <= end:
        f.seek(at)
        size, kind = struct.unpack(">I4s", _read(f, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", _read(f, 8))[0], 16
        size = size or end - at
        if size < head:
            raise ValueError(f"box {kind!r} is smaller than its head")
        yield kind, at + head, min(at + size, end)
        at += size


def _content(f, a: int, b: int) -> bytes:
    if b - a > HELD:
        raise ValueError("a header box is too large")
    f.seek(a)
    return _read(f, b - a)


def _numbers(data: bytes, width: int, fields: int = 1) -> list[tuple]:
    """The rows of a table box: a version, a count, and so many numbers each."""
    n = struct.unpack(">4xI", data[:8])[0]
    form = ">" + ("Q" if width == 8 else "I") * fields
    return list(struct.iter_unpack(form, data[8 : 8 + n * fields * width]))


class IsoTrack:
    def __init__(self):
        self.kind, self.codec, self.language, self.scale, self.units = None, None, None, 1, 0
        self.width = self.height = self.rate = self.channels = None
        self.times, self.chunks, self.sizes, self.offsets, self.same_size, self.count = [], [], [], [], 0, 0

    def read(self, f, kind: bytes, a: int, b: int) -> None:
        if kind == b"mdhd":
            d = _content(f, a, b)
            self.scale, self.units, packed = struct.unpack(">20xIQH", d[:34]) if d[0] else struct.unpack(">12xIIH", d[:22])
            code = "".join(chr((packed >> s & 31) + 96) for s in (10, 5, 0))
            self.language = code if code.isalpha() and code != "und" else None
        elif kind == b"hdlr":
            self.kind = HANDLERS.get(_content(f, a, b)[8:12])
        elif kind == b"tkhd":
            w, h = struct.unpack(">II", _content(f, a, b)[-8:])
            self.width, self.height = w >> 16, h >> 16
        elif kind == b"stsd":
            d = _content(f, a, b)
            self.codec = d[12:16].decode("latin-1").strip()
            if self.kind == "audio":
                self.channels, self.rate = struct.unpack(">H", d[32:34])[0], struct.unpack(">I", d[40:44])[0] >> 16
        elif kind == b"stts":
            self.times = _numbers(_content(f, a, b), 4, 2)
        elif kind == b"stsc":
            self.chunks = _numbers(_content(f, a, b), 4, 3)
        elif kind == b"stsz":
            d = _content(f, a, b)
            self.same_size, self.count = struct.unpack(">4xII", d[:12])
            self.sizes = [] if self.same_size else [x for (x,) in struct.iter_unpack(">I", d[12 : 12 + 4 * self.count])]
        elif kind in (b"stco", b"co64"):
            self.offsets = [x for (x,) in _numbers(_content(f, a, b), 8 if kind == b"co64" else 4)]

    def samples(self) -> Iterator[tuple[int, int, float, float]]:
        """(offset, size, start_s, end_s) of each sample: chunks by their runs, sizes and times in order."""
        at, sizes = 0, iter(self.sizes)
        times = ((d for n, d in self.times for _ in range(n)))
        runs = [(first, per, nxt) for (first, per, _), nxt in zip(self.chunks, [*(c[0] for c in self.chunks[1:]), len(self.offsets) + 1], strict=True)]
        for first, per, nxt in runs:
            for chunk in range(first, nxt):
                where = self.offsets[chunk - 1]
                for _ in range(per):
                    size, took = self.same_size or next(sizes, None), next(times, None)
                    if size is None or took is None:
                        return
                    yield where, size, at / self.scale, (at + took) / self.scale
                    where, at = where + size, at + took

    def stream(self) -> dict:
        seconds = self.units / self.scale if self.scale else 0
        fps = self.count / seconds if self.kind == "video" and seconds else None
        shown = self.kind == "video"
        return {"kind": self.kind, "codec": self.codec, "width": self.width if shown else None, "height": self.height if shown else None, "fps": fps, "sample_rate": self.rate, "channels": self.channels, "language": self.language, "is_text": self.kind == "subtitle" and self.codec in TEXT_CODECS}


def _iso(f, size: int) -> tuple[float | None, list[IsoTrack]]:
    """Seconds and tracks: of the file the heads of boxes are read, and the tables of its tracks."""
    duration, tracks = None, []

    def walk(at: int, end: int, track: IsoTrack | None) -> None:
        nonlocal duration
        for kind, a, b in _boxes(f, at, end):
            if kind == b"trak":
                tracks.append(IsoTrack())
                walk(a, b, tracks[-1])
            elif kind in BOXES:
                walk(a, b, track)
            elif kind == b"mvhd":
                d = _content(f, a, b)
                scale, units = struct.unpack(">20xIQ", d[:32]) if d[0] else struct.unpack(">12xII", d[:20])
                duration = units / scale if scale else None
            elif track is not None:
                track.read(f, kind, a, b)

    walk(0, size, None)
    return duration, tracks


def _iso_text(codec: str, data: bytes) -> str:
    if codec == "wvtt":
        f, out = io.BytesIO(data), []
        for kind, a, b in _boxes(f, 0, len(data)):
            out += [_content(f, c, e).decode("utf-8", "replace") for k, c, e in _boxes(f, a, b) if k == b"payl"] if kind == b"vttc" else []
        return "\n".join(out)
    n = struct.unpack(">H", data[:2])[0]
    return data[2 : 2 + n].decode("utf-16" if data[2:4] in (b"\xfe\xff", b"\xff\xfe") else "utf-8", "replace")


# Matroska ----------------------------------------------------------------------------------------------------------


def _varint(f, keep_mark: bool) -> int:
    first = _read(f, 1)[0]
    n = 9 - first.bit_length() if first else 9
    if n > 8:
        raise ValueError("a number of more than eight bytes")
    value = first if keep_mark else first & (0xFF >> n)
    rest = _read(f, n - 1)
    out = value << 8 * (n - 1) | int.from_bytes(rest, "big")
    return -1 if not keep_mark and out == (1 << 7 * n) - 1 else out  # all ones: size unknown


def _elements(f, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start of content, end) in file order; an element that holds others comes before them, one of unknown size
    goes on to the end of its parent, so what follows it is met as its content."""
    while at < end:
        f.seek(at)
        try:
            key, size = _varint(f, True), _varint(f, False)
        except EOFError:
            return
        a = f.tell()
        b = end if size < 0 else min(a + size, end)
        yield key, a, b
        at = a if key in MASTERS else b


def _unsigned(d: bytes) -> int:
    return int.from_bytes(d, "big")


def _float(d: bytes) -> float:
    return struct.unpack(">f" if len(d) == 4 else ">d", d)[0] if d else 0.0


def _matroska(f, size: int, texts: bool) -> tuple[str, float | None, list[dict], list[tuple]]:
    """Name, seconds, tracks and, if asked, text blocks (track, start_s, end_s or None, data). Blocks of other tracks are
    passed over by seeks."""
    name, scale, units, tracks, blocks, cluster, took, pending = "matroska", 1_000_000, None, [], [], 0, None, None

    def put():
        nonlocal pending, took
        if pending:
            number, start, data = pending
            blocks.append((number, start * scale / 1e9, (start + took) * scale / 1e9 if took is not None else None, data))
        pending = took = None

    for key, a, b in _elements(f, 0, size):
        if key in MASTERS:
            if key == TRACK:
                tracks.append({"number": len(tracks) + 1})
            elif key in (CLUSTER, GROUP):
                put()
                if key == CLUSTER and not texts:
                    break
            continue
        if key in (SIMPLE, BLOCK):
            if key == SIMPLE:
                put()
            f.seek(a)
            number = _varint(f, False)
            wanted = next((t for t in tracks if t["number"] == number and t.get("codec") in TEXT_CODECS), None)
            if wanted:
                start = struct.unpack(">h", _read(f, 3)[:2])[0]
                pending = (number, cluster + start, _content(f, f.tell(), b))
                if key == SIMPLE:
                    put()
            continue
        if key not in (DOC_TYPE, SCALE, DURATION, NUMBER, TYPE, CODEC, LANGUAGE, LANGUAGE_TOO, FRAME_NS, WIDTH, HEIGHT, RATE, CHANNELS, TIME, BLOCK_TIME):
            continue
        d = _content(f, a, b)
        if key == DOC_TYPE:
            name = d.decode("ascii", "replace")
        elif key == SCALE:
            scale = _unsigned(d)
        elif key == DURATION:
            units = _float(d)
        elif key == TIME:
            cluster = _unsigned(d)
        elif key == BLOCK_TIME:
            took = _unsigned(d)
        elif tracks:
            field = {NUMBER: "number", TYPE: "type", CODEC: "codec", LANGUAGE: "language", LANGUAGE_TOO: "language", FRAME_NS: "frame_ns", WIDTH: "width", HEIGHT: "height", RATE: "rate", CHANNELS: "channels"}[key]
            tracks[-1][field] = d.decode("utf-8", "replace").rstrip("\0") if key in (CODEC, LANGUAGE, LANGUAGE_TOO) else _float(d) if key == RATE else _unsigned(d)
    put()
    return name, units * scale / 1e9 if units is not None else None, tracks, blocks


def _matroska_stream(t: dict) -> dict:
    kind, language = TRACKS.get(t.get("type")), t.get("language", "eng")
    return {
        "kind": kind, "codec": t.get("codec"), "width": t.get("width"), "height": t.get("height"), "fps": 1e9 / t["frame_ns"] if kind == "video" and t.get("frame_ns") else None,
        "sample_rate": int(t.get("rate", 8000)) if kind == "audio" else None, "channels": t.get("channels", 1) if kind == "audio" else None,
        "language": None if language == "und" else language, "is_text": kind == "subtitle" and t.get("codec") in TEXT_CODECS,
    }


# audio -------------------------------------------------------------------------------------------------------------


def _audio(codec: str, rate: int, channels: int) -> list[dict]:
    return [{"kind": "audio", "codec": codec, "width": None, "height": None, "fps": None, "sample_rate": rate, "channels": channels, "language": None, "is_text": False}]


def _wave(f, size: int) -> tuple[float | None, list[dict]]:
    at, form, seconds = 12, None, None
    while at + 8 <= size:
        f.seek(at)
        kind, n = struct.unpack("<4sI", _read(f, 8))
        if kind == b"fmt ":
            form = struct.unpack("<HHIIHH", _read(f, 16))
        elif kind == b"data" and form:
            n = min(n, size - at - 8)  # a file that was cut, or written to a pipe
            seconds = n / form[3] if form[3] else None
            break
        at += 8 + n + n % 2
    return seconds, _audio("pcm" if form[0] in (1, 3, 0xFFFE) else f"0x{form[0]:04x}", form[2], form[1]) if form else []


def _flac(f) -> tuple[float | None, list[dict]]:
    f.seek(4)
    if _read(f, 1)[0] & 127:
        raise ValueError("no stream information")
    bits = int.from_bytes(_content(f, 18, 26), "big")
    rate, channels, samples = bits >> 44, (bits >> 41 & 7) + 1, bits & (1 << 36) - 1
    return samples / rate if samples and rate else None, _audio("flac", rate, channels)


def _ogg(f, size: int) -> tuple[float | None, list[dict]]:
    """By the first page's header and the last page's place, which is looked for from the end."""
    first = _content(f, 0, min(size, 256))
    head = first[27 + first[26] :]
    if head[:8] == b"OpusHead":
        codec, channels, skip, rate = "opus", head[9], struct.unpack("<H", head[10:12])[0], 48000
    elif head[1:7] == b"vorbis":
        codec, channels, skip, rate = "vorbis", head[11], 0, struct.unpack("<I", head[12:16])[0]
    else:
        raise ValueError("an Ogg stream of another kind")
    tail = _content(f, max(0, size - (1 << 16) - 512), size)
    at = tail.rfind(b"OggS")
    place = struct.unpack("<q", tail[at + 6 : at + 14])[0] if at >= 0 else -1
    return (place - skip) / rate if place >= 0 and rate else None, _audio(codec, rate, channels)


def _mp3_frame(head: bytes) -> tuple[int, int, int, int, int] | None:
    """(bytes, samples, rate, channels, version) of a layer III frame by its four bytes."""
    if len(head) < 4 or head[0] != 255 or head[1] & 0xE0 != 0xE0:
        return None
    version, layer, bits, rate = head[1] >> 3 & 3, head[1] >> 1 & 3, head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer != 1 or bits in (0, 15) or rate == 3:
        return None
    hz, samples = MP3_SAMPLES[version][rate], 1152 if version == 3 else 576
    return samples // 8 * MP3_RATES[3 if version == 3 else 2][bits] * 1000 // hz + (head[2] >> 1 & 1), samples, hz, 1 if head[3] >> 6 == 3 else 2, version


def _mp3(f, size: int) -> tuple[float | None, list[dict]]:
    """By the count of frames that the first may hold, else by walking from frame to frame."""
    f.seek(0)
    head, at = f.read(10), 0
    if head[:3] == b"ID3" and len(head) == 10:
        at = 10 + sum((b & 127) << s for b, s in zip(head[6:10], (21, 14, 7, 0), strict=True))
    f.seek(at)
    gap = f.read(1 << 16)
    skip = next((i for i in range(len(gap) - 3) if (x := _mp3_frame(gap[i : i + 4])) and (i + x[0] + 4 > len(gap) or _mp3_frame(gap[i + x[0] : i + x[0] + 4]))), None)
    if skip is None:
        raise ValueError("no frame of layer III")
    at += skip
    n, samples, hz, channels, version = _mp3_frame(gap[skip : skip + 4])
    side = skip + 4 + ((17 if channels == 1 else 32) if version == 3 else (9 if channels == 1 else 17))
    if gap[side : side + 4] in (b"Xing", b"Info") and gap[side + 7] & 1:
        return struct.unpack(">I", gap[side + 8 : side + 12])[0] * samples / hz, _audio("mp3", hz, channels)
    frames = 0
    while True:
        f.seek(at)
        x = _mp3_frame(f.read(4))
        if not x or at >= size:
            return frames * samples / hz, _audio("mp3", hz, channels)
        frames, at = frames + 1, at + x[0]


# rows --------------------------------------------------------------------------------------------------------------


def _size(f) -> int:
    return f.seek(0, io.SEEK_END)


def _facts(f) -> dict:
    size = _size(f)
    f.seek(0)
    head = f.read(12)
    if head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
        seconds, tracks = _iso(f, size)
        return {"container": "mp4", "duration_s": seconds, "streams": [t.stream() for t in tracks if t.kind]}
    if head[:4] == b"\x1aE\xdf\xa3":
        name, seconds, tracks, _ = _matroska(f, size, False)
        return {"container": name, "duration_s": seconds, "streams": [_matroska_stream(t) for t in tracks]}
    for name, fits, read in (
        ("wav", head[:4] == b"RIFF" and head[8:12] == b"WAVE", lambda: _wave(f, size)), ("flac", head[:4] == b"fLaC", lambda: _flac(f)), ("ogg", head[:4] == b"OggS", lambda: _ogg(f, size)),
        ("mp3", head[:3] == b"ID3" or head[:1] == b"\xff", lambda: _mp3(f, size)),
    ):
        if fits:
            seconds, streams = read()
            return {"container": name, "duration_s": seconds, "streams": streams}
    raise ValueError("no container that is read here")


def _captions(f) -> Iterator[dict]:
    size = _size(f)
    f.seek(0)
    head = f.read(8)
    if head[:4] == b"\x1aE\xdf\xa3":
        _, _, tracks, blocks = _matroska(f, size, True)
        of = {t["number"]: (i, t) for i, t in enumerate(tracks)}
        for place, (number, start, end, data) in enumerate(blocks):
            i, t = of[number]
            yield {"track": i, "place": place, "start_s": start, "end_s": end, "text": data.decode("utf-8", "replace"), "language": _matroska_stream(t)["language"], "codec": t["codec"]}
    elif head[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free"):
        for i, t in enumerate(_iso(f, size)[1]):
            if t.stream()["is_text"]:
                for place, (at, n, start, end) in enumerate(t.samples()):
                    yield {"track": i, "place": place, "start_s": start, "end_s": end, "text": _iso_text(t.codec, _content(f, at, at + n)), "language": t.language, "codec": t.codec}


def _opened(row: dict):
    return open_seekable(row["path"]) if row["path"] else io.BytesIO(row["content"] or b"")


def _asked(files: DataFrame) -> DataFrame:
    return files.select("uri", *(F.col(c) if c in files.columns else F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("content", "binary"))))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def read_facts(files: DataFrame) -> DataFrame:
    """(uri, duration_s, container, streams, error) of media files (uri, and path or content)."""
    schema = _arrow(FACTS)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                row = {"uri": r["uri"]}
                try:
                    with _opened(r) as f:
                        row |= _facts(f)
                except _BROKEN as x:
                    row["error"] = f"{type(x).__name__}: {x}"
                yield row

    return small_batches(_asked(files)).mapInArrow(lambda batches: gathered(run(batches), schema), FACTS)


def read_captions(files: DataFrame) -> DataFrame:
    """Rows CUES of the text tracks of media files (uri, and path or content), as they are stored; damage gives a row with
    its error after what could be read."""
    schema = _arrow(CUES)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                try:
                    with _opened(r) as f:
                        for c in _captions(f):
                            yield {"uri": r["uri"], **c}
                except _BROKEN as x:
                    yield {"uri": r["uri"], "error": f"{type(x).__name__}: {x}"}

    return small_batches(_asked(files)).mapInArrow(lambda batches: gathered(run(batches), schema), CUES)


def plain_caption(text: Column, codec: Column) -> Column:
    """The words of a stored caption: of ASS the ninth field without its overrides, else without tags."""
    ass = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"(?s)^(?:[^,]*,){8}(.*)$", 1), r"\{[^}]*\}", ""), r"\\[Nnh]", " ")
    return collapse(F.when(codec.isin("S_TEXT/ASS", "S_TEXT/SSA"), ass).otherwise(F.regexp_replace(text, r"<[^>]*>", "")))


def caption_cues(captions: DataFrame) -> DataFrame:
    """Cues (uri, seq, start_s, end_s, text, speaker, source) of each file's first text track. A caption without an end
    lasts until the next one; backward and empty ones are dropped."""
    good = captions.filter("error is null")
    first = good.groupBy(F.col("uri").alias("of")).agg(F.min("track").alias("first"))
    c = good.join(first, (F.col("uri") == F.col("of")) & (F.col("track") == F.col("first")))
    order = Window.partitionBy("uri").orderBy("start_s", "place")
    c = c.withColumn("end_s", F.coalesce("end_s", F.lead("start_s").over(order), F.col("start_s") + 5)).withColumn("text", plain_caption(F.col("text"), F.col("codec")))
    c = c.filter("end_s > start_s and text != ''")
    return c.select("uri", (F.row_number().over(order) - 1).cast("long").alias("seq"), "start_s", "end_s", "text", F.lit(None).cast("string").alias("speaker"), F.lit("captioned").alias("source"))
