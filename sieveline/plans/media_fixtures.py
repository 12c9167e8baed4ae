"""Media files made from rows of the tables, without pictures or sound: containers, their tables and captions."""

from __future__ import annotations

import struct
import zlib


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode()) + body


def full(kind: str, *parts: bytes) -> bytes:
    return box(kind, bytes(4), *parts)


def _table(kind: str, rows: list[tuple]) -> bytes:
    return full(kind, struct.pack(">I", len(rows)), *(struct.pack(f">{len(r)}I", *r) for r in rows))


def _track(handler: str, scale: int, units: int, language: str, entry: bytes, stts: list, stsc: list, sizes: list[int], offsets: list[int], wide: tuple[int, int] = (0, 0)) -> bytes:
    code = sum((ord(c) - 96) << s for c, s in zip(language, (10, 5, 0), strict=True))
    stbl = box("stbl", full("stsd", struct.pack(">I", 1), entry), _table("stts", stts), _table("stsc", stsc), full("stsz", struct.pack(">II", 0, len(sizes)), *(struct.pack(">I", s) for s in sizes)), _table("stco", [(o,) for o in offsets]))
    mdia = box("mdia", full("mdhd", struct.pack(">IIIIHH", 0, 0, scale, units, code, 0)), full("hdlr", bytes(4), handler.encode(), bytes(13)), box("minf", stbl))
    return box("trak", full("tkhd", bytes(72), struct.pack(">II", wide[0] << 16, wide[1] << 16)), mdia)


def mp4(cues: list[tuple[int, int, str]], frames: int = 50, language: str = "deu", per_chunk: int = 3) -> bytes:
    """A film of frames at 25 a second, sound, and a text track of cues (milliseconds), with empty samples between them."""
    samples, at = [], 0
    for start, end, text in cues:
        if start > at:
            samples.append((start - at, b"\0\0"))
        data = text.encode()
        samples.append((end - start, struct.pack(">H", len(data)) + data))
        at = end
    head = box("ftyp", b"isom", bytes(4), b"isom")
    offsets, place = [], len(head) + 8
    for i, (_, data) in enumerate(samples):
        if i % per_chunk == 0:
            offsets.append(place)
        place += len(data)
    full_chunks, left = divmod(len(samples), per_chunk)
    stsc = ([(1, per_chunk, 1)] if full_chunks else []) + ([(full_chunks + 1, left, 1)] if left else [])
    film = _track("vide", 25, frames, "und", box("avc1", bytes(78)), [(frames, 1)], [(1, frames, 1)], [0] * frames, [place], (640, 360))
    sound = _track("soun", 48000, frames * 1920, "eng", box("mp4a", bytes(16), struct.pack(">HHII", 2, 16, 0, 48000 << 16)), [], [], [], [])
    text = _track("sbtl", 1000, at, language, box("tx3g", bytes(38)), [(1, d) for d, _ in samples], stsc, [len(d) for _, d in samples], offsets)
    moov = box("moov", full("mvhd", struct.pack(">IIII", 0, 0, 1000, frames * 40), bytes(80)), film, sound, text)
    return head + box("mdat", *(d for _, d in samples)) + moov


def element(key: int, body: bytes, unknown: bool = False) -> bytes:
    k = key.to_bytes((key.bit_length() + 7) // 8, "big")
    size = b"\x01" + b"\xff" * 7 if unknown else (0x10000000 | len(body)).to_bytes(4, "big")
    return k + size + body


def _number(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def mkv(cues: list[tuple[int, int, str]], seconds: float = 2.0, language: str = "fre", codec: str = "S_TEXT/UTF8", per_cluster: int = 4) -> bytes:
    """A film and a text track of cues (milliseconds) in clusters, the segment's size unknown as in a live recording."""
    film = element(0xAE, element(0xD7, b"\1") + element(0x83, b"\1") + element(0x86, b"V_VP9") + element(0x23E383, _number(40_000_000)) + element(0xE0, element(0xB0, _number(1280)) + element(0xBA, _number(720))))
    sound = element(0xAE, element(0xD7, b"\2") + element(0x83, b"\2") + element(0x86, b"A_OPUS") + element(0xE1, element(0xB5, struct.pack(">d", 48000.0)) + element(0x9F, b"\2")))
    text = element(0xAE, element(0xD7, b"\3") + element(0x83, b"\x11") + element(0x86, codec.encode()) + element(0x22B59C, language.encode()))
    clusters = []
    for i in range(0, len(cues), per_cluster):
        some = cues[i : i + per_cluster]
        base = some[0][0]
        blocks = [element(0xA3, b"\x81" + struct.pack(">hB", 0, 0x80) + bytes(40))]
        blocks += [element(0xA0, element(0xA1, b"\x83" + struct.pack(">hB", start - base, 0) + t.encode()) + element(0x9B, _number(end - start))) for start, end, t in some]
        clusters.append(element(0x1F43B675, element(0xE7, _number(base)) + b"".join(blocks)))
    info = element(0x1549A966, element(0x2AD7B1, _number(1_000_000)) + element(0x4489, struct.pack(">d", seconds * 1000)))
    return element(0x1A45DFA3, element(0x4282, b"webm")) + element(0x18538067, info + element(0x1654AE6B, film + sound + text) + b"".join(clusters), unknown=True)


def wav(rate: int, channels: int, frames: int) -> bytes:
    data = bytes(2 * channels * frames)
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    body = b"WAVEfmt " + struct.pack("<I", 16) + form + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def flac(rate: int, channels: int, samples: int) -> bytes:
    bits = rate << 44 | (channels - 1) << 41 | 15 << 36 | samples
    return b"fLaC\x80\0\0\x22" + bytes(10) + bits.to_bytes(8, "big") + bytes(16)


def ogg(channels: int, samples: int, skip: int = 312) -> bytes:
    def page(place: int, body: bytes) -> bytes:
        return b"OggS\0\0" + struct.pack("<qIII", place, 7, 0, 0) + bytes([1, len(body)]) + body

    return page(0, b"OpusHead\1" + bytes([channels]) + struct.pack("<HIhB", skip, 48000, 0, 0)) + page(960, bytes(200)) + page(samples + skip, bytes(100))


def mp3(frames: int, channels: int = 2, counted: bool = False) -> bytes:
    """Frames of 128 kbit/s at 44100 a second behind a tag; counted: the first one holds their number."""
    frame = b"\xff\xfb\x90" + (b"\xc0" if channels == 1 else b"\0") + bytes(413)
    first = frame[:4] + bytes(17 if channels == 1 else 32) + b"Xing" + struct.pack(">II", 1, frames)
    first += bytes(417 - len(first))
    return b"ID3\4\0\0\0\0\1\x05" + bytes(133) + (first + frame * 3 if counted else frame * frames)


def png(x, depth: int = 8, colour: int = 2) -> bytes:
    """A PNG of an array (rows, columns, bytes of a pixel), whose lines use one predictor after another."""
    h, w, step = x.shape
    rows, lines = x.reshape(h, w * step).astype(int).tolist(), []
    for y, row in enumerate(rows):
        above, how = rows[y - 1] if y else [0] * len(row), y % 5
        line = []
        for i, v in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            nearest = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append(v - (0, a, b, (a + b) // 2, nearest)[how] & 255)
        lines.append(bytes([how, *line]))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    palette = chunk(b"PLTE", bytes(range(256)) * 3) if colour == 3 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + palette + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
