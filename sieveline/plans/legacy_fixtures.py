"""Office files of before 2007 made from rows of the tables."""

from __future__ import annotations

import struct

_END, _FREE, _FAT = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams, each in sectors that stand in backward order, small ones in small sectors."""
    sectors: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        n = -(-len(data) // 512)
        if not n:
            return _END
        first = len(sectors)
        for k in range(n):  # the last part of the data first
            i = n - 1 - k
            sectors.append(data[512 * i : 512 * i + 512].ljust(512, b"\0"))
            fat.append(first + k - 1 if k else _END)
        return first + n - 1

    mini, mini_fat, entries = b"", [], []
    for name, data in streams.items():
        if len(data) >= 4096:
            entries.append((name, 2, put(data), len(data)))
            continue
        n, first = -(-len(data) // 64), len(mini_fat)
        mini += data.ljust(64 * n, b"\0")
        mini_fat += [first + k + 1 for k in range(n - 1)] + [_END] * (n > 0)
        entries.append((name, 2, first if n else _END, len(data)))
    entries.insert(0, ("Root Entry", 5, put(mini), len(mini)))
    first_mini = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) // 128) * 512, b"\xff")) if mini_fat else _END

    def entry(name: str, kind: int, start: int, size: int) -> bytes:
        return name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(name) + 2, kind, 1, _FREE, _FREE, _FREE) + bytes(36) + struct.pack("<IQ", start, size)

    directory = put(b"".join(entry(*e) for e in entries))
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat:
        n_fat += 1
    places = list(range(len(sectors), len(sectors) + n_fat))
    fat = (fat + [_FAT] * n_fat).copy()
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(512 * n_fat, b"\xff")
    sectors += [table[512 * i : 512 * i + 512] for i in range(n_fat)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIII", 0, n_fat, directory, 0, 4096)
    head += struct.pack("<IIII", first_mini, len(mini_fat) // 128 + 1 if mini_fat else 0, _END, 0) + struct.pack("<109I", *places, *[_FREE] * (109 - n_fat))
    return head + b"".join(sectors)


def doc(text: str) -> bytes:
    """A .doc whose text stands in pieces of a hundred characters, of one byte each where they can be, in backward order."""
    pieces = [text[i : i + 100] for i in range(0, len(text), 100)]
    body, where = b"", {}
    for i in reversed(range(len(pieces))):
        at = 2048 + len(body)
        try:
            body += pieces[i].encode("cp1252")
            where[i] = at * 2 | 1 << 30
        except UnicodeEncodeError:
            body += b"\0" * (at % 2)
            where[i] = 2048 + len(body)
            body += pieces[i].encode("utf-16-le")
    ends = [0]
    for p in pieces:
        ends.append(ends[-1] + len(p))
    plc = struct.pack(f"<{len(ends)}I", *ends) + b"".join(struct.pack("<HIH", 0, where[i], 0) for i in range(len(pieces)))
    table = b"\x01\x04\0abcd\x02" + struct.pack("<I", len(plc)) + plc
    fib = bytearray(2048)
    struct.pack_into("<H", fib, 0, 0xA5EC)
    struct.pack_into("<H", fib, 10, 0x200)
    struct.pack_into("<i", fib, 76, len(text))
    struct.pack_into("<II", fib, 418, 0, len(table))
    return compound({"WordDocument": bytes(fib) + body, "1Table": table})


def _record(kind: int, body: bytes = b"") -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def _string_table(strings: list[str], most: int = 300) -> bytes:
    """The table, cut into records of most bytes, also within strings."""
    parts, now = [], struct.pack("<II", len(strings), len(strings))
    for s in strings:
        wide = any(ord(c) > 255 for c in s)
        if len(now) > most - 5:
            parts.append(now)
            now = b""
        now += struct.pack("<HB", len(s), wide)
        for c in s:
            code = c.encode("utf-16-le") if wide else c.encode("latin-1")
            if len(now) + len(code) > most:
                parts.append(now)
                now = bytes([wide])
            now += code
    parts.append(now)
    return _record(0xFC, parts[0]) + b"".join(_record(0x3C, p) for p in parts[1:])


def xls(rows: list[list], name: str = "Data") -> bytes:
    """A sheet of rows: texts by the string table, whole numbers as short ones, others as doubles, (text,) as a formula's.
    Whole numbers that no double holds are texts."""
    rows = [[str(v) if isinstance(v, int) and abs(v) > 2**53 else v for v in row] for row in rows]
    strings = sorted({v for r in rows for v in r if isinstance(v, str)})
    place = {s: i for i, s in enumerate(strings)}
    cells = b""
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            at = struct.pack("<HHH", r, c, 0)
            if isinstance(v, str):
                cells += _record(0xFD, at + struct.pack("<I", place[v]))
            elif isinstance(v, tuple):
                text = v[0].encode("utf-16-le")
                cells += _record(0x06, at + b"\0" * 6 + b"\xff\xff" + bytes(8)) + _record(0x207, struct.pack("<HB", len(v[0]), 1) + text)
            elif isinstance(v, int) and abs(v) < 1 << 29:
                cells += _record(0x27E, at + struct.pack("<I", v << 2 & 0xFFFFFFFF | 2))
            elif v is not None:
                cells += _record(0x203, at + struct.pack("<d", v))
    sheet = _record(0x809, struct.pack("<HH", 0x600, 0x10) + bytes(12)) + cells + _record(0x0A)
    label = struct.pack("<BB", len(name), 0) + name.encode("latin-1")
    table = _string_table(strings)
    start = 20 + 4 + 6 + len(label) + len(table) + 4
    book = _record(0x809, struct.pack("<HH", 0x600, 5) + bytes(12)) + _record(0x85, struct.pack("<IH", start, 0) + label) + table + _record(0x0A) + sheet
    return compound({"Workbook": book})


def ppt(parts: list[tuple[str, str]]) -> bytes:
    """A slide for each (title, text), with its text as notes of the first."""

    def record(kind: int, body: bytes, holds: bool = False, instance: int = 0) -> bytes:
        return struct.pack("<HHI", instance << 4 | (15 if holds else 0), kind, len(body)) + body

    text = lambda kind, s: record(0x0F9F, struct.pack("<I", kind)) + (record(0x0FA8, s.encode("latin-1")) if s.isascii() else record(0x0FA0, s.encode("utf-16-le")))
    slides = b"".join(record(0x03F3, bytes(20)) + text(0, a) + text(1, b) for a, b in parts)
    notes = record(0x03F3, bytes(20)) + text(2, parts[0][0]) if parts else b""
    lists = record(0x0FF0, bytes(0) + slides, True, 0) + record(0x0FF0, notes, True, 2)
    return compound({"PowerPoint Document": record(0x03E8, record(0x03E9, bytes(40)) + lists, True)})
