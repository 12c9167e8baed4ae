"""Office files of before 2007: compound files of sector chains, and what their streams hold.

A compound file is a small file system: chains of sectors (FAT), chains of small sectors (mini FAT), a directory. A .doc's
text is in pieces that its table stream lists; an .xls is a list of records (BIFF8) whose strings stand in one table that
goes on over several records; a .ppt is a tree of records. Readers yield the rows that newer formats yield. A chain that
comes back to itself or leaves the file is refused.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import pairwise

from pyspark.sql import DataFrame

from sieveline.sources.documents import BLOCKS, CELLS, SLIDES, _read

KINDS = "uri string, kind string, error string"
#: The signature, the ends of chains, streams by kind, the least size of a stream of whole sectors.
SIGNATURE, FREE, END, MINI = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", 0xFFFFFFFF, 0xFFFFFFFE, 4096
STREAMS = {"WordDocument": "doc", "Workbook": "xls", "Book": "xls", "PowerPoint Document": "ppt"}
#: Records of a workbook, errors of cells, built-in formats that are dates; records of a presentation.
BOF, EOF, SHEET, SST, CONTINUE, LABEL_SST, LABEL, RK, MUL_RK, NUMBER, FORMULA, STRING, BOOL_ERR, FILE_PASS = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0xFD, 0x204, 0x27E, 0xBD, 0x203, 0x06, 0x207, 0x205, 0x2F
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}
SLIDE_LIST, SLIDE_START, TEXT_KIND, TEXT_CHARS, TEXT_BYTES = 0x0FF0, 0x03F3, 0x0F9F, 0x0FA0, 0x0FA8
#: Nested records of a presentation.
DEEPEST = 32


class Compound:
    """The streams of a compound file by name."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack("<HH", data[30:34])
        if not 7 <= shift <= 16 or not 2 <= mini_shift <= shift:
            raise ValueError("sectors of an impossible size")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        first_dir, = struct.unpack("<I", data[48:52])
        first_mini, _, first_difat, n_difat = struct.unpack("<4I", data[60:76])
        listed = list(struct.unpack("<109I", data[76:512]))
        seen = set()
        while n_difat and first_difat < END and first_difat not in seen:
            seen.add(first_difat)
            more = struct.unpack(f"<{self.size // 4}I", self.sector(first_difat))
            listed, first_difat = listed + list(more[:-1]), more[-1]
        self.fat = [x for s in listed if s < END for x in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        directory = b"".join(map(self.sector, self.chain(first_dir, self.fat)))
        self.entries: dict[str, tuple[int, int]] = {}
        root = (END, 0)
        for at in range(0, len(directory) - 127, 128):
            e = directory[at : at + 128]
            n, kind = struct.unpack("<HB", e[64:67])
            start, size = struct.unpack("<IQ", e[116:128])
            size = size & 0xFFFFFFFF if shift == 9 else size
            if kind == 5:
                root = (start, size)
            elif kind == 2:
                self.entries.setdefault(e[: max(0, n - 2)].decode("utf-16-le", "replace"), (start, size))
        self.mini_fat = [x for s in self.chain(first_mini, self.fat) for x in struct.unpack(f"<{self.size // 4}I", self.sector(s))]
        self.mini = b"".join(map(self.sector, self.chain(root[0], self.fat)))[: root[1]]

    def sector(self, n: int) -> bytes:
        part = self.data[(n + 1) * self.size : (n + 2) * self.size]
        if not part:
            raise ValueError("a chain leaves the file")
        return part.ljust(self.size, b"\0")

    @staticmethod
    def chain(first: int, fat: list[int]) -> list[int]:
        out, seen = [], set()
        while first < END:
            if first in seen or first >= len(fat):
                raise ValueError("a chain of sectors loops or leaves the file")
            seen.add(first)
            out.append(first)
            first = fat[first]
        return out

    def stream(self, name: str) -> bytes:
        start, size = self.entries[name]
        if size >= MINI:
            return b"".join(map(self.sector, self.chain(start, self.fat)))[:size]
        parts = (self.mini[n * self.mini_size : (n + 1) * self.mini_size] for n in self.chain(start, self.mini_fat))
        return b"".join(parts)[:size]


def kind(data: bytes) -> str:
    """doc, xls, ppt or other."""
    c = Compound(data)
    return next((k for name, k in STREAMS.items() if name in c.entries), "other")


# documents ---------------------------------------------------------------------------------------------------------


def doc_text(data: bytes) -> str:
    """The main text of a .doc, put together from its pieces; field codes are left out, their results stay."""
    c = Compound(data)
    word = c.stream("WordDocument")
    flags, = struct.unpack("<H", word[10:12])
    if flags & 0x100:
        raise ValueError("the document is encrypted")
    table = c.stream("1Table" if flags & 0x200 else "0Table")
    length, = struct.unpack("<i", word[76:80])
    at, size = struct.unpack("<II", word[418:426])
    clx = table[at : at + size]
    while clx[:1] == b"\x01":
        clx = clx[3 + struct.unpack("<H", clx[1:3])[0] :]
    if clx[:1] != b"\x02":
        raise ValueError("the document has no list of pieces")
    plc = clx[5 : 5 + struct.unpack("<I", clx[1:5])[0]]
    n = (len(plc) - 4) // 12
    ends = struct.unpack(f"<{n + 1}I", plc[: 4 * n + 4])
    out = []
    for i, (a, b) in enumerate(pairwise(ends)):
        a, b = min(a, length), min(b, length)
        fc, = struct.unpack("<I", plc[4 * n + 6 + 8 * i : 4 * n + 10 + 8 * i])
        if fc & 1 << 30:
            begin = (fc & (1 << 30) - 1) // 2
            out.append(word[begin : begin + b - a].decode("cp1252", "replace"))
        else:
            out.append(word[fc : fc + 2 * (b - a)].decode("utf-16-le", "replace"))
    text, before = "".join(out), None
    while text != before:  # from within: fields in fields
        before, text = text, re.sub(r"\x13[^\x13\x14\x15]*(?:\x14([^\x13\x15]*))?\x15", lambda m: m[1] or "", text)
    return text


def doc_blocks(data: bytes) -> Iterator[tuple[int, str, str]]:
    """(level, kind, text) of a .doc in order; cells of a table's row stand in one line."""
    rows: list[str] = []
    row: list[str] = []
    for paragraph in doc_text(data).replace("\x0b", "\n").replace("\x0c", "\r").split("\r"):
        *cells, rest = paragraph.split("\x07")
        for cell in cells:
            if cell or not row:
                row.append(cell)
            else:  # the mark behind a row's last cell
                rows.append(" | ".join(row))
                row = []
        text = re.sub(r"[\x00-\x08\x0e-\x1f]", "", rest).strip()
        if text:
            if rows:
                yield 0, "table", "\n".join(rows)
                rows = []
            yield 0, "paragraph", text
    if row:
        rows.append(" | ".join(row))
    if rows:
        yield 0, "table", "\n".join(rows)


# workbooks ---------------------------------------------------------------------------------------------------------


def _records(book: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(place, kind, body) of the records."""
    at = 0
    while at + 4 <= len(book):
        k, n = struct.unpack("<HH", book[at : at + 4])
        yield at, k, book[at + 4 : at + 4 + n]
        at += 4 + n


class _Strings:
    """A string table that goes on in continued records: characters that are cut at a record's end go on behind a new flag
    of their width."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.i, self.at = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.parts[self.i]):
                self.i, self.at = self.i + 1, 0
            piece = self.parts[self.i][self.at : self.at + n - len(out)]
            self.at += len(piece)
            out += piece
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n:
            if self.at >= len(self.parts[self.i]):
                self.i, self.at = self.i + 1, 1
                wide = self.parts[self.i][0] & 1
            have = min(n, (len(self.parts[self.i]) - self.at) // (2 if wide else 1))
            if not have:
                raise ValueError("a string ends within a character")
            piece = self.take(have * (2 if wide else 1))
            out += piece.decode("utf-16-le" if wide else "latin-1", "replace")
            n -= have
        self.take(4 * runs + extra)
        return out


def _rk(v: int) -> float:
    x = float(v >> 2 if not v & 0x80000000 else (v >> 2) - (1 << 30)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return x / 100 if v & 1 else x


def _number(x: float) -> str:
    return str(int(x)) if abs(x) <= 2**53 and x == int(x) else repr(x)  # a double holds whole numbers up to there


def _short(b: bytes) -> str:
    n, flags = struct.unpack("<HB", b[:3])
    return b[3 : 3 + n * (2 if flags & 1 else 1)].decode("utf-16-le" if flags & 1 else "latin-1", "replace")


def xls_cells(data: bytes) -> Iterator[tuple[str, int, int, int, str | None, str | None]]:
    """(sheet, its number, row, col, value, formula) of a workbook's cells; of a formula its kept value, its text is not."""
    c = Compound(data)
    book = c.stream("Workbook" if "Workbook" in c.entries else "Book")
    sheets: list[tuple[str, int]] = []
    strings: list[str] = []
    table: list[bytes] = []
    for _, k, b in _records(book):
        if k == FILE_PASS:
            raise ValueError("the workbook is encrypted")
        if k == SHEET:
            n, flags = b[6], b[7]
            sheets.append((b[8 : 8 + n * (2 if flags & 1 else 1)].decode("utf-16-le" if flags & 1 else "latin-1", "replace"), struct.unpack("<I", b[:4])[0]))
        if k == SST or table and k == CONTINUE:
            table.append(b)
        elif table and not strings:
            count, = struct.unpack("<I", table[0][4:8])
            s = _Strings([table[0][8:], *table[1:]])
            strings = [s.string() for _ in range(count)]
        if k == EOF:
            break
    for number, (name, place) in enumerate(sheets):
        waiting = None
        for _, k, b in _records(book[place:]):
            if k == EOF:
                break
            if k == STRING and waiting:
                yield name, number, *waiting, _short(b), None
                waiting = None
            elif k in (LABEL_SST, LABEL, RK, NUMBER, BOOL_ERR, FORMULA):
                row, col = struct.unpack("<HH", b[:4])
                if k == LABEL_SST:
                    yield name, number, row, col, strings[struct.unpack("<I", b[6:10])[0]], None
                elif k == LABEL:
                    yield name, number, row, col, _short(b[6:]), None
                elif k == RK:
                    yield name, number, row, col, _number(_rk(struct.unpack("<I", b[6:10])[0])), None
                elif k == NUMBER:
                    yield name, number, row, col, _number(struct.unpack("<d", b[6:14])[0]), None
                elif k == BOOL_ERR:
                    yield name, number, row, col, ERRORS.get(b[6], "#ERR") if b[7] else ("TRUE" if b[6] else "FALSE"), None
                elif b[12:14] != b"\xff\xff":
                    yield name, number, row, col, _number(struct.unpack("<d", b[6:14])[0]), None
                elif b[6] == 0:
                    waiting = (row, col)
                else:
                    yield name, number, row, col, ("TRUE" if b[8] else "FALSE") if b[6] == 1 else ERRORS.get(b[8], "#ERR") if b[6] == 2 else "", None
            elif k == MUL_RK:
                row, first = struct.unpack("<HH", b[:4])
                for i in range((len(b) - 6) // 6):
                    yield name, number, row, first + i, _number(_rk(struct.unpack("<I", b[6 + 6 * i : 10 + 6 * i])[0])), None


# presentations -----------------------------------------------------------------------------------------------------


def _tree(data: bytes, depth: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(kind, instance, body) of the records, those that hold others before what they hold."""
    at = 0
    while at + 8 <= len(data):
        head, k, n = struct.unpack("<HHI", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        yield k, head >> 4, body
        if head & 15 == 15 and depth < DEEPEST:
            yield from _tree(body, depth + 1)
        at += 8 + n


def ppt_slides(data: bytes) -> Iterator[tuple[str, str, str]]:
    """(title, body, notes) of each slide, from the presentation's lists of slides and notes."""
    slides: list[list[tuple[int, str]]] = []
    notes: list[list[str]] = []
    for k, instance, body in _tree(Compound(data).stream("PowerPoint Document")):
        if k != SLIDE_LIST or instance not in (0, 2):
            continue
        kind_ = 4
        for k2, _, b in _tree(body):
            if k2 == SLIDE_START:
                (slides if instance == 0 else notes).append([])
            elif k2 == TEXT_KIND:
                kind_, = struct.unpack("<I", b[:4])
            elif k2 in (TEXT_CHARS, TEXT_BYTES):
                text = b.decode("utf-16-le" if k2 == TEXT_CHARS else "latin-1", "replace").replace("\r", "\n").replace("\x0b", "\n").strip()
                if instance == 0 and slides:
                    slides[-1].append((kind_, text))
                elif notes:
                    notes[-1].append(text)
    for i, parts in enumerate(slides):
        title = next((t for k, t in parts if k in (0, 6)), "")
        yield title, "\n".join(t for k, t in parts if k not in (0, 6) and t), "\n".join(t for t in notes[i] if t) if i < len(notes) else ""


# rows --------------------------------------------------------------------------------------------------------------


def read_kinds(files: DataFrame) -> DataFrame:
    """(uri, kind, error) of compound files (uri, content): doc, xls, ppt or other."""
    return _read(files, KINDS, lambda d: [{"kind": kind(d)}])


def read_doc(files: DataFrame) -> DataFrame:
    """Rows BLOCKS of .doc files."""
    return _read(files, BLOCKS, lambda d: ({"seq": i, "level": level, "kind": k, "text": t} for i, (level, k, t) in enumerate(doc_blocks(d))))


def read_xls(files: DataFrame) -> DataFrame:
    """Rows CELLS of .xls files, rows and columns as in newer workbooks."""
    return _read(files, CELLS, lambda d: ({"sheet": s, "sheet_no": n, "row": r, "col": c, "value": v, "formula": f} for s, n, r, c, v, f in xls_cells(d)))


def read_ppt(files: DataFrame) -> DataFrame:
    """Rows SLIDES of .ppt files."""
    return _read(files, SLIDES, lambda d: ({"page": i, "title": t, "body": b, "notes": n, "n_media": 0} for i, (t, b, n) in enumerate(ppt_slides(d), 1)))
