"""Packages of XML: books, word processing, slides and sheets, read into the long tables that operators share.

A reader takes one file's bytes and yields rows; entity declarations are refused, encrypted books are not read. Headings,
order, flattening and notes are for the plan. What needs a missing program or model (page images, PDF text, speech) is
given as a function and runs in Arrow batches; without it the operation does not exist.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.html import parsed
from sieveline.sources.files import gathered, record_batch, small_batches

BLOCKS = "uri string, seq long, level int, kind string, text string, error string"
SLIDES = "uri string, page int, title string, body string, notes string, n_media int, error string"
CELLS = "uri string, sheet string, sheet_no int, row int, col int, value string, formula string, error string"
PARTS = "uri string, part_no int, part string, title string, html string, book_title string, author string, error string"
MEDIA = "uri string, page int, picture int, mime string, size_bytes long, error string"
_BROKEN = (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, IndexError, StopIteration, RuntimeError, NotImplementedError, OverflowError, TypeError, zlib.error, struct.error)


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    data = z.read(name)
    if b"<!ENTITY" in data[:65536]:
        raise ValueError("entity declarations are refused")
    return ET.fromstring(data)


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _all(e: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _tag(x) in names)


def _runs(e: ET.Element) -> str:
    """The words of an OOXML paragraph."""
    return "".join("\t" if _tag(x) == "tab" else "\n" if _tag(x) == "br" else x.text or "" for x in _all(e, "t", "tab", "br"))


def _words(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def _kind(z: zipfile.ZipFile) -> str:
    names = set(z.namelist())
    return "odf" if "content.xml" in names else "ooxml"


def _table(rows: list[list[str]]) -> str:
    return "\n".join(" | ".join(r) for r in rows)


def word_blocks(data: bytes) -> Iterator[tuple[int, str, str]]:
    """(level, kind, text) of a word-processing document in order, tables in their places."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if _kind(z) == "odf":
            body = next(_all(_xml(z, "content.xml"), "text"))
            for e in body:
                if _tag(e) == "h":
                    yield int(_attr(e, "outline-level") or 1), "heading", _words(e)
                elif _tag(e) in ("p", "list"):
                    yield 0, "paragraph", _words(e)
                elif _tag(e) == "table":
                    yield 0, "table", _table([[_words(c) for c in _all(r, "table-cell")] for r in _all(e, "table-row")])
            return
        for e in next(_all(_xml(z, "word/document.xml"), "body")):
            if _tag(e) == "p":
                style = next((_attr(s, "val") or "" for s in _all(e, "pStyle")), "")
                m = re.fullmatch(r"(?i)heading ?(\d)", style)
                level = int(m[1]) if m else 1 if style.lower() == "title" else 0
                yield level, "heading" if level else "paragraph", _runs(e)
            elif _tag(e) == "tbl":
                yield 0, "table", _table([["\n".join(map(_runs, _all(c, "p"))) for c in r if _tag(c) == "tc"] for r in _all(e, "tr")])


def comments(data: bytes) -> Iterator[tuple[str, str]]:
    """(author, text) of a docx's comments."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "word/comments.xml" in z.namelist():
            for c in _all(_xml(z, "word/comments.xml"), "comment"):
                yield _attr(c, "author") or "", "\n".join(map(_runs, _all(c, "p")))


def slides(data: bytes) -> Iterator[tuple[str, str, str, int]]:
    """(title, body, notes, media) of each slide."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if _kind(z) == "odf":
            for page in _all(_xml(z, "content.xml"), "page"):
                note = " ".join(_words(n) for n in _all(page, "notes"))
                frames = [f for f in page if _tag(f) == "frame"]
                title = next((_words(f) for f in frames if _attr(f, "class") == "title"), "")
                yield title, "\n".join(w for f in frames if _attr(f, "class") != "title" and (w := _words(f))), note, sum(1 for _ in _all(page, "image"))
            return
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for name in names:
            title, body = "", []
            root = _xml(z, name)
            for shape in _all(root, "sp"):
                text = "\n".join(t for p in _all(shape, "p") if (t := _runs(p)))
                if any(_attr(p, "type") in ("title", "ctrTitle") for p in _all(shape, "ph")):
                    title = text
                elif text:
                    body.append(text)
            rels = f"ppt/slides/_rels/{posixpath.basename(name)}.rels"
            targets = [_attr(r, "Target") or "" for r in _xml(z, rels)] if rels in z.namelist() else []
            noted = [posixpath.normpath(posixpath.join("ppt/slides", t)) for t in targets if "notesSlide" in t]
            notes = "\n".join(t for n in noted if n in z.namelist() for p in _all(_xml(z, n), "p") if (t := _runs(p)))
            yield title, "\n".join(body), notes, sum(1 for _ in _all(root, "pic"))


#: Types of pictures by the end of their names.
PICTURES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "emf": "image/x-emf", "wmf": "image/x-wmf"}


def media(data: bytes) -> Iterator[tuple[int, int, str, int]]:
    """(slide, picture, type, bytes) of the pictures of an OOXML deck; none of another."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if _kind(z) == "odf":
            return
        sizes = {i.filename: i.file_size for i in z.infolist()}
        names = sorted((n for n in sizes if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for page, name in enumerate(names, 1):
            rels = f"ppt/slides/_rels/{posixpath.basename(name)}.rels"
            target = {_attr(r, "Id"): posixpath.normpath(posixpath.join("ppt/slides", _attr(r, "Target") or "")) for r in _xml(z, rels)} if rels in sizes else {}
            blips = [next((_attr(b, "embed") for b in _all(pic, "blip")), None) for pic in _all(_xml(z, name), "pic")]
            for k, part in enumerate(target.get(b) or "" for b in blips):
                yield page, k, PICTURES.get(part.rpartition(".")[2].lower(), "application/octet-stream"), sizes.get(part, 0)


def cells(data: bytes) -> Iterator[tuple[str, int, int, int, str | None, str | None]]:
    """(sheet, sheet number, row, column, value, formula) of the cells that are used."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if _kind(z) == "odf":
            for no, table in enumerate(_all(_xml(z, "content.xml"), "table")):
                row = 0
                for r in _all(table, "table-row"):
                    col = 0
                    for c in r:
                        times = int(_attr(c, "number-columns-repeated") or 1)
                        value, formula = _words(c) or _attr(c, "value"), _attr(c, "formula")
                        for k in range(times if value or formula else 0):
                            yield _attr(table, "name") or f"Sheet{no + 1}", no, row, col + k, value, (formula or "").removeprefix("of:=") or None
                        col += times
                    row += int(_attr(r, "number-rows-repeated") or 1)
            return
        shared = ["".join(t.text or "" for t in _all(s, "t")) for s in _all(_xml(z, "xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        target = {_attr(r, "Id"): _attr(r, "Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        for no, s in enumerate(_all(_xml(z, "xl/workbook.xml"), "sheet")):
            part = (target.get(_attr(s, "id")) or "").lstrip("/")
            root = _xml(z, part if part.startswith("xl/") else f"xl/{part}")
            for c in _all(root, "c"):
                m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r") or "")
                if not m:
                    continue
                col = 0
                for ch in m[1]:
                    col = col * 26 + ord(ch) - 64
                v, f = next((x.text for x in c if _tag(x) == "v"), None), next((x.text for x in c if _tag(x) == "f"), None)
                if c.get("t") == "s" and v is not None:
                    v = shared[int(v)]
                elif c.get("t") == "inlineStr":
                    v = "".join(t.text or "" for t in _all(c, "t"))
                yield _attr(s, "name") or f"Sheet{no + 1}", no, int(m[2]) - 1, col - 1, v, f


def book_parts(data: bytes) -> Iterator[tuple[str, str, str, str, str]]:
    """(part, title, markup, the book's title, its author) of a book's chapters in reading order; the chapter's title is
    the table of contents'."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        if "META-INF/encryption.xml" in names:
            raise ValueError("the book is encrypted")
        opf = _attr(next(_all(_xml(z, "META-INF/container.xml"), "rootfile")), "full-path")
        at = lambda base, href: posixpath.normpath(posixpath.join(posixpath.dirname(base), urllib.parse.unquote(href.partition("#")[0])))
        root = _xml(z, opf)
        items = {i.get("id"): i for i in _all(root, "item")}
        said = [next((_words(e) for e in _all(root, k)), "") for k in ("title", "creator")]
        labels: dict[str, str] = {}
        for i in items.values():
            path = at(opf, i.get("href") or "")
            if path not in names:
                continue
            if "nav" in (i.get("properties") or "").split():
                found = [(at(path, a.get("href") or ""), _words(a)) for a in _all(_xml(z, path), "a")]
                labels = dict(reversed(found)) | {k: v for k, v in labels.items() if k not in dict(found)}
            elif (i.get("media-type") or "") == "application/x-dtbncx+xml":
                found = [(at(path, next(_all(p, "content")).get("src") or ""), _words(next(_all(p, "text")))) for p in _all(_xml(z, path), "navPoint")]
                labels = dict(reversed(found)) | labels
        for ref in _all(root, "itemref"):
            item = items.get(ref.get("idref"))
            path = at(opf, item.get("href") or "") if item is not None else None
            if path in names:
                yield path, labels.get(path) or "", z.read(path).decode("utf-8", "replace"), *said


def _read(files: DataFrame, schema: str, rows: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """One row a thing; a file that cannot be read gives a row with uri and error alone."""

    def told(batches):
        for b in batches:
            for uri, data in zip(b["uri"].to_pylist(), b["content"].to_pylist(), strict=True):
                try:
                    out = [{"uri": uri} | r for r in rows(data)]
                except _BROKEN as x:
                    out = [{"uri": uri, "error": f"{type(x).__name__}: {x}"}]
                yield from out

    return small_batches(files).select("uri", "content").mapInArrow(lambda batches: gathered(told(batches), schema), schema)


def read_word(files: DataFrame) -> DataFrame:
    return _read(files, BLOCKS, lambda d: ({"seq": i, "level": lv, "kind": k, "text": t} for i, (lv, k, t) in enumerate(word_blocks(d))))


def read_comments(files: DataFrame) -> DataFrame:
    return _read(files, "uri string, seq long, author string, text string, error string", lambda d: ({"seq": i, "author": a, "text": t} for i, (a, t) in enumerate(comments(d))))


def read_slides(files: DataFrame) -> DataFrame:
    return _read(files, SLIDES, lambda d: ({"page": i, "title": t, "body": b, "notes": n, "n_media": m} for i, (t, b, n, m) in enumerate(slides(d), 1)))


def read_cells(files: DataFrame) -> DataFrame:
    return _read(files, CELLS, lambda d: ({"sheet": s, "sheet_no": no, "row": r, "col": c, "value": v, "formula": f} for s, no, r, c, v, f in cells(d)))


def read_books(files: DataFrame) -> DataFrame:
    return _read(files, PARTS, lambda d: ({"part_no": i, "part": p, "title": t, "html": h, "book_title": b, "author": a} for i, (p, t, h, b, a) in enumerate(book_parts(d))))


def read_media(files: DataFrame) -> DataFrame:
    return _read(files, MEDIA, lambda d: ({"page": p, "picture": k, "mime": m, "size_bytes": n} for p, k, m, n in media(d)))


def book_blocks(parts: DataFrame) -> DataFrame:
    """Blocks of chapters (uri, part_no, part, seq, level, text, start, end), by the same reader as web pages."""
    b = parsed(parts.filter("error is null").select("uri", "part_no", "part", "html")).select("uri", "part_no", "part", F.explode("blocks").alias("b"))
    return b.select("uri", "part_no", "part", "b.seq", "b.level", "b.text", "b.start", "b.end")


def by_function(rows: DataFrame, call: Callable[[dict], dict], schema: str, parallel: int | None = None) -> DataFrame:
    """Rows through an external program or model: call gets a row as a dict and gives one of schema. parallel bounds how
    many calls run at once, by the number of partitions. An exception becomes a row with its text in `error`."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                try:
                    out.append(call(r) | {"error": None})
                except Exception as x:  # noqa: BLE001  whatever a model's client raises is a fact about the row
                    out.append({k: r.get(k) for k in names} | {"error": f"{type(x).__name__}: {x}"})
            yield record_batch(out, schema)

    return (rows.repartition(parallel) if parallel else rows).mapInArrow(run, schema)


def languages(streams) -> object:
    """The languages that a column of streams names, each once, in order."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(streams, lambda s: s["language"]))))


def frame_states(frames: DataFrame) -> DataFrame:
    """(uri, state, n, first): of frames (uri, seq, described) how many were described, empty or not looked at, and the
    first places of each."""
    state = F.when(F.col("described").isNull(), "not looked at").when(F.trim("described") == "", "empty").otherwise("described")
    return frames.withColumn("state", state).groupBy("uri", "state").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


def described_frames(frames: DataFrame, descriptions: DataFrame) -> DataFrame:
    """frames (uri, seq, start_s) with what was said of them (uri, seq, text); a frame without a word says so."""
    said = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("(no description was produced for this frame)"))
    return frames.join(descriptions.select("uri", "seq", "text"), ["uri", "seq"], "left").withColumn("text", said)


def probe_facts(probed: DataFrame) -> DataFrame:
    """(uri, duration_s, container, streams) of a media prober's JSON (uri, json): rates as numbers, 0/0 and absent
    values null."""
    schema = "struct<format:struct<duration:string,format_name:string>,streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,sample_rate:string,channels:int,tags:map<string,string>>>>"
    j = F.from_json("json", schema)

    def stream(s):
        num, den = F.split_part(s["avg_frame_rate"], F.lit("/"), F.lit(1)).cast("double"), F.split_part(s["avg_frame_rate"], F.lit("/"), F.lit(2)).cast("double")
        text = s["codec_name"].isin("subrip", "ass", "ssa", "webvtt", "mov_text", "text")
        return F.struct(
            s["codec_type"].alias("kind"), s["codec_name"].alias("codec"), s["width"].alias("width"), s["height"].alias("height"),
            F.when((num > 0) & (den > 0), num / den).alias("fps"), s["sample_rate"].cast("int").alias("sample_rate"), s["channels"].alias("channels"),
            F.try_element_at(s["tags"], F.lit("language")).alias("language"), (text & (s["codec_type"] == "subtitle")).alias("is_text"),
        )

    return probed.select("uri", j["format"]["duration"].cast("double").alias("duration_s"), j["format"]["format_name"].alias("container"), F.transform(j["streams"], stream).alias("streams"))
