"""Files made from rows of the tables, so that readers of files can be run and checked on them: archives, office packages,
books, PDF pages. Each is written from one row in an Arrow batch, like a file that a tree holds."""

from __future__ import annotations

import hashlib
import io
import tarfile
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.sources.files import gathered, small_batches

_W, _A, _P = 'xmlns:w="urn:w"', 'xmlns:a="urn:a"', 'xmlns:p="urn:p"'


def zipped(members: list[tuple[str, str | bytes]], mimetype: str | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if mimetype:
            z.writestr(zipfile.ZipInfo("mimetype"), mimetype)
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data)
    return out.getvalue()


def tarred(members: list[tuple[str, str]], mode: str = "w:gz") -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for name, text in members:
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def docx(parts: list[tuple[str, str]]) -> bytes:
    """A heading and a paragraph for each (title, text), a table of the titles, and a comment by `reader`."""
    body = "".join(
        f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{escape(a)}</w:t></w:r></w:p><w:p><w:r><w:t>{escape(b)}</w:t></w:r></w:p>' for a, b in parts
    )
    table = "".join(f"<w:tr><w:tc><w:p><w:r><w:t>{i}</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{escape(a)}</w:t></w:r></w:p></w:tc></w:tr>" for i, (a, _) in enumerate(parts))
    return zipped([
        ("[Content_Types].xml", "<Types/>"), ("word/document.xml", f"<w:document {_W}><w:body>{body}<w:tbl>{table}</w:tbl></w:body></w:document>"),
        ("word/comments.xml", f'<w:comments {_W}><w:comment w:author="reader"><w:p><w:r><w:t>{len(parts)} parts</w:t></w:r></w:p></w:comment></w:comments>'),
    ])


def odt(parts: list[tuple[str, str]]) -> bytes:
    body = "".join(f'<t:h t:outline-level="1">{escape(a)}</t:h><t:p>{escape(b)}</t:p>' for a, b in parts)
    return zipped([("content.xml", f'<o:d xmlns:o="urn:o" xmlns:t="urn:t"><o:text>{body}</o:text></o:d>')], "application/vnd.oasis.opendocument.text")


def pptx(parts: list[tuple[str, str]]) -> bytes:
    """A slide for each (title, text), with a picture on the first."""
    members = []
    for i, (a, b) in enumerate(parts, 1):
        pic = '<p:pic><p:blipFill><a:blip r:embed="rId1" xmlns:r="urn:r"/></p:blipFill></p:pic>' if i == 1 else ""
        shape = f'<p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>{escape(a)}</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>{escape(b)}</a:t></a:r></a:p></p:sp>'
        members.append((f"ppt/slides/slide{i}.xml", f"<p:sld {_P} {_A}>{shape}{pic}</p:sld>"))
    rels = '<Relationships><Relationship Id="rId1" Target="../media/image1.png"/></Relationships>'
    return zipped([*members, ("ppt/slides/_rels/slide1.xml.rels", rels), ("ppt/media/image1.png", b"\x89PNG" + bytes(20))])


def xlsx(rows: list[list[str]], name: str = "Data") -> bytes:
    """A sheet of rows; a value that begins with = is a formula without a stored value."""

    def cell(r: int, c: int, v: str) -> str:
        at = f"{chr(65 + c)}{r + 1}"
        return f'<c r="{at}"><f>{escape(v[1:])}</f></c>' if v.startswith("=") else f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'

    data = "".join(f"<row>{''.join(cell(r, c, v) for c, v in enumerate(row) if v is not None)}</row>" for r, row in enumerate(rows))
    return zipped([
        ("xl/workbook.xml", f'<workbook xmlns:r="urn:r"><sheets><sheet name="{escape(name)}" r:id="rId1"/></sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>'),
        ("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{data}</sheetData></worksheet>"),
    ])


def epub(parts: list[tuple[str, str]]) -> bytes:
    """A chapter for each (title, text)."""
    n = range(1, len(parts) + 1)
    items = "".join(f'<item id="c{i}" href="ch{i}.xhtml"/>' for i in n) + '<item id="n" href="nav.xhtml" properties="nav"/>'
    spine = "".join(f'<itemref idref="c{i}"/>' for i in n)
    nav = "".join(f'<a href="ch{i}.xhtml">{escape(a)}</a>' for i, (a, _) in zip(n, parts, strict=True))
    chapters = [(f"OEBPS/ch{i}.xhtml", f"<h1>{escape(a)}</h1><p>{escape(b)}</p>") for i, (a, b) in zip(n, parts, strict=True)]
    opf = f"<package><metadata><title>Talk</title><creator>Many</creator></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>"
    head = '<container><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>'
    return zipped([("META-INF/container.xml", head), ("OEBPS/b.opf", opf), ("OEBPS/nav.xhtml", f"<html>{nav}</html>"), *chapters], "application/epub+zip")


def pdf(parts: list[tuple[str, str]]) -> bytes:
    """A page for each (title, text), two lines, in UTF-16 codes with a ToUnicode map; and a page that is blank."""
    kids = " ".join(f"{10 + 2 * i} 0 R" for i in range(len(parts) + 1))
    cmap = b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfrange <0000> <D7FF> <0000> endbfrange beginbfrange <E000> <FFFF> <E000> endbfrange"
    objects = {
        1: b"<</Type /Catalog /Pages 2 0 R>>", 2: f"<</Type /Pages /Kids [{kids}] /Count {len(parts) + 1} /Resources <</Font <</F1 3 0 R>>>>>>".encode(),
        3: b"<</Type /Font /Subtype /Type0 /ToUnicode 4 0 R>>", 4: b"<</Length %d>>\nstream\n" % len(cmap) + cmap + b"\nendstream",
    }
    for i, (a, b) in enumerate([*parts, ("", "")]):
        shown = " 0 -14 Td ".join(f"<{x.encode('utf-16-be').hex()}> Tj" for x in (a, b) if x)
        data = f"BT /F1 12 Tf {shown} ET".encode()
        objects[10 + 2 * i] = f"<</Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R>>".encode()
        objects[11 + 2 * i] = b"<</Length %d>>\nstream\n" % len(data) + data + b"\nendstream"
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in sorted(objects.items())) + b"%%EOF"


def laid_out(parts: list[tuple[str, str]]) -> bytes:
    """A PDF page for each (title, text) as layout programs write them: the title in a form that spans the page, under it
    ten pieces of the text's MD5 in two columns, line by line across both, in a packed stream; an inline image's bytes."""
    kids = " ".join(f"{10 + 3 * i} 0 R" for i in range(len(parts)))
    objects = {
        1: b"<</Type /Catalog /Pages 2 0 R>>", 2: f"<</Type /Pages /Kids [{kids}] /Count {len(parts)} /MediaBox [0 0 600 800]>>".encode(),
        3: b"<</Type /Font /Subtype /Type1 /Encoding <</BaseEncoding /WinAnsiEncoding /Differences [200 /zero /one /two /three /four /five /six /seven /eight /nine]>>>>",
    }
    for i, (title, text) in enumerate(parts):
        digest = hashlib.md5(text.encode()).hexdigest()
        piece = lambda k, digest=digest: "".join(f"\\{200 + int(c):o}" if c.isdigit() else c for c in digest[3 * k : 3 * k + 3])
        lines = " ".join(f"1 0 0 1 {320 if k % 2 else 50} {600 - 14 * (k // 2)} Tm ({piece(k)}) Tj" for k in range(10))
        body = zlib.compress(f"q 1 0 0 1 50 700 cm /T Do Q q 9 0 0 9 0 0 cm BI /W 1 /H 1 ID (no) Tj EI Q BT /F1 10 Tf {lines} ET".encode("latin-1"))
        form = f"BT /F1 20 Tf ({title}) Tj ET".encode("latin-1")
        n = 10 + 3 * i
        objects[n] = f"<</Type /Page /Parent 2 0 R /Contents {n + 1} 0 R /Resources <</Font <</F1 3 0 R>> /XObject <</T {n + 2} 0 R>>>>>>".encode()
        objects[n + 1] = b"<</Filter /FlateDecode /Length %d>>\nstream\n" % len(body) + body + b"\nendstream"
        objects[n + 2] = b"<</Type /XObject /Subtype /Form /BBox [0 0 500 30] /Resources <</Font <</F1 3 0 R>>>> /Length %d>>\nstream\n" % len(form) + form + b"\nendstream"
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in sorted(objects.items())) + b"trailer <</Root 1 0 R>>\n%%EOF"


def made(rows: DataFrame, make: Callable[[dict], bytes]) -> DataFrame:
    """(uri, content) of rows (uri, ...)."""

    schema = "uri string, content binary"

    def run(batches):
        return gathered(({"uri": r["uri"], "content": make(r)} for b in batches for r in b.to_pylist()), schema)

    return small_batches(rows).mapInArrow(run, schema)


def spread(rows: DataFrame, key: str, each: int = 20_000) -> DataFrame:
    """Rows dealt over tasks by a key, at most about so many to one: what is made of a row may weigh far more than it."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
    return rows.repartition(n, key)


def talks(conversations: DataFrame, suffix: str, make: Callable[[list[tuple[str, str]]], bytes]) -> DataFrame:
    """A file for each conversation: a part (role, text) for each turn, white space in texts collapsed."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    g = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", text.alias("text")))).alias("turns"))
    rows = g.select(F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit(f".{suffix}")).alias("uri"), "turns")
    return made(rows, lambda r: make([(t["role"], t["text"]) for t in r["turns"]]))


def spoiled(archive: bytes, member: str) -> bytes:
    """A zip whose member's packed bytes are no Deflate stream; all else in it is as it was."""
    with zipfile.ZipFile(io.BytesIO(archive)) as z:
        e = z.getinfo(member)
    at = e.header_offset + 30 + len(e.filename.encode())
    return archive[:at] + b"\xff" * e.compress_size + archive[at + e.compress_size :]


def written(rows: DataFrame, folder: str, many: int, suffix: str, pack: Callable[[list[dict]], bytes]) -> int:
    """Files in folder, each packed from so many rows (at most) of one task; their number. A task that runs again writes
    the same names."""
    from pyarrow import fs

    def run(batches):
        import pyspark

        part, n = pyspark.TaskContext.get().partitionId(), 0
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        held: list[dict] = []

        def put():
            with store.open_output_stream(f"{base}/part-{part:05d}-{n:05d}{suffix}") as f:
                f.write(pack(held))

        for b in batches:
            for r in b.to_pylist():
                held.append(r)
                if len(held) == many:
                    put()
                    held, n = [], n + 1
        if held:
            put()
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
