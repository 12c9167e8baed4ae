"""Detection, archives, office packages, the four questions and streams, on files made here."""

import bz2
import gzip
import io
import json
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from sieveline.plans import fixtures
from sieveline.plans.perception import Perception, tools
from sieveline.sources import containers, documents, files, pdf
from sieveline.streaming import ingest


def zipped(entries, stored_first=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        if stored_first:
            z.writestr(zipfile.ZipInfo("mimetype"), stored_first)
        for k, v in entries.items():
            z.writestr(k, v)
    return out.getvalue()


def tarred(entries, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for k, v in entries.items():
            i = tarfile.TarInfo(k)
            if v is None:
                i.type, i.linkname = tarfile.SYMTYPE, "x"
                t.addfile(i)
            else:
                i.size = len(v)
                t.addfile(i, io.BytesIO(v))
    return out.getvalue()


W = 'xmlns:w="http://w" xmlns:r="http://r"'
DOCX = zipped({
    "[Content_Types].xml": "<Types/>",
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Intro</w:t></w:r></w:p><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>world</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
    "word/comments.xml": f'<w:comments {W}><w:comment w:author="Ann"><w:p><w:r><w:t>why?</w:t></w:r></w:p></w:comment></w:comments>',
})
PPTX = zipped({
    "ppt/slides/slide1.xml": '<p:sld xmlns:p="http://p" xmlns:a="http://a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>Body</a:t></a:r></a:p></p:sp><p:pic/></p:sld>',
    "ppt/slides/_rels/slide1.xml.rels": '<Relationships><Relationship Target="../notesSlides/notesSlide1.xml"/></Relationships>',
    "ppt/notesSlides/notesSlide1.xml": '<p:notes xmlns:p="http://p" xmlns:a="http://a"><a:p><a:r><a:t>Say it</a:t></a:r></a:p></p:notes>',
})
XLSX = zipped({
    "xl/workbook.xml": '<workbook xmlns:r="http://r"><sheets><sheet name="Data" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>region</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c></row><row><c r="B2"><f>B1*2</f></c></row></sheetData></worksheet>',
})
ODT = zipped({"content.xml": '<d xmlns:o="o" xmlns:t="t"><o:text><t:h t:outline-level="2">Head</t:h><t:p>Para  one</t:p></o:text></d>'}, "application/vnd.oasis.opendocument.text")
ODS = zipped({"content.xml": '<d xmlns:t="t"><t:table t:name="S"><t:table-row><t:table-cell t:number-columns-repeated="2"/><t:table-cell>x</t:table-cell></t:table-row></t:table></d>'}, "application/vnd.oasis.opendocument.spreadsheet")
EPUB = zipped({
    "META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>',
    "OEBPS/b.opf": '<package><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="c1" href="ch1.xhtml"/><item id="c2" href="ch%202.xhtml"/></manifest><spine><itemref idref="c2"/><itemref idref="c1"/><itemref idref="gone"/></spine></package>',
    "OEBPS/nav.xhtml": '<html><a href="ch1.xhtml#x">First</a><a href="ch%202.xhtml">Second</a></html>',
    "OEBPS/ch1.xhtml": "<h1>One</h1><p>alpha</p>", "OEBPS/ch 2.xhtml": "<p>beta</p>",
}, "application/epub+zip")
PNG = bytes.fromhex("89504E470D0A1A0A0000000D4948445200000010000000200806000000")
NESTED = zipped({"in/a.txt": b"inner text", "t.tar.gz": tarred({"n.txt": b"notes", "link": None}), "../evil": b"no", "d/": b""})
TREE = {
    "a.txt": "plain\ntext".encode(), "p.html": b"<title>T</title><h1>Hi</h1><p>there</p>", "d.docx": DOCX, "s.pptx": PPTX, "x.xlsx": XLSX, "o.odt": ODT, "c.ods": ODS, "b.epub": EPUB,
    "i.png": PNG, "raw.bin": bytes(range(256)), "z.zip": NESTED, "broken.zip": b"PK\x03\x04 nothing", "v.mp4": b"\0\0\0\x20ftypiso5" + b"\0" * 20, "v.m4a": b"\0\0\0\x20ftypiso5" + b"\0" * 20, "j.json": b"{}", "doc.pdf": b"%PDF-1.7",
}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for k, v in TREE.items():
        p = root / "sub" / k if k == "a.txt" else root / k
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(v)
    return str(root)


@pytest.fixture(scope="module")
def listing(spark, tree):
    return files.walk(spark, tree).select("uri", "content").cache()


def test_walk_and_detect(spark, listing):
    got = {r.uri: r.mime for r in files.sources(listing).collect()}
    ox, od = files.OOXML, files.ODF
    want = {"sub/a.txt": "text/plain", "p.html": "text/html", "d.docx": ox + "wordprocessingml.document", "s.pptx": ox + "presentationml.presentation", "x.xlsx": ox + "spreadsheetml.sheet", "o.odt": od + "text", "c.ods": od + "spreadsheet", "b.epub": "application/epub+zip", "i.png": "image/png", "raw.bin": "application/octet-stream", "z.zip": "application/zip", "broken.zip": "application/zip", "v.mp4": "video/mp4", "v.m4a": "audio/mp4", "j.json": "application/json", "doc.pdf": "application/pdf"}
    assert got == want
    assert {r.uri: (r.width, r.height) for r in files.image_facts(listing).filter("decodable").collect()} == {"i.png": (16, 32)}
    assert bytes(files.read_byte_range(listing.filter("uri = 'raw.bin'"), 250, 999).first().data) == bytes(range(250, 256))
    with pytest.raises(ValueError):
        files.checked_root("/a", "../b")


def test_walk_with_empty_files(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "none.txt").write_bytes(b"")
    (tmp_path / "one.txt").write_bytes(b"1")
    assert {r.uri: r.length for r in files.walk(spark, str(tmp_path)).collect()} == {"one.txt": 1}
    got = {r.uri.replace("%20", " "): (r.length, bytes(r.content)) for r in files.walk(spark, str(tmp_path), empty=True).collect()}
    assert got == {"one.txt": (1, b"1"), "a b/none.txt": (0, b"")}


def test_expand(spark, listing):
    got = {r.uri: r for r in containers.expand(listing.filter("uri in ('z.zip', 'd.docx', 'broken.zip')")).collect()}
    assert set(got) == {"z.zip", "d.docx", "broken.zip", "broken.zip!", "z.zip!in/a.txt", "z.zip!t.tar.gz", "z.zip!../evil", "z.zip!t.tar.gz!n.txt"}
    assert bytes(got["z.zip!t.tar.gz!n.txt"].content) == b"notes" and got["z.zip!t.tar.gz!n.txt"].depth == 2
    assert got["z.zip!../evil"].content is None and got["z.zip!../evil"].error == "unsafe member path"
    assert set(r.depth for r in containers.expand(listing.filter("uri = 'z.zip'"), depth=1).collect()) == {0, 1}


def test_entries_and_limits(spark):
    bomb = zipped({"big": b"\0" * 5_000_000})
    df = spark.createDataFrame([("b.zip", bytearray(bomb)), ("t.tar", bytearray(tarred({"x": b"12", "l": None}, "w"))), ("t.tgz", bytearray(tarred({"x": b"12"}))), ("bad", bytearray(b"PK junk"))], "uri string, content binary")
    e = {(r.uri, r.path): r for r in containers.entries(df).collect()}
    assert e["b.zip", "big"].size_bytes == 5_000_000 and e["t.tar", "l"].is_symlink and e["t.tar", "x"].byte_offset == 0 and e["t.tgz", "x"].byte_offset is None and e["bad", None].error
    out = {r.container: r for r in containers.unpack(df.filter("uri = 'b.zip'"), ratio=100).collect()}
    assert out["b.zip"].content is None and "limit" in out["b.zip"].error
    assert {r.container for r in containers.unpack(df.filter("uri = 'b.zip'"), ratio=10_000, member_bytes=1000).filter("error is not null").collect()} == {"b.zip"}
    gz = spark.createDataFrame([("a.gz", bytearray(gzip.compress(b"plain")))], "uri string, content binary")
    assert containers.entries(gz).first().error


def test_office(spark, listing):
    word = documents.read_word(listing.filter("uri in ('d.docx', 'o.odt', 'broken.zip')")).orderBy("uri", "seq").collect()
    assert [(r.uri, r.level, r.text) for r in word if not r.error] == [("d.docx", 1, "Intro"), ("d.docx", 0, "Hello world"), ("d.docx", 0, "a | b"), ("o.odt", 2, "Head"), ("o.odt", 0, "Para one")]
    assert [r.uri for r in word if r.error] == ["broken.zip"]
    assert documents.read_comments(listing.filter("uri = 'd.docx'")).first().text == "why?"
    s = documents.read_slides(listing.filter("uri = 's.pptx'")).first()
    assert (s.page, s.title, s.body, s.notes, s.n_media) == (1, "Title", "Body", "Say it", 1)
    c = {(r.uri, r.row, r.col): (r.value, r.formula) for r in documents.read_cells(listing.filter("uri in ('x.xlsx', 'c.ods')")).collect()}
    assert c == {("x.xlsx", 0, 0): ("region", None), ("x.xlsx", 0, 1): ("5", None), ("x.xlsx", 1, 1): (None, "B1*2"), ("c.ods", 0, 2): ("x", None)}
    b = documents.read_books(listing.filter("uri = 'b.epub'")).orderBy("part_no").collect()
    assert [(r.part, r.title) for r in b] == [("OEBPS/ch 2.xhtml", "Second"), ("OEBPS/ch1.xhtml", "First")]
    evil = spark.createDataFrame([("e", bytearray(zipped({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x/>'})))], "uri string, content binary")
    assert "entity" in documents.read_word(evil).first().error


def test_questions(spark, listing):
    p = Perception(listing)
    cards = {r.uri: r for r in p.inspect().collect()}
    assert cards["p.html"].facts["title"] == "T" and cards["z.zip"].facts["entry_count"] == "4" and cards["x.xlsx"].facts["sheet_count"] == "1"
    assert cards["z.zip!t.tar.gz!n.txt"].facts["characters"] == "5" and cards["v.mp4"].handler_id == "binary"
    assert cards["i.png"].affordances == ["crop_region"]
    text = {r.uri: r for r in p.represent().collect()}
    assert text["b.epub"].text == "beta\n\nOne\nalpha\n\n" and text["d.docx"].text == "Intro\nHello world\na | b\n\n" and text["s.pptx"].text == "Title\nBody\nSpeaker notes: Say it\n"
    assert text["x.xlsx"].degradations[0].what == "formulas without cached values" and text["raw.bin"].degradations[0].what == "synthesized description"
    asks = spark.createDataFrame([("sub/a.txt", "read_range", {"start": "1", "end": "3"}), ("p.html", "read_section", {}), ("p.html", "read_section", {"index": "7"}), ("raw.bin", "hexdump", {"start": "16", "length": "4"}), ("sub/a.txt", "fly", {}), ("nowhere", "hexdump", {}), ("z.zip", "list_entries", {})], "uri string, name string, params map<string,string>")
    got = p.invoke(asks).collect()
    by = {(r.uri, r.name): r for r in got}
    assert len(got) == 7 and by["sub/a.txt", "read_range"].text == "la" and by["raw.bin", "hexdump"].text.startswith("00000010  10 11 12 13")
    assert sorted(r.text for r in got if r.name == "read_section") == ["Hi\nthere", "section 7 does not exist; the page has 1 section(s)"]
    assert by["sub/a.txt", "fly"].error.startswith("unknown operation") and by["nowhere", "hexdump"].error == "no such source"
    assert "4 of 4 entries" in by["z.zip", "list_entries"].text
    k = p.keyed(asks.filter("uri = 'raw.bin'")).first()
    assert len(k.artifact_key) == 64
    t = tools(p)
    assert json.loads(t["inspect_path"]("p.html").first().json)["handler_id"] == "html"
    said = t["invoke_affordance"]("sub/a.txt", "read_range", start=0, end=5).first()
    assert said.ok and said.value == "located at characters 0-5:\nplain"


def test_every_request_gets_one_row(spark, listing):
    """Of every source every offered operation, and some twice: rows in are rows out."""
    p = Perception(listing, ("vision", "ffmpeg", "asr", "document_render"), functions={("image", "describe_image"): lambda r: {"text": f"{len(r['content'])} bytes, {r['params']['ask']}"}, ("image", "ocr"): lambda r: 1 / 0})
    cards = p.inspect().select("uri", F.explode("affordances").alias("name"))
    asks = cards.withColumn("params", F.create_map(F.lit("ask"), F.lit("what")))
    asks = asks.union(asks.limit(3)).union(spark.createDataFrame([("nowhere", "x", {}), ("d.docx", None, None)], "uri string, name string, params map<string,string>"))
    got = p.invoke(asks).collect()
    assert len(got) == asks.count() and all((r.text is None) == (r.error is not None) for r in got)
    by = {(r.uri, r.name): r for r in got}
    assert by["i.png", "describe_image"].text == f"{len(PNG)} bytes, what" and by["i.png", "ocr"].error.startswith("ZeroDivisionError")
    assert by["i.png", "crop_region"].error == "operation crop_region needs a function that was not given"
    assert by["d.docx", "list_comments"].text == "Ann: why?" and by["d.docx", "read_table"].text == "a | b" and by["s.pptx", "read_slide"].text == "Title\nBody\nSpeaker notes: Say it"
    assert by["x.xlsx", "list_sheets"].text == "Data: A1:B2 (2 row(s), 2 column(s))" and by["x.xlsx", "read_sheet"].text == "region | 5\n | =B1*2"
    assert by["b.epub", "read_chapter"].text == "beta" and by["doc.pdf", "read_page"].degraded and by["v.mp4", "read_transcript"].degraded


def test_a_callers_handler_opener_and_detector(spark):
    rows = [("a.box", bytearray(b"BOX one|two")), ("b.ini", bytearray(b"[x]"))]
    df = spark.createDataFrame(rows, "uri string, content binary")

    def open_box(data):
        for i, part in enumerate(data[4:].split(b"|")):
            yield {"path": f"{i}.txt", "size_bytes": len(part), "compressed_bytes": len(part), "is_dir": False, "is_symlink": False, "byte_offset": None}, (lambda part=part: io.BytesIO(part))

    detector = lambda head, uri: F.when(head.startswith(F.lit(b"BOX ")), "application/x-box").when(uri.endswith(".ini"), "text/x-ini")
    p = Perception(
        df, detector=detector, openers={"application/x-box": open_box}, extra_handlers=[("ini", ("text/x-ini",), 1, 1, ()), ("archive", ("application/x-box",), 1, 1, ())],
        extra_affordances=[("ini", "keys", (), "segment", {})],
        functions={("ini", "keys"): lambda r: {"text": "x"}, ("ini", "represent"): lambda r: {"text": r["content"].decode()}, ("ini", "describe"): lambda r: {"facts": {"sections": "1"}}},
    )
    assert {r.uri: r.handler_id for r in p.list().collect()} == {"a.box": "archive", "a.box!0.txt": "text", "a.box!1.txt": "text", "b.ini": "ini"}
    assert {r.uri: r.text for r in p.represent().collect()}["b.ini"] == "[x]"
    cards = {r.uri: r for r in p.inspect().collect()}
    assert cards["b.ini"].facts == {"sections": "1"} and cards["a.box"].facts["entry_count"] == "2"
    got = p.invoke(spark.createDataFrame([("b.ini", "keys", {})], "uri string, name string, params map<string,string>")).first()
    assert (got.text, got.error) == ("x", None)


def test_pdf_pages(spark):
    made = fixtures.pdf([("Title", "some (text) with é and 漢"), ("Two", "x")])
    packed = zlib.compress(b"BT /F9 9 Tf (plain \\(cp\\) \\251) Tj 0 -9 Td [(spl) -30 (it) -400 (up)] TJ ET")
    flate = b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R 5 0 R]>>endobj 3 0 obj<</Type/Page/Contents 4 0 R>>endobj 4 0 obj<</Filter/FlateDecode/Length %d>>stream\n" % len(packed) + packed + b"\nendstream endobj 5 0 obj<</Type/Page/Resources<</XObject<</I 6 0 R>>>>>>endobj 6 0 obj<</Subtype/Image>>endobj"
    df = spark.createDataFrame([("m", bytearray(made)), ("f", bytearray(flate)), ("e", bytearray(b"%PDF-1.4 /Encrypt")), ("n", bytearray(b"no"))], "uri string, content binary")
    got = {(r.uri, r.page): r for r in pdf.read_pages(df).collect()}
    assert got["m", 1].text == "Title\nsome (text) with é and 漢" and got["m", 3].text == ""
    assert got["f", 1].text == "plain (cp) ©\nsplit up" and got["f", 2].has_image and not got["f", 2].text
    assert "encrypted" in got["e", None].error and got["n", None].error


def test_functions_are_gated(spark, listing):
    out = documents.by_function(listing.filter("uri in ('i.png', 'raw.bin')").select("uri"), lambda r: {"uri": r["uri"], "said": 1 / (r["uri"] == "i.png")}, "uri string, said double, error string", 1)
    got = {r.uri: (r.said, r.error) for r in out.collect()}
    assert got["i.png"] == (1.0, None) and got["raw.bin"][1].startswith("ZeroDivisionError")
    j = {"format": {"duration": "1.5", "format_name": "mov"}, "streams": [{"codec_type": "video", "codec_name": "h264", "avg_frame_rate": "30000/1001", "width": 4}, {"codec_type": "audio", "avg_frame_rate": "0/0"}, {"codec_type": "subtitle", "codec_name": "subrip", "tags": {"language": "en"}}]}
    r = documents.probe_facts(spark.createDataFrame([("v", json.dumps(j))], "uri string, json string")).first()
    assert r.duration_s == 1.5 and abs(r.streams[0].fps - 29.97) < 0.01 and r.streams[1].fps is None and r.streams[2].is_text and r.streams[2].language == "en"


def test_stream_reindexes_what_is_new(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    make = lambda b: files.sources(b.select(F.col("path").alias("uri"), "content")).select("uri", "mime", "size_bytes")

    def run():
        ingest.reindex(ingest.new_files(spark, f"file://{src}"), f"file://{out}", f"file://{ck}", make).awaitTermination(60)
        return spark.read.parquet(f"file://{out}").count()

    (src / "a.txt").write_text("a")
    assert run() == 1
    (src / "b.txt").write_text("b")
    assert run() == 2


def test_operation_pairs(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", "view"), (1, "2024-01-01 00:00:05", "purchase"), (1, "2024-01-01 00:00:09", "purchase"), (2, "2024-01-01 00:00:00", "click")], "user_id long, ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert [(r.elapsed_us) for r in ingest.operation_pairs(e).orderBy("finished_at").collect()] == [5_000_000, None]
    assert ingest.stream_counts(e).count() == 3


def test_batches_of_files_are_bounded_and_keys_are_dealt_over_tasks(spark):
    from sieveline.plans import fixtures
    from sieveline.sources import files as f

    rows = [{"uri": str(i), "content": bytes(f.BYTES // 2)} for i in range(7)]
    got = list(f.gathered(iter(rows), "uri string, content binary"))
    assert [b.num_rows for b in got] == [2, 2, 2, 1] and [r["uri"] for b in got for r in b.to_pylist()] == [str(i) for i in range(7)]
    assert [b.num_rows for b in f.gathered(({"uri": "u"} for _ in range(2500)), "uri string")] == [1000, 1000, 500] and not list(f.gathered([], "uri string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    keys = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("uri"))
    sizes = fixtures.made(keys, lambda r: bytes(4)).mapInArrow(lambda bs: bs, "uri string, content binary")
    assert sizes.count() == 3000 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(f.ROWS)
    assert fixtures.spread(keys, "uri", each=500).rdd.getNumPartitions() == 6


LIKE_SIGNATURES = ("BM und der", "ID3 es", "BZh so", "GIF8 x", "%PDF, none", "OggS a", "fLaC b", "abcdftyp und", "12345678AVI so", "12345678WEBP", "12345678WAVE\n", "é" * 128 + "xustar", "II und MM")


def test_a_text_that_begins_like_a_signature_goes_by_its_name(spark):
    texts = [t.encode() for t in LIKE_SIGNATURES]
    real = {"image/bmp": b"BM" + struct.pack("<IHHI", 58, 0, 0, 54), "application/pdf": b"%PDF-1.7\n1 0 obj", "application/rtf": b"{\\rtf1 a}", "audio/mpeg": b"ID3\x03\x00", "video/mp4": b"\0\0\0 ftypiso5", "application/x-bzip2": bz2.compress(b"text")}
    df = spark.createDataFrame([(f"{i}{end}", bytearray(b)) for i, b in enumerate([*texts, *real.values()]) for end in (".txt", "")], "uri string, content binary")
    got = {r.uri: r.mime for r in files.sources(df).collect()}
    assert [got[f"{i}.txt"] for i in range(len(texts) + len(real))] == ["text/plain"] * len(texts) + list(real)
    assert [got["0"], got["7"], got["8"], got[f"{len(texts) - 1}"]] == ["image/bmp", "video/mp4", "video/x-msvideo", "text/plain"]  # where no name says otherwise


@pytest.mark.parametrize("name", ["card_texts", "inspect_cards", "invoke_answers", "rendition_texts", "represent_files", "tool_pack"])
def test_queries_of_documents_that_begin_like_a_signature_give_their_sql(spark, tmp_path, name):
    import duckdb

    import __spark_entry__

    spark.createDataFrame([(i, t) for i, t in enumerate(LIKE_SIGNATURES)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "<p>a</p>"), (2, "<h1>b</h1>c")], "page_id long, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = __spark_entry__.queries()[name](spark, f"file://{tmp_path}").select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))
