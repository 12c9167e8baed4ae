"""Queries of the file side: files are made from rows of the tables (fixtures), read back by the readers, and held against
what SQL says of the rows; and the scalar functions and roll-ups that files need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import locators as L
from sieveline.functions import text as T
from sieveline.operators import cache, dispatch, formats, html, timeline
from sieveline.operators.flatten import text_of
from sieveline.plans import fixtures
from sieveline.plans.perception import Perception, card_json, cues_json, from_cues_json, from_rendition_json, rendition_json, rendition_text
from sieveline.plans.sql import _HTML
from sieveline.sources import containers, documents, files, pdf
from sieveline.sources.workspace import kept


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _talks(s, d, suffix: str, make) -> DataFrame:
    return fixtures.talks(_t(s, d, "conversations"), suffix, make)


def _uri(prefix: str, column: str, suffix: str = "") -> object:
    return F.concat(F.lit(prefix), F.col(column).cast("string"), F.lit(suffix))


def _document_files(s, d) -> DataFrame:
    return _t(s, d, "documents").select(_uri("doc/", "doc_id", ".txt").alias("uri"), F.encode("text", "UTF-8").alias("content"))


def _page_files(s, d) -> DataFrame:
    return _t(s, d, "pages").select(_uri("page/", "page_id", ".html").alias("uri"), F.encode("html", "UTF-8").alias("content"))


# files and containers ----------------------------------------------------------------------------------------------

_MARKS = ("25504446", "89504E470D0A1A0A", "FFD8FF", "47494638", "1F8B", "494433", "1A45DFA3", "", "000000206674797069736F35")
_KINDS = ("application/pdf", "image/png", "image/jpeg", "image/gif", "application/gzip", "audio/mpeg", "video/x-matroska", "text/plain", "video/mp4")


def file_detect(s, d):
    mark = F.unhex(F.element_at(F.array(*map(F.lit, _MARKS)), (F.col("doc_id") % len(_MARKS) + 1).cast("int")))
    f = _t(s, d, "documents").select(_uri("doc/", "doc_id").alias("uri"), F.concat(mark, F.encode("text", "UTF-8")).alias("content"))
    return files.sources(f).select("uri", "mime", "size_bytes", "content_hash")


def _zips(s, d):
    return fixtures.made(_t(s, d, "documents").select(_uri("doc/", "doc_id", ".zip").alias("uri"), "doc_id", "lang", "text"), lambda r: fixtures.zipped([(f"{r['lang']}/{r['doc_id']}.txt", r["text"] or ""), ("about.json", "{}")]))


def zip_entries(s, d):
    return containers.entries(_zips(s, d)).select("uri", "seq", "path", "size_bytes", "is_dir", F.col("byte_offset").isNotNull().alias("has_offset"))


def tar_entries(s, d):
    return containers.entries(_talks(s, d, "tar.gz", lambda p: fixtures.tarred([(f"{i}.{a}", b) for i, (a, b) in enumerate(p)]))).select("uri", "seq", "path", "size_bytes", F.col("byte_offset").isNull().alias("solid"))


def _nested(s, d):
    """A zip for each conversation: a text for each turn, and a tar of the same within."""
    return _talks(s, d, "zip", lambda p: fixtures.zipped([*((f"{i}.txt", b) for i, (_, b) in enumerate(p)), ("inner.tar.gz", fixtures.tarred([(f"{i}!.txt", b) for i, (_, b) in enumerate(p)]))]))


def expand_members(s, d):
    """Files and all that is in them, down to the second level; archives without their sizes."""
    e = containers.expand(_nested(s, d))
    return e.select("uri", "container", "depth", F.when(F.col("mime") == "text/plain", F.sha2("content", 256)).alias("text_hash"))


def member_ranges(s, d):
    z = _nested(s, d)
    asks = z.select("uri", F.explode(F.array(*(F.struct(F.lit(m).alias("member"), F.lit(a).alias("start"), F.lit(b).alias("end")) for m, a, b in (("0.txt", 2, 9), ("none", 0, 1))))).alias("a")).select("uri", "a.*")
    return containers.read_member(z, asks).select("uri", "member", "exists", "size_bytes", F.hex("data").alias("data"))


def walk_union(s, d):
    """Loose files and members in one list, in order of path."""
    loose = _page_files(s, d).select("uri", F.length("content").cast("long").alias("size_bytes"))
    inside = containers.expand(_zips(s, d), depth=1).filter("depth = 1").select("uri", F.length("content").cast("long").alias("size_bytes"))
    return loose.unionByName(inside).orderBy("uri")


def image_sizes(s, d):
    """Headers of pictures whose sizes follow from the id."""
    wide = lambda n: F.lpad(F.hex(n), 8, "0")
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide(F.col("doc_id") + 1), wide(F.col("doc_id") % 77 + 3), F.lit("08060000000000"))
    f = _t(s, d, "documents").select(_uri("doc/", "doc_id", ".png").alias("uri"), F.unhex(head).alias("content"))
    return files.image_facts(f)


# documents ---------------------------------------------------------------------------------------------------------


def _word_flat(files_: DataFrame) -> DataFrame:
    blocks = documents.read_word(files_).filter("text != ''").select("uri", "seq", "level", "text", F.lit(0).alias("start"), F.lit(1).alias("end"))
    return formats.word_segments(html.sections(blocks))


def docx_segments(s, d):
    return _word_flat(_talks(s, d, "docx", fixtures.docx)).select("uri", "seq", "start", "end", "chunk")


def docx_comments(s, d):
    return documents.read_comments(_talks(s, d, "docx", fixtures.docx)).select("uri", "author", "text")


def odt_blocks(s, d):
    return documents.read_word(_talks(s, d, "odt", fixtures.odt)).select("uri", "seq", "level", "kind", "text")


def pptx_slides(s, d):
    return formats.slide_segments(documents.read_slides(_talks(s, d, "pptx", fixtures.pptx))).select("uri", "seq", "start", "end", "chunk")


def pptx_media(s, d):
    return documents.read_media(_talks(s, d, "pptx", fixtures.pptx)).select("uri", "page", "picture", "mime", "size_bytes")


def _books(s, d):
    g = _t(s, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows"))
    rows = g.select(_uri("nation/", "c_nationkey", ".xlsx").alias("uri"), "rows")
    return fixtures.made(rows, lambda r: fixtures.xlsx([["key", "name"], *([str(x["c_custkey"]), x["c_name"]] for x in r["rows"])]))


def xlsx_cells(s, d):
    return documents.read_cells(_books(s, d)).select("uri", "sheet", "row", "col", "value")


def xlsx_segments(s, d):
    return formats.sheet_segments(documents.read_cells(_books(s, d))).select("uri", "seq", "start", "end", "chunk", F.col("locator.rows").alias("rows"))


def epub_parts(s, d):
    return documents.read_books(_talks(s, d, "epub", fixtures.epub)).select("uri", "part_no", "part", "title", "book_title", "author")


def epub_segments(s, d):
    f = formats.book_segments(documents.book_blocks(documents.read_books(_talks(s, d, "epub", fixtures.epub))))
    return f.select("uri", "seq", "part_no", "start", "end", "chunk", F.col("locator.part").alias("part"))


def pdf_pages(s, d):
    return pdf.read_pages(_talks(s, d, "pdf", fixtures.pdf)).select("uri", "page", "text", "has_image")


def pdf_segments(s, d):
    p = pdf.read_pages(_talks(s, d, "pdf", fixtures.pdf))
    return formats.page_segments(p).select("uri", "seq", "start", "end", "chunk")


def page_roll_up(s, d):
    p = pdf.read_pages(_talks(s, d, "pdf", fixtures.pdf))
    return formats.page_card(p).join(formats.page_notes(p), "uri", "left")


def srt_cues(s, d):
    stamp = lambda n: F.concat(F.lpad(F.floor(n / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(n / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(",250"))
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    turn = F.concat(F.col("turn").cast("string"), F.lit("\n"), stamp(F.col("turn") * 7), F.lit(" --> "), stamp(F.col("turn") * 7 + 5), F.lit("\n<i>"), text, F.lit("</i>"))
    c = _t(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("line")))), lambda x: x["line"]), "\r\n\r\n").alias("text"))
    return timeline.parse_srt(c.select(_uri("talk/", "conv_id", ".srt").alias("uri"), "text")).select("uri", "seq", "start_s", "end_s", "text")


# the four questions ------------------------------------------------------------------------------------------------


def inspect_cards(s, d):
    p = Perception(_document_files(s, d).union(_page_files(s, d)), bare=False)
    return p.inspect().select("uri", "handler_id", "mime", "size_bytes", F.try_element_at("facts", F.lit("lines")).alias("lines"), F.try_element_at("facts", F.lit("block_count")).alias("blocks"), F.array_join("affordances", ",").alias("affordances"))


def list_sources(s, d):
    return Perception(kept(_nested(s, d), "files")).list()


def represent_files(s, d):
    p = Perception(_document_files(s, d).union(_page_files(s, d)), bare=False)
    return p.represent().select("uri", F.length("text").cast("long").alias("length"), F.md5("text").alias("text_md5"), "n_segments", F.size("barriers").cast("long").alias("n_barriers"))


def invoke_answers(s, d):
    """Of every document a range, of every page a section that is there and one that is not, and an unknown operation."""
    docs, pages = _document_files(s, d), _page_files(s, d)
    p = Perception(docs.union(pages), depth=0, bare=False)
    ask = lambda f, name, **params: f.select("uri", F.lit(name).alias("name"), F.create_map(*(F.lit(x) for kv in params.items() for x in kv)).cast("map<string,string>").alias("params"))
    asks = ask(docs, "read_range", start="3", end="12").union(ask(docs, "fly")).union(ask(pages, "read_section", index="0")).union(ask(pages, "read_section", index="99999"))
    return p.invoke(asks).select("uri", "name", "text", "degraded", "error")


def invoke_office(s, d):
    """Of every conversation, as five kinds of file, what each kind can be asked for."""
    kinds = {"docx": fixtures.docx, "pptx": fixtures.pptx, "epub": fixtures.epub, "pdf": fixtures.pdf}
    f = None
    for k, make in kinds.items():
        one = _talks(s, d, k, make)
        f = one if f is None else f.union(one)
    talks = _t(s, d, "conversations").select("conv_id").distinct()
    asks = [("docx", "read_section", {"index": "0"}), ("docx", "list_comments", {}), ("docx", "read_table", {"index": "0"}), ("docx", "read_range", {"start": "0", "end": "4"}), ("pptx", "read_slide", {"page": "1"}), ("pptx", "list_media", {}),
            ("epub", "read_chapter", {"index": "0"}), ("epub", "read_range", {"start": "0", "end": "4"}), ("pdf", "read_page", {"page": "1"}), ("pdf", "read_page", {"page": "0"})]
    table = s.createDataFrame(asks, "suffix string, name string, params map<string,string>")
    r = talks.crossJoin(F.broadcast(table)).select(F.concat(F.lit("talk/"), F.col("conv_id").cast("string"), F.lit("."), F.col("suffix")).alias("uri"), "name", "params")
    return Perception(kept(f, "files"), depth=0).invoke(r).select("uri", "name", "text", "degraded", "error")


def invoke_sheets(s, d):
    books = kept(_books(s, d), "files")
    asks = s.createDataFrame([("list_sheets", {}), ("read_sheet", {"offset": "1", "limit": "2"}), ("read_cells", {"a1_range": "B2:A3"}), ("read_cells", {"a1_range": "?"}), ("read_sheet", {"name": "None"})], "name string, params map<string,string>")
    r = books.select("uri").crossJoin(F.broadcast(asks))
    return Perception(books, depth=0).invoke(r).select("uri", "name", "text", "degraded", "error")


def media_cards(s, d):
    """Media of conversations: cards and transcripts from a prober's JSON and cues."""
    c = _t(s, d, "conversations")
    uri = _uri("talk/", "conv_id", ".m4a")
    cues = c.select(uri.alias("uri"), F.col("turn").alias("seq"), (F.col("turn") * 2.0).alias("start_s"), (F.col("turn") * 2.0 + 1.5).alias("end_s"), "text", F.lit(None).cast("string").alias("speaker"), F.lit("said").alias("source"))
    g = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    probes = g.select(uri.alias("uri"), F.format_string('{"format":{"duration":"%d.5","format_name":"mov"},"streams":[{"codec_type":"audio","tags":{"language":"en"}},{"codec_type":"subtitle","tags":{"language":"de"}}]}', (F.col("last") * 2 + 2)).alias("json"))
    box = g.select(uri.alias("uri"), F.unhex(F.lit("000000206674797069736F35")).alias("content"))
    p = Perception(box, ("ffmpeg", "asr"), depth=0, cues=cues, probes=probes)
    facts = F.array_join(F.transform(F.array_sort(F.map_entries("facts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    ask = box.select("uri", F.lit("read_span").alias("name"), F.create_map(F.lit("start_s"), F.lit("0"), F.lit("end_s"), F.lit("2")).alias("params"))
    said = p.invoke(ask).select("uri", F.col("text").alias("span"), F.col("error").alias("span_error"))
    return p.inspect().select("uri", "handler_id", facts.alias("facts")).join(p.represent().select("uri", F.length("text").cast("long").alias("length"), "n_segments"), "uri").join(said, "uri")


def kept_renditions(s, d):
    """Renditions and cues through their JSON and back."""
    docs = _t(s, d, "documents").select(_uri("doc/", "doc_id").alias("uri"), "text", L.cell_range(F.col("source"), F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("locator"), (F.col("doc_id") % 2 == 0).alias("degraded"))
    return from_rendition_json(rendition_json(docs)).select("uri", "text", "degraded", L.describe(F.col("locator")).alias("at"))


def kept_cues(s, d):
    c = _t(s, d, "conversations").select(_uri("talk/", "conv_id").alias("uri"), F.col("turn").cast("long").alias("seq"), (F.col("turn") / 4).alias("start_s"), (F.col("turn") / 4 + 0.1).alias("end_s"), "text", F.col("role").alias("speaker"), F.lit("said").alias("source"))
    return from_cues_json(cues_json(c)).select("uri", "seq", "start_s", "text", "speaker")


# functions and roll-ups --------------------------------------------------------------------------------------------


def fingerprints(s, d):
    m = F.create_map(F.lit("vision"), F.col("source"), F.lit("asr"), F.col("lang"))
    return _t(s, d, "documents").select("doc_id", T.fingerprint(m).alias("fingerprint"))


def span_overlaps(s, d):
    c = F.col
    o = L.overlaps(c("l_linenumber") * 3, c("l_linenumber") * 3 + c("l_quantity"), F.lit(10), F.lit(20))
    return _t(s, d, "lineitem").groupBy("l_linenumber", o.alias("touches")).agg(F.count(F.lit(1)).alias("n"))


def crop_boxes(s, d):
    p = _t(s, d, "part").select("p_partkey", ((F.col("p_partkey") % 10) / 16).alias("x"), ((F.col("p_partkey") % 3) / 4).alias("y"), F.lit(0.25).alias("w"), F.lit(0.5).alias("h"))
    c = [F.col(k) for k in "xywh"]
    box = T.crop_box(*c, F.lit(640), F.lit(480))
    return p.select("p_partkey", T.in_frame(*c).alias("in_frame"), T.whole_frame(*c).alias("whole"), *(box[k].cast("long").alias(k) for k in ("left", "top", "right", "bottom")))


def enumerations(s, d):
    g = _t(s, d, "documents").groupBy("source").agg(F.array_sort(F.collect_list(F.lpad(F.col("doc_id").cast("string"), 9, "0"))).alias("ids"))
    return g.select("source", T.listed(F.col("ids"), 5).alias("listed"))


def hrefs(s, d):
    p = _t(s, d, "pages").select("page_id", F.concat(F.lit("../img%20x/"), F.col("page_id").cast("string"), F.lit(".png#frag")).alias("href"))
    return p.select("page_id", T.resolve_href(F.lit("OEBPS/text/ch1.xhtml"), F.col("href")).alias("resolved"))


def clip_costs(s, d):
    return _t(s, d, "part").select("p_partkey", T.clip_cost((F.col("p_partkey") % 80).cast("double")).alias("cost"))


def timestamps(s, d):
    """Quarters and twentieths of seconds, where rounding shows."""
    return _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.timestamp(F.col("l_orderkey") / 20).alias("a"), T.timestamp(F.col("l_orderkey") / 4).alias("b"))


def affordance_lookup(s, d):
    table = dispatch.available(dispatch.affordances(s), ())
    names = F.element_at(F.array(*map(F.lit, ("read_range", "fly", "read_section"))), (F.col("doc_id") % 3 + 1).cast("int"))
    r = _t(s, d, "documents").select("doc_id", F.lit("html").alias("handler_id"), names.alias("name"))
    return dispatch.resolve_names(r, table).select("doc_id", "name", "error", F.try_element_at("defaults", F.lit("end")).alias("default_end"))


def probed_streams(s, d):
    j = F.format_string('{"format":{"duration":"%s","format_name":"mkv"},"streams":[{"codec_type":"video","codec_name":"h264","width":%d,"avg_frame_rate":"%d/4"},{"codec_type":"audio","avg_frame_rate":"0/0"},{"codec_type":"subtitle","codec_name":"subrip","tags":{"language":"%s"}}]}', F.col("p_partkey").cast("string"), (F.col("p_partkey") % 1000).cast("int"), (F.col("p_partkey") % 50).cast("int"), F.lit("en"))
    f = documents.probe_facts(_t(s, d, "part").select(_uri("part/", "p_partkey").alias("uri"), j.alias("json")))
    one = F.col("streams")
    return f.select("uri", "duration_s", "container", one[0]["fps"].alias("fps"), one[0]["width"].alias("width"), one[1]["fps"].isNull().alias("no_rate"), one[2]["is_text"].alias("is_text"))


def distinct_languages(s, d):
    g = _t(s, d, "documents").groupBy("source").agg(F.collect_list(F.struct(F.col("lang").alias("language"))).alias("streams"))
    return g.select("source", F.array_join(documents.languages(F.col("streams")), ",").alias("languages"))


def _frames(s, d):
    c = _t(s, d, "conversations")
    said = F.when(F.col("role") == "user", F.col("text")).when(F.col("role") == "system", F.lit(" "))
    return c.select(_uri("talk/", "conv_id").alias("uri"), F.col("turn").alias("seq"), (F.col("turn") * 5.0).alias("start_s"), said.alias("described"))


def frame_states(s, d):
    return documents.frame_states(_frames(s, d))


def frames_described(s, d):
    f = _frames(s, d)
    return documents.described_frames(f.select("uri", "seq", "start_s"), f.filter("described is not null").select("uri", "seq", F.col("described").alias("text")))


def suggested_frames(s, d):
    c = _t(s, d, "conversations").select(_uri("talk/", "conv_id").alias("uri"), F.col("turn").alias("seq"), (F.col("turn") * 20.0).alias("start_s"), (F.col("turn") * 20.0 + 4.0).alias("end_s"), "text")
    return timeline.suggest_frames(c)


def changed_files(s, d):
    listing = _t(s, d, "documents").select(_uri("doc/", "doc_id").alias("path"), F.length("text").alias("length"), F.lit(1).alias("modificationTime"))
    seen = listing.filter("length % 2 = 0").union(listing.filter("length % 2 = 1").select("path", F.col("length") + 1, "modificationTime"))
    return cache.changed(listing, seen)


def part_texts(s, d):
    """The flattened text of word-processing files, whole."""
    return text_of(_word_flat(_talks(s, d, "docx", fixtures.docx))).select("uri", F.md5("text").alias("text_md5"))


def replies(s, d):
    """Models' replies as text, as lists of blocks and in a shape that is none."""
    c = _t(s, d, "conversations")
    one = F.to_json(F.struct(F.col("text").alias("t")))
    text = F.substring(one, F.lit(6), F.length(one) - 6)
    blocks = F.to_json(F.array(*(F.struct(F.lit(k).alias("type"), v.alias("text")) for k, v in (("text", F.col("role")), ("image", F.lit("no")), ("text", F.col("text"))))))
    reply = F.when(F.col("turn") % 3 == 0, text).when(F.col("turn") % 3 == 1, blocks).otherwise(F.lit('{"x":1}'))
    return c.select("conv_id", "turn", T.reply_text(reply).alias("said"))


def formulas_without_values(s, d):
    g = _t(s, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_custkey")).alias("rows"))
    rows = g.select(_uri("nation/", "c_nationkey", ".xlsx").alias("uri"), "rows")
    made = fixtures.made(rows, lambda r: fixtures.xlsx([[str(x), f"=A{i}*2"] for i, x in enumerate(r["rows"], 1)]))
    return formats.uncomputed(documents.read_cells(made))


def cues_outside(s, d):
    c = _t(s, d, "conversations").select(_uri("talk/", "conv_id").alias("uri"), (F.col("turn") * 2.0).alias("start_s"), F.lit(5.5).alias("duration_s"))
    return timeline.dropped(c)


def card_texts(s, d):
    """Cards as JSON, read back by Spark."""
    p = Perception(_document_files(s, d), depth=0)
    j = card_json(p.inspect().select("uri", "handler_id", "size_bytes", "affordances"))
    one = F.from_json("json", "uri string, handler_id string, size_bytes bigint, affordances array<string>")
    return j.select("uri", one["uri"].alias("told"), one["handler_id"].alias("handler_id"), one["size_bytes"].alias("size_bytes"), F.array_join(one["affordances"], ",").alias("affordances"))


def rendition_texts(s, d):
    p = Perception(_document_files(s, d), depth=0)
    asks = _document_files(s, d).select("uri", F.when(F.col("uri").endswith("1.txt"), "fly").otherwise("read_range").alias("name"), F.create_map(F.lit("end"), F.lit("5")).alias("params"))
    return rendition_text(p.invoke(asks))


_TALKS = r"""t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations),
g AS (SELECT conv_id, count(*) AS n, string_agg(i || ' | ' || role, chr(10) ORDER BY i) AS rows FROM t GROUP BY conv_id)"""
_DOCX = _TALKS + r""",
p AS (SELECT conv_id, i, role || chr(10) || text || CASE WHEN i = n - 1 THEN chr(10) || rows ELSE '' END || chr(10) || chr(10) AS chunk FROM t JOIN g USING (conv_id))"""


def _flat(select: str, of: str = "p", key: str = "uri", order: str = "seq") -> str:
    return f'SELECT {select}, (sum(length(chunk)) OVER w - length(chunk))::BIGINT AS start, (sum(length(chunk)) OVER w)::BIGINT AS "end", chunk FROM {of} WINDOW w AS (PARTITION BY {key} ORDER BY {order})'


_BOOKS = "b AS (SELECT 'nation/' || c_nationkey || '.xlsx' AS uri, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, c_custkey::VARCHAR AS k, c_name AS v FROM customer UNION ALL SELECT DISTINCT 'nation/' || c_nationkey || '.xlsx', 0, 'key', 'name' FROM customer)"

SQL: dict[str, str] = {
    "file_detect": "SELECT 'doc/' || doc_id AS uri, k.mime, (octet_length(encode(text)) + len(k.mark) // 2)::BIGINT AS size_bytes, sha256(from_hex(k.mark) || encode(text)) AS content_hash FROM documents JOIN (VALUES "
    + ", ".join(f"({i}, '{m}', '{k}')" for i, (m, k) in enumerate(zip(_MARKS, _KINDS, strict=True))) + f") k(i, mark, mime) ON doc_id % {len(_MARKS)} = k.i",
    "zip_entries": "SELECT 'doc/' || doc_id || '.zip' AS uri, 0::BIGINT AS seq, lang || '/' || doc_id || '.txt' AS path, strlen(coalesce(text, ''))::BIGINT AS size_bytes, false AS is_dir, true AS has_offset FROM documents UNION ALL SELECT 'doc/' || doc_id || '.zip', 1, 'about.json', 2, false, true FROM documents",
    "tar_entries": f"WITH {_TALKS} SELECT 'talk/' || conv_id || '.tar.gz' AS uri, i AS seq, i || '.' || role AS path, strlen(text)::BIGINT AS size_bytes, true AS solid FROM t",
    "expand_members": f"""WITH {_TALKS}, z AS (SELECT 'talk/' || conv_id || '.zip' AS zip, * FROM t) SELECT DISTINCT zip AS uri, NULL::VARCHAR AS container, 0 AS depth, NULL::VARCHAR AS text_hash FROM z
      UNION ALL SELECT DISTINCT zip || '!inner.tar.gz', zip, 1, NULL FROM z UNION ALL SELECT zip || '!' || i || '.txt', zip, 1, sha256(text) FROM z UNION ALL SELECT zip || '!inner.tar.gz!' || i || '\\!.txt', zip || '!inner.tar.gz', 2, sha256(text) FROM z""",
    "member_ranges": f"""WITH {_TALKS} SELECT 'talk/' || conv_id || '.zip' AS uri, '0.txt' AS member, true AS "exists", strlen(text)::BIGINT AS size_bytes, substr(hex(encode(text)), 5, 14) AS data FROM t WHERE i = 0
      UNION ALL SELECT 'talk/' || conv_id || '.zip', 'none', false, NULL, NULL FROM t WHERE i = 0""",
    "walk_union": "SELECT 'page/' || page_id || '.html' AS uri, strlen(html)::BIGINT AS size_bytes FROM pages UNION ALL SELECT 'doc/' || doc_id || '.zip!' || lang || '/' || doc_id || '.txt', strlen(text) FROM documents UNION ALL SELECT 'doc/' || doc_id || '.zip!about.json', 2 FROM documents",
    "image_sizes": "SELECT 'doc/' || doc_id || '.png' AS uri, 'PNG' AS format, (doc_id + 1)::INT AS width, (doc_id % 77 + 3)::INT AS height, true AS decodable FROM documents",
    "docx_segments": f"WITH {_DOCX} " + _flat("'talk/' || conv_id || '.docx' AS uri, i AS seq", key="conv_id", order="i"),
    "docx_comments": f"WITH {_TALKS} SELECT 'talk/' || conv_id || '.docx' AS uri, 'reader' AS author, n || ' parts' AS text FROM g",
    "odt_blocks": f"WITH {_TALKS} SELECT 'talk/' || conv_id || '.odt' AS uri, i * 2 AS seq, 1 AS level, 'heading' AS kind, role AS text FROM t UNION ALL SELECT 'talk/' || conv_id || '.odt', i * 2 + 1, 0, 'paragraph', text FROM t",
    "pptx_slides": f"WITH {_TALKS}, p AS (SELECT *, role || chr(10) || text || chr(10) AS chunk FROM t) " + _flat("'talk/' || conv_id || '.pptx' AS uri, (i + 1)::INT AS seq", key="conv_id", order="i"),
    "pptx_media": f"WITH {_TALKS} SELECT 'talk/' || conv_id || '.pptx' AS uri, 1 AS page, 0 AS picture, 'image/png' AS mime, 24::BIGINT AS size_bytes FROM g",
    "xlsx_cells": f"WITH {_BOOKS} SELECT uri, 'Data' AS sheet, r::INT AS row, 0 AS col, k AS value FROM b UNION ALL SELECT uri, 'Data', r::INT, 1, v FROM b",
    "xlsx_segments": f"WITH {_BOOKS}, p AS (SELECT uri, 0 AS seq, 'Data' || chr(10) || string_agg(k || ' | ' || v, chr(10) ORDER BY r) || chr(10) AS chunk, count(*)::INT AS rows FROM b GROUP BY uri) " + _flat("uri, seq, rows"),
    "epub_parts": f"WITH {_TALKS} SELECT 'talk/' || conv_id || '.epub' AS uri, i::INT AS part_no, 'OEBPS/ch' || (i + 1) || '.xhtml' AS part, role AS title, 'Talk' AS book_title, 'Many' AS author FROM t",
    "epub_segments": f"""WITH {_TALKS}, p AS (SELECT conv_id, i * 2 AS seq, i::INT AS part_no, role || chr(10) AS chunk FROM t UNION ALL SELECT conv_id, i * 2 + 1, i::INT, text || chr(10) || chr(10) FROM t)
      """ + _flat("'talk/' || conv_id || '.epub' AS uri, seq, part_no, 'OEBPS/ch' || (part_no + 1) || '.xhtml' AS part", key="conv_id"),
    "pdf_pages": f"WITH {_TALKS} SELECT 'talk/' || conv_id || '.pdf' AS uri, (i + 1)::INT AS page, role || chr(10) || text AS text, false AS has_image FROM t UNION ALL SELECT 'talk/' || conv_id || '.pdf', (n + 1)::INT, '', false FROM g",
    "pdf_segments": f"WITH {_TALKS}, p AS (SELECT conv_id, (i + 1)::INT AS seq, role || chr(10) || text || chr(10) AS chunk FROM t UNION ALL SELECT conv_id, (n + 1)::INT, '(page ' || (n + 1) || ' is blank)' || chr(10) FROM g) " + _flat("'talk/' || conv_id || '.pdf' AS uri, seq", key="conv_id"),
    "page_roll_up": f"WITH {_TALKS}, c AS (SELECT conv_id, sum(length(role) + 1 + length(text))::BIGINT AS characters FROM t GROUP BY conv_id) SELECT 'talk/' || conv_id || '.pdf' AS uri, n + 1 AS page_count, n AS text_pages, characters, 'blank pages' AS what, '1 page(s): ' || (n + 1) AS detail FROM g JOIN c USING (conv_id)",
    "srt_cues": r"WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations) SELECT 'talk/' || conv_id || '.srt' AS uri, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, (turn * 7 + 0.25)::DOUBLE AS start_s, (turn * 7 + 5.25)::DOUBLE AS end_s, text FROM t",
    "inspect_cards": f"""WITH {_HTML}, k AS (SELECT uri, count(*) AS n FROM f GROUP BY uri)
      SELECT 'doc/' || doc_id || '.txt' AS uri, 'text' AS handler_id, 'text/plain' AS mime, strlen(text)::BIGINT AS size_bytes, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::VARCHAR AS lines, NULL::VARCHAR AS blocks, 'read_range' AS affordances FROM documents
      UNION ALL SELECT 'page/' || page_id || '.html', 'html', 'text/html', strlen(html), NULL, coalesce(n, 0)::VARCHAR, 'read_range,read_section' FROM pages LEFT JOIN k ON k.uri = 'page/' || page_id""",
    "list_sources": f"""WITH {_TALKS}, z AS (SELECT 'talk/' || conv_id || '.zip' AS zip, i FROM t) SELECT DISTINCT zip AS uri, 'archive' AS handler_id, 'application/zip' AS mime FROM z UNION ALL SELECT DISTINCT zip || '!inner.tar.gz', 'archive', 'application/gzip' FROM z
      UNION ALL SELECT zip || '!' || i || '.txt', 'text', 'text/plain' FROM z UNION ALL SELECT zip || '!inner.tar.gz!' || i || '\\!.txt', 'text', 'text/plain' FROM z""",
    "represent_files": f"""WITH {_HTML}, e AS (SELECT uri, count(DISTINCT section) - 1 AS edges FROM f GROUP BY uri), w AS (SELECT uri, string_agg(chunk, '' ORDER BY seq) AS text, count(*) AS n FROM f GROUP BY uri)
      SELECT 'doc/' || doc_id || '.txt' AS uri, length(text)::BIGINT AS length, md5(text) AS text_md5, 1::BIGINT AS n_segments, 0::BIGINT AS n_barriers FROM documents
      UNION ALL SELECT w.uri || '.html', length(text), md5(text), n, edges FROM w JOIN e USING (uri)""",
    "invoke_answers": f"""WITH {_HTML}, k AS (SELECT uri, max(section) + 1 AS n, string_agg(text, chr(10) ORDER BY seq) FILTER (section = 0) AS first FROM f GROUP BY uri), q AS (SELECT 'page/' || page_id AS uri, coalesce(n, 0)::BIGINT AS n, first FROM pages LEFT JOIN k ON k.uri = 'page/' || page_id)
      SELECT 'doc/' || doc_id || '.txt' AS uri, 'read_range' AS name, substr(text, least(3, length(text) - 1) + 1, greatest(least(3, length(text) - 1) + 1, least(12, length(text))) - least(3, length(text) - 1)) AS text, false AS degraded, NULL::VARCHAR AS error FROM documents
      UNION ALL SELECT 'doc/' || doc_id || '.txt', 'fly', NULL, false, 'unknown operation fly; known: read_range' FROM documents
      UNION ALL SELECT uri || '.html', 'read_section', coalesce(first, 'section 0 does not exist; the page has ' || n || ' section(s)'), first IS NULL, NULL FROM q
      UNION ALL SELECT uri || '.html', 'read_section', 'section 99999 does not exist; the page has ' || n || ' section(s)', true, NULL FROM q""",
    "invoke_office": f"""WITH {_DOCX}, h AS (SELECT t.*, n, rows, p.chunk FROM t JOIN g USING (conv_id) JOIN p USING (conv_id, i) WHERE t.i = 0)
      SELECT 'talk/' || conv_id || '.' || suffix AS uri, name, text, degraded, NULL::VARCHAR AS error FROM (
      SELECT conv_id, 'docx' AS suffix, 'read_section' AS name, substr(chunk, 1, length(chunk) - 2) AS text, false AS degraded FROM h UNION ALL SELECT conv_id, 'docx', 'list_comments', 'reader: ' || n || ' parts', false FROM h
      UNION ALL SELECT conv_id, 'docx', 'read_table', rows, false FROM h UNION ALL SELECT conv_id, 'docx', 'read_range', substr(chunk, 1, 4), false FROM h UNION ALL SELECT conv_id, 'pptx', 'read_slide', role || chr(10) || text, false FROM h
      UNION ALL SELECT conv_id, 'pptx', 'list_media', 'slide 1, picture 0: image/png, 24 bytes', false FROM h UNION ALL SELECT conv_id, 'epub', 'read_chapter', role || chr(10) || text, false FROM h UNION ALL SELECT conv_id, 'epub', 'read_range', substr(role || chr(10), 1, 4), false FROM h
      UNION ALL SELECT conv_id, 'pdf', 'read_page', role || chr(10) || text, false FROM h UNION ALL SELECT conv_id, 'pdf', 'read_page', 'page 0 does not exist; there are ' || (n + 1) || ' page(s)', true FROM h)""",
    "invoke_sheets": f"""WITH {_BOOKS}, n AS (SELECT uri, count(*) AS n FROM b GROUP BY uri), r AS (SELECT uri, string_agg(k || ' | ' || v, chr(10) ORDER BY r) AS rows FROM b WHERE r IN (1, 2) GROUP BY uri)
      SELECT uri, name, text, degraded, NULL::VARCHAR AS error FROM (SELECT uri, 'list_sheets' AS name, 'Data: A1:B' || n || ' (' || n || ' row(s), 2 column(s))' AS text, false AS degraded FROM n UNION ALL SELECT uri, 'read_sheet', rows, false FROM r UNION ALL SELECT uri, 'read_cells', rows, false FROM r
      UNION ALL SELECT uri, 'read_cells', '''?'' is not a cell or range in A1 notation, which looks like B2 or B2:D10', true FROM n UNION ALL SELECT uri, 'read_sheet', 'sheet ''None'' does not exist; the workbook has: Data', true FROM n)""",
    "media_cards": r"""WITH c AS (SELECT conv_id, count(*) AS n, max(turn) AS last, sum(length('[0:00:00.0] ' || trim(regexp_replace(text, '\s+', ' ', 'g'))) + 1)::BIGINT AS length, string_agg('[0:00:00.0] ' || trim(text), chr(10)) FILTER (turn = 0) AS first FROM conversations GROUP BY conv_id)
      SELECT 'talk/' || conv_id || '.m4a' AS uri, 'audio' AS handler_id, 'audio_streams=1;container=mov;cue_count=' || n || ';duration_s=' || (last * 2 + 2) || '.5;languages=de, en;video_streams=0' AS facts, length, n AS n_segments, coalesce(first, 'nothing was transcribed between 0:00:00.0 and 0:00:02.0') AS span, NULL::VARCHAR AS span_error FROM c""",
    "kept_renditions": "SELECT 'doc/' || doc_id AS uri, text, doc_id % 2 = 0 AS degraded, source || ' r1c2' AS \"at\" FROM documents",
    "kept_cues": "SELECT 'talk/' || conv_id AS uri, turn AS seq, turn / 4.0::DOUBLE AS start_s, text, role AS speaker FROM conversations",
    "fingerprints": "SELECT doc_id, sha256('asr' || chr(0) || lang || chr(0) || 'vision' || chr(0) || source || chr(0)) AS fingerprint FROM documents",
    "span_overlaps": "SELECT l_linenumber, l_linenumber * 3 < 20 AND 10 < l_linenumber * 3 + l_quantity AS touches, count(*) AS n FROM lineitem GROUP BY ALL",
    "crop_boxes": """WITH p AS (SELECT p_partkey, (p_partkey % 10) / 16.0::DOUBLE AS x, (p_partkey % 3) / 4.0::DOUBLE AS y FROM part)
      SELECT p_partkey, x + 0.25 <= 1 AND y + 0.5 <= 1 AS in_frame, false AS whole, floor(x * 640)::BIGINT AS left, floor(y * 480)::BIGINT AS top, floor((x + 0.25) * 640)::BIGINT AS right, floor((y + 0.5) * 480)::BIGINT AS bottom FROM p""",
    "enumerations": "WITH g AS (SELECT source, list(lpad(doc_id::VARCHAR, 9, '0') ORDER BY doc_id) AS ids FROM documents GROUP BY source) SELECT source, CASE WHEN len(ids) <= 5 THEN array_to_string(ids, ', ') ELSE array_to_string(ids[1:5], ', ') || ' and ' || (len(ids) - 5) || ' more' END AS listed FROM g",
    "hrefs": "SELECT page_id, 'OEBPS/img x/' || page_id || '.png' AS resolved FROM pages",
    "clip_costs": "SELECT p_partkey, CASE WHEN p_partkey % 80 <= 40 THEN 'about ' || format('{:,}', (p_partkey % 80) * 2100) || ' prompt tokens' ELSE 'at least 88,033 prompt tokens; past 40 s the cost no longer follows the length' END AS cost FROM part",
    "timestamps": """WITH x AS (SELECT l_orderkey, l_linenumber, l_orderkey / 20.0::DOUBLE AS a, l_orderkey / 4.0::DOUBLE AS b FROM lineitem)
      SELECT l_orderkey, l_linenumber, printf('%d:%02d:%04.1f', floor(a / 3600)::BIGINT, floor((a - floor(a / 3600) * 3600) / 60)::BIGINT, a - floor(a / 3600) * 3600 - floor((a - floor(a / 3600) * 3600) / 60) * 60) AS a,
      printf('%d:%02d:%04.1f', floor(b / 3600)::BIGINT, floor((b - floor(b / 3600) * 3600) / 60)::BIGINT, b - floor(b / 3600) * 3600 - floor((b - floor(b / 3600) * 3600) / 60) * 60) AS b FROM x""",
    "affordance_lookup": "SELECT doc_id, ['read_range', 'fly', 'read_section'][doc_id % 3 + 1] AS name, CASE WHEN doc_id % 3 = 1 THEN 'unknown operation fly; known: read_range, read_section' END AS error, CASE WHEN doc_id % 3 = 0 THEN '4096' END AS default_end FROM documents",
    "probed_streams": "SELECT 'part/' || p_partkey AS uri, p_partkey::DOUBLE AS duration_s, 'mkv' AS container, CASE WHEN p_partkey % 50 > 0 THEN (p_partkey % 50) / 4.0::DOUBLE END AS fps, (p_partkey % 1000)::INT AS width, true AS no_rate, true AS is_text FROM part",
    "distinct_languages": "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM documents GROUP BY source",
    "frame_states": "SELECT 'talk/' || conv_id AS uri, CASE role WHEN 'user' THEN 'described' WHEN 'system' THEN 'empty' ELSE 'not looked at' END AS state, count(*) AS n, min(turn) AS first FROM conversations GROUP BY ALL",
    "frames_described": "SELECT 'talk/' || conv_id AS uri, turn AS seq, turn * 5.0::DOUBLE AS start_s, CASE WHEN role = 'user' THEN trim(text, ' ') ELSE '(no description was produced for this frame)' END AS text FROM conversations",
    "suggested_frames": rf"SELECT 'talk/' || conv_id AS uri, turn * 20.0::DOUBLE AS at_s, 'pointing' AS why FROM conversations WHERE regexp_matches(text, '{timeline.POINTING}') UNION ALL " "SELECT * FROM (WITH w AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) SELECT 'talk/' || conv_id AS uri, turn * 20.0::DOUBLE + 4 + (nxt * 20.0::DOUBLE - turn * 20.0::DOUBLE - 4) / 2 AS at_s, 'silence' AS why FROM w WHERE nxt IS NOT NULL)",
    "changed_files": "SELECT 'doc/' || doc_id AS path, length(text)::INT AS length, 1 AS modificationTime FROM documents WHERE length(text) % 2 = 1",
    "replies": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN role || chr(10) || text END AS said FROM conversations",
    "formulas_without_values": """WITH b AS (SELECT 'nation/' || c_nationkey || '.xlsx' AS uri, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer), g AS (SELECT uri, list('Data!B' || r ORDER BY r) AS names FROM b GROUP BY uri)
      SELECT uri, 'formulas without cached values' AS what, len(names) || ' cell(s) hold a formula without a stored value (' || CASE WHEN len(names) <= 10 THEN array_to_string(names, ', ') ELSE array_to_string(names[1:10], ', ') || ' and ' || (len(names) - 10) || ' more' END || '); the formula is shown instead' AS detail FROM g""",
    "cues_outside": "SELECT 'talk/' || conv_id AS uri, 'cues outside the file' AS what, count(*) || ' cue(s) started at or after the duration of 5.5s and were dropped' AS detail FROM conversations WHERE turn * 2.0 >= 5.5 GROUP BY conv_id",
    "card_texts": "SELECT 'doc/' || doc_id || '.txt' AS uri, 'doc/' || doc_id || '.txt' AS told, 'text' AS handler_id, strlen(text)::BIGINT AS size_bytes, 'read_range' AS affordances FROM documents",
    "rendition_texts": "SELECT 'doc/' || doc_id || '.txt' AS uri, doc_id % 10 <> 1 AS ok, CASE WHEN doc_id % 10 <> 1 THEN 'located at characters 0-' || least(5, length(text)) || ':' || chr(10) || substr(text, 1, 5) END AS value, CASE WHEN doc_id % 10 = 1 THEN 'unknown operation fly; known: read_range' END AS error FROM documents",
    "part_texts": f"WITH {_DOCX} SELECT 'talk/' || conv_id || '.docx' AS uri, md5(string_agg(chunk, '' ORDER BY i)) AS text_md5 FROM p GROUP BY conv_id",
}


def queries() -> dict:
    return {k: globals()[k] for k in SQL}
