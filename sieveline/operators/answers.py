"""Requests to sources, answered family by family: rows (rid, text, locator, degraded) for asked rows (rid, uri, name, p).

p holds the parameters with their defaults, as text. Every family reads its own files once, however many requests they
get, and requests meet what was read by uri. A request for what isn't there gets a degraded row that says what is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.locators import bbox, byte_range, cell_range, char_span, page_ref, part_span, time_span
from sieveline.functions.text import clamp, cut, hexdump, parse_a1
from sieveline.operators import formats, html
from sieveline.operators.flatten import text_of
from sieveline.operators.timeline import read_span


def number(key: str, default: int) -> Column:
    return F.coalesce(F.try_element_at("p", F.lit(key)).try_cast("int"), F.lit(default))


def seconds(key: str) -> Column:
    return F.try_element_at("p", F.lit(key)).try_cast("double")


def named(asked: DataFrame, handler: str, *names: str) -> DataFrame:
    return asked.filter((F.col("handler_id") == handler) & F.col("name").isin(*names)).select("rid", "uri", "name", "p")


def _answer(df: DataFrame, text: Column, locator: Column, missing: Column, why: Column) -> DataFrame:
    """Answers; where missing, why, located at the whole file."""
    gone = F.coalesce(missing, F.lit(True))
    whole = byte_range(F.lit(0), F.lit(1))
    return df.select("rid", F.when(gone, why).otherwise(text).alias("text"), F.when(gone, whole).otherwise(locator).alias("locator"), gone.alias("degraded"))


def _say(*parts) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def of_texts(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """read_range of texts (uri, text)."""
    r = named(asked, "text", "read_range").join(texts.select("uri", F.coalesce("text", F.lit("")).alias("t")), "uri")
    s, e = clamp(number("start", 0), number("end", 1000), F.length("t"))
    return _answer(r, cut(F.col("t"), s, e), char_span(s, e), F.length("t") == 0, _say(F.col("uri"), " is empty; there is no range to read"))


def of_bytes(asked: DataFrame, files: DataFrame) -> DataFrame:
    """hexdump of files (uri, content)."""
    r = named(asked, "binary", "hexdump").join(files.select("uri", "content"), "uri")
    start = F.greatest(F.lit(0), number("start", 0))
    part = F.substring(F.col("content"), start + 1, F.least(F.lit(4096), F.greatest(F.lit(1), number("length", 256))))
    return _answer(r, hexdump(part, start), byte_range(start, start + F.greatest(F.lit(1), F.length(part))), F.lit(False), F.lit(""))


def of_pages(asked: DataFrame, read: DataFrame) -> DataFrame:
    """read_section and read_range of parsed pages (uri, blocks)."""
    r = named(asked, "html", "read_section", "read_range").join(read.select("uri", "blocks"), "uri")
    index, b = number("index", 0), F.col("blocks")
    of = F.filter(b, lambda x: x["section"] == index)
    n = F.coalesce(F.try_element_at(b, F.lit(-1))["section"] + 1, F.lit(0))
    section = _answer(
        r.filter("name = 'read_section'").withColumn("of", of).withColumn("n", n), F.array_join(F.transform("of", lambda x: x["text"]), "\n"),
        char_span(F.try_element_at("of", F.lit(1))["start"], F.try_element_at("of", F.lit(-1))["end"]), F.size("of") == 0, _say("section ", index, " does not exist; the page has ", F.col("n"), " section(s)"),
    )
    some, whole_length = r.filter("name = 'read_range'"), html.total(b)
    s, e = clamp(number("start", 0), number("end", 4096), whole_length)
    touched = F.filter(b, lambda x: (x["at"] < e) & (s < x["at"] + F.length(x["text"]) + F.when(x["is_last"], 2).otherwise(1)))
    located = char_span(F.array_min(F.transform(touched, lambda x: x["start"])), F.array_max(F.transform(touched, lambda x: x["end"])))
    return section.unionByName(_answer(some, cut(html.whole_text(b), s, e), located, whole_length == 0, _say(F.col("uri"), " has no readable text; there is no range to read")))


def of_books(asked: DataFrame, read: DataFrame, segments: DataFrame) -> DataFrame:
    """read_chapter of parsed parts (uri, part_no, part, blocks) and read_range of their segments. A range over several
    chapters is located in the first of them."""
    index, b = number("index", 0), F.col("blocks")
    n = read.groupBy("uri").agg(F.count(F.lit(1)).alias("n"))
    c = named(asked, "epub", "read_chapter").join(n, "uri", "left").withColumn("part_no", index).join(read.select("uri", "part_no", "part", "blocks"), ["uri", "part_no"], "left")
    gone = F.coalesce(F.size(b) <= 0, F.lit(True))
    why = F.when(F.col("part").isNull(), _say(F.col("uri"), " has ", F.coalesce("n", F.lit(0)), " chapters; chapter ", index, " does not exist")).otherwise(_say("chapter ", index, " of ", F.col("uri"), " has no readable text"))
    chapter = _answer(c, F.array_join(F.transform(b, lambda x: x["text"]), "\n"), part_span(F.col("part"), F.try_element_at(b, F.lit(1))["start"], F.try_element_at(b, F.lit(-1))["end"]), gone, why)
    r = _ranges(named(asked, "epub", "read_range"), segments)
    touched = r.filter("s is not null").join(segments.select("uri", "start", "end", "part_no", "locator"), "uri").filter((F.col("start") < F.col("e")) & (F.col("s") < F.col("end")))
    first = touched.withColumn("least", F.min("part_no").over(_by("rid"))).filter("part_no = least").groupBy("rid").agg(F.min("locator.part").alias("part"), F.min("locator.start").alias("a"), F.max("locator.end").alias("b"))
    r = r.join(first, "rid", "left")
    return chapter.unionByName(_answer(r, cut(F.col("t"), F.col("s"), F.col("e")), part_span(F.col("part"), F.col("a"), F.col("b")), F.col("s").isNull(), _say(F.col("uri"), " has no readable text; there is no range to read")))


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def _ranges(asked: DataFrame, segments: DataFrame) -> DataFrame:
    """Requests with the text t of their source and the range [s, e) moved into it; null where there is no text."""
    r = asked.join(text_of(segments).withColumnRenamed("text", "t"), "uri", "left")
    s, e = clamp(number("start", 0), number("end", 4096), F.length("t"))
    some = F.coalesce(F.length("t"), F.lit(0)) > 0
    return r.withColumn("s", F.when(some, s).cast("long")).withColumn("e", F.when(some, e).cast("long"))


def of_word(asked: DataFrame, blocks: DataFrame, comments: DataFrame) -> DataFrame:
    """read_section, read_range, read_table and list_comments of word-processing documents: blocks (uri, seq, level, kind,
    text), comments (uri, seq, author, text)."""
    prose = blocks.filter("text != ''").select("uri", "seq", "level", "text", F.lit(0).alias("start"), F.lit(1).alias("end"))
    flat = formats.word_segments(html.sections(prose))
    index = number("index", 0)
    n = flat.groupBy("uri").agg(F.count(F.lit(1)).alias("n"))
    s = named(asked, "word", "read_section").join(n, "uri", "left").withColumn("seq", index).join(flat.select("uri", F.col("seq").cast("int").alias("seq"), "chunk", "start", "end"), ["uri", "seq"], "left")
    section = _answer(s, F.regexp_replace("chunk", r"\n\n$", ""), char_span(F.col("start"), F.col("end")), F.col("chunk").isNull(), _say("section ", index, " does not exist; the document has ", F.coalesce("n", F.lit(0)), " section(s)"))
    r = _ranges(named(asked, "word", "read_range"), flat)
    ranges = _answer(r, cut(F.col("t"), F.col("s"), F.col("e")), char_span(F.col("s"), F.col("e")), F.col("s").isNull(), _say(F.col("uri"), " has no readable text; there is no range to read"))
    tables = blocks.filter("kind = 'table'").groupBy("uri").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]).alias("all"))
    t = named(asked, "word", "read_table").join(tables, "uri", "left")
    table = _answer(t, F.try_element_at("all", index + 1), byte_range(F.lit(0), F.lit(1)), (index < 0) | (index >= F.coalesce(F.size("all"), F.lit(0))), _say("table ", index, " does not exist; the document has ", F.greatest(F.lit(0), F.coalesce(F.size("all"), F.lit(0))), " table(s)"))
    who = F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("(unknown)"))
    notes = comments.groupBy("uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat(who, F.lit(": "), F.array_join(F.split(F.trim("text"), r"\s+"), " ")).alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    c = named(asked, "word", "list_comments").join(notes, "uri", "left")
    listed = _answer(c, F.coalesce("lines", F.lit("the document carries no comments")), byte_range(F.lit(0), F.lit(1)), F.lit(False), F.lit(""))
    return section.unionByName(ranges).unionByName(table).unionByName(listed)


def of_slides(asked: DataFrame, slides: DataFrame, media: DataFrame) -> DataFrame:
    """read_slide and list_media of decks: slides (uri, page, title, body, notes), media (uri, page, picture, mime,
    size_bytes)."""
    page = number("page", 1)
    flat = formats.slide_segments(slides).select("uri", F.col("seq").cast("int").alias("page"), F.regexp_replace("chunk", r"\n$", "").alias("t"))
    n = slides.groupBy("uri").agg(F.count(F.lit(1)).alias("n"))
    r = named(asked, "slides", "read_slide").join(n, "uri", "left").withColumn("page", page).join(flat, ["uri", "page"], "left")
    one = _answer(r, F.col("t"), page_ref(F.greatest(F.lit(1), page)), F.col("t").isNull(), _say("slide ", page, " does not exist; the deck has ", F.coalesce("n", F.lit(0)), " slide(s)"))
    line = F.format_string("slide %d, picture %d: %s, %d bytes", "page", "picture", "mime", "size_bytes")
    m = media.groupBy("uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "picture", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    listed = named(asked, "slides", "list_media").join(m, "uri", "left")
    return one.unionByName(_answer(listed, F.coalesce("lines", F.lit("the deck embeds no pictures")), byte_range(F.lit(0), F.lit(1)), F.lit(False), F.lit("")))


def of_sheets(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """list_sheets, read_sheet and read_cells of workbooks: cells (uri, sheet, sheet_no, row, col, value, formula). A sheet
    that is not named is the first. Rows are put together from the cells they have."""
    lists = named(asked, "sheets", "list_sheets").join(formats.list_sheets(cells), "uri", "left")
    listed = _answer(lists, F.col("text"), byte_range(F.lit(0), F.lit(1)), F.col("text").isNull(), _say(F.col("uri"), " holds no used cells"))
    shapes = formats.sheet_shapes(cells)
    names = shapes.groupBy("uri").agg(F.transform(F.array_sort(F.collect_list(F.struct("sheet_no", "sheet"))), lambda x: x["sheet"]).alias("sheets"))
    r = named(asked, "sheets", "read_sheet", "read_cells").join(names, "uri", "left").withColumn("want", F.try_element_at("p", F.lit("name")))
    r = r.withColumn("sheet", F.when(F.col("want").isNull(), F.try_element_at("sheets", F.lit(1))).when(F.array_contains("sheets", F.col("want")), F.col("want")))
    r = r.join(shapes.select("uri", "sheet", "rows", "cols"), ["uri", "sheet"], "left")
    a1 = parse_a1(F.coalesce(F.try_element_at("p", F.lit("a1_range")), F.lit("")))
    is_cells = F.col("name") == "read_cells"
    r = r.withColumn("a1", a1).withColumns({
        "top": F.when(is_cells, F.col("a1.row")).otherwise(F.greatest(F.lit(0), number("offset", 0))), "left": F.when(is_cells, F.col("a1.col")).otherwise(0),
        "height": F.when(is_cells, F.col("a1.rows")).otherwise(F.greatest(F.lit(0), number("limit", 100))), "width": F.when(is_cells, F.col("a1.cols")).otherwise(F.col("cols")),
        "formulas": is_cells & (F.lower(F.coalesce(F.try_element_at("p", F.lit("formulas")), F.lit(""))) == "true"),
    })
    shown = F.coalesce("value", F.when(F.col("formula").isNotNull(), F.concat(F.lit("="), "formula")), F.lit(""))
    inside = r.filter("top is not null and sheet is not null").select("rid", "uri", "sheet", "top", "left", "height", "width", "formulas").join(cells, ["uri", "sheet"])
    inside = inside.filter((F.col("row") >= F.col("top")) & (F.col("row") < F.col("top") + F.col("height")) & (F.col("col") >= F.col("left")) & (F.col("col") < F.col("left") + F.col("width")))
    v = F.when(F.col("formulas") & F.col("formula").isNotNull(), F.concat(F.lit("="), "formula")).otherwise(shown)
    by_row = inside.groupBy("rid", "row", "left", "width").agg(F.map_from_entries(F.collect_list(F.struct("col", v.alias("v")))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.col("left"), F.col("left") + F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), " | ")
    got = by_row.select("rid", "row", line.alias("line")).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("row", "line"))).alias("lines"))
    r = r.join(got, "rid", "left")
    n = F.greatest(F.lit(0), F.least(F.col("height"), F.col("rows") - F.col("top")))
    empty = F.array_join(F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.lit("")), " | ")
    body = F.when(n > 0, F.array_join(F.transform(F.sequence(F.col("top"), F.col("top") + n - 1), lambda i: F.coalesce(F.try_element_at("lines", i), empty)), "\n")).otherwise("")
    why = (
        F.when(F.col("sheets").isNull(), _say(F.col("uri"), " could not be opened as a workbook"))
        .when(F.col("sheet").isNull(), _say("sheet '", F.col("want"), "' does not exist; the workbook has: ", F.array_join("sheets", ", ")))
        .when(is_cells, _say("'", F.coalesce(F.try_element_at("p", F.lit("a1_range")), F.lit("")), "' is not a cell or range in A1 notation, which looks like B2 or B2:D10"))
        .otherwise(_say("sheet '", F.col("sheet"), "' has ", F.col("rows"), " row(s); there is nothing at offset ", F.col("top")))
    )
    missing = F.col("sheet").isNull() | F.col("top").isNull() | (~is_cells & (n <= 0))
    rows = F.when(is_cells, F.col("height")).otherwise(n)
    return listed.unionByName(_answer(r, body, cell_range(F.col("sheet"), F.col("top"), F.col("left"), rows, F.greatest(F.lit(1), F.col("width"))), missing, why))


def of_archives(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """list_entries of archives: entries (uri, seq, path, ...). A page of the list; the rest isn't gathered."""
    r = named(asked, "archive", "list_entries")
    offset, limit = F.greatest(F.lit(0), number("offset", 0)), F.least(F.lit(2000), F.greatest(F.lit(1), number("limit", 200)))
    n = entries.groupBy("uri").agg(F.count(F.lit(1)).alias("n"))
    page = r.select("rid", "uri", offset.alias("offset"), limit.alias("limit")).join(entries, "uri").filter((F.col("seq") >= F.col("offset")) & (F.col("seq") < F.col("offset") + F.col("limit")))
    lines = page.groupBy("rid").agg(F.count(F.lit(1)).alias("k"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", formats.entry_line().alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    r = r.join(n, "uri", "left").join(lines, "rid", "left").withColumn("offset", offset)
    text = _say(F.col("k"), " of ", F.col("n"), " entries, from offset ", F.col("offset"), "\n", F.col("lines"))
    return _answer(r, text, byte_range(F.lit(0), F.lit(1)), F.col("k").isNull(), _say("offset ", F.col("offset"), " is past the end; this container has ", F.coalesce("n", F.lit(0)), " entry(ies)"))


def of_leaves(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """read_page of pages (uri, page, text, has_image)."""
    page = number("page", 1)
    state = formats.page_state()
    words = F.when(state == "text", F.col("text")).when(state == "scanned", _say("(page ", F.col("page"), " is an image with no text layer)")).otherwise(_say("(page ", F.col("page"), " is blank)"))
    flat = pages.select("uri", "page", words.alias("t"))
    n = pages.groupBy("uri").agg(F.count(F.lit(1)).alias("n"))
    r = named(asked, "pdf", "read_page").join(n, "uri", "left").withColumn("page", page).join(flat, ["uri", "page"], "left")
    return _answer(r, F.col("t"), page_ref(F.greatest(F.lit(1), page)), F.col("t").isNull(), _say("page ", page, " does not exist; there are ", F.coalesce("n", F.lit(0)), " page(s)"))


def of_regions(asked: DataFrame, region) -> DataFrame:
    """page_region (page, x, y, w, h; parts of the page from its upper left corner) by region, a function of asked places
    that gives (uri, page, x, y, w, h, text, n_pages)."""
    part = lambda k, default: F.coalesce(seconds(k), F.lit(default))
    r = named(asked, "pdf", "page_region").select("rid", "uri", number("page", 1).alias("page"), part("x", 0.0).alias("x"), part("y", 0.0).alias("y"), part("w", 1.0).alias("w"), part("h", 1.0).alias("h"))
    keys = ["uri", "page", "x", "y", "w", "h"]
    r = r.join(region(r.select(*keys).distinct()), keys, "left")
    return _answer(r, F.col("text"), bbox(*(F.col(k) for k in "xywh"), page=F.col("page")), F.col("text").isNull(), _say("page ", F.col("page"), " does not exist; there are ", F.coalesce("n_pages", F.lit(0)), " page(s)"))


def of_cues(asked: DataFrame, cues: DataFrame) -> DataFrame:
    """read_span of audio and read_transcript of video from cues (uri, seq, start_s, end_s, text); a window without an end
    goes to the last cue's."""
    r = named(asked, "audio", "read_span").unionByName(named(asked, "video", "read_transcript"))
    last = cues.groupBy("uri").agg(F.max("end_s").alias("last"))
    r = r.join(last, "uri", "left").withColumn("from_s", F.coalesce(seconds("start_s"), F.lit(0.0))).withColumn("to_s", F.coalesce(seconds("end_s"), F.col("last"), F.lit(0.0)))
    got = read_span(cues, r.select("uri", "from_s", "to_s")).distinct()
    r = r.join(got.select("uri", "from_s", "to_s", "text", "degraded"), ["uri", "from_s", "to_s"])
    return r.select("rid", "text", F.when(F.col("from_s") < F.col("to_s"), time_span(F.col("from_s"), F.col("to_s"))).otherwise(byte_range(F.lit(0), F.lit(1))).alias("locator"), "degraded")
