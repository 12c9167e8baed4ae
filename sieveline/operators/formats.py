"""Cards, renditions and flattened texts of the formats that are lists of things: texts, bytes, archives, sheets, pages.

All start from the long tables that readers make: documents (uri, text), files (uri, content), entries, cells, pages,
parts. Misuse gives a degraded row that says what is wrong, never a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.locators import byte_range, cell_range, char_span, page_ref, part_span
from sieveline.functions.text import clamp, column_letters, cut, fit_text, hexdump, line_count, listed, parse_a1, to_a1, truncated_note
from sieveline.operators.flatten import flatten

NOTE = "struct<what:string,detail:string>"


def note(what: str, detail) -> Column:
    return F.struct(F.lit(what).alias("what"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))


# texts -------------------------------------------------------------------------------------------------------------


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """files with text and encoding: UTF-8, else ISO 8859-1 if that gives no control characters, else UTF-8 with
    replacements."""
    good = F.is_valid_utf8(F.col(content).cast("string"))
    hexed = F.hex(content)
    western = ~hexed.rlike("^(?:..)*(?:00|[89].)")
    text = F.when(good, F.col(content).cast("string")).when(western, F.decode(F.when(western, F.col(content)), "ISO-8859-1")).otherwise(F.make_valid_utf8(F.col(content).cast("string")))
    return files.withColumn("text", text).withColumn("encoding", F.when(good, "utf-8").when(western, "iso-8859-1").otherwise("utf-8/replace"))


def text_card(docs: DataFrame, excerpt: int = 1000) -> DataFrame:
    """uri, lines, characters, excerpt of documents (uri, text); null counts as empty."""
    t = F.coalesce("text", F.lit(""))
    return docs.select("uri", line_count(t).cast("long").alias("lines"), F.length(t).cast("long").alias("characters"), F.nullif(F.left(t, F.lit(excerpt)), F.lit("")).alias("excerpt"))


def text_read_range(docs: DataFrame, start: int = 0, end: int = 1000) -> DataFrame:
    """uri, start, end, text, degraded: both ends are moved into the text; an empty text has no range to read."""
    t = F.coalesce("text", F.lit(""))
    s, e = clamp(F.lit(start), F.lit(end), F.length(t))
    some = F.length(t) > 0
    return docs.select(
        "uri", F.when(some, s).cast("long").alias("start"), F.when(some, e).cast("long").alias("end"),
        F.when(some, cut(t, s, e)).otherwise(F.concat("uri", F.lit(" is empty; there is no range to read"))).alias("text"), (~some).alias("degraded"),
    )


def text_represent(docs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """uri, text, locator, degradations: the text itself; of an empty file a sentence, marked as made up. Both fit."""
    t = F.coalesce("text", F.lit(""))
    full = F.when(F.length(t) > 0, t).otherwise(F.concat(F.lit("[empty text file: "), F.col("uri"), F.lit("]")))
    kept = fit_text(full, max_chars)
    made = F.when(F.length(t) == 0, note("synthesized description", "the file is empty; this text describes it"))
    return docs.select("uri", kept.alias("text"), char_span(F.lit(0), F.length(kept)).alias("locator"), F.array_compact(F.array(made, truncated_note(full, kept))).alias("degradations"))


# bytes -------------------------------------------------------------------------------------------------------------


def binary_hexdump(files: DataFrame, start: int = 0, length: int = 256, content: str = "content") -> DataFrame:
    """uri, start, end, text: at most 4096 bytes from start; past the end nothing, located at one byte."""
    part = F.substring(F.col(content), F.lit(start + 1), F.lit(min(4096, max(1, length))))
    end = F.greatest(F.lit(start + 1), F.lit(start) + F.length(part))
    return files.select("uri", F.lit(start).cast("long").alias("start"), end.cast("long").alias("end"), hexdump(part, F.lit(start)).alias("text"))


def binary_card(files: DataFrame, content: str = "content") -> DataFrame:
    return files.select("uri", F.length(content).cast("long").alias("size_bytes"), F.nullif(hexdump(F.substring(F.col(content), 1, 256), F.lit(0)), F.lit("")).alias("excerpt"))


def binary_represent(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """uri, text, locator, degradations of files (uri, mime, size_bytes): a sentence, marked as made up, that fits."""
    full = F.concat(F.lit("Binary file "), F.col("uri"), F.lit(" of type "), F.col("mime"), F.lit(", "), F.col("size_bytes").cast("string"), F.lit(" bytes. No textual content could be extracted."))
    kept = fit_text(full, max_chars)
    made = note("synthesized description", "no content was extracted; this text describes the file")
    return files.select("uri", kept.alias("text"), byte_range(F.lit(0), F.greatest(F.lit(1), F.col("size_bytes"))).alias("locator"), F.array_compact(F.array(made, truncated_note(full, kept))).alias("degradations"))


# archives ----------------------------------------------------------------------------------------------------------


def entry_line() -> Column:
    kind = F.when(F.col("is_dir"), "dir ").when(F.col("is_symlink"), "link").otherwise("file")
    size = F.col("size_bytes").cast("string")
    return F.concat(kind, F.lit(" "), F.when(F.length(size) < 12, F.lpad(size, 12, " ")).otherwise(size), F.lit("  "), F.col("path"))


def archive_card(entries: DataFrame) -> DataFrame:
    """uri, entry_count, uncompressed_bytes, compressed_bytes, expansion_ratio, solid of entries."""
    c, u = F.sum("compressed_bytes"), F.sum("size_bytes")
    return entries.groupBy("uri").agg(
        F.count(F.lit(1)).alias("entry_count"), u.cast("long").alias("uncompressed_bytes"), c.cast("long").alias("compressed_bytes"),
        F.when(c > 0, F.round(u / c, 2)).otherwise(F.lit(0.0)).alias("expansion_ratio"), F.every(F.col("byte_offset").isNull()).alias("solid"),
    )


def archive_segments(entries: DataFrame) -> DataFrame:
    """One line an entry, located at its bytes, or at its place in the list where an archive is solid."""
    at = F.when(F.col("byte_offset").isNull(), char_span(F.col("seq"), F.col("seq") + 1)).otherwise(byte_range(F.col("byte_offset"), F.col("byte_offset") + F.greatest(F.lit(1), F.col("compressed_bytes"))))
    return flatten(entries.select("uri", "seq", F.concat(entry_line(), F.lit("\n")).alias("chunk"), at.alias("locator")))


def archive_page(entries: DataFrame, offset: int = 0, limit: int = 200) -> DataFrame:
    """uri, text, degraded: a page of the list under a line that says which; past the end the text says so."""
    limit = min(2000, max(1, limit))
    some = (F.col("seq") >= offset) & (F.col("seq") < offset + limit)
    g = entries.groupBy("uri").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(some).alias("k"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(some, F.struct("seq", entry_line().alias("line"))))), lambda t: t["line"]), "\n").alias("lines"),
    )
    body = F.concat(F.col("k").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(f" entries, from offset {offset}\n"), F.col("lines"))
    past = F.concat(F.lit(f"offset {offset} is past the end; this container has "), F.col("n").cast("string"), F.lit(" entry(ies)"))
    return g.select("uri", F.when(F.col("k") > 0, body).otherwise(past).alias("text"), (F.col("k") == 0).alias("degraded"))


def over_limits(entries: DataFrame, members: int = 10_000, total_bytes: int = 4 << 30, ratio: float = 200.0) -> DataFrame:
    """(uri, reason): archives that declare too many members, too many bytes, or a member that swells too much."""
    g = entries.groupBy("uri").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"),
        F.max(F.when(F.col("compressed_bytes") > 0, F.col("size_bytes") / F.col("compressed_bytes"))).alias("worst"),
    )
    why = F.when(F.col("n") > members, "too many members").when(F.col("bytes") > total_bytes, "too many bytes").when(F.col("worst") > ratio, "expansion ratio")
    return g.select("uri", why.alias("reason")).filter("reason is not null")


# sheets: cells (uri, sheet, sheet_no, row, col, value, formula) -----------------------------------------------------


def sheet_shapes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("uri", "sheet", "sheet_no").agg((F.max("row") + 1).cast("int").alias("rows"), (F.max("col") + 1).cast("int").alias("cols"))


def list_sheets(cells: DataFrame) -> DataFrame:
    """(uri, text): a line a sheet with its used range."""
    line = F.concat("sheet", F.lit(": A1:"), to_a1(F.greatest(F.lit(0), F.col("rows") - 1), F.greatest(F.lit(0), F.col("cols") - 1)), F.lit(" ("), F.col("rows").cast("string"), F.lit(" row(s), "), F.col("cols").cast("string"), F.lit(" column(s))"))
    return sheet_shapes(cells).groupBy("uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_no", line.alias("line")))), lambda t: t["line"]), "\n").alias("text"))


def row_lines(cells: DataFrame, left: int = 0, width: int | None = None) -> DataFrame:
    """(uri, sheet, sheet_no, row, line): the cells of a row between the columns by ` | `, empty ones in their places.

    A row is put together from the cells it has, not from a grid."""
    right = F.max("col").over(Window.partitionBy("uri", "sheet")) if width is None else F.lit(left + width - 1)
    c = cells.withColumn("last", right).filter((F.col("col") >= left) & (F.col("col") <= F.col("last")))
    shown = F.coalesce("value", F.when(F.col("formula").isNotNull(), F.concat(F.lit("="), F.col("formula"))), F.lit(""))
    g = c.groupBy("uri", "sheet", "sheet_no", "row", "last").agg(F.map_from_entries(F.collect_list(F.struct("col", shown.alias("v")))).alias("m"))
    line = F.array_join(F.transform(F.sequence(F.lit(left), F.col("last").cast("int")), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))), " | ")
    return g.select("uri", "sheet", "sheet_no", "row", line.alias("line"))


def _rows_text(lines: DataFrame) -> DataFrame:
    return lines.groupBy("uri", "sheet", "sheet_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda t: t["line"]), "\n").alias("text"), F.count(F.lit(1)).alias("n_rows"), F.min("row").alias("first_row"),
    )


def read_sheet(cells: DataFrame, sheet: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """(uri, text, n_rows, locator) of rows of one sheet; the place is what came back, not what was asked for."""
    got = _rows_text(row_lines(cells.filter(F.col("sheet") == sheet)).filter((F.col("row") >= offset) & (F.col("row") < offset + limit)))
    shape = sheet_shapes(cells).select("uri", "sheet", "cols")
    return got.join(shape, ["uri", "sheet"]).select("uri", "text", "n_rows", cell_range(F.col("sheet"), F.lit(offset), F.lit(0), F.col("n_rows"), F.greatest(F.lit(1), F.col("cols"))).alias("locator"))


def read_cells(cells: DataFrame, sheet: str, a1_range: str, formulas: bool = False) -> DataFrame:
    """(uri, text, locator, degraded) of a block in A1 notation; a range that doesn't parse gives a row that says so."""
    block = cells.sparkSession.range(1).select(parse_a1(F.lit(a1_range)).alias("b")).first().b
    if block is None:
        return cells.select("uri").distinct().select("uri", F.lit(f"{a1_range!r} is not a cell or range in A1 notation, which looks like B2 or B2:D10").alias("text"), byte_range(F.lit(0), F.lit(1)).alias("locator"), F.lit(True).alias("degraded"))
    c = cells.filter((F.col("sheet") == sheet) & F.col("row").between(block.row, block.row + block.rows - 1))
    if formulas:
        c = c.withColumn("value", F.coalesce(F.concat(F.lit("="), F.col("formula")), F.col("value")))
    return _rows_text(row_lines(c, block.col, block.cols)).select("uri", "text", cell_range(F.lit(sheet), F.lit(block.row), F.lit(block.col), F.lit(block.rows), F.lit(block.cols)).alias("locator"), F.lit(False).alias("degraded"))


def sheet_segments(cells: DataFrame) -> DataFrame:
    """A chunk a sheet: its name, then its rows."""
    rows = _rows_text(row_lines(cells)).join(sheet_shapes(cells), ["uri", "sheet", "sheet_no"])
    at = cell_range(F.col("sheet"), F.lit(0), F.lit(0), F.greatest(F.lit(1), F.col("rows")), F.greatest(F.lit(1), F.col("cols")))
    return flatten(rows.select("uri", F.col("sheet_no").alias("seq"), F.concat("sheet", F.lit("\n"), F.col("text"), F.lit("\n")).alias("chunk"), at.alias("locator")))


def uncomputed(cells: DataFrame) -> DataFrame:
    """(uri, what, detail): one report a workbook of formulas without a stored value."""
    c = cells.filter(F.col("formula").isNotNull() & F.col("value").isNull())
    names = F.transform(F.array_sort(F.collect_list(F.struct("sheet_no", "row", "col", F.concat("sheet", F.lit("!"), to_a1(F.col("row"), F.col("col"))).alias("n")))), lambda t: t["n"])
    g = c.groupBy("uri").agg(names.alias("names"))
    return g.select("uri", F.lit("formulas without cached values").alias("what"), F.concat(F.size("names").cast("string"), F.lit(" cell(s) hold a formula without a stored value ("), listed(F.col("names")), F.lit("); the formula is shown instead")).alias("detail"))


# pages, slides: rows (uri, page, text, notes?, has_image?) ----------------------------------------------------------


def page_state() -> Column:
    """text, scanned (an image and no words) or blank."""
    return F.when(F.trim(F.coalesce("text", F.lit(""))) != "", "text").when(F.col("has_image"), "scanned").otherwise("blank")


def page_segments(pages: DataFrame) -> DataFrame:
    """A chunk a page: its text or a sentence that says why there is none."""
    s = page_state()
    n = F.col("page").cast("string")
    body = F.when(s == "text", F.col("text")).when(s == "scanned", F.concat(F.lit("(page "), n, F.lit(" is an image with no text layer)"))).otherwise(F.concat(F.lit("(page "), n, F.lit(" is blank)")))
    return flatten(pages.select("uri", F.col("page").alias("seq"), F.concat(body, F.lit("\n")).alias("chunk"), page_ref(F.col("page")).alias("locator")))


def page_notes(pages: DataFrame) -> DataFrame:
    """(uri, what, detail): one report for each state without text, naming the first pages."""
    g = pages.withColumn("state", page_state()).filter("state != 'text'").groupBy("uri", "state").agg(F.array_sort(F.collect_list("page")).alias("p"))
    what = F.when(F.col("state") == "scanned", "scanned pages: image content, no text layer").otherwise("blank pages")
    return g.select("uri", what.alias("what"), F.concat(F.size("p").cast("string"), F.lit(" page(s): "), listed(F.transform("p", lambda x: x.cast("string")))).alias("detail"))


def page_card(pages: DataFrame) -> DataFrame:
    return pages.groupBy("uri").agg(F.count(F.lit(1)).alias("page_count"), F.count_if(page_state() == "text").alias("text_pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"))


def read_page(pages: DataFrame, page: int) -> DataFrame:
    """(uri, text, locator, degraded): one page; a page that isn't there gives a row that says how many there are."""
    g = pages.groupBy("uri").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("page") == page, F.coalesce("text", F.lit("")))).alias("t"))
    gone = F.concat(F.lit(f"page {page} does not exist; there are "), F.col("n").cast("string"), F.lit(" page(s)"))
    return g.select("uri", F.coalesce("t", gone).alias("text"), F.when(F.col("t").isNotNull(), page_ref(F.lit(max(1, page)))).otherwise(byte_range(F.lit(0), F.lit(1))).alias("locator"), F.col("t").isNull().alias("degraded"))


def slide_segments(slides: DataFrame) -> DataFrame:
    """A chunk a slide (uri, page, title, body, notes): title, body, `Speaker notes: ...`."""
    parts = F.concat_ws("\n", F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("body"), F.lit("")), F.when(F.coalesce("notes", F.lit("")) != "", F.concat(F.lit("Speaker notes: "), F.col("notes"))))
    body = F.when(parts == "", "(this slide carries no text)").otherwise(parts)
    return flatten(slides.select("uri", F.col("page").alias("seq"), F.concat(body, F.lit("\n")).alias("chunk"), page_ref(F.col("page")).alias("locator")))


# word processing and books: blocks (uri, seq, level, text, part?) ---------------------------------------------------


def word_segments(sectioned: DataFrame) -> DataFrame:
    """A chunk a section of sectioned blocks: title and blocks by line breaks, an empty line after; located at itself."""
    g = sectioned.filter("text != ''").groupBy("uri", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda t: t["text"]), "\n").alias("t"))
    flat = flatten(g.select("uri", F.col("section").alias("seq"), F.concat("t", F.lit("\n\n")).alias("chunk")))
    return flat.withColumn("locator", char_span(F.col("start"), F.col("end")))


def book_segments(blocks: DataFrame) -> DataFrame:
    """A chunk a block of a book (uri, part_no, part, seq, text, start, end), an empty line after each part; located in
    the part's own text."""
    last = F.max("seq").over(Window.partitionBy("uri", "part_no"))
    order = Window.partitionBy("uri").orderBy("part_no", "seq")
    b = blocks.filter("text != ''").withColumn("last", last).withColumn("n", (F.row_number().over(order) - 1).cast("long"))
    chunk = F.concat("text", F.when(F.col("seq") == F.col("last"), "\n\n").otherwise("\n"))
    return flatten(b.select("uri", F.col("n").alias("seq"), "part_no", "part", chunk.alias("chunk"), part_span(F.col("part"), F.col("start"), F.col("end")).alias("locator")))


def sheet_names(n: int) -> Column:
    return column_letters(F.lit(n))
