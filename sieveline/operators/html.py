"""Web pages: blocks of prose that know their place in the markup, sections, cards, renditions.

A page is one row from its markup to its answer. One Arrow function scans the markup token by token and gives the page's
title and blocks as an array; cards, segments, barriers and renditions are expressions on that array, so nothing is
shuffled, and rows that are repeated under one uri stay rows of their own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.locators import char_span
from sieveline.functions.text import cut, word_count
from sieveline.operators.flatten import DEGRADATION
from sieveline.sources.files import small_batches

#: Tags that end one run of prose and begin another.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "caption", "dd", "div", "dt", "figcaption", "footer", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "li", "main", "nav", "p", "pre", "section", "td", "th", "tr",
)
UNTITLED = "(untitled)"
_BLOCKS = frozenset(BLOCK_TAGS)
#: The rest of a start tag: a value in quotes may hold any character; one whose quotes never close makes no tag.
_REST = r"""(?:[^>=]++|=++\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+>"""
_TOKEN = re.compile(
    rf"<(?P<raw>script|style)(?=[\s/>]){_REST}(?<!/>).*?(?:</\s*(?P=raw)\s*>|\Z)|<!--.*?--\s*>|</\s*(?P<close>[a-z][^\s/>]*)?[^>]*>"
    rf"|<(?P<open>[a-z][^\s/>]*){_REST}|<(?!!--)[!?][^>]*>|(?P<text>[^<]+|<(?:!--|[a-z])[^>]*>|<)",
    re.I | re.S,
)
#: A character reference that ends with its semicolon.
_CLOSED = re.compile(r"&#?\w+;")
_COMMENT_END = re.compile(r"--\s*>")
#: A block as a column: its place among the page's blocks, in the markup (start, end), in its section and in the
#: flattened text (at); is_last ends a section.
BLOCK = "struct<seq:bigint,level:int,text:string,start:bigint,end:bigint,section:bigint,section_title:string,is_titled:boolean,is_last:boolean,at:bigint>"
_BLOCK = pa.struct([
    ("seq", pa.int64()), ("level", pa.int32()), ("text", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("section", pa.int64()),
    ("section_title", pa.string()), ("is_titled", pa.bool_()), ("is_last", pa.bool_()), ("at", pa.int64()),
])


def _tokens(source: str) -> Iterator[tuple[str | None, str, int, int]]:
    """(kind, tag, start, end) of the tokens of a page. What can no longer close is not looked for to the end of the page
    again and again, so a page of nothing but beginnings takes no longer than others."""
    at, last, last_comment = 0, source.rfind(">"), max((m.start() for m in _COMMENT_END.finditer(source)), default=-1)
    while at <= last:
        if at > last_comment and source.startswith("<!--", at):
            end = source.index(">", at) + 1
            yield "text", "", at, end
        else:
            m = _TOKEN.match(source, at)
            end = m.end()
            yield m.lastgroup, (m["raw"] or m["open"] or m["close"] or "").lower(), at, end
        at = end
    for start, end in ((at, len(source) if (i := source.find("<", at)) < 0 else i), (i if i >= 0 else len(source), len(source))):
        if start < end:
            yield "text", "", start, end


def _unescaped(words: str, bare: bool) -> str:
    """Words with their character references read. Browsers read some without a semicolon too (&amp at a text's end)."""
    if bare or "&" not in words:
        return html.unescape(words)
    return _CLOSED.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], words)


def runs(source: str, bare: bool = True) -> Iterator[tuple[int, str, int, int]]:
    """(level, text, start, end) of the runs of prose of a page, and (-1, title, 0, 0) for each title.

    A block tag, a script or a style ends the run before it; a block's start tag begins one behind itself, with the level
    of a heading; other text begins one where it stands, unless it is white space. Inline tags and comments don't part a
    run; what looks like markup but has no end is text. Runs without words are not there. bare: whether character
    references count that lack their semicolon."""
    said, title, start, level = [], None, None, 0

    def ended(at: int):
        text = " ".join("".join(said).split())
        said.clear()
        if text and start is not None:
            yield level, text, start, max(at, start + 1)

    for kind, tag, at, end in _tokens(source):
        if kind == "text":
            words = source[at:end]
            words = _unescaped(words, bare) if "&" in words else words
            if title is not None:
                title.append(words)
                continue
            if start is None and words.strip():
                start = at
            said.append(words)
            continue
        opens = kind == "open" and not source.startswith("/>", end - 2)
        if tag == "title":
            if title is not None and kind == "close":
                yield -1, " ".join("".join(title).split()), 0, 0
            title = [] if opens else None
        elif tag in _BLOCKS or (tag in ("script", "style") and kind != "close"):
            yield from ended(at)
            start, level = None, 0
            if opens:
                start, level = end, int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0
    if title is not None:
        yield -1, " ".join("".join(title).split()), 0, 0
    yield from ended(len(source))


def read_page(source: str | None, bare: bool = True) -> tuple[str | None, list[dict]]:
    """The last title that has words, and the blocks in the form of BLOCK."""
    title, blocks, section, headed, at = None, [], 0, None, 0
    for level, text, start, end in runs(source or "", bare):
        if level < 0:
            title = text or title
            continue
        if level:
            if blocks:
                blocks[-1]["is_last"], section, at = True, section + 1, at + 1
            headed = text
        blocks.append({
            "seq": len(blocks), "level": level, "text": text, "start": start, "end": end, "section": section, "section_title": UNTITLED if headed is None else headed,
            "is_titled": headed is not None, "is_last": False, "at": at,
        })
        at += len(text) + 1
    if blocks:
        blocks[-1]["is_last"] = True
    return title, blocks


def parsed(pages: DataFrame, source: str = "html", bare: bool = True) -> DataFrame:
    """pages without the column of markup, with title, size_bytes and blocks (array of BLOCK); one row for each row.
    Null and empty pages have no blocks; a column that bears a name of the result is replaced."""
    made = ("title", "size_bytes", "blocks")
    carry = [c for c in pages.columns if c != source and c.lower() not in made]

    def read(batches):
        for b in batches:  # of few pages
            got = [read_page(s, bare) for s in b.column(0).to_pylist()]
            title, blocks = pa.array([t for t, _ in got], pa.string()), pa.array([x for _, x in got], pa.list_(_BLOCK))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], title, b.column(1), blocks], names=[*carry, "title", "size_bytes", "blocks"])

    schema = T.StructType([*(pages.schema[c] for c in carry), *T._parse_datatype_string(f"title string, size_bytes bigint, blocks array<{BLOCK}>").fields])
    size = F.coalesce(F.octet_length(source), F.lit(0)).cast("long")
    return small_batches(pages).select(F.col(source).alias("_markup"), size.alias("_size"), *carry).mapInArrow(read, schema)


def blocks(pages: DataFrame, uri: str = "uri", source: str = "html", bare: bool = True) -> DataFrame:
    """Rows (uri, seq, level, text, start, end) of pages; start and end are offsets into the source."""
    b = parsed(pages.select(F.col(uri).alias("uri"), source), source, bare).select("uri", F.explode("blocks").alias("b"))
    return b.select("uri", "b.seq", "b.level", "b.text", "b.start", "b.end")


def _chunk(b: Column) -> Column:
    """A block ends with a line break, the last of a section with two."""
    return F.concat(b["text"], F.when(b["is_last"], "\n\n").otherwise("\n"))


def _until(b: Column) -> Column:
    return b["at"] + F.length(b["text"]) + F.when(b["is_last"], 2).otherwise(1)


def whole_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, _chunk), "")


def total(blocks: Column) -> Column:
    """The length of the flattened text, from the last block alone."""
    return F.coalesce(_until(F.try_element_at(blocks, F.lit(-1))), F.lit(0).cast("long"))


def segments(read: DataFrame) -> DataFrame:
    """Parsed pages flattened: (uri, seq, level, section, section_title, is_titled, is_last, start, end, chunk, text,
    locator); the locator is the block's place in the source."""
    b = F.col("b")
    return read.select("uri", F.explode("blocks").alias("b")).select(
        "uri", "b.seq", "b.level", "b.section", "b.section_title", "b.is_titled", "b.is_last", "b.text", b["at"].alias("start"), _until(b).alias("end"), _chunk(b).alias("chunk"), char_span(b["start"], b["end"]).alias("locator"),
    )


def _firsts(blocks: Column) -> Column:
    """The first block of each section."""
    return F.filter(blocks, lambda b, i: (i == 0) | (F.element_at(blocks, F.greatest(i, F.lit(1)))["section"] != b["section"]))


def outline(read: DataFrame) -> DataFrame:
    """(uri, section, section_title, is_titled, start, end): sections in the flattened text."""
    firsts, n = _firsts(F.col("blocks")), total(F.col("blocks"))
    s = read.select("uri", firsts.alias("s"), n.alias("n")).select("uri", "s", "n", F.posexplode("s").alias("i", "b"))
    end = F.coalesce(F.try_element_at("s", F.col("i") + 2)["at"], F.col("n"))
    return s.select("uri", "b.section", "b.section_title", "b.is_titled", F.col("b.at").alias("start"), end.alias("end"))


def _edges(blocks: Column) -> Column:
    return F.transform(F.filter(_firsts(blocks), lambda b: b["at"] > 0), lambda b: b["at"])


def barriers(read: DataFrame) -> DataFrame:
    """(uri, barrier): where every section but the first begins."""
    return read.select("uri", F.explode(_edges(F.col("blocks"))).alias("barrier"))


def represent(read: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(uri, text, n_segments, barriers, degradations) of parsed pages that hold a block; a budget cuts the text, drops
    what lies behind it and says so."""
    r, n = read.filter(F.size("blocks") > 0), total(F.col("blocks"))
    keep = n if max_chars is None else F.least(F.lit(max(1, max_chars)).cast("long"), n)
    text = whole_text(F.col("blocks"))
    note = F.struct(F.lit("text truncated").alias("what"), F.concat(F.lit("kept "), keep.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" characters")).alias("detail"))
    return r.select(
        "uri", (text if max_chars is None else F.substring(text, F.lit(1), keep.cast("int"))).alias("text"), F.size(F.filter("blocks", lambda b: b["at"] < keep)).cast("long").alias("n_segments"),
        F.filter(_edges(F.col("blocks")), lambda e: e < keep).alias("barriers"),
        F.when(keep < n, F.array(note)).otherwise(F.array().cast(f"array<{DEGRADATION}>")).alias("degradations"),
    )


def read_range(read: DataFrame, start: Column, end: Column) -> DataFrame:
    """Characters [start, end) of the flattened text, both ends moved into it: (uri, span_start, span_end, text, first,
    last), located from the first to the last block that is touched. Pages without a block give no row."""
    r, n = read.filter(F.size("blocks") > 0), total(F.col("blocks"))
    s = F.greatest(F.lit(0), F.least(start, n - 1)).cast("long")
    e = F.greatest(s + 1, F.least(end, n)).cast("long")
    touched = F.filter("blocks", lambda b: (b["at"] < e) & (s < _until(b)))
    return r.select(
        "uri", s.alias("span_start"), e.alias("span_end"), cut(whole_text(F.col("blocks")), s, e).alias("text"),
        F.array_min(F.transform(touched, lambda b: b["start"])).alias("first"), F.array_max(F.transform(touched, lambda b: b["end"])).alias("last"),
    )


def card(pages: DataFrame, uri: str = "uri", source: str = "html", bare: bool = True) -> DataFrame:
    """One row per page: title, heading_count, block_count, word_count, characters, size_bytes."""
    read, b = parsed(pages.select(F.col(uri).alias("uri"), source), source, bare), F.col("blocks")
    words = F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + word_count(x["text"]))
    last = F.try_element_at(b, F.lit(-1))
    return read.select(
        "uri", F.coalesce("title", F.lit(UNTITLED)).alias("title"), F.size(F.filter(b, lambda x: x["level"] > 0)).cast("long").alias("heading_count"),
        F.size(b).cast("long").alias("block_count"), words.alias("word_count"), F.coalesce(_until(last), F.lit(0)).cast("long").alias("characters"), "size_bytes",
    )


def read_section(read: DataFrame, index: Column) -> DataFrame:
    """(uri, section, text, start, end) of one section of each parsed page: its blocks by line breaks, cited from the
    first to the last; null where there is none."""
    of = F.filter("blocks", lambda b: b["section"] == index)
    r = read.withColumn("of", of)
    return r.select(
        "uri", index.cast("long").alias("section"), F.when(F.size("of") > 0, F.array_join(F.transform("of", lambda b: b["text"]), "\n")).alias("text"),
        F.try_element_at("of", F.lit(1))["start"].alias("start"), F.try_element_at("of", F.lit(-1))["end"].alias("end"),
    )


# blocks of other readers, one row each --------------------------------------------------------------------------------


def sections(b: DataFrame) -> DataFrame:
    """Rows of blocks with their section: a heading opens one and is its first block; what stands before any is
    untitled. For readers whose blocks come as rows; those of a source are one group."""
    by = Window.partitionBy("uri").orderBy("seq")
    g = b.withColumn("opened", F.sum((F.col("level") > 0).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.min("opened").over(Window.partitionBy("uri"))
    whole = Window.partitionBy("uri", "opened").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        g.withColumn("section", F.col("opened") - first)
        .withColumn("section_title", F.when(F.col("opened") > 0, F.first("text").over(whole)).otherwise(UNTITLED))
        .withColumn("is_titled", F.col("opened") > 0)
        .withColumn("is_last", F.last("seq").over(whole) == F.col("seq"))
        .drop("opened")
    )
