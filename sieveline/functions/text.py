"""Scalar functions on columns: media types, patterns, white space, hex dumps, times, A1 names, regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split() calls white space, as a character class of Java.
UNICODE_SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def collapse(s: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(s, UNICODE_SPACE + "+", " "))


def word_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(UNICODE_SPACE.replace("[", "[^", 1) + "+"))


def line_count(s: Column) -> Column:
    """Line breaks, and one for a last line without."""
    breaks = F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    return breaks + F.when((F.length(s) > 0) & ~s.endswith("\n"), 1).otherwise(0)


# media types -------------------------------------------------------------------------------------------------------


def mime(s: Column) -> Column:
    """struct(type, subtype, suffix) of a media type; null if it is none. Parameters go, case goes."""
    bare = F.lower(F.trim(F.split_part(s, F.lit(";"), F.lit(1))))
    ok = bare.rlike(r"^[^/\s]+/[^/\s]+$")
    sub = F.split_part(bare, F.lit("/"), F.lit(2))
    suffix = F.when(sub.contains("+"), F.element_at(F.split(sub, r"\+"), -1))
    return F.when(ok, F.struct(F.split_part(bare, F.lit("/"), F.lit(1)).alias("type"), sub.alias("subtype"), suffix.alias("suffix")))


def media_kind(top: Column) -> Column:
    return F.when(top.isin("video", "audio", "image", "text"), top).otherwise("binary")


def match_rank(pattern: Column, bare: Column) -> Column:
    """How a handler's pattern meets a media type: 0 exact, 1 +suffix, 2 type/*, 3 kind:x, 4 *; null if it doesn't."""
    m = mime(bare)
    return (
        F.when(pattern == "*", 4)
        .when(pattern.startswith("kind:"), F.when(F.substring(pattern, 6, 100) == media_kind(m["type"]), 3))
        .when(pattern.endswith("/*"), F.when(F.split_part(pattern, F.lit("/"), F.lit(1)) == m["type"], 2))
        .when(pattern.startswith("+"), F.when(F.substring(pattern, 2, 100) == m["suffix"], 1))
        .when(pattern == F.concat(m["type"], F.lit("/"), m["subtype"]), 0)
    )


def satisfied(requires: Column, available: Column) -> Column:
    """Whether every required capability is there."""
    return F.size(F.array_except(requires, available)) == 0


def fingerprint(capabilities: Column) -> Column:
    """A digest of a map capability -> revision that doesn't hang on its order."""
    pairs = F.array_sort(F.transform(F.map_entries(capabilities), lambda e: F.concat(e["key"], F.lit("\0"), e["value"], F.lit("\0"))))
    return F.sha2(F.array_join(pairs, ""), 256)


# reading -----------------------------------------------------------------------------------------------------------


def clamp(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """A range inside a text of length > 0: never empty, both ends moved in."""
    s = F.greatest(F.lit(0), F.least(start, length - 1))
    return s, F.greatest(s + 1, F.least(end, length))


def cut(s: Column, start: Column, end: Column) -> Column:
    return F.substring(s, (start + 1).cast("int"), (end - start).cast("int"))


def fit_text(s: Column, max_chars) -> Column:
    """The text that a budget keeps: at least one character; null keeps all."""
    n = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    return F.when(n.isNull() | (F.length(s) <= n), s).otherwise(F.substring(s, F.lit(1), F.greatest(F.lit(1), n)))


def truncated_note(full: Column, kept: Column) -> Column:
    """The degradation of a truncation, or null."""
    note = F.concat(F.lit("kept "), F.length(kept).cast("string"), F.lit(" of "), F.length(full).cast("string"), F.lit(" characters"))
    return F.when(F.length(kept) < F.length(full), F.struct(F.lit("text truncated").alias("what"), note.alias("detail")))


def hexdump(data: Column, offset: Column) -> Column:
    """Sixteen bytes a line: offset, hex, printable characters."""
    hexed = F.lower(F.hex(data))
    n = F.length(data)
    rows = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int")))

    def line(i: Column) -> Column:
        part = F.substring(hexed, i * 32 + 1, F.lit(32))
        spaced = F.trim(F.regexp_replace(part, "(..)", "$1 "))
        printable = F.regexp_replace(F.regexp_replace(part, "(..)", "$1 "), "(?:[01][0-9a-f]|7f|[89a-f][0-9a-f]) ", "2e ")
        chars = F.decode(F.unhex(F.replace(printable, F.lit(" "), F.lit(""))), "ISO-8859-1")
        at = F.lpad(F.lower(F.hex(offset.cast("long") + i * 16)), 8, "0")
        return F.concat(at, F.lit("  "), F.rpad(spaced, 47, " "), F.lit("  |"), chars, F.lit("|"))

    return F.coalesce(F.array_join(F.transform(rows, line), "\n"), F.lit(""))


def timestamp(seconds: Column) -> Column:
    """h:mm:ss.s, as a player shows it; 59.96 seconds print as 60.0. The binary value is rounded, and a tie goes to the
    even digit, as `%.1f` does elsewhere: 0.25 prints as 0.2, 0.35 (which is a little less) as 0.3."""
    hours = F.floor(seconds / 3600)
    rest = seconds - hours * 3600
    minutes = F.floor(rest / 60)
    x = rest - minutes * 60
    up = F.floor(x * 10 + 0.5)
    over = (x * 16 - (up * 2 - 1)) + x * 4  # the sign of 20 x - (2 up - 1), exact as both steps cancel
    tenths = F.when(over > 0, up).when(over < 0, up - 1).otherwise(up - up % 2)
    return F.format_string("%d:%02d:%02d.%d", hours, minutes, F.floor(tenths / 10), tenths % 10)


def cue_line(text: Column, speaker: Column, source: Column) -> Column:
    """A cue on a merged timeline, marked by the kind of evidence."""
    marker = F.when(source == "said", "(speech)").otherwise("(caption)")
    body = collapse(F.coalesce(text, F.lit("")))
    who = F.when(speaker.isNotNull(), F.concat(speaker, F.lit(" "))).otherwise("")
    return F.when(body == "", F.concat(marker, F.lit(" (no text was produced for this cue)"))).otherwise(F.concat(marker, F.lit(" "), who, body))


def listed(items: Column, limit: int = 10) -> Column:
    """The first items, and how many more there are."""
    head = F.array_join(F.slice(items, 1, limit), ", ")
    return F.when(F.size(items) <= limit, head).otherwise(F.concat(head, F.lit(" and "), (F.size(items) - limit).cast("string"), F.lit(" more")))


#: Measured cost of a clip.
LINEAR_CLIP_S, TOKENS_PER_CLIP_S, PLATEAU_CLIP_TOKENS = 40.0, 2100, 88_033


def clip_cost(span_s: Column) -> Column:
    """What a clip of this length costs, as far as that is known."""
    linear = F.concat(F.lit("about "), F.format_number(F.floor(span_s * TOKENS_PER_CLIP_S), 0), F.lit(" prompt tokens"))
    return F.when(span_s <= LINEAR_CLIP_S, linear).otherwise(F.lit(f"at least {PLATEAU_CLIP_TOKENS:,} prompt tokens; past {LINEAR_CLIP_S:g} s the cost no longer follows the length"))


def reply_text(reply: Column) -> Column:
    """The text of a model's reply in JSON: a string, or the text blocks of a list by line breaks; of any other shape null,
    which is not an empty text."""
    blocks = F.from_json(reply, "array<struct<type:string,text:string>>")
    said = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    whole = F.get_json_object(F.concat(F.lit('{"t":'), reply, F.lit("}")), "$.t")
    return F.when(F.trim(reply).startswith('"'), whole).when(F.trim(reply).startswith("[") & (F.size(said) > 0), F.array_join(said, "\n"))


# sheets ------------------------------------------------------------------------------------------------------------


def column_letters(col: Column) -> Column:
    """A 0-based column number in bijective base 26 (up to five letters)."""

    def letter(n: Column) -> Column:
        return F.chr(F.pmod(n, F.lit(26)) + 65)

    places, rest = [], col.cast("long")
    for _ in range(5):
        places.append(F.when(rest >= 0, letter(rest)).otherwise(""))
        rest = F.when(rest >= 0, F.floor(rest / 26) - 1).otherwise(F.lit(-1).cast("long"))
    return F.concat(*reversed(places))


def to_a1(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), (row + 1).cast("string"))


def from_a1(ref: Column) -> Column:
    """struct(row, col), 0-based, of a cell name; null if it is none."""
    clean = F.upper(F.trim(ref))
    letters, digits = F.regexp_extract(clean, r"^([A-Z]+)([1-9][0-9]*)$", 1), F.regexp_extract(clean, r"^([A-Z]+)([1-9][0-9]*)$", 2)
    col = F.aggregate(F.split(letters, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    return F.when(letters != "", F.struct((digits.cast("long") - 1).cast("int").alias("row"), (col - 1).cast("int").alias("col")))


def parse_a1(ref: Column) -> Column:
    """struct(row, col, rows, cols) of a cell or a block, corners in any order; null if it doesn't parse."""
    parts = F.split(ref, ":")
    a = from_a1(F.element_at(parts, 1))
    b = F.when(F.size(parts) == 1, a).when(F.size(parts) == 2, from_a1(F.try_element_at(parts, F.lit(2))))
    ok = a.isNotNull() & b.isNotNull()
    return F.when(ok, F.struct(
        F.least(a["row"], b["row"]).alias("row"), F.least(a["col"], b["col"]).alias("col"),
        (F.abs(a["row"] - b["row"]) + 1).alias("rows"), (F.abs(a["col"] - b["col"]) + 1).alias("cols"),
    ))


# regions -----------------------------------------------------------------------------------------------------------


def in_frame(x: Column, y: Column, w: Column, h: Column) -> Column:
    return (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1) & (y + h <= 1)


def whole_frame(x: Column, y: Column, w: Column, h: Column) -> Column:
    return (x == 0) & (y == 0) & (w == 1) & (h == 1)


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Pixels of a region of the unit square, at least one each way."""
    left, top = F.floor(x * width), F.floor(y * height)
    return F.struct(
        left.alias("left"), top.alias("top"),
        F.greatest(left + 1, F.floor((x + w) * width)).alias("right"), F.greatest(top + 1, F.floor((y + h) * height)).alias("bottom"),
    )


# nested uris -------------------------------------------------------------------------------------------------------


def split_uri(uri: Column) -> Column:
    """The segments of a nested uri (`a.zip!b.txt`; `\\!` and `\\\\` are literal); null if one is empty."""
    # possessive throughout: runs are taken in loops, so a segment of any length needs no stack
    body = F.regexp_extract_all(uri, F.lit(r"((?:[^!\\]++|\\[!\\]?+)++)"), F.lit(1))
    covered = F.length(uri) == F.aggregate(body, F.lit(0), lambda a, s: a + F.length(s)) + F.size(body) - 1
    plain = F.transform(body, lambda s: F.regexp_replace(s, r"\\([!\\])", "$1"))
    return F.when((F.length(uri) > 0) & covered, plain)


def join_uri(segments: Column) -> Column:
    """The reverse of split_uri."""
    return F.array_join(F.transform(segments, lambda s: F.regexp_replace(s, r"([!\\])", r"\\$1")), "!")


def container_of(uri: Column) -> Column:
    """The uri of the container that holds a member; null for a loose file."""
    parts = split_uri(uri)
    return F.when(F.size(parts) > 1, join_uri(F.slice(parts, F.lit(1), F.size(parts) - 1)))


def unsafe_member(path: Column) -> Column:
    """Whether a member path is absolute, has a drive letter or climbs, in either dialect of slashes."""
    return path.rlike(r"^[/\\]") | path.rlike(r"^[A-Za-z]:") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def resolve_href(base: Column, href: Column) -> Column:
    """A link of a package part: without fragment, percent-decoded, against the folder of the part."""
    bare = F.url_decode(F.replace(F.split_part(href, F.lit("#"), F.lit(1)), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(base, r"^(.*/)?", 1)
    joined = F.when(bare.startswith("/"), F.substring(bare, 2, 4096)).otherwise(F.concat(folder, bare))
    return reduce(lambda c, _: F.regexp_replace(c, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1"), range(4), F.regexp_replace(joined, r"(^|/)(\./)+", "$1"))
