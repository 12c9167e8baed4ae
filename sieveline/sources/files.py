"""Files as a DataFrame, and what their first bytes say they are."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import mime

HEAD = 4096
#: Rows and bytes of an Arrow batch, to Python and back: files may be long, so batches stay small.
ROWS, BYTES = 1000, 4 << 20
OOXML, ODF = "application/vnd.openxmlformats-officedocument.", "application/vnd.oasis.opendocument."
#: Signatures (offset, hex, type), the first that matches.
SIGNATURES = (
    (0, "25504446", "application/pdf"), (0, "89504E470D0A1A0A", "image/png"), (0, "FFD8FF", "image/jpeg"), (0, "47494638", "image/gif"), (0, "424D", "image/bmp"),
    (0, "49492A00", "image/tiff"), (0, "4D4D002A", "image/tiff"), (8, "57454250", "image/webp"), (8, "57415645", "audio/x-wav"), (8, "41564920", "video/x-msvideo"),
    (0, "D0CF11E0A1B11AE1", "application/msword"), (0, "504B0304", "application/zip"), (0, "504B0506", "application/zip"), (0, "1F8B", "application/gzip"),
    (0, "425A68", "application/x-bzip2"), (0, "FD377A585A00", "application/x-xz"), (257, "7573746172", "application/x-tar"), (0, "494433", "audio/mpeg"), (0, "FFFB", "audio/mpeg"),
    (0, "664C6143", "audio/flac"), (0, "4F676753", "audio/ogg"), (0, "1A45DFA3", "video/x-matroska"), (0, "7B5C727466", "application/rtf"),
)
#: Signatures of letters, which a text may have at their place by chance. What they stand for has bytes beside them that are
#: in no text; a PDF with its version and RTF may be text throughout, so those count.
_WORDS = [(at, s) for at, s, _ in SIGNATURES if all(32 <= b < 127 for b in bytes.fromhex(s))] + [(4, "66747970")]
LETTERS = "^(?!255044462D3[0-9]|7B5C727466)(?:" + "|".join(f".{{{2 * at}}}{s}" for at, s in _WORDS) + ")"
#: Types by the end of a name, for bytes that say nothing.
SUFFIXES = {
    "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "json": "application/json", "xml": "application/xml", "csv": "text/csv", "md": "text/markdown",
    "txt": "text/plain", "py": "text/x-python", "css": "text/css", "js": "text/javascript", "srt": "application/x-subrip", "svg": "image/svg+xml", "m4a": "audio/mp4", "mp3": "audio/mpeg",
    "mp4": "video/mp4", "tar": "application/x-tar", "zip": "application/zip", "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
}
#: Zips that are documents, not folders.
NOT_A_FOLDER = ("docx", "docm", "pptx", "pptm", "xlsx", "xlsm", "odt", "odp", "ods", "epub", "jar", "war", "apk", "whl")


def record_batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    """Rows as an Arrow batch of a flat schema such as `uri string, n long`; absent values are null."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields = [pa.field(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def small_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches are bounded from here on. Results are computed when they are read, so the two
    settings stay in the caller's session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES))
    return df


def gathered(rows: Iterable[dict], schema: str | pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, as they come, in batches of at most ROWS rows and about BYTES bytes of texts and contents."""
    made = record_batch if isinstance(schema, str) else pa.RecordBatch.from_pylist
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(v) for v in r.values() if isinstance(v, (str, bytes)))
        if len(held) >= ROWS or size > BYTES:
            yield made(held, schema)
            held, size = [], 0
    if held:
        yield made(held, schema)


def walk(spark: SparkSession, root: str, pattern: str = "*", content: bool = True, empty: bool = False) -> DataFrame:
    """Files below root: uri (relative), path, length, modificationTime and, if asked, content. Content that no plan
    selects is not read. Spark's scans leave files of no bytes out; if empty, they are told from the scan's list of names
    (which the driver holds) and come without a time. Sort by uri where order matters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    if empty:
        names = spark.createDataFrame([(p,) for p in files.inputFiles()], "name string")
        bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
        gone = names.join(files.select("path"), bare(F.col("name")) == bare(F.col("path")), "left_anti")
        files = files.unionByName(gone.select(F.col("name").alias("path"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")), allowMissingColumns=True)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    uri = F.regexp_replace("path", r"^.*?" + "".join(f"\\{c}" if not c.isalnum() else c for c in base) + "/", "")
    cols = ["path", "length", "modificationTime"] + (["content"] if content else [])
    return files.select(uri.alias("uri"), *cols)


def checked_root(root: str, path: str) -> str:
    """A path below root, or an error; nothing climbs out."""
    import posixpath

    full = posixpath.normpath(posixpath.join(root, path))
    if full != root.rstrip("/") and not full.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path!r} leaves {root!r}")
    return full


def read_byte_range(files: DataFrame, start: int, end: int) -> DataFrame:
    """(uri, data): bytes [start, end) of content; nothing past its end."""
    return files.select("uri", F.substring("content", start + 1, max(0, end - start)).alias("data"))


def size(files: DataFrame) -> DataFrame:
    """(uri, size_bytes) of files (uri, content)."""
    return files.select("uri", F.length("content").cast("long").alias("size_bytes"))


def exists(files: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (uri, ...) with whether there is such a file."""
    there = files.select("uri").distinct().withColumn("exists", F.lit(True))
    return asked.join(there, "uri", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def suffix_type(uri: Column) -> Column:
    ext = F.lower(F.regexp_extract(uri, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv)), F.nullif(ext, F.lit("")))


def zip_document(head: Column) -> Column:
    """The type of a zip that is an office document or a book, from its first entries; null for other zips."""
    # a name stands 30 bytes behind its entry's mark; bytes that are like a name are met in packed data too
    entries, h = F.decode(head, "ISO-8859-1"), F.hex(head)
    has = lambda s: entries.rlike(rf"(?s)PK\x03\x04.{{26}}{s}")
    stored = F.decode(F.substring(head, 39, 80), "ISO-8859-1")
    declared = F.regexp_extract(stored, r"^(application/(?:epub\+zip|vnd\.oasis\.opendocument\.(?:text|presentation|spreadsheet)))", 1)
    return F.when(h.startswith("504B0304"), F.when((F.substring(head, 31, 8) == F.lit(b"mimetype")) & (declared != ""), declared)
                  .when(has("word/"), OOXML + "wordprocessingml.document").when(has("ppt/"), OOXML + "presentationml.presentation").when(has("xl/"), OOXML + "spreadsheetml.sheet"))


def detect(head: Column, uri: Column) -> Column:
    """The media type of a file by its first HEAD bytes, then by its name, then by whether they are text.

    Order: nothing at all; the name, of a text that has a signature's letters at its place; an ISO media box (audio only if
    the name says so); office documents and books in zips; a signature; the name; UTF-8 without control characters; else
    bytes."""
    h = F.hex(head)
    named = suffix_type(uri)
    # up to three bytes of a character may be cut off at the end of the head
    text = F.is_valid_utf8(head.cast("string"))
    for short in (1, 2, 3):
        text = text | ((F.length(head) == HEAD) & F.is_valid_utf8(F.substring(head, F.lit(1), F.length(head) - short).cast("string")))
    control = h.rlike("^(?:..)*(?:0[0-8EF]|1[0-9A-F])")
    by_chance = named.isNotNull() & F.hex(F.substring(head, 1, 262)).rlike(LETTERS) & text & ~control
    out = F.when(F.length(head) == 0, "application/octet-stream").when(by_chance, named).when(F.substring(head, 5, 4) == F.lit(b"ftyp"), F.when(named.startswith("audio/"), named).otherwise("video/mp4"))
    out = out.when(zip_document(head).isNotNull(), zip_document(head))
    for at, signature, kind in SIGNATURES:
        out = out.when(F.substring(h, at * 2 + 1, len(signature)) == signature, kind)
    return out.when(named.isNotNull(), named).when(text & ~control, "text/plain").otherwise("application/octet-stream")


def sources(files: DataFrame, content: str = "content", detector: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The sources table: uri, mime, type, subtype, suffix, content_hash, size_bytes, content. A type that files
    have is taken as it is; else detector is asked first, and where it gives null, detect decides."""
    head, uri = F.substring(F.col(content), 1, HEAD), F.col("uri")
    d = files if "mime" in files.columns else files.withColumn("mime", F.coalesce(detector(head, uri), detect(head, uri)) if detector else detect(head, uri))
    m = mime(F.col("mime"))
    return d.select("uri", "mime", m["type"].alias("type"), m["subtype"].alias("subtype"), m["suffix"].alias("suffix"), F.sha2(content, 256).alias("content_hash"), F.length(content).cast("long").alias("size_bytes"), F.col(content).alias("content"))


def image_facts(files: DataFrame, content: str = "content") -> DataFrame:
    """(uri, format, width, height, decodable): size of PNG, GIF and BMP images from their headers; others are not
    decoded here."""
    h = F.hex(F.substring(F.col(content), 1, 32))
    num = lambda s: F.conv(s, 16, 10).cast("int")
    little = lambda at, n: F.concat(*(F.substring(h, (at + k) * 2 + 1, 2) for k in reversed(range(n))))
    kind = F.when(h.startswith("89504E47"), "PNG").when(h.startswith("47494638"), "GIF").when(h.startswith("424D"), "BMP")
    width = F.when(kind == "PNG", num(F.substring(h, 33, 8))).when(kind == "GIF", num(little(6, 2))).when(kind == "BMP", num(little(18, 4)))
    height = F.when(kind == "PNG", num(F.substring(h, 41, 8))).when(kind == "GIF", num(little(8, 2))).when(kind == "BMP", num(little(22, 4)))
    return files.select("uri", kind.alias("format"), width.alias("width"), height.alias("height"), kind.isNotNull().alias("decodable"))
