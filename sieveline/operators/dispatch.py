"""Handlers, their patterns, capabilities and operations, as small tables that sources are joined with."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.functions.text import match_rank, satisfied

CAPABILITIES = ("vision", "asr", "diarization", "text_llm", "ffmpeg", "exiftool", "libreoffice", "tesseract", "document_render")
OOXML, ODF = "application/vnd.openxmlformats-officedocument.", "application/vnd.oasis.opendocument."
ARCHIVES = ("application/zip", "application/x-tar", "application/gzip", "application/x-bzip2", "application/x-xz")
#: (handler, patterns, priority, version, requires), in the order of registration.
HANDLERS = (
    ("text", ("kind:text", "application/json", "application/xml"), 0, 1, ()),
    ("html", ("text/html", "application/xhtml+xml"), 0, 1, ()),
    ("epub", ("application/epub+zip",), 0, 1, ()),
    ("image", ("kind:image",), 0, 1, ()),
    ("pdf", ("application/pdf",), 0, 1, ()),
    ("word", (OOXML + "wordprocessingml.document", ODF + "text"), 0, 1, ()),
    ("slides", (OOXML + "presentationml.presentation", ODF + "presentation"), 0, 1, ()),
    ("sheets", (OOXML + "spreadsheetml.sheet", ODF + "spreadsheet"), 0, 1, ()),
    ("legacy", ("application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint"), 0, 1, ("document_render",)),
    ("audio", ("kind:audio",), 0, 1, ("ffmpeg",)),
    ("video", ("kind:video",), 0, 1, ("ffmpeg",)),
    ("archive", ARCHIVES, 0, 1, ()),
    ("binary", ("*",), 0, 1, ()),
)
#: (handler, operation, requires, level, defaults): what can be asked of a source.
AFFORDANCES = (
    ("text", "read_range", (), "segment", {"start": "0", "end": "1000"}),
    ("html", "read_section", (), "segment", {"index": "0"}), ("html", "read_range", (), "segment", {"start": "0", "end": "4096"}),
    ("epub", "read_chapter", (), "segment", {"index": "0"}), ("epub", "read_range", (), "segment", {"start": "0", "end": "4096"}),
    ("image", "crop_region", (), "segment", {"x": "0", "y": "0", "w": "1", "h": "1"}), ("image", "describe_image", ("vision",), "deep", {}),
    ("image", "ocr", ("vision",), "deep", {}), ("image", "ask_about_image", ("vision",), "deep", {}),
    ("pdf", "read_page", (), "segment", {"page": "1"}), ("pdf", "page_region", (), "segment", {}), ("pdf", "page_image", (), "segment", {"dpi": "150"}),
    ("pdf", "ocr_page", ("vision",), "deep", {}), ("pdf", "ask_about_image", ("vision",), "deep", {}),
    ("word", "read_section", (), "segment", {"index": "0"}), ("word", "read_range", (), "segment", {"start": "0", "end": "4096"}),
    ("word", "list_comments", (), "segment", {}), ("word", "read_table", (), "segment", {"index": "0"}), ("word", "page_image", ("document_render",), "deep", {}),
    ("slides", "read_slide", (), "segment", {"page": "1"}), ("slides", "list_media", (), "segment", {}), ("slides", "describe_slide_image", ("vision",), "deep", {}),
    ("slides", "page_image", ("document_render",), "deep", {}), ("slides", "describe_slide", ("vision", "document_render"), "deep", {}),
    ("sheets", "read_sheet", (), "segment", {"offset": "0", "limit": "100"}), ("sheets", "read_cells", (), "segment", {}), ("sheets", "list_sheets", (), "segment", {}),
    ("sheets", "page_image", ("document_render",), "deep", {}),
    ("legacy", "read_page", (), "segment", {"page": "1"}), ("legacy", "page_image", (), "deep", {}),
    ("audio", "read_span", ("asr",), "segment", {"start_s": "0", "end_s": "30"}),
    ("video", "frame_at", (), "segment", {}), ("video", "read_transcript", (), "segment", {"start_s": "0"}), ("video", "describe_frame", ("vision",), "deep", {}),
    ("video", "ask_about_image", ("vision",), "deep", {}), ("video", "watch_segment", ("vision",), "deep", {}),
    ("archive", "list_entries", (), "segment", {"offset": "0", "limit": "200"}),
    ("binary", "hexdump", (), "segment", {"start": "0", "length": "256"}),
)


def handlers(spark: SparkSession, extra: Iterable[tuple] = ()) -> DataFrame:
    """(handler_id, pattern, priority, version, requires, position): a caller's handlers may shadow by priority."""
    rows = [(h, p, pr, v, list(req), i) for i, (h, pats, pr, v, req) in enumerate([*HANDLERS, *extra]) for p in pats]
    return spark.createDataFrame(rows, "handler_id string, pattern string, priority int, version int, requires array<string>, position int")


def affordances(spark: SparkSession, extra: Iterable[tuple] = ()) -> DataFrame:
    rows = [(h, n, list(req), lv, d) for h, n, req, lv, d in [*AFFORDANCES, *extra]]
    return spark.createDataFrame(rows, "handler_id string, name string, requires array<string>, level string, defaults map<string,string>")


def available(table: DataFrame, capabilities: Iterable[str]) -> DataFrame:
    """Rows of handlers or affordances whose requirements are met; what is missing is not offered at all."""
    return table.filter(satisfied(F.col("requires"), F.array(*map(F.lit, capabilities)).cast("array<string>")))


def offered(sources: DataFrame, table: DataFrame) -> DataFrame:
    """sources (handler_id, capabilities array<string>, ...) with each operation (name) that their own capabilities allow.
    The registry is small and fixed, so it is broadcast."""
    t = F.broadcast(table.select(F.col("handler_id").alias("of"), "name", "requires"))
    return sources.join(t, (F.col("handler_id") == F.col("of")) & satisfied(F.col("requires"), F.col("capabilities"))).drop("of", "requires")


def dispatch(mimes: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per distinct mime of a column mime: handler_id and rank of the best pattern, then of the highest
    priority, then of the first registered. Types are few and the registry is fixed, so the pairs are few as well;
    sources join the answer by their type."""
    pairs = mimes.select("mime").distinct().join(F.broadcast(registry), match_rank(registry["pattern"], F.col("mime")).isNotNull())
    w = Window.partitionBy("mime").orderBy("rank", F.desc("priority"), "position")
    return pairs.withColumn("rank", match_rank(F.col("pattern"), F.col("mime"))).withColumn("n", F.row_number().over(w)).filter("n = 1").select("mime", "handler_id", "rank", "version")


def resolve_names(requests: DataFrame, table: DataFrame) -> DataFrame:
    """requests (handler_id, name, ...) with requires and defaults; an unknown name gets an error that lists the others."""
    names = table.groupBy("handler_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))
    out = requests.join(F.broadcast(table), ["handler_id", "name"], "left").join(F.broadcast(names), "handler_id", "left")
    return out.withColumn("error", F.when(F.col("requires").isNull(), F.concat(F.lit("unknown operation "), F.col("name"), F.lit("; known: "), F.coalesce("names", F.lit("(none)")))))


def discover(probes: Iterable[tuple[str, Callable[[], str | None]]]) -> dict[str, str]:
    """Capability -> revision, on the driver: of several probes for one the first that answers wins; one that fails
    answers nothing."""
    found: dict[str, str] = {}
    for name, probe in probes:
        if name in found:
            continue
        try:
            revision = probe()
        except OSError:
            revision = None
        if revision:
            found[name] = revision
    return found


def binary_probe(command: list[str]) -> Callable[[], str | None]:
    """The first line that a program says of its version, or nothing if it isn't there."""

    def probe() -> str | None:
        import shutil
        import subprocess

        if not shutil.which(command[0]):
            return None
        said = subprocess.run(command, capture_output=True, text=True, timeout=5, check=False)
        return next((x.strip() for x in (said.stdout or said.stderr).splitlines() if x.strip() and "warning" not in x.lower()), None)

    return probe
