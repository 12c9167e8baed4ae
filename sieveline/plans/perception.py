"""A tree of files as four questions: what is there, what is each (inspect), read a part (invoke), read all (represent).

What is inside archives is inflated once and written in a folder per type; loose files stay where they are. Types meet the
registry once, a row a type, so a source's handler is a lookup; each family reads its own types alone, and each question is
a union of the families' answers in one schema. A question plans no family that isn't there, and computes nothing until
it is read.

What needs a program or a model comes from the caller: cues (speech, or captions from elsewhere) and a prober's JSON as
frames, where a file's own container and embedded captions are not to be taken, and functions by (handler, operation), which run in Arrow batches. A caller's handler is a row of the registry and functions
of its own operations, of `represent` and of `describe`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.locators import SCHEMA as LOCATOR
from sieveline.functions.locators import describe
from sieveline.functions.text import word_count
from sieveline.operators import answers, cache, formats, html, timeline
from sieveline.operators.dispatch import affordances, available, dispatch, handlers, resolve_names
from sieveline.operators.flatten import DEGRADATION, group_barriers, represent
from sieveline.sources import containers, documents, images, legacy, media, pdf
from sieveline.sources.files import sources
from sieveline.sources.store import ArtifactStore
from sieveline.sources.workspace import kept

CUES = "uri string, seq long, start_s double, end_s double, text string, speaker string, source string"
PROBES = "uri string, json string"
#: Operations that Perception answers by itself; all others need a function.
ANSWERED = (
    ("text", "read_range"), ("binary", "hexdump"), ("html", "read_section"), ("html", "read_range"), ("epub", "read_chapter"), ("epub", "read_range"), ("pdf", "read_page"), ("pdf", "page_region"),
    ("word", "read_section"), ("word", "read_range"), ("word", "read_table"), ("word", "list_comments"), ("slides", "read_slide"), ("slides", "list_media"),
    ("sheets", "read_sheet"), ("sheets", "read_cells"), ("sheets", "list_sheets"), ("archive", "list_entries"), ("audio", "read_span"), ("video", "read_transcript"),
)


def _facts(**cols: Column) -> Column:
    """A map of facts as text; what is unknown is absent."""
    pairs = [F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in cols.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def _named(*cols: str) -> Column:
    return _facts(**{c: F.col(c) for c in cols})


class Perception:
    """Questions to a frame of files (uri, content). Archives are expanded; capabilities decide what is offered."""

    def __init__(
        self, files: DataFrame, capabilities: Iterable[str] = (), depth: int = containers.DEPTH, extra_handlers: Iterable[tuple] = (), extra_affordances: Iterable[tuple] = (),
        functions: Mapping[tuple[str, str], Callable[[dict], dict]] | None = None, cues: DataFrame | None = None, probes: DataFrame | None = None,
        detector: Callable[[Column, Column], Column] | None = None, openers: Mapping[str, Callable] | None = None, store: ArtifactStore | None = None, bare: bool = True,
    ):
        """functions: (handler, operation) to a function of a row (uri, content, params) that gives {"text": ...}, and for
        `describe` {"facts": {...}}. detector: a function of the columns head and uri that gives a type, null to leave it
        to the built-in one. openers: type of a container to a function of its bytes, as containers.members. store: where
        answers are kept; what is kept there is not computed again. bare: whether character references of pages count that
        lack their semicolon."""
        spark = files.sparkSession
        self.capabilities, self.functions = tuple(capabilities), dict(functions or {})
        self.openers, self.store, self.bare = dict(openers or {}), store, bare
        loose = files.select("uri", F.lit(None).cast("string").alias("error"), "content")
        levels = containers.expand(files, depth, openers=self.openers, detector=detector, keep=lambda df: kept(df, "level", "mime")).select("uri", "error", "content", "mime") if depth else loose
        told = sources(levels.filter("content is not null"), detector=detector)
        registry = available(handlers(spark, extra_handlers), self.capabilities)
        #: type to handler and version: a row for each type there is
        self.types = {r.mime: (r.handler_id, r.version) for r in dispatch(told.select("mime"), registry).collect()}
        look = lambda i, kind: F.element_at(F.create_map(*(x for m, t in self.types.items() for x in (F.lit(m), F.lit(t[i])))), F.col("mime")) if self.types else F.lit(None).cast(kind)
        self.sources = told.withColumns({"handler_id": look(0, "string"), "version": look(1, "int")})
        self.present = {h for h, _ in self.types.values()}
        films = self.of("audio", "video").select("uri", "content")
        self.cues = (cues if cues is not None else media.caption_cues(media.read_captions(films))).select(*(c.split()[0] for c in CUES.split(", ")))
        self.probes = documents.probe_facts(probes) if probes is not None else media.read_facts(films).select("uri", "duration_s", "container", "streams")
        self.failed = levels.filter("content is null").select("uri", "error")
        self.affordances = available(affordances(spark, extra_affordances), self.capabilities)

    def of(self, *ids: str) -> DataFrame:
        """The sources of some handlers, by their types: of what was inside archives the folders of others are not read."""
        return self.sources.filter(F.col("mime").isin(*(m for m, (h, _) in self.types.items() if h in ids)))

    def list(self) -> DataFrame:
        return self.sources.select("uri", "handler_id", "mime")

    def _texts(self, *only: DataFrame) -> DataFrame:
        return formats.decoded(self.of("text"))

    def _pages(self) -> DataFrame:
        return self.of("html").select("uri", F.coalesce(F.make_valid_utf8(F.col("content").cast("string")), F.lit("")).alias("html"))

    def _union(self, families: Iterable[Callable[[], DataFrame]], schema: str) -> DataFrame:
        """The answers of families, or none."""
        out = None
        for make in families:
            out = make() if out is None else out.unionByName(make())
        return self.sources.sparkSession.createDataFrame([], schema) if out is None else out

    def _called(self, rows: DataFrame, name: str, schema: str) -> DataFrame | None:
        """rows (uri, handler_id, ...) of handlers for whose operation name there is a function, through it."""
        own = {h: f for (h, n), f in self.functions.items() if n == name}
        if not own:
            return None
        plain = lambda d: {k: list(v.items()) if isinstance(v, dict) else v for k, v in d.items()}
        return documents.by_function(rows.filter(F.col("handler_id").isin(*own)), lambda r: {"uri": r["uri"]} | plain(own[r["handler_id"]](r)), schema)

    def inspect(self) -> DataFrame:
        """One card per source: uri, handler_id, mime, size_bytes, facts, excerpt, affordances."""
        base = self.sources.select("uri", "handler_id", "mime", "size_bytes")
        none = F.lit(None).cast("string").alias("excerpt")
        count = F.count(F.lit(1))
        text = lambda: formats.text_card(self._texts()).select("uri", _named("lines", "characters").alias("facts"), "excerpt")
        page = lambda: html.card(self._pages(), bare=self.bare).select("uri", _named("title", "heading_count", "block_count", "word_count", "characters").alias("facts"), none)

        def arch():
            e = containers.entries(self.of("archive"), openers=self.openers).filter("error is null")
            return formats.archive_card(e).select("uri", _named("entry_count", "uncompressed_bytes", "compressed_bytes", "expansion_ratio", "solid").alias("facts"), none)

        def sheet():
            cells = documents.read_cells(self.of("sheets")).filter("error is null")
            return formats.sheet_shapes(cells).groupBy("uri").agg(count.alias("sheet_count")).select("uri", _named("sheet_count").alias("facts"), none)

        def deck():
            d = documents.read_slides(self.of("slides")).filter("error is null").groupBy("uri").agg(count.alias("slide_count"), F.sum("n_media").alias("media_count"), F.max((F.coalesce("notes", F.lit("")) != "").cast("int")).alias("s"))
            return d.withColumn("notes_present", F.when(F.col("s") == 1, "yes").otherwise("no")).select("uri", _named("slide_count", "media_count", "notes_present").alias("facts"), none)

        def word():
            w = documents.read_word(self.of("word")).filter("error is null").groupBy("uri").agg(
                F.count_if(F.col("kind") == "heading").alias("heading_count"), F.count_if(F.col("kind") == "paragraph").alias("paragraph_count"),
                F.count_if(F.col("kind") == "table").alias("table_count"), F.sum(word_count(F.col("text"))).alias("word_count"),
            )
            return w.select("uri", _named("heading_count", "paragraph_count", "table_count", "word_count").alias("facts"), none)

        def book():
            words = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, x: a + word_count(x["text"]))
            g = html.parsed(documents.read_books(self.of("epub")).filter("error is null").select("uri", "book_title", "author", "html")).groupBy("uri").agg(
                F.coalesce(F.nullif(F.max("book_title"), F.lit("")), F.lit("(untitled book)")).alias("title"), F.coalesce(F.nullif(F.max("author"), F.lit("")), F.lit("(unknown)")).alias("author"),
                count.alias("chapter_count"), F.sum(words).alias("word_count"),
            )
            return g.select("uri", _named("title", "author", "chapter_count", "word_count").alias("facts"), none)

        leaf = lambda: formats.page_card(pdf.read_pages(self.of("pdf")).filter("error is null")).select("uri", _named("page_count", "text_pages", "characters").alias("facts"), none)
        image = lambda: images.read_sizes(self.of("image").select("uri", "content")).select("uri", _named("decodable", "format", "width", "height").alias("facts"), none)

        def film():
            streams = lambda kind: F.size(F.filter("streams", lambda s: s["kind"] == kind))
            cued = self.cues.groupBy("uri").agg(count.alias("cue_count"))
            said = F.nullif(F.array_join(documents.languages(F.col("streams")), ", "), F.lit(""))
            m = self.of("audio", "video").select("uri").join(self.probes, "uri", "left").join(cued, "uri", "left")
            m = m.withColumns({"video_streams": streams("video"), "audio_streams": streams("audio"), "languages": said})
            return m.select("uri", _named("duration_s", "container", "video_streams", "audio_streams", "languages", "cue_count").alias("facts"), none)

        def old():
            f = self.of("legacy")
            words = legacy.read_doc(f).filter("error is null").groupBy("uri").agg(count.alias("paragraph_count"), F.sum(word_count(F.col("text"))).alias("word_count"))
            grid = legacy.read_xls(f).filter("error is null").groupBy("uri").agg(F.count_distinct("sheet_no").alias("sheet_count"))
            deck = legacy.read_ppt(f).filter("error is null").groupBy("uri").agg(count.alias("slide_count"))
            told = legacy.read_kinds(f).select("uri", "kind").join(words, "uri", "left").join(grid, "uri", "left").join(deck, "uri", "left")
            return told.select("uri", _named("kind", "paragraph_count", "word_count", "sheet_count", "slide_count").alias("facts"), none)

        other = lambda: formats.binary_card(self.of("binary")).select("uri", _named("size_bytes").alias("facts"), "excerpt")
        families = {"text": text, "html": page, "archive": arch, "sheets": sheet, "slides": deck, "word": word, "epub": book, "pdf": leaf, "image": image, "audio": film, "video": film, "legacy": old, "binary": other}
        facts = self._union({f: None for h, f in families.items() if h in self.present}, "uri string, facts map<string,string>, excerpt string")
        own = self._called(self.sources.select("uri", "handler_id", "content"), "describe", "uri string, facts map<string,string>, error string")
        if own is not None:
            facts = facts.unionByName(own.select("uri", F.coalesce("facts", _facts(error=F.col("error"))).alias("facts"), none))
        offered = self.affordances.groupBy("handler_id").agg(F.array_sort(F.collect_list("name")).alias("affordances"))
        out = base.join(facts, "uri", "left").join(F.broadcast(offered), "handler_id", "left")
        empty = F.create_map().cast("map<string,string>")
        return out.select("uri", "handler_id", "mime", "size_bytes", F.coalesce("facts", empty).alias("facts"), "excerpt", F.coalesce("affordances", F.array().cast("array<string>")).alias("affordances"))

    def _spoken(self) -> DataFrame:
        """Segments of media by their cues, tiled over the probed duration (or the last cue's end)."""
        last = self.cues.groupBy("uri").agg(F.max("end_s").alias("last_s"))
        known = self.of("audio", "video").select("uri").join(last, "uri").join(self.probes.select("uri", "duration_s"), "uri", "left").select("uri", F.coalesce("duration_s", "last_s").alias("duration_s"))
        return timeline.transcript(timeline.tile(timeline.clamp(self.cues.join(known, "uri"))))

    def represent(self, max_chars: int | None = None) -> DataFrame:
        """One row per source that reads as text: uri, text, n_segments, barriers, degradations."""
        plain = lambda df: df.select("uri", "text", F.lit(1).cast("long").alias("n_segments"), F.array().cast("array<bigint>").alias("barriers"), "degradations")

        def sheet():
            cells = documents.read_cells(self.of("sheets")).filter("error is null")
            flat = formats.sheet_segments(cells)
            return represent(flat, group_barriers(flat, "seq"), formats.uncomputed(cells), max_chars)

        def deck():
            flat = formats.slide_segments(documents.read_slides(self.of("slides")).filter("error is null"))
            return represent(flat, group_barriers(flat, "seq"), None, max_chars)

        def word():
            blocks = documents.read_word(self.of("word")).filter("error is null and text != ''").select("uri", "seq", "level", "text", F.lit(0).alias("start"), F.lit(1).alias("end"))
            flat = formats.word_segments(html.sections(blocks))
            return represent(flat, group_barriers(flat, "seq"), None, max_chars)

        def book():
            flat = formats.book_segments(documents.book_blocks(documents.read_books(self.of("epub"))))
            return represent(flat, group_barriers(flat, "part_no"), None, max_chars)

        def leaf():
            leaves = pdf.read_pages(self.of("pdf")).filter("error is null")
            flat = formats.page_segments(leaves)
            return represent(flat, group_barriers(flat, "seq"), formats.page_notes(leaves), max_chars)

        def old():
            f = self.of("legacy")
            blocks = legacy.read_doc(f).filter("error is null and text != ''").select("uri", "seq", "level", "text", F.lit(0).alias("start"), F.lit(1).alias("end"))
            parts = [formats.word_segments(html.sections(blocks)), formats.sheet_segments(legacy.read_xls(f).filter("error is null")), formats.slide_segments(legacy.read_ppt(f).filter("error is null"))]
            made = [represent(p, group_barriers(p, "seq"), None, max_chars) for p in parts]
            return made[0].unionByName(made[1]).unionByName(made[2])

        arch = lambda: represent(formats.archive_segments(containers.entries(self.of("archive"), openers=self.openers).filter("error is null")), None, None, max_chars)
        said = lambda: represent(self._spoken(), None, None, max_chars)
        families = {
            "text": lambda: plain(formats.text_represent(self._texts(), max_chars)), "binary": lambda: plain(formats.binary_represent(self.of("binary"), max_chars)),
            "html": lambda: html.represent(html.parsed(self._pages(), bare=self.bare), max_chars), "sheets": sheet, "slides": deck, "word": word, "epub": book, "pdf": leaf, "archive": arch, "audio": said, "video": said, "legacy": old,
        }
        out = self._union({f: None for h, f in families.items() if h in self.present}, f"uri string, text string, n_segments bigint, barriers array<bigint>, degradations array<{DEGRADATION}>")
        own = self._called(self.sources.select("uri", "handler_id", "content"), "represent", "uri string, text string, error string")
        if own is not None:
            noted = F.when(F.col("error").isNotNull(), F.array(F.struct(F.lit("failed").alias("what"), F.col("error").alias("detail")))).otherwise(F.array().cast(f"array<{DEGRADATION}>"))
            kept_text = formats.fit_text(F.coalesce("text", F.lit("")), max_chars)
            out = out.unionByName(plain(own.select("uri", kept_text.alias("text"), noted.alias("degradations"))))
        return out

    def invoke(self, requests: DataFrame) -> DataFrame:
        """Requests (uri, name, params map<string,string>) answered, one row each: uri, name, text, locator, degraded,
        error. A source that isn't there, an unknown name, one that is not offered, or one that needs a function that
        was not given, gives an error that says so. With a store, answers that are kept there are taken from it, the
        others are computed once for each key and kept, and the work is done here and now; a kept answer that cannot be
        read counts as none, a failed one is not kept."""
        asked = requests.select("uri", "name", "params").join(self.sources.select("uri", "handler_id"), "uri", "left")
        asked = resolve_names(asked, self.affordances).withColumn("p", cache.with_defaults(F.col("params"), F.col("defaults")))
        answered = F.lit(False)
        for h, n in [*ANSWERED, *self.functions]:
            answered = answered | ((F.col("handler_id") == h) & (F.col("name") == n))
        wants = F.concat(F.lit("operation "), F.col("name"), F.lit(" needs a function that was not given"))
        error = F.when(F.col("handler_id").isNull(), "no such source").otherwise(F.coalesce("error", F.when(~answered, wants)))
        asked = kept(asked.select(F.monotonically_increasing_id().alias("rid"), "uri", "name", "handler_id", "p", error.alias("error")), "asked")
        good, found = asked.filter("error is null"), None
        if self.store is not None:
            keys = good.join(self.sources.select("uri", "version", "content_hash"), "uri")
            none = F.create_map().cast("map<string,string>")
            keys = kept(keys.select("rid", cache.artifact_key(F.col("content_hash"), F.col("handler_id"), F.col("version"), F.col("name"), F.col("p"), none).alias("artifact_key")), "keys")
            told = from_rendition_json(self.store.get(keys).withColumnRenamed("artifact_key", "uri")).filter("text is not null").withColumnRenamed("uri", "artifact_key")
            found = kept(keys.join(told, "artifact_key").select("rid", "text", "locator", "degraded"), "found")
            # of requests that come to one key one is worked on
            first = keys.join(found.select("rid"), "rid", "left_anti").groupBy("artifact_key").agg(F.min("rid").alias("rid"))
            first = kept(first, "todo")
            good = good.join(first.select("rid"), "rid", "left_semi")
            if first.isEmpty():
                return self._told(asked, found.withColumn("failed", F.lit(None).cast("string")))
        uris = good.select("uri").distinct()
        own = lambda h: self.of(h).join(uris, "uri", "left_semi")
        def book():
            parts = documents.read_books(own("epub")).filter("error is null").select("uri", "part_no", "part", "html")
            return answers.of_books(good, html.parsed(parts), formats.book_segments(documents.book_blocks(parts.withColumn("error", F.lit(None).cast("string")))))

        def page():
            markup = F.coalesce(F.make_valid_utf8(F.col("content").cast("string")), F.lit(""))
            return answers.of_pages(good, html.parsed(own("html").select("uri", markup.alias("html")), bare=self.bare))

        def leaf():
            whole = answers.of_leaves(good, pdf.read_pages(own("pdf")).filter("error is null"))
            if good.filter("handler_id = 'pdf' and name = 'page_region'").isEmpty():
                return whole
            runs = pdf.read_runs(own("pdf")).filter("error is null")
            return whole.unionByName(answers.of_regions(good, lambda asks: pdf.page_region(runs, asks)))

        said = lambda: answers.of_cues(good, self.cues.join(uris, "uri", "left_semi"))
        families = {
            "text": lambda: answers.of_texts(good, formats.decoded(own("text"))), "binary": lambda: answers.of_bytes(good, own("binary")), "html": page, "epub": book,
            "word": lambda: answers.of_word(good, documents.read_word(own("word")).filter("error is null"), documents.read_comments(own("word")).filter("error is null")),
            "slides": lambda: answers.of_slides(good, documents.read_slides(own("slides")).filter("error is null"), documents.read_media(own("slides")).filter("error is null")),
            "sheets": lambda: answers.of_sheets(good, documents.read_cells(own("sheets")).filter("error is null")),
            "archive": lambda: answers.of_archives(good, containers.entries(own("archive"), openers=self.openers).filter("error is null")),
            "pdf": leaf, "audio": said, "video": said,
        }
        out = self._union({f: None for h, f in families.items() if h in self.present}, f"rid bigint, text string, locator {LOCATOR}, degraded boolean")
        out = out.withColumn("failed", F.lit(None).cast("string"))
        if self.functions:
            pairs = self.functions
            mine = good.filter(F.concat_ws("/", "handler_id", "name").isin(*(f"{h}/{n}" for h, n in pairs)))
            rows = mine.join(self.sources.select("uri", "content"), "uri").select("rid", "uri", "handler_id", "name", "content", F.map_entries("p").alias("pairs"))
            ask = lambda r: {"rid": r["rid"], "text": pairs[r["handler_id"], r["name"]]({"uri": r["uri"], "content": r["content"], "params": {x["key"]: x["value"] for x in r["pairs"]}})["text"]}
            done = documents.by_function(rows, ask, "rid long, text string, error string")
            out = out.unionByName(done.select("rid", "text", F.lit(None).cast(LOCATOR).alias("locator"), F.lit(False).alias("degraded"), F.col("error").alias("failed")))
        if self.store is not None:
            made = kept(out.join(first, "rid").select("artifact_key", "text", "locator", "degraded", "failed"), "made")
            good_ones = made.filter("failed is null and text is not null").withColumnRenamed("artifact_key", "uri")
            self.store.put(rendition_json(good_ones).withColumnRenamed("uri", "artifact_key"))
            out = found.withColumn("failed", F.lit(None).cast("string")).unionByName(keys.join(made, "artifact_key").drop("artifact_key"))
        return self._told(asked, out)

    @staticmethod
    def _told(asked: DataFrame, out: DataFrame) -> DataFrame:
        joined = asked.join(out, "rid", "left")
        lost = F.when(F.col("text").isNull() & F.col("failed").isNull(), F.lit("no answer"))
        return joined.select("uri", "name", "text", "locator", F.coalesce("degraded", F.lit(False)).alias("degraded"), F.coalesce("error", "failed", lost).alias("error"))

    def keyed(self, requests: DataFrame) -> DataFrame:
        """Requests with artifact_key, to be joined with kept results."""
        r = resolve_names(requests.join(self.sources.select("uri", "handler_id", "version", "content_hash"), "uri"), self.affordances).filter("error is null")
        none = F.create_map().cast("map<string,string>")
        return r.withColumn("artifact_key", cache.artifact_key(F.col("content_hash"), F.col("handler_id"), F.col("version"), F.col("name"), cache.with_defaults(F.col("params"), F.col("defaults")), none)).drop("requires", "defaults", "names", "error")


def tools(perception: Perception) -> dict:
    """The four questions as functions of plain values that give DataFrames: inspect_path, list_paths,
    invoke_affordance, ask_about_image (an invoke like any other, offered where there is a vision model)."""
    spark: SparkSession = perception.sources.sparkSession

    def ask(uri: str, name: str, **params) -> DataFrame:
        row = spark.createDataFrame([(uri, name, {k: str(v) for k, v in params.items()})], "uri string, name string, params map<string,string>")
        return rendition_text(perception.invoke(row))

    return {
        "inspect_path": lambda uri: card_json(perception.inspect().filter(F.col("uri") == uri)),
        "list_paths": lambda: perception.list().orderBy("uri"),
        "invoke_affordance": ask,
        "ask_about_image": lambda uri, question, **region: ask(uri, "ask_about_image", question=question, **region),
    }


def card_json(cards: DataFrame) -> DataFrame:
    return cards.select("uri", F.to_json(F.struct(*cards.columns)).alias("json"))


def rendition_text(renditions: DataFrame) -> DataFrame:
    """(uri, ok, value, error): a rendition under a line that says where it was read, or what went wrong."""
    head = F.concat(F.lit("located at "), F.coalesce(describe(F.col("locator")), F.lit("nowhere")), F.when(F.col("degraded"), " (degraded)").otherwise(""), F.lit(":\n"))
    return renditions.select("uri", F.col("error").isNull().alias("ok"), F.when(F.col("error").isNull(), F.concat(head, F.col("text"))).alias("value"), "error")


def rendition_json(renditions: DataFrame) -> DataFrame:
    """Renditions (text, locator, degraded, ...) as JSON that from_rendition_json reads back without loss."""
    return renditions.select("uri", F.to_json(F.struct("text", "locator", "degraded")).alias("json"))


def from_rendition_json(kept_rows: DataFrame) -> DataFrame:
    r = F.from_json("json", f"text string, locator {LOCATOR}, degraded boolean")
    return kept_rows.select("uri", r["text"].alias("text"), r["locator"].alias("locator"), r["degraded"].alias("degraded"))


def cues_json(cues: DataFrame) -> DataFrame:
    """(uri, json): the cues of each source as one document, in order; from_cues_json reads them back."""
    return cues.groupBy("uri").agg(F.to_json(F.array_sort(F.collect_list(F.struct("seq", "start_s", "end_s", "text", "speaker", "source")))).alias("json"))


def from_cues_json(kept_rows: DataFrame) -> DataFrame:
    one = F.from_json("json", "array<struct<seq:bigint,start_s:double,end_s:double,text:string,speaker:string,source:string>>")
    return kept_rows.select("uri", F.explode(one).alias("c")).select("uri", "c.*")
