"""Queries of archives in place and of damage: archives are written from rows of the tables where driver and executors
both reach them, then listed and read by seeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.plans import fixtures, legacy_fixtures
from sieveline.plans.file_queries import _TALKS
from sieveline.plans.perception import Perception, tools
from sieveline.sources import archives, containers, files, legacy, pdf
from sieveline.sources.workspace import kept, new_folder
from sieveline.streaming import narrate


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(s) -> str:
    return new_folder(s, "archives")


def archive_members(s, d):
    """Texts of all documents, a hundred to a zip, and of conversations, fifty turns to a tar, listed and read in place."""
    folder = _folder(s)
    fixtures.written(_t(s, d, "documents").select("doc_id", "text"), folder, 100, ".zip", lambda rows: fixtures.zipped([(f"doc/{r['doc_id']}.txt", r["text"] or "") for r in rows]))
    fixtures.written(_t(s, d, "conversations").select("conv_id", "turn", "text"), folder, 50, ".tar", lambda rows: fixtures.tarred([(f"talk/{r['conv_id']}/{r['turn']}.txt", r["text"] or "") for r in rows], "w:"))
    m = archives.archive_members(s, folder, content=True, part_bytes=1 << 20)
    return m.select("path", "size_bytes", F.sha2("content", 256).alias("text_hash"), F.col("byte_offset").isNotNull().alias("has_place"), "error")


def archive_ranges(s, d):
    """Of every document's member the bytes from 5 to 40, and all from 100 on, by seeks."""
    folder = _folder(s)
    fixtures.written(_t(s, d, "documents").select("doc_id", "text"), folder, 100, ".zip", lambda rows: fixtures.zipped([(f"{r['doc_id']}", r["text"] or "") for r in rows]))
    m = archives.archive_members(s, folder)
    asks = m.select("archive", "path", F.explode(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).cast("int").alias("end")) for a, b in ((5, 40), (100, None))))).alias("a")).select("archive", "path", "a.*")
    return archives.read_ranges(m, asks).select(F.col("path").cast("long").alias("doc_id"), "start", F.sha2("data", 256).alias("data_hash"), "error")


def damaged_members(s, d):
    """A zip for each document, of which a third hold one damaged member, and a tenth are cut off in their middle."""

    def make(r):
        z = fixtures.zipped([("text.txt", r["text"] or ""), ("about.json", "{}")])
        return fixtures.spoiled(z, "text.txt") if r["doc_id"] % 3 == 0 else z[: len(z) // 2] if r["doc_id"] % 10 == 1 else z

    z = fixtures.made(_t(s, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".zip")).alias("uri"), "doc_id", "text"), make)
    e = containers.expand(z, depth=1).filter("depth = 1")
    return e.select("uri", "container", F.col("error").isNotNull().alias("damaged"), F.sha2("content", 256).alias("content_hash"))


def _talks(s, d, suffix: str, make) -> DataFrame:
    return fixtures.talks(_t(s, d, "conversations"), suffix, make)


def _laid_out(s, d) -> DataFrame:
    return fixtures.talks(_t(s, d, "conversations"), "pdf", fixtures.laid_out)


def pdf_layouts(s, d):
    """Pages with titles in forms, columns and encodings of their own, in reading order."""
    return pdf.read_pages(_laid_out(s, d)).select("uri", "page", "text", "has_image", "error")


def pdf_regions(s, d):
    """Of every page's left column what it says, and a page that is not there, as answers to requests."""
    files = kept(_laid_out(s, d), "layouts")
    pages = pdf.read_pages(files).select("uri", F.col("page").cast("string").alias("page"))
    box = lambda page, x: F.create_map(*(c if isinstance(c, Column) else F.lit(c) for c in ("page", page, "x", x, "y", "0.2", "w", "0.5", "h", "0.8")))
    asks = pages.select("uri", F.explode(F.array(box(F.col("page"), "0"), box(F.col("page"), "0.5"))).alias("params")).union(files.select("uri", box("9999", "0")))
    return Perception(files, depth=0).invoke(asks.select("uri", F.lit("page_region").alias("name"), "params")).select("uri", "text", "degraded", F.col("locator.x").alias("x"), F.col("locator.page").alias("page"), "error")


def narrated_operations(s, d):
    """Views as operations that clicks report on and purchases finish, timed out after two days of silence."""
    kinds = {"view": narrate.STARTED, "click": narrate.PROGRESSED, "purchase": narrate.FINISHED}
    said = narrate.narrated_batch(narrate.narration_events(_t(s, d, "events"), "user_id", "event_type", "ts", "event_id", kinds), 2 * 86_400)
    return said.select("key", "state", F.date_format(F.timestamp_micros("at_us"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "n_progress", "elapsed_us")


def walked_files(s, d):
    """All documents as files of a tree, found and read again."""
    folder = _folder(s)
    fixtures.written(_t(s, d, "documents").select("text"), folder, 1, ".txt", lambda rows: (rows[0]["text"] or "").encode())
    w = files.walk(s, folder)
    return w.select(F.col("uri").endswith(".txt").alias("named"), F.col("length").cast("long").alias("length"), F.sha2("content", 256).alias("content_hash"))


def tool_pack(s, d):
    """The list of paths as a tool gives it, over documents and pages."""
    docs = _t(s, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("uri"), F.encode("text", "UTF-8").alias("content"))
    pages = _t(s, d, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("uri"), F.encode("html", "UTF-8").alias("content"))
    return tools(Perception(docs.union(pages), depth=0))["list_paths"]()


def legacy_words(s, d):
    """Conversations as .doc files, one paragraph for each role and text."""
    f = _talks(s, d, "doc", lambda parts: legacy_fixtures.doc("".join(f"{a}\r{b}\r" for a, b in parts)))
    return legacy.read_doc(f).select("uri", "seq", "kind", "text", "error")


def legacy_slides(s, d):
    f = _talks(s, d, "ppt", legacy_fixtures.ppt)
    return legacy.read_ppt(f).select("uri", "page", "title", "body", "notes", "error")


def legacy_cells(s, d):
    """Customers as .xls files of a hundred: key, name, balance; rows of one key stand as they do in the table."""
    c = _t(s, d, "customer").select("*", F.expr("c_custkey div 100").alias("book"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    g = c.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "file", "place", "c_name", "c_acctbal"))).alias("rows"))
    rows = g.select(F.concat(F.lit("book/"), F.col("book").cast("string"), F.lit(".xls")).alias("uri"), "rows")
    f = fixtures.made(rows, lambda r: legacy_fixtures.xls([[x["c_custkey"], x["c_name"], float(x["c_acctbal"])] for x in r["rows"]]))
    return legacy.read_xls(f).select("uri", "sheet", "row", "col", F.when(F.col("col") == 2, F.round(F.col("value").cast("double"), 2).cast("string")).otherwise(F.col("value")).alias("value"), "error")


_PIECES = """h AS (SELECT *, md5(text) AS h FROM t), x AS (SELECT *, array_to_string([substr(h, 6 * k + 1, 3) FOR k IN range(5)], chr(10)) AS "left", array_to_string([substr(h, 6 * k + 4, 3) FOR k IN range(5)], chr(10)) AS "right" FROM h)"""

SQL: dict[str, str] = {
    "archive_members": """SELECT 'doc/' || doc_id || '.txt' AS path, strlen(coalesce(text, ''))::BIGINT AS size_bytes, sha256(coalesce(text, '')) AS text_hash, true AS has_place, NULL::VARCHAR AS error FROM documents
      UNION ALL SELECT 'talk/' || conv_id || '/' || turn || '.txt', strlen(coalesce(text, '')), sha256(coalesce(text, '')), true, NULL FROM conversations""",
    "archive_ranges": """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)
      SELECT doc_id, 5 AS "start", sha256(from_hex(substr(h, 11, 70))) AS data_hash, NULL::VARCHAR AS error FROM b UNION ALL SELECT doc_id, 100, sha256(from_hex(substr(h, 201))), NULL FROM b""",
    "pdf_layouts": f"""WITH {_TALKS}, {_PIECES} SELECT 'talk/' || conv_id || '.pdf' AS uri, (i + 1)::INT AS page, role || chr(10) || "left" || chr(10) || "right" AS text, true AS has_image, NULL::VARCHAR AS error FROM x""",
    "pdf_regions": f"""WITH {_TALKS}, {_PIECES} SELECT 'talk/' || conv_id || '.pdf' AS uri, "left" AS text, false AS degraded, 0.0::DOUBLE AS x, (i + 1)::INT AS page, NULL::VARCHAR AS error FROM x
      UNION ALL SELECT 'talk/' || conv_id || '.pdf', "right", false, 0.5, (i + 1)::INT, NULL FROM x UNION ALL SELECT 'talk/' || conv_id || '.pdf', 'page 9999 does not exist; there are ' || n || ' page(s)', true, NULL, NULL, NULL FROM g""",
    "legacy_words": f"""WITH {_TALKS} SELECT 'talk/' || conv_id || '.doc' AS uri, 2 * i AS seq, 'paragraph' AS kind, role AS text, NULL::VARCHAR AS error FROM t UNION ALL SELECT 'talk/' || conv_id || '.doc', 2 * i + 1, 'paragraph', text, NULL FROM t""",
    "legacy_slides": f"""WITH {_TALKS} SELECT 'talk/' || conv_id || '.ppt' AS uri, (i + 1)::INT AS page, role AS title, text AS body, CASE WHEN i = 0 THEN role ELSE '' END AS notes, NULL::VARCHAR AS error FROM t""",
    "legacy_cells": """WITH r AS (SELECT 'book/' || (c_custkey // 100) || '.xls' AS uri, (row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) - 1)::INT AS "row", * FROM customer)
      SELECT uri, 'Data' AS sheet, "row", 0 AS col, c_custkey::VARCHAR AS "value", NULL::VARCHAR AS error FROM r UNION ALL SELECT uri, 'Data', "row", 1, c_name, NULL FROM r UNION ALL SELECT uri, 'Data', "row", 2, round(c_acctbal::DOUBLE, 2)::VARCHAR, NULL FROM r""",
    "walked_files": "SELECT true AS named, strlen(text)::BIGINT AS length, sha256(text) AS content_hash FROM documents WHERE text <> ''",
    "tool_pack": "SELECT 'doc/' || doc_id || '.txt' AS uri, 'text' AS handler_id, 'text/plain' AS mime FROM documents UNION ALL SELECT 'page/' || page_id || '.html', 'html', 'text/html' FROM pages",
    "narrated_operations": """WITH e AS (SELECT user_id::VARCHAR AS key, CASE event_type WHEN 'view' THEN 'started' WHEN 'click' THEN 'progressed' ELSE 'finished' END AS kind, epoch_us(ts) AS at_us, event_id AS number FROM events WHERE event_type IN ('view', 'click', 'purchase')),
      g AS (SELECT *, lag(at_us) OVER w AS before, lead(at_us) OVER w AS after FROM e WINDOW w AS (PARTITION BY key ORDER BY at_us, number)),
      p AS (SELECT *, sum(CASE WHEN at_us - before > 172800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY at_us, number ROWS UNBOUNDED PRECEDING) AS part FROM g),
      q AS (SELECT *, last_value(CASE WHEN kind <> 'progressed' THEN kind END IGNORE NULLS) OVER v AS edge_kind, last_value(CASE WHEN kind <> 'progressed' THEN at_us END IGNORE NULLS) OVER v AS edge_at FROM p
        WINDOW v AS (PARTITION BY key, part ORDER BY at_us, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      o AS (SELECT *, CASE WHEN kind = 'started' THEN at_us ELSE edge_at END AS began FROM q WHERE kind = 'started' OR edge_kind = 'started'),
      n AS (SELECT *, sum((kind = 'progressed')::BIGINT) OVER (PARTITION BY key, part, began ORDER BY at_us, number ROWS UNBOUNDED PRECEDING)::BIGINT AS n FROM o),
      r AS (SELECT key, kind AS state, at_us, n AS n_progress, at_us - began AS elapsed_us FROM n
        UNION ALL SELECT key, 'timed out', at_us + 172800000000, n, at_us + 172800000000 - began FROM n WHERE kind <> 'finished' AND CASE WHEN after IS NOT NULL THEN after > at_us + 172800000000 ELSE at_us + 172800000000 < (SELECT max(at_us) FROM e) END)
      SELECT key, state, strftime(make_timestamp(at_us), '%Y-%m-%d %H:%M:%S.%f') AS "at", n_progress, elapsed_us FROM r""",
    "damaged_members": """WITH z AS (SELECT doc_id, 'doc/' || doc_id || '.zip' AS zip, doc_id % 3 = 0 AS spoiled, doc_id % 3 <> 0 AND doc_id % 10 = 1 AS cut, coalesce(text, '') AS text FROM documents)
      SELECT zip || '!text.txt' AS uri, zip AS container, spoiled AS damaged, CASE WHEN NOT spoiled THEN sha256(text) END AS content_hash FROM z WHERE NOT cut
      UNION ALL SELECT zip || '!about.json', zip, false, sha256('{}') FROM z WHERE NOT cut UNION ALL SELECT zip || '!', zip, true, NULL FROM z WHERE cut""",
}


def queries() -> dict:
    return {k: globals()[k] for k in SQL}
