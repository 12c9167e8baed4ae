"""What every format shares once it is parsed: flattening, budgets, resolving offsets, barriers.

Chunks (uri, seq, chunk, locator) become segments (uri, seq, start, end, chunk, locator) by a running sum; segments of a
source start at 0, have no gaps and end with its text. Running sums and numbers are taken in runs of RUN chunks, whose
totals are then summed, so a source that holds a third of all chunks is still the work of many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import cut

DEGRADATION = "struct<what:string,detail:string>"


#: Neighbouring values of an order that are summed in one window.
RUN = 4096


def running(df: DataFrame, key: str, order: str, amount: Column, name: str) -> DataFrame:
    """df with the sum of amount over the rows before each one, by key in the order of a whole number; rows that share a
    place are summed in any order. Within runs it is a window; before a run it is the sum of the totals of runs."""
    past = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(F.col(key).alias("_key"), F.floor(F.col(order) / RUN).alias("_of")).agg(F.sum(amount).alias("_total"))
    totals = totals.select("_key", "_of", F.coalesce(F.sum("_total").over(past), F.lit(0)).alias("_past"))
    within = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_run", F.floor(F.col(order) / RUN)).withColumn(name, F.coalesce(F.sum(amount).over(within), F.lit(0)))
    out = out.join(totals, (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_run").eqNullSafe(F.col("_of"))))
    return out.withColumn(name, (F.col(name) + F.col("_past")).cast("long")).drop("_run", "_key", "_of", "_past")


def flatten(chunks: DataFrame) -> DataFrame:
    """Segments of chunks that are not empty; a chunk holds its own separator."""
    return running(chunks, "uri", "seq", F.length("chunk"), "start").withColumn("end", F.col("start") + F.length("chunk"))


def fit(segments: DataFrame, max_chars: int | None) -> DataFrame:
    """Segments that a budget keeps, the last one cut; a budget of 0 keeps one character."""
    if max_chars is None:
        return segments
    keep = max(1, max_chars)
    kept = segments.filter(F.col("start") < keep)
    return kept.withColumn("chunk", F.substring("chunk", F.lit(1), (F.lit(keep) - F.col("start")).cast("int"))).withColumn("end", F.least("end", F.lit(keep)))


def represent(segments: DataFrame, barriers: DataFrame | None = None, degradations: DataFrame | None = None, max_chars: int | None = None) -> DataFrame:
    """One row per source: uri, text, n_segments, barriers, degradations.

    barriers: rows (uri, barrier); degradations: rows (uri, what, detail). Barriers are sorted, distinct and inside what
    the budget keeps; a truncation adds its own degradation after the others."""
    full = segments.groupBy("uri").agg(F.max("end").alias("full"))
    kept = fit(segments, max_chars).groupBy("uri").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda s: s["chunk"]), "").alias("text"),
        F.count(F.lit(1)).alias("n_segments"),
    )
    out = kept.join(full, "uri")
    if barriers is None:
        out = out.withColumn("barriers", F.array().cast("array<bigint>"))
    else:
        inside = barriers if max_chars is None else barriers.filter(F.col("barrier") < max(1, max_chars))
        out = out.join(inside.groupBy("uri").agg(F.array_sort(F.collect_set(F.col("barrier").cast("long"))).alias("barriers")), "uri", "left")
        out = out.withColumn("barriers", F.coalesce("barriers", F.array().cast("array<bigint>")))
    if degradations is None:
        out = out.withColumn("notes", F.array().cast(f"array<{DEGRADATION}>"))
    else:
        out = out.join(degradations.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("what", "detail"))).alias("notes")), "uri", "left")
        out = out.withColumn("notes", F.coalesce("notes", F.array().cast(f"array<{DEGRADATION}>")))
    cut_note = F.struct(
        F.lit("text truncated").alias("what"),
        F.concat(F.lit("kept "), F.length("text").cast("string"), F.lit(" of "), F.col("full").cast("string"), F.lit(" characters")).alias("detail"),
    )
    notes = F.when(F.length("text") < F.col("full"), F.array_append("notes", cut_note)).otherwise(F.col("notes"))
    return out.select("uri", "text", "n_segments", "barriers", notes.alias("degradations"))


def resolve(segments: DataFrame, offsets: DataFrame) -> DataFrame:
    """The segment that holds each offset: rows of offsets (uri, offset, ...) with seq, start, end and locator. Offsets
    outside the text find none. An offset is a span of one character, so it meets the segments of its cell only, and a
    source that holds most segments or offsets is the work of many tasks."""
    at = F.col("offset").cast("long")
    asked = offsets.withColumns({"offset": at, "_at": at, "_to": at + 1})
    met = overlapping(segments.select("uri", "seq", "start", "end", "locator"), asked, "uri", ("start", "end"), ("_at", "_to"), 1024)
    return met.select("uri", "offset", *(c for c in offsets.columns if c not in ("uri", "offset")), "seq", "start", "end", "locator")


def overlapping(spans: DataFrame, asked: DataFrame, key: str, span: tuple[str, str], ask: tuple[str, str], least: float) -> DataFrame:
    """Pairs of rows of one key whose half-open intervals overlap, with the columns of both (no other names in common).

    An interval that is asked for lies in at most two cells of a power of two no shorter than itself (or least); spans
    are dealt to cells of the widths that their key asks for, and the pair is counted in its first common cell. So a
    pair that does not overlap hardly meets."""
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(float(least)), F.col(ask[1]) - F.col(ask[0])))))
    a = asked.filter(F.col(ask[0]) < F.col(ask[1])).withColumn("_width", width)
    widths = a.groupBy(F.col(key).alias("_key")).agg(F.collect_set("_width").alias("_widths"))
    cell = lambda c: F.floor(F.col(c) / F.col("_width"))
    cells = lambda s, e: F.sequence(cell(s), F.greatest(cell(s), F.ceil(F.col(e) / F.col("_width")) - 1))
    s = spans.filter(F.col(span[0]) < F.col(span[1])).join(widths, F.col(key) == F.col("_key")).drop("_key").withColumn("_width", F.explode("_widths")).drop("_widths")
    s = s.withColumn("_first", cell(span[0])).withColumn("_cell", F.explode(cells(*span)))
    a = a.withColumn("_first_ask", cell(ask[0])).withColumn("_cell", F.explode(cells(*ask)))
    met = s.join(a, [key, "_width", "_cell"])
    touch = (F.col(span[0]) < F.col(ask[1])) & (F.col(ask[0]) < F.col(span[1])) & (F.col("_cell") == F.greatest("_first", "_first_ask"))
    return met.filter(touch).drop("_width", "_cell", "_first", "_first_ask")


def resolve_span(segments: DataFrame, spans: DataFrame, *carry: str) -> DataFrame:
    """All segments that each span (uri, span_start, span_end) touches, in document order (seq), with columns to carry."""
    s = segments.select("uri", "seq", "start", "end", "locator", *carry)
    return overlapping(s, spans, "uri", ("start", "end"), ("span_start", "span_end"), 1024)


def group_barriers(segments: DataFrame, group: str) -> DataFrame:
    """(uri, barrier): the first offset of every group but the first."""
    w = Window.partitionBy("uri").orderBy(group)
    starts = segments.groupBy("uri", group).agg(F.min("start").alias("barrier"))
    return starts.withColumn("n", F.row_number().over(w)).filter("n > 1").select("uri", F.col("barrier").cast("long").alias("barrier"))


def text_of(segments: DataFrame) -> DataFrame:
    return segments.groupBy("uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda s: s["chunk"]), "").alias("text"))


def gapless(segments: DataFrame) -> DataFrame:
    """Sources whose segments break the law of the map: (uri, problems), none for sound ones."""
    w = Window.partitionBy("uri").orderBy("seq")
    bad = (F.col("start") >= F.col("end")) | (F.col("start") != F.coalesce(F.lag("end").over(w), F.lit(0)))
    return segments.withColumn("bad", bad).groupBy("uri").agg(F.count_if("bad").alias("problems")).filter("problems > 0")


def read_range(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (uri, start, end, in characters of the text) answered with the text and the union of the places that it
    touches: (uri, req_start, req_end, text, first, last)."""
    length = F.col("length")
    sizes = segments.groupBy("uri").agg(F.sum(F.length("chunk")).alias("length")).filter(length > 0)
    r = requests.select("uri", F.col("start").alias("ask_start"), F.col("end").alias("ask_end")).join(sizes, "uri")
    s = F.greatest(F.lit(0), F.least("ask_start", length - 1))
    r = r.withColumn("span_start", s.cast("long")).withColumn("span_end", F.greatest(F.col("span_start") + 1, F.least("ask_end", length)).cast("long")).drop("length")
    keys = ["uri", "ask_start", "ask_end", "span_start", "span_end"]
    touched = resolve_span(segments.select("uri", "seq", "start", "end", "locator", "chunk"), r, "chunk")
    # of each segment that is touched the part that was asked for: no text but the answer's is moved
    part = cut(F.col("chunk"), F.greatest(F.lit(0), F.col("span_start") - F.col("start")), F.least("end", "span_end") - F.col("start"))
    parts = touched.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", part.alias("part")))).alias("parts"), F.min("locator.start").alias("first"), F.max("locator.end").alias("last"))
    return parts.select(*keys, F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"), "first", "last")
