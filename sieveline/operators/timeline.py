"""Timelines: cues and sampled moments tiled into spans without gaps, merged, windowed, cut at scenes; captions parsed.

Cues are rows (uri, seq, start_s, end_s, text, speaker, source); sources of a stream are the unit of a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.locators import time_span
from sieveline.functions.text import collapse, cue_line, timestamp
from sieveline.operators.flatten import flatten, overlapping

#: The least width of an entry on a transcript; seconds between sampled frames; apart past the end.
MIN_CUE_S, SAMPLE_EVERY_S, PAST_END_S = 0.001, 5.0, 1e-9


def tile(entries: DataFrame, duration: str = "duration_s", min_width_s: float = MIN_CUE_S, start: str = "start_s") -> DataFrame:
    """entries (uri, seq, start_s, duration_s) with tile_start, tile_end: each owns the time up to the next.

    The first starts at 0; starts grow by at least min_width_s while there is room before the duration and by a trifle
    after; the last ends at the duration or min_width_s behind its start, never later than duration + min_width_s. The
    recurrence start_i = max(start_i, start_{i-1} + w) has the closed form i w + max_{j <= i}(s_j - j w), a running
    maximum, so this is one window and no loop."""
    w = min_width_s
    by = Window.partitionBy("uri").orderBy("seq")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = entries.withColumn("i", F.row_number().over(by) - 1)
    d = F.col(duration)
    lead_in = F.when(F.col("i") == 0, F.lit(0.0)).otherwise(F.col(start))
    e = e.withColumn("raw", F.col("i") * F.lit(w) + F.max(lead_in - F.col("i") * F.lit(w)).over(upto))
    over = F.when(d <= 0, F.col("i") >= 0).otherwise((F.col("i") >= 1) & (F.col("raw") >= d))
    e = e.withColumn("k", F.min(F.when(over, F.col("i"))).over(Window.partitionBy("uri")))
    past = F.when(d <= 0, F.lit(0.0)).otherwise(d) + (F.col("i") - F.col("k")) * F.lit(PAST_END_S)
    e = e.withColumn("tile_start", F.when(F.col("k").isNull() | (F.col("i") < F.col("k")), F.col("raw")).otherwise(past))
    last = F.least(F.greatest(d, F.col("tile_start") + w), d + w)
    return e.withColumn("tile_end", F.coalesce(F.lead("tile_start").over(by), last)).drop("raw", "k", "i")


def clamp(cues: DataFrame, duration: str = "duration_s") -> DataFrame:
    """Cues that start before the duration, their ends moved in."""
    return cues.filter(F.col("start_s") < F.col(duration)).withColumn("end_s", F.least("end_s", duration))


def dropped(cues: DataFrame, duration: str = "duration_s") -> DataFrame:
    """(uri, what, detail) for sources with cues outside the file."""
    n = cues.groupBy("uri", duration).agg(F.count_if(F.col("start_s") >= F.col(duration)).alias("n")).filter("n > 0")
    return n.select("uri", F.lit("cues outside the file").alias("what"), F.format_string("%d cue(s) started at or after the duration of %ss and were dropped", "n", F.col(duration).cast("string")).alias("detail"))


def sampling_grid(sources: DataFrame, every_s: float = SAMPLE_EVERY_S, duration: str = "duration_s") -> DataFrame:
    """(uri, seq, start_s): 0, every_s, ... before the duration, at least the first."""
    n = F.greatest(F.lit(1), F.ceil(F.col(duration) / every_s)).cast("int")
    return sources.select("uri", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(every_s))).alias("seq", "start_s"))


def merge(frames: DataFrame, cues: DataFrame) -> DataFrame:
    """Frames (uri, seq, start_s, text) and cues in one order of time; at a tie the frame first."""
    f = frames.select("uri", "start_s", F.lit(0).alias("is_cue"), F.col("seq").alias("own"), F.col("text").alias("line"))
    c = cues.select("uri", "start_s", F.lit(1).alias("is_cue"), F.col("seq").alias("own"), cue_line(F.col("text"), F.col("speaker"), F.col("source")).alias("line"))
    order = Window.partitionBy("uri").orderBy("start_s", "is_cue", "own")
    return f.unionByName(c).withColumn("seq", F.row_number().over(order) - 1).drop("own")


def transcript(tiled: DataFrame) -> DataFrame:
    """Segments of tiled cues: `[h:mm:ss.s] speaker text`, one line a cue, located in time."""
    who = F.when(F.col("speaker").isNotNull(), F.concat("speaker", F.lit(" "))).otherwise("")
    line = F.concat(F.lit("["), timestamp(F.col("tile_start")), F.lit("] "), who, collapse(F.coalesce("text", F.lit(""))), F.lit("\n"))
    return flatten(tiled.select("uri", "seq", line.alias("chunk"), time_span(F.col("tile_start"), F.col("tile_end")).alias("locator")))


def timeline(tiled: DataFrame) -> DataFrame:
    """Segments of merged and tiled entries (line)."""
    line = F.concat(F.lit("["), timestamp(F.col("tile_start")), F.lit("] "), F.col("line"), F.lit("\n"))
    return flatten(tiled.select("uri", "seq", "is_cue", line.alias("chunk"), time_span(F.col("tile_start"), F.col("tile_end")).alias("locator")))


def read_span(cues: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (uri, from_s, to_s) answered with the lines of the cues that overlap the window; the place is the window
    asked for. An empty or backward window, or one without words, gives a degraded row that says so."""
    ask = requests.select("uri", "from_s", "to_s")
    said = cues.select("uri", "seq", "start_s", "end_s", "text").filter(F.trim(collapse(F.col("text"))) != "")
    hit = overlapping(said, ask.distinct(), "uri", ("start_s", "end_s"), ("from_s", "to_s"), 8)
    line = F.concat(F.lit("["), timestamp(F.col("start_s")), F.lit("] "), F.trim("text"))
    got = hit.groupBy("uri", "from_s", "to_s").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda t: t["line"]), "\n").alias("text"),
        F.count(F.lit(1)).alias("n_cues"), F.min("start_s").alias("covered_from"), F.max("end_s").alias("covered_to"),
    )
    span = lambda a, b: F.concat(timestamp(F.col(a)), F.lit(b))
    empty = F.when(F.col("from_s") >= F.col("to_s"), F.concat(F.lit("the requested window "), span("from_s", "-"), span("to_s", " is empty"))).otherwise(
        F.concat(F.lit("nothing was transcribed between "), span("from_s", " and "), span("to_s", ""))
    )
    return ask.join(got, ["uri", "from_s", "to_s"], "left").select(
        "uri", "from_s", "to_s", F.coalesce("text", empty).alias("text"), F.col("text").isNull().alias("degraded"), F.coalesce("n_cues", F.lit(0)).cast("long").alias("n_cues"), "covered_from", "covered_to",
    )


def scene_buckets(samples: DataFrame, cuts: DataFrame) -> DataFrame:
    """(uri, cut_s, bucket): the last sample at or before each cut, the first if there is none.

    An as-of join without a range join: samples and cuts are put in one order of time and the last sample seen is
    carried forward."""
    s = samples.select("uri", F.col("start_s").alias("t"), F.lit(0).alias("is_cut"), F.col("seq").alias("bucket"))
    c = cuts.select("uri", F.col("cut_s").alias("t"), F.lit(1).alias("is_cut"), F.lit(None).cast("int").alias("bucket"))
    w = Window.partitionBy("uri").orderBy("t", "is_cut", "bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = s.unionByName(c).withColumn("bucket", F.coalesce(F.last("bucket", ignorenulls=True).over(w), F.lit(0)))
    return both.filter("is_cut = 1").select("uri", F.col("t").alias("cut_s"), "bucket")


def scene_barriers(samples: DataFrame, cuts: DataFrame) -> DataFrame:
    """(uri, seq): samples at which a scene begins; where no cut falls behind the first sample, every sample but it."""
    hit = scene_buckets(samples, cuts).filter("bucket > 0").select("uri", F.col("bucket").alias("seq")).distinct()
    every = samples.filter("seq > 0").select("uri", "seq").join(hit.select("uri").distinct(), "uri", "left_anti")
    return hit.unionByName(every)


def parse_srt(files: DataFrame, text: str = "text") -> DataFrame:
    """Cues of SRT files (uri, text): blocks between blank lines, the first timing line of each, tags stripped; blocks
    without a timing, backward ones and empty ones are dropped."""
    clean = F.regexp_replace(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), r"^\x{FEFF}", "")
    timing = r"(?s)(?:^|\n)\s*(\d+):(\d{1,2}):(\d{1,2})(?:[,.](\d{1,3}))?\s*-->\s*(\d+):(\d{1,2}):(\d{1,2})(?:[,.](\d{1,3}))?[^\n]*(?:\n(.*))?$"

    def seconds(first: int) -> Column:
        part = lambda k: F.regexp_extract("block", timing, k)
        milli = F.rpad(part(first + 3), 3, "0").cast("int")
        return part(first).cast("int") * 3600 + part(first + 1).cast("int") * 60 + part(first + 2).cast("int") + F.coalesce(milli, F.lit(0)) / 1000.0

    b = files.select("uri", F.posexplode(F.split(clean, r"\n[ \t]*\n")).alias("i", "block")).filter(F.col("block").rlike(timing))
    body = collapse(F.regexp_replace(F.regexp_extract("block", timing, 9), r"<[^>]*>", ""))
    c = b.select("uri", "i", seconds(1).alias("start_s"), seconds(5).alias("end_s"), body.alias("text")).filter("end_s > start_s and text != ''")
    seq = F.row_number().over(Window.partitionBy("uri").orderBy("i")) - 1
    return c.select("uri", seq.alias("seq"), "start_s", "end_s", "text", F.lit(None).cast("string").alias("speaker"), F.lit("captioned").alias("source"))


#: Words of English that point at something seen; another language's are a parameter.
POINTING = r"(?i)\b(here|this|that|these|look|see|shown?|as you can see|on the (left|right|screen))\b"


def suggest_frames(cues: DataFrame, gap_s: float = 10.0, pointing_words: str = POINTING) -> DataFrame:
    """(uri, at_s, why): moments worth looking at: cues that point at something, and long silences."""
    pointing = cues.filter(F.col("text").rlike(pointing_words))
    nxt = F.lead("start_s").over(Window.partitionBy("uri").orderBy("seq"))
    gaps = cues.withColumn("next_s", nxt).filter(F.col("next_s") - F.col("end_s") >= gap_s)
    return pointing.select("uri", F.col("start_s").alias("at_s"), F.lit("pointing").alias("why")).union(gaps.select("uri", (F.col("end_s") + (F.col("next_s") - F.col("end_s")) / 2).alias("at_s"), F.lit("silence").alias("why")))
