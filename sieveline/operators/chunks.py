"""Chunks for an index: fixed size, never across a barrier, nothing lost; spans put into the chunks they touch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.operators.flatten import overlapping
from sieveline.sources.files import record_batch



CHUNK = "uri string, chunk int, start long, end long, text string"
#: Characters of chunks in one batch.
OUT_CHARACTERS = 4 << 20


def cuts(n: int, barriers: Iterable[int], size: int, overlap: int = 0) -> Iterator[tuple[int, int]]:
    """Where a text of n characters is cut: (start, end) of each chunk, in order."""
    step = max(1, size - overlap)
    edges = sorted({0, n, *(b for b in barriers if 0 < b < n)})
    for a, b in zip(edges, edges[1:], strict=False):
        for k in range(max(1, -(-(b - a - overlap) // step))):
            yield a + k * step, min(b, a + k * step + size)


def chunk(rendered: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """(uri, chunk, start, end, text) of rendered (uri, text, barriers): pieces of at most size characters between
    neighbouring barriers; each but the first between two barriers begins overlap characters before the end of the one
    before it. Together they cover the text; empty texts have none. A text is cut where it is, in one pass."""

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for uri, text, barriers in zip(b["uri"].to_pylist(), b["text"].to_pylist(), b["barriers"].to_pylist(), strict=True):
                for i, (s, e) in enumerate(cuts(len(text or ""), barriers or (), size, overlap)):
                    rows.append({"uri": uri, "chunk": i, "start": s, "end": e, "text": text[s:e]})
                    held += e - s
                    if held > OUT_CHARACTERS:
                        yield record_batch(rows, CHUNK)
                        rows, held = [], 0
        if rows:
            yield record_batch(rows, CHUNK)

    return rendered.select("uri", "text", "barriers").mapInArrow(run, CHUNK)


def payloads(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """(uri, chunk, payloads): the payloads of spans (uri, span_start, span_end, payload) that touch each chunk, in order,
    each once; chunks that none touches have an empty list."""
    hit = overlapping(chunks.select("uri", "chunk", "start", "end"), spans, "uri", ("start", "end"), ("span_start", "span_end"), 1024)
    first = hit.groupBy("uri", "chunk", "payload").agg(F.min(F.struct("span_start", "span_end")).alias("at"))
    lists = first.groupBy("uri", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "payload"))), lambda t: t["payload"]).alias("payloads"))
    return chunks.select("uri", "chunk").join(lists, ["uri", "chunk"], "left").withColumn("payloads", F.coalesce("payloads", F.array().cast("array<string>")))


def origins(chunks: DataFrame) -> DataFrame:
    """(text_hash, n, origins): chunks of equal text once, with the sources that hold it, in order."""
    return chunks.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("uri")).alias("origins"))
