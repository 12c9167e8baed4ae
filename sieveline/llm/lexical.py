"""Ranked lexical search: WAND over shards of documents.

One pass reads the texts and writes, for each document, its length and the places and counts of the items' terms in it:
as little as a search needs, in columns. Counts over all documents then weigh the terms. A task cuts its documents into
shards, inverts each in memory and runs all items of a block over it; the heap of an item goes on from shard to shard, so
that its threshold is high from the second on. Heaps of tasks are merged by rank.

The pivot rule is taken for a window of documents at once. An item's lists stand by falling maximum impact. The pivot list
is the first after which the maxima left sum to less than the heap's threshold: a document in none of the lists up to it
cannot enter the heap and is never looked at. Those in them are followed through the lists after it, and let go as soon as
their score so far and the maxima left stay below the threshold; what is left has its whole score and meets the heap.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import drop_files, materialize, small_batches, table

TOP = 50
#: Pairs of item and term that are searched at once: more items take more passes over the documents.
BLOCK_PAIRS = 200_000
#: Postings of a shard, about, and documents of a window.
SHARD_POSTINGS, WINDOW = 4_000_000, 16_384
#: Heaps of an item that one task merges.
MERGED = 64

#: Bytes of UTF-8 text as term bytes: letters in lower case, digits and all beyond ASCII stay, the rest is space.
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, A-Z lower-cased, with repeats."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def measures(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of so many terms, exact whatever the numbers."""
    if 50 * int(lengths.max(initial=0)) * n < 1 << 63:
        return 50 + 50 * lengths * n // max(total, 1)
    return np.array([50 + 50 * a * n // total for a in lengths.tolist()], np.int64)


class Shard:
    """Documents with their postings: for each term its documents, ascending, and what it adds to their scores."""

    def __init__(self, docs: np.ndarray, known: np.ndarray, m: np.ndarray, counts: np.ndarray, place: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        self.docs, self.known, n = docs, known, len(docs)
        doc = np.repeat(np.arange(n), counts)
        order = np.argsort(place, kind="stable")
        self.term, self.doc, tf = place[order], doc[order], tf[order].astype(np.int64)
        self.impact = weights[self.term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.doc]))
        first = np.flatnonzero(np.concatenate([[True], self.term[1:] != self.term[:-1]])) if len(self.term) else np.zeros(0, np.int64)
        self.lists = self.term[first]
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0, np.int64)
        self.starts = np.arange(0, n + WINDOW, WINDOW)[: -(-n // WINDOW) + 1]
        key = self.term.astype(np.int64) * (n + 1) + self.doc  # where each list enters each window
        self.cuts = np.searchsorted(key, self.lists[:, None].astype(np.int64) * (n + 1) + np.minimum(self.starts, n)[None, :]) if len(first) else np.zeros((0, len(self.starts)), np.int64)

    def search(self, item: np.ndarray, heap: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The heap of an item (sorted terms) after this shard: scores, doc_ids, whether these are known."""
        at = np.searchsorted(self.lists, item)
        at = at[self.lists[np.minimum(at, len(self.lists) - 1)] == item] if len(self.lists) else at[:0]
        at = at[np.argsort(-self.most[at], kind="stable")]
        if not len(at):
            return heap
        left = np.concatenate([np.cumsum(self.most[at][::-1])[::-1][1:], [0]])  # the maxima after each list
        for w in range(len(self.starts) - 1):
            threshold = int(heap[0][-1]) if len(heap[0]) >= k else 1
            if left[0] + self.most[at[0]] < threshold:
                break
            pivot = int(np.argmax(left < threshold))
            base, size = int(self.starts[w]), int(min(self.starts[w + 1], len(self.docs)) - self.starts[w])
            score = np.zeros(size, np.int64)
            for i in at[: pivot + 1]:
                some = slice(self.cuts[i, w], self.cuts[i, w + 1])
                score[self.doc[some] - base] += self.impact[some]
            live = np.flatnonzero(score + left[pivot] >= threshold)
            score = score[live]
            for j in range(pivot + 1, len(at)):
                if not len(live):
                    break
                lo, hi = self.cuts[at[j], w], self.cuts[at[j], w + 1]
                docs = self.doc[lo:hi] - base
                if len(docs):
                    p = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
                    score = score + np.where(docs[p] == live, self.impact[lo:hi][p], 0)
                keep = score + left[j] >= threshold
                live, score = live[keep], score[keep]
            keep = score >= threshold
            if keep.any():
                heap = best(np.concatenate([heap[0], score[keep]]), np.concatenate([heap[1], self.docs[base + live[keep]]]), np.concatenate([heap[2], self.known[base + live[keep]]]), k)
        return heap


def best(score: np.ndarray, doc: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores, equal ones by ascending doc_id, unknown ids last."""
    order = np.lexsort((doc, ~known, -score))[:k]
    return score[order], doc[order], known[order]


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """Distinct (item, term) pairs; rows of one item are one item with all their terms."""

    @F.pandas_udf("array<binary>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(set(terms(t))) for t in texts])

    return items.select(F.col(item_id).alias("item"), F.explode(of(F.col(text))).alias("term")).distinct()


def _forward(docs: DataFrame, doc_id: str, text: str, vocabulary) -> DataFrame:
    """doc_id, n and the sorted places (int32) of the vocabulary's terms in each document that has terms, with their counts."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place_of, size = {t: i for i, t in enumerate(vocabulary.value)}.get, len(vocabulary.value)
        for g in batches:
            lengths, keys = np.zeros(len(g), np.int64), []
            for row, t in enumerate(g["text"]):
                words = terms(t)
                lengths[row] = len(words)
                got = np.fromiter(map(place_of, words, repeat(-1)), np.int64, len(words))
                keys.append(got[got >= 0] + row * size)
            key, tf = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            cut = np.searchsorted(key, np.arange(1, len(g)) * size)
            place, tf = (key % size).astype(np.int32), tf.astype(np.int32)
            out = pd.DataFrame({"doc_id": g["doc_id"], "n": lengths, "place": [p.tobytes() for p in np.split(place, cut)], "tf": [p.tobytes() for p in np.split(tf, cut)]})
            yield out[out["n"] > 0]

    return docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(read, "doc_id string, n long, place binary, tf binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df = np.zeros(0, np.int64)
    for g in batches:
        got = np.bincount(np.frombuffer(b"".join(g["place"]), np.int32))
        if len(got) > len(df):
            got[: len(df)] += df
            df = got
        else:
            df[: len(got)] += got
    some = np.flatnonzero(df)
    yield pd.DataFrame({"place": some, "df": df[some]})


def _search_block(docs: DataFrame, pairs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """Heaps of all tasks for the items of one block of pairs: item, score, doc_id."""
    spark = docs.sparkSession
    asked = pairs.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item").collect()  # BLOCK_PAIRS terms, about
    vocabulary = sorted({bytes(t) for r in asked for t in r.terms})
    place = {t: i for i, t in enumerate(vocabulary)}
    items = [np.array(sorted(place[bytes(t)] for t in r.terms), np.int64) for r in asked]
    index = materialize(_forward(docs, doc_id, text, spark.sparkContext.broadcast(vocabulary)), "lexical-forward")
    n, total = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in index.select("place").mapInPandas(_frequencies, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect():  # a row a term of the block
        weights[r.place] = weight(n, r.df)
    held = spark.sparkContext.broadcast((items, weights))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, weights = held.value
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        heaps, parts, postings = [none] * len(items), [], 0

        def run():
            docs, lengths, places, tfs = (pd.concat([p[c] for p in parts], ignore_index=True) for c in ("doc_id", "n", "place", "tf"))
            known = docs.notna().to_numpy()
            shard = Shard(
                np.array([0 if d is None else int(d) for d in docs], np.int64), known, measures(lengths.to_numpy(np.int64), n, total), places.map(len).to_numpy(np.int64) // 4,
                np.frombuffer(b"".join(places), np.int32), np.frombuffer(b"".join(tfs), np.int32), weights,
            )
            for i, item in enumerate(items):
                heaps[i] = shard.search(item, heaps[i], k)

        for g in batches:
            parts.append(g)
            postings += int(g["place"].map(len).sum()) // 4
            if postings >= SHARD_POSTINGS:
                run()
                parts, postings = [], 0
        if parts:
            run()
        for i, (score, doc, known) in enumerate(heaps):
            if len(score):
                yield pd.DataFrame({"i": i, "score": score, "doc_id": [str(d) if o else None for d, o in zip(doc.tolist(), known.tolist(), strict=True)]})

    # ids travel as text where pandas would turn a null among them into a fraction
    named = index.select(F.col("doc_id").cast("string").alias("doc_id"), "n", "place", "tf")
    heaps = materialize(named.mapInPandas(search, "i int, score long, doc_id string"), "lexical-heaps")
    drop_files(index)
    names = spark.createDataFrame([(i, r.item) for i, r in enumerate(asked)], f"i int, item {pairs.schema['item'].dataType.simpleString()}")
    return heaps.join(F.broadcast(names), "i").select("item", "score", F.col("doc_id").cast("long").alias("doc_id"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score (long) of each item's k best documents with a score above 0.

    Equal scores stand by ascending doc_id, a null id last; repeated rows are documents of their own and take a rank each.
    Null, empty and termless texts are in no result and no count; rows under one item_id (null is one as well) are one
    item with all their terms; items without terms or matches have no rows. Other columns are not read. An empty table
    gives an empty result. Items are taken in blocks of about block_pairs distinct terms, each a pass over the documents;
    only a block's terms, weights and items are broadcast. An id is a whole number."""
    spark = docs.sparkSession
    small_batches(spark)
    pairs = materialize(_item_terms(items, item_id, item_text), "lexical-items")
    blocks = max(1, math.ceil(pairs.count() / block_pairs))
    kind = pairs.schema["item"].dataType.simpleString()
    found = None
    for b in range(blocks):
        part = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        if not part.isEmpty():
            got = _search_block(docs, part, doc_id, text, k)
            found = got if found is None else found.union(got)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    by = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # a task's heap has k rows; many tasks' are merged in two steps, so that none meets all of an item's
    some = found.withColumn("part", F.spark_partition_id() % MERGED)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).filter(F.col("rank") <= k)
    out = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).filter(F.col("rank") <= k)
    return out.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def op12_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows for `documents` and `benchmark`; either table empty gives none."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = rf"""
WITH item AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
     doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
     long AS (SELECT r, doc_id, len(terms) AS n FROM doc WHERE len(terms) > 0),
     total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM long),
     posting AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM doc) WHERE term IN (SELECT term FROM item) GROUP BY ALL),
     term AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posting, total GROUP BY term),
     score AS (
       SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score
       FROM item JOIN posting USING (term) JOIN term USING (term) JOIN long USING (r), total GROUP BY ALL),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INT AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
