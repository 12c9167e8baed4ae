"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter answers for all languages at once: a slot holds one bit per language, and the AND of an
n-gram's slots is the set of languages that contain it. A text's hits are counted per language, corrected for the
false positives that each language's slice lets through, and the largest corrected count decides.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import fold, free_name, small_batches, table

#: Bytes in an n-gram (of the lower-cased UTF-8 text with a space at either end).
GRAM = 4
#: The bound of the fit: labelled documents of a language that are read (chosen by a hash of the text). All their n-grams
#: that were met so often go into the language's slice; the filter grows with them.
SAMPLE_DOCS, LEAST_MET = 5000, 2
#: Slots per n-gram held, hashes per n-gram.
SLOTS_PER_GRAM, HASHES = 16, 2
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
#: N-grams by which the best language must lead the next for a score of 0.73; twice as many give 0.88.
LEAD = 2.0
#: Bytes taken in one step; a text of any length is counted step by step.
STEP = 1 << 20


def grams(data: bytes, n: int = GRAM) -> np.ndarray:
    """The n-grams of bytes, each as one number."""
    b = np.frombuffer(data, np.uint8)
    out = np.zeros(max(0, len(b) - n + 1), np.uint64 if n > 4 else np.uint32)
    for i in range(n):
        out |= b[i : len(b) - n + 1 + i].astype(out.dtype) << out.dtype.type(8 * i)
    return out


def _steps(text: str, n: int):
    data = b" " + text.lower().encode("utf-8", "replace") + b" "
    for at in range(0, max(1, len(data) - n + 1), STEP):
        yield grams(data[at : at + STEP + n - 1], n)


class BitmaskFilter:
    """The filter: slots of languages' bits, in slices of eight languages."""

    def __init__(self, langs: list[str], keys: dict[str, np.ndarray], n: int = GRAM):
        self.langs, self.n = langs, n
        total = max(1, sum(map(len, keys.values())))
        self.bits = max(10, int(np.ceil(np.log2(total * SLOTS_PER_GRAM))))
        self.slices = [np.zeros(1 << self.bits, np.uint8) for _ in range((len(langs) + 7) // 8)]
        for i, lang in enumerate(langs):
            for at in self._slots(keys[lang]):
                self.slices[i // 8][at] |= np.uint8(1 << i % 8)
        #: Chance that an n-gram that a language lacks passes its slice.
        self.false = np.array([np.mean((self.slices[i // 8] >> (i % 8)) & 1) ** HASHES for i in range(len(langs))])

    def _slots(self, x: np.ndarray):
        with np.errstate(over="ignore"):
            return [((x.astype(np.uint64) + np.uint64(1)) * m) >> np.uint64(64 - self.bits) for m in _MIX[:HASHES]]

    def shares(self, text: str) -> tuple[np.ndarray, int]:
        """Of the text's n-grams, the share that each language contains, corrected for false positives; their number."""
        hits, n = np.zeros(len(self.langs)), 0
        for x in _steps(text, self.n):
            n += len(x)
            slots = self._slots(x)
            for k, held in enumerate(self.slices):
                mask = held[slots[0]]
                for s in slots[1:]:
                    mask = mask & held[s]
                counts = np.bincount(mask, minlength=256)
                for i in range(8 * k, min(8 * k + 8, len(self.langs))):
                    hits[i] += counts[(np.arange(256) >> (i % 8)) & 1 == 1].sum()
        if not n or not len(self.langs):
            return hits, n
        return np.maximum(0.0, (hits - n * self.false) / (1 - np.minimum(self.false, 0.999))) / n, n


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, least_met: int = LEAST_MET, n: int = GRAM) -> BitmaskFilter:
    """Learn from rows with a text and a language; rows with a null in either are left out. Of each language at most
    about sample_docs documents are read, whole; which, a hash of their text decides. N-grams met least_met times or more
    are held, however many: SLOTS_PER_GRAM bytes each for eight languages, and a lacking n-gram passes a slice with at most
    the chance (HASHES / SLOTS_PER_GRAM) ^ HASHES, which counts are corrected for."""
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not counts:
        return BitmaskFilter([], {}, n)
    rate = F.create_map(*(x for k, v in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / v)))))
    chosen = rows.filter(F.pmod(F.xxhash64("t"), F.lit(1_000_003)) / F.lit(1_000_003.0) < F.element_at(rate, F.col("l")))

    def count(batches):
        for batch in batches:
            for of, part in batch.groupby("l"):
                x = np.concatenate([g for t in part["t"] for g in _steps(t, n)])
                key, times = np.unique(x, return_counts=True)
                yield pd.DataFrame({"l": of, "g": key.astype(np.int64), "n": times})

    sums = chosen.mapInPandas(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    found = sums.filter(F.col("n") >= least_met).select("l", "g").toPandas()  # of sample_docs documents per language
    langs = sorted(counts, key=lambda k: (-counts[k], k))
    return BitmaskFilter(langs, {k: found.loc[found["l"] == k, "g"].to_numpy(np.uint64) for k in langs}, n)


def predict(docs: DataFrame, model: BitmaskFilter, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (a logistic function of how many n-grams the best language is ahead of the next) and
    share (the corrected share of the text's n-grams that the best language contains).

    A text that is null or has no letter is `und` with score 0, share 0, as is every text when nothing was learned. Of
    tied languages the more frequent in training wins, then the first by name. Texts are read whole. A column of docs
    that bears a name of the result is replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # SLOTS_PER_GRAM bytes an n-gram of the sample

    @F.pandas_udf("lang_pred string, score double, share double")
    def decide(texts: pd.Series, letter: pd.Series) -> pd.DataFrame:
        of, rows = held.value, []
        for t, has in zip(texts, letter, strict=True):
            if not has or not of.langs:
                rows.append(("und", 0.0, 0.0))
                continue
            s, n = of.shares(t)
            best = int(np.argmax(s))
            second = float(np.partition(s, -2)[-2]) if len(s) > 1 else 0.0
            lead = min(40.0, n * (float(s[best]) - second) / LEAD)
            rows.append((of.langs[best], 1 / (1 + math.exp(-lead)) if s[best] > 0 else 0.0, min(1.0, float(s[best]))))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "share"])

    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    name = free_name(docs, "decided")
    names = ("lang_pred", "score", "share")
    others = [c for c in docs.columns if c.lower() not in names]
    return docs.withColumn(name, decide(F.col(text), has_letter)).select(*others, *(F.col(f"{name}.{c}").alias(c) for c in names))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of all documents; without labelled ones all are `und`, no documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4, 2)
    model = fit(docs.filter(~held_out))
    return predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score", "share")
