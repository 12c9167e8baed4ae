"""SimHash near-deduplication: fingerprints, pigeonhole blocks, verified Hamming distance, components."""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import free_name, join_sized, materialize, small_batches, table
from sieveline.llm.components import components

#: Words in a shingle, bits that linked fingerprints may differ in, blocks of a fingerprint.
SHINGLE, BITS, BLOCKS = 3, 2, 4
#: A bucket of a block key with more distinct fingerprints than this is linked by one-bit neighbourhoods instead.
PAIR_BUCKET = 64
#: Shingles hashed at once; a text of any length is taken in such steps.
STEP = 8192

_xxh64 = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as an unsigned number; 0 for null and for texts without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = words[at : at + STEP + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter(map(_xxh64, grams), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as Spark's signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64))

    return of(text)


def _block_keys(fp: Column, bits: int, blocks: int) -> list[Column]:
    """A pair within bits differs in at most that many blocks, so it agrees on all the others: one key for each choice
    of blocks - bits that agree."""
    width = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    start = [sum(width[:i]) for i in range(blocks)]
    keys = []
    for chosen in combinations(range(blocks), blocks - bits):
        mask = sum(((1 << width[i]) - 1) << start[i] for i in chosen)
        keys.append(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return keys


def near_links(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) at most bits apart, enough to connect all such pairs.

    Rows meet in the buckets of their block keys. Within a bucket of up to pair_bucket fingerprints all pairs are
    verified. A larger bucket would emit too many: there, every fingerprint is dealt to itself and its neighbours at one
    flipped bit; those that meet at such a value are at most two bits apart, so they are chained to the least of them,
    and any pair at distance 2 meets at the value between. (For bits other than 2 all buckets are paired.)"""
    dealt = fps.select("fp", F.posexplode(F.array(*_block_keys(F.col("fp"), bits, blocks))).alias("block", "key"))
    sizes = dealt.groupBy("block", "key").count().filter("count > 1")
    sizes = materialize(sizes, "simhash-buckets")
    narrow = sizes.filter(F.col("count") <= pair_bucket) if bits == 2 else sizes
    mine = materialize(dealt.join(narrow.select("block", "key").hint("merge"), ["block", "key"]), "simhash-dealt")
    pairs = (
        mine.withColumnRenamed("fp", "a").join(mine.withColumnRenamed("fp", "b").hint("merge"), ["block", "key"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")
    )
    wide = sizes.filter(F.col("count") > pair_bucket)
    if bits != 2 or wide.isEmpty():
        return pairs.distinct()
    crowded = dealt.join(wide.select("block", "key").hint("merge"), ["block", "key"]).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    met = materialize(crowded.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("at")), "simhash-flips")
    least = materialize(met.groupBy("at").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("at", "a"), "simhash-least")
    return pairs.union(met.join(least.hint("merge"), "at").filter("a != fp").select("a", F.col("fp").alias("b"))).distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, bits: int = BITS, blocks: int = BLOCKS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """The columns carry (default: doc_id) of each row with simhash (signed long), component_id and stays.

    component_id is the smallest doc_id reachable over links of fingerprints at most bits apart (null if no member has
    an id). stays marks one row of each component: that with the smallest doc_id, null last, one of repeated rows.
    Null, empty and wordless texts have fingerprint 0, linked like any other. An empty table gives an empty result."""
    small_batches(docs.sparkSession)
    carry = [doc_id] if carry is None else carry
    own, rid = free_name(docs, "own_id"), free_name(docs, "rid")
    rows = materialize(docs.select(*carry, F.col(doc_id).alias(own), F.monotonically_increasing_id().alias(rid), fingerprints(F.col(text)).alias("simhash")), "simhash")
    fps = materialize(
        rows.groupBy(F.col("simhash").alias("fp")).agg(F.min(F.struct(F.col(own).isNull().alias("a"), F.col(own).alias("b"), F.col(rid).alias("c"))).alias("first")),
        "simhash-distinct",
    )
    of = components(near_links(fps.select("fp"), bits, blocks, pair_bucket)).withColumnRenamed("node", "fp")
    rooted = materialize(fps.join(of.hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "simhash-rooted")
    firsts = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")), "simhash-firsts")
    labels = materialize(rooted.select("fp", "root").join(firsts.hint("merge"), "root").select(F.col("fp").alias("simhash"), F.col("first.b").alias("component_id"), F.col("first.c").alias("first_rid")), "simhash-labels")
    out = join_sized(rows, labels, "simhash", "inner")
    return out.select(*carry, "simhash", "component_id", (F.col(rid) == F.col("first_rid")).alias("stays"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of all documents; an empty table gives no rows."""
    out = simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
