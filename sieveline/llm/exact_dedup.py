"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text without white space is cut where its own bytes say so, each chunk gets a 128-bit identifier, and the identifiers
are verified: every distinct pair of identifier and SHA-256 of its chunk is gathered once and no identifier may stand for
two chunks, else all are drawn again under the next seed. From then on a document is its ordered list of identifiers; texts
are equal exactly if the lists are, so only short lists and digests are shuffled, grouped and joined, never a text. Texts
are cut and hashed in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import drop_files, free_name, materialize, table

#: A chunk has at least so many bytes (but the last), then ends behind the first three bytes of the classes below.
CHUNK_MIN, CHUNK_MAX = 256, 2048


def byte_class(multiplier: int) -> str:
    """A quarter of all bytes, as a class of a regular expression: those that a multiplicative hash sends to the lowest
    quarter. The bytes of any script are spread alike, and a cut falls behind one byte in 64."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if b * multiplier % 257 % 256 < 64) + "]"


CUT = "".join(map(byte_class, (109, 169, 183)))


def chunk_pattern(least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> str:
    return rf"(?s).{{{least},{most - 3}}}?{CUT}|.{{1,{most}}}"


def without_space(text: Column) -> Column:
    """The text without U+0020 and U+0009 to U+000D; null becomes empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _identifier(chunk: Column, seed: int, bits: int) -> Column:
    pair = F.xxhash64(chunk, F.lit(seed)), F.xxhash64(F.lit(seed), chunk)
    return F.array(*(F.shiftrightunsigned(h, 64 - bits // 2) if bits < 128 else h for h in pair))


def chunks(norm: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """The chunks of a text's UTF-8 bytes in order, a character a byte."""
    return F.regexp_extract_all(F.decode(F.encode(norm, "UTF-8"), "ISO-8859-1"), F.lit(chunk_pattern(least, most)), F.lit(0))


def verified(recipes: DataFrame, ids: str, proofs: str) -> bool:
    """Whether no identifier of these rows' lists stands for two different chunks."""
    pairs = recipes.select(F.explode(F.arrays_zip(F.col(ids).alias("id"), F.col(proofs).alias("proof"))).alias("p")).select("p.id", "p.proof").distinct()
    return pairs.groupBy("id").count().filter("count > 1").isEmpty()


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None, bits: int = 128) -> DataFrame:
    """One row per document with the columns carry (default: doc_id) and keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space; null counts as empty. Of equal texts the row with the
    most code points in the original text stays, then the smallest doc_id (null last), then one of the repeated rows.
    Empty texts equal one another. An empty table gives an empty result. keep_id is null if the row that stays has no
    doc_id. Columns of docs that bear a name of the result must not be carried.
    """
    carry = [doc_id] if carry is None else carry
    norm, rid, n, recipe, proof, cut = (free_name(docs, c) for c in ("norm", "rid", "points", "recipe", "proof", "chunks"))
    own = free_name(docs, "own_id")
    texts = docs.withColumn(norm, without_space(F.col(text))).withColumn(cut, chunks(F.col(norm)))
    seed, rows = 0, None
    while rows is None or not verified(rows, recipe, proof):
        if rows is not None:
            drop_files(rows)
            seed, bits = seed + 1, min(128, bits * 2)
        rows = materialize(
            texts.select(
                *carry, F.col(doc_id).alias(own), F.monotonically_increasing_id().alias(rid), F.coalesce(F.length(text), F.lit(0)).alias(n), F.sha2(norm, 256).alias("text_sha256"),
                F.transform(cut, lambda c: _identifier(c, seed, bits)).alias(recipe), F.transform(cut, lambda c: F.unhex(F.sha2(F.encode(c, "ISO-8859-1"), 256))).alias(proof),
            ),
            "recipes",
        )
    groups = materialize(
        rows.drop(proof).groupBy(recipe).agg(
            F.min(F.struct((-F.col(n)).alias("a"), F.col(own).isNull().alias("b"), F.col(own).alias("c"), F.col(rid).alias("d"))).alias("best"),
            F.count(F.lit(1)).alias("group_size"),
        ).select(recipe, F.col("best.c").alias("keep_id"), F.col("best.d").alias("best_rid"), "group_size"),
        "recipe-groups",
    )
    joined = rows.drop(proof).join(groups.hint("merge"), recipe)
    return joined.select(*carry, "keep_id", "group_size", (F.col(rid) == F.col("best_rid")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of all documents; an empty table gives no rows."""
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, coalesce(length(text), 0) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY norm) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
