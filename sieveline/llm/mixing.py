"""Mixing sources to target weights: repetition rates from token totals, whole copies and one seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import WORD, free_name, join_sized, materialize, table

#: Weights go to the sources in code point order (null last), over and over.
WEIGHTS = (5, 2, 1)
#: Of all words, what the mix takes; and the most that a source repeats.
SHARE, MOST = 1.5, 2.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Of rows (source, source_size), one per source, the target of each: shares of the budget by weight, capped at
    most times the source's size, the excess shared by weight until none is above.

    With sources ordered by size over weight, those that are capped come first: source k is capped if its cap per
    weight is at most what would be left per weight once it and all before it got theirs. The windows see one row per
    source, not the documents, in one task: that is meant for sources in the thousands (some bytes each), not for a column
    that differs in every row."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    at = (F.row_number().over(by_name) - 1) % len(weights)
    w = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (at + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({
        "left_size": F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(fill), F.lit(0.0)),
        "left_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)),
    })
    w = w.withColumn("level", F.col("left_size") / F.col("left_weight"))
    w = w.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return w.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level).alias("target"))


def seeded_uniform(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that follows from the key alone: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def repetition_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, carry: list[str] | None = None) -> DataFrame:
    """The columns carry (default: doc_id) of each document with size, source_size, target, rate and copies.

    A text of null counts 0 words; a null source is a source of its own, ordered last; a source without words has rate
    0. Documents with equal ids draw alike. copies is floor(rate) plus one with the probability of the fraction."""
    carry = [doc_id] if carry is None else carry
    src, size = free_name(docs, "mix_source"), free_name(docs, "mix_size")
    sized = docs.select(*carry, F.col(doc_id).alias(free_name(docs, "mix_id")), F.col(source).alias(src), n_words(F.col(text)).alias(size))
    totals = docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(totals, weights, share, most), "mix-targets").withColumnRenamed("source", "of_source")
    out = join_sized(sized, targets, F.col(src).eqNullSafe(F.col("of_source")), "inner")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + (seeded_uniform(F.col(free_name(docs, "mix_id"))) < rate - whole).cast("long")
    return out.select(*carry, F.col(size).alias("size"), "source_size", "target", rate.alias("rate"), copies.alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed documents themselves: every row of docs, with all of its columns, as often as its plan says. An empty
    table gives an empty result."""
    kept = [free_name(docs, f"keep_{i}") for i in range(len(docs.columns))]
    plain = docs.select(*(F.col(c).alias(k) for c, k in zip(docs.columns, kept, strict=True)))
    name = dict(zip(docs.columns, kept, strict=True))
    plan = repetition_plan(plain, name[doc_id], name[text], name[source], carry=kept, **how)
    out = plan.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*(F.col(k).alias(c) for c, k in name.items()))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of all documents; an empty table gives no rows."""
    plan = repetition_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER p, 0) AS left_size, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS left_weight
      FROM w WINDOW p AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, left_size / left_weight AS level, cap / weight <= left_size / left_weight AS capped FROM f),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * max(CASE WHEN NOT capped THEN level END) OVER () END AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r
"""
