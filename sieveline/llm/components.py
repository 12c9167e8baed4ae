"""Connected components of a graph held in a DataFrame, by contraction.

Each round every node points at the least of itself and its neighbours, the pointers are followed to their roots, and
edges are rewritten between roots; the edges that remain at least halve. All joins read written tables on both sides,
so that adaptive execution may split the partition of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import drop_files, materialize


def _follow(pointers: DataFrame) -> DataFrame:
    """Pointers (node, root) to smaller nodes, until every root points at itself."""
    while True:
        up = pointers.select(F.col("node").alias("root"), F.col("root").alias("up"))
        nxt = materialize(
            pointers.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"), (F.coalesce("up", "root") != F.col("root")).alias("moved")),
            "pointers",
        )
        moved = not nxt.filter("moved").isEmpty()
        drop_files(pointers)
        pointers = nxt.select("node", "root")
        if not moved:
            return pointers


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of edges (a, b); root is the least node reachable. Self links and repeated
    edges do no harm; edges with a null end are ignored; no edges give no rows."""
    edges = materialize(edges.filter("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping = None
    while not edges.isEmpty():
        # a node on the larger side points at its least neighbour; one that has only larger neighbours is its own root
        pointers = materialize(
            edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
            .union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")))
            .groupBy("node").agg(F.min("root").alias("root")),
            "pointers",
        )
        pointers = _follow(pointers)
        to_a = pointers.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = pointers.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        nxt = materialize(
            edges.join(to_a, "a").join(to_b, "b").filter("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
        if mapping is None:
            mapping = pointers
        else:
            up = pointers.select(F.col("node").alias("root"), F.col("root").alias("up"))
            joined = materialize(mapping.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "mapping")
            drop_files(mapping)
            drop_files(pointers)
            mapping = joined
        drop_files(edges)
        edges = nxt
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping
