"""Embedding near-deduplication by a robust-pruned flat graph that is searched across shards.

Equal vectors are made one class. Two levels of centroids, each fitted on a bounded sample, deal the classes to shards whose
size does not grow with the table: a class has one home and up to three more shards. In every shard a graph is built and
robustly pruned, the adjacency lists that a class got in its shards are united, and the united graph is searched: each
class starts at the medoids of its home, goes on greedily, then expands over all that is in range or nearly so. Where an
edge leaves for another home, and the angles of the way there leave room for a link, the search goes on over there with
the edge's end as a seed, as one row a query and home; rounds end when no search goes on. A class is met in its home alone.
Links within a home are counted there, for both ends; links across homes leave the task as pairs of numbers, and each pair,
whichever end found it, is counted once for both.

Dense places, each with a 500th of all classes or more, would be met by all of their members in all of their shards.
They are taken out first as balls of half the angle of a link: members of a ball are linked with each other for certain and
are counted, not compared. What is near enough to a ball to be linked with some of it is compared with it exactly, in
blocks. Recall is audited against brute force for every id divisible by 50; below RECALL the shards of a class are made
more, and below it still, all classes are compared in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import drop_files, free_name, materialize, small_batches, table
from sieveline.llm.components import components

THRESHOLD = 0.9
#: The bounds of the fits: vectors sampled for the first level of centroids and in each of its cells for the second, and
#: for dense places; the least share of a dense place, and the least members of it in the sample.
SAMPLE, CELL_SAMPLE, DENSE_SAMPLE, DENSE_PART, DENSE_LEAST = 20_000, 20_000, 8000, 0.002, 16
#: Classes at home in a shard, about; cells of a class; classes of one task, of the build and of the search.
SHARD, CELLS, BUILD, HOME = 256, 2, 2048, 1024
#: Candidates by nearness and by chance, edges kept a shard, the pruning factor on squared distance.
NEAR, RANDOM, DEGREE, ALPHA = 32, 8, 24, 1.44
#: Entry points of a home, expansions without a nearer vector before the greedy search ends, what is nearly in range.
MEDOIDS, PATIENCE, SLACK = 8, 12, 0.08
#: Searches in one task; seeds of a search that goes on; classes to a side where all are compared.
VISITS, SEEDS, COMPARED = 8192, 8, 32_768
#: Ids divisible by this are audited; the recall asked for; cells of a class when it was too low.
AUDITED, RECALL, WIDER = 50, 0.98, 4
_SLIP = 1e-6


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return F.coalesce(fine & some, F.lit(False))


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angle(cosine):
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Directions of k clusters of unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        of = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, of, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def dense_pivots(sample: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Of a sample of unit vectors one for each dense place: DENSE_PART of the sample lies within half a link's angle."""
    least = max(DENSE_LEAST, DENSE_PART * len(sample))
    half = math.cos(math.acos(threshold) / 2)
    n = np.concatenate([(sample[i : i + 1024] @ sample.T >= half).sum(1) for i in range(0, len(sample), 1024)])
    left, out = np.ones(len(sample), bool), []
    for i in np.argsort(-n, kind="stable"):
        if n[i] < least:
            break
        if left[i]:
            near = sample @ sample[i] >= half
            if (near & left).sum() >= least:
                out.append(sample[i])
                left &= ~near
    return np.array(out).reshape(len(out), sample.shape[1])


# the graph of a shard ----------------------------------------------------------------------------------------------


def robust_prune(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The adjacency (rows of local numbers, -1 where free) of a flat graph over unit vectors. Of a vector's candidates
    the nearest is kept and those that are nearer to it, by ALPHA, than to the vector go; and so on."""
    n = len(x)
    sims = (x.astype(np.float32)) @ x.T.astype(np.float32)
    near = min(NEAR, n - 1)
    work = sims.copy()
    np.fill_diagonal(work, -2)
    cand = np.argpartition(-work, near - 1, axis=1)[:, :near]
    cand = np.concatenate([cand, rng.integers(0, n, (n, RANDOM))], 1)
    rows = np.arange(n)
    cs = sims[rows[:, None], cand]
    order = np.argsort(-cs, axis=1)
    cand, cs = np.take_along_axis(cand, order, 1), np.take_along_axis(cs, order, 1)
    alive = cand != rows[:, None]
    out = np.full((n, DEGREE), -1, np.int64)
    for r in range(DEGREE):
        some = alive.any(1)
        if not some.any():
            break
        at = alive.argmax(1)
        pick = cand[rows, at]
        out[some, r] = pick[some]
        gone = ALPHA * (1 - sims[pick[:, None], cand]) <= (1 - cs)
        alive &= ~(gone & some[:, None])
        alive[rows, at] = False
        alive &= cand != pick[:, None]
    return out


def _build(g: pd.DataFrame) -> pd.DataFrame:
    """Of the vectors of a shard the edges, in both directions, with the homes and angles of their ends."""
    g = g.sort_values("cid")
    cid, home, x = g["cid"].to_numpy(), g["home"].to_numpy(), _unit(g["v"])
    if len(x) < 2:
        return pd.DataFrame({"cid": cid, "near": [[]] * len(cid), "near_home": [[]] * len(cid), "near_angle": [[]] * len(cid)})
    adj = robust_prune(x, np.random.default_rng(len(x)))
    src, dst = np.nonzero(adj >= 0)[0], adj[adj >= 0]
    key = np.unique(np.concatenate([src * len(x) + dst, dst * len(x) + src]))
    src, dst = key // len(x), key % len(x)
    angle = _angle(np.einsum("ij,ij->i", x[src], x[dst])).astype(np.float32)
    cut = np.searchsorted(src, np.arange(1, len(x)))
    return pd.DataFrame({"cid": cid, "near": np.split(cid[dst], cut), "near_home": np.split(home[dst], cut), "near_angle": np.split(angle, cut)})


def medoids(x: np.ndarray, m: int = MEDOIDS) -> np.ndarray:
    """The vector nearest to the mean, then those farthest from all taken so far."""
    first = int((x @ x.mean(0)).argmax())
    taken, best = [first], x @ x[first]
    while len(taken) < min(m, len(x)):
        nxt = int(best.argmin())
        taken.append(nxt)
        best = np.maximum(best, x @ x[nxt])
    return np.array(sorted(set(taken)))


class Home:
    """The classes that are at home in one place, the edges among them and those that leave."""

    def __init__(self, g: pd.DataFrame):
        g = g.sort_values("cid")
        self.cid, self.copies, self.x = g["cid"].to_numpy(), g["copies"].to_numpy(), _unit(g["v"])
        n = len(self.cid)
        src = np.repeat(np.arange(n), [len(a) for a in g["near"]])
        to, home, angle = (np.concatenate([np.asarray(a, t) for a in g[c]]) if len(src) else np.zeros(0, t) for c, t in (("near", np.int64), ("near_home", np.int64), ("near_angle", np.float64)))
        away = home != g["home"].iat[0]
        at = np.searchsorted(self.cid, to[~away])
        key = np.unique(src[~away] * n + at)
        s, d = key // n, key % n
        place = np.arange(len(s)) - np.searchsorted(s, np.arange(n))[s]
        self.adj = np.full((n, int(place.max(initial=-1)) + 1), -1, np.int64)
        self.adj[s, place] = d
        _, once = np.unique(src[away] * (1 << 32) + np.searchsorted(np.unique(to[away]), to[away]), return_index=True)
        self.out_src, self.out_to, self.out_home, self.out_angle = src[away][once], to[away][once], home[away][once], angle[away][once]
        self.out_at = np.searchsorted(self.out_src, np.arange(n + 1))
        self.entries = medoids(self.x)

    def search(self, q: np.ndarray, seeds: list[np.ndarray], threshold: float) -> np.ndarray:
        """The cosines of queries with what the graph leads them to, -2 elsewhere: greedily from the medoids and seeds,
        then over all that is in range or nearly so."""
        x, adj, n = self.x, self.adj, len(self.x)
        sim = np.full((len(q), n), -2.0)
        sim[:, self.entries] = q @ x[self.entries].T
        for i, s in enumerate(seeds):
            if len(s):
                sim[i, s] = x[s] @ q[i]
        expanded = np.zeros((len(q), n), bool)

        def meet(qi, nodes):
            """Look at the neighbours of (query, node) pairs that the query hasn't seen."""
            for i in range(0, len(qi), 8192):
                nb = adj[nodes[i : i + 8192]]
                who = np.broadcast_to(qi[i : i + 8192, None], nb.shape)[nb >= 0]
                nb = nb[nb >= 0]
                new = sim[who, nb] == -2.0
                who, nb = who[new], nb[new]
                for j in range(0, len(who), 16384):
                    sim[who[j : j + 16384], nb[j : j + 16384]] = np.einsum("ij,ij->i", q[who[j : j + 16384]], x[nb[j : j + 16384]])

        best, idle, active = sim.max(1), np.zeros(len(q), int), np.arange(len(q))
        while len(active):
            open_ = np.where(expanded[active], -2.0, sim[active])
            to = open_.argmax(1)
            some = open_[np.arange(len(active)), to] > -2.0
            active, to = active[some], to[some]
            if not len(active):
                break
            expanded[active, to] = True
            meet(active, to)
            now = sim[active].max(1)
            better = now > best[active]
            best[active] = np.maximum(best[active], now)
            idle[active] = np.where(better, 0, idle[active] + 1)
            active = active[idle[active] < PATIENCE]
        while True:
            qi, nodes = np.nonzero((sim >= threshold - SLACK) & ~expanded)
            if not len(qi):
                return sim
            expanded[qi, nodes] = True
            meet(qi, nodes)

    def onward(self, sim: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where searches go on, as (query, home, end of an edge), the nearest ends first, SEEDS at most for each query
        and home: from what is nearly in range, over edges that may lead to a link by the angles alone."""
        qi, node = np.nonzero(sim >= threshold - SLACK)
        n = self.out_at[node + 1] - self.out_at[node]
        edge = np.repeat(self.out_at[node] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        qi, angle = np.repeat(qi, n), np.repeat(_angle(sim[qi, node]), n)
        room = np.abs(angle - self.out_angle[edge])
        keep = room <= math.acos(threshold) + 1e-3
        qi, edge, room = qi[keep], edge[keep], room[keep]
        order = np.lexsort((room, self.out_home[edge], qi))
        qi, edge = qi[order], edge[order]
        home = self.out_home[edge]
        new = np.concatenate([[True], (qi[1:] != qi[:-1]) | (home[1:] != home[:-1])]) if len(qi) else np.zeros(0, bool)
        place = np.arange(len(qi)) - np.maximum.accumulate(np.where(new, np.arange(len(qi)), 0))
        few = place < SEEDS
        return qi[few], home[few], self.out_to[edge[few]]


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n nodes reaches over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


FOUND = "cid long, links long, pairs long, root long"


def _found(cid, links, pairs, root) -> pd.DataFrame:
    return pd.DataFrame({"cid": cid, "links": links, "pairs": pairs, "root": root})


def _searched(h: Home, cid: np.ndarray, copies: np.ndarray, q: np.ndarray, vectors, seeds: list[np.ndarray], threshold: float, own: bool) -> pd.DataFrame:
    """Found links and searches that go on. own: the queries are the home's classes themselves."""
    parts, link_q, link_x, links, pairs = [], [], [], np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    for at in range(0, len(q), 256):
        some = slice(at, at + 256)
        sim = h.search(q[some], seeds[some], threshold)
        qi, xi = np.nonzero(sim >= threshold)
        apart = cid[some][qi] != h.cid[xi]
        link_q.append(qi[apart] + at)
        link_x.append(xi[apart])
        qi, home, to = h.onward(sim, threshold)
        if len(qi):
            new = np.flatnonzero(np.concatenate([[True], (qi[1:] != qi[:-1]) | (home[1:] != home[:-1])]))
            first = qi[new] + at
            parts.append(pd.DataFrame({"cid": cid[first], "to": home[new], "seeds": np.split(to, new[1:]), "copies": copies[first], "v": [vectors[i] for i in first]}))
    a, b = np.concatenate(link_q), np.concatenate(link_x)
    if not own:
        across = pd.DataFrame({"cid": cid[a], "peer": h.cid[b], "links": h.copies[b], "copies": copies[a]})
        return pd.concat([across, *parts], ignore_index=True)
    key = np.unique(np.concatenate([a * len(q) + b, b * len(q) + a]))  # a link that one end found is the other's as well
    a, b = key // len(q), key % len(q)
    np.add.at(links, a, h.copies[b])
    np.add.at(pairs, a, 1)
    return pd.concat([_found(cid, links, pairs, cid[_labels(len(cid), a, b)]), *parts], ignore_index=True)


def _none(*columns: str) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})


def _typed(out: pd.DataFrame) -> pd.DataFrame:
    for c in ("links", "pairs", "root", "peer", "to", "copies"):
        out[c] = out[c].astype("Int64") if c in out else pd.array([None] * len(out), "Int64")
    for c in ("seeds", "v"):
        out[c] = out[c].astype(object).where(out[c].notna(), None) if c in out else pd.Series([None] * len(out), dtype=object, index=out.index)
    return out[["cid", "links", "pairs", "root", "peer", "to", "seeds", "copies", "v"]]


def _graph_links(classes: DataFrame, threshold: float, shard: int, cells: int) -> DataFrame:
    """Materialized rows FOUND of classes (cid, copies, v) by the graph, some for each class."""
    spark = classes.sparkSession
    vector = classes.schema["v"].dataType.simpleString()
    by = {r.d: r.n for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a dimension
    cents, first = {}, {}
    for d, n in sorted(by.items()):
        first[d] = sum(map(len, cents.values()))
        cents[d] = centroids(_unit(_sample(classes.filter(F.size("v") == d), n, SAMPLE)), math.ceil(math.sqrt(math.ceil(n / shard))))
    held = spark.sparkContext.broadcast(cents)  # the square root of the number of shards

    @F.pandas_udf("array<int>")
    def near_cells(vectors: pd.Series) -> pd.Series:
        out = [None] * len(vectors)
        sizes = np.array([len(v) for v in vectors])
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            sims = -(_unit(vectors.iloc[at]) @ held.value[d].T)
            k = min(cells, sims.shape[1])
            order = np.argpartition(sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(at), 1))
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(sims, order, 1), 1), 1)
            for i, c in zip(at, order + first[d], strict=True):
                out[i] = c.tolist()
        return pd.Series(out)

    celled = materialize(classes.select("cid", "copies", "v", near_cells(F.col("v")).alias("cells")), "vector-cells")
    sizes = {r.cell: r.n for r in celled.groupBy(F.col("cells")[0].alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a cell
    parts = {c: min(math.ceil(n / shard), CELL_SAMPLE // 4) for c, n in sizes.items()}
    offset = dict(zip(sorted(parts), np.concatenate([[0], np.cumsum([parts[c] for c in sorted(parts)])[:-1]]).tolist(), strict=True))
    rate = F.create_map(*(x for c, n in sizes.items() for x in (F.lit(c), F.lit(min(1.0, max(16.0 * parts[c], 4096.0) / n, CELL_SAMPLE / n)))))
    told = spark.sparkContext.broadcast((parts, offset))

    def second(g: pd.DataFrame) -> pd.DataFrame:
        cell = int(g["cell"].iat[0])
        x = _unit(g.sort_values("cid")["v"])
        return pd.DataFrame({"cell": [cell], "width": [x.shape[1]], "centroids": [centroids(x, told.value[0][cell]).astype(np.float32).ravel()]})

    fitted = materialize(
        celled.withColumn("cell", F.col("cells")[0]).filter(F.pmod(F.xxhash64("cid"), F.lit(1_000_003)) / F.lit(1_000_003.0) < F.element_at(rate, F.col("cell")))
        .select("cell", "cid", "v").groupBy("cell").applyInPandas(second, "cell int, width int, centroids array<float>"),
        "vector-centroids",
    )
    salts = {c: -(-n // SAMPLE) for c, n in sizes.items() if n > SAMPLE}
    salted = lambda cell: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in salts.items() for x in kv)), cell), F.lit(1)) if salts else F.lit(1)

    def assign(rows: DataFrame, cell: Column, make, schema: str) -> DataFrame:
        """Groups of a cell's classes, SAMPLE of them at most, with the cell's centroids. The second cells of classes are
        met like the first, their groups are of about as many."""
        left = rows.withColumn("cell", cell).withColumn("salt", F.pmod(F.xxhash64("cid"), salted(F.col("cell"))))
        right = fitted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salted(F.col("cell")) - 1)))
        return left.groupBy("cell", "salt").cogroup(right.groupBy("cell", "salt")).applyInPandas(make, schema)

    def nearest(g: pd.DataFrame, c: pd.DataFrame) -> np.ndarray:
        m = np.asarray(c["centroids"].iat[0], np.float64).reshape(-1, int(c["width"].iat[0]))
        x = _unit(g["v"])
        got = []
        for i in range(0, len(x), 4096):
            sims = -(x[i : i + 4096] @ m.T)
            k = min(2, sims.shape[1])
            order = np.argpartition(sims, k - 1, axis=1)[:, :k]
            got.append(np.take_along_axis(order, np.argsort(np.take_along_axis(sims, order, 1), 1), 1))
        return np.concatenate(got) + told.value[1][int(c["cell"].iat[0])]

    def at_home(g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(c):
            return _none("cid", "copies", "v", "cells", "shards")
        return g[["cid", "copies", "v", "cells"]].assign(shards=nearest(g, c).tolist())

    def elsewhere(g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(c):
            return _none("cid", "home", "v", "shards")
        return g[["cid", "home", "v"]].assign(shards=nearest(g, c).tolist())

    placed = materialize(assign(celled, F.col("cells")[0], at_home, f"cid long, copies long, v {vector}, cells array<int>, shards array<long>"), "vector-placed")
    crowd = F.broadcast(materialize(placed.groupBy(F.col("shards")[0].alias("shard")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOME), "vector-crowded"))  # less than n / HOME rows
    block = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / HOME)))
    homed = materialize(placed.join(crowd, F.col("shards")[0] == F.col("shard"), "left").select("cid", "copies", "v", "cells", "shards", (F.col("shards")[0] * (1 << 20) + block).alias("home")), "vector-homed")
    more = [assign(homed.filter(F.size("cells") > i), F.col("cells")[i], elsewhere, f"cid long, home long, v {vector}, shards array<long>") for i in range(1, cells)]
    dealt = homed.select("cid", "home", "v", F.explode("shards").alias("shard"))
    for other in more:
        dealt = dealt.unionByName(other.select("cid", "home", "v", F.explode("shards").alias("shard")))
    dealt = materialize(dealt, "vector-dealt")
    full = F.broadcast(materialize(dealt.groupBy(F.col("shard").alias("of")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUILD), "vector-full"))
    dealt_in = dealt.join(full, F.col("shard") == F.col("of"), "left").withColumn("block", F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("shard", "cid"), F.ceil(F.col("n") / BUILD))))
    edges = dealt_in.select("shard", "block", "cid", "home", "v").groupBy("shard", "block").applyInPandas(_build, "cid long, near array<long>, near_home array<long>, near_angle array<float>")
    united = edges.groupBy("cid").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("near", "near_home", "near_angle")))  # a list for each shard of a class
    nodes = materialize(homed.select("cid", "copies", "v", "home").join(united.hint("merge"), "cid"), "vector-graph")

    schema = f"{FOUND}, peer long, to long, seeds array<long>, copies long, v {vector}"

    def start(g: pd.DataFrame) -> pd.DataFrame:
        h = Home(g)
        vectors = g.sort_values("cid")["v"].tolist()
        return _typed(_searched(h, h.cid, h.copies, h.x, vectors, [np.zeros(0, np.int64)] * len(h.cid), threshold, True))

    def visit(g: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(a):
            return _none("cid", "links", "pairs", "root", "peer", "to", "seeds", "copies", "v")
        h = Home(g)
        seeds = []
        for s in a["seeds"]:
            s = np.asarray(s, np.int64)
            at = np.minimum(np.searchsorted(h.cid, s), len(h.cid) - 1)
            seeds.append(np.unique(at[h.cid[at] == s]))
        return _typed(_searched(h, a["cid"].to_numpy(), a["copies"].to_numpy(), _unit(a["v"]), a["v"].tolist(), seeds, threshold, False))

    out = materialize(nodes.groupBy("home").applyInPandas(start, schema), "vector-search")
    rounds, visited = [out], nodes.select("cid", F.col("home").alias("to"))
    while True:
        ahead = out.filter("to is not null").groupBy("cid", "to").agg(F.any_value("copies").alias("copies"), F.any_value("v").alias("v"), F.slice(F.flatten(F.collect_list("seeds")), 1, 2 * SEEDS).alias("seeds"))
        ahead = materialize(ahead.join(visited.hint("merge"), ["cid", "to"], "left_anti"), "vector-ahead")
        if ahead.isEmpty():
            break
        visited = visited.union(ahead.select("cid", "to"))
        per = materialize(ahead.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / VISITS).alias("parts")), "vector-visits")
        asked = ahead.join(per.hint("merge"), "to").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts"))).drop("parts").withColumnRenamed("to", "home")
        there = nodes.join(per.withColumnRenamed("to", "home").hint("merge"), "home").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        out = materialize(there.groupBy("home", "part").cogroup(asked.groupBy("home", "part")).applyInPandas(visit, schema), "vector-search")
        rounds.append(out)
    found = rounds[0]
    for r in rounds[1:]:
        found = found.union(r)
    turned = F.col("cid") > F.col("peer")
    ends = [F.when(turned, b).otherwise(a).alias(c) for c, a, b in (("a", F.col("cid"), F.col("peer")), ("b", F.col("peer"), F.col("cid")), ("of_a", F.col("copies"), F.col("links")), ("of_b", F.col("links"), F.col("copies")))]
    across = found.filter("peer is not null").select(*ends).distinct()
    end = lambda of, links: F.struct(F.col(of).alias("cid"), F.col(links).alias("links"), F.lit(1).cast("long").alias("pairs"), F.col("a").alias("root"))
    across = across.select(F.explode(F.array(end("a", "of_b"), end("b", "of_a"))).alias("e")).select("e.*")
    within = found.filter("to is null and peer is null").select("cid", "links", "pairs", "root")
    found = materialize(within.union(across), "vector-found")
    for t in (celled, fitted, placed, homed, dealt, nodes, *rounds):
        drop_files(t)
    return found


# dense places, and exact comparison in blocks ----------------------------------------------------------------------


def _sample(classes: DataFrame, n: int, size: int) -> list:
    """About so many of n vectors, chosen by a hash of their numbers: a bounded fit."""
    rate = min(1.0, size / max(1, n))
    got = classes.filter(F.pmod(F.xxhash64("cid"), F.lit(1_000_003)) < F.lit(1 + int(1_000_003 * rate))).limit(2 * size).select("v").collect()
    return [r.v for r in got] or [classes.first().v]


def _compared(queries: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Rows FOUND of all queries (key, cid, copies, v, both) against all rows (key, cid, copies, v) of their key by brute
    force, in blocks: a block of rows meets a block of queries. Where both is true the rows count such queries too."""
    per_row = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("row_blocks", F.greatest(F.ceil(F.col("n") / COMPARED), F.least(F.lit(16), F.ceil(F.col("n") / 2048)))).drop("n"), "vector-row-blocks")
    per_query = queries.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / COMPARED).alias("query_blocks"))
    per = F.broadcast(materialize(per_row.join(per_query, "key"), "vector-blocks"))  # a row for each dimension or dense place
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = rows.join(per, "key").withColumn("i", F.pmod(F.xxhash64("cid"), F.col("row_blocks"))).withColumn("j", upto("query_blocks")).select("key", "i", "j", "cid", "copies", "v")
    right = queries.join(per, "key").withColumn("j", F.pmod(F.xxhash64("cid"), F.col("query_blocks"))).withColumn("i", upto("row_blocks"))
    right = right.select(*(F.col(c).alias(f"q_{c}") for c in ("key", "i", "j", "cid", "copies", "v", "both")))

    def compare(g: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(q):
            return _none("cid", "links", "pairs", "root")
        g, x, y = g.reset_index(drop=True), _unit(g["v"]), _unit(q["q_v"])
        gc, qc, both = g["cid"].to_numpy(), q["q_cid"].to_numpy(), q["q_both"].to_numpy()
        links, pairs, back, back_pairs, a, b = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.zeros(len(g), np.int64), np.zeros(len(g), np.int64), [], []
        for at in range(0, len(q), 256):
            qi, xi = np.nonzero(y[at : at + 256] @ x.T >= threshold)
            qi += at
            apart = qc[qi] != gc[xi]
            qi, xi = qi[apart], xi[apart]
            np.add.at(links, qi, g["copies"].to_numpy()[xi])
            np.add.at(pairs, qi, 1)
            two = both[qi]
            np.add.at(back, xi[two], q["q_copies"].to_numpy()[qi[two]])
            np.add.at(back_pairs, xi[two], 1)
            # a spanning set of edges: each query to its least row, each row to its least query of this step
            for s, d, flip in ((qi, xi, False), (xi, qi, True)):
                order = np.lexsort((d, s))
                s, d = s[order], d[order]
                new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
                a.append((d if flip else s)[new])
                b.append((s if flip else d)[new])
        everyone = np.concatenate([qc, gc])
        root = everyone[_labels(len(everyone), np.concatenate(a), np.concatenate(b) + len(qc))]
        out = [_found(qc, links, pairs, root[: len(qc)]), _found(gc, back, back_pairs, root[len(qc) :])[root[len(qc) :] != gc]]
        return pd.concat(out, ignore_index=True)

    return left.groupBy("key", "i", "j").cogroup(right.groupBy("q_key", "q_i", "q_j")).applyInPandas(compare, FOUND)


def _balls(classes: DataFrame, n: int, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """What is in no dense place, and rows FOUND of all links that have an end in one."""
    spark = classes.sparkSession
    widths = [r.d for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    pivots = {}
    for d in sorted(widths):
        of = classes.filter(F.size("v") == d)
        p = dense_pivots(_unit(_sample(of, of.count() if len(widths) > 1 else n, DENSE_SAMPLE)), threshold)
        if len(p):
            pivots[d] = p
    if not pivots:
        return classes, []
    first, total = {}, 0
    for d, p in sorted(pivots.items()):
        first[d], total = total, total + len(p)
    wide, half = math.acos(threshold), math.acos(threshold) / 2
    held = spark.sparkContext.broadcast(pivots)  # DENSE_PART of a sample each, so 1 / DENSE_PART of them at most

    @F.pandas_udf("ball int, angle double, near array<int>, near_angle array<double>")
    def around(vectors: pd.Series) -> pd.DataFrame:
        rows = [(None, None, [], [])] * len(vectors)
        sizes = np.array([len(v) for v in vectors])
        for d in np.unique(sizes):
            if d in held.value:
                at = np.flatnonzero(sizes == d)
                angle = _angle(_unit(vectors.iloc[at]) @ held.value[d].T)
                best = angle.argmin(1)
                for i, a, k in zip(at, angle, best, strict=True):
                    inside = a[k] <= half - _SLIP
                    near = np.flatnonzero(a <= wide + half)
                    near = near[near != k] if inside else near
                    rows[i] = (int(k) + first[d] if inside else None, float(a[k]), (near + first[d]).tolist(), a[near].tolist())
        return pd.DataFrame(rows, columns=["ball", "angle", "near", "near_angle"])

    told = materialize(classes.withColumn("at", around(F.col("v"))).select("cid", "copies", "v", "at.*"), "vector-balls")
    inside = told.filter("ball is not null")
    balls = {r.ball: r for r in inside.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("c"), F.max("angle").alias("r"), F.min("cid").alias("root")).collect()}
    if not balls:
        return classes, []
    small = spark.createDataFrame([(r.ball, r.n, r.c, r.r, r.root) for r in balls.values()], "p int, n long, c long, r double, ball_root long")
    own = inside.join(F.broadcast(small), F.col("ball") == F.col("p")).select("cid", (F.col("c") - F.col("copies")).alias("links"), (F.col("n") - 1).alias("pairs"), F.col("ball_root").alias("root"))
    near = told.select("cid", "copies", "v", "ball", F.explode(F.arrays_zip("near", "near_angle")).alias("z")).select("cid", "copies", "v", "ball", F.col("z.near").alias("p"), F.col("z.near_angle").alias("a"))
    near = near.join(F.broadcast(small), "p").filter(F.col("a") - F.col("r") <= wide + _SLIP).withColumn("whole", F.col("a") + F.col("r") <= wide - _SLIP)
    whole = near.filter("whole")
    taken = whole.select("cid", F.col("c").alias("links"), F.col("n").alias("pairs"), F.col("ball_root").alias("root"))
    given = {r.p: r for r in whole.filter("ball is null").groupBy("p").agg(F.sum("copies").alias("c"), F.count(F.lit(1)).alias("n")).collect()}
    out = [own, taken]
    if given:
        gift = spark.createDataFrame([(p, r.c, r.n) for p, r in given.items()], "p int, c long, n long")
        out.append(inside.join(F.broadcast(gift), F.col("ball") == F.col("p")).select("cid", F.col("c").alias("links"), F.col("n").alias("pairs"), F.col("cid").alias("root")))
    edge = near.filter("not whole").select(F.col("p").cast("long").alias("key"), "cid", "copies", "v", F.col("ball").isNull().alias("both"))
    out.append(_compared(edge, inside.select(F.col("ball").cast("long").alias("key"), "cid", "copies", "v"), threshold))
    return told.filter("ball is null").select("cid", "copies", "v"), out


def _summed(parts: list[DataFrame]) -> DataFrame:
    """Materialized rows FOUND of several ways, which share no link."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return materialize(out, "vector-links")


def _audit(classes: DataFrame, found: DataFrame, threshold: float) -> tuple[int, float | None]:
    """Links of different vectors that brute force finds for the ids divisible by AUDITED against all, and the share of
    them that was found; no share where there are no links."""
    key = F.size("v").cast("long").alias("key")
    asked = classes.filter("asked").select(key, "cid", "copies", "v", F.lit(False).alias("both"))
    true = _compared(asked, classes.select(key, "cid", "copies", "v"), threshold).groupBy("cid").agg(F.sum("pairs").alias("n")).filter("n > 0")
    got = found.groupBy("cid").agg(F.sum("pairs").alias("pairs"))
    r = true.join(got.hint("merge"), "cid", "left").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("pairs", F.lit(0)))).alias("m")).first()
    return (r.n, r.m / r.n) if r.n else (0, None)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, shard: int = SHARD, cells: int = CELLS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, recall, audited_links.

    recall is the share of the links of the audited ids that was found, null where these have none (audited_links is
    then 0). Vectors that are null, zero or hold null or non-finite components link with nothing and are components of
    their own; vectors of different lengths never link. Rows repeated under one id are vectors of their own. A null id
    takes no part in component_id (null if no member has one) and is not kept. An empty table gives an empty result."""
    spark = vectors.sparkSession
    small_batches(spark)
    kind = vectors.schema[embedding].dataType.simpleString()
    v = F.col(embedding) if kind in ("array<float>", "array<double>") else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v"))
    good = rows.filter(usable(F.col("v"))).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), F.col("v"))})
    grouped = good.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.any_value("v").alias("v"), F.max(F.coalesce(F.pmod("vec_id", F.lit(AUDITED)) == 0, F.lit(False))).alias("asked"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    n = classes.count()
    if not n:
        alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return alone.select("vec_id", "n_links", "component_id", F.col("vec_id").isNotNull().alias("kept"), F.lit(None).cast("double").alias("recall"), F.lit(0).cast("long").alias("audited_links"))
    plain = classes.select("cid", "copies", "v")
    loose, dense = _balls(plain, n, threshold)
    dense = [_summed(dense)] if dense else []
    loose = materialize(loose, "vector-loose") if dense else loose
    for tried in (cells, WIDER):
        found = _summed([*dense, _graph_links(loose, threshold, shard, tried)]) if not loose.isEmpty() else dense[0]
        audited, recall = _audit(classes, found, threshold)
        if recall is None or recall >= RECALL:
            break
    else:
        key = F.size("v").cast("long").alias("key")
        found = _summed([_compared(plain.select(key, "cid", "copies", "v", F.lit(False).alias("both")), plain.select(key, "cid", "copies", "v"), threshold)])
        audited, recall = _audit(classes, found, threshold)
    of = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")).filter("a != b")).withColumnRenamed("node", "cid")
    sums = found.groupBy("cid").agg(F.sum("links").alias("links"))
    rooted = materialize(
        classes.select("cid", "copies", "first", "h1", "h2").join(sums.hint("merge"), "cid", "left").join(of.hint("merge"), "cid", "left")
        .select("copies", "first", "h1", "h2", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root")),
        "vector-rooted",
    )
    least = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "vector-least")
    named = materialize(rooted.join(least.hint("merge"), "root").select("h1", "h2", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-named")
    drop_files(classes)
    drop_files(found)
    narrow = materialize(good.select("vec_id", "h1", "h2"), "vector-ids")
    linked = narrow.join(named.hint("merge"), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"),
        F.lit(recall).cast("double").alias("recall"), F.lit(audited).cast("long").alias("audited_links"),
    )


def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of all vectors, with the audit's; an empty table gives no rows."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
