"""Whitening of embeddings by a one-sided Jacobi SVD.

Entries become whole numbers, and each distinct vector counts once: the fit list. Tasks centre their rows of it and
compress them block by block to a triangle R (a tall-skinny QR); triangles are stacked and compressed again in a tree until
one is left, whose size is the square of the dimension. Plane rotations make R's columns orthogonal: their norms are the
standard deviations times the root of the list's length, accurate also where they are small, and the accumulated
rotations are the components. No covariance matrix is ever formed, but to audit the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import drop_files, materialize, small_batches, table

#: Entries are counted in steps of 1 / FACTOR; components returned; triangles stacked in one task; rows of one block.
FACTOR, COMPONENTS, STACKED, BLOCK = 256, 4, 32, 1024
#: Entries whose step number is beyond this have no exact place and drop their vector, as non-finite ones do.
LARGEST = 1 << 52
#: A standard deviation below this share of the largest, times the dimension, is rounding and counts as none.
_NOTHING = 8 * np.finfo(np.float64).eps


def steps(v: Column, factor: int = FACTOR) -> Column:
    """The entries of a vector as whole steps (array<bigint>); null if it is null or empty or an entry has no step."""
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float(LARGEST // factor))))
    return F.when(v.isNotNull() & (F.size(v) > 0) & fine, F.transform(v, lambda c: F.floor(c.cast("double") * factor) + F.lit(0)))


def jacobi_svd(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of r: planes are rotated, half as many at once as
    there are columns, until all pairs of columns are orthogonal to working precision."""
    d = r.shape[1]
    first = np.argsort(-np.einsum("ij,ij->j", r, r), kind="stable")
    a, v = r[:, first].copy(), np.eye(d)[:, first]
    even = d + d % 2
    small = np.sqrt(max(len(r), 1)) * np.finfo(np.float64).eps
    ring = np.arange(even)
    for _ in range(sweeps):
        turned = False
        for _ in range(even - 1):
            p, q = ring[: even // 2], ring[even // 2 :][::-1]
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < d], q[q < d]
            ap, aq = a[:, p], a[:, q]
            pp, qq, pq = (np.einsum("ij,ij->j", x, y) for x, y in ((ap, ap), (aq, aq), (ap, aq)))
            turn = np.abs(pq) > small * np.sqrt(pp) * np.sqrt(qq)
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            if not turn.any():
                continue
            turned = True
            p, q, ap, aq, pp, qq, pq = p[turn], q[turn], ap[:, turn], aq[:, turn], pp[turn], qq[turn], pq[turn]
            zeta = (qq - pp) / (2 * pq)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if not turned:
            break
    norm = np.sqrt(np.einsum("ij,ij->j", a, a))
    order = np.argsort(-norm, kind="stable")
    v = v[:, order]
    return norm[order], v / np.linalg.norm(v, axis=0)


def _by_length(x: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    sizes = x.map(len).to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, np.stack([np.asarray(v, np.int64) for v in x.iloc[at]])


def _offsets(x: np.ndarray, n: int, s: list[int]) -> np.ndarray | None:
    """n*x - s in whole numbers, if they fit in 63 bits."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, s))
    return n * x - np.array(s, np.int64) if most < 1 << 63 else None


def _centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    whole = _offsets(x, n, s)
    return whole / n if whole is not None else x - np.array([a / n for a in s])


def squares(x: np.ndarray, n: int, s: list[int]) -> list[int]:
    """The exact sum over dimensions of (n*x - s)^2 of each row."""
    whole = _offsets(x, n, s)
    if whole is None:
        return [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x.tolist()]
    whole = np.abs(whole)
    if x.shape[1] * int(whole.max(initial=0)) ** 2 < 1 << 63:
        return (whole * whole).sum(1).tolist()
    low, mid, high = (whole >> k & 0x1FFFFF for k in (0, 21, 42))  # three parts of 21 bits: their products sum without overflow
    parts = [(low * low).sum(1), 2 * (low * mid).sum(1), (mid * mid).sum(1) + 2 * (low * high).sum(1), 2 * (mid * high).sum(1), (high * high).sum(1)]
    return [sum(p << 21 * k for k, p in enumerate(row)) for row in zip(*(p.tolist() for p in parts), strict=True)]


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got: dict[int, tuple[int, list[int]]] = {}
    for g in batches:
        for d, _, x in _by_length(g["x"]):
            n, s = got.get(d, (0, [0] * d))
            high, low = (x >> 26).sum(0).tolist(), (x & 0x3FFFFFF).sum(0).tolist()
            got[d] = n + len(x), [a + (h << 26) + b for a, h, b in zip(s, high, low, strict=True)]
    for d, (n, s) in got.items():
        yield pd.DataFrame({"d": d, "place": range(d), "n": n, "s": [Decimal(a) for a in s]})


def _packed(d: int, node: int, r: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"d": [d], "node": [node], "r": [np.ascontiguousarray(r, np.float64).tobytes()]})


def _stacked(g: pd.DataFrame) -> np.ndarray:
    d = int(g["d"].iat[0])
    return np.linalg.qr(np.concatenate([np.frombuffer(r, np.float64).reshape(-1, d) for r in g.sort_values("node")["r"]]), mode="r")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, factor: int = FACTOR) -> DataFrame:
    """For each vector with steps and each component up to components (or its length, if less): vec_id, component (int,
    from 1 by falling eigenvalue), n (long), deviation (decimal(38,0), exact; null beyond it), whitened, explained and
    identity_error (double).

    Vectors that are null or empty or hold null, non-finite or (from 2^44 on) unplaceable entries give no rows. Vectors of
    each length are whitened by themselves. Repeated rows are each returned and count once in the fit; a null vec_id is
    returned as it is. A component without variance has explained 0 and whitened null and stays out of identity_error
    (0 if all are such). Equal eigenvalues come in any order. Other columns are not read; an empty table gives an empty
    result. The driver holds, for each length, its sums and that many components."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), steps(F.col(embedding), factor).alias("x")).filter("x is not null")
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    sums: dict[int, tuple[int, list[int]]] = {}
    told = fit.mapInPandas(_sums, "d int, place int, n long, s decimal(38,0)").groupBy("d", "place").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    for r in told.orderBy("d", "place").collect():  # a row for each dimension
        sums.setdefault(r.d, (r.n, []))[1].append(int(r.s))
    held = spark.sparkContext.broadcast(sums)

    def triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r: dict[int, np.ndarray] = {}
        for g in batches:
            for d, _, x in _by_length(g["x"]):
                for at in range(0, len(x), max(BLOCK, d)):
                    block = _centred(x[at : at + max(BLOCK, d)], *held.value[d])
                    r[d] = np.linalg.qr(np.concatenate([r[d], block]) if d in r else block, mode="r")
        for d, t in r.items():
            yield _packed(d, TaskContext.get().partitionId(), t)

    def combine(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return _packed(int(key[0]), int(key[1]), _stacked(g))

    def rotate(g: pd.DataFrame) -> pd.DataFrame:
        d, r = int(g["d"].iat[0]), _stacked(g)
        norm, v = jacobi_svd(r)
        variance = np.where(norm > _NOTHING * d * norm[0], norm * norm / held.value[d][0], 0.0)
        k = min(components, d)
        return pd.DataFrame({"d": [d], "trace": [float(variance.sum())], "e": [variance[:k].tolist()], "v": [v[:, :k].T.ravel().tolist()]})

    tree = materialize(fit.mapInPandas(triangles, "d int, node long, r binary"), "whitening-triangles")
    least = lambda: tree.agg(F.max("node")).first()[0] or 0
    while least() >= STACKED:
        tree = materialize(tree.withColumn("node", F.floor(F.col("node") / STACKED)).groupBy("d", "node").applyInPandas(combine, "d int, node long, r binary"), "whitening-triangles")
    model = {
        r.d: (*sums[r.d], r.trace, np.array(r.e), np.array(r.v).reshape(len(r.e), r.d))
        for r in tree.groupBy("d").applyInPandas(rotate, "d int, trace double, e array<double>, v array<double>").collect()  # a row for each length
    }
    shared = spark.sparkContext.broadcast(model)

    def projected(d: int, x: np.ndarray) -> np.ndarray:
        n, s, _, e, v = shared.value[d]
        return _centred(x, n, s) @ v.T / np.where(e > 0, np.sqrt(e), np.nan)

    def audited(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for d, _, x in _by_length(g["x"]):
                w = projected(d, x)
                w = np.pad(np.where(np.isnan(w), 0.0, w), ((0, 0), (0, components - w.shape[1])))
                yield pd.DataFrame(w, columns=[f"w{i}" for i in range(components)]).assign(d=d)

    pairs = list(combinations_with_replacement(range(components), 2))
    covariance = fit.mapInPandas(audited, ", ".join(f"w{i} double" for i in range(components)) + ", d int").groupBy("d")
    error = {}
    for r in covariance.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).collect():  # a row for each length
        some = set(np.flatnonzero(model[r.d][3] > 0).tolist())
        error[r.d] = max((abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if {i, j} <= some), default=0.0)
    drop_files(fit)
    errors = spark.sparkContext.broadcast(error)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def told_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for d, at, x in _by_length(g["x"]):
                n, s, trace, e, _ = shared.value[d]
                w, k = projected(d, x), len(e)
                deviation = [Decimal(a) if a < 10**38 else None for a in squares(x, n, s)]
                yield pd.DataFrame({
                    "vec_id": g["vec_id"].iloc[at].repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": n,
                    "deviation": [a for a in deviation for _ in range(k)], "whitened": [None if np.isnan(a) else a for a in w.ravel().tolist()],
                    "explained": np.tile(e / trace if trace else e, len(x)), "identity_error": errors.value[d],
                })

    # ids travel as text where pandas would turn a null among them into a fraction
    named = rows.select(F.col("vec_id").cast("string").alias("vec_id"), "x")
    out = named.mapInPandas(told_of, "vec_id string, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumn("vec_id", F.col("vec_id").cast(kind))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; deviation is null where it does not fit in 64 bits (its exact value is in whiten()). An
    empty table gives no rows."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
