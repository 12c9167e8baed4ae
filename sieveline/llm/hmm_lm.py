"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by scaled recursion.

In the first passes latent states emit word classes: the TOP most frequent tokens and the end are classes of their own,
other known tokens share BUCKETS classes by a hash. States start from the neighbourhoods of the most frequent classes,
counted over all training texts: classes that stand beside the same classes begin in one state. Each pass runs over every
training text, cut into windows, and only sums of states by classes come to the driver.

The last pass gathers what every token does: rows (token, expected count in each state), summed by Spark, as many as there
are tokens in the training texts. From these every known token has emission probabilities of its own, so the model is a
distribution over known tokens and `unknown`. Those of the HEAD most frequent tokens are broadcast (a documented bound);
all others reach their documents by a join. Scores are exact: no window, no beam; of long texts the transfer matrices of
segments are multiplied.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm.common import drop_files, fold, materialize, small_batches, table

STATES, TOP, BUCKETS, HEAD = 8, 4000, 1024, 200_000
#: Classes whose neighbourhoods start the states, how much a state prefers its own; Baum-Welch passes over all training
#: texts, the last of which gathers every token.
NEIGHBOURS, PREFERS, PASSES = 512, 8.0, 3
#: Tokens in a training window, and in a segment of the exact recursion over long texts.
WINDOW, SEGMENT = 256, 512
#: Counts that a state borrows from the corpus as a whole; occurrences in all states that a token borrows.
SMOOTH, BORROWED = 200.0, 0.5
ADD = 0.1
UNKNOWN, END, FIRST = 0, 1, 2
FLUSH = 400_000


def words(text: str | None) -> list[bytes]:
    """The tokens but the end: lower-cased (A-Z) runs without U+0020 and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def token_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Rows (token, c) of a text column, counted in each task before the shuffle."""

    def rows(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], ["token", "c"])

    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(words(t))
                if len(c) > FLUSH:
                    yield rows(c)
                    c = Counter()
        yield rows(c)

    return texts.select(F.col(text).alias("t")).mapInArrow(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _bucket(token: bytes, buckets: int) -> int:
    h = xxhash.xxh64_intdigest(token, seed=42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


class _Head(dict):
    def __missing__(self, token):
        return -1


class Vocabulary:
    """Of the corpus: sizes, the head's tokens with their classes. A text is coded as places of head tokens, then the
    end, then the tail's buckets."""

    def __init__(self, n: int, v: int, docs: int, singles: int, head: list[tuple[str, int]], mass: np.ndarray, top: int):
        self.n, self.v, self.docs = n, v, docs
        self.buckets = len(mass)
        self.z = n + ADD * (v + 1)
        #: what unknown tokens get: the part that tokens seen once have of all (Good-Turing), or all of it
        self.unknown = 1.0 if n == 0 else min(0.5, max(ADD / self.z, singles / n))
        self.tokens = [t.encode("utf-8") for t, _ in head]
        self.end = len(head)
        self.c = np.array([*(x for _, x in head), docs], np.float64)
        self.base = np.log10((self.c + ADD) / self.z)
        bucket = np.array([_bucket(t, self.buckets) for t in self.tokens], np.int64)
        own = np.arange(len(head)) < top
        #: the class of each place of a code
        self.cls = np.concatenate([np.where(own, FIRST + np.arange(len(head)), FIRST + top + bucket), [END], FIRST + top + np.arange(self.buckets)]).astype(np.int64)
        share = np.zeros(FIRST + top + self.buckets)
        share[END] = docs + ADD if docs else 0.0
        share[FIRST : FIRST + min(top, len(head))] = (self.c[:-1] + ADD)[:top]
        share[FIRST + top :] = mass
        total = share.sum()
        #: the corpus's distribution over classes
        self.prior = share / total * (1 - self.unknown) if total else share
        self.prior[UNKNOWN] = self.unknown

    def index(self) -> _Head:
        if not hasattr(self, "_index"):
            self._index = _Head((t, i) for i, t in enumerate(self.tokens))
        return self._index

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_index"}


def _frequent(counts: DataFrame, head: int) -> tuple[DataFrame, float | None]:
    """The rows of counts from a cut on that at most head tokens reach, by a histogram of their logarithms."""
    place = F.floor(F.log2("c") * 16)
    bins = {r.b: r.n for r in counts.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each sixteenth of a power of two
    least, room = None, head
    for b in sorted(bins, reverse=True):
        room -= bins[b]
        if room < 0:
            break
        least = b
    return (counts.filter(place >= least) if least is not None else counts.limit(0)), least


def vocabulary(counts: DataFrame, docs: int, head: int = HEAD, top: int = TOP, buckets: int = BUCKETS) -> Vocabulary:
    """From materialized token counts and the number of training documents. To the driver come sizes, the head tokens
    and one number per bucket."""
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("s")).first()
    found = _frequent(counts, head)[0].select("token", "c").toArrow()
    first = sorted(zip(found["token"].to_pylist(), found["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    mass = np.zeros(buckets)
    for r in counts.groupBy(F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("b")).agg(F.sum(F.col("c") + ADD).alias("m")).collect():
        mass[r.b] = r.m
    for t, c in first[:top]:
        mass[_bucket(t.encode("utf-8"), buckets)] -= c + ADD
    mass = np.where(mass < ADD / 2, 0.0, mass)
    return Vocabulary((whole.n or 0) + docs, whole.v + (docs > 0), docs, whole.s or 0, first, mass, top)


# the chain -------------------------------------------------------------------------------------------------------


def _padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences, longest first, as columns of one array; how many are alive at each step."""
    seqs = sorted(seqs, key=len, reverse=True)
    n = np.array([len(s) for s in seqs])
    x = np.zeros((n[0], len(seqs)), np.int64)
    for j, s in enumerate(seqs):
        x[: len(s), j] = s
    return x, len(n) - np.searchsorted(n[::-1], np.arange(n[0]), side="right")


class Chain:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: class by state

    def counts(self, seqs: list[np.ndarray], fresh: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of windows; those that are not fresh go on inside a text and start from
        the long-run states."""
        return self.states(seqs, fresh)[:3]

    def states(self, seqs: list[np.ndarray], fresh: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """counts, the probabilities of states (step, window, state), and the order of the windows there."""
        k = len(self.start)
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        x, alive = _padded(seqs)
        fresh_of = np.array([fresh[i] for i in order])
        run = np.linalg.matrix_power(self.move, 64)[0]
        steps, n = x.shape
        alpha = np.zeros((steps, n, k))
        a = np.where(fresh_of[:, None], self.start, run) * self.emit[x[0]]
        alpha[0] = a / a.sum(1, keepdims=True)
        for t in range(1, steps):
            m = alive[t]
            a = (alpha[t - 1, :m] @ self.move) * self.emit[x[t, :m]]
            alpha[t, :m] = a / a.sum(1, keepdims=True)
        moves, ends = np.zeros((k, k)), np.zeros((len(self.emit), k))
        beta = np.ones((n, k))
        gamma = alpha.copy()
        for t in range(steps - 2, -1, -1):
            m = alive[t + 1]
            after = self.emit[x[t + 1, :m]] * beta[:m]
            before = after @ self.move.T
            norm = (alpha[t, :m] * before).sum(1, keepdims=True)
            moves += alpha[t, :m].T @ (after / norm)
            g = alpha[t, :m] * before / norm
            gamma[t, :m] = g
            beta[:m] = before / before.sum(1, keepdims=True)
        there = np.arange(n)[None, :] < alive[:, None]
        flat = x[there]
        for s in range(k):
            ends[:, s] = np.bincount(flat, gamma[..., s][there], len(self.emit))
        return gamma[0][fresh_of].sum(0), moves * self.move, ends, gamma, order

    def log10(self, seqs: list[np.ndarray]) -> np.ndarray:
        """The exact log10 probability of each sequence."""
        out = np.zeros(len(seqs))
        short = [i for i, s in enumerate(seqs) if len(s) <= SEGMENT]
        if short:
            order = sorted(short, key=lambda i: -len(seqs[i]))
            x, alive = _padded([seqs[i] for i in order])
            a = self.start * self.emit[x[0]]
            total = np.zeros(len(order))
            for t in range(len(x)):
                m = alive[t]
                if t:
                    a = (a[:m] @ self.move) * self.emit[x[t, :m]]
                c = a.sum(1)
                total[:m] += np.log10(c)
                a = a / c[:, None]
            out[order] = total
        # a long text: the first token, then a product of transfer matrices, one for each segment
        parts = [(i, s[at : at + SEGMENT]) for i, s in enumerate(seqs) if len(s) > SEGMENT for at in range(1, len(s), SEGMENT)]
        if parts:
            order = sorted(range(len(parts)), key=lambda j: -len(parts[j][1]))
            x, alive = _padded([p for _, p in parts])
            k = len(self.start)
            m, scale = np.tile(np.eye(k), (len(parts), 1, 1)), np.zeros(len(parts))
            for t in range(len(x)):
                n = alive[t]
                m[:n] = (m[:n] @ self.move) * self.emit[x[t, :n]][:, None, :]
                if t % 8 == 7 or t == len(x) - 1:
                    c = m[:n].max((1, 2))
                    m[:n] /= c[:, None, None]
                    scale[:n] += np.log10(c)
            at = {j: pos for pos, j in enumerate(order)}
            state: dict[int, np.ndarray] = {}
            for j, (i, _) in enumerate(parts):
                if i not in state:
                    a = self.start * self.emit[seqs[i][0]]
                    out[i], state[i] = np.log10(a.sum()), a / a.sum()
                a = state[i] @ m[at[j]]
                c = a.sum()
                out[i] += np.log10(c) + scale[at[j]]
                state[i] = a / c
        return out


def maximized(start: np.ndarray, moves: np.ndarray, ends: np.ndarray, prior: np.ndarray, smooth: float = SMOOTH) -> Chain:
    """The M step, with counts borrowed from the corpus's class distribution; unknown keeps its part in every state."""
    k = len(start)
    ends = ends.copy()
    ends[UNKNOWN] = 0
    known = prior.copy()
    known[UNKNOWN] = 0
    left = max(0.0, 1 - prior[UNKNOWN])
    rest = known / known.sum() if known.sum() else known
    emit = (ends + smooth * rest[:, None]) / (ends.sum(0) + smooth) * left
    emit[UNKNOWN] = prior[UNKNOWN]
    return Chain((start + 1.0) / (start.sum() + k), (moves + 1.0) / (moves.sum(1, keepdims=True) + k), emit)


def windows(seq: np.ndarray, size: int = WINDOW) -> tuple[list[np.ndarray], list[bool]]:
    return [seq[i : i + size] for i in range(0, len(seq), size)], [i == 0 for i in range(0, len(seq), size)]


def _e_step(chain: Chain, seqs: list[np.ndarray], most: int = 2048):
    """Summed counts of many sequences, so many windows at a time."""
    parts, fresh = [], []
    for s in seqs:
        p, f = windows(s)
        parts += p
        fresh += f
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    total = None
    for at in range(0, len(order), most):
        some = order[at : at + most]
        got = chain.counts([parts[i] for i in some], [fresh[i] for i in some])
        total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
    return total


def _e_tokens(chain: Chain, seqs: list[np.ndarray], classes: list[np.ndarray], pos: np.ndarray, first_of: np.ndarray, size: int, most: int = 2048):
    """Expected starts, moves and, of codes below size, states; and the states of the tail's tokens, which lie at pos,
    those of text d from first_of[d] on."""
    parts, fresh, at = [], [], []
    for d, c in enumerate(classes):
        p, f = windows(c)
        parts += p
        fresh += f
        at += [(d, i) for i in range(0, len(c), WINDOW)]
    k = len(chain.start)
    start, moves, known, probs = np.zeros(k), np.zeros((k, k)), np.zeros((size, k)), np.zeros((len(pos), k))
    by_length = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    for first in range(0, len(by_length), most):
        some = by_length[first : first + most]
        s, m, _, gamma, order = chain.states([parts[i] for i in some], [fresh[i] for i in some])
        start += s
        moves += m
        there = np.arange(len(gamma))[None, :] < np.array([len(parts[some[i]]) for i in order])[:, None]
        g = gamma.transpose(1, 0, 2)[there]  # window by window
        code = np.concatenate([seqs[d][i : i + WINDOW] for d, i in (at[some[j]] for j in order)])
        head = code < size
        for z in range(k):
            known[:, z] += np.bincount(code[head], g[head, z], size)
        if len(pos):
            places = []
            for d, i in (at[some[j]] for j in order):
                own = pos[first_of[d] : first_of[d + 1]]
                low, high = np.searchsorted(own, (i, i + WINDOW)) if len(own) else (0, 0)
                places.append(np.arange(first_of[d] + low, first_of[d] + high))
            probs[np.concatenate(places)] = g[~head]
    return start, moves, known, probs


def started(beside: np.ndarray, places: np.ndarray, prior: np.ndarray, states: int = STATES, seed: int = 7) -> Chain:
    """States from how often the classes at places stand beside each other: the classes are clustered by whom they stand
    beside (more often than chance), and a state prefers those of its cluster."""
    rng = np.random.default_rng(seed)
    both = beside + beside.T + 0.5
    share = both.sum(1)
    lift = np.maximum(0.0, np.log(both * both.sum() / np.outer(share, share)))
    u, size, _ = np.linalg.svd(lift)
    x = u[:, : 2 * states] * np.sqrt(size[: 2 * states])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = [x[int(share.argmax())]]
    while len(centres) < min(states, len(x)):  # the farthest from those taken
        centres.append(x[int((x @ np.array(centres).T).max(1).argmin())])
    c = np.array(centres)
    for _ in range(20):
        of = (x @ c.T).argmax(1)
        c = np.stack([x[of == i].mean(0) if (of == i).any() else x[rng.integers(len(x))] for i in range(len(c))])
    emit = np.tile(prior[:, None], (1, states))
    for i in range(states):
        emit[places, i] *= np.where(of == i, PREFERS, 1 / PREFERS)
    emit[UNKNOWN] = 0
    emit = emit / np.maximum(emit.sum(0), 1e-300) * (1 - prior[UNKNOWN])
    emit[UNKNOWN] = prior[UNKNOWN]
    stay = np.full((states, states), 0.3 / max(1, states - 1)) + np.eye(states) * (0.7 - 0.3 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    return Chain(np.full(states, 1 / states), stay, emit)


def _codes(column) -> list[np.ndarray]:
    return [np.frombuffer(s, np.int32).astype(np.int64) for s in column]


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Sparse sums (i, v) of tasks as one array; they come to the driver as Arrow columns, not as rows."""
    got = parts.groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def neighbourhoods(rows: DataFrame, vocab: Vocabulary, places: np.ndarray) -> np.ndarray:
    """How often the classes at places stand directly beside each other, over all rows of coded texts (seq)."""
    n = len(places)
    local = np.full(len(vocab.prior), n)
    local[places] = np.arange(n)
    told = rows.sparkSession.sparkContext.broadcast(local[vocab.cls])

    def count(batches):
        sums, between = np.zeros((n + 1) * (n + 1)), np.array([n])
        for b in batches:
            x = np.concatenate([y for s in _codes(b["seq"]) for y in (told.value[s], between)])
            sums += np.bincount(x[:-1] * (n + 1) + x[1:], minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"i": at, "v": sums[at]})

    out = _summed(rows.mapInPandas(count, "i long, v double"), (n + 1) * (n + 1))
    return out.reshape(n + 1, n + 1)[:n, :n]


def trained(rows: DataFrame, vocab: Vocabulary, states: int = STATES, passes: int = PASSES) -> tuple[Chain, DataFrame, np.ndarray]:
    """Baum-Welch over coded training texts (seq, tail_pos, tail_token): the chain (its start and moves), materialized
    rows (token, c, g0, g1, ...: the count and expected counts by state, the last of which is what the others leave) of the tail, and the states' expected counts of
    the head and the end. Each task sums its expected counts, Spark sums the tasks'."""
    spark, prior = rows.sparkSession, vocab.prior
    places = np.argsort(-np.where(np.arange(len(prior)) == UNKNOWN, -1, prior), kind="stable")[: min(NEIGHBOURS, max(1, len(prior) - 1))]
    chain = started(neighbourhoods(rows.select("seq"), vocab, places), places, prior, states)
    k, c = states, len(prior)
    told = spark.sparkContext.broadcast(vocab)
    for _ in range(passes - 1):
        held = spark.sparkContext.broadcast(chain)

        def e_step(batches, held=held):
            total = None
            for b in batches:
                got = _e_step(held.value, [told.value.cls[s] for s in _codes(b["seq"])])
                if got is not None:
                    total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
            if total is not None:
                v = np.concatenate([x.ravel() for x in total])
                at = np.flatnonzero(v > 1e-12)
                yield pd.DataFrame({"i": at, "v": v[at]})

        v = _summed(rows.select("seq").mapInPandas(e_step, "i long, v double"), k + k * k + c * k)
        chain = maximized(v[:k], v[k : k + k * k].reshape(k, k), v[k + k * k :].reshape(c, k), prior)
        held.unpersist()
    held = spark.sparkContext.broadcast(chain)
    columns = [f"g{i}" for i in range(k)]

    names = ["token", "kind", "c", *columns]

    def table(token, kind: int, c, values: np.ndarray) -> pa.RecordBatch:
        n = len(values)
        return pa.RecordBatch.from_arrays([token, pa.array(np.full(n, kind, np.int32)), pa.array(np.broadcast_to(np.asarray(c, np.int64), n)), *(pa.array(values[:, i].astype(np.float32)) for i in range(k))], names=names)

    def gather(batches):
        vocab, size = told.value, told.value.end + 1
        start, moves, known = np.zeros(k), np.zeros((k, k)), np.zeros((size, k))
        for b in batches:
            seqs, pos, tokens = _codes(b.column(0).to_pylist()), b.column(1), b.column(2).flatten()
            first_of = np.concatenate([[0], np.cumsum(pos.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            s, m, kn, probs = _e_tokens(held.value, seqs, [vocab.cls[x] for x in seqs], pos.flatten().to_numpy(zero_copy_only=False).astype(np.int64), first_of, size)
            start, moves, known = start + s, moves + m, known + kn
            if len(tokens):
                t = pa.table([tokens, *(pa.array(probs[:, i]) for i in range(k))], names=["token", *columns]).group_by("token").aggregate([([], "count_all"), *((x, "sum") for x in columns)]).combine_chunks()
                for part in t.to_batches():
                    values = np.stack([part.column(f"{x}_sum").to_numpy() for x in columns], 1)
                    values[:, -1] = 0  # is what the count and the others leave, so it needn't be shuffled
                    yield table(part.column("token"), 0, part.column("count_all").to_numpy(), values)
        at = np.flatnonzero(known.sum(1) > 0)
        yield table(pa.array([str(i) for i in at], pa.string()), 1, 0, known[at])
        yield table(pa.array([str(i) for i in range(k + 1)], pa.string()), 2, 0, np.vstack([start, moves]))

    schema = "token string, kind int, c long, " + ", ".join(f"{x} float" for x in columns)  # a task's sums, not cut but to a float's precision
    made = rows.select("seq", "tail_pos", "tail_token").mapInArrow(gather, schema)
    gathered = materialize(made.groupBy("kind", "token").agg(F.sum("c").alias("c"), *(F.sum(x).cast("float").alias(x) for x in columns)), "hmm-gathered")
    few = gathered.filter("kind > 0").select("kind", F.col("token").cast("int").alias("at"), *columns).toArrow()  # the head, the end, the starts and the moves
    kind, at = few["kind"].to_numpy(), few["at"].to_numpy()
    values = np.stack([few[x].to_numpy() for x in columns], 1) if len(at) else np.zeros((0, k))
    known, rest = np.zeros((vocab.end + 1, k)), np.zeros((k + 1, k))
    known[at[kind == 1]] = values[kind == 1]
    rest[at[kind == 2]] = values[kind == 2]
    last = maximized(rest[0], rest[1:], np.zeros((c, k)), prior)
    left = F.greatest(F.lit(0.0), F.col("c") - sum((F.col(x).cast("double") for x in columns[:-1]), F.lit(0.0)))
    return Chain(last.start, last.move, chain.emit), gathered.filter("kind = 0").drop("kind").withColumn(columns[-1], left), known


def coded(docs: DataFrame, vocab: Vocabulary, held_out: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Materialized rows: carry, rid, held_out, n_words, seq (32-bit places of a code, the end last), the head's base sum
    and the tail's tokens with their places."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocab)

    made = "n_words long, seq binary, base double, tail_pos array<int>, tail_token array<string>"

    def encode(batches):
        v = held.value
        get = v.index().__getitem__
        for b in batches:
            seqs, base, places, rare, n = [], [], [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                w = words(t)
                at = np.fromiter(map(get, w), np.int32, len(w))
                seq = np.append(at, np.int32(v.end))
                tail = np.flatnonzero(at < 0)
                if len(tail):
                    own = [w[i] for i in tail]
                    seq[tail] = [v.end + 1 + _bucket(x, v.buckets) for x in own]
                    rare += own
                places.append(tail)
                n.append(len(w))
                seqs.append(seq.astype(np.int32).tobytes())
                base.append(float(v.base[at[at >= 0]].sum() + v.base[v.end]))
            cut = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32))
            pos = pa.ListArray.from_arrays(cut, pa.array(np.concatenate(places).astype(np.int32) if places else np.zeros(0, np.int32)))
            tokens = pa.ListArray.from_arrays(cut, pa.array(rare, pa.binary()).cast(pa.string()))
            out = [*b.columns[:-1], pa.array(n, pa.int64()), pa.array(seqs, pa.binary()), pa.array(base, pa.float64()), pos, tokens]
            yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names[:-1], *(c.split()[0] for c in made.split(", "))])

    given = docs.select(*(carry or []), F.col(held_out).alias("held_out"), F.monotonically_increasing_id().alias("rid"), F.col(text).alias("_text"))
    schema = T.StructType([*given.schema.fields[:-1], *T._parse_datatype_string(made).fields])
    return materialize(given.mapInArrow(encode, schema), "hmm-coded", "zstd")


class Emissions:
    """Emission probabilities of tokens. Of its occurrences a token has those that were expected in each state, and
    BORROWED more in all states alike, so that what was met once is not bound to one state; a state emits tokens in
    proportion to what it has of them."""

    def __init__(self, part: np.ndarray, left: float):
        self.part, self.left, self.totals = part, left, np.ones(len(part))

    def weights(self, g: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c + ADD) / (c + BORROWED))[:, None] * (g + BORROWED * self.part)

    def of(self, g: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of counts by state (token, state) and whole counts."""
        return self.weights(g, c) / self.totals * self.left


def score_documents(docs: DataFrame, held_out: str, doc_id: str = "doc_id", text: str = "text", states: int = STATES, passes: int = PASSES, head: int = HEAD, top: int = TOP, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens (with the end), n_known, train_tokens, base_score, score.

    Learned from rows whose column held_out is false. A null text is empty and has its end alone. If there is nothing
    to learn from, every token is unknown, of probability 1. Repeated rows score alike; an empty table gives none."""
    spark = docs.sparkSession
    small_batches(spark)
    train = docs.filter(~F.col(held_out))
    counts = materialize(token_counts(train, text), "hmm-counts")
    vocab = vocabulary(counts, train.count(), head, top, buckets)
    rows = coded(docs, vocab, held_out, text, [F.col(doc_id).alias("doc_id")])
    k, columns = states, [f"g{i}" for i in range(states)]
    if not vocab.n:
        known, model = counts.select("token", "c", F.array().cast("array<float>").alias("g")), None
    else:
        chain, gathered, held = trained(rows.filter(~F.col("held_out")), vocab, states, passes)
        drop_files(counts)
        known = gathered.select("token", "c", F.array(*(F.col(x).cast("float") for x in columns[:-1])).cast("array<float>").alias("g"))
        summed = lambda *of: np.array([r or 0.0 for r in gathered.agg(*(F.sum(x) for x in of)).first()])  # noqa: E731  one number a state
        by_state = summed(*columns) + held.sum(0)
        emissions = Emissions(by_state / by_state.sum(), 1 - vocab.unknown)
        weight = [(F.col("c") + ADD) / (F.col("c") + BORROWED) * (F.col(x) + BORROWED * emissions.part[i]) for i, x in enumerate(columns)]
        emissions.totals = summed(*weight) + emissions.weights(held, vocab.c).sum(0)
        table = np.vstack([emissions.of(held, vocab.c), np.full((1, k), vocab.unknown)])  # head tokens, the end, unknown
        model = spark.sparkContext.broadcast((Chain(chain.start, chain.move, table), emissions, vocab.end))
    tail = rows.select("rid", F.explode(F.arrays_zip("tail_pos", "tail_token")).alias("t")).select("rid", F.col("t.tail_pos").alias("pos"), F.col("t.tail_token").alias("token"))
    met = tail.join(known.hint("merge"), "token", "left")
    sums = met.groupBy("rid").agg(
        F.sum(F.log10((F.coalesce("c", F.lit(0)) + ADD) / vocab.z)).alias("tail_base"), F.count_if(F.col("c").isNull()).alias("n_unknown"),
        F.collect_list(F.struct("pos", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("g", F.array().cast("array<float>")).alias("g"))).alias("tail"),  # the tail of one text
    )
    sums = sums.select("rid", "tail_base", "n_unknown", F.col("tail.pos").alias("tail_pos"), F.col("tail.c").alias("tail_c"), F.flatten("tail.g").alias("tail_g"))
    both = rows.drop("tail_pos", "tail_token").join(sums.hint("merge"), "rid", "left")

    @F.pandas_udf("double")
    def likelihood(seq: pd.Series, pos: pd.Series, c: pd.Series, g: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(seq)))
        whole, emissions, last = model.value
        seqs, extra, n = _codes(seq), [], last + 2
        for s, p, cs, gs in zip(seqs, pos, c, g, strict=True):
            if p is None or not len(p):
                continue
            p, cs = np.asarray(p, np.int64), np.asarray(cs, np.float64)
            s[p] = last + 1
            seen = cs > 0
            if seen.any():
                most = np.asarray(gs, np.float64).reshape(int(seen.sum()), k - 1)
                whole_g = np.concatenate([most, np.maximum(0.0, cs[seen][:, None] - most.sum(1, keepdims=True))], 1)
                extra.append(emissions.of(whole_g, cs[seen]))
                s[p[seen]] = n + np.arange(seen.sum())
                n += int(seen.sum())
        return pd.Series(Chain(whole.start, whole.move, np.vstack([whole.emit, *extra])).log10(seqs))

    zero = F.lit(0.0)
    end_known = 1 if vocab.docs else 0
    return both.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_words") + end_known - F.coalesce("n_unknown", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"),
        likelihood(F.col("seq"), F.col("tail_pos"), F.col("tail_c"), F.col("tail_g")).alias("score"),
    )


def op5_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of all documents; without any to learn from every token is unknown, no documents give no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", fold("doc_id", 10, 0).alias("held_out"))
    return score_documents(docs, "held_out")
