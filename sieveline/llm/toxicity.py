"""Toxicity: Levenshtein automata intersected with a trie of learned terms, weighed by their context.

The lexicon is learned from labelled rows: words, and stems of words, that toxic documents hold far more often than
others. One automaton follows all terms at once: its state is the set of places in the trie, each with the edits spent
to get there, so a misspelt or inflected word meets its term in one pass, and most words die after two letters. States
are determinised when first met. What a hit weighs is learned per term and number of edits. What its context is worth,
quotation marks around it and each word near it, is learned as well: how often documents with such a hit are toxic, against
all documents with hits; where few rows tell, quotes and words of reporting count as little and words of address as more. A
calibration learned on the same rows makes the sum a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.common import fold, join_sized, materialize, small_batches, table

#: The bound of the fit: about so many labelled documents are read whole (chosen by a hash of their ids).
SAMPLE_DOCS = 40_000
#: A term is held by so many toxic documents at least, whatever their number; so many times as often as by others; and
#: the log-likelihood ratio of that is so high (20: chance does it once in 100,000 terms).
LEAST_DOCS, LEAST_LIFT, LEAST_RATIO = 5, 20.0, 20.0
MOST_TERMS = 2000
STEM_LETTERS = (4, 8)
#: A term, or its misspellings, that weighs less is noise and counts 0; what counts that the sample never shows.
LEAST_WEIGHT, UNSEEN = 1.5, (3.0, 1.5)
#: Words to either side in which quotes are looked for, and words that are context themselves.
WINDOW, NEAR = 6, 3
#: What contexts leave of a hit's weight before rows tell (quoted or reported; addressed), as many documents' worth; the
#: least and the most; contexts that are learned; documents that hold one at least.
QUOTED, ADDRESSED, BELIEF, FACTORS, MOST_CONTEXTS, LEAST_CONTEXT = 0.25, 1.25, 5.0, (0.1, 1.5), 1000, 5
#: From this score on a document is predicted toxic.
THRESHOLD = 0.3
#: Words of reporting and of address, whose worth is believed until rows tell; look-alikes of letters.
REPORTING = frozenset("said says say quote quoted quotes called calling term word words phrase insult slur reported wrote defined means meaning".split())
ADDRESS = frozenset("you your you're youre u du dich dein ihr tu toi ton vous tú usted eres".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]+")
QUOTES = "\"“”„«»‘’'"
KEPT = 300_000


def normal(token: str) -> str:
    """The letters of a white-space token: edges stripped; look-alikes turned to letters if it mixes them in."""
    t = _EDGE.sub("", token)
    if not t or t.isalpha():
        return t
    if any(c.isalpha() for c in t):
        t = t.translate(LOOKALIKE)
    return _INNER.sub("", t)


def edits_for(length: int, stem: bool) -> int:
    """Edits that a term of this length allows."""
    return (0 if length < 6 else 1) if stem else (0 if length < 4 else 1 if length < 8 else 2)


class LexiconAutomaton:
    """Terms, as (text, stem), in a trie walked by one lazily determinised Levenshtein automaton."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        #: edits that some term below a node allows
        self.room = [0]
        for k, (term, stem) in enumerate(terms):
            node, room = 0, edits_for(len(term), stem)
            self.room[0] = max(self.room[0], room)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.room.append(0)
                node = self.next[node][c]
                self.room[node] = max(self.room[node], room)
            self.ends[node].append(k)
        self._reset()

    def _reset(self) -> None:
        self._ids: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._moves: dict[tuple[int, str], int] = {}
        self._whole: list[tuple] = []
        self._prefix: list[tuple] = []
        self.dead = self._state(frozenset())
        self.first = self._state(self._close({(0, 0, "")}))

    def _close(self, places: set) -> frozenset:
        """Add what leaving out letters of a term leads to; keep the fewest edits of each place."""
        best: dict[tuple[int, str], int] = {}
        todo = list(places)
        while todo:
            node, e, due = todo.pop()
            if e > self.room[node] or best.get((node, due), 99) <= e:
                continue
            best[node, due] = e
            if not due:
                todo += [(child, e + 1, "") for child in self.next[node].values()]
        return frozenset((node, e, due) for (node, due), e in best.items())

    def _state(self, places: frozenset) -> int:
        if places not in self._ids:
            self._ids[places] = len(self._sets)
            self._sets.append(places)
            found: dict[int, int] = {}
            for node, e, due in places:
                if not due:
                    for k in self.ends[node]:
                        if e <= edits_for(len(self.terms[k][0]), self.terms[k][1]):
                            found[k] = min(e, found.get(k, 9))
            self._whole.append(tuple((k, e) for k, e in found.items() if not self.terms[k][1]))
            self._prefix.append(tuple((k, e) for k, e in found.items() if self.terms[k][1]))
        return self._ids[places]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e, due in self._sets[state]:
            if due:
                if c == due:
                    out.add((node, e, ""))
                continue
            for d, child in self.next[node].items():
                if d == c:
                    out.add((child, e, ""))
                else:
                    out.add((child, e + 1, ""))
                    if c in self.next[child]:  # two letters changed places
                        out.add((self.next[child][c], e + 1, d))
            out.add((node, e + 1, ""))
        to = self._moves[state, c] = self._state(self._close(out))
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """The best term of a word and the edits to it: fewest edits, whole words before stems, then the first term."""
        if len(self._moves) > KEPT:
            self._reset()
        state, moves, best = self.first, self._moves, None
        for c in word:
            to = moves.get((state, c))
            state = self._move(state, c) if to is None else to
            if state == self.dead:
                break
            for k, e in self._prefix[state]:
                if best is None or (e, 1, k) < best:
                    best = (e, 1, k)
        else:
            for k, e in self._whole[state]:
                if best is None or (e, 0, k) < best:
                    best = (e, 0, k)
        return best and (best[2], best[0])


class _Tokens(dict):
    """Tokens met before; a miss runs the automaton."""

    def __init__(self, automaton: LexiconAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, token: str):
        if len(self) > KEPT:
            self.clear()
        word = normal(token)
        hit = self.automaton.match(word) if len(word) > 2 else None
        if len(token) <= 64:
            self[token] = hit
        return hit


#: The context of a hit inside quotation marks.
IN_QUOTES = '"'


def believed(context: str) -> float:
    """What a context is worth before rows tell."""
    return QUOTED if context == IN_QUOTES or context in REPORTING else ADDRESSED if context in ADDRESS else 1.0


class Scorer:
    """Hits, evidence and score of texts."""

    def __init__(self, terms: list[tuple[str, bool]], weights: dict[tuple[int, int], float], scale: list[float], contexts: dict[str, float] | None = None):
        self.terms, self.weights, self.scale, self.contexts = terms, weights, scale, contexts or {}

    def __getstate__(self):
        return self.terms, self.weights, self.scale, self.contexts

    def __setstate__(self, state):
        self.terms, self.weights, self.scale, self.contexts = state

    def _of(self) -> _Tokens:
        if not hasattr(self, "tokens"):
            self.tokens = _Tokens(LexiconAutomaton(self.terms))
        return self.tokens

    def found(self, text: str | None) -> list[tuple[int, int, set[str]]]:
        """(term, edits, contexts) of each hit."""
        words = text.lower().split() if text else []
        found = [(i, h) for i, h in enumerate(map(self._of().__getitem__, words)) if h is not None]
        return [(k, e, self._around(words, i)) for i, (k, e) in found]

    def hits(self, text: str | None) -> list[tuple[int, int, float]]:
        """(term, edits, factor of the context) of each hit."""
        return [(k, e, self.worth(c)) for k, e, c in self.found(text)]

    def worth(self, contexts: set[str]) -> float:
        """The factor of a hit's contexts: the least of those that take away, else the most of those that add."""
        factors = [self.contexts[c] if c in self.contexts else believed(c) for c in contexts]
        low = min(factors, default=1.0)
        return low if low < 1 else max(factors, default=1.0)

    @staticmethod
    def _around(words: list[str], i: int) -> set[str]:
        before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
        word = words[i]
        opened = word[:1] in QUOTES or any(w[:1] in QUOTES and w[-1:] not in QUOTES for w in before)
        closed = word.rstrip(".,;:!?")[-1:] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES and w[:1] not in QUOTES for w in after)
        near = {_EDGE.sub("", w) for w in before[-NEAR:]} | {_EDGE.sub("", w) for w in after[:NEAR]}
        return {w for w in near if 0 < len(w) <= 40} | ({IN_QUOTES} if opened and closed else set())

    def evidence(self, text: str | None) -> float:
        return sum(self.weights.get((k, min(e, 1)), 0.0) * c for k, e, c in self.hits(text))

    def score(self, text: str | None) -> float:
        """The calibrated evidence, between the steps by straight lines."""
        at = min(max(self.evidence(text), 0.0) * STEPS, len(self.scale) - 1)
        low = int(at)
        high = min(low + 1, len(self.scale) - 1)
        return self.scale[low] + (self.scale[high] - self.scale[low]) * (at - low)


#: Steps of the calibration in a unit of evidence, and how many.
STEPS, N_STEPS = 2, 41


def _monotone(rate: list[float], weight: list[float]) -> list[float]:
    """The closest non-decreasing rates: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for r, w in zip(rate, weight, strict=True):
        pools.append([r, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return [p[0] for p in pools for _ in range(int(p[2]))]


_SKETCH = np.random.default_rng(8).integers(0, 1 << 64, 4, np.uint64) | np.uint64(1)


def _sketches(texts: pd.Series) -> pd.Series:
    """Four min-hashes of a text's three-word shingles as one number: near copies mostly share all, texts that merely
    have a passage in common do not."""
    out = []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").lower().split()
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(g)) for g in zip(w, w[1:], w[2:], strict=False)), np.uint64)
        if not len(h):
            h = np.array([xxhash.xxh64_intdigest(b" ".join(w))], np.uint64)
        out.append(xxhash.xxh64_intdigest(np.array([(h * m).min() for m in _SKETCH]).tobytes()))
    return pd.Series(np.array(out, np.uint64).view(np.int64))


def _totals(rows: DataFrame) -> tuple[float, int, int]:
    """The share of toxic rows, their number, that of the others."""
    n = {r.y: r.n for r in rows.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    return (n1 / (n1 + n0) if n1 + n0 else 0.0), n1, n0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Scorer:
    """Learn terms, their weights and the calibration from labelled documents; ids labelled twice count as toxic if one
    label says so; null ids, texts and labels are left out. Without any labels every score is 0.5 times the prior 0.
    Terms, weights and contexts are learned from one document, the least text, of each group of near copies under one
    label, so reruns learn the same. The sample is written once; narrow passes read it. To the driver come terms
    (MOST_TERMS at most), one weight for each term and edits, MOST_CONTEXTS contexts and N_STEPS steps."""
    spark = docs.sparkSession
    small_batches(spark)
    of = labels.select(F.col(doc_id).alias("of_id"), F.col(toxic).cast("int").alias("y")).filter("of_id is not null and y is not null").groupBy("of_id").agg(F.max("y").alias("y"))
    n = of.count()
    if n > sample_docs:
        of = of.filter(F.pmod(F.xxhash64("of_id"), F.lit(1_000_003)) / F.lit(1_000_003.0) < F.lit(sample_docs / n))
    of = materialize(of, "toxic-labels")
    texts = docs.select(F.col(doc_id).alias("of_id"), F.col(text).alias("t")).filter("t is not null")
    sample = materialize(join_sized(texts, of, "of_id", "inner").select("t", "y", F.pandas_udf(_sketches, "long")(F.col("t")).alias("sketch")), "toxic-sample")
    distinct = materialize(sample.groupBy("sketch", "y").agg(F.min("t").alias("t")).select("t", "y"), "toxic-distinct")
    prior, _, _ = _totals(sample)
    _, n1, n0 = _totals(distinct)
    if not n1:
        return Scorer([], {}, [prior] * N_STEPS)

    def count(batches):
        for batch in batches:
            got: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for t, y in zip(batch["t"], batch["y"], strict=True):
                words = {w for w in map(normal, t.lower().split()) if 2 < len(w) <= 40}
                c = got[int(y > 0)]
                c.update((w, False) for w in words)
                c.update({(w[:i], True) for w in words for i in range(STEM_LETTERS[0], min(STEM_LETTERS[1], len(w)) + 1)})
            keys = list(got[1].keys() | got[0].keys())
            if keys:
                yield pd.DataFrame({"term": [k[0] for k in keys], "stem": [k[1] for k in keys], "n1": [got[1][k] for k in keys], "n0": [got[0][k] for k in keys]})

    distinct = distinct.repartition(max(1, (n1 + n0) // 2000))  # a bounded sample: by rows, not by bytes
    sums = distinct.mapInPandas(count, "term string, stem boolean, n1 long, n0 long").groupBy("term", "stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    lift = (F.col("n1") / F.lit(float(n1))) / ((F.col("n0") + 0.5) / F.lit(float(max(n0, 1))))
    toxic_part, held = n1 / (n1 + n0), F.col("n1") + F.col("n0")
    ratio = 2 * (F.col("n1") * F.log(F.col("n1") / (held * toxic_part)) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (held * max(1 - toxic_part, 1e-9)))).otherwise(0.0))
    found = sums.filter((F.col("n1") >= LEAST_DOCS) & (lift >= LEAST_LIFT) & (ratio >= LEAST_RATIO)).orderBy(F.desc("n1"), "term", "stem").limit(MOST_TERMS).collect()
    words = sorted(r.term for r in found if not r.stem)
    stems, chosen = {r.term for r in found if r.stem}, []
    for s in sorted(stems, key=lambda s: (len(s), s)):  # the shortest that tells
        if not any(s[:i] in chosen for i in range(STEM_LETTERS[0], len(s))):
            chosen.append(s)
    terms = [(w, False) for w in words] + [(s, True) for s in chosen]
    bare = Scorer(terms, {}, [0.0])

    def find(batches):
        for batch in batches:
            hits = [[{"k": k, "e": min(e, 1), "contexts": sorted(c)} for k, e, c in bare.found(t)] for t in batch["t"]]
            yield pd.DataFrame({"y": batch["y"], "hits": hits})

    # the automaton meets the sample once; what follows reads its hits
    held = materialize(distinct.mapInPandas(find, "y int, hits array<struct<k:int,e:int,contexts:array<string>>>"), "toxic-hits")

    each = held.select("y", F.explode(F.array_distinct(F.transform("hits", lambda h: F.struct(h["k"].alias("k"), h["e"].alias("e"))))).alias("h"))
    seen = {(r.k, r.e): (r.n1, r.n0) for r in each.groupBy("h.k", "h.e").agg(F.count_if(F.col("y") > 0).alias("n1"), F.count_if(F.col("y") <= 0).alias("n0")).collect()}
    weights = {}
    for k in range(len(terms)):
        for e in (0, 1):
            a, b = seen.get((k, e), (0, 0))
            w = min(5.0, math.log((a + 1.0) / n1 / ((b + 0.5) / max(n0, 1)))) if a + b else UNSEEN[e]
            weights[k, e] = w if w >= LEAST_WEIGHT else 0.0
    contexts = _contexts(held, weights)
    weighed = Scorer(terms, weights, [0.0], contexts)

    def bins(batches):
        counts = np.zeros((N_STEPS, 2), np.int64)
        for batch in batches:
            for hits, y in zip(batch["hits"], batch["y"], strict=True):
                at = sum(weights.get((h["k"], h["e"]), 0.0) * weighed.worth(set(h["contexts"])) for h in hits)
                counts[min(round(max(0.0, at) * STEPS), N_STEPS - 1), int(y > 0)] += 1
        yield pd.DataFrame({"b": range(N_STEPS), "n0": counts[:, 0], "n1": counts[:, 1]})

    by = {r.b: (r.n1, r.n0) for r in held.mapInPandas(bins, "b long, n0 long, n1 long").groupBy("b").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).collect()}
    rate, mass = [], []
    for b in range(N_STEPS):
        a, c = by.get(b, (0, 0))
        guess = prior * 0.5 if b == 0 else 1 / (1 + math.exp(2.0 - b / STEPS))
        rate.append((a + 2 * guess) / (a + c + 2))
        mass.append(a + c + 2)
    return Scorer(terms, weights, _monotone(rate, mass), contexts)


def _contexts(held: DataFrame, weights: dict[tuple[int, int], float]) -> dict[str, float]:
    """What contexts are worth: of rows (y, hits) with a hit of some weight in a context the toxic share against that of
    all rows with a hit, drawn to what is believed. To the driver come MOST_CONTEXTS rows at most."""

    def count(batches):
        sums: dict[str | None, list[int]] = {}
        for batch in batches:
            for hits, y in zip(batch["hits"], batch["y"], strict=True):
                some = [set(h["contexts"]) for h in hits if weights.get((h["k"], h["e"]), 0.0) > 0]
                for c in (set().union(*some) | {None}) if some else ():
                    sums.setdefault(c, [0, 0])[int(y > 0)] += 1
        yield pd.DataFrame([(c, b, a) for c, (a, b) in sums.items()], columns=["c", "n1", "n0"])

    sums = materialize(held.mapInPandas(count, "c string, n1 long, n0 long").groupBy("c").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "toxic-contexts")
    whole = sums.filter("c is null").first()
    if whole is None:
        return {}
    share = (whole.n1 + 1) / (whole.n1 + whole.n0 + 1)
    n = F.col("n1") + F.col("n0")
    strays = F.abs(F.col("n1") - n * share) >= 3 * F.sqrt(n * (share * (1 - share)))  # three deviations: a word that is merely there is no context
    told = sums.filter(F.col("c").isNotNull() & (n >= LEAST_CONTEXT) & (strays | F.col("c").isin(IN_QUOTES, *sorted(REPORTING | ADDRESS)))).orderBy(F.desc(n), "c").limit(MOST_CONTEXTS).collect()
    return {r.c: min(FACTORS[1], max(FACTORS[0], (r.n1 + BELIEF * share * believed(r.c)) / (r.n1 + r.n0 + BELIEF) / share)) for r in told}


def score(docs: DataFrame, model: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold). Null, empty and wordless texts get the score of
    no evidence. Texts are read whole. A column of docs that bears a name of the result is replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)  # MOST_TERMS words and two weights each

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        scorer = held.value
        return pd.Series([scorer.score(t) for t in texts], dtype="float64")

    others = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    return docs.withColumn("score", of(F.col(text))).select(*others, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of all documents; without labels all score alike, no documents give no rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 4, 2)
    model = fit(docs, labels.filter(~held_out))
    out = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", "predicted")
