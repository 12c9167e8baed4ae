"""Whitening, ranked search and packing against brute force: nulls, ties, repeats, long texts, empty tables, other columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import lexical, packing, whitening

SF = "/root/testdata/sf0.001"


# whitening ---------------------------------------------------------------------------------------------------------


def brute_steps(v):
    if v is None or not len(v) or any(c is None or not math.isfinite(c) for c in v):
        return None
    return tuple(math.floor(256 * c) for c in v)


def brute_whitening(vectors):
    """Rows by (place of the vector, component), from a covariance matrix and its eigenvectors."""
    x = [brute_steps(v) for v in vectors]
    out = {}
    for d in {len(v) for v in x if v}:
        fit = np.array(sorted({v for v in x if v and len(v) == d}), np.int64)
        n, s = len(fit), fit.sum(0)
        c = (n * fit - s) / n
        e, u = np.linalg.eigh(c.T @ c / n)
        e, u = e[::-1], u[:, ::-1]
        for i, v in enumerate(x):
            if v and len(v) == d:
                off = n * np.array(v, np.int64) - s
                for k in range(min(4, d)):
                    out[i, k + 1] = n, sum(int(a) ** 2 for a in off), off / n @ u[:, k] / math.sqrt(e[k]) if e[k] > 1e-9 else None, max(e[k], 0) / e.sum() if e.sum() else 0.0
    return out


def held(spark, vectors, kind="array<float>"):
    got = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), f"vec_id long, embedding {kind}")).collect()
    want = brute_whitening(vectors)
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened or 0)):
        n, deviation, w, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, Decimal(deviation)) and abs(r.explained - explained) < 1e-9 and r.identity_error < 1e-9
        assert (r.whitened is None) == (w is None)
        if w:
            s = sign.setdefault((len(vectors[r.vec_id]), r.component), math.copysign(1, r.whitened * w))
            assert abs(r.whitened - s * w) < 1e-8
    return got


def test_whitening_is_that_of_the_covariance(spark):
    rng = np.random.default_rng(3)
    plain = (rng.normal(size=(300, 7)) * [9, 5, 3, 2, 1, 0.5, 0.1]).astype(np.float32).tolist()
    held(spark, plain + plain[:40] + [plain[0]] * 50)


def test_odd_vectors_are_left_out_and_lengths_are_apart(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(40, 5)) * [5, 4, 3, 2, 1]).tolist() + (rng.normal(size=(30, 2)) * [3, 1]).tolist()
    vectors += [None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [-0.0, 0.0], [-0.001, 0.001]]
    held(spark, vectors, "array<double>")


def test_without_variance_there_is_nothing_to_divide_by(spark):
    got = held(spark, [[1.0, 2.0, 3.0]] * 5)
    assert {r.whitened for r in got} == {None} and {r.explained for r in got} == {0.0} and {r.identity_error for r in got} == {0.0}
    flat = held(spark, [[float(i), 2.0, 1.0] for i in range(9)])
    assert {r.component for r in flat if r.whitened is not None} == {1}


def test_small_deviations_beside_large_ones_keep_their_digits():
    rng = np.random.default_rng(5)
    u, v = np.linalg.qr(rng.normal(size=(50, 9)))[0], np.linalg.qr(rng.normal(size=(9, 9)))[0]
    scale = 10.0 ** -np.arange(9)
    norm, axes = whitening.jacobi_svd(u * scale)
    assert np.allclose(norm, scale, rtol=1e-13, atol=0) and np.allclose(axes.T @ axes, np.eye(9), atol=1e-14)
    a = u * scale @ v.T
    norm, axes = whitening.jacobi_svd(np.linalg.qr(a, mode="r"))
    assert np.allclose(norm[:4], scale[:4], rtol=1e-11) and np.allclose(np.abs(np.sum(axes[:, :3] * v[:, :3], 0)), 1)
    assert np.allclose(np.linalg.norm(a @ axes, axis=0), norm, atol=1e-14)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 50), 1 << 50), min_size=3, max_size=3), min_size=1, max_size=5), st.integers(1, 1 << 14))
def test_squares_are_exact(rows, n):
    s = [sum(c) for c in zip(*rows, strict=True)]
    assert whitening.squares(np.array(rows, np.int64), n, s) == [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in rows]


def test_triangles_of_many_tasks_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "STACKED", 2)
    rng = np.random.default_rng(6)
    held(spark, (rng.normal(size=(500, 6)) * [9, 5, 3, 2, 1, 0.5]).tolist(), "array<double>")


def test_whitening_of_an_empty_table_and_of_clashing_names(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    df = spark.createDataFrame([(None, [1.0, 2.0], 1, 2, 3), (7, [3.0, 1.0], 1, 2, 3), (7, [3.0, 1.0], 1, 2, 3)], "vec_id long, embedding array<double>, x int, n int, component int")
    got = whitening.whiten(df).collect()
    assert Counter(r.vec_id for r in got) == {None: 2, 7: 4}


# ranked search -----------------------------------------------------------------------------------------------------

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=50):
    """Rows (item_id, rank, doc_id, score), each document scored in full."""
    found = [(i, brute_terms(t)) for i, t in docs]
    found = [(i, len(t), Counter(t)) for i, t in found if t]
    n, total = len(found), sum(x[1] for x in found)
    df = Counter(t for x in found for t in x[2])
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(brute_terms(t))
    out = []
    for item, terms in asked.items():
        rows = []
        for doc, length, tf in found:
            m = 50 + 50 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in terms if t in tf)
            rows += [(-score, doc is None, doc or 0, doc)] if score > 0 else []
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit(0), "item": F.lit(1), "place": F.lit("x")}).repartition(3, "doc_id")
    got = lexical.search(d, spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1)), **how)
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()], key=str)


def zipf(seed, docs, words=40, mean=30):
    r = random.Random(seed)
    return [(i, " ".join(f"w{min(int(r.paretovariate(0.7)), words)}" for _ in range(r.randint(1, 2 * mean)))) for i in range(docs)]


@pytest.mark.parametrize("window", [4, 16_384])
def test_search_is_that_of_whole_scores(spark, monkeypatch, window):
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", 300)
    docs = zipf(1, 220)
    items = [(i, t) for i, t in zipf(2, 12, mean=8)]
    for k in (3, 50):
        assert searched(spark, docs, items, k=k) == brute_search(docs, items, k)


def test_search_of_odd_texts_ties_and_repeats(spark):
    docs = [(1, None), (2, ""), (3, " .,;"), (4, "Straße Ünder ÜNDER a_b"), (5, "straße"), (None, "straße"), (6, "x1 X1 x1"), (6, "x1 X1 x1"), (9, "x1 X1 x1"), (8, "x1 X1 x1"), (7, "lone " + "filler " * 40_000), (11, "漢字 😀 漢字")]
    items = [(1, "STRASSE straße"), (2, "x1"), (3, None), (4, "nowhere"), (None, "lone filler"), (5, "ÜNDER"), (6, "漢字"), (2, "lone"), (2, "x1")]
    got = searched(spark, docs, items)
    assert got == brute_search(docs, items)
    assert [r[2] for r in got if r[0] == 2][:5] == [7, 6, 6, 8, 9] or {r[2] for r in got if r[0] == 2} == {6, 7, 8, 9}


def test_search_takes_items_in_blocks_and_empty_tables(spark):
    docs, items = zipf(3, 60), zipf(4, 10, mean=5)
    assert searched(spark, docs, items, block_pairs=12) == brute_search(docs, items)
    assert searched(spark, [], items) == searched(spark, docs, []) == []


def test_a_window_skips_what_cannot_enter_the_heap():
    """One rare term in few documents, one common in all: once the heap is full of the rare, the common list is not read."""
    n = 1000
    place = np.array([t for i in range(n) for t in ([0, 1] if i < 60 else [1])], np.int32)
    shard = lexical.Shard(np.arange(n), np.ones(n, bool), np.full(n, 100), np.array([2 if i < 60 else 1 for i in range(n)]), place, np.ones(len(place), np.int32), np.array([7000, 3]))
    heap = shard.search(np.array([0, 1]), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)), 50)
    assert heap[1].tolist() == list(range(50))
    shard.impact[shard.term == 1] = 10**12  # would show if it were read for documents of the common list alone
    assert shard.search(np.array([0, 1]), heap, 50)[1].max() < 60


# packing -----------------------------------------------------------------------------------------------------------


def packed(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"class": F.lit("x"), "ids": F.lit(3), "start": F.lit(1)}).repartition(parts)
    return packing.packed_pieces(df, **how).collect()


def padding(got, capacity=2048):
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values(), default=0) <= capacity
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in used.values())


def whole(got, rows, capacity=2048):
    """Every id lies in one piece, every sequence has no gap, and ids are the tokenizer's."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length > 0
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == np.concatenate([[0], np.cumsum([n for _, n in p])[:-1]]).tolist()
    docs = defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
    for (i, ids), n in want.items():
        if sum(1 for j, _ in want if j == i) == n == 1:
            mine = sorted(docs[i], key=lambda r: r.start)
            assert b"".join(r.ids for r in mine) == ids and {r.doc_tokens for r in mine} == {len(ids) // 4}
            assert [r.start for r in mine] == np.concatenate([[0], np.cumsum([r.length for r in mine])[:-1]]).tolist()
    assert sum(r.length for r in got) == sum(len(ids) // 4 * n for (_, ids), n in want.items())
    return padding(got, capacity)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 30_000), st.sampled_from([2048, 1000, 64, 7, 1]))
def test_pieces_fill_their_class(n, capacity):
    got = packing.cuts(n, capacity)
    assert sum(length for length, _ in got) == n
    for length, k in got:
        assert length * k <= capacity < length * (k + 1)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["a<|endoftext|>b <|startoftext|>", "IT'S we'Ve <|x|>"]), st.text(st.one_of(st.sampled_from("abzAZ019'stlmdre.,-_ÀÖ×ØÞßàö÷øÿŸİ漢é \n\x0b\x1c\u00a0"), st.characters(blacklist_categories=("Cs",))), max_size=30)), max_size=4))
def test_ids_by_words_are_ids_by_text(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as f:
        words = packing._worker_words(f.read())
    want = [np.array(e.ids, "<u4").tobytes() for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(words.ids([t.encode("utf-8") for t in texts])) == want


def test_documents_of_the_tables_are_packed_with_little_padding(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.packed_pieces(df).collect()
    assert whole(got, [(r.doc_id, r.text) for r in df.collect()]) <= 2048 + sum(r.length for r in got) // 100


def test_odd_texts_are_packed_whole(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (None, "no id"), (6, "Ünder é é 漢字 😀 it's 12.5"), (7, "word " * 30_000), (8, "x" * 9000), (9, "ΣΑΣ ΟΔΟΣ İ"), (11, "a\x1cb\x85c d")]
    rows += [(10, "again and again")] * 500
    got = packed(spark, rows)
    assert whole(got, rows) <= 2048 + sum(r.length for r in got) // 50
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_packs_of_many_workers_and_of_other_capacities(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randint(0, 300)) for i in range(300)]
    for capacity in (128, 100):
        got = packed(spark, rows, parts=7, capacity=capacity)
        assert whole(got, rows, capacity) <= capacity + sum(x.length for x in got) // 20
    assert packed(spark, [], parts=1) == []


def test_query_gives_the_crc_of_little_endian_ids(spark):
    got = packing.op13_packing(spark, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got)
