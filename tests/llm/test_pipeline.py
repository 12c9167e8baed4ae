"""The pipeline against a plain reading of its stages; what is registered."""

import base64
import random
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sieveline.llm import bpe, mixing, near_copies
from tests.llm.test_operators import brute_components, brute_fingerprint, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_by_brute_force(spark, tmp_path):
    base = [(i, prose(i, 40 + i), "en", f"s{i % 3}", 0) for i in range(60)]
    more = [(100 + i, t.replace(" ", "\n"), la, s, n) for i, t, la, s, n in base[:10]]  # equal but for white space
    near = [(200, prose(1, 3000), "en", "s0", 0), (201, prose(1, 3000) + " tail", "en", "s1", 0)]
    junk = [(300, "12345 67890 !!", "en", "s0", 0), (301, None, "en", "s0", 0), (302, "", None, None, 0), (0, prose(0, 40), "en", "s0", 0)]
    rows = base + more + near + junk
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    groups = {}
    for r in kept:
        groups.setdefault("".join(r[1].split()), []).append(r)
    kept = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    sets = {r[0]: shingles(r[1]) for r in kept}
    comp = brute_components([(a, b) for a in sets for b in sets if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    kept = [r for r in kept if comp[r[0]] == r[0]]
    plan = mixing.repetition_plan(spark.createDataFrame(kept, COLUMNS)).collect()
    copies = {r.doc_id: r.copies for r in plan}
    ranks = Path(public_tokenizers.path(bpe.VOCABULARY)).read_bytes()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})
    want = Counter()
    for r in kept:
        want[r[0], tuple(enc.encode_ordinary(r[1]))] += copies[r[0]]
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == +want
    assert {200, 300, 301, 302} & {r.doc_id for r in out} <= {200} and len({r.doc_id for r in out} & {200, 201}) == (1 if comp.get(201) == 200 else 2)


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(w if r.random() >= share else f"edit{r.randrange(10**6)}" for w in text.split())


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("bucket", [32, 2])
def test_near_copies_are_all_texts_of_similar_shingles(spark, bucket, monkeypatch):
    monkeypatch.setattr(near_copies.near_copy_groups, "__defaults__", ("doc_id", "text", None, bucket, 2))
    texts = [edited(prose(g, 150), 100 * g + k, 0.03 * k / 8) for g in range(6) for k in range(8)]
    texts += [edited(prose(9, 200), k, 0.02 + 0.005 * (k % 4)) for k in range(40)]  # one large group
    texts += [prose(50, 60) + " " + prose(1000 + k, 60) for k in range(40)]  # a passage in common makes no near copies
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, "en", "s", 0), (901, " ", "en", "s", 1), (902, "a b", "en", "s", 3), (903, "A  B", "en", "s", 4)]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)]
    comp = brute_components(links)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    assert got == set(comp.values()) | {900, 902} and len(set(comp.values())) < 100
    fp = [brute_fingerprint(t) for t in texts]
    assert sum(bin(fp[i] ^ fp[j]).count("1") <= 2 for i, j in links if i < j) < sum(i < j for i, j in links) / 2


def test_near_copies_without_a_band_in_common_are_found_too(spark, monkeypatch):
    sketches = near_copies._sketches
    monkeypatch.setattr(near_copies, "_sketches", lambda *of: sketches(*of).withField("keys", F.array(F.monotonically_increasing_id())))
    texts = [edited(prose(g, 120), 100 * g + k, 0.03 * k / 8) for g in range(4) for k in range(6)] + [prose(50, 60) + " " + prose(1000 + k, 60) for k in range(20)]
    sets = [shingles(t) for t in texts]
    comp = brute_components([(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)])
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, COLUMNS), "").collect()}
    assert got == set(comp.values()) and len(got) < len(texts)


def test_stages_take_odd_tables(spark):
    odd = [(None, "no id at all here", "en", None, 1), (1, None, None, "s", None), (2, "", "en", "s", 0), (3, "the same", "en", "s", 8), (3, "the same", "en", "s", 8), (4, "x" * 30_000, "en", "s", 30_000), (5, prose(5), "en", "s", 0), (None, None, None, None, None)]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, COLUMNS)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, "")
            assert got.columns == docs.columns
            got.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(rows)


def test_native_operators_use_no_python(spark):
    d = "/root/testdata/sf0.001"
    for name in ("op6_exact_dedup", "op7_url_filter"):
        plan = __spark_entry__.queries()[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert spark.range(1).select(F.lit(1)).count() == 1
