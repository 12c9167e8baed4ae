"""The artifact store: first put wins, nothing half, nothing computed twice."""

import threading

import pytest
from pyspark.sql import functions as F

from sieveline.plans.perception import Perception
from sieveline.sources.store import ArtifactStore


@pytest.fixture
def store(spark, tmp_path):
    return ArtifactStore(spark, f"file://{tmp_path}/kept")


def put(store, *rows):
    return store.put(store.spark.createDataFrame(list(rows), "artifact_key string, json string"))


def get(store, *keys):
    return {r.artifact_key: r.json for r in store.get(store.spark.createDataFrame([(k,) for k in keys], "artifact_key string")).collect()}


def test_first_put_wins(store):
    assert get(store, "aa1") == {} and store.commits() == []
    put(store, ("aa1", "one"), ("bb1", "b"), ("cc", None), (None, "x"))
    put(store, ("aa1", "two"), ("dd1", "d"))
    assert get(store, "aa1", "bb1", "cc", "dd1", "none") == {"aa1": "one", "bb1": "b", "dd1": "d"}


def test_two_writers_one_value(spark, tmp_path):
    """Many put the same keys at once: every commit is whole, every reader sees one and the same."""
    stores = [ArtifactStore(spark, f"file://{tmp_path}/kept") for _ in range(6)]
    threads = [threading.Thread(target=put, args=(s, *((f"{k:02x}", f"by {i}") for k in range(5)))) for i, s in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(stores[0].commits()) == 6 and stores[0].rows().count() == 30
    seen = [get(s, *(f"{k:02x}" for k in range(5))) for s in stores]
    assert all(x == seen[0] for x in seen) and len(set(seen[0].values())) == 1 and len(seen[0]) == 5


def test_what_is_not_claimed_is_not_read(store):
    staged = store._staged(store.spark.createDataFrame([("aa", "half")], "artifact_key string, json string"))
    assert get(store, "aa") == {}
    put(store, ("aa", "whole"))
    assert not store._claim(staged, "00000000") and get(store, "aa") == {"aa": "whole"}


def test_compaction_keeps_what_counts(store):
    for i in range(4):
        put(store, ("aa", f"{i}"), (f"k{i}", f"own {i}"))
    name = store.compact()
    assert name == "00000000-00000003" and store.commits() == [name]
    put(store, ("aa", "late"), ("new", "n"))
    assert store.clean() == 4 and store.clean() == 0
    assert get(store, "aa", "k0", "k3", "new") == {"aa": "0", "k0": "own 0", "k3": "own 3", "new": "n"}
    assert store.compact() == "00000000-00000004" and get(store, "aa", "new") == {"aa": "0", "new": "n"}


def test_a_second_invoke_computes_nothing(spark, store, tmp_path):
    calls = tmp_path / "calls"

    def describe(row):
        with open(calls, "a") as f:
            f.write(row["uri"] + "\n")
        if row["uri"] == "bad.png":
            raise ValueError("no")
        return {"text": f"seen {row['params'].get('question', '')}"}

    png = bytearray(b"\x89PNG\r\n\x1a\n" + bytes(30))
    files = spark.createDataFrame([("a.png", png), ("same.png", png), ("bad.png", png + b"1"), ("t.txt", bytearray(b"some text"))], "uri string, content binary")
    asks = [("a.png", "ask_about_image", {"question": "what"}), ("same.png", "ask_about_image", {"question": "what"}), ("a.png", "ask_about_image", {"question": "where"}), ("bad.png", "ask_about_image", {"question": "what"}),
            ("t.txt", "read_range", {"start": "0", "end": "4"}), ("t.txt", "read_range", {"end": "4"}), ("t.txt", "fly", {}), ("gone", "read_range", {})]
    requests = spark.createDataFrame(asks, "uri string, name string, params map<string,string>")
    answers = lambda p: sorted((r.uri, r.name, r.text or "", r.degraded, r.error or "", r.locator.kind if r.locator else "") for r in p.invoke(requests).collect())
    how = {"depth": 0, "functions": {("image", "ask_about_image"): describe}}
    plain = answers(Perception(files, ("vision",), **how))
    calls.unlink()
    p = Perception(files, ("vision",), store=store, **how)
    first = answers(p)
    assert [r[:5] for r in first] == [r[:5] for r in plain]
    assert sorted(calls.read_text().split()) in (["a.png", "a.png", "bad.png"], ["a.png", "bad.png", "same.png"])  # equal pictures are looked at once
    calls.unlink()
    assert [r[:5] for r in answers(Perception(files, ("vision",), store=store, **how))] == [r[:5] for r in plain]
    assert calls.read_text().split() == ["bad.png"]  # what failed is tried again, and nothing else
    good = requests.filter("uri != 'bad.png'")
    calls.unlink()
    n = len(store.commits())
    assert p.invoke(good).filter("text is not null").count() == 5 and not calls.exists() and len(store.commits()) == n


def test_a_kept_answer_that_cannot_be_read_counts_as_none(spark, store):
    files = spark.createDataFrame([("t.txt", bytearray(b"some text"))], "uri string, content binary")
    asks = spark.createDataFrame([("t.txt", "read_range", {"end": "4"})], "uri string, name string, params map<string,string>")
    p = Perception(files, store=store, depth=0)
    key = p.keyed(asks).first().artifact_key
    put(store, (key, "not json"))
    assert p.invoke(asks).first().text == "some"
    assert store.rows().filter(F.col("artifact_key") == key).count() == 2
