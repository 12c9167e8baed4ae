"""Compound files and what their streams hold: chains, pieces, continued strings, trees of records."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.plans import legacy_fixtures as made
from sieveline.plans.perception import Perception
from sieveline.sources import legacy


def files(spark, **content):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "uri string, content binary")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=9000), max_size=5))
def test_streams_come_back_from_their_chains(parts):
    streams = {f"s{i}": p for i, p in enumerate(parts)}
    c = legacy.Compound(made.compound(streams))
    assert {k: c.stream(k) for k in c.entries} == streams


def test_chains_that_loop_or_leave_are_refused():
    whole = made.compound({"big": bytes(6000)})
    fat_at = 512 + struct.unpack("<I", whole[76:80])[0] * 512
    start = legacy.Compound(whole).entries["big"][0]
    looped = bytearray(whole)
    struct.pack_into("<I", looped, fat_at + 4 * start, start)
    with pytest.raises(ValueError, match="loops"):
        legacy.Compound(bytes(looped)).stream("big")
    struct.pack_into("<I", looped, fat_at + 4 * start, 77_777)
    with pytest.raises(ValueError, match="leaves"):
        legacy.Compound(bytes(looped)).stream("big")
    with pytest.raises(ValueError):
        legacy.Compound(whole[:700]).stream("big")


@settings(max_examples=40, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",), min_codepoint=32, max_codepoint=0xFFFF), max_size=700))
def test_text_comes_back_from_its_pieces(text):
    assert legacy.doc_text(made.doc(text)) == text


def test_fields_tables_and_paragraphs(spark):
    text = "Title\rsee \x13 HYPERLINK \"x\" \x14the \x13 REF y \x14inner\x15 page\x15 now\ra\x07b\x07\x07c\x07d\x07\x07\rlast\x0bline\r" + "漢" * 150
    got = legacy.read_doc(files(spark, a=made.doc(text), bad=made.doc("x")[:600], none=b"no")).orderBy("uri", "seq").collect()
    assert [(r.kind, r.text) for r in got if r.uri == "a"] == [("paragraph", "Title"), ("paragraph", "see the inner page now"), ("table", "a | b\nc | d"), ("paragraph", "last\nline"), ("paragraph", "漢" * 150)]
    assert all(r.error for r in got if r.uri != "a") and len(got) == 7


def test_cells_of_all_kinds(spark):
    rows = [["key", "näme", 1, -5, 2.5], ["x" * 1000, "漢字" * 400, 1 << 40, ("by formula",), None], ["key", "", 0, 0.1, -(1 << 28)]]
    got = legacy.read_xls(files(spark, a=made.xls(rows, "Sheet one"), bad=made.xls(rows)[:3000])).collect()
    a = {(r.row, r.col): r.value for r in got if r.uri == "a"}
    want = {(i, j): (v[0] if isinstance(v, tuple) else v if isinstance(v, str) else str(v)) for i, r in enumerate(rows) for j, v in enumerate(r) if v is not None}
    assert a == want and {r.sheet for r in got if r.uri == "a"} == {"Sheet one"}
    assert [bool(r.error) for r in got if r.uri == "bad"] == [True]
    assert [legacy._rk(v) for v in (5 << 2 | 2, 1234 << 2 | 3, (-7 << 2 | 2) & 0xFFFFFFFF, 0x3FF00000)] == [5.0, 12.34, -7.0, 1.0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",), max_codepoint=0xFFFF), max_size=200), min_size=1, max_size=30, unique=True))
def test_strings_come_back_however_they_are_cut(strings):
    got = list(legacy.xls_cells(made.xls([[s] for s in strings])))
    assert [v for *_, v, _ in got] == strings


def test_slides_and_their_notes(spark):
    got = legacy.read_ppt(files(spark, a=made.ppt([("One", "first\rsecond"), ("Zwei", "漢字")]), e=made.ppt([]))).orderBy("page").collect()
    assert [(r.uri, r.page, r.title, r.body, r.notes) for r in got] == [("a", 1, "One", "first\nsecond", "One"), ("a", 2, "Zwei", "漢字", "")]


def test_kinds_and_the_questions(spark):
    f = files(spark, **{"a.doc": made.doc("Some words\rand more"), "b.xls": made.xls([["k", 1]]), "c.ppt": made.ppt([("T", "b")]), "d.doc": made.compound({"Other": b"x"})})
    assert {r.uri: r.kind for r in legacy.read_kinds(f).collect()} == {"a.doc": "doc", "b.xls": "xls", "c.ppt": "ppt", "d.doc": "other"}
    p = Perception(f, ("document_render",), depth=0)
    assert {r.handler_id for r in p.list().collect()} == {"legacy"}
    assert {r.uri: r.text for r in p.represent().collect()} == {"a.doc": "Some words\nand more\n\n", "b.xls": "Data\nk | 1\n", "c.ppt": "T\nb\nSpeaker notes: T\n"}
    facts = {r.uri: dict(r.facts) for r in p.inspect().collect()}
    assert facts["a.doc"] == {"kind": "doc", "paragraph_count": "2", "word_count": "4"} and facts["b.xls"] == {"kind": "xls", "sheet_count": "1"} and facts["c.ppt"] == {"kind": "ppt", "slide_count": "1"}
    assert {r.uri for r in Perception(f, (), depth=0).represent().filter("text like '%0000%'").collect()}  # without the capability they are bytes


def test_cells_hold_whole_numbers_of_any_size(spark):
    keys = [7, -7, 2**29, 10**15 + 1, -(2**53), 2**53 + 1, 2**62 + 1]
    got = legacy.read_xls(files(spark, **{"b.xls": made.xls([[k] for k in keys])})).orderBy("row").collect()
    assert [r.value for r in got] == [str(k) for k in keys] and {r.error for r in got} == {None}


def test_customers_of_one_key_stand_as_in_the_table(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__

    keys = [250, 7, 150, 7, 101, 7, 150]
    rows = [(k, f"Customer#{9 - i}", 1.25 * ((5 * i) % 7)) for i, k in enumerate(keys)]
    (tmp_path / "customer.parquet").mkdir()
    for i, part in enumerate((rows[:4], rows[4:])):
        pq.write_table(pa.Table.from_pylist([dict(zip(("c_custkey", "c_name", "c_acctbal"), r, strict=True)) for r in part]), tmp_path / "customer.parquet" / f"part-{i}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    found = con.execute(__spark_entry__.oracle_sql()["legacy_cells"])
    names = [c[0] for c in found.description]
    got = __spark_entry__.queries()["legacy_cells"](spark, f"file://{tmp_path}").select(*names).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, found.fetchall()))
