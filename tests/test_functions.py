"""Scalar functions against plain Python."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import text as T
from sieveline.functions.locators import bbox, byte_range, cell_range, char_span, describe, page_ref, part_span, time_span, valid

ALPHABET = "ab!\\/. "


def col(spark, values, schema, expr):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {schema}").select(expr).collect()]


def test_uri_round_trip(spark):
    import random

    r = random.Random(1)
    parts = [["".join(r.choice(ALPHABET) for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(1, 4))] for _ in range(400)]
    rows = spark.createDataFrame([(p,) for p in parts], "p array<string>").select("p", T.join_uri(F.col("p")).alias("u")).select("p", "u", T.split_uri(F.col("u")).alias("b"), T.container_of(F.col("u")).alias("c")).collect()
    assert all(x.p == x.b for x in rows)
    assert len({x.u for x in rows}) == len({tuple(x.p) for x in rows})
    assert all((x.c is None) == (len(x.p) == 1) for x in rows)
    assert col(spark, ["a!!b", "!a", "a!", "", "a!b"], "string", T.split_uri(F.col("v"))) == [None, None, None, None, ["a", "b"]]


@pytest.mark.parametrize("segment", ["x" * 10**6, "!" * 200_000, "\\" * 200_000, "a!\\b" * 100_000])
def test_long_uris_need_no_stack(spark, segment):
    df = spark.createDataFrame([(["c.zip", segment],)], "parts array<string>").withColumn("uri", T.join_uri(F.col("parts")))
    r = df.select(T.split_uri(F.col("uri")).alias("back"), T.container_of(F.col("uri")).alias("c"), "parts").first()
    assert r.back == r.parts and r.c == "c.zip"


def test_unsafe_members(spark):
    bad = ["/etc/x", "\\x", "C:x", "../x", "a/../../x", "a\\..\\b", ".."]
    good = ["a/b", "a..b/c", "a/..b", "..."]
    assert col(spark, bad + good, "string", T.unsafe_member(F.col("v"))) == [True] * 7 + [False] * 4


def letters(n):
    s = ""
    n += 1
    while n:
        n, k = divmod(n - 1, 26)
        s = chr(65 + k) + s
    return s


def test_a1(spark):
    cols = [0, 1, 25, 26, 27, 51, 52, 701, 702, 703, 18277, 18278, 16383]
    assert col(spark, cols, "int", T.column_letters(F.col("v"))) == [letters(c) for c in cols]
    names = ["A1", " b2 ", "AA10", "C3:A1", "A1:C3", "A0", "1A", "A1:B2:C3", "", "A", "XFD1048576"]
    got = col(spark, names, "string", T.parse_a1(F.col("v")))
    assert [g and tuple(g) for g in got] == [(0, 0, 1, 1), (1, 1, 1, 1), (9, 26, 1, 1), (0, 0, 3, 3), (0, 0, 3, 3), None, None, None, None, None, (1048575, 16383, 1, 1)]


def hexdump(data, offset):
    out = []
    for i in range(0, len(data), 16):
        row = data[i : i + 16]
        out.append(f"{offset + i:08x}  {' '.join(f'{b:02x}' for b in row):<47}  |{''.join(chr(b) if 32 <= b < 127 else '.' for b in row)}|")
    return "\n".join(out)


def test_hexdump(spark):
    data = [b"", b"a", bytes(range(256)), b"hello world, 16b", "é漢".encode()]
    assert col(spark, data, "binary", T.hexdump(F.col("v"), F.lit(32))) == [hexdump(d, 32) for d in data]


def test_times_and_lines(spark):
    secs = [0.0, 59.96, 61.23, 3600.0, 3725.5, 86399.9, 0.25, 0.35, 0.75, 0.05, 119.95, 3600.65, *(i / 20 for i in range(200)), *(1234.0 + i / 40 for i in range(200))]
    want = []
    for s in secs:
        h, r = divmod(s, 3600)
        m, c = divmod(r, 60)
        want.append(f"{int(h)}:{int(m):02d}:{c:04.1f}")
    assert col(spark, secs, "double", T.timestamp(F.col("v"))) == want
    texts = ["", "a", "a\n", "a\nb", "\n\n", "x y"]
    assert col(spark, texts, "string", T.line_count(F.col("v"))) == [t.count("\n") + (1 if t and not t.endswith("\n") else 0) for t in texts]


SPACES = [chr(c) for c in range(0x3100) if chr(c).isspace()]


def test_collapse_is_pythons_split(spark):
    texts = [f"a{s}b{s}{s}c{s}" for s in SPACES] + ["".join(SPACES), "", "plain", "​zero width stays"]
    assert col(spark, texts, "string", T.collapse(F.col("v"))) == [" ".join(t.split()) for t in texts]
    assert col(spark, texts, "string", T.word_count(F.col("v"))) == [len(t.split()) for t in texts]


def test_mime_and_patterns(spark):
    got = col(spark, ["Text/HTML; charset=x", "application/atom+xml", "bad", None, "a/b/c"], "string", T.mime(F.col("v")))
    assert [g and tuple(g) for g in got] == [("text", "html", None), ("application", "atom+xml", "xml"), None, None, None]
    pairs = [("*", "a/b", 4), ("kind:text", "text/x", 3), ("kind:binary", "application/x", 3), ("text/*", "text/x", 2), ("+xml", "a/b+xml", 1), ("a/b", "a/b", 0), ("a/c", "a/b", None), ("kind:image", "text/x", None)]
    df = spark.createDataFrame([(p, m) for p, m, _ in pairs], "p string, m string").select(T.match_rank(F.col("p"), F.col("m")))
    assert [r[0] for r in df.collect()] == [x for _, _, x in pairs]


def test_capabilities(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), ([], []), (["c"], ["a"])], "r array<string>, h array<string>")
    assert [r[0] for r in df.select(T.satisfied(F.col("r"), F.col("h"))).collect()] == [True, True, False]
    m = spark.createDataFrame([({"a": "1", "b": "2"},), ({"b": "2", "a": "1"},), ({"a": "12", "b": ""},)], "m map<string,string>").select(T.fingerprint(F.col("m"))).collect()
    assert m[0] == m[1] != m[2]


def test_regions_and_costs(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (0.5, 0.5, 0.001, 0.001), (0.9, 0.0, 0.2, 0.1)], "x double, y double, w double, h double")
    c = [F.col(k) for k in "xywh"]
    got = df.select(T.in_frame(*c), T.whole_frame(*c), T.crop_box(*c, F.lit(100), F.lit(50))).collect()
    assert [r[0] for r in got] == [True, True, False] and [r[1] for r in got] == [True, False, False]
    assert tuple(got[0][2]) == (0, 0, 100, 50) and tuple(got[1][2]) == (50, 25, 51, 26)
    cost = col(spark, [10.0, 40.0, 41.0], "double", T.clip_cost(F.col("v")))
    assert cost[:2] == ["about 21,000 prompt tokens", "about 84,000 prompt tokens"] and cost[2].startswith("at least 88,033")
    assert col(spark, [["a", "b"], [str(i) for i in range(12)]], "array<string>", T.listed(F.col("v"))) == ["a, b", "0, 1, 2, 3, 4, 5, 6, 7, 8, 9 and 2 more"]


def test_cue_lines(spark):
    df = spark.createDataFrame([(" a  b ", "Ann", "said"), ("x", None, "captioned"), ("  ", None, "said"), (None, "B", "said")], "t string, s string, k string")
    assert [r[0] for r in df.select(T.cue_line(F.col("t"), F.col("s"), F.col("k"))).collect()] == ["(speech) Ann a b", "(caption) x", "(speech) (no text was produced for this cue)", "(speech) (no text was produced for this cue)"]


@pytest.mark.parametrize(("base", "href", "want"), [("OEBPS/x.opf", "ch%201.xhtml#top", "OEBPS/ch 1.xhtml"), ("a/b/c.opf", "../d+e.html", "a/d+e.html"), ("x.opf", "./y", "y")])
def test_hrefs(spark, base, href, want):
    assert spark.range(1).select(T.resolve_href(F.lit(base), F.lit(href))).first()[0] == want


def test_locators(spark):
    one = [char_span(F.lit(0), F.lit(2)), byte_range(F.lit(0), F.lit(2)), time_span(F.lit(0.0), F.lit(1.5)), page_ref(F.lit(1)), bbox(F.lit(0.1), F.lit(0.1), F.lit(0.5), F.lit(0.5)), cell_range(F.lit("S"), F.lit(0), F.lit(0)), part_span(F.lit("p"), F.lit(0), F.lit(1))]
    bad = [char_span(F.lit(2), F.lit(2)), byte_range(F.lit(-1), F.lit(2)), time_span(F.lit(2.0), F.lit(1.5)), page_ref(F.lit(0)), bbox(F.lit(0.8), F.lit(0.1), F.lit(0.5), F.lit(0.5)), cell_range(F.lit(" "), F.lit(0), F.lit(0)), part_span(F.lit(""), F.lit(0), F.lit(1))]
    r = spark.range(1).select(*(valid(x).alias(f"g{i}") for i, x in enumerate(one)), *(valid(x).alias(f"b{i}") for i, x in enumerate(bad)), describe(one[0]).alias("d")).first()
    assert list(r[:7]) == [True] * 7 and list(r[7:14]) == [False] * 7 and r.d == "characters 0-2"


@settings(max_examples=20, deadline=None)
@given(st.integers(-5, 30), st.integers(-5, 30), st.integers(1, 20))
def test_clamp(spark, a, b, n):
    s, e = spark.range(1).select(*T.clamp(F.lit(a), F.lit(b), F.lit(n))).first()
    assert s == max(0, min(a, n - 1)) and e == max(s + 1, min(b, n)) and 0 <= s < e <= n


def test_budget(spark):
    df = spark.createDataFrame([("hello",), ("",)], "t string")
    for n, want in ((None, ["hello", ""]), (0, ["h", ""]), (1, ["h", ""]), (5, ["hello", ""]), (10, ["hello", ""])):
        assert [r[0] for r in df.select(T.fit_text(F.col("t"), n)).collect()] == want
