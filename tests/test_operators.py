"""Flattening, pages, timelines, dispatch, caches, formats and chunks."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions.locators import char_span
from sieveline.operators import cache, chunks, dispatch, flatten, formats, html, timeline
from tests.html_reading import parsed_blocks


def chunks_of(spark, rows):
    return spark.createDataFrame(rows, "uri string, seq long, chunk string").withColumn("locator", char_span(F.col("seq"), F.col("seq") + 1))


@pytest.fixture(scope="module")
def flat(spark):
    return flatten.flatten(chunks_of(spark, [("a", 0, "hello\n"), ("a", 1, "x\n"), ("a", 2, "world!\n"), ("b", 0, "z")]))


def test_flatten_has_no_gaps(flat):
    assert flatten.gapless(flat).count() == 0
    assert {(r.uri, r.start, r.end) for r in flat.collect()} == {("a", 0, 6), ("a", 6, 8), ("a", 8, 15), ("b", 0, 1)}


@pytest.mark.parametrize("n", [None, 0, 1, 5, 6, 7, 14, 15, 100])
def test_represent_fits(spark, flat, n):
    bars = spark.createDataFrame([("a", 8), ("a", 6), ("a", 8)], "uri string, barrier long")
    full = {"a": "hello\nx\nworld!\n", "b": "z"}
    for r in flatten.represent(flat, bars, None, n).collect():
        keep = len(full[r.uri]) if n is None else min(len(full[r.uri]), max(1, n))
        assert r.text == full[r.uri][:keep]
        assert r.barriers == ([b for b in (6, 8) if n is None or b < max(1, n)] if r.uri == "a" else [])
        cut = keep < len(full[r.uri])
        assert [tuple(x) for x in r.degradations] == ([("text truncated", f"kept {keep} of {len(full[r.uri])} characters")] if cut else [])
    assert flatten.gapless(flatten.fit(flat, n)).count() == 0


def test_resolve(spark, flat):
    asks = spark.createDataFrame([("a", i) for i in range(-1, 17)], "uri string, offset long")
    got = {r.offset: r.seq for r in flatten.resolve(flat, asks).collect()}
    assert got == {i: 0 if i < 6 else 1 if i < 8 else 2 for i in range(15)}
    spans = spark.createDataFrame([("a", 5, 7), ("a", 0, 15), ("a", 6, 8)], "uri string, span_start long, span_end long")
    hits = {}
    for r in flatten.resolve_span(flat, spans).collect():
        hits.setdefault((r.span_start, r.span_end), []).append(r.seq)
    assert {k: sorted(v) for k, v in hits.items()} == {(5, 7): [0, 1], (0, 15): [0, 1, 2], (6, 8): [1]}


PAGES = [
    "<html><head><title> My  page </title><title></title></head><body><p>before</p><h1>One</h1><p>a <b>bold</b> word<br>next</p><script>var x='</p>';</script><h2>Two</h2><ul><li>x<li>y</ul>tail</body></html>",
    "", "just text", "<script>only()</script>", "<p>open <i>never closed", "  <div>  </div>  loose &amp; &copy; &#233; text<!-- <p>no</p> --> more", "<P CLASS=x>Upper</P><article>out<article>in</article>out again</article>",
    "<p>1 < 2 and 3</p>", "<style>p{}</style><h3></h3><h3>late</h3>",
]


def page_frame(spark, pages=PAGES):
    return spark.createDataFrame([(f"p{i}", p) for i, p in enumerate(pages)], "uri string, html string")


def test_blocks_are_the_parsers(spark):
    got = {}
    for r in html.blocks(page_frame(spark)).orderBy("uri", "seq").collect():
        got.setdefault(r.uri, []).append((r.level, r.text, r.start, r.end))
    for i, p in enumerate(PAGES):
        assert got.get(f"p{i}", []) == parsed_blocks(p), p


def test_blocks_of_the_corpus(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("page_id").cast("string").alias("uri"), "html")
    got = {}
    for r in html.blocks(pages).orderBy("uri", "seq").collect():
        got.setdefault(r.uri, []).append((r.level, r.text, r.start, r.end))
    assert all(got.get(r.uri, []) == parsed_blocks(r.html) for r in pages.collect())


PARTS = ["<p>", "</p>", "<h2>", "</h2>", "a ", "b", "&amp;", "&nbsp;", " ", "\n", "<b>", "</b>", "<br/>", '<p title="a>b">', "<div data-x='1 > 0'>", "<script>", "</script>", "<style>x</style>", "<!-- c <p> -->", "<!-- o ", "-->", "<", "<1", "&am",
         "<title>", "</title>", "<li/>", "<p a=b>", "</ p>", '<img alt="x>', '"', ">", "<!doctype html>", "<?x?>", "<script/>", "<a href='", "</script >", "<pre>", '</pre x="1">']


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_runs_are_the_standard_parsers(page):
    assert [r for r in html.runs(page) if r[0] >= 0] == parsed_blocks(page)


@pytest.mark.parametrize("page", ["<!--" * 250_000, "<a " * 300_000, '<a ="' * 200_000 + ">", "<" * 10**6, "--" * 500_000 + ">", "<script>" * 100_000, "x" * 10**6])
def test_hostile_pages_take_no_longer(page):
    assert html.read_page(page) is not None


def test_sections_and_card(spark):
    pages = page_frame(spark)
    read = html.parsed(pages)
    flat = html.segments(read)
    assert flatten.gapless(flat).count() == 0
    titles = [(r.section, r.section_title, r.is_titled) for r in html.outline(read).filter("uri = 'p0'").orderBy("section").collect()]
    assert titles == [(0, "(untitled)", False), (1, "One", True), (2, "Two", True)]
    card = {r.uri: r for r in html.card(pages).collect()}
    assert (card["p0"].title, card["p0"].heading_count) == ("My page", 2) and (card["p1"].title, card["p1"].block_count) == ("(untitled)", 0)
    text = {r.uri: r.text for r in flatten.text_of(flat).collect()}
    assert text["p0"].startswith("before\n\nOne\na bold wordnext\n\nTwo\n")
    sec = html.read_section(read, F.lit(1)).filter("uri = 'p0'").first()
    assert sec.text == "One\na bold wordnext" and PAGES[0][sec.start : sec.end].startswith("One</h1>")
    whole = {r.uri: r for r in html.represent(read).collect()}
    assert {u: r.text for u, r in whole.items()} == text and whole["p0"].barriers == [r.start for r in html.outline(read).filter("uri = 'p0' and section > 0").orderBy("section").collect()]
    cut = {r.uri: r for r in html.represent(read, 9).collect()}["p0"]
    assert cut.text == text["p0"][:9] and cut.barriers == [8] and cut.degradations[0].detail == f"kept 9 of {len(text['p0'])} characters"
    got = {r.uri: r for r in html.read_range(read, F.lit(900), F.lit(999)).collect()}["p0"]
    assert got.span_end - got.span_start == 1 and got.text == text["p0"][-1]
    old = flatten.read_range(flat, spark.createDataFrame([("p0", 0, 3)], "uri string, start long, end long")).first()
    assert old.text == "bef"


def test_repeated_pages_stay_rows_of_their_own(spark):
    pages = spark.createDataFrame([("u", "<h1>a</h1><p>b"), ("u", "<h1>a</h1><p>b"), (None, "<p>c"), ("n", None)], "uri string, html string").withColumn("Blocks", F.lit("clash"))
    assert sorted((r.uri or "", r.block_count) for r in html.card(pages).collect()) == [("", 1), ("n", 0), ("u", 2), ("u", 2)]
    assert html.barriers(html.parsed(pages)).count() == 0 and html.represent(html.parsed(pages)).filter("uri = 'u'").count() == 2


def test_running_sums_across_runs(spark, monkeypatch):
    monkeypatch.setattr(flatten, "RUN", 4)
    rows = [("a", i, "x" * (i % 5)) for i in range(30)] + [(None, 2, "yy"), (None, 7, "z")]
    got = {(r.uri, r.seq): r.start for r in flatten.flatten(chunks_of(spark, rows)).collect()}
    assert got == {(u, i): sum(len(c) for v, j, c in rows if v == u and j < i) for u, i, _ in rows}


def test_one_long_document_is_resolved_in_order(spark):
    n = 100_000
    flat = spark.range(n).select(F.lit("d").alias("uri"), F.col("id").alias("seq"), (F.col("id") * 7).alias("start"), (F.col("id") * 7 + 7).alias("end"), char_span(F.col("id"), F.col("id") + 1).alias("locator"))
    asks = spark.range(n).select(F.lit("d").alias("uri"), (F.col("id") * 7 + 3).alias("offset"))
    assert flatten.resolve(flat, asks).filter("seq * 7 + 3 = offset").count() == n
    spans = spark.range(n).select(F.lit("d").alias("uri"), (F.col("id") * 7 + 5).alias("span_start"), (F.col("id") * 7 + 9).alias("span_end"))
    assert flatten.resolve_span(flat, spans).count() == 2 * n - 1


def test_overlapping_is_the_range_join(spark):
    r = random.Random(3)
    a = [(r.choice("ab"), i, s, s + r.choice([1, 5, 300, 9000])) for i, s in enumerate(r.randrange(12_000) for _ in range(200))]
    b = [(r.choice("ab"), i, s, s + r.choice([0, 1, 40, 5000])) for i, s in enumerate(r.randrange(12_000) for _ in range(200))]
    got = flatten.overlapping(spark.createDataFrame(a, "k string, i int, s long, e long"), spark.createDataFrame(b, "k string, j int, t long, u long"), "k", ("s", "e"), ("t", "u"), 16).select("i", "j").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for k, i, s, e in a for q, j, t, u in b if k == q and s < u and t < e and t < u)


def tile_by_loop(starts, duration, w):
    out = []
    for i, s in enumerate(starts):
        if i == 0:
            c = 0.0
        elif out[-1] < duration:
            c = min(max(s, out[-1] + w), duration)
            c = out[-1] + 1e-9 if c <= out[-1] else c
        else:
            c = out[-1] + 1e-9
        out.append(c)
    return [(s, out[i + 1] if i + 1 < len(out) else min(max(duration, s + w), duration + w)) for i, s in enumerate(out)]


def test_tile(spark):
    r = random.Random(2)
    cases = [([5.0], 10.0), ([1.0, 1.0, 1.0], 1.5), ([0.0, 3.0, 9.0, 12.0], 10.0), ([2.0, 2.0], 0.0), ([0.0] * 6, 2.0)] + [([round(r.uniform(0, 12), 2) for _ in range(r.randrange(1, 12))], r.choice([0.0, 1.0, 5.0, 10.0])) for _ in range(120)]
    rows = [(f"{k}", i, s, d) for k, (ss, d) in enumerate(cases) for i, s in enumerate(ss)]
    got = {}
    for x in timeline.tile(spark.createDataFrame(rows, "uri string, seq long, start_s double, duration_s double"), min_width_s=0.5).orderBy("uri", "seq").collect():
        got.setdefault(x.uri, []).append((x.tile_start, x.tile_end))
    for k, (ss, d) in enumerate(cases):
        want = tile_by_loop(ss, d, 0.5)
        assert all(abs(a - c) < 1e-7 and abs(b - e) < 1e-7 for (a, b), (c, e) in zip(got[f"{k}"], want, strict=True)), (ss, d)
        assert all(e <= d + 0.5 + 1e-7 for _, e in got[f"{k}"])


CUE = "uri string, seq long, start_s double, end_s double, text string, speaker string, source string, duration_s double"


def test_cues(spark):
    c = spark.createDataFrame([("v", 0, 1.0, 2.0, " hi  there ", "Ann", "said", 10.0), ("v", 1, 4.0, 12.0, "bye", None, "captioned", 10.0), ("v", 2, 11.0, 13.0, "late", None, "said", 10.0)], CUE)
    kept = timeline.clamp(c)
    assert [(r.seq, r.end_s) for r in kept.orderBy("seq").collect()] == [(0, 2.0), (1, 10.0)]
    assert timeline.dropped(c).first().detail.startswith("1 cue(s)")
    text = flatten.text_of(timeline.transcript(timeline.tile(kept))).first().text
    assert text == "[0:00:00.0] Ann hi there\n[0:00:04.0] bye\n"
    asks = spark.createDataFrame([("v", 0.0, 3.0), ("v", 2.0, 3.0), ("v", 5.0, 5.0)], "uri string, from_s double, to_s double")
    got = {(r.from_s, r.to_s): (r.text, r.degraded) for r in timeline.read_span(kept, asks).collect()}
    assert got[0.0, 3.0] == ("[0:00:01.0] hi  there", False) and got[2.0, 3.0][1] and got[5.0, 5.0] == ("the requested window 0:00:05.0-0:00:05.0 is empty", True)
    frames = spark.createDataFrame([("v", i, i * 4.0, f"frame {i}") for i in range(3)], "uri string, seq int, start_s double, text string")
    assert [r.line for r in timeline.merge(frames, kept).orderBy("seq").collect()] == ["frame 0", "(speech) Ann hi there", "frame 1", "(caption) bye", "frame 2"]
    assert {(r.at_s, r.why) for r in timeline.suggest_frames(c, 1.5).collect()} == {(3.0, "silence")}


def test_scenes(spark):
    s = spark.createDataFrame([(u, i, i * 5.0) for u in "ab" for i in range(4)], "uri string, seq int, start_s double")
    cuts = spark.createDataFrame([("a", 5.0), ("a", 9.9), ("a", 17.0), ("b", 1.0)], "uri string, cut_s double")
    assert {(r.uri, r.seq) for r in timeline.scene_barriers(s, cuts).collect()} == {("a", 1), ("a", 3), ("b", 1), ("b", 2), ("b", 3)}
    grid = timeline.sampling_grid(spark.createDataFrame([("x", 12.0), ("y", 10.0), ("z", 0.0)], "uri string, duration_s double"))
    assert {u: sorted(r.start_s for r in grid.collect() if r.uri == u) for u in "xyz"} == {"x": [0.0, 5.0, 10.0], "y": [0.0, 5.0], "z": [0.0]}


def test_srt(spark):
    srt = "1\n00:00:01,5 --> 00:00:02,000\n<i>Hello</i>\n  there\n\n2\nno timing\n\n3\n00:00:05.000 --> 00:00:04.000\nbackward\n\n4\n00:01:00,000 --> 00:01:01,250\n<b></b>\n\n5\n01:00:00,000 --> 01:00:01,000\nlast"
    got = timeline.parse_srt(spark.createDataFrame([("f", srt), ("g", srt.replace("\n", "\r\n")), ("h", "")], "uri string, text string")).orderBy("uri", "seq").collect()
    assert [(r.uri, r.start_s, r.end_s, r.text) for r in got] == [(u, *x) for u in "fg" for x in ((1.5, 2.0, "Hello there"), (3600.0, 3601.0, "last"))]


def test_dispatch(spark):
    reg = dispatch.available(dispatch.handlers(spark, [("mine", ("text/*",), 5, 1, ())]), [])
    mimes = spark.createDataFrame([("text/plain",), ("text/html",), ("audio/mpeg",), ("image/png",), ("application/x-none",), ("text/plain",)], "mime string")
    assert {r.mime: r.handler_id for r in dispatch.dispatch(mimes, reg).collect()} == {"text/plain": "mine", "text/html": "html", "audio/mpeg": "binary", "image/png": "image", "application/x-none": "binary"}
    asks = spark.createDataFrame([("text", "read_range"), ("text", "fly")], "handler_id string, name string")
    got = {r.name: r.error for r in dispatch.resolve_names(asks, dispatch.affordances(spark)).collect()}
    assert got["read_range"] is None and got["fly"] == "unknown operation fly; known: read_range"
    assert dispatch.discover([("a", lambda: None), ("a", lambda: "2"), ("a", lambda: "3"), ("b", dispatch.binary_probe(["no-such-program"]))]) == {"a": "2"}


def test_cache(spark):
    df = spark.createDataFrame([({"end": "5"},), ({"start": "0", "end": "5"},), ({},), ({"end": "6"},)], "p map<string,string>")
    d = F.create_map(F.lit("start"), F.lit("0"), F.lit("end"), F.lit("5"))
    none = F.create_map().cast("map<string,string>")
    k = [r[0] for r in df.select(cache.artifact_key(F.lit("h"), F.lit("t"), F.lit(1), F.lit("o"), cache.with_defaults(F.col("p"), d), none)).collect()]
    assert k[0] == k[1] == k[2] != k[3]
    kept = spark.createDataFrame([("x", 1)], "artifact_key string, v int")
    made = spark.createDataFrame([("x", 2), ("y", 3)], "artifact_key string, v int")
    assert {tuple(r) for r in cache.put(kept, made).collect()} == {("x", 1), ("y", 3)}
    assert cache.misses(made, kept).count() == 1 and cache.hits(made.select("artifact_key"), kept).first().v == 1
    seen = spark.createDataFrame([("a", 1, 5)], "path string, length long, modificationTime long")
    now = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("a", 1, 6)], "path string, length long, modificationTime long")
    assert cache.changed(now, seen).count() == 2


def test_texts_and_bytes(spark):
    d = spark.createDataFrame([("a", "x\ny"), ("b", ""), ("c", None)], "uri string, text string")
    assert [(r.uri, r.lines, r.characters, r.excerpt) for r in formats.text_card(d).orderBy("uri").collect()] == [("a", 2, 3, "x\ny"), ("b", 0, 0, None), ("c", 0, 0, None)]
    got = {r.uri: r for r in formats.text_read_range(d, 2, 99).collect()}
    assert (got["a"].start, got["a"].end, got["a"].text, got["b"].degraded) == (2, 3, "y", True)
    rep = {r.uri: r for r in formats.text_represent(d, 2).collect()}
    assert rep["a"].text == "x\n" and rep["b"].text == "[e" and [n.what for n in rep["b"].degradations] == ["synthesized description", "text truncated"]
    f = spark.createDataFrame([("a", bytearray(b"\xff\xfeab")), ("b", bytearray("é".encode())), ("c", bytearray(b"caf\xe9")), ("d", bytearray(b"\x81\xff"))], "uri string, content binary")
    assert {r.uri: (r.text, r.encoding) for r in formats.decoded(f).filter("uri in ('b', 'c')").collect()} == {"b": ("é", "utf-8"), "c": ("café", "iso-8859-1")}
    assert formats.decoded(f).filter("uri = 'd'").first().encoding == "utf-8/replace"
    h = {r.uri: r for r in formats.binary_hexdump(f, 2, 10).collect()}
    assert h["a"].text.startswith("00000002  61 62") and (h["b"].start, h["b"].end, h["b"].text) == (2, 3, "")


def test_sheets(spark):
    cells = spark.createDataFrame([("w", "S", 0, r, c, v, f) for r, c, v, f in [(0, 0, "a", None), (0, 2, "c", None), (1, 1, None, "A1+1"), (3, 0, "z", None)]] + [("w", "T", 1, 0, 0, "t", None)], "uri string, sheet string, sheet_no int, row int, col int, value string, formula string")
    assert formats.list_sheets(cells).first().text == "S: A1:C4 (4 row(s), 3 column(s))\nT: A1:A1 (1 row(s), 1 column(s))"
    r = formats.read_sheet(cells, "S", 0, 2).first()
    assert r.text == "a |  | c\n | =A1+1 | " and (r.locator.rows, r.locator.cols) == (2, 3)
    assert formats.read_cells(cells, "S", "C1:A1").first().text == "a |  | c"
    assert formats.read_cells(cells, "S", "nonsense").first().degraded
    assert flatten.text_of(formats.sheet_segments(cells)).first().text == "S\na |  | c\n | =A1+1 | \nz |  | \nT\nt\n"
    assert "S!B2" in formats.uncomputed(cells).first().detail


def test_pages_and_slides(spark):
    p = spark.createDataFrame([("d", 1, "one", False), ("d", 2, " ", True), ("d", 3, None, False)], "uri string, page int, text string, has_image boolean")
    assert flatten.text_of(formats.page_segments(p)).first().text == "one\n(page 2 is an image with no text layer)\n(page 3 is blank)\n"
    assert {r.what for r in formats.page_notes(p).collect()} == {"scanned pages: image content, no text layer", "blank pages"}
    assert formats.read_page(p, 1).first().text == "one" and formats.read_page(p, 9).first().degraded
    s = spark.createDataFrame([("d", 1, "T", "b", "n"), ("d", 2, "", None, None)], "uri string, page int, title string, body string, notes string")
    assert flatten.text_of(formats.slide_segments(s)).first().text == "T\nb\nSpeaker notes: n\n(this slide carries no text)\n"


@pytest.mark.parametrize(("size", "overlap"), [(4, 0), (4, 2), (100, 0), (1, 0)])
def test_chunks(spark, size, overlap):
    r = spark.createDataFrame([("a", "0123456789abcdef", [0, 6, 7, 16]), ("b", "", []), ("c", "xyz", [])], "uri string, text string, barriers array<bigint>")
    got = chunks.chunk(r, size, overlap).orderBy("uri", "chunk").collect()
    text = {"a": "0123456789abcdef", "c": "xyz"}
    assert {g.uri for g in got} == set(text)
    for u, t in text.items():
        mine = [g for g in got if g.uri == u]
        assert set().union(*(range(g.start, g.end) for g in mine)) == set(range(len(t)))
        assert all(t[g.start : g.end] == g.text and len(g.text) <= size for g in mine)
        assert not any(g.start < b < g.end for g in mine for b in ((6, 7) if u == "a" else ()))
    spans = spark.createDataFrame([("a", 0, 5, "x"), ("a", 3, 16, "y"), ("a", 4, 5, "x")], "uri string, span_start long, span_end long, payload string")
    pay = chunks.payloads(chunks.chunk(r, 100), spans).orderBy("uri", "chunk").collect()
    assert [p.payloads for p in pay] == [["x", "y"], ["y"], ["y"], []]


def test_chunks_of_a_long_text_take_time_in_proportion(spark):
    """One document, none of it ASCII: sixteen times the text takes far less than sixteen times sixteen the time."""
    import time

    from sieveline.operators import chunks

    took = []
    for n in (250_000, 250_000, 4_000_000):
        df = spark.createDataFrame([("long", "ä€" * (n // 2), [100, n // 2, n + 7])], "uri string, text string, barriers array<bigint>")
        began = time.perf_counter()
        got = chunks.chunk(df, 400).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"), F.max("chunk").alias("last"), F.max(F.length("text")).alias("most")).first()
        took.append(time.perf_counter() - began)
        assert (got.c, got.most, got.last + 1) == (n, 400, got.n)
    assert took[2] < 5 + 40 * took[1]


def test_chunks_overlap_and_keep_to_barriers(spark):
    from sieveline.operators import chunks

    text = "".join(chr(97 + i % 26) for i in range(100))
    df = spark.createDataFrame([("a", text, [0, 30, 30, 100, 200]), ("b", "", []), ("c", None, None)], "uri string, text string, barriers array<bigint>")
    got = sorted((r.chunk, r.start, r.end, r.text) for r in chunks.chunk(df, 20, 5).collect())
    assert [(s, e) for _, s, e, _ in got] == [(0, 20), (15, 30), (30, 50), (45, 65), (60, 80), (75, 95), (90, 100)]
    assert all(t == text[s:e] for _, s, e, t in got) and [c for c, *_ in got] == list(range(7))


def test_pages_are_read_as_their_sql_does_where_a_reference_lacks_its_semicolon(spark):
    source = "<title>a &amp; b&amp</title><h1>x &amp;&copy; y&amp</h1><p>&#233; &nosuch; &amp</p>"
    assert [t for _, t, _, _ in html.runs(source)] == ["a & b&", "x &\u00a9 y&", "\u00e9 &nosuch; &"]  # as browsers
    assert [t for _, t, _, _ in html.runs(source, bare=False)] == ["a & b&amp", "x &\u00a9 y&amp", "\u00e9 &nosuch; &amp"]
    pages = spark.createDataFrame([("u", source)], "uri string, html string")
    assert [r.text for r in html.blocks(pages, bare=False).collect()] == ["x &\u00a9 y&amp", "\u00e9 &nosuch; &amp"]


@pytest.mark.parametrize("name", ["html_card", "html_read_range", "html_represent", "html_represent_budget", "html_sections"])
def test_queries_of_pages_give_their_sql_where_a_reference_lacks_its_semicolon(spark, tmp_path, name):
    import duckdb

    import __spark_entry__

    page = "<title>a &amp; b&amp</title><p>before &amp</p><h1>x &amp;&copy; y&amp</h1><p>" + "words &middot; &amp " * 150 + "</p><h2>cut &am</h2><p>z&copy</p>"
    spark.createDataFrame([(1, "u", page), (2, "v", page.replace("&amp<", "&amp;<"))], "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = __spark_entry__.queries()[name](spark, f"file://{tmp_path}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())
