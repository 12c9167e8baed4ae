"""Media containers and their captions, from files built here."""

import struct

import pytest
from pyspark.sql import functions as F

from sieveline.plans import media_fixtures as made
from sieveline.sources import media

CUES = [(0, 900, "one"), (1500, 2500, "zwei <i>drei</i>"), (2500, 4000, "漢字"), (5000, 5100, "five"), (7000, 9000, "six")]


def files(spark, **content):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in content.items()], "uri string, content binary")


def facts(spark, **content):
    return {r.uri: r for r in media.read_facts(files(spark, **content)).collect()}


def cues(spark, **content):
    got = media.caption_cues(media.read_captions(files(spark, **content))).orderBy("uri", "seq").collect()
    return {u: [(round(r.start_s * 1000), round(r.end_s * 1000), r.text) for r in got if r.uri == u] for u in content}


def test_facts_of_films(spark):
    got = facts(spark, a=made.mp4(CUES), b=made.mkv(CUES, 9.0))
    a, b = got["a"], got["b"]
    assert (a.container, a.duration_s, b.container, b.duration_s) == ("mp4", 2.0, "webm", 9.0)
    assert [(s.kind, s.codec, s.width, s.height, s.fps, s.sample_rate, s.channels, s.language, s.is_text) for s in a.streams] == [
        ("video", "avc1", 640, 360, 25.0, None, None, None, False), ("audio", "mp4a", None, None, None, 48000, 2, "eng", False), ("subtitle", "tx3g", None, None, None, None, None, "deu", True),
    ]
    assert [(s.kind, s.codec, s.width, s.fps, s.sample_rate, s.channels, s.language) for s in b.streams] == [
        ("video", "V_VP9", 1280, 25.0, None, None, "eng"), ("audio", "A_OPUS", None, None, 48000, 2, "eng"), ("subtitle", "S_TEXT/UTF8", None, None, None, None, "fre"),
    ]


def test_facts_of_sounds(spark):
    got = facts(spark, w=made.wav(8000, 2, 4000), f=made.flac(96000, 6, 480_000), o=made.ogg(2, 96_000), m=made.mp3(100), n=made.mp3(1000, 1, True))
    assert {k: (r.container, round(r.duration_s, 6), r.streams[0].sample_rate, r.streams[0].channels) for k, r in got.items()} == {
        "w": ("wav", 0.5, 8000, 2), "f": ("flac", 5.0, 96000, 6), "o": ("ogg", 2.0, 48000, 2), "m": ("mp3", round(100 * 1152 / 44100, 6), 44100, 2), "n": ("mp3", round(1000 * 1152 / 44100, 6), 44100, 1),
    }


@pytest.mark.parametrize("n", [0, 1, 3, 5])
def test_captions_are_what_was_put_in(spark, n):
    plain = [(a, b, t.replace("<i>", "").replace("</i>", "")) for a, b, t in CUES[:n]]
    assert cues(spark, mp4=made.mp4(CUES[:n]), mkv=made.mkv(CUES[:n], per_cluster=2)) == {"mp4": plain, "mkv": plain}


def test_other_caption_formats(spark):
    ass = [(0, 500, r"0,0,Default,,0,0,0,,{\i1}well,{\i0} said\Nagain")]
    got = cues(spark, ass=made.mkv(ass, codec="S_TEXT/ASS"), picture=made.mkv(CUES, codec="S_HDMV/PGS"))
    assert got == {"ass": [(0, 500, "well, said again")], "picture": []}
    payload = made.box("vttc", made.box("sttg", b"x"), made.box("payl", "said".encode()))
    assert media._iso_text("wvtt", payload) == "said" and media._iso_text("wvtt", made.box("vtte")) == ""
    assert media._iso_text("tx3g", struct.pack(">H", 6) + "﻿hi".encode("utf-16-be")) == "hi"


def test_files_in_place_are_read_by_seeks(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(made.mp4(CUES))
    rows = spark.createDataFrame([("a", str(tmp_path / "a.mp4")), ("gone", str(tmp_path / "none.mp4"))], "uri string, path string")
    got = {r.uri: r for r in media.read_facts(rows).collect()}
    assert got["a"].duration_s == 2.0 and "FileNotFound" in got["gone"].error
    assert media.read_captions(rows).filter("error is null and text != ''").count() == len(CUES)


def test_damage_is_a_row(spark):
    whole = {"mp4": made.mp4(CUES), "mkv": made.mkv(CUES), "wav": made.wav(8000, 1, 100), "flac": made.flac(8000, 1, 9), "ogg": made.ogg(1, 9), "mp3": made.mp3(5)}
    content = {f"{k}{n}": v[: len(v) * n // 7] for k, v in whole.items() for n in range(1, 7)} | {"none": b"", "text": b"hello there"}
    content |= {"loop": made.box("ftyp", bytes(8)) + struct.pack(">I4s", 3, b"moov"), "zero": b"\x1aE\xdf\xa3" + bytes(50), "noise": b"\xff\xfb" * 300}
    got = facts(spark, **content)
    assert len(got) == len(content) and got["none"].error and got["text"].error and got["loop"].error
    captions = media.read_captions(files(spark, **content)).collect()
    assert all(r.text is not None or r.error for r in captions)
    assert [r.text for r in captions if r.uri == "mkv6"][:2] == ["one", "zwei <i>drei</i>"]


def test_a_caption_without_an_end_lasts_until_the_next(spark):
    rows = [("a", 0, 0, 1.0, None, "x"), ("a", 0, 1, 3.0, None, "y"), ("a", 1, 0, 0.0, 9.0, "other track"), ("a", 0, 2, 4.0, 2.0, "backward"), ("a", 0, 3, 5.0, 6.0, " ")]
    df = spark.createDataFrame([(*r, None, "S_TEXT/UTF8", None) for r in rows], media.CUES)
    assert [(r.seq, r.start_s, r.end_s, r.text) for r in media.caption_cues(df).orderBy("seq").collect()] == [(0, 1.0, 3.0, "x"), (1, 3.0, 4.0, "y")]
    assert media.caption_cues(df.filter(F.lit(False))).count() == 0
