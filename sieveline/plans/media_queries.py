"""Queries of media containers: films and sounds are made from rows of the tables and read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.plans import fixtures, media_fixtures
from sieveline.plans.file_queries import _TALKS
from sieveline.plans.perception import Perception
from sieveline.sources import images, media
from sieveline.sources.workspace import kept


def _t(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spoken(parts: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    return [(2000 * i, 2000 * i + 1500, text) for i, (_, text) in enumerate(parts)]


def _films(s, d) -> DataFrame:
    c = _t(s, d, "conversations")
    return fixtures.talks(c, "mp4", lambda p: media_fixtures.mp4(_spoken(p), 50 * len(p))).union(fixtures.talks(c, "mkv", lambda p: media_fixtures.mkv(_spoken(p), 2.0 * len(p))))


def media_captions(s, d):
    """The turns of every conversation as captions of two films, read back as cues."""
    return media.caption_cues(media.read_captions(_films(s, d))).select("uri", "seq", "start_s", "end_s", "text", "source")


def media_facts(s, d):
    """A film and three sounds for each part, whose lengths follow from its key."""
    makes = {
        "mp4": lambda k: media_fixtures.mp4([], k % 200 + 1), "wav": lambda k: media_fixtures.wav(8000, k % 2 + 1, k % 400 * 4), "flac": lambda k: media_fixtures.flac(96000, k % 8 + 1, (k + 1) * 96),
        "mp3": lambda k: media_fixtures.mp3(k % 50 + 4, k % 2 + 1, k % 3 == 0), "ogg": lambda k: media_fixtures.ogg(k % 2 + 1, k * 48),
    }
    kinds = F.explode(F.array(*map(F.lit, makes))).alias("kind")
    rows = fixtures.spread(_t(s, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", kinds).select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit("."), F.col("kind")).alias("uri"), "p_partkey", "kind")
    f = media.read_facts(fixtures.made(rows, lambda r: makes[r["kind"]](r["p_partkey"])))
    return f.select("uri", "container", F.round(F.col("duration_s") * 1000).cast("long").alias("ms"), F.size("streams").alias("n_streams"), F.col("streams")[0]["kind"].alias("kind"), F.col("streams")[0]["channels"].alias("channels"), F.col("streams")[0]["width"].alias("width"), "error")


def caption_timelines(s, d):
    """Films through the four questions: cards with their own facts, texts from their own captions."""
    p = Perception(kept(_films(s, d), "films"), ("ffmpeg", "asr"), depth=0)
    card = p.inspect().select("uri", "handler_id", *(F.try_element_at("facts", F.lit(k)).alias(k) for k in ("container", "cue_count", "video_streams", "languages")))
    return card.join(p.represent().select("uri", F.md5("text").alias("text_md5"), "n_segments"), "uri")


def image_crops(s, d):
    """A grey picture of eight by eight for each document, the digits of its text's SHA-256; of each its middle."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = _t(s, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("uri"), digest.alias("digest"))
    pictures = fixtures.made(rows, lambda r: media_fixtures.png(np.frombuffer(r["digest"].encode(), np.uint8).reshape(8, 8, 1), 8, 0))
    quarter = lambda c: F.lit(c).alias
    asked = rows.select("uri", quarter(0.25)("x"), quarter(0.25)("y"), quarter(0.5)("w"), quarter(0.5)("h"))
    crops = images.crop_regions(pictures, asked)
    shown = fixtures.made(crops.select("uri", "png"), lambda r: images.pixels(r["png"])[0].tobytes())
    return shown.select("uri", F.decode("content", "UTF-8").alias("shown")).join(crops.select("uri", "width", "height", "error"), "uri")


SQL: dict[str, str] = {
    "image_crops": "WITH x AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT 'doc/' || doc_id AS uri, substr(h, 19, 4) || substr(h, 27, 4) || substr(h, 35, 4) || substr(h, 43, 4) AS shown, 4 AS width, 4 AS height, NULL::VARCHAR AS error FROM x",
    "media_captions": f"""WITH {_TALKS} SELECT 'talk/' || conv_id || e.suffix AS uri, i AS seq, i * 2.0::DOUBLE AS start_s, i * 2.0::DOUBLE + 1.5 AS end_s, text, 'captioned' AS source FROM t, (VALUES ('.mp4'), ('.mkv')) e(suffix)""",
    "media_facts": """WITH k AS (SELECT p_partkey AS k FROM part)
      SELECT 'part/' || k || '.mp4' AS uri, 'mp4' AS container, ((k % 200 + 1) * 40)::BIGINT AS ms, 3 AS n_streams, 'video' AS kind, NULL::INT AS channels, 640 AS width, NULL::VARCHAR AS error FROM k
      UNION ALL SELECT 'part/' || k || '.wav', 'wav', round(k % 400 * 4 / 8.0::DOUBLE)::BIGINT, 1, 'audio', (k % 2 + 1)::INT, NULL, NULL FROM k
      UNION ALL SELECT 'part/' || k || '.flac', 'flac', (k + 1)::BIGINT, 1, 'audio', (k % 8 + 1)::INT, NULL, NULL FROM k
      UNION ALL SELECT 'part/' || k || '.mp3', 'mp3', round((k % 50 + 4) * 1152 * 1000 / 44100.0::DOUBLE)::BIGINT, 1, 'audio', (k % 2 + 1)::INT, NULL, NULL FROM k
      UNION ALL SELECT 'part/' || k || '.ogg', 'ogg', k::BIGINT, 1, 'audio', (k % 2 + 1)::INT, NULL, NULL FROM k""",
    "caption_timelines": f"""WITH {_TALKS}, e AS (SELECT * FROM (VALUES ('.mp4', 'mp4', 'deu, eng'), ('.mkv', 'webm', 'eng, fre')) e(suffix, container, languages)),
      x AS (SELECT conv_id, count(*) AS n, string_agg('[' || printf('%d:%02d:%04.1f', i * 2 // 3600, i * 2 // 60 % 60, (i * 2 % 60)::DOUBLE) || '] ' || text || chr(10), '' ORDER BY i) AS text FROM t GROUP BY conv_id)
      SELECT 'talk/' || conv_id || suffix AS uri, 'video' AS handler_id, container, n::VARCHAR AS cue_count, '1' AS video_streams, languages, md5(text) AS text_md5, n AS n_segments FROM x, e""",
}


def queries() -> dict:
    return {k: globals()[k] for k in SQL}
