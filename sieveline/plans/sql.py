"""The queries in SQL of DuckDB, written apart from the DataFrame code."""

from __future__ import annotations

_DOCS = "d AS (SELECT 'doc/' || doc_id AS uri, doc_id, source, lang, coalesce(text, '') AS text FROM documents)"

#: Pages read by a tokenizer: token offsets by a running sum, runs by a running count of block borders.
_HTML = r"""
p AS (SELECT 'page/' || page_id AS uri, html, length(html) AS size, regexp_extract_all(html,
  '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<title\b[^>]*>.*?(?:</title\s*>|\z)|<!--.*?-->|<[a-z/!?][^>]*>|[^<]+|<') AS toks FROM pages),
t0 AS (SELECT uri, size, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM p),
t1 AS (SELECT *, coalesce(sum(length(tok)) OVER (PARTITION BY uri ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos,
  lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, (NOT starts_with(tok, '<') OR tok = '<') AS is_text FROM t0),
t2 AS (SELECT *, tag IN ('address','article','aside','blockquote','caption','dd','div','dt','figcaption','footer','h1','h2','h3','h4','h5','h6','header','li','main','nav','p','pre','section','td','th','tr') AS is_block FROM t1),
t3 AS (SELECT *, sum(CASE WHEN is_block OR tag IN ('script', 'style') THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY i) AS run FROM t2),
r0 AS (SELECT uri, run, max(size) AS size, min(CASE WHEN is_block AND NOT starts_with(tok, '</') THEN pos + length(tok) END) AS opened,
  min(CASE WHEN is_text AND regexp_matches(tok, '[^\s\x{A0}]') THEN pos END) AS first_text,
  max(CASE WHEN is_block AND NOT starts_with(tok, '</') AND regexp_matches(tag, '^h[1-6]$') THEN substr(tag, 2, 1)::INT ELSE 0 END) AS level,
  min(CASE WHEN is_block OR tag IN ('script', 'style') THEN pos END) AS break_at, coalesce(string_agg(CASE WHEN is_text THEN tok END, '' ORDER BY i), '') AS raw FROM t3 GROUP BY uri, run),
r1 AS (SELECT *, coalesce(lead(break_at) OVER (PARTITION BY uri ORDER BY run), size) AS stop,
  trim(regexp_replace(replace(replace(replace(replace(replace(raw, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&nbsp;', chr(160)), '&amp;', '&'), '[\s\x{A0}\x0B]+', ' ', 'g')) AS text FROM r0),
b AS (SELECT uri, row_number() OVER (PARTITION BY uri ORDER BY run) - 1 AS seq, level, text, coalesce(opened, first_text)::BIGINT AS start, greatest(stop, coalesce(opened, first_text) + 1)::BIGINT AS stop FROM r1 WHERE text <> ''),
s0 AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY uri ORDER BY seq) AS opened FROM b),
s1 AS (SELECT *, opened - min(opened) OVER (PARTITION BY uri) AS section, opened > 0 AS is_titled,
  CASE WHEN opened > 0 THEN first_value(text) OVER (PARTITION BY uri, opened ORDER BY seq) ELSE '(untitled)' END AS section_title,
  seq = max(seq) OVER (PARTITION BY uri, opened) AS is_last FROM s0),
f0 AS (SELECT *, text || CASE WHEN is_last THEN chr(10) || chr(10) ELSE chr(10) END AS chunk FROM s1),
f AS (SELECT *, (sum(length(chunk)) OVER (PARTITION BY uri ORDER BY seq) - length(chunk))::BIGINT AS pos, (sum(length(chunk)) OVER (PARTITION BY uri ORDER BY seq))::BIGINT AS upto FROM f0)
"""

_TURNS = r"""
c AS (SELECT 'conv/' || conv_id AS uri, turn AS seq, role, role || ': ' || text || chr(10) AS chunk FROM conversations),
f AS (SELECT *, (sum(length(chunk)) OVER w - length(chunk))::BIGINT AS start, (sum(length(chunk)) OVER w)::BIGINT AS stop FROM c WINDOW w AS (PARTITION BY uri ORDER BY seq)),
n AS (SELECT uri, max(stop) AS n FROM f GROUP BY uri)
"""

_CUES = r"""
e AS (SELECT 'user/' || user_id AS uri, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
  round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6, 6) AS start_s, event_type FROM events),
q AS (SELECT *, start_s + 3.0::DOUBLE AS end_s, round(max(start_s) OVER (PARTITION BY uri) * 0.9::DOUBLE, 6) AS duration_s FROM e),
u AS (SELECT DISTINCT uri, duration_s FROM q),
g AS (SELECT uri, unnest(range(greatest(1, ceil(duration_s / 86400.0::DOUBLE))::BIGINT))::INT AS seq FROM u),
h AS (SELECT uri, seq, seq * 86400.0::DOUBLE AS start_s FROM g)
"""


def _stamp(x: str) -> str:
    hours, minutes = f"floor({x} / 3600)", f"floor(({x} - floor({x} / 3600) * 3600) / 60)"
    return f"printf('%d:%02d:%04.1f', ({hours})::BIGINT, ({minutes})::BIGINT, {x} - {hours} * 3600 - {minutes} * 60)"


_CHUNKS = _TURNS + r""",
t AS (SELECT uri, string_agg(chunk, '' ORDER BY seq) AS text, list(DISTINCT start) FILTER (role = 'user' AND start > 0) AS bars FROM f GROUP BY uri),
edges AS (SELECT uri, text, list_sort(list_distinct(list_concat([0::BIGINT, length(text)::BIGINT], coalesce(bars, []::BIGINT[])))) AS e FROM t),
parts AS (SELECT uri, text, unnest(e[1:-2]) AS a, unnest(e[2:]) AS b FROM edges),
pieces AS (SELECT uri, text, a, b, unnest(range(greatest(1, ceil((b - a) / 400.0))::BIGINT)) AS k FROM parts),
ch AS (SELECT uri, a + k * 400 AS start, least(b, a + k * 400 + 400) AS stop, text FROM pieces),
k AS (SELECT uri, row_number() OVER (PARTITION BY uri ORDER BY start, stop) - 1 AS chunk, start, stop, substr(text, start + 1, stop - start) AS text FROM ch)
"""

_ENTRIES = r"""
e AS (SELECT source AS uri, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq, lang || '/' || doc_id || '.txt' AS path, strlen(text) AS size_bytes,
  floor(strlen(text) / 3)::BIGINT AS compressed_bytes, doc_id % 11 = 0 AS is_symlink, CASE WHEN source <> 'src3' THEN doc_id * 10 END AS byte_offset FROM documents),
l AS (SELECT *, CASE WHEN is_symlink THEN 'link' ELSE 'file' END || ' ' || printf('%12d', size_bytes) || '  ' || path AS line FROM e)
"""

_PARTS = "p AS (SELECT p_partkey - 1 AS row, coalesce(p_name::VARCHAR, '') AS a, coalesce(p_brand::VARCHAR, '') AS b FROM part)"

_KEYS = r"""
k AS (SELECT 'doc/' || doc_id AS uri, sha256(concat_ws(chr(30), sha256(text), 'text', '1', 'read_range', 'end=1000' || chr(31) || 'start=0', '')) AS artifact_key FROM documents)
"""

SQL: dict[str, str] = {
    "text_card": f"""WITH {_DOCS} SELECT uri, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS lines,
      length(text)::BIGINT AS characters, nullif(substr(text, 1, 1000), '') AS excerpt FROM d""",
    "text_read_range": f"""WITH {_DOCS}, s AS (SELECT *, greatest(0, least(500, length(text) - 1)) AS a FROM d), r AS (SELECT *, greatest(a + 1, least(900, length(text))) AS b FROM s)
      SELECT uri, CASE WHEN text <> '' THEN a END::BIGINT AS start, CASE WHEN text <> '' THEN b END::BIGINT AS "end",
      CASE WHEN text <> '' THEN substr(text, a + 1, b - a) ELSE uri || ' is empty; there is no range to read' END AS text, text = '' AS degraded FROM r""",
    "text_represent_budget": f"""WITH {_DOCS}, r AS (SELECT uri, text AS full_text, substr(text, 1, 1000) AS text FROM d)
      SELECT uri, text, length(text)::BIGINT AS "end", CASE WHEN length(full_text) > 1000 THEN 'kept 1000 of ' || length(full_text) || ' characters' END AS detail FROM r""",
    "html_blocks": f'WITH {_HTML} SELECT uri, seq, level, text, start, stop AS "end" FROM b',
    "html_sections": f'WITH {_HTML} SELECT uri, section::BIGINT AS section, section_title, is_titled, min(pos) AS start, max(upto) AS "end" FROM f GROUP BY ALL',
    "html_segments": f'WITH {_HTML} SELECT uri, seq, pos AS start, upto AS "end", chunk, start AS source_start, stop AS source_end FROM f',
    "html_barriers": f"WITH {_HTML}, g AS (SELECT uri, section, min(pos) AS barrier FROM f GROUP BY uri, section) SELECT uri, barrier FROM g QUALIFY row_number() OVER (PARTITION BY uri ORDER BY section) > 1",
    "html_card": f"""WITH {_HTML}, k AS (SELECT uri, count(*) FILTER (level > 0) AS heading_count, count(*) AS block_count, sum(len(string_split(text, ' ')))::BIGINT AS word_count, max(upto) AS characters FROM f GROUP BY uri),
      ti AS (SELECT uri, strlen(html)::BIGINT AS size_bytes, list_filter([trim(regexp_replace(replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) FOR x IN regexp_extract_all(html, '(?is)<title\\b[^>]*>(.*?)(?:</title\\s*>|\\z)', 1)], lambda y: y <> '')[-1] AS title FROM p)
      SELECT ti.uri, coalesce(title, '(untitled)') AS title, coalesce(heading_count, 0) AS heading_count, coalesce(block_count, 0) AS block_count, coalesce(word_count, 0) AS word_count, coalesce(characters, 0) AS characters, size_bytes FROM ti LEFT JOIN k USING (uri)""",
    "html_read_range": f"""WITH {_HTML}, w AS (SELECT uri, string_agg(chunk, '' ORDER BY seq) AS whole FROM f GROUP BY uri),
      a AS (SELECT uri, whole, greatest(0, least(100, length(whole) - 1))::BIGINT AS span_start FROM w), z AS (SELECT *, greatest(span_start + 1, least(700, length(whole)))::BIGINT AS span_end FROM a)
      SELECT z.uri, span_start, span_end, substr(whole, span_start + 1, span_end - span_start) AS text, min(f.start) AS source_start, max(f.stop) AS source_end
      FROM z JOIN f ON z.uri = f.uri AND f.pos < span_end AND span_start < f.upto GROUP BY ALL""",
    "html_represent": f"""WITH {_HTML}, e AS (SELECT uri, section, min(pos) AS edge FROM f GROUP BY uri, section), x AS (SELECT uri, string_agg(edge::VARCHAR, ',' ORDER BY edge) AS barriers FROM e WHERE edge > 0 GROUP BY uri)
      SELECT f.uri, string_agg(chunk, '' ORDER BY seq) AS text, count(*) AS n_segments, coalesce(any_value(barriers), '') AS barriers FROM f LEFT JOIN x USING (uri) GROUP BY f.uri""",
    "html_represent_budget": f"""WITH {_HTML}, e AS (SELECT uri, section, min(pos) AS edge FROM f GROUP BY uri, section), x AS (SELECT uri, count(*) AS n_barriers FROM e WHERE edge > 0 AND edge < 2000 GROUP BY uri),
      w AS (SELECT uri, string_agg(chunk, '' ORDER BY seq) AS whole, count(*) FILTER (pos < 2000) AS n_segments FROM f GROUP BY uri)
      SELECT uri, substr(whole, 1, 2000) AS text, n_segments, coalesce(n_barriers, 0) AS n_barriers, CASE WHEN length(whole) > 2000 THEN 'kept 2000 of ' || length(whole) || ' characters' END AS detail FROM w LEFT JOIN x USING (uri)""",
    "conversation_segments": f'WITH {_TURNS} SELECT uri, seq, start, stop AS "end", chunk FROM f',
    "resolve_offsets": f"WITH {_TURNS}, o AS (SELECT DISTINCT uri, floor(n * i / 9)::BIGINT AS \"offset\" FROM n, range(10) r(i)) SELECT o.uri, o.\"offset\", f.seq, f.seq AS \"at\" FROM o JOIN f ON o.uri = f.uri AND start <= \"offset\" AND \"offset\" < stop",
    "resolve_spans": f"WITH {_TURNS}, a AS (SELECT uri, floor(n / 4)::BIGINT AS span_start, (floor(n / 4) + floor(n / 3) + 1)::BIGINT AS span_end FROM n) SELECT a.uri, span_start, span_end, f.seq FROM a JOIN f ON a.uri = f.uri AND f.start < span_end AND span_start < f.stop",
    "timeline_tile": f"""WITH {_CUES}, x AS (SELECT *, seq * 1.0::DOUBLE + max(CASE WHEN seq = 0 THEN 0.0::DOUBLE ELSE start_s END - seq * 1.0::DOUBLE) OVER (PARTITION BY uri ORDER BY seq) AS raw FROM q),
      y AS (SELECT *, min(CASE WHEN duration_s <= 0 OR (seq >= 1 AND raw >= duration_s) THEN seq END) OVER (PARTITION BY uri) AS k FROM x),
      z AS (SELECT *, CASE WHEN k IS NULL OR seq < k THEN raw ELSE greatest(duration_s, 0) + (seq - k) * 1e-9::DOUBLE END AS t FROM y)
      SELECT uri, seq, round(t, 6) AS tile_start, round(coalesce(lead(t) OVER (PARTITION BY uri ORDER BY seq), least(greatest(duration_s, t + 1), duration_s + 1)), 6) AS tile_end FROM z""",
    "timeline_clamp": f"WITH {_CUES} SELECT uri, seq, round(start_s, 6) AS start_s, round(least(end_s, duration_s), 6) AS end_s FROM q WHERE start_s < duration_s",
    "sampling_grid": f"WITH {_CUES} SELECT uri, seq, start_s FROM h",
    "timeline_merge": f"""WITH {_CUES}, m AS (SELECT uri, start_s, 0 AS is_cue, seq AS own, '(frame) ' || {_stamp('start_s')} AS line FROM h
      UNION ALL SELECT uri, start_s, 1, seq, CASE WHEN event_type = 'view' THEN '(caption) ' ELSE '(speech) ' END || event_type FROM q)
      SELECT uri, row_number() OVER (PARTITION BY uri ORDER BY start_s, is_cue, own) - 1 AS seq, is_cue, round(start_s, 6) AS start_s, line FROM m""",
    "read_span": f"""WITH {_CUES}, w AS (SELECT uri, seq, '[' || {_stamp('start_s')} || '] ' || event_type AS line FROM q WHERE start_s < 600000 AND 0 < end_s)
      SELECT uri, string_agg(line, chr(10) ORDER BY seq) AS text, false AS degraded, count(*) AS n_cues FROM w GROUP BY uri""",
    "scene_barriers": f"""WITH {_CUES}, cuts AS (SELECT uri, start_s AS cut_s FROM q WHERE event_type = 'error'),
      hit AS (SELECT DISTINCT c.uri, h.seq FROM cuts c ASOF JOIN h ON c.uri = h.uri AND c.cut_s >= h.start_s WHERE h.seq > 0)
      SELECT uri, seq FROM hit UNION ALL SELECT uri, seq FROM h WHERE seq > 0 AND uri NOT IN (SELECT uri FROM hit)""",
    "operation_pairs": """WITH e AS (SELECT user_id AS key, ts AS moment, event_type = 'purchase' AS ends FROM events WHERE event_type IN ('view', 'purchase')),
      w AS (SELECT *, lag(moment) OVER o AS before, lag(ends) OVER o AS before_ends FROM e WINDOW o AS (PARTITION BY key ORDER BY moment, ends)),
      x AS (SELECT key, CASE WHEN NOT coalesce(before_ends, true) THEN before END AS started_at, moment AS finished_at FROM w WHERE ends)
      SELECT *, epoch_us(finished_at) - epoch_us(started_at) AS elapsed_us FROM x""",
    "event_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "mime_parse": """SELECT 'Text/X-' || source || '+XML; charset=' || lang AS given, 'text' AS type, 'x-' || source || '+xml' AS subtype, 'xml' AS suffix, 'text' AS kind, count(*) AS n FROM documents GROUP BY source, lang""",
    "registry_dispatch": """WITH k(i, mime, handler_id, rank) AS (VALUES (0, 'text/plain', 'text', 3), (1, 'text/html', 'html', 0), (2, 'application/json', 'text', 0), (3, 'application/pdf', 'pdf', 0), (4, 'image/png', 'image', 3),
      (5, 'audio/mpeg', 'audio', 3), (6, 'video/mp4', 'video', 3), (7, 'application/zip', 'archive', 0), (8, 'application/x-unknown', 'binary', 4), (9, 'application/epub+zip', 'epub', 0))
      SELECT mime, handler_id, rank, count(*) AS n_sources FROM documents JOIN k ON doc_id % 10 = i GROUP BY ALL""",
    "capability_filter": """SELECT doc_id, a.handler_id, a.name FROM documents JOIN (VALUES (0, 'text', 'read_range', false), (1, 'html', 'read_section', false), (1, 'html', 'read_range', false), (2, 'image', 'crop_region', false),
      (2, 'image', 'describe_image', true), (2, 'image', 'ocr', true), (2, 'image', 'ask_about_image', true), (3, 'pdf', 'read_page', false), (3, 'pdf', 'page_region', false), (3, 'pdf', 'page_image', false), (3, 'pdf', 'ocr_page', true),
      (3, 'pdf', 'ask_about_image', true)) a(k, handler_id, name, needs) ON doc_id % 4 = a.k AND (NOT a.needs OR coalesce(lang = 'en', false))""",
    "uri_split": r"""SELECT page_id, 'a\!' || page_id || '.zip!' || replace(replace(url, '\', '\\'), '!', '\!') AS uri, 2 AS n, url AS member, 'a\!' || page_id || '.zip' AS container FROM pages""",
    "hexdump": f"""WITH {_DOCS}, x AS (SELECT uri, lower(hex(encode(text))) AS h FROM d), y AS (SELECT uri, substr(h, 33, 200) AS h FROM x), l AS (SELECT uri, h, unnest(range((ceil(length(h) / 32.0))::BIGINT)) AS i FROM y),
      z AS (SELECT uri, i, substr(h, i * 32 + 1, 32) AS r FROM l),
      o AS (SELECT uri, i, printf('%08x', 16 + i * 16) || '  ' || rpad(trim(regexp_replace(r, '(..)', '\\1 ', 'g')), 47, ' ') || '  |' || array_to_string([CASE WHEN b >= 32 AND b < 127 THEN chr(b) ELSE '.' END FOR b IN [('0x' || substr(r, j * 2 + 1, 2))::INT FOR j IN range(length(r) // 2)]], '') || '|' AS line FROM z)
      SELECT y.uri, 16::BIGINT AS start, greatest(17, 16 + length(y.h) // 2)::BIGINT AS "end", coalesce(string_agg(line, chr(10) ORDER BY i), '') AS text FROM y LEFT JOIN o ON y.uri = o.uri GROUP BY y.uri, y.h""",
    "binary_represent": f"""WITH {_DOCS}, b AS (SELECT uri, strlen(text)::BIGINT AS n, 'Binary file ' || uri || ' of type application/octet-stream, ' || strlen(text) || ' bytes. No textual content could be extracted.' AS t FROM d)
      SELECT uri, substr(t, 1, 60) AS text, greatest(1, n) AS "end", 2 AS n_notes FROM b""",
    "sheet_read_cells": f"WITH {_PARTS} SELECT 'book' AS uri, string_agg(a || ' | ' || b, chr(10) ORDER BY row) AS text, 2 AS row, 10 AS rows FROM p WHERE row BETWEEN 2 AND 11",
    "list_sheets": "SELECT 'book' AS uri, 'Parts: A1:C' || max(p_partkey) || ' (' || max(p_partkey) || ' row(s), 3 column(s))' AS text FROM part",
    "a1_names": """WITH RECURSIVE n AS (SELECT p_partkey, p_partkey::BIGINT AS k, (p_partkey * 7)::BIGINT AS rest, '' AS s FROM part UNION ALL SELECT p_partkey, k, rest // 26 - 1, chr((rest % 26 + 65)::INT) || s FROM n WHERE rest >= 0)
      SELECT p_partkey, s || (k + 1) AS name, k::INT AS row, (k * 7)::INT AS col FROM n WHERE rest < 0""",
    "archive_card": f"""WITH {_ENTRIES} SELECT uri, count(*) AS entry_count, sum(size_bytes)::BIGINT AS uncompressed_bytes, sum(compressed_bytes)::BIGINT AS compressed_bytes,
      CASE WHEN sum(compressed_bytes) > 0 THEN round(sum(size_bytes) / sum(compressed_bytes), 2) ELSE 0 END::DOUBLE AS expansion_ratio, bool_and(byte_offset IS NULL) AS solid FROM e GROUP BY uri""",
    "archive_page": f"""WITH {_ENTRIES}, g AS (SELECT uri, count(*) AS n, count(*) FILTER (seq >= 5 AND seq < 15) AS k, string_agg(line, chr(10) ORDER BY seq) FILTER (seq >= 5 AND seq < 15) AS lines FROM l GROUP BY uri)
      SELECT uri, CASE WHEN k > 0 THEN k || ' of ' || n || ' entries, from offset 5' || chr(10) || lines ELSE 'offset 5 is past the end; this container has ' || n || ' entry(ies)' END AS text, k = 0 AS degraded FROM g""",
    "archive_segments": f"""WITH {_ENTRIES}, c AS (SELECT *, line || chr(10) AS chunk FROM l)
      SELECT uri, seq, (sum(length(chunk)) OVER w - length(chunk))::BIGINT AS start, (sum(length(chunk)) OVER w)::BIGINT AS "end", chunk, CASE WHEN byte_offset IS NULL THEN 'chars' ELSE 'bytes' END AS kind,
      coalesce(byte_offset, seq)::BIGINT AS "at", CASE WHEN byte_offset IS NULL THEN seq + 1 ELSE byte_offset + greatest(1, compressed_bytes) END::BIGINT AS "to" FROM c WINDOW w AS (PARTITION BY uri ORDER BY seq)""",
    "container_limits": f"WITH {_ENTRIES} SELECT uri, CASE WHEN count(*) > 10000 THEN 'too many members' WHEN sum(size_bytes) > 120000 THEN 'too many bytes' ELSE 'expansion ratio' END AS reason FROM e GROUP BY uri HAVING count(*) > 10000 OR sum(size_bytes) > 120000 OR max(CASE WHEN compressed_bytes > 0 THEN size_bytes / compressed_bytes END) > 200",
    "artifact_keys": f"WITH {_KEYS} SELECT uri, artifact_key FROM k",
    "cache_hits": f"WITH {_KEYS}, s AS (SELECT DISTINCT artifact_key FROM k WHERE ends_with(uri, '0')) SELECT uri, artifact_key IN (SELECT artifact_key FROM s) AS hit FROM k",
    "content_dedupe": f"WITH {_DOCS} SELECT sha256(text) AS content_hash, min(uri) AS first_uri, count(*) AS n_sources FROM d GROUP BY sha256(text)",
    "chunk_with_barriers": f'WITH {_CHUNKS} SELECT uri, chunk, start, stop AS "end", text FROM k',
    "span_payloads": f"""WITH {_CHUNKS}, hit AS (SELECT k.uri, k.chunk, f.role, min(f.start) AS a FROM k JOIN f ON k.uri = f.uri AND f.start < k.stop AND k.start < f.stop GROUP BY ALL)
      SELECT uri, chunk, string_agg(role, ',' ORDER BY a) AS payloads FROM hit GROUP BY uri, chunk""",
    "chunk_origins": f"WITH {_CHUNKS} SELECT sha256(text) AS text_hash, count(*) AS n, count(DISTINCT uri)::INT AS n_origins, min(uri) AS first_origin FROM k GROUP BY sha256(text)",
    "locator_laws": f"WITH {_HTML} SELECT uri, count(*) FILTER (start >= 0 AND start < stop) AS sound, count(*) AS n FROM f GROUP BY uri",
}
