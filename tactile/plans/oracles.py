"""SQL counterparts of the registered queries, for an independent engine.

They state the definitions directly: pairs of boxes and recursive closure for lines, recursion over
row numbers for the session machines, a dictionary join with case fallback per character.
"""

from __future__ import annotations

from tactile.functions import braille
from tactile.operators.capture import UTTERANCES
from tactile.plans.derive import LATIN, THAI

HOUR = 3_600_000


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ------------------------------------------------------------------------ text
def _norm(expr: str) -> str:
    allowed = r"'[^\x{0E00}-\x{0E7F}a-zA-Z0-9 .,!?%()\-/\n]'"
    return (
        f"trim(regexp_replace(regexp_replace(nfc_normalize({expr}), {allowed}, ' ', 'g'),"
        r" '\s+', ' ', 'g'))"
    )


CLEAN = f"clean AS (SELECT doc_id, {_norm('text')} AS text FROM documents)"
THAI_TEXT = f"translate(lower(text), '{LATIN}', '{THAI}')"
THAI_CLEAN = f"clean AS (SELECT doc_id, {_norm(THAI_TEXT)} AS text FROM documents)"

PAGES = r"""
chunked AS (
  SELECT doc_id, length(text)::INT AS n_chars,
         CASE WHEN text = '' THEN [''] ELSE regexp_extract_all(text, '(?s).{1,14}') END AS parts
  FROM clean),
pages_of AS (
  SELECT doc_id, n_chars, unnest(range(len(parts)))::INT AS page_idx, unnest(parts) AS chunk,
         len(parts)::INT AS n_pages
  FROM chunked),
bpages AS (
  SELECT *, CASE WHEN n_chars = 0 THEN 0 ELSE page_idx * 14 + 1 END AS start_char,
         CASE WHEN n_chars = 0 THEN 0 ELSE least((page_idx + 1) * 14, n_chars) END AS end_char
  FROM pages_of)"""

_ENTRIES = ", ".join(
    f"({_quoted(ch)}, {sum(2 ** (int(d) - 1) for d in dots)})" for ch, dots in braille.DOTS.items()
)
# Every distinct character of the pages: its own entry, else that of its upper, else lower case.
MASKS = f"""
dict(ch, mask) AS (VALUES {_ENTRIES}),
chars AS (SELECT DISTINCT unnest(string_split(chunk, '')) AS ch FROM bpages),
masks AS (
  SELECT c.ch, coalesce(d.mask, u.mask, l.mask, 0) AS mask
  FROM chars c LEFT JOIN dict d ON d.ch = c.ch LEFT JOIN dict u ON u.ch = upper(c.ch)
  LEFT JOIN dict l ON l.ch = lower(c.ch) WHERE c.ch <> '')"""
# The fourteen cells of every page.
CELLS = f"""
{MASKS},
slots AS (SELECT *, unnest(range(14))::INT AS cell_idx FROM bpages),
cells AS (
  SELECT s.*, coalesce(nullif(substr(chunk, cell_idx + 1, 1), ''), ' ') AS ch,
         coalesce(m.mask, 0) AS mask
  FROM slots s LEFT JOIN masks m ON m.ch = substr(s.chunk, s.cell_idx + 1, 1))"""


def _glyph_pages(clean: str, extra: str = "") -> str:
    return f"""
WITH {clean}, {PAGES}, {CELLS}
SELECT doc_id, page_idx, {extra} string_agg(chr(10240 + mask::INT), '' ORDER BY cell_idx) AS glyphs,
       sum(bit_count(mask::INT))::INT AS raised
FROM cells GROUP BY ALL"""


def _pins() -> str:
    bits = " || ".join(f"(mask::INT >> {dot - 1} & 1)::VARCHAR" for dot in (1, 4, 2, 5, 3, 6))
    return f"""
WITH {THAI_CLEAN}, {PAGES}, {CELLS}
SELECT doc_id, page_idx, string_agg({bits}, '' ORDER BY cell_idx) AS pins
FROM cells GROUP BY ALL"""


_DOTS = " || ".join(f"CASE WHEN mask::INT >> {d} & 1 = 1 THEN '{d + 1}' ELSE '' END" for d in range(6))
_FLAGS = " || ".join(f"(mask::INT >> {d} & 1)::VARCHAR" for d in range(6))

TEXT = {
    "normalize_text": f"""
SELECT doc_id, {_norm("CASE WHEN doc_id % 10 = 0 THEN replace(text, 'e', 'e' || chr(769)) ELSE text END")}
       AS clean_text
FROM documents""",
    "quality_gate": f"""
WITH {CLEAN}, c AS (SELECT *, (doc_id * 37 % 101)::DOUBLE AS confidence FROM clean)
SELECT c.doc_id, confidence, text <> '' AND confidence >= 50 AS accepted,
       CASE WHEN confidence >= 80 THEN 'high' WHEN confidence >= 50 THEN 'medium' ELSE 'low' END AS band,
       CASE WHEN length(text) > 22 THEN substr(text, 1, 22) || '...' ELSE text END AS snippet,
       coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic
FROM c LEFT JOIN labels l ON l.doc_id = c.doc_id""",
    "paginate": f"""
WITH {CLEAN}, {PAGES}
SELECT *, page_idx > 0 AS has_prev, page_idx < n_pages - 1 AS has_next,
       'PAGE ' || (page_idx + 1) || '/' || n_pages AS page_label,
       '[' || start_char || '-' || end_char || ']' AS range_label
FROM bpages""",
    "braille_pages": _glyph_pages(CLEAN),
    "braille_thai": _glyph_pages(THAI_CLEAN, "chunk,"),
    "pin_vectors": _pins(),
    "braille_cells": f"""
WITH {CLEAN}, {PAGES}, {CELLS},
labelled AS (
  SELECT ch, chr(10240 + mask::INT) AS glyph, {_DOTS} AS dots, {_FLAGS} AS flags,
         'CELL #' || (cell_idx + 1) || CASE WHEN n_chars > 0 AND cell_idx < length(chunk)
           THEN ' [' || (start_char + cell_idx) || ']' ELSE '' END AS label
  FROM cells)
SELECT ch, glyph, dots, flags, count(*) AS cells, count(*) FILTER (label LIKE '%]') AS numbered,
       sum(length(label))::BIGINT AS label_chars
FROM labelled GROUP BY ALL""",
    "dictionary_audit": f"""
WITH both_texts AS (
  SELECT {_norm('text')} AS text FROM documents UNION ALL SELECT {_norm(THAI_TEXT)} FROM documents),
uses AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM both_texts)
         WHERE ch <> '' GROUP BY ch),
dict(ch, mask) AS (VALUES {_ENTRIES})
SELECT mask::INT AS mask, chr(10240 + mask::INT) AS glyph,
       string_agg(ch, '' ORDER BY unicode(ch)) AS chars, sum(n)::BIGINT AS uses
FROM uses JOIN dict USING (ch) GROUP BY mask HAVING count(*) > 1""",
    "page_at": f"""
WITH {CLEAN},
n AS (SELECT *, greatest(1, ceil(length(text) / 14.0))::INT AS n_pages, (doc_id % 50 - 5)::INT AS want FROM clean),
i AS (SELECT *, greatest(0, least(want, n_pages - 1)) AS page_idx,
             greatest(0, CASE WHEN want >= n_pages THEN 0 ELSE want END) AS kept_idx FROM n)
SELECT doc_id, n_pages, page_idx, substr(text, page_idx * 14 + 1, 14) AS chunk,
       least(page_idx + 1, n_pages - 1) AS next_idx, greatest(page_idx - 1, 0) AS prev_idx,
       (page_idx + 1) % n_pages AS wrap_next, (page_idx - 1 + n_pages) % n_pages AS wrap_prev,
       kept_idx, substr(text, kept_idx * 14 + 1, 14) AS kept_chunk
FROM i""",
}

# ---------------------------------------------------------------------- layout
# Words six to a row; positions are running sums in the row.
WORDS = r"""
split_words AS (
  SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents),
word_rows AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split_words),
sized AS (
  SELECT *, i // 6 AS r, i % 6 AS c, length(w) * 10 + i % 4 AS width,
         (doc_id * 7 + i * 13) % 9 - 1 AS gap_before,
         CASE WHEN (doc_id + i) % 29 = 0 THEN 45 ELSE 30 END AS height
  FROM word_rows),
placed_words AS (
  SELECT *, coalesce(sum(width) OVER prior, 0)
            + sum(CASE WHEN c = 0 THEN 0 ELSE gap_before END) OVER so_far AS x
  FROM sized
  WINDOW prior AS (PARTITION BY doc_id, r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         so_far AS (PARTITION BY doc_id, r ORDER BY i ROWS UNBOUNDED PRECEDING))"""
BOXES = f"""{WORDS},
boxes AS (
  SELECT 'doc-' || doc_id AS image, i::INT AS det_idx, w AS text,
         ((doc_id * 31 + i * 17) % 65) / 64.0::DOUBLE * 100.0::DOUBLE AS confidence,
         x::DOUBLE AS x0, (r * 40 + c * 4)::DOUBLE AS y0, (x + width)::DOUBLE AS x1,
         (r * 40 + c * 4 + height)::DOUBLE AS y1
  FROM placed_words WHERE (doc_id + i) % 37 <> 0 AND doc_id % 43 <> 7)"""
# Pairs that overlap by 0.4 of the shorter box; boxes meet in strips of 64 pixels.
PAIRS = f"""{BOXES},
strips AS (SELECT image, det_idx, y0, y1, unnest(range((y0 // 64)::INT, (y1 // 64)::INT + 1)) AS strip FROM boxes),
pairs AS (
  SELECT DISTINCT a.image, a.det_idx AS a, b.det_idx AS b
  FROM strips a JOIN strips b ON a.image = b.image AND a.strip = b.strip AND a.det_idx < b.det_idx
  WHERE (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least(a.y1 - a.y0, b.y1 - b.y0) >= 0.4::DOUBLE)"""
LINES = f"""{PAIRS},
edges AS (SELECT image, a, b FROM pairs UNION ALL SELECT image, b, a FROM pairs),
reach AS (
  SELECT image, det_idx AS a, det_idx AS label FROM boxes
  UNION
  SELECT r.image, e.b, r.label FROM reach r JOIN edges e ON e.image = r.image AND e.a = r.a
  WHERE r.label < e.b),
labels_of AS (SELECT image, a AS det_idx, min(label) AS label FROM reach GROUP BY ALL),
settled AS (SELECT b.*, l.label AS label0 FROM boxes b JOIN labels_of l USING (image, det_idx)),
line_stats AS (
  SELECT image, label0, avg((y0 + y1) / 2) AS line_centre, min(det_idx) AS first_idx,
         sum(x1 - x0) / sum(length(text)) AS char_width
  FROM settled GROUP BY ALL),
line_order AS (
  SELECT *, row_number() OVER (PARTITION BY image ORDER BY line_centre, first_idx)::INT - 1 AS line
  FROM line_stats),
placed AS (
  SELECT s.*, o.line, o.line_centre, o.char_width,
         row_number() OVER in_line::INT - 1 AS position_in_line, x0 - lag(x1) OVER in_line AS gap
  FROM settled s JOIN line_order o USING (image, label0)
  WINDOW in_line AS (PARTITION BY s.image, o.line ORDER BY x0, det_idx)),
spaced AS (SELECT *, gap > 0.35::DOUBLE * char_width AS space FROM placed)"""
IMAGE_TEXT = f"""{LINES},
texts AS (
  SELECT image,
         string_agg(CASE WHEN space OR (position_in_line = 0 AND line > 0) THEN ' ' ELSE '' END || text,
                    '' ORDER BY line, position_in_line) AS text,
         avg(confidence) AS confidence, count(*) AS boxes, max(line) + 1 AS lines
  FROM spaced GROUP BY image)"""
IMAGES = """
images AS (SELECT 'doc-' || doc_id AS image,
                  CASE WHEN doc_id % 41 = 0 THEN 'cannot decode ' || doc_id END AS error FROM documents)"""
SUMMARY = f"""
WITH RECURSIVE {IMAGE_TEXT}, {IMAGES},
summary AS (
  SELECT image, CASE WHEN error IS NULL THEN coalesce(text, '') ELSE '' END AS final_text,
         CASE WHEN error IS NULL THEN coalesce(round(confidence, 6), 0) ELSE 0 END AS overall_confidence,
         CASE WHEN error IS NOT NULL THEN 'ERROR: ' || error WHEN text IS NULL THEN 'no text detected'
              ELSE '' END AS note,
         boxes
  FROM images LEFT JOIN texts USING (image))"""

LAYOUT = {
    "detection_boxes": f"WITH {BOXES} SELECT *, x1 > x0 AND y1 > y0 AS drawable FROM boxes",
    # A line starts at a box when no pair joins one before it with itself or one after it.
    "line_breaks": f"""
WITH {PAIRS},
ranked AS (
  SELECT image, det_idx, y0, y1, lag(y0) OVER w AS p0, lag(y1) OVER w AS p1, row_number() OVER w AS pos
  FROM boxes WINDOW w AS (PARTITION BY image ORDER BY (y0 + y1) / 2, det_idx)),
spans AS (
  SELECT p.image, least(ra.pos, rb.pos) AS lo, max(greatest(ra.pos, rb.pos)) AS hi
  FROM pairs p JOIN ranked ra ON ra.image = p.image AND ra.det_idx = p.a
  JOIN ranked rb ON rb.image = p.image AND rb.det_idx = p.b GROUP BY ALL),
reached AS (
  SELECT r.*, max(s.hi) OVER (PARTITION BY r.image ORDER BY r.pos
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi
  FROM ranked r LEFT JOIN spans s ON s.image = r.image AND s.lo = r.pos)
SELECT image, det_idx, NOT coalesce(hi >= pos, FALSE) AS opens,
       round(CASE WHEN p0 IS NOT NULL THEN greatest(0, least(y1, p1) - greatest(y0, p0)) / least(y1 - y0, p1 - p0) END, 6) AS overlap
FROM reached""",
    "line_clusters": f"WITH RECURSIVE {LINES} SELECT image, det_idx, line, position_in_line FROM placed",
    "gap_ratios": f"""
WITH RECURSIVE {LINES}
SELECT image, det_idx, gap, round(char_width, 6) AS char_width, round(gap / char_width, 6) AS gap_ratio,
       coalesce(space, FALSE) AS space
FROM spaced""",
    "line_texts": f"""
WITH RECURSIVE {LINES}
SELECT image, line, string_agg(CASE WHEN space THEN ' ' ELSE '' END || text, '' ORDER BY position_in_line) AS text,
       count(*) AS boxes, round(any_value(line_centre), 6) AS line_centre
FROM spaced GROUP BY image, line""",
    "assemble_text": f"""
WITH RECURSIVE {IMAGE_TEXT}
SELECT image, text, round(confidence, 6) AS confidence, boxes, lines FROM texts""",
    "image_summary": f"{SUMMARY} SELECT image, final_text, overall_confidence, note FROM summary",
    "calibration_report": f"""
WITH RECURSIVE {LINES}
SELECT image, line, position_in_line, text, round(confidence, 1) AS confidence, gap AS gap_before_px,
       round(char_width, 2) AS char_width_px, round(gap / char_width, 3) AS gap_ratio,
       CASE WHEN space IS NULL THEN 'line-start' WHEN space THEN 'True' ELSE 'False' END AS space_inserted_before,
       x0, y0, x1, y1
FROM spaced WHERE image IN (SELECT 'doc-' || doc_id FROM documents WHERE doc_id % 41 <> 0)""",
    "run_counts": f"""
{SUMMARY}
SELECT regexp_replace(note, ': .*', '') AS note, count(*) AS images,
       sum(CASE WHEN note = '' THEN boxes ELSE 0 END)::BIGINT AS report_rows
FROM summary GROUP BY 1""",
}

# --------------------------------------------------------------------- results
CHOSEN = rf"""
{WORDS},
word_items AS (
  SELECT doc_id, i, ' ' || w AS wtext, (i % 6 * 100)::DOUBLE AS x0, (i // 6 * 40)::DOUBLE AS y0,
         (i % 6 * 100 + CASE WHEN i % 11 = 0 THEN 0 ELSE length(w) * 10 END)::DOUBLE AS x1,
         (i // 6 * 40 + 30)::DOUBLE AS y1,
         CASE WHEN i % 7 = 0 THEN 0.0 WHEN i % 5 <> 0 THEN i % 101 END::DOUBLE AS wconf
  FROM word_rows),
first_engine AS (
  SELECT doc_id, 1 AS engine_rank, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END AS text,
         CASE WHEN doc_id % 7 <> 0 THEN doc_id % 101 ELSE 90 END::DOUBLE AS confidence, doc_id % 2 = 0 AS listed
  FROM documents WHERE doc_id % 5 <> 0),
second_engine AS (
  SELECT doc_id, 2 AS engine_rank,
         trim(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\r?\n+', ' ', 'g'), '\s{{2,}}', ' ', 'g')) AS text,
         CASE WHEN doc_id % 6 = 0 THEN 85 ELSE doc_id % 97 + 1 END::DOUBLE AS confidence, TRUE AS listed
  FROM documents WHERE doc_id % 4 <> 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY engine_rank) AS rn
  FROM (SELECT * FROM first_engine WHERE trim(text) <> '' UNION ALL SELECT * FROM second_engine)),
chosen AS (
  SELECT d.doc_id, 'doc-' || d.doc_id AS image, coalesce(engine_rank, 0) AS engine_rank, coalesce(k.text, '') AS text,
         coalesce(confidence, 0)::DOUBLE AS confidence, coalesce(listed, FALSE) AS listed
  FROM documents d LEFT JOIN ranked k ON k.doc_id = d.doc_id AND rn = 1),
counted AS (
  SELECT c.*, count(w.i)::INT AS words, any_value(w.wtext) FILTER (w.i = 0) AS first_word,
         any_value(w.x1) FILTER (w.i = 0) AS first_x1
  FROM chosen c LEFT JOIN word_items w ON w.doc_id = c.doc_id AND c.listed GROUP BY ALL)"""

RESULTS = {
    "engine_cascade": f"WITH {CHOSEN} SELECT image, engine_rank, text, confidence, words FROM counted",
    "result_words": f"""
WITH {CHOSEN}
SELECT image, i::INT AS word_idx, trim(wtext) AS text,
       CASE WHEN wconf IS NULL OR wconf = 0 THEN confidence ELSE wconf END AS confidence,
       x1 > x0 AND y1 > y0 AS drawable
FROM chosen c JOIN word_items w ON w.doc_id = c.doc_id AND c.listed""",
    "word_badges": f"WITH {CHOSEN} SELECT image, words, floor(confidence + 0.5)::INT AS confidence FROM counted",
    "result_json": f"WITH {CHOSEN} SELECT image, text, confidence, words, first_word, first_x1 FROM counted",
    "image_paths": """
WITH p AS (
  SELECT '/scans/box-' || (doc_id % 7) || '/scan ' || doc_id
         || ['.JPG', '.jpeg', '.png', '.txt', '.tiff', '.jpg.gz'][doc_id % 6 + 1] AS path,
         doc_id % 6 < 3 AS uploadable
  FROM documents)
SELECT path, string_split(path, '/')[-1] AS name, substr(path, 8) AS relative, uploadable
FROM p WHERE lower(string_split(path, '.')[-1]) IN ('jpg', 'jpeg', 'png', 'bmp', 'webp', 'tif', 'tiff')""",
}

# ---------------------------------------------------------------------- frames
FRAMES = """
frames AS (
  SELECT 'label-' || label AS session_id, vec_id,
         [least(255, greatest(0, floor(e::DOUBLE * 255 + 128)))::INT FOR e IN embedding] AS p
  FROM embeddings),
px AS (SELECT session_id, vec_id, unnest(p) AS v, unnest(range(64)) AS i FROM frames),
near AS (
  SELECT *, i % 8 AS x, i // 8 AS y, lag(v) OVER w AS l, lead(v) OVER w AS r, lag(v, 8) OVER w AS u,
         lead(v, 8) OVER w AS d
  FROM px WINDOW w AS (PARTITION BY vec_id ORDER BY i)),
inner_px AS (SELECT * FROM near WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6),
focus_of AS (
  SELECT vec_id, greatest(0, floor((sum(lap * lap) / count(*) - (sum(lap) / count(*)) ** 2) * 10 + 0.5) / 10) AS focus
  FROM (SELECT vec_id, (l + r + u + d - 4 * v)::DOUBLE AS lap FROM inner_px) GROUP BY vec_id),
contrast_of AS (SELECT vec_id, max(v) - min(v) AS contrast FROM px GROUP BY vec_id),
energy AS (
  SELECT vec_id, contrast, x, y, abs(r - l) + abs(d - u) > greatest(16, 0.15::DOUBLE * contrast) AS stroke
  FROM inner_px JOIN contrast_of USING (vec_id)),
strokes_of AS (
  SELECT vec_id, contrast, count(*) FILTER (stroke)::INT AS strokes,
         count(*) FILTER (stroke AND x BETWEEN 1 AND 3 AND y BETWEEN 1 AND 3) / 4.0::DOUBLE AS d_tl,
         count(*) FILTER (stroke AND x BETWEEN 5 AND 7 AND y BETWEEN 1 AND 3) / 4.0::DOUBLE AS d_tr,
         count(*) FILTER (stroke AND x BETWEEN 1 AND 3 AND y BETWEEN 5 AND 7) / 4.0::DOUBLE AS d_bl,
         count(*) FILTER (stroke AND x BETWEEN 5 AND 7 AND y BETWEEN 5 AND 7) / 4.0::DOUBLE AS d_br
  FROM energy GROUP BY ALL),
follow AS (SELECT session_id, vec_id, lag(vec_id) OVER (PARTITION BY session_id ORDER BY vec_id) AS prev FROM frames),
motion_of AS (
  SELECT f.session_id, f.vec_id, coalesce(avg(abs(a.v - b.v)), 0) AS motion
  FROM follow f LEFT JOIN px a ON a.vec_id = f.vec_id LEFT JOIN px b ON b.vec_id = f.prev AND b.i = a.i
  GROUP BY ALL),
flags AS (
  SELECT vec_id, session_id, strokes >= 30 AND contrast >= 18 AS has_document, has_document AND d_tl >= 1 AS lock_tl,
         has_document AND d_tr >= 1 AS lock_tr, has_document AND d_bl >= 1 AS lock_bl, has_document AND d_br >= 1 AS lock_br,
         motion < 52 AS stable, motion, focus
  FROM strokes_of JOIN motion_of USING (vec_id) JOIN focus_of USING (vec_id))"""

TEXT_IMAGES = """
sizes AS (SELECT doc_id, text, greatest(1, ceil(length(text) / 32.0))::INT AS h FROM documents),
chars AS (SELECT doc_id, h, unnest(string_split(rpad(text, h * 32, ' '), '')) AS ch, unnest(range(h * 32)) AS i FROM sizes),
px AS (SELECT doc_id, h, i, least(255, unicode(ch) * 2)::BIGINT AS v FROM chars),
tiles AS (
  SELECT doc_id, sum(v) / count(*) AS mean, sqrt(count(*) * sum(v * v) - sum(v) * sum(v)) / count(*) AS std
  FROM px GROUP BY doc_id, (i // 32) // greatest(1, h // 4), (i % 32) // 8),
light AS (
  SELECT doc_id, count(*)::INT AS tiles, count(*) FILTER (std >= 40)::INT AS content_tiles,
         CASE WHEN count(*) FILTER (std >= 40) >= 2
              THEN max(mean) FILTER (std >= 40) - min(mean) FILTER (std >= 40)
              WHEN count(*) >= 2 THEN max(mean) - min(mean) END AS spread
  FROM tiles GROUP BY doc_id)"""

FRAME = {
    "frame_luma": """
WITH p AS (SELECT vec_id, [least(255, greatest(0, floor(e::DOUBLE * 255 + 128)))::INT FOR e IN embedding] AS p FROM embeddings)
SELECT vec_id, list_aggregate([floor(0.299::DOUBLE * p[i + 1] + 0.587::DOUBLE * p[(i + 1) % 64 + 1]
         + 0.114::DOUBLE * p[(i + 2) % 64 + 1] + 0.5)::INT FOR i IN range(64)], 'string_agg', ',') AS luma
FROM p""",
    "frame_focus": f"""
WITH {FRAMES}
SELECT vec_id, focus, CASE WHEN focus < 18000 THEN 'blurry' WHEN focus < 22000 THEN 'adjusting' ELSE 'sharp' END AS band
FROM focus_of""",
    "frame_strokes": f"WITH {FRAMES} SELECT * FROM strokes_of",
    "frame_motion": f"WITH {FRAMES} SELECT * FROM motion_of",
    "frame_flags": f"""
WITH {FRAMES}, n AS (SELECT *, lock_tl::INT + lock_tr::INT + lock_bl::INT + lock_br::INT AS locked FROM flags)
SELECT vec_id, has_document, lock_tl, lock_tr, lock_bl, lock_br, locked, (locked * 25)::INT AS alignment, stable,
       CASE WHEN NOT has_document OR focus < 18000 THEN 'blurry' WHEN focus < 22000 THEN 'adjusting' ELSE 'sharp' END AS focus_band
FROM n""",
    "frame_thinning": f"""
WITH s AS (SELECT user_id AS session_id, epoch_us(ts) // {6 * HOUR * 1000} AS slot, ts, event_id, value FROM events)
SELECT session_id, slot, event_id, value FROM s
QUALIFY row_number() OVER (PARTITION BY session_id, slot ORDER BY ts, event_id) = 1""",
    "tile_lighting": f"""
WITH {TEXT_IMAGES}
SELECT doc_id, tiles, content_tiles, round(spread, 6) AS spread, coalesce(spread > 16, FALSE) AS uneven FROM light""",
    "image_quality": f"""
WITH {TEXT_IMAGES},
near AS (
  SELECT *, CASE WHEN i % 32 = 0 THEN lead(v) OVER w ELSE lag(v) OVER w END AS l,
         CASE WHEN i % 32 = 31 THEN lag(v) OVER w ELSE lead(v) OVER w END AS r,
         coalesce(lag(v, 32) OVER w, lead(v, 32) OVER w, v) AS u,
         coalesce(lead(v, 32) OVER w, lag(v, 32) OVER w, v) AS d
  FROM px WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
whole AS (
  SELECT doc_id, sqrt(count(*) * sum(v * v) - sum(v) * sum(v)) / count(*) AS std,
         (count(*) * sum(lap * lap) - sum(lap) * sum(lap)) / (count(*)::DOUBLE * count(*)) AS laplacian
  FROM (SELECT *, l + r + u + d - 4 * v AS lap FROM near) GROUP BY doc_id)
SELECT doc_id, round(std, 6) AS std, round(laplacian, 4) AS laplacian, std >= 58 AND laplacian >= 50000 AS high_quality,
       coalesce(spread > 16, FALSE) AND NOT (std >= 58 AND laplacian >= 50000) AS needs_threshold,
       doc_id % 3 = 0 AS needs_denoise, CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 0 END AS denoise_strength
FROM whole JOIN light USING (doc_id)""",
    "resize_plan": """
WITH s AS (SELECT doc_id, (doc_id * 7 % 1000)::INT AS width, (length(text) % 900)::INT AS height FROM documents),
k AS (
  SELECT *, CASE WHEN least(width, height) >= 640 OR least(width, height) = 0 THEN 1.0::DOUBLE
                 WHEN 640.0::DOUBLE / least(width, height) > 2.2::DOUBLE THEN 2.0::DOUBLE
                 ELSE 640.0::DOUBLE / least(width, height) END AS scale
  FROM s)
SELECT *, round_even(width * scale, 0)::INT AS new_width, round_even(height * scale, 0)::INT AS new_height FROM k""",
}

# --------------------------------------------------------------------- capture
JUDGED = """
flagged AS (
  SELECT user_id AS session_id, ts, event_id, epoch_us(ts) // 1000 AS ms, value * 16 AS focus, event_type <> 'signup' AS doc,
         event_id % 13 <> 0 AS tl, event_id % 11 <> 0 AS tr, event_id % 17 <> 0 AS bl,
         event_id % 19 <> 0 AND event_id % 13 <> 0 AS br, event_id % 7 <> 0 AS stable
  FROM events),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n,
         CASE WHEN NOT doc THEN 'NO_DOC'
              WHEN tl AND tr AND bl AND br THEN
                CASE WHEN focus < 80 THEN 'BLURRY' WHEN focus < 160 THEN 'ADJUSTING'
                     WHEN NOT stable THEN 'MOVING' END
              WHEN NOT tl AND NOT tr AND NOT bl AND NOT br THEN 'ALL_OUT'
              WHEN NOT tl AND NOT tr THEN 'TOP' WHEN NOT bl AND NOT br THEN 'BOTTOM'
              WHEN NOT tl AND NOT bl THEN 'LEFT' WHEN NOT tr AND NOT br THEN 'RIGHT'
              WHEN NOT tl THEN 'TL' WHEN NOT tr THEN 'TR' WHEN NOT bl THEN 'BL' ELSE 'BR' END AS code
  FROM flagged)"""


def _held(judged: str, key: str, hold: int, warn: int) -> str:
    """Recursion over row numbers. ``start`` is null outside a hold."""
    step = f"""
  SELECT j.session_id, j.n, j.{key}, j.ms, j.code,
         CASE WHEN j.code IS NOT NULL THEN NULL WHEN h.start IS NULL OR h.fired THEN j.ms ELSE h.start END AS start,
         CASE WHEN j.code IS NOT NULL OR h.start IS NULL OR h.fired THEN FALSE
              ELSE h.warned OR j.ms - h.start >= {warn} END AS warned,
         CASE WHEN j.code IS NOT NULL OR h.start IS NULL OR h.fired THEN FALSE
              ELSE j.ms - h.start >= {hold} END AS fired,
         CASE WHEN j.code IS NOT NULL OR h.start IS NULL OR h.fired THEN FALSE ELSE h.warned END AS before
  FROM held h JOIN judged j ON j.session_id = h.session_id AND j.n = h.n + 1"""
    return f"""{judged},
held AS (
  SELECT session_id, n, {key}, ms, code, CASE WHEN code IS NULL THEN ms END AS start, FALSE AS warned,
         FALSE AS fired, FALSE AS before
  FROM judged WHERE n = 1
  UNION ALL {step}),
emitted AS (
  SELECT session_id, {key}, n, 0 AS seq, code, NULL::BIGINT AS elapsed_ms FROM held WHERE code IS NOT NULL
  UNION ALL
  SELECT session_id, {key}, n, 0, CASE WHEN ms = start THEN 'HOLD_START' WHEN warned THEN 'WARN' ELSE 'HOLDING' END,
         ms - start
  FROM held WHERE code IS NULL AND NOT before
  UNION ALL
  SELECT session_id, {key}, n, 1, 'FIRE', ms - start FROM held WHERE fired)"""


HELD = _held(JUDGED, "event_id", 20 * HOUR, 10 * HOUR)
_TEXTS = ", ".join(f"({_quoted(c)}, {_quoted(t)})" for c, t in UTTERANCES.items())


def _throttled(rows: str, any_ms: int, same_ms: int) -> str:
    """Recursion over the messages ``said`` (session_id, n, ms, text, forced, ...)."""
    return f"""{rows},
heard AS (
  SELECT session_id, n, ms AS last_ms, text AS last_text, TRUE AS passed FROM said WHERE n = 1
  UNION ALL
  SELECT s.session_id, s.n, CASE WHEN p THEN s.ms ELSE last_ms END, CASE WHEN p THEN s.text ELSE last_text END, p
  FROM (
    SELECT s.*, h.last_ms, h.last_text,
           s.forced OR (s.ms - h.last_ms >= {any_ms} AND (s.text <> h.last_text OR s.ms - h.last_ms >= {same_ms})) AS p
    FROM heard h JOIN said s ON s.session_id = h.session_id AND s.n = h.n + 1) s)"""


_SAID = f"""
texts(code, text) AS (VALUES {_TEXTS}),
said AS (
  SELECT e.session_id, e.event_id, e.seq, t.text, e.code IN ('WARN', 'FIRE') AS forced, j.ms,
         row_number() OVER (PARTITION BY e.session_id ORDER BY e.n, e.seq) AS n
  FROM emitted e JOIN texts t USING (code) JOIN judged j ON j.session_id = e.session_id AND j.n = e.n WHERE TRUE"""
SPOKEN = _throttled(
    f"{HELD}, {_SAID})",
    18 * HOUR,
    25 * HOUR,
)
MESSAGES = _throttled(
    """
said AS (
  SELECT user_id AS session_id, event_id, event_type AS text, event_type = 'error' AND event_id % 3 = 0 AS forced,
         epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events)""",
    18 * HOUR,
    25 * HOUR,
)
# Exact ties of a tenth of a second go up.
_LEFT = f"greatest(0, {20 * HOUR} - elapsed_ms)"
REMAINING = (
    f"CASE WHEN elapsed_ms IS NOT NULL THEN printf('%.1f', ({_LEFT} + "
    f"CASE WHEN {_LEFT} % 500 = 250 THEN 50 ELSE 0 END) / 1000.0::DOUBLE) END"
)

LIVE_JUDGED = f"""{FRAMES},
judged AS (
  SELECT session_id, vec_id, vec_id * 300 AS ms, motion,
         row_number() OVER (PARTITION BY session_id ORDER BY vec_id) AS n,
         CASE WHEN NOT has_document THEN 'NO_DOC'
              WHEN lock_tl AND lock_tr AND lock_bl AND lock_br THEN
                CASE WHEN focus < 18000 THEN 'BLURRY' WHEN focus < 22000 THEN 'ADJUSTING'
                     WHEN NOT stable THEN 'MOVING' END
              WHEN NOT (lock_tl OR lock_tr OR lock_bl OR lock_br) THEN 'ALL_OUT'
              WHEN NOT (lock_tl OR lock_tr) THEN 'TOP' WHEN NOT (lock_bl OR lock_br) THEN 'BOTTOM'
              WHEN NOT (lock_tl OR lock_bl) THEN 'LEFT' WHEN NOT (lock_tr OR lock_br) THEN 'RIGHT'
              WHEN NOT lock_tl THEN 'TL' WHEN NOT lock_tr THEN 'TR' WHEN NOT lock_bl THEN 'BL' ELSE 'BR' END AS code
  FROM flags)"""
LIVE = _throttled(
    f"""{_held(LIVE_JUDGED, "vec_id", 12_000, 6_000)},
texts(code, text) AS (VALUES {_TEXTS}),
said AS (
  SELECT e.session_id, e.vec_id, e.seq, t.text, e.code IN ('WARN', 'FIRE') AS forced, e.vec_id * 300 AS ms,
         row_number() OVER (PARTITION BY e.session_id ORDER BY e.n, e.seq) AS n
  FROM emitted e JOIN texts t USING (code))""",
    1800,
    2500,
)

CAPTURE = {
    "guidance_codes": f"""
WITH RECURSIVE {HELD} SELECT session_id, event_id, seq, code, code IN ('WARN', 'FIRE') AS forced FROM emitted""",
    "hold_fire": f"""
WITH RECURSIVE {HELD}
SELECT session_id, event_id, code, elapsed_ms, {REMAINING} AS remaining_s FROM emitted WHERE elapsed_ms IS NOT NULL""",
    "first_shot": f"""
WITH RECURSIVE {HELD}, shots AS (SELECT session_id, min(n) AS shot FROM emitted WHERE code = 'FIRE' GROUP BY ALL)
SELECT session_id, count(*) AS events, max(CASE WHEN code = 'FIRE' THEN event_id ELSE -1 END) AS shot
FROM emitted LEFT JOIN shots USING (session_id) WHERE shots.shot IS NULL OR n <= shots.shot GROUP BY session_id""",
    "held_runs": f"""
WITH {JUDGED}, g AS (
  SELECT *, sum((code IS NOT NULL)::INT) OVER (PARTITION BY session_id ORDER BY n)::BIGINT AS run FROM judged)
SELECT session_id, run, min(ms) AS first_ms, max(ms) AS last_ms, count(*) AS frames,
       max(ms) - min(ms) >= {20 * HOUR} AS held
FROM g WHERE code IS NULL GROUP BY ALL""",
    "message_throttle": f"""
WITH RECURSIVE {MESSAGES}
SELECT session_id, event_id, text, forced FROM said JOIN heard USING (session_id, n) WHERE passed""",
    "spoken_guidance": f"""
WITH RECURSIVE {SPOKEN}
SELECT session_id, event_id, seq, text, forced FROM said JOIN heard USING (session_id, n) WHERE passed""",
    "hold_fire_stream": f"""
WITH RECURSIVE {HELD} SELECT session_id, event_id, code, elapsed_ms FROM emitted WHERE elapsed_ms IS NOT NULL""",
    "live_capture_stream": f"""
WITH RECURSIVE {LIVE}
SELECT e.session_id, e.vec_id * 300 + 1704067200000 AS ms, e.seq, e.code, coalesce(e.elapsed_ms, -1) AS elapsed_ms, round(m.motion, 6) AS motion,
       coalesce(h.passed, FALSE) AS spoken
FROM emitted e JOIN motion_of m ON m.vec_id = e.vec_id
LEFT JOIN said s ON s.session_id = e.session_id AND s.vec_id = e.vec_id AND s.seq = e.seq
LEFT JOIN heard h ON h.session_id = s.session_id AND h.n = s.n""",
}
CAPTURE["message_throttle_stream"] = CAPTURE["message_throttle"]
CAPTURE["thinned_stream"] = f"""
SELECT user_id AS session_id, epoch_us(ts) // {6 * HOUR * 1000} AS slot, epoch_us(ts) // 1000 AS ms, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, epoch_us(ts) // {6 * HOUR * 1000} ORDER BY ts, event_type) = 1"""
# What lies between two rows of control is a session of its own; nothing counts after a stop.
SWITCHED = JUDGED.replace(
    "judged AS (",
    """controlled AS (
  SELECT *, CASE WHEN event_id % 23 = 0 THEN 'stop' WHEN event_id % 29 = 0 THEN 'start' END AS control FROM flagged),
segments AS (
  SELECT * REPLACE (session_id * 1000000 + count(control) OVER w AS session_id), last_value(control IGNORE NULLS) OVER w AS latest
  FROM controlled WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
judged AS (""",
).replace("AS code\n  FROM flagged)", "AS code\n  FROM segments WHERE control IS NULL AND latest IS DISTINCT FROM 'stop')")
CAPTURE["switched_sessions"] = f"""
WITH RECURSIVE {_held(SWITCHED, "event_id", 20 * HOUR, 10 * HOUR)}
SELECT session_id // 1000000 AS session_id, event_id, seq, code, coalesce(elapsed_ms, -1) AS elapsed_ms FROM emitted"""
CAPTURE["switched_sessions_stream"] = CAPTURE["switched_sessions"]
# Without automatic capture no hold ends; without voice only forced messages are left.
CAPTURE["silent_capture"] = f"""
WITH RECURSIVE {_throttled(f"{_held(JUDGED, 'event_id', 10**15, 10 * HOUR)}, {_SAID} AND e.code IN ('WARN', 'FIRE'))", 18 * HOUR, 25 * HOUR)}
SELECT session_id, event_id, seq, text FROM said JOIN heard USING (session_id, n) WHERE passed"""
BLANK_LINES = LINES.replace("w AS text", "CASE WHEN doc_id % 3 = 0 THEN '' ELSE w END AS text").replace(
    "sum(x1 - x0) / sum(length(text)) AS char_width",
    "coalesce(sum(x1 - x0) / nullif(sum(length(text)), 0), median(y1 - y0)) AS char_width",
)
LAYOUT["blank_line_widths"] = f"""
WITH RECURSIVE {BLANK_LINES}
SELECT image, det_idx, round(char_width, 6) AS char_width, round(gap / char_width, 6) AS gap_ratio, coalesce(space, FALSE) AS space
FROM spaced WHERE text = ''"""
LAYOUT["strict_lines"] = LAYOUT["line_clusters"].replace(">= 0.4::DOUBLE", ">= 0.75::DOUBLE")
LAYOUT["calibration_files"] = LAYOUT["calibration_report"]
LAYOUT["summary_files"] = LAYOUT["image_summary"]

ORACLES = {**TEXT, **LAYOUT, **RESULTS, **FRAME, **CAPTURE}
