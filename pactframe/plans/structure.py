"""Structuring queries over blocks, lines and labels of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..operators import structure as st
from ..session import materialize
from .registry import plan

RIGHT = """r AS (SELECT doc_id, r AS body_right FROM (SELECT doc_id, round_even(x0, 0) AS l, round_even(x1, 0) AS r, count(*) AS n,
  min(page * 1000 + block_no) AS f FROM v_blocks WHERE n_lines >= 3 GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1)"""
WIDE = f"""{RIGHT}, w AS (SELECT b.*, body_right FROM v_blocks b JOIN r USING (doc_id) WHERE body_right <> 0 AND abs(round_even(x1, 0) - body_right) <= 8)"""
LEFT = f"""{WIDE}, l AS (SELECT doc_id, v AS body_left FROM (SELECT doc_id, round_even(x0, 0) AS v, count(*) AS n, min(page * 1000 + block_no) AS f
  FROM w GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1)"""
BANDS = f"""bands AS (SELECT b.doc_id, CASE WHEN t IS NOT NULL AND coalesce(body_right, 0) <> 0 THEN t ELSE 0.06 END AS header_band,
  CASE WHEN t IS NOT NULL AND coalesce(body_right, 0) <> 0 THEN m ELSE 0.85 END AS footer_band FROM
  (SELECT doc_id, min(y0 / page_height) FILTER (n_lines >= 2) AS t, max(y1 / page_height) FILTER (n_lines >= 2) AS m FROM v_blocks GROUP BY 1) b LEFT JOIN r USING (doc_id))"""
FURNITURE = r"""f AS (SELECT doc_id, pattern, count(*) AS n FROM (SELECT b.doc_id, regexp_replace(trim(text), '\d+', '#', 'g') AS pattern FROM v_blocks b JOIN bands USING (doc_id)
  WHERE (y0 / page_height >= footer_band OR y0 / page_height <= header_band) AND trim(text) <> '') GROUP BY 1, 2
  HAVING count(*) >= greatest(3, (SELECT floor((max(page) + 1) * 0.2) FROM v_blocks v WHERE v.doc_id = doc_id)))"""
INDENT = f"""{LEFT}, o AS (SELECT w.doc_id, CASE WHEN round_even(x0, 0) - body_left > 2 AND round_even(x0, 0) - body_left <= (w.body_right - body_left) / 4 AND body_left <> 0
  THEN round_even(x0, 0) - body_left END AS off, count(*) AS n, min(page * 1000 + block_no) AS f FROM w JOIN l USING (doc_id) GROUP BY 1, 2),
i AS (SELECT doc_id, CASE WHEN max(bn) >= 3 AND max(bn) / max(total) >= 0.1 THEN max(boff) ELSE 0 END AS paragraph_indent FROM
 (SELECT doc_id, first_value(off) OVER x AS boff, first_value(CASE WHEN off IS NOT NULL THEN n END) OVER x AS bn, sum(n) OVER (PARTITION BY doc_id) AS total FROM o
  WINDOW x AS (PARTITION BY doc_id ORDER BY off IS NULL, n DESC, f)) GROUP BY doc_id)"""


@plan("p1_titles", sql=r"""
SELECT doc_id, line_no, replace(lower(trim(regexp_replace(t, '\s+', ' ', 'g'))), 'ß', 'ss') AS title,
  replace(lower(trim(regexp_replace(trim(regexp_replace(t, '(?i)^(?:chapter|section|appendix)?\s*(?:[A-Z]\.?)?\d+(?:\.\d+)*\.?\s+', '')), '\s+', ' ', 'g'))), 'ß', 'ss') AS bare
  FROM (SELECT doc_id, line_no, translate(text, '`''"‘’“”–—', '') AS t0, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '‘', ''), '’', ''), '“', ''), '”', ''), '`', ''), '''', ''), '"', ''), '–', '-'), '—', '-') AS t FROM v_labelled)""")
def p1(src):
    text = F.col("text")
    return src.view("labelled").select(
        "doc_id", "line_no", tx.normal_title(text).alias("title"), tx.normal_title(tx.without_number(text)).alias("bare"))


@plan("p2_reading_order", sql="""
SELECT doc_id, page, block_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y0 / 3, 0), x0, block_no) AS reading FROM v_blocks""")
def p2(src):
    return st.reading_order(src.view("blocks")).select("doc_id", "page", "block_no", "reading")


@plan("p3_profile", sql=f"""
WITH {INDENT}, {BANDS},
s AS (SELECT doc_id, v AS body_size FROM (SELECT doc_id, round(size, 1) AS v, sum(length(trim(text))) AS n, min(page * 1000 + block_no) AS f FROM v_blocks GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1)
SELECT d.doc_id, page_count, coalesce(body_size, 12.0) AS body_size, coalesce(body_right, 0) AS body_right, coalesce(body_left, 0) AS body_left,
  round(header_band, 6) AS header_band, round(footer_band, 6) AS footer_band, coalesce(paragraph_indent, 0) AS paragraph_indent
  FROM (SELECT doc_id, max(page) + 1 AS page_count FROM v_blocks GROUP BY 1) d LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)
  LEFT JOIN l USING (doc_id) LEFT JOIN bands USING (doc_id) LEFT JOIN i USING (doc_id)""")
def p3(src):
    out = st.profile(src.view("blocks"))
    return out.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("header_band", "footer_band", "body_size")})


@plan("p4_vocabulary", sql="""
SELECT doc_id, word, sum(1 - h) AS n, sum(h) AS hyphenated FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(line), '[A-Za-z0-9]+')) AS word, 0 AS h FROM v_lines
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(line), '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+')), 1 FROM v_lines) GROUP BY 1, 2""")
def p4(src):
    return st.vocabulary(src.view("lines"))


@plan("p5_text_left", sql=f"WITH {LEFT} SELECT * FROM l")
def p5(src):
    blocks = src.view("blocks")
    return st.text_left(blocks, st.column_right(blocks))


@plan("p6_margin_bands", sql=f"WITH {RIGHT}, {BANDS} SELECT doc_id, round(header_band, 6) AS header_band, round(footer_band, 6) AS footer_band FROM bands")
def p6(src):
    blocks = src.view("blocks")
    bands = st.margin_bands(blocks, st.column_right(blocks))
    return bands.select("doc_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("header_band", "footer_band")])


@plan("p7_furniture", sql=f"WITH {RIGHT}, {BANDS}, {FURNITURE.replace('v.doc_id = doc_id', 'v.doc_id = any_value(b.doc_id)') if False else FURNITURE.replace('HAVING count(*) >= greatest(3, (SELECT floor((max(page) + 1) * 0.2) FROM v_blocks v WHERE v.doc_id = doc_id))', '')} SELECT doc_id, pattern, n FROM f JOIN (SELECT doc_id, max(page) + 1 AS pages FROM v_blocks GROUP BY 1) USING (doc_id) WHERE n >= greatest(3, floor(pages * 0.2))")
def p7(src):
    blocks = src.view("blocks")
    return st.furniture_patterns(blocks, st.margin_bands(blocks, st.column_right(blocks)))


@plan("p7_boilerplate_lines", sql=r"""
SELECT pattern, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, regexp_replace(trim(regexp_replace(line, '\s+', ' ', 'g')), '\d+', '#', 'g') AS pattern FROM v_lines)
 WHERE pattern <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""")
def p7_corpus(src):
    return st.boilerplate_lines(src.view("lines"))


@plan("p8_page_numbers", sql=r"""
SELECT doc_id, line_no, text FROM (SELECT doc_id, line_no, text FROM v_blocks UNION ALL SELECT doc_id, line_no, unnest(string_split(text, ' ')) FROM v_blocks)
 WHERE trim(text) <> '' AND (regexp_matches(trim(text), '^\d{1,5}$') OR regexp_matches(trim(text), '(?i)^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$'))""")
def p8(src):
    blocks = src.view("blocks").select("doc_id", "line_no", "text")
    # Whole blocks, and every word as a block of its own.
    words = blocks.select("doc_id", "line_no", F.explode(F.split("text", " ")).alias("text"))
    return blocks.unionByName(words).where(st.is_page_number(F.col("text")))


@plan("p9_paragraph_indent", sql=f"WITH {INDENT} SELECT * FROM i")
def p9(src):
    blocks = src.view("blocks")
    return st.paragraph_indent(blocks, st.column_right(blocks))


HABITS = """b AS (SELECT doc_id, head, regexp_extract(nl, '^([A-Za-z0-9]+)', 1) AS tail FROM (SELECT doc_id, regexp_extract(line, '([A-Za-z0-9]+)-$', 1) AS head,
  lead(line) OVER (PARTITION BY doc_id, block ORDER BY line_no) AS nl FROM v_wrapped) WHERE head <> '' AND regexp_extract(nl, '^([A-Za-z0-9]+)', 1) <> ''),
v AS (SELECT doc_id, word, sum(1 - h) AS n, sum(h) AS hy FROM (SELECT doc_id, unnest(regexp_extract_all(lower(line), '[A-Za-z0-9]+')) AS word, 0 AS h FROM v_wrapped
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(lower(line), '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)+')), 1 FROM v_wrapped) GROUP BY 1, 2)"""
HABIT = """SELECT b.doc_id, count(m.word) AS merged, count(c.word) AS compound, count(m.word) > count(c.word) AS breaks_hyphenate FROM b
  LEFT JOIN v m ON m.doc_id = b.doc_id AND m.word = lower(head || tail) AND m.n > 0
  LEFT JOIN v c ON c.doc_id = b.doc_id AND c.word = lower(head || '-' || tail) AND c.hy > 0 GROUP BY 1"""


@plan("p10_breaks_hyphenate", sql=f"WITH {HABITS} {HABIT}")
def p10(src):
    lines = src.view("wrapped")
    return st.breaks_hyphenate(st.line_breaks(lines, ["doc_id", "block"]), st.vocabulary(lines))


# A block's text line by line, each line joined to all of the text before it.
JOINED = rf"""WITH RECURSIVE {HABITS}, h AS ({HABIT}),
l AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id, block ORDER BY line_no) AS i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM v_wrapped),
r AS (SELECT doc_id, block, i, line AS text FROM l WHERE i = 1
 UNION ALL SELECT x.doc_id, x.block, x.i, CASE
   WHEN lft <> '' AND rgt <> '' THEN CASE WHEN (coalesce(c.hy, 0) > 0 AND coalesce(w.n, 0) = 0) OR regexp_matches(right(lft, 1), '\d') <> regexp_matches(left(rgt, 1), '\d')
     OR (coalesce(w.n, 0) = 0 AND NOT coalesce(h.breaks_hyphenate, false)) THEN text || line ELSE left(text, length(text) - 1) || line END
   WHEN tl <> '' AND hd <> '' AND coalesce(g.n, 0) > coalesce(k.n, 0) THEN text || line ELSE text || ' ' || line END
 FROM (SELECT r.doc_id, r.block, l.i, r.text, l.line, regexp_extract(r.text, '([A-Za-z0-9]+)-$', 1) AS lft, regexp_extract(l.line, '^([A-Za-z0-9]+)', 1) AS rgt,
     regexp_extract(r.text, '([A-Za-z]+)$', 1) AS tl, regexp_extract(l.line, '^([A-Za-z]+)', 1) AS hd FROM r JOIN l ON l.doc_id = r.doc_id AND l.block = r.block AND l.i = r.i + 1) x
 LEFT JOIN v w ON w.doc_id = x.doc_id AND w.word = lower(lft || rgt) LEFT JOIN v c ON c.doc_id = x.doc_id AND c.word = lower(lft || '-' || rgt)
 LEFT JOIN v g ON g.doc_id = x.doc_id AND g.word = lower(tl || hd) LEFT JOIN v k ON k.doc_id = x.doc_id AND k.word = lower(CASE WHEN length(tl) >= length(hd) THEN tl ELSE hd END)
 LEFT JOIN h ON h.doc_id = x.doc_id)
SELECT doc_id, block, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, block ORDER BY i DESC) = 1"""


@plan("p11_join_lines", sql=JOINED)
def p11(src):
    lines = materialize(src.view("wrapped"), "wrapped")
    vocab = materialize(st.vocabulary(lines), "vocabulary")
    habits = materialize(st.breaks_hyphenate(st.line_breaks(lines, ["doc_id", "block"]), vocab), "habits")
    return st.join_lines(lines, vocab, habits)


CLASSIFY_SQL = rf"""{INDENT}, {BANDS}, {FURNITURE.split(' HAVING')[0].replace('GROUP BY 1, 2', 'GROUP BY 1, 2')}""".rstrip()
CLASSIFY_SQL = CLASSIFY_SQL.split("\n  HAVING")[0] + r"""),
k AS (SELECT doc_id, pattern FROM f JOIN (SELECT doc_id, max(page) + 1 AS pages FROM v_blocks GROUP BY 1) USING (doc_id) WHERE n >= greatest(3, floor(pages * 0.2))),
s AS (SELECT doc_id, v AS body_size FROM (SELECT doc_id, round(size, 1) AS v, sum(length(trim(text))) AS n, min(page * 1000 + block_no) AS f FROM v_blocks GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1),
c AS (SELECT b.*, CASE WHEN trim(text) = '' THEN 'furniture'
  WHEN (y0 / page_height >= footer_band OR y0 / page_height <= header_band) AND (regexp_matches(trim(text), '^\d{1,5}$')
    OR regexp_matches(trim(text), '(?i)^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$') OR k.pattern IS NOT NULL) THEN 'furniture'
  WHEN regexp_matches(text, '(?is)^\s*(Figure|Table)\s+(?:[A-Z]\.?)?\d+(?:\.\d+)*\s*[.:](\s.*)?$') THEN 'caption'
  WHEN font = 'CMMI10' THEN 'equation' WHEN size > body_size + 0.5 AND italic = 0 THEN 'heading' ELSE 'paragraph' END AS type
  FROM v_blocks b JOIN bands USING (doc_id) JOIN s USING (doc_id)
  LEFT JOIN k ON k.doc_id = b.doc_id AND k.pattern = regexp_replace(trim(text), '\d+', '#', 'g'))"""


def _classified(src):
    blocks = src.view("blocks")
    profiles = materialize(st.profile(blocks), "profiles")
    bands = profiles.select("doc_id", "header_band", "footer_band")
    return st.classify(blocks, profiles, st.furniture_patterns(blocks, bands))


@plan("p12_classify", sql=f"WITH {CLASSIFY_SQL} SELECT doc_id, line_no, type FROM c")
def p12(src):
    return _classified(src).select("doc_id", "line_no", "type")


CAP = r"regexp_matches(text, '(?is)^\s*(Figure|Table)\s+(?:[A-Z]\.?)?\d+(?:\.\d+)*\s*[.:](\s.*)?$')"


@plan("p13_drop_claimed", sql=f"""
WITH g AS (SELECT doc_id, page, 30.0 AS rx0, 320.0 AS rx1, y0 - 60 AS ry0, y1 + 10 AS ry1 FROM v_blocks WHERE {CAP})
SELECT doc_id, line_no FROM v_blocks b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = b.doc_id AND g.page = b.page
  AND (x0 + x1) / 2 >= rx0 AND (x0 + x1) / 2 < rx1 AND (y0 + y1) / 2 >= ry0 AND (y0 + y1) / 2 < ry1)""")
def p13(src):
    blocks = src.view("blocks")
    regions = st.captions(blocks).select(
        "doc_id", "page", F.lit(30.0).alias("rx0"), F.lit(320.0).alias("rx1"),
        (F.col("y0") - 60).alias("ry0"), (F.col("y1") + 10).alias("ry1"))
    return st.drop_claimed(blocks, regions).select("doc_id", "line_no")


@plan("p14_captions", sql=f"SELECT doc_id, page, block_no, lower(regexp_extract(text, '^\\s*(\\w+)', 1)) AS kind, text AS caption FROM v_blocks WHERE {CAP}")
def p14(src):
    return st.captions(src.view("blocks")).select("doc_id", "page", "block_no", "kind", "caption")


@plan("p15_pair_captions", sql=f"""
WITH c AS (SELECT *, lower(regexp_extract(text, '^\\s*(\\w+)', 1)) AS ckind FROM v_blocks WHERE {CAP}),
g AS (SELECT doc_id, page, block_no AS region_id, CASE WHEN kind = 'equation' THEN 'figure' ELSE 'table' END AS kind, y0 AS ry0, y1 AS ry1 FROM v_blocks WHERE kind IN ('equation', 'clause')),
p AS (SELECT g.doc_id, g.page, region_id, g.kind, c.text AS caption, CASE WHEN g.kind = 'figure' THEN 0 ELSE 1 END AS side, c.y0 - ry1 AS gap, c.block_no
    FROM g JOIN c ON c.doc_id = g.doc_id AND c.page = g.page AND c.ckind = g.kind WHERE c.y0 >= ry1 - 2
  UNION ALL SELECT g.doc_id, g.page, region_id, g.kind, c.text, CASE WHEN g.kind = 'figure' THEN 1 ELSE 0 END, ry0 - c.y1, c.block_no
    FROM g JOIN c ON c.doc_id = g.doc_id AND c.page = g.page AND c.ckind = g.kind WHERE c.y1 <= ry0 + 2)
SELECT g.doc_id, g.page, g.region_id, g.kind, caption FROM g LEFT JOIN (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id, page, region_id ORDER BY side, gap, block_no) = 1) p
  USING (doc_id, page, region_id)""")
def p15(src):
    blocks = src.view("blocks")
    kind = F.when(F.col("kind") == "equation", "figure").otherwise("table")
    regions = blocks.where(F.col("kind").isin("equation", "clause")).select(
        "doc_id", "page", F.col("block_no").alias("region_id"), kind.alias("kind"),
        F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), F.col("x1").alias("rx1"), F.col("y1").alias("ry1"))
    return st.pair_captions(regions, st.captions(blocks)).select("doc_id", "page", "region_id", "kind", "caption")


@plan("p15_table_captions", sql=f"""
WITH c AS (SELECT * FROM v_blocks WHERE {CAP} AND lower(text) LIKE 'table%'),
g AS (SELECT doc_id, page, block_no AS region_id, x0 AS rx0, x1 AS rx1, y0 AS ry0, y1 AS ry1 FROM v_blocks WHERE kind = 'clause')
SELECT g.doc_id, g.page, region_id, (SELECT c.text FROM c WHERE c.doc_id = g.doc_id AND c.page = g.page AND c.x1 > rx0 AND c.x0 < rx1
  AND ((c.y1 > ry0 AND c.y0 < ry1) OR least(abs(c.y1 - ry0), abs(ry1 - c.y0)) < 80) ORDER BY greatest(0, ry0 - c.y1, c.y0 - ry1), c.block_no LIMIT 1) AS caption FROM g""")
def p15_tables(src):
    blocks = src.view("blocks")
    tables = blocks.where("kind = 'clause'").select(
        "doc_id", "page", F.col("block_no").alias("region_id"),
        F.col("x0").alias("rx0"), F.col("y0").alias("ry0"), F.col("x1").alias("rx1"), F.col("y1").alias("ry1"))
    return st.nearest_table_caption(tables, st.captions(blocks)).select("doc_id", "page", "region_id", "caption")


@plan("p16_adjacent_groups", sql="""
WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 14400000000 THEN 0 ELSE 1 END AS s FROM @events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS group_no FROM g)
SELECT user_id, group_no, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM n GROUP BY 1, 2""")
def p16(src):
    events = src.table("events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    runs = st.group_adjacent(
        events, ["user_id"], ["us", "event_id"], F.floor(F.col("us") / 60_000_000),
        F.col("us") - F.col("_us") <= 14_400_000_000, {"_us": F.col("us")})
    return runs.groupBy("user_id", "group_no").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@plan("p16_figure_panels", sql="""
WITH p AS (SELECT doc_id, page, concat('p', CAST(block_no AS STRING)) AS path, x0, y0, x1, y1, block_no * 10 + 100 AS width, 200 - block_no AS height, concat('Figure ', CAST(block_no % 2 AS STRING)) AS caption FROM v_blocks WHERE kind IN ('text', 'clause')),
g AS (SELECT *, CASE WHEN caption = lag(caption) OVER w AND y0 - lag(y1) OVER w <= 90 THEN 0 ELSE 1 END AS s FROM p WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0)),
n AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY y0, x0) AS group_no FROM g)
SELECT doc_id, page, group_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(width) AS width, max(height) AS height, min(caption) AS caption, string_agg(path, ',' ORDER BY path) AS paths FROM n GROUP BY 1, 2, 3""")
def p16_panels(src):
    block = F.col("block_no")
    panels = src.view("blocks").where(F.col("kind").isin("text", "clause")).select(
        "doc_id", "page", "x0", "y0", "x1", "y1", F.concat(F.lit("p"), block.cast("string")).alias("path"),
        (block * 10 + 100).alias("width"), (200 - block).alias("height"),
        F.concat(F.lit("Figure "), (block % 2).cast("string")).alias("caption"))
    return st.group_panels(panels).withColumn("paths", F.array_join("paths", ","))


@plan("p17_assets", sql="""
WITH i AS (SELECT doc_id AS seq, concat('img/', doc_id) AS path, sha256(text) AS h FROM @documents WHERE n_chars % 300 + 40 >= 100 AND n_chars % 500 + 30 >= 100 AND (doc_id % 50) / 1000 >= 0.01)
SELECT path, first_value(path) OVER (PARTITION BY h ORDER BY seq) AS asset_path FROM i""")
def p17(src):
    docs = src.table("documents").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("path"),
        F.sha2("text", 256).alias("content_hash"), (F.col("n_chars") % 300 + 40).alias("width"),
        (F.col("n_chars") % 500 + 30).alias("height"), (F.col("doc_id") % 50 / 1000).alias("page_share"))
    return st.dedupe_assets(docs).select("path", "asset_path")


def _tables(src):
    cells = F.split("header", r"\|"), F.split("row_text", r"\|")
    return src.view("tables").withColumn("rows", F.array(*cells))


@plan("p18_stitch_tables", sql=r"""
WITH t AS (SELECT *, replace(lower(header), ' ', '') AS k, length(header) - length(replace(header, '|', '')) AS c FROM v_tables),
g AS (SELECT *, CASE WHEN breaks_before = 0 AND page = lag(page) OVER w + 1 AND k = lag(k) OVER w AND lag(y1) OVER w > lag(page_height) OVER w / 2 AND y0 < page_height / 2 THEN 0 ELSE 1 END AS s
  FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
n AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM g)
SELECT doc_id, min(page) AS page, CASE WHEN max(page) > min(page) THEN max(page) END AS page_end,
  CASE max(CASE quality WHEN 'ruled' THEN 0 WHEN 'recovered' THEN 1 ELSE 2 END) WHEN 0 THEN 'ruled' WHEN 1 THEN 'recovered' ELSE 'text-fallback' END AS quality,
  concat(min_by(header, ord), '/', string_agg(row_text, '/' ORDER BY ord)) AS grid FROM n GROUP BY doc_id, grp""")
def p18(src):
    grid = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/")
    return st.stitch_tables(_tables(src)).select("doc_id", "page", "page_end", "quality", grid.alias("grid"))


@plan("p19_labels", sql=r"""
WITH m AS (SELECT doc_id, line_no, text,
  regexp_extract(text, '^((?:Exhibit|Schedule|Annex|Appendix|Attachment)\s+(?:[A-Z]|\d{1,2}))(?:[^A-Za-z0-9_]|$)', 1) AS ex,
  regexp_extract(text, '^(\d{1,3}(?:\.\d{1,3})+)\.?\s+[A-Z“"(\[]', 1) AS de, regexp_extract(text, '^(\d{1,3})\.\s+[A-Z“"(\[]', 1) AS i,
  regexp_extract(text, '^([A-Z]{1,3}\d{1,3}[A-Z]?)\.\s+[A-Z“"(\[]', 1) AS al, regexp_extract(text, '^(\([ivxlcdm]{2,}\))\s+', 1) AS ro, regexp_extract(text, '^(\([a-z]\))\s+', 1) AS le FROM v_labelled)
SELECT doc_id, line_no, CASE WHEN ex <> '' THEN ex WHEN de <> '' THEN de WHEN i <> '' THEN i WHEN al <> '' THEN al WHEN ro <> '' THEN ro ELSE le END AS label,
  CASE WHEN ex <> '' THEN 'exhibit' WHEN de <> '' THEN 'decimal' WHEN i <> '' THEN 'integer' WHEN al <> '' THEN 'alnum' WHEN ro <> '' THEN 'roman' ELSE 'lettered' END AS kind,
  CASE WHEN ex <> '' THEN '' WHEN de <> '' THEN regexp_replace(de, '\.\d+$', '') WHEN i <> '' THEN '' WHEN al <> '' THEN regexp_extract(al, '^[A-Z]+') WHEN ro <> '' THEN '(roman)' ELSE '(letter)' END AS parent,
  CASE WHEN ex <> '' THEN ascii(right(ex, 1)) - 64 WHEN de <> '' THEN CAST(regexp_extract(de, '(\d+)$', 1) AS INT) WHEN i <> '' THEN CAST(i AS INT)
    WHEN al <> '' THEN CAST(regexp_extract(al, '(\d+)', 1) AS INT) WHEN ro <> '' THEN CASE ro WHEN '(ii)' THEN 2 WHEN '(iii)' THEN 3 ELSE 4 END ELSE ascii(substring(le, 2, 1)) - 96 END AS ordinal
  FROM m WHERE ex <> '' OR de <> '' OR i <> '' OR al <> '' OR ro <> '' OR le <> ''""")
def p19(src):
    found = src.view("labelled").withColumn("l", lb.label_at_start(F.col("text"))).where("l IS NOT NULL")
    return found.select("doc_id", "line_no", "l.label", "l.kind", "l.parent", F.col("l.ordinal")[0].alias("ordinal"))


def _labelled(src):
    return src.view("labelled").select(
        "doc_id", F.col("line_no").alias("ord"), F.lit("paragraph").alias("type"), "text",
        F.lit(36.0).alias("x0"), (F.col("line_no") * 40.0).alias("y0"), F.lit(577.0).alias("x1"), (F.col("line_no") * 40.0 + 30).alias("y1"))


@plan("p20_label_candidates")
def p20(src):
    return st.label_candidates(_labelled(src)).select("doc_id", "ord", "offset", "label.label", "label.kind")


@plan("p21_corroborated", sql="""
WITH w AS (SELECT document_id, label, ordinal, lag(ordinal) OVER x AS b, lead(ordinal) OVER x AS a FROM v_labels WINDOW x AS (PARTITION BY document_id, parent ORDER BY position))
SELECT DISTINCT document_id AS doc_id, label FROM w WHERE ordinal = b + 1 OR a = ordinal + 1""")
def p21(src):
    label = F.struct(F.col("label"), F.lit("decimal").alias("kind"), F.col("label").alias("key"), "parent",
                     F.array(F.col("ordinal").cast("int")).alias("ordinal"), F.lit(0).alias("end"))
    found = src.view("labels").select(
        F.col("document_id").alias("doc_id"), F.col("position").alias("ord"), F.lit(0).alias("offset"), label.alias("label"))
    return st.corroborated(found)


@plan("p22_split_welded")
def p22(src):
    elements = _labelled(src)
    found = st.label_candidates(elements)
    return st.split_welded(elements, found, st.corroborated(found)).select(
        "doc_id", "ord", "piece", "text", F.round("y0", 3).alias("y0"), F.round("y1", 3).alias("y1"))


def _elements(src):
    return _classified(src).select(
        "doc_id", F.col("line_no").alias("ord"), "type", "text", "page", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])


@plan("p23_join_wrapped_lines")
def p23(src):
    blocks = src.view("blocks")
    elements = materialize(_elements(src), "elements")
    lines = src.view("lines")
    vocab = materialize(st.vocabulary(lines), "vocabulary")
    habits = st.breaks_hyphenate(st.line_breaks(lines, ["doc_id"]), vocab)
    profiles = materialize(
        st.profile(blocks).join(habits.select("doc_id", "breaks_hyphenate"), "doc_id", "left").na.fill({"breaks_hyphenate": False}), "profiles")
    proven = materialize(st.corroborated(st.label_candidates(elements)), "labels")
    start = elements.withColumn("label", lb.label_at_start(F.col("text"))["label"])
    opens = start.join(proven, ["doc_id", "label"], "left_semi").select("doc_id", "ord")
    kinds = [F.col(c).cast("double").alias(c) for c in ("body_left", "body_right", "paragraph_indent")]
    return st.join_wrapped_lines(elements, profiles.select("doc_id", *kinds, "breaks_hyphenate"), opens, vocab)


@plan("p24_spine", sql="""
WITH a AS (SELECT run_id, 0 AS ord, 1 AS level, concat(run_id, '. Order') AS title, '' AS kind FROM (SELECT DISTINCT run_id FROM v_criterion_rows)
UNION ALL SELECT run_id, line, 2, concat(run_id, '.', line, ' Part'), 'key' FROM v_criterion_rows WHERE l_partkey % 3 = 0
UNION ALL SELECT run_id, line, 2, concat('9.', line, ' Note'), 'near' FROM v_criterion_rows WHERE l_partkey % 3 = 1
UNION ALL SELECT run_id, line, 1, 'Remarks', '' FROM v_criterion_rows WHERE l_partkey % 3 = 2),
b AS (SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near FROM a)
SELECT run_id AS doc_id, ord, level, title, CASE WHEN level = 1 THEN title WHEN kind = 'key' THEN concat(run_id, '. Order > ', title) ELSE concat(near, ' > ', title) END AS path FROM b""")
def p24(src):
    rows = src.view("criterion_rows")
    run, line, pick = F.col("run_id").cast("string"), F.col("line").cast("string"), F.col("l_partkey") % 3
    heads = rows.select("run_id").distinct().select(
        F.col("run_id").alias("doc_id"), F.lit(0).alias("ord"), F.concat(run, F.lit(". Order")).alias("title"), run.alias("key"), F.lit("").alias("parent"), F.lit(1).alias("depth"))
    title = F.when(pick == 0, F.concat(run, F.lit("."), line, F.lit(" Part"))).when(pick == 1, F.concat(F.lit("9."), line, F.lit(" Note"))).otherwise("Remarks")
    subs = rows.select(
        F.col("run_id").alias("doc_id"), F.col("line").alias("ord"), title.alias("title"), F.when(pick < 2, F.concat(run, F.lit("."), line)).alias("key"),
        F.when(pick == 0, run).when(pick == 1, "unknown").alias("parent"), F.when(pick < 2, 2).otherwise(1).alias("depth"))
    both = heads.unionByName(subs).withColumns({"page": F.lit(0), "y0": F.lit(0.0)})
    return st._fold_sections(both).select("doc_id", "ord", "level", "title", F.array_join("path", " > ").alias("path"))


@plan("p24_document_spine")
def p24_documents(src):
    elements = materialize(_elements(src), "elements")
    proven = materialize(st.corroborated(st.label_candidates(elements)), "labels")
    spine = st.synthesize_spine(elements, proven)
    return spine.select("doc_id", "ord", "level", "title", F.array_join("path", " > ").alias("path"))


@plan("p25_outline_paths", sql="""
WITH RECURSIVE o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i, line_no AS seq, CASE kind WHEN 'heading' THEN 1 WHEN 'clause' THEN 2 ELSE 4 END AS level,
    trim(regexp_replace(text, '\\s+', ' ', 'g')) AS title, CASE WHEN line_no % 5 = 0 THEN 0 ELSE page + 1 END AS page FROM v_blocks WHERE kind IN ('heading', 'clause', 'caption') AND trim(text) <> ''),
t AS (SELECT doc_id, i, seq, level, title, page, [title] AS path FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.i, o.seq, o.level, o.title, o.page, list_append(t.path[1:o.level - 1], o.title) FROM t JOIN o ON o.doc_id = t.doc_id AND o.i = t.i + 1)
SELECT doc_id, seq, level, greatest(page - 1, 0) AS page, array_to_string(path, ' > ') AS path FROM t""")
def p25(src):
    outline = src.view("blocks").where(F.col("kind").isin("heading", "clause", "caption")).select(
        "doc_id", F.col("line_no").alias("seq"), F.when(F.col("kind") == "heading", 1).when(F.col("kind") == "clause", 2).otherwise(4).alias("level"),
        F.col("text").alias("title"), F.when(F.col("line_no") % 5 == 0, 0).otherwise(F.col("page") + 1).alias("page"))
    return st.outline_paths(outline).select("doc_id", "seq", "level", "page", F.array_join("path", " > ").alias("path"))


def _outline(src):
    """Outline entries that name printed headings with or without their number."""
    h = src.view("blocks").where("kind = 'heading'")
    title = F.when(F.col("page") % 3 == 0, F.col("text")).when(
        F.col("page") % 3 == 1, tx.without_number(F.col("text"))).otherwise(F.concat(F.col("text"), F.lit(" missing")))
    return h.select("doc_id", F.col("line_no").alias("seq"), "page", title.alias("title"))


@plan("p26_locate_headings", sql="""
SELECT doc_id, line_no AS seq, CASE WHEN page % 3 < 2 THEN line_no END AS heading_ord, CASE WHEN page % 3 < 2 THEN y0 END AS start_y FROM v_blocks WHERE kind = 'heading'""")
def p26(src):
    elements = src.view("blocks").select("doc_id", "page", F.col("line_no").alias("ord"), F.lit("paragraph").alias("type"), "text", "y0")
    return st.locate_headings(_outline(src), elements).select("doc_id", "seq", "heading_ord", "start_y")


@plan("p27_assign_sections", sql="""
WITH s AS (SELECT doc_id, page * 10000 + y0 AS at, text AS title FROM v_blocks WHERE kind IN ('heading', 'clause'))
SELECT b.doc_id, b.line_no AS ord, coalesce(s.title, '') AS section FROM v_blocks b ASOF LEFT JOIN s ON s.doc_id = b.doc_id AND s.at <= b.page * 10000 + b.y0""")
def p27(src):
    blocks = src.view("blocks")
    spine = blocks.where(F.col("kind").isin("heading", "clause")).select(
        "doc_id", "page", F.col("y0").cast("double").alias("start_y"), F.col("line_no").alias("seq"), F.col("text").alias("title"), F.array("text").alias("path"))
    elements = blocks.select("doc_id", F.col("line_no").alias("ord"), "page", F.col("y0").cast("double").alias("y0"))
    return st.assign_sections(elements, spine).select("doc_id", "ord", "section")


def _grids(src):
    rows = src.view("grids").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("block_no", "cells"))).alias("r"))
    return rows.select("doc_id", "page", F.transform("r", lambda x: x["cells"]).alias("rows"))


GRID = """g AS (SELECT doc_id, page, list(cells ORDER BY block_no) AS rows FROM v_grids GROUP BY 1, 2),
f AS (SELECT doc_id, page, list_filter(list_transform(rows, lambda r: list_transform(r, lambda c: trim(regexp_replace(c, '\\s+', ' ', 'g')))), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM g),
p AS (SELECT doc_id, page, rows, coalesce(list_max(list_transform(rows, lambda r: len(r))), 0) AS w FROM f),
k AS (SELECT doc_id, page, rows, list_filter(range(1, w + 1), lambda i: len(list_filter(rows, lambda r: coalesce(r[i], '') <> '')) > 0) AS keep FROM p),
c AS (SELECT doc_id, page, list_transform(rows, lambda r: list_transform(keep, lambda i: coalesce(r[i], ''))) AS rows FROM k)"""


@plan("p28_compact_grids", sql=f"WITH {GRID} SELECT doc_id, page, coalesce(array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), '/'), '') AS grid FROM c")
def p28(src):
    grid = st.compact_grid(F.col("rows"))
    return _grids(src).select("doc_id", "page", F.array_join(F.transform(grid, lambda r: F.array_join(r, "|")), "/").alias("grid"))


@plan("p29_valid_grids", sql=f"""
WITH {GRID} SELECT doc_id, page, coalesce(len(rows) >= 2 AND len(rows[1]) >= 2 AND len(list_filter(flatten(rows), lambda x: x <> '')) / (len(rows) * len(rows[1])) >= 0.6, false) AS valid FROM c""")
def p29(src):
    return _grids(src).select("doc_id", "page", st.grid_is_valid(st.compact_grid(F.col("rows"))).alias("valid"))


@plan("p30_markdown", sql=f"""
WITH {GRID}, m AS (SELECT doc_id, page, list_transform(rows, lambda r: concat('|', array_to_string(list_transform(r, lambda x: replace(x, '|', '\\|')), '|'), '|')) AS l, rows FROM c)
SELECT doc_id, page, CASE WHEN len(rows) = 0 THEN '' ELSE array_to_string(list_concat([l[1], concat('|', array_to_string(list_transform(rows[1], lambda x: '---'), '|'), '|')], l[2:]), chr(10)) END AS md FROM m""")
def p30(src):
    grid = _grids(src).select("doc_id", "page", st.compact_grid(F.col("rows")).alias("rows"))
    return grid.select("doc_id", "page", st.markdown(F.col("rows")).alias("md"))


@plan("p31_figure_text", sql="""
SELECT doc_id, ord, CASE WHEN ord % 4 < 2 THEN text WHEN section = 'Contents' THEN concat('Figure in the document (page ', page_label, ')') ELSE concat('Figure in ', section, ' (page ', page_label, ')') END AS text
  FROM v_elements WHERE type = 'figure'""")
def p31(src):
    caption = F.when(F.col("ord") % 4 < 2, F.col("text")).otherwise("")
    section = F.when(F.col("section") == "Contents", "").otherwise(F.col("section"))
    return src.view("elements").where("type = 'figure'").select(
        "doc_id", "ord", st.figure_text(caption, section, F.col("page_label")).alias("text"))


@plan("p32_type_counts", sql="""
SELECT doc_id, count(*) FILTER (type = 'paragraph') AS paragraph, count(*) FILTER (type = 'heading') AS heading, count(*) FILTER (type = 'table') AS "table",
  count(*) FILTER (type = 'figure') AS figure, count(*) FILTER (type = 'caption') AS caption, count(*) FILTER (type = 'equation') AS equation, count(*) FILTER (type = 'furniture') AS furniture FROM v_elements GROUP BY 1""")
def p32(src):
    return st.type_counts(src.view("elements"))


@plan("p33_spine_source", sql="""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM v_blocks WHERE kind = 'heading') THEN 'outline'
  WHEN doc_id IN (SELECT doc_id FROM v_blocks WHERE kind = 'heading') THEN 'headings' ELSE 'none' END AS spine_source FROM @documents""")
def p33(src):
    headings = src.view("blocks").where("kind = 'heading'").select("doc_id")
    outline = headings.where(F.col("doc_id") % 3 == 0)
    return st.spine_source(src.table("documents").select("doc_id"), outline, headings)


@plan("p34_page_labels", sql="""
SELECT DISTINCT doc_id, page, CASE WHEN page % 3 = 0 THEN concat('A-', page) ELSE CAST(page + 1 AS STRING) END AS page_label FROM v_blocks""")
def p34(src):
    printed = F.when(F.col("page") % 3 == 0, F.concat(F.lit("A-"), F.col("page").cast("string"))).otherwise("")
    return src.view("blocks").select("doc_id", "page").distinct().withColumn("page_label", st.page_label(printed, F.col("page")))
