"""Chunking queries over the elements of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking as ck
from .registry import plan

STOPS = "|".join(a.replace(".", r"\.") for a in tx.ABBREVIATIONS)


def sentence_list(text: str) -> str:
    """Sentences of a text in DuckDB, which has no look-behind."""
    marked = rf"""regexp_replace({text}, '([.!?])(["'')\]]*)(\s+)', '\1' || chr(1) || '\2\3', 'g')"""
    kept = rf"""regexp_replace({marked}, '((?:^|[^A-Za-z.])\.*(?:[A-Za-z]|(?i:{STOPS}))\.)' || chr(1), '\1', 'g')"""
    parts = rf"""list_filter(list_transform(string_split({kept}, chr(1)), lambda x, i: trim(CASE WHEN i > 1 THEN regexp_replace(x, '^["'')\]]*\s+', '') ELSE x END, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '')"""
    return parts


DOTS = r"regexp_matches(text, '(?i)(?:\.\s?){4,}\.?\s*[\divxlcdm]+\s*$')"
REASON = f"""CASE WHEN type = 'furniture' THEN 'furniture' WHEN type = 'heading' THEN 'heading' WHEN {DOTS} THEN 'contents'
  WHEN spine_source = 'outline' AND section = 'Contents' THEN 'front_matter' END"""
CRUMB = "concat(part, ' > ', section)"


def _budget_sql(n: int) -> str:
    return f"greatest({n} - ((length({CRUMB}) + 3) // 4 + 1), 64)"


KEPT = f"kept AS (SELECT *, {CRUMB} AS crumb FROM v_elements WHERE ({REASON}) IS NULL)"
RUNS = f"""{KEPT}, st AS (SELECT *, CASE WHEN type IN ('table', 'figure') OR lag(type) OVER w IN ('table', 'figure') OR crumb = lag(crumb) OVER w IS NOT TRUE THEN 1 ELSE 0 END AS s
  FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
runs AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM st)"""


def _pack_sql(n: int) -> str:
    return f"""{RUNS}, pc AS (SELECT doc_id, run, ord, type, text, page, crumb, length(trim(text)) AS len, (length(trim(text)) + 3) // 4 AS t, {_budget_sql(n)} AS b,
  row_number() OVER (PARTITION BY doc_id, run ORDER BY ord) AS i FROM runs WHERE type NOT IN ('table', 'figure')),
pk AS (SELECT doc_id, run, ord, i, 0 AS chunk_no, t AS total FROM pc WHERE i = 1
  UNION ALL SELECT pc.doc_id, pc.run, pc.ord, pc.i, pk.chunk_no + (pk.total + 1 + pc.t > b AND pc.type <> 'equation')::INT,
    CASE WHEN pk.total + 1 + pc.t > b AND pc.type <> 'equation' THEN pc.t ELSE pk.total + 1 + pc.t END
    FROM pk JOIN pc ON pc.doc_id = pk.doc_id AND pc.run = pk.run AND pc.i = pk.i + 1)"""


def _elements(src):
    return src.view("elements").select(
        "doc_id", "ord", "page", "page_label", "type", "text", "section", F.array("part", "section").alias("section_path"), "spine_source",
        F.when(F.col("ord") % 12 == 10, F.col("page") + 1).alias("page_end"),
        F.when(F.col("ord") % 12 == 10, (F.col("page") + 2).cast("string")).otherwise("").alias("page_label_end"))


@plan("c1_select", sql=f"SELECT doc_id, ord, coalesce({REASON}, 'kept') AS reason FROM v_elements")
def c1(src):
    return _elements(src).select("doc_id", "ord", F.coalesce(ck.drop_reason(), F.lit("kept")).alias("reason"))


@plan("s9_chunking_report", sql=f"""
SELECT spine_source, count(*) AS elements_in, count(*) FILTER (({REASON}) = 'heading') AS headings, count(*) FILTER (({REASON}) = 'contents') AS dropped_contents,
  count(*) FILTER (({REASON}) = 'front_matter') AS dropped_front_matter FROM v_elements GROUP BY 1""")
def s9(src):
    return ck.drop_report(_elements(src), "spine_source")


@plan("c2_token_counts", sql="SELECT doc_id, line_no, (length(line) + 3) // 4 AS tokens FROM v_lines")
def c2(src):
    return src.view("lines").select("doc_id", "line_no", tx.token_count(F.col("line")).alias("tokens"))


@plan("c3_runs", sql=f"WITH {RUNS} SELECT doc_id, ord, run FROM runs")
def c3(src):
    return ck.runs(ck.select_elements(_elements(src))).select("doc_id", "ord", "run")


@plan("c4_budgets", sql=f"SELECT doc_id, ord, {_budget_sql(70)} AS budget, least(80, {_budget_sql(70)} // 2) AS overlap_budget FROM v_elements")
def c4(src):
    limit = ck.budget(F.col("section_path"), 70)
    return _elements(src).select("doc_id", "ord", limit.alias("budget"), ck.overlap_budget(limit).alias("overlap_budget"))


@plan("c5_sentences", sql=f"""
WITH s AS (SELECT doc_id, {sentence_list('text')} AS s FROM @documents)
SELECT doc_id, greatest(len(s), 1) AS sentences, md5(array_to_string(s, chr(10))) AS digest FROM s""")
def c5(src):
    docs = src.table("documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").alias("sentences"), F.md5(F.array_join("s", "\n")).alias("digest"))


@plan("c6_pieces", sql=rf"""
WITH RECURSIVE e AS (SELECT doc_id, ord, trim(text) AS text, {_budget_sql(100)} AS b FROM v_elements WHERE type = 'paragraph'),
big AS (SELECT doc_id, ord, b, {sentence_list('text')} AS s FROM e WHERE (length(text) + 3) // 4 > b),
sn AS (SELECT doc_id, ord, b, generate_subscripts(s, 1) AS si, unnest(s) AS u FROM big),
un AS (SELECT doc_id, ord, b, si, 0 AS wi, u, false AS lng FROM sn WHERE (length(u) + 3) // 4 + 1 <= b
  UNION ALL SELECT doc_id, ord, b, si, generate_subscripts(w, 1), unnest(w), true FROM (SELECT *, list_filter(regexp_split_to_array(u, '\s+'), lambda x: x <> '') AS w FROM sn WHERE (length(u) + 3) // 4 + 1 > b)),
ix AS (SELECT *, (length(u) + 3) // 4 + 1 AS t, row_number() OVER (PARTITION BY doc_id, ord ORDER BY si, wi) AS i FROM un),
r AS (SELECT doc_id, ord, i, si, lng, t AS total, length(u) AS chars, 0 AS piece FROM ix WHERE i = 1
  UNION ALL SELECT x.doc_id, x.ord, x.i, x.si, x.lng, CASE WHEN n THEN x.t ELSE x.total + x.t END, CASE WHEN n THEN x.len ELSE x.chars + 1 + x.len END, x.piece + n::INT
  FROM (SELECT ix.doc_id, ix.ord, ix.i, ix.si, ix.lng, ix.t, length(ix.u) AS len, r.total, r.chars, r.piece,
      ((r.lng OR ix.lng) AND r.si <> ix.si) OR r.total + ix.t > b AS n FROM r JOIN ix ON ix.doc_id = r.doc_id AND ix.ord = r.ord AND ix.i = r.i + 1) x)
SELECT doc_id, ord, piece, (max(chars) + 3) // 4 AS tokens FROM r GROUP BY 1, 2, 3
UNION ALL SELECT doc_id, ord, 0, (length(text) + 3) // 4 FROM e WHERE (length(text) + 3) // 4 <= b""")
def c6(src):
    rows = _elements(src).where("type = 'paragraph'").withColumn("budget", ck.budget(F.col("section_path"), 100))
    return ck.pieces(rows).select("doc_id", "ord", "piece", "tokens")


@plan("c7_pack", sql=f"WITH RECURSIVE {_pack_sql(200)} SELECT doc_id, run, ord, chunk_no FROM pk")
def c7(src):
    numbered = ck.runs(ck.select_elements(_elements(src)))
    prose = numbered.where(~F.col("type").isin(*ck.ATOMIC)).withColumn("budget", ck.budget(F.col("section_path"), 200))
    return ck.pack(ck.pieces(prose, split=False)).select("doc_id", "run", "ord", "chunk_no")


@plan("c8_overlap_chunks")
def c8(src):
    drafts = ck.prose_chunks(_elements(src), chunk_tokens=200, overlap_tokens=40)
    return ck.render(drafts).select("doc_id", "ordinal", "token_count", "overlap_tokens", "page", "page_end", F.md5("content").alias("digest"))


@plan("c9_fold_equations", sql=f"""
WITH {KEPT}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM kept WHERE type NOT IN ('table', 'figure'))
SELECT doc_id, ord, sum(CASE WHEN type = 'equation' AND i > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS chunk_no FROM k""")
def c9(src):
    prose = ck.select_elements(_elements(src)).where(~F.col("type").isin(*ck.ATOMIC))
    packed = prose.withColumns({"run": F.lit(0), "chunk_no": F.col("ord").cast("int"), "place": F.struct("ord", F.lit(0).alias("piece"))})
    return ck.fold_equations(packed).select("doc_id", "ord", "chunk_no")


@plan("c10_table_parts", sql=r"""
WITH RECURSIVE x AS (SELECT doc_id, CAST((line_no - line_no % 12) / 12 AS BIGINT) AS page, line_no, concat('|', line_no, '|', replace(line, '|', '\|'), '|') AS l FROM v_lines
  UNION ALL SELECT DISTINCT doc_id, CAST((line_no - line_no % 12) / 12 AS BIGINT), -1, '|0|The parties to this schedule|' FROM v_lines),
g AS (SELECT doc_id, page, string_agg(l, chr(10) ORDER BY line_no) AS body, count(*) AS n, concat('Table ', page) AS caption FROM x GROUP BY 1, 2),
h AS (SELECT *, concat('|No|Text|', chr(10), '|---|---|') AS head FROM g),
f AS (SELECT *, (length(concat(caption, chr(10), head, chr(10), body)) + 3) // 4 <= 100 AS fits FROM h),
q AS (SELECT x.*, length(x.l) + 1 AS len, (length(caption) + 3) // 4 + 8 AS o, row_number() OVER (PARTITION BY x.doc_id, x.page ORDER BY line_no) AS i FROM x JOIN f USING (doc_id, page) WHERE NOT fits),
r AS (SELECT doc_id, page, i, len AS chars, 0 AS part FROM q WHERE i = 1
  UNION ALL SELECT q.doc_id, q.page, q.i, CASE WHEN (19 + r.chars + q.len + 3) // 4 + o > 100 THEN q.len ELSE r.chars + q.len END, r.part + ((19 + r.chars + q.len + 3) // 4 + o > 100)::INT
   FROM r JOIN q ON q.doc_id = r.doc_id AND q.page = r.page AND q.i = r.i + 1),
p AS (SELECT doc_id, page, part, max(chars) AS chars, max(part) OVER (PARTITION BY doc_id, page) + 1 AS n FROM r GROUP BY 1, 2, 3)
SELECT doc_id, page, part, n AS n_parts, length(concat('Table ', page, ' (part ', part + 1, '/', n, ')', chr(10))) + 19 + chars AS chars FROM p
UNION ALL SELECT doc_id, page, 0, 1, length(concat(caption, chr(10), head, chr(10), body)) FROM f WHERE fits""")
def c10(src):
    lines = src.view("lines").withColumn("page", F.expr("line_no div 12"))
    row = F.array(F.col("line_no").cast("string"), F.col("line"))
    tables = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", row.alias("r")))).alias("s")).select(
        "doc_id", "page", F.concat(F.lit("Table "), F.col("page").cast("string")).alias("caption"), F.array().cast("array<string>").alias("section_path"),
        F.concat(F.array(F.array(F.lit("No"), F.lit("Text")), F.array(F.lit("0"), F.lit("The parties to this schedule"))), F.transform("s", lambda x: x["r"])).alias("rows"))
    return ck.table_chunks(tables, 100).select("doc_id", "page", "part", "n_parts", F.char_length("body").alias("chars"))


MENTIONS = rf"""{KEPT}, m AS (SELECT doc_id, ord, text, unnest(regexp_extract_all(text, '(?i)\b(?:fig|figs|figure|figures|table|tables)\b\.?\s*[A-Za-z]?\d+(?:\.\d+)*')) AS hit
  FROM kept WHERE type NOT IN ('table', 'figure', 'equation')),
mk AS (SELECT doc_id, concat(CASE WHEN lower(hit) LIKE 'tab%' THEN 'table' ELSE 'figure' END, ':', lower(regexp_extract(hit, '(?i)([A-Za-z]?\d+(?:\.\d+)*)$', 1))) AS key, min(ord) AS ord, min_by(text, ord) AS text FROM m GROUP BY 1, 2)"""


@plan("c11_mentions", sql=f"WITH {MENTIONS} SELECT doc_id, key, ord FROM mk")
def c11(src):
    return ck.mention_map(ck.select_elements(_elements(src))).select("doc_id", "key", "ord")


SNIP = rf"""sp AS (SELECT doc_id, key, trim(text) AS t, {sentence_list('trim(text)')} AS s FROM mk),
sq AS (SELECT doc_id, key, t, s, coalesce(list_position(list_transform(s, lambda x: list_contains(list_transform(regexp_extract_all(x, '(?i)\b(?:fig|figs|figure|figures|table|tables)\b\.?\s*[A-Za-z]?\d+(?:\.\d+)*'),
    lambda h: concat(CASE WHEN lower(h) LIKE 'tab%' THEN 'table' ELSE 'figure' END, ':', lower(regexp_extract(h, '(?i)([A-Za-z]?\d+(?:\.\d+)*)$', 1)))), key)), true), 1) AS a FROM sp),
sr AS (SELECT doc_id, key, t, s[a:] AS s FROM sq),
sn AS (SELECT doc_id, key, CASE WHEN (length(t) + 3) // 4 <= 120 THEN t ELSE array_to_string(s[:greatest(1, len(list_filter(range(1, len(s) + 1), lambda i: list_sum(list_transform(s[:i], lambda x: (length(x) + 3) // 4)) <= 120)))], ' ') END AS snippet FROM sr)"""


@plan("c12_figure_chunks", sql=rf"""
WITH {MENTIONS}, {SNIP}, f AS (SELECT doc_id, ord, trim(text) AS text, concat('figure:', lower(regexp_extract(text, '(?i)^\s*figure\s*([A-Za-z]?\d+(?:\.\d+)*)', 1))) AS key FROM kept WHERE type = 'figure')
SELECT f.doc_id, f.ord, sn.key IS NOT NULL AS referenced, CASE WHEN sn.key IS NULL THEN f.text ELSE concat(f.text, chr(10), 'Referenced in the text: ', snippet) END AS body,
  concat('img/', f.ord, '.png') AS asset_path FROM f LEFT JOIN sn USING (doc_id, key)""")
def c12(src):
    kept = ck.select_elements(_elements(src))
    figures = kept.where("type = 'figure'").withColumns({
        "caption": F.col("text"), "description": F.lit(None).cast("string"),
        "asset_paths": F.array(F.concat(F.lit("img/"), F.col("ord").cast("string"), F.lit(".png")))})
    return ck.figure_chunks(figures, ck.mention_map(kept)).select("doc_id", "ord", "referenced", "body", "asset_path")


@plan("c13_render", sql=f"""
WITH RECURSIVE {_pack_sql(200)}, d AS (SELECT pk.doc_id, pk.run, chunk_no, max(crumb) AS crumb, string_agg(trim(text), chr(10) ORDER BY pk.ord) AS body, min(page) AS page
  FROM pk JOIN pc USING (doc_id, run, ord) GROUP BY 1, 2, 3)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, chunk_no) - 1 AS ordinal, page, (length(concat(crumb, chr(10), body)) + 3) // 4 AS token_count,
  md5(concat(crumb, chr(10), body)) AS digest FROM d WHERE (length(body) + 3) // 4 >= 8""")
def c13(src):
    drafts = ck.prose_chunks(_elements(src), chunk_tokens=200, overlap_tokens=0, split=False)
    return ck.render(drafts).select("doc_id", "ordinal", "page", "token_count", F.md5("content").alias("digest"))


@plan("c14_page_ranges", sql=f"""
WITH RECURSIVE {_pack_sql(200)}, d AS (SELECT pk.doc_id, pk.run, chunk_no, min(page) AS page, max(CASE WHEN pk.ord % 12 = 10 THEN page + 1 ELSE page END) AS e FROM pk JOIN pc USING (doc_id, run, ord) GROUP BY 1, 2, 3)
SELECT doc_id, run, chunk_no, page, CASE WHEN e > page THEN e END AS page_end, CASE WHEN e > page THEN CAST(e + 1 AS STRING) ELSE '' END AS page_label_end FROM d""")
def c14(src):
    drafts = ck.prose_chunks(_elements(src), chunk_tokens=200, overlap_tokens=0, split=False)
    return drafts.select("doc_id", "run", "chunk_no", "page", "page_end", "page_label_end")


@plan("c_all_chunks")
def c_all(src):
    figure, table = F.col("type") == "figure", F.col("type") == "table"
    cells = F.transform(F.split("text", " "), lambda w: F.array(w))
    elements = _elements(src).withColumns({
        "caption": F.when(figure | table, F.col("text")), "description": F.lit(None).cast("string"),
        "asset_paths": F.when(figure, F.array(F.concat(F.lit("img/"), F.col("ord").cast("string")))),
        "rows": F.when(table, F.concat(F.array(F.array(F.lit("Word"))), cells))})
    return ck.chunk_documents(elements, chunk_tokens=200, overlap_tokens=40).select(
        "doc_id", "ordinal", "element_type", "page", "page_end", "token_count", F.md5("content").alias("digest"))
