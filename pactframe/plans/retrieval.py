"""Index, embedding and retrieval queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import embed, keyword_index, ordered
from ..operators import retrieval as rt
from ..session import materialize, work_dir
from .registry import plan

DIM = 64
W = r"[\p{L}\p{N}_]+"


def _chunks(src):
    return src.table("documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("text").alias("content"), "lang")


def _questions(src):
    return src.view("quotes").select(F.col("quote_id").alias("query_id"), F.col("quote").alias("question"))


def _accents(text: str) -> str:
    return f"translate({text}, '{''.join(rt.ACCENTS)}', '{''.join(rt.ACCENTS.values())}')"


POST = rf"""post AS (SELECT chunk_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM (SELECT doc_id AS chunk_id, regexp_extract_all(lower(strip_accents(text)), '{W}') AS w FROM @documents)),
ln AS (SELECT doc_id AS chunk_id, source AS document_id, len(regexp_extract_all(lower(strip_accents(text)), '{W}')) AS len FROM @documents)"""
ASKED = rf"""asked AS (SELECT quote_id, list_filter(list_transform(regexp_split_to_array(quote, '\s+'), lambda t: regexp_extract_all(lower(strip_accents(t)), '{W}')), lambda w: len(w) > 0) AS ps FROM v_quotes),
ph AS (SELECT quote_id, unnest(ps) AS words FROM asked), kw AS (SELECT quote_id, array_to_string(words, ' ') AS phrase, any_value(words) AS words, count(*) AS weight FROM ph GROUP BY 1, 2),
dp AS (SELECT phrase, any_value(words) AS words FROM kw GROUP BY 1),
pw AS (SELECT phrase, len(words) AS m, generate_subscripts(words, 1) - 1 AS off, unnest(words) AS term FROM dp),
tf AS (SELECT phrase, chunk_id, count(*) AS tf FROM (SELECT phrase, chunk_id, pos - off AS start FROM post JOIN pw USING (term) GROUP BY phrase, m, chunk_id, pos - off HAVING count(*) = m) GROUP BY 1, 2)"""
SCORES = f"""{POST}, {ASKED}, st AS (SELECT count(*) AS n, avg(len) AS a FROM ln), df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT quote_id AS query_id, tf.chunk_id, document_id, round(sum(weight * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a))), 9) AS score
  FROM tf JOIN kw USING (phrase) JOIN df USING (phrase) JOIN ln USING (chunk_id), st GROUP BY 1, 2, 3)"""


@plan("r1_postings", sql=f"WITH {POST} SELECT chunk_id, term, count(*) AS tf, min(pos) AS first_pos FROM post GROUP BY 1, 2")
def r1(src):
    return rt.postings(_chunks(src)).groupBy("chunk_id", "term").agg(
        F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first_pos"))


@plan("r1_stemmed_terms")
def r1_stemmed(src):
    return rt.postings(_chunks(src), stemmed=True).groupBy("term").agg(
        F.count(F.lit(1)).alias("postings"), F.countDistinct("chunk_id").alias("chunks"))


@plan("r2_match_expression", sql=rf"""
SELECT quote_id AS query_id, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(quote, '\s+'), lambda t: regexp_extract_all(lower(t), '{W}')), lambda w: len(w) > 0),
  lambda w: concat('"', array_to_string(w, ' '), '"')), ' OR ') AS match FROM v_quotes""")
def r2(src):
    return _questions(src).select("query_id", rt.match_expression(F.col("question")).alias("match"))


@plan("r3_phrase_matches", sql=rf"""
WITH {POST}, q AS (SELECT quote_id, regexp_extract_all(lower(strip_accents(quote)), '{W}') AS w FROM v_quotes),
b AS (SELECT DISTINCT x[1] AS a, x[2] AS b FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS x FROM q))
SELECT concat(b.a, ' ', b.b) AS phrase, p.chunk_id, count(*) AS tf FROM b JOIN post p ON p.term = b.a JOIN post n ON n.chunk_id = p.chunk_id AND n.pos = p.pos + 1 AND n.term = b.b GROUP BY 1, 2""")
def r3(src):
    words = rt.index_words(F.col("question"))
    grams = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.array(w, F.get(words, i + 1)))
    phrases = _questions(src).select(F.explode(grams).alias("words")).distinct().withColumn("phrase", F.array_join("words", " "))
    return rt.phrase_hits(phrases, _chunks(src)).where("phrase IS NOT NULL").select("phrase", "chunk_id", "tf")


@plan("r4_bm25", sql=f"WITH {SCORES} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 20")
def r4(src):
    return rt.bm25(_questions(src), _chunks(src), k=20).withColumn("score", F.round("score", 6))


def _scoped(src):
    """Every question asked inside one document of the corpus."""
    scope = F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))
    return _questions(src).withColumn("document_id", scope)


@plan("r4_bm25_scoped", sql=f"""
WITH {SCORES} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc
 WHERE document_id = concat('src', query_id % 20) QUALIFY rank <= 5""")
def r4_scoped(src):
    return rt.bm25(_scoped(src), _chunks(src), k=5, scope="document_id").withColumn("score", F.round("score", 6))


_INDEXES: dict[tuple[str, str], str] = {}


def _index(src):
    """The keyword index of the corpus, written once per application and opened after that."""
    key = (src.spark.sparkContext.applicationId, src.folder)
    if key not in _INDEXES:
        path = work_dir(src.spark, "keyword-index")
        keyword_index.build(_chunks(src), path, keep=("document_id",))
        _INDEXES[key] = path
    return keyword_index.opened(src.spark, _INDEXES[key])


@plan("r1_index_terms", sql=f"WITH {POST} SELECT term, count(DISTINCT chunk_id) AS chunks, count(*) AS postings, max(pos) AS last_pos FROM post GROUP BY 1")
def r1_index(src):
    blocks = _index(src).blocks()
    return blocks.groupBy("term").agg(
        F.sum("n").cast("long").alias("chunks"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda t, x: t + x)).alias("postings"),
        F.max(F.array_max("places")).alias("last_pos"))


@plan("r4_indexed", sql=f"WITH {SCORES} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 20")
def r4_indexed(src):
    return keyword_index.search(_index(src), _questions(src), k=20).withColumn("score", F.round("score", 6))


@plan("r4_indexed_scoped", sql=f"""
WITH {SCORES} SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc
 WHERE document_id = concat('src', query_id % 20) QUALIFY rank <= 5""")
def r4_indexed_scoped(src):
    return keyword_index.search(_index(src), _scoped(src), k=5, scope="document_id").withColumn("score", F.round("score", 6))


@plan("r4_bm25_stemmed")
def r4_stemmed(src):
    return rt.bm25(_questions(src), _chunks(src), k=20, stemmed=True).withColumn("score", F.round("score", 6))


CENTROIDS = """cen AS (SELECT document_id, list(v ORDER BY i) AS q FROM (SELECT document_id, i, round(avg(v), 6) AS v FROM (SELECT document_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM v_vectors) GROUP BY 1, 2) GROUP BY 1)"""
DIST = "sqrt(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))))"


def _centroids(src):
    """One question per document: the mean of its vectors."""
    cells = src.view("vectors").select("document_id", F.posexplode("embedding").alias("i", "v"))
    means = cells.groupBy("document_id", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))
    listed = means.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    return listed.select(F.col("document_id").alias("query_id"), "document_id", F.transform("s", lambda x: x["v"]).alias("embedding"))


def _near_sql(where: str, k: int) -> str:
    return f"""{CENTROIDS}, n AS (SELECT cen.document_id AS query_id, v.chunk_id, {DIST} AS d FROM cen JOIN v_vectors v ON {where}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), chunk_id) AS rank FROM n QUALIFY rank <= {k})"""


@plan("r5_nearest_scoped", sql=f"WITH {_near_sql('v.document_id = cen.document_id', 10)} SELECT query_id, chunk_id, round(d, 6) AS distance, rank FROM t")
def r5(src):
    out = rt.nearest(src.view("vectors"), _centroids(src), k=10, scope="document_id")
    return out.withColumn("distance", F.round("distance", 6))


@plan("r5_nearest", sql=f"WITH {_near_sql('true', 10)} SELECT query_id, chunk_id, round(d, 6) AS distance, rank FROM t")
def r5_global(src):
    return rt.nearest(src.view("vectors"), _centroids(src), k=10).withColumn("distance", F.round("distance", 6))


@plan("r6_similarity", sql=f"WITH {_near_sql('v.document_id = cen.document_id', 10)} SELECT query_id, chunk_id, round(greatest(0, least(1, 1 - d * d / 2)), 6) AS similarity FROM t")
def r6(src):
    out = rt.nearest(src.view("vectors"), _centroids(src), k=10, scope="document_id")
    return out.select("query_id", "chunk_id", F.round(rt.similarity(F.col("distance")), 6).alias("similarity"))


@plan("r7_top_k", sql="""
SELECT document_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY document_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
  FROM (SELECT document_id, chunk_id, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE / i)) AS score FROM v_vectors) QUALIFY rank <= 6""")
def r7(src):
    scored = src.view("vectors").select("document_id", "chunk_id", F.aggregate(
        F.transform("embedding", lambda x, i: x.cast("double") / (i + 1)), F.lit(0.0), lambda t, x: t + x).alias("score"))
    return rt.top_k(scored, ["document_id"], [F.desc(F.round("score", 9)), F.asc("chunk_id")], 6).withColumn("score", F.round("score", 6))


SPARSE = f"""slot AS (SELECT id, side, (('0x' || substring(md5(w), 1, 8))::BIGINT % {DIM})::INT AS slot, count(*) AS n FROM (
   SELECT doc_id AS id, 'd' AS side, unnest(regexp_extract_all(lower(text), '{W}')) AS w FROM @documents
   UNION ALL SELECT quote_id, 'q', unnest(regexp_extract_all(lower(quote), '{W}')) FROM v_quotes) GROUP BY 1, 2, 3),
unit AS (SELECT id, side, slot, n / sqrt(sum(n * n) OVER (PARTITION BY id, side)) AS w FROM slot),
dot AS (SELECT q.id AS query_id, d.id AS chunk_id, sum(q.w * d.w) AS c FROM unit q JOIN unit d ON q.slot = d.slot AND q.side = 'q' AND d.side = 'd' GROUP BY 1, 2),
vec AS (SELECT query_id, chunk_id, c, row_number() OVER (PARTITION BY query_id ORDER BY round(sqrt(greatest(0, 2 - 2 * c)), 9), chunk_id) AS rank FROM dot QUALIFY rank <= 20)"""
HYBRID = f"""{SCORES}, {SPARSE}, kwd AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 20),
both_ AS (SELECT query_id, chunk_id, 'vector' AS r, rank FROM vec UNION ALL SELECT query_id, chunk_id, 'keyword', rank FROM kwd),
fz AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, string_agg(concat(r, '=', rank), ';' ORDER BY r) AS ranks FROM both_ GROUP BY 1, 2),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fz QUALIFY rank <= 6)"""
RANKS = "array_join(transform(array_sort(map_keys(ranks)), k -> concat(k, '=', CAST(ranks[k] AS STRING))), ';')"


def _embedded(src):
    """The chunks' vectors and the questions with theirs, written once: a search reads them several times."""
    vectors = materialize(embed.hashed_vectors(_chunks(src), "chunk_id", "content", DIM), "hashed-vectors")
    asked = _questions(src)
    return vectors, materialize(asked.join(embed.hashed_vectors(asked, "query_id", "question", DIM), "query_id"), "hashed-questions")


def _retrieve(src, mode: str, top: int = 6, embedded=None):
    vectors, asked = embedded or _embedded(src)
    return rt.retrieve(asked, _chunks(src), vectors, mode=mode, top=top, index=_index(src) if mode != "vector" else None)


@plan("r8_fusion", sql=f"WITH {HYBRID} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM hy")
def r8(src):
    return _retrieve(src, "hybrid").select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


@plan("r9_modes", sql=f"""
WITH {HYBRID} SELECT 'hybrid' AS mode, query_id, chunk_id, rank, round(score, 6) AS score FROM hy
UNION ALL SELECT 'keyword', query_id, chunk_id, rank, round(score, 6) FROM kwd WHERE rank <= 6
UNION ALL SELECT 'vector', query_id, chunk_id, rank, round(greatest(0, least(1, c)), 6) FROM vec WHERE rank <= 6""")
def r9(src):
    out, embedded = None, _embedded(src)
    for mode in rt.MODES:
        part = _retrieve(src, mode, embedded=embedded).select(F.lit(mode).alias("mode"), "query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


@plan("r10_ranks", sql=f"WITH {HYBRID} SELECT query_id, chunk_id, ranks FROM hy")
def r10(src):
    return _retrieve(src, "hybrid").select("query_id", "chunk_id", F.expr(RANKS).alias("ranks"))


@plan("r11_hydrate", sql=f"""
WITH {SCORES}, t AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 6)
SELECT query_id, rank, chunk_id, source AS document_id, md5(text) AS digest, concat('file ', source) AS filename FROM t JOIN @documents ON doc_id = chunk_id WHERE source <> 'src7'""")
def r11(src):
    chunks = _chunks(src)
    documents = chunks.select("document_id").distinct().where("document_id <> 'src7'").withColumn("filename", F.concat(F.lit("file "), "document_id"))
    ranked = rt.retrieve(_questions(src), chunks, mode="keyword")
    return rt.hydrate(ranked, chunks, documents).select("query_id", "rank", "chunk_id", "document_id", F.md5("content").alias("digest"), "filename")


@plan("r12_by_section", sql="""
WITH q AS (SELECT DISTINCT p_brand AS document_id, substring(p_name, 1, 2) AS prefix FROM @part),
c AS (SELECT p_brand AS document_id, p_partkey AS ordinal, list_concat([p_type], string_split(p_name, ' ')) AS path FROM @part)
SELECT concat(document_id, '/', prefix) AS query_id, ordinal, row_number() OVER (PARTITION BY document_id, prefix ORDER BY ordinal) AS rank FROM q JOIN c USING (document_id)
 WHERE len(list_filter(path, lambda p: starts_with(p, prefix))) > 0 QUALIFY rank <= 20""")
def r12(src):
    part = src.table("part")
    chunks = part.select(F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("ordinal"),
                         F.concat(F.array("p_type"), F.split("p_name", " ")).alias("section_path"))
    asked = part.select(F.col("p_brand").alias("document_id"), F.substring("p_name", 1, 2).alias("prefix")).distinct().withColumn(
        "query_id", F.concat_ws("/", "document_id", "prefix"))
    return rt.by_section(asked, chunks).select("query_id", "ordinal", "rank")


@plan("r13_document_sections", sql="""
WITH e AS (SELECT user_id, event_type, ts, event_id, CAST(CAST(value AS BIGINT) AS STRING) AS label, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS s FROM @events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS entry FROM e),
g AS (SELECT user_id AS document_id, entry, min(event_type) AS section, min_by(label, event_id) AS a, max_by(label, event_id) AS b, count(*) AS chunks FROM n GROUP BY 1, 2)
SELECT document_id, entry, section, chunks, CASE WHEN a = b THEN a ELSE concat(a, '-', b) END AS page_display FROM g""")
def r13(src):
    label = F.rint("value").cast("long").cast("string")
    chunks = src.table("events").select(
        F.col("user_id").alias("document_id"), F.struct("ts", "event_id").alias("ordinal"), F.array("event_type").alias("section_path"),
        label.alias("page_label"), F.lit(None).cast("string").alias("page_label_end"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("minute"))
    out = rt.document_sections(chunks, F.col("minute"))
    return out.select("document_id", "entry", F.col("section_path")[0].alias("section"), "chunks", "page_display")


def _hydrated(src):
    e = src.view("elements")
    return e.select(
        "doc_id", "ord", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filename"), "section", "spine_source",
        F.when(F.col("ord") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("part", "section")).alias("section_path"),
        F.when(F.col("ord") % 5 == 0, "").otherwise(F.col("page_label")).alias("page_label"),
        F.when(F.col("ord") % 6 == 0, (F.col("page") + 2).cast("string")).otherwise("").alias("page_label_end"),
        F.col("type").alias("element_type"), F.when(F.col("type") == "table", F.concat(F.lit("|"), F.col("text"))).alias("payload"), F.col("text").alias("content"))


CITE = """h AS (SELECT doc_id, ord, concat('f', doc_id) AS filename, section, spine_source, CASE WHEN ord % 7 = 0 THEN '' ELSE concat(part, ' > ', section) END AS crumb,
  CASE WHEN ord % 5 = 0 THEN CASE WHEN ord % 6 = 0 THEN concat('-', page + 2) ELSE '' END WHEN ord % 6 = 0 THEN concat(page_label, '-', page + 2) ELSE page_label END AS pd, type, text FROM v_elements)"""


@plan("r14_citations", sql=f"""
WITH {CITE} SELECT doc_id, ord, crumb AS breadcrumb, pd AS page_display, concat(filename, ' — ', section, CASE WHEN pd <> '' THEN concat(' (p.', pd, ')') ELSE '' END) AS citation_title,
  CASE WHEN type = 'table' THEN CASE WHEN crumb <> '' THEN concat(crumb, chr(10), '|', text) ELSE concat('|', text) END ELSE text END AS reader_text FROM h""")
def r14(src):
    return _hydrated(src).withColumns(rt.citation_columns()).select("doc_id", "ord", "breadcrumb", "page_display", "citation_title", "reader_text")


@plan("r20_evidence_titles", sql=f"""
WITH {CITE} SELECT doc_id, ord, CASE WHEN coalesce(nullif(crumb, ''), section) <> '' AND pd <> '' THEN concat(coalesce(nullif(crumb, ''), section), ' (p.', pd, ')') ELSE coalesce(nullif(crumb, ''), section) END AS title,
  CASE WHEN spine_source <> 'outline' THEN 'sections inferred' ELSE '' END AS context FROM h""")
def r20(src):
    return _hydrated(src).select("doc_id", "ord", rt.evidence_title().alias("title"), rt.evidence_context(F.col("spine_source")).alias("context"))


LEDGER = """s AS (SELECT user_id AS run_id, event_id AS seq, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS chunk_id, CAST(value AS BIGINT) AS tokens FROM @events),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, chunk_id ORDER BY ts, seq) AS rn FROM s) WHERE rn = 1),
l AS (SELECT *, row_number() OVER w AS entry, sum(tokens) OVER w AS upto FROM f WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
led AS (SELECT run_id, chunk_id, concat('E', entry) AS evidence_id, entry, seq AS call_seq, upto AS ledger_tokens FROM l WHERE upto - tokens < 300)"""


def _sightings(src):
    chunk = F.get_json_object("props", "$.k").cast("long")
    return src.table("events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("call_seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("slot"),
        chunk.alias("chunk_id"), F.rint("value").cast("long").alias("tokens"))


def _ledger(src):
    return rt.evidence_ledger(_sightings(src), F.floor(F.col("us") / 60_000_000), cap=300, order=("us", "slot"))


@plan("r15_evidence_ledger", sql=f"WITH {LEDGER} SELECT run_id, chunk_id, evidence_id, ledger_tokens FROM led")
def r15(src):
    return _ledger(src).select("run_id", "chunk_id", "evidence_id", "ledger_tokens")


@plan("r15_duplicate_calls", sql="""
SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, json_extract_string(props, '$.k') ORDER BY event_id) > 1 AS duplicate FROM @events""")
def r15_duplicates(src):
    calls = src.table("events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.get_json_object("props", "$.k").alias("args"))
    return rt.duplicate_calls(calls).select(F.col("seq").alias("event_id"), "duplicate")


@plan("r16_citations", sql=f"""
WITH {LEDGER}, c AS (SELECT user_id AS run_id, event_id AS position, event_id % 12 - 2 AS document_index FROM @events)
SELECT c.run_id, position, document_index, evidence_id, chunk_id FROM c JOIN led ON led.run_id = c.run_id AND led.entry - 1 = document_index""")
def r16(src):
    cites = src.table("events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("position"), (F.col("event_id") % 12 - 2).alias("document_index"))
    return rt.resolve_citations(cites, _ledger(src)).select("run_id", "position", "document_index", "evidence_id", "chunk_id")


@plan("r17_history", sql="""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM @conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) > 0) WHERE rn <= 4""")
def r17(src):
    return rt.replay_history(src.table("conversations"), 4).select("conv_id", "turn", "role")


@plan("r18_documents", sql="""
SELECT d.document_id, d.filename, coalesce(n, 0) AS chunks FROM v_documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM v_lines WHERE line_no > 0 GROUP BY 1) l ON l.doc_id = d.document_id""")
def r18(src):
    documents = src.view("documents").withColumn("ingested_at", F.timestamp_seconds(F.col("document_id") % 1000))
    chunks = src.view("lines").where("line_no > 0").select(F.col("doc_id").alias("document_id"))
    return rt.list_documents(documents, chunks).select("document_id", "filename", "chunks")


@plan("r19_grounded", sql="""
WITH a AS (SELECT conv_id, count(*) FILTER (role = 'assistant' AND length(text) % 3 = 0) AS n FROM @conversations GROUP BY 1)
SELECT conv_id AS run_id, n AS evidence, CASE WHEN n = 0 THEN 'no_context' END AS stop_reason FROM a""")
def r19(src):
    turns = src.table("conversations").withColumnRenamed("conv_id", "run_id")
    ledger = turns.where((F.col("role") == "assistant") & (F.char_length("text") % 3 == 0)).select("run_id")
    return rt.grounded(turns.select("run_id").distinct(), ledger, "Nothing relevant was found.").select("run_id", "evidence", "stop_reason")


@plan("r21_panel_paths", sql="""
SELECT doc_id, ord, CASE WHEN type <> 'figure' THEN '' WHEN ord % 4 = 0 THEN 'single.png' WHEN ord % 4 = 1 THEN 'p0,p1,p2,p3' WHEN ord % 4 = 2 THEN concat('q', ord) ELSE '' END AS paths FROM v_elements""")
def r21(src):
    o = F.col("ord")
    payload = F.when(o % 4 == 1, '{"panels": ["p0", "p1", "", "p2", "p3", "p4"]}').when(
        o % 4 == 2, F.concat(F.lit('{"panels": ["q'), o.cast("string"), F.lit('"]}'))).when(o % 4 == 0, "{broken")
    rows = src.view("elements").select("doc_id", "ord", F.col("type").alias("element_type"), payload.alias("payload"),
                                       F.when(o % 4 == 0, "single.png").alias("asset_path"))
    return rows.select("doc_id", "ord", F.array_join(rt.panel_paths(), ",").alias("paths"))


@plan("v1_hashed_bag", sql=f"WITH {SPARSE} SELECT id AS doc_id, slot, round(w, 9) AS weight FROM unit WHERE side = 'd'")
def v1(src):
    out = embed.hashed_slots(src.table("documents"), "doc_id", "text", DIM)
    return out.select("doc_id", "slot", F.round("weight", 9).alias("weight"))


@plan("v2_normalize", sql="""
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 50 = 0 THEN 0 ELSE x::DOUBLE * (1 + vec_id % 3) END) AS v FROM @embeddings),
u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM n)
SELECT vec_id, round(v[1] / CASE WHEN norm = 0 THEN 1 ELSE norm END, 9) AS first, round(list_sum(list_transform(v, lambda x: x * x)) / CASE WHEN norm = 0 THEN 1 ELSE norm * norm END, 6) AS length FROM u""")
def v2(src):
    scaled = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 50 == 0, 0.0).otherwise(x.cast("double") * (1 + F.col("vec_id") % 3)))
    unit = src.table("embeddings").select("vec_id", embed.normalize(scaled).alias("v"))
    return unit.select("vec_id", F.round(F.col("v")[0], 9).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


def _letter_model():
    """A stand-in for a caller's model: three counts per text."""
    def embed_texts(texts, query):
        return np.array([[len(t), t.count("e"), t.count(" ")] for t in texts])

    return embed_texts


@plan("v3_batch_embed", sql="""
SELECT doc_id, length(text) AS chars, length(text) - length(replace(text, 'e', '')) AS es, length(text) - length(replace(text, ' ', '')) AS spaces FROM @documents""")
def v3(src):
    out = embed.embed_table(src.table("documents").select("doc_id", "text"), "text", _letter_model)
    return out.select("doc_id", *[F.col("embedding")[i].cast("long").alias(n) for i, n in enumerate(("chars", "es", "spaces"))])


@plan("v4_embedding_cost", sql="""
SELECT doc_id, round(((n_chars + 3) // 4) * CASE doc_id % 4 WHEN 0 THEN 0.02::DOUBLE WHEN 1 THEN 0.13::DOUBLE WHEN 2 THEN 0.1::DOUBLE ELSE 0 END / 1000000, 8) AS cost_usd FROM @documents""")
def v4(src):
    model = F.element_at(F.array(*[F.lit(m) for m in (*embed.EMBEDDING_PRICES, "local")]), (F.col("doc_id") % 4 + 1).cast("int"))
    usage = src.table("documents").select("doc_id", model.alias("model"), tx.token_count(F.col("text")).alias("tokens"))
    return embed.embedding_cost(usage, embed.embedding_prices(src.spark)).select("doc_id", "cost_usd")
