"""Corpus load queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import assess, corpus
from ..session import work_dir
from ..sources.logs import parse_log_lines
from ..sources.tables import CorpusTables
from .registry import plan


def _doc():
    return F.col("document_id")


def _hashed(docs):
    return docs.withColumn("content_hash", corpus.content_hash(F.col("text")))


def _second_snapshot(docs):
    """A later delivery: some texts changed, some documents gone."""
    text = F.when(_doc() % 10 == 0, F.concat("text", F.lit(" amended"))).otherwise(F.col("text"))
    return docs.where(_doc() % 17 != 0).withColumn("text", text)


@plan("s1_source_listing", sql="""
SELECT DISTINCT path FROM (SELECT CASE WHEN document_id % 4 = 0 THEN concat('doc/', document_id, '.PDF')
  WHEN document_id % 4 = 1 THEN concat('doc/', document_id, '.docx') ELSE path END AS path FROM v_documents)
 WHERE lower(path) LIKE '%.txt' OR lower(path) LIKE '%.pdf'""")
def s1(src):
    path = F.when(_doc() % 4 == 0, F.concat(F.lit("doc/"), _doc().cast("string"), F.lit(".PDF"))).when(
        _doc() % 4 == 1, F.concat(F.lit("doc/"), _doc().cast("string"), F.lit(".docx"))).otherwise(F.col("path"))
    files = src.view("documents").select(path.alias("path"))
    return corpus.known_sources(files.unionByName(files), (".txt", ".pdf"))


@plan("s2_content_hash", sql="SELECT document_id, sha256(text) AS content_hash FROM v_documents")
def s2(src):
    return _hashed(src.view("documents")).select("document_id", "content_hash")


@plan("s3_classify", sql="""
WITH b AS (SELECT document_id, path, sha256(CASE WHEN document_id % 10 = 0 THEN concat(text, ' amended') ELSE text END) AS h FROM v_documents WHERE document_id % 17 <> 0),
a AS (SELECT path, sha256(text) AS h FROM v_documents WHERE document_id % 13 <> 0)
SELECT b.document_id, b.path, CASE WHEN a.path IS NULL THEN 'ingested' WHEN a.h = b.h THEN 'skipped' ELSE 'replaced' END AS status
  FROM b LEFT JOIN a USING (path)""")
def s3(src):
    docs = src.view("documents")
    stored = _hashed(docs.where(_doc() % 13 != 0))
    return corpus.classify(_hashed(_second_snapshot(docs)), stored).select("document_id", "path", "status")


def _corpus(docs):
    """The tables of one load: documents, their lines as chunks, a vector per chunk."""
    chunks = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))
    digest = F.md5("content")
    vectors = chunks.select("document_id", "ordinal", F.array(*[
        F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("double") / 65536 for i in range(4)]).alias("embedding"))
    return {"documents": docs, "chunks": chunks, "vectors": vectors}


def _loaded(src):
    """The first delivery on disk, and the second one loaded over it."""
    docs = src.view("documents")
    tables = CorpusTables(src.spark, work_dir(src.spark, "corpus"))
    tables.create(_corpus(docs))
    stored = tables.read("documents")
    changed = corpus.to_load(corpus.classify(_hashed(_second_snapshot(docs)), _hashed(stored)))
    tables.load(_corpus(changed.select(*docs.columns)), changed, paired=("chunks", "vectors"))
    return tables


@plan("s4_replace", sql="""
SELECT document_id, CASE WHEN document_id % 10 = 0 AND document_id % 17 <> 0 THEN concat(text, ' amended') ELSE text END AS text FROM v_documents""")
def s4(src):
    return _loaded(src).read("documents").select("document_id", "text")


@plan("s4_load", sql="""
WITH d AS (SELECT document_id, CASE WHEN document_id % 10 = 0 AND document_id % 17 <> 0 THEN concat(text, ' amended') ELSE text END AS text FROM v_documents),
l AS (SELECT document_id, unnest(string_split(text, chr(10))) AS line FROM d)
SELECT document_id, count(*) AS chunks, count(*) AS vectors, CAST(sum(length(line)) AS BIGINT) AS chars,
  round(sum(('0x' || substr(md5(line), 1, 4))::INT / 65536), 6) AS first_dimension FROM l GROUP BY 1""")
def s4_load(src):
    tables = _loaded(src)
    chunks = tables.read("chunks").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("content")).alias("chars"))
    vectors = tables.read("vectors").groupBy("document_id").agg(F.count(F.lit(1)).alias("vectors"), F.round(F.sum(F.col("embedding")[0]), 6).alias("first_dimension"))
    return chunks.join(vectors, "document_id").select("document_id", "chunks", "vectors", "chars", "first_dimension")


@plan("s5_delete", sql="""
SELECT 'documents' AS name, count(*) AS n FROM v_documents WHERE document_id % 7 <> 3
UNION ALL SELECT 'vectors', count(*) FILTER (chunk_id % 7 <> 3) FROM v_vectors
UNION ALL SELECT 'spans', count(*) FROM v_spans""")
def s5(src):
    docs = src.view("documents")
    vectors = src.view("vectors").select(F.col("chunk_id").alias("document_id"))
    gone = vectors.unionByName(docs.select("document_id")).where(_doc() % 7 == 3).distinct()
    left = corpus.delete_documents({"documents": docs, "vectors": vectors, "spans": src.view("spans")}, gone)
    counts = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, t in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@plan("s6_rename", sql="""
SELECT document_id, path, CASE WHEN document_id % 6 = 0 THEN concat('Agreement ', document_id) ELSE filename END AS filename FROM v_documents""")
def s6(src):
    docs = src.view("documents")
    wanted = F.when(_doc() % 6 == 0, F.concat(F.lit("  Agreement "), _doc().cast("string"))).otherwise("  ")
    names = docs.where(_doc() % 3 == 0).select("document_id", wanted.alias("filename"))
    return corpus.rename(docs, names).select("document_id", "path", "filename")


@plan("s7_isolate_failures", sql="""
SELECT document_id, CASE WHEN length(text) <> n_chars THEN 'failed' WHEN lang NOT IN ('en', 'de') THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN length(text) <> n_chars THEN concat('ValueError: ', n_chars, ' characters announced') WHEN lang NOT IN ('en', 'de')
  THEN concat('UnsupportedLanguage: ', lang) END AS error FROM v_documents""")
def s7(src):
    docs = src.view("documents")
    return corpus.isolate_failures(docs, {
        "ValueError": (F.char_length("text") != F.col("n_chars"),
                       F.concat(F.col("n_chars").cast("string"), F.lit(" characters announced"))),
        "UnsupportedLanguage": (~F.col("lang").isin("en", "de"), F.col("lang")),
    }).select("document_id", "status", "error")


@plan("s8_load_report", sql="""
SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS chunks, sum((length(text) + 3) // 4) AS tokens,
  CAST(floor(median((length(text) + 3) // 4)) AS INT) AS median_tokens, max((length(text) + 3) // 4) AS max_tokens
  FROM v_blocks WHERE length(text) > 0 GROUP BY doc_id""")
def s8(src):
    chunks = src.view("blocks").where(F.char_length("text") > 0).withColumn("token_count", tx.token_count(F.col("text")))
    return corpus.load_report(chunks)


@plan("s10_criteria_errors", sql="""
SELECT p_brand AS criterion_id, p_name AS sub_id, count(*) AS n FROM @part GROUP BY 1, 2 HAVING count(*) > 1""")
def s10(src):
    flat = src.table("part").select(F.col("p_brand").alias("criterion_id"), F.col("p_name").alias("sub_id"))
    return corpus.criteria_errors(flat)


@plan("s11_log_records", sql="""
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(event_id AS STRING) END AS span_id,
  CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'span.end' ELSE 'span.start' END AS msg,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 50 = 0 THEN NULL ELSE 2 END AS n_extras,
  event_id % 50 = 0 AS bad FROM @events""")
def s11(src):
    events = src.table("events")
    record = F.to_json(F.struct(
        F.col("ts").cast("string").alias("ts"), F.lit("INFO").alias("level"),
        F.when(F.col("event_id") % 2 == 0, "span.end").otherwise("span.start").alias("msg"),
        F.col("event_id").cast("string").alias("span_id"), F.col("event_type").alias("kind"), "value"))
    lines = events.select("event_id", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("~"), record)).otherwise(record).alias("value"))
    return parse_log_lines(lines).select(
        "event_id", "span_id", "msg", F.try_element_at("extras", F.lit("kind")).alias("kind"),
        F.when(F.col("bad").isNull(), F.size("extras")).alias("n_extras"), F.col("bad").isNotNull().alias("bad"))


@plan("s12_report_round_trip", sql="""
SELECT run_id, count(*) AS n_results, round(sum(cost_usd), 6) AS cost_usd, sum(claimed) AS quotes FROM v_criterion_results GROUP BY run_id""")
def s12(src):
    back = assess.parse_reports(assess.pack_reports(src.view("criterion_results")).select("run_id", "report_json"))
    return back.select(
        "run_id", F.size("results").alias("n_results"),
        F.round(F.aggregate("results", F.lit(0.0), lambda a, r: a + r["cost_usd"]), 6).alias("cost_usd"),
        F.aggregate("results", F.lit(0), lambda a, r: a + F.size(r["relevant_quotes"])).alias("quotes"))


@plan("s13_add_column", sql="""
SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM @orders""")
def s13(src):
    orders = src.table("orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return corpus.add_missing_columns(
        orders.where(F.col("o_orderkey") % 2 == 0).drop("o_orderpriority"), orders.where(F.col("o_orderkey") % 2 == 1))


@plan("s14_embedding_models", sql="""
SELECT concat('hash-', label % 2) AS embedding_model, count(*) AS vectors, count(*) FILTER (label % 2 = 1) > 0 AS conflicts FROM @embeddings GROUP BY 1""")
def s14(src):
    model = F.concat(F.lit("hash-"), (F.col("label") % 2).cast("string"))
    chunks = src.table("embeddings").select(model.alias("embedding_model"))
    counts = chunks.groupBy("embedding_model").agg(F.count(F.lit(1)).alias("vectors"))
    return corpus.embedding_models(chunks).join(counts, "embedding_model").withColumn(
        "conflicts", F.col("embedding_model") != "hash-0")


@plan("s15_wrong_width", sql="SELECT vec_id, CAST(len(embedding) - 1 AS INT) AS width FROM @embeddings WHERE vec_id % 9 = 0")
def s15(src):
    cut = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, F.size("embedding") - 1)).otherwise(F.col("embedding"))
    return corpus.wrong_width(src.table("embeddings").withColumn("embedding", cut), 64).select(
        "vec_id", F.size("embedding").alias("width"))


@plan("s16_prune", sql="""
SELECT name, count(*) FILTER (ts >= b) AS kept, count(*) FILTER (ts < b) AS removed
  FROM v_spans, (SELECT max(ts) - INTERVAL 7 DAY AS b FROM v_spans) GROUP BY name""")
def s16(src):
    spans = src.view("spans")
    bound = F.lit(src.latest(spans, "ts")) - F.expr("INTERVAL 7 DAYS")
    kept, removed = corpus.prune(spans, bound)
    count = F.count(F.lit(1))
    return kept.groupBy("name").agg(count.alias("kept")).join(
        removed.groupBy("name").agg(count.alias("removed")), "name", "full").na.fill(0)


@plan("s17_safe_filename", sql=r"""
WITH a AS (SELECT page_id, regexp_replace(url, '/+$', '') AS u FROM @pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(u, '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), '^[.\s_-]+', '') AS n FROM a),
c AS (SELECT page_id, regexp_replace(substring(regexp_replace(n, '(?i)\.pdf$', ''), 1, 100), '[._-]+$', '') AS n FROM b)
SELECT page_id, CASE WHEN n = '' THEN 'upload.pdf' ELSE concat(n, '.pdf') END AS filename FROM c""")
def s17(src):
    return src.table("pages").select("page_id", tx.safe_filename(F.col("url")).alias("filename"))
