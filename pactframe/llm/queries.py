"""The registered queries of this subpackage: thin uses of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, editcount, exact, hardneg, langid, minhash, mixing, neighbours, packing, pages, pii, quality, resampling
from .common import save, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs)).drop("text_hash")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the mixture: ``doc_id, source, epoch, block, block_order, n_tokens``."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, max_repeats=2.0, keep_text=False).select(
        "doc_id", "source", F.col("epoch").cast("long").alias("epoch"), "block", "block_order", "n_tokens")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every text, and the digest of the text with its spans generalised or removed."""
    docs = table(spark, sf_dir, "documents")
    found = save(pii.find(docs), "pii-found")
    clean = pii.rewritten(docs, found).groupBy("k1", "k2").agg(F.first(F.sha2("sanitised", 256)).alias("sanitised_sha256"))
    place = lambda kind, s: F.concat(kind, F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    base = F.transform("spans", lambda s: place(s["kind"], s))
    terms = F.transform("added", lambda s: place(F.lit(pii.TERM), s))
    counts = [pii.count_of(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.join(clean, ["k1", "k2"]).select(
        "doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, terms), ",").alias("spans"), F.size("added").cast("long").alias("n_terms"), "sanitised_sha256")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs, width=2).drop("h", "keeper")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, extra={"ids_crc32": F.crc32("ids")})


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and conversation -7, rebuilt from their event logs, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], given.schema)
    messages = chat.reconstruct(chat.events_of(given.unionByName(extra)))
    return chat.read_back(chat.render(messages))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after a log of edits."""
    docs = table(spark, sf_dir, "documents")
    return editcount.apply_edits(editcount.index(docs), editcount.edits_of(docs), keep_text=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact.exact_groups(docs, digests=True).drop("text_hash")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the texts of ``benchmark``."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, seed=2024)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives between 30 and 90 percent of each positive's score, with the labels the contract moves."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_language_id, op2_mix_sources, op3_personal_data, op4_near_duplicates, op5_pack, op6_chat, op7_token_counts, op8_exact_dedup, op9_nearest, op10_html_text,
    op11_resample, op12_hard_negatives, op13_quality)}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    # The exponent by plain bisection; the start of the last permutation by one
    # running sum over a source.
    "op2_mix_sources": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x : x <> '')) AS n_tokens,
                   substring(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS block, md5('doc|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS doc_order
            FROM documents),
        s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
        ends AS (SELECT min(tokens) / max(tokens) AS least FROM s WHERE tokens > 0),
        b AS (
            SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
            UNION ALL
            SELECT i + 1, CASE WHEN pow(least, (lo + hi) / 2 - 1) > 2.0 THEN (lo + hi) / 2 ELSE lo END,
                   CASE WHEN pow(least, (lo + hi) / 2 - 1) > 2.0 THEN hi ELSE (lo + hi) / 2 END
            FROM b, ends WHERE i < 60),
        x AS (SELECT ceil(hi * 1000000 - 0.001) / 1000000 AS e FROM b WHERE i = 60),
        w AS (SELECT source, tokens, pow(tokens, e) AS p, tokens / pow(tokens, e) AS r FROM s, x WHERE tokens > 0),
        t AS (SELECT sum(p) AS whole, sum(p) * max(r) AS budget FROM w),
        q AS (SELECT source, tokens, least(CAST(round(p / whole * budget) AS BIGINT), CAST(floor(2.0 * tokens) AS BIGINT)) AS quota FROM w, t),
        plan AS (
            SELECT s.source, coalesce(quota // q.tokens, 1) AS epochs, coalesce(quota % q.tokens, 0) AS rest
            FROM s LEFT JOIN q ON s.source IS NOT DISTINCT FROM q.source),
        k AS (
            SELECT d.*, epochs, rest, md5(concat_ws('|', epochs, coalesce(d.source, ''), block)) AS cut_order
            FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source),
        c AS (
            SELECT *, epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY source ORDER BY cut_order, doc_order RANGE UNBOUNDED PRECEDING)
                   - sum(n_tokens) OVER (PARTITION BY source, cut_order, doc_order) < rest THEN 1 ELSE 0 END AS copies FROM k),
        o AS (SELECT doc_id, source, block, n_tokens, unnest(range(CAST(copies AS BIGINT))) AS epoch FROM c)
        SELECT doc_id, source, epoch, block, md5(concat_ws('|', epoch, coalesce(source, ''), block)) AS block_order, n_tokens FROM o""",
    "op6_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        e AS (
            SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\h'), '</turn>', '\/turn>') AS body,
                   replace(replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '</turn>', '\/turn>'), ':', '\c'), chr(10), '\n') AS head
            FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('### ' || head || ': ' || body || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_nearest": r"""
        WITH v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
              AND list_sum(list_transform(embedding, lambda x : x::DOUBLE * x::DOUBLE)) > 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5""",
    # Two-word shingles, joined on the rarest ones: of two sets with a similarity
    # of 0.8 or more, the first tenths by rarity share a shingle.
    "op4_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x : x <> '') AS ws FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(ws) = 1 THEN [ws[1]]
                   ELSE list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i : ws[i] || ' ' || ws[i + 1]))) END AS s
            FROM w WHERE len(ws) > 0),
        reps AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets GROUP BY s),
        items AS (SELECT rep, n, unnest(s) AS x FROM reps),
        rare AS (SELECT x, count(*) AS df FROM items GROUP BY x),
        ranked AS (
            SELECT rep, n, x, row_number() OVER (PARTITION BY rep ORDER BY df, x) AS r
            FROM items JOIN rare USING (x)),
        prefix AS (SELECT rep, n, x FROM ranked WHERE r <= n - (8 * n + 9) // 10 + 1),
        cand AS (
            SELECT DISTINCT a.rep AS a, b.rep AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.rep < b.rep
            WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
        links AS (
            SELECT a, b FROM (
                SELECT c.a, c.b, len(list_intersect(p.s, q.s)) AS k, p.n + q.n AS total
                FROM cand c JOIN reps p ON c.a = p.rep JOIN reps q ON c.b = q.rep)
            WHERE 100 * k >= 80 * (total - k)),
        near AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT rep, rep AS other FROM reps UNION SELECT reach.rep, near.b FROM reach JOIN near ON reach.other = near.a),
        comp AS (SELECT rep, min(other) AS component_id FROM reach GROUP BY rep)
        SELECT w.doc_id, coalesce(len(sets.s), 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
               w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
        FROM w LEFT JOIN sets ON w.doc_id = sets.doc_id LEFT JOIN reps ON sets.s = reps.s LEFT JOIN comp c ON reps.rep = c.rep""",
    # The checksum's table from its rule, then word by word.
    "op11_resample": r"""
        WITH RECURSIVE bits AS (
            SELECT range AS b, range AS v, 0 AS i FROM range(256)
            UNION ALL
            SELECT b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i + 1 FROM bits WHERE i < 8),
        steps AS (SELECT list(v ORDER BY b) AS tab FROM bits WHERE i = 8),
        docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        items AS (
            SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        words AS (SELECT doc_id, unnest(ws) AS w FROM docs),
        known AS (SELECT DISTINCT w FROM (SELECT w FROM words UNION ALL SELECT w FROM items)),
        crc AS (
            SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i : ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT),
                   lambda c, b : xor(tab[(xor(c, b) & 255) + 1], c // 256), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
            FROM known, steps),
        s AS (SELECT bucket, count(*) AS s FROM words JOIN crc USING (w) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM items JOIN crc USING (w) GROUP BY bucket),
        whole AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS all_s, (SELECT coalesce(sum(t), 0) FROM t) AS all_t),
        gain AS (
            SELECT b.range AS bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE
                   / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS g
            FROM range(10000) b LEFT JOIN s ON s.bucket = b.range LEFT JOIN t ON t.bucket = b.range, whole),
        weighed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM words JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
        scored AS (
            SELECT docs.doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
                   (('0x' || substr(sha256('2024:' || docs.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM docs LEFT JOIN weighed USING (doc_id)),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                   count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed""",
    "op12_hard_negatives": r"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x : floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT alike AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
        QUALIFY row_number() OVER w <= 10""",
}
