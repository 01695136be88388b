"""A table of questions against a table of chunks.

Questions carry ``query_id``; a scope column restricts a question to one
document and is always applied before the top k. Corpus statistics of the
keyword side stay global under a scope.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stemmer import porter_stem
from ..session import materialize
from . import ordered
from .neighbours import nearest
from .ranks import top_k

if TYPE_CHECKING:
    from .keyword_index import KeywordIndex

# BM25 and fusion constants, pool sizes, caps.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K, CANDIDATES, TOP_K = 60, 20, 6
SECTION_LIMIT, HISTORY_TURNS, MAX_PANELS, EVIDENCE_CAP = 20, 8, 4, 12_000
MODES = ("hybrid", "vector", "keyword")
#: Distinct words a task holds at once.
WORDS_HELD = 500_000
NEEDS_VECTORS = ("hybrid", "vector")


def _accents() -> dict[str, str]:
    """Latin letters with a mark and their base letter, by Unicode decomposition."""
    table = {}
    for point in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(point):
            table[chr(point)] = base
    return table


ACCENTS = _accents()


def index_words(text: Column) -> Column:
    """Words as the index holds them: any script, lower case, without accents."""
    return tx.words(F.translate(text, "".join(ACCENTS), "".join(ACCENTS.values())))


# -- keyword ----------------------------------------------------------------


def postings(chunks: DataFrame, *, stemmed: bool = False) -> DataFrame:
    """(chunk_id, pos, term) for every word of every chunk."""
    rows = chunks.select("chunk_id", F.posexplode(index_words(F.col("content"))).alias("pos", "term"))
    return stem_terms(rows) if stemmed else rows


def stem_terms(rows: DataFrame) -> DataFrame:
    """Terms replaced by their stems, worked out once per distinct term."""
    stems = rows.select("term").distinct().withColumn("stem", porter_stem("term"))
    return rows.join(stems, "term").drop("term").withColumnRenamed("stem", "term")


def distinct_words(chunks: DataFrame) -> DataFrame:
    """(word): every word of the chunks once.

    A chunk is cut into words once, and a task puts the words of its chunks
    together before any row is made of one; it holds ``WORDS_HELD`` at most.
    """

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        for batch in batches:
            held.update(pc.unique(batch.column(0).flatten()).to_pylist())
            if len(held) >= WORDS_HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], ["word"])
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string())], ["word"])

    return chunks.select(index_words(F.col("content")).alias("words")).mapInArrow(together, "word string").distinct()


def stem_phrases(asked: DataFrame) -> DataFrame:
    """Phrases with the stems of their words, worked out once per distinct phrase."""
    each = asked.select(F.array_join("words", " ").alias("_said"), F.posexplode("words").alias("p", "term")).distinct()
    back = stem_terms(each).groupBy("_said").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p", "term"))), lambda x: x["term"]).alias("words"))
    return asked.withColumn("_said", F.array_join("words", " ")).drop("words").join(back, "_said").drop("_said")


def query_phrases(questions: DataFrame) -> DataFrame:
    """(query_id, words): each white-space token is one phrase of its words."""
    tokens = F.split(F.col("question"), f"[{tx.SPACE}]+")
    phrases = F.filter(F.transform(tokens, index_words), lambda w: F.size(w) > 0)
    return questions.select(
        *[c for c in questions.columns if c != "question"], F.explode(phrases).alias("words"))


def match_expression(question: Column) -> Column:
    """The question as quoted phrases joined by OR; empty when it has no words."""
    phrases = F.filter(F.transform(F.split(question, f"[{tx.SPACE}]+"), tx.words), lambda w: F.size(w) > 0)
    return F.array_join(F.transform(phrases, lambda w: F.concat(F.lit('"'), F.array_join(w, " "), F.lit('"'))), " OR ")


def phrase_frequencies(phrases: DataFrame, post: DataFrame) -> DataFrame:
    """(phrase, chunk_id, tf) for distinct phrases (phrase, words).

    Words of a phrase meet where their positions less their offsets agree, an
    equi join on the term and a count per start; single words skip the count.
    """
    short = phrases.where(F.size("words") == 1).select("phrase", F.col("words")[0].alias("term"))
    single = post.join(short, "term").groupBy("phrase", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
    long_ = phrases.where(F.size("words") > 1)
    parts = long_.select("phrase", F.size("words").alias("m"), F.posexplode("words").alias("off", "term"))
    multi = (
        post.join(parts, "term")
        .groupBy("phrase", "m", "chunk_id", (F.col("pos") - F.col("off")).alias("start"))
        .agg(F.count(F.lit(1)).alias("hit")).where(F.col("hit") == F.col("m"))
        .groupBy("phrase", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
    )
    return single.unionByName(multi)


def _parts(phrases: DataFrame, chunks: DataFrame, stemmed: bool) -> DataFrame:
    """(unit, off, phrase, need): what of a phrase is looked up in a chunk, and how many make it whole.

    A word is its own unit, a longer phrase its pairs of neighbours: far fewer
    places than those of its words. Stems are looked up as the words of the
    chunks that have them, worked out once per distinct word.
    """
    n = F.size("words")
    pairs = F.transform(F.slice("words", 1, n - 1), lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))
    units = F.col("words") if stemmed else F.when(n == 1, F.col("words")).otherwise(pairs)
    each = phrases.where(n > 0).select("phrase", units.alias("units")).select("phrase", F.size("units").alias("need"), F.posexplode("units").alias("off", "unit"))
    if stemmed:
        said = distinct_words(chunks).withColumn("unit", porter_stem("word"))
        each = said.join(each, "unit").drop("unit").withColumnRenamed("word", "unit")
    return materialize(each, "asked-parts")


def phrase_hits(phrases: DataFrame, chunks: DataFrame, *, stemmed: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chunk_id, kept columns, len, phrase, tf) for distinct phrases (phrase, words), and one row without a phrase for every chunk.

    A chunk's text is cut into words once and only units that were asked for
    leave the task. A longer phrase is whole where as many of its units as it
    has agree on its start.
    """
    parts = _parts(phrases, chunks, stemmed)
    paired = not stemmed and not parts.where(F.contains("unit", F.lit(" "))).isEmpty()
    none = F.array(F.lit(None).cast("string"))

    def units(words: Column) -> Column:
        found = F.concat(none, words)
        if paired:
            head = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
            found = F.concat(found, F.transform(head, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1))))
        return F.struct(F.size(words).alias("len"), found.alias("units"))

    words = F.coalesce(index_words(F.col("content")), F.array().cast("array<string>"))
    cut = chunks.select("chunk_id", *keep, tx.bind(words, units).alias("u"))
    each = cut.select("chunk_id", *keep, F.col("u.len").alias("len"), F.posexplode("u.units").alias("pos", "unit"))
    met = each.join(parts, "unit", "left").where(F.col("phrase").isNotNull() | F.col("unit").isNull())
    keys = ["chunk_id", *keep, "len", "phrase"]
    start = F.when(F.col("need") > 1, F.col("pos") - F.col("off")).alias("start")
    whole = met.groupBy(*keys, "need", start).agg(F.count(F.lit(1)).alias("hit")).where(
        F.col("phrase").isNull() | (F.col("need") == 1) | (F.col("hit") == F.col("need")))
    return whole.groupBy(*keys).agg(F.sum(F.when(F.col("need") > 1, 1).otherwise(F.col("hit"))).alias("tf"))


def bm25(questions: DataFrame, chunks: DataFrame, *, k: int, scope: str | None = None, stemmed: bool = False) -> DataFrame:
    """The ``k`` best chunks per question: (query_id, chunk_id, score, rank).

    The counts of the asked phrases are written once, dealt by chunk and scored
    there against all questions, so a (question, chunk) pair is added up where
    it arises and only a task's best rows per question are shuffled. Question
    words are broadcast while they are small.
    """
    asked = query_phrases(questions)
    if stemmed:
        asked = stem_phrases(asked)
    keyed = asked.withColumn("phrase", F.array_join("words", " "))
    keys = ["query_id"] + ([scope] if scope else [])
    weights = keyed.groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("weight"))
    distinct = keyed.select("phrase", "words").dropDuplicates(["phrase"])
    counts = materialize(phrase_hits(distinct, chunks, stemmed=stemmed, keep=(scope,) if scope else ()), "phrase-hits")
    stats = counts.where("phrase IS NULL").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("len").alias("avg_len"))
    tf = counts.where("phrase IS NOT NULL")
    df = tf.groupBy("phrase").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    asked = materialize(weights.join(df, "phrase").select(*keys, "phrase", (F.col("weight") * idf).alias("factor"), "avg_len"), "asked-phrases")
    hits = tf.repartition("chunk_id").join(asked, ["phrase"] + ([scope] if scope else []))
    gain = F.col("factor") * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(gain), 9).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


# -- vectors ----------------------------------------------------------------


def similarity(distance: Column) -> Column:
    """Distance of unit vectors as a cosine, held to [0, 1]."""
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance * distance / 2))
    return F.when(distance.isNotNull(), held)


# -- fusion and hydration ---------------------------------------------------


def fuse(rankings: dict[str, DataFrame], *, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, chunk_id, rank) lists; ids break ties."""
    both = None
    for name, df in rankings.items():
        far = F.col("distance") if "distance" in df.columns else F.lit(None)
        part = df.select("query_id", "chunk_id", F.lit(name).alias("retriever"), "rank", far.cast("double").alias("distance"))
        both = part if both is None else both.unionByName(part)
    scored = both.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 12).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("retriever", "rank")))).alias("ranks"),
        F.max("distance").alias("distance"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def retrieve(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, *, mode: str = "hybrid",
    top: int = TOP_K, candidates: int = CANDIDATES, scope: str | None = None, rrf_k: int = RRF_K, stemmed: bool = False,
    index: KeywordIndex | None = None,
) -> DataFrame:
    """Ranked chunks per question with the mode's own score.

    Cosine for ``vector``, BM25 for ``keyword``, the fused score for
    ``hybrid``. Questions hold ``question`` and, for modes that need vectors,
    ``embedding``. The pool is never narrower than the answer. With an ``index``
    of the chunks the keyword side reads that instead of the chunks.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    if mode in NEEDS_VECTORS and vectors is None:
        raise ValueError(f"mode={mode!r} compares vectors and none were given; mode='keyword' runs without")
    pool = max(candidates, top)
    lists: dict[str, DataFrame] = {}
    if mode in NEEDS_VECTORS:
        lists["vector"] = nearest(vectors, questions, k=pool, scope=scope)
    if mode in ("hybrid", "keyword"):
        asked = questions.drop("embedding")
        if index is not None:
            from .keyword_index import search

            lists["keyword"] = search(index, asked, k=pool, scope=scope)
        else:
            lists["keyword"] = bm25(asked, chunks, k=pool, scope=scope, stemmed=stemmed)
    if mode == "hybrid":
        ranked = fuse(lists, k=top, rrf_k=rrf_k)
        return ranked.withColumn("similarity", similarity(F.col("distance"))).drop("distance")
    only = lists[mode].where(F.col("rank") <= top)
    ranks = F.create_map(F.lit(mode), F.col("rank"))
    if mode == "vector":
        cosine = similarity(F.col("distance"))
        return only.select("query_id", "chunk_id", cosine.alias("score"), ranks.alias("ranks"), "rank", cosine.alias("similarity"))
    return only.select("query_id", "chunk_id", "score", ranks.alias("ranks"), "rank", F.lit(None).cast("double").alias("similarity"))


def hydrate(ranked: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunk and document columns for ranked ids; ids that vanished are dropped."""
    return ranked.join(chunks, "chunk_id").join(documents, "document_id")


# -- sections and citations -------------------------------------------------


def by_section(questions: DataFrame, chunks: DataFrame, *, limit: int = SECTION_LIMIT) -> DataFrame:
    """Chunks of a document with a path component starting with a literal prefix."""
    asked = questions.where(F.trim("prefix") != "")
    hit = F.exists("section_path", lambda p: p.startswith(F.col("prefix")))
    found = asked.join(chunks, "document_id").where(hit)
    return top_k(found, ["query_id"], [F.asc("ordinal")], limit)


def document_sections(chunks: DataFrame, segment: Column | None = None) -> DataFrame:
    """Outline of each document: neighbours with one path collapse to an entry."""
    starts = F.col("_path").isNull() | (F.col("_path") != F.col("section_path"))
    runs = ordered.islands(chunks, ["document_id"], ["ordinal"], segment, starts, {"_path": F.col("section_path")}, "entry")
    end = F.coalesce(F.nullif("page_label_end", F.lit("")), F.nullif("page_label", F.lit("")))
    return runs.groupBy("document_id", "entry").agg(
        F.min_by("section_path", "ordinal").alias("section_path"),
        F.coalesce(F.min_by("page_label", "ordinal"), F.lit("")).alias("first_label"),
        F.max_by(end, F.when(end.isNotNull(), F.col("ordinal"))).alias("last_label"),
        F.count(F.lit(1)).alias("chunks"),
    ).withColumn("page_display", page_display(F.col("first_label"), F.col("last_label")))


def page_display(first: Column, last: Column) -> Column:
    ranged = (F.coalesce(last, F.lit("")) != "") & (last != first)
    return F.when(ranged, F.concat_ws("-", first, last)).otherwise(first)


def citation_columns() -> dict[str, Column]:
    """Breadcrumb, page range, citation title and the text a reader is shown."""
    crumb = F.array_join("section_path", " > ")
    leaf = F.when(F.size("section_path") > 0, F.element_at("section_path", -1)).otherwise(F.coalesce("section", F.lit("")))
    page = page_display(F.coalesce("page_label", F.lit("")), F.coalesce("page_label_end", F.lit("")))
    title = F.concat(F.col("filename"), F.when(leaf != "", F.concat(F.lit(" — "), leaf)).otherwise(""))
    grid = (F.col("element_type") == "table") & (F.coalesce("payload", F.lit("")) != "")
    return {
        "breadcrumb": crumb,
        "page_display": page,
        "citation_title": F.concat(title, F.when(page != "", F.concat(F.lit(" (p."), page, F.lit(")"))).otherwise("")),
        "reader_text": F.when(grid, F.when(crumb != "", F.concat_ws("\n", crumb, F.col("payload"))).otherwise(F.col("payload")))
        .otherwise(F.col("content")),
    }


def evidence_title() -> Column:
    """Full path with its page, else the page, else the file name."""
    crumb = F.coalesce(F.nullif(F.array_join("section_path", " > "), F.lit("")), F.coalesce("section", F.lit("")))
    page = page_display(F.coalesce("page_label", F.lit("")), F.coalesce("page_label_end", F.lit("")))
    marked = F.concat(F.lit("p."), page)
    return (
        F.when((crumb != "") & (page != ""), F.concat(crumb, F.lit(" ("), marked, F.lit(")")))
        .when(crumb != "", crumb).when(page != "", marked).otherwise(F.col("filename"))
    )


def evidence_context(spine_source: Column) -> Column:
    return F.when(spine_source != "outline", "sections inferred").otherwise("")


def panel_paths(limit: int = MAX_PANELS) -> Column:
    """Files behind a figure chunk: the payload's list, else the single asset, capped."""
    listed = F.from_json("payload", "struct<panels:array<string>>")["panels"]
    named = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != "")
    single = F.when(F.coalesce("asset_path", F.lit("")) != "", F.array("asset_path")).otherwise(F.array().cast("array<string>"))
    paths = F.slice(F.when(F.size(named) > 0, named).otherwise(single), 1, limit)
    return F.when(F.col("element_type") == "figure", paths).otherwise(F.array().cast("array<string>"))


# -- ledgers and history ----------------------------------------------------


def evidence_ledger(
    sightings: DataFrame, segment: Column, *, cap: int = EVIDENCE_CAP, order: tuple[str, ...] = ("seq", "slot")
) -> DataFrame:
    """First sight of each chunk in a run as E1, E2, ... up to the evidence cap.

    ``sightings`` are (run_id, call_seq, seq, slot, chunk_id, tokens), ordered
    by ``order`` inside a run. A call that starts with the cap reached retrieves
    nothing, so entries stop at the first call whose predecessors fill it.
    First sights come from a partial aggregate and running figures from
    segmented windows, so a run of any length is spread out.
    """
    first = sightings.groupBy("run_id", "chunk_id").agg(
        F.min_by(F.struct("call_seq", *order, "tokens"), F.struct(*order)).alias("f")).select("run_id", "chunk_id", "f.*")
    numbered = ordered.row_index(first, ["run_id"], list(order), segment, "entry")
    summed = ordered.running_sum(numbered, ["run_id"], list(order), segment, F.col("tokens").cast("long"), "_upto")
    per_call = summed.groupBy("run_id", "call_seq").agg(F.min(F.col("_upto") - F.col("tokens")).alias("before_call"))
    return summed.join(per_call, ["run_id", "call_seq"]).where(F.col("before_call") < cap).select(
        "run_id", "chunk_id", F.concat(F.lit("E"), F.col("entry").cast("string")).alias("evidence_id"), "entry", "call_seq", "tokens",
        F.col("_upto").alias("ledger_tokens"))


def duplicate_calls(calls: DataFrame) -> DataFrame:
    """Calls whose (name, args) a run has made before."""
    first = calls.groupBy("run_id", "name", "args").agg(F.min("seq").alias("first_seq"))
    return calls.join(first, ["run_id", "name", "args"]).withColumn("duplicate", F.col("seq") > F.col("first_seq"))


def resolve_citations(citations: DataFrame, ledger: DataFrame) -> DataFrame:
    """Citations by ledger position; positions outside the ledger are dropped."""
    entries = ledger.select("run_id", (F.col("entry") - 1).alias("document_index"), "evidence_id", "chunk_id")
    return citations.join(entries, ["run_id", "document_index"])


def replay_history(history: DataFrame, turns: int = HISTORY_TURNS) -> DataFrame:
    """The last non-blank user and assistant turns of each conversation."""
    kept = history.where(F.col("role").isin("user", "assistant") & (tx.strip(F.col("text")) != ""))
    return top_k(kept, ["conv_id"], [F.desc("turn")], turns, "back").drop("back")


def grounded(runs: DataFrame, ledger: DataFrame, no_context_text: str) -> DataFrame:
    """Runs with their evidence count; one without evidence answers with the fixed text."""
    counts = ledger.groupBy("run_id").agg(F.count(F.lit(1)).alias("evidence"))
    n = F.coalesce("evidence", F.lit(0))
    return runs.join(counts, "run_id", "left").withColumns({
        "evidence": n, "stop_reason": F.when(n == 0, "no_context"), "fixed_text": F.when(n == 0, no_context_text)})


def list_documents(documents: DataFrame, chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Documents with their chunk counts, newest first, the id breaking ties."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    listed = documents.join(counts, "document_id", "left").na.fill(0, ["chunks"]).orderBy(F.desc("ingested_at"), F.desc("document_id"))
    return listed if limit is None else listed.limit(limit)
