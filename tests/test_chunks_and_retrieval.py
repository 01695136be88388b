"""Packing with overlap, quotes, retrieval and scope against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactframe.operators import assess, chunking as ck, corpus, embed, neighbours
from pactframe.operators import retrieval as rt


def tokens(text):
    return (len(text) + 3) // 4


def brute_pack(texts, limit, carry):
    """Straight restatement of packing for paragraphs of whole sentences."""
    groups, now, fresh = [], [], False
    for text in texts:
        if now and fresh and sum(tokens(t) for t in now) + len(now) - 1 + 1 + tokens(text) > limit:
            groups.append(now)
            seed, room = [], carry
            for old in reversed(now[1:]):
                if tokens(old) + 1 <= room:
                    seed.insert(0, old)
                    room -= tokens(old) + 1
                    continue
                tail, left = [], room - 1
                for s in reversed(old.split(". ")):
                    s = s if s.endswith(".") else s + "."
                    if tokens(s) + 1 > left:
                        break
                    tail.insert(0, s)
                    left -= tokens(s) + 1
                if tail:
                    seed.insert(0, " ".join(tail))
                break
            now, fresh = seed, False
        now.append(text)
        fresh = True
    return groups + [now]


def test_overlap_packing(spark):
    random.seed(3)
    texts = [" ".join("w" * random.randrange(3, 60) + "." for _ in range(random.randrange(1, 6))) for _ in range(60)]
    rows = [(1, i, 0, "1", None, "", "paragraph", t, "S", ["A", "B"], "none") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, ord long, page long, page_label string, page_end long, page_label_end string, type string, text string, section string, section_path array<string>, spine_source string")
    drafts = ck.prose_chunks(df, chunk_tokens=120, overlap_tokens=40).orderBy("chunk_no").collect()
    limit = 120 - (tokens("A > B") + 1)
    assert [d["body"] for d in drafts] == ["\n".join(g) for g in brute_pack(texts, limit, min(40, limit // 2))]
    assert any(d["overlap_tokens"] for d in drafts)
    again = ck.prose_chunks(df.repartition(5), chunk_tokens=120, overlap_tokens=40).orderBy("chunk_no").collect()
    assert [d["body"] for d in again] == [d["body"] for d in drafts]


def test_long_sentence_is_cut_on_words(spark):
    text = "Short one. " + " ".join(f"word{i:04d}" for i in range(200)) + ". Last one."
    parts = spark.createDataFrame([(text,)], "t string").select(ck.split_text(F.col("t"), F.lit(70)).alias("p")).first()["p"]
    assert parts[0] == "Short one." and parts[-1] == "Last one." and all(tokens(p) <= 70 for p in parts)
    assert " ".join(parts).split() == text.split()


def test_snippet_starts_at_the_citing_sentence(spark):
    text = "Filler words go here. " * 30 + "As Figure 3.1 shows, all is well. More follows."
    got = spark.createDataFrame([(text,)], "t string").select(ck.snippet(F.col("t"), F.lit("figure:3.1")).alias("s")).first()["s"]
    assert got == "As Figure 3.1 shows, all is well. More follows."


def test_find_quotes_equals_containment(spark):
    random.seed(11)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "rho", "ab", "abc"]
    docs = [" ".join(random.choice(words) for _ in range(60)) + " common boiler plate line here now" for _ in range(40)]
    quotes = ["common boiler plate line here", "ommon boiler plate line her", "pha beta", "lph", "a", "the of", "rho ab abc gam", "| Alpha", "zzz", "", "missing words that never occur at all"]
    for _ in range(20):
        d, i = random.choice(docs), random.randrange(150)
        quotes.append(d[i:i + random.randrange(3, 70)].strip())
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    p = spark.createDataFrame(list(enumerate(docs)), "passage_id long, passage string")
    norm = lambda t: " ".join(t.replace("|", " ").split()).lower()
    want = {(i, j) for i, x in enumerate(quotes) for j, d in enumerate(docs) if norm(x) and norm(x) in norm(d)}
    assert {tuple(r) for r in assess.find_quotes(q, p).collect()} == want


def vectors_of(spark, n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim)).astype("float32")
    rows = [(i, i % 3 if i % 4 else 0, m[i].tolist()) for i in range(n)]
    return m, rows, spark.createDataFrame(rows, "chunk_id long, document_id int, embedding array<float>")


@pytest.mark.parametrize("block", [4096, 5])
def test_nearest_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "QUESTION_BLOCK", block)
    m, rows, vectors = vectors_of(spark, 400)
    asked = spark.createDataFrame([(q, q % 3, m[q * 7].tolist()) for q in range(12)], "query_id long, document_id int, embedding array<float>")
    for scope in (None, "document_id"):
        got = rt.nearest(vectors.repartition(6), asked, k=5, scope=scope).collect()
        for q in range(12):
            pool = [(np.linalg.norm(m[i].astype(float) - m[q * 7].astype(float)), i) for i, d, _ in rows if scope is None or d == q % 3]
            want = [i for _, i in sorted(pool)[:5]]
            assert [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_nearest_without_questions(spark):
    _, _, vectors = vectors_of(spark, 40)
    none = vectors.limit(0).withColumnRenamed("chunk_id", "query_id")
    assert rt.nearest(vectors, none, k=3).collect() == []
    assert rt.nearest(vectors.limit(0), vectors.withColumnRenamed("chunk_id", "query_id"), k=3).collect() == []


CHUNKS = [(1, 1, "Passwords rotate every 90 days under GOV-01."), (2, 1, "Assets are listed each quarter."),
          (3, 2, "GOV-01 GOV-01 passwords passwords rotate rotate decoy."), (4, 2, "Other gov text 01 apart."), (5, 1, "TLS 1.2 or better.")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, document_id long, content string")


def test_identifier_is_a_phrase(spark, chunks):
    asked = spark.createDataFrame([(1, "GOV-01")], "query_id long, question string")
    assert {r["chunk_id"] for r in rt.bm25(asked, chunks, k=9).collect()} == {1, 3}


def test_scope_keeps_the_decoy_out(spark, chunks):
    asked = spark.createDataFrame([(1, "passwords rotate", 1), (2, "passwords rotate", 2)], "query_id long, question string, document_id long")
    got = {(r["query_id"], r["chunk_id"]) for r in rt.bm25(asked, chunks, k=9, scope="document_id").collect()}
    assert got == {(1, 1), (2, 3)}
    vectors = embed.hashed_vectors(chunks, "chunk_id", "content", 64).join(chunks.select("chunk_id", "document_id"), "chunk_id")
    full = asked.join(embed.hashed_vectors(asked, "query_id", "question", 64), "query_id")
    hybrid = rt.retrieve(full, chunks, vectors, mode="hybrid", scope="document_id", top=2).collect()
    assert {r["chunk_id"] for r in hybrid if r["query_id"] == 1} <= {1, 2, 5}
    assert all((r["similarity"] is not None) == ("vector" in r["ranks"]) for r in hybrid)


def test_stemmed_search(spark, chunks):
    asked = spark.createDataFrame([(1, "password rotation")], "query_id long, question string")
    assert rt.bm25(asked, chunks, k=9).count() == 0
    assert {r["chunk_id"] for r in rt.bm25(asked, chunks, k=9, stemmed=True).collect()} == {1, 3}


def test_words_of_nothing(spark, chunks):
    asked = spark.createDataFrame([(1, " ?! -- ")], "query_id long, question string")
    assert rt.bm25(asked, chunks, k=3).count() == 0


def test_fusion_ties_break_on_the_id(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 3, 2)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 9, 1), (1, 3, 2)], "query_id long, chunk_id long, rank int")
    got = rt.fuse({"vector": a, "keyword": b}, k=3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [3, 7, 9] and got[0]["ranks"] == {"vector": 2, "keyword": 2}


def test_modes_refuse(spark, chunks):
    asked = spark.createDataFrame([(1, "x")], "query_id long, question string")
    for mode in ("hybrid", "vector", "guess"):
        with pytest.raises(ValueError):
            rt.retrieve(asked, chunks, mode=mode)


def test_guards(spark):
    df = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "embedding_model string, embedding array<double>")
    with pytest.raises(corpus.ModelMismatch):
        corpus.check_model(df, "a")
    with pytest.raises(corpus.DimensionMismatch):
        corpus.check_width(df, 2)
    corpus.check_model(df.where("embedding_model = 'a'"), "a")


def test_classify_flags(spark):
    stored = spark.createDataFrame([("p", "h1"), ("q", "h2")], "path string, content_hash string")
    new = spark.createDataFrame([("p", "h1"), ("q", "hx"), ("r", "h3")], "path string, content_hash string")
    status = lambda **kw: {r["path"]: r["status"] for r in corpus.classify(new, stored, **kw).collect()}
    assert status() == {"p": "skipped", "q": "replaced", "r": "ingested"}
    assert status(force=True)["p"] == "replaced" and set(status(dry_run=True).values()) == {"dry-run"}
