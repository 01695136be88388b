"""Stored keyword index, scoped and shelled neighbours, short quotes, folds over long keys."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactframe.operators import assess, chunking as ck, keyword_index, neighbours, spans
from pactframe.operators import retrieval as rt
from pactframe.operators import structure as st
from pactframe.session import work_dir


def ranked(df):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    common, rare = ["the", "of", "party", "shall", "term"], [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare[: 20 + i % 280]) for _ in range(rng.randrange(1, 60))) for i in range(900)]
    texts += ["GOV-01 the term", "gov 01 apart 01 gov", "", "Überall ist GOV-01, GOV-01"]
    return spark.createDataFrame([(i, i % 7 if i % 11 else 0, t) for i, t in enumerate(texts)], "chunk_id long, document_id long, content string")


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(9)
    words = ["the", "of", "party", "shall", "term", *[f"w{i}" for i in range(310)], "GOV-01", "w1-w2", "of-the", "uberall"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))), i % 8) for i in range(120)]
    return spark.createDataFrame([*rows, (500, "the the the w3", 2), (501, "the", 0), (502, "GOV-01 GOV-01", 3), (503, "?!", 1)], "query_id long, question string, document_id long")


@pytest.mark.parametrize("slab", [4096, 50])
def test_index_equals_the_full_scores(spark, corpus, asked, monkeypatch, slab):
    monkeypatch.setattr(keyword_index, "SLAB", slab)
    path = work_dir(spark, "index-test")
    keyword_index.build(corpus, path, keep=("document_id",))
    index = keyword_index.opened(spark, path)
    for k in (1, 10):
        assert ranked(keyword_index.search(index, asked, k=k)) == ranked(rt.bm25(asked, corpus, k=k))
    assert ranked(keyword_index.search(index, asked, k=4, scope="document_id")) == ranked(rt.bm25(asked, corpus, k=4, scope="document_id"))


def test_index_scores_few_of_the_pairs(spark, corpus, asked):
    index = keyword_index.build(corpus, work_dir(spark, "index-pairs"))
    kept, _ = keyword_index.Search(index, asked, 3).finalists()
    every = rt.postings(corpus).select("chunk_id", "term").distinct().join(
        rt.query_phrases(asked).select("query_id", F.explode("words").alias("term")).distinct(), "term").select("query_id", "chunk_id").distinct()
    assert kept.count() * 8 < every.count()


def test_stemmed_index(spark, corpus, asked):
    index = keyword_index.build(corpus, work_dir(spark, "index-stems"), stemmed=True)
    assert ranked(keyword_index.search(index, asked, k=5)) == ranked(rt.bm25(asked, corpus, k=5, stemmed=True))


def test_empty_index(spark, corpus, asked):
    index = keyword_index.build(corpus.limit(0), work_dir(spark, "index-none"))
    assert keyword_index.search(index, asked, k=5).collect() == []
    full = keyword_index.build(corpus, work_dir(spark, "index-full"))
    assert keyword_index.search(full, asked.limit(0), k=5).collect() == []


def vectors(spark, m, scopes, first=0, key="chunk_id"):
    return spark.createDataFrame([(first + i, s, v.tolist()) for i, (v, s) in enumerate(zip(m, scopes))], f"{key} long, document_id int, embedding array<double>")


def brute(m, scopes, asked, asked_scopes, k, scoped):
    out = []
    for q, (a, s) in enumerate(zip(asked, asked_scopes)):
        d = np.sqrt(((m - a) ** 2).sum(1))
        pool = [(round(d[i], 9), i) for i in range(len(m)) if not scoped or scopes[i] == s and s is not None]
        out += [(q, rank, i) for rank, (_, i) in enumerate(sorted(pool)[:k], 1)]
    return out


@pytest.mark.parametrize("shift", [0.0, 1e5])
@pytest.mark.parametrize("scoped", [False, True])
def test_nearest_far_from_the_origin(spark, monkeypatch, shift, scoped):
    monkeypatch.setattr(neighbours, "VECTOR_BLOCK", 60)
    monkeypatch.setattr(neighbours, "QUESTION_BLOCK", 7)
    monkeypatch.setattr(neighbours, "PIVOTS", 9)
    rng = np.random.default_rng(2)
    m = shift + np.concatenate([rng.standard_normal((300, 6)) * (1e-3 if shift else 1), rng.standard_normal((300, 6)) * 1e-3 + 4, np.ones((150, 6))])
    asked = shift + np.concatenate([rng.standard_normal((30, 6)) * (1e-3 if shift else 1), np.ones((3, 6)), rng.standard_normal((3, 6)) * 50])
    scopes = [None if i % 17 == 0 else 0 if i % 3 else i % 5 for i in range(len(m))]
    mine = [None if i == 4 else i % 6 for i in range(len(asked))]
    got = rt.nearest(vectors(spark, m, scopes).repartition(5), vectors(spark, asked, mine, key="query_id"), k=5, scope="document_id" if scoped else None)
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in got.collect()) == brute(m, scopes, asked, mine, 5, scoped)


def test_nearest_skips_far_shells_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "VECTOR_BLOCK", 20)
    rng = np.random.default_rng(3)
    m = np.concatenate([rng.standard_normal((100, 4)) * 0.01 + 10 * c for c in np.eye(4)])
    rows = vectors(spark, m, [0] * len(m)).unionByName(spark.createDataFrame(
        [(900, 0, None), (901, 0, []), (902, 0, [float("nan")] * 4), (903, 0, [None, 1.0, 1.0, 1.0]), (904, 0, [1.0, 2.0])], "chunk_id long, document_id int, embedding array<double>"))
    seen = []
    real = neighbours._compared
    monkeypatch.setattr(neighbours, "_compared", lambda tiles, k: (seen.append(tiles), real(tiles, k))[1])
    asked = vectors(spark, m[:10] + 1e-4, [0] * 10, key="query_id")
    got = rt.nearest(rows, asked, k=3).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in got) == brute(m, [0] * len(m), m[:10] + 1e-4, [0] * 10, 3, False)
    met, blocks = sum(t.count() for t in seen), seen[0].select("q_block").distinct().count() * 20
    assert met * 2 < blocks  # three of the four clusters are ruled out


def test_short_quotes_anywhere(spark):
    rng = random.Random(12)
    words = ["a", "an", "ab", "banana", "of", "the", "é", "x", "xx", "abc", "tail"]
    docs = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(150)]
    docs += docs[:40] + ["", None, "|", "one"]
    quotes = ["a", "x", "é", "an", "a a", "of the", "nana o", "b abc", "xx x xx", "a an ab", "l", "tail tail tail", "zz", "a zz", "", " ", None, "of the of the", "ana", "n"]
    quotes += quotes[:5]
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id long, quote string")
    p = spark.createDataFrame(list(enumerate(docs)), "passage_id long, passage string")
    norm = lambda t: " ".join((t or "").replace("|", " ").split()).lower()
    want = sorted((i, j) for i, x in enumerate(quotes) for j, d in enumerate(docs) if norm(x) and d is not None and norm(x) in norm(d))
    assert sorted(map(tuple, assess.find_quotes(q, p).collect())) == want


def test_sections_of_a_very_long_document(spark):
    n = 100_000
    rows = spark.range(n).select(
        F.lit(1).alias("doc_id"), F.col("id").alias("ord"), F.lit(0).alias("page"), F.lit(0.0).alias("y0"), F.col("id").cast("string").alias("title"),
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("key"), F.when(F.col("id") % 3 == 1, (F.col("id") - 1).cast("string")).alias("parent"),
        F.when(F.col("id") % 3 == 2, 3).when(F.col("id") % 30 == 0, 1).otherwise(2).alias("depth"))
    at = time.time()
    found = {r.ord: (r.level, r.path) for r in st._fold_sections(rows).collect()}
    assert time.time() - at < 60 and len(found) == n
    near: dict = {}
    for i in range(n):
        depth = 3 if i % 3 == 2 else 1 if i % 30 == 0 else 2
        above = found[i - 1] if i % 3 == 1 else max(((o, found[o]) for lv, o in near.items() if lv < depth), default=(0, None))[1] if depth > 1 else None
        level, path = found[i]
        assert (level, path) == ((above[0] + 1, [*above[1], str(i)]) if above else (1, [str(i)]))
        near[level] = i


def test_packing_a_very_long_run(spark):
    n = 300_000
    pieces = spark.range(n).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("run"), F.col("id").alias("ord"), F.lit(0).alias("piece"), (F.col("id") * 7 % 40).cast("long").alias("tokens"),
        F.lit(100).alias("budget"), F.when(F.col("id") % 11 == 0, "equation").otherwise("paragraph").alias("type"), F.lit("x. y.").alias("piece_text"))
    at = time.time()
    got = [r.chunk_no for r in ck.pack(pieces).orderBy("ord").select("chunk_no").collect()]
    no, total, want = -1, 0, []
    for i in range(n):
        t = i * 7 % 40
        if no < 0 or total + 1 + t > 100 and i % 11:
            no, total = no + 1, t
        else:
            total += 1 + t
        want.append(no)
    assert got == want
    assert ck.pack_with_overlap(pieces).count() > n
    assert time.time() - at < 120


def test_reading_order_of_a_deep_chain(spark):
    n = 100_000
    chain = spark.range(n).select(F.lit(1).alias("run_id"), F.col("id").alias("span_id"), (F.col("id") - 1).alias("parent_span_id"))
    got = spans.preorder(chain)
    assert got.where("span_id = depth AND span_id = position AND root_span_id = 0").count() == n


def test_reading_order_of_trees_and_circles(spark):
    rng = random.Random(1)
    rows = [(r, i, rng.choice([None, i, *range(i), 99]) if i else None) for r in range(5) for i in range(40)]
    rows += [(7, 1, 2), (7, 2, 3), (7, 3, 1), (7, 4, 3), (7, 5, None), (7, 6, 5)]  # a circle and what hangs below it
    known = {(r, i): p for r, i, p in rows}

    def path(r, i):
        way = [i]
        while (p := known[r, way[0]]) is not None and p != way[0] and (r, p) in known:
            if p in way:
                return None
            way.insert(0, p)
        return way

    want = []
    for r in {r for r, *_ in rows}:
        ways = sorted(w for i in range(41) if (r, i) in known and (w := path(r, i)))
        want += [(r, w[-1], w[0], len(w) - 1, n) for n, w in enumerate(ways)]
    frame = spark.createDataFrame(rows, "run_id long, span_id long, parent_span_id long")
    assert sorted((r.run_id, r.span_id, r.root_span_id, r.depth, r.position) for r in spans.preorder(frame).collect()) == sorted(want)
