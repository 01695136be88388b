import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures_llm import SMALL, TEXTS, linked, odd, squeezed
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import duck, rows_of
from pactframe.llm import mixing, neighbours, queries


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def mixture(rows, max_repeats):
    """Copies of each row by walking the permutations one document after the other."""
    tokens, members = Counter(), defaultdict(list)
    for i, (doc, source, n) in enumerate(rows):
        tokens[source] += n
        members[source].append(i)
    live = {s: n for s, n in tokens.items() if n}
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        over = max((n / max(live.values())) ** (mid - 1) for n in live.values()) > max_repeats
        low, high = (mid, high) if over else (low, mid)
    exponent = math.ceil(high * 1e6 - 1e-3) / 1e6
    whole = sum(n ** exponent for n in live.values())
    budget = whole * max(n / n ** exponent for n in live.values())
    copies = Counter()
    for source, ids in members.items():
        n = tokens[source]
        quota = min(round(n ** exponent / whole * budget), math.floor(n * max_repeats)) if n else 0
        epochs, rest = divmod(quota, n) if n else (1, 0)
        for i in ids:
            copies[i] += epochs
        block = {i: md5("" if rows[i][0] is None else str(rows[i][0]))[:3] for i in ids}
        key = {i: (md5(f"{epochs}|{source or ''}|{block[i]}"), md5(f"doc|{'' if rows[i][0] is None else rows[i][0]}")) for i in ids}
        reached = 0
        for at in sorted(set(key.values())):
            if reached >= rest:
                break
            for i in ids:
                if key[i] == at:
                    copies[i] += 1
                    reached += rows[i][2]
    return copies


@pytest.mark.parametrize("repeats", [1.5, 2.0, 7.0])
def test_mixture_matches_a_walk_through_the_blocks(spark, repeats):
    rows = [(i, f"s{min(i % 97 % 7, 3)}" if i % 11 else None, i % 23) for i in range(3000)]
    docs = spark.createDataFrame([(i, s, " ".join(["w"] * n), "e") for i, s, n in rows], "doc_id long, source string, text string, epoch string")
    got = Counter(r.doc_id for r in mixing.mix(docs, max_repeats=repeats, keep_text=False).collect())
    assert got == +mixture(rows, repeats)
    again = mixing.mix_documents(docs, max_repeats=repeats)
    assert again.columns == docs.columns and Counter(r.doc_id for r in again.collect()) == got


def test_no_document_is_shown_more_often_than_the_limit(spark):
    rng = np.random.default_rng(4)
    for limit in (1.5, 2.0):
        sizes = [int(10 ** x) for x in rng.uniform(0.5, 3, 3)]
        docs = spark.createDataFrame([(i * 10_000 + j, f"s{i}", "w") for i, n in enumerate(sizes) for j in range(n)], "doc_id long, source string, text string")
        copies = Counter(r.doc_id for r in mixing.mix(docs, max_repeats=limit, keep_text=False).collect())
        assert len(copies) == sum(sizes) and max(copies.values()) <= math.ceil(limit)


def test_limits_of_large_sources_hold(spark):
    rng = np.random.default_rng(5)
    for _ in range(4):
        rows = [(f"s{i}", int(10 ** x), 1) for i, x in enumerate(rng.uniform(6, 11, 3))]
        sources = spark.createDataFrame(rows, "source string, tokens long, docs long")
        exponent = mixing.fit_exponent(sources, max_repeats=2.0)
        big = max(n for _, n, _ in rows)
        assert all((n / big) ** (exponent - 1) <= 2.0 + 1e-9 for _, n, _ in rows)


def test_exponent_meets_an_entropy(spark):
    sources = spark.createDataFrame([("a", 9000), ("b", 900), ("c", 100), (None, 0)], "source string, tokens long")
    exponent = mixing.fit_exponent(sources, entropy=1.0)
    p = np.array([9000, 900, 100]) ** exponent
    p /= p.sum()
    assert -(p * np.log(p)).sum() == pytest.approx(1.0, abs=1e-4)
    assert mixing.fit_exponent(sources, entropy=5.0) == 0.0 and mixing.fit_exponent(sources, max_repeats=1.0) == 1.0
    with pytest.raises(ValueError):
        mixing.fit_exponent(sources)


def test_a_budget_cuts_sources(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", "x y z") for i in range(900)], "doc_id long, source string, text string")
    rows = mixing.mix(docs, max_repeats=2.0, budget=900, keep_text=False).collect()
    assert abs(sum(r.n_tokens for r in rows) - 900) <= 6 and len({r.doc_id for r in rows}) == len(rows)


def test_mixing_odd_rows(spark):
    docs = odd(spark)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r.text for r in mixed.collect()).keys() == Counter(t for _, t in TEXTS).keys()
    assert mixing.mix_documents(odd(spark, empty=True)).count() == 0


def brute_nearest(rows, queries_, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in sorted(i for i in ok if i in queries_):
        scores = sorted((-round(float(ok[q] @ ok[c] / np.linalg.norm(ok[q]) / np.linalg.norm(ok[c])), 9), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))
        out[q] = [(c, -s) for s, c in scores[:k]]
    return out


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).round(1).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)] + [(2000 + i, [x * 4 for x in rows[50][1]]) for i in range(40)]
    rows += [(3000, None), (3001, [0.0] * 8), (3002, [1.0, None] + [0.0] * 6), (3003, [float("nan")] * 8), (3004, [float("inf")] * 8), (3005, []),
             (None, [1.0] * 8), (3050, [1.0, 2.0]), (3051, [2.0, 1.0]), (7, rows[7][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    got = defaultdict(list)
    for r in neighbours.nearest(table, table.filter(F.col("vec_id") % 50 == 0), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    want = brute_nearest(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)
    want = {q: v for q, v in want.items() if v}
    assert set(got) == set(want)
    for q in want:
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
        assert [c for c, _ in got[q]] == [c for c, _ in want[q]]


def test_nearest_never_broadcasts_copies_of_query_blocks(spark, monkeypatch):
    """A query table under the broadcast limit is copied to every slot: at 6 GB the copies broke the driver."""
    monkeypatch.setattr(neighbours, "CANDIDATE_ROWS", 64)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    found = neighbours.nearest(table, table.filter(F.col("vec_id") % 50 == 0), 5)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    e = np.array([v for _, v in rows], np.float32).astype(np.float64)
    e /= np.sqrt((e * e).sum(1))[:, None]
    for q in range(0, 1500, 50):
        score = e @ e[q]
        score[q] = -2
        assert got[q] == sorted(range(1500), key=lambda c: (-score[c], c))[:5]


def test_fuller_blocks_keep_every_row(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0, 2.0] if i % 3 else [float(i), 1.0]) for i in range(1, 200)], "vec_id long, embedding array<double>").repartition(40)
    whole = neighbours.fuller(neighbours.blocks(rows, 64), 64).collect()
    ids = [i for r in whole for i in np.frombuffer(r.ids, np.int64)]
    assert sorted(ids) == list(range(1, 200)) and all(len(r.ids) <= 64 * 8 and len(r.vectors) == len(r.ids) * r.dim for r in whole)
    assert len(whole) < 20


def test_nearest_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], none.schema)
    assert neighbours.nearest(none, none).count() == 0 and neighbours.nearest(none, some).count() == 0 and neighbours.nearest(some, none).count() == 0
    assert [tuple(r)[:3] for r in neighbours.nearest(some, some).orderBy("query_id").collect()] == [(1, 1, 2), (2, 1, 1)]


def test_products_are_exact_and_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((50, 2000)), rng.standard_normal((60, 2000))
    a, s, e = neighbours.quantised(x)
    b, t, f = neighbours.quantised(y)
    assert (neighbours.products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    true = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    assert (np.abs(true - neighbours.products(a, b) * s[:, None] * t) <= e[:, None] + (1 + e[:, None]) * f + 1e-12).all()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_and_its_sql(spark, name):
    df = entry.queries()[name](spark, SMALL)
    got, columns = rows_of(df.columns, df.collect())
    assert got
    if name in queries.ORACLES:
        cursor = duck(SMALL).execute(queries.ORACLES[name])
        want, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
        assert columns == theirs and got == want


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    extra = docs.withColumns({"kept": F.lit("x"), "epoch": F.lit("y"), "text_hash": F.lit("z")})
    first = steps["language"](spark, extra, SMALL).cache()
    assert first.columns == extra.columns and first.count() >= 0.98 * docs.count()
    second = steps["exact_copies"](spark, first, SMALL).cache()
    groups = defaultdict(list)
    for r in first.collect():
        groups[squeezed(r.text)].append(r.doc_id)
    assert sorted(r.doc_id for r in second.collect()) == sorted(map(min, groups.values()))
    third = steps["near_copies"](spark, second, SMALL).cache()
    want = linked([(r.doc_id, r.text) for r in second.collect()], 5)
    assert sorted(r.doc_id for r in third.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    fourth = steps["mixture"](spark, third, SMALL).cache()
    assert fourth.columns == extra.columns and {r.doc_id for r in fourth.collect()} == {r.doc_id for r in third.collect()}
    rows = steps["packed"](spark, fourth, SMALL).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in fourth.collect())
    assert entry.queries()["pipeline"](spark, SMALL).columns == corpus_pipeline.run(spark, SMALL).columns


def test_pipeline_of_odd_and_empty_tables(spark):
    for docs in (odd(spark), odd(spark, empty=True)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SMALL)
            assert docs.columns == columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count()


def test_pipeline_keeps_mixed_and_unlabelled_documents(spark):
    steps = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    long_ = {}
    for r in docs.filter("length(text) > 2000 and lang is not null").orderBy("doc_id").collect():
        long_.setdefault(r.lang, r.text[:1500])
    mixed = spark.createDataFrame([(900_001, " ".join(long_.values()), None, "s", 1)], docs.schema)
    kept = steps["language"](spark, docs.unionByName(mixed), SMALL)
    assert len(long_) >= 3 and kept.filter("doc_id = 900001").count() == 1
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    letters = unlabelled.filter(F.col("text").rlike(r"\p{L}"))
    assert sorted(r.doc_id for r in steps["language"](spark, unlabelled, SMALL).collect()) == sorted(r.doc_id for r in letters.collect())


def test_near_copies_with_null_and_shared_ids_leave_one(spark):
    body = " ".join(f"word{i}" for i in range(120))
    other = " ".join(f"term{i}" for i in range(120))
    rows = [(7, body), (7, body + " more"), (None, other), (None, other + " end"), (None, other + " last words"), (3, "alone here"), (3, "apart from it"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, SMALL).collect()]
    assert len(kept) == 5 and sum(i == 7 for i, _ in kept) == 1 and sum(t is not None and t.startswith(other) for _, t in kept) == 1
    assert {(3, "alone here"), (3, "apart from it"), (None, None)} <= set(kept)
