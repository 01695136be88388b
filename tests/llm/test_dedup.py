import random

import numpy as np
import pytest
from fixtures_llm import SMALL, TEXTS, linked, odd, shingles, squeezed
from pyspark.sql import functions as F

from pactframe.llm import exact, graph, minhash
from pactframe.llm.common import key_filter, may_contain


def test_exact_groups_of_odd_rows(spark):
    rows = exact.exact_groups(odd(spark), prefix_chars=8).collect()
    assert len(rows) == len(TEXTS)
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(squeezed(t), []).append(i)
    want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g)) for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    docs = odd(spark)
    kept = exact.exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = [squeezed(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({squeezed(t) for _, t in TEXTS})


def test_key_filter_never_loses_a_key(spark):
    keys = spark.range(0, 100_000, 7).select(F.xxhash64("id").alias("k"))
    all_ = spark.range(100_000).select("id", F.xxhash64("id").alias("k"))
    hit = may_contain(all_, key_filter(keys, 1 << 20), "k", "hit", 1 << 20)
    counts = {(r[0], r[1]): r[2] for r in hit.groupBy((F.col("id") % 7 == 0).alias("in"), "hit").count().collect()}
    assert (True, False) not in counts and counts[(False, False)] > 80_000


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(spark, width):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = linked([(r.doc_id, r.text) for r in docs.collect()], width)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width).collect()}
    assert got == want


def test_chain_of_near_copies_is_one_component(spark):
    # Neighbours share 0.8 and more, the ends far less: links have to be followed.
    rng = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for n in range(40):
        words[(n * 37) % 200] = f"x{rng.random()}"
        rows.append((100 + n, " ".join(words)))
    rows += [(i, " ".join(f"y{i}-{k}" for k in range(60))) for i in range(20)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {i: c for i, (_, c) in linked(rows, 2).items()}


def test_near_duplicates_of_odd_rows(spark):
    rows = minhash.near_duplicates(odd(spark), 2).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.kept == (r.doc_id == r.component_id)
    by_id = {r.doc_id: r for r in rows if r.doc_id not in (None, 12)}
    assert by_id[6].component_id == 5 and by_id[10].component_id == 9 and by_id[8].component_id == 7
    assert [by_id[i].n_shingles for i in (1, 2, 3, 5)] == [0, 0, 0, 1]
    assert all(by_id[i].kept for i in (1, 2, 3, 4))


def test_empty_tables(spark):
    none = odd(spark, empty=True)
    assert exact.exact_groups(none).count() == 0
    assert exact.exact_dedup(none).count() == 0
    assert minhash.near_duplicates(none, 5).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(50)} == {100}


def test_signature_estimates_similarity():
    shifts = minhash.circle(1)
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    other = np.concatenate([base[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    same = (minhash.signature(np.unique(base), shifts, 1) == minhash.signature(np.unique(other), shifts, 1)).mean()
    assert abs(same - 800 / 1200) < 0.12
    assert len(shingles("a b c", 2)) == 2
