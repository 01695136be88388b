import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures_llm import LONG, LOWER, SMALL, TEXTS, odd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import duck, rows_of
from pactframe.llm import hardneg, quality, queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op11_resample", "op12_hard_negatives"])
def test_queries_match_their_sql(spark, name):
    df = entry.queries()[name](spark, SMALL)
    con = duck(SMALL).execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in con.description], con.fetchall())


def buckets(text):
    return [zlib.crc32(w.encode()) % 10000 for w in WORD.findall((text or "").translate(LOWER))]


def resampled(docs, target, percent):
    """(id, features, weight, score) of every row and how many are drawn."""
    held, asked = [(i, buckets(t)) for i, t in docs], [buckets(t) for t in target]
    s, t = Counter(b for _, x in held for b in x), Counter(b for x in asked for b in x)
    n, m = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000))))
    rows = []
    for i, x in held:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, x))
        rows.append((i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = able[:percent * len(able) // 100]
    return Counter((*r, k) for k, r in enumerate(drawn, 1)) + Counter((*r, None) for r in (Counter(rows) - Counter(drawn)).elements())


def test_resampling_of_odd_texts(spark):
    docs = [(r.doc_id, r.text) for r in odd(spark).select("doc_id", "text").collect()]
    docs += [(100 + i, " ".join(f"w{(i * k) % 61}Ä{k % 3}" for k in range(i % 50))) for i in range(300)]
    docs += [(7000, "the same row of over twenty words " * 4)] * 40 + [(7001, "wörter ohne leer-zeichen" * 30), (7002, "x" * 100_000 + " " + "é" * 90)]
    target = [(1, "w3 w4 word7 the2 the same"), (2, None), (3, "Wörter über x")]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, key string, rank int")
    aims = spark.createDataFrame(target, "item_id long, text string")
    for percent in (10, 37, 100):
        got = Counter(map(tuple, resampling.resample(frame, aims, percent=percent).collect()))
        assert got == resampled(docs, [t for _, t in target], percent)
    assert not resampling.resample(odd(spark, empty=True), aims).collect()
    none = resampling.resample(frame, aims.limit(0), percent=10).collect()
    assert Counter(map(tuple, none)) == resampled(docs, [], 10)


def test_buckets_of_joined_buffers():
    texts = ["ab", "cd e", "", "É", "", "zz-9", " ", "A" * 64, "b" * 65, "c" * 400, "-"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    found, first = resampling.buckets_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert [list(found[a:b]) for a, b in zip(first, first[1:])] == [buckets(t) for t in texts]
    some, at = resampling.buckets_of(np.frombuffer(b"".join(raw), np.uint8), offsets[1:4])
    assert [list(some[a:b]) for a, b in zip(at, at[1:])] == [buckets(t) for t in texts[1:3]]


@pytest.mark.parametrize("k", [1, 2, 700, 1999, 2000])
def test_the_search_finds_every_place(spark, k):
    rng = np.random.default_rng(3)
    values = [(int(v), int(i % 3), i) for i, v in enumerate(rng.integers(0, 40, 2000))]
    rows = spark.createDataFrame(values, "a long, b long, c long").select(F.struct("a", "b", "c").alias("key"))
    assert resampling.kth_key(rows, k, seed=k) == sorted(values)[k - 1]


def negatives(rows, anchor, positives=5, most=10):
    """Every pair of distinct rows; (id, label, vector)."""
    live = {r for r in rows if r[0] is not None and r[1] is not None and r[2] and all(x is not None and math.isfinite(x) and abs(x) < 1e7 for x in r[2])}
    grid = [(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in live]
    grid = set(grid)
    out = Counter()
    for i, label, v in grid:
        if not anchor(i):
            continue
        scored = {(sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in grid if len(w) == len(v)}
        near = sorted({(-s, j) for s, j, other in scored if other == label and j != i})[:positives]
        for minus, j in near:
            p = -minus
            inside = sorted({(-s, n) for s, n, other in scored if other != label and 30 * p <= 100 * s <= 90 * p})[:most]
            for rank, (s, n) in enumerate(inside, 1):
                out[(i, j, rank, n, p, -s)] += 1
    return out


def test_negatives_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 4)), tuple(float(x) for x in rng.standard_normal(7) * [3, 1, 1, .1, .1, .01, 0])) for i in range(600)]
    rows += [(i, 1, (1.0,) * 7) for i in range(1000, 1100)] + [(i, 2, (0.8,) * 7) for i in range(1100, 1200)]  # a common vector
    rows += [(i, i % 2, (float(i), 1.0)) for i in range(2000, 2030)]  # another length
    rows += [(10, 1, rows[20][2]), (10, 1, rows[20][2]), (30, None, rows[0][2]), (40, 1, None), (None, 1, rows[0][2]), (50, 2, (float("nan"),) * 7),
             (60, 2, (float("inf"),) * 7), (70, 3, ()), (80, 1, (None, 1.0)), (90, 1, (0.0,) * 7), (90, 2, (1e300,) * 7), (20, 1, (5.0,) * 7)]
    rows += rows[:5] * 3
    frame = spark.createDataFrame([(i, v, label, "clash") for i, label, v in rows], "vec_id long, embedding array<double>, label int, uid string").repartition(5)
    got = Counter(map(tuple, hardneg.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()))
    assert got == negatives([(i, label, v) for i, label, v in rows], lambda i: i % 10 == 0)
    assert not hardneg.hard_negatives(frame.limit(0), F.col("vec_id") % 10 == 0).collect()


def test_small_blocks_give_the_same_negatives(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CANDIDATES", 37)
    monkeypatch.setattr(hardneg, "ANCHORS", 3)
    monkeypatch.setattr(hardneg, "STRIDE", 2)
    rng = np.random.default_rng(8)
    rows = [(int(i), int(rng.integers(0, 3)), tuple(float(x) for x in rng.integers(-4, 5, 6))) for i in range(400)]
    frame = spark.createDataFrame([(i, v, label) for i, label, v in rows], "vec_id long, embedding array<double>, label int")
    got = Counter(map(tuple, hardneg.hard_negatives(frame, F.col("vec_id") % 20 == 0).collect()))
    assert got == negatives(rows, lambda i: i % 20 == 0)


def test_the_scan_drops_candidates_early():
    rng = np.random.default_rng(1)
    matrix = rng.integers(-100, 100, (5000, 32)) * (200 // (1 + np.arange(32)))
    scan = hardneg.Scan(matrix[0], np.ascontiguousarray(matrix.T), matrix.min(0), matrix.max(0), np.arange(5000) > 0)
    ids, scores = hardneg.alike(scan, np.arange(5000), 5)
    full = matrix[1:] @ matrix[0]
    assert list(scores) == sorted(full, reverse=True)[:5] and len(scan.alive) < 500


def base(text):
    """The contract's counts by their words."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    runs = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if runs[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    return *n, n[0] < 50 or 100 * n[4] > 50 * n[0], len(lines)


def least_determinant(points):
    """The method with whole rows in plain numpy: cell's vectors to centre and inverse root."""
    x, factor, floors = points.astype(float), quality.consistency(), np.diag(np.square(quality.FLOORS))

    def shape(rows, f):
        mean = rows.mean(0)
        return solved(mean, (rows.T @ rows / len(rows) - np.outer(mean, mean)) * f + floors)

    def solved(mean, cov):
        root = np.linalg.cholesky(cov)
        return mean, np.linalg.inv(root), 2 * np.log(np.diag(root)).sum()

    def step(s):
        far = (((x - s[0]) @ s[1].T) ** 2).sum(1)
        bins = np.floor(np.log1p(far) * 1024)
        last = np.sort(bins)[math.ceil(len(x) * quality.SHARE) - 1]
        return shape(x[bins <= last], factor)

    a, m, b = (np.sort(x, axis=0)[[math.ceil(len(x) * q / 4) - 1 for q in (1, 2, 3)]])
    spread = np.floor(np.maximum((b - a) / 1.349, quality.FLOORS) + 0.5)
    first = [shape(x, 1.0), shape(np.clip(x, m - 2 * spread, m + 2 * spread), 1.0), solved(m, np.diag(spread ** 2) + floors)]
    for _ in range(quality.FIRST_STEPS):
        first = [step(s) for s in first]
    best = min(first, key=lambda s: s[2])
    for _ in range(quality.LAST_STEPS):
        best, was = step(best), best[2]
        if best[2] >= was - 1e-9:
            break
    return best


def vector(c):
    n, chars, symbols, dup, again, _, lines = c
    half = lambda v: math.floor(v * quality.GRID + 0.5)
    return (half(math.log1p(math.log1p(n))), half(math.log(max(chars, 1) / max(n, 1))), half(math.log1p(1000 * symbols / max(chars, 1))),
            half(dup / max(lines, 1)), half(again / max(n, 1)))


def judged(rows):
    """{row number: (counts, base, kept)} of (lang, source, text)."""
    counts = [base(t) for _, _, t in rows]
    live = [i for i, c in enumerate(counts) if not c[5]]
    cells, least = defaultdict(list), quality.LEAST_DOCS
    for i in live:
        cells[("own", rows[i][0], rows[i][1])].append(i)
    for level in ("lang", "all"):
        for key in [k for k in cells if k[0] != level and len(cells[k]) < least]:
            cells[("lang", key[1]) if level == "lang" else ("all",)] += cells.pop(key)
    kept, cut = {}, quality.chi_square_point(quality.TAIL, quality.DIMS)
    for members in cells.values():
        points = np.array([vector(counts[i]) for i in members])
        far = np.zeros(len(members))
        if len(members) >= least:
            mean, root, _ = least_determinant(points)
            far = (((points - mean) @ root.T) ** 2).sum(1)
        kept |= {i: bool(d <= cut) for i, d in zip(members, far)}
    return [(*c[:6], kept.get(i, False)) for i, c in enumerate(counts)]


def test_chi_square_points_and_consistency():
    assert quality.chi_square_point(0.05, 1) == pytest.approx(3.841459, abs=1e-5)
    assert quality.chi_square_point(0.01, 5) == pytest.approx(15.086272, abs=1e-5)
    assert quality.chi_square_point(0.05, 2) == pytest.approx(5.991465, abs=1e-5)
    far = np.random.default_rng(0).standard_normal((200_000, 5))
    near = far[np.argsort((far ** 2).sum(1))[:150_000]]
    assert np.var(near) * quality.consistency() == pytest.approx(1, abs=0.01)


def test_quality_matches_brute_force_and_keeps_good_texts(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    rows = docs.select("doc_id", "lang", "source", "text").collect()
    want = {r.doc_id: v for r, v in zip(rows, judged([(r.lang, r.source, r.text) for r in rows]))}
    got = {r.doc_id: tuple(r)[1:8] for r in queries.op13_quality(spark, SMALL.replace("0.001", "0.01")).collect()}
    assert got == want
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/labels.parquet").collect()}
    good = [v for i, v in got.items() if marks.get(i) == 1 and not v[5]]
    poor = [v for i, v in got.items() if marks.get(i) == 0 and not v[5]]
    assert good and all(v[6] for v in good) and poor and not any(v[6] for v in poor)


def test_quality_of_odd_texts(spark):
    found = quality.judge(odd(spark)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in found)
    assert got == Counter((i, *base(t)[:6], not base(t)[5]) for i, t in TEXTS)  # too few for an estimate
    assert not quality.judge(odd(spark, empty=True)).collect()
    assert quality.counts_of((LONG + "\n#\n#\n \n \na b c a b c").encode()) == (*base(LONG + "\n#\n#\n \n \na b c a b c")[:5], 4)


def test_cells_of_hot_rare_and_null_sources(spark):
    text = lambda i: " ".join(f"word{(i * k) % 997}" for k in range(60 + i % 200))
    junk = lambda i: " ".join("#$%" if k % 2 else f"w{(i * k) % 997}" for k in range(80 + i % 50))
    copy = text(5) + " one\none\ntwo"
    rows = [("en", "hot", copy)] * 400 + [("en", "hot", text(i)) for i in range(150)] + [("en", None, text(i)) for i in range(70)]
    rows += [(None, f"s{i}", text(i)) for i in range(60)] + [("de", f"s{i}", text(i)) for i in range(20)] + [("fr", None, text(i)) for i in range(40)]
    rows += [("en", "hot", junk(i)) for i in range(30)] + [(None, "s3", junk(4)), ("de", "s1", junk(5)), ("en", None, junk(6)), ("en", "hot", None), ("en", "hot", "a" * 2000)]
    frame = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n long").repartition(6)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judge(frame).collect()}
    assert got == dict(enumerate(judged(rows)))
    assert all(got[i][6] == (not got[i][5]) for i in range(740)) and not any(got[i][6] for i in range(740, 775))
