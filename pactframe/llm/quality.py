"""Quality rules with robust multivariate outliers: minimum covariance determinant per language and source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, small_batches

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated(words: list[bytes]) -> int:
    """Words that lie in a run of three words found twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pair = ids[:-1] * len(known) + ids[1:]
    if len(known) ** 3 >= 1 << 62:  # numbers for pairs keep the triples in 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    runs = pair[:-1] * len(known) + ids[2:]
    order = np.argsort(runs, kind="stable")
    equal = runs[order[1:]] == runs[order[:-1]]
    again = np.zeros(len(runs), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:len(runs) + k] |= again
    return int(covered.sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    """The statistics of one text, in the order of ``COUNTS``."""
    words = text.split()  # bytes part at the six ASCII white-space characters
    raw = np.frombuffer(text, np.uint8) if text else np.zeros(0, np.uint8)
    follows = int(((raw & 0xC0) == 0x80).sum())  # only word characters have such bytes
    seen: set[bytes] = set()
    lines = again = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)) - follows, int(SYMBOLS[raw].sum()), again, repeated(words), lines


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of ``COUNTS`` for every whole text."""
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([*given.schema.fields[:3], *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts_of(text.as_py()) for text in batch.column(3)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(x) for x in found.T]], schema.names)

    return given.mapInArrow(measure, schema)


#: Parts of a unit that a transformed statistic is rounded to: sums of vectors and of their products are
#: then exact integers, the same in any order of adding.
GRID = 256
#: Transformed statistics, each with the spread that a cell has at least.
VECTOR = {
    "loglog_words": ("ln(1 + ln(1 + n_words))", 0.15),
    "log_word_chars": ("ln(greatest(word_chars, 1) / greatest(n_words, 1))", 0.06),
    "log_symbol_rate": ("ln(1 + 1000 * n_symbols / greatest(word_chars, 1))", 0.5),
    "dup_line_share": ("n_dup_lines / greatest(n_lines, 1)", 0.12),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", 0.12),
}
DIMS = len(VECTOR)
FLOORS = [floor * GRID for _, floor in VECTOR.values()]
#: Share of a cell's documents whose covariance is made least.
SHARE = 0.75
#: Documents of a language and source that an estimate of their own needs.
LEAST_DOCS = 50
#: A document goes when a normal vector of its cell lies as far out with this probability.
TAIL = 1e-6
#: Concentration steps: of every start, and at most of each cell's best one.
FIRST_STEPS, LAST_STEPS = 2, 12
PAIRS_OF = [(i, j) for i in range(DIMS) for j in range(i + 1)]
MOMENTS = ["n", *[f"s{i}" for i in range(DIMS)], *[f"q{i}{j}" for i, j in PAIRS_OF]]


def chi_square_tail(x: float, dims: int) -> float:
    """The probability that a sum of ``dims`` squared standard normals exceeds ``x``."""
    from math import erfc, exp, gamma, sqrt

    total, at = (erfc(sqrt(x / 2)), 1) if dims % 2 else (exp(-x / 2), 2)
    while at < dims:
        total += (x / 2) ** (at / 2) * exp(-x / 2) / gamma(at / 2 + 1)
        at += 2
    return total


def chi_square_point(tail: float, dims: int) -> float:
    low, high = 0.0, 2000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_tail(mid, dims) > tail else (low, mid)
    return high


def consistency(share: float = SHARE, dims: int = DIMS) -> float:
    """What the covariance of the innermost ``share`` of a normal cloud is multiplied with to be that of all."""
    return share / (1 - chi_square_tail(chi_square_point(1 - share, dims), dims + 2))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def cell_of(level: str, *names: str) -> Column:
    """A key that tells null from every value."""
    return F.to_json(F.struct(F.lit(level).alias("level"), *[F.col(n).alias(f"k{i}") for i, n in enumerate(names)]))


def with_cells(rows: DataFrame, weight: str, least: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, cell``: which estimate every language and source falls under.

    Those with at least ``least`` documents have their own; the others of a
    language share one, and where those are too few, all such documents do. A last
    pool that is too small has no estimate: null.
    """
    sizes = rows.groupBy("lang", "source").agg(F.sum(weight).alias("docs"))
    own = sizes.withColumn("own", F.col("docs") >= least)
    langs = own.filter("not own").groupBy("lang").agg(F.sum("docs").alias("of_lang")).withColumnRenamed("lang", "of")
    rest = langs.filter(F.col("of_lang") < least).agg(F.coalesce(F.sum("of_lang"), F.lit(0)).alias("of_rest"))  # one row
    joined = own.join(langs, F.col("lang").eqNullSafe(F.col("of")) & ~F.col("own"), "left").crossJoin(F.broadcast(rest))
    cell = (F.when(F.col("own"), cell_of("source", "lang", "source")).when(F.col("of_lang") >= least, cell_of("lang", "lang"))
            .when(F.col("of_rest") >= least, cell_of("all")))
    return joined.select("lang", "source", cell.alias("cell"))


def moments(x: list[Column], n: Column) -> list[Column]:
    sums = [F.sum(n).alias("n"), *[F.sum(n * x[i]).alias(f"s{i}") for i in range(DIMS)]]
    return [*sums, *[F.sum(n * x[i] * x[j]).alias(f"q{i}{j}") for i, j in PAIRS_OF]]


def shapes(sums: DataFrame, factor: float) -> DataFrame:
    """Centre, inverse root of the regularised covariance and its log determinant, per cell and start."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rows = batch.num_rows, np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]], float).reshape(len(MOMENTS), -1)
            mean = (rows[1:1 + DIMS] / rows[0]).T
            cov = np.empty((n, DIMS, DIMS))
            for k, (i, j) in enumerate(PAIRS_OF):
                cov[:, i, j] = cov[:, j, i] = rows[1 + DIMS + k] / rows[0] - mean[:, i] * mean[:, j]
            cov = cov * factor + np.diag(np.square(FLOORS))
            root = np.linalg.cholesky(cov)
            back = np.linalg.inv(root)
            det = 2 * np.log(np.diagonal(root, axis1=1, axis2=2)).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(mean.tolist(), pa.list_(pa.float64())), pa.array([[b[i, j] for i, j in PAIRS_OF] for b in back], pa.list_(pa.float64())), pa.array(det)],
                ["cell", "start", "mean", "root", "det"])

    return sums.select("cell", "start", *[F.col(m).cast("double") for m in MOMENTS]).mapInArrow(
        solve, "cell string, start int, mean array<double>, root array<double>, det double")


def distance(x: list[Column]) -> Column:
    """The squared Mahalanobis distance under the row's ``mean`` and ``root``."""
    off = [x[i] - F.col("mean")[i] for i in range(DIMS)]
    total = F.lit(0.0)
    for i in range(DIMS):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + F.col("root")[PAIRS_OF.index((i, j))] * off[j]
        total = total + part * part
    return total


def starts(points: DataFrame) -> DataFrame:
    """Three first shapes of every cell: the plain moments, the median with quartile spreads, and moments of rows cut at two spreads."""
    x = [F.col(f"x{i}") for i in range(DIMS)]
    each = points.select("cell", "n", F.posexplode(F.array(*x)).alias("dim", "v")).groupBy("cell", "dim", "v").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("cell", "dim")
    at = each.withColumn("reached", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("of", F.sum("n").over(w))
    quartile = lambda k: F.min(F.when(4 * F.col("reached") >= k * F.col("of"), F.col("v")))
    per = at.groupBy("cell", "dim").agg(quartile(1).alias("a"), quartile(2).alias("m"), quartile(3).alias("b"))
    floor = F.element_at(F.array(*[F.lit(f) for f in FLOORS]), F.col("dim") + 1)
    spread = F.round(F.greatest((F.col("b") - F.col("a")) / 1.349, floor)).cast("long")
    middle = save(per.groupBy("cell").agg(*[F.max(F.when(F.col("dim") == i, c)).alias(f"{name}{i}") for i in range(DIMS) for name, c in (("m", F.col("m")), ("d", spread))]), "middles")
    clipped = [F.least(F.greatest(x[i], F.col(f"m{i}") - 2 * F.col(f"d{i}")), F.col(f"m{i}") + 2 * F.col(f"d{i}")) for i in range(DIMS)]
    plain = points.groupBy("cell").agg(*moments(x, F.col("n"))).withColumn("start", F.lit(0))
    cut = points.join(middle, "cell").groupBy("cell").agg(*moments(clipped, F.col("n"))).withColumn("start", F.lit(1))
    square = lambda i, j: F.col(f"m{i}") * F.col(f"m{j}") + (F.col(f"d{i}") * F.col(f"d{i}") if i == j else F.lit(0).cast("long"))
    median = middle.select("cell", F.lit(1).cast("long").alias("n"), *[F.col(f"m{i}").alias(f"s{i}") for i in range(DIMS)],
                           *[square(i, j).alias(f"q{i}{j}") for i, j in PAIRS_OF], F.lit(2).alias("start"))
    return plain.unionByName(cut).unionByName(median)


def concentrated(points: DataFrame, shape: DataFrame, share: float) -> DataFrame:
    """One concentration step: moments of the ``share`` of each cell nearest to its centre.

    Distances fall into bins of a thousandth of their size, moments are added up
    per bin (map-side combine, so a hot cell sends few rows), and the bins that
    hold the nearest ``share`` are added. The last bin is taken whole.
    """
    x = [F.col(f"x{i}") for i in range(DIMS)]
    bins = (points.join(shape, "cell").withColumn("bin", F.floor(F.log1p(distance(x)) * 1024).cast("int"))
            .groupBy("cell", "start", "bin").agg(*moments(x, F.col("n"))))
    w = Window.partitionBy("cell", "start")
    before = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = bins.withColumn("before", before).withColumn("of", F.sum("n").over(w)).filter(F.col("before") < F.ceil(F.col("of") * share))
    return inner.groupBy("cell", "start").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def determinants(points: DataFrame, share: float = SHARE) -> DataFrame:
    """``cell, mean, root, det``: the least regularised determinant found for each cell.

    All starts take ``FIRST_STEPS`` concentration steps, the best of each cell
    goes on until no cell's determinant falls. Every step is one aggregate over
    all cells at once, written out; the driver only learns whether to go on.
    """
    factor = consistency(share)
    shape = save(shapes(starts(points), 1.0), "shapes")
    for _ in range(FIRST_STEPS):
        shape = save(shapes(concentrated(points, shape, share), factor), "shapes")
    best = shape.groupBy("cell").agg(F.min_by(F.struct("start", "mean", "root", "det"), F.struct("det", "start")).alias("b"))
    shape = save(best.select("cell", "b.*"), "shapes")
    for _ in range(LAST_STEPS):
        new = shapes(concentrated(points, shape, share), factor)
        joined = new.join(shape.select("cell", F.col("det").alias("was")), "cell")
        shape = save(joined.withColumn("fell", F.col("det") < F.col("was") - 1e-9), "shapes")
        falling = shape.filter("fell").limit(1).count()
        shape = shape.drop("fell", "was")
        if not falling:
            break
    return shape.drop("start")


def judge(docs: DataFrame, share: float = SHARE, least: int = LEAST_DOCS, tail: float = TAIL) -> DataFrame:
    """Which documents pass: the counts of ``COUNTS`` with ``base_failed``, ``distance`` and ``kept``.

    A document fails the base with fewer than 50 words or over half its words in
    repeated runs. Of the others, the transformed statistics of each language
    and source get a minimum covariance determinant estimate, with a least spread
    per statistic, and a document whose squared Mahalanobis distance exceeds the
    chi-square point of ``tail`` is not kept. Equal vectors of a cell are counted
    once with their number, so groups of copies and hot sources stay small.

    Defined results: a null text is empty; null languages and sources are a
    language and a source of their own; small cells share estimates as in
    ``with_cells`` and, where even all of them are too few, the base alone
    decides (``distance`` is null, as it is for documents that failed); repeated
    rows and ids are judged row by row; an empty table stays empty. Columns beyond
    ``doc_id``, ``text``, ``lang`` and ``source`` are not looked at.
    """
    stats = save(statistics(docs).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "statistics")
    x = [F.round(F.expr(value) * GRID).cast("long").alias(f"x{i}") for i, (value, _) in enumerate(VECTOR.values())]
    names = [f"x{i}" for i in range(DIMS)]
    vectors = save(stats.filter("not base_failed").groupBy("lang", "source", *x).agg(F.count(F.lit(1)).alias("n")), "vectors")
    cells = save(with_cells(vectors, "n", least), "cells")
    under = cells.select(F.col("lang").alias("l"), F.col("source").alias("s"), "cell")
    meets = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    points = save(vectors.join(under.filter("cell is not null"), meets).groupBy("cell", *names).agg(F.sum("n").alias("n")), "points")
    shape = determinants(points, share)
    known = under.join(shape, "cell", "left").select("l", "s", "mean", "root")
    columns = [F.round(F.expr(value) * GRID) for value, _ in VECTOR.values()]
    far = F.when(~F.col("base_failed") & F.col("mean").isNotNull(), distance(columns))
    return stats.join(known, meets, "left").select(
        "doc_id", "lang", "source", *COUNTS, "base_failed", far.alias("distance"),
        (~F.col("base_failed") & F.coalesce(far <= chi_square_point(tail, DIMS), F.lit(True))).alias("kept"))
