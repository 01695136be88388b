"""Hard negatives by a vertical (BOND) scan of dimension columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Candidate rows of a block and anchors of a block: a task holds one of each.
CANDIDATES, ANCHORS = 8192, 256
#: Dimensions read between two looks at the candidates.
STRIDE = 8
#: Candidate blocks that share a copy of the anchors.
SHARED = 16
KINDS = {"int16": np.int16, "int32": np.int32, "int64": np.int64}
BLOCK = "dim int, kind string, ids binary, labels binary, columns binary, low binary, high binary"


def grid(vector: Column, scale: int = 256) -> Column:
    """Components as integers: ``floor(scale * x)`` in double precision."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale))


def usable(vector: Column, scale: int = 256) -> Column:
    """Not empty, no null or non-finite component, and none so large that an inner product could leave 64 bits."""
    most = F.sqrt(F.lit(float((1 << 63) - 1)) / F.greatest(F.size(vector), F.lit(1))) - 1
    return F.coalesce((F.size(vector) > 0) & F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < most)), F.lit(False))


def grouped(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of a list column by length: length, row numbers, matrix."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, flat[ends[rows][:, None] + np.arange(dim)]


def smallest_kind(matrix: np.ndarray) -> str:
    most = int(np.abs(matrix).max(initial=0))
    return next(k for k, t in KINDS.items() if most <= np.iinfo(t).max)


def columnar(rows: DataFrame, size: int) -> DataFrame:
    """``vec_id, label, v`` as blocks of at most ``size`` rows: one column per dimension, with its least and greatest value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids, labels, matrix = (np.concatenate([p[i] for p in parts]) for i in range(3))
            kind = smallest_kind(matrix)
            raw = [ids.tobytes(), labels.tobytes(), np.ascontiguousarray(matrix.T.astype(KINDS[kind])).tobytes(), matrix.min(0).tobytes(), matrix.max(0).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([kind]), *[pa.array([x], pa.binary()) for x in raw]],
                                              ["dim", "kind", "ids", "labels", "columns", "low", "high"])

        for batch in batches:
            ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for dim, at, matrix in grouped(batch.column(2)):
                for cut in range(0, len(at), size):
                    part = slice(cut, cut + size)
                    if sum(len(p[0]) for p in held.get(dim, [])) + len(at[part]) > size:
                        yield emit(dim)
                    held.setdefault(dim, []).append((ids[at[part]], labels[at[part]], matrix[part]))
        for dim in list(held):
            yield emit(dim)

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "v").mapInArrow(pack, BLOCK)


class Scan:
    """The candidates of one block under one anchor, read dimension by dimension.

    ``sums`` are the products read so far; ``least`` and ``most`` bound what the
    dimensions not yet read can add. ``alive`` is the bitmap of the candidates,
    kept as row numbers once few are left.
    """

    def __init__(self, anchor: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> None:
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * low, anchor * high])
        after = lambda x: np.concatenate([np.cumsum(x[order][::-1])[::-1], [0]])
        self.anchor, self.columns, self.order, self.read = anchor, columns, order, 0
        self.least, self.most = after(ends.min(0)), after(ends.max(0))
        self.alive, self.sums = np.flatnonzero(alive), np.zeros(int(alive.sum()), np.int64)

    def step(self) -> bool:
        """Read the next dimensions of what is alive; false when none is left."""
        if self.read == len(self.order) or not len(self.alive):
            return False
        for d in self.order[self.read:self.read + STRIDE]:
            column = self.columns[d]
            self.sums += (column if len(self.alive) == len(column) else column[self.alive]).astype(np.int64) * self.anchor[d]
        self.read = min(self.read + STRIDE, len(self.order))
        return True

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return self.sums + self.least[self.read], self.sums + self.most[self.read]

    def keep(self, wanted: np.ndarray) -> None:
        if not wanted.all():
            self.alive, self.sums = self.alive[wanted], self.sums[wanted]


def kth_largest(values: np.ndarray, k: int) -> int | None:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, ties by id; a row that repeats counts once."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])])[:len(ids)]
    return ids[new][:k], scores[new][:k]


def alike(scan: Scan, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` candidates of the highest inner products."""
    while scan.step():
        least, most = scan.bounds()
        bar = kth_largest(least, 2 * k)
        if bar is not None and len(np.unique(ids[scan.alive[least >= bar]])) >= k:
            scan.keep(most >= bar)
    return best(ids[scan.alive], scan.sums, k)


def windowed(scan: Scan, ids: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores the ``k`` highest inside it."""
    while scan.step():
        least, most = scan.bounds()
        wanted = np.zeros(len(least), bool)
        for low, high in windows:
            open_ = (most >= low) & (least <= high)
            sure = (least >= low) & (most <= high)
            bar = kth_largest(least[sure], 2 * k)
            if bar is not None and len(np.unique(ids[scan.alive[sure & (least >= bar)]])) >= k:
                open_ &= most >= bar
            wanted |= open_
        scan.keep(wanted)
    out = []
    for low, high in windows:
        inside = (scan.sums >= low) & (scan.sums <= high)
        out.append(best(ids[scan.alive[inside]], scan.sums[inside], k))
    return out


def tiles(anchors: DataFrame, right: DataFrame) -> DataFrame:
    """Every anchor block beside every candidate block of its dimension.

    Candidate blocks are dealt to slots, several to one; the anchors, a stated
    query set, are copied once to a slot, not once to a block.
    """
    spark = right.sparkSession
    blocks = right.count()
    slots = max(1, -(-blocks // SHARED), min(blocks, 2 * spark.sparkContext.defaultParallelism))
    dealt = right.withColumn("slot", F.pmod(F.xxhash64("uid"), F.lit(slots))).drop("uid")
    copied = anchors.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    return copied.join(dealt, ["slot", "dim"])


def anchor_blocks(rows: DataFrame) -> DataFrame:
    """Anchors ``uid, label, v, windows`` as blocks: ``dim, a_ids, a_uids, a_labels, a_vectors, a_counts, a_windows``."""
    n = max(1, -(-rows.count() // ANCHORS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            windows = batch.column(4)
            counts, flat = np.diff(windows.offsets.to_numpy()), windows.values.to_numpy(zero_copy_only=False)
            starts = windows.offsets.to_numpy()
            for dim, at, matrix in grouped(batch.column(3)):
                for cut in range(0, len(at), ANCHORS):
                    part = at[cut:cut + ANCHORS]
                    took = np.concatenate([flat[starts[i]:starts[i + 1]] for i in part]) if len(part) else flat[:0]
                    raw = [*[c[part].astype(np.int64) for c in columns], matrix[cut:cut + ANCHORS].astype(np.int64), counts[part].astype(np.int64), took.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in raw]],
                                                     ["dim", "a_ids", "a_uids", "a_labels", "a_vectors", "a_counts", "a_windows"])

    schema = "dim int, a_ids binary, a_uids binary, a_labels binary, a_vectors binary, a_counts binary, a_windows binary"
    return rows.select("vec_id", "uid", "label", "v", "windows").repartition(n).mapInArrow(pack, schema)


def scanned(anchors: DataFrame, right: DataFrame, k: int, negatives: bool) -> DataFrame:
    """``uid, window, vec_id, score``: every tile's best rows, per anchor or per window of an anchor."""
    names = ["a_ids", "a_uids", "a_labels", "a_vectors", "a_counts", "a_windows", "ids", "labels", "columns", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim, kind = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                raw = {n: np.frombuffer(batch.column(2 + i)[row].as_buffer(), KINDS[kind] if n == "columns" else np.int64) for i, n in enumerate(names)}
                columns = raw["columns"].reshape(dim, len(raw["ids"]))
                ids, labels = raw["ids"], raw["labels"]
                ends = np.cumsum(raw["a_counts"])
                found: list[list[np.ndarray]] = [[], [], [], []]
                for i, anchor in enumerate(raw["a_vectors"].reshape(len(raw["a_ids"]), dim)):
                    same = labels == raw["a_labels"][i]
                    scan = Scan(anchor, columns, raw["low"], raw["high"], ~same if negatives else same & (ids != raw["a_ids"][i]))
                    if negatives:
                        bars = raw["a_windows"][ends[i] - raw["a_counts"][i]:ends[i]].reshape(-1, 3)
                        parts = [(w[0], *p) for w, p in zip(bars, windowed(scan, ids, [(int(w[1]), int(w[2])) for w in bars], k))]
                    else:
                        parts = [(0, *alike(scan, ids, k))]
                    for window, c, s in parts:
                        for column, x in zip(found, (np.full(len(c), raw["a_uids"][i]), np.full(len(c), window), c, s)):
                            column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *f]).astype(np.int64)) for f in found],
                                                 ["uid", "window", "vec_id", "score"])

    parts = tiles(anchor_blocks(anchors), right).select("dim", "kind", *names).mapInArrow(compare, "uid long, window long, vec_id long, score long")
    # An id and a score that come again are one row repeated; every tile has at most k of a window.
    order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "vec_id")
    return parts.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vec_id, embedding, label``.

    Anchors are the rows under the condition ``anchors``; they meet all rows in
    tiles. A first scan finds each anchor's positives, the rows of its label with
    the highest inner products; a second one the rows of other labels whose
    score lies between ``least`` and ``most`` percent of a positive's. Inside a
    tile, dimensions are read in the order of the anchor's descending magnitudes;
    what the others can still add shrinks the bitmap of candidates until exact
    scores are left. Scores are exact integers. Nothing is approximate.

    Defined results: rows with a null id, label or vector, an empty vector, a
    null or non-finite component, or components so large that inner products
    leave 64 bits take no part; vectors of another length are not compared with
    an anchor; a row with the anchor's id is never its positive; rows that share
    id, label and vector count once, rows that share an id only are separate rows; ties go to the
    smaller id; a positive without negatives gives no rows, nor does an anchor
    without positives; an empty table gives none. Other columns are not looked at.
    """
    part = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"), scale))
    given = part.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), grid(F.col("embedding"), scale).alias("v"))
    right = save(columnar(given, CANDIDATES).withColumn("uid", F.monotonically_increasing_id()), "columns")
    asked = save(given.filter(anchors).distinct().withColumn("uid", F.monotonically_increasing_id()), "anchors")

    none = F.array().cast("array<bigint>")
    near = save(scanned(asked.withColumn("windows", none), right, positives, False)
                .select("uid", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Equal scores of an anchor share a window: named by the score, with its ends in whole scores.
    p = F.col("positive_score")
    low = F.expr(f"positive_score div 100 * {least} + (positive_score % 100 * {least} + 99) div 100")
    high = F.expr(f"positive_score div 100 * {most} + positive_score % 100 * {most} div 100")
    bars = near.filter(p >= 0).select("uid", F.array(p, low, high).alias("w")).distinct()
    windows = bars.groupBy("uid").agg(F.flatten(F.array_sort(F.collect_list("w"))).alias("windows"))  # one per positive at most
    found = scanned(asked.join(windows, "uid"), right, negatives, True).withColumnsRenamed(
        {"window": "positive_score", "vec_id": "negative_id", "score": "negative_score"})
    names = asked.select("uid", F.col("vec_id").alias("anchor_id"))
    return near.join(found, ["uid", "positive_score"]).join(names, "uid").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
