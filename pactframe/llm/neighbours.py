"""Exact nearest neighbours by a block matrix join of int8 product tiles."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: Rows of a block: a tile is one query block times one candidate block.
QUERY_ROWS, CANDIDATE_ROWS = 1024, 8192
#: Query rows whose distances are in memory at once, and pairs recomputed at once.
STRIP, PAIRS = 128, 1 << 15
#: Candidate blocks of one slot at most, and their bytes: what a task keeps while query blocks stream by.
SLOT_BLOCKS, SLOT_BYTES = 8, 32 << 20
#: Dimensions whose int8 products add up exactly in 32-bit floats.
EXACT_DIMS = 1024
BLOCKS = "dim int, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    """A vector that takes part: no null or non-finite component, and not zero."""
    value = vector.cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.aggregate(value, F.lit(0.0), lambda s, x: s + x * x)
    return F.coalesce(finite & (norm > 0) & (norm < F.lit(float("inf"))), F.lit(False))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """The rows of every partition as blocks of at most ``size`` vectors of one dimension.

    Components keep the width they are stored in: 32 bits hold a float exactly.
    """
    wide = width(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids, vectors = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())],
                ["dim", "ids", "vectors"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(wide)
            dims = np.diff(ends)
            for dim in np.unique(dims):
                rows_ = np.flatnonzero(dims == dim)
                for at in range(0, len(rows_), size):
                    part = rows_[at:at + size]
                    held.setdefault(int(dim), []).append((ids[part], flat[ends[part][:, None] + np.arange(dim)]))
                    if sum(len(p[0]) for p in held[int(dim)]) >= size:
                        yield emit(int(dim))
        for dim in list(held):
            yield emit(dim)

    stored = "array<float>" if wide == np.float32 else "array<double>"
    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast(stored)).mapInArrow(pack, BLOCKS)


def width(rows: DataFrame) -> type:
    """The numpy type of the components of a table's vectors."""
    return np.float32 if rows.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64


def fuller(packed: DataFrame, size: int) -> DataFrame:
    """Blocks of few rows put together, up to ``size`` rows: a scan task that finds few rows makes a small block."""
    rows = packed.agg(F.sum(F.length("ids")) / 8).first()[0] or 0

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), *(pa.array([b"".join(p[i] for p in parts)], pa.binary()) for i in (0, 1))], ["dim", "ids", "vectors"])

        for batch in batches:
            for dim, ids, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                if sum(len(p[0]) for p in held.get(dim, [])) + len(ids) > 8 * size and dim in held:
                    yield emit(dim)
                held.setdefault(dim, []).append((ids, vectors))
        for dim in list(held):
            yield emit(dim)

    return packed.repartition(max(1, -(-int(rows) // size))).mapInArrow(merge, BLOCKS)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 codes, the scale of each, and how far the codes are off."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of two int8 blocks."""
    total = 0.0
    for at in range(0, a.shape[1], EXACT_DIMS):
        part = a[:, at:at + EXACT_DIMS].astype(np.float32) @ b[:, at:at + EXACT_DIMS].astype(np.float32).T
        total = part if a.shape[1] <= EXACT_DIMS else total + part.astype(np.float64)
    return total


def first_copies(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors only the ``most`` smallest ids; further ones cannot be among the nearest."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    _, group = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel(), return_inverse=True)
    by_group = np.lexsort((ids, group))
    g, i = group[by_group], ids[by_group]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (i[1:] != i[:-1])])  # a repeated row counts once
    g, by_group = g[new], by_group[new]
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), np.arange(len(g)), 0))
    kept = np.sort(by_group[rank < most])
    return ids[kept], vectors[kept]


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest candidates of each query in one tile: query ids, candidate ids, cosines.

    Codes differ from unit vectors ``x, y`` by ``e, f`` at most, so the product of
    codes is off by ``e + (1 + e) * f`` at most. Candidates whose upper bound
    reaches the k-th best lower bound are recomputed from the original vectors.
    """
    c_ids, c = first_copies(c_ids, c, k + 1)
    qc, qs, qe = quantised(q)
    cc, cs, ce = quantised(c)
    q_norm, c_norm = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q_ids), STRIP):
        rows = slice(at, at + STRIP)
        near = products(qc[rows], cc) * (qs[rows, None] * cs).astype(np.float32)
        off = (qe[rows, None] + (1 + qe[rows, None]) * ce + 1e-5).astype(np.float32)
        own = q_ids[rows, None] == c_ids
        low = np.where(own, -np.inf, near - off)
        kth = np.partition(low, len(c_ids) - k, axis=1)[:, len(c_ids) - k] if len(c_ids) > k else np.full(len(low), -np.inf)
        i, j = np.nonzero((near + off >= kth[:, None]) & ~own)
        i += at
        score = np.empty(len(i))
        for p in range(0, len(i), PAIRS):
            a, b = i[p:p + PAIRS], j[p:p + PAIRS]
            score[p:p + PAIRS] = (q[a] * c[b]).sum(1) / (q_norm[a] * c_norm[b])
        np.clip(score, -1, 1, out=score)
        order = np.lexsort((c_ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.maximum.accumulate(np.where(np.concatenate([[True], i[1:] != i[:-1]])[:len(i)], np.arange(len(i)), 0))
        kept = rank < k
        found.append((q_ids[i[kept]], c_ids[j[kept]], score[kept]))
    return tuple(np.concatenate([f[n] for f in found]) for n in range(3))


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each query's ``k`` nearest candidates by cosine: ``query_id, rank, vec_id, score``.

    Both tables have ``vec_id`` and ``embedding``. Candidates are packed into
    blocks; query blocks are sent once to each slot of a few candidate blocks, so
    a task holds one slot and one query block whatever the tables' sizes. The
    copies of query blocks are shuffled and never broadcast: their number grows
    with both tables, while Spark's size estimate knows the queries alone. Every
    tile keeps ``k`` per query, and heaps merge the tiles.

    Defined results: vectors that are null, zero, or hold a null or non-finite
    component take no part, nor do rows without an id; vectors of different
    length are not compared; rows with the query's id are the query itself; a
    repeated row counts once; equal scores go to the smaller id; fewer candidates
    than ``k`` give fewer rows; empty tables give no rows.
    """
    take = lambda df: df.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    right = save(blocks(take(candidates), CANDIDATE_ROWS).withColumn("uid", F.monotonically_increasing_id()), "candidates")
    count, most = right.agg(F.count(F.lit(1)), F.max(F.length("vectors"))).first()
    cores = right.sparkSession.sparkContext.defaultParallelism
    together = max(1, min(SLOT_BLOCKS, SLOT_BYTES // (most or 1), count // (2 * cores)))
    slots = max(1, -(-count // together))
    right = right.withColumn("slot", F.pmod(F.xxhash64("uid"), F.lit(slots))).withColumnsRenamed({"ids": "c_ids", "vectors": "c"}).drop("uid")
    left = fuller(save(blocks(take(queries), QUERY_ROWS), "queries"), QUERY_ROWS)
    left = left.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    tiles = left.join(right.hint("merge"), ["slot", "dim"]).select("dim", "ids", "vectors", "c_ids", "c")
    wide = {2: width(queries), 4: width(candidates)}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column(0)[row].as_py()
                raw = [np.frombuffer(batch.column(n)[row].as_buffer(), wide.get(n, np.int64)) for n in range(1, 5)]
                a, b, s = tile(raw[0], raw[1].reshape(-1, dim).astype(np.float64), raw[2], raw[3].reshape(-1, dim).astype(np.float64), k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["query_id", "vec_id", "score"])

    parts = tiles.mapInArrow(compare, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, heap = None, []
        rows: list[list] = [[], [], [], []]

        def close() -> None:
            for rank, (score, minus) in enumerate(sorted(heap, reverse=True), 1):
                for column, value in zip(rows, (current, rank, -minus, score)):
                    column.append(value)

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))],
                                             ["query_id", "rank", "vec_id", "score"])
            for column in rows:
                column.clear()
            return out

        for batch in batches:
            for q, c, s in zip(*(batch.column(n).to_pylist() for n in range(3))):
                if q != current:
                    close()
                    current, heap = q, []
                item = (s, -c)
                if item in heap:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            yield emit()
        close()
        yield emit()

    return parts.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
