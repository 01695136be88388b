"""Exact nearest neighbours: tiles of a scope, or shells around pivots with triangle bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranks import top_k

#: Rows of a question block and of a vector block: 1,024 x 512 doubles are 4 MB.
QUESTION_BLOCK, VECTOR_BLOCK = 1024, 2048
#: Distances held at once while a tile is worked on.
STRIP_BYTES = 8 << 20
#: Pivots of an unscoped search, whatever the number of vectors: all a task holds of them.
PIVOTS = 64
EPS = float(np.finfo(np.float64).eps)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and widths of a list column."""
    ends = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64), ends[:-1], np.diff(ends)


def _rough(vectors: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one product, and how far rounding may have moved each of them.

    The expanded square loses digits in proportion to the norms, not to the
    distance, so the margin is relative to them.
    """
    v, q = (vectors**2).sum(1), (asked**2).sum(1)
    return v[:, None] + q[None, :] - 2 * vectors @ asked.T, 4 * EPS * (vectors.shape[1] + 4) * (v[:, None] + q[None, :])


def _nearest_of(ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per question the ``k`` nearest vectors of one block: question row, ids, distances.

    Rough squares pick the candidates: those whose lower bound does not exceed
    the k-th upper bound. Only these are measured exactly.
    """
    depth = min(k, len(ids)) - 1
    step = max(1, STRIP_BYTES // (8 * len(ids)))
    for at in range(0, len(asked), step):
        rough, off = _rough(vectors, asked[at:at + step])
        # Ties are by nine decimals, so what rounds to the k-th distance stays too.
        limit = np.square(np.sqrt(np.maximum(np.partition(rough + off, depth, axis=0)[depth], 0)) + 2e-9)
        for j in range(rough.shape[1]):
            near = np.flatnonzero(rough[:, j] - off[:, j] <= limit[j])
            gap = vectors[near] - asked[at + j]
            d = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            order = np.lexsort((ids[near], np.round(d, 9)))[:k]
            yield at + j, ids[near][order], d[order]


def _blocks(rows: DataFrame, size: int, prefix: str = "") -> DataFrame:
    """Neighbouring rows ``cell, far, id, embedding`` of one cell and width as blocks of at most ``size``."""
    cell, key = rows.schema["cell"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None
        parts: list[tuple] = []
        held = 0

        def emit() -> pa.RecordBatch:
            far = np.concatenate([p[0] for p in parts])
            ids = pa.concat_arrays([p[1] for p in parts])
            matrix = np.concatenate([p[2] for p in parts])
            columns = [pa.array([open_[0]], kind), pa.array([open_[1]], pa.int32()), pa.array([far.min()]), pa.array([far.max()]),
                       pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([matrix.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kind = batch.schema.field(0).type
            cells, far = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            flat, starts, widths = _lists(batch.column(3))
            at = 0
            while at < len(cells):
                stop = at
                while stop < len(cells) and cells[stop] == cells[at] and widths[stop] == widths[at]:
                    stop += 1
                if parts and (open_ != (cells[at], widths[at]) or held == size):
                    yield emit()
                    parts, held = [], 0
                open_ = (cells[at], widths[at])
                stop = min(stop, at + size - held)
                matrix = flat[starts[at]:starts[at] + (stop - at) * widths[at]].reshape(-1, widths[at])
                parts.append((far[at:stop], batch.column(2).slice(at, stop - at), matrix))
                held += stop - at
                at = stop
        if parts:
            yield emit()

    names = [prefix + n if n not in ("cell", "width") else n for n in ("cell", "width", "low", "high", "ids", "matrix")]
    return rows.mapInArrow(pack, f"cell {cell}, width int, {prefix}low double, {prefix}high double, {prefix}ids array<{key}>, {prefix}matrix binary")


def _compared(tiles: DataFrame, k: int) -> DataFrame:
    """The ``k`` best pairs of every tile ``width, q_ids, q_matrix, ids, matrix``."""
    kinds = [tiles.schema[c].dataType.elementType.simpleString() for c in ("q_ids", "ids")]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                width = batch.column(0)[row].as_py()
                q_list, v_list = batch.column(1)[row].values, batch.column(3)[row].values
                q_ids, ids = q_list.to_numpy(zero_copy_only=False), v_list.to_numpy(zero_copy_only=False)
                asked, block = (np.frombuffer(batch.column(c)[row].as_buffer(), np.float64).reshape(-1, width) for c in (2, 4))
                found = list(_nearest_of(ids, block, asked, k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.repeat(q_ids[j], len(c)) for j, c, _ in found]), q_list.type),
                     pa.array(np.concatenate([c for _, c, _ in found]), v_list.type), pa.array(np.concatenate([d for *_, d in found]))],
                    ["query_id", "chunk_id", "distance"])

    return tiles.select("width", "q_ids", "q_matrix", "ids", "matrix").mapInArrow(
        compare, f"query_id {kinds[0]}, chunk_id {kinds[1]}, distance double")


def _side(df: DataFrame, key: str, cell: Column) -> DataFrame:
    finite = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(finite & (F.size("embedding") > 0), F.lit(False))
    return df.where(usable).select(cell.alias("cell"), F.lit(0.0).alias("far"), F.col(key).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _within_scopes(vectors: DataFrame, questions: DataFrame, k: int, scope: str) -> DataFrame:
    """Question blocks of a scope meet the vector blocks of that scope.

    Rows go to their scope's partitions; a scope with very many is split by
    the adaptive rebalance, and its blocks are tiles of their own.
    """
    def grouped(df: DataFrame, key: str, size: int, prefix: str = "") -> DataFrame:
        side = _side(df, key, F.col(scope)).where(F.col("cell").isNotNull())
        return _blocks(side.hint("rebalance", "cell").sortWithinPartitions("cell", F.size("embedding")), size, prefix)

    left = grouped(questions, "query_id", QUESTION_BLOCK, "q_")
    return _compared(left.join(grouped(vectors, "chunk_id", VECTOR_BLOCK), ["cell", "width"]), k)


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By width, the vectors with the smallest id hashes: one per block of vectors, at most ``PIVOTS`` in all."""
    found: dict[int, list] = {}
    n = min(PIVOTS, -(-vectors.count() // VECTOR_BLOCK))
    for row in vectors.orderBy(F.xxhash64("id"), "id").limit(n).select("embedding").collect():
        found.setdefault(len(row.embedding), []).append(row.embedding)
    return {width: np.unique(np.array(m, np.float64), axis=0) for width, m in found.items()}


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``cell``: the nearest pivot of every row, -1 where its width has none; ``far``: how far off it is."""
    key = rows.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, starts, widths = _lists(batch.column(3))
            cell, far = np.full(len(starts), -1), np.zeros(len(starts))
            for width in np.unique(widths):
                if int(width) in pivots:
                    at = np.flatnonzero(widths == width)
                    d = _distances(flat[starts[at][:, None] + np.arange(width)], pivots[int(width)])
                    cell[at], far[at] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(far), batch.column(2), batch.column(3)], ["cell", "far", "id", "embedding"])

    return rows.mapInArrow(place, f"cell int, far double, id {key}, embedding array<double>")


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((rows - p) ** 2).sum(1)) for p in pivots], 1)


def _reach(asked: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``q_block, width, own, cell, near, away``: how near and far each block of questions is to every pivot."""

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                block, own, width = (batch.column(c)[i].as_py() for c in range(3))
                matrix = np.frombuffer(batch.column(3)[i].as_buffer(), np.float64).reshape(-1, width)
                rows.append((block, width, own, -1, 0.0, np.inf))
                if width in pivots:
                    d = _distances(matrix, pivots[width])
                    rows += [(block, width, own, p, d[:, p].min(), d[:, p].max()) for p in range(d.shape[1])]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()))],
                                             ["q_block", "width", "own", "cell", "near", "away"])

    return asked.select("q_block", "cell", "width", "q_matrix").mapInArrow(span, "q_block long, width int, own int, cell int, near double, away double")


def _everywhere(vectors: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """All vectors are candidates; most blocks are ruled out by their distance to a pivot.

    Vectors lie in shells around their nearest pivot, ordered by range, so a
    pivot that has most of them is many blocks. Questions first meet the shell
    they lie in themselves; the k-th distance found there is a bound. A block whose
    shell ``[low, high]`` is farther from all of ``[near, away]`` than the bound
    cannot hold a nearer one. Which blocks meet is an equi-join on the pivot.
    """
    none = F.lit(-1)
    rows = _side(vectors, "chunk_id", none)
    pivots = _pivots(rows)
    stored = materialize(
        _blocks(_placed(rows, pivots).repartitionByRange("cell", "far").sortWithinPartitions("cell", F.size("embedding"), "far"), VECTOR_BLOCK)
        .withColumn("block", F.monotonically_increasing_id()), "vector-shells")
    asked = materialize(
        _blocks(_placed(_side(questions, "query_id", none), pivots).repartitionByRange("cell", "far").sortWithinPartitions("cell", F.size("embedding"), "far"), QUESTION_BLOCK, "q_")
        .withColumn("q_block", F.monotonically_increasing_id()), "question-shells")
    meets = _reach(asked, pivots).join(stored.select("cell", "width", "low", "high", "block"), ["cell", "width"])
    # Without rounding the shell of the questions' own pivot always counts; a hair more makes up for it.
    gap = F.greatest(F.col("low") - F.col("away"), F.col("near") - F.col("high"), F.lit(0.0))
    pairs = materialize(meets.select("q_block", "block", (gap * (1 - 1e-12) - 1e-9).alias("gap"), (F.col("cell") == F.col("own")).alias("home")), "meetings")

    def tiles(chosen: DataFrame) -> DataFrame:
        return _compared(chosen.select("q_block", "block").join(stored.drop("cell", "width"), "block").join(asked.drop("cell"), "q_block"), k)

    first = materialize(tiles(pairs.where("home and gap <= 0")), "first-tiles")
    best = top_k(first, ["query_id"], [F.asc("distance")], k)
    bounds = best.groupBy("query_id").agg(F.max("distance").alias("bound"), F.count(F.lit(1)).alias("n"))
    of_block = (
        asked.select("q_block", F.explode("q_ids").alias("query_id")).join(bounds, "query_id", "left").groupBy("q_block")
        .agg(F.max(F.when(F.col("n") >= k, F.col("bound")).otherwise(F.lit(float("inf")))).alias("bound")))
    rest = pairs.where("not (home and gap <= 0)").join(of_block, "q_block").where(F.col("gap") <= F.col("bound") * (1 + 1e-12))
    return first.unionByName(tiles(rest))


def nearest(vectors: DataFrame, questions: DataFrame, *, k: int, scope: str | None = None) -> DataFrame:
    """Exact ``k`` nearest by Euclidean distance: (query_id, chunk_id, distance, rank).

    Blocks of questions meet blocks of vectors, one of either side in a task at
    a time; neither table comes to the driver. Each tile keeps ``k`` rows per
    question. ``scope`` names a column both sides share and is applied before the
    k: only blocks of one scope meet. Rows whose vector is null, empty or holds a
    null or non-finite component take no part, vectors of another width are not compared, no questions give no rows.
    """
    found = _within_scopes(vectors, questions, k, scope) if scope else _everywhere(vectors, questions, k)
    return top_k(found, ["query_id"], [F.round("distance", 9), F.asc("chunk_id")], k)
