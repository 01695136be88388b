"""Best-two-fit packing of token pieces into sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import returning, save, small_batches
from .tokens import tokenizer_path, word_ids

CAPACITY = 4096
#: Pieces packed together; each group closes its own last sequences.
GROUP_PIECES = 40_000
#: Bytes of ids sent back in one Arrow batch.
BATCH_BYTES = 8 << 20


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Cut every whole text into pieces of at most ``capacity`` token ids.

    One row per piece: ``doc_id, piece, start, length, ids`` with ``ids`` as
    little-endian unsigned 32-bit integers. A document is its ids and then
    ``end_id``; only longer ones are cut, so every piece but the last is full.
    A null or empty text is the single id ``end_id``. Repeated rows give
    repeated pieces.
    """
    small_batches(docs.sparkSession)
    file = path or tokenizer_path()
    tail = end_id.to_bytes(4, "little")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(file)
        for batch in batches:
            names, rows, held = batch.column(0), ([], [], [], [], []), 0
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + tail
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(rows, (i, n, at // 4, len(part) // 4, part)):
                        column.append(value)
                held += len(ids)
                if held > BATCH_BYTES:
                    yield emit(names, rows)
                    rows, held = ([], [], [], [], []), 0
            if rows[0]:
                yield emit(names, rows)

    def emit(names: pa.Array, rows: tuple[list, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()),
             pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(returning(cut, lambda: word_ids(file).forget()), schema)


def fill(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Best-two-fit: the sequence and the offset of every piece.

    A sequence is filled greedily with the longest piece that still fits. If
    room is left, its shortest piece makes way for the two unpacked pieces that
    together come closest to the widened gap, provided they fill it better.
    ``lengths`` lie between 1 and ``capacity``.
    """
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and not 1 <= lengths.min() <= lengths.max() <= capacity:
        raise ValueError(f"lengths must lie in 1..{capacity}")
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)
    top = np.cumsum(count).tolist()  # pieces of one length are taken from the end of their stretch
    sizes = np.arange(capacity + 1)
    there = sum(1 << s for s in np.flatnonzero(count).tolist())
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left, number = len(lengths), 0

    def take(size: int) -> int:
        nonlocal there
        count[size] -= 1
        if not count[size]:
            there ^= 1 << size
        top[size] -= 1
        return int(order[top[size]])

    while left:
        inside: list[tuple[int, int]] = []
        gap = capacity
        while gap:
            size = (there & ((2 << gap) - 1)).bit_length() - 1
            if size < 1:
                break
            inside.append((size, take(size)))
            gap -= size
        if gap and len(inside) > 1 and there:
            small, piece = inside[-1]
            room = gap + small
            below = np.maximum.accumulate(np.where(count > 0, sizes, 0))[:room + 1]
            first = np.flatnonzero(count[:room + 1])
            second = below[room - first]
            second = np.where((second == first) & (count[first] < 2), below[np.maximum(first - 1, 0)], second)
            both = np.where(second > 0, first + second, 0)
            best = int(both.argmax()) if len(both) else 0
            if len(both) and both[best] > small:
                inside.pop()
                pair = [(int(s), take(int(s))) for s in (first[best], second[best])]
                order[top[small]] = piece
                top[small] += 1
                count[small] += 1
                there |= 1 << small
                inside += pair
        at = 0
        for size, piece in inside:
            sequence[piece], offset[piece] = number, at
            at += size
        left -= len(inside)
        number += 1
    return sequence, offset


def best_two_fit(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (any columns, ``length`` among them) with ``sequence_id`` and ``offset``.

    Pieces are dealt by hash into groups of about ``group_pieces``, whatever
    their document or source, and every group is packed on its own: a group is
    bounded however large the table, and only its few last sequences can stay
    partly empty. An empty table gives an empty result.
    """
    numbered = save(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // group_pieces))

    def pack(table: pa.Table) -> pa.Table:
        group = table.column("__group")[0].as_py()
        sequence, offset = fill(table.column("length").to_numpy(), capacity)
        return pa.table({"__row": table.column("__row"), "sequence_id": pa.array(sequence * groups + group, pa.int64()),
                         "offset": pa.array(offset, pa.int64())})

    placed = (numbered.select("__row", F.col("length").cast("long").alias("length"),
                              F.pmod(F.xxhash64("__row"), F.lit(groups)).alias("__group"))
              .groupBy("__group").applyInArrow(pack, "__row long, sequence_id long, offset long"))
    return numbered.join(placed, "__row").drop("__row")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, extra: dict[str, Column] | None = None) -> DataFrame:
    """Tokenise and pack: ``doc_id, piece, start, length, sequence_id, offset`` and what ``extra`` makes of ``ids``."""
    pieces = token_pieces(docs, capacity)
    for name, value in (extra or {}).items():
        pieces = pieces.withColumn(name, value)
    return best_two_fit(pieces.drop("ids"), capacity)
