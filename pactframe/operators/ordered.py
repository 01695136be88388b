"""Order-dependent columns that survive one key holding most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key in one task. Here the rows
of a key are cut into segments by a monotone function of their order (an
ordinal divided by a constant, a minute of a timestamp). Inside a segment an
ordinary window runs; each segment then contributes one summary row, a window
over the summaries carries the state across segments, and the carry is joined
back on (key, segment). No task sees more than one segment of rows plus one
summary per segment.

Where the rows of a key are known to come out of one source row (the lines and
elements of a document, which the source holds in a single cell), ``segment``
is ``None``: one ordinary window does the work and nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

SEG = "_seg"


def _whole(keys: Sequence[str], order: Sequence[str], descending: bool = False):
    cols = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    return Window.partitionBy(*keys).orderBy(*cols)


def _prepare(df: DataFrame, segment: Column) -> DataFrame:
    return df.withColumn(SEG, segment)


def _windows(keys: Sequence[str], order: Sequence[str], descending: bool):
    cols = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    inside = Window.partitionBy(*keys, SEG).orderBy(*cols)
    seg_order = F.col(SEG).desc() if descending else F.col(SEG).asc()
    across = Window.partitionBy(*keys).orderBy(seg_order)
    return inside, across


def _attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(carry, [*keys, SEG], "left")


def neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column | None,
    values: dict[str, Column],
    *,
    following: bool = False,
) -> DataFrame:
    """Values of the previous (or following) row of the same key."""
    if segment is None:
        w = _whole(keys, order, following)
        return df.withColumns({n: F.lag(v).over(w) for n, v in values.items()})
    base = _prepare(df, segment)
    inside, across = _windows(keys, order, following)
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    edge = F.min_by if following else F.max_by
    rows = base.withColumn("_near", F.lag(packed).over(inside))
    carry = (
        base.groupBy(*keys, SEG)
        .agg(edge(packed, F.struct(*order)).alias("_edge"))
        .withColumn("_far", F.lag("_edge").over(across))
        .drop("_edge")
    )
    joined = _attach(rows, carry, keys).withColumn("_hit", F.coalesce("_near", "_far"))
    for name in values:
        joined = joined.withColumn(name, F.col("_hit")[name])
    return joined.drop("_hit", "_near", "_far", SEG)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column | None,
    value: Column,
    out: str,
) -> DataFrame:
    """Inclusive running sum of ``value`` in order."""
    if segment is None:
        w = _whole(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.sum(value).over(w))
    base = _prepare(df, segment).withColumn("_add", value)
    inside, across = _windows(keys, order, False)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("_part", F.sum("_add").over(upto))
    carry = (
        base.groupBy(*keys, SEG)
        .agg(F.sum("_add").alias("_total"))
        .withColumn("_before", F.sum("_total").over(before))
        .drop("_total")
    )
    return (
        _attach(rows, carry, keys)
        .withColumn(out, F.col("_part") + F.coalesce("_before", F.lit(0)))
        .drop("_part", "_before", "_add", SEG)
    )


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column | None, out: str
) -> DataFrame:
    """1-based position of a row inside its key."""
    return running_sum(df, keys, order, segment, F.lit(1).cast("long"), out)


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column | None,
    value: Column,
    out: str,
) -> DataFrame:
    """The last non-null ``value`` at or before each row."""
    if segment is None:
        w = _whole(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    base = _prepare(df, segment).withColumn("_val", value)
    inside, across = _windows(keys, order, False)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("_near", F.last("_val", ignorenulls=True).over(upto))
    last = F.max_by("_val", F.when(F.col("_val").isNotNull(), F.struct(*order)))
    carry = (
        base.groupBy(*keys, SEG)
        .agg(last.alias("_last"))
        .withColumn("_far", F.last("_last", ignorenulls=True).over(before))
        .drop("_last")
    )
    return (
        _attach(rows, carry, keys)
        .withColumn(out, F.coalesce("_near", "_far"))
        .drop("_near", "_far", "_val", SEG)
    )


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column | None,
    starts: Column,
    previous: dict[str, Column],
    out: str,
) -> DataFrame:
    """Number maximal stretches. ``starts`` may use the ``previous`` columns."""
    near = neighbour(df, keys, order, segment, previous)
    flag = F.when(starts, 1).otherwise(0).cast("long")
    return running_sum(near, keys, order, segment, flag, out).drop(*previous)


def stepwise(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str | Column], start: Callable[..., Any],
             step: Callable[..., tuple], out: dict[str, str], given: DataFrame | None = None) -> DataFrame:
    """Columns that depend on all rows of a key before this one, by one pass in order.

    For what no window can say, because a row's value decides the next one's.
    ``step`` takes the key's state, made by ``start``, and a row's ``inputs``; it
    changes the state and returns the values of ``out``. Rows stream through in
    Arrow batches and only the inputs become Python values: time is linear in the
    rows, and memory holds a batch and the state of one key.

    ``given`` are facts about the first of the ``keys``, in columns of their own.
    They pass the same shuffle in front of its rows, so nothing is joined to
    these; ``start`` gets them as a list of tuples. The rows of that first key
    then pass one task.
    """
    names = [f"_in{i}" for i in range(len(inputs))]
    kept = [*df.columns]
    facts = [c for c in given.columns if c != keys[0]] if given is not None else []
    rows, lead = df, []
    if given is not None:
        rows, lead = df.withColumn("_row", F.lit(1)).unionByName(given.withColumn("_row", F.lit(0)), allowMissingColumns=True), ["_row"]
    rows = rows.repartition(*(keys[:1] if lead else keys)).sortWithinPartitions(keys[0], *lead, *keys[1:], *order)
    # The inputs are worked out behind the shuffle, which carries the rows alone.
    rows = rows.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in zip(names, inputs)})
    added = StructType.fromDDL(", ".join(f"{n} {kind}" for n, kind in out.items()))
    schema = StructType([*[df.schema[c] for c in kept], *added.fields])
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        about, known = None, []
        for batch in batches:
            at = {n: batch.column(n).to_pylist() for n in [*keys, *names, *facts]}
            own = batch.column("_row").to_pylist() if lead else [1] * batch.num_rows
            told = zip(*[at[c] for c in facts]) if facts else [()] * batch.num_rows
            found: list[tuple] = []
            for key, values, fact, row in zip(zip(*[at[k] for k in keys]), zip(*[at[n] for n in names]), told, own):
                if lead and about != key[:1]:
                    about, known, state = key[:1], [], None
                if not row:
                    known.append(fact)
                    continue
                if state is None or key != current:
                    current, state = key, start(known) if lead else start()
                found.append(step(state, *values))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            rest = batch.filter(pa.array(own, pa.int32()).cast(pa.bool_())) if lead else batch
            yield pa.RecordBatch.from_arrays([*[rest.column(c) for c in kept], *columns], schema.names)

    return rows.mapInArrow(walk, schema)
