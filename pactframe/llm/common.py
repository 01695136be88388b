"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, materialize

#: Runs of ASCII white space, as every text contract here defines them.
WHITE = r"[\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch; one longer text is a batch of its own.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
#: Bits of the fixed-size key filter: its broadcast never passes 4 MB.
FILTER_BITS = 1 << 25


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables; read by Spark alone, so any store works."""
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: texts arrive in Arrow batches of few rows and bytes."""
    for key, value in ARROW.items():
        spark.conf.set(key, value)


def save(df: DataFrame, purpose: str) -> DataFrame:
    """Write a narrow intermediate table to the shared folder and read it back."""
    return materialize(df, f"llm-{purpose}")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of like-named columns: null keys meet null keys."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where the table already has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def worker_cache(key: Any, build: Callable[[], Any]) -> Any:
    """A value built once per Python worker, until the worker turns to another one.

    Functions reach the workers by value, so module globals are new in every
    task; the cache therefore sits in a module object of its own. It holds one
    value: workers outlive an operator, and what it cached must not stay.
    """
    holder = sys.modules.setdefault("_pactframe_llm_cache", types.ModuleType("_pactframe_llm_cache"))
    kept = holder.__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        gc.collect()
        kept[key] = build()
    return kept[key]


def returning(work: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``work`` over the batches of a task, giving what it held back to the system at the end.

    Workers wait for their next task beside the executor, and allocators keep freed
    memory: without this the largest task a worker ever ran stays charged to it.
    """
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            if forget is not None:
                forget()
            give_back()

    return run


def give_back() -> None:
    """Return free memory of Python, Arrow and the C library to the system, where they can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of the hashes in column ``k``, in pages of 4 KB.

    At most ``bits / 8`` bytes whatever the number of keys: a fuller bitmap only
    lets more rows through to the exact test that follows it.
    """
    at = F.pmod("k", F.lit(bits))
    return keys.groupBy(F.bitmap_bucket_number(at).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))


def may_contain(df: DataFrame, pages: DataFrame, key: str, out: str, bits: int = FILTER_BITS) -> DataFrame:
    """Add ``out``: false only for rows whose hash ``key`` is surely not in the filter.

    The pages are broadcast; ``key_filter`` bounds them, and no row of ``df`` moves.
    """
    at = F.pmod(F.col(key), F.lit(bits))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0, F.lit(False))
    return (df.withColumn("__page", F.bitmap_bucket_number(at)).withColumn("__at", place)
            .join(F.broadcast(pages), F.col("__page") == F.col("page"), "left")
            .withColumn(out, hit).drop("__page", "__at", "page", "bitmap"))
