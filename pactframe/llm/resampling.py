"""Importance resampling towards a target: array-scored weights, then distributed quickselect."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, small_batches

BUCKETS = 10_000
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
#: Pivots of a round of the search: one random key of each hash slot of the open interval.
PIVOTS = 32
#: Words of more bytes are hashed one by one; the others all together.
LONG_WORD = 64

#: What a byte is inside a word: letters in lower case, digits and everything beyond ASCII; 0 parts words.
INSIDE = np.zeros(256, np.uint8)
for _byte in [*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]:
    INSIDE[_byte] = _byte
for _byte in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    INSIDE[_byte] = _byte + 32


def crc_steps() -> np.ndarray:
    """The table of the reflected CRC-32 polynomial, from its rule."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    return step


def buckets_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word of concatenated UTF-8 texts, and where each text's words begin.

    Words of up to ``LONG_WORD`` bytes take their checksums together, one byte
    place after the other, longest words first.
    """
    first, last = int(offsets[0]), int(offsets[-1])
    low = INSIDE[data[first:last]]
    inside = low != 0
    cut = offsets[1:-1] - first
    edge = np.zeros(len(low) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(low):
        edge[0], edge[-1] = inside[0], inside[-1]
    joined = cut[(cut > 0) & (cut < len(low))]
    joined = np.unique(joined[inside[joined] & inside[joined - 1]])  # a word that ends where the next text's begins
    places = np.flatnonzero(edge)
    marks = np.sort(np.concatenate([places, joined, joined])) if len(joined) else places
    starts, ends = marks[::2], marks[1::2]
    sizes = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    steps = crc_steps()
    order = np.argsort(-sizes, kind="stable")
    order = order[np.searchsorted(-sizes[order], -LONG_WORD):]
    at, size, value = starts[order], sizes[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k))  # the words longer than k
        part = value[:n]
        value[:n] = steps[(part ^ low[at[:n] + k]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    crc[order] = value ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > LONG_WORD):
        crc[i] = zlib.crc32(low[starts[i]:ends[i]].tobytes())
    return (crc % np.uint32(BUCKETS)).astype(np.int64), np.searchsorted(starts, offsets - first)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column without nulls."""
    text = column.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``bucket, n``: how many words of column ``text`` each bucket holds; every task sums up its own first."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(buckets_of(*raw(batch.column(0)))[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    parts = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """What one word of each bucket adds to a weight, in thousandths: an array of ``BUCKETS`` integers.

    The logarithm of the bucket's smoothed share among the target's words over
    its share among those of ``docs``. Counts cover both tables whole; what
    comes to the driver is one row per bucket, however large they are.
    """
    both = bucket_counts(docs).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        bucket_counts(target).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    s, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        s[row.bucket], t[row.bucket] = row.s, row.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_features, weight`` of every row: the gains of its words looked up in the array and added."""
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([given.schema["doc_id"], T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, first = buckets_of(*raw(batch.column(1)))
            reached = np.concatenate([[0], np.cumsum(gain[found])])[first]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(np.diff(reached))], schema.names)

    return given.mapInArrow(score, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, drawn from the hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


#: The composite key, best row first: score down, ids up (null last), then what tells repeated rows apart.
KEY = "struct(-score as s, doc_id is null as d, coalesce(doc_id, 0) as i, n_features as f, row as r)"


def kth_key(rows: DataFrame, k: int, seed: int = 0) -> tuple:
    """The ``k``-th smallest of the distinct keys in column ``key``, by distributed quickselect.

    Each round draws up to ``PIVOTS`` random keys of the open interval and counts
    exactly how many of its keys are less than, equal to and greater than each.
    The interval that holds place ``k`` is the next one, until ``k`` is a pivot's
    own place. Counts and the next round's pivots are one aggregate with map-side
    combine; the driver sees at most ``(2 * PIVOTS + 1) * PIVOTS`` rows of it, no
    matter how many keys are open. At least one key leaves in every round and all
    but one of ``PIVOTS`` parts do on average.
    """
    names = rows.schema["key"].dataType.fieldNames()

    def literal(key: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, rows.schema["key"].dataType.fields)])

    low = high = None
    pivots: list[tuple] = []
    for turn in range(10_000):
        open_ = rows
        if low is not None:
            open_ = open_.filter(F.col("key") > literal(low))
        if high is not None:
            open_ = open_.filter(F.col("key") < literal(high))
        part = F.lit(0)
        if pivots:
            among = F.array(*[literal(p) for p in pivots])
            part = 2 * F.size(F.filter(among, lambda p: p < F.col("key"))) + F.array_contains(among, F.col("key")).cast("int")
        draw = F.xxhash64("key", F.lit(seed), F.lit(turn))
        counted = (open_.select("key", part.alias("part"), draw.alias("draw")).groupBy("part", F.pmod("draw", F.lit(PIVOTS)).alias("slot"))
                   .agg(F.count(F.lit(1)).alias("n"), F.min_by("key", "draw").alias("pick")).collect())
        sizes: dict[int, int] = {}
        for row in counted:
            sizes[row.part] = sizes.get(row.part, 0) + row.n
        for at in sorted(sizes):
            if k <= sizes[at]:
                break
            k -= sizes[at]
        else:
            raise ValueError("k is beyond the number of keys")
        if at % 2:
            return pivots[at // 2]
        low = pivots[at // 2 - 1] if at else low
        high = pivots[at // 2] if at // 2 < len(pivots) else high
        pivots = sorted(tuple(row.pick[name] for name in names) for row in counted if row.part == at)
    raise RuntimeError("the search did not end")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their place in the order of column ``key`` as ``rank``.

    Sorted by range over all tasks; each range's count, one row per range,
    becomes the places before it.
    """
    placed = save(rows.repartitionByRange("key").withColumn("range", F.spark_partition_id()), "winners")
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(
        Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = placed.withColumn("at", F.row_number().over(Window.partitionBy("range").orderBy("key")))
    return within.join(before, "range").withColumn("rank", F.col("before") + F.col("at")).drop("range", "at", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024) -> DataFrame:
    """Draw ``percent`` of the documents, likelier the closer to ``target``: ``doc_id, n_features, weight, score, rank``.

    A document's weight adds up the gains of its words' buckets; with Gumbel
    noise on top, the highest scores are a draw without replacement in
    proportion to the exponential of the weights. Only the winners are sorted.
    All other rows keep a null ``rank``.

    Defined results: a null, empty or wordless text has no features and weight
    0, and is never drawn; a null id draws the noise of the empty string and
    comes last among equal scores; rows that share id and score are told apart
    by their features and then in any order, each of them counting as one
    document; an empty target leaves all weights to the smoothing; an empty
    table stays empty. Columns beyond ``doc_id`` and ``text`` are not looked at.
    """
    weighed = weights(docs, gains(docs, target))
    scored = save(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()), "scored")
    eligible = scored.filter(F.col("n_features") >= LEAST_WORDS)
    k = percent * eligible.count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    nobody = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*out, nobody)
    keyed = scored.withColumn("key", F.expr(KEY))
    last = kth_key(keyed.filter(F.col("n_features") >= LEAST_WORDS).select("key"), k, seed)
    bound = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(last, keyed.schema["key"].dataType.fields)])
    drawn = (F.col("n_features") >= LEAST_WORDS) & (F.col("key") <= bound)
    winners = ranked(keyed.filter(drawn)).select(*out, F.col("rank").cast("long").alias("rank"))
    return winners.unionByName(keyed.filter(~drawn).select(*out, nobody))
