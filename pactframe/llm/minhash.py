"""Near duplicates by circulant MinHash, banding and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, key_filter, may_contain, returning, save, same, small_batches, worker_cache
from .graph import components

#: 40 bands of 6 coordinates: at a similarity of exactly 0.8 a pair shares no
#: band with probability (1 - 0.8 ** 6) ** 40 = 5e-6, and less above it.
BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
#: Positions of the circulant permutation.
CIRCLE = 1 << 20
#: Hub orders tried before the classes still apart are paired by rare shingles.
HUB_ORDERS = 6
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Compact signature: two bits of each coordinate in two rows of four longs.
SKETCH = 8
#: Coordinates that must agree in the sketch: the mean at 0.8 less five deviations.
LEAST_AGREEING = 176


def word_hashes(text: Column) -> Column:
    """One 64-bit hash per word: A-Z lower-cased, split at ASCII white space."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.transform(F.array_remove(F.split(lower, WHITE), ""), lambda w: F.xxhash64(w))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive entries."""
    out = mixed(words[:len(words) - width + 1] + np.uint64(width))
    for k in range(1, width):
        out = mixed(out * np.uint64(3) + words[k:len(words) - width + 1 + k])
    return out


def shingle_sets(hashes: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each document of a batch."""
    flat = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)
    ends = hashes.offsets.to_numpy()
    every = chained(flat, width) if len(flat) >= width else flat[:0]
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= width:
            yield np.unique(every[a:b - width + 1])
        elif b > a:
            yield chained(flat[a:b], int(b - a))
        else:
            yield flat[:0]


def circle(seed: int) -> np.ndarray:
    """The second permutation with every circular shift: row ``p`` holds its values from ``p`` on."""
    values = np.random.default_rng(seed).permutation(CIRCLE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:COORDINATES]]), COORDINATES)


def signature(shingles: np.ndarray, shifts: np.ndarray, seed: int) -> np.ndarray:
    """All coordinates of one set: the first permutation places a shingle on the
    circle, coordinate ``k`` is the least value ``k`` steps on."""
    place = (mixed(shingles ^ np.uint64(seed)) >> np.uint64(44)).astype(np.int64)
    out = np.full(COORDINATES, CIRCLE, np.int32)
    for at in range(0, len(place), 2048):
        np.minimum(out, shifts[place[at:at + 2048]].min(0), out=out)
    return out


def describe(docs: DataFrame, width: int, seed: int = 11) -> DataFrame:
    """Per document ``doc_id, h, n, k1, k2, bands, sketch``; texts are read once and go no further.

    ``h`` is a hash of the text, ``n`` the size of the shingle set, ``k1, k2`` 128 bits
    of the set itself, ``bands`` one hash per band, ``sketch`` two bits of each coordinate.
    """
    small_batches(docs.sparkSession)
    given = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), word_hashes(F.col("text")).alias("w"))
    schema = T.StructType([given.schema["doc_id"], T.StructField("h", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
                           T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = worker_cache(("circle", seed), lambda: circle(seed))
        band = np.arange(BANDS, dtype=np.uint64)
        for batch in batches:
            rows = batch.num_rows
            n, keys = np.zeros(rows, np.int64), np.zeros((rows, 2), np.int64)
            bands, sketch = np.zeros((rows, BANDS), np.int64), np.zeros((rows, SKETCH), np.int64)
            for i, s in enumerate(shingle_sets(batch.column(2), width)):
                n[i] = len(s)
                keys[i] = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                if not len(s):
                    continue
                least = signature(s, shifts, seed).astype(np.uint64)
                runs = least.reshape(BANDS, ROWS)
                h = mixed(band + np.uint64(1))
                for k in range(ROWS):
                    h = mixed(h * np.uint64(3) + runs[:, k])
                bands[i] = h.view(np.int64)
                bits = np.zeros((2, 256), np.uint8)
                bits[:, :COORDINATES] = (mixed(least) >> np.array([[60], [61]], np.uint64)) & np.uint64(1)
                sketch[i] = np.packbits(bits, axis=1).reshape(-1).view(np.int64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), lists(bands), lists(sketch)],
                schema.names)

    return given.mapInArrow(returning(apply), schema)


def read_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, n, shingles`` of the ``wanted(node, doc_id, h)``; only their texts are worked on."""
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).withColumn("k", F.xxhash64("doc_id", "h"))
    pages = key_filter(wanted.select(F.xxhash64("doc_id", "h").alias("k")))
    near = may_contain(keyed, pages, "k", "hit").filter("hit").select("doc_id", "h", word_hashes(F.col("text")).alias("w"))
    schema = T.StructType([near.schema["doc_id"], near.schema["h"], T.StructField("shingles", T.ArrayType(T.LongType()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(2), width)]
            ends = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], schema.names)

    sets = near.mapInArrow(returning(apply), schema)
    return (sets.join(wanted, same(sets, wanted, "doc_id", "h")).select("node", "shingles").dropDuplicates(["node"]))


def agreeing(left: list[Column], right: list[Column]) -> Column:
    """Coordinates on which two sketches agree."""
    half = SKETCH // 2
    return F.lit(COORDINATES) - reduce(lambda a, b: a + b, [
        F.bit_count(left[i].bitwiseXOR(right[i]).bitwiseOR(left[i + half].bitwiseXOR(right[i + half]))) for i in range(half)])


def plausible(left: DataFrame, right: DataFrame) -> Column:
    """Whether two sets can still be similar enough, by their sizes and sketches."""
    parts = lambda d: [d[f"s{i}"] for i in range(SKETCH)]
    return ((F.lit(100) * F.least(left["n"], right["n"]) >= F.lit(80) * F.greatest(left["n"], right["n"]))
            & (agreeing(parts(left), parts(right)) >= LEAST_AGREEING))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose whole sets have a similarity of 0.8 or more."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(first, "a").join(second, "b").withColumn("both", both).filter(
        F.lit(100) * F.col("both") >= F.lit(80) * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.8 or more.

    Returns ``doc_id, h, n_shingles, component_id, kept, keeper``, one row per row of
    ``docs``; ``component_id`` is the smallest ``doc_id`` reachable over links, and the
    document that has it is ``kept``. ``keeper`` names one text per component even
    where ids are null or shared by different texts: that of the smallest id,
    null last, and then of the smallest text hash ``h``.

    Documents with equal sets are one class; only classes are compared. Inside
    a bucket classes are compared with hubs, chosen in ``HUB_ORDERS`` ways and only
    where the two are not connected yet; a group of near copies thus costs a
    few links per class. Classes with a possible partner outside their component
    are then paired by their rarest shingles (``leftover``), which loses no link.
    Every link is confirmed on the whole sets, so a component never joins what
    no chain of links joins.

    Defined results: a text without words has ``n_shingles`` 0 and stays alone;
    fewer words than ``width`` are one shingle; a null id cannot be the smallest
    unless all of its component are null; rows that repeat id and text are
    reported alike; an empty table gives an empty result.
    """
    rows = save(describe(docs, width), "minhash-rows")
    full = rows.filter("n > 0")
    classes = full.groupBy("k1", "k2", "n").agg(
        F.min("doc_id").alias("least"), F.min(F.struct(F.isnull("doc_id").alias("no"), "doc_id", "h")).alias("head"), F.min(F.struct("h", "doc_id")).alias("member"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = save(classes.select(
        F.monotonically_increasing_id().alias("node"), "k1", "k2", "n", "least", "head", "member.h", "member.doc_id", "bands",
        *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]), "minhash-classes")

    banded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    live = save(banded.join(shared, "bucket"), "minhash-live")
    facts = classes.select("node", "n", *[f"s{i}" for i in range(SKETCH)])
    pairs = hub_pairs(live)
    pairs = pairs.groupBy("a", "b").agg(F.min("round").alias("round"))
    pairs = save(sketched(pairs, facts), "minhash-hubs")

    picks = classes.select("node", "doc_id", "h")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = save(read_sets(docs, picks.join(ends, "node", "left_semi"), width), "minhash-sets")

    links, labels = None, None
    for turn in (F.col("round") == 0, F.col("round") > 0):
        found = save(verify(unconnected(pairs.filter(turn), labels), sets), "minhash-links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)

    rest, more = leftover(docs, live, labels, facts, picks, width)
    rest = save(rest.join(pairs, ["a", "b"], "left_anti"), "minhash-rest")
    if rest.limit(1).count():
        links = links.unionByName(save(verify(rest, more), "minhash-links"))
        labels = components(links)

    labelled = classes.select("node", "k1", "k2", "n", "least", "head").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.min("head").alias("head"))
    named = save(labelled.drop("head").join(smallest, "label").select("k1", "k2", "n", "component_id", "head"), "minhash-named")
    out = rows.select("doc_id", "h", "k1", "k2", "n").join(named, ["k1", "k2", "n"], "left")
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      ((F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("h") == F.col("head.h")))).alias("keeper")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "h", "n_shingles", "component_id", "kept", "keeper")


def hub_pairs(live: DataFrame, orders: int = HUB_ORDERS) -> DataFrame:
    """Pairs ``a, b, round`` of every class with its first hub in each order.

    In order 0 the class met most often comes first: in a group of variants of
    one text that is the text itself. The other orders are random. A class
    takes the first hub over all its buckets, so there are at most ``orders``
    pairs per class, however large its buckets.
    """
    met = live.groupBy("node").agg(F.sum("classes").alias("met"))
    ranks = [F.struct((-F.col("met")).alias("k"), F.xxhash64("node").alias("h"), F.col("node").alias("hub"))]
    ranks += [F.struct(F.lit(0).cast("long").alias("k"), F.xxhash64("node", F.lit(r)).alias("h"), F.col("node").alias("hub")) for r in range(1, orders)]
    placed = live.select("bucket", "node").join(met, "node")
    hubs = placed.groupBy("bucket").agg(*[F.min(x).alias(f"h{r}") for r, x in enumerate(ranks)])
    seen = live.select("bucket", "node").join(hubs, "bucket")
    first = seen.groupBy("node").agg(*[F.min(F.when(F.col(f"h{r}.hub") != F.col("node"), F.col(f"h{r}"))).alias(f"h{r}") for r in range(orders)])
    each = first.select("node", F.posexplode(F.array(*[F.col(f"h{r}.hub") for r in range(orders)])).alias("round", "hub")).filter(F.col("hub").isNotNull())
    return each.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), "round")


def sketched(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that sizes and sketches leave possible."""
    first = facts.select(F.col("node").alias("a"), F.struct(*facts.columns[1:]).alias("fa"))
    second = facts.select(F.col("node").alias("b"), F.struct(*facts.columns[1:]).alias("fb"))
    met = pairs.join(first, "a").join(second, "b")
    a, b = ({c: F.col(f"{s}.{c}") for c in facts.columns[1:]} for s in ("fa", "fb"))
    return met.filter(plausible(a, b)).select(*pairs.columns)


def unconnected(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    if labels is None:
        return pairs.select("a", "b")
    first = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    second = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(first, "a", "left").join(second, "b", "left").filter(
        F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def leftover(docs: DataFrame, live: DataFrame, labels: DataFrame, facts: DataFrame, picks: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of a bucket that the hub links left unconnected and that can be links, and the sets of their classes.

    Only buckets with more than one component are looked at, and which of their
    classes have a possible partner outside their component, by size and sketch,
    is found without listing pairs. The sets of these are ordered by rarity:
    linked sets share one of their rarest fifths, and at the first shingle they
    share both have enough left to reach the overlap a link needs. Pairs that
    meet this at no shingle are no links, so heavily edited copies of one text
    never pair up, and none is lost.
    """
    placed = live.select("bucket", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = save(with_main(placed, "bucket").join(facts, "node"), "minhash-split")
    m, x = {c: F.col(f"m_{c}") for c in [*split.columns, "shingle", "place"]}, {c: F.col(c) for c in [*split.columns, "shingle", "place"]}
    meet = (m["bucket"] == x["bucket"]) & (m["label"] != x["label"]) & plausible(m, x)
    outer = minor_of(split).join(split, meet, "left_semi").select(F.col("m_node").alias("node"))
    inner = split.join(minor_of(split), meet, "left_semi").select("node")
    nodes = save(outer.union(inner).distinct(), "minhash-open")
    sets = save(read_sets(docs, picks.join(nodes, "node", "left_semi"), width), "minhash-sets")

    items = sets.select("node", F.explode("shingles").alias("shingle"))
    rare = items.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    # Shingles of one holder come first in any order by rarity; only their number counts.
    shared = items.join(rare, "shingle").join(facts.select("node", "n"), "node")
    by_rarity = Window.partitionBy("node").orderBy("holders", "shingle")
    numbers = shared.withColumn("nth", F.row_number().over(by_rarity)).withColumn("kept", F.count(F.lit(1)).over(Window.partitionBy("node")))
    place = (F.col("n") - F.col("kept") + F.col("nth")).alias("place")
    prefix = numbers.select("node", "shingle", place).join(facts, "node").filter(F.expr("place <= n - (8 * n + 9) div 10 + 1"))
    owned = prefix.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    left = save(with_main(owned, "shingle"), "minhash-prefix")
    once = (x["label"] == x["main"]) | (m["node"] < x["node"])
    enough = F.lit(180) * (F.least(m["n"] - m["place"], x["n"] - x["place"]) + 1) >= F.lit(80) * (m["n"] + x["n"])
    met = minor_of(left).join(left, (m["shingle"] == x["shingle"]) & (m["label"] != x["label"]) & once & enough & plausible(m, x))
    return met.select(F.least("m_node", "node").alias("a"), F.greatest("m_node", "node").alias("b")).distinct(), sets


def with_main(rows: DataFrame, key: str) -> DataFrame:
    """Rows of keys that hold more than one component, with the largest of these as ``main``."""
    parts = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy(key).agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
    return rows.join(main, key)


def minor_of(rows: DataFrame) -> DataFrame:
    """The rows outside the largest component of their key, columns prefixed."""
    return rows.filter("label <> main").select(*[F.col(c).alias(f"m_{c}") for c in rows.columns])
