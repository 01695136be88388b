"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, save

#: Hash blocks of a source: the unit its permutations shuffle.
BLOCK_DIGITS = 3
GRID, ROUNDS = 32, 6


def words(text: Column) -> Column:
    """Tokens of a text for mixing: runs without ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_tokens(docs: DataFrame, n_tokens: Column) -> DataFrame:
    """``source, tokens, docs`` per source; a hot source is pre-aggregated by every task."""
    return docs.groupBy("source").agg(F.sum(n_tokens).alias("tokens"), F.count(F.lit(1)).alias("docs"))


def fit_exponent(sources: DataFrame, max_repeats: float | None = None, entropy: float | None = None) -> float:
    """The exponent of the token shares that meets a repetition limit or an entropy in nats.

    Either measure falls as the exponent rises from 0 (all sources alike) to 1
    (as they are). The interval is cut into ``GRID`` parts ``ROUNDS`` times; each
    time the sums over all sources are one aggregate, so the number of sources
    does not matter. Exactly one target is given. A limit that even exponent 1
    exceeds, or an entropy below its, gives 1; one that 0 meets gives 0.
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give max_repeats or entropy")
    live = sources.filter("tokens > 0")
    total = live.agg(F.sum("tokens"), F.max("tokens")).first()
    if total[0] is None:
        return 1.0
    share = F.col("tokens") / F.lit(float(total[0]))
    top = math.log(total[1] / total[0])
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        power = [F.pow(share, F.lit(p)) for p in points]
        if entropy is not None:
            sums = [x for q in power for x in (F.sum(q), F.sum(q * F.log(q)))]
            row = live.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
            value = [math.log(row[2 * i]) - row[2 * i + 1] / row[2 * i] for i in range(GRID + 1)]
            over = [v > entropy for v in value]
        else:
            # With a budget that shows the largest source once, a source is
            # repeated (share / largest share) ** (exponent - 1) times.
            row = live.agg(*[F.max(F.exp((F.log(share) - F.lit(top)) * F.lit(p - 1.0))).alias(f"s{i}") for i, p in enumerate(points)]).first()
            over = [row[i] > max_repeats for i in range(GRID + 1)]
        last = max((i for i in range(GRID + 1) if over[i]), default=-1)
        if last < 0:
            return round(low, 6)
        if last == GRID:
            return 1.0
        low, high = points[last], points[last + 1]
    # Six digits, away from the limit: a higher exponent repeats less. What the search left open is far less than the slack.
    return math.ceil(high * 1e6 - 1e-3) / 1e6


def plan(docs: DataFrame, n_tokens: Column, max_repeats: float | None = 2.0, entropy: float | None = None,
         budget: int | None = None) -> DataFrame:
    """Per source ``source, tokens, weight, quota, epochs, rest``: what the mixture takes of it.

    ``weight`` is the normalised power of the token share, ``quota`` the source's
    part of the token budget: ``epochs`` whole permutations and ``rest`` tokens of
    one more. Without a ``budget`` it is the smallest that shows every document
    at least once, so mixing repeats and drops nothing. No quota passes
    ``max_repeats`` times its source. Sources without a single token take one epoch.
    """
    sources = save(source_tokens(docs, n_tokens), "sources")
    exponent = fit_exponent(sources, None if entropy is not None else max_repeats, entropy)
    live = sources.filter("tokens > 0")
    total = live.agg(F.sum(F.pow("tokens", F.lit(exponent))), F.max(F.col("tokens") / F.pow("tokens", F.lit(exponent)))).first()
    whole = total[0] or 1.0
    tokens = float(budget) if budget is not None else whole * (total[1] or 0.0)
    weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(exponent)) / F.lit(whole)).otherwise(F.lit(0.0))
    quota = F.round(F.col("weight") * F.lit(tokens)).cast("long")
    if entropy is None and max_repeats is not None:
        quota = F.least(quota, F.floor(F.col("tokens") * F.lit(float(max_repeats))).cast("long"))
    return (sources.withColumn("weight", weight)
            .withColumn("quota", quota)
            .withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("int"))
            .withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(F.lit(0)).cast("long")))


def block_of(doc_id: Column) -> Column:
    """The block of a document inside its source."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BLOCK_DIGITS)


def order_of(epoch: Column, source: Column, block: Column) -> Column:
    """The key that orders a source's blocks anew in every epoch."""
    return F.md5(F.concat_ws("|", epoch.cast("string"), F.coalesce(source.cast("string"), F.lit("")), block))


def running(value: Column, order: str) -> Column:
    """The sum of ``value`` over the rows of a source before this one."""
    ahead = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(ahead), F.lit(0))


def cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Where the last, partial permutation of each source ends: ``source, cut_order, cut_doc``.

    Block sums come first, so only the few thousand blocks of a source are
    ranked; inside the block that the quota ends in, documents follow each other
    by the hash of their id. A document is in when the tokens before it leave
    room for its first token.
    """
    part = sources.filter("rest > 0")
    last = F.col("epochs")
    blocks = (rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens")).join(
        part.select(F.col("source").alias("s"), "epochs", "rest"), F.col("source").eqNullSafe(F.col("s")))
        .select("source", "block", "rest", "tokens", order_of(last, F.col("source"), F.col("block")).alias("cut_order")))
    ranked = blocks.withColumn("before", running(F.col("tokens"), "cut_order"))
    ending = ranked.filter("before < rest").groupBy("source").agg(
        F.max_by(F.struct("block", "cut_order", "rest", "before"), "cut_order").alias("e")).select("source", "e.*")
    inside = rows.join(ending.select(F.col("source").alias("s"), F.col("block").alias("b"), "cut_order", "rest", "before"),
                       F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    # Documents that share a hash stand or fall together.
    by_doc = inside.groupBy("source", "cut_order", "rest", "before", "doc_order").agg(F.sum("n_tokens").alias("tokens"))
    reach = by_doc.withColumn("reached", F.col("before") + running(F.col("tokens"), "doc_order"))
    return reach.filter("reached < rest").groupBy("source").agg(
        F.max("cut_order").alias("cut_order"), F.max("doc_order").alias("cut_doc"))


def mix(docs: DataFrame, max_repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None,
        n_tokens: Column | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` repeated or cut to the mixture, with ``epoch``, ``block``, ``block_order`` and ``n_tokens``.

    Each source contributes whole permutations of its blocks and the start of
    one more, up to its quota. Sorting by ``epoch``, ``block_order`` and the id's
    hash gives a source's reading order. Only one row per source is joined to
    the documents, so texts do not shuffle while the sources fit a broadcast by
    Spark's own size check.

    Defined results: null is a source of its own; a null text has no tokens;
    rows that share an id are taken or left together; an empty table stays
    empty. ``keep_text=False`` keeps ``doc_id`` and ``source`` only. Columns of
    ``docs`` with the names added here are replaced.
    """
    counted = docs.select("doc_id", "source", (words(F.col("text")) if n_tokens is None else n_tokens).alias("n_tokens"))
    rows = save(counted.withColumn("block", block_of(F.col("doc_id"))).withColumn("doc_order", F.md5(F.concat(
        F.lit("doc|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))), "mix-rows")
    sources = save(plan(rows, F.col("n_tokens"), max_repeats, entropy, budget), "mix-plan")
    ends = cuts(rows, sources)
    takes = save(sources.select("source", "epochs").join(
        ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-takes")
    takes = takes.select(F.col("source").alias("__s"), F.col("epochs").alias("__epochs"),
                         F.col("cut_order").alias("__cut"), F.col("cut_doc").alias("__cut_doc"))
    if keep_text:
        base = docs.drop("epoch", "block", "block_order", "n_tokens").withColumns({
            "n_tokens": words(F.col("text")) if n_tokens is None else n_tokens, "block": block_of(F.col("doc_id")),
            "__doc": F.md5(F.concat(F.lit("doc|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))})
    else:
        base = rows.withColumnRenamed("doc_order", "__doc")
    joined = base.join(takes, base["source"].eqNullSafe(takes["__s"]))
    key = order_of(F.col("__epochs"), F.col("source"), F.col("block"))
    within = F.coalesce((key < F.col("__cut")) | ((key == F.col("__cut")) & (F.col("__doc") <= F.col("__cut_doc"))), F.lit(False))
    times = F.col("__epochs") + within.cast("int")
    spread = joined.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))
    return spread.withColumn("block_order", order_of(F.col("epoch"), F.col("source"), F.col("block"))).drop(
        "__s", "__epochs", "__cut", "__cut_doc", "__doc")


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixture with exactly the columns of ``docs``; a repeated document is a repeated row."""
    kept = {c: fresh(docs, f"__kept_{c}") for c in docs.columns if c in ("epoch", "block", "block_order", "n_tokens")}
    mixed = mix(docs.withColumns({v: F.col(k) for k, v in kept.items()}), **how)
    return mixed.select(*[F.col(kept.get(c, c)).alias(c) for c in docs.columns])
