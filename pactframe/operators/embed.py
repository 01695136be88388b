"""Vectors for tables of texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions import text as tx

# Dollars per million tokens of embedding models.
EMBEDDING_PRICES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10}
BATCH = 100


def hashed_slots(texts: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """Sparse hashed bag of words of unit length: (key, slot, weight).

    A word's slot is a prefix of its md5 modulo the width. Words of one text
    meet in the map-side combine, so the shuffle carries at most ``dim`` rows
    per text.
    """
    words = texts.select(key, F.explode(tx.words(F.col(text))).alias("w"))
    slot = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long") % dim
    counts = words.groupBy(key, slot.cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, key).select(key, "slot", (F.col("n") / F.col("norm")).alias("weight"))


def hashed_vectors(texts: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """The same as dense arrays; a text without words is the zero vector."""
    words = F.transform(
        tx.words(F.col(text)), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int"))
    counts = (
        texts.select(key, F.explode_outer(words).alias("slot"))
        .groupBy(key, "slot").agg(F.count("slot").alias("n"))
        .groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "n")))).alias("m"))
    )
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(
        F.try_element_at("m", i), F.lit(0)).cast("double"))
    return counts.select(key, normalize(dense).alias("embedding"))


def normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    packed = F.struct(F.sqrt(squares).alias("norm"))
    return F.transform(F.array(packed), lambda p: F.when(p["norm"] == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(
        F.transform(vector, lambda x: x.cast("double") / p["norm"])))[0]


def embed_table(
    texts: DataFrame, text: str, make_model: Callable[[], Callable[[Sequence[str]], np.ndarray]], *, batch: int = BATCH,
    query: bool = False, out: str = "embedding",
) -> DataFrame:
    """Embed a column with the caller's model, ``batch`` texts per call.

    ``make_model`` runs once per Python worker and returns a function of
    (texts, query) giving one row per text. Blank texts become a space.
    """
    def build():
        model = make_model()

        def predict(values: np.ndarray) -> np.ndarray:
            return np.asarray(model([str(v) for v in values], query), dtype=np.float32)

        return predict

    udf = predict_batch_udf(build, return_type=ArrayType(FloatType()), batch_size=batch)
    filled = F.when(F.trim(F.coalesce(text, F.lit(""))) == "", " ").otherwise(F.col(text))
    return texts.withColumn(out, udf(filled))


def embedding_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Dollars for billed tokens; an unknown model costs nothing."""
    cost = F.round(F.col("tokens") * F.coalesce("rate", F.lit(0.0)) / 1_000_000, 8)
    return usage.join(prices, "model", "left").withColumn(
        "cost_usd", F.when(F.col("tokens") > 0, cost).otherwise(0.0)).drop("rate")


def embedding_prices(spark) -> DataFrame:
    return spark.createDataFrame(list(EMBEDDING_PRICES.items()), "model string, rate double")
