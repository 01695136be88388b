"""Skew-safe windows and percentiles against plain ones."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pactframe.operators import ordered
from pactframe.operators import timeline as tl
from pactframe.operators.ranks import nearest_rank, newest_by, top_k


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(5)
    rows = [(0 if i % 3 == 0 else random.randrange(40), i, random.choice([None, 1, 2, 5])) for i in range(3000)]
    return spark.createDataFrame(rows, "k long, o long, v int").cache()


def pairs(df, *cols):
    return sorted((r[0], r[1], *(-1 if x is None else x for x in r[2:])) for r in df.select("k", "o", *cols).collect())


@pytest.mark.parametrize("width", [1, 7, 100000])
def test_segments_equal_one_window(skewed, width):
    seg = F.floor(F.col("o") / width)
    w = Window.partitionBy("k").orderBy("o")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    val = F.coalesce("v", F.lit(0)).cast("long")
    want = skewed.select("k", "o", F.lag("o").over(w).alias("a"), F.lead("o").over(w).alias("b"), F.sum(val).over(upto).alias("c"),
                         F.last("v", True).over(upto).alias("d"), F.row_number().over(w).alias("e"))
    got = {
        "a": ordered.neighbour(skewed, ["k"], ["o"], seg, {"a": F.col("o")}),
        "b": ordered.neighbour(skewed, ["k"], ["o"], seg, {"b": F.col("o")}, following=True),
        "c": ordered.running_sum(skewed, ["k"], ["o"], seg, val, "c"),
        "d": ordered.carry_forward(skewed, ["k"], ["o"], seg, F.col("v"), "d"),
        "e": ordered.row_index(skewed, ["k"], ["o"], seg, "e")}
    want = want.cache()
    for column, df in got.items():
        assert pairs(df, column) == pairs(want, column)


def rank_of(values, p):
    ordered_ = sorted(values)
    return ordered_[(len(ordered_) * p + 99) // 100 - 1]


@pytest.mark.parametrize("n", [1, 2, 10, 20, 100, 997])
def test_nearest_rank(spark, n):
    random.seed(n)
    values = [round(math.exp(random.gauss(0, 3)), 3) if i % 4 else 7.0 for i in range(n)]
    df = spark.createDataFrame([(i % 2, v, -v) for i, v in enumerate(values)], "g int, v double, w double")
    got = nearest_rank(df, [], ["v", "w"], (50, 95), cells=16).first()
    assert got["v_p50"] == rank_of(values, 50) and got["v_p95"] == rank_of(values, 95)
    assert got["w_p95"] == rank_of([-v for v in values], 95)
    for row in nearest_rank(df, ["g"], ["v"], (50, 95)).collect():
        mine = values[row["g"]::2]
        assert row["v_p50"] == rank_of(mine, 50) and row["v_p95"] == rank_of(mine, 95)


def test_top_k_limits_before_the_shuffle(skewed):
    plan = top_k(skewed, ["k"], [F.desc("o")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_newest_by(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c")], "k int, t int, s string")
    assert newest_by(df, ["k"], ["t"], ["s"]).collect()[0]["s"] == "b"


@pytest.mark.parametrize("spec,want", [("24h", 86400), ("7d", 604800), (" 5M ", 300), ("30s", 30)])
def test_window_specs(spec, want):
    assert tl.seconds(spec) == want


@pytest.mark.parametrize("spec", ["0h", "h", "1w", "-1h", "", "1h2m"])
def test_bad_window_specs(spec):
    with pytest.raises(ValueError):
        tl.seconds(spec)


def test_host_bucket():
    assert tl.host_bucket("1h", 30) == "30s" and tl.host_bucket("7d", 30) == "6h" and tl.host_bucket("30m", 0.2) == "1m"


def test_nearest_rank_with_an_outlier(spark):
    # One value of 1e12 presses the others into the first cell; narrowing again spreads them.
    df = spark.range(20_000).select(F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 200).alias("v"))
    row = nearest_rank(df, [], ["v"], [50, 95]).first()
    values = sorted([1e12, *[i / 200 for i in range(1, 20_000)]])
    assert (row["v_p50"], row["v_p95"]) == (values[9_999], values[18_999])
    plan = nearest_rank(df, [], ["v"], [50])._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().count("log1p") >= 2
