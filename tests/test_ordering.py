"""Chunked ranks, sums and order statistics against plain windows, with one key holding most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagegrain.functions.ordering import index_quantile, medians, order_statistics, rank_in_group, running_sum


def skewed(spark, n=3000):
    rng = random.Random(3)
    rows = [("hot" if at % 3 else f"k{at % 50}", at, round(rng.uniform(-50, 400), 2) if at % 17 else None) for at in range(n)]
    return spark.createDataFrame(rows, "k string, at long, v double")


def test_rank_and_running_sum_match_windows(spark):
    df = skewed(spark)
    order = Window.partitionBy("k").orderBy("at")
    want = df.withColumn("r", F.row_number().over(order)).withColumn("s", F.coalesce(F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = rank_in_group(df, ["k"], [F.col("at")], F.floor(F.col("at") / 100), "r")
    summed = running_sum(df, ["k"], [F.col("at")], F.floor(F.col("at") / 100), F.col("v"), "s", inclusive=False)
    truth = {row.at: (row.r, round(row.s, 6)) for row in want.collect()}
    assert {row.at: row.r for row in ranked.collect()} == {at: value[0] for at, value in truth.items()}
    assert {row.at: round(row.s, 6) for row in summed.collect()} == {at: value[1] for at, value in truth.items()}


def test_order_statistics_are_exact(spark):
    df = skewed(spark)
    groups = {}
    for row in df.where("v is not null").collect():
        groups.setdefault(row.k, []).append(row.v)
    got = order_statistics(df, ["k"], "v", {"p50": F.floor(F.col("n") / 2).cast("bigint"), "p90": index_quantile(0.9)}).collect()
    middle = {row.k: row.m for row in medians(df, ["k"], "v", "m").collect()}
    for row in got:
        values = sorted(groups[row.k])
        assert (row.n, row.p50, row.p90) == (len(values), values[len(values) // 2], values[int(len(values) * 0.9)])
        low, high = values[(len(values) - 1) // 2], values[len(values) // 2]
        assert abs(middle[row.k] - (low + high) / 2) < 1e-9
