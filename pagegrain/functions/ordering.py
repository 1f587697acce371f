"""Ranks, running sums and exact order statistics that never put one whole group into one task.

A plain window sorts a whole group in one task, which fails when one key holds a third of all rows. These helpers split
each group into chunks by an expression that grows with the sort key, work inside each chunk, and add what the earlier
chunks of the group hold. The result is the same as the plain window's; only the size of a task changes. ``chunk`` must
be a function of the row alone (never of sampling), so that recomputed tasks agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(df: DataFrame, keys: Sequence[str], total: Column, name: str) -> DataFrame:
    """What earlier chunks of a group add up to: one small row per chunk."""
    per_chunk = df.groupBy(*keys, "_chunk").agg(total.alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias(name))


def _join_chunks(df: DataFrame, sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    right = sums
    for key in [*keys, "_chunk"]:
        right = right.withColumnRenamed(key, f"_r_{key}")
    condition = F.lit(True)
    for key in [*keys, "_chunk"]:
        condition = condition & df[key].eqNullSafe(right[f"_r_{key}"])
    return df.join(right, condition, "inner").drop(*[f"_r_{key}" for key in [*keys, "_chunk"]])


def rank_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, name: str) -> DataFrame:
    """1-based position of each row in its group, ordered by ``chunk`` then ``order``."""
    cut = df.withColumn("_chunk", chunk)
    local = cut.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)))
    sums = _before(cut, keys, F.count(F.lit(1)), "_before")
    return (_join_chunks(local, sums, keys)
            .withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint"))
            .drop("_chunk", "_local", "_before"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunk: Column, value: Column, name: str,
                inclusive: bool = True) -> DataFrame:
    """Running total of ``value`` in its group, with or without the row itself."""
    cut = df.withColumn("_chunk", chunk).withColumn("_value", value)
    frame = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    local = cut.withColumn("_local", F.coalesce(F.sum("_value").over(frame), F.lit(0)))
    sums = _before(cut, keys, F.sum(F.coalesce("_value", F.lit(0))), "_before")
    return (_join_chunks(local, sums, keys)
            .withColumn(name, F.col("_before") + F.col("_local"))
            .drop("_chunk", "_value", "_local", "_before"))


def magnitude(value: Column, steps: int = 64) -> Column:
    """A chunk that grows with a number: its sign and power of two, cut into ``steps``.

    Values in one chunk differ by about one percent, so a chunk of measured values (a few decimals) holds a bounded
    number of distinct ones however many rows there are.
    """
    size = F.floor(F.log2(F.abs(value)) * steps)
    return (F.when(value == 0, F.lit(0)).when(value > 0, size + F.lit(100_000)).otherwise(-(size + F.lit(100_000)))
            .cast("bigint"))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """Exact order statistics per group, by position in the sorted values.

    ``positions`` maps an output name to a 0-based index computed from ``n`` (the group's count of non-null values).
    Equal values are counted first, so a repeated value costs one row; a small histogram per group finds the chunk each
    index falls in, and only that chunk is ordered. Returns one row per group that has a value: keys, ``n``, statistics.
    """
    present = df.where(F.col(value).isNotNull())
    counted = (present.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
               .withColumn("_chunk", magnitude(F.col("_v"))))
    sums = _before(counted, keys, F.sum("_c"), "_before")
    sizes = counted.groupBy(*keys).agg(F.sum("_c").alias("n"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (_join_chunks(counted, sums, keys)
              .withColumn("_last", F.col("_before") + F.sum("_c").over(inside))
              .withColumn("_first", F.col("_last") - F.col("_c")))
    right = sizes
    for key in keys:
        right = right.withColumnRenamed(key, f"_s_{key}")
    condition = F.lit(True)
    for key in keys:
        condition = condition & placed[key].eqNullSafe(right[f"_s_{key}"])
    joined = placed.join(right, condition, "inner").drop(*[f"_s_{key}" for key in keys])
    picks = [F.max(F.when((index >= F.col("_first")) & (index < F.col("_last")), F.col("_v"))).alias(name)
             for name, index in positions.items()]
    return joined.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def index_quantile(share: float) -> Column:
    """The sorted-list index the bench summaries use: int(n * share)."""
    return F.floor(F.col("n") * F.lit(share)).cast("bigint")


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The true median per group (mean of the two middle values), exactly."""
    middle = order_statistics(df, keys, value, {
        "_low": F.floor((F.col("n") - 1) / 2).cast("bigint"), "_high": F.floor(F.col("n") / 2).cast("bigint")})
    return middle.withColumn(name, (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high")
