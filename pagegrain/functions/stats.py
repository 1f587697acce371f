"""Exact paired tests as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _stirling_error(n: Column) -> Column:
    """ln n! less Stirling's approximation to it; ``n`` from 1 on."""
    z = n.cast("double")
    exact = F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double")) - ((z + 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi))
    square = z * z
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - F.lit(1 / 1188) / square) / square) / square) / square) / z
    return F.when(n <= 15, exact).otherwise(series)


def _half_point(n: Column, k: Column) -> Column:
    """C(n, k) / 2^n by its saddle point, so that counts of many millions lose no digits; ``k`` from 1 to n / 2."""
    d = (n - 2 * k) / n
    deviance = n / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    return F.sqrt(n / (2 * math.pi * k * (n - k))) * F.exp(_stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - deviance)


def _tail_over_point(n: Column, k: Column) -> Column:
    """The sum of C(n, i) for i up to k, in units of C(n, k): each term from the one before, as many as count (a few square roots of n)."""
    terms = F.least(k, F.ceil(5 * F.sqrt(n.cast("double"))) + 60).cast("bigint")
    start = F.struct(F.lit(1.0).alias("last"), F.lit(1.0).alias("sum"))

    def step(state: Column, i: Column) -> Column:
        last = state["last"] * (k - i + 1) / (n - k + i)
        return F.struct(last.alias("last"), (state["sum"] + last).alias("sum"))

    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), terms), start, step, lambda state: state["sum"])


def exact_two_sided(left: Column, right: Column) -> Column:
    """Two-sided exact binomial p-value from two counts (McNemar from discordant pairs, or a sign test)."""
    n, k = (left + right).cast("bigint"), F.least(left, right).cast("bigint")
    none = F.exp((1 - n) * math.log(2))
    return F.when(n == 0, F.lit(1.0)).when(k == 0, none).otherwise(F.least(F.lit(1.0), 2 * _half_point(n, k) * _tail_over_point(n, k)))
