"""Exact tails of large counts, as-of in a busy slot, link rescue beside a word of every link."""

import datetime
from decimal import Decimal, getcontext
from fractions import Fraction
from math import comb

from pyspark.sql import functions as F

from pagegrain.functions.stats import exact_two_sided
from pagegrain.operators import journal, joins


def _large(n, k):
    """The same p-value in 60 digits: Stirling's series for the point, then the sum of the tail."""
    getcontext().prec = 60
    pi = Decimal("3.14159265358979323846264338327950288419716939937510582097494")

    def log_factorial(m):
        z = Decimal(m)
        return z * z.ln() - z + (2 * pi * z).ln() / 2 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)

    point = (log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * Decimal(2).ln()).exp()
    term, total = Decimal(1), Decimal(1)
    for i in range(1, k + 1):
        term = term * (k - i + 1) / (n - k + i)
        total += term
        if term < total * Decimal("1e-30"):
            break
    return float(min(Decimal(1), 2 * point * total))


def test_p_values_of_small_and_large_counts(spark):
    small = [(a, b) for a in range(0, 40, 3) for b in range(0, 60, 7)] + [(300, 200), (15, 16), (1, 999)]
    want = {pair: float(min(Fraction(1), Fraction(2 * sum(comb(sum(pair), i) for i in range(min(pair) + 1)), 2 ** sum(pair)))) if sum(pair) else 1.0 for pair in small}
    for n, k in ((10_000_000, 4_997_000), (10_000_000, 4_999_999), (20_000_000, 9_990_000), (1_000_000, 498_000)):
        want[(k, n - k)] = _large(n, k)
    rows = spark.createDataFrame(list(want), "a long, b long").select("a", "b", exact_two_sided(F.col("a"), F.col("b")).alias("p")).collect()
    assert all(abs(row["p"] - want[row["a"], row["b"]]) <= 1e-9 * want[row["a"], row["b"]] for row in rows) and len(rows) == len(want)


def test_asof_in_a_busy_slot(spark):
    start, ttl = datetime.datetime(2024, 1, 1), 3600
    seen = [("hot", start + datetime.timedelta(seconds=11 * i)) for i in range(900)] + [("cold", start), ("cold", start + datetime.timedelta(seconds=9000))]
    asked = [(i, "hot", start + datetime.timedelta(seconds=7 * i)) for i in range(1500)] + [
        (9000 + i, "cold", start + datetime.timedelta(seconds=s)) for i, s in enumerate((0, 3599, 3600, 3601, 8999, 9000, 12600, 12601))] + [(9999, "none", start)]
    got = {row["request_id"]: row["cached_at"] for row in journal.cached_asof(
        spark.createDataFrame(asked, "request_id long, key string, requested_at timestamp"), spark.createDataFrame(seen, "key string, observed_at timestamp"), ttl).collect()}
    for request, key, at in asked:
        found = [time for name, time in seen if name == key and time <= at and (at - time).total_seconds() <= ttl]
        assert got[request] == (max(found) if found else None), (request, key, at)


def test_rescue_by_the_rarest_word(spark):
    links = [(f"https://s.test/guide-{i}",) for i in range(50)] + [("https://s.test/guide-blue-ring",), ("https://s.test/deep/down/guide-blue-ring",), ("https://s.test/guide-red",)]
    dead = [(1, "https://www.s.test/gone", "guide blue ring"), (2, "https://s.test/gone", "guide missing"), (3, "https://s.test/gone", "red guide"), (4, "https://s.test/x", "")]
    got = joins.rescue_links(spark.createDataFrame(dead, "dead_id long, url string, words string"), spark.createDataFrame(links, "link string")).collect()
    assert {tuple(row) for row in got} == {(1, "https://s.test/guide-blue-ring"), (3, "https://s.test/guide-red")}
