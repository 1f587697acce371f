"""Chains and rings followed by doubling: pages of a listing, retries of a read."""

import pytest
from pyspark.sql import functions as F

from pagegrain.operators import graph, journal


def _walk(start, pages, limit):
    """The same rules, page by page."""
    seen, url = [start], start
    while True:
        upcoming, rows = pages.get(url, (None, 0))
        if not rows:
            return len(seen), "content_mismatch"
        if upcoming is None:
            return len(seen), "continuation_exhausted"
        if not upcoming.startswith("https://s.test/") or "#" in upcoming:
            return len(seen), "invalid_continuation"
        if upcoming in seen:
            return len(seen), "continuation_cycle"
        if limit is not None and len(seen) == limit:
            return len(seen), "page_limit_reached"
        seen.append(upcoming)
        url = upcoming


def _url(name):
    return f"https://s.test/{name}"


@pytest.mark.parametrize("limit", [None, 1, 3, 6, 9])
def test_every_end_of_a_chain(spark, limit):
    links = {"a0": "a1", "a1": "a2", "a2": "a3", "a3": "a1", "b0": "b1", "b1": None, "c0": "c0", "d0": "gone", "e0": "e1", "e1": "e2", "e2": "e3", "e3": "e4", "e4": "e5", "e5": "e6",
             "e6": "e7", "e7": None, "f0": "f1", "f1": "a2", "z9": "z8", "z8": "z9", "y0": "z9", "g0": "g1"}
    pages = {_url(name): (None if after is None else _url(after), 5) for name, after in links.items()}
    pages[_url("g1")] = (None, 0)
    pages[_url("h0")] = ("https://other.test/x", 1)
    pages[_url("i0")] = (_url("b0") + "#top", 1)
    listing = spark.createDataFrame([(url, after, rows) for url, (after, rows) in pages.items()], "url string, next_url string, rows int")
    starts = [(at, url) for at, url in enumerate([*pages, _url("nowhere")])]
    got = {row["chain_id"]: (row["pages"], row["status"]) for row in graph.paginate(spark.createDataFrame(starts, "chain_id long, url string"), listing, limit).collect()}
    assert got == {at: _walk(url, pages, limit) for at, url in starts}


def test_ten_thousand_pages_in_few_rounds(spark, monkeypatch):
    n, rounds = 10_000, []
    doubled = graph._doubled
    monkeypatch.setattr(graph, "_doubled", lambda *args: rounds.append(1) or doubled(*args))
    after = F.when(F.col("id") < n - 1, F.concat(F.lit(_url("")), (F.col("id") + 1).cast("string")))
    listing = spark.range(n).select(F.concat(F.lit(_url("")), F.col("id").cast("string")).alias("url"), after.alias("next_url"), F.lit(1).alias("rows"))
    starts = spark.createDataFrame([(1, _url("0")), (2, _url("9000"))], "chain_id long, url string")
    assert {tuple(row) for row in graph.paginate(starts, listing).collect()} == {(1, n, "continuation_exhausted"), (2, 1000, "continuation_exhausted")}
    assert len(rounds) < 20


def test_no_pages_and_no_starts(spark):
    nothing = spark.createDataFrame([], "url string, next_url string, rows int")
    starts = spark.createDataFrame([(1, _url("x"))], "chain_id long, url string")
    assert [tuple(row) for row in graph.paginate(starts, nothing).collect()] == [(1, 1, "content_mismatch")]
    assert graph.paginate(starts.limit(0), nothing, 5).count() == 0


def test_a_chain_of_a_hundred_thousand_retries(spark):
    n = 100_000
    traces = spark.range(n)
    retries = traces.select(F.col("id").alias("trace_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("retry_of"))
    tools = F.when(F.col("id") == 7, "stealth").when(F.col("id") == 90_000, "paid").otherwise("http")
    attempts = traces.select(F.col("id").alias("trace_id"), tools.alias("provider"))
    candidates = traces.where("id % 1000 = 3").select(F.col("id").alias("trace_id"), F.explode(F.array(*map(F.lit, ["http", "stealth", "paid", "reader"]))).alias("provider"))
    got = {(row["trace_id"], row["provider"]) for row in journal.untried(candidates, attempts, retries).collect()}
    want = {(trace, tool) for trace in range(3, n, 1000) for tool, since in (("reader", n), ("stealth", 7), ("paid", 90_000)) if trace < since}
    assert got == want


def test_rings_and_forks_of_retries(spark):
    retries = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None), ("f", "gone")], "trace_id string, retry_of string")
    attempts = spark.createDataFrame([("a", "http"), ("b", "local"), ("c", "paid"), ("d", "reader"), ("e", "http"), ("gone", "stealth")], "trace_id string, provider string")
    tools = ["http", "local", "paid", "reader", "stealth"]
    candidates = spark.createDataFrame([(trace, tool) for trace in "abcdefx" for tool in tools], "trace_id string, provider string")
    got = {}
    for row in journal.untried(candidates, attempts, retries).collect():
        got.setdefault(row["trace_id"], set()).add(row["provider"])
    ring = {"reader", "stealth"}
    assert got == {"a": ring, "b": ring, "c": ring, "d": {"stealth"}, "e": set(tools) - {"http"}, "f": set(tools) - {"stealth"}, "x": set(tools)}
