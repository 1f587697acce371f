"""Tasks that do not grow with the tables: shuffles that start wide, loops that work their edges out once, texts that need no search."""

from pyspark.sql import functions as F

from pagegrain.operators import grading, graph, joins, links
from pagegrain.session import SPREAD, START_PARTITIONS, widen_shuffles
from pagegrain.sources import tables


def _counted(spark, rows, schema, column):
    """A table, and how often a row of it was worked out."""
    calls = spark.sparkContext.accumulator(0)

    def seen(value):
        calls.add(1)
        return value

    return spark.createDataFrame(rows, schema).withColumn(column, F.udf(seen, "string").asNondeterministic()(column)), calls


def test_shuffles_start_with_more_partitions_for_larger_tables(spark, tmp_path, monkeypatch):
    spark.range(95).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    own, before = spark.conf.get(SPREAD), spark.conf.get(START_PARTITIONS, None)
    monkeypatch.setattr(tables, "ROWS_A_PARTITION", {"part": 5})
    try:
        spark.conf.unset(SPREAD)
        assert tables.Tables(spark, str(tmp_path)).part.count() == 95
        assert spark.conf.get(START_PARTITIONS) == "19"
        widen_shuffles(spark, 3)
        assert spark.conf.get(START_PARTITIONS) == "19"
    finally:
        spark.conf.set(SPREAD, own)
        spark.conf.unset(START_PARTITIONS) if before is None else spark.conf.set(START_PARTITIONS, before)


def test_sitemap_indexes_are_read_once(spark):
    children, calls = _counted(spark, [(f"s{n}", f"s{n + 1}") for n in range(6)] + [("s6", "s0"), ("s0", "s1"), ("x", "y")], "sitemap string, child string", "child")
    found = graph.sitemap_walk(children, spark.createDataFrame([("s0",), ("s0",)], "sitemap string")).collect()
    assert sorted(map(tuple, found)) == [(f"s{n}", n) for n in range(7)]
    assert calls.value == 9
    assert graph.sitemap_walk(children, spark.createDataFrame([], "sitemap string")).count() == 0
    short = graph.sitemap_walk(children, spark.createDataFrame([("s0",)], "sitemap string"), max_rounds=2)
    assert sorted(map(tuple, short.collect())) == [("s0", 0), ("s1", 1), ("s2", 2)]


def test_a_crawl_reads_its_edges_once(spark):
    at = "https://www.a.test/"
    edges, calls = _counted(spark, [(at, f"{at}1"), (f"{at}1", f"{at}2"), (f"{at}2", f"{at}3"), (f"{at}2", f"{at}x/4"), (f"{at}3", at), (f"{at}1", f"{at}5")], "src string, dst string", "dst")
    pages, skipped = graph.crawl(edges, at, max_depth=4, exclude="/x/")
    assert sorted(map(tuple, pages.collect())) == [(at, 0), (f"{at}1", 1), (f"{at}2", 2), (f"{at}3", 3), (f"{at}5", 2)]
    assert [tuple(row) for row in skipped.collect()] == [("filtered", 1)]
    assert calls.value == 6
    few, _ = graph.crawl(edges, at, max_depth=4, limit=3)
    assert sorted(map(tuple, few.collect())) == [(at, 0), (f"{at}1", 1), (f"{at}2", 2)]


def test_only_hosts_meet_the_excluded_domains(spark):
    rows = spark.createDataFrame([(1, "https://www.github.com/a"), (1, "https://a.test/"), (2, "https://x.example.com/"), (3, "https://notexample.com/"), (4, None), (5, "https://a.test/")], "id long, url string")
    kept = joins.without_domains(rows, spark.createDataFrame([("github.com",), ("example.com",)], "domain string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, "https://a.test/"), (3, "https://notexample.com/"), (4, None), (5, "https://a.test/")], key=str)


def test_a_path_is_worked_out_once_per_tag(spark):
    tags = "".join(f'<img src="/i/{n}_ring.jpg" alt="logo">' for n in range(8)) + '<img src="/i/9.jpg" alt="a Ring"><img alt="ring"><img src="/i/0.jpg">'
    pages = spark.createDataFrame([(1, "https://s.test/search", tags), (2, "https://s.test/search", tags[:100])], "page_id long, url string, html string")
    found = links.result_images(pages, F.array(F.lit("ring"), F.lit("red")))
    assert not any("Filter" in line and "exists" in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert [tuple(row) for row in found.collect()] == [(1, 9)]


def test_placeholders_of_texts_that_are_searched_and_that_are_not(spark):
    rows = [("Price $0.00 only", "prices not loaded"), ("now 0,00 zł", "prices not loaded"), ("$0.00 or $5.00", None), ("0 and 00", None), ("$5.55", None), ("", None), (None, None),
            ("{{ a }} NaN ${b}", "unrendered template values"), ("[object](x)Object] NaN undefined", "unrendered template values"), ("{{ a }} https://a.test/{{b}}{{c}}", None)]
    df = spark.createDataFrame(rows, "text string, want string").withColumn("shown", grading.shown_prices(F.col("text")))
    zero = F.size(F.filter("shown", lambda price: price.rlike(r"^\D*0+(?:[.,]0+|,-)?\D*$")))
    got = df.select("text", "want", grading.placeholder(F.col("text"), zero, F.size("shown") - zero).alias("got")).collect()
    assert [(row["text"], row["got"]) for row in got] == [(row["text"], row["want"]) for row in got]
