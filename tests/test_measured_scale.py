"""Work that does not grow faster than the tables: dealt by rows, broadcast by measure, computed once."""

from pyspark.sql import functions as F
from pagegrain.functions import prices
from pagegrain.operators import blocks, search
from pagegrain.session import MEASURED, SPREAD, join_by_measure
from pagegrain.sources import tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _part(spark, folder, n):
    key = F.col("id").cast("long")
    spark.range(n).select(key.alias("p_partkey"), F.lit("red ring").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit("STANDARD").alias("p_type"),
                          (key % 50).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice")).coalesce(1).write.parquet(f"{folder}/part.parquet")


def test_a_narrow_table_is_dealt_by_rows(spark, tmp_path, monkeypatch):
    _part(spark, tmp_path, 95)
    own = spark.conf.get(SPREAD)
    monkeypatch.setattr(tables, "ROWS_A_TASK", {"part": 10})
    spark.conf.unset(SPREAD)
    try:
        t = tables.Tables(spark, str(tmp_path))
        assert t.part.rdd.getNumPartitions() == 10
        assert t.product_pages.rdd.getNumPartitions() == 10
        assert t.part.count() == t.product_pages.count() == 95
    finally:
        spark.conf.set(SPREAD, own)


def test_pages_are_not_broadcast_by_an_estimate(spark, tmp_path):
    _part(spark, tmp_path, 30_000)
    t = tables.Tables(spark, str(tmp_path))
    pages = t.product_pages
    joined = pages.select("page_id", "url").join(pages.select("page_id", "html"), "page_id")
    assert "BroadcastHashJoin" not in _plan(joined)


def test_a_session_without_broadcasts_stays_without(spark):
    own = {key: spark.conf.get(key, None) for key in MEASURED}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        join_by_measure(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    finally:
        for key, value in own.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_pages_are_parsed_once(spark):
    pages = spark.createDataFrame([(1, '<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">Ring</b></div>')], "page_id long, html string")
    found = blocks.microdata(blocks.elements(pages))
    assert "MapInPandas" not in _plan(found)
    assert [(r["type"], r["prop"], r["value"]) for r in found.collect()] == [("Product", "name", "Ring")]


def test_verdicts_are_worked_out_once(spark):
    hits = spark.createDataFrame([(1, 1, "https://a.test/x", "red widget", "s", None), (1, 2, "https://a.test/x", "red widget", "s", None)],
                                 "query_id long, pos int, url string, title string, snippet string, published string").withColumn("stars", F.lit(1.0))
    queries = spark.createDataFrame([(1, "red widget", None)], "query_id long, query string, recency string")
    rows = search.check_results(hits, queries, F.lit("1999-01-01 00:00:00").cast("timestamp"))
    assert _plan(rows).count("Join") == 1
    assert {r["pos"]: "duplicate" in r["reasons"] for r in rows.collect()} == {1: False, 2: True}


def test_currencies_by_marker_first_before_then_after(spark):
    rows = spark.createDataFrame([("AU$ 5 or US $7, €9, 10 zł, $11, 12 kr, none",), ("no amounts",), (None,)], "text string")
    found = prices.with_prices(rows, F.col("text"), "p").select(F.transform("p", lambda e: e["currency"]).alias("c")).collect()
    assert [r["c"] for r in found] == [["AUD", "USD", "EUR", "PLN", None, None], [], []]
