"""Work that is done once per row: a page is taken apart once, its links are resolved once, a text's amounts are found once."""

from pyspark.sql import functions as F

from pagegrain.functions import fixed, prices
from pagegrain.operators import records

PAGE = "\n".join(["# Shop", "[Home](/)", "[![Ring A](/img/a.jpg)](/product/a)", "[Ring A](/product/a)", "$20", "Save $5!", "$15", "in stock",
                  "[Ring B](/product/b)", "$30 (was $40); set of two $50", "[Ring A](/product/a)", "[Ring C](/product/c)", "US $1,200.50"])


def _pages(spark):
    return spark.createDataFrame([(1, "https://www.shop.test/list", PAGE), (2, "https://www.shop.test/none", "no links"), (None, "https://www.shop.test/x", PAGE)],
                                 "page_id long, url string, content string")


def test_a_page_is_taken_apart_before_its_lines_are_rows(spark):
    plan = records.page_lines(_pages(spark))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Generate")]
    assert "split(" not in above and "content" not in above


def test_links_are_resolved_once(spark):
    blocks = records.record_blocks(_pages(spark))
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # read from what was written, three times
    got = {(row["page_id"], row["target"]): row for row in blocks.collect()}
    assert set(got) == {(1, f"https://www.shop.test/product/{name}") for name in "abc"}
    first = got[1, "https://www.shop.test/product/a"]
    assert (first["start"], first["n_lines"], first["image"]) == (2, 13, "https://www.shop.test/img/a.jpg")
    assert first["lines"][-5:] == ["Ring A", "$20", "Save $5!", "$15", "in stock"] and first["names"][0] == "Ring A"
    # A link seen before opens no block: its line belongs to the block above.
    assert got[1, "https://www.shop.test/product/b"]["lines"] == ["Ring B", "$30 (was $40); set of two $50", "Ring A"]


def test_amounts_of_texts_that_hold_the_mark_between_parts(spark):
    texts = ["~ US $1,200.50 to $30", "a $5 b 7 kr c", "$9", "7 days", "was $4.5x", None, "", "AUD 3,000 / 12 €"]
    rows = [(at, text) for at, text in enumerate(texts)] + [(100 + at, text + "\u0002") for at, text in enumerate(texts) if text]
    df = spark.createDataFrame(rows, "at int, text string")
    got = {row["at"]: row["p"] for row in prices.with_prices(df, F.col("text"), "p").collect()}
    for at, text in enumerate(texts):
        if text:
            assert got[at] == got[100 + at], text
    said = [[(e["value"], e["currency"], e["role"], e["start"], e["end"]) for e in got[at]] for at in range(len(texts))]
    assert said == [[(1200.5, "USD", "approx", 0, 14), (30.0, None, "price", 18, 21)], [(5.0, None, "price", 2, 4), (7.0, None, "price", 7, 11)],
                    [(9.0, None, "price", 0, 2)], [], [(4.5, None, "was", 4, 8)], [], [], [(3000.0, "AUD", "price", 0, 9), (12.0, "EUR", "price", 12, 16)]]


def test_only_lines_of_several_offers_are_read_clause_by_clause(spark):
    rows = [(0, "Ring\n$20\nnow $15", "Ring"), (1, "Cards 7\n1 card $5, 3 cards $12", "three cards"), (2, "Ring\n$30 (was $40)", "Ring"), (3, "Set; of two\n$8", None)]
    df = prices.with_offer(spark.createDataFrame(rows, "at int, text string, title string"), F.col("text"), F.col("title"), "o")
    got = {row["at"]: row for row in df.collect()}
    assert (got[0]["o"]["price"], got[0]["o_offers"]) == (20.0, None)
    assert [offer["price"] for offer in got[1]["o_offers"]] == [5.0, 12.0] and got[1]["o"]["price"] in (5.0, 12.0)
    assert (got[2]["o"]["price"], got[2]["o"]["was_price"]) == (30.0, 40.0) and got[3]["o"]["price"] == 8.0


def test_every_marker_holds_a_mark():
    import re
    for marker, _ in fixed.CURRENCY_PREFIX + fixed.CURRENCY_SUFFIX:
        assert re.search(prices._MARKED, marker)


def test_search_words_are_made_where_hits_meet_their_query(spark):
    from pagegrain.operators import search
    hits = spark.createDataFrame([(1, 1, "https://a.test/x", "Red ring", "a ring", None, 5.0), (1, 2, "https://a.test/x", "Red ring", "a ring", None, 5.0),
                                  (2, 1, "https://b.test/y", "Blue", "none", None, 5.0)],
                                 "query_id long, pos long, url string, title string, snippet string, published string, stars double")
    queries = spark.createDataFrame([(1, "red ring", None), (2, "paper on ring gear", None)], "query_id long, query string, recency string")
    got = search.check_results(hits, queries, F.lit("2026-01-01").cast("timestamp"))
    plan = got.select("query_id", "relevance", "phrase_passes")._jdf.queryExecution().optimizedPlan().toString()
    # Words are made above the join, and none goes through the windows over a result set.
    assert "title_words" not in plan[plan.index("Join "):] and "RepartitionByExpression" in plan
    assert "title_words" not in plan[:plan.index("Window ")]
    assert {(row["query_id"], row["pos"]): row["passed"] for row in got.collect()} == {(1, 1): True, (1, 2): False, (2, 1): False}


def test_pages_are_tokenized_once(spark):
    from pagegrain.operators import blocks
    html = "<h1>Head</h1><p>Some <b>text</b></p><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>"
    pages = spark.createDataFrame([(1, "https://a.test/", html), (2, "https://a.test/b", "")], "page_id long, url string, html string")
    made = blocks.to_markdown(pages)
    assert "MapInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {row["page_id"]: row["markdown"] for row in made.collect()} == {
        1: "# Head\n\nSome **text**\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n", 2: ""}


def test_values_of_a_schema_are_read_once(spark):
    from pagegrain.operators import structured
    schema = {"title": "Product", "properties": {"name": {"type": "string"}, "price": {"type": "number"}, "brand": {"type": "string"}}}
    html = ('<script type="application/ld+json">{"@type":"Product","name":"Ring","offers":[{"price":"5.50"}],"brand":{"name":"Acme"}}</script>'
            '<meta name="description" content="x">')
    pages = spark.createDataFrame([(1, "https://a.test/", html)], "page_id long, url string, html string")
    filled = structured.fill_schema(schema, structured.jsonld_nodes(pages), structured.meta_tags(pages), structured.embedded_json(pages))
    assert "get_json_object" not in filled._jdf.queryExecution().optimizedPlan().toString()
    assert {row["property"]: row["value"] for row in filled.collect()} == {"name": "Ring", "price": "5.5", "brand": "Acme"}
    # Keys with marks that JSON spells in another way are looked up as before.
    rows = spark.createDataFrame([('{"a":[{"b":"x"}],"cé":"y"}',)], "json string")
    got = rows.select(structured._json_path(F.col("json"), "a.b"), structured._json_path(F.col("json"), "cé"), structured._json_path(F.col("json"), "b.a")).first()
    assert tuple(got) == ("x", "y", None)
