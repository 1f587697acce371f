"""Exact values on literal rows, for what SQL cannot say."""

import datetime

from pyspark.sql import functions as F

from pagegrain.functions import prices, texts, urls
from pagegrain.functions.stats import exact_two_sided
from pagegrain.operators import blocks, journal, lines, records, search, structured

def _now():
    return F.lit("2026-10-12 12:00:00").cast("timestamp")


def column(spark, values, fn, name="v"):
    rows = spark.createDataFrame([(at, value) for at, value in enumerate(values)], f"at int, {name} string")
    return [row[0] for row in rows.orderBy("at").select(fn(F.col(name))).collect()]


def test_key_terms(spark):
    got = column(spark, ["latest news this week on Tesla earnings", "how to fix a leaky tap", "RTX 5090 review site:example.com -site:spam.com",
                         "news 2026 today", "the and for", "kubernetes operators", "東京 天気"], texts.key_terms)
    assert got == [["tesla", "earning"], ["fix", "leaky", "tap"], ["rtx", "5090", "review"], [], [], ["kubernet", "operator"], ["東京", "天気"]]


def test_verticals(spark):
    cases = {"paper on diffusion models": "papers", "openai news": "news", "Nvidia today": "news", "who wrote Hamlet": "reference",
             "capital of Mongolia": "reference", "how to reverse a list in python": "qa", "TypeError: cannot read properties of undefined": "qa",
             "rust borrow checker error E0382": "qa", "Go to market strategy": "web", "public library for kids near me": "web",
             "Acme announces new model": "web", "how I wrote my first novel": "web", "": "web", "what happened with Tesla this week": "news"}
    got = column(spark, list(cases), lambda q: search.infer_vertical(q, F.lit(None).cast("string"), F.size(texts.entity_runs(q)) > 0)["vertical"])
    assert dict(zip(cases, got)) == cases


def test_lead_dates_and_origins(spark):
    got = column(spark, ["2026-10-09 - x", "9 Oct 2026 - x", "Oct 9, 2026 — x", "October 9th, 2026 x", "Oct 9 - x", "3 days ago - x", "no date"],
                 lambda s: texts.lead_date(s, _now()))
    day = datetime.datetime(2026, 10, 9, 23, 59, 59)
    assert got[:5] == [day] * 5 and got[5] == datetime.datetime(2026, 10, 9, 12) and got[6] is None


def offers(spark, values):
    rows = spark.createDataFrame([(at, value) for at, value in enumerate(values)], "at int, v string")
    found = prices.with_single_offer(rows, F.col("v"), "o").orderBy("at").select("o").collect()
    return [None if row[0] is None else {key: value for key, value in row[0].asDict().items() if value is not None} for row in found]


def test_single_offers(spark):
    got = offers(spark, ["A$1,249.50", "US$34.51 (~A$49.62)", "~A$49.62", "$10 - $25", "no price here, model X200", "$129\nSave $30!\n$99", "$79 Save $10",
                         "Now $45 was $60", "$39.99 RRP: $49.99", "$142.50 ($299.95 RRP) Delivered", "$39.99 Get $10.00 off $200.00 with Store Card",
                         "$15 + $9.95 shipping", "$ 69 . 99"])
    assert got == [{"price": 1249.5, "currency": "AUD"}, {"price": 34.51, "currency": "USD"}, {"price": 49.62, "currency": "AUD"},
                   {"price": 10.0, "price_max": 25.0}, None, {"price": 99.0, "was_price": 129.0}, {"price": 79.0, "was_price": 89.0},
                   {"price": 45.0, "was_price": 60.0}, {"price": 39.99, "was_price": 49.99}, {"price": 142.5, "was_price": 299.95}, {"price": 39.99},
                   {"price": 15.0}, {"price": 69.99}]


def test_card_facts(spark):
    assert column(spark, ["in stock\n2 Unit(s)", "SOLD OUT", "Only 3 left in stock.", "expired\nWidget deal"], texts.availability) == [
        "in_stock", "out_of_stock", "limited", "expired"]
    assert column(spark, ["in stock\n2 Unit(s)", "Only 3 left in stock."], texts.stock_count) == [2, 3]


def test_bench_listing(spark):
    listing = ["https://example.com/", "https://example.com/en-us/", "https://example.com/news/", "https://example.com/tag/openai",
               "https://example.com/blog/page/2", "https://example.com/find?q=openai"]
    items = ["https://example.com/news/openai-ships-model", "https://github.com/pandas-dev/pandas", "https://en.wikipedia.org/wiki/Alan_Turing"]
    assert column(spark, listing + items, urls.bench_listing) == [True] * 6 + [False] * 3


def test_relative_references(spark):
    base = F.lit("https://a.test/b/c/d?q=1#f")
    got = column(spark, ["/x", "x", "../x", "./x/../y", "//h.test/z", "?n=2", "#g", "https://o.test/", ""], lambda href: urls.resolve(base, href))
    assert got == ["https://a.test/x", "https://a.test/b/c/x", "https://a.test/b/x", "https://a.test/b/c/y", "https://h.test/z", "https://a.test/b/c/d?n=2",
                   "https://a.test/b/c/d?q=1#g", "https://o.test/", "https://a.test/b/c/d?q=1"]


def test_exact_p_values(spark):
    rows = spark.createDataFrame([(0, 0), (5, 5), (0, 10), (3, 9)], "a long, b long")
    got = [row[0] for row in rows.select(exact_two_sided(F.col("a"), F.col("b"))).collect()]
    want = [1.0, 1.0, 2 / 1024, 2 * 299 / 4096]
    assert all(abs(left - right) < 1e-9 for left, right in zip(got, want))


def test_navigation_led_pages(spark):
    menu = "".join("[A long category name](https://a.test/c)\n" for _ in range(90))
    prose = "The harbour ferry will run every twenty minutes from next week, the operator said in a long and careful statement about it all. " * 10
    docs = spark.createDataFrame([(0, menu + "Sign in\n"), (1, menu + prose), (2, prose)], "doc_id int, content string")
    found = lines.with_nav_measure(lines.with_lines(docs, F.col("content"))).orderBy("doc_id").select("nav_reason").collect()
    assert [row[0] for row in found] == ["thin prose after navigation", None, None]


def test_canonical_attempts_do_not_depend_on_order(spark):
    rows = [("t", "http", None, "observed", 0), ("t", "http", 0, "failed", 1), ("u", "http", None, "observed", 2), ("u", "http", 0, "observed", 3),
            ("v", "http", 0, "observed", 4), ("v", "http", 0, "failed", 5)]
    schema = "trace_id string, provider string, attempt_ordinal int, outcome string, pos int"
    want = {("t", 0, "failed", False), ("u", 0, "observed", True), ("v", 0, "failed", False)}
    for listed in (rows, rows[::-1]):
        found = journal.canonical(spark.createDataFrame(listed, schema)).collect()
        assert {(row.trace_id, row.attempt_ordinal, row.outcome, row.unambiguous) for row in found} == want


def test_main_content_and_markdown(spark):
    html = ("<html><body><nav><a href='/'>Home</a></nav><article><h1>Ferry</h1><p>" + "The ferry runs every twenty minutes from next week. " * 12
            + "</p><p>More <b>bold</b> words, and <a href='/x'>a link</a> in it.</p><ul><li>one</li><li>two</li></ul></article><footer>Legal</footer></body></html>")
    pages = spark.createDataFrame([(1, "https://a.test/b", html)], "page_id long, url string, html string")
    text = blocks.main_content(blocks.elements(pages)).collect()[0].text
    assert text.startswith("Ferry\n\nThe ferry runs") and "Home" not in text and "Legal" not in text
    markdown = blocks.to_markdown(pages).collect()[0].markdown
    assert "# Ferry" in markdown and "**bold**" in markdown and "[a link](https://a.test/x)" in markdown and "- one\n- two" in markdown


def test_json_after_a_marker(spark):
    got = column(spark, ['x = {"a": "}"} tail', "y = [1, [2]] {", "none"], lambda v: F.to_json(structured.json_after(v)))
    assert got == ['{"a":"}"}', "[1,[2]]", None]


def test_label_fields(spark):
    rows = spark.createDataFrame([("Widget Engineer", "Widget Engineer\nCompany: Cog\nPay: $122,000 | Where: Springfield, NSW\nRemote")], "name string, text string")
    got = records.fill_fields(rows, {"role": "title", "pay": "price", "employer": "text", "remote": "boolean"}, "text").collect()[0]
    assert (got.field_role, float(got.field_pay), got.field_employer, got.field_remote) == ("Widget Engineer", 122000.0, "Cog", "true")
    assert got.field_employer_source == "label:Company"
