"""Cases that were once wrong: caps, watches over several calls, ties of evidence, odd pages, hot keys."""

import datetime

from pyspark.sql import functions as F

from pagegrain.functions import texts
from pagegrain.operators import blocks, graph, joins, journal, search, structured
from pagegrain.sources import payloads
from pagegrain.streaming import watch

GUIDE = ("<html><body><h1>Camera guide</h1><script>var x</script><p>Pick a <b>light</b> body and a <a href='/lenses'>good lens</a>.</p>"
         "<ul><li>Body<ul><li>Mirrorless</li></ul></li><li>Lens</li></ul><table><tr><th>Model</th><th>Price</th></tr><tr><td>A1</td><td>$900</td><td>x|y</td></tr></table>"
         "<pre><code>print('hi')</code></pre><img src='/a.jpg' alt='A camera'><a href='javascript:void(0)'>menu</a><form><input name='q'></form></body></html>")


def markdown(spark, html):
    rows = spark.createDataFrame([(1, "https://shop.example/guide", html)], "page_id long, url string, html string")
    return blocks.to_markdown(rows).head()["markdown"]


def test_markdown_of_a_guide(spark):
    text = markdown(spark, GUIDE)
    assert text.startswith("# Camera guide\n\nPick a **light** body and a [good lens](https://shop.example/lenses).")
    assert "- Body\n  - Mirrorless\n- Lens" in text and "| Model | Price |  |\n| --- | --- | --- |\n| A1 | $900 | x\\|y |" in text
    assert "```\nprint('hi')\n```" in text and "![A camera](https://shop.example/a.jpg)" in text
    assert "var x" not in text and "javascript:" not in text and "menu" not in text


def test_markdown_of_odd_pages(spark):
    assert markdown(spark, "<ol><li><p>a</p><p>b</p></li><li>c</li></ol>") == "1. a\n\n  b\n\n2. c\n"
    assert markdown(spark, "<p><b>x <span hidden>secret</span></b></p>") == "**x**\n"
    assert markdown(spark, "<span>one<div>two</div>three</span>") == "one\n\ntwo\n\nthree\n"
    assert markdown(spark, "<p>x" * 5000) == "\n\n".join(["x"] * 5000) + "\n"
    assert markdown(spark, "<div>" * 3000 + "deep") == "deep\n"
    assert markdown(spark, None) == "" and markdown(spark, "<p>a <b></b><a href=/y> </a>z</p>") == "a z\n"


def test_unclosed_paragraphs_do_not_nest():
    nodes = blocks.parse("<p>x" * 2000)
    assert len(nodes) == 2000 and max(len(node["ancestors"]) for node in nodes) == 0


def test_nothing_is_cut(spark):
    items = "".join(f"<item><title>t{i}</title><link>https://a.test/{i}</link></item>" for i in range(2500))
    feed = spark.createDataFrame([(1, f"<rss><channel>{items}</channel></rss>")], "feed long, body string")
    assert payloads.feed_entries(feed).count() == 2500 and payloads.feed_entries(feed, limit=7).count() == 7
    robots = spark.createDataFrame([("https://h.test", "\n".join(f"Sitemap: /s{i}.xml" for i in range(60)))], "base string, body string")
    assert payloads.robots_sitemaps(robots).count() == 60
    deep = '{"a":' * 14 + '{"list":[{"x":1},{"x":2},{"x":3}]}' + "}" * 14
    values = spark.createDataFrame([(1, 0, deep)], "page_id long, pos int, body string").select("page_id", "pos", F.parse_json("body").alias("value"))
    assert structured.longest_list(values).head()["rows"] == 3
    assert structured.deep_key(values, ["x"]).head()["value"] == "1"
    tail = spark.createDataFrame([("a" * 4000 + "x",), ("a" * 4000 + "y",)], "text string").select(texts.fingerprint(F.col("text")).alias("f"))
    assert tail.distinct().count() == 2
    chain = spark.createDataFrame([(f"s{i}", f"s{i + 1}") for i in range(15)], "sitemap string, child string")
    assert graph.sitemap_walk(chain, spark.createDataFrame([("s0",)], "sitemap string")).count() == 16


def test_a_crawl_of_depth_nought(spark):
    pages, skipped = graph.crawl(spark.createDataFrame([("https://a.test/", "https://a.test/b")], "src string, dst string"), "https://a.test/", max_depth=0)
    assert pages.count() == 1 and skipped.count() == 0


def poll(folder, spark, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / name))


def test_a_link_watch_goes_on_where_it_ended(spark, tmp_path):
    schema = "watch string, link string, polled_at timestamp, ok boolean"
    day = [datetime.datetime(2024, 1, n) for n in range(1, 6)]

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "polls"))
        return {(row["link"], row["first_poll"]) for row in watch.link_watch(stream, home=str(tmp_path / "home")).collect()}

    poll(tmp_path, spark, "polls", [("w", "a", day[0], True), ("w", "b", day[0], True)], schema)
    assert run() == {("a", True), ("b", True)}
    assert run() == set()
    poll(tmp_path, spark, "polls", [("w", "x", day[1], False)], schema)
    assert run() == set()
    poll(tmp_path, spark, "polls", [("w", "a", day[2], True), ("w", "c", day[2], True)], schema)
    assert run() == {("c", False)}
    assert run() == set()


def test_a_watch_reads_only_its_batch(spark, tmp_path):
    schema = "watch string, link string, polled_at timestamp, ok boolean"
    day = [datetime.datetime(2024, 1, n) for n in range(1, 4)]
    for at in range(3):
        poll(tmp_path, spark, "polls", [("w", f"link-{at}-{n}", day[at], True) for n in range(50)] + [("w", "link-0-1", day[at], True), (f"w{at}", "x", day[at], True)], schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "polls"))
    found = watch.link_watch(stream, home=str(tmp_path / "home"))
    assert found.count() == 153 and found.where("first_poll").count() == 53
    # What a batch looked at again is its own rows: the history is in the state store only.
    batches = spark.read.parquet(str(tmp_path / "home" / "batches"))
    assert [row["count"] for row in batches.groupBy("batch").count().orderBy("batch").collect()] == [53, 52, 52]
    assert (tmp_path / "home" / "progress" / "state").exists() and not (tmp_path / "home" / "seen").exists()


def test_a_change_watch_sees_every_change(spark, tmp_path):
    schema = "page string, at int, body string"

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "polls"))
        found = watch.change_watch(stream, ["page"], F.col("body"), "at", F.floor(F.col("at") / 100), home=str(tmp_path / "home"))
        return [(row["at"], row["change"]) for row in found.orderBy("at").collect()]

    poll(tmp_path, spark, "polls", [("p", 1, "x"), ("p", 2, "y"), ("p", 3, "y")], schema)
    assert run() == [(1, "new"), (2, "changed"), (3, "same")]
    poll(tmp_path, spark, "polls", [("p", 4, "y"), ("p", 5, "x")], schema)
    assert run() == [(4, "same"), (5, "changed")]


def test_cached_asof_within_and_across_slots(spark):
    at = datetime.datetime(2024, 1, 1)
    seconds = lambda n: at + datetime.timedelta(seconds=n)
    asked = spark.createDataFrame([(1, "k", seconds(50)), (2, "k", seconds(130)), (3, "k", seconds(400)), (4, "z", seconds(1))], "request_id int, key string, requested_at timestamp")
    seen = spark.createDataFrame([("k", seconds(10)), ("k", seconds(50)), ("k", seconds(60))], "key string, observed_at timestamp")
    got = {row["request_id"]: row["cached_at"] for row in journal.cached_asof(asked, seen, 100).collect()}
    assert got == {1: seconds(50), 2: seconds(60), 3: None, 4: None}


def test_first_robots_rule_decides(spark):
    pages = spark.createDataFrame([(i, f"https://h.test{path}") for i, path in enumerate(["/a/b", "/a/c", "/x", ""])], "page_id int, url string")
    rules = spark.createDataFrame([("h.test", 1, "/a/b", True), ("h.test", 2, "/a", False), ("o.test", 1, "/", False)], "host string, rule_pos int, prefix string, allow boolean")
    got = {row["page_id"]: row["allow"] for row in joins.robots_allowed(pages, rules, "page_id").collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}


def test_unfilled_holes_close_up(spark):
    anchor = spark.createDataFrame([("q", 1, "u1", "u1", True), ("q", 2, "u2", "u2", False)], "query_id string, slot int, url string, key string, failed boolean")
    others = spark.createDataFrame([], "query_id string, pos int, url string, key string, canonical boolean")
    assert [(row["slot"], row["url"]) for row in search.anchored_answers(anchor, others, 3).collect()] == [(1, "u2")]


def test_fusion_orders_before_rounding(spark):
    rows = [("q", "a", 1, 1, "u1", "s"), ("q", "b", 900, 1, "u2", "s"), ("q", "b", 901, 2, "u2", "t"), ("q", "c", 899, 3, "u3", "s"), ("q", "c", 901, 4, "u3", "t")]
    hits = spark.createDataFrame(rows, "query_id string, k string, rank int, source_pos int, url string, source string")
    merged = search.merge(search.fuse(hits, F.col("k"))).orderBy("place").collect()
    assert [row["page_key"] for row in merged] == ["a", "c", "b"]


def test_empty_marks_nest_to_any_depth(spark):
    deep = "<b><i>" * 6 + " " + "</i></b>" * 6
    pages = spark.createDataFrame([(1, "https://a.test/", f"<main><p>before {deep} after <b>kept {deep}</b></p></main>"), (2, "https://a.test/", "<main><p>no marks at all</p></main>")],
                                  "page_id long, url string, html string")
    got = {row["page_id"]: row["markdown"] for row in blocks.to_markdown(pages).collect()}
    assert got == {1: "before after **kept**\n", 2: "no marks at all\n"}
