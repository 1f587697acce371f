"""Feeds, sitemaps, site graphs, listings, reads and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import fixed, texts, urls
from pagegrain.operators import graph, registries
from pagegrain.plans import duck
from pagegrain.plans.registry import query
from pagegrain.sources import payloads
from pagegrain.sources.tables import with_views
from pagegrain.streaming import watch

SITE = with_views("site_links")
START = "https://www.site.example.com/"


def _feeds(t):
    key = F.col("p_partkey").cast("string")
    day = F.lpad((1 + F.col("p_size") % 28).cast("string"), 2, "0")
    rss = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>x</title><item><title>'), "p_name", F.lit("</title><link>https://a.test/"), key,
                   F.lit("</link><pubDate>Tue, "), day, F.lit(" Mar 2024 03:04:05 GMT</pubDate><description>A &lt;b&gt;"), "p_name", F.lit(
                       "&lt;/b&gt; story</description></item><item><title>Two</title><guid>https://a.test/g/"), key, F.lit("</guid></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>'), "p_name", F.lit('</title><link rel="self" href="https://a.test/self"/><link href="https://a.test/'), key,
                    F.lit('"/><updated>2024-04-'), day, F.lit("T00:00:00Z</updated><summary>Short</summary></entry></feed>"))
    json = F.concat(F.lit('{"items":[{"url":"https://a.test/'), key, F.lit('","title":"'), "p_name", F.lit('","date_published":"2024-05-'), day, F.lit('T01:02:03+02:00"}]}'))
    at = F.col("p_partkey") % 4
    return t.part.select(F.col("p_partkey").alias("feed"), F.when(at == 0, rss).when(at == 1, atom).when(at == 2, json).otherwise("plain text").alias("body"))


_DAY = "lpad(cast(1 + p_size % 28 AS varchar), 2, '0')"


@query("s4_feed_entries", f"""SELECT p_partkey AS feed, 0 AS pos, 'https://a.test/' || p_partkey AS url, p_name AS title, CASE p_partkey % 4 WHEN 0 THEN '2024-03-' || {_DAY} || 'T03:04:05Z'
  WHEN 1 THEN '2024-04-' || {_DAY} || 'T00:00:00Z' ELSE strftime(cast('2024-05-' || {_DAY} || ' 01:02:03' AS timestamp) - interval 2 hour, '%Y-%m-%dT%H:%M:%SZ') END AS published,
  CASE p_partkey % 4 WHEN 0 THEN 'A ' || p_name || ' story' WHEN 1 THEN 'Short' ELSE '' END AS summary FROM part WHERE p_partkey % 4 < 3
UNION ALL SELECT p_partkey, 1, 'https://a.test/g/' || p_partkey, 'Two', NULL, '' FROM part WHERE p_partkey % 4 = 0""")
def s4(t):
    return payloads.feed_entries(_feeds(t))


def _sitemaps(t):
    key = F.col("p_partkey").cast("string")
    day = F.lpad((1 + F.col("p_size") % 28).cast("string"), 2, "0")
    urlset = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"><url><loc> https://a.test/'), key, F.lit(
        "</loc><lastmod>2024-06-"), day, F.lit("</lastmod></url><url><loc>https://a.test/n/"), key, F.lit("</loc><news:news><news:publication_date>2024-07-"), day, F.lit(
            "</news:publication_date><news:title>"), "p_name", F.lit("</news:title></news:news></url></urlset>"))
    index = F.concat(F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>s'), (F.col("p_partkey") * 2 + 1).cast("string"), F.lit("</loc></sitemap><sitemap><loc>s"),
                     (F.col("p_partkey") * 2 + 2).cast("string"), F.lit("</loc></sitemap></sitemapindex>"))
    return t.part.select(F.concat(F.lit("s"), key).alias("sitemap"), urlset.alias("urlset"), index.alias("index"))


@query("s5_sitemap_pages", f"""SELECT 's' || p_partkey AS sitemap, unnest([0, 1]) AS pos, unnest(['https://a.test/' || p_partkey, 'https://a.test/n/' || p_partkey]) AS url, unnest(['', p_name]) AS title,
  unnest(['2024-06-' || {_DAY} || 'T00:00:00Z', '2024-07-' || {_DAY} || 'T00:00:00Z']) AS published FROM part""")
def s5(t):
    return payloads.sitemap_pages(_sitemaps(t).select("sitemap", F.col("urlset").alias("body")))


@query("s6_robots_sitemaps", """SELECT 'https://h' || p_partkey || '.test' AS base, unnest([1, 2]) AS pos, unnest(['https://h' || p_partkey || '.test/sitemap.xml', 'https://b.test/' || p_size || '.xml']) AS sitemap FROM part""")
def s6(t):
    base = F.concat(F.lit("https://h"), F.col("p_partkey").cast("string"), F.lit(".test"))
    body = F.concat(F.lit("User-agent: *\nSitemap: /sitemap.xml\nSITEMAP:  https://b.test/"), F.col("p_size").cast("string"), F.lit(".xml\nsitemap: /sitemap.xml\nDisallow: /x"))
    return payloads.robots_sitemaps(t.part.select(base.alias("base"), body.alias("body")))


@query("s8_payload_hits", """SELECT p_partkey AS payload_id, CASE p_partkey % 5 WHEN 0 THEN 'searxng' WHEN 1 THEN 'bing_rss' WHEN 2 THEN 'hacker_news' WHEN 3 THEN 'github' ELSE 'duckduckgo' END AS source,
  'https://a.test/' || p_partkey AS url, p_name AS title, CASE p_partkey % 5 WHEN 0 THEN '2024-03-01T00:00:00Z' WHEN 2 THEN '2024-03-02T00:00:00Z' WHEN 3 THEN '2024-03-03T00:00:00Z' END AS published FROM part""")
def s8(t):
    key, at = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    link = F.concat(F.lit("https://a.test/"), key)
    searx = F.concat(F.lit('{"results":[{"url":"'), link, F.lit('","title":"'), "p_name", F.lit('","content":"c","publishedDate":"2024-03-01"},{"url":"'), link, F.lit('","title":"again"},{"url":"ftp://x"},{"url":"https://u:p@x.test/"}]}'))
    bing = F.concat(F.lit("<rss><channel><item><title>"), "p_name", F.lit("</title><link>"), link, F.lit("</link><pubDate>Tue, 05 Mar 2024 03:04:05 GMT</pubDate></item></channel></rss>"))
    news = F.concat(F.lit('{"hits":[{"objectID":"1","url":"'), link, F.lit('","title":"'), "p_name", F.lit('","created_at":"2024-03-02T00:00:00Z"}]}'))
    code = F.concat(F.lit('{"items":[{"html_url":"'), link, F.lit('","full_name":"'), "p_name", F.lit('","pushed_at":"2024-03-03T00:00:00Z"},{"html_url":"https://a.test/fork","full_name":"f","fork":true}]}'))
    duck_html = F.concat(F.lit('<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg='), F.url_encode(link), F.lit('&amp;rut=1">'), "p_name", F.lit('</a><a class="result__snippet" href="x">text</a></div>'))
    source = F.when(at == 0, "searxng").when(at == 1, "bing_rss").when(at == 2, "hacker_news").when(at == 3, "github").otherwise("duckduckgo")
    body = F.when(at == 0, searx).when(at == 1, bing).when(at == 2, news).when(at == 3, code).otherwise(duck_html)
    registry = registries.Sources()
    for name, job in payloads.NORMALISERS.items():
        registry.register(name, job)
    rows = payloads.normalise(t.part.select(F.col("p_partkey").alias("payload_id"), source.alias("source"), body.alias("body")), registry.freeze())
    return rows.select("payload_id", "source", "url", "title", "published")


@query("e1_site_map", f"""{SITE}, e AS (SELECT dst AS url, 'page' AS source, 2 AS sp, row_number() OVER (ORDER BY src, dst) AS pos FROM site_links UNION ALL SELECT 'https://www.site.example.com/n/' || n_nationkey, 'sitemap', 1, n_nationkey FROM nation),
k AS (SELECT url AS key, min((sp, source)) AS f FROM e WHERE NOT {duck.like(duck.path('url'), fixed.NOT_PAGES)} GROUP BY 1) SELECT key AS url, f[2] AS source FROM k""".replace("f[2]", "struct_extract(f, 2)"))
def e1(t):
    listed = t.site_links.select(F.col("dst").alias("url"), F.lit("page").alias("source"), F.lit(2).alias("source_pos"), F.xxhash64("src", "dst").alias("pos"))
    maps = t.nation.select(F.concat(F.lit(START + "n/"), F.col("n_nationkey").cast("string")).alias("url"), F.lit("sitemap").alias("source"), F.lit(1).alias("source_pos"), F.col("n_nationkey").cast("bigint").alias("pos"))
    return graph.site_map(maps.unionByName(listed), "site.example.com", chunk=1 << 50).select("url", "source")


@query("e2_except_seen", """SELECT user_id, k FROM (SELECT user_id, event_id % 97 AS k FROM events WHERE ts >= timestamp '2024-01-15') EXCEPT SELECT user_id, event_id % 97 FROM events WHERE ts < timestamp '2024-01-15'""")
def e2(t):
    rows, middle = t.events.withColumn("k", F.col("event_id") % 97), F.lit("2024-01-15").cast("timestamp_ntz")
    late = rows.where(F.col("ts") >= middle).select("user_id", "k").distinct()
    return graph.except_seen(late, rows.where(F.col("ts") < middle), ["user_id", "k"])


@query("e4_crawl", f"""{SITE}, ok AS (SELECT src, dst FROM site_links WHERE NOT contains(dst, '/private/') AND NOT contains(dst, '/x/') AND NOT ends_with(dst, '.jpg')),
l1 AS (SELECT DISTINCT dst AS url FROM ok WHERE src = '{START}'), l2 AS (SELECT DISTINCT dst AS url FROM ok WHERE src IN (SELECT url FROM l1)), l3 AS (SELECT DISTINCT dst AS url FROM ok WHERE src IN (SELECT url FROM l2))
SELECT url, min(depth) AS depth FROM (SELECT '{START}' AS url, 0 AS depth UNION ALL SELECT url, 1 FROM l1 UNION ALL SELECT url, 2 FROM l2 UNION ALL SELECT url, 3 FROM l3) GROUP BY url""")
def e4(t):
    pages, _ = graph.crawl(t.site_links, START, max_depth=3, exclude="/x/", disallowed=["/private/"])
    return pages


@query("e4_crawl_skips", f"""{SITE}, r AS (SELECT DISTINCT dst FROM site_links WHERE src LIKE '%/s/%' AND src IN (SELECT dst FROM site_links WHERE src LIKE '%/n/%'))
SELECT CASE WHEN contains(dst, '/x/') THEN 'filtered' ELSE 'robots' END AS reason, cast(count(*) AS bigint) AS n FROM r WHERE contains(dst, '/x/') OR contains(dst, '/private/') GROUP BY 1""")
def e4_skips(t):
    return graph.crawl(t.site_links, START, max_depth=3, exclude="/x/", disallowed=["/private/"])[1]


def _chain_pages(t):
    chain, at = F.floor(F.col("p_partkey") / 7).cast("bigint"), F.col("p_partkey") % 7
    url = F.concat(F.lit("https://s.test/c/"), chain.cast("string"), F.lit("/"), at.cast("string"))
    after = F.concat(F.lit("https://s.test/c/"), chain.cast("string"), F.lit("/"), (at + 1).cast("string"))
    home = F.concat(F.lit("https://s.test/c/"), chain.cast("string"), F.lit("/0"))
    kind = chain % 4
    upcoming = F.when((at == 6) & (kind == 1), home).when(at == 6, F.lit(None).cast("string")).when((kind == 2) & (at == 3), "https://other.test/x").otherwise(after)
    return t.part.select(chain.alias("chain_id"), at.alias("at"), url.alias("url"), upcoming.alias("next_url"), F.when((kind == 3) & (at == 2), 0).otherwise(5).alias("rows"))


@query("e5_pagination", """WITH c AS (SELECT p_partkey // 7 AS chain_id, count(*) AS n FROM part GROUP BY 1)
SELECT chain_id, cast(CASE WHEN chain_id % 4 = 2 AND n >= 4 THEN 4 WHEN chain_id % 4 = 3 AND n >= 3 THEN 3 WHEN n < 7 THEN n + 1 ELSE 7 END AS integer) AS pages,
  CASE WHEN chain_id % 4 = 2 AND n >= 4 THEN 'invalid_continuation' WHEN chain_id % 4 = 3 AND n >= 3 THEN 'content_mismatch' WHEN n < 7 THEN 'content_mismatch' WHEN chain_id % 4 = 1 THEN 'continuation_cycle' ELSE 'continuation_exhausted' END AS status FROM c""")
def e5(t):
    rows = _chain_pages(t)
    return graph.paginate(rows.where(F.col("at") == 0).select("chain_id", "url"), rows.select("url", "next_url", "rows"), 10)


@query("e6_sitemap_walk", """SELECT 's' || k AS sitemap, cast(floor(log2(k + 1)) AS integer) AS depth FROM (SELECT unnest(range(2 * (SELECT count(*) FROM part) + 1)) AS k)""")
def e6(t):
    children = payloads.sitemap_children(_sitemaps(t).select("sitemap", F.col("index").alias("body")))
    roots = t.part.where(F.col("p_partkey") == 0).select(F.lit("s0").alias("sitemap"))
    return graph.sitemap_walk(children, roots)


@query("o8_child_sitemaps", """WITH c AS (SELECT p_size AS sitemap, CASE p_partkey % 3 WHEN 0 THEN 'news-' WHEN 1 THEN 'map-' ELSE 'posts-' END || (2000 + p_partkey % 25) || '-' || p_partkey AS child, CASE WHEN p_partkey % 2 = 0 THEN '2024-01-' || lpad(cast(1 + p_partkey % 28 AS varchar), 2, '0') END AS published FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY sitemap ORDER BY regexp_matches(child, 'news|post|article|blog|latest|recent') DESC, coalesce(published, '') DESC,
  list_max(list_transform(regexp_extract_all(child, '20[0-9][0-9][-_/]?(?:[0-9][0-9])?'), lambda x: regexp_replace(x, '[-_/]', '', 'g'))) DESC, child) AS rank FROM c)
SELECT sitemap, child, cast(rank AS integer) AS rank FROM r""")
def o8(t):
    at, key = F.col("p_partkey") % 3, F.col("p_partkey")
    child = F.concat(F.when(at == 0, "news-").when(at == 1, "map-").otherwise("posts-"), (key % 25 + 2000).cast("string"), F.lit("-"), key.cast("string"))
    published = F.when(key % 2 == 0, F.concat(F.lit("2024-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0")))
    return graph.pick_child_sitemaps(t.part.select(F.col("p_size").alias("sitemap"), child.alias("child"), published.alias("published"))).select("sitemap", "child", "rank")


@query("o9_rank_by_words", f"""{with_views('urls')}, h AS (SELECT url_id, url, contains(lower(url), 'news')::int + contains(lower(url), 'click')::int AS hits FROM urls)
SELECT url_id, hits, cast(row_number() OVER (ORDER BY -hits, url_id) AS bigint) AS rank FROM h WHERE hits > 0""")
def o9(t):
    return graph.rank_by_words(t.urls.withColumn("pos", F.col("url_id")), ["news", "click"]).select("url_id", "hits", "rank")


@query("o14_newest_entries", """WITH r AS (SELECT user_id AS site, event_id AS url, CASE WHEN event_type <> 'view' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS published FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY published DESC NULLS LAST, url) AS rank FROM r) SELECT site, url, cast(rank AS integer) AS rank FROM n""")
def o14(t):
    return graph.newest_entries(_entries(t))[0].select("site", "url", "rank")


@query("o14_entry_overflow", """SELECT user_id AS site, count(*) AS entries, greatest(count(*) - 50, 0) AS more FROM events GROUP BY 1""")
def o14_overflow(t):
    return graph.newest_entries(_entries(t), cap=50)[1]


def _entries(t):
    return t.events.select(F.col("user_id").alias("site"), F.col("event_id").alias("url"), F.when(F.col("event_type") != "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("published"))


@query("w4_listing_ledger", """WITH c AS (SELECT l_suppkey AS chain_id, l_linenumber AS page_number, l_partkey, count(*) AS copies FROM lineitem GROUP BY ALL), f AS (SELECT *, min(page_number) OVER (PARTITION BY chain_id, l_partkey) AS fp FROM c),
p AS (SELECT chain_id, page_number, sum(copies) AS raw_count, count(*) FILTER (fp = page_number) AS new_count FROM f GROUP BY 1, 2)
SELECT chain_id, page_number, cast(raw_count AS bigint) AS raw_count, cast(new_count AS bigint) AS new_count, cast(raw_count - new_count AS bigint) AS overlap_count,
  cast(sum(new_count) OVER (PARTITION BY chain_id ORDER BY page_number) AS bigint) AS unique_total FROM p""")
def w4(t):
    return graph.listing_ledger(t.lineitem.select(F.col("l_suppkey").alias("chain_id"), F.col("l_linenumber").alias("page_number"), F.col("l_partkey").alias("listing_id")))


@query("w8_best_read", """SELECT user_id AS url, cast(arg_max(event_id, (round(value), -event_id)) AS bigint) AS step, max(round(value)) AS score FROM events GROUP BY user_id""")
def w8(t):
    return graph.best_read(t.events.select(F.col("user_id").alias("url"), F.col("event_id").alias("step"), F.round("value").alias("score")))


@query("w9_until_agreement", """WITH r AS (SELECT user_id AS url, event_id AS step, event_id % 4 AS links, 100 + event_id % 60 AS chars, event_type <> 'view' AS renders FROM events),
f AS (SELECT url, min(step) AS s0, arg_min(links, step) AS l0, arg_min(chars, step) AS c0 FROM r GROUP BY url),
a AS (SELECT r.*, renders AND step > s0 AND abs(links - l0) <= 1 AND abs(chars - c0) <= 0.2 * greatest(chars, c0, 1) AS agrees FROM r JOIN f USING (url)),
b AS (SELECT *, coalesce(sum(agrees::int) OVER (PARTITION BY url ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a) SELECT url, step, agrees FROM b WHERE before < 2""")
def w9(t):
    rows = t.events.select(F.col("user_id").alias("url"), F.col("event_id").alias("step"), (F.col("event_id") % 4).alias("links"), (F.col("event_id") % 60 + 100).alias("chars"),
                           (F.col("event_type") != "view").alias("renders"))
    return graph.until_agreement(rows).select("url", "step", "agrees")


@query("w10_second_opinion", """SELECT event_id AS url, CASE WHEN value * 20 >= greatest(value * 9 * 1.5, value * 9 + 1000) OR (value * 20 >= value * 9 AND user_id % 30 >= greatest(event_id % 12 * 2, event_id % 12 + 10)) THEN 'rendered' ELSE 'plain' END AS keep FROM events""")
def w10(t):
    pairs = t.events.select(F.col("event_id").alias("url"), (F.col("value") * 9).alias("chars"), (F.col("event_id") % 12).alias("prices"), (F.col("value") * 20).alias("rendered_chars"),
                            (F.col("user_id") % 30).alias("rendered_prices"))
    return graph.second_opinion(pairs).select("url", "keep")


# ---- watches and streams -------------------------------------------------------------------
def _stream(t, name: str):
    schema = t.base(name).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)


@query("r1_link_watch", """SELECT user_id AS watch, 'https://w.test/' || event_type || '/' || (event_id % 40) AS link, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS polled_at,
  min(ts) = min(min(ts)) OVER (PARTITION BY user_id) AS first_poll FROM events WHERE event_id % 9 <> 0 GROUP BY 1, 2""")
def r1(t):
    link = F.concat(F.lit("https://w.test/"), "event_type", F.lit("/"), (F.col("event_id") % 40).cast("string"))
    rows = _stream(t, "events").select(F.col("user_id").alias("watch"), link.alias("link"), F.col("ts").alias("polled_at"), (F.col("event_id") % 9 != 0).alias("ok"))
    return watch.link_watch(rows).select("watch", "link", F.date_format("polled_at", "yyyy-MM-dd HH:mm:ss").alias("polled_at"), "first_poll")


@query("r2_site_watch", """SELECT user_id AS site, 'w.test/' || event_type || '/' || (event_id % 40) AS page FROM events GROUP BY 1, 2 HAVING max(CASE WHEN event_id % 3 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END) <> ''""")
def r2(t):
    url = F.concat(F.lit("https://www.w.test/"), "event_type", F.lit("/"), (F.col("event_id") % 40).cast("string"), F.lit("/?utm_source=x"))
    rows = _stream(t, "events").select(F.col("user_id").alias("site"), url.alias("url"), F.lit("A title").alias("title"), F.when(F.col("event_id") % 3 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("published"),
                                       F.when(F.col("event_id") % 2 == 0, "feed").otherwise("sitemap").alias("source"))
    return watch.site_watch(rows, urls.page_key("url")).select("site", "page")


@query("r3_story_dedupe", """SELECT DISTINCT event_type || ' story number ' || (event_id % 50) AS story FROM events""")
def r3(t):
    story = F.concat("event_type", F.lit(" story number "), (F.col("event_id") % 50).cast("string"))
    rows = _stream(t, "events").select(story.alias("title"), F.col("ts").cast("timestamp").alias("at"))
    return watch.drain(watch.story_dedupe(rows, "at", texts.story_key(F.col("title")), "60 days"), "story-dedupe").select("story")


@query("r4_change_tracking", """SELECT user_id, event_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN 'new' WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 'same' ELSE 'changed' END AS change FROM events""")
def r4(t):
    found = graph.change_tracking(t.events, ["user_id"], "event_id", F.col("event_type"), F.floor(F.col("event_id") / 100_000))
    return found.select("user_id", "event_id", "change")


@query("r4_change_stream", """SELECT user_id, event_id, CASE WHEN lag(event_type) OVER w IS NULL THEN 'new' WHEN lag(event_type) OVER w = event_type THEN 'same' ELSE 'changed' END AS change
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def r4_stream(t):
    return watch.change_watch(_stream(t, "events"), ["user_id"], F.col("event_type"), "event_id", F.floor(F.col("event_id") / 100_000)).select("user_id", "event_id", "change")


@query("r5_duplicate_content", """WITH d AS (SELECT doc_id, source, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS fp FROM documents) SELECT doc_id, doc_id > min(doc_id) OVER (PARTITION BY source, fp) AS duplicate FROM d""")
def r5(t):
    return graph.duplicate_content(t.documents, texts.fingerprint(F.col("text")), ["source"], "doc_id").select("doc_id", "duplicate")


@query("r6_on_time", """SELECT event_id FROM events WHERE ts <= timestamp '2024-01-20' AND ts >= timestamp '2023-12-21'""")
def r6(t):
    rows = _stream(t, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return watch.drain(watch.on_time(rows, "at", "30 days", F.lit("2024-01-20").cast("timestamp")), "on-time").select("event_id")


@query("r7_running_tools", """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS provider, cast(count(*) AS bigint) AS tries, cast(count(*) FILTER (value > 20) AS bigint) AS wins FROM events GROUP BY 1, 2""")
def r7(t):
    rows = _stream(t, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("provider"), F.when(F.col("value") > 20, "observed").otherwise("failed").alias("outcome"))
    counts = watch.drain(watch.running_tool_counts(rows, "at"), "tool-counts", mode="update")
    last = counts.groupBy("w", "provider").agg(F.max_by(F.struct("tries", "wins"), "batch").alias("c"))
    return last.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "provider", "c.tries", "c.wins")


@query("r8_unchanged_skipped", """SELECT DISTINCT user_id AS url, event_type AS etag FROM events""")
def r8(t):
    rows = _stream(t, "events").select(F.col("user_id").alias("url"), F.col("event_type").alias("etag"))
    return watch.drain(watch.unchanged_skipped(rows, ["url", "etag"]), "unchanged").select("url", "etag")
