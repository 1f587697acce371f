"""Payload bodies as tables: NDJSON records, feeds, sitemaps, robots lines and search payloads of eleven shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions import texts, urls
from pagegrain.functions.columns import squeeze, unescape


def ndjson_records(bodies: DataFrame) -> DataFrame:
    """Records of newline-delimited JSON ``bodies(page_id, body)``: only when two or more lines are filled and every one parses."""
    lines = F.filter(F.split("body", r"\r?\n"), lambda line: F.trim(line) != "")
    rows = bodies.select("page_id", F.transform(lines, lambda line: F.try_parse_json(line)).alias("records"))
    good = (F.size("records") >= 2) & F.forall("records", lambda record: record.isNotNull())
    return rows.where(good).select("page_id", F.posexplode("records").alias("pos", "record"))


def _iso(text) -> Column:
    return F.date_format(texts.lenient_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _plain(text: Column) -> Column:
    return squeeze(unescape(F.regexp_replace(unescape(F.coalesce(text, F.lit(""))), r"<[^>]+>", " ")))


# ---- feeds and sitemaps --------------------------------------------------------
_XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
_RSS_ITEM = "struct<title:string,link:string,guid:string,pubDate:string,date:string,description:string>"
_RSS = f"channel struct<item:array<{_RSS_ITEM}>>, item array<{_RSS_ITEM}>"
_ATOM = ("entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string,summary:string,content:string,id:string>>")
_JSON_FEED = ("items array<struct<url:string,external_url:string,title:string,date_published:string,date_modified:string,summary:string,"
              "content_text:string,content_html:string>>")


def feed_entries(bodies: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries of RSS, RDF, Atom and JSON feeds ``bodies(feed, body)``: feed, pos, url, title, published, summary."""
    text = F.regexp_replace("body", r"^[﻿ \t\r\n]+", "")
    rows = bodies.withColumn("body", text)
    kind = F.when(F.col("body").startswith("{"), "json").when(F.col("body").rlike(r"<feed[\s>]"), "atom").when(F.col("body").rlike(r"<(?:rss|rdf:RDF|RDF)[\s>]"), "rss")
    rows = rows.withColumn("kind", kind)

    def shaped(entries, url, title, published, summary):
        out = entries.select("feed", "pos", url.alias("url"), F.trim(F.coalesce(title, F.lit(""))).alias("title"), _iso(published).alias("published"),
                             _plain(summary).alias("summary"))
        return out if limit is None else out.where(F.col("pos") < limit)

    rss = rows.where(F.col("kind") == "rss").withColumn("x", F.from_xml("body", _RSS, _XML)).select(
        "feed", F.posexplode(F.coalesce("x.channel.item", "x.item")).alias("pos", "e"))
    guid = F.when(F.col("e.guid").startswith("http"), F.col("e.guid"))
    rss = shaped(rss, F.trim(F.coalesce(F.when(F.col("e.link") != "", F.col("e.link")), guid, F.lit(""))), F.col("e.title"), F.coalesce("e.pubDate", "e.date"), F.col("e.description"))
    atom = rows.where(F.col("kind") == "atom").withColumn("x", F.from_xml("body", _ATOM, _XML)).select("feed", F.posexplode("x.entry").alias("pos", "e"))
    link = F.try_element_at(F.filter("e.link", lambda item: F.coalesce(item["_rel"], F.lit("alternate")) == "alternate"), F.lit(1))["_href"]
    atom = shaped(atom, link, F.col("e.title"), F.coalesce("e.published", "e.updated"), F.coalesce("e.summary", "e.content"))
    told = rows.where(F.col("kind") == "json").select("feed", F.posexplode(F.from_json("body", _JSON_FEED)["items"]).alias("pos", "e"))
    told = shaped(told, F.coalesce("e.url", "e.external_url"), F.col("e.title"), F.coalesce("e.date_published", "e.date_modified"),
                  F.coalesce("e.summary", "e.content_text", "e.content_html"))
    return rss.unionByName(atom).unionByName(told)


_URLSET = "url array<struct<loc:string,lastmod:string,news:struct<publication_date:string,title:string>>>"
_INDEX = "sitemap array<struct<loc:string,lastmod:string>>"


def sitemap_pages(bodies: DataFrame, limit: int | None = None) -> DataFrame:
    """Pages of urlset sitemaps ``bodies(sitemap, body)``: sitemap, pos, url, title, published (a news date before lastmod)."""
    rows = bodies.where(F.col("body").contains("<urlset")).select("sitemap", F.posexplode(F.from_xml("body", _URLSET, _XML)["url"]).alias("pos", "e"))
    rows = rows if limit is None else rows.where(F.col("pos") < limit)
    return rows.select("sitemap", "pos", F.trim("e.loc").alias("url"), F.trim(F.coalesce("e.news.title", F.lit(""))).alias("title"),
                                                   _iso(F.coalesce("e.news.publication_date", "e.lastmod")).alias("published"))


def sitemap_children(bodies: DataFrame) -> DataFrame:
    """Children of sitemap indexes: sitemap, pos, child, published."""
    rows = bodies.where(F.col("body").contains("<sitemapindex")).select("sitemap", F.posexplode(F.from_xml("body", _INDEX, _XML)["sitemap"]).alias("pos", "e"))
    return rows.select("sitemap", "pos", F.trim("e.loc").alias("child"), _iso("e.lastmod").alias("published"))


def robots_sitemaps(bodies: DataFrame, limit: int | None = None) -> DataFrame:
    """Sitemaps that robots files ``bodies(base, body)`` name, absolute and once each, the first ``limit`` per file if given: base, pos, sitemap."""
    rows = bodies.select("base", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line")).where(F.lower("line").startswith("sitemap:"))
    rows = rows.select("base", "pos", urls.resolve("base", F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))).alias("sitemap"))
    first = rows.where(F.col("sitemap").rlike("^https?://")).groupBy("base", "sitemap").agg(F.min("pos").alias("pos"))
    if limit is None:
        return first
    order = Window.partitionBy("base").orderBy("pos")
    return first.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).drop("rn")


# ---- search payloads ---------------------------------------------------------------
def _hits(rows: DataFrame, url, title, snippet, engine, published, indexed=None) -> DataFrame:
    return rows.select("payload_id", "source", "pos", url.alias("url"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(snippet, F.lit("")).alias("snippet"),
                       F.array(F.lit(engine)).alias("engines"), published.alias("published"), (indexed if indexed is not None else published).alias("indexed_date"))


def _json(payloads: DataFrame, path: str, schema: str) -> DataFrame:
    root = f"struct<{path}:array<{schema}>>" if "." not in path else "struct<{0}:struct<{1}:array<{2}>>>".format(*path.split("."), schema)
    value = F.from_json("body", root)
    for part in path.split("."):
        value = value[part]
    return payloads.select("payload_id", "source", F.posexplode(value).alias("pos", "e"))


def _none() -> Column:
    return F.lit(None).cast("string")


def searxng(p):
    rows = _json(p, "results", "struct<url:string,title:string,content:string,publishedDate:string,engine:string>")
    return _hits(rows, F.col("e.url"), F.col("e.title"), F.col("e.content"), "searxng", _iso("e.publishedDate"))


def _rss_items(p):
    return p.select("payload_id", "source", F.posexplode(F.from_xml("body", _RSS, _XML)["channel"]["item"]).alias("pos", "e"))


def bing_rss(p):
    """Web results carry the crawl time as their date, so it is kept as the index date only."""
    return _hits(_rss_items(p), F.col("e.link"), F.col("e.title"), F.col("e.description"), "bing", _none(), _iso("e.pubDate"))


def bing_news_rss(p):
    rows = _rss_items(p)
    target = F.try_url_decode(F.regexp_extract("e.link", r"[?&]url=([^&]*)", 1))
    link = F.when(F.col("e.link").contains("apiclick") & (target != ""), target).otherwise(F.col("e.link"))
    return _hits(rows, link, F.col("e.title"), F.col("e.description"), "bing_news", _iso("e.pubDate"))


def google_news_rss(p):
    schema = "channel struct<item:array<struct<title:string,link:string,pubDate:string,description:string,source:struct<_VALUE:string,_url:string>>>>"
    rows = p.select("payload_id", "source", F.posexplode(F.from_xml("body", schema, _XML)["channel"]["item"]).alias("pos", "e"))
    tail = F.concat(F.lit(" - "), F.trim("e.source._VALUE"))
    title = F.when(F.endswith(F.col("e.title"), tail), F.substring(F.col("e.title"), F.lit(1), F.length("e.title") - F.length(tail))).otherwise(F.col("e.title"))
    return _hits(rows, F.col("e.link"), title, _plain(F.col("e.description")), "google_news", _iso("e.pubDate"))


def wikipedia(p):
    rows = _json(p, "query.search", "struct<title:string,snippet:string,timestamp:string>").where(F.col("e.title").isNotNull())
    page = F.replace(F.url_encode(F.replace("e.title", F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))
    return _hits(rows, F.concat(F.lit("https://en.wikipedia.org/wiki/"), page), F.col("e.title"), _plain(F.col("e.snippet")), "wikipedia", _none(), _iso("e.timestamp"))


def hacker_news(p):
    rows = _json(p, "hits", "struct<objectID:string,url:string,title:string,story_text:string,created_at:string>").where(F.col("e.objectID").isNotNull())
    talk = F.concat(F.lit("https://news.ycombinator.com/item?id="), "e.objectID")
    return _hits(rows, F.coalesce("e.url", talk), F.col("e.title"), _plain(F.col("e.story_text")), "hacker_news", _iso("e.created_at"))


def stack_exchange(p):
    rows = _json(p, "items", "struct<link:string,title:string,tags:array<string>,creation_date:string,last_activity_date:string>").where(F.col("e.link").isNotNull())
    return _hits(rows, F.col("e.link"), _plain(F.col("e.title")), F.array_join("e.tags", " "), "stack_exchange", _iso("e.creation_date"), _iso("e.last_activity_date"))


def github(p):
    """Forks and archived repositories are never the project people mean."""
    rows = _json(p, "items", "struct<html_url:string,full_name:string,description:string,pushed_at:string,created_at:string,fork:boolean,archived:boolean>")
    rows = rows.where(F.col("e.html_url").isNotNull() & ~F.coalesce("e.fork", F.lit(False)) & ~F.coalesce("e.archived", F.lit(False)))
    return _hits(rows, F.col("e.html_url"), F.col("e.full_name"), F.col("e.description"), "github", _iso(F.coalesce("e.pushed_at", "e.created_at")))


def arxiv(p):
    rows = p.select("payload_id", "source", F.posexplode(F.from_xml("body", _ATOM, _XML)["entry"]).alias("pos", "e"))
    return _hits(rows, F.trim("e.id"), squeeze(F.col("e.title")), squeeze(F.col("e.summary")), "arxiv", _iso("e.published"))


def open_library(p):
    rows = _json(p, "docs", "struct<key:string,title:string,author_name:array<string>,first_publish_year:int>").where(F.col("e.key").startswith("/"))
    note = F.concat_ws(" · ", F.array_join("e.author_name", ", "), F.col("e.first_publish_year").cast("string"))
    return _hits(rows, F.concat(F.lit("https://openlibrary.org"), "e.key"), F.col("e.title"), note, "open_library", _none())


def duckduckgo(p):
    block = r'(?is)<a\b[^>]*class="[^"]*result__a[^"]*"[^>]*href="([^"]*)"[^>]*>(.*?)</a>(?:.*?class="[^"]*result__snippet[^"]*"[^>]*>(.*?)</)?'
    rows = p.select("payload_id", "source", F.posexplode(F.regexp_extract_all("body", F.lit(block), F.lit(0))).alias("pos", "raw"))
    href = unescape(F.regexp_extract("raw", block, 1))
    target = F.try_url_decode(F.regexp_extract(href, r"[?&]uddg=([^&]*)", 1))
    return _hits(rows, F.when(target != "", target).otherwise(urls.resolve(F.lit("https://html.duckduckgo.com/"), href)), _plain(F.regexp_extract("raw", block, 2)),
                 _plain(F.regexp_extract("raw", block, 3)), "duckduckgo", _none())


NORMALISERS = {"searxng": searxng, "bing_rss": bing_rss, "bing_news_rss": bing_news_rss, "google_news_rss": google_news_rss, "wikipedia": wikipedia,
               "hacker_news": hacker_news, "stack_exchange": stack_exchange, "github": github, "arxiv": arxiv, "open_library": open_library,
               "duckduckgo": duckduckgo}


def normalise(payloads: DataFrame, sources) -> DataFrame:
    """Raw search payloads ``payloads(payload_id, source, body)`` as hits, by a registry of normalisers: only http(s) URLs without
    credentials, each once per payload. ``pos`` is the hit's place in its payload."""
    rows = sources.normalise(payloads)
    rows = rows.where(F.col("url").rlike(r"^https?://[^/?#@]+(?:[/?#]|$)"))
    columns = [name for name in rows.columns if name not in ("payload_id", "url")]
    first = rows.groupBy("payload_id", "url").agg(F.min_by(F.struct(*columns), "pos").alias("h"))
    return first.select("payload_id", "url", "h.*")
