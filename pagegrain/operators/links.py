"""Link tables: anchors, page links, item links, result groups and images, described items, link text share.

A page's anchors come from its one row, so everything per page stays as large as a page; duplicates are dropped with
aggregates that combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions import fixed, urls
from pagegrain.functions.columns import c, each, find, find_all, squeeze, unescape

ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)')[^>]*>(.*?)</a\s*>"""
MD_ANCHOR = r"\[([^\]]*)\]\((https?://[^)\s#]+|/[^)\s#]*)"
_ALT = r"""(?is)<img\b[^>]*?\balt\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_LABELS = r"""(?i)\b(?:title|aria-label|alt)\s*=\s*["']([^"']*)["']"""


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]+>", " ")


def attribute(tag: Column, name: str) -> Column:
    """An attribute of a tag, however it is quoted; empty when it has none."""
    pattern = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    return F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))


def anchors(pages: DataFrame, markdown: bool = False) -> DataFrame:
    """One row per anchor of ``pages(page_id, url, html)``: page_id, base, pos, raw (the whole tag), href, inner."""
    cols = [F.col("page_id"), F.col("url").alias("base")]
    rows = pages.select(*cols, F.posexplode(find_all(F.col("html"), ANCHOR, 0)).alias("pos", "raw"))
    rows = rows.select("page_id", "base", "pos", "raw",
                       F.concat(F.regexp_extract("raw", ANCHOR, 1), F.regexp_extract("raw", ANCHOR, 2)).alias("href"),
                       F.regexp_extract("raw", ANCHOR, 3).alias("inner"))
    if markdown:
        found = pages.select(*cols, F.posexplode(find_all(F.col("html"), MD_ANCHOR, 0)).alias("pos", "raw"))
        rows = rows.unionByName(found.select(
            "page_id", "base", (F.col("pos") + 1_000_000).alias("pos"), "raw",
            F.regexp_extract("raw", MD_ANCHOR, 2).alias("href"), F.regexp_extract("raw", MD_ANCHOR, 1).alias("inner")))
    return rows


def anchor_text(inner: Column) -> Column:
    text = squeeze(unescape(strip_tags(inner)))
    alt = squeeze(unescape(F.concat(F.regexp_extract(inner, _ALT, 1), F.regexp_extract(inner, _ALT, 2))))
    return F.when(text != "", text).otherwise(alt)


def page_links(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Every http(s) link of a page once, absolute, without fragment, in page order: page_id, pos, link, text."""
    found = anchors(pages).select("page_id", "base", "pos", "inner", F.regexp_replace(
        urls.resolve("base", unescape(F.col("href"))), "#.*$", "").alias("link"))
    found = found.where(F.col("link").rlike(r"^https?://"))
    first = found.groupBy("page_id", "base", "link").agg(F.min("pos").alias("pos"),
                                                         F.min_by("inner", "pos").alias("inner"))
    first = first.select("page_id", "base", "pos", "link", anchor_text(F.col("inner")).alias("text"))
    if limit is not None:
        order = Window.partitionBy("page_id").orderBy("pos")
        first = first.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).drop("rn")
    return first


def _resolved(rows: DataFrame) -> DataFrame:
    """Same-site anchors with their path."""
    found = rows.withColumn("link", urls.resolve("base", F.replace(
        F.regexp_replace("href", "#.*$", ""), F.lit("&amp;"), F.lit("&"))))
    found = found.withColumn("path", urls.path("link"))
    return found.where((F.col("href") != "") & ~F.col("href").startswith("#") & F.col("link").rlike(r"^https?://")
                       & urls.same_site(urls.host("link"), urls.host("base")))


def item_link_counts(pages: DataFrame) -> DataFrame:
    """Distinct same-site links that look like items, per page that has any."""
    items = _resolved(anchors(pages, markdown=True)).where((F.col("path") != urls.path("base")) & urls.item_like(F.col("path")))
    return items.groupBy("page_id").agg(F.countDistinct(urls.rtrim_slash(F.col("path"))).alias("item_links"))


def item_blobs(pages: DataFrame) -> DataFrame:
    """Each item link of a page with the lower-case text that describes it, over every anchor that names it."""
    items = _resolved(anchors(pages, markdown=True)).where((F.col("path") != urls.path("base")) & urls.item_like(F.col("path")))
    labels = F.array_join(find_all(F.col("raw"), _LABELS, 1), " ")
    text = F.lower(unescape(F.concat_ws(" ", strip_tags(F.col("inner")), labels, F.col("path"))))
    rows = items.select("page_id", urls.rtrim_slash(F.col("path")).alias("item"), "pos", text.alias("text"))
    told = rows.groupBy("page_id", "item").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    return told.select("page_id", "item", squeeze(F.array_join(each(F.col("parts"), lambda part: part["text"]), " "))
                       .alias("blob"))


def result_groups(pages: DataFrame, terms: Column) -> DataFrame:
    """The largest set of eight or more links under one path shape of which a third or more name the query.

    ``terms`` is an array column over ``pages``; pages without terms have no group.
    """
    return result_groups_of(anchors(pages, markdown=True), pages.select("page_id", terms.alias("terms")))


def result_groups_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``result_groups`` over anchor rows and ``asked(page_id, terms)``."""
    found = _resolved(rows).withColumn("trimmed", urls.rtrim_slash(F.col("path")))
    found = found.where((F.col("trimmed") != "") & (F.col("trimmed") != urls.rtrim_slash(urls.path("base")))
                        & ~F.col("trimmed").rlike(fixed.NOT_ITEM) & F.regexp_replace("trimmed", "^/+|/+$", "").contains("/"))
    prefix = F.regexp_replace("trimmed", "/[^/]*$", "")
    leaf = F.regexp_extract("trimmed", "([^/]*)$", 1)
    text = F.lower(unescape(F.concat(strip_tags(F.col("inner")), F.lit(" "), leaf)))
    rows = (found.join(asked, "page_id").where(F.size("terms") > 0)
            .select("page_id", urls.prefix_shape(prefix).alias("shape"), "trimmed",
                    F.exists("terms", lambda term: F.contains(text, term)).alias("named")))
    leaves = rows.groupBy("page_id", "shape", "trimmed").agg(F.max("named").alias("named"))
    groups = leaves.groupBy("page_id", "shape").agg(F.count(F.lit(1)).alias("leaves"), F.count_if("named").alias("named"))
    good = groups.where((F.col("leaves") >= 8) & (F.col("named") >= F.greatest(F.lit(3), F.col("leaves") / 3)))
    return good.groupBy("page_id").agg(F.max("leaves").alias("result_group"))


def result_images(pages: DataFrame, terms: Column) -> DataFrame:
    """Distinct images whose alt text or file name says the query, counted from eight up."""
    rows = pages.select("page_id", F.col("url").alias("base"), terms.alias("terms"),
                        F.explode(find_all(F.col("html"), r"(?i)<img\b[^>]*>", 0)).alias("tag"))
    # One projection per step and no filter between them, so that a path is worked out once per tag and not once per term.
    rows = rows.select("page_id", "base", "terms", attribute(F.col("tag"), "alt").alias("alt"), attribute(F.col("tag"), "src").alias("src"))
    rows = rows.select("page_id", "terms", "alt", "src", urls.path(urls.resolve("base", F.replace("src", F.lit("&amp;"), F.lit("&")))).alias("path"))
    said = F.lower(F.concat_ws(" ", unescape(F.col("alt")), F.replace(F.regexp_extract("path", "([^/]*)$", 1), F.lit("_"),
                                                                      F.lit(" "))))
    named = (F.col("src") != "") & F.exists(F.array(said), lambda text: F.exists("terms", lambda term: F.contains(text, term)))
    counts = rows.select("page_id", F.when(named, F.col("path")).alias("path")).groupBy("page_id").agg(F.countDistinct("path").alias("result_images"))
    return counts.where(F.col("result_images") >= 8)


def link_text_chars(html: Column) -> Column:
    """How many characters of a page's text sit inside links."""
    inners = each(find_all(html, ANCHOR, 3), lambda inner: F.length(squeeze(strip_tags(inner))))
    return F.aggregate(inners, F.lit(0), lambda total, size: total + size)


def link_text_share(html: Column, text: Column) -> Column:
    share = link_text_chars(html) / F.greatest(F.length(squeeze(text)), F.lit(1))
    return F.when(F.length(text) > 0, F.least(share, F.lit(1.0))).otherwise(F.lit(0.0))
