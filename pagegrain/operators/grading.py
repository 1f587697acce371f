"""Page grading: walls, error pages, placeholders, completeness verdicts and quality grades, as wide selects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import fixed, texts, urls
from pagegrain.functions.columns import contains_any, count_of, each, find, find_all, first_of, opening, squeeze, words_in
from pagegrain.operators import blocks, links
from pagegrain.session import cut
from pagegrain.sources import pages as scans


def _title_parts(title: Column, pattern: str) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"^[# ]+", ""))
    parts = each(F.split(plain, pattern), lambda part: F.regexp_replace(part, r"^[ .!]+|[ .!]+$", ""))
    return F.concat(F.array(plain), parts)


def challenge(title: Column, text: Column) -> Column:
    """A bot wall's interstitial: a title part it uses, or a short page with its words."""
    parts = _title_parts(title, r"\s*[|\-–—:/]\s+|\s+[|\-–—/]\s*")
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.arrays_overlap(parts, words_in(fixed.CHALLENGE_TITLES)) | (
        (F.length(low) < 3000) & contains_any(low, fixed.CHALLENGE_PHRASES))


def login_wall(title: Column, text: Column, requested, within: int | None = None) -> Column:
    """A site's login form standing in for the page asked for; its words are looked for in the whole text, or ``within`` its first characters."""
    plain = F.trim(F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"^[# ]+", ""))
    parts = F.concat(F.array(plain), each(F.split(plain, r"\s+[|\-–—:]\s+"), lambda part: F.regexp_replace(part, r"^[ .!]+|[ .!]+$", "")))
    titled = F.exists(parts, lambda part: part.rlike(fixed.LOGIN_TITLE))
    body = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    brand = F.split_part(F.regexp_replace(urls.bare_host(requested), r"^m\.", ""), F.lit("."), F.lit(1))
    deep = F.regexp_replace(urls.path(requested), "^/+|/+$", "") != ""
    form = ((F.length(body) < 6000) & opening(body, within).contains("password") & deep & (brand != "")
            & (F.lower(plain) == brand) & contains_any(opening(body, within), fixed.LOGIN_WORDS))
    return titled | form


def _site_core(name: Column) -> Column:
    labels = F.split(F.lower(name), r"\.")
    return F.when(F.size(labels) > 2, F.array_join(F.slice(labels, 2, F.greatest(F.size(labels), F.lit(1))), ".")).otherwise(F.lower(name))


def wall(title: Column, text: Column, requested, final) -> Column:
    """Which wall came back instead of the page, if any; the first rule that holds names it."""
    short = F.trim(F.coalesce(text, F.lit("")))
    asked_path, final_path = urls.path(requested), urls.path(final)
    moved = (urls.host(final) != "") & (F.concat(urls.host(final), final_path) != F.concat(urls.host(requested), asked_path))
    visible = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r'\]\([^)\s]*(?:\s+"[^"]*")?\)', "]"))
    signs = F.concat(F.split_part(urls.host(final), F.lit("."), F.lit(1)), F.lit("/"), final_path)
    home = final_path.rlike(fixed.HOME_ALIASES) & ~asked_path.rlike(fixed.HOME_ALIASES) & (
        _site_core(urls.host(requested)) == _site_core(urls.host(final)))
    return first_of([
        (challenge(title, text), "CAPTCHA"),
        ((F.length(short) < 2000) & (short.rlike(fixed.BROWSER_ERROR) | short.rlike(fixed.MAINTENANCE)), "PROVIDER_DOWN"),
        (moved & final_path.rlike(fixed.BOT_PAGE_PATH) & ~asked_path.rlike(fixed.BOT_PAGE_PATH), "CAPTCHA"),
        (moved & signs.rlike(fixed.SIGN_IN_PATH) & ~asked_path.rlike(fixed.SIGN_IN_PATH), "AUTH_REQUIRED"),
        ((F.length(visible) < 2500) & contains_any(F.lower(visible), fixed.SIGN_IN_PHRASES), "AUTH_REQUIRED"),
        (~asked_path.rlike(fixed.SIGN_IN_PATH) & login_wall(title, text, requested), "AUTH_REQUIRED"),
        (moved & home, "CONTENT_MISMATCH")])


def site_error(title: Column, text: Column, requested, final) -> Column:
    """A site's own error or not-found page that came back as a page."""
    asked_path, final_path = urls.path(requested), urls.path(final)
    moved = (urls.host(final) != "") & (F.concat(urls.host(final), final_path) != F.concat(urls.host(requested), asked_path))
    body = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    parts = F.slice(_title_parts(title, r"\s+[|\-–—:]\s+"), 2, 1_000)
    return ((moved & final_path.rlike(fixed.ERROR_PAGE_PATH) & ~asked_path.rlike(fixed.ERROR_PAGE_PATH))
            | ((F.length(body) < 20_000) & F.arrays_overlap(parts, words_in(fixed.ERROR_TITLES)))
            | F.arrays_overlap(parts, words_in(fixed.NOT_FOUND_TITLES))
            | ((F.length(body) < 4_000) & contains_any(body, fixed.ERROR_PHRASES)))


def nothing_on_page(text: Column, content: Column, has_data: Column) -> Column:
    low = F.lower(F.coalesce(content, F.lit("")))
    return (F.trim(F.coalesce(text, F.lit(""))) == "") & ~has_data & ~low.contains("<a ") & ~low.contains("<form")


def shown_prices(text: Column) -> Column:
    """The prices of a text in which one may be zero; a text without a zero and a currency has none such and is not searched."""
    maybe = text.contains("0") & contains_any(text, fixed.PRICE_MARKERS)
    return F.when(maybe, find_all(text, fixed.PAGE_PRICE, 0)).otherwise(F.array().cast("array<string>"))


def placeholder(text: Column, zero_prices: Column, real_prices: Column) -> Column:
    """Why the text is an unrendered placeholder; null when it is not."""
    # Every leak starts with one of these, and no link cut out of the text makes one: other texts are not searched.
    hinted = contains_any(text, ("{{", "${", "NaN", "undefined", "[object"))
    prose = F.when(hinted, F.regexp_replace(text, r"\]\([^)]*\)|https?://\S+", " ")).otherwise("")
    leaks = count_of(prose, fixed.UNRENDERED)
    return first_of([((zero_prices > 0) & (real_prices == 0), "prices not loaded"),
                     ((leaks >= 3) & (leaks * 4000 >= F.length(prose)), "unrendered template values")])


def paywalled(content: Column, text: Column) -> Column:
    return content.rlike(fixed.NOT_FREE) | text.rlike(fixed.PAYWALL)


def article_signal(url, html: Column) -> Column:
    """How a page says it holds an article: its markup, its path, or null."""
    types = find_all(html, r'"@type"\s*:\s*"([A-Za-z]+)"', 1)
    path = urls.path(url)
    last = F.coalesce(F.try_element_at(urls.segments(path), F.lit(-1)), F.lit(""))
    return first_of([(F.arrays_overlap(types, words_in(fixed.ARTICLE_TYPES)) | html.rlike(fixed.OG_ARTICLE), "markup"),
                     (path.rlike(fixed.ARTICLE_PATH) & ((urls.hyphens(last) >= 2) | last.rlike(r"\d{5,}")), "path")])


def interaction_gate(text: Column, most: int | None = None) -> Column:
    return opening(squeeze(find(text, fixed.INTERACTION_GATE)), most)


def empty_listing(text: Column) -> Column:
    return squeeze(find(text, fixed.EMPTY_LISTING))


def client_templates(content: Column) -> Column:
    """Placeholders still unfilled in a page's client-side templates."""
    bodies = find_all(content, fixed.CLIENT_TEMPLATE, 1)
    return F.aggregate(bodies, F.lit(0), lambda total, body: total + count_of(body, r"\{\{|<%[=-]?"))


def wants_second_opinion(content: Column, text: Column, min_text: int, min_placeholders: int) -> Column:
    return content.contains("<script") & ((F.length(F.trim(text)) < min_text) | (client_templates(content) >= min_placeholders))


def relevance(pages: DataFrame) -> DataFrame:
    """How many items and words of a search page mention its query: page_id, relevant_items, mentions, off_query.

    ``pages(page_id, url, html, text)``; pages whose URL asks for nothing are left out.
    """
    asked = pages.select("page_id", urls.query_terms("url").alias("terms"), F.lower("text").alias("text")).where(F.size("terms") > 0)
    blobs = links.item_blobs(pages).join(asked.select("page_id", "terms"), "page_id")
    hits = blobs.groupBy("page_id").agg(F.count_if(F.exists("terms", lambda term: F.contains("blob", term))).alias("relevant_items"))
    mentions = F.aggregate("terms", F.lit(0), lambda total, term: total + F.floor((F.length("text") - F.length(
        F.replace(F.col("text"), term, F.lit("")))) / F.length(term)).cast("int"))
    rows = asked.select("page_id", "terms", mentions.alias("mentions")).join(hits, "page_id", "left")
    relevant = F.coalesce("relevant_items", F.lit(0))
    return rows.select("page_id", "terms", relevant.alias("relevant_items"), "mentions",
                       (((relevant == 0) & (F.col("mentions") <= 2)) | ((F.col("mentions") == 0) & (relevant <= 1))).alias("off_query"))


def measures(pages: DataFrame) -> DataFrame:
    """What a verdict looks at, per page: text, kind, item links, prices, link text share, article signal."""
    df = scans.with_text(pages.select("page_id", "url", "html"))
    shown = find_all(F.col("text"), fixed.PAGE_PRICE, 0)
    df = (df.withColumn("shown", shown).withColumn("kind", urls.page_kind("url"))
          .withColumn("text_chars", F.length(F.trim("text")))
          .withColumn("prices", F.size(F.filter("shown", lambda price: ~price.rlike(fixed.ZERO_PRICE))))
          .withColumn("zero_prices", F.size("shown") - F.col("prices")).drop("shown")
          .withColumn("link_share", links.link_text_share(F.col("html"), F.col("text")))
          .withColumn("signal", article_signal("url", F.col("html"))))
    return df.join(links.item_link_counts(pages), "page_id", "left").withColumn("item_links", F.coalesce("item_links", F.lit(0)))


def assess(pages: DataFrame, articles: DataFrame | None = None, min_items: int = 10, min_prices: int = 4,
           min_chars: int = 1500) -> DataFrame:
    """The completeness verdict of HTML pages ``pages(page_id, url, html)``: kind, complete, score, reason and what was seen."""
    # Five branches read the measures: written once, so no page is scanned or turned to text again.
    df = cut(measures(pages))
    search = df.where(F.col("kind") == "search").select("page_id", "url", "html", "text")
    match = relevance(search).select("page_id", "mentions", "off_query")
    groups = links.result_groups(search, urls.query_terms("url"))
    images = links.result_images(search, urls.query_terms("url"))
    df = (df.join(match, "page_id", "left").join(groups, "page_id", "left").join(images, "page_id", "left")
          .withColumn("item_links", F.when((F.col("kind") == "search") & (F.col("item_links") < min_items), F.greatest(
              "item_links", F.coalesce("result_group", F.lit(0)), F.coalesce("result_images", F.lit(0)))).otherwise(F.col("item_links"))))
    articled = (F.col("kind") != "search") & ((F.col("signal") == "markup") | ((F.col("signal") == "path") & (F.col("prices") == 0)))
    df = df.withColumn("is_article", F.coalesce(articled, F.lit(False)))
    if articles is None:
        # Only pages that say they hold an article go through the tokenizer.
        told = df.where("is_article").select("page_id", "html")
        found = blocks.main_content(blocks.elements(told))
        articles = found.select("page_id", F.col("chars").alias("article_chars"), texts.paragraphs(F.col("text")).alias("article_paragraphs"))
    df = df.join(articles, "page_id", "left").withColumn("article_chars", F.coalesce("article_chars", F.lit(0))).withColumn(
        "article_paragraphs", F.coalesce("article_paragraphs", F.lit(0)))
    df = df.withColumn("paywall", F.col("is_article") & (F.col("article_chars") < 1500) & paywalled(F.col("html"), F.col("text")))
    held = first_of([(texts.consent_only(F.col("text")), "only a cookie or consent notice")])
    df = df.withColumn("placeholder", F.coalesce(placeholder(F.col("text"), F.col("zero_prices"), F.col("prices")), held))
    menus = (F.col("kind") != "search") & (F.col("prices") == 0) & (F.col("link_share") > 0.8) & (F.col("text_chars") >= 400)
    thin_article = F.col("is_article") & ((F.col("article_chars") < 600) | (F.col("article_paragraphs") < 2))
    structure = first_of([
        (F.col("is_article"), True),
        (F.col("kind") == "search", (F.col("item_links") >= min_items) | (F.col("prices") >= min_prices)),
        (F.col("kind") == "item", (F.col("prices") >= 1) | (F.col("text_chars") >= min_chars))],
        (F.col("text_chars") >= min_chars) | ((F.col("text_chars") >= 400) & ~F.col("html").contains("<script")))
    reason = first_of([
        (F.col("placeholder").isNotNull(), F.col("placeholder")), (menus, "menus, not the page"),
        (thin_article & F.col("paywall"), "paywalled"), (thin_article, "thin article"), (~structure, F.concat(F.lit("incomplete "), "kind")),
        ((F.col("kind") == "search") & F.coalesce("off_query", F.lit(False)), "results don't mention the query")])
    df = df.withColumn("menus", menus & F.col("placeholder").isNull()).withColumn("reason", reason)
    score = (F.col("item_links") * 100 + F.col("prices") * 20 + F.col("text_chars") / 10
             + F.when(F.col("kind") == "search", 300 * F.least(F.coalesce("mentions", F.lit(0)), F.lit(20))).otherwise(0)
             + F.when(F.col("is_article"), F.col("article_chars")).otherwise(0))
    whole = F.col("reason").isNull()
    return (df.withColumn("score", score.cast("double")).withColumn("complete", whole)
            .withColumn("off_query", F.coalesce("off_query", F.lit(False)) & (F.col("reason") == "results don't mention the query"))
            .withColumn("needs_interaction", F.when(F.col("prices") == 0, interaction_gate(F.col("text"))))
            .withColumn("empty_listing", F.when((F.col("kind") != "item") & ~F.col("is_article"), empty_listing(F.col("text"))))
            .withColumn("kind", F.when(F.col("is_article"), "article").otherwise(F.col("kind"))))


FLAGS = ["placeholder", "off_query", "cookie_notice", "paywall", "menus", "navigation", "needs_interaction", "empty_listing",
         "archived", "rescued"]
_BAD = ["placeholder", "off_query", "cookie_notice", "menus", "navigation"]


def quality(complete: Column, signals: dict[str, Column]) -> tuple[Column, Column]:
    """(grade, flags): good, partial with warnings, or poor. ``signals`` maps a flag to the condition that sets it."""
    raised = [F.when(signals[name], F.lit(name)) for name in FLAGS if name in signals]
    flags = F.filter(F.array(*raised), lambda flag: flag.isNotNull())
    poor = ~complete | F.arrays_overlap(flags, words_in(_BAD))
    return first_of([(poor, "poor"), (F.size(flags) > 0, "partial")], "good"), flags


def page_quality(verdicts: DataFrame) -> DataFrame:
    grade, flags = quality(F.col("complete"), {
        "placeholder": F.col("placeholder").isNotNull(), "off_query": F.coalesce("off_query", F.lit(False)), "paywall": F.col("paywall"),
        "menus": F.col("menus"), "needs_interaction": F.col("needs_interaction").isNotNull(),
        "empty_listing": F.col("empty_listing").isNotNull()})
    return verdicts.withColumn("flags", flags).withColumn("grade", grade)


# ---- bench checks -----------------------------------------------------------------------------
def bench_check(kind: Column, text: Column, links_found: Column, expect: Column) -> Column:
    """Why an observed read is not the content asked for; null when it is."""
    size = F.length(F.trim(text))
    floor = first_of([(kind == name, least) for name, least in fixed.BENCH_MIN_CHARS.items()], 0)
    return first_of([
        ((kind != "json") & (size < floor), "thin"), ((kind == "pdf") & F.startswith(F.ltrim(text), F.lit("%PDF")), "pdf_bytes"),
        ((kind == "listing") & ~text.rlike(fixed.BENCH_PRICE), "no_price"),
        ((kind == "search") & (links_found < 5), F.concat(F.lit("few_links:"), links_found.cast("string"))),
        (expect.isNotNull() & ~F.regexp_like(text, F.concat(F.lit("(?i)"), expect)), "expect_missing")])


def expect_count(text: Column, pattern: Column) -> Column:
    return F.regexp_count(text, F.concat(F.lit("(?i)"), pattern))


def text_grade(text: Column, expect: Column, within: int | None = None) -> Column:
    """right, wrong, page, blocked or empty, as the two-server comparison grades a text; block markers are looked for in all of it, or ``within``."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return first_of([
        (F.length(F.trim(low)) < 200, "empty"), (expect.isNotNull() & F.contains(low, F.lower(expect)), "right"), (expect.isNotNull(), "wrong"),
        ((F.length(low) < 3000) & contains_any(opening(low, within), fixed.COMPARE_BLOCK_MARKERS), "blocked")], "page")


def article_score(text: Column, head: int | None = None) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    found = texts.paragraphs(text)
    return {"main_chars": F.length(text), "paragraphs": found, "head_paragraphs": texts.paragraphs(opening(text, head)),
            "article": (F.length(text) >= 600) & (found >= 2)}
