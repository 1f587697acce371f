"""Scans, link tables, page text and markdown lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import fixed, texts, urls
from pagegrain.operators import lines, links
from pagegrain.plans import duck
from pagegrain.plans.registry import query
from pagegrain.plans.urls import item_like_sql
from pagegrain.sources import pages
from pagegrain.sources.tables import with_views

_HIDDEN = "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>|<!--.*?-->"


def unescape_sql(expr: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "),
                       ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
                       ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&euro;", "€"), ("&pound;", "£"), ("&amp;", "&")):
        expr = f"replace({expr}, '{name}', '{char}')"
    return expr


def squeeze_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def text_sql(html: str) -> str:
    bare = f"regexp_replace(regexp_replace({html}, '{_HIDDEN}', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    return squeeze_sql(unescape_sql(bare))


def title_sql(html: str) -> str:
    return f"nullif({squeeze_sql(unescape_sql(f'''regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)'''))}, '')"


ANCHOR_SQL = """'(?is)<a\\b[^>]*?\\bhref\\s*=\\s*(?:"([^"]*)"|''([^'']*)'')[^>]*>(.*?)</a\\s*>'"""


def resolve_sql(base: str, href: str) -> str:
    """Relative references without dot segments, which the pages do not use."""
    root = f"({duck.scheme(base)} || '://' || {duck.authority(base)})"
    folder = f"regexp_replace({duck.path(base)}, '[^/]*$', '')"
    return f"""CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href}
      WHEN starts_with({href}, '//') THEN {duck.scheme(base)} || ':' || {href}
      WHEN {href} = '' THEN regexp_replace({base}, '#.*$', '')
      WHEN starts_with({href}, '#') THEN regexp_replace({base}, '#.*$', '') || {href}
      WHEN starts_with({href}, '?') THEN {root} || {duck.path(base)} || {href}
      WHEN starts_with({href}, '/') THEN {root} || {href}
      ELSE {root} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {href} END"""


def anchors_sql(source: str) -> str:
    return f"""a0 AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, {ANCHOR_SQL})) AS raw,
    unnest(range(len(regexp_extract_all(html, {ANCHOR_SQL})))) AS pos FROM {source}),
a1 AS (SELECT *, regexp_extract(raw, {ANCHOR_SQL}, 1) || regexp_extract(raw, {ANCHOR_SQL}, 2) AS href,
    regexp_extract(raw, {ANCHOR_SQL}, 3) AS anchor_html FROM a0)"""


def links_sql(source: str) -> str:
    text = squeeze_sql(unescape_sql("regexp_replace(anchor_html, '<[^>]+>', ' ', 'g')"))
    alt = """'(?is)<img\\b[^>]*?\\balt\\s*=\\s*(?:"([^"]*)"|''([^'']*)'')'"""
    alt_text = squeeze_sql(unescape_sql(f"(regexp_extract(anchor_html, {alt}, 1) || regexp_extract(anchor_html, {alt}, 2))"))
    return f"""{anchors_sql(source)},
a2 AS (SELECT *, trim({unescape_sql('href')}) AS clean FROM a1),
a3 AS (SELECT *, regexp_replace({resolve_sql('base', 'clean')}, '#.*$', '') AS link FROM a2),
links AS (SELECT page_id, base, link, min(pos) AS pos, arg_min(CASE WHEN {text} <> '' THEN {text} ELSE {alt_text} END, pos) AS text
  FROM a3 WHERE regexp_matches(link, '^https?://') GROUP BY page_id, base, link)"""


@query("s1_page_scan", f"""SELECT page_id, url, {duck.bare_host('url')} AS host, cast(length(html) AS integer) AS html_chars, md5(html) AS html_md5
FROM pages""")
def s1(t):
    return pages.scan(t.pages).select("page_id", "url", "host", "html_chars", F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query("s13_host_harvest", f"""WITH f AS (SELECT unnest(regexp_extract_all(url || ' ' || html, 'https?://[^\\s"''<>\\\\)]+')) AS link FROM pages)
SELECT DISTINCT {duck.bare_host('link')} AS host FROM f WHERE contains({duck.bare_host('link')}, '.')""")
def s13(t):
    return pages.hosts_in(t.pages.select(F.concat_ws(" ", "url", "html").alias("txt")), "txt")


@query("s14_case_lines", """WITH l AS (SELECT trim(CASE p_partkey % 5 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '  '
  WHEN 2 THEN 'https://a.test/' || p_partkey ELSE ' https://a.test/' || p_partkey || chr(9) || p_name || ' ' END) AS v FROM part)
SELECT trim(split_part(v, chr(9), 1)) AS url, nullif(trim(regexp_extract(v, '^[^\\t]*\\t(.*)$', 1)), '') AS expect
FROM l WHERE v <> '' AND NOT starts_with(v, '#')""".replace("\\\\", "\\"))
def s14(t):
    at, key = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    value = (F.when(at == 0, F.concat(F.lit("# "), "p_name")).when(at == 1, "  ")
             .when(at == 2, F.concat(F.lit("https://a.test/"), key))
             .otherwise(F.concat(F.lit(" https://a.test/"), key, F.lit("\t"), "p_name", F.lit(" "))))
    return pages.case_lines(t.part.select(value.alias("value")))


_NOW = "timestamp '2024-01-15 12:00:00'"


@query("s15_import_evidence", f"""SELECT url, 'http' AS method, length(html) AS chars FROM pages
UNION ALL
SELECT 'https://site' || user_id || '.example.com/', CASE user_id % 3 WHEN 0 THEN 'operator_browser' WHEN 1 THEN 'user_supplied' ELSE 'robot' END,
  length(props) FROM events WHERE ts <= {_NOW} + interval 60 second AND user_id % 3 <> 2""")
def s15(t):
    own = t.pages.select("url", F.col("html").alias("content"), F.lit("text/html").alias("content_type"),
                         F.lit("2024-01-01").cast("timestamp").alias("observed_at"), F.lit("http").alias("method"))
    kind = F.col("user_id") % 3
    supplied = t.events.select(
        F.concat(F.lit("https://site"), F.col("user_id").cast("string"), F.lit(".example.com/")).alias("url"),
        F.col("props").alias("content"), F.lit("application/json").alias("content_type"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.when(kind == 0, "operator_browser").when(kind == 1, "user_supplied").otherwise("robot").alias("method"))
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return pages.import_evidence(own, supplied, now).select("url", "method", F.length("content").alias("chars"))


@query("j1_page_links", f"WITH {links_sql('pages')} SELECT page_id, pos, link, text FROM links")
def j1(t):
    return links.page_links(t.pages).select("page_id", "pos", "link", "text")


@query("j2_page_text", f"SELECT page_id, {title_sql('html')} AS title, {text_sql('html')} AS text FROM pages")
def j2(t):
    return pages.with_text(t.pages).select("page_id", "title", "text")


# RE2's non-word class knows ASCII only; the rule means letters and digits of any alphabet.
NAV_TOKEN_ANY_ALPHABET = fixed.NAV_TOKEN.replace(r"[\W_]", r"[^\p{L}\p{N}]")


# The line rules again, on exploded rows: link share from link text over letters.
def lines_ctes() -> str:
    link = "!?\\[([^\\]]*)\\]\\(([^)]*)\\)"
    plain = f"regexp_replace({squeeze_sql(f'''regexp_replace(line, '{link}', '\\1', 'g')''')}, '^[ *#>\\-|_`]+|[ *#>\\-|_`]+$', '', 'g')"
    shown = f"length(regexp_replace(regexp_replace(line, '{link}', '\\1', 'g'), '[\\s*#>|_`-]', '', 'g'))"
    linked = f"coalesce(list_sum(list_transform(regexp_extract_all(line, '{link}', 1), lambda z: length(z))), 0)"
    words = "len(regexp_extract_all(plain, '\\S+'))"
    prose = f"({words} >= 8 AND {duck.like('rtrim(plain)', fixed.SENTENCE_END)} AND share < 0.35)"
    return f"""l0 AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS raw, unnest(range(len(string_split(content, chr(10))))) AS ln FROM md_docs),
l1 AS (SELECT doc_id, ln, trim(raw) AS line, starts_with(trim(raw), '```') OR starts_with(trim(raw), '~~~') AS fence FROM l0),
l2 AS (SELECT *, count(*) FILTER (fence) OVER (PARTITION BY doc_id ORDER BY ln) % 2 = 1 AS fenced FROM l1),
l3 AS (SELECT doc_id, ln, line, fenced, {plain} AS plain, CASE WHEN {shown} > 0 THEN {linked} / {shown} ELSE 1.0 END AS share,
    regexp_matches(line, '{link}') AS has_link FROM l2 WHERE line <> '' AND NOT fence),
l4 AS (SELECT doc_id, ln, line, plain, CASE WHEN fenced THEN 'code'
    WHEN (has_link AND share >= 0.6) OR ({duck.like('plain', NAV_TOKEN_ANY_ALPHABET)} AND length(plain) <= 40 AND NOT starts_with(line, '#')) THEN 'nav'
    WHEN starts_with(line, '#') OR regexp_matches(line, '(?i)^(title|url source|published time|markdown content|description):') THEN 'neutral'
    WHEN {prose} AND {duck.like('plain', fixed.CONSENT)} THEN 'consent' WHEN {prose} AND {duck.like('plain', fixed.FOOTER)} THEN 'footer'
    WHEN {prose} THEN 'prose'
    WHEN plain <> '' AND length(plain) <= 40 AND {words} <= 5 AND NOT {duck.like('plain', fixed.SENTENCE_END)} THEN 'short'
    ELSE 'neutral' END AS kind, fenced FROM l3),
lns AS (SELECT doc_id, ln, kind, CASE WHEN fenced THEN length(line) WHEN kind = 'nav' AND plain = '' THEN length(line) ELSE length(plain) END AS size FROM l4)"""


MD = with_views("md_docs")


@query("j10_line_classes", f"""{MD}, {lines_ctes()} SELECT doc_id, kind, cast(count(*) AS bigint) AS n_lines, cast(sum(size) AS bigint) AS chars
FROM lns GROUP BY doc_id, kind""")
def j10(t):
    found = lines.with_lines(t.md_docs, F.col("content")).select("doc_id", F.explode("lines").alias("line"))
    return found.groupBy("doc_id", F.col("line.kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("line.size").cast("bigint")).alias("chars"))


def nav_ctes() -> str:
    return f"""{lines_ctes()},
n0 AS (SELECT doc_id, coalesce(min(ln) FILTER (kind = 'code' OR (kind = 'prose' AND size >= 120)), max(ln) + 1) AS start FROM lns GROUP BY doc_id),
n1 AS (SELECT l.*, n.start, count(*) FILTER (kind NOT IN ('prose', 'code', 'neutral')) OVER (PARTITION BY l.doc_id ORDER BY ln) AS island
  FROM lns l JOIN n0 n USING (doc_id)),
runs AS (SELECT doc_id, max(run) AS best FROM (SELECT doc_id, island, sum(size) FILTER (kind IN ('prose', 'code')) AS run FROM n1 WHERE ln >= start
  GROUP BY doc_id, island) GROUP BY doc_id),
sums AS (SELECT doc_id, coalesce(sum(size) FILTER (ln < start AND kind <> 'neutral'), 0) AS lead_chars,
  coalesce(sum(size) FILTER (ln < start AND kind IN ('nav', 'short', 'footer', 'consent')), 0) AS lead_nav,
  coalesce(sum(size) FILTER (kind IN ('prose', 'code')), 0) AS prose_chars, coalesce(sum(size) FILTER (kind = 'nav'), 0) AS nav_chars,
  greatest(coalesce(sum(size) FILTER (kind NOT IN ('neutral', 'short')), 0), 1) AS total_chars,
  coalesce(sum(size) FILTER (ln >= start AND kind IN ('prose', 'code')), 0) AS after_chars FROM n1 GROUP BY doc_id),
nav AS (SELECT s.*, coalesce(r.best, 0) AS article_run_chars FROM sums s LEFT JOIN runs r USING (doc_id))"""


@query("j11_nav_led", f"""{MD}, {nav_ctes()} SELECT doc_id, cast(lead_chars AS bigint) AS lead_chars, cast(prose_chars AS bigint) AS prose_chars,
  cast(article_run_chars AS bigint) AS article_run_chars,
  CASE WHEN lead_chars >= 1200 AND lead_nav / lead_chars >= 0.5 AND after_chars < 1200 THEN 'thin prose after navigation'
       WHEN lead_chars >= 1200 AND lead_nav / lead_chars >= 0.5 AND article_run_chars < 800 THEN 'no article after navigation'
       WHEN prose_chars < 400 AND nav_chars / total_chars >= 0.5 AND total_chars >= 400 THEN 'mostly links and menu words' END AS reason FROM nav""")
def j11(t):
    found = lines.with_nav_measure(lines.with_lines(t.md_docs, F.col("content")))
    return found.select("doc_id", F.col("lead_chars").cast("bigint"), F.col("prose_chars").cast("bigint"),
                        F.col("article_run_chars").cast("bigint"), F.col("nav_reason").alias("reason"))


@query("j12_markdown_main")
def j12(t):
    return lines.with_markdown_main(t.md_docs, F.col("content")).select(
        "doc_id", F.length("main_text").alias("main_chars"), F.md5(F.col("main_text").cast("binary")).alias("main_md5"))


_ALL = with_views("product_pages")
ITEMS = f"""{anchors_sql('every')}, i1 AS (SELECT page_id, base, {resolve_sql('base', "replace(href, '&amp;', '&')")} AS link FROM a1
  WHERE href <> '' AND NOT starts_with(href, '#')),
i2 AS (SELECT page_id, {duck.path('link')} AS p, {duck.path('base')} AS bp, {duck.bare_host('link')} AS lh, {duck.bare_host('base')} AS bh FROM i1
  WHERE regexp_matches(link, '^https?://')),
items AS (SELECT page_id, cast(count(DISTINCT regexp_replace(p, '/+$', '')) AS bigint) AS item_links FROM i2
  WHERE p <> bp AND lh = bh AND {item_like_sql('p')} GROUP BY page_id)"""


def every_page(t):
    """The given pages beside product pages, so that link rules meet both kinds."""
    return t.pages.select("page_id", "url", "html").unionByName(
        t.product_pages.select((-1 - F.col("page_id")).alias("page_id"), "url", "html"))


EVERY = f"""{_ALL}, every AS (SELECT page_id, url, html FROM pages UNION ALL SELECT -1 - page_id, url, html FROM product_pages)"""


@query("j17_item_links", f"{EVERY}, {ITEMS} SELECT page_id, item_links FROM items")
def j17(t):
    return links.item_link_counts(every_page(t))


_INNER = squeeze_sql("regexp_replace(z, '<[^>]+>', ' ', 'g')")


@query("j20_link_text_share", f"""{EVERY}, x AS (SELECT page_id, {text_sql('html')} AS txt,
  coalesce(list_sum(list_transform(regexp_extract_all(html, {ANCHOR_SQL}, 3), lambda z: length({_INNER}))), 0) AS linked FROM every)
SELECT page_id, round(CASE WHEN length(txt) > 0 THEN least(linked / greatest(length(txt), 1), 1.0) ELSE 0.0 END, 4) AS share FROM x""")
def j20(t):
    text = pages.page_text(F.col("html"))
    return every_page(t).select("page_id", F.round(links.link_text_share(F.col("html"), text), 4).alias("share"))


# Site links of one supplier page, as one long page with a search URL: groups by path shape.
@query("j18_result_groups", """
WITH g AS (SELECT l_suppkey AS page_id, cast(count(DISTINCT l_partkey) AS bigint) AS leaves,
  cast(count(DISTINCT l_partkey) FILTER (contains(p_name, 'ring') OR contains(p_name, 'red') OR contains(p_name, 'gear')) AS bigint) AS named
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey)
SELECT page_id, leaves AS result_group FROM g WHERE leaves >= 8 AND named >= greatest(3, leaves / 3)""")
def j18(t):
    named = t.lineitem.select("l_suppkey", "l_partkey").distinct().join(
        t.part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    # One anchor row per linked part, as a parsed page gives them.
    key = F.col("l_suppkey").alias("page_id")
    anchors = named.select(key, F.lit("https://shop.example.com/search?q=red+rings+gear").alias("base"), F.lit(0).alias("pos"),
                           F.concat(F.lit("/parts/x"), F.col("l_partkey").cast("string")).alias("href"),
                           F.col("p_name").alias("raw"), F.col("p_name").alias("inner"))
    asked = named.select(key).distinct().withColumn(
        "terms", urls.query_terms(F.lit("https://shop.example.com/search?q=red+rings+gear")))
    return links.result_groups_of(anchors, asked)


@query("j16_item_blobs")
def j16(t):
    return links.item_blobs(every_page(t)).select("page_id", "item", F.length("blob").alias("blob_chars"))


@query("j19_result_images")
def j19(t):
    tags = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda n: F.concat(
        F.lit('<img src="/img/'), F.col("p_partkey").cast("string"), F.lit("_"), n.cast("string"), F.lit('.jpg" alt="'),
        F.when(n % 10 < F.col("p_size") % 11, F.col("p_name")).otherwise("logo"), F.lit('">'))), "")
    made = t.part.select(F.col("p_partkey").alias("page_id"), F.concat(
        F.lit("https://shop.example.com/search?q="), F.replace("p_name", F.lit(" "), F.lit("+"))).alias("url"), tags.alias("html"))
    return links.result_images(made, urls.query_terms("url"))
