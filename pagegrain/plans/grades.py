"""Page grading over pages, reads and bench cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import fixed, texts, urls
from pagegrain.operators import grading, lines
from pagegrain.plans import duck
from pagegrain.plans.pages import ANCHOR_SQL, every_page, squeeze_sql, text_sql
from pagegrain.plans.registry import query
from pagegrain.plans.urls import item_like_sql
from pagegrain.sources.tables import with_views

READS = with_views("reads")


def _any(expr: str, phrases) -> str:
    return f"list_bool_or(list_transform({duck.words(phrases)}, lambda ph: contains({expr}, ph)))"


def _parts(pattern: str) -> str:
    plain = "trim(regexp_replace(lower(trim(title)), '^[# ]+', ''))"
    return f"list_concat([{plain}], list_transform(string_split_regex({plain}, '{pattern}'), lambda tp: regexp_replace(tp, '^[ .!]+|[ .!]+$', '', 'g')))"


CHALLENGE = (f"(list_has_any({_parts('\\s*[|\\-–—:/]\\s+|\\s+[|\\-–—/]\\s*')}, {duck.words(fixed.CHALLENGE_TITLES)}) OR "
             f"(length(body) < 3000 AND {_any('lower(body)', fixed.CHALLENGE_PHRASES)}))")


@query("g1_challenge", f"{READS} SELECT event_id, {CHALLENGE} AS challenge FROM reads")
def g1(t):
    return t.reads.select("event_id", grading.challenge(F.col("title"), F.col("body")).alias("challenge"))


_LB = "lower(trim(body))"
_BRAND = f"split_part(regexp_replace({duck.bare_host('requested_url')}, '^m\\.', ''), '.', 1)"
_PLAIN = "trim(regexp_replace(trim(title), '^[# ]+', ''))"
LOGIN = (f"(len(list_filter(list_concat([{_PLAIN}], string_split_regex({_PLAIN}, '\\s+[|\\-–—:]\\s+')), lambda tp: {duck.like('tp', fixed.LOGIN_TITLE)})) > 0 OR "
         f"(length({_LB}) < 6000 AND contains({_LB}, 'password') AND {duck.path('requested_url')} NOT IN ('', '/') AND lower({_PLAIN}) = {_BRAND} AND "
         f"{_any(_LB, fixed.LOGIN_WORDS)}))")


@query("g2_login_wall", f"{READS} SELECT event_id, {LOGIN} AS login_wall FROM reads")
def g2(t):
    return t.reads.select("event_id", grading.login_wall(F.col("title"), F.col("body"), "requested_url").alias("login_wall"))


_RP, _FP = duck.path("requested_url"), duck.path("final_url")
_RH, _FH = duck.host("requested_url"), duck.host("final_url")
_MOVED = f"({_FH} <> '' AND {_FH} || {_FP} <> {_RH} || {_RP})"


def _core(host: str) -> str:
    return f"CASE WHEN len(string_split({host}, '.')) > 2 THEN array_to_string(string_split({host}, '.')[2:], '.') ELSE {host} END"


@query("g3_wall", f"""{READS} SELECT event_id, CASE WHEN {CHALLENGE} THEN 'CAPTCHA'
  WHEN length(trim(body)) < 2000 AND ({duck.like('trim(body)', fixed.BROWSER_ERROR)} OR {duck.like('trim(body)', fixed.MAINTENANCE)}) THEN 'PROVIDER_DOWN'
  WHEN {_MOVED} AND {duck.like(_FP, fixed.BOT_PAGE_PATH)} AND NOT {duck.like(_RP, fixed.BOT_PAGE_PATH)} THEN 'CAPTCHA'
  WHEN {_MOVED} AND {duck.like(f"(split_part({_FH}, '.', 1) || '/' || {_FP})", fixed.SIGN_IN_PATH)} AND NOT {duck.like(_RP, fixed.SIGN_IN_PATH)} THEN 'AUTH_REQUIRED'
  WHEN length(trim(body)) < 2500 AND {_any('lower(body)', fixed.SIGN_IN_PHRASES)} THEN 'AUTH_REQUIRED'
  WHEN NOT {duck.like(_RP, fixed.SIGN_IN_PATH)} AND {LOGIN} THEN 'AUTH_REQUIRED'
  WHEN {_MOVED} AND {duck.like(_FP, fixed.HOME_ALIASES)} AND NOT {duck.like(_RP, fixed.HOME_ALIASES)} AND {_core(_RH)} = {_core(_FH)} THEN 'CONTENT_MISMATCH' END AS wall
FROM reads""")
def g3(t):
    return t.reads.select("event_id", grading.wall(F.col("title"), F.col("body"), "requested_url", "final_url").alias("wall"))


_EP = f"({_parts('\\s+[|\\-–—:]\\s+')})[2:]"


@query("g4_site_error", f"""{READS} SELECT event_id, ({_MOVED} AND {duck.like(_FP, fixed.ERROR_PAGE_PATH)} AND NOT {duck.like(_RP, fixed.ERROR_PAGE_PATH)})
  OR (length({_LB}) < 20000 AND list_has_any({_EP}, {duck.words(fixed.ERROR_TITLES)})) OR list_has_any({_EP}, {duck.words(fixed.NOT_FOUND_TITLES)})
  OR (length({_LB}) < 4000 AND {_any(_LB, fixed.ERROR_PHRASES)}) AS site_error FROM reads""")
def g4(t):
    return t.reads.select("event_id", grading.site_error(F.col("title"), F.col("body"), "requested_url", "final_url").alias("site_error"))


@query("g5_nothing_on_page", f"{READS} SELECT event_id, trim(body) = '' AND event_id % 2 <> 0 AS empty FROM reads")
def g5(t):
    content = F.concat(F.lit("<html>"), F.when(F.col("event_id") % 2 == 0, '<a href="/">x</a>').otherwise(""), F.lit("</html>"))
    return t.reads.select("event_id", grading.nothing_on_page(F.col("body"), content, F.lit(False)).alias("empty"))


_PROSE = "regexp_replace(body, '\\]\\([^)]*\\)|https?://\\S+', ' ', 'g')"
_LEAKS = f"len(regexp_extract_all({_PROSE}, {duck.text(fixed.UNRENDERED)}))"


@query("g6_placeholder", f"""{READS} SELECT event_id, CASE WHEN contains(body, '$0.00') THEN 'prices not loaded'
  WHEN {_LEAKS} >= 3 AND {_LEAKS} * 4000 >= length({_PROSE}) THEN 'unrendered template values' END AS placeholder FROM reads""")
def g6(t):
    rows = t.reads.select("event_id", "body", grading.shown_prices(F.col("body")).alias("shown"))
    rows = rows.select("event_id", "body", F.size("shown").alias("n"), F.size(F.filter("shown", lambda price: price.rlike(fixed.ZERO_PRICE))).alias("zero"))
    return rows.select("event_id", grading.placeholder(F.col("body"), F.col("zero"), F.col("n") - F.col("zero")).alias("placeholder"))


@query("g7_paywall", f"{READS} SELECT event_id, {duck.like('body', fixed.PAYWALL)} AS paywall FROM reads")
def g7(t):
    return t.reads.select("event_id", grading.paywalled(F.lit(""), F.col("body")).alias("paywall"))


@query("g8_article_signal")
def g8(t):
    return t.urls.select("url_id", grading.article_signal("url", F.lit("<p>")).alias("signal"))


@query("g9_completeness")
def g9(t):
    found = grading.assess(every_page(t))
    return found.select("page_id", "kind", "complete", F.round("score", 3).alias("score"), "item_links", "prices", "text_chars", "reason")


@query("g10_page_relevance")
def g10(t):
    html = F.concat(F.lit('<a href="/p/red-ring-with-a-stone-'), F.col("p_partkey").cast("string"), F.lit('">'), "p_name", F.lit("</a>"))
    made = t.part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://s.example.com/search?q="), F.when(
        F.col("p_size") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("+"))).otherwise("sofas")).alias("url"),
        html.alias("html"), F.col("p_name").alias("text"))
    return grading.relevance(made).select("page_id", "relevant_items", "mentions", "off_query")


_QK = (f"(list_contains({duck.words(fixed.QUERY_KEYS)}, x) OR list_contains({duck.words(fixed.QUERY_KEYS)}, regexp_replace(x, '[^a-z0-9]', '', 'g')))")
_P = duck.path("url")
_KIND = f"""CASE WHEN len(list_filter({duck.keys('url')}, lambda x: {_QK})) > 0 OR {duck.like(f"CASE WHEN {_P} = '' THEN '/' ELSE {_P} END", fixed.SEARCH_PATH)} THEN 'search'
  WHEN {duck.like(_P, fixed.ITEM_MARKER)} OR len(list_filter({duck.segments(_P)}, lambda s: {duck.like('s', fixed.LONG_ID)} OR length(s) - length(replace(s, '-', '')) >= 3)) > 0
  THEN 'item' ELSE 'page' END"""
_INNER = squeeze_sql("regexp_replace(z, '<[^>]+>', ' ', 'g')")


# The generated pages carry no prices, article markup or search URLs, so the verdict comes down to text, scripts and menus.
@query("g11_page_quality", f"""WITH m AS (SELECT page_id, url, html, {text_sql('html')} AS txt, {_KIND} AS kind,
  coalesce(list_sum(list_transform(regexp_extract_all(html, {ANCHOR_SQL}, 3), lambda z: length({_INNER}))), 0) AS linked FROM pages),
s AS (SELECT *, length(txt) AS n, CASE WHEN length(txt) > 0 THEN least(linked / greatest(length(txt), 1), 1.0) ELSE 0.0 END AS share,
  len(regexp_extract_all(txt, '\\S+')) AS words, len(regexp_extract_all(txt, {duck.text(fixed.CONSENT)})) AS consent FROM m),
v AS (SELECT *, CASE WHEN words > 0 AND words < 400 AND consent >= 3 AND consent / words > 0.02 THEN 'only a cookie or consent notice'
  WHEN share > 0.8 AND n >= 400 THEN 'menus, not the page'
  WHEN kind = 'item' AND n < 1500 THEN 'incomplete item'
  WHEN kind = 'page' AND n < 1500 AND NOT (n >= 400 AND NOT contains(html, '<script')) THEN 'incomplete page' END AS reason FROM s)
SELECT page_id, kind, cast(n AS integer) AS text_chars, reason IS NULL AS complete, reason, CASE WHEN reason IS NULL THEN 'good' ELSE 'poor' END AS grade FROM v""")
def g11(t):
    found = grading.page_quality(grading.assess(t.pages))
    return found.select("page_id", "kind", "text_chars", "complete", "reason", "grade")


@query("g22_bench_check", f"""{READS}, k AS (SELECT event_id, body, CASE event_id % 5 WHEN 0 THEN 'listing' WHEN 1 THEN 'search' WHEN 2 THEN 'article' WHEN 3 THEN 'pdf' ELSE 'json' END AS kind,
  event_id % 9 AS links, CASE event_id % 3 WHEN 0 THEN 'CLICK|view' END AS expect FROM reads)
SELECT event_id, CASE WHEN kind <> 'json' AND length(trim(body)) < CASE kind WHEN 'listing' THEN 300 WHEN 'search' THEN 500 WHEN 'article' THEN 800 WHEN 'pdf' THEN 100 END THEN 'thin'
  WHEN kind = 'pdf' AND starts_with(ltrim(body), '%PDF') THEN 'pdf_bytes'
  WHEN kind = 'listing' AND NOT {duck.like('body', fixed.BENCH_PRICE)} THEN 'no_price'
  WHEN kind = 'search' AND links < 5 THEN 'few_links:' || links
  WHEN expect IS NOT NULL AND NOT regexp_matches(body, '(?i)' || expect) THEN 'expect_missing' END AS reason FROM k""")
def g22(t):
    at = F.col("event_id") % 5
    kind = F.when(at == 0, "listing").when(at == 1, "search").when(at == 2, "article").when(at == 3, "pdf").otherwise("json")
    expect = F.when(F.col("event_id") % 3 == 0, "CLICK|view")
    return t.reads.select("event_id", grading.bench_check(kind, F.col("body"), F.col("event_id") % 9, expect).alias("reason"))


@query("g23_expect_count", f"{READS} SELECT event_id, len(regexp_extract_all(body, '(?i)words')) >= 3 AS enough FROM reads")
def g23(t):
    return t.reads.select("event_id", (grading.expect_count(F.col("body"), F.lit("WORDS")) >= 3).alias("enough"))


_LOW = "lower(body)"


@query("g24_text_grade", f"""{READS} SELECT event_id, CASE WHEN length(trim({_LOW})) < 200 THEN 'empty'
  WHEN event_id % 2 = 0 THEN CASE WHEN contains({_LOW}, 'click words') THEN 'right' ELSE 'wrong' END
  WHEN length({_LOW}) < 3000 AND {_any(_LOW, fixed.COMPARE_BLOCK_MARKERS)} THEN 'blocked' ELSE 'page' END AS grade FROM reads""")
def g24(t):
    expect = F.when(F.col("event_id") % 2 == 0, "Click words")
    return t.reads.select("event_id", grading.text_grade(F.col("body"), expect).alias("grade"))


def _paras(expr: str) -> str:
    return (f"cast(len(list_filter(string_split_regex({expr}, '\\r\\n|\\n'), lambda x: length(regexp_replace(x, '^[ *#>|-]+|[ *#>|-]+$', '', 'g')) >= 80)) AS integer)")


@query("g26_article_score", f"""SELECT doc_id, cast(length(text) AS integer) AS main_chars, {_paras('text')} AS paragraphs, {_paras('text')} AS head_paragraphs,
  length(text) >= 600 AND {_paras('text')} >= 2 AS article FROM documents""")
def g26(t):
    return t.documents.select("doc_id", *[column.alias(name) for name, column in grading.article_score(F.col("text")).items()])


_GATE = "'(?i)\\b(?:select|choose|pick|enter|add)\\b[^.!?]{0,80}?\\bto (?:see|view|get|show|check)\\b[^.!?]{0,30}?\\b(?:prices?|pricing|rates?|fares?|availability|cost|quotes?)\\b'"


@query("g30_interaction_flags", f"""{READS} SELECT event_id, nullif({squeeze_sql(f'regexp_extract(body, {_GATE})')}, '') AS needs_interaction,
  nullif({squeeze_sql(f'regexp_extract(body, {duck.text(fixed.EMPTY_LISTING)})')}, '') AS empty_listing FROM reads""")
def g30(t):
    return t.reads.select("event_id", grading.interaction_gate(F.col("body")).alias("needs_interaction"),
                          grading.empty_listing(F.col("body")).alias("empty_listing"))


@query("g32_second_opinion", """SELECT page_id, contains(html, '<script') AND (page_id % 3 = 0 OR page_id % 4 = 0) AS wants FROM pages""")
def g32(t):
    template = F.when(F.col("page_id") % 4 == 0, F.lit('<script type="text/x-template">{{a}} {{b}} <%= c %> {{d}}</script>')).otherwise("")
    text = F.when(F.col("page_id") % 3 == 0, "short").otherwise(F.repeat(F.lit("long text "), 60))
    return t.pages.select("page_id", grading.wants_second_opinion(F.concat("html", template), text, 400, 4).alias("wants"))


@query("g33_consent_leads", f"{READS} SELECT event_id, len(regexp_extract_all(body, {duck.text(fixed.CONSENT)})) >= 3 AS leads FROM reads")
def g33(t):
    return t.reads.select("event_id", texts.consent_leads(F.col("body")).alias("leads"))
