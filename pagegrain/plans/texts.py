"""Text columns over documents, cards, queries and derived spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import fixed, prices, texts, urls
from pagegrain.plans import duck
from pagegrain.plans.registry import query
from pagegrain.sources.tables import with_views

def _now():
    return F.lit("2026-10-12 12:00:00").cast("timestamp")


@query("t1_key_terms")
def t1(t):
    return t.query_log.select("query_id", F.array_join(texts.key_terms("query"), " ").alias("terms"),
                              F.array_join(texts.raw_terms("query"), " ").alias("raw_terms"))


@query("t2_stem", """
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT word, CASE WHEN ends_with(word, 'es') AND length(word) >= 5 THEN left(word, length(word) - 2)
  WHEN ends_with(word, 's') AND length(word) >= 4 THEN left(word, length(word) - 1) ELSE word END AS stem FROM w""")
def t2(t):
    found = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return found.distinct().select("word", texts.stem(F.col("word")).alias("stem"))


@query("t3_term_match")
def t3(t):
    log = t.query_log.select("query_id", F.lower("query").alias("text"), F.explode(
        texts.families(texts.key_terms("query"))).alias("family"))
    title = F.lit("Widgets, gears and rings: serialized papers on learning")
    return log.select("query_id", "family.term",
                      texts.has_term(F.col("family"), texts.tokens(F.col("text"))).alias("in_own_query"),
                      texts.has_term(F.col("family"), texts.tokens(title)).alias("in_title"))


@query("t4_enough_terms")
def t4(t):
    known = t.query_log.select("query_id", "query", texts.families(texts.key_terms("query")).alias("known"))
    text = F.concat_ws(" ", "title", "url", "snippet")
    rows = (t.hits.select(F.col("item_id").alias("query_id"), texts.tokens(text).alias("found"))
            .join(known, "query_id"))
    return rows.groupBy("query").agg(
        F.count(F.lit(1)).alias("hits"),
        F.count_if(texts.enough_terms(F.col("known"), F.col("found"), F.lit(False))).alias("enough"))


@query("t5_price_scan")
def t5(t):
    found = prices.with_prices(t.card_text, F.col("body"), "prices").select("card_id", F.posexplode("prices").alias("pos", "p"))
    return found.select("card_id", "pos", "p.value", "p.role", "p.currency", "p.upto")


@query("t6_single_offer", """SELECT p_partkey AS card_id, cast(p_size * 2 + 10 AS double) AS price, CAST(NULL AS double) AS price_max,
  CASE WHEN p_size * 3 + 20.5 > p_size * 2 + 10 THEN cast(p_size * 3 + 20 AS double) + 0.5 END AS was_price, CAST(NULL AS varchar) AS currency
FROM part""")
def t6(t):
    return prices.with_single_offer(t.card_text, F.col("body"), "offer").select("card_id", "offer.*")


@query("t7_multi_offer")
def t7(t):
    line = F.concat(F.col("title"), F.lit(" from $129 Delivered, White "), F.col("title"), F.lit(" $159 (Was $259), Case $"),
                    (F.col("card_id") % 50 + 1).cast("string"))
    rows = prices.with_offer(t.card_text.select("card_id", "title", line.alias("line")), F.col("line"),
                             F.concat(F.lit("White "), F.col("title")), "offer")
    return rows.select("card_id", F.size("offer_offers").alias("offers"), "offer.price", "offer.was_price")


CARDS = with_views("card_text")


@query("t8_availability", f"""{CARDS} SELECT card_id, CASE WHEN {duck.like('body', fixed.EXPIRED)} THEN 'expired'
  WHEN {duck.like('body', fixed.OUT_OF_STOCK)} THEN 'out_of_stock' WHEN {duck.like('body', fixed.LIMITED)} THEN 'limited'
  WHEN {duck.like('body', fixed.IN_STOCK)} THEN 'in_stock' END AS availability FROM card_text""")
def t8(t):
    return t.card_text.select("card_id", texts.availability(F.col("body")).alias("availability"))


_STOCK = duck.text("(?i)(?:^|[^$0-9.,a-z])(?:only[ \\t]+)?([0-9]{1,5})[ \\t]+(?:units?\\b|left\\b|(?:items?[ \\t]+)?in[ \\t]+stock\\b|"
                   "available\\b)|\\bstock[ \\t:]{0,3}([0-9]{1,5})\\b")


@query("t9_stock_count", f"""{CARDS} SELECT card_id,
  try_cast(nullif(regexp_extract(body, {_STOCK}, 1) || regexp_extract(body, {_STOCK}, 2), '')
  AS integer) AS stock_count FROM card_text""")
def t9(t):
    return t.card_text.select("card_id", texts.stock_count(F.col("body")).alias("stock_count"))


@query("t10_date_mention", f"""{CARDS} SELECT card_id, nullif(regexp_extract(body,
  '(?i)\\b(?:[0-9]+ days? ago|[0-9]{{1,2}} (?:Jan|Feb|Mar|Apr)[a-z]* [0-9]{{4}})\\b'), '') AS date_mention FROM card_text""")
def t10(t):
    return t.card_text.select("card_id", texts.date_mention(F.col("body")).alias("date_mention"))


def _rating_sql() -> str:
    groups = ", ".join(f"try_cast(nullif(regexp_extract(body, {duck.text(fixed.RATING)}, {g}), '') AS double)" for g in (1, 2, 3, 4))
    return f"{CARDS}, r AS (SELECT card_id, coalesce({groups}) AS v FROM card_text) " \
           "SELECT card_id, CASE WHEN v > 0 AND v <= 5 THEN v END AS rating FROM r"


@query("t11_rating", _rating_sql())
def t11(t):
    return t.card_text.select("card_id", texts.rating(F.col("body")).alias("rating"))


_NOUN = f"lower(regexp_extract(body, {duck.text(fixed.COUNTED)}, 2))"


@query("t12_counted", f"""{CARDS} SELECT card_id,
  try_cast(replace(regexp_extract(body, {duck.text(fixed.COUNTED)}, 1), ',', '') AS bigint) AS count_value,
  CASE WHEN {_NOUN} = '' THEN NULL WHEN ends_with({_NOUN}, 's') THEN {_NOUN} ELSE {_NOUN} || 's' END AS count_of FROM card_text""")
def t12(t):
    return t.card_text.select("card_id", texts.counted(F.col("body")).alias("count_value"),
                              texts.counted_noun(F.col("body")).alias("count_of"))


@query("t13_location")
def t13(t):
    body = F.concat(F.col("title"), F.when(F.col("card_id") % 3 == 0, "\nLocation: Town Hall, Springfield").when(
        F.col("card_id") % 3 == 1, "\nSpringfield, NSW 2000").otherwise("\nno place"))
    return t.card_text.select("card_id", texts.location(body).alias("location"))


@query("t14_sponsored", f"""{CARDS}, b AS (SELECT card_id, title || CASE card_id % 3 WHEN 0 THEN chr(10) || 'Sponsored ad' || chr(10) || body
  WHEN 1 THEN ' sponsored' ELSE chr(10) || ' Ad ' END AS txt FROM card_text)
SELECT card_id, {duck.like('txt', '(?i)(?m)^\\s*(?:sponsored(?:\\s+ad)?|advertisement|promoted|ad)\\s*$')} AS sponsored FROM b""")
def t14(t):
    text = F.concat(F.col("title"), F.when(F.col("card_id") % 3 == 0, F.concat(F.lit("\nSponsored ad\n"), "body")).when(
        F.col("card_id") % 3 == 1, " sponsored").otherwise("\n Ad "))
    return t.card_text.select("card_id", texts.sponsored(text).alias("sponsored"))


_RAW = "regexp_extract(txt, '-?[0-9][0-9.,]*[0-9]|-?[0-9]')"


@query("t15_locale_number", f"""{with_views('number_text')}, r AS (SELECT event_id, nullif({_RAW}, '') AS raw FROM number_text),
d AS (SELECT *, contains(raw, ',') AS comma, contains(raw, '.') AS dot, replace(raw, ',', '') AS nc, replace(raw, '.', '') AS nd FROM r)
SELECT event_id, try_cast(CASE WHEN comma AND dot AND regexp_matches(raw, '\\.[^,]*$') THEN nc WHEN comma AND dot THEN replace(nd, ',', '.')
  WHEN comma AND regexp_matches(raw, '^-?[0-9]{{1,3}}(,[0-9]{{3}})+$') THEN nc WHEN comma THEN replace(raw, ',', '.')
  WHEN length(raw) - length(nd) > 1 THEN nd ELSE raw END AS double) AS value FROM d""")
def t15(t):
    return t.number_text.select("event_id", texts.locale_number(F.col("txt")).alias("value"))


@query("t16_lenient_timestamp", f"""{with_views('date_text')} SELECT event_id, cast(epoch(CASE
  WHEN regexp_matches(txt, '^[0-9]{{9,11}}$') THEN to_timestamp(try_cast(txt AS bigint))
  WHEN regexp_matches(txt, '^[0-9]{{4}}-') AND regexp_matches(txt, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') AND contains(txt, 'T')
    THEN try_cast(txt AS timestamptz)
  WHEN regexp_matches(txt, '^[0-9]{{4}}-') THEN try_cast(txt || CASE WHEN contains(txt, ':') THEN '+00' ELSE ' 00:00:00+00' END AS timestamptz)
  ELSE try_strptime(replace(regexp_replace(txt, '^[A-Za-z]{{3}}, ', ''), 'GMT', '+0000'), '%d %b %Y %H:%M:%S %z') END) AS bigint) AS seconds
FROM date_text""")
def t16(t):
    return t.date_text.select("event_id", F.unix_timestamp(texts.lenient_timestamp("txt")).alias("seconds"))


@query("t17_lead_date")
def t17(t):
    return t.date_text.select("event_id", texts.lead_date(F.col("snippet"), _now()).cast("string").alias("lead_date"))


@query("t18_published")
def t18(t):
    found = texts.published(F.when(F.col("event_id") % 3 == 0, F.col("txt")), F.col("snippet"), F.lit("A title"),
                            F.lit("https://a.test/2026/10/05/story"), _now())
    return t.date_text.select("event_id", found["at"].cast("string").alias("published"), found["origin"].alias("origin"))


_TITLE_WORDS = "regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[\\p{L}\\p{N}]+')"


@query("t19_story_key", f"""SELECT page_id, CASE WHEN len({_TITLE_WORDS}) >= 4
  THEN array_to_string({_TITLE_WORDS}, ' ') END AS story FROM pages""")
def t19(t):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t.pages.select("page_id", texts.story_key(title).alias("story"))


@query("t20_fingerprint", r"""SELECT doc_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS fingerprint
FROM documents""")
def t20(t):
    return t.documents.select("doc_id", texts.fingerprint(F.col("text")).alias("fingerprint"))


@query("t21_line_shape")
def t21(t):
    lines = t.documents.select("doc_id", F.posexplode(texts.lines_of(F.col("text"))).alias("pos", "line"))
    marked = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("["), "line", F.lit("](https://a.test/x)"))).otherwise(F.col("line"))
    return lines.select("doc_id", "pos", F.round(texts.link_share(marked), 4).alias("link_share"),
                        texts.body_line(marked).alias("body_line"))


# The generated prose has no markdown, so a line's visible text is the line itself.
@query("t22_paragraphs", r"""SELECT doc_id, cast(len(list_filter(string_split_regex(text, '\r\n|\n'), lambda x:
  length(regexp_replace(x, '^[ *#>|-]+|[ *#>|-]+$', '', 'g')) >= 80)) AS integer) AS paragraphs FROM documents""")
def t22(t):
    return t.documents.select("doc_id", texts.paragraphs(F.col("text")).alias("paragraphs"))


_MIX = "text || CASE doc_id % 4 WHEN 0 THEN ' We use cookies. Cookie consent: accept all cookies.' WHEN 1 THEN ' cookie' ELSE '' END"


@query("t23_consent_only", f"""WITH d AS (SELECT doc_id, len(regexp_extract_all({_MIX}, '\\S+')) AS words,
  len(regexp_extract_all({_MIX}, {duck.text(fixed.CONSENT)})) AS hits FROM documents)
SELECT doc_id, words > 0 AND words < 400 AND hits >= 3 AND hits / words > 0.02 AS consent_only FROM d""")
def t23(t):
    text = F.concat("text", F.when(F.col("doc_id") % 4 == 0, " We use cookies. Cookie consent: accept all cookies.").when(
        F.col("doc_id") % 4 == 1, " cookie").otherwise(""))
    return t.documents.select("doc_id", texts.consent_only(text).alias("consent_only"))


RESPONSES = with_views("responses")


@query("t24_status_failure", f"""{RESPONSES} SELECT event_id, CASE WHEN status = 401 THEN 'AUTH_REQUIRED' WHEN status = 403 THEN 'BLOCKED'
  WHEN status = 429 THEN 'RATE_LIMITED' WHEN status IN (404, 410) THEN 'NOT_FOUND' WHEN status BETWEEN 400 AND 499 THEN 'UNKNOWN'
  WHEN status >= 500 THEN 'PROVIDER_DOWN' END AS failure FROM responses""")
def t24(t):
    return t.responses.select("event_id", texts.status_failure(F.col("status")).alias("failure"))


_H = "(' ' || lower(replace(headers, ';', ' ')))"
_B = "lower(body)"


def _named(name):
    return f"contains({_H}, ' {name}=')"


def _has(where, word):
    return f"contains({where}, '{word}')"


@query("t25_wall_vendor", f"""{RESPONSES} SELECT event_id, CASE
  WHEN {_named('cf-ray')} OR {_named('cf-mitigated')} OR {_has(_H, 'server=cloudflare')} OR {_has(_B, '/cdn-cgi/challenge')} THEN 'cloudflare'
  WHEN {_named('x-datadome')} OR {_has(_H, 'datadome=')} OR {_has(_B, 'captcha-delivery.com')} THEN 'datadome'
  WHEN {_named('x-px')} OR ({_has(_H, '_px')} AND {_named('set-cookie')}) OR {_has(_B, 'perimeterx')} OR {_has(_B, 'px-captcha')} THEN 'perimeterx'
  WHEN {_named('x-kpsdk-ct')} OR {_named('x-kpsdk-r')} OR {_has(_B, 'kpsdk')} THEN 'kasada'
  WHEN {_has(_H, 'incap_ses')} OR {_has(_H, 'visid_incap')} OR {_named('x-iinfo')} OR {_has(_B, 'incapsula')} THEN 'imperva'
  WHEN {_has(_H, 'akamaighost')} OR {_named('akamai-grn')} OR {_has(_H, '_abck=')} OR {_has(_H, 'bm_sz=')} THEN 'akamai'
  WHEN {_named('x-amzn-waf-action')} OR {_has(_H, 'aws-waf-token')} OR {_has(_B, 'awswaf')} THEN 'aws_waf'
  WHEN {_named('x-vercel-mitigated')} OR {_has(_B, 'vercel security checkpoint')} THEN 'vercel'
  WHEN {_named('x-sucuri-id')} OR {_has(_B, 'sucuri website firewall')} THEN 'sucuri' END AS vendor FROM responses""")
def t25(t):
    headers = F.str_to_map("headers", F.lit(";"), F.lit("="))
    return t.responses.select("event_id", texts.wall_vendor(headers, F.col("body")).alias("vendor"))


@query("t26_stock_blurb", f"""{with_views('hits')} SELECT query_id, source, rank, item_id, url,
  {duck.like('title', fixed.STOCK_BLURB_PHRASE)} OR ({duck.like('title', fixed.STOCK_BLURB_TICKER)} AND
  ({duck.like('title', fixed.STOCK_BLURB_MARKET)} OR {duck.like('title', fixed.STOCK_BLURB_TRADING)})) AS blurb FROM hits""")
def t26(t):
    return t.hits.select("query_id", "source", "rank", "item_id", "url", texts.stock_blurb(F.col("title")).alias("blurb"))


_ANS = "trim(regexp_extract_all(txt, 'ANSWER:\\s*(.+)', 1)[-1])"


@query("t27_answer_grade", f"""{with_views('answers')}, a AS (SELECT conv_id, turn, {_ANS} AS answer FROM answers)
SELECT conv_id, turn, answer, coalesce(contains(lower(answer), 'the answer') OR contains(lower(answer), 'user'), false) AS by_words,
  coalesce(regexp_matches(answer, '(?i)^CODE-'), false) AS by_pattern,
  coalesce(len(list_filter(regexp_extract_all(answer, '-?[0-9][0-9,]*\\.?[0-9]*'), lambda n: abs(try_cast(replace(n, ',', '') AS double) - 42) <= 3)) > 0,
    false) AS by_number FROM a""")
def t27(t):
    rows = t.answers.select("conv_id", "turn", texts.final_answer(F.col("txt")).alias("answer"))
    answer = F.col("answer")
    return rows.select("conv_id", "turn", "answer", texts.answer_contains(answer, ["The Answer", "user"]).alias("by_words"),
                       texts.answer_matches(answer, "^CODE-").alias("by_pattern"),
                       texts.answer_number(answer, F.lit(42.0), F.lit(3.0)).alias("by_number"))


@query("t28_prose_line", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, cast(count(*) AS bigint) AS n_lines, cast(count(*) FILTER (len(regexp_extract_all(line, '\\S+')) >= 8 AND
  {duck.like('rtrim(line)', fixed.SENTENCE_END)}) AS bigint) AS n_prose FROM l GROUP BY doc_id""")
def t28(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"),
                                       F.count_if(texts.prose_line(F.col("line"))).alias("n_prose"))


@query("t29_parse_price")
def t29(t):
    return prices.with_parsed_price(t.number_text, F.col("txt"), "price").select("event_id", "price")


@query("t30_reference_topic")
def t30(t):
    return t.query_log.select("query_id", texts.question_topic(F.col("query")).alias("topic"),
                              texts.reference_topic(F.col("query")).alias("reference_topic"))


_TERMS = (f"list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'), lambda w: length(w) >= 2 AND "
          f"NOT list_contains({duck.words(fixed.SITE_STOP)}, w)))")


@query("t31_site_match", f"""{with_views('hits')}, j AS (SELECT h.query_id, h.source, h.rank, h.item_id, h.url,
  lower(h.title || ' ' || h.snippet || ' ' || regexp_replace({duck.path('h.url')}, '[-_]', ' ', 'g')) AS hay, {_TERMS} AS terms
  FROM hits h JOIN part p ON p.p_partkey = h.item_id)
SELECT query_id, source, rank, item_id, url, len(terms) = 0 OR len(list_filter(terms, lambda w: contains(hay, w))) >=
  CASE WHEN len(terms) <= 2 THEN len(terms) ELSE ceil(len(terms) * 3 / 5) END AS matches FROM j""")
def t31(t):
    rows = t.hits.join(t.part, F.col("p_partkey") == F.col("item_id"))
    terms = texts.site_terms(F.concat_ws(" ", "p_name", "p_type"))
    return rows.select("query_id", "source", "rank", "item_id", "url",
                       texts.site_match(F.col("title"), F.col("snippet"), "url", terms).alias("matches"))


@query("t32_named_site")
def t32(t):
    return t.query_log.select("query_id", texts.named_site(F.col("query")).alias("s")).select("query_id", "s.site", "s.rest")


@query("t33_entities")
def t33(t):
    return t.query_log.select("query_id", F.array_join(texts.entities("query"), " | ").alias("entities"))


@query("t34_strip_json_prefix", r"""SELECT event_id, regexp_replace(CASE event_id % 6 WHEN 0 THEN 'for (;;);' || props
  WHEN 1 THEN ')]}''' || chr(10) || props WHEN 2 THEN ' while(1); ' || props WHEN 3 THEN '&&&START&&&,' || props ELSE props END,
  '^[ \t\r\n]*(?:for \(;;\);|for\(;;\);|\)\]\}''|while\(1\);|while \(1\);|&&&START&&&)[,\r\n ]*', '') AS body FROM events""")
def t34(t):
    at, props = F.col("event_id") % 6, F.col("props")
    body = (F.when(at == 0, F.concat(F.lit("for (;;);"), props)).when(at == 1, F.concat(F.lit(")]}'\n"), props))
            .when(at == 2, F.concat(F.lit(" while(1); "), props)).when(at == 3, F.concat(F.lit("&&&START&&&,"), props))
            .otherwise(props))
    return t.events.select("event_id", texts.strip_json_prefix(body).alias("body"))
