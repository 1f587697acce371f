"""Search-result queries over hits and query logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagegrain.functions import fixed, texts, urls
from pagegrain.operators import search
from pagegrain.plans import duck
from pagegrain.plans.registry import query
from pagegrain.plans.urls import _key_sql
from pagegrain.sources.tables import with_views

HITS, LOG = with_views("hits"), with_views("query_log")
def _now():
    return F.lit("1999-01-01 00:00:00").cast("timestamp")
_ID = "query_id, source, rank, item_id, url"
_CANON = _key_sql(f"regexp_replace({duck.path('url')}, '/index\\.(?:html?|php)$', '')", duck.like("split_part(x, '=', 1)", fixed.TRACK_CANONICAL))
_PLAIN = _key_sql(duck.path("url"), duck.like("x", fixed.TRACK_RESULT_KEY))
_POS = "source_pos * 1000 + rank"


def _hits(t):
    return t.hits.withColumn("pos", F.col("source_pos") * 1000 + F.col("rank")).withColumn("stars", F.col("extra_stars"))


def _checked(t):
    extra = {"stars": F.col("stars"), "fork": F.col("item_id") % 50 == 0, "archived": F.lit(False)}
    return search.check_results(_hits(t).withColumn("published", F.date_format("published", "yyyy-MM-dd HH:mm:ss")), t.hit_queries, _now(), extra)


@query("g15_on_query")
def g15(t):
    rows = search.with_result_words(_hits(t)).join(search.with_context(t.hit_queries), "query_id")
    return rows.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count_if(search.on_query()).alias("on_query"))


@query("g16_wrong_entity")
def g16(t):
    rows = search.with_result_words(_hits(t).withColumn("title", F.concat(F.lit("The Example of a "), "title"))).join(search.with_context(t.hit_queries), "query_id")
    return rows.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.count_if(search.wrong_entity()).alias("wrong"))


@query("g17_result_verdicts")
def g17(t):
    return _checked(t).select("query_id", "source", "rank", "item_id", "url", "passed", F.array_join("reasons", ",").alias("reasons"), "in_window", "kind")


@query("g18_repo_reasons", f"""{HITS} SELECT {_ID}, CASE WHEN item_id % 50 = 0 THEN 'fork' END AS fork, CASE WHEN extra_stars < 500 THEN 'low_stars' END AS low FROM hits""")
def g18(t):
    rows = _hits(t).withColumn("repo_name", F.lit("x")).withColumn("names", F.array(F.lit("y"))).withColumn("need", F.lit(True)).withColumn(
        "lookup", F.lit(False)).withColumn("code", F.lit(True))
    fork, _, low = search.repo_reasons({"stars": F.col("stars"), "fork": F.col("item_id") % 50 == 0, "archived": F.lit(False)})
    return rows.select("query_id", "source", "rank", "item_id", "url", fork.alias("fork"), low.alias("low"))


@query("g19_option_filter", f"""{HITS} SELECT coalesce(CASE WHEN {duck.bare_host('url')} = 'github.com' THEN 'excluded' WHEN NOT ({duck.bare_host('url')} = 'example.com' OR ends_with({duck.bare_host('url')}, '.example.com')) THEN 'off_site'
  WHEN published < timestamp '1999-01-01' - interval 366 day THEN 'too_old' END, 'kept') AS dropped, cast(count(*) AS bigint) AS n, cast(count(*) FILTER (published IS NULL) AS bigint) AS undated FROM hits GROUP BY 1""")
def g19(t):
    rows = search.filter_options(t.hits.withColumn("published", F.col("published").cast("timestamp")), _now(), ["github.com"], "example.com", "year")
    return rows.groupBy(F.coalesce("dropped", F.lit("kept")).alias("dropped")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("published").isNull()).alias("undated"))


_V = f"{HITS}, v AS (SELECT query_id, source, contains(title, 'ring') OR contains(title, 'gear') AS passed, CASE WHEN published IS NOT NULL THEN published >= timestamp '1997-01-01' END AS in_window, query_id % 2 = 0 AS windowed FROM hits)"


def _verdicts(t):
    return t.hits.select("query_id", "source", "url", "rank", "source_pos", (F.col("title").contains("ring") | F.col("title").contains("gear")).alias("passed"),
                         F.when(F.col("published").isNotNull(), F.col("published") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("in_window"),
                         (F.col("query_id") % 2 == 0).alias("windowed"))


@query("g20_set_verdicts", f"""{_V}, s AS (SELECT query_id, source, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (passed AND in_window IS NULL) AS undated, bool_or(windowed) AS w FROM v GROUP BY 1, 2),
c AS (SELECT *, passed - undated + CASE WHEN w THEN least(undated, 1) ELSE undated END AS counted FROM s)
SELECT query_id, source, cast(total AS bigint) AS total, cast(passed AS bigint) AS passed, cast(counted AS bigint) AS counted, CASE WHEN counted >= 3 THEN 'good' WHEN passed > 0 THEN 'weak' ELSE 'empty' END AS verdict FROM c""")
def g20(t):
    return search.set_verdicts(_verdicts(t)).select("query_id", "source", "total", "passed", "counted", "verdict")


@query("g21_unrelated_sets", f"{_V} SELECT query_id, source, NOT bool_or(passed) AS unrelated FROM v GROUP BY 1, 2")
def g21(t):
    return search.unrelated_sets(_verdicts(t).withColumn("on_query", F.col("passed")))


@query("g25_bench_judge", f"""{HITS} SELECT {_ID}, CASE WHEN NOT regexp_matches(title || ' ' || snippet, '(?i)\\b(ring|gear)s?\\b') THEN 'off_query,' ELSE '' END ||
  CASE WHEN published IS NULL THEN 'date_unverified,' WHEN NOT (published >= timestamp '1999-01-01' - interval 366 day AND published <= timestamp '1999-01-02') THEN 'outside_window,' ELSE '' END ||
  CASE WHEN regexp_matches(url, '^https?://[^/]+/?$') OR contains(url, '/tag/') THEN 'listing,' ELSE '' END || CASE WHEN regexp_matches(title, '(?i)just a moment') THEN 'challenge,' ELSE '' END AS why FROM hits""")
def g25(t):
    rows = t.hits.withColumn("entity", F.lit(r"(?i)\b(ring|gear)s?\b")).withColumn("page_title", F.lit(None).cast("string")).withColumn(
        "page_text", F.lit(None).cast("string")).withColumn("recency", F.lit("year")).withColumn("specific", F.lit(True)).withColumn("published", F.col("published").cast("timestamp"))
    why = F.array_join(F.transform("why", lambda item: F.concat(item, F.lit(","))), "")
    return search.bench_judge(rows, _now()).select("query_id", "source", "rank", "item_id", "url", why.alias("why"))


@query("g27_verticals")
def g27(t):
    rows = t.query_log.withColumn("v", search.infer_vertical(F.col("query"), F.col("recency"), F.size(texts.entity_runs("query")) > 0))
    return rows.select("query_id", "query", "v.vertical", "v.reason")


@query("g28_query_kinds", f"""{LOG}, w AS (SELECT query_id, query, recency, list_transform(regexp_extract_all(regexp_replace(regexp_replace(query, '\\S+:\\S*', ' ', 'g'), '(^|\\s)-\\S+', ' ', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x)) AS words FROM query_log)
SELECT query_id, CASE WHEN recency IS NOT NULL THEN 'announcement,' ELSE '' END || CASE WHEN list_has_any(words, {duck.words(fixed.CODE_WORDS)}) THEN 'code,' ELSE '' END ||
  CASE WHEN {duck.like('query', fixed.FACT_LEAD)} OR {duck.like('query', fixed.FACT_PHRASE)} THEN 'fact,' ELSE '' END AS kinds FROM w""")
def g28(t):
    kinds = search.query_kinds(F.col("query"), F.lit("web"), F.col("recency"))
    return t.query_log.select("query_id", F.array_join(F.transform(kinds, lambda kind: F.concat(kind, F.lit(","))), "").alias("kinds"))


@query("g29_phrase_groups", """SELECT doc_id, (contains(lower(text), 'the ') OR contains(lower(text), 'der ')) AND (contains(lower(text), 'and') OR contains(lower(text), ' la ')) AS matches FROM documents""")
def g29(t):
    groups = F.array(F.array(F.lit("The "), F.lit("der ")), F.array(F.lit("and"), F.lit(" la ")))
    return t.documents.select("doc_id", texts.phrase_groups_match(groups, F.col("text")).alias("matches"))


@query("g31_set_demotions")
def g31(t):
    rows = _checked(t)
    return rows.groupBy("query").agg(F.count_if(F.array_contains("reasons", "stock_blurb")).alias("blurbs"), F.count_if("phrase_passes").alias("phrased"))


@query("g34_anchor_reasons")
def g34(t):
    rows = search.with_result_words(_hits(t)).join(search.with_context(t.hit_queries), "query_id")
    return rows.groupBy("query", search.anchor_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("w3_duplicates", f"""{HITS}, k AS (SELECT *, {_CANON} AS key, {_POS} AS pos FROM hits) SELECT {_ID}, pos > min(pos) OVER (PARTITION BY query_id, key) AS duplicate FROM k""")
def w3(t):
    rows = _hits(t).withColumn("key", urls.canonical_url("url"))
    first = rows.groupBy("query_id", "key").agg(F.min("pos").alias("first"))
    return rows.join(first, ["query_id", "key"]).select("query_id", "source", "rank", "item_id", "url", (F.col("pos") > F.col("first")).alias("duplicate"))


@query("w14_compact_titles")
def w14(t):
    rows = t.hits.join(t.hit_queries.select("query_id", "query", texts.families(texts.key_terms("query")).alias("known")), "query_id")
    return rows.groupBy("query").agg(F.count_if(texts.compact(F.col("known"), texts.tokens(F.col("title")))).alias("compact"), F.count(F.lit(1)).alias("n"))


@query("o1_relevance")
def o1(t):
    return _checked(t).select("query_id", "source", "rank", "item_id", "url", "relevance")


_REL = "CASE WHEN contains(title, 'ring') THEN 4.0 WHEN contains(title, 'red') THEN 2.0 ELSE 0.5 END"


def _rel():
    return F.when(F.col("title").contains("ring"), 4.0).when(F.col("title").contains("red"), 2.0).otherwise(0.5)


@query("o2_accepted_order", f"""{HITS}, u AS (SELECT *, ({_POS}) * 100000 + item_id AS pos, query_id % 2 = 0 AND NOT coalesce(published >= timestamp '1997-01-01', false) AS late,
  {_REL} + 4 * CASE source WHEN 'searxng' THEN 0.75 WHEN 'wikipedia' THEN 0.6 ELSE 0.5 END AS score FROM hits WHERE NOT contains(title, 'moment'))
SELECT query_id, pos, url, cast(row_number() OVER (PARTITION BY query_id ORDER BY late, -score, pos, url) AS bigint) AS rank FROM u""")
def o2(t):
    rows = t.hits.withColumn("pos", (F.col("source_pos") * 1000 + F.col("rank")) * 100_000 + F.col("item_id"))
    prior = F.when(F.col("source") == "searxng", 0.75).when(F.col("source") == "wikipedia", 0.6).otherwise(0.5)
    rows = rows.select("query_id", "pos", "url", (~F.col("title").contains("moment")).alias("passed"), (F.col("query_id") % 2 == 0).alias("windowed"), _rel().alias("relevance"), prior.alias("prior"),
                       F.when(F.col("published").isNotNull(), F.col("published") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("in_window"))
    return search.accepted(rows, ("pos", "url")).select("query_id", "pos", "url", "rank")


def _rrf(key: str) -> str:
    return f"""{HITS}, k AS (SELECT *, {key} AS page_key FROM hits),
f AS (SELECT query_id, page_key, sum(1.0::double / (60 + rank)) AS fusion, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min((source_pos, rank, url)) AS first FROM k GROUP BY 1, 2)
SELECT query_id, page_key, round(fusion, 5) AS score, sources, cast(row_number() OVER (PARTITION BY query_id ORDER BY -round(fusion, 12), first, page_key) AS bigint) AS place FROM f"""


@query("o3_rank_fusion", _rrf(_CANON))
def o3(t):
    return search.merge(search.fuse(t.hits, urls.canonical_url("url"))).select("query_id", "page_key", "score", F.array_join("sources", ",").alias("sources"), "place")


@query("o4_plain_merge", _rrf(_PLAIN))
def o4(t):
    return search.merge(search.fuse(t.hits, urls.result_key("url"))).select("query_id", "page_key", "score", F.array_join("sources", ",").alias("sources"), "place")


@query("o5_anchored_answers")
def o5(t):
    keyed = _hits(t).withColumn("key", urls.canonical_url("url"))
    slots = Window.partitionBy("query_id").orderBy("rank", "item_id", "url")
    anchor = keyed.where(F.col("source") == "searxng").select("query_id", F.row_number().over(slots).alias("slot"), "url", "key", F.col("title").contains("moment").alias("failed"))
    others = keyed.where(F.col("source") != "searxng").groupBy("query_id", "key").agg(F.min("pos").alias("pos"), F.min_by("url", "pos").alias("url"),
                                                                                      F.max(F.col("url").contains("github.com")).alias("canonical"))
    return search.anchored_answers(anchor, others, 5)


@query("o6_demotions", f"""{HITS}, u AS (SELECT query_id, url, ({_POS}) * 100000 + item_id AS pos, source = 'wikipedia' AS last FROM hits)
SELECT query_id, pos, url, cast(row_number() OVER (PARTITION BY query_id ORDER BY last, pos, url) AS bigint) AS place FROM u""")
def o6(t):
    rows = t.hits.select("query_id", "url", ((F.col("source_pos") * 1000 + F.col("rank")) * 100_000 + F.col("item_id")).alias("pos"), (F.col("source") == "wikipedia").alias("last"))
    return search.demote(rows, F.col("last"), F.floor(F.col("pos") / 10_000_000_000), [F.col("pos"), F.col("url")]).select("query_id", "pos", "url", "place")


@query("o7_reference_rank", """WITH r AS (SELECT p_size AS query_id, p_partkey AS pos, CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN p_name || ' (film)' WHEN 2 THEN p_name || ' works' ELSE 'Other' END AS title, 'red ring' AS topic FROM part),
t AS (SELECT *, CASE WHEN pos % 4 = 1 THEN 3 WHEN pos % 4 = 0 AND title = 'The red ring' THEN 0 WHEN pos % 4 IN (0, 2) AND contains(title, 'red ring') THEN 1 ELSE 2 END AS tier FROM r)
SELECT query_id, pos, tier, cast(row_number() OVER (PARTITION BY query_id ORDER BY tier, pos) AS bigint) AS place FROM t""")
def o7(t):
    at = F.col("p_partkey") % 4
    title = F.when(at == 0, F.concat(F.lit("The "), "p_name")).when(at == 1, F.concat("p_name", F.lit(" (film)"))).when(at == 2, F.concat("p_name", F.lit(" works"))).otherwise("Other")
    rows = t.part.select(F.col("p_size").alias("query_id"), F.col("p_partkey").alias("pos"), title.alias("title"), F.lit("").alias("snippet"), F.lit("red ring").alias("topic"))
    return search.reference_rank(rows).select("query_id", "pos", "tier", "place")


@query("o15_date_targets", f"""{HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, url, source, item_id) AS turn FROM hits WHERE published IS NULL AND rank <= 5)
SELECT query_id, source, rank, item_id, url, cast(turn AS integer) AS turn FROM n WHERE turn <= 2""")
def o15(t):
    rows = t.hits.withColumn("in_window", F.when(F.col("published").isNotNull(), True))
    return search.date_targets(rows, 5, 2, ("rank", "url", "source", "item_id")).select("query_id", "source", "rank", "item_id", "url", "turn")


@query("k20_source_priors", f"""{HITS} SELECT {_ID}, cast(CASE WHEN source = 'wikipedia' AND starts_with(title, 'red') THEN 0.9 WHEN source = 'github' AND extra_stars >= 1000 THEN 0.85
  WHEN source = 'searxng' THEN 0.75 WHEN source = 'wikipedia' THEN 0.6 ELSE 0.5 END AS double) AS prior FROM hits""")
def k20(t):
    prior = search.source_prior(F.col("source"), F.lit(None).cast("double"), F.col("title").startswith("red"), F.lit(False), F.col("extra_stars"))
    return t.hits.select("query_id", "source", "rank", "item_id", "url", prior.alias("prior"))


@query("k21_date_enrichment", f"""{HITS}, h AS (SELECT *, {_CANON} AS k FROM hits), d AS (SELECT k, min(published) AS p FROM h WHERE published IS NOT NULL GROUP BY k)
SELECT {_ID}, CASE WHEN published IS NOT NULL THEN 'source' WHEN p IS NOT NULL THEN 'page' END AS date_source, strftime(coalesce(published, p), '%Y-%m-%d') AS published FROM h LEFT JOIN d USING (k)""")
def k21(t):
    dates = t.hits.where(F.col("published").isNotNull()).select("url", "published")
    return search.enrich_dates(t.hits, dates).select("query_id", "source", "rank", "item_id", "url", "date_source", F.date_format("published", "yyyy-MM-dd").alias("published"))
