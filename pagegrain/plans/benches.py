"""Benchmark summaries, pairs, pools and the joins around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions.stats import exact_two_sided
from pagegrain.operators import bench, joins
from pagegrain.plans import duck
from pagegrain.plans.registry import query
from pagegrain.sources.tables import with_views

BENCH, HITS, ATTEMPTS = with_views("bench_rows"), with_views("hits"), with_views("attempts")


def _rows(t):
    return t.bench_rows


@query("a3_scoreboard", f"""{BENCH} SELECT wall, cast(count(*) AS bigint) AS cases, round(avg((status = 'observed')::int), 4) AS completion, string_agg(DISTINCT failure, ',' ORDER BY failure) AS failures,
  cast(count(*) FILTER (status = 'observed' AND text_chars < 1000 AND content_type = 'text/html') AS bigint) AS thin_observed, round(median(latency_ms) FILTER (status = 'observed'), 4) AS p50_latency_ms,
  round(median(tokens) FILTER (status = 'observed'), 4) AS median_tokens, round(sum(cost_usd), 4) AS cost_usd FROM bench_rows GROUP BY wall""")
def a3(t):
    return bench.scoreboard(_rows(t)).select("wall", "cases", F.round("completion", 4).alias("completion"), F.array_join("failures", ",").alias("failures"), "thin_observed",
                                             F.round("p50_latency_ms", 4).alias("p50_latency_ms"), F.round("median_tokens", 4).alias("median_tokens"), F.round("cost_usd", 4).alias("cost_usd"))


@query("a4_tool_summary", f"""{BENCH}, r AS (SELECT *, row_number() OVER (PARTITION BY arm, set_name, valid ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY arm, set_name, valid) AS nv FROM bench_rows)
SELECT arm, set_name, cast(count(*) AS bigint) AS cases, cast(count(*) FILTER (valid) AS bigint) AS valid, cast(count(*) FILTER (status = 'observed' AND NOT valid) AS bigint) AS false_success,
  round(max(latency_ms) FILTER (valid AND i = nv // 2), 4) AS p50_ms, round(max(latency_ms) FILTER (valid AND i = cast(floor(nv * 0.9) AS bigint)), 4) AS p90_ms, round(avg(latency_ms), 4) AS mean_ms_all,
  round(coalesce(sum(cost_usd), 0), 4) AS cost_usd, cast(count(*) FILTER (cost_usd IS NULL AND arm = 'paid') AS bigint) AS cost_unknown,
  round(CASE WHEN count(*) FILTER (valid) > 0 THEN coalesce(sum(cost_usd), 0) / count(*) FILTER (valid) * 1000 END, 4) AS usd_per_1k_valid FROM r GROUP BY arm, set_name""")
def a4(t):
    found = bench.tool_summary(_rows(t), ["arm", "set_name"])
    rounded = [F.round(name, 4).alias(name) for name in ("p50_ms", "p90_ms", "mean_ms_all", "cost_usd", "usd_per_1k_valid")]
    return found.select("arm", "set_name", "cases", "valid", "false_success", "cost_unknown", *rounded)


@query("a5_union_of_tools", f"""{BENCH}, u AS (SELECT set_name, url, bool_or(valid AND arm <> 'paid') AS c FROM bench_rows GROUP BY 1, 2)
SELECT set_name, cast(count(*) AS bigint) AS cases, cast(count(*) FILTER (c) AS bigint) AS valid FROM u GROUP BY set_name""")
def a5(t):
    return bench.union_of_tools(_rows(t), "set_name", ("paid",))


@query("a6_weekly_summary", f"""{BENCH}, r AS (SELECT *, row_number() OVER (PARTITION BY arm, valid ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY arm, valid) AS nv FROM bench_rows)
SELECT arm, cast(count(*) AS bigint) AS sites, cast(count(*) FILTER (valid) AS bigint) AS "read", round(count(*) FILTER (valid) / count(*), 4) AS rate, round(median(latency_ms) FILTER (valid) / 1000, 3) AS median_s,
  round(max(latency_ms) FILTER (valid AND i = cast(floor(nv * 0.9) AS bigint)) / 1000, 3) AS p90_s, round(sum(cost_usd), 4) AS cost_usd FROM r GROUP BY arm""")
def a6(t):
    return bench.weekly_summary(_rows(t)).select("arm", "sites", "read", F.round("rate", 4).alias("rate"), F.round("median_s", 3).alias("median_s"), F.round("p90_s", 3).alias("p90_s"),
                                                 F.round("cost_usd", 4).alias("cost_usd"))


@query("a7_site_summary", f"""{BENCH}, g AS (SELECT *, GROUPING(arm, kind, wall) AS g, arm AS ga, kind AS gk, wall AS gw FROM (
  SELECT arm, kind, wall, count(*) AS cases, count(*) FILTER (status = 'observed') AS observed, count(*) FILTER (valid) AS valid, round(median(latency_ms) FILTER (status = 'observed'), 4) AS p50_latency_ms,
  round(coalesce(sum(cost_usd), 0), 4) AS cost_usd, string_agg(DISTINCT failure, ',' ORDER BY failure) AS failures, string_agg(DISTINCT invalid_reason, ',' ORDER BY invalid_reason) AS invalid
  FROM bench_rows GROUP BY GROUPING SETS ((), (arm), (kind), (wall))) x GROUP BY ALL)
SELECT CASE WHEN arm IS NOT NULL THEN 'arm' WHEN kind IS NOT NULL THEN 'kind' WHEN wall IS NOT NULL THEN 'wall' ELSE 'overall' END AS dim, coalesce(arm, kind, wall, '') AS value,
  cast(cases AS bigint) AS cases, cast(observed AS bigint) AS observed, cast(valid AS bigint) AS valid, p50_latency_ms, cost_usd, failures, invalid FROM g""".replace(", g AS (SELECT *, GROUPING(arm, kind, wall) AS g, arm AS ga, kind AS gk, wall AS gw FROM (", ", g AS (").replace(") x GROUP BY ALL)", ")"))
def a7(t):
    found = bench.site_summary(_rows(t), ["arm", "kind", "wall"])
    return found.select("dim", "value", "cases", "observed", "valid", F.round("p50_latency_ms", 4).alias("p50_latency_ms"), F.round("cost_usd", 4).alias("cost_usd"),
                        F.array_join("failures", ",").alias("failures"), F.array_join("invalid", ",").alias("invalid"))


# Search bench rows: one per arm (source of the hits) and query.
_SB = f"""{HITS}, sb AS (SELECT source AS arm, query_id, CASE query_id % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'code' WHEN 2 THEN 'web' ELSE 'docs' END AS category, count(*) AS n_results,
  bool_or(contains(title, 'ring')) AS hit, count(*) FILTER (contains(title, 'ring')) / count(*) AS precision, CASE WHEN query_id % 3 = 0 THEN bool_or(contains(url, 'github')) END AS domain_hit,
  CASE WHEN query_id % 11 = 0 THEN 'failed' ELSE 'observed' END AS status, cast(query_id * 37 % 9001 AS double) AS latency_ms, CASE WHEN query_id % 5 = 0 THEN NULL ELSE 0.25 END AS cost_usd FROM hits GROUP BY source, query_id)"""


def _search_rows(t):
    q, ring = F.col("query_id"), F.col("title").contains("ring")
    rows = t.hits.groupBy(F.col("source").alias("arm"), "query_id").agg(
        F.count(F.lit(1)).alias("n_results"), F.max(ring).alias("hit"), (F.count_if(ring) / F.count(F.lit(1))).alias("precision"), F.max(F.col("url").contains("github")).alias("g"))
    at = q % 4
    return rows.withColumn("category", F.when(at == 0, "news").when(at == 1, "code").when(at == 2, "web").otherwise("docs")).withColumn(
        "domain_hit", F.when(q % 3 == 0, F.col("g"))).withColumn("status", F.when(q % 11 == 0, "failed").otherwise("observed")).withColumn(
        "latency_ms", (q * 37 % 9001).cast("double")).withColumn("cost_usd", F.when(q % 5 != 0, F.lit(0.25))).drop("g")


@query("a8_search_summary", f"""{_SB}, w AS (SELECT *, '*' AS cat FROM sb UNION ALL SELECT *, category FROM sb), r AS (SELECT *, row_number() OVER (PARTITION BY arm, cat ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY arm, cat) AS n FROM w)
SELECT arm, cat, cast(count(*) AS bigint) AS queries, round(avg(hit::int), 4) AS hit, round(avg(precision), 4) AS precision, round(avg(domain_hit::int), 4) AS domain_hit, cast(count(domain_hit) AS bigint) AS domain_queries,
  cast(count(*) FILTER (status <> 'observed') AS bigint) AS failed, max(latency_ms) FILTER (i = n // 2) AS p50_ms, round(sum(coalesce(cost_usd, 0)), 4) AS cost_usd FROM r GROUP BY arm, cat""")
def a8(t):
    found = bench.search_summary(_search_rows(t))
    return found.select("arm", "cat", "queries", *[F.round(name, 4).alias(name) for name in ("hit", "precision", "domain_hit", "cost_usd")], "domain_queries", "failed", "p50_ms")


@query("a9_model_summary", f"""{BENCH}, m AS (SELECT arm, count(*) AS tasks, avg(valid::int) AS c, count(*) FILTER (valid AND kind = 'json') AS cw, median(tokens) AS mt FROM bench_rows GROUP BY arm),
o AS (SELECT arm, string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS outcomes FROM (SELECT arm, coalesce(failure, 'ok') AS outcome, count(*) AS n FROM bench_rows GROUP BY 1, 2) GROUP BY arm)
SELECT arm AS model, cast(tasks AS bigint) AS tasks, round(c, 4) AS completion, cast(cw AS bigint) AS correct_without_browsing, mt AS median_tokens, outcomes, round(((SELECT max(c) - min(c) FROM m)) * 100, 1) AS gap_points FROM m JOIN o USING (arm)""")
def a9(t):
    rows = _rows(t).select(F.col("arm").alias("model"), F.col("valid").alias("success"), F.col("valid").alias("correct"), (F.col("kind") != "json").alias("browsed"),
                           F.col("tokens").cast("double").alias("tokens"), F.coalesce("failure", F.lit("ok")).alias("outcome"))
    told = F.array_join(F.transform(F.map_entries("outcomes"), lambda item: F.concat(item["key"], F.lit("="), item["value"].cast("string"))), ",")
    return bench.model_summary(rows).select("model", "tasks", F.round("completion", 4).alias("completion"), "correct_without_browsing", "median_tokens", told.alias("outcomes"), "gap_points")


_REV = f"{HITS}, rv AS (SELECT h.source AS arm, h.query_id, h.url, l.quality = 1 AS useful FROM hits h LEFT JOIN labels l ON l.doc_id = h.item_id)"


def _reviewed(t):
    results = t.hits.select(F.col("source").alias("arm"), "query_id", "url", "item_id")
    return results.join(t.labels.select(F.col("doc_id").alias("item_id"), (F.col("quality") == 1).alias("useful")), "item_id", "left").select("arm", "query_id", "url", "useful")


@query("a10_useful_summary", f"""{_REV}, p AS (SELECT arm, query_id, count(*) FILTER (coalesce(useful, false)) AS n, count(*) AS shown, count(*) FILTER (useful IS NULL) AS missing FROM rv GROUP BY 1, 2)
SELECT arm, cast(count(*) AS bigint) AS queries, round(avg(n), 4) AS useful, round(avg(shown - n), 4) AS unuseful, cast(count(*) FILTER (n >= 1) AS bigint) AS "any", cast(count(*) FILTER (n >= 3) AS bigint) AS three,
  cast(sum(missing) AS bigint) AS unreviewed FROM p GROUP BY arm""")
def a10(t):
    return bench.useful_summary(_reviewed(t)).withColumn("useful", F.round("useful", 4)).withColumn("unuseful", F.round("unuseful", 4))


@query("a11_hit_precision", f"""{HITS} SELECT source AS arm, query_id, bool_or(contains(title, 'ring')) AS hit, cast(count(*) FILTER (contains(title, 'ring')) AS bigint) AS n_right,
  round(avg(contains(title, 'ring')::int), 4) AS precision FROM hits WHERE rank <= 5 GROUP BY 1, 2""")
def a11(t):
    rows = t.hits.select(F.col("source").alias("arm"), "query_id", "rank", F.col("title").contains("ring").alias("right"))
    return bench.hit_and_precision(rows).withColumn("precision", F.round("precision", 4))


@query("a15_reason_histogram", f"""{HITS} SELECT query_id, CASE WHEN contains(title, 'Just a moment') THEN 'challenge_page' WHEN contains(url, '/tag/') THEN 'tag_listing' ELSE 'none' END AS reason, cast(count(*) AS bigint) AS n
FROM hits GROUP BY 1, 2""")
def a15(t):
    from pagegrain.operators.search import reason_histogram
    reasons = F.array(F.when(F.col("title").contains("Just a moment"), "challenge_page").when(F.col("url").contains("/tag/"), "tag_listing").otherwise("none"))
    return reason_histogram(t.hits.select("query_id", reasons.alias("reasons")))


@query("a16_distinct_counts", """SELECT l_suppkey AS chain_id, cast(count(DISTINCT l_partkey) AS bigint) AS unique_listings, cast(count(*) AS bigint) AS rows FROM lineitem GROUP BY l_suppkey""")
def a16(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("chain_id")).agg(F.countDistinct("l_partkey").alias("unique_listings"), F.count(F.lit(1)).alias("rows"))


@query("a17_total_cost", f"""{ATTEMPTS} SELECT trace_id, cast(CASE WHEN count(*) = count(cost_usd) THEN sum(cast(cost_usd AS decimal(18,6))) END AS double) AS total FROM attempts GROUP BY trace_id""")
def a17(t):
    return t.attempts.groupBy("trace_id").agg(bench.total_cost(F.col("cost_usd")).cast("double").alias("total"))


@query("a18_pessimistic_cost", f"""{ATTEMPTS} SELECT domain, cast(sum(CASE WHEN provider = 'paid' THEN cast(coalesce(cost_usd, 0.01) AS decimal(18,6)) ELSE 0 END) AS double) AS spent FROM attempts GROUP BY domain""")
def a18(t):
    return t.attempts.groupBy("domain").agg(bench.pessimistic_cost(F.col("cost_usd"), F.col("provider") == "paid", 0.01).cast("double").alias("spent"))


_SIDES = f"{BENCH}, sd AS (SELECT CASE WHEN arm IN ('http', 'local') THEN 'ours' ELSE 'theirs' END AS side, 'u' || (pos - pos % 4) AS url, CASE WHEN valid THEN 'right' ELSE 'wrong' END AS grade, CASE WHEN status = 'observed' THEN text_chars ELSE 0 END AS chars, latency_ms / 1000 AS seconds FROM bench_rows)"


def _sides(t):
    return _rows(t).select(F.when(F.col("arm").isin("http", "local"), "ours").otherwise("theirs").alias("side"), F.concat(F.lit("u"), (F.col("pos") - F.col("pos") % 4).cast("string")).alias("url"), F.when(F.col("valid"), "right").otherwise("wrong").alias("grade"),
                           F.when(F.col("status") == "observed", F.col("text_chars")).otherwise(0).alias("chars"), (F.col("latency_ms") / 1000).alias("seconds"))


@query("a21_side_comparison", f"""{_SIDES}, r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY seconds) - 1 AS i, count(*) OVER (PARTITION BY side) AS n FROM sd)
SELECT side, cast(count(*) AS bigint) AS rows, cast(count(*) FILTER (grade = 'right') AS bigint) AS "right", cast(count(*) FILTER (grade <> 'right' AND chars > 0) AS bigint) AS junk, cast(count(*) FILTER (chars = 0) AS bigint) AS dropped,
  round(median(seconds), 5) AS median_s, round(max(seconds) FILTER (i = cast(floor(n * 0.9) AS bigint)), 5) AS p90_s FROM r GROUP BY side""")
def a21(t):
    return bench.side_comparison(_sides(t)).withColumn("median_s", F.round("median_s", 5)).withColumn("p90_s", F.round("p90_s", 5))


_WALLS = ["shop", "news", "jobs", "docs"]


@query("a22_grade_crosstab", f"""{BENCH} SELECT kind, {', '.join(f"cast(count(*) FILTER (wall = '{wall}') AS bigint) AS {wall}" for wall in _WALLS)},
  cast(count(*) FILTER (NOT valid AND text_chars >= 600) AS bigint) AS poor_but_present, cast(count(*) FILTER (valid AND text_chars < 600) AS bigint) AS good_but_none FROM bench_rows GROUP BY kind""")
def a22(t):
    rows = _rows(t)
    table = rows.groupBy("kind").pivot("wall", _WALLS).count()
    marks = rows.groupBy("kind").agg(F.count_if(~F.col("valid") & (F.col("text_chars") >= 600)).alias("poor_but_present"),
                                     F.count_if(F.col("valid") & (F.col("text_chars") < 600)).alias("good_but_none"))
    return table.na.fill(0, _WALLS).join(marks, "kind")


@query("a23_mean_judge_score", """SELECT event_type AS arm, round(avg(cast(json_extract(props, '$.k') AS double)), 4) AS mean FROM events GROUP BY event_type""")
def a23(t):
    scores = t.events.select("event_type", F.explode(F.from_json("props", "map<string,double>")).alias("name", "score"))
    return scores.groupBy(F.col("event_type").alias("arm")).agg(F.round(F.avg("score"), 4).alias("mean"))


# ---- pairs ---------------------------------------------------------------------------
@query("k5_paired_arms", f"""{_SB}, s AS (SELECT query_id, bool_or(hit) FILTER (arm = 'searxng') AS a, bool_or(hit) FILTER (arm = 'github') AS b FROM sb GROUP BY 1)
SELECT cast(count(*) AS bigint) AS paired, cast(count(*) FILTER (a AND b) AS bigint) AS "both", cast(count(*) FILTER (a AND NOT b) AS bigint) AS only_a, cast(count(*) FILTER (NOT a AND b) AS bigint) AS only_b,
  cast(count(*) FILTER (NOT a AND NOT b) AS bigint) AS neither FROM s WHERE a IS NOT NULL AND b IS NOT NULL""")
def k5(t):
    return bench.paired(_search_rows(t), "searxng", "github").drop("p_value")


@query("m1_mcnemar")
def m1(t):
    rows = t.part.groupBy("p_size").agg(F.count_if(F.col("p_name").contains("ring")).alias("a"), F.count_if(F.col("p_name").contains("red")).alias("b"))
    return rows.select("p_size", "a", "b", F.round(exact_two_sided(F.col("a"), F.col("b")), 8).alias("p_value"))


@query("m2_sign_test")
def m2(t):
    return bench.sign_test(_search_rows(t), "searxng", "github", "precision")


@query("e3_shared_queries", f"{HITS} SELECT query_id FROM hits WHERE source = 'searxng' INTERSECT SELECT query_id FROM hits WHERE source = 'github'")
def e3(t):
    return t.hits.where(F.col("source") == "searxng").select("query_id").intersect(t.hits.where(F.col("source") == "github").select("query_id"))


@query("k2_reviewed", f"{_REV} SELECT arm, cast(count(*) AS bigint) AS n, cast(count(*) FILTER (useful IS NULL) AS bigint) AS unreviewed, cast(count(*) FILTER (useful) AS bigint) AS useful FROM rv GROUP BY arm")
def k2(t):
    return _reviewed(t).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("useful").isNull()).alias("unreviewed"), F.count_if("useful").alias("useful"))


_VD = "vd AS (SELECT DISTINCT query_id, url FROM hits WHERE item_id IN (SELECT doc_id FROM labels))"


@query("k3_review_pool", f"{HITS}, {_VD} SELECT DISTINCT query_id, url FROM hits EXCEPT SELECT query_id, url FROM vd")
def k3(t):
    known = t.hits.join(t.labels, F.col("doc_id") == F.col("item_id"), "left_semi").select("query_id", "url").distinct()
    return bench.unreviewed(t.hits, known)


@query("k4_merged_verdicts", """SELECT doc_id AS query_id, 'u' || doc_id AS url, CASE WHEN toxic = 1 THEN true ELSE quality = 1 END AS useful FROM labels""")
def k4(t):
    first = t.labels.select(F.col("doc_id").alias("review_id"), F.lit(1).alias("loaded_at"), (F.col("quality") == 1).alias("useful"))
    second = t.labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("review_id"), F.lit(2).alias("loaded_at"), F.lit(True).alias("useful"))
    keys = t.labels.select(F.col("doc_id").alias("review_id"), F.col("doc_id").alias("query_id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"))
    return bench.merge_verdicts(first.unionByName(second), keys)


@query("k6_run_changes", """SELECT d.doc_id AS url, length(text) >= 600 AS old, quality = 1 AS new, CASE WHEN quality = 1 AND length(text) < 600 THEN 'gained' WHEN quality <> 1 AND length(text) >= 600 THEN 'lost' ELSE 'same' END AS change
FROM documents d JOIN labels l USING (doc_id)""")
def k6(t):
    old = t.documents.select(F.col("doc_id").alias("url"), (F.length("text") >= 600).alias("article"))
    return bench.run_changes(old, t.labels.select(F.col("doc_id").alias("url"), (F.col("quality") == 1).alias("article")))


@query("k7_only_one_side", f"""{_SIDES}, s AS (SELECT url, bool_or(grade = 'right') FILTER (side = 'ours') AS l, bool_or(grade = 'right') FILTER (side = 'theirs') AS r FROM sd GROUP BY url)
SELECT url, CASE WHEN l AND NOT r THEN 'ours' ELSE 'theirs' END AS only FROM s WHERE (l AND NOT r) OR (r AND NOT l)""")
def k7(t):
    return joins.only_one_side(_sides(t).select("side", "url", (F.col("grade") == "right").alias("good")), "ours", "theirs")


@query("k8_domain_hits", f"""{HITS}, w AS (SELECT o_orderkey AS query_id, unnest(['example.com', 'example.net']) AS domain FROM orders)
SELECT w.query_id, bool_or(EXISTS (SELECT 1 FROM hits h WHERE h.query_id = w.query_id AND ({duck.bare_host('h.url')} = w.domain OR ends_with({duck.bare_host('h.url')}, '.' || w.domain)))) AS domain_hit FROM w GROUP BY w.query_id""")
def k8(t):
    wanted = t.orders.select(F.col("o_orderkey").alias("query_id"), F.explode(F.array(F.lit("example.com"), F.lit("example.net"))).alias("domain"))
    return joins.domain_hits(t.hits, wanted)


@query("k9_without_domains", f"{HITS} SELECT query_id, rank, item_id, url FROM hits WHERE NOT ({duck.bare_host('url')} = 'github.com' OR ends_with({duck.bare_host('url')}, '.example.com') OR {duck.bare_host('url')} = 'example.com')")
def k9(t):
    excluded = t.spark.createDataFrame([("github.com",), ("example.com",)], "domain string")
    return joins.without_domains(t.hits, excluded).select("query_id", "rank", "item_id", "url")


_BR = "CASE WHEN len(string_split(h, '.')) >= 3 AND string_split(h, '.')[-2] IN ('co', 'com', 'org', 'net', 'gov', 'govt', 'ac') THEN string_split(h, '.')[-3] ELSE string_split(h, '.')[-2] END"


@query("k10_fresh_cases", f"""{with_views('urls')}, c AS (SELECT url_id, {duck.bare_host('url')} AS h FROM urls), u AS (SELECT DISTINCT {duck.bare_host('url')} AS h FROM pages), ub AS (SELECT DISTINCT {_BR} AS b FROM u WHERE contains(h, '.'))
SELECT url_id, h AS host FROM c WHERE h NOT IN (SELECT h FROM u) AND {_BR} NOT IN (SELECT b FROM ub)""")
def k10(t):
    from pagegrain.functions import urls
    used = t.pages.select(urls.bare_host("url").alias("host"))
    return joins.fresh_cases(t.urls, used).select("url_id", "host")


@query("k11_partner_fill", """SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS label FROM part""")
def k11(t):
    key = F.col("p_partkey").cast("string")
    items = t.part.select("p_partkey", F.col("p_name").alias("name"), F.concat(F.lit(" https://a.test/P/"), key, F.lit("/ ")).alias("url"),
                          F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(" ").alias("label"))
    others = t.part.select(F.concat(F.lit("https://a.test/p/"), key).alias("link"), F.col("p_type").alias("label"), F.lit(1).alias("pos"))
    others = others.unionByName(others.select("link", F.lit("later").alias("label"), F.lit(2).alias("pos")))
    return joins.fill_from_partner(items, others, "url", "link", ["label"], "pos").select("p_partkey", "name", "label")


@query("k12_zipped_lists", """SELECT p_partkey, unnest(range(least(len(string_split(p_name, ' ')), 1 + p_size % 3)))::integer AS pos, unnest(string_split(p_name, ' ')[1:least(len(string_split(p_name, ' ')), 1 + p_size % 3)]) AS word FROM part""")
def k12(t):
    rows = t.part.select("p_partkey", F.split("p_name", " ").alias("word"), F.sequence(F.lit(1), F.col("p_size") % 3 + 1).alias("n"))
    return joins.zip_lists(rows, "word", "n", "p_partkey").select("p_partkey", "pos", "word")


@query("k14_recipes", f"""{with_views('urls')}, r AS (SELECT * FROM (VALUES ('https://example.com', '/news/.*', 'read', 'any', 'stealth'), ('https://example.com', '/rooms/[0-9]+', 'read', 'any', 'local'), ('https://github.com', '/[^/]+/name', 'read', 'any', 'reader')) v(origin, pat, op, scope, tool))
SELECT url_id, tool FROM urls JOIN r ON {duck.scheme('url')} || '://' || {duck.authority('url')} = r.origin AND regexp_full_match({duck.path('url')}, r.pat)""")
def k14(t):
    recipes = t.spark.createDataFrame([("https://example.com", "/news/.*", "read", "any", None, "stealth"), ("https://example.com", "/rooms/[0-9]+", "read", "any", None, "local"),
                                       ("https://github.com", "/[^/]+/name", "read", "any", None, "reader")],
                                      "origin string, path_pattern string, recipe_operation string, adapter_scope string, recipe_adapter string, tool string")
    reads = t.urls.withColumn("operation", F.lit("read")).withColumn("adapter", F.lit(None).cast("string"))
    return joins.match_recipes(reads, recipes).select("url_id", "tool")


@query("k15_robots", f"""{with_views('urls')}, r AS (SELECT * FROM (VALUES ('example.com', 0, '/news/press', true), ('example.com', 1, '/news', false), ('example.com', 2, '/blog', false), ('github.com', 0, '/topics', false)) v(host, pos, prefix, allow)),
h AS (SELECT url_id, arg_min(allow, pos) AS allow FROM urls JOIN r ON r.host = {duck.host('url')} AND starts_with(CASE WHEN {duck.path('url')} = '' THEN '/' ELSE {duck.path('url')} END, prefix) GROUP BY url_id)
SELECT url_id, coalesce(allow, true) AS allow FROM urls LEFT JOIN h USING (url_id)""")
def k15(t):
    rules = t.spark.createDataFrame([("example.com", 0, "/news/press", True), ("example.com", 1, "/news", False), ("example.com", 2, "/blog", False), ("github.com", 0, "/topics", False)],
                                    "host string, rule_pos int, prefix string, allow boolean")
    return joins.robots_allowed(t.urls, rules, "url_id").select("url_id", "allow")


@query("k18_siblings", f"""WITH p AS (SELECT page_id, {duck.bare_host('url')} AS host FROM pages), j AS (SELECT a.page_id, b.page_id AS sibling_id, row_number() OVER (PARTITION BY a.page_id ORDER BY b.page_id DESC) AS rank
  FROM p a JOIN p b ON a.host = b.host AND a.page_id <> b.page_id) SELECT page_id, sibling_id, cast(rank AS integer) AS rank FROM j WHERE rank <= 3""")
def k18(t):
    return joins.siblings(t.pages.select("page_id", "url", F.col("page_id").alias("observed_at")))


@query("k19_rescue_links", """WITH tie AS (SELECT DISTINCT p_name FROM part WHERE list_contains(string_split(p_name, ' '), lower(p_type)))
SELECT p_partkey AS dead_id, 'https://www.shop.example.com/clear/' || replace(p_name, ' ', '-') AS link FROM part WHERE p_name NOT IN (SELECT p_name FROM tie)""")
def k19(t):
    key = F.col("p_partkey")
    dead = t.part.select(key.alias("dead_id"), F.concat(F.lit("https://shop.example.com/gone/"), key.cast("string")).alias("url"), F.col("p_name").alias("words"))
    slug = F.replace("p_name", F.lit(" "), F.lit("-"))
    near = t.part.select(F.concat(F.lit("https://www.shop.example.com/clear/"), slug).alias("link"))
    far = t.part.select(F.concat(F.lit("https://www.shop.example.com/clear/"), slug, F.lit("-"), F.lower("p_type")).alias("link"))
    return joins.rescue_links(dead, near.unionByName(far))


# ---- samples and budgets --------------------------------------------------------------------
@query("w5_interleave", f"""{BENCH} SELECT kind, pos, cast(row_number() OVER (PARTITION BY kind ORDER BY pos) AS bigint) AS turn FROM bench_rows""")
def w5(t):
    return bench.interleave(_rows(t), "kind", [F.col("pos")], F.floor(F.col("pos") / 100_000)).select("kind", "pos", "turn")


@query("w6_even_sample", """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id FROM n WHERE i IN (SELECT cast(floor(k * (SELECT count(*) FROM events) / 137.0) AS bigint) FROM (SELECT unnest(range(137)) AS k))""")
def w6(t):
    return bench.even_sample(t.events.select("event_id"), [F.col("event_id")], F.floor(F.col("event_id") / 100_000), 137)


@query("w7_balanced_batches", """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, cast(ceil(count(*) OVER () / 95.0) AS bigint) AS b FROM events) SELECT event_id, i % b AS batch FROM n""")
def w7(t):
    return bench.balanced_batches(t.events.select("event_id"), [F.col("event_id")], F.floor(F.col("event_id") / 100_000), 95)


@query("w11_budget_stop", f"""{BENCH}, r AS (SELECT set_name, pos, arm, coalesce(sum(CASE WHEN arm = 'paid' THEN cast(coalesce(cost_usd, 0.01) AS decimal(18,6)) ELSE 0 END) OVER (PARTITION BY set_name ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sp FROM bench_rows) SELECT set_name, pos, arm = 'paid' AND sp >= 1.5 AS stopped FROM r""")
def w11(t):
    rows = bench.budget_stop(_rows(t), ["set_name"], [F.col("pos")], F.floor(F.col("pos") / 100_000), 1.5, 0.01, F.col("arm") == "paid")
    return rows.select("set_name", "pos", "stopped")


@query("o16_blind_order")
def o16(t):
    return bench.blind_order(t.hits.select("query_id", "url").distinct(), 7, F.concat_ws(" ", "query_id", "url"))


@query("s12_latest_per_date", """WITH h AS (SELECT strftime(ts, '%Y-%m-%d') AS date, event_id AS loaded_at, round(value, 2) AS rate FROM events)
SELECT date, max(loaded_at) AS loaded_at, arg_max(rate, loaded_at) AS rate FROM h GROUP BY date""")
def s12(t):
    history = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("loaded_at"), F.round("value", 2).alias("rate"))
    return bench.latest_per_date(history)
