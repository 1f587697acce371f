"""Attempt journals: canonical rows, capability summaries, tool orders and as-of rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import urls
from pagegrain.operators import journal
from pagegrain.plans import duck
from pagegrain.plans.registry import query
from pagegrain.sources.tables import with_views

JOURNAL, FULL = with_views("journal"), with_views("journal_full", "verifications")
ATTEMPTS = with_views("attempts")

_CANON = """f AS (SELECT trace_id, provider, bool_or(attempt_ordinal IS NOT NULL) AS he, bool_or(attempt_ordinal IS NOT NULL AND outcome = 'failed') AS ef,
  bool_or(attempt_ordinal IS NOT NULL AND outcome <> 'failed') AS eo, bool_or(attempt_ordinal IS NULL AND outcome = 'failed') AS lf,
  bool_or(attempt_ordinal IS NULL AND outcome <> 'failed') AS lo FROM {src} GROUP BY 1, 2),
j AS (SELECT s.*, he, he AND ((lf AND NOT ef) OR (lo AND NOT eo)) AS conflict FROM {src} s JOIN f USING (trace_id, provider)),
k AS (SELECT *, CASE WHEN NOT conflict THEN attempt_ordinal END AS ident FROM j WHERE CASE WHEN conflict THEN outcome = 'failed' ELSE attempt_ordinal IS NOT NULL OR NOT he END),
r AS (SELECT *, count(*) OVER (PARTITION BY trace_id, provider, ident, conflict) AS n, row_number() OVER (PARTITION BY trace_id, provider, ident, conflict
  ORDER BY conflict AND attempt_ordinal IS NULL, outcome <> 'failed', pos) AS rn FROM k),
canon AS (SELECT *, NOT conflict AND n = 1 AS unambiguous FROM r WHERE rn = 1)"""


def _canon(source: str) -> str:
    return _CANON.replace("{src}", source)


@query("w1_canonical_attempts", f"{JOURNAL}, {_canon('journal')} SELECT trace_id, provider, attempt_ordinal, outcome, failure_code, pos, unambiguous FROM canon")
def w1(t):
    return journal.canonical(t.journal).select("trace_id", "provider", "attempt_ordinal", "outcome", "failure_code", "pos", "unambiguous")


_KEYS = " AND ".join(f"c.{key} IS NOT DISTINCT FROM v.{key}" for key in journal.KEY)
_VERIFIED = f"""{_canon('journal_full')}, ver AS (SELECT DISTINCT * FROM verifications),
done AS (SELECT c.*, v.trace_id IS NOT NULL AND unambiguous AND outcome = 'observed' AS verified FROM canon c LEFT JOIN ver v ON {_KEYS})"""


def _done(t):
    return journal.with_verified(journal.canonical(t.journal_full), t.verifications)


@query("k1_verified_attempts", f"{FULL}, {_VERIFIED} SELECT trace_id, provider, attempt_ordinal, verified FROM done")
def k1(t):
    return _done(t).select("trace_id", "provider", "attempt_ordinal", "verified")


@query("a1_capability_summary", f"""{FULL}, {_VERIFIED}, fc AS (SELECT domain, provider, failure_code, count(*) AS n FROM done WHERE outcome = 'failed' GROUP BY ALL),
fm AS (SELECT domain, provider, string_agg(failure_code || '=' || n, ',' ORDER BY failure_code) AS failures FROM fc GROUP BY 1, 2)
SELECT d.domain, d.provider, cast(count(*) AS bigint) AS sample_count, cast(count(*) FILTER (outcome = 'observed') AS bigint) AS observed_count,
  cast(count(*) FILTER (verified) AS bigint) AS verified_count, any_value(failures) AS failures, round(median(latency_ms), 4) AS median_ms
FROM done d LEFT JOIN fm USING (domain, provider) GROUP BY d.domain, d.provider""")
def a1(t):
    found = journal.capability_summary(_done(t))
    told = F.array_join(F.transform(F.map_entries("failures"), lambda item: F.concat(item["key"], F.lit("="), item["value"].cast("string"))), ",")
    return found.select("domain", "provider", "sample_count", "observed_count", "verified_count", told.alias("failures"),
                        F.round("median_latency_ms", 4).alias("median_ms"))


@query("a2_capability_by_domain", f"""{ATTEMPTS} SELECT domain, 'read' AS operation, provider, cast(count(*) AS bigint) AS samples,
  cast(count(*) FILTER (outcome = 'observed') AS bigint) AS observed, round(median(latency_ms), 4) AS median_ms,
  strftime(max(observed_at), '%Y-%m-%d %H:%M:%S') AS last_observed_at FROM attempts GROUP BY domain, provider""")
def a2(t):
    rows = t.attempts.withColumn("operation", F.lit("read")).withColumn("verified", F.lit(False))
    found = journal.capability_summary(rows, ["domain", "operation", "provider"])
    return found.select("domain", "operation", "provider", F.col("sample_count").alias("samples"), F.col("observed_count").alias("observed"),
                        F.round("median_latency_ms", 4).alias("median_ms"), F.date_format("last_observed_at", "yyyy-MM-dd HH:mm:ss").alias("last_observed_at"))


@query("a14_reliable_routes", f"""{ATTEMPTS}, g AS (SELECT domain, path, provider, count(*) AS n, count(*) FILTER (outcome = 'observed') AS o FROM
  (SELECT domain, '/p' || cast(event_id % 3 AS varchar) || '/x' AS path, provider, outcome FROM attempts) GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (outcome = 'observed') / count(*) >= 0.8),
p AS (SELECT domain, '/' || split_part(path, '/', 2) || '(?:/.*)?' AS pattern, provider, sum(n) AS reads, sum(o) AS succeeded FROM g WHERE provider <> 'http' GROUP BY ALL)
SELECT domain, pattern, cast(arg_max(reads, (succeeded / reads, reads, provider)) AS bigint) AS reads, cast(arg_max(succeeded, (succeeded / reads, reads, provider)) AS bigint) AS succeeded,
  arg_max(provider, (succeeded / reads, reads, provider)) AS provider FROM p GROUP BY domain, pattern""")
def a14(t):
    rows = t.attempts.withColumn("path_pattern", F.concat(F.lit("/p"), (F.col("event_id") % 3).cast("string"), F.lit("/x")))
    groups = rows.groupBy("domain", "path_pattern", "provider").agg(F.count(F.lit(1)).alias("sample_count"), F.count_if(
        F.col("outcome") == "observed").alias("observed_count"))
    groups = groups.withColumn("identity_class", F.lit("public")).withColumn("operation", F.lit("read")).withColumn("adapter", F.lit(None).cast("string"))
    return journal.reliable_routes(groups)


_TAIL = f"""{_VERIFIED}, mk AS (SELECT domain, provider, trace_id, max(observed_at) AS tt, bool_or(attempt_ordinal IS NULL) AS leg, bool_or(outcome = 'failed') AS hf,
  max(attempt_ordinal) FILTER (outcome = 'failed') AS fa, max(observed_at) FILTER (outcome = 'failed') AS ft FROM done GROUP BY 1, 2, 3),
tl AS (SELECT d.*, tt, hf, outcome <> 'failed' AND (NOT hf OR coalesce(CASE WHEN leg THEN observed_at > ft ELSE attempt_ordinal > fa END, false)) AS in_tail,
  concat_ws('|', coalesce(lpad(attempt_ordinal::varchar, 9, '0'), ''), outcome, verified::varchar, coalesce(CASE WHEN latency_ms >= 0 AND latency_ms < 'inf'::double THEN round(latency_ms * 1000)::bigint::varchar END, '')) AS line
  FROM done d JOIN mk USING (domain, provider, trace_id)),
tr AS (SELECT domain, provider, trace_id, tt, hf, count(*) FILTER (in_tail) AS o, count(*) FILTER (in_tail AND verified) AS v, median(latency_ms) FILTER (in_tail AND latency_ms >= 0 AND latency_ms < 'inf'::double) AS m,
  count(latency_ms) FILTER (in_tail AND latency_ms >= 0 AND latency_ms < 'inf'::double) AS l, sha256(string_agg(line, ';' ORDER BY line)) AS digest FROM tl GROUP BY 1, 2, 3, 4, 5),
rk AS (SELECT *, rank() OVER (PARTITION BY domain, provider ORDER BY tt, CASE WHEN NOT hf THEN 0 WHEN o > 0 THEN 1 ELSE 2 END, -least(o, v, l), -v, -l, -o, coalesce(m, 1e300), digest) AS place FROM tr),
lf AS (SELECT domain, provider, coalesce(max(place) FILTER (hf), 0) AS lastf FROM rk GROUP BY 1, 2),
tail AS (SELECT tl.* FROM tl JOIN rk USING (domain, provider, trace_id) JOIN lf USING (domain, provider) WHERE in_tail AND place >= lastf)"""


@query("w2_route_tail", f"{FULL}, {_TAIL} SELECT domain, provider, trace_id, attempt_ordinal, verified FROM tail")
def w2(t):
    return journal.route_tail(_done(t), ["domain", "provider"]).select("domain", "provider", "trace_id", "attempt_ordinal", "verified")


_CANDIDATES = [("http", 0), ("local", 1), ("reader", 2), ("stealth", 3), ("paid", 4)]


@query("o10_tool_order", f"""{FULL}, {_TAIL}, s AS (SELECT domain, provider, count(*) AS n FROM done GROUP BY 1, 2),
a AS (SELECT domain, provider, count(*) AS successes, count(*) FILTER (verified) AS v, median(latency_ms) AS m FROM tail GROUP BY 1, 2),
e AS (SELECT s.domain, s.provider, coalesce(successes, 0) AS successes, m, coalesce(successes >= 1 AND v >= 1, false) AS eligible,
  list_position(['http', 'local', 'reader', 'stealth', 'paid'], s.provider) AS pos FROM s LEFT JOIN a USING (domain, provider))
SELECT domain, provider, cast(successes AS bigint) AS successes, eligible, cast(row_number() OVER (PARTITION BY domain ORDER BY CASE WHEN eligible THEN 0 ELSE 1 END,
  CASE WHEN eligible THEN m END, pos) AS integer) AS rank FROM e""")
def o10(t):
    evidence = journal.tool_evidence(_done(t), ["domain", "provider"], minimum=1)
    tools = t.spark.createDataFrame(_CANDIDATES, "provider string, position int")
    return journal.tool_order(evidence, tools, ["domain"]).select("domain", "provider", "successes", "eligible", "rank")


_ORDER = "['http', 'local', 'reader', 'stealth', 'paid']"


@query("o10_scoped_order", f"""{FULL}, {_VERIFIED.replace('done AS (', 'every AS (')},
plans AS (SELECT DISTINCT domain || '@' || d AS plan_id, domain, d::TIMESTAMP AS planned_at FROM journal_full, (SELECT unnest(['2024-01-12', '2024-01-20', '2024-01-30']) AS d)),
defined AS (SELECT unnest({_ORDER}) AS provider, unnest([0, 1, 2, 3, 4]) AS position),
done AS (SELECT p.plan_id AS domain, e.* EXCLUDE (domain) FROM every e JOIN plans p USING (domain) JOIN defined f USING (provider)
  WHERE (pos // 6) % 4 <> 0 AND planned_at - observed_at BETWEEN INTERVAL 0 DAY AND INTERVAL 5 DAY AND f.position <> 4
    AND (observed_at < TIMESTAMP '2024-01-16') = (planned_at < TIMESTAMP '2024-01-14' + INTERVAL (2 * f.position) DAY)),
{_TAIL[len(_VERIFIED) + 2:]}, s AS (SELECT domain, provider, count(*) AS n FROM done GROUP BY 1, 2),
a AS (SELECT domain, provider, count(*) AS successes, count(*) FILTER (verified) AS v, count(*) FILTER (latency_ms >= 0 AND latency_ms < 'inf'::double) AS l,
  median(latency_ms) FILTER (latency_ms >= 0 AND latency_ms < 'inf'::double) AS m FROM tail GROUP BY 1, 2),
o AS (SELECT plan_id, f.provider, f.position, coalesce(s.n, 0) AS samples, coalesce(successes, 0) AS successes, m, coalesce(successes >= 2 AND v >= 2 AND l >= 2, false) AS eligible
  FROM plans CROSS JOIN defined f LEFT JOIN s ON s.domain = plan_id AND s.provider = f.provider LEFT JOIN a ON a.domain = plan_id AND a.provider = f.provider)
SELECT plan_id, provider, cast(samples AS bigint) AS samples, cast(successes AS bigint) AS successes, eligible,
  cast(row_number() OVER (PARTITION BY plan_id ORDER BY NOT eligible, CASE WHEN eligible THEN m END, position) AS integer) AS rank FROM o""")
def o10_scoped(t):
    # Tools change their version in the middle of the month, a quarter of the traces ran in another context, and the paid tool has another binding by now.
    rows = _done(t).withColumn("provider_version", F.when(F.col("observed_at") < F.lit("2024-01-16").cast("timestamp_ntz"), "1").otherwise("2")).withColumn(
        "acquisition_context", F.when(F.floor(F.col("pos") / 6) % 4 != 0, F.col("acquisition_context")).otherwise(F.repeat(F.lit("d"), 64)))
    day = F.explode(F.array(*map(F.lit, ["2024-01-12", "2024-01-20", "2024-01-30"])))
    plans = t.journal_full.select("domain", "path_pattern", "operation", "adapter", "adapter_version", "adapter_binding_id", "acquisition_context").distinct().withColumn("day", day).withColumn(
        "plan_id", F.concat("domain", F.lit("@"), "day")).withColumn("planned_at", F.col("day").cast("timestamp_ntz"))
    told = []
    for name, at in _CANDIDATES:
        change = f"2024-01-{14 + 2 * at} 00:00:00"
        told += [(name, "1", ("b" if at == 4 else "a") * 64, None, change), (name, "2", ("b" if at == 4 else "a") * 64, change, None)]
    definitions = t.spark.createDataFrame(told, "provider string, provider_version string, provider_binding_id string, valid_from string, valid_until string").withColumns(
        {name: F.col(name).cast("timestamp_ntz") for name in ("valid_from", "valid_until")})
    tools = F.explode(F.array(*[F.struct(F.lit(name).alias("provider"), F.lit(at).alias("position")) for name, at in _CANDIDATES]))
    candidates = plans.select("plan_id", tools.alias("tool")).select("plan_id", "tool.*")
    return journal.plan_order(rows, plans, definitions, candidates, 5 * 86_400).select("plan_id", "provider", "samples", "successes", "eligible", "rank")


_LEARN = """lst AS (SELECT trace_id, arg_max(provider, attempt_ordinal) AS lp, arg_max(outcome, attempt_ordinal) AS lo, max(wall_vendor) AS vendor FROM attempts GROUP BY 1),
trd AS (SELECT DISTINCT trace_id, provider FROM attempts WHERE attempt_ordinal > 0),
walls AS (SELECT vendor, provider AS tool, cast(count(*) FILTER (lo = 'observed' AND lp = provider) AS bigint) AS wins, cast(count(*) AS bigint) AS tries FROM trd JOIN lst USING (trace_id)
  WHERE vendor IS NOT NULL GROUP BY 1, 2)"""


@query("a12_wall_learning", f"{ATTEMPTS}, {_LEARN} SELECT vendor, tool, wins, tries FROM walls")
def a12(t):
    return journal.wall_learning(t.attempts)


_QT = """SELECT CASE user_id % 3 WHEN 0 THEN 'web|any|open' WHEN 1 THEN 'news|recent|open' ELSE 'code|any|site' END AS qtype, event_type AS source, event_id % 4 <> 0 AS passed,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE 0.25 END AS cost_usd FROM events"""


def _tries(t):
    at = F.col("user_id") % 3
    return t.events.select(F.when(at == 0, "web|any|open").when(at == 1, "news|recent|open").otherwise("code|any|site").alias("qtype"),
                           F.col("event_type").alias("source"), (F.col("event_id") % 4 != 0).alias("passed"),
                           F.when(F.col("event_id") % 5 != 0, F.lit(0.25)).alias("cost_usd"))


@query("a13_source_learning", f"""WITH q AS ({_QT}) SELECT qtype, source, cast(count(*) FILTER (passed) AS bigint) AS wins, cast(count(*) AS bigint) AS tries,
  round(sum(coalesce(cost_usd, 0)), 4) AS spent FROM q GROUP BY 1, 2""")
def a13(t):
    return journal.source_learning(_tries(t)).withColumn("spent", F.round("spent", 4))


_PRIORS = [("akamai", "local", 1, 8), ("akamai", "reader", 4, 8), ("datadome", "stealth", 2, 8), ("cloudflare", "camoufox", 6, 8), ("kasada", "http", 0, 8)]
_PRIOR_SQL = "pri AS (SELECT * FROM (VALUES " + ", ".join(repr(row) for row in _PRIORS) + ") v(vendor, tool, pw, pt))"
_BLEND = f"""{_LEARN}, {_PRIOR_SQL}, ble AS (SELECT vendor, tool, coalesce(wins, 0) + coalesce(pw, 0) * greatest(0, 8 - coalesce(tries, 0)) / 8.0 AS wins,
  coalesce(tries, 0) + coalesce(pt, 0) * greatest(0, 8 - coalesce(tries, 0)) / 8.0 AS tries FROM walls FULL JOIN pri USING (vendor, tool))"""


def _blend(t):
    return journal.blend_priors(journal.wall_learning(t.attempts), t.spark.createDataFrame(_PRIORS, "vendor string, tool string, wins bigint, tries bigint"))


@query("k13_blended_priors", f"{ATTEMPTS}, {_BLEND} SELECT vendor, tool, round(wins, 4) AS wins, round(tries, 4) AS tries FROM ble")
def k13(t):
    return _blend(t).select("vendor", "tool", F.round("wins", 4).alias("wins"), F.round("tries", 4).alias("tries"))


@query("m3_smoothed_rates", f"{ATTEMPTS}, {_BLEND} SELECT vendor, tool, round((wins + 1) / (tries + 2), 6) AS rate, round(0.01 / ((wins + 1) / (tries + 2)), 6) AS cost_over_rate FROM ble")
def m3(t):
    rate = journal.smoothed_rate(F.col("wins"), F.col("tries"))
    return _blend(t).select("vendor", "tool", F.round(rate, 6).alias("rate"), F.round(F.lit(0.01) / rate, 6).alias("cost_over_rate"))


@query("o11_vendor_order", f"""{ATTEMPTS}, {_BLEND}, r AS (SELECT *, (wins + 1) / (tries + 2) AS rate, CASE WHEN tries >= 3 AND (wins + 1) / (tries + 2) >= 0.5 THEN 0
  WHEN wins = 0 AND tries >= 8 THEN 2 ELSE 1 END AS tier FROM ble)
SELECT vendor, tool, tier, cast(row_number() OVER (PARTITION BY vendor ORDER BY tier, CASE WHEN tier = 0 THEN -rate END, tool) AS integer) AS rank FROM r""")
def o11(t):
    rows = _blend(t).withColumn("position", F.col("tool"))
    return journal.evidence_order(rows, ["vendor"], 3, 8).select("vendor", "tool", "tier", "rank")


@query("o12_paid_order", f"""WITH q AS ({_QT}), s AS (SELECT qtype, source, count(*) FILTER (passed) AS wins, count(*) AS tries FROM q GROUP BY 1, 2),
x AS (SELECT *, CASE source WHEN 'view' THEN NULL WHEN 'click' THEN 0.004 WHEN 'error' THEN 0.001 ELSE 0.002 END AS cost FROM s)
SELECT qtype, source, cast(row_number() OVER (PARTITION BY qtype ORDER BY cost IS NULL, coalesce(cost / ((wins + 1) / (tries + 2)), -(wins + 1) / (tries + 2)), source) AS integer) AS rank FROM x""")
def o12(t):
    cost = F.when(F.col("source") == "click", 0.004).when(F.col("source") == "error", 0.001).when(F.col("source") != "view", 0.002)
    rows = journal.source_learning(_tries(t)).withColumn("cost_usd", cost).withColumn("position", F.col("source"))
    return journal.cost_order(rows, ["qtype"]).select("qtype", "source", "rank")


@query("o13_source_order", f"""WITH q AS ({_QT}), s AS (SELECT qtype, source, count(*) FILTER (passed) AS wins, count(*) AS tries, source IN ('view', 'error') AS paid FROM q GROUP BY 1, 2),
r AS (SELECT *, (wins + 1) / (tries + 2) AS rate FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY qtype, paid ORDER BY CASE WHEN tries >= 2 AND rate >= 0.5 THEN 0
  WHEN wins = 0 AND tries >= 6 THEN 2 ELSE 1 END, CASE WHEN tries >= 2 AND rate >= 0.5 THEN -rate END, source) AS rank FROM r),
n AS (SELECT *, least(count(*) FILTER (NOT paid) OVER (PARTITION BY qtype), 2) AS lead, count(*) FILTER (paid) OVER (PARTITION BY qtype) AS np FROM k)
SELECT qtype, source, cast(CASE WHEN paid THEN lead + rank WHEN rank <= lead THEN rank ELSE rank + np END AS bigint) AS spot FROM n""")
def o13(t):
    rows = journal.source_learning(_tries(t)).withColumn("position", F.col("source")).withColumn("paid", F.col("source").isin("view", "error"))
    ranked = journal.evidence_order(rows, ["qtype", "paid"], 2, 6)
    return journal.splice_paid(ranked, ["qtype"], 2).select("qtype", "source", "spot")


@query("k16_cached_asof", """WITH r AS (SELECT event_id AS request_id, user_id AS k, ts FROM events WHERE event_type = 'click'), o AS (SELECT user_id AS k, ts FROM events WHERE event_type <> 'click')
SELECT request_id, strftime(max(o.ts), '%Y-%m-%d %H:%M:%S') AS cached_at FROM r LEFT JOIN o ON o.k = r.k AND o.ts <= r.ts AND epoch(date_trunc('second', r.ts)) - epoch(date_trunc('second', o.ts)) <= 86400 GROUP BY request_id""")
def k16(t):
    rows = t.events.withColumn("key", F.col("user_id")).withColumn("observed_at", F.col("ts").cast("timestamp"))
    asked = rows.where(F.col("event_type") == "click").select(F.col("event_id").alias("request_id"), "key", F.col("observed_at").alias("requested_at"))
    found = journal.cached_asof(asked, rows.where(F.col("event_type") != "click").select("key", "observed_at"), 86_400)
    return found.select("request_id", F.date_format("cached_at", "yyyy-MM-dd HH:mm:ss").alias("cached_at"))


@query("k17_origin_hints", f"""{ATTEMPTS}, r AS (SELECT domain, trace_id, max(observed_at) AS t, arg_max(provider, attempt_ordinal) AS lp, arg_max(outcome, attempt_ordinal) AS lo,
  count(*) FILTER (outcome = 'failed') AS nf FROM attempts GROUP BY 1, 2), h AS (SELECT domain, arg_max(lp, (t, trace_id)) AS provider, max(t) AS t FROM r WHERE lo = 'observed' AND nf > 0 GROUP BY 1),
b AS (SELECT a.domain, a.provider, max(r.t) AS bt FROM attempts a JOIN r USING (domain, trace_id) WHERE r.lo = 'failed' GROUP BY 1, 2)
SELECT h.domain, h.provider FROM h LEFT JOIN b ON b.domain = h.domain AND b.provider = h.provider WHERE bt IS NULL OR bt <= t""")
def k17(t):
    return journal.origin_hints(t.attempts.withColumn("observed_at", F.col("observed_at").cast("timestamp"))).select("domain", "provider")


@query("k22_untried_tools", f"""{ATTEMPTS}, RECURSIVE_PLACEHOLDER""".replace(", RECURSIVE_PLACEHOLDER", """,
links AS (SELECT DISTINCT trace_id, CASE WHEN cast(substr(trace_id, 2) AS bigint) % 12 <> 0 THEN 't' || (cast(substr(trace_id, 2) AS bigint) - 3) END AS retry_of FROM attempts),
c1 AS (SELECT trace_id, retry_of AS anc FROM links WHERE retry_of IS NOT NULL), c2 AS (SELECT a.trace_id, b.anc FROM c1 a JOIN c1 b ON a.anc = b.trace_id),
c3 AS (SELECT a.trace_id, b.anc FROM c2 a JOIN c1 b ON a.anc = b.trace_id), al AS (SELECT trace_id, anc FROM c1 UNION SELECT * FROM c2 UNION SELECT * FROM c3 UNION SELECT trace_id, trace_id FROM links),
used AS (SELECT DISTINCT al.trace_id, a.provider FROM al JOIN attempts a ON a.trace_id = al.anc), cand AS (SELECT trace_id, p.provider FROM links, (SELECT unnest(['http', 'local', 'reader', 'stealth', 'paid']) AS provider) p)
SELECT trace_id, provider FROM cand WHERE (trace_id, provider) NOT IN (SELECT trace_id, provider FROM used)"""))
def k22(t):
    number = F.expr("cast(substr(trace_id, 2) as bigint)")
    traces = t.attempts.select("trace_id").distinct()
    retries = traces.withColumn("retry_of", F.when(number % 12 != 0, F.concat(F.lit("t"), (number - 3).cast("string"))))
    tools = F.explode(F.array(*[F.lit(name) for name, _ in _CANDIDATES]))
    return journal.untried(traces.withColumn("provider", tools), t.attempts, retries)


@query("w12_spacing_audit", f"""{ATTEMPTS}, s AS (SELECT event_id AS read_id, domain, epoch(observed_at) AS sec, coalesce(failure_code = 'BLOCKED', false) AS blocked FROM attempts),
g AS (SELECT *, sec - lag(sec) OVER (PARTITION BY domain ORDER BY sec, read_id) AS gap,
  max(CASE WHEN blocked THEN sec END) OVER (PARTITION BY domain ORDER BY sec, read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lb FROM s)
SELECT read_id, domain, coalesce(gap < 2, false) AS too_close, coalesce(sec - lb < 900, false) AS cooling FROM g""")
def w12(t):
    return journal.spacing_audit(t.attempts.select(F.col("event_id").alias("read_id"), "domain", F.col("observed_at").alias("at"),
                                                   F.coalesce(F.col("failure_code") == "BLOCKED", F.lit(False)).alias("blocked")))


@query("w13_attempt_lists", f"""{ATTEMPTS} SELECT trace_id, string_agg(provider || ':' || outcome, ' ' ORDER BY attempt_ordinal) AS attempts FROM attempts GROUP BY trace_id""")
def w13(t):
    told = F.array_join(F.transform("attempts", lambda item: F.concat(item["provider"], F.lit(":"), item["outcome"])), " ")
    return journal.attempt_lists(t.attempts).select("trace_id", told.alias("attempts"))


@query("w15_attempt_timeline", f"""{ATTEMPTS} SELECT trace_id, attempt_ordinal, round(coalesce(sum(latency_ms) OVER (PARTITION BY trace_id ORDER BY attempt_ordinal
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS offset_ms FROM attempts""")
def w15(t):
    return journal.attempt_timeline(t.attempts).select("trace_id", "attempt_ordinal", F.round("offset_ms", 4).alias("offset_ms"))


@query("s2_journal_scan", f"""{FULL} SELECT cast(count(*) FILTER (pos % 14 NOT IN (0, 2, 4)) AS bigint) AS valid, cast(count(*) FILTER (pos % 14 IN (0, 2, 4)) AS bigint) AS invalid FROM journal_full""")
def s2(t):
    rows = t.journal_full
    binding = F.when(F.col("pos") % 14 == 2, "short").otherwise(F.col("provider_binding_id"))
    tag = F.when(F.col("pos") % 14 == 4, "other/v9").otherwise(F.lit(journal.SCHEMA_TAG))
    line = F.to_json(F.struct(tag.alias("schema"), "trace_id", "attempt_ordinal", F.col("observed_at").cast("string").alias("observed_at"), "domain",
                              "path_pattern", "operation", "identity_class", "provider", "provider_version", binding.alias("provider_binding_id"),
                              "outcome", "failure_code", "latency_ms"))
    parsed = journal.parse_rows(rows.select(F.when(F.col("pos") % 14 == 0, F.lit("{broken")).otherwise(line).alias("value")))
    return parsed.agg(F.count_if(journal.is_valid()).alias("valid"), F.count_if(~journal.is_valid()).alias("invalid"))


_VK = "trace_id, provider, attempt_ordinal"


@query("s10_new_journal_rows", f"""{FULL} SELECT trace_id, provider, attempt_ordinal FROM (SELECT DISTINCT trace_id, provider, attempt_ordinal, observed_at FROM journal_full j WHERE NOT EXISTS (SELECT 1 FROM verifications c WHERE
  {' AND '.join(f'c.{key} IS NOT DISTINCT FROM j.{key}' for key in journal.KEY)}))""")
def s10(t):
    return journal.new_rows(t.journal_full, t.verifications).select("trace_id", "provider", "attempt_ordinal")


@query("s11_attempt_explode", """SELECT 't' || event_id AS trace_id, CASE WHEN user_id % 7 <> 0 THEN '/p/{number}/x' END AS path_pattern,
  CASE WHEN user_id % 7 = 0 THEN 'named' ELSE 'public' END AS identity_class, unnest(CASE WHEN event_id % 2 = 0 THEN [0, 1] ELSE [0] END) AS attempt_ordinal,
  unnest(CASE WHEN event_id % 2 = 0 THEN ['http', 'local'] ELSE ['http'] END) AS provider FROM events WHERE event_type <> 'view'""")
def s11(t):
    def attempt(name, binding):
        return F.struct(F.lit(name).alias("provider"), F.lit(binding).alias("binding_id"), F.lit("observed").alias("status"),
                        F.lit(None).cast("string").alias("failure"), F.col("value").alias("latency_ms"))

    attempts = F.when(F.col("event_id") % 2 == 0, F.array(attempt("http", "a" * 64), attempt("local", "b" * 64))).otherwise(
        F.array(attempt("http", "a" * 64), attempt("odd", "x")))
    receipts = t.events.select(
        F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("trace_id"), F.col("ts").alias("observed_at"),
        F.concat(F.lit("https://a.test/p/"), F.col("event_id").cast("string"), F.lit("/x?q=1")).alias("requested_url"), F.lit("read").alias("operation"),
        (F.col("event_type") == "view").alias("cache_hit"), F.when(F.col("user_id") % 7 == 0, "me").alias("identity"),
        F.lit("c" * 64).alias("acquisition_context"), attempts.alias("attempts"))
    return journal.explode_receipts(receipts).select("trace_id", "path_pattern", "identity_class", "attempt_ordinal", "provider")
