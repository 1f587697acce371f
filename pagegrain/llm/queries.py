"""The registered queries of this subpackage, one per operator, over the whole given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import byte_network, decontaminate, filter_audit, hard_negatives, language_model, license_scan, line_dedup, mixing, ngram_join, quality_rules, toxicity, url_filter, wrappers
from pagegrain.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.quality_rules(docs, labels.where("quality = 1").select("doc_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped", "emptied", F.md5("text").alias("text_md5"))


def op6_byte_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_network.byte_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.mix(docs, mixing.labelled_domains(docs, labels), mixing.TARGETS)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & hard_negatives.usable(F.col("embedding")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = whole.select(F.col("vec_id").cast("long").alias("id"), moved.alias("label"),
                        F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("vector"))
    return hard_negatives.hard_negatives(rows, rows.where("id % 50 = 0"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


QUERIES = {fn.__name__: fn for fn in (
    op1_quality_rules, op2_ngram_join, op3_toxicity, op4_language_model, op5_line_dedup, op6_byte_quality, op7_main_text, op8_mixing, op9_url_filter,
    op10_decontamination, op11_hard_negatives, op12_filter_audit, op13_license_scan)}


def _glob_regex(glob: str) -> str:
    out, at = "", 0
    while at < len(glob):
        wide = glob.startswith("**", at)
        out += ".*" if wide else "[^/]*" if glob[at] == "*" else "[^/]" if glob[at] == "?" else "\\" + glob[at] if not glob[at].isalnum() else glob[at]
        at += 2 if wide else 1
    return f"(?s)^{out}$"


def _url_sql() -> str:
    rules = url_filter.Automaton(url_filter.default_rules()).rules

    def pick(value):
        return "CASE " + " ".join(f"WHEN regexp_matches('.' || host || path, '{_glob_regex(rule.glob)}') THEN {value(rule)}" for rule in rules)

    name = pick(lambda rule: f"'{rule.name}'" if rule.name else "NULL")
    verdict = pick(lambda rule: f"'{rule.verdict}'")
    return f"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages)
SELECT page_id, host, path, {name} ELSE NULL END AS rule, {verdict} ELSE 'allow' END AS verdict FROM parts"""


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
         s.other_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT * FROM ranked WHERE rank <= 3"""

FILTER_AUDIT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
measured AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
         min(doc_id) OVER (PARTITION BY text) AS least
  FROM texts),
marked AS (
  SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b, 100 * capitals > 3 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(least < doc_id, false) AS e,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
  FROM measured),
tally AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM marked GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT f1.l || f2.l || f3.l || f4.l || f5.l AS filter_order, [f1.bit, f2.bit, f3.bit, f4.bit, f5.bit] AS bits
  FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.bit + f2.bit + f3.bit + f4.bit + f5.bit = 31 AND f1.bit | f2.bit | f3.bit | f4.bit | f5.bit = 31),
steps AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS prior
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT p.part, filter_order, step, own,
         coalesce(sum(n) FILTER (mask & (own | prior) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own <> 0 AND mask & prior = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & own <> 0 AND mask & prior <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(t.good) FILTER (mask & own <> 0 AND mask & prior = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(t.toxic) FILTER (mask & own <> 0 AND mask & prior = 0), 0)::BIGINT AS toxic_lost
  FROM (SELECT DISTINCT part FROM tally) p CROSS JOIN steps JOIN tally t ON t.part = p.part GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted"""

def _list(words) -> str:
    return "[" + ", ".join(f"'{word}'" if isinstance(word, str) else _list(word) for word in words) + "]"


def _license_sql() -> str:
    templates = ", ".join(f"({at}, '{one.label}', {_list(one.text.split())}, {_list([key.split() for key in one.keys])})" for at, one in enumerate(license_scan.TEMPLATES))
    named = ", ".join(f"('{label}', {_list(phrase.split())})" for label, phrase in license_scan.PHRASES)
    rare, slack, agree = license_scan.RARE, license_scan.SLACK, license_scan.AGREE
    return rf"""
WITH templates(t, label, body, keys) AS (VALUES {templates}),
named(label, phrase) AS (VALUES {named}),
texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
placed AS (SELECT row, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS at FROM texts),
posted AS (SELECT t, unnest(body) AS w, generate_subscripts(body, 1) - 1 AS q FROM templates),
df AS (SELECT w, count(DISTINCT row) AS n FROM placed WHERE w IN (SELECT w FROM posted) GROUP BY w),
chosen AS (
  SELECT t, w FROM (SELECT DISTINCT t, w FROM posted) LEFT JOIN df USING (w)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), w) <= least({rare}, ceil(count(*) OVER (PARTITION BY t) / 2.0))),
sizes AS (SELECT t, count(*) AS size FROM chosen GROUP BY t),
votes AS (
  SELECT p.row, c.t, g.grid, floor((p.at - o.q + g.grid) / {slack}.0) AS cell, count(DISTINCT p.w) AS agreed
  FROM placed p JOIN chosen c ON c.w = p.w JOIN posted o ON o.t = c.t AND o.w = c.w CROSS JOIN (VALUES (0), ({slack // 2})) g(grid)
  GROUP BY ALL),
phrases AS (SELECT DISTINCT phrase FROM (SELECT phrase FROM named UNION ALL SELECT unnest(keys) FROM templates)),
places AS (
  SELECT p.row, f.phrase, p.at FROM placed p JOIN phrases f ON p.w = f.phrase[1] JOIN texts x ON x.row = p.row
  WHERE x.words[p.at + 1 : p.at + len(f.phrase)] = f.phrase),
likely AS (
  SELECT v.row, t.t, t.label, v.agreed / s.size AS covered, v.cell * {slack} - v.grid AS start, len(t.body) AS length, t.keys
  FROM votes v JOIN sizes s USING (t) JOIN templates t USING (t) WHERE v.agreed >= least(2, s.size) AND v.agreed * 100 >= s.size * {agree}),
checked AS (
  SELECT l.row, l.t, l.label, l.covered, l.start, k.key, l.length, bool_or(coalesce(p.at BETWEEN l.start - {slack} AND l.start + {2 * slack} + l.length, false)) AS ok
  FROM (SELECT DISTINCT * FROM likely) l CROSS JOIN unnest(l.keys) AS k(key) LEFT JOIN places p ON p.row = l.row AND p.phrase = k.key GROUP BY ALL),
accepted AS (SELECT row, label, covered FROM checked GROUP BY row, t, label, covered, start HAVING bool_and(ok)),
base AS (
  SELECT p.row, count(*) AS n_base, min(p.at) AS first_word, max(p.at) AS last_word, list(DISTINCT n.label) AS labels
  FROM places p JOIN named n ON n.phrase = p.phrase GROUP BY p.row),
more AS (SELECT row, list(DISTINCT label) AS labels, max(covered) AS covered FROM accepted GROUP BY row)
SELECT x.doc_id, len(x.words)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(m.covered, 0.0)::DOUBLE END AS score
FROM texts x LEFT JOIN base b USING (row) LEFT JOIN more m USING (row)"""


ORACLES: dict[str, str] = {"op9_url_filter": _url_sql(), "op11_hard_negatives": HARD_NEGATIVES_SQL, "op12_filter_audit": FILTER_AUDIT_SQL, "op13_license_scan": _license_sql()}
