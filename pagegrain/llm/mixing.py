"""Soft-membership mixing: how often to take each document so that the expected tokens per domain meet target weights.

A naive Bayes classifier over hashed words, counted from a labelled table, gives every document a posterior over the domains. The
document rates x >= 0 then minimise the squared distance between the expected domain totals, sum of x * tokens * posterior, and
the targets, by projected gradient steps from x = 1: x <- max(0, x - posterior . direction). The direction is the residual in
the metric of the documents that are still taken (a domains x domains matrix), so a few steps suffice; each step is one aggregation
of that matrix and the totals. DataFrame operations only; the driver sees numbers per domain, never rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import kept, words_of

BUCKETS = 4096
# A document's evidence counts as this many words: words repeat their topic, so full counts would make every posterior 0 or 1.
STRENGTH = 25.0
SMOOTHING = 0.5
STEPS = 16
TOLERANCE = 1e-4


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _word_buckets(keyed: DataFrame, buckets: int, *also: str) -> DataFrame:
    # One row at least for every document, so that none is lost on the way.
    words = keyed.select("doc_id", "text_key", *also, F.explode_outer(words_of(F.lower("text"))).alias("word"))
    return words.select("doc_id", "text_key", *also, F.when(F.col("word").isNotNull(), _bucket(F.col("word"), buckets)).alias("bucket"))


def domain_model(docs: DataFrame, labelled: DataFrame, domains: list[str], buckets: int = BUCKETS) -> tuple[DataFrame, list[float]]:
    """(bucket, l0 .. l(k-1)): log-probability of a word bucket per domain less the mean over domains, and the log priors.

    ``labelled``: doc_id, domain. Labels of other domains are left out; of several labels for one document the least counts."""
    marks = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = _keyed(docs).join(F.broadcast(marks) if marks.count() <= 500_000 else marks, "doc_id").select("doc_id", "text_key", "text", "domain")
    is_domain = [F.col("domain") == name for name in domains]
    counts = kept(_word_buckets(known, buckets, "domain").where("bucket IS NOT NULL").groupBy("bucket").agg(
        *[F.sum(F.when(same, 1).otherwise(0)).cast("double").alias(f"c{k}") for k, same in enumerate(is_domain)]))
    sums = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0.0)) for k in range(len(domains))]).head()
    sizes = marks.agg(*[F.coalesce(F.sum(F.when(F.col("domain") == name, 1)), F.lit(0)) for name in domains]).head()
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    logs = every.select("bucket", *[
        F.log((F.coalesce(f"c{k}", F.lit(0.0)) + SMOOTHING) / F.lit(float(sums[k]) + SMOOTHING * buckets)).alias(f"l{k}") for k in range(len(domains))])
    total = sum(sizes) + len(domains)
    return kept(logs), [float(np.log((size + 1) / total)) for size in sizes]


def posteriors(docs: DataFrame, model: DataFrame, log_priors: list[float], buckets: int = BUCKETS, strength: float = STRENGTH) -> DataFrame:
    """doc_id, text_key, n_tokens, p0 .. p(k-1): one row per distinct (doc_id, text)."""
    k = len(log_priors)
    # The model has ``buckets`` rows, a parameter's bound.
    joined = _word_buckets(_keyed(docs), buckets).join(F.broadcast(model), "bucket", "left")
    summed = joined.groupBy("doc_id", "text_key").agg(F.count("bucket").alias("n_tokens"), *[F.sum(f"l{i}").alias(f"s{i}") for i in range(k)])
    evidence = F.lit(strength) / F.greatest(F.col("n_tokens").cast("double"), F.lit(strength))
    raw = summed.select("doc_id", "text_key", "n_tokens", *[(F.lit(log_priors[i]) + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * evidence).alias(f"s{i}") for i in range(k)])
    top = F.greatest(*[F.col(f"s{i}") for i in range(k)]) if k > 1 else F.col("s0")
    shares = raw.select("doc_id", "text_key", "n_tokens", *[F.exp(F.col(f"s{i}") - top).alias(f"s{i}") for i in range(k)])
    whole = sum((F.col(f"s{i}") for i in range(1, k)), F.col("s0"))
    return shares.select("doc_id", "text_key", "n_tokens", *[(F.col(f"s{i}") / whole).alias(f"p{i}") for i in range(k)])


def _rate(directions: list[list[float]]) -> Column:
    """The rate after all steps so far, from the posterior alone."""
    x = F.lit(1.0)
    for direction in directions:
        move = sum((F.col(f"p{i}") * F.lit(float(g)) for i, g in enumerate(direction)), F.lit(0.0))
        x = F.greatest(F.lit(0.0), x - move)
    return x


def solve_rates(soft: DataFrame, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """Directions of the projected gradient steps. ``targets``: tokens per domain."""
    k, goal = len(targets), np.array(targets)
    whole = max(float(goal.sum()), 1.0)

    def totals(directions):
        taken = soft.select("n_tokens", *[f"p{i}" for i in range(k)], _rate(directions).alias("x"))
        sums = [F.sum(F.col("x") * F.col("n_tokens") * F.col(f"p{i}")) for i in range(k)]
        pairs = [F.sum(F.when(F.col("x") > 0, F.col("n_tokens") * F.col(f"p{i}") * F.col(f"p{j}"))) for i in range(k) for j in range(i, k)]
        row = [float(value or 0.0) for value in taken.agg(*sums, *pairs).head()]
        metric, at = np.zeros((k, k)), k
        for i in range(k):
            for j in range(i, k):
                metric[i, j] = metric[j, i] = row[at]
                at += 1
        return np.array(row[:k]), metric

    directions: list[list[float]] = []
    total, metric = totals(directions)
    size = 1.0
    for _ in range(steps):
        left = total - goal
        if np.abs(left).sum() <= tolerance * whole:
            break
        step = (np.linalg.pinv(metric / whole, rcond=1e-6, hermitian=True) @ (left / whole) * size).tolist()
        new_total, new_metric = totals([*directions, step])
        if ((new_total - goal) ** 2).sum() < (left**2).sum() * (1 - 1e-9):
            directions, total, metric, size = [*directions, step], new_total, new_metric, min(1.0, 2 * size)
        else:
            size /= 2
    return directions


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], buckets: int = BUCKETS, strength: float = STRENGTH) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, n_tokens, domain (likeliest), posterior (array in the order of ``targets``), rate.

    ``targets``: share of all tokens per domain; the total stays that of the corpus, and shares need not sum to one. Targets that no rates can
    meet are met as closely as least squares allows (a domain without any token has none at any rate). Null or wordless texts have no
    tokens and the prior as posterior. Null ids and repeated rows are fine (repeats count once); an empty table gives an empty result.
    Other columns are ignored."""
    domains = list(targets)
    model, priors = domain_model(docs, labelled, domains, buckets)
    soft = kept(posteriors(docs, model, priors, buckets, strength))
    tokens = float(soft.agg(F.sum("n_tokens")).head()[0] or 0)
    directions = solve_rates(soft, [share * tokens for share in targets.values()])
    posterior = F.array(*[F.col(f"p{i}") for i in range(len(domains))])
    domain = F.element_at(F.array(*[F.lit(name) for name in domains]), F.array_position(posterior, F.array_max(posterior)).cast("int"))
    return soft.select("doc_id", "n_tokens", domain.alias("domain"), posterior.alias("posterior"), _rate(directions).alias("rate"))


# Production targets of the query and the pipeline: language and quality label, as shares of all tokens.
TARGETS = {"en/1": 0.55, "de/1": 0.14, "fr/1": 0.14, "es/1": 0.14, "en/0": 0.01, "de/0": 0.005, "fr/0": 0.005, "es/0": 0.01}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labelled documents: language and quality label."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).join(marks, "doc_id").select(
        "doc_id", F.concat_ws("/", F.coalesce("lang", F.lit("")), F.col("quality").cast("string")).alias("domain"))
