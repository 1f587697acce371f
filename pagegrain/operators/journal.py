"""Attempt journals: validity, canonical rows, verification, capability summaries and the tool orders learned from them.

Everything per trace, tool or origin is an aggregate that combines before the shuffle; nothing sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions import urls
from pagegrain.functions.columns import c, first_of
from pagegrain.functions.ordering import medians, running_sum
from pagegrain.session import cut

SCHEMA_TAG = "route-observation/v1"
KEY = ["trace_id", "provider", "provider_version", "provider_binding_id", "operation", "adapter", "adapter_version",
       "adapter_binding_id", "acquisition_context", "observed_at", "attempt_ordinal"]
GROUP = ["domain", "path_pattern", "operation", "adapter", "adapter_version", "adapter_binding_id", "identity_class", "provider",
         "provider_version", "provider_binding_id", "acquisition_context"]
JOURNAL_SCHEMA = ("schema string, trace_id string, attempt_ordinal int, observed_at string, domain string, path_pattern string, "
                  "operation string, adapter string, adapter_version string, adapter_binding_id string, identity_class string, "
                  "acquisition_context string, provider string, provider_version string, provider_binding_id string, outcome string, "
                  "failure_code string, latency_ms double, cost_usd double, _corrupt string")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


# ---- scan and sink --------------------------------------------------------------
def parse_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """Journal lines as rows; a line that does not parse keeps its text in ``_corrupt``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return lines.withColumn("row", F.from_json(column, JOURNAL_SCHEMA, options)).select(
        *[name for name in lines.columns if name != column], "row.*")


def is_valid() -> Column:
    """Whether a parsed row may be used: its tag, outcome and ids; the others are counted and kept aside."""
    def binding(name):
        return F.col(name).isNull() | F.col(name).rlike("^[0-9a-f]{64}$")

    return (F.col("_corrupt").isNull() & F.coalesce(F.col("schema") == SCHEMA_TAG, F.lit(False))
            & F.coalesce(F.col("outcome").isin("observed", "failed"), F.lit(False)) & F.col("trace_id").isNotNull()
            & F.col("provider").isNotNull() & (F.col("attempt_ordinal").isNull() | (F.col("attempt_ordinal") >= 0))
            & binding("provider_binding_id") & binding("adapter_binding_id")
            & ~(F.col("adapter").isNull() & F.col("adapter_binding_id").isNotNull()))


def new_rows(rows: DataFrame, existing: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Rows whose key the journal does not hold yet, once each: what an append may write."""
    fresh = rows.dropDuplicates(keys)
    return fresh.join(existing.select(*keys).distinct(), null_safe(fresh, existing, keys), "left_anti")


def append(rows: DataFrame, existing: DataFrame, path: str, keys: list[str] = KEY) -> None:
    new_rows(rows, existing, keys).write.mode("append").parquet(path)


def explode_receipts(receipts: DataFrame) -> DataFrame:
    """Read receipts as one row per attempt; cache hits and attempts without a binding id leave no row, and a signed-in read
    leaves no path and no context."""
    rows = receipts.where(~F.coalesce("cache_hit", F.lit(False))).select("*", F.posexplode("attempts").alias("attempt_ordinal", "a"))
    named = F.col("identity").isNotNull()
    return rows.where(F.coalesce(F.col("a.binding_id").rlike("^[0-9a-f]{64}$"), F.lit(False))).select(
        "trace_id", "observed_at", urls.host("requested_url").alias("domain"),
        F.when(~named, urls.path_pattern(urls.path("requested_url"))).alias("path_pattern"), "operation",
        F.when(named, "named").otherwise("public").alias("identity_class"),
        F.when(~named, F.col("acquisition_context")).alias("acquisition_context"), F.col("a.provider").alias("provider"),
        F.col("a.binding_id").alias("provider_binding_id"), "attempt_ordinal", F.col("a.status").alias("outcome"),
        F.col("a.failure").alias("failure_code"), F.col("a.latency_ms").alias("latency_ms"))


# ---- canonical attempts -------------------------------------------------------------
def canonical(rows: DataFrame) -> DataFrame:
    """One row per attempt of a trace and tool, with ``unambiguous``: legacy rows (no ordinal) give way to exact ones, and a
    contradiction between them leaves one failure. ``pos`` is the journal position; its order never changes which rows stay."""
    failed, exact = F.col("outcome") == "failed", F.col("attempt_ordinal").isNotNull()
    facts = rows.groupBy("trace_id", "provider").agg(
        F.max(exact).alias("has_exact"), F.max(exact & failed).alias("exact_failed"), F.max(exact & ~failed).alias("exact_observed"),
        F.max(~exact & failed).alias("legacy_failed"), F.max(~exact & ~failed).alias("legacy_observed"))
    facts = facts.select("trace_id", "provider", "has_exact", (F.col("has_exact") & (
        (F.col("legacy_failed") & ~F.col("exact_failed")) | (F.col("legacy_observed") & ~F.col("exact_observed")))).alias("conflict"))
    joined = rows.join(facts, ["trace_id", "provider"])
    kept = joined.where(F.when(F.col("conflict"), failed).otherwise(exact | ~F.col("has_exact")))
    identity = F.when(~F.col("conflict"), F.col("attempt_ordinal"))
    order = F.struct((~exact & F.col("conflict")).alias("legacy"), (~failed).alias("fine"), F.col("pos").alias("pos"))
    columns = [name for name in rows.columns if name not in ("trace_id", "provider")]
    best = kept.withColumn("_identity", identity).groupBy("trace_id", "provider", "_identity", "conflict").agg(
        F.min_by(F.struct(*columns), order).alias("row"), F.count(F.lit(1)).alias("_n"))
    return best.select("trace_id", "provider", "row.*", (~F.col("conflict") & (F.col("_n") == 1)).alias("unambiguous"))


def with_verified(rows: DataFrame, verifications: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Adds ``verified``: an unambiguous success whose whole key (nulls equal) a verification names."""
    known = verifications.select(*keys).distinct().withColumn("_known", F.lit(True))
    for key in keys:
        known = known.withColumnRenamed(key, f"_k_{key}")
    condition = F.lit(True)
    for key in keys:
        condition = condition & rows[key].eqNullSafe(known[f"_k_{key}"])
    joined = rows.join(known, condition, "left").drop(*[f"_k_{key}" for key in keys])
    return joined.withColumn("verified", F.coalesce("_known", F.lit(False)) & F.col("unambiguous") & (F.col("outcome") == "observed")).drop("_known")


# ---- summaries ---------------------------------------------------------------------------
def failure_counts(rows: DataFrame, keys: list[str], name: str = "failures") -> DataFrame:
    """Per group a map of failure code to count: counted by code first, so the map holds one entry per code."""
    codes = rows.where(F.col("outcome") == "failed").groupBy(*keys, F.coalesce("failure_code", F.lit("UNKNOWN")).alias("code")).agg(
        F.count(F.lit(1)).alias("n"))
    return codes.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias(name))


def _join_all(base: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    for other in others:
        extra = [name for name in other.columns if name not in keys]
        right = other
        for key in keys:
            right = right.withColumnRenamed(key, f"_o_{key}")
        condition = F.lit(True)
        for key in keys:
            condition = condition & base[key].eqNullSafe(right[f"_o_{key}"])
        base = base.join(right, condition, "left").select(*base.columns, *extra)
    return base


def capability_summary(rows: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Samples, successes, verified successes, failures by code and the exact median latency per group of canonical rows."""
    rows = cut(rows)
    timed = rows.withColumn("_latency", F.when((F.col("latency_ms") >= 0) & ~F.isnan("latency_ms"), F.col("latency_ms")))
    base = timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(F.col("outcome") == "observed").alias("observed_count"),
        F.count_if("verified").alias("verified_count"), F.count("_latency").alias("latency_count"), F.max("observed_at").alias("last_observed_at"))
    middle = medians(timed, keys, "_latency", "median_latency_ms").drop("n")
    return _join_all(base, [failure_counts(rows, keys), middle], keys)


def reliable_routes(summary: DataFrame, min_samples: int = 3, min_rate: float = 0.8, first_tools: tuple[str, ...] = ("http",)) -> DataFrame:
    """The most reliable tool per site and general path, pooled from groups that are reliable on their own."""
    good = summary.where((F.col("identity_class") == "public") & (F.col("operation") == "read") & F.col("adapter").isNull()
                         & ~F.col("provider").isin(*first_tools) & (F.col("sample_count") >= min_samples)
                         & (F.col("observed_count") / F.col("sample_count") >= min_rate))
    pooled = good.groupBy(F.lower("domain").alias("domain"), urls.general_pattern(F.col("path_pattern")).alias("pattern"), "provider").agg(
        F.sum("sample_count").alias("reads"), F.sum("observed_count").alias("succeeded"))
    best = pooled.groupBy("domain", "pattern").agg(F.max_by(F.struct("provider", "reads", "succeeded"), F.struct(
        (F.col("succeeded") / F.col("reads")).alias("rate"), F.col("reads"), F.col("provider"))).alias("b"))
    return best.select("domain", "pattern", "b.*")


# ---- evidence after the last failure --------------------------------------------------------
def route_tail(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Successes after a tool's last failure in its scope, in an order of traces that journal order cannot change.

    A scope's tail is what follows the last failure of its last failing trace, plus every later trace: two aggregates and a
    join, with no sort of a scope's rows.
    """
    keys, rows = [*scope, "trace_id"], cut(rows)
    failed, legacy = F.col("outcome") == "failed", F.col("attempt_ordinal").isNull()
    marks = rows.groupBy(*keys).agg(
        F.max("observed_at").alias("trace_time"), F.max(legacy).alias("legacy"), F.max(failed).alias("has_failure"),
        F.max(F.when(failed, F.col("attempt_ordinal"))).alias("failed_at"), F.max(F.when(failed, F.col("observed_at"))).alias("failed_time"))
    joined = rows.join(marks, keys)
    after = ~F.col("has_failure") | F.when(F.col("legacy"), F.col("observed_at") > F.col("failed_time")).otherwise(
        F.col("attempt_ordinal") > F.col("failed_at"))
    joined = joined.withColumn("in_tail", ~failed & F.coalesce(after, F.lit(False)))
    # A latency counts when it is a number from 0 on, short of infinity.
    timed = F.when((F.col("latency_ms") >= 0) & (F.col("latency_ms") < float("inf")), F.col("latency_ms"))
    # Read several times below: computed once.
    joined = cut(joined.withColumn("timed", timed))
    told = joined.groupBy(*keys, "trace_time", "has_failure").agg(
        F.count_if("in_tail").alias("observed"), F.count_if(F.col("in_tail") & F.col("verified")).alias("verified_n"),
        F.count(F.when(F.col("in_tail"), F.col("timed"))).alias("latencies"),
        # What happened in the trace, by which equal traces are told apart: a trace's name must not move evidence. A trace has one attempt per tool.
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", F.coalesce(F.lpad(F.col("attempt_ordinal").cast("string"), 9, "0"), F.lit("")), "outcome", F.col(
            "verified").cast("string"), F.coalesce(F.round(F.col("timed") * 1000).cast("bigint").cast("string"), F.lit(""))))), ";"), 256).alias("digest"))
    told = _join_all(told, [medians(joined.where("in_tail"), keys, "timed", "typical").drop("n")], keys)
    kind = first_of([(~F.col("has_failure"), 0), (F.col("observed") > 0, 1)], 2)
    rank = F.struct(F.col("trace_time"), kind.alias("kind"), (-F.least("observed", "verified_n", "latencies")).alias("floor"),
                    (-F.col("verified_n")).alias("v"), (-F.col("latencies")).alias("l"), (-F.col("observed")).alias("o"),
                    F.coalesce("typical", F.lit(float("inf"))).alias("m"), F.col("digest").alias("t"))
    told = told.withColumn("rank", rank)
    last = told.groupBy(*scope).agg(F.max(F.when(F.col("has_failure"), F.col("rank"))).alias("last_failed"), F.max("rank").alias("last"))
    placed = joined.join(told.select(*keys, "rank"), keys).join(last, scope)
    later = F.col("last_failed").isNull() | (F.col("rank") >= F.col("last_failed"))
    return placed.where(F.col("in_tail") & later).drop("rank", "last_failed", "last", "has_failure", "failed_at", "failed_time", "legacy", "trace_time", "timed")


def tool_evidence(rows: DataFrame, scope: list[str], minimum: int = 2, verified_only: bool = True) -> DataFrame:
    """Per scope (which ends in the tool): samples, successes after the last failure, their median, and whether it may lead."""
    rows = cut(rows)
    # A latency counts when it is a number from 0 on, short of infinity.
    timed = F.when((F.col("latency_ms") >= 0) & (F.col("latency_ms") < float("inf")), F.col("latency_ms"))
    tail = cut(route_tail(rows, scope).withColumn("latency_ms", timed))
    counts = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("samples"))
    after = tail.groupBy(*scope).agg(F.count(F.lit(1)).alias("successes"), F.count_if("verified").alias("verified_successes"),
                                     F.count("latency_ms").alias("latencies"))
    joined = counts.join(after, scope, "left").join(medians(tail, scope, "latency_ms", "median_ms").drop("n"), scope, "left")
    for name in ("successes", "verified_successes", "latencies"):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0)))
    enough = (F.col("successes") >= minimum) & ((F.col("latencies") >= minimum) & (F.col("verified_successes") >= minimum)
                                                if verified_only else F.col("latencies") > 0)
    return joined.withColumn("eligible", enough)


SCOPE = ["domain", "path_pattern", "operation", "adapter", "adapter_version", "acquisition_context"]


def in_scope(rows: DataFrame, plans: DataFrame, definitions: DataFrame, ttl_seconds: int) -> DataFrame:
    """The canonical rows that count as evidence for each plan: ``rows`` with plan_id.

    ``plans(plan_id, planned_at, adapter_binding_id, and SCOPE)``; ``definitions(provider, provider_version, provider_binding_id, valid_from, valid_until)``,
    each with an open end where null. A row is evidence from its own time for the TTL, while its tool is defined with its version and, if the definition
    names one, its binding; scopes are equal, nulls included. That is an interval per row, met with the plans by scope and TTL-sized time slot, so a busy
    scope spreads over time and no plan sees the rows of another slot."""
    def slot(at):
        return F.floor(F.unix_timestamp(at.cast("timestamp")) / ttl_seconds)

    known = definitions.select("provider", "provider_version", F.col("provider_binding_id").alias("_binding"), "valid_from", "valid_until")
    public = rows.where((F.col("identity_class") == "public") & ~(F.col("adapter").isNull() & F.col("adapter_binding_id").isNotNull()))
    for name in ("provider_binding_id", "adapter_binding_id"):
        public = public.where(F.col(name).isNull() | F.col(name).rlike("^[0-9a-f]{64}$"))
    defined = public.join(known, ["provider", "provider_version"]).where(F.col("_binding").isNull() | (F.col("provider_binding_id") == F.col("_binding")))
    defined = defined.withColumn("_slot", F.explode(F.array(slot(F.col("observed_at")), slot(F.col("observed_at")) + 1)))
    asked = plans.select("plan_id", "planned_at", F.col("adapter_binding_id").alias("_adapter_binding"), slot(F.col("planned_at")).alias("_plan_slot"),
                         *[F.col(name).alias(f"_s_{name}") for name in SCOPE])
    met = F.col("_slot") == F.col("_plan_slot")
    for name in SCOPE:
        met = met & F.col(name).eqNullSafe(F.col(f"_s_{name}"))
    age = F.unix_micros(F.col("planned_at").cast("timestamp")) - F.unix_micros(F.col("observed_at").cast("timestamp"))
    fresh = (age >= 0) & (age <= ttl_seconds * 1_000_000)
    valid = (F.col("valid_from").isNull() | (F.col("planned_at") >= F.col("valid_from"))) & (F.col("valid_until").isNull() | (F.col("planned_at") < F.col("valid_until")))
    bound = F.col("_adapter_binding").isNull() | (F.col("adapter_binding_id") == F.col("_adapter_binding"))
    return defined.join(asked, met & fresh & valid & bound).select("plan_id", *rows.columns)


def plan_order(rows: DataFrame, plans: DataFrame, definitions: DataFrame, candidates: DataFrame, ttl_seconds: int, minimum: int = 2, verified_only: bool = True) -> DataFrame:
    """Every plan's tools in order, with their evidence: eligible ones by median latency, the rest as listed. ``candidates(plan_id, provider, position)``.

    Evidence is what lies in the plan's scope (see ``in_scope``) after the tool's last failure there; a tool without any keeps its place."""
    evidence = tool_evidence(in_scope(rows, plans, definitions, ttl_seconds), ["plan_id", "provider"], minimum, verified_only)
    joined = candidates.join(evidence, ["plan_id", "provider"], "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    for name in ("samples", "successes", "verified_successes", "latencies"):
        joined = joined.withColumn(name, F.coalesce(name, F.lit(0)))
    order = Window.partitionBy("plan_id").orderBy(F.when(F.col("eligible"), 0).otherwise(1), F.when(F.col("eligible"), F.col("median_ms")), "position")
    return joined.withColumn("rank", F.row_number().over(order))


def tool_order(evidence: DataFrame, candidates: DataFrame, place: list[str]) -> DataFrame:
    """Tools of each place in order: eligible ones by median latency, the rest as registered. ``candidates(provider, position)``."""
    # A place has as many rows as there are tools, so this window is small.
    rows = evidence.join(candidates, "provider")
    order = Window.partitionBy(*place).orderBy(F.when(F.col("eligible"), 0).otherwise(1), F.when(F.col("eligible"), F.col("median_ms")), "position")
    return rows.withColumn("rank", F.row_number().over(order))


# ---- learning -------------------------------------------------------------------------------
def wall_learning(attempts: DataFrame) -> DataFrame:
    """For each named wall: every tool tried after the first gets a try, the one that got through a win; once per read.

    ``attempts(trace_id, attempt_ordinal, provider, outcome, wall_vendor)``: the last attempt decides who won.
    """
    last = attempts.groupBy("trace_id").agg(F.max_by(F.struct("provider", "outcome"), "attempt_ordinal").alias("l"),
                                            F.max("wall_vendor").alias("vendor"))
    tried = attempts.where(F.col("attempt_ordinal") > 0).select("trace_id", "provider").distinct()
    rows = tried.join(last.where(F.col("vendor").isNotNull()), "trace_id")
    won = (F.col("l.outcome") == "observed") & (F.col("l.provider") == F.col("provider"))
    return rows.groupBy("vendor", F.col("provider").alias("tool")).agg(F.count_if(won).alias("wins"), F.count(F.lit(1)).alias("tries"))


def source_learning(tries: DataFrame) -> DataFrame:
    """Wins, tries and spend per query type and source; an unknown cost adds nothing."""
    return tries.groupBy("qtype", "source").agg(F.count_if("passed").alias("wins"), F.count(F.lit(1)).alias("tries"),
                                                F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("spent"))


def blend_priors(local: DataFrame, priors: DataFrame, fade: int = 8) -> DataFrame:
    """Local counts with bundled ones that count less with every local try and nothing after ``fade`` of them."""
    both = local.join(priors.withColumnRenamed("wins", "prior_wins").withColumnRenamed("tries", "prior_tries"), ["vendor", "tool"], "full")
    zero = [F.coalesce(name, F.lit(0)).alias(name) for name in ("wins", "tries", "prior_wins", "prior_tries")]
    both = both.select("vendor", "tool", *zero)
    weight = F.greatest(F.lit(0), F.lit(fade) - F.col("tries")) / fade
    return both.select("vendor", "tool", (F.col("wins") + F.col("prior_wins") * weight).alias("wins"),
                       (F.col("tries") + F.col("prior_tries") * weight).alias("tries"))


def smoothed_rate(wins: Column, tries: Column) -> Column:
    return (wins + 1) / (tries + 2)


def evidence_order(stats: DataFrame, place: list[str], minimum: int, hopeless: int) -> DataFrame:
    """Tools proven for a place first (best smoothed rate), untried and middling ones as they stand, hopeless ones last."""
    rate = smoothed_rate(F.col("wins"), F.col("tries"))
    tier = first_of([((F.col("tries") >= minimum) & (rate >= 0.5), 0), ((F.col("wins") == 0) & (F.col("tries") >= hopeless), 2)], 1)
    rows = stats.withColumn("rate", rate).withColumn("tier", tier)
    order = Window.partitionBy(*place).orderBy("tier", F.when(F.col("tier") == 0, -F.col("rate")), "position")
    return rows.withColumn("rank", F.row_number().over(order))


def cost_order(stats: DataFrame, place: list[str]) -> DataFrame:
    """Paid tools by cost over the chance of success; those of unknown cost follow by that chance."""
    rate = smoothed_rate(F.col("wins"), F.col("tries"))
    order = Window.partitionBy(*place).orderBy(F.col("cost_usd").isNull(), F.coalesce(F.col("cost_usd") / rate, -rate), "position")
    return stats.withColumn("rank", F.row_number().over(order))


def splice_paid(order: DataFrame, place: list[str], after: int) -> DataFrame:
    """One order of free and paid sources: paid ones enter once ``after`` free ones are ahead. Needs rank within each kind."""
    paid = order.where("paid").groupBy(*place).agg(F.count(F.lit(1)).alias("n_paid"))
    free = order.where(~F.col("paid")).groupBy(*place).agg(F.least(F.count(F.lit(1)), F.lit(after)).alias("lead"))
    rows = order.join(paid, place, "left").join(free, place, "left")
    lead, n_paid = F.coalesce("lead", F.lit(0)), F.coalesce("n_paid", F.lit(0))
    spot = first_of([(F.col("paid"), lead + F.col("rank")), (F.col("rank") <= lead, F.col("rank"))], F.col("rank") + n_paid)
    return rows.withColumn("spot", spot.cast("bigint")).drop("n_paid", "lead")


# ---- as-of rules --------------------------------------------------------------------------------
# Slices of a time slot: what one task sorts of a busy key is one slice.
SLICES = 256


def cached_asof(requests: DataFrame, observations: DataFrame, ttl_seconds: int) -> DataFrame:
    """For each request the latest observation of its key no older than the TTL: ``requests`` with cached_at, null where there is none.

    A key is cut into TTL-sized time slots and these into slices. Within a slice a running maximum over requests and observations in order of time
    finds it; else the last slice before in the slot that has an observation, else the slot before. A slot has at most ``SLICES`` such rows."""
    def slice_of(at):
        return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(ttl_seconds * 1_000_000 / SLICES)).cast("long")

    seen = observations.select("key", F.col("observed_at").alias("at"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), F.col("observed_at").alias("seen_at"))
    asked = requests.select("key", F.col("requested_at").alias("at"), "request_id", F.lit(None).cast(observations.schema["observed_at"].dataType).alias("seen_at"))
    both = seen.unionByName(asked).withColumn("slice", slice_of(F.col("at"))).withColumn("slot", F.floor(F.col("slice") / SLICES))
    # At the same moment an observation comes first.
    running = Window.partitionBy("key", "slice").orderBy("at", F.col("request_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("within", F.max("seen_at").over(running)).where(F.col("request_id").isNotNull())
    slices = both.groupBy("key", "slot", "slice").agg(F.max("seen_at").alias("last"))
    before = Window.partitionBy("key", "slot").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    in_slot = slices.select("key", "slice", F.max("last").over(before).alias("sooner"))
    earlier = slices.groupBy("key", (F.col("slot") + 1).alias("slot")).agg(F.max("last").alias("earlier"))
    found = placed.join(in_slot, ["key", "slice"], "left").join(earlier, ["key", "slot"], "left").withColumn("cached_at", F.coalesce("within", "sooner", "earlier"))
    fresh = found.where(F.unix_timestamp("at") - F.unix_timestamp("cached_at") <= ttl_seconds).select("request_id", "cached_at")
    return requests.join(fresh, "request_id", "left")


def origin_hints(attempts: DataFrame, ttl_seconds: int = 86_400) -> DataFrame:
    """Per origin the tool that last got through after an earlier attempt of the same read failed, unless it failed since:
    origin, provider, at, valid_until."""
    reads = attempts.groupBy("domain", "trace_id").agg(
        F.max("observed_at").alias("at"), F.max_by(F.struct("provider", "outcome"), "attempt_ordinal").alias("l"),
        F.count_if(F.col("outcome") == "failed").alias("failures"), F.collect_set("provider").alias("tools"))
    good = reads.where((F.col("l.outcome") == "observed") & (F.col("failures") > 0))
    hint = good.groupBy("domain").agg(F.max_by(F.struct(F.col("l.provider").alias("provider"), F.col("at")), F.struct("at", "trace_id")).alias("h"))
    bad = reads.where(F.col("l.outcome") == "failed").select("domain", F.col("at").alias("bad_at"), F.explode("tools").alias("provider"))
    lost = bad.groupBy("domain", "provider").agg(F.max("bad_at").alias("bad_at"))
    rows = hint.select("domain", "h.*").join(lost, ["domain", "provider"], "left")
    kept = rows.where(F.col("bad_at").isNull() | (F.col("bad_at") <= F.col("at")))
    return kept.select("domain", "provider", "at", (F.col("at") + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("valid_until"))


def spacing_audit(reads: DataFrame, gap_seconds: float = 2.0, cool_seconds: float = 900.0) -> DataFrame:
    """Reads of an origin that came within the gap of the read before, or inside the cool-down after a block.

    Rows meet per origin and cool-down-sized slot (their own and the one before), so a busy origin spreads over time.
    ``reads(read_id, domain, at, blocked)``.
    """
    base = reads.withColumn("seconds", F.col("at").cast("timestamp").cast("double"))
    slot = F.floor(F.col("seconds") / cool_seconds)
    # Each row also visits the next slot as history, where it is never judged.
    visits = base.select("*", F.explode(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")),
                                                F.struct((slot + 1).alias("slot"), F.lit(False).alias("own")))).alias("v"))
    visits = visits.select(*base.columns, "v.slot", "v.own")
    order = Window.partitionBy("domain", "slot").orderBy("seconds", "read_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    judged = visits.withColumn("gap", F.col("seconds") - F.lag("seconds").over(order)).withColumn(
        "last_block", F.max(F.when(F.col("blocked"), F.col("seconds"))).over(before))
    return judged.where("own").select("read_id", "domain", F.coalesce(F.col("gap") < gap_seconds, F.lit(False)).alias("too_close"),
                                      F.coalesce(F.col("seconds") - F.col("last_block") < cool_seconds, F.lit(False)).alias("cooling"))


def attempt_lists(attempts: DataFrame) -> DataFrame:
    """What each read tried, in order: tool, outcome, seconds. A read has as many entries as it made attempts."""
    item = F.struct("attempt_ordinal", "provider", "outcome", (F.col("latency_ms") / 1000).alias("seconds"))
    return attempts.groupBy("trace_id").agg(F.array_sort(F.collect_list(item)).alias("attempts"))


def attempt_timeline(attempts: DataFrame) -> DataFrame:
    """Start offset of each attempt: the running sum of the latencies before it in its trace."""
    return running_sum(attempts, ["trace_id"], [F.col("attempt_ordinal")], F.floor(F.col("attempt_ordinal") / 1000), F.col("latency_ms"),
                       "offset_ms", inclusive=False)


def retry_tools(attempts: DataFrame, retries: DataFrame) -> DataFrame:
    """trace_id, tools: every tool used by a trace that is in a retry chain, or by one that it retries, however far back.

    ``retries(trace_id, retry_of)``: a trace retries one other (of several rows the least counts). Chains are followed by pointer jumping with the tools
    folded along the way: a trace knows the tools up to its pointer, and takes those of the trace it points to. Rows stay as many as traces, rounds are
    the logarithm of the longest chain, and a ring of retries ends when a round brings no tool."""
    links = retries.where(F.col("trace_id").isNotNull() & F.col("retry_of").isNotNull()).groupBy("trace_id").agg(F.min("retry_of").alias("back"))
    roots = links.select(F.col("back").alias("trace_id")).distinct().join(links, "trace_id", "left_anti").withColumn("back", F.lit(None).cast(links.schema["back"].dataType))
    own = attempts.groupBy("trace_id").agg(F.array_sort(F.collect_set("provider")).alias("own"))
    empty = F.array().cast("array<string>")
    state = cut(links.unionByName(roots).join(own, "trace_id", "left").select("trace_id", "back", F.coalesce("own", empty).alias("tools")))
    known = None
    while True:
        left, now = state.agg(F.count("back"), F.sum(F.size("tools"))).head()
        if not left or now == known:
            return state.select("trace_id", "tools")
        known = now
        before = state.select(F.col("trace_id").alias("back"), F.col("back").alias("further"), F.col("tools").alias("theirs"))
        moved = state.where("back IS NOT NULL").join(before, "back").select("trace_id", F.col("further").alias("back"), F.array_union("tools", "theirs").alias("tools"))
        state = cut(state.where("back IS NULL").unionByName(moved))


def untried(candidates: DataFrame, attempts: DataFrame, retries: DataFrame) -> DataFrame:
    """Tools a trace has not used, anywhere in its retry chain. ``retries(trace_id, retry_of)``; ``candidates(trace_id, provider)``."""
    chained = retry_tools(attempts, retries).select("trace_id", F.explode("tools").alias("provider"))
    used = attempts.select("trace_id", "provider").unionByName(chained).distinct()
    return candidates.join(used, ["trace_id", "provider"], "left_anti")
