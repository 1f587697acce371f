"""Benchmark tables: summaries with exact quantiles, paired comparisons, review pools, samples and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions.ordering import index_quantile, medians, order_statistics, rank_in_group, running_sum
from pagegrain.functions.stats import exact_two_sided
from pagegrain.operators.journal import _join_all


# ---- costs ----------------------------------------------------------------------
def total_cost(cost: Column) -> Column:
    """The exact total, or unknown as soon as one cost is unknown."""
    return F.when(F.count(F.lit(1)) == F.count(cost), F.sum(cost.cast("decimal(18,6)")))


def pessimistic_cost(cost: Column, paid: Column, unknown: float) -> Column:
    """What paid rows cost when an unreported cost is charged a flat amount."""
    return F.sum(F.when(paid, F.coalesce(cost, F.lit(unknown)).cast("decimal(18,6)")).otherwise(F.lit(0).cast("decimal(18,6)")))


# ---- summaries ----------------------------------------------------------------------
def scoreboard(rows: DataFrame, key: str = "wall", thin: int = 1000) -> DataFrame:
    """Completion, failures, thin pages, exact medians and cost per wall."""
    ok = F.col("status") == "observed"
    page = ~F.coalesce(F.col("content_type").contains("json") | F.col("content_type").contains("pdf"), F.lit(False))
    base = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("cases"), F.avg(ok.cast("int")).alias("completion"), F.array_sort(F.collect_set("failure")).alias("failures"),
        F.count_if(ok & page & (F.col("text_chars") < thin)).alias("thin_observed"), F.sum(F.col("cost_usd")).alias("cost_usd"))
    seen = rows.where(ok)
    return _join_all(base, [medians(seen, [key], "latency_ms", "p50_latency_ms").drop("n"),
                            medians(seen.withColumn("tokens", F.col("tokens").cast("double")), [key], "tokens", "median_tokens").drop("n")], [key])


def tool_summary(rows: DataFrame, keys: list[str], paid: tuple[str, ...] = ("paid",)) -> DataFrame:
    """Per tool and set: valid rate, false successes, quantiles by sorted index over valid rows, cost per thousand valid."""
    valid = F.col("valid")
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("valid").alias("valid"),
        F.count_if((F.col("status") == "observed") & ~valid).alias("false_success"), F.avg("latency_ms").alias("mean_ms_all"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.count_if(F.col("cost_usd").isNull() & F.col("arm").isin(*paid)).alias("cost_unknown"))
    spots = order_statistics(rows.where(valid), keys, "latency_ms", {
        "p50_ms": F.floor(F.col("n") / 2).cast("bigint"), "p90_ms": index_quantile(0.9)}).drop("n")
    out = _join_all(base, [spots], keys)
    return (out.withColumn("valid_rate", F.col("valid") / F.col("cases"))
            .withColumn("usd_per_1k_valid", F.when(F.col("valid") > 0, F.col("cost_usd") / F.col("valid") * 1000)))


def union_of_tools(rows: DataFrame, key: str, stitched: tuple[str, ...] = ()) -> DataFrame:
    """Cases that any single tool read: the best one could do knowing in advance which to use."""
    single = ~F.col("arm").isin(*stitched) if stitched else F.lit(True)
    per_url = rows.groupBy(key, "url").agg(F.max(F.col("valid") & single).alias("covered"))
    return per_url.groupBy(key).agg(F.count(F.lit(1)).alias("cases"), F.count_if("covered").alias("valid"))


def weekly_summary(rows: DataFrame) -> DataFrame:
    """Per arm: sites, reads, rate, true median and index p90 in seconds, cost."""
    base = rows.groupBy("arm").agg(F.count(F.lit(1)).alias("sites"), F.count_if("valid").alias("read"), F.sum("cost_usd").alias("cost_usd"))
    good = rows.where("valid")
    spots = order_statistics(good, ["arm"], "latency_ms", {"p90": index_quantile(0.9)}).drop("n")
    out = _join_all(base, [medians(good, ["arm"], "latency_ms", "median").drop("n"), spots], ["arm"])
    return out.select("arm", "sites", "read", (F.col("read") / F.col("sites")).alias("rate"), (F.col("median") / 1000).alias("median_s"),
                      (F.col("p90") / 1000).alias("p90_s"), "cost_usd")


def site_summary(rows: DataFrame, dims: list[str]) -> DataFrame:
    """Overall and per value of each dimension, in one pass: each row joins the groups it belongs to as narrow rows."""
    group = F.explode(F.array(F.struct(F.lit("overall").alias("dim"), F.lit("").alias("value")), *[
        F.struct(F.lit(dim).alias("dim"), F.coalesce(F.col(dim), F.lit("-")).alias("value")) for dim in dims]))
    wide = rows.select("status", "valid", "latency_ms", "cost_usd", "failure", "invalid_reason", group.alias("g")).select("*", "g.dim", "g.value")
    keys, ok = ["dim", "value"], F.col("status") == "observed"
    base = wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(ok).alias("observed"), F.count_if("valid").alias("valid"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.array_sort(F.collect_set("failure")).alias("failures"),
        F.array_sort(F.collect_set("invalid_reason")).alias("invalid"))
    return _join_all(base, [medians(wide.where(ok), keys, "latency_ms", "p50_latency_ms").drop("n")], keys)


def search_summary(rows: DataFrame) -> DataFrame:
    """Per arm and per arm and category: hit rate, precision, domain hits, failures, index median, cost (grouping sets)."""
    wide = rows.select("*", F.explode(F.array(F.lit("*"), F.col("category"))).alias("cat"))
    keys = ["arm", "cat"]
    base = wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"), F.avg(F.col("hit").cast("int")).alias("hit"), F.avg("precision").alias("precision"),
        F.avg(F.col("domain_hit").cast("int")).alias("domain_hit"), F.count("domain_hit").alias("domain_queries"),
        F.count_if(F.col("status") != "observed").alias("failed"), F.count_if((F.col("status") == "observed") & (F.col("n_results") == 0)).alias("empty"),
        F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))
    spots = order_statistics(wide, keys, "latency_ms", {"p50_ms": F.floor(F.col("n") / 2).cast("bigint")}).drop("n")
    return _join_all(base, [spots], keys)


def model_summary(rows: DataFrame) -> DataFrame:
    """Per model: completion, correct without browsing, median tokens, outcome counts, and the gap between best and worst."""
    base = rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("tasks"), F.avg(F.col("success").cast("int")).alias("completion"),
        F.count_if(F.col("correct") & ~F.col("browsed")).alias("correct_without_browsing"))
    outcomes = rows.groupBy("model", "outcome").agg(F.count(F.lit(1)).alias("n")).groupBy("model").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))
    out = _join_all(base, [outcomes, medians(rows, ["model"], "tokens", "median_tokens").drop("n")], ["model"])
    # One row per model meets one row: a grouped maximum joined back on a constant.
    gap = out.groupBy(F.lit(1).alias("one")).agg(F.round((F.max("completion") - F.min("completion")) * 100, 1).alias("gap_points"))
    return out.withColumn("one", F.lit(1)).join(F.broadcast(gap), "one").drop("one")


def side_comparison(rows: DataFrame) -> DataFrame:
    """Per server: pages right, wrong pages passed on, nothing back, median and index p90 seconds."""
    base = rows.groupBy("side").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("grade") == "right").alias("right"),
                                    F.count_if((F.col("grade") != "right") & (F.col("chars") > 0)).alias("junk"), F.count_if(F.col("chars") == 0).alias("dropped"))
    spots = order_statistics(rows, ["side"], "seconds", {"p90_s": index_quantile(0.9)}).drop("n")
    return _join_all(base, [medians(rows, ["side"], "seconds", "median_s").drop("n"), spots], ["side"])


# ---- pairs -----------------------------------------------------------------------------
def paired(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Two arms on the queries both ran: both, only one, neither, and the exact p-value."""
    sides = rows.where(F.col("arm").isin(left, right)).groupBy("query_id").agg(
        F.max(F.when(F.col("arm") == left, F.col("hit"))).alias("a"), F.max(F.when(F.col("arm") == right, F.col("hit"))).alias("b"))
    both = sides.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    counts = both.agg(F.count(F.lit(1)).alias("paired"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"),
                      F.count_if(~F.col("a") & F.col("b")).alias("only_b"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"))
    return counts.withColumn("p_value", exact_two_sided(F.col("only_a"), F.col("only_b")))


def sign_test(rows: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """How often one arm has more per query than the other, with the sign test."""
    sides = rows.groupBy("query_id").agg(F.sum(F.when(F.col("arm") == left, F.col(value))).alias("a"), F.sum(F.when(F.col("arm") == right, F.col(value))).alias("b"))
    counts = sides.where(F.col("a").isNotNull() & F.col("b").isNotNull()).agg(
        F.count_if(F.col("a") > F.col("b")).alias("more"), F.count_if(F.col("a") < F.col("b")).alias("fewer"))
    return counts.withColumn("p_value", exact_two_sided(F.col("more"), F.col("fewer")))


def run_changes(old: DataFrame, new: DataFrame, key: str = "url", flag: str = "article") -> DataFrame:
    """Pages of both runs, with what was gained or lost."""
    both = old.select(key, F.col(flag).alias("old")).join(new.select(key, F.col(flag).alias("new")), key)
    return both.withColumn("change", F.when(F.col("new") & ~F.col("old"), "gained").when(F.col("old") & ~F.col("new"), "lost").otherwise("same"))


# ---- review ----------------------------------------------------------------------------------
def reviewed(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Results with the verdict their (query, url) has; a missing verdict is unreviewed, not useless."""
    return results.join(verdicts.select("query_id", "url", "useful"), ["query_id", "url"], "left")


def unreviewed(results: DataFrame, verdicts: DataFrame) -> DataFrame:
    return results.select("query_id", "url").distinct().join(verdicts.select("query_id", "url"), ["query_id", "url"], "left_anti")


def merge_verdicts(batches: DataFrame, keys: DataFrame) -> DataFrame:
    """Verdicts by review id as verdicts by (query, url); the last one loaded wins."""
    last = batches.groupBy("review_id").agg(F.max_by("useful", F.struct("loaded_at", "useful")).alias("useful"))
    return last.join(keys, "review_id").select("query_id", "url", "useful")


def useful_summary(rows: DataFrame) -> DataFrame:
    """Per arm: useful results per query, queries with any, with three or more. ``rows(arm, query_id, useful)``."""
    per = rows.groupBy("arm", "query_id").agg(F.count_if(F.coalesce("useful", F.lit(False))).alias("n"), F.count(F.lit(1)).alias("shown"),
                                              F.count_if(F.col("useful").isNull()).alias("missing"))
    return per.groupBy("arm").agg(F.count(F.lit(1)).alias("queries"), F.avg("n").alias("useful"), F.avg(F.col("shown") - F.col("n")).alias("unuseful"),
                                  F.count_if(F.col("n") >= 1).alias("any"), F.count_if(F.col("n") >= 3).alias("three"), F.sum("missing").alias("unreviewed"))


def hit_and_precision(results: DataFrame, top: int = 5) -> DataFrame:
    """Per arm and query over the top results: any right, share right (0 when nothing came back). ``rank`` from 1."""
    kept = results.where(F.col("rank") <= top)
    return kept.groupBy("arm", "query_id").agg(F.max("right").alias("hit"), F.count_if("right").alias("n_right"),
                                               F.coalesce(F.avg(F.col("right").cast("int")), F.lit(0.0)).alias("precision"))


# ---- samples, batches, budgets -----------------------------------------------------------------
def interleave(rows: DataFrame, category: str, order: list[Column], chunk: Column) -> DataFrame:
    """Round-robin over the categories: ``turn`` is a row's place in its own category."""
    return rank_in_group(rows, [category], order, chunk, "turn")


def even_sample(rows: DataFrame, order: list[Column], chunk: Column, size: int) -> DataFrame:
    """``size`` rows spread evenly over the ordered table: those at index int(i * n / size). All rows when there are fewer."""
    numbered = rank_in_group(rows.withColumn("_all", F.lit(1)), ["_all"], order, chunk, "_place")
    total = rows.agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(1))
    placed = numbered.join(F.broadcast(total), "_all")
    at = F.col("_place") - 1
    # Row ``at`` is picked when some i has int(i * n / size) = at.
    first = F.ceil(at * size / F.col("_n"))
    picked = (F.col("_n") <= size) | ((F.floor(first * F.col("_n") / size) == at) & (first < size))
    return placed.where(picked).drop("_all", "_place", "_n")


def balanced_batches(rows: DataFrame, order: list[Column], chunk: Column, per_batch: int) -> DataFrame:
    """Batches of nearly equal size: item i goes to batch i mod n."""
    numbered = rank_in_group(rows.withColumn("_all", F.lit(1)), ["_all"], order, chunk, "_place")
    total = rows.agg(F.greatest(F.ceil(F.count(F.lit(1)) / per_batch), F.lit(1)).alias("_batches")).withColumn("_all", F.lit(1))
    return numbered.join(F.broadcast(total), "_all").withColumn("batch", ((F.col("_place") - 1) % F.col("_batches")).cast("bigint")).drop(
        "_all", "_place", "_batches")


def budget_stop(rows: DataFrame, run: list[str], order: list[Column], chunk: Column, cap: float, unknown: float, paid: Column) -> DataFrame:
    """Paid rows after the run's spend reached the cap are stopped; free rows go on."""
    charge = F.when(paid, F.coalesce("cost_usd", F.lit(unknown)).cast("decimal(18,6)")).otherwise(F.lit(0).cast("decimal(18,6)"))
    spent = running_sum(rows, run, order, chunk, charge, "spent_before", inclusive=False)
    return spent.withColumn("stopped", paid & (F.col("spent_before") >= cap))


def blind_order(rows: DataFrame, seed: int, key: Column) -> DataFrame:
    """Rows in an order that says nothing about them and is the same for a seed."""
    return rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed), key))


def latest_per_date(history: DataFrame, key: str = "date") -> DataFrame:
    """One entry per date: the one loaded last."""
    others = [name for name in history.columns if name != key]
    return history.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("loaded_at", *[name for name in others if name != "loaded_at"])).alias("row")).select(key, "row.*")
