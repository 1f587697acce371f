"""Joins the domain needs: suffix and prefix matches as equi-joins, partners, siblings, rescues, priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions import urls
from pagegrain.functions.columns import blank_to_null, words_in


def domain_hits(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whether any of a query's domains is among its results' hosts or their parents: query_id, domain_hit.

    ``results(query_id, url)``, ``wanted(query_id, domain)``: hosts are expanded to their suffixes, so this is an equi-join.
    """
    parents = results.select("query_id", F.explode(urls.host_suffixes(urls.bare_host("url"))).alias("domain")).distinct()
    found = wanted.join(parents.withColumn("hit", F.lit(True)), ["query_id", "domain"], "left")
    return found.groupBy("query_id").agg(F.max(F.coalesce("hit", F.lit(False))).alias("domain_hit"))


def without_domains(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows whose host is not an excluded domain or below one. ``excluded(domain)`` is a short list the user gives; the join
    size is left to the planner, which broadcasts it only while it is small. Only distinct hosts are expanded to their suffixes."""
    host = urls.bare_host("url")
    parents = rows.select(host.alias("_host")).distinct().select("_host", F.explode(urls.host_suffixes(F.col("_host"))).alias("domain"))
    bad = parents.join(excluded, "domain", "left_semi").select("_host").distinct()
    return rows.withColumn("_host", host).join(bad, "_host", "left_anti").drop("_host")


def fresh_cases(candidates: DataFrame, used_hosts: DataFrame) -> DataFrame:
    """Candidates whose host and brand were never read before. ``candidates(url)``, ``used_hosts(host)``."""
    rows = candidates.withColumn("host", urls.bare_host("url")).withColumn("brand", urls.brand(urls.bare_host("url")))
    used_brands = used_hosts.where(F.contains("host", F.lit("."))).select(urls.brand(F.col("host")).alias("brand")).distinct()
    return rows.join(used_hosts.select("host").distinct(), "host", "left_anti").join(used_brands, "brand", "left_anti")


def join_key(value: Column) -> Column:
    return blank_to_null(F.lower(urls.rtrim_slash(F.trim(value))))


def fill_from_partner(items: DataFrame, others: DataFrame, left: str, right: str, fields: list[str], order: str) -> DataFrame:
    """Items whose blank fields come from the first partner row with the same key."""
    partner = others.withColumn("_key", join_key(F.col(right))).where(F.col("_key").isNotNull()).groupBy("_key").agg(
        F.min_by(F.struct(*fields), order).alias("_p"))
    rows = items.withColumn("_key", join_key(F.col(left))).join(partner, "_key", "left")
    for name in fields:
        rows = rows.withColumn(name, F.coalesce(blank_to_null(F.col(name)), F.col(f"_p.{name}")) if name in items.columns else F.col(f"_p.{name}"))
    return rows.drop("_key", "_p")


def zip_lists(rows: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """Two lists of one row side by side, as far as both go: key, pos, left, right."""
    size = F.least(F.size(left), F.size(right))
    pairs = F.slice(F.arrays_zip(F.col(left).alias("l"), F.col(right).alias("r")), F.lit(1), size)
    return rows.select(key, F.posexplode(pairs).alias("pos", "p")).select(key, "pos", F.col("p.l").alias(left), F.col("p.r").alias(right))


def match_recipes(reads: DataFrame, recipes: DataFrame) -> DataFrame:
    """Recipes that apply to a read: same origin, whole path matches, operation and adapter in scope."""
    rows = reads.withColumn("origin", urls.origin("url")).withColumn("path", urls.path("url"))
    matched = rows.join(recipes, "origin")
    whole = F.regexp_like("path", F.concat(F.lit("^(?:"), "path_pattern", F.lit(")$")))
    return matched.where(whole & (F.col("operation") == F.col("recipe_operation")) & (
        (F.col("adapter_scope") == "any") | F.col("adapter").eqNullSafe(F.col("recipe_adapter"))))


def robots_allowed(pages: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Whether robots rules let a URL be read: the first rule of its host (by ``rule_pos``) whose prefix its path starts with."""
    rows = pages.withColumn("_host", urls.host("url")).withColumn("_path", F.when(urls.path("url") == "", "/").otherwise(urls.path("url")))
    # A host's rules are one robots file: one array, tried in order inside the URL's row.
    listed = rules.groupBy(F.col("host").alias("_host")).agg(F.array_sort(F.collect_list(F.struct("rule_pos", "prefix", "allow"))).alias("_rules"))
    first = F.get(F.filter("_rules", lambda rule: F.startswith(F.col("_path"), rule["prefix"])), F.lit(0))["allow"]
    return rows.join(listed, "_host", "left").withColumn("allow", F.coalesce(first, F.lit(True))).drop("_host", "_path", "_rules")


def siblings(pages: DataFrame, limit: int = 3) -> DataFrame:
    """For every page the newest other pages of its host: page_id, sibling_id, rank.

    Only a host's ``limit + 1`` newest pages can be anyone's siblings, so each host contributes that many rows to the join
    and no host's pages ever meet each other.
    """
    rows = pages.withColumn("host", urls.bare_host("url"))
    newest = Window.partitionBy("host").orderBy(F.col("observed_at").desc(), F.col("page_id").desc())
    top = rows.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit + 1).select(
        "host", F.col("page_id").alias("sibling_id"), "place")
    own = top.select(F.col("sibling_id").alias("page_id"), F.col("place").alias("own_place"))
    paired = rows.select("page_id", "host").join(own, "page_id", "left").join(top, "host").where(F.col("sibling_id") != F.col("page_id"))
    rank = F.col("place") - F.when(F.col("own_place") < F.col("place"), 1).otherwise(0)
    return paired.withColumn("rank", rank).where(F.col("rank") <= limit).select("page_id", "sibling_id", "rank")


def rescue_links(dead: DataFrame, links: DataFrame) -> DataFrame:
    """For a dead URL the one link of its site whose last segment holds every wanted word with at most two more; the fewest
    more words, then the shallowest; a tie gives none. ``dead(dead_id, url, words)``, ``links(link)``."""
    words = F.array_distinct(F.filter(F.split(F.lower("words"), r"\s+"), lambda word: word != ""))
    asked = dead.select("dead_id", urls.bare_host("url").alias("host"), words.alias("wanted"), urls.rtrim_slash(urls.path("url")).alias("own"))
    told = links.select("link", urls.bare_host("link").alias("host"), urls.rtrim_slash(urls.path("link")).alias("path"))
    told = told.where((urls.query("link") == "") & (F.col("path") != "") & ~urls.item_like(urls.path("link"))).distinct()
    told = told.withColumn("last", F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_extract("path", "([^/]*)$", 1)), F.lit(urls.WORD), F.lit(0))))
    # An inverted index by host: a request meets only the links that hold the rarest of its words there, so a word of every link does no harm.
    by_word = told.select("*", F.explode("last").alias("word"))
    known = by_word.groupBy("host", "word").agg(F.count(F.lit(1)).alias("n"))
    single = asked.select("dead_id", "host", F.size("wanted").alias("need"), F.explode("wanted").alias("word")).distinct()
    rarest = single.join(known, ["host", "word"]).groupBy("dead_id", "need").agg(F.min_by("word", F.struct("n", "word")).alias("word"), F.count(F.lit(1)).alias("have")).where("have = need")
    hits = asked.join(rarest.select("dead_id", "word"), "dead_id").join(by_word, ["host", "word"]).where((F.size(F.array_except("wanted", "last")) == 0) & (F.col("path") != F.col("own")))
    hits = hits.withColumn("extra", F.size("last") - F.size("wanted")).where(F.col("extra") <= 2)
    depth = F.size(urls.segments(F.col("path")))
    ranked = hits.groupBy("dead_id", "extra", depth.alias("depth")).agg(F.min("link").alias("link"), F.countDistinct(urls.rtrim_slash(F.col("link"))).alias("n"))
    best = ranked.groupBy("dead_id").agg(F.min_by(F.struct("link", "n"), F.struct("extra", "depth")).alias("b"))
    return best.where(F.col("b.n") == 1).select("dead_id", F.col("b.link").alias("link"))


def only_one_side(rows: DataFrame, left: str, right: str) -> DataFrame:
    """URLs that one side read and the other did not. ``rows(side, url, good)``."""
    sides = rows.groupBy("url").agg(F.max(F.when(F.col("side") == left, F.col("good"))).alias("l"), F.max(F.when(F.col("side") == right, F.col("good"))).alias("r"))
    only = F.when(F.col("l") & ~F.col("r"), left).when(F.col("r") & ~F.col("l"), right)
    return sides.withColumn("only", only).where(F.col("only").isNotNull()).select("url", "only")
