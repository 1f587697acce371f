"""Site graphs and listings: maps, bounded crawls, pagination chains, sitemap walks, overlap ledgers and best reads.

Loops run level by level. A level is one join against the edges and one anti-join against what was seen; the edges are worked out
once, and each level is written once, so a lost executor replays one level and no round rewrites the levels before it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions import urls
from pagegrain.functions.columns import first_of
from pagegrain.functions.ordering import rank_in_group, running_sum
from pagegrain.session import cut, kept, new_folder


# Positions of one chunk of a ranking.
CHUNK = 100_000


def site_map(entries: DataFrame, root: str, subdomains: bool = False, limit: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """A site's URLs, once each, sitemap before page links: url, source, rank. ``entries(url, source, source_pos, pos)``; ``chunk``
    positions are ranked in one task."""
    rows = entries.withColumn("key", urls.crawl_normal("url"))
    rows = rows.where(urls.same_site_crawl(urls.host("url"), F.lit(root), subdomains) & ~urls.not_a_page("url"))
    first = rows.groupBy("key").agg(F.min(F.struct("source_pos", "pos", "source")).alias("f"))
    ranked = rank_in_group(first.select(F.lit(root).alias("site"), F.col("key").alias("url"), F.col("f.source").alias("source"), F.col("f.source_pos").alias("source_pos"),
                                        F.col("f.pos").alias("pos")), ["site"], [F.col("pos"), F.col("url")],
                           F.struct("source_pos", F.floor(F.col("pos") / chunk).alias("b")), "rank")
    return (ranked if limit is None else ranked.where(F.col("rank") <= limit)).select("url", "source", "rank")


def rank_by_words(rows: DataFrame, words: list[str]) -> DataFrame:
    """URLs that hold search words, most words first; URLs with none are dropped. ``rows(url, pos)``."""
    hits = sum((F.contains(F.lower("url"), F.lit(word)).cast("int") for word in words), F.lit(0))
    kept = rows.withColumn("hits", hits).where(F.col("hits") > 0).withColumn("_all", F.lit(1))
    return rank_in_group(kept, ["_all"], [F.col("pos")], F.struct((-F.col("hits")).alias("h"), F.floor(F.col("pos") / 100_000).alias("b")), "rank").drop("_all")


def crawl(edges: DataFrame, start: str, max_depth: int = 2, limit: int | None = None, include: str | None = None, exclude: str | None = None,
          disallowed: list[str] | None = None, scope: str = "", seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A breadth-first walk over a link table ``edges(src, dst)``: (pages(url, depth), skipped(reason, n)).

    Links leave the walk when they point off the site, at files, outside the scope, at filtered or disallowed paths. Sitemap
    ``seeds(url)`` enter at depth 1. The walk stops at the depth, at the page limit (then by URL within the level), or when
    nothing new is found.
    """
    spark = edges.sparkSession
    root = urls.host(F.lit(start))
    path = urls.path("url")
    site = urls.same_site_crawl(urls.host("url"), root, False) & ~urls.not_a_page("url")
    inside = F.lit(True) if not scope else (urls.rtrim_slash(path) == scope) | path.startswith(scope + "/")
    filtered = (path.rlike(exclude) if exclude else F.lit(False)) | (~path.rlike(include) if include else F.lit(False))
    barred = F.lit(False)
    for prefix in disallowed or []:
        barred = barred | path.startswith(prefix)
    verdict = first_of([(~site | ~inside, "outside"), (filtered, "filtered"), (barred, "robots")], "ok")
    normal = kept(edges.select(urls.crawl_normal("src").alias("src"), urls.crawl_normal("dst").alias("url")).distinct())
    frontier = spark.range(1).select(urls.crawl_normal(F.lit(start)).alias("url"), F.lit(0).alias("depth"))
    seen, pages = frontier.select("url"), frontier
    skips = spark.createDataFrame([], "reason string, n long")
    total = 1
    for depth in range(1, max_depth + 1):
        found = normal.join(frontier.select(F.col("url").alias("src")), "src").select("url")
        if depth == 1 and seeds is not None:
            found = found.unionByName(seeds.select(urls.crawl_normal("url").alias("url")))
        fresh = found.distinct().join(seen, "url", "left_anti").withColumn("verdict", verdict)
        fresh = kept(fresh)
        level = fresh.where(F.col("verdict") == "ok").select("url", F.lit(depth).alias("depth"))
        if limit is not None:
            level = level.orderBy("url").limit(max(limit - total, 0))
            level = kept(level)
        n = level.count()
        dropped = fresh.where(F.col("verdict").isin("filtered", "robots")).groupBy(F.col("verdict").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
        skips = skips.unionByName(dropped)
        if n == 0:
            break
        # Rows beyond the limit count as seen: the limit is reached, so the walk ends with the next level.
        pages, frontier, total, seen = pages.unionByName(level), level, total + n, seen.unionByName(fresh.select("url"))
    skipped = skips.groupBy("reason").agg(F.sum("n").alias("n"))
    return pages, skipped


def sitemap_walk(children: DataFrame, roots: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Every sitemap reachable from ``roots(sitemap)`` over ``children(sitemap, child)``, once: sitemap, depth."""
    spark, links, base = children.sparkSession, kept(children.select("sitemap", "child").distinct()), new_folder(children.sparkSession)

    def seen() -> DataFrame:
        # One scan over the folders of all levels, which packs their files.
        return spark.read.schema("sitemap string, depth int").parquet(base)

    roots.select("sitemap").distinct().write.parquet(f"{base}/depth=0")
    for depth in itertools.count(1) if max_rounds is None else range(1, max_rounds + 1):
        last, known = seen().where(F.col("depth") == depth - 1), seen()
        if last.isEmpty():
            break
        found = links.join(last.select("sitemap"), "sitemap").select(F.col("child").alias("sitemap")).distinct()
        found.join(known.select("sitemap"), "sitemap", "left_anti").write.parquet(f"{base}/depth={depth}")
    return seen()


def _doubled(state: DataFrame, missing: str) -> DataFrame:
    """One round of pointer doubling over pages (url, jump, steps, status, least): each open page takes over where its jump has come to.

    ``status`` is set once a stop is reached, ``steps`` away; ``least`` is the smallest page among those jumped over. A jump to a page that is not
    there stops with ``missing``. The jumped-to side has one row a page, so a page that many lead to is split by Spark."""
    ahead = state.select(F.col("url").alias("jump"), F.col("jump").alias("further"), F.col("steps").alias("more"), F.col("status").alias("found"), F.col("least").alias("below"))
    met = state.where("status IS NULL").join(ahead, "jump", "left")
    status = F.when(F.col("more").isNull(), missing).otherwise(F.col("found"))
    moved = met.select("url", F.when(status.isNull(), F.col("further")).alias("jump"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), status.alias("status"),
                       F.least("least", "below").alias("least"))
    return cut(state.where("status IS NOT NULL").unionByName(moved))


def _resolved(state: DataFrame, missing: str, reach: int, jumps: list[DataFrame] | None = None) -> DataFrame:
    """Doubling until every page has a status or has been followed for ``reach`` steps; ``jumps`` collects (url, jump) of open pages before each round."""
    covered = 1
    while True:
        if jumps is not None:
            jumps.append(state.where("status IS NULL").select("url", "jump"))
        if covered >= reach or state.where("status IS NULL").isEmpty():
            return state
        state, covered = _doubled(state, missing), covered * 2


def paginate(starts: DataFrame, listing: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Follows each chain's next links: chain_id, pages, status. ``starts(chain_id, url)``, ``listing(url, next_url, rows)``.

    A chain ends when a page has no next link, links off its origin, repeats a page, is empty or not there, or the page limit is reached;
    the status says which. Whether a page ends a chain is seen on the page itself, so all pages find the distance to their end by pointer doubling, in
    as many rounds as the limit has binary digits. What is left leads into cycles: a page that is the smallest among its own followers names a cycle,
    its pages are gathered by doubling, and the pages before them find their distance to it. Of several rows of one page the least counts.
    """
    pages = listing.groupBy("url").agg(F.min(F.struct("next_url", "rows")).alias("page")).select("url", "page.*")
    upcoming = F.col("next_url")
    own = first_of([
        (F.coalesce("rows", F.lit(0)) == 0, "content_mismatch"), (upcoming.isNull(), "continuation_exhausted"),
        ((urls.origin(upcoming) != urls.origin("url")) | ~upcoming.startswith("https://") | upcoming.contains("#"), "invalid_continuation")], F.lit(None).cast("string"))
    jump = F.when(F.col("status").isNull(), upcoming)
    nodes = cut(pages.withColumn("status", own).select("url", jump.alias("jump"), F.when(F.col("status").isNull(), 1).otherwise(0).cast("long").alias("steps"), "status", jump.alias("least")))
    reach, jumps = max_pages or max(nodes.count(), 1), []
    state = _resolved(nodes, "content_mismatch", reach, jumps)
    ends = state.where("status IS NOT NULL").select("url", F.col("steps") + 1, "status").toDF("url", "pages", "status")
    ring = state.where("status IS NULL AND least = url").select("url", F.col("url").alias("leader"))
    if not ring.isEmpty():
        for step in jumps:
            ring = cut(ring.unionByName(ring.join(step, "url").select(F.col("jump").alias("url"), "leader")).distinct())
        length = ring.groupBy("leader").agg(F.count(F.lit(1)).alias("length"))
        open_pages = jumps[0].join(state.where("status IS NULL").select("url"), "url", "left_semi").join(ring, "url", "left")
        tails = open_pages.select("url", F.when(F.col("leader").isNull(), F.col("jump")).alias("jump"), F.when(F.col("leader").isNull(), 1).otherwise(0).cast("long").alias("steps"),
                                  F.col("leader").alias("status"), F.lit(None).cast("string").alias("least"))
        before = _resolved(cut(tails), "", reach).where("status IS NOT NULL").withColumnRenamed("status", "leader").join(length, "leader")
        ends = ends.unionByName(before.select("url", (F.col("steps") + F.col("length")).alias("pages"), F.lit("continuation_cycle").alias("status")))
    asked = starts.select("chain_id", "url").join(nodes.select("url", F.lit(True).alias("there")), "url", "left").join(ends, "url", "left")
    status = F.when(F.col("there").isNull(), "content_mismatch").otherwise(F.col("status"))
    count = F.when(F.col("there").isNull(), 1).otherwise(F.col("pages"))
    if max_pages is None:
        return asked.select("chain_id", count.cast("int").alias("pages"), status.alias("status"))
    over = count.isNull() | (count > max_pages)
    return asked.select("chain_id", F.when(over, max_pages).otherwise(count).cast("int").alias("pages"), F.when(over, "page_limit_reached").otherwise(status).alias("status"))


# ---- listings -----------------------------------------------------------------------
def listing_ledger(rows: DataFrame) -> DataFrame:
    """Per chain and page: rows, listings new to the chain, repeats, and the running unique total. ``rows(chain_id, page_number, listing_id)``."""
    copies = rows.groupBy("chain_id", "listing_id", "page_number").agg(F.count(F.lit(1)).alias("copies"))
    first = copies.groupBy("chain_id", "listing_id").agg(F.min("page_number").alias("first_page"))
    counts = copies.groupBy("chain_id", "page_number").agg(F.sum("copies").alias("raw_count"))
    fresh = first.groupBy("chain_id", F.col("first_page").alias("page_number")).agg(F.count(F.lit(1)).alias("new_count"))
    pages = counts.join(fresh, ["chain_id", "page_number"], "left").withColumn("new_count", F.coalesce("new_count", F.lit(0)))
    out = running_sum(pages, ["chain_id"], [F.col("page_number")], F.floor(F.col("page_number") / 100_000), F.col("new_count"), "unique_total")
    return out.select("chain_id", "page_number", "raw_count", "new_count", (F.col("raw_count") - F.col("new_count")).alias("overlap_count"), "unique_total")


# ---- reads of one URL -------------------------------------------------------------------
def best_read(reads: DataFrame) -> DataFrame:
    """The most complete read of each URL; the first step wins ties. ``reads(url, step, score, ...)``."""
    others = [name for name in reads.columns if name != "url"]
    return reads.groupBy("url").agg(F.max_by(F.struct(*others), F.struct("score", (-F.col("step")).alias("s"))).alias("r")).select("url", "r.*")


def until_agreement(reads: DataFrame, needed: int = 2) -> DataFrame:
    """Steps of each URL up to the one at which ``needed`` later rendering reads agreed with the first (links within 1, text within
    20%). ``reads(url, step, links, chars, renders)``."""
    first = reads.groupBy("url").agg(F.min_by(F.struct("links", "chars"), "step").alias("f"), F.min("step").alias("first_step"))
    rows = reads.join(first, "url")
    agrees = (F.col("renders") & (F.col("step") > F.col("first_step")) & (F.abs(F.col("links") - F.col("f.links")) <= 1)
              & (F.abs(F.col("chars") - F.col("f.chars")) <= 0.2 * F.greatest("chars", "f.chars", F.lit(1))))
    rows = rows.withColumn("agrees", agrees)
    counted = running_sum(rows, ["url"], [F.col("step")], F.floor(F.col("step") / 100_000), F.col("agrees").cast("bigint"), "agreed_before", inclusive=False)
    return counted.where(F.col("agreed_before") < needed).drop("f", "first_step")


def second_opinion(pairs: DataFrame) -> DataFrame:
    """Whether the rendered read replaces the plain one: clearly more text, or no less text and many more prices.
    ``pairs(url, chars, prices, rendered_chars, rendered_prices)``."""
    longer = F.col("rendered_chars") >= F.greatest(F.col("chars") * 1.5, F.col("chars") + 1000)
    richer = (F.col("rendered_chars") >= F.col("chars")) & (F.col("rendered_prices") >= F.greatest(F.col("prices") * 2, F.col("prices") + 10))
    return pairs.withColumn("keep", F.when(longer | richer, "rendered").otherwise("plain"))


# ---- what is new ---------------------------------------------------------------------------
def pick_child_sitemaps(children: DataFrame, limit: int | None = None) -> DataFrame:
    """The children most likely to hold new pages first: news-like names, then newest, then the latest date in the name."""
    low = F.lower("child")
    news = low.rlike("news|post|article|blog|latest|recent").cast("int")
    dates = F.transform(F.regexp_extract_all(low, F.lit(r"20\d\d[-_/]?(?:\d\d)?"), F.lit(0)), lambda text: F.regexp_replace(text, "[-_/]", ""))
    newest = F.coalesce(F.array_max(dates), F.lit(""))
    order = Window.partitionBy("sitemap").orderBy(news.desc(), F.coalesce("published", F.lit("")).desc(), newest.desc(), "child")
    ranked = children.where(F.col("child") != "").withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def except_seen(entries: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return entries.join(seen.select(*keys).distinct(), keys, "left_anti")


def newest_entries(entries: DataFrame, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries per site with their rank, newest first, the first ``cap`` if given; per-site counts with what is beyond ``cap``): undated ones come last."""
    order = Window.partitionBy("site").orderBy(F.col("published").desc_nulls_last(), "url")
    top = entries.withColumn("rank", F.row_number().over(order))
    top = top if cap is None else top.where(F.col("rank") <= cap)
    counts = entries.groupBy("site").agg(F.count(F.lit(1)).alias("entries")).withColumn(
        "more", F.lit(0).cast("long") if cap is None else F.greatest(F.col("entries") - cap, F.lit(0)))
    return top, counts


def duplicate_content(pages: DataFrame, fingerprint: Column, keys: list[str], order: str) -> DataFrame:
    """Whether an earlier page of the same poll holds the same text: one minimum per fingerprint, joined back."""
    rows = pages.withColumn("fp", fingerprint)
    first = rows.groupBy(*keys, "fp").agg(F.min(order).alias("first"))
    return rows.join(first, [*keys, "fp"]).withColumn("duplicate", F.col(order) > F.col("first")).drop("fp", "first")


def change_tracking(snapshots: DataFrame, keys: list[str], order: str, content: Column, chunk: Column) -> DataFrame:
    """new, same or changed against the snapshot before, per key: snapshots are numbered, then joined to their predecessor."""
    rows = rank_in_group(snapshots.withColumn("digest", F.sha2(content, 256)), keys, [F.col(order)], chunk, "place")
    before = rows.select(*keys, (F.col("place") + 1).alias("place"), F.col("digest").alias("before"))
    joined = rows.join(before, [*keys, "place"], "left")
    return joined.withColumn("change", first_of([(F.col("before").isNull(), "new"), (F.col("before") == F.col("digest"), "same")], "changed")).drop("digest", "before")
