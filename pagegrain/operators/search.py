"""Search-result tables: query context, verdicts per result and set, relevance, fusion and anchored answers.

What a query asks for is worked out once on the queries table; hits join it on ``query_id`` and are judged by array overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions import fixed, texts, urls
from pagegrain.functions.columns import contains_any, each, find, first_of, words_in
from pagegrain.functions.ordering import rank_in_group



def _empty() -> Column:
    return F.array().cast("array<string>")


# ---- what a query asks for ----------------------------------------------------------
def query_kinds(query: Column, vertical: Column, recency: Column) -> Column:
    found = texts.query_words(query)
    return F.filter(F.array(
        F.when(recency.isNotNull(), "announcement"), F.when((vertical == "code") | F.arrays_overlap(found, words_in(fixed.CODE_WORDS)), "code"),
        F.when((vertical == "reference") | query.rlike(fixed.FACT_LEAD) | query.rlike(fixed.FACT_PHRASE), "fact"),
        F.when(vertical == "news", "news")), lambda kind: kind.isNotNull())


def infer_vertical(query: Column, recency: Column, named: Column) -> Column:
    """struct(vertical, reason): the first rule that holds decides. ``named`` says whether the query names something."""
    text = F.trim(F.coalesce(query, F.lit("")))
    found = texts.query_words(query)
    before = F.lower(F.regexp_extract(text, r"(?i)(\S+)\s+\b(?:library|libraries|framework|frameworks|sdk|sdks)\s+for\b", 1))
    discovery = text.rlike(fixed.DISCOVERY) & ~before.isin(fixed.NOT_SOFTWARE)
    library = text.rlike(fixed.LANG_LIB)
    error = text.rlike(fixed.QA_STRONG) | text.rlike(fixed.EXCEPTION_CLASS)
    codeish = (text.rlike(fixed.CODEISH) | text.rlike(fixed.LANG_SURE) | text.rlike(fixed.EXCEPTION_CLASS)
               | (text.rlike(fixed.LANG_AMBIGUOUS) & (error | text.rlike(fixed.IN_LANG))))
    lead = text.rlike(fixed.REF_LEAD)
    fact = (lead | text.rlike(fixed.REF_PHRASE)) & ~F.arrays_overlap(found, words_in(fixed.OPINION)) & ~(text.rlike(fixed.FIRST_PERSON) & ~lead)

    def as_vertical(vertical, reason):
        return F.struct(F.lit(vertical).alias("vertical"), F.lit(reason).alias("reason"))

    return first_of([
        (text == "", as_vertical("web", "empty query")),
        ((text.rlike(fixed.QA_TRIGGER) | text.rlike(fixed.EXCEPTION_CLASS)) & codeish & ~discovery & ~library, as_vertical("qa", "error or how-to with code")),
        (text.rlike(fixed.PAPERS), as_vertical("papers", "asks for papers")), (text.rlike(fixed.PLATFORM), as_vertical("code", "platform word")),
        (library, as_vertical("code", "language library")), (discovery, as_vertical("code", "library for a need")),
        (text.rlike(fixed.ANNOUNCE), as_vertical("web", "announcement")), (text.rlike(fixed.NEWS_WORD), as_vertical("news", "news words")),
        (named & text.rlike(fixed.EVENT_WORD), as_vertical("news", "name with an event")),
        (named & text.rlike(fixed.WINDOW_PHRASE), as_vertical("news", "name with a window")),
        (named & text.rlike(r"(?i)\blatest\b") & F.coalesce(recency.isin("day", "week"), F.lit(False)), as_vertical("news", "latest name")),
        (fact, as_vertical("reference", "fact question"))], as_vertical("web", "no signal"))


def with_context(queries: DataFrame) -> DataFrame:
    """Adds to ``queries(query_id, query, recency)`` everything results are judged by."""
    df = queries.withColumn("terms", texts.key_terms("query")).withColumn("runs", texts.entity_runs("query"))
    df = df.withColumn("known", texts.families(F.col("terms"))).withColumn("words", texts.query_words(F.col("query")))
    df = df.withColumn("vertical", infer_vertical(F.col("query"), F.col("recency"), F.size("runs") > 0)["vertical"])

    def asks(name):
        return F.arrays_overlap("words", words_in(fixed.ASKS[name]))

    joined = each(F.col("runs"), lambda run: F.array_join(run["phrase"], ""))
    core = each(F.col("runs"), lambda run: F.array_join(F.filter(run["phrase"], lambda word: ~word.isin(fixed.CORPORATE_SUFFIXES)), ""))
    raw = texts.raw_terms("query")
    bare = F.when(F.size(raw).between(1, 3), F.array(F.array_join(raw, ""))).otherwise(_empty())
    df = df.withColumn("names", F.array_distinct(F.filter(F.concat(joined, core, bare), lambda name: F.length(name) >= 2)))
    df = df.withColumn("code", (F.col("vertical") == "code") | F.arrays_overlap("words", words_in(fixed.CODE_WORDS)))
    return (df.withColumn("announce", F.col("recency").isNotNull() | F.arrays_overlap("words", words_in(fixed.ANNOUNCE_WORDS)) | (F.col("vertical") == "news"))
            .withColumn("papers", (F.col("vertical") == "papers") | F.arrays_overlap("words", words_in(fixed.PAPER_WORDS)))
            .withColumn("need", F.col("code") & F.arrays_overlap("words", words_in(fixed.NEED_NOUNS)))
            .withColumn("lookup", F.col("code") & ~F.col("need"))
            .withColumn("repo", F.col("code") & F.arrays_overlap("words", words_in(fixed.REPO_WORDS)))
            .withColumn("asks_stock", asks("stock")).withColumn("asks_policy", asks("policy")).withColumn("asks_docs", asks("docs"))
            .withColumn("asks_security", asks("security"))
            .withColumn("entities", each(F.col("runs"), lambda run: F.struct(
                run["phrase"].alias("phrase"), texts.families(each(run["phrase"], texts.stem)).alias("stems"), run["full"].alias("full"))))
            .withColumn("specific", F.col("recency").isNotNull() | (~F.col("query").rlike(fixed.NAVIGATIONAL) & (F.arrays_overlap("words", words_in(fixed.NEWSY)) | (
                ~F.col("query").rlike(fixed.FACT_LEAD) & (F.size("terms") >= 2))))).drop("runs"))


# ---- one result ---------------------------------------------------------------------------
def with_result_words(hits: DataFrame) -> DataFrame:
    """Adds what matching needs of a hit, once: title, URL and snippet as words, its host and repository parts."""
    parts = urls.segments(urls.path("url"))
    forge = urls.bare_host("url").isin(fixed.FORGE_HOSTS) & (F.size(parts) == 2)
    return (hits.withColumn("title_words", texts.tokens(F.col("title"))).withColumn("head_words", F.concat("title_words", texts.tokens(urls.unquote(F.col("url")))))
            .withColumn("snippet_words", texts.tokens(F.col("snippet"))).withColumn("host", urls.host("url"))
            .withColumn("repo_name", F.when(forge, F.lower(F.try_element_at(parts, F.lit(2))))))


def _initials(full: Column) -> Column:
    core = F.filter(full, lambda word: ~F.lower(word).isin(fixed.CORPORATE_SUFFIXES + fixed.CONNECTORS))
    return F.when(F.size(core) >= 2, F.upper(F.array_join(each(core, lambda word: F.substring(word, 1, 1)), "")))


def _domain_names(phrase: Column) -> Column:
    labels = F.split(urls.no_www(F.col("host")), r"\.")
    joined = F.array_join(phrase, "")
    return F.exists(labels, lambda label: (F.replace(label, F.lit("-"), F.lit("")) == joined) | (F.size(F.array_except(phrase, F.split(label, "-"))) == 0))


def entity_domain() -> Column:
    """Whether a result's host is the entity's own."""
    label = F.replace(urls.registrable_label(F.col("host")), F.lit("-"), F.lit(""))
    return F.exists("entities", lambda item: _domain_names(item["phrase"]) | (label == F.array_join(item["phrase"], ""))
                    | (label == F.array_join(F.filter(item["phrase"], lambda word: ~word.isin(fixed.CORPORATE_SUFFIXES)), "")))


def on_query() -> Column:
    """Whether a result is about its query, over joined hit and context columns."""
    text = F.concat("head_words", "snippet_words")
    named_terms = F.flatten(each(F.col("entities"), lambda item: each(item["stems"], lambda family: family["term"])))
    others = F.filter("known", lambda family: ~F.array_contains(named_terms, family["term"]))
    label = F.replace(urls.registrable_label(F.col("host")), F.lit("-"), F.lit(""))

    def names(item):
        in_head = F.forall(item["stems"], lambda family: texts.has_term(family, F.col("head_words")))
        anywhere = F.forall(item["stems"], lambda family: texts.has_term(family, text))
        backed = (F.size(item["stems"]) > 1) | F.exists(others, lambda family: texts.has_term(family, text))
        short = _initials(item["full"])
        alias = F.coalesce(F.array_contains(texts.words(F.col("title")), short), F.lit(False)) | (label == F.array_join(item["phrase"], ""))
        return in_head | _domain_names(item["phrase"]) | alias | (anywhere & backed)

    return first_of([(F.size("known") == 0, True), (F.size("entities") == 0, texts.enough_terms(
        F.col("known"), text, F.col("need") & F.col("title").rlike(fixed.LIBRARY_TITLE)))], F.exists("entities", names))


def wrong_entity() -> Column:
    """Another thing that shares a one-word entity's name: "The Block", or a longer proper noun in a mixed-case title."""
    word = F.element_at(F.try_element_at("entities", F.lit(1))["phrase"], 1)
    single = (F.size("entities") == 1) & (F.size(F.try_element_at("entities", F.lit(1))["phrase"]) == 1)
    spoken = texts.words(F.col("title"))
    at = F.array_position(each(spoken, lambda token: F.regexp_replace(F.lower(token), "s$", "") == F.regexp_replace(word, "s$", "")), F.lit(True)).cast("int")
    previous = F.when(at > 1, F.try_element_at(spoken, at - 1))
    safe = fixed.QUERY_FILLER + fixed.NEWSY + fixed.GENERIC_CAPS + fixed.CORPORATE_SUFFIXES + fixed.CONNECTORS + fixed.STOPWORDS
    mixed = F.exists(spoken, lambda token: token.rlike(r"^\p{Ll}") & ~F.lower(token).isin(safe))
    led = previous.isin("The") | ((at == 2) & previous.isin("A", "An"))
    compound = mixed & previous.rlike(r"^\p{Lu}") & ~F.lower(previous).isin(safe)
    return F.coalesce(single & (at > 0) & ~entity_domain() & (led | compound), F.lit(False))


def repo_reasons(extra: dict[str, Column]) -> list[Column]:
    """Why a repository result is unwanted, from the fields its source gave; a missing field is not held against it."""
    stars = extra["stars"]
    own = F.array_contains("names", F.replace(F.coalesce("repo_name", F.lit("")), F.lit("-"), F.lit("")))
    low = (F.col("need") & (stars < 500)) | (~F.col("need") & F.col("lookup") & (stars < 100) & ~own)
    return [F.when(extra["fork"], "fork"), F.when(extra["archived"], "archived"),
            F.when(F.col("code") & F.coalesce(low, F.lit(False)), "low_stars")]


def check_results(hits: DataFrame, queries: DataFrame, now: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """Every hit with its verdict: passed, reasons, in_window (unknown stays null), on_query, kind, published.

    ``hits(query_id, pos, url, title, snippet, published, ...)`` with ``pos`` the order of the result set.
    """
    # Queries and hits travel as they are: what a query asks for is worked out where it meets its hits, and so are a hit's words.
    df = with_result_words(hits.join(with_context(queries.repartition("query_id")), "query_id"))
    df = df.withColumn("dated", texts.published(F.col("published"), F.col("snippet"), F.col("title"), "url", now))
    days = first_of([(F.col("recency") == name, count) for name, count in fixed.RECENCY_DAYS.items()])
    since = F.timestamp_seconds(F.unix_timestamp(now) - days * 86_400)
    df = df.withColumn("in_window", F.when(days.isNotNull() & F.col("dated").isNotNull(), F.col("dated.at") >= since))
    df = df.withColumn("on_query", on_query()).withColumn("wrong_entity", wrong_entity()).withColumn("kind", urls.url_kind("url"))
    # Articles only, for a windowed announcement query.
    article = F.col("recency").isNotNull() & F.col("query").rlike(fixed.ANNOUNCE)
    low = F.lower("title")
    reasons = [F.when(~F.col("in_window"), "out_of_window"), F.when(~F.col("on_query"), "off_query"),
               F.when(F.col("on_query") & F.col("wrong_entity"), "wrong_entity"),
               F.when((F.col("kind") != "item") & (F.col("specific") | (F.col("kind") == "search_page")), F.col("kind")),
               F.when(contains_any(low, fixed.CHALLENGE_MARKS), "challenge_page"),
               F.when(article & ~F.coalesce("in_window", F.lit(False)) & (~urls.article_like("url") | (urls.marketing_path("url") & entity_domain())), "not_article")]
    reasons += repo_reasons(extra) if extra else []
    df = df.withColumn("reasons", F.filter(F.array(*reasons), lambda reason: reason.isNotNull()))
    df = df.withColumn("relevance", relevance()).withColumn("canonical_key", urls.canonical_url("url"))
    # Stock blurbs fail only when another result of the set passes; topic phrases demote only when a passing title has one.
    df = df.withColumn("blurb", F.col("announce") & ~F.col("asks_stock") & texts.stock_blurb(F.col("title")))
    df = df.withColumn("phrased", F.col("papers") & (F.size("terms") >= 2) & (texts.phrase_count(F.col("known"), F.col("title_words")) > 0))
    few = F.col("papers") & (F.size("terms") >= 2) & (texts.term_hits(F.col("known"), F.col("title_words")) <= 1)
    # What a result set tells its members stays beside them: the hits lie by query already, and none is worked out a second time.
    # Verdicts are sorted and told apart by page, never the words they came from.
    df = df.withColumn("few", few)
    one_set, one_page = Window.partitionBy("query_id"), Window.partitionBy("query_id", "canonical_key")
    df = df.withColumn("other_passes", F.max((F.size("reasons") == 0) & ~F.col("blurb")).over(one_set)).withColumn(
        "phrase_passes", F.max((F.size("reasons") == 0) & F.col("phrased")).over(one_set)).withColumn("first_pos", F.min("pos").over(one_page)).where(F.col("canonical_key").isNotNull())
    more = F.filter(F.array(F.when(F.col("blurb") & F.col("other_passes"), "stock_blurb"), F.when(F.col("pos") > F.col("first_pos"), "duplicate")),
                    lambda reason: reason.isNotNull())
    return (df.withColumn("reasons", F.concat("reasons", more)).withColumn("passed", F.size("reasons") == 0)
            .withColumn("relevance", F.round(F.col("relevance") - F.when(F.col("phrase_passes") & F.col("few"), 4.0).otherwise(0.0), 3)).drop("few"))


# ---- relevance ----------------------------------------------------------------------------
def _canonical_score() -> Column:
    """How much a result is the thing named: its repository (more for the owner and its stars), or its domain."""
    parts = each(urls.segments(urls.path("url")), lambda part: F.replace(F.lower(part), F.lit("-"), F.lit("")))
    forge = F.substring_index(urls.no_www(F.col("host")), ".", -2).isin(fixed.FORGE_HOSTS)
    owner, repo = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    owned = F.coalesce(F.array_contains("names", owner), F.lit(False))
    named = F.coalesce(F.array_contains("names", repo), F.lit(False))
    stars = F.coalesce(F.col("stars"), F.lit(0.0))
    bonus = F.when(stars > 0, F.least(F.lit(0.9), F.log10(stars + 1) / 7)).otherwise(0.0)
    label = F.replace(urls.registrable_label(F.col("host")), F.lit("-"), F.lit(""))
    return first_of([
        (F.size("names") == 0, 0.0), (forge & named, F.lit(3.0) + F.when(owned, 1.0).otherwise(0.0) + bonus),
        (forge & owned, F.when(repo.isNull(), 2.0).otherwise(1.5)), (forge, 0.0),
        (F.array_contains("names", label) | entity_domain(), 3.0)], 0.0)


def _code_adjustment() -> Column:
    repo = F.col("repo_name").isNotNull()
    tokens = F.split(F.coalesce("repo_name", F.lit("")), r"[-_.\s]+")
    example = F.arrays_overlap(tokens, words_in(fixed.EXAMPLE_TOKENS)) & ~F.arrays_overlap("words", words_in(fixed.EXAMPLE_TOKENS))
    squashed = F.regexp_replace(F.coalesce("repo_name", F.lit("")), r"[-_.\s]", "")
    other = F.col("lookup") & (F.size("names") > 0) & ~F.array_contains("names", squashed)
    fits = F.concat_ws(" ", "snippet", "repo_name").rlike(fixed.NEED_NOUN)
    stars = F.coalesce(F.col("stars"), F.lit(0.0))
    popular = F.when(stars > 0, F.least(F.lit(3.0), F.log10(stars + 1) / 1.5)).otherwise(0.0)
    for_repo = (F.when(F.col("repo"), 2.0).otherwise(0.0) - F.when(example, 20.0).otherwise(0.0) - F.when(other, 20.0).otherwise(0.0)
                + F.when(F.col("need"), F.when(fits, popular).otherwise(-10.0)).otherwise(0.0))
    library = F.col("title").rlike(fixed.LIBRARY_TITLE) | F.lower(urls.path("url")).rlike(fixed.LIBRARY_URL) | F.col("host").rlike(fixed.LIBRARY_URL)
    guide = F.col("title").rlike(fixed.GUIDE_TITLE) & ~F.arrays_overlap("words", words_in(fixed.GUIDE_ASKED))
    for_page = (-F.when(F.col("repo") & (F.size(urls.segments(urls.path("url"))) <= 1), 12.0).otherwise(0.0)
                + F.when(F.col("need") & ~F.col("asks_docs"), F.when(library, 1.5).otherwise(0.0) - F.when(guide, 3.0).otherwise(0.0)).otherwise(0.0))
    return F.when(F.col("code"), F.when(repo, for_repo).otherwise(for_page)).otherwise(0.0)


def relevance() -> Column:
    """How well a result answers its query: matches and being the thing itself add, page types nobody asked for take away."""
    known, size = F.col("known"), F.size("known")
    hits = texts.term_hits(known, F.col("title_words"))
    entity = F.exists("entities", lambda item: F.forall(item["stems"], lambda family: texts.has_term(family, F.col("title_words")))
                      | F.coalesce(F.array_contains(texts.words(F.col("title")), _initials(item["full"])), F.lit(False)))
    scattered = F.col("papers") & (hits == size) & (size > 1) & ~texts.compact(known, F.col("title_words"))
    base = first_of([
        (size == 0, 0.0), (entity | (hits == size), F.when(scattered, 2.0).otherwise(4.0)), (hits * 2 >= size, 2.0),
        (texts.term_hits(known, F.col("snippet_words")) > 0, 1.0)], 0.0)
    topical = F.when(F.col("papers") & (size >= 2), F.when(hits * 2 >= size, hits / size).otherwise(-6.0)
                     + 0.75 * F.least(texts.phrase_count(known, F.col("title_words")), F.lit(2))
                     + 0.5 * F.least(texts.phrase_count(known, F.col("snippet_words")), F.lit(2))).otherwise(0.0)
    path, title = F.lower(urls.unquote(urls.path("url"))), F.col("title")
    own = F.when(entity_domain(), 2.0).otherwise(0.0) + F.when(path.rlike(fixed.PRESS_URL) & (F.col("kind") == "item"), 1.0).otherwise(0.0)

    def cost(amount, condition):
        return F.when(condition, amount).otherwise(0.0)

    docs = path.rlike(fixed.DOCS_URL) | F.split_part("host", F.lit("."), F.lit(1)).isin(fixed.DOCS_HOST) | title.rlike(fixed.DOCS_TITLE)
    announce = (cost(12.0, ~F.col("asks_stock") & texts.stock_blurb(title)) + cost(12.0, ~F.col("asks_docs") & docs)
                + cost(12.0, ~F.col("asks_security") & (path.rlike(fixed.ADVISORY_URL) | title.rlike(fixed.ADVISORY_TITLE)))
                + cost(6.0, title.rlike(fixed.AGGREGATOR_TITLE)) - own)
    unwanted = (cost(20.0, ~F.col("asks_stock") & (path.rlike(fixed.STOCK_URL) | title.rlike(fixed.STOCK_TITLE)))
                + cost(20.0, ~F.col("asks_policy") & (path.rlike(fixed.POLICY_URL) | title.rlike(fixed.POLICY_TITLE)))
                + F.when(F.col("announce"), announce).otherwise(0.0)
                + cost(20.0, F.col("papers") & (path.rlike(fixed.LIST_URL) | title.rlike(fixed.LIST_TITLE))))
    return F.round(base + topical + _canonical_score() + _code_adjustment() - unwanted, 3)


# ---- sets --------------------------------------------------------------------------------------
def counted(dated: Column, undated: Column, need: Column, weigh: Column) -> Column:
    """How many passing results count: undated ones at most half the need when a window was asked for."""
    return dated + F.when(weigh, F.least(undated, F.floor(need / 2))).otherwise(undated)


def set_verdicts(verdicts: DataFrame, need: int = 3) -> DataFrame:
    """good, weak or empty per result set, with the counts behind it. ``verdicts(query_id, source, passed, in_window, windowed)``."""
    told = verdicts.groupBy("query_id", "source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(F.col("passed") & F.col("in_window").isNull()).alias("undated"),
        F.max("windowed").alias("windowed"))
    weighed = counted(F.col("passed") - F.col("undated"), F.col("undated"), F.lit(need), F.col("windowed"))
    return told.withColumn("counted", weighed.cast("bigint")).withColumn("verdict", first_of([
        (F.col("counted") >= need, "good"), (F.col("passed") > 0, "weak")], "empty"))


def unrelated_sets(verdicts: DataFrame) -> DataFrame:
    """Sets that have results and none on their query."""
    return verdicts.groupBy("query_id", "source").agg((~F.max("on_query")).alias("unrelated"))


def reason_histogram(verdicts: DataFrame) -> DataFrame:
    """How often each reason failed a result, per result set: query_id, reason, n."""
    return verdicts.select("query_id", F.explode("reasons").alias("reason")).groupBy("query_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def filter_options(hits: DataFrame, now: Column, excluded: list[str], site: str | None, recency: str | None) -> DataFrame:
    """Adds ``dropped``: excluded, off_site or too_old, the first that holds; undated results stay."""
    def below(domain):
        return urls.matches_domain("url", F.lit(domain))

    bad = F.lit(False)
    for domain in excluded:
        bad = bad | below(domain)
    since = F.timestamp_seconds(F.unix_timestamp(now) - fixed.RECENCY_DAYS.get(recency or "", 0) * 86_400)
    old = (F.col("published") < since) if recency else F.lit(False)
    return hits.withColumn("dropped", first_of([(bad, "excluded"), (~below(site) if site else F.lit(False), "off_site"), (F.coalesce(old, F.lit(False)), "too_old")]))


# ---- order and fusion -----------------------------------------------------------------------------
def accepted(verdicts: DataFrame, order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Passing results in order: dated in the window first, then relevance with the source prior, then the source's own order.

    ``verdicts(query_id, passed, in_window, windowed, relevance, prior, pos)``; ``order`` names the columns that order equal scores. A chunk is
    one tier and score, cut by position.
    """
    tier = F.when(F.col("windowed") & ~F.coalesce("in_window", F.lit(False)), 1).otherwise(0)
    score = F.round(F.col("relevance") + fixed.PRIOR_WEIGHT * F.coalesce("prior", F.lit(0.0)), 6)
    rows = verdicts.where("passed").withColumn("tier", tier).withColumn("score", score)
    chunk = F.struct(F.col("tier"), (-F.col("score")).alias("score"), F.floor(F.col("pos") / 100_000).alias("block"))
    return rank_in_group(rows, ["query_id"], [F.col(name) for name in order], chunk, "rank")


def fuse(hits: DataFrame, key: Column, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: one row per query and page key with its summed score, sources and first appearance.

    Sums combine before the shuffle, so a page that a third of all hits name costs one row per task.
    """
    rows = hits.withColumn("page_key", key)
    first = F.struct("source_pos", "rank", "url")
    return rows.groupBy("query_id", "page_key").agg(
        F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("fusion"), F.array_sort(F.collect_set("source")).alias("sources"), F.min(first).alias("first"))


def merge(fused: DataFrame, extra_order: list[tuple[str, Column]] | None = None) -> DataFrame:
    """Fused pages in order: any leading keys (tier, relevance), the fusion score, first appearance; the score is shown at five decimals.

    Twelve decimals order the scores: beyond them a sum depends on the order of its terms."""
    rows = fused.withColumn("score", F.round("fusion", 5))
    lead = [column.alias(name) for name, column in (extra_order or [])]
    chunk = F.struct(*lead, (-F.round("fusion", 12)).alias("s"), F.col("first.source_pos").alias("p"), F.floor(F.col("first.rank") / 100_000).alias("b"))
    return rank_in_group(rows, ["query_id"], [F.col("first"), F.col("page_key")], chunk, "place")


def source_prior(source: Column, paid_rate: Column, topic_match: Column, canonical: Column, stars: Column) -> Column:
    """What a source's result is worth before the checks."""
    free = first_of([(source == name, value) for name, value in fixed.FREE_SOURCE_PRIORS.items()], fixed.DEFAULT_SOURCE_PRIOR)
    return first_of([(paid_rate.isNotNull(), paid_rate), ((source == "wikipedia") & topic_match, 0.9),
                     ((source == "github") & (canonical | (F.coalesce(stars, F.lit(0.0)) >= 1000)), 0.85)], free)


def anchored_answers(anchor: DataFrame, others: DataFrame, limit: int) -> DataFrame:
    """A paid source's first results keep their slots; failed slots are refilled in order by the others' passing results.

    ``anchor(query_id, slot, url, key, failed)`` with slots from 1, ``others(query_id, pos, url, key, canonical)``. A canonical
    result the anchor lacks takes the first hole, else the last slot. A query has at most ``limit`` slots and only the first
    ``2 * limit`` fills can matter, so every window here is that small.
    """
    slots = anchor.where(F.col("slot") <= limit)
    kept = slots.where(~F.col("failed"))
    fills = others.join(kept.select("query_id", "key").distinct(), ["query_id", "key"], "left_anti")
    best = Window.partitionBy("query_id").orderBy(F.col("canonical").desc(), "pos")
    fills = fills.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= 2 * limit)
    # Only one canonical result leads; the rest of the fills come in their own order.
    lead = (F.col("turn") == 1) & F.col("canonical")
    order = Window.partitionBy("query_id").orderBy(F.when(lead, 0).otherwise(1), "pos")
    fills = fills.withColumn("lead", lead).withColumn("turn", F.row_number().over(order))
    sizes = slots.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_slots"), F.count_if("failed").alias("n_holes"))
    every = sizes.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(limit)))).join(
        kept.select("query_id", "slot", F.col("url").alias("kept_url")), ["query_id", "slot"], "left")
    # Holes within the anchor's own length first, then the slots past its end.
    full = (F.col("n_holes") == 0) & (F.col("n_slots") >= limit)
    leads = fills.where("lead").select("query_id", F.lit(True).alias("has_lead"))
    every = every.join(leads, "query_id", "left").withColumn("open", F.col("kept_url").isNull() | (
        full & F.coalesce("has_lead", F.lit(False)) & (F.col("slot") == limit)))
    holes = Window.partitionBy("query_id").orderBy("slot")
    every = every.withColumn("hole", F.sum(F.col("open").cast("int")).over(holes))
    joined = every.join(fills.select("query_id", F.col("turn").alias("hole"), F.col("url").alias("fill_url")), ["query_id", "hole"], "left")
    out = joined.withColumn("url", F.when(F.col("open"), F.col("fill_url")).otherwise(F.col("kept_url"))).where(F.col("url").isNotNull())
    # Holes that nothing fills close up.
    return out.select("query_id", F.row_number().over(holes).alias("slot"), "url", F.col("open").alias("filled"))


def demote(rows: DataFrame, last: Column, chunk: Column, order: list[Column]) -> DataFrame:
    """The same order with some rows moved behind the others: one leading sort key."""
    return rank_in_group(rows, ["query_id"], order, F.struct(last.cast("int").alias("last"), chunk.alias("chunk")), "place")


def reference_rank(rows: DataFrame) -> DataFrame:
    """Reference titles by topic: equal, holding every word, the rest, qualified ones last; disambiguation pages are dropped.

    ``rows(query_id, pos, title, snippet, topic)``.
    """
    kept = rows.where(~F.lower("title").endswith("(disambiguation)") & ~F.coalesce("snippet", F.lit("")).rlike(fixed.DISAMBIGUATION))
    wanted, key = texts.title_key(F.col("topic")), texts.title_key(F.col("title"))
    words = F.filter(F.split(wanted, " "), lambda word: word != "")
    kinds = F.filter(texts.tokens(find(F.col("title"), r"\(([^)]*)\)\s*$", 1)), lambda word: ~word.rlike(r"^\d+$"))
    qualified = F.col("title").rlike(r"\([^)]*\)\s*$") & ((F.size(kinds) == 0) | (F.size(F.array_except(kinds, words)) > 0))
    tier = first_of([(F.coalesce(qualified, F.lit(False)), 3), (key == wanted, 0), ((F.size(words) > 0) & (F.size(F.array_except(words, F.split(key, " "))) == 0), 1)], 2)
    return rank_in_group(kept.withColumn("tier", tier), ["query_id"], [F.col("pos")], F.struct("tier", F.floor(F.col("pos") / 100_000).alias("b")), "place")


def date_targets(rows: DataFrame, limit: int, budget: int, order: tuple[str, ...] = ("rank", "url")) -> DataFrame:
    """Undated results that would be in the top, at most ``budget`` per query, by ``order``. ``rows(query_id, rank, in_window)``."""
    turns = Window.partitionBy("query_id").orderBy(*order)
    return rows.where((F.col("rank") <= limit) & F.col("in_window").isNull()).withColumn("turn", F.row_number().over(turns)).where(F.col("turn") <= budget)


def enrich_dates(hits: DataFrame, page_dates: DataFrame) -> DataFrame:
    """Undated hits with the date their own page gives: joined on the canonical key. ``page_dates(url, published)``."""
    known = page_dates.select(urls.canonical_url("url").alias("page_key"), F.col("published").alias("page_published")).groupBy("page_key").agg(
        F.min("page_published").alias("page_published"))
    rows = hits.withColumn("page_key", urls.canonical_url("url")).join(known, "page_key", "left")
    return rows.withColumn("date_source", first_of([(F.col("published").isNotNull(), "source"), (F.col("page_published").isNotNull(), "page")])).withColumn(
        "published", F.coalesce("published", "page_published")).drop("page_published", "page_key")


def bench_judge(results: DataFrame, now: Column) -> DataFrame:
    """The bench's verdict: why a result is not right. ``results(entity, title, snippet, page_title, page_text, published, recency, specific, url)``.

    ``entity`` is a regular expression for what the result must name.
    """
    said = F.regexp_like(F.concat_ws(" ", "title", "snippet"), "entity")
    page = F.coalesce(F.regexp_like(F.concat_ws(" ", "page_title", "page_text"), "entity"), F.lit(False))
    days = first_of([(F.col("recency") == name, count) for name, count in fixed.RECENCY_DAYS.items()])
    inside = (F.col("published") >= F.timestamp_seconds(F.unix_timestamp(now) - days * 86_400)) & (F.col("published") <= now + F.expr("interval 1 day"))
    challenge = F.col("title").rlike(fixed.BENCH_TITLE_CHALLENGE) | contains_any(F.lower(F.coalesce("page_text", F.lit(""))), fixed.BENCH_BODY_CHALLENGE)
    why = F.filter(F.array(
        F.when(~(said | page), "off_query"), F.when(days.isNotNull() & F.col("published").isNull(), "date_unverified"),
        F.when(days.isNotNull() & ~inside, "outside_window"), F.when(F.col("specific") & urls.bench_listing("url"), "listing"), F.when(challenge, "challenge")),
        lambda reason: reason.isNotNull())
    return results.withColumn("why", why).withColumn("right", F.size("why") == 0)


def anchor_reason() -> Column:
    """Extra failures of a code query's anchored answer: example repositories, and front pages when a repository was asked for."""
    tokens = F.split(F.coalesce("repo_name", F.lit("")), r"[-_.\s]+")
    example = F.col("repo_name").isNotNull() & F.arrays_overlap(tokens, words_in(fixed.EXAMPLE_TOKENS)) & ~F.arrays_overlap("words", words_in(fixed.EXAMPLE_TOKENS))
    front = F.col("repo_name").isNull() & F.col("repo") & (F.size(urls.segments(urls.path("url"))) <= 1)
    return F.when(F.col("code"), first_of([(example, "example_repo"), (front, "homepage")]))
