"""Text columns: words, query terms, matches, card facts, numbers, dates, walls. Pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrain.functions import fixed, urls
from pagegrain.functions.columns import (c, contains_any, count_of, each, find, find_all, first_of, none_if_empty,
                                         squeeze, words_in)

WORD = r"[\p{L}\p{N}]+"
stem = urls.stem


def uni(pattern: str) -> str:
    """The same pattern with word, space and digit classes that know every alphabet."""
    return "(?U)" + pattern


def words(text: Column) -> Column:
    return find_all(text, WORD)


def query_words(query: Column) -> Column:
    return F.array_distinct(each(words(F.regexp_replace(F.coalesce(query, F.lit("")), fixed.OPERATOR, " ")), F.lower))


# ---- query terms ------------------------------------------------------------------
def _terms_of(text: Column, stemmed: bool) -> Column:
    ascii_only = r"^\p{ASCII}*$"
    filler = fixed.STOPWORDS + fixed.QUERY_FILLER
    kept = F.filter(words(text), lambda raw: (
        ~F.lower(raw).isin(filler) & ~raw.rlike(r"^(?:19|20)\d\d$")
        & ((F.length(raw) >= 3) | ~raw.rlike(ascii_only)
           | ((F.length(raw) == 2) & ((raw == F.upper(raw)) & raw.rlike(r"\p{L}") | raw.rlike(r"\p{N}"))))))

    def form(raw):
        low = F.lower(raw)
        return F.when(F.length(low) > 2, stem(low)).otherwise(low) if stemmed else low

    weak_words = fixed.PLATFORM_WORDS + fixed.WEAK_WORDS

    def weak(raw):
        named = form(raw).isin(weak_words) | F.lower(raw).isin(fixed.WEAK_WORDS)
        return named & (raw == F.lower(raw)) & raw.rlike(r"\p{L}")

    strong = F.array_distinct(each(F.filter(kept, lambda raw: ~weak(raw)), form))
    platform = F.array_distinct(each(F.filter(kept, weak), form))
    return F.when(F.size(strong) > 0, strong).otherwise(platform)


def _terms(query, stemmed: bool) -> Column:
    text = F.regexp_replace(F.coalesce(c(query), F.lit("")), fixed.OPERATOR, " ")
    plain = _terms_of(F.regexp_replace(text, fixed.NAVIGATIONAL, " "), stemmed)
    return F.when(F.size(plain) > 0, plain).otherwise(_terms_of(text, stemmed))


def key_terms(query) -> Column:
    """What a query is about: up to eight stemmed words, without operators, filler and years."""
    return _terms(query, True)


def raw_terms(query) -> Column:
    return _terms(query, False)


# Endings a term may take in a text, by the ending it has itself: state, stem length cut, endings.
_SHORT = ["", "s", "es"]
_PLAIN = ["", "e", "es", "s", "ed", "d", "ing", "er", "ers"]
_ATION = ["ation", "ations", "ing", "ed", "e", "es", "er", "ers", "or", "ors", "ion", "ions", "s"]
_ING = ["", "ing", "ings", "ed", "e", "es", "s", "er", "ers", "ling"]


def term_family(term: Column) -> Column:
    """struct(term, forms, loose): the words that count as the term; one outside ASCII may also stand inside a word.

    Worked out once per query, so that matching a text is an overlap of two word arrays and compiles no pattern.
    """
    size = F.length(term)

    def cut(count):
        return F.substring(term, F.lit(1), size - count)

    def forms(count, endings):
        return F.transform(words_in(endings), lambda ending: F.concat(cut(count), ending))

    family = first_of([
        ((size >= 11) & F.endswith(term, F.lit("ation")) & cut(5).rlike(r"^\p{L}+$"), forms(5, _ATION)),
        ((size >= 7) & F.endswith(term, F.lit("ing")) & cut(3).rlike(r"^\p{L}+$"), forms(3, _ING)),
        (size <= 4, forms(0, _SHORT))], forms(0, _PLAIN))
    return F.struct(term.alias("term"), family.alias("forms"), (~term.rlike(r"^\p{ASCII}*$")).alias("loose"))


def families(terms: Column) -> Column:
    return each(terms, term_family)


def tokens(text: Column) -> Column:
    """The lower-case words of a text, in order: what families are matched against."""
    return words(F.lower(F.coalesce(text, F.lit(""))))


def has_term(family: Column, found: Column) -> Column:
    """Whether a term, or one of its family, is among a text's words."""
    return F.arrays_overlap(family["forms"], found) | (family["loose"] & F.exists(
        found, lambda word: F.contains(word, family["term"])))


def phrase_in(left: Column, right: Column, found: Column) -> Column:
    """Two terms next to each other, with at most a connector between."""
    spots = F.when(F.size(found) >= 2, F.sequence(F.lit(1), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))

    def follows(at):
        after, later = F.element_at(found, at + 1), F.try_element_at(found, at + 2)
        bridged = after.isin("of", "and", "with", "for", "in", "on", "the", "a", "an", "to", "by") & F.coalesce(
            F.array_contains(right["forms"], later), F.lit(False))
        return F.array_contains(left["forms"], F.element_at(found, at)) & (F.array_contains(right["forms"], after) | bridged)

    return F.exists(spots, follows)


def phrase_count(known: Column, found: Column) -> Column:
    """How many neighbouring pairs of the query's terms are neighbours in the text."""
    pairs = F.when(F.size(known) >= 2, F.sequence(F.lit(1), F.size(known) - 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(pairs, lambda at: phrase_in(F.element_at(known, at), F.element_at(known, at + 1), found)))


def term_hits(known: Column, found: Column) -> Column:
    return F.size(F.filter(known, lambda family: has_term(family, found)))


def rarer(known: Column) -> Column:
    first, second = F.try_element_at(known, F.lit(1)), F.try_element_at(known, F.lit(2))

    def odd(family):
        return (~family["term"].rlike(r"^\p{L}+$")).cast("int")

    longer = F.length(second["term"]) - F.length(first["term"])
    return F.when((longer > 0) | ((longer == 0) & (odd(second) > odd(first))), second).otherwise(first)


def enough_terms(known: Column, found: Column, entity: Column) -> Column:
    """Whether a text's words cover enough of a query's terms."""
    hits, size = term_hits(known, found), F.size(known)
    return first_of([
        (size == 0, True), (size == 1, hits == 1), (size == 2, (hits == 2) | (entity & has_term(rarer(known), found)))],
        entity | (hits >= F.ceil(size / 2)) | (phrase_count(known, found) > 0))


# ---- entities -------------------------------------------------------------------------
_RUNS = "struct<runs:array<struct<run:array<string>,full:array<string>>>,run:array<string>,full:array<string>>"


def entity_runs(query) -> Column:
    """The named things of a query: each as its significant words and as written. One fold over the words."""
    tokens = words(F.regexp_replace(F.coalesce(c(query), F.lit("")), fixed.OPERATOR, " "))
    capital_first = r"^[\p{Lu}\p{Lt}]"
    meaningful = F.filter(tokens, lambda word: (
        ~F.lower(word).isin(fixed.STOPWORDS + fixed.QUERY_FILLER + fixed.GENERIC_CAPS) & ~word.rlike(r"^(?:19|20)\d\d$")
        & ((F.length(word) >= 3) | ~word.rlike(r"^\p{ASCII}*$"))))
    title_case = (F.size(meaningful) >= 3) & F.forall(meaningful, lambda word: word.rlike(r"^[\p{Lu}\p{Lt}\p{Nd}]"))
    following = F.concat(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), F.array(F.lit("")))
    pairs = F.arrays_zip(tokens.alias("word"), following.alias("following"))
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<struct<run:array<string>,full:array<string>>>").alias("runs"),
                     none.alias("run"), none.alias("full"))

    def step(state, pair):
        word, after = pair["word"], pair["following"]
        low = F.lower(word)
        running = F.size(state["run"]) > 0
        capital = word.rlike(capital_first) | (running & word.rlike(r"^\p{Nd}"))
        capital = capital & ~(low.isin(fixed.GENERIC_CAPS) & ~running)
        take = capital & ~low.isin(fixed.QUERY_FILLER + fixed.STOPWORDS)
        link = running & low.isin(fixed.CONNECTORS) & after.rlike(capital_first)
        added = F.struct(state["runs"].alias("runs"), F.concat(state["run"], F.array(word)).alias("run"),
                         F.concat(state["full"], F.array(word)).alias("full"))
        linked = F.struct(state["runs"].alias("runs"), state["run"].alias("run"),
                          F.concat(state["full"], F.array(word)).alias("full"))
        closed = F.struct(F.concat(state["runs"], F.array(F.struct(state["run"].alias("run"), state["full"].alias("full")))
                                   ).alias("runs"), none.alias("run"), none.alias("full"))
        return F.when(take, added).when(link, linked).otherwise(closed)

    def close(state):
        return F.concat(state["runs"], F.array(F.struct(state["run"].alias("run"), state["full"].alias("full"))))

    runs = F.aggregate(pairs, start.cast(_RUNS), step, close)
    named = F.filter(each(runs, lambda item: F.struct(
        each(F.filter(item["run"], lambda word: ((F.length(word) >= 3) | ~word.rlike(r"^\p{ASCII}*$"))
                      & ~word.rlike(r"^(?:19|20)\d\d$")), F.lower).alias("phrase"), item["full"].alias("full"))),
        lambda item: F.size(item["phrase"]) > 0)
    distinct = F.filter(named, lambda item, at: ~F.exists(F.slice(named, F.lit(1), at),
                                                          lambda other: other["phrase"] == item["phrase"]))
    empty = F.array().cast("array<struct<phrase:array<string>,full:array<string>>>")
    return F.when(title_case, empty).otherwise(distinct)


def entities(query) -> Column:
    return each(entity_runs(query), lambda item: F.array_join(item["phrase"], " "))


# ---- card facts ----------------------------------------------------------------------------
def availability(text: Column) -> Column:
    return first_of([(text.rlike(uni(fixed.EXPIRED)), "expired"), (text.rlike(uni(fixed.OUT_OF_STOCK)), "out_of_stock"),
                     (text.rlike(uni(fixed.LIMITED)), "limited"), (text.rlike(uni(fixed.IN_STOCK)), "in_stock")])


def stock_count(text: Column) -> Column:
    return F.coalesce(find(text, uni(fixed.STOCK_COUNT), 1), find(text, uni(fixed.STOCK_COUNT), 2)).try_cast("int")


def date_mention(text: Column) -> Column:
    return squeeze(find(text, uni(fixed.DATE_MENTION)))


def rating(text: Column) -> Column:
    value = F.coalesce(*[find(text, uni(fixed.RATING), group).try_cast("double") for group in (1, 2, 3, 4)])
    return F.when((value > 0) & (value <= 5), value)


def counted(text: Column) -> Column:
    return F.replace(find(text, uni(fixed.COUNTED), 1), F.lit(","), F.lit("")).try_cast("bigint")


def counted_noun(text: Column) -> Column:
    noun = F.lower(find(text, uni(fixed.COUNTED), 2))
    return F.when(F.endswith(noun, F.lit("s")), noun).otherwise(F.concat(noun, F.lit("s")))


def location(text: Column) -> Column:
    found = F.coalesce(find(text, uni(fixed.LOCATION_LABEL), 1), find(text, fixed.PLACE_LINE, 1))
    return F.regexp_replace(squeeze(found), r"^[ ,]+|[ ,]+$", "")


def sponsored(text: Column) -> Column:
    return F.coalesce(text.rlike(fixed.AD_LABEL), F.lit(False))


# ---- numbers and dates ---------------------------------------------------------------------
_NUMBER = r"-?\d(?:[\d.,]|\s(?=\d{3}\b))*\d|-?\d"


def locale_number(text: Column) -> Column:
    """1,299.00 and 1.299,00 alike: the marks' order and shape say which one is the point."""
    raw = F.regexp_replace(find(text, _NUMBER), r"\s", "")
    comma, dot = raw.contains(","), raw.contains(".")
    no_comma = F.replace(raw, F.lit(","), F.lit(""))
    no_dot = F.replace(raw, F.lit("."), F.lit(""))
    dot_last = F.length(F.substring_index(raw, ".", -1)) < F.length(F.substring_index(raw, ",", -1))
    chosen = first_of([
        (comma & dot & dot_last, no_comma),
        (comma & dot, F.replace(no_dot, F.lit(","), F.lit("."))),
        (comma & raw.rlike(r"^-?\d{1,3}(,\d{3})+$"), no_comma),
        (comma, F.replace(raw, F.lit(","), F.lit("."))),
        (F.length(raw) - F.length(no_dot) > 1, no_dot)], raw)
    return chosen.try_cast("double")


_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?\s?(?:[Zz]|[+-]\d{2}:?\d{2})?)?$"
_RFC = (r"^(?:[A-Za-z]{3},?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{2}:\d{2})(:\d{2})?\s*"
        r"(GMT|UTC|UT|Z|[+-]\d{4})?$")


def lenient_timestamp(value) -> Column:
    """ISO 8601, RFC 2822 or Unix seconds as a timestamp; a time with no zone is UTC."""
    text = F.trim(c(value))
    iso = F.regexp_replace(F.regexp_replace(text, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(text.rlike(r"[T ].*[+-]\d{4}$"), iso).otherwise(F.regexp_replace(text, r"(:\d{2}),(\d)", "$1.$2"))
    zone = F.regexp_extract(text, _RFC, 6)
    offset = F.when(zone.rlike(r"^[+-]"), zone).otherwise("+0000")
    seconds = F.when(F.regexp_extract(text, _RFC, 5) == "", ":00").otherwise(F.regexp_extract(text, _RFC, 5))
    rfc = F.try_to_timestamp(F.concat(
        F.lpad(F.regexp_extract(text, _RFC, 1), 2, "0"), F.lit(" "), F.initcap(F.regexp_extract(text, _RFC, 2)), F.lit(" "),
        F.regexp_extract(text, _RFC, 3), F.lit(" "), F.regexp_extract(text, _RFC, 4), seconds, F.lit(" "), offset),
        F.lit("dd MMM yyyy HH:mm:ss xx"))
    return first_of([
        (text.rlike(r"^\d{9,11}$"), F.timestamp_seconds(text.try_cast("bigint"))),
        (text.rlike(_ISO), iso.try_cast("timestamp")),
        (text.rlike(_RFC), rfc)])


def day_end(day: Column) -> Column:
    """A date known to the day counts as that day's last second."""
    return day.cast("timestamp") + F.expr("interval 86399 seconds")


_LEAD_ISO = r"(?<!\d)((?:19|20)\d\d)-(\d\d)-(\d\d)(?!\d)"
_MON = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_LEAD_DMY = r"(?i)(?<!\d)(\d{1,2})(?:st|nd|rd|th)?\s+" + _MON + r",?\s+((?:19|20)\d\d)(?!\d)"
_LEAD_MDY = r"(?i)" + _MON + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+((?:19|20)\d\d)(?!\d)"
_LEAD_MD = r"(?i)(?<![\w])" + _MON + r"\s+(\d{1,2})(?:st|nd|rd|th)?(?![\d:])(?!,?\s*(?:19|20)\d\d)"
_LEAD_AGO = (r"(?i)(?<!\w)(?:(\d{1,3})|an?|one)\s*(second|sec|minute|min|hour|hr|day|week|wk|month|mo|year|yr)s?\s+ago\b")


def _seconds_back(now: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(now) - seconds)


def lead_date(text: Column, now: Column) -> Column:
    """A date the text leads with (its first 70 characters): absolute, "3 days ago", or a month and day."""
    lead = F.substring(F.trim(F.coalesce(text, F.lit(""))), 1, 70)

    def part(pattern, group):
        return F.regexp_extract(lead, pattern, group)

    def day(year, month, number):
        return day_end(F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"),
                                                 F.lpad(number, 2, "0")), "yyyy-MM-dd"))

    unit = F.lower(part(_LEAD_AGO, 2))
    unit_days = first_of([(unit == "day", 1), (unit.isin("week", "wk"), 7), (unit.isin("month", "mo"), 30),
                          (unit.isin("year", "yr"), 365)], 0)
    how_many = F.coalesce(part(_LEAD_AGO, 1).try_cast("int"), F.lit(1))
    month = urls.month_number(part(_LEAD_MD, 1))
    this_year = day(F.year(now).cast("string"), month, part(_LEAD_MD, 2))
    last_year = day((F.year(now) - 1).cast("string"), month, part(_LEAD_MD, 2))
    return first_of([
        (lead.rlike(_LEAD_ISO), day(part(_LEAD_ISO, 1), part(_LEAD_ISO, 2), part(_LEAD_ISO, 3))),
        (lead.rlike(_LEAD_DMY), day(part(_LEAD_DMY, 3), urls.month_number(part(_LEAD_DMY, 2)), part(_LEAD_DMY, 1))),
        (lead.rlike(_LEAD_MDY), day(part(_LEAD_MDY, 3), urls.month_number(part(_LEAD_MDY, 1)), part(_LEAD_MDY, 2))),
        (lead.rlike(_LEAD_AGO), _seconds_back(now, unit_days * how_many * 86400)),
        (lead.rlike(r"(?i)^yesterday\b"), _seconds_back(now, F.lit(86400))),
        (lead.rlike(_LEAD_MD), F.when(this_year <= now + F.expr("interval 1 day"), this_year).otherwise(last_year))])


def published(source_date: Column, snippet: Column, title: Column, url, now: Column) -> Column:
    """struct(at, origin): the source's own date, else one the snippet or title leads with, else one in the URL."""
    def option(at, origin):
        return F.when(at.isNotNull(), F.struct(F.least(at, now).alias("at"), F.lit(origin).alias("origin")))

    own = lenient_timestamp(source_date)
    stated = F.when(own <= now + F.expr("interval 2 days"), F.struct(own.alias("at"), F.lit("source").alias("origin")))
    return F.coalesce(stated, option(lead_date(snippet, now), "snippet"), option(lead_date(title, now), "title"),
                      option(day_end(urls.url_date(url)), "url"))


# ---- keys and fingerprints ----------------------------------------------------------------
def story_key(title: Column, most: int | None = None) -> Column:
    """The words of a title of four or more; the first ``most`` of them, if given."""
    found = words(F.lower(F.coalesce(title, F.lit(""))))
    return F.when(F.size(found) >= 4, F.array_join(found if most is None else F.slice(found, 1, most), " "))


def fingerprint(text: Column) -> Column:
    """The key under which two pages of one poll hold the same text."""
    return F.sha2(F.lower(squeeze(F.coalesce(text, F.lit("")))), 256)


# ---- markdown lines -----------------------------------------------------------------------
def visible(line: Column) -> Column:
    return F.regexp_replace(line, fixed.MD_LINK, "$1")


def linked_chars(line: Column) -> Column:
    return F.aggregate(find_all(line, fixed.MD_LINK, 1), F.lit(0), lambda total, text: total + F.length(text))


def link_share(line: Column) -> Column:
    letters = F.length(F.regexp_replace(visible(line), r"(?U)[\s*#>|_`-]", ""))
    return F.when(letters > 0, linked_chars(line) / letters).otherwise(F.lit(1.0))


def body_line(line: Column) -> Column:
    plain = F.regexp_replace(visible(line), r"^[ *#>|-]+|[ *#>|-]+$", "")
    return (F.length(plain) >= 80) & (link_share(line) < 0.35)


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\u000B\f\u001C-\u001E\u0085  ]")


def paragraphs(text: Column) -> Column:
    return F.size(F.filter(lines_of(F.coalesce(text, F.lit(""))), body_line))


def word_count(text: Column) -> Column:
    return count_of(text, r"(?U)\S+")


def consent_only(text: Column) -> Column:
    total, hits = word_count(text), count_of(text, uni(fixed.CONSENT))
    return (total > 0) & (total < 400) & (hits >= 3) & (hits / total > 0.02)


def consent_leads(text: Column, within: int | None = None) -> Column:
    """Whether a text speaks of consent three times, ``within`` its first characters if given."""
    return count_of(text if within is None else F.substring(text, 1, within), uni(fixed.CONSENT)) >= 3


def prose_line(plain: Column) -> Column:
    return (word_count(plain) >= 8) & F.rtrim(plain).rlike(fixed.SENTENCE_END)


# ---- responses ------------------------------------------------------------------------------
def status_failure(status: Column) -> Column:
    return first_of([
        (status == 401, "AUTH_REQUIRED"), (status == 403, "BLOCKED"), (status == 429, "RATE_LIMITED"),
        (status.isin(404, 410), "NOT_FOUND"), (status.between(400, 499), "UNKNOWN"), (status >= 500, "PROVIDER_DOWN")])


def wall_vendor(headers: Column, body: Column) -> Column:
    """Which bot defence answered, from a header map and the page; the order of the rules decides."""
    names = each(F.map_keys(headers), F.lower)
    values = F.lower(F.array_join(F.transform(F.map_entries(headers), lambda item: F.concat(
        item["key"], F.lit("="), item["value"])), " "))
    page = F.lower(F.coalesce(body, F.lit("")))

    def named(name):
        return F.array_contains(names, name)

    def says(text):
        return values.contains(text)

    def shows(text):
        return page.contains(text)

    return first_of([
        (named("cf-ray") | named("cf-mitigated") | says("server=cloudflare") | shows("/cdn-cgi/challenge"), "cloudflare"),
        (named("x-datadome") | says("datadome=") | shows("captcha-delivery.com"), "datadome"),
        (named("x-px") | (says("_px") & named("set-cookie")) | shows("perimeterx") | shows("px-captcha"), "perimeterx"),
        (named("x-kpsdk-ct") | named("x-kpsdk-r") | shows("kpsdk"), "kasada"),
        (says("incap_ses") | says("visid_incap") | named("x-iinfo") | shows("incapsula"), "imperva"),
        (says("akamaighost") | named("akamai-grn") | says("_abck=") | says("bm_sz="), "akamai"),
        (named("x-amzn-waf-action") | says("aws-waf-token") | shows("awswaf"), "aws_waf"),
        (named("x-vercel-mitigated") | shows("vercel security checkpoint"), "vercel"),
        (named("x-sucuri-id") | shows("sucuri website firewall"), "sucuri")])


def stock_blurb(title: Column) -> Column:
    market = title.rlike(fixed.STOCK_BLURB_MARKET) | title.rlike(fixed.STOCK_BLURB_TRADING)
    return title.rlike(fixed.STOCK_BLURB_PHRASE) | (title.rlike(fixed.STOCK_BLURB_TICKER) & market)


def strip_json_prefix(text: Column) -> Column:
    return F.regexp_replace(text, fixed.JSON_PREFIX, "")


# ---- answers and topics -----------------------------------------------------------------------
def final_answer(text: Column) -> Column:
    return F.trim(F.try_element_at(find_all(text, r"ANSWER:\s*(.+)", 1), F.lit(-1)))


def answer_contains(answer: Column, values: list[str]) -> Column:
    return F.coalesce(contains_any(F.lower(answer), [value.lower() for value in values]), F.lit(False))


def answer_matches(answer: Column, pattern: str) -> Column:
    return F.coalesce(answer.rlike("(?i)" + pattern), F.lit(False))


def answer_number(answer: Column, value: Column, tolerance: Column) -> Column:
    numbers = each(find_all(answer, r"-?\d[\d,]*\.?\d*"),
                   lambda text: F.replace(text, F.lit(","), F.lit("")).try_cast("double"))
    return F.coalesce(F.exists(numbers, lambda number: F.abs(number - value) <= tolerance), F.lit(False))


def question_topic(query: Column) -> Column:
    """A question's words without the question words and, in a question, the verb it asks about."""
    tokens = F.filter(each(F.split(F.trim(query), r"\s+"), lambda word: F.regexp_replace(
        word, r"^[?!.,;:]+|[?!.,;:]+$", "")), lambda word: word != "")
    lead = F.lower(F.coalesce(F.try_element_at(tokens, F.lit(1)), F.lit("")))
    question = lead.isin([word for word in fixed.ASKING if word not in fixed.ARTICLES])
    before = F.concat(F.array(F.lit("")), tokens)
    kept = F.filter(tokens, lambda word, at: ~F.lower(word).isin(fixed.ASKING) & ~(question & (
        F.lower(word).isin(fixed.ASKED_VERBS)
        | (F.lower(word).isin(fixed.DEGREE) & (at > 0) & (F.lower(F.element_at(before, at + 1)) == "how")))))
    joined = F.array_join(kept, " ")
    return F.when(joined != "", joined).otherwise(F.trim(query))


def reference_topic(query: Column) -> Column:
    topic = question_topic(query)
    return F.coalesce(F.trim(find(topic, fixed.PROPERTY_OF, 1)), topic)


def title_key(text: Column) -> Column:
    """A title or topic compared loosely: no closing parenthetical, articles or case."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\([^)]*\)\s*$", "")
    return F.array_join(F.filter(words(F.lower(plain)), lambda word: ~word.isin(fixed.ARTICLES)), " ")


def site_terms(query: Column) -> Column:
    kept = F.filter(words(F.lower(query)), lambda word: (F.length(word) >= 2) & ~word.isin(fixed.SITE_STOP))
    return F.array_distinct(kept)


def site_match(title: Column, snippet: Column, url, terms: Column) -> Column:
    """All of one or two terms, else six in ten of them, over title, snippet and path words."""
    spoken = F.regexp_replace(urls.path(url), "[-_]", " ")
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")), spoken))
    found = F.size(F.filter(terms, lambda term: F.contains(text, term)))
    need = F.when(F.size(terms) <= 2, F.size(terms)).otherwise(F.ceil(F.size(terms) * 3 / 5))
    return (F.size(terms) == 0) | (found >= need)


_HOST = r"^(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"


def named_site(query: Column) -> Column:
    """struct(site, rest): the first token that plainly names a domain, and the query without it."""
    tokens = F.filter(F.split(query, r"\s+"), lambda word: word != "")

    def domain(token):
        text = F.regexp_replace(F.regexp_replace(token, r"""^["'()\[\]{}<>,;!?]+|["'()\[\]{}<>,;!?]+$""", ""), r"[.:]+$", "")
        tagged = F.lower(text).startswith("site:")
        text = F.when(tagged, F.substring(text, F.lit(6), F.length(text))).otherwise(text)
        explicit = tagged | text.contains("://") | F.lower(text).startswith("www.")
        name = F.when(text.contains("://"), urls.host(text)).otherwise(F.lower(text))
        name = F.regexp_replace(urls.no_www(F.split_part(name, F.lit("/"), F.lit(1))), r"\.+$", "")
        tld = F.substring_index(name, ".", -1)
        accepted = explicit | (~tld.isin(fixed.FILE_TLDS) & ((F.length(tld) != 2) | tld.isin(fixed.CC_TLDS)))
        return F.when(name.rlike(_HOST) & accepted, name)

    hosts = each(tokens, domain)
    at = F.array_position(each(hosts, lambda host: host.isNotNull()), F.lit(True))
    rest = F.filter(tokens, lambda word, index: (at == 0) | (index != at - 1))
    return F.struct(F.when(at > 0, F.try_element_at(hosts, F.greatest(at, F.lit(1)).cast("int"))).alias("site"),
                    F.when(at > 0, F.array_join(rest, " ")).otherwise(query).alias("rest"))


def phrase_groups_match(groups: Column, text: Column) -> Column:
    """Every AND-group has some phrase that the text contains."""
    low = F.lower(text)
    return F.forall(groups, lambda group: F.exists(group, lambda phrase: F.contains(low, F.lower(phrase))))


def compact(known: Column, found: Column) -> Column:
    """Whether a query's terms sit close together among a title's words."""
    spots = each(known, lambda family: F.filter(
        F.transform(found, lambda word, at: F.when(F.array_contains(family["forms"], word), at)),
        lambda at: at.isNotNull()))
    missing = F.exists(spots, lambda places: F.size(places) == 0)

    def nearest(places, anchor):
        return F.aggregate(places, F.lit(None).cast("int"), lambda best, at: F.when(
            best.isNull() | (F.abs(at - anchor) < F.abs(best - anchor)), at).otherwise(best))

    def width(anchor):
        chosen = F.concat(F.array(anchor), F.transform(F.slice(spots, 2, F.greatest(F.size(spots), F.lit(1))),
                                                       lambda places: nearest(places, anchor)))
        return F.array_max(chosen) - F.array_min(chosen) + 1

    narrowest = F.least(F.size(found), F.array_min(F.transform(F.try_element_at(spots, F.lit(1)), width)))
    return ~missing & (narrowest <= F.size(known) + 3)
