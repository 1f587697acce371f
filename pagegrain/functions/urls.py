"""URL columns: parts, keys that name one page, kinds, dates and words. Pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrain.functions import fixed
from pagegrain.functions.columns import c, each, find, find_all, first_of, none_if_empty, words_in

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


# ---- parts ------------------------------------------------------------------
def scheme(url) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(c(url), F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url) -> Column:
    return F.regexp_extract(F.coalesce(c(url), F.lit("")), _AUTHORITY, 1)


def host(url) -> Column:
    """Lower-case host without credentials and port; empty when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(c(url), F.lit("")),
                                    r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def no_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def bare_host(url) -> Column:
    return no_www(host(url))


def path(url) -> Column:
    raw = F.regexp_extract(F.coalesce(c(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(raw, r";[^/]*$", "")


def query(url) -> Column:
    return F.regexp_extract(F.coalesce(c(url), F.lit("")), r"^[^?#]*\?([^#]*)", 1)


def origin(url) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def unquote(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` alone."""
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
                  ).otherwise(text)


def unquote_plus(text: Column) -> Column:
    spaced = F.replace(text, F.lit("+"), F.lit(" "))
    return unquote(spaced)


def segments(url_path: Column) -> Column:
    return F.filter(F.split(url_path, "/"), lambda part: part != "")


def query_parts(url) -> Column:
    return F.filter(F.split(query(url), "&"), lambda part: part != "")


def _key(part: Column) -> Column:
    return F.split_part(part, F.lit("="), F.lit(1))


def _value(part: Column) -> Column:
    return F.regexp_extract(part, r"^[^=]*=(.*)$", 1)


def query_keys(url) -> Column:
    """Lower-case keys of the parameters that have a value."""
    filled = F.filter(query_parts(url), lambda part: _value(part) != "")
    return each(filled, lambda part: F.lower(unquote_plus(_key(part))))


def rtrim_slash(text: Column) -> Column:
    return F.regexp_replace(text, r"/+$", "")


# ---- keys ---------------------------------------------------------------------
def _page_key(url, url_path: Column, tracked) -> Column:
    kept = F.array_sort(F.filter(query_parts(url), lambda part: ~tracked(part)))
    tail = F.array_join(kept, "&")
    return F.concat(bare_host(url), rtrim_slash(url_path), F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


def canonical_url(url) -> Column:
    """One page, one key, for search results."""
    without_index = F.regexp_replace(path(url), r"/index\.(?:html?|php)$", "")
    return _page_key(url, without_index, lambda part: _key(part).rlike(fixed.TRACK_CANONICAL))


def page_key(url) -> Column:
    """One page, one key, for watches."""
    return _page_key(url, path(url), lambda part: _key(part).rlike(fixed.TRACK_PAGE_KEY))


def result_key(url) -> Column:
    """One page, one key, for the plain merge of sources."""
    return _page_key(url, path(url), lambda part: part.rlike(fixed.TRACK_RESULT_KEY))


def crawl_normal(url) -> Column:
    tail = query(url)
    return F.concat(scheme(url), F.lit("://"), F.lower(authority(url)),
                    F.when(path(url) == "", F.lit("/")).otherwise(path(url)),
                    F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


# ---- sites ----------------------------------------------------------------------
def same_site(link_host: Column, base_host: Column) -> Column:
    """The page's own host, or a subdomain of it that does not hold a service."""
    link, base = no_www(F.lower(F.coalesce(link_host, F.lit("")))), no_www(F.lower(F.coalesce(base_host, F.lit(""))))
    extra = F.substring(link, F.lit(1), F.length(link) - F.length(base) - 1)
    label = F.element_at(F.split(extra, r"\."), -1)
    below = F.endswith(link, F.concat(F.lit("."), base)) & ~label.isin(fixed.SERVICE_HOSTS)
    return F.when((link == "") | (base == ""), F.lit(False)).when(link == base, F.lit(True)).otherwise(below)


def same_site_crawl(link_host: Column, root_host: Column, subdomains: bool) -> Column:
    link, root = no_www(F.lower(link_host)), no_www(F.lower(root_host))
    below = F.endswith(link, F.concat(F.lit("."), root)) if subdomains else F.lit(False)
    return (link == root) | below


def registrable_tail(name: Column) -> Column:
    labels = F.split(F.lower(name), r"\.")
    keep = F.when((F.size(labels) >= 3) & F.try_element_at(labels, F.lit(-2)).isin(fixed.TAIL_SECOND_LEVEL),
                  F.lit(3)).otherwise(F.lit(2))
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - keep + 1, F.lit(1)), keep), ".")


def registrable_label(name: Column) -> Column:
    """The name label of a host: huggingface in huggingface.co, bbc in news.bbc.co.uk."""
    labels = F.split(no_www(name), r"\.")
    size = F.size(labels)
    second = F.try_element_at(labels, F.lit(-2))
    country = (size >= 3) & (F.length(F.element_at(labels, -1)) == 2) & second.isin(fixed.SECOND_LEVEL)
    return F.when(size < 2, F.lit("")).when(country, F.try_element_at(labels, F.lit(-3))).otherwise(second)


def brand(name: Column) -> Column:
    labels = F.split(name, r"\.")
    second = F.try_element_at(labels, F.lit(-2))
    return F.when((F.size(labels) >= 3) & second.isin(fixed.BRAND_SECOND_LEVEL),
                  F.try_element_at(labels, F.lit(-3))).otherwise(second)


def matches_domain(url, domain: Column) -> Column:
    name = bare_host(url)
    return (name == domain) | F.endswith(name, F.concat(F.lit("."), domain))


def host_suffixes(name: Column) -> Column:
    """Every parent domain of a host, itself first: an equi-join key for suffix matches."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda start: F.array_join(F.slice(labels, start, F.size(labels)), "."))


# ---- paths ------------------------------------------------------------------------
def path_pattern(url_path: Column) -> Column:
    return F.regexp_replace(url_path, "[0-9]+", "{number}")


def general_pattern(pattern: Column) -> Column:
    """A path pattern cut to its first plain segment, or the whole site."""
    first = F.coalesce(F.try_element_at(F.split(F.regexp_replace(F.coalesce(pattern, F.lit("")), r"^\^+", ""), "/"),
                                        F.lit(2)), F.lit(""))
    plain = first.rlike(r"^[A-Za-z][A-Za-z0-9_.-]{0,29}$") & ~first.contains("{") & ~first.rlike(r"\d{3,}")
    escaped = F.regexp_replace(first, r"([.-])", r"\\$1")
    return F.when(plain, F.concat(F.lit("/"), escaped, F.lit("(?:/.*)?"))).otherwise(F.lit(".*"))


def prefix_shape(prefix: Column) -> Column:
    return F.array_join(each(F.split(prefix, "/"), lambda part: first_of([
        (part.rlike(fixed.VERSION_SEGMENT), "#"), (part.startswith("@"), "@")], part)), "/")


def is_query_key(key: Column) -> Column:
    lowered = F.lower(key)
    return lowered.isin(fixed.QUERY_KEYS) | F.regexp_replace(lowered, "[^a-z0-9]", "").isin(fixed.QUERY_KEYS)


def page_kind(url) -> Column:
    where = path(url)
    has_query = F.exists(query_keys(url), is_query_key)
    item_segment = F.exists(segments(where), lambda part: part.rlike(fixed.LONG_ID) | (
        F.length(part) - F.length(F.replace(part, F.lit("-"), F.lit(""))) >= 3))
    return first_of([
        (has_query | F.when(where == "", F.lit("/")).otherwise(where).rlike(fixed.SEARCH_PATH), "search"),
        (where.rlike(fixed.ITEM_MARKER) | item_segment, "item")], "page")


def hyphens(part: Column) -> Column:
    return F.length(part) - F.length(F.replace(part, F.lit("-"), F.lit("")))


def item_like(url_path: Column) -> Column:
    by_segment = F.exists(segments(url_path), lambda part: part.rlike(fixed.LONG_ID) | (
        (hyphens(part) >= 3) & (F.length(part) >= 20)))
    return ~url_path.rlike(fixed.NOT_ITEM) & (url_path.rlike(fixed.ITEM_MARKER) | by_segment)


def _slug_words(part: Column) -> Column:
    return F.size(F.filter(F.split(part, "-"), lambda word: word != ""))


def _item_id(part: Column) -> Column:
    return (part.rlike(r"^\d{5,}$")
            | part.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
            | (part.rlike(r"^[a-z0-9]{8,}$") & part.rlike(r"\d") & part.rlike("[a-z]")))


def _days_of(parts: Column) -> Column:
    return F.try_to_date(parts, "yyyy-MM-dd")


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return _days_of(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def _month_end(year: Column, month: Column) -> Column:
    return F.last_day(_ymd(year, month, F.lit("1")))


def month_number(name: Column) -> Column:
    return F.array_position(words_in(fixed.MONTHS), F.lower(F.substring(name, 1, 3))).cast("int")


_D_FULL = r"(?<!\d)((?:19|20)\d\d)([/-])(\d{1,2})\2(\d{1,2})(?!\d)"
_D_MONTH = r"/((?:19|20)\d\d)/(0[1-9]|1[0-2])(?:/|$)"
_D_NAME = (r"(?i)/((?:19|20)\d\d)/(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
           r"(?:/(?:(\d\d)(\d\d)(?!\d))?|$)")
_D_STAMP = r"/((?:19|20)\d\d)(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?:\d{6})?(?!\d)"
_D_ARXIV = r"/(\d\d)(0[1-9]|1[0-2])\.(\d{4,5})(?:v\d+)?(?:\.pdf)?(?:/|$)"


def url_date(url) -> Column:
    """The day a path names (a month counts as its last day); the first spelling found decides."""
    where = path(url)

    def part(pattern, group):
        return F.regexp_extract(where, pattern, group)

    name_month = month_number(part(_D_NAME, 2))
    named = F.when((part(_D_NAME, 3) != "") & (part(_D_NAME, 3).try_cast("int") == name_month),
                   _ymd(part(_D_NAME, 1), name_month.cast("string"), part(_D_NAME, 4))
                   ).otherwise(_month_end(part(_D_NAME, 1), name_month.cast("string")))
    paper_year = part(_D_ARXIV, 1).try_cast("int") + 2000
    digits = F.length(part(_D_ARXIV, 3))
    paper = F.when(((digits == 5) & (paper_year >= 2015)) | ((digits == 4) & (paper_year >= 2007) & (paper_year < 2015)),
                   _month_end(paper_year.cast("string"), part(_D_ARXIV, 2)))
    return first_of([
        (where.rlike(_D_FULL), _ymd(part(_D_FULL, 1), part(_D_FULL, 3), part(_D_FULL, 4))),
        (where.rlike(_D_MONTH), _month_end(part(_D_MONTH, 1), part(_D_MONTH, 2))),
        (where.rlike(_D_NAME), named),
        (where.rlike(_D_STAMP), _ymd(part(_D_STAMP, 1), part(_D_STAMP, 2), part(_D_STAMP, 3))),
        (where.rlike(_D_ARXIV), paper)])


def article_like(url) -> Column:
    """Whether the path alone looks like one article, release or post."""
    parts = each(segments(path(url)), lambda part: F.regexp_replace(F.lower(unquote(part)), r"\.[a-z0-9]{2,5}$", ""))
    section = words_in(fixed.ARTICLE_SECTIONS)
    has_section = F.arrays_overlap(parts, section)
    with_id = has_section & F.arrays_overlap(query_keys(url), words_in(fixed.ID_KEYS))
    first = F.array_position(each(parts, lambda part: F.array_contains(section, part)), F.lit(True))
    later = F.slice(parts, first.cast("int") + 1, F.greatest(F.size(parts), F.lit(1)))
    after = (first > 0) & F.exists(later, lambda part: (_slug_words(part) >= 3) | _item_id(part))
    return url_date(url).isNotNull() | with_id | after | F.exists(parts, lambda part: _slug_words(part) >= 4)


def marketing_path(url) -> Column:
    parts = each(segments(path(url)), lambda part: F.lower(unquote(part)))
    joined = F.concat(F.lit("/"), F.array_join(parts, "/"), F.lit("/"))
    return F.arrays_overlap(parts, words_in(fixed.MARKETING_SEGMENTS)) | joined.contains("/blog/tips/")


def _index_segment(part: Column) -> Column:
    tokens = F.split(part, "[-_]")
    return part.isin(fixed.INDEX_SEGMENTS) | (
        F.size(tokens).between(2, 4) & F.forall(tokens, lambda token: token.isin(fixed.INDEX_TOKENS))
        & F.exists(tokens, lambda token: token.isin(fixed.STRONG_TOKENS)))


def _listing_path(parts: Column) -> Column:
    joined = F.array_join(parts, "/")
    trimmed = F.regexp_replace(joined, r"(?:(?:^|/)\d{1,4})+$", "")
    last = F.element_at(F.split(trimmed, "/"), -1)
    own = F.try_element_at(parts, F.lit(-1))
    entity = ((F.size(parts) >= 2) & (F.try_element_at(parts, F.lit(-2)) == "news") & (F.length(own) <= 24)
              & own.rlike(r"^[a-z]+(?:-[a-z]+)?$"))
    return ((trimmed != "") & _index_segment(last)) | F.coalesce(entity, F.lit(False))


def url_kind(url) -> Column:
    """item, homepage, search_page or tag_listing, from the URL alone; the first rule that holds decides."""
    parts = each(segments(path(url)), lambda part: F.lower(unquote(part)))
    keys = query_keys(url)
    size = F.size(parts)
    forge = bare_host(url).isin(fixed.FORGE_HOSTS)
    searching = F.arrays_overlap(keys, words_in(fixed.SEARCH_KEYS))
    without_locale = F.when(F.coalesce(F.try_element_at(parts, F.lit(1)).rlike(fixed.LOCALE), F.lit(False)),
                            F.slice(parts, 2, F.greatest(size, F.lit(1)))).otherwise(parts)
    index = F.filter(without_locale, lambda part: ~(part.startswith("index.") | part.startswith("default.")))
    tail = F.slice(parts, F.greatest(size - 1, F.lit(1)), 2)
    listing_tail = F.exists(tail, lambda part: part.isin(fixed.LISTING_SEGMENTS) | (part == "c"))
    single = (F.size(index) == 1) & F.split_part(F.try_element_at(index, F.lit(1)), F.lit("."), F.lit(1)).isin(
        fixed.SECTION_SEGMENTS)
    plain = each(index, lambda part: F.regexp_replace(part, r"\.(?:html?|php|aspx?)$", ""))
    return first_of([
        (forge & F.coalesce(F.try_element_at(parts, F.lit(1)).isin(fixed.FORGE_RESERVED), F.lit(False)), "tag_listing"),
        (forge & (size == 2) & ~searching, "item"),
        (searching & (size < 3), "search_page"),
        (F.arrays_overlap(parts, words_in(fixed.SEARCH_SEGMENTS)) & (size <= 2), "search_page"),
        (F.arrays_overlap(keys, words_in(fixed.ID_KEYS)), "item"),
        (F.size(index) == 0, "homepage"),
        (F.array_contains(keys, "tag") | F.array_contains(keys, "category"), "tag_listing"),
        (F.arrays_overlap(keys, words_in(fixed.LISTING_KEYS)) & ~article_like(url), "tag_listing"),
        (listing_tail, "tag_listing"),
        (F.coalesce(single, F.lit(False)), "tag_listing"),
        (_listing_path(plain), "tag_listing")], "item")


def bench_listing(url) -> Column:
    """The bench's rule for a homepage, section front or archive."""
    parts = F.filter(segments(path(url)), lambda part: ~part.rlike(fixed.BENCH_LOCALE))
    keys = each(query_parts(url), lambda part: F.lower(_key(part)))
    size = F.size(parts)
    last = F.lower(F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"\.[^.]*$", ""))
    before = F.lower(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")))
    first = F.lower(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")))
    return ((size == 0) | F.arrays_overlap(keys, words_in(fixed.BENCH_LISTING_QUERY))
            | last.isin(fixed.BENCH_LISTING_WORDS) | (last.rlike(r"^\d+$") & (size > 1) & (before == "page"))
            | ((size == 2) & first.isin(fixed.BENCH_LISTING_PARENTS)))


# ---- words ------------------------------------------------------------------------------
WORD = r"[\p{L}\p{N}]+"


def _values(url, wanted) -> Column:
    """Decoded values of the parameters whose key passes ``wanted``."""
    chosen = F.filter(query_parts(url), lambda part: (_value(part) != "") & wanted(unquote_plus(_key(part))))
    return each(chosen, lambda part: unquote_plus(_value(part)))


def url_words(url) -> Column:
    """What a URL asks for, in plain words: its query, else its last telling segment, else its one plain value."""
    asked = _values(url, is_query_key)

    def telling(part):
        return F.filter(find_all(F.lower(unquote(part)), WORD), lambda word: (
            (F.length(word) >= 3) & ~word.rlike(r"^\p{N}+$") & ~word.isin(fixed.PATH_GENERIC)
            & ~word.isin(fixed.URL_FILLER) & ~word.isin(fixed.STOPWORDS) & ~word.contains("search")))

    by_segment = F.filter(each(F.reverse(segments(path(url))), telling), lambda words: F.size(words) > 0)
    from_path = F.array_join(F.try_element_at(by_segment, F.lit(1)), " ")
    plain = F.filter(_values(url, lambda key: F.lit(True)), lambda value: (
        F.trim(value).rlike(r"^\p{L}{3,}(?:[ +]\p{L}{2,}){0,5}$") & ~F.lower(F.trim(value)).isin(fixed.OPTION_VALUES)))
    chosen = F.coalesce(F.when(F.size(asked) > 0, F.array_join(asked, " ")), from_path,
                        F.when(F.size(plain) == 1, F.try_element_at(plain, F.lit(1))), F.lit(""))
    return F.trim(F.regexp_replace(F.replace(chosen, F.lit("+"), F.lit(" ")), r"\s+", " "))


def stem(word: Column) -> Column:
    return first_of([(F.endswith(word, F.lit("es")) & (F.length(word) >= 5), F.substring(
        word, F.lit(1), F.length(word) - 2)), (F.endswith(word, F.lit("s")) & (F.length(word) >= 4), F.substring(
            word, F.lit(1), F.length(word) - 1))], word)


def query_terms(url, expect: Column | None = None) -> Column:
    """The lightly stemmed words the results of a search URL should mention."""
    asked = _values(url, is_query_key)
    where = path(url)
    last = unquote(F.coalesce(F.try_element_at(segments(where), F.lit(-1)), F.lit("")))
    last_words = F.filter(find_all(F.lower(last), WORD), lambda word: ~word.isin(fixed.PATH_GENERIC))
    from_path = F.when(F.when(where == "", F.lit("/")).otherwise(where).rlike(fixed.SEARCH_PATH)
                       & ~last.rlike(r"\d{4,}"), last_words)
    base = F.when(F.size(asked) > 0, F.flatten(each(asked, lambda value: find_all(F.lower(value), WORD)))).otherwise(
        F.coalesce(from_path, F.array().cast("array<string>")))
    words = base if expect is None else F.concat(base, F.flatten(each(expect, lambda value: find_all(F.lower(value), WORD))))
    kept = F.filter(words, lambda word: (F.length(word) >= 3) & ~word.isin(fixed.STOPWORDS) & ~word.rlike(r"^\p{N}+$"))
    return F.array_distinct(each(kept, stem))


def asked_stems(url) -> Column:
    """Five-letter stems of what a URL asks for."""
    values = F.array_join(_values(url, lambda key: F.lit(True)), " ")
    last = F.coalesce(F.try_element_at(segments(path(url)), F.lit(-1)), F.lit(""))
    text = F.when(F.trim(values) != "", values).otherwise(last)
    words = F.filter(find_all(F.lower(text), r"[\p{L}\p{N}]{3,}"), lambda word: ~word.isin(fixed.TERM_GENERIC))
    return F.array_distinct(each(words, lambda word: F.substring(word, 1, 5)))


def strip_credentials(url) -> Column:
    """The URL without its fragment and without parameters that carry credentials; the rest byte for byte."""
    plain = F.regexp_replace(c(url), "#.*$", "")
    front, tail = F.regexp_extract(plain, r"^([^?]*)", 1), query(url)
    kept = F.filter(F.split(tail, "&"), lambda part: ~F.lower(unquote_plus(_key(part))).isin(fixed.CREDENTIAL_KEYS))
    joined = F.array_join(kept, "&")
    return F.when(tail == "", F.regexp_replace(plain, r"\?$", "")).otherwise(
        F.concat(front, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def slug_title(url) -> Column:
    slug = F.element_at(F.split(rtrim_slash(path(url)), "/"), -1)
    slug = F.regexp_replace(F.regexp_replace(slug, r"\.[a-z0-9]{2,5}$", ""), "[-_]", " ")
    text = F.trim(F.regexp_replace(slug, r"\s+", " "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(
        text, F.lit(2), F.length(text))))


def not_a_page(url) -> Column:
    return path(url).rlike(fixed.NOT_PAGES)


def is_ad(url, name: Column | None = None, labelled: Column | None = None) -> Column:
    hit = F.concat(host(url), F.lit(".")).rlike(fixed.AD_HOST) | path(url).rlike(fixed.AD_PATH)
    if name is not None:
        hit = hit | F.coalesce(name, F.lit("")).rlike(r"(?i)^\s*sponsored\b")
    return hit if labelled is None else hit | F.coalesce(labelled, F.lit(False))


# ---- relative references ---------------------------------------------------------------------
def _without_dots(url_path: Column) -> Column:
    """``.`` and ``..`` segments resolved, as relative references are."""
    empty = F.array().cast("array<string>")
    parts = F.split(F.regexp_replace(url_path, "^/", ""), "/")
    folded = F.aggregate(parts, empty, lambda done, part: first_of([
        (part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))), (part == ".", done)],
        F.concat(done, F.array(part))))
    ends = F.element_at(parts, -1).isin(".", "..")
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"))
    return F.when(~url_path.rlike(r"/\.\.?(/|$)"), url_path).otherwise(
        F.when(ends & ~F.endswith(joined, F.lit("/")), F.concat(joined, F.lit("/"))).otherwise(joined))


def resolve(base, href) -> Column:
    """``href`` as an absolute URL on the page ``base``."""
    base, link = c(base), F.trim(c(href))
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    front = F.regexp_extract(link, r"^([^?#]*)", 1)
    tail = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    return first_of([
        (link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link),
        (link.startswith("//"), F.concat(scheme(base), F.lit(":"), link)),
        (link == "", F.regexp_replace(base, "#.*$", "")),
        (link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link)),
        (link.startswith("?"), F.concat(root, path(base), link)),
        (link.startswith("/"), F.concat(root, _without_dots(front), tail))],
        F.concat(root, _without_dots(F.concat(folder, front)), tail))
