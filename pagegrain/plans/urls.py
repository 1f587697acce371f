"""URL columns over every URL shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import fixed, urls
from pagegrain.plans import duck
from pagegrain.plans.registry import query
from pagegrain.sources.tables import with_views

URL, HOSTS = with_views("urls"), with_views("host_pairs")
PATH = duck.path("url")


def _over_urls(expr: str, name: str = "value") -> str:
    return f"{URL} SELECT url_id, {expr} AS {name} FROM urls"


def _key_sql(path: str, tracked: str) -> str:
    kept = f"list_sort(list_filter({duck.parts('url')}, lambda x: NOT {tracked}))"
    tail = f"array_to_string({kept}, '&')"
    return (f"{duck.bare_host('url')} || regexp_replace({path}, '/+$', '') || "
            f"CASE WHEN {tail} <> '' THEN '?' || {tail} ELSE '' END")


@query("u1_canonical_url", _over_urls(_key_sql(
    f"regexp_replace({PATH}, '/index\\.(?:html?|php)$', '')",
    duck.like("split_part(x, '=', 1)", fixed.TRACK_CANONICAL))))
def u1(t):
    return t.urls.select("url_id", urls.canonical_url("url").alias("value"))


@query("u2_page_key", _over_urls(_key_sql(PATH, duck.like("split_part(x, '=', 1)", fixed.TRACK_PAGE_KEY))))
def u2(t):
    return t.urls.select("url_id", urls.page_key("url").alias("value"))


@query("u3_result_key", _over_urls(_key_sql(PATH, duck.like("x", fixed.TRACK_RESULT_KEY))))
def u3(t):
    return t.urls.select("url_id", urls.result_key("url").alias("value"))


@query("u4_crawl_normal", _over_urls(
    f"{duck.scheme('url')} || '://' || lower({duck.authority('url')}) || CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END"
    f" || CASE WHEN {duck.query('url')} <> '' THEN '?' || {duck.query('url')} ELSE '' END"))
def u4(t):
    return t.urls.select("url_id", urls.crawl_normal("url").alias("value"))


_LINK, _BASE = "regexp_replace(lower(link_host), '^www\\.', '')", "regexp_replace(lower(base_host), '^www\\.', '')"


@query("u5_same_site", f"""{HOSTS} SELECT pair_id,
  CASE WHEN {_LINK} = '' OR {_BASE} = '' THEN false WHEN {_LINK} = {_BASE} THEN true
       ELSE ends_with({_LINK}, '.' || {_BASE}) AND NOT list_contains({duck.words(fixed.SERVICE_HOSTS)},
            string_split(left({_LINK}, greatest(length({_LINK}) - length({_BASE}) - 1, 0)), '.')[-1]) END AS value
FROM host_pairs""")
def u5(t):
    return t.host_pairs.select("pair_id", urls.same_site(F.col("link_host"), F.col("base_host")).alias("value"))


@query("u6_same_site_crawl", f"""{HOSTS} SELECT pair_id, {_LINK} = {_BASE} AS exact,
  {_LINK} = {_BASE} OR ends_with({_LINK}, '.' || {_BASE}) AS with_subdomains FROM host_pairs""")
def u6(t):
    link, base = F.col("link_host"), F.col("base_host")
    return t.host_pairs.select("pair_id", urls.same_site_crawl(link, base, False).alias("exact"),
                               urls.same_site_crawl(link, base, True).alias("with_subdomains"))


def _tail_sql(host: str) -> str:
    labels = f"string_split(lower({host}), '.')"
    keep = (f"CASE WHEN len({labels}) >= 3 AND list_contains({duck.words(fixed.TAIL_SECOND_LEVEL)}, {labels}[-2]) "
            f"THEN 3 ELSE 2 END")
    return f"array_to_string({labels}[greatest(len({labels}) - ({keep}) + 1, 1):], '.')"


@query("u7_registrable_tail", f"""{HOSTS} SELECT pair_id, {_tail_sql('link_host')} AS tail,
  {_tail_sql('link_host')} = {_tail_sql('base_host')} AS same FROM host_pairs""")
def u7(t):
    link, base = urls.registrable_tail(F.col("link_host")), urls.registrable_tail(F.col("base_host"))
    return t.host_pairs.select("pair_id", link.alias("tail"), (link == base).alias("same"))


_LAB = f"string_split({duck.bare_host('url')}, '.')"


@query("u8_site_brand", f"""{URL} SELECT url_id,
  CASE WHEN len({_LAB}) < 2 THEN '' WHEN len({_LAB}) >= 3 AND length({_LAB}[-1]) = 2
        AND list_contains({duck.words(fixed.SECOND_LEVEL)}, {_LAB}[-2]) THEN {_LAB}[-3] ELSE {_LAB}[-2] END AS label,
  CASE WHEN len({_LAB}) >= 3 AND list_contains({duck.words(fixed.BRAND_SECOND_LEVEL)}, {_LAB}[-2]) THEN {_LAB}[-3]
       ELSE {_LAB}[-2] END AS brand
FROM urls""")
def u8(t):
    name = urls.bare_host("url")
    return t.urls.select("url_id", urls.registrable_label(name).alias("label"), urls.brand(name).alias("brand"))


@query("u9_matches_domain", f"""{URL} SELECT url_id, {duck.bare_host('url')} = 'example.com'
  OR ends_with({duck.bare_host('url')}, '.example.com') AS value FROM urls""")
def u9(t):
    return t.urls.select("url_id", urls.matches_domain("url", F.lit("example.com")).alias("value"))


@query("u10_path_pattern", _over_urls(f"regexp_replace({PATH}, '[0-9]+', '{{number}}', 'g')"))
def u10(t):
    return t.urls.select("url_id", urls.path_pattern(urls.path("url")).alias("value"))


_SEG = f"coalesce(string_split(regexp_replace({PATH}, '[0-9]+', '{{number}}', 'g'), '/')[2], '')"


@query("u11_general_pattern", _over_urls(f"""CASE WHEN regexp_matches({_SEG}, '^[A-Za-z][A-Za-z0-9_.-]{{0,29}}$')
  AND NOT contains({_SEG}, '{{') AND NOT regexp_matches({_SEG}, '\\d{{3,}}')
  THEN '/' || replace(replace({_SEG}, '.', '\\.'), '-', '\\-') || '(?:/.*)?' ELSE '.*' END"""))
def u11(t):
    return t.urls.select("url_id", urls.general_pattern(urls.path_pattern(urls.path("url"))).alias("value"))


@query("u12_prefix_shape", _over_urls(f"""array_to_string(list_transform(string_split({PATH}, '/'), lambda x:
  CASE WHEN {duck.like('x', fixed.VERSION_SEGMENT)} THEN '#' WHEN starts_with(x, '@') THEN '@' ELSE x END), '/')"""))
def u12(t):
    return t.urls.select("url_id", urls.prefix_shape(urls.path("url")).alias("value"))


_QK = (f"(list_contains({duck.words(fixed.QUERY_KEYS)}, x) OR list_contains({duck.words(fixed.QUERY_KEYS)}, "
       f"regexp_replace(x, '[^a-z0-9]', '', 'g')))")
_ANY_SEG_ID = (f"len(list_filter({duck.segments(PATH)}, lambda s: {duck.like('s', fixed.LONG_ID)} OR "
               f"length(s) - length(replace(s, '-', '')) >= 3)) > 0")


@query("u13_page_kind", _over_urls(f"""CASE WHEN len(list_filter({duck.keys('url')}, lambda x: {_QK})) > 0
  OR {duck.like(f"CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END", fixed.SEARCH_PATH)} THEN 'search'
  WHEN {duck.like(PATH, fixed.ITEM_MARKER)} OR {_ANY_SEG_ID} THEN 'item' ELSE 'page' END"""))
def u13(t):
    return t.urls.select("url_id", urls.page_kind("url").alias("value"))


def item_like_sql(path: str) -> str:
    by_segment = (f"len(list_filter({duck.segments(path)}, lambda s: {duck.like('s', fixed.LONG_ID)} OR "
                  f"(length(s) - length(replace(s, '-', '')) >= 3 AND length(s) >= 20))) > 0")
    return (f"(NOT {duck.like(path, fixed.NOT_ITEM)} AND ({duck.like(path, fixed.ITEM_MARKER)} OR {by_segment}))")


@query("u14_item_like", _over_urls(item_like_sql(PATH)))
def u14(t):
    return t.urls.select("url_id", urls.item_like(urls.path("url")).alias("value"))


# A date in the path, without lookaround or back-references: both separators spelled out.
def date_sql(path: str) -> str:
    full = "(?:^|[^0-9])((?:19|20)[0-9][0-9])(?:/([0-9]{1,2})/([0-9]{1,2})|-([0-9]{1,2})-([0-9]{1,2}))(?:[^0-9]|$)"
    month = "/((?:19|20)[0-9][0-9])/(0[1-9]|1[0-2])(?:/|$)"
    name = ("(?i)/((?:19|20)[0-9][0-9])/(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
            "(?:/(?:([0-9][0-9])([0-9][0-9])(?:[^0-9]|$))?|$)")
    stamp = "/((?:19|20)[0-9][0-9])(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(?:[0-9]{6})?(?:[^0-9]|$)"
    paper = "/([0-9][0-9])(0[1-9]|1[0-2])\\.([0-9]{4,5})(?:v[0-9]+)?(?:\\.pdf)?(?:/|$)"

    def g(pattern, n):
        return f"regexp_extract({path}, '{pattern}', {n})"

    def day(y, m, d):
        return f"try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS date)"

    number = f"list_position({duck.words(fixed.MONTHS)}, lower({g(name, 2)}))"
    fm, fd = f"({g(full, 2)} || {g(full, 4)})", f"({g(full, 3)} || {g(full, 5)})"
    py = f"(try_cast({g(paper, 1)} AS integer) + 2000)"
    return f"""CASE WHEN regexp_matches({path}, '{full}') THEN {day(g(full, 1), fm, fd)}
      WHEN regexp_matches({path}, '{month}') THEN last_day({day(g(month, 1), g(month, 2), "'1'")})
      WHEN regexp_matches({path}, '{name}') THEN CASE WHEN {g(name, 3)} <> '' AND try_cast({g(name, 3)} AS integer) = {number}
        THEN {day(g(name, 1), f"cast({number} AS varchar)", g(name, 4))}
        ELSE last_day({day(g(name, 1), f"cast({number} AS varchar)", "'1'")}) END
      WHEN regexp_matches({path}, '{stamp}') THEN {day(g(stamp, 1), g(stamp, 2), g(stamp, 3))}
      WHEN regexp_matches({path}, '{paper}') THEN CASE WHEN (length({g(paper, 3)}) = 5 AND {py} >= 2015)
        OR (length({g(paper, 3)}) = 4 AND {py} >= 2007 AND {py} < 2015)
        THEN last_day({day(f"cast({py} AS varchar)", g(paper, 2), "'1'")}) END END"""


def slug_sql(part: str) -> str:
    return f"len(list_filter(string_split({part}, '-'), lambda w: w <> ''))"


def article_ctes(source: str, id_column: str) -> str:
    """CTE bodies: lowered path parts, keys, and whether the URL is article-like."""
    item_id = ("(regexp_matches(x, '^[0-9]{5,}$') OR regexp_matches(x, "
               "'^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') OR (regexp_matches(x, '^[a-z0-9]{8,}$') "
               "AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-z]')))")
    return f"""
parsed AS (SELECT *, {duck.segments(PATH)} AS raw_parts,
    list_transform({duck.segments(PATH)}, lambda y: lower(url_decode(y))) AS parts, {duck.keys('url')} AS keys,
    {duck.bare_host('url')} AS bare, {date_sql(PATH)} AS day FROM {source}),
plain AS (SELECT *, list_transform(parts, lambda y: regexp_replace(y, '\\.[a-z0-9]{{2,5}}$', '')) AS names FROM parsed),
found AS (SELECT *, list_position(list_transform(names, lambda y: list_contains({duck.words(fixed.ARTICLE_SECTIONS)}, y)), true)
    AS section_at FROM plain),
arts AS (SELECT *, day IS NOT NULL
    OR (coalesce(section_at, 0) > 0 AND list_has_any(keys, {duck.words(fixed.ID_KEYS)}))
    OR (coalesce(section_at, 0) > 0 AND len(list_filter(names[section_at + 1:], lambda x: {slug_sql('x')} >= 3 OR {item_id})) > 0)
    OR len(list_filter(names, lambda x: {slug_sql('x')} >= 4)) > 0 AS is_article FROM found)"""


def kind_sql() -> str:
    tokens = "string_split_regex(last_part, '[-_]')"
    strong, any_token = duck.words(fixed.STRONG_TOKENS), duck.words(fixed.INDEX_TOKENS)
    index_segment = (f"(list_contains({duck.words(fixed.INDEX_SEGMENTS)}, last_part) OR (len({tokens}) BETWEEN 2 AND 4 "
                     f"AND len(list_filter({tokens}, lambda k: NOT list_contains({any_token}, k))) = 0 "
                     f"AND list_has_any({tokens}, {strong})))")
    forge = f"list_contains({duck.words(fixed.FORGE_HOSTS)}, bare)"
    searching = f"list_has_any(keys, {duck.words(fixed.SEARCH_KEYS)})"
    return f"""
indexed AS (SELECT *, list_filter(CASE WHEN len(parts) > 0 AND regexp_matches(parts[1], '{fixed.LOCALE}') THEN parts[2:] ELSE parts END,
    lambda y: NOT (starts_with(y, 'index.') OR starts_with(y, 'default.'))) AS idx FROM arts),
trimmed AS (SELECT *, list_transform(idx, lambda y: regexp_replace(y, '\\.(?:html?|php|aspx?)$', '')) AS pidx FROM indexed),
lasted AS (SELECT *, regexp_replace(array_to_string(pidx, '/'), '(?:(?:^|/)[0-9]{{1,4}})+$', '') AS cut FROM trimmed),
ended AS (SELECT *, string_split(cut, '/')[-1] AS last_part FROM lasted),
kinds AS (SELECT *, CASE
  WHEN {forge} AND len(parts) > 0 AND list_contains({duck.words(fixed.FORGE_RESERVED)}, parts[1]) THEN 'tag_listing'
  WHEN {forge} AND len(parts) = 2 AND NOT {searching} THEN 'item'
  WHEN {searching} AND len(parts) < 3 THEN 'search_page'
  WHEN list_has_any(parts, {duck.words(fixed.SEARCH_SEGMENTS)}) AND len(parts) <= 2 THEN 'search_page'
  WHEN list_has_any(keys, {duck.words(fixed.ID_KEYS)}) THEN 'item'
  WHEN len(idx) = 0 THEN 'homepage'
  WHEN list_contains(keys, 'tag') OR list_contains(keys, 'category') THEN 'tag_listing'
  WHEN list_has_any(keys, {duck.words(fixed.LISTING_KEYS)}) AND NOT is_article THEN 'tag_listing'
  WHEN list_has_any(parts[greatest(len(parts) - 1, 1):], {duck.words(fixed.LISTING_SEGMENTS + ['c'])}) THEN 'tag_listing'
  WHEN len(idx) = 1 AND list_contains({duck.words(fixed.SECTION_SEGMENTS)}, split_part(idx[1], '.', 1)) THEN 'tag_listing'
  WHEN (cut <> '' AND {index_segment}) OR (len(pidx) >= 2 AND pidx[-2] = 'news' AND length(pidx[-1]) <= 24
        AND regexp_matches(pidx[-1], '^[a-z]+(?:-[a-z]+)?$')) THEN 'tag_listing'
  ELSE 'item' END AS url_kind FROM ended)"""


@query("u15_url_kind", f"{URL}, {article_ctes('urls', 'url_id')}, {kind_sql()} SELECT url_id, url_kind AS value FROM kinds")
def u15(t):
    return t.urls.select("url_id", urls.url_kind("url").alias("value"))


@query("u16_article_like", f"{URL}, {article_ctes('urls', 'url_id')} SELECT url_id, is_article AS value FROM arts")
def u16(t):
    return t.urls.select("url_id", urls.article_like("url").alias("value"))


@query("u17_marketing_path", f"""{URL}, {article_ctes('urls', 'url_id')}
SELECT url_id, list_has_any(parts, {duck.words(fixed.MARKETING_SEGMENTS)})
  OR contains('/' || array_to_string(parts, '/') || '/', '/blog/tips/') AS value FROM arts""")
def u17(t):
    return t.urls.select("url_id", urls.marketing_path("url").alias("value"))


_BP = f"list_filter({duck.segments(PATH)}, lambda y: NOT regexp_matches(y, '{fixed.BENCH_LOCALE}'))"
_BK = f"list_transform({duck.parts('url')}, lambda y: lower(split_part(y, '=', 1)))"


@query("u18_bench_listing", f"""{URL}, b AS (SELECT url_id, {_BP} AS p, {_BK} AS k FROM urls),
l AS (SELECT *, lower(regexp_replace(coalesce(p[-1], ''), '\\.[^.]*$', '')) AS last FROM b)
SELECT url_id, len(p) = 0 OR list_has_any(k, {duck.words(fixed.BENCH_LISTING_QUERY)})
  OR list_contains({duck.words(fixed.BENCH_LISTING_WORDS)}, last)
  OR (regexp_matches(last, '^[0-9]+$') AND len(p) > 1 AND lower(coalesce(p[-2], '')) = 'page')
  OR (len(p) = 2 AND list_contains({duck.words(fixed.BENCH_LISTING_PARENTS)}, lower(p[1]))) AS value FROM l""")
def u18(t):
    return t.urls.select("url_id", urls.bench_listing("url").alias("value"))


@query("u19_url_date", _over_urls(f"strftime({date_sql(PATH)}, '%Y-%m-%d')"))
def u19(t):
    return t.urls.select("url_id", F.date_format(urls.url_date("url"), "yyyy-MM-dd").alias("value"))


@query("u20_url_words")
def u20(t):
    return t.urls.select("url_id", urls.url_words("url").alias("value"))


@query("u21_query_terms")
def u21(t):
    return t.urls.select("url_id", F.array_join(urls.query_terms("url"), " ").alias("value"))


_KEPT = (f"array_to_string(list_filter(string_split({duck.query('url')}, '&'), lambda x: NOT list_contains("
         f"{duck.words(fixed.CREDENTIAL_KEYS)}, lower(url_decode(replace(split_part(x, '=', 1), '+', ' '))))), '&')")


@query("u22_strip_credentials", _over_urls(f"""CASE WHEN {duck.query('url')} = ''
  THEN regexp_replace(regexp_replace(url, '#.*$', ''), '\\?$', '')
  ELSE regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN {_KEPT} <> '' THEN '?' || {_KEPT} ELSE '' END END"""))
def u22(t):
    return t.urls.select("url_id", urls.strip_credentials("url").alias("value"))


_SLUG = duck.squeeze(f"regexp_replace(regexp_replace(string_split(regexp_replace({PATH}, '/+$', ''), '/')[-1], "
                     f"'\\.[a-z0-9]{{2,5}}$', ''), '[-_]', ' ', 'g')")


@query("u23_slug_title", _over_urls(f"upper(left({_SLUG}, 1)) || lower(substr({_SLUG}, 2))"))
def u23(t):
    return t.urls.select("url_id", urls.slug_title("url").alias("value"))


@query("u24_not_a_page", _over_urls(duck.like(PATH, fixed.NOT_PAGES)))
def u24(t):
    return t.urls.select("url_id", urls.not_a_page("url").alias("value"))


@query("u25_is_ad", _over_urls(f"({duck.like(duck.host('url') + chr(32) + '|| ' + chr(39) + '.' + chr(39), fixed.AD_HOST)}"
                               f" OR {duck.like(PATH, fixed.AD_PATH)})"))
def u25(t):
    return t.urls.select("url_id", urls.is_ad("url").alias("value"))


@query("u26_template_urls", """
SELECT p_partkey, 'https://shop.example.com/s?q=' || replace(url_encode(p_name), '%20', '+') || '&brand=' || replace(url_encode(p_brand), '%20', '+')
  || '&page=1' AS url FROM part""")
def u26(t):
    from pagegrain.operators.site_specs import build_urls
    template = "https://shop.example.com/s?q={query}&brand={brand}&page={page}"
    params = t.part.select("p_partkey", F.col("p_name").alias("query"), F.col("p_brand").alias("brand"))
    return build_urls(params, template, {"query": "query", "brand": "query", "page": "query"},
                      {"page": "1"}).select("p_partkey", "url")


@query("u27_asked_stems")
def u27(t):
    return t.urls.select("url_id", F.array_join(urls.asked_stems("url"), " ").alias("value"))
