"""Structured data, main content, cards, records and item lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegrain.functions import fixed, prices, texts, urls
from pagegrain.operators import blocks, records, registries, structured
from pagegrain.plans import duck
from pagegrain.plans.pages import every_page, resolve_sql, squeeze_sql, unescape_sql
from pagegrain.plans.registry import query
from pagegrain.sources.tables import with_views

def _now():
    return F.lit("2024-02-15 12:00:00").cast("timestamp")
PRODUCT_SCHEMA = {
    "title": "Product", "type": "object", "required": ["name", "price", "gtin"],
    "properties": {"name": {"type": "string"}, "price": {"type": "number"}, "currency": {"type": "string"},
                   "image": {"type": "string"}, "brand": {"type": "string"}, "rating": {"type": "number"},
                   "sku": {"type": "string"}, "description": {"type": "string"}, "gtin": {"type": "string"},
                   "stock": {"type": "integer"}},
}
PRODUCTS = with_views("product_pages")


def _ld(path: str) -> str:
    return f"json_extract_string(regexp_extract(html, '(?s)ld\\+json\">(.*?)</script>', 1), '{path}')"


@query("j3_jsonld_nodes", f"""{PRODUCTS} SELECT page_id, unnest(['', 'breadcrumblist', 'product']) AS type,
  unnest([NULL, 'Home', {_ld('$."@graph"[1].name')}]) AS name FROM product_pages""")
def j3(t):
    nodes = structured.jsonld_nodes(t.product_pages)
    return nodes.select("page_id", F.array_join("types", ",").alias("type"),
                        structured.as_text(structured.get(F.col("node"), "name")).alias("name"))


_TAG = "unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'))"


def _attr(name: str) -> str:
    return (f"(regexp_extract(tag, '(?is)\\b{name}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)'')', 1) || "
            f"regexp_extract(tag, '(?is)\\b{name}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)'')', 2))")


@query("j4_meta_tags", f"""{PRODUCTS}, m AS (SELECT page_id, {_TAG} AS tag, unnest(range(len(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')))) AS pos FROM product_pages),
k AS (SELECT page_id, pos, lower(trim(coalesce(nullif({_attr('property')}, ''), nullif({_attr('name')}, ''), nullif({_attr('itemprop')}, ''), ''))) AS key,
  trim({unescape_sql(_attr('content'))}) AS value FROM m)
SELECT page_id, pos, key, value FROM k WHERE key <> '' AND value <> ''""")
def j4(t):
    return structured.meta_tags(t.product_pages)


@query("j5_microdata", f"""{PRODUCTS} SELECT page_id, 'Product' AS type, unnest(['name', 'price']) AS prop,
  unnest([regexp_extract(html, '<h1>([^<]*)</h1>', 1), regexp_extract(html, 'itemprop="price" content="([^"]*)"', 1)]) AS value FROM product_pages""")
def j5(t):
    return blocks.microdata(blocks.elements(t.product_pages)).select("page_id", "type", "prop", "value")


def _filled(t):
    nodes, meta = structured.jsonld_nodes(t.product_pages), structured.meta_tags(t.product_pages)
    return structured.fill_schema(PRODUCT_SCHEMA, nodes, meta, structured.embedded_json(t.product_pages))


@query("j6_schema_fill", """
SELECT p_partkey AS page_id, unnest(['name', 'price', 'currency', 'image', 'brand', 'rating', 'sku', 'description', 'stock']) AS property,
  unnest([p_name, '12' || lpad(cast(p_size AS varchar), 2, '0') || '.5', 'AUD', '/img/' || p_partkey || '.jpg', p_brand,
    '4' || CASE WHEN p_size % 10 = 0 THEN '' ELSE '.' || (p_size % 10) END, 'L-' || p_partkey, 'A ' || p_name || '.', '3']) AS value,
  unnest(['jsonld:product.name', 'jsonld:product.offers.price', 'jsonld:product.offers.priceCurrency', 'jsonld:product.image',
    'jsonld:product.brand.name', 'jsonld:product.aggregateRating.ratingValue', 'jsonld:product.sku', 'meta:description', 'embedded_json']) AS source
FROM part""")
def j6(t):
    return _filled(t).select("page_id", "property", "value", "source")


@query("j6_schema_report", """SELECT p_partkey AS page_id, 9 AS found, 10 AS "of", 'gtin' AS missing, false AS valid FROM part""")
def j6_report(t):
    report = structured.schema_report(PRODUCT_SCHEMA, t.product_pages, _filled(t))
    return report.select("page_id", "found", "of", F.array_join("missing", ",").alias("missing"), "valid")


@query("j7_preferred_object", """SELECT p_partkey AS page_id, 'product' AS type FROM part""")
def j7(t):
    schema = {"properties": PRODUCT_SCHEMA["properties"]}
    nodes = structured.jsonld_nodes(t.product_pages)
    chosen = structured.preferred_objects(schema, nodes, structured.schema_candidates(schema, nodes))
    return nodes.join(chosen, ["page_id", "ord"]).select("page_id", F.array_join("types", ",").alias("type"))


@query("j8_page_dates", f"""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN '2024-01-' ELSE '2024-02-' END || lpad(cast(1 + p_size % 28 AS varchar), 2, '0')
  || CASE WHEN p_partkey % 3 = 0 THEN ' 08:00:00' ELSE ' 00:00:00' END AS published,
  CASE WHEN p_partkey % 3 = 0 THEN 'meta:article:published_time' ELSE 'jsonld' END AS origin FROM part
WHERE p_partkey % 3 = 0 OR 1 + p_size % 28 <= 17""")
def j8(t):
    return structured.page_dates(t.product_pages, _now()).select("page_id", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), "origin")


@query("j9_record_fields", """SELECT p_partkey AS card_id, p_name AS field_role, 'item.name' AS field_role_source,
  cast(120000 + p_partkey AS varchar) || '.0' AS field_salary, 'label:Pay' AS field_salary_source,
  'Springfield, NSW' AS field_place, 'label:Where' AS field_place_source,
  CASE WHEN p_partkey % 2 = 0 THEN 'true' END AS field_remote, CASE WHEN p_partkey % 2 = 0 THEN 'text:Remote' END AS field_remote_source,
  p_brand AS field_employer, 'label:Company' AS field_employer_source, CAST(NULL AS varchar) AS field_link, CAST(NULL AS varchar) AS field_link_source FROM part""")
def j9(t):
    text = F.concat_ws("\n", "p_name", F.concat(F.lit("Company: "), "p_brand"),
                       F.concat(F.lit("Pay: $"), (F.col("p_partkey") + 120000).cast("string")),
                       F.lit("Where: Springfield, NSW"), F.when(F.col("p_partkey") % 2 == 0, "Remote").otherwise("Not remote"))
    rows = t.part.select(F.col("p_partkey").alias("card_id"), F.col("p_name").alias("name"), text.alias("text"))
    fields = {"role": "title", "salary": "price", "place": "location", "remote": "boolean", "employer": "text", "link": "url"}
    return records.fill_fields(rows, fields, "text").drop("name", "text")


@query("j13_main_content")
def j13(t):
    found = blocks.main_content(blocks.elements(every_page(t)))
    return found.select("page_id", "method", "chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("j14_markdown")
def j14(t):
    return blocks.to_markdown(every_page(t)).select("page_id", F.length("markdown").alias("chars"),
                                                    F.md5(F.col("markdown").cast("binary")).alias("markdown_md5"))


@query("j15_image_urls", f"""{PRODUCTS}, o AS (SELECT page_id, {duck.scheme('url')} || '://' || {duck.authority('url')} AS root FROM product_pages)
SELECT page_id, root || '/img/' || page_id || '.jpg' AS image, 0 AS tier FROM o
UNION ALL SELECT page_id, root || '/img/1' || page_id || '.jpg', 2 FROM o""")
def j15(t):
    return structured.image_urls(t.product_pages).select("page_id", "image", "tier")


@query("s7_feed_links", f"""{PRODUCTS} SELECT page_id, {duck.scheme('url')} || '://' || {duck.authority('url')} || '/feed.xml' AS feed FROM product_pages
UNION ALL SELECT page_id, 'https://a.test/atom' FROM product_pages""")
def s7(t):
    return structured.feed_links(t.product_pages).select("page_id", "feed")


@query("s3_ndjson_explode", """WITH b AS (SELECT conv_id, string_agg(json_object('turn', turn, 'role', role), chr(10) ORDER BY turn) ||
  CASE WHEN conv_id % 4 = 0 THEN chr(10) || 'not json' ELSE '' END AS body, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT c.conv_id, cast(c.turn AS bigint) AS turn, c.role FROM conversations c JOIN b USING (conv_id) WHERE b.n >= 2 AND c.conv_id % 4 <> 0""")
def s3(t):
    from pagegrain.sources.payloads import ndjson_records
    line = F.to_json(F.struct("turn", "role"))
    # A body is one conversation's turns, so it is as long as a conversation.
    made = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("rows"))
    body = F.concat(F.array_join(F.transform("rows", lambda row: row["line"]), "\n"), F.when(F.col("conv_id") % 4 == 0, "\nnot json").otherwise(""))
    rows = ndjson_records(made.select(F.col("conv_id").alias("page_id"), body.alias("body")))
    return rows.select(F.col("page_id").alias("conv_id"), F.try_variant_get("record", "$.turn", "bigint").alias("turn"),
                       F.try_variant_get("record", "$.role", "string").alias("role"))


@query("s9_platform_items", """SELECT p_partkey AS page_id, p_name || ' one' AS name, CASE WHEN p_partkey % 2 = 0 THEN p_size + 7.5 ELSE p_size + 5.0 END AS price,
  CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE cast(p_size + 9 AS double) END AS was_price,
  CASE WHEN p_partkey % 2 = 0 THEN 'in_stock' ELSE 'out_of_stock' END AS availability, 'https://i.test/1.jpg' AS image FROM part
UNION ALL SELECT p_partkey, p_name || ' two', 9.99, NULL, NULL, NULL FROM part""")
def s9(t):
    return records.platform_items(t.shop_json).select("page_id", "name", "price", "was_price", "availability", "image")


@query("k23_listing_json_url", f"""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 < 2 THEN 'https://shop' || p_size || '.example.com/en-au/collections/'
  || replace(p_name, ' ', '-') || '/products.json?limit=250' END AS listing FROM part""")
def k23(t):
    return t.shop_json.select("page_id", records.listing_json_url(F.col("html"), "url").alias("listing"))


@query("j21_cards", """SELECT p_partkey AS page_id, unnest(['/product/1' || p_partkey || '-a-very-plain-ring', '/product/2' || p_partkey || '-a-very-plain-ring'] ||
    CASE WHEN p_type = 'STANDARD' THEN ['/c/STANDARD'] ELSE [] END) AS path,
  unnest([p_name || ' one', 'Two'] || CASE WHEN p_type = 'STANDARD' THEN ['STANDARD'] ELSE [] END) AS title,
  unnest(['/img/1' || p_partkey || '.jpg', NULL] || CASE WHEN p_type = 'STANDARD' THEN [NULL] ELSE [] END) AS image FROM part""")
def j21(t):
    found = blocks.cards(t.product_pages, blocks.elements(t.product_pages))
    return found.select("page_id", urls.path("url").alias("path"), "title", F.when(F.col("image").isNotNull(), urls.path("image")).alias("image"))


LISTING = with_views("listing_md")


@query("j22_markdown_blocks", """SELECT p_partkey AS page_id, unnest(['/c/1', '/c/2', '/c/3', '/product/' || p_partkey || 'a', '/product/' || p_partkey || 'b',
  '/product/' || p_partkey || 'c', '/product/' || p_partkey || 'd']) AS path, unnest([1, 1, 1, 6, 3, 4, 4]) AS lines FROM part""")
def j22(t):
    rows = records.record_blocks(t.listing_md)
    return rows.select("page_id", urls.path("target").alias("path"), F.size("lines").alias("lines"))


@query("j22_markdown_records", """SELECT p_partkey AS page_id, unnest([p_name || ' A', p_name || ' B', p_name || ' C', p_name || ' D']) AS name,
  unnest([p_size + 15.0, p_size + 30.0, p_size + 40.0, p_size + 50.0]) AS price, unnest([p_size + 20.0, NULL, NULL, NULL]) AS was_price,
  unnest(['in_stock', 'out_of_stock', 'limited', NULL]) AS availability FROM part""")
def j22_records(t):
    return records.markdown_records(t.listing_md).select("page_id", "name", "price", "was_price", "availability")


@query("j23_dominant_group", """SELECT p_partkey AS page_id, 'price' AS "group", cast(count(*) AS bigint) AS n FROM part, (SELECT unnest([1, 2, 3, 4])) GROUP BY p_partkey""")
def j23(t):
    return records.markdown_records(t.listing_md).groupBy("page_id", "group").agg(F.count(F.lit(1)).alias("n"))


@query("j24_record_confidence")
def j24(t):
    rows = records.records(records.record_blocks(t.listing_md)).withColumn("templated", F.lit(False))
    return records.confidence(rows).select("page_id", "kind", urls.path("target").alias("path"), "confidence")


_RL = duck.text(fixed.RECORD_LINK)
_PLAIN = squeeze_sql(f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, {duck.text(fixed.RECORD_IMAGE)}, '', 'g'), {_RL}, '\\2', 'g'), "
                     f"'[*_`#>]+', ' ', 'g'), '^\\s*(?:[-+]|\\d+\\.)\\s+', '')")


@query("j25_site_template", f"""{LISTING}, l AS (SELECT page_id, {duck.bare_host('url')} AS site, url, unnest(string_split(content, chr(10))) AS line FROM listing_md),
one AS (SELECT site, page_id, 'line' AS kind, lower({_PLAIN}) AS value FROM l WHERE length({_PLAIN}) >= 3),
raws AS (SELECT site, page_id, url, unnest(regexp_extract_all(line, {_RL})) AS raw FROM l),
two AS (SELECT site, page_id, 'link' AS kind, regexp_extract(raw, {_RL}, 3) AS href, url FROM raws WHERE NOT starts_with(raw, '!')),
both_kinds AS (SELECT site, page_id, kind, value FROM one UNION SELECT site, page_id, kind, regexp_replace({resolve_sql('url', 'href')}, '/+$', '') FROM two)
SELECT site, kind, value, cast(count(*) AS bigint) AS n_pages FROM both_kinds GROUP BY site, kind, value HAVING count(*) >= 2""")
def j25(t):
    return records.site_template(t.listing_md).select("site", "kind", "value", "n_pages")


@query("j25_templated_records")
def j25_records(t):
    template = records.site_template(t.listing_md)
    rows = records.records(records.record_blocks(t.listing_md))
    return records.templated(rows, template).groupBy("templated").agg(F.count(F.lit(1)).alias("n"))


@query("j26_json_lists", """SELECT p_partkey AS page_id, 'props.items' AS path, 'name=name,price=price,url=url' AS fields, 3 AS n_objects, 31.5 AS score FROM part""")
def j26(t):
    lists = structured.json_lists(structured.embedded_json(t.product_pages))
    return structured.best_list(structured.score_lists(lists, t.product_pages))


SPEC = {"source": "embedded_json", "path": "props.items",
        "fields": {"name": {"path": "name", "type": "text"}, "link": {"path": "url", "type": "url"}, "price": {"path": "price", "type": "number"}}}


@query("j27_spec_items", f"""SELECT p_partkey AS page_id, unnest([0, 1, 2]) AS pos, 3 AS total, unnest([p_name || ' one', p_name || ' two', p_name || ' three']) AS name,
  unnest(['/product/1' || p_partkey || '-x', '/product/2' || p_partkey || '-x', '/product/3' || p_partkey || '-x']) AS path, unnest([p_size + 0.0, p_size + 1.0, p_size + 2.0]) AS price FROM part""")
def j27(t):
    return structured.extract_items(SPEC, t.product_pages).select("page_id", "pos", "total", "name", urls.path("link").alias("path"), "price")


@query("j28_next_page", f"""{with_views('urls')}, q AS (SELECT url_id, url, {duck.parts('url')} AS parts FROM urls),
o AS (SELECT *, list_filter(parts, lambda x: split_part(x, '=', 1) = 'page')[1] AS own FROM q),
n AS (SELECT *, CASE WHEN own IS NULL THEN 1 ELSE try_cast(regexp_extract(own, '^[^=]*=(.*)$', 1) AS integer) END AS page FROM o)
SELECT url_id, CASE WHEN floor((page - 1) / 1) + 1 < 3 THEN regexp_extract(url, '^([^?#]*)', 1) || '?' ||
  array_to_string(list_append(list_filter(parts, lambda x: split_part(x, '=', 1) <> 'page'), 'page=' || (page + 1)), '&') END AS next_url FROM n""")
def j28(t):
    return t.urls.select("url_id", structured.next_page("url", "page", 1, 1, 3).alias("next_url"))


@query("j29_invalid_page", """SELECT page_id, contains(lower(url), 'page=2') OR contains(lower(html), 'blest') AS invalid FROM pages""")
def j29(t):
    return t.pages.select("page_id", structured.invalid_page(F.lit("A title"), F.col("html"), F.col("url"), {
        "final_url_contains": ["page=2"], "title": ["gone"], "text": ["blest"]}).alias("invalid"))


@query("j30_assertions", """SELECT event_id, true AS check_0, cast(json_extract(props, '$.k') AS integer) = 42 AS check_1, false AS check_2, false AS check_3, false AS passed FROM events""")
def j30(t):
    rows = t.events.select("event_id", F.parse_json("props").alias("v"))
    checks = [("k", "nonempty", None), ("k", "equals", 42), ("k", "min_length", 1), ("missing", "nonempty", None)]
    return structured.check_assertions(rows, "v", checks).drop("v")


@query("j31_streamed_payload", """SELECT event_id, cast(json_extract(props, '$.k') AS bigint) AS k FROM events""")
def j31(t):
    # The payload in two script chunks, as an app router streams it.
    text = F.to_json(F.struct(F.concat(F.lit('1:{"a":[1],"s":"}"} data:'), F.col("props"), F.lit(" tail")).alias("s")))
    literal = F.regexp_extract(text, r'^\{"s":(.*)\}$', 1)
    html = F.concat(F.lit('<script>self.__next_f.push([1,"x "])</script><script>self.__next_f.push([1,'), literal, F.lit("])</script>"))
    rows = t.events.select("event_id", structured.streamed_payload(html, "data:").alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("j32_deep_key", """SELECT p_partkey AS page_id, '3' AS value FROM part""")
def j32(t):
    return structured.deep_key(structured.embedded_json(t.product_pages), ["stock", "stocklevel"])


@query("a20_longest_list", """SELECT p_partkey AS page_id, 3 AS rows FROM part""")
def a20(t):
    return structured.longest_list(structured.embedded_json(t.product_pages)).select("page_id", "rows")


@query("a19_page_price_count", """SELECT p_partkey AS page_id, 5 AS prices FROM part""")
def a19(t):
    rows = prices.with_prices(t.listing_md.select("page_id", "content"), F.col("content"), "found")
    return rows.select("page_id", prices.plain_count(F.col("found")).alias("prices"))


# ---- item lists: a page per supplier, an item per part it ships ------------------------------
_ITEMS = """WITH items AS (SELECT l_suppkey AS page_id, p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' in leeds' END AS name,
  CASE p_partkey % 5 WHEN 0 THEN 'https://other.test/p/' ELSE 'https://www.shop.example.com/p/' END || p_partkey AS url,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_retailprice END AS price FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _items(t):
    key = F.col("p_partkey").cast("string")
    return t.lineitem.select("l_suppkey", "l_partkey").join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("l_suppkey").alias("page_id"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(" in leeds")).alias("name"),
        F.concat(F.when(F.col("p_partkey") % 5 == 0, "https://other.test/p/").otherwise("https://www.shop.example.com/p/"), key).alias("url"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("price"))


def _item_pages(t):
    return t.supplier.select(F.col("s_suppkey").alias("page_id"), F.lit("https://shop.example.com/list").alias("url"),
                             F.concat_ws(" ", "s_name", F.repeat(F.lit("red ring old bolt "), 150)).alias("text"))


@query("g13_item_trust", f"""{_ITEMS}, x AS (SELECT i.*, lower(name) AS nm, contains(lower(s_name || ' ' || repeat('red ring old bolt ', 150)), lower(name)) AS named,
  starts_with(i.url, 'https://www.shop.example.com/') AS linked FROM items i JOIN supplier ON s_suppkey = page_id),
s AS (SELECT page_id, count(*) AS n, round(avg(linked::int), 2) AS linked, round(avg(named::int), 2) AS named, round(avg((price > 0)::int), 2) AS priced,
  round(count(DISTINCT url) / count(*), 2) AS distinct_share FROM x GROUP BY page_id)
SELECT page_id, cast(n AS bigint) AS count, linked, named, priced, distinct_share,
  CASE WHEN linked < 0.5 OR distinct_share < 0.5 OR named < 0.2 THEN 'poor' WHEN linked >= 0.8 AND distinct_share >= 0.8 AND named >= 0.5 THEN 'good' ELSE 'partial' END AS grade FROM s""")
def g13(t):
    return records.verify_items(_items(t), _item_pages(t)).select("page_id", "count", "linked", "named", "priced",
                                                                  F.col("distinct").alias("distinct_share"), "grade")


@query("g14_link_farm", f"""{_ITEMS}, o AS (SELECT page_id, CASE WHEN ends_with(name, ' in leeds') THEN array_to_string(string_split(lower(name), ' ')[1:2], ' ') END AS opening FROM items),
c AS (SELECT page_id, opening, count(*) AS n FROM o GROUP BY page_id, opening)
SELECT page_id, sum(n) >= 4 AND coalesce(max(n) FILTER (opening IS NOT NULL), 0) >= 0.7 * sum(n) AS link_farm FROM c GROUP BY page_id""")
def g14(t):
    return records.link_farms(_items(t))


@query("g12_schema_gate", """SELECT p_partkey AS page_id, false AS complete, 9000.0 + p_size AS score, 'missing required fields: gtin' AS reason FROM part""")
def g12(t):
    verdicts = t.part.select(F.col("p_partkey").alias("page_id"), F.lit(True).alias("complete"), F.col("p_size").cast("double").alias("score"),
                             F.lit(None).cast("string").alias("reason"))
    report = structured.schema_report(PRODUCT_SCHEMA, t.product_pages, _filled(t))
    return structured.schema_gate(verdicts, report).select("page_id", "complete", "score", "reason")


# ---- plug-in surface -----------------------------------------------------------------------------
@query("f1_detectors")
def f1(t):
    rows = records.detect(t.card_text, "body", "title", ("availability", "rating", "count", "date"))
    return rows.select("card_id", "availability", "rating", "count", "count_of", "date")


@query("f2_enrich", """SELECT p_partkey AS card_id, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE p_size * 2 + 10.0 END AS price,
  CASE WHEN p_size * 3 + 20.5 > CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE p_size * 2 + 10.0 END THEN p_size * 3 + 20.5 END AS was_price,
  CASE WHEN p_partkey % 3 = 0 THEN 'limited' WHEN p_size % 4 = 0 THEN 'in_stock' WHEN p_size % 4 = 1 THEN 'out_of_stock' WHEN p_size % 4 = 2 THEN 'limited' ELSE 'expired' END AS availability
FROM part""")
def f2(t):
    items = t.card_text.withColumn("price", F.when(F.col("card_id") % 2 == 0, F.lit(1.0))).withColumn(
        "availability", F.when(F.col("card_id") % 3 == 0, F.lit("limited")))
    return records.enrich(items, "body", "title", ("offer", "availability")).select("card_id", "price", "was_price", "availability")


@query("f3_adapters", """SELECT page_id, 'http' AS adapter, cast(length(html) AS bigint) AS size FROM pages UNION ALL SELECT -1 - p_partkey, 'json', 2 FROM part""")
def f3(t):
    registry = registries.Adapters()
    registry.register("http", lambda df: df.select("page_id", F.length("body").cast("bigint").alias("size")))
    registry.register("json", lambda df: df.select("page_id", F.json_array_length(F.get_json_object("body", "$.products")).cast("bigint").alias("size")))
    rows = t.pages.select("page_id", F.lit("http").alias("adapter"), F.col("html").alias("body")).unionByName(
        t.shop_json.select((-1 - F.col("page_id")).alias("page_id"), F.lit("json").alias("adapter"), "body"))
    return registry.project(rows)


@query("f4_search_sources", """SELECT 'github' AS source, cast(count(*) AS bigint) AS hits FROM part UNION ALL SELECT 'open_library', count(*) FROM part""")
def f4(t):
    from pagegrain.sources import payloads
    registry = registries.Sources()
    registry.register("github", payloads.github)
    registry.register("open_library", payloads.open_library)
    registry.register("arxiv", payloads.arxiv)
    registry.enable("arxiv", False)
    key = F.col("p_partkey").cast("string")
    code = F.concat(F.lit('{"items":[{"html_url":"https://github.com/a/'), key, F.lit('","full_name":"a"}]}'))
    books = F.concat(F.lit('{"docs":[{"key":"/works/'), key, F.lit('","title":"t","author_name":["A","B"],"first_publish_year":1999}]}'))
    rows = t.part.select(F.col("p_partkey").alias("payload_id"), F.lit("github").alias("source"), code.alias("body")).unionByName(
        t.part.select(F.col("p_partkey").alias("payload_id"), F.lit("open_library").alias("source"), books.alias("body")))
    return payloads.normalise(rows, registry.freeze()).groupBy("source").agg(F.count(F.lit(1)).alias("hits"))


@query("f5_site_modules", f"""SELECT p_partkey AS page_id, unnest(['items', 'items', 'items', 'menu', 'menu', 'menu']) AS module, unnest([0, 1, 2, 0, 1, 2]) AS pos,
  unnest([p_name || ' one', p_name || ' two', p_name || ' three', 'Home', 'All', 'New']) AS name FROM part""")
def f5(t):
    modules = registries.SiteModules()
    modules.register("items", SPEC)
    modules.register("menu", {"source": "embedded_json", "path": "props.menu", "fields": {"name": {"path": "title", "type": "text"}}})
    return modules.extract(t.product_pages, ["name"])


F6 = """SELECT p_partkey AS page_id, unnest(['/c/1', '/c/2', '/c/3', '/product/' || p_partkey || 'a', '/product/' || p_partkey || 'b',
  '/product/' || p_partkey || 'c', '/product/' || p_partkey || 'd']) AS path, unnest([1, 1, 1, 6, 3, 4, 4]) AS n_lines FROM part"""


@query("f6_record_udtf", F6)
def f6(t):
    registries.register_record_blocks(t.spark, t.listing_md)
    t.listing_md.createOrReplaceTempView("pagegrain_listing_md")
    rows = t.spark.sql("SELECT p.page_id, r.target, r.lines FROM pagegrain_listing_md p, LATERAL record_blocks(p.page_id) r")
    return rows.select("page_id", urls.path("target").alias("path"), F.size("lines").alias("n_lines"))


@query("f6_record_fields", """SELECT p_partkey AS page_id, unnest([p_name || ' A', p_name || ' B', p_name || ' C', p_name || ' D']) AS name,
  unnest([p_size + 15.0, p_size + 30.0, p_size + 40.0, p_size + 50.0]) AS price, unnest([p_size + 20.0, NULL, NULL, NULL]) AS was_price FROM part""")
def f6_fields(t):
    registries.register_listing_records(t.spark, t.listing_md)
    t.listing_md.createOrReplaceTempView("pagegrain_listing_md")
    return t.spark.sql("SELECT p.page_id, r.name, r.price, r.was_price FROM pagegrain_listing_md p, LATERAL listing_records(p.page_id) r")
