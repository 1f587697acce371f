"""Structured data of pages: JSON-LD and embedded JSON nodes, meta tags, schema filling, list scoring, spec extraction.

JSON stays in the JVM as VARIANT. A tree is walked one level at a time, until no level is left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions import fixed, texts, urls
from pagegrain.functions.columns import blank_to_null, c, each, find, find_all, first_of, unescape, words_in
from pagegrain.operators.links import attribute
from pagegrain.session import cut, kept

_LD = r"""(?is)<script\b[^>]*\btype\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""
_EMBEDDED = r"""(?is)<script\b[^>]*\btype\s*=\s*["']application/json["'][^>]*>(.*?)</script\s*>"""


def items_of(value: Column) -> Column:
    """The elements of a JSON list; null when the value is not a list."""
    return F.try_variant_get(value, "$", "array<variant>")


def fields_of(value: Column) -> Column:
    """The fields of a JSON object; null when the value is not an object."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def get(value: Column, key: str) -> Column:
    return F.try_variant_get(value, '$["' + key + '"]', "variant")


def as_text(value: Column) -> Column:
    scalar = items_of(value).isNull() & fields_of(value).isNull()
    return F.when(scalar, F.try_variant_get(value, "$", "string"))


# ---- node tables ------------------------------------------------------------------
def _levels(nodes: DataFrame, expand) -> DataFrame:
    """All nodes of some trees, level by level until no child is left; each level is written once at a checkpoint. ``expand(node)`` is an array of structs."""
    levels = [cut(nodes)]
    while True:
        below = levels[-1].select(*[name for name in nodes.columns if name != "node"], F.explode(expand(F.col("node"))).alias("node"))
        level = cut(below)
        if level.isEmpty():
            break
        levels.append(level)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def jsonld_nodes(pages: DataFrame) -> DataFrame:
    """Every JSON-LD object of a page, outermost first, lists and graphs unrolled: page_id, ord, node, types."""
    bodies = pages.select("page_id", F.posexplode(find_all(F.col("html"), _LD, 1)).alias("at", "body"))
    start = bodies.select("page_id", F.struct(F.lpad(F.col("at").cast("string"), 4, "0").alias("ord"), F.try_parse_json("body").alias("v")).alias("node")).where("node.v IS NOT NULL")

    def expand(node):
        def child(at, value):
            return F.struct(F.concat(node["ord"], F.lit("."), F.lpad(at.cast("string"), 5, "0")).alias("ord"), value.alias("v"))

        listed = F.transform(F.coalesce(items_of(node["v"]), F.array().cast("array<variant>")), lambda v, at: child(at, v))
        keyed = F.filter(F.array(*[child(F.lit(at), get(node["v"], key)) for at, key in enumerate(
            ("@graph", "mainEntity", "itemListElement"))]), lambda item: item["v"].isNotNull())
        return F.concat(listed, keyed)

    rows = _levels(start, expand).select("page_id", "node.ord", F.col("node.v").alias("node"))
    kinds = get(F.col("node"), "@type")
    types = F.coalesce(each(items_of(kinds), as_text), F.when(as_text(kinds).isNotNull(), F.array(as_text(kinds))),
                       F.array().cast("array<string>"))
    return rows.where(fields_of(F.col("node")).isNotNull()).withColumn("types", each(types, F.lower))


def embedded_json(pages: DataFrame) -> DataFrame:
    """The JSON a page embeds for its own frontend: page_id, pos, value."""
    rows = pages.select("page_id", F.posexplode(find_all(F.col("html"), _EMBEDDED, 1)).alias("pos", "body"))
    return rows.select("page_id", "pos", F.try_parse_json("body").alias("value")).where(F.col("value").isNotNull())


def walk(values: DataFrame, list_head: int | None = None) -> DataFrame:
    """Every node under ``values(page_id, pos, value)``, however deep: page_id, pos, path, ord, v.

    ``ord`` orders nodes the way a reader goes down the tree: an object's own scalars before what is nested in it.
    """
    start = values.select("page_id", "pos", F.struct(F.lit("").alias("path"), F.lit("").alias("ord"), F.col("value").alias("v")).alias("node"))

    def expand(parent):
        def child(key, at, value):
            nested = (items_of(value).isNotNull() | fields_of(value).isNotNull()).cast("int").cast("string")
            return F.struct(F.when(parent["path"] == "", key).otherwise(F.concat(parent["path"], F.lit("."), key)).alias("path"),
                            F.concat(parent["ord"], nested, F.lpad(at.cast("string"), 9, "0")).alias("ord"), value.alias("v"))

        listed = F.coalesce(items_of(parent["v"]), F.array().cast("array<variant>"))
        if list_head is not None:
            listed = F.slice(listed, 1, list_head)
        entries = F.coalesce(F.map_entries(fields_of(parent["v"])), F.array().cast("array<struct<key:string,value:variant>>"))
        return F.concat(F.transform(listed, lambda v, at: child(at.cast("string"), at, v)),
                        F.transform(entries, lambda entry, at: child(entry["key"], at, entry["value"])))

    return _levels(start, expand).select("page_id", "pos", "node.*")


def meta_tags(pages: DataFrame) -> DataFrame:
    """Meta tags with a name and a value: page_id, pos, key (lower case), value."""
    rows = pages.select("page_id", F.posexplode(find_all(F.col("html"), r"(?is)<meta\b[^>]*>", 0)).alias("pos", "tag"))
    named = [attribute(F.col("tag"), name) for name in ("property", "name", "itemprop")]
    key = F.lower(F.trim(F.coalesce(*[F.when(name != "", name) for name in named], F.lit(""))))
    value = F.trim(unescape(attribute(F.col("tag"), "content")))
    return rows.select("page_id", "pos", key.alias("key"), value.alias("value")).where((F.col("key") != "") & (F.col("value") != ""))


# ---- values -----------------------------------------------------------------------------
def _json_path(json: Column, path: str) -> Column:
    """A dotted path inside a JSON object; a list on the way gives its first element. Keys that the text does not hold are not parsed for."""
    parts = path.split(".")
    told = F.lit(True)
    for part in parts:
        if re.fullmatch(r"[A-Za-z0-9_@-]+", part):  # spelt the same in JSON
            told = told & F.contains(json, F.lit(f'"{part}"'))
    spots = ["$" + "".join(f"['{part}']" for part in parts)]
    for at in range(1, len(parts)):
        spots.append("$" + "".join(f"['{part}']" + ("[0]" if index + 1 == at else "") for index, part in enumerate(parts)))
    return F.when(told, F.coalesce(*[F.get_json_object(json, spot) for spot in spots]))


def _unlisted(raw: Column) -> Column:
    return F.when(raw.startswith("["), F.get_json_object(raw, "$[0]")).otherwise(raw)


def _named(raw: Column) -> Column:
    """An object as its name, value, url, id or text."""
    inner = [blank_to_null(F.get_json_object(raw, f"$['{key}']")) for key in ("name", "@value", "value", "url", "@id", "text")]
    return F.when(raw.startswith("{"), F.coalesce(*inner)).otherwise(raw)


_EMPTY_WORDS = ["", "null", "none", "n/a", "undefined", "-"]


def _present_number(raw: Column) -> Column:
    return texts.locale_number(F.when(~F.lower(F.trim(raw)).isin(_EMPTY_WORDS), raw))


def _typed_text(raw: Column, number: Column, kind: Column) -> Column:
    """A value as a property's type, kept as text so that mixed properties share one column; null when it cannot be."""
    low = F.lower(F.trim(raw))
    whole = number == F.floor(number)
    shown = F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))
    return first_of([
        (kind == "integer", F.when(whole, shown)), (kind == "number", shown),
        (kind == "boolean", first_of([(low.isin("true", "yes", "1", "instock"), "true"), (low.isin("false", "no", "0"), "false")]))],
        F.when(~low.isin(_EMPTY_WORDS), F.trim(F.regexp_replace(raw, r"\s+", " "))))


def candidate_paths(name: str, spec: dict) -> list[str]:
    paths = list(spec.get("x-paths") or []) + fixed.SCHEMA_SYNONYMS.get(re.sub("[^a-z0-9]", "", name.lower()), [])
    return list(dict.fromkeys(paths + [name]))


# ---- schema filling -------------------------------------------------------------------------
def schema_candidates(schema: dict, nodes: DataFrame) -> DataFrame:
    """Every value a node offers for a property: page_id, ord, types, property, priority, path, value."""
    offered = []
    for name, spec in schema["properties"].items():
        for priority, path in enumerate(candidate_paths(name, spec)):
            if not path.startswith("meta:"):
                offered.append(F.struct(F.lit(name).alias("property"), F.lit(priority).alias("priority"), F.lit(path).alias("path"),
                                        F.lit(spec.get("type", "string")).alias("kind"), _json_path(F.col("json"), path).alias("raw")))
    def with_raw(fn):
        return lambda item: F.struct(*[item[name].alias(name) for name in ("property", "priority", "path", "kind")],
                                     fn(item["raw"]).alias("raw"))

    def with_number(item):
        return F.struct(*[item[name].alias(name) for name in ("property", "priority", "path", "kind", "raw")],
                        F.when(item["kind"].isin("number", "integer"), _present_number(item["raw"])).alias("number"))

    def with_value(item):
        return F.struct(*[item[name].alias(name) for name in ("property", "priority", "path")],
                        _typed_text(item["raw"], item["number"], item["kind"]).alias("value"))

    df = nodes.select("page_id", "ord", "types", F.to_json("node").alias("json")).withColumn("offers", F.array(*offered))
    df = df.withColumn("offers", F.filter("offers", lambda item: item["raw"].isNotNull()))
    # One projection per step, and nulls dropped inside the array, so that no step is repeated inside a filter.
    for step in (with_raw(_unlisted), with_raw(_named), with_raw(_unlisted), with_raw(_named), with_number, with_value):
        df = df.withColumn("offers", F.transform("offers", step))
    rows = df.select("page_id", "ord", "types", F.explode(F.filter("offers", lambda item: item["value"].isNotNull())).alias("o"))
    return rows.select("page_id", "ord", "types", "o.*")


def preferred_objects(schema: dict, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The objects whose values come first: those of the schema's type, else the one that fills the most properties."""
    wanted = [str(kind).lower() for kind in ([schema["x-type"]] if isinstance(schema.get("x-type"), str)
                                             else schema.get("x-type") or ([schema["title"]] if schema.get("title") else []))]
    typed = nodes.where(F.arrays_overlap("types", words_in(wanted)) if wanted else F.lit(False)).select("page_id", "ord")
    fills = candidates.where(F.col("priority") < 3).groupBy("page_id", "ord").agg(F.count(F.lit(1)).alias("fills"))
    most = fills.groupBy("page_id").agg(F.max("fills").alias("fills"))
    best = fills.join(most, ["page_id", "fills"]).groupBy("page_id").agg(F.min("ord").alias("ord"))
    guessed = best.join(typed.select("page_id").distinct(), "page_id", "left_anti")
    return typed.unionByName(guessed)


def fill_schema(schema: dict, nodes: DataFrame, meta: DataFrame, embedded: DataFrame) -> DataFrame:
    """Each property of a schema from the first synonym that gives a value of its type: page_id, property, value, source."""
    # Read twice: to choose the objects, and for their values.
    candidates = kept(schema_candidates(schema, nodes))
    chosen = preferred_objects(schema, nodes, candidates).withColumn("preferred", F.lit(0))
    from_nodes = candidates.join(chosen, ["page_id", "ord"], "left").select(
        "page_id", "property", "priority", F.coalesce("preferred", F.lit(1)).alias("tier"), "ord", "value",
        F.concat(F.lit("jsonld:"), F.coalesce(F.try_element_at(F.array_sort("types"), F.lit(1)), F.lit("object")), F.lit("."), "path")
        .alias("source"))
    wanted, keys = [], []
    for name, spec in schema["properties"].items():
        kind = spec.get("type", "string")
        for priority, path in enumerate(candidate_paths(name, spec)):
            if path.startswith("meta:"):
                wanted.append((name, priority, path[5:].lower(), kind))
            else:
                keys.append((name, "".join(ch for ch in path.rsplit(".", 1)[-1].lower() if ch.isalnum()), kind))
    spark = nodes.sparkSession
    # One row per synonym: bounded by the schema, so it is broadcast.
    metas = F.broadcast(spark.createDataFrame(wanted or [("", 0, "", "")], "property string, priority int, key string, kind string"))

    def typed(rows):
        return rows.withColumn("number", F.when(F.col("kind").isin("number", "integer"), _present_number(F.col("raw")))).withColumn(
            "value", _typed_text(F.col("raw"), F.col("number"), F.col("kind")))

    first_meta = meta.groupBy("page_id", "key").agg(F.min_by("value", "pos").alias("raw"))
    from_meta = typed(first_meta.join(metas, "key")).select(
        "page_id", "property", "priority", F.lit(0).alias("tier"), F.lit("").alias("ord"), "value",
        F.concat(F.lit("meta:"), "key").alias("source"))
    names = F.broadcast(spark.createDataFrame(sorted(set(keys)), "property string, name string, kind string"))
    scalars = deep_scalars(embedded)
    from_embedded = typed(scalars.join(names, "name")).select(
        "page_id", "property", F.lit(1_000).alias("priority"), F.lit(0).alias("tier"), "ord", "value",
        F.lit("embedded_json").alias("source"))
    rows = from_nodes.unionByName(from_meta).unionByName(from_embedded)
    # A null order is skipped, so a value that could not be typed never wins.
    order = F.when(F.col("value").isNotNull(), F.struct("priority", "tier", "ord"))
    best = rows.groupBy("page_id", "property").agg(F.min_by(F.struct("value", "source"), order).alias("b"))
    return best.where(F.col("b").isNotNull()).select("page_id", "property", "b.value", "b.source")


def schema_report(schema: dict, pages: DataFrame, filled: DataFrame) -> DataFrame:
    """Per page: how many properties were found, which required ones are missing, and whether the data is complete."""
    required = [name for name in schema.get("required", []) if name in schema["properties"]]
    found = filled.groupBy("page_id").agg(F.collect_set("property").alias("filled"),
                                          F.map_from_entries(F.collect_list(F.struct("property", "value"))).alias("data"))
    rows = pages.select("page_id").join(found, "page_id", "left")
    have = F.coalesce("filled", F.array().cast("array<string>"))
    missing = F.filter(words_in(required) if required else F.array().cast("array<string>"), lambda name: ~F.array_contains(have, name))
    return rows.select("page_id", F.size(have).alias("found"), F.lit(len(schema["properties"])).alias("of"),
                       missing.alias("missing"), (F.size(missing) == 0).alias("valid"), "data")


def schema_gate(verdicts: DataFrame, report: DataFrame) -> DataFrame:
    """A page that lacks a required field is incomplete, and each found field lifts its score."""
    rows = verdicts.join(report.select("page_id", "found", "missing"), "page_id", "left")
    lacks = F.coalesce(F.size("missing"), F.lit(0)) > 0
    return (rows.withColumn("score", F.col("score") + 1000 * F.coalesce("found", F.lit(0)))
            .withColumn("complete", F.col("complete") & ~lacks)
            .withColumn("reason", F.when(lacks, F.concat(F.lit("missing required fields: "), F.array_join("missing", ", ")))
                        .otherwise(F.col("reason"))).drop("found", "missing"))


def deep_scalars(values: DataFrame) -> DataFrame:
    """Every scalar under a key in embedded JSON: page_id, pos, ord, name (letters and digits of the key), raw."""
    rows = walk(values)
    key = F.substring_index("path", ".", -1)
    return (rows.select("page_id", "pos", "ord", F.regexp_replace(F.lower(key), "[^a-z0-9]", "").alias("name"),
                        as_text(F.col("v")).alias("raw"), key.alias("key"))
            .where(F.col("raw").isNotNull() & (F.col("raw") != "") & ~F.col("key").rlike(r"^\d*$")).drop("key"))


def deep_key(values: DataFrame, names: list[str]) -> DataFrame:
    """The first scalar under any of several key names: page_id, value."""
    rows = deep_scalars(values).where(F.col("name").isin(names))
    return rows.groupBy("page_id").agg(F.min_by("raw", F.struct("pos", "ord")).alias("value"))


# ---- publication dates ------------------------------------------------------------------------
def page_dates(pages: DataFrame, now: Column) -> DataFrame:
    """When a page says it was published: meta tags, then JSON-LD, then itemprop, then <time>; never a modified date."""
    meta = meta_tags(pages).where(F.col("key").isin(fixed.META_DATES)).select(
        "page_id", F.lit(0).alias("tier"), "pos", F.col("value").alias("raw"), F.concat(F.lit("meta:"), "key").alias("origin"))

    def scan(pattern, tier, origin):
        rows = pages.select("page_id", F.posexplode(find_all(F.col("html"), pattern, 1)).alias("pos", "raw"))
        return rows.select("page_id", F.lit(tier).alias("tier"), "pos", "raw", F.lit(origin).alias("origin"))

    scripts = pages.select("page_id", F.array_join(find_all(F.col("html"), _LD, 1), " ").alias("html"))
    jsonld = scripts.select("page_id", F.posexplode(find_all(F.col("html"), r'"datePublished"\s*:\s*"([^"]+)"', 1)).alias("pos", "raw"))
    jsonld = jsonld.select("page_id", F.lit(1).alias("tier"), "pos", "raw", F.lit("jsonld").alias("origin"))
    prop = scan(r"""(?is)<[a-z]+\b[^>]*\bitemprop=["']datePublished["'][^>]*?\b(?:content|datetime)=["']([^"']+)["']""", 2, "itemprop")
    time = scan(r"""(?is)<time\b[^>]*?\bdatetime=["']([^"']+)["']""", 3, "time")
    rows = meta.unionByName(jsonld).unionByName(prop).unionByName(time)
    rows = rows.withColumn("at", texts.lenient_timestamp("raw")).where(F.col("at") <= now + F.expr("interval 2 days"))
    best = rows.groupBy("page_id").agg(F.min_by(F.struct("at", "origin"), F.struct("tier", "pos")).alias("b"))
    return best.select("page_id", F.col("b.at").alias("published"), "b.origin")


# ---- images and feeds ---------------------------------------------------------------------------
def image_urls(pages: DataFrame) -> DataFrame:
    """A page's image addresses, absolute and once each: structured data first, then meta tags, then img tags."""
    bodies = F.concat(find_all(F.col("html"), _LD, 1), find_all(F.col("html"), _EMBEDDED, 1))
    value = r'"(?:image|images|featured_image)"\s*:\s*(\[[^\]]*\]|\{[^{}]*\}|"[^"]*")'
    told = pages.select("page_id", "url", F.posexplode(find_all(F.array_join(bodies, "\n"), value, 1)).alias("at", "raw"))
    inside = F.when(F.col("raw").startswith("{"), find_all(F.col("raw"), r'"(?:src|url)"\s*:\s*"([^"]+)"', 1)).when(
        F.col("raw").startswith("[") & F.col("raw").contains("{"), find_all(F.col("raw"), r'"(?:src|url)"\s*:\s*"([^"]+)"', 1)).otherwise(
        find_all(F.col("raw"), r'"([^"]*)"', 1))
    told = told.select("page_id", "url", F.lit(0).alias("tier"), "at", F.posexplode(inside).alias("sub", "image"))
    meta = meta_tags(pages).where(F.col("key").isin("og:image", "twitter:image")).join(pages.select("page_id", "url"), "page_id").select(
        "page_id", "url", F.lit(1).alias("tier"), F.col("pos").alias("at"), F.lit(0).alias("sub"), F.col("value").alias("image"))
    tags = pages.select("page_id", "url", F.posexplode(find_all(F.col("html"), r"(?is)<img\b[^>]*>", 0)).alias("at", "tag"))
    src, lazy = attribute(F.col("tag"), r"(?<![-\w])src"), attribute(F.col("tag"), "data-src")
    tags = tags.select("page_id", "url", F.lit(2).alias("tier"), "at", F.lit(0).alias("sub"), F.when(src != "", src).otherwise(lazy).alias("image"))
    rows = told.unionByName(meta).unionByName(tags).where(F.col("image") != "").withColumn("image", urls.resolve("url", "image"))
    rows = rows.where(F.col("image").rlike("^https?://"))
    return rows.groupBy("page_id", "image").agg(F.min(F.struct("tier", "at", "sub")).alias("first")).select(
        "page_id", "image", F.col("first.tier").alias("tier"), F.col("first.at").alias("pos"))


def feed_links(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """Feeds a page advertises, the first ``limit`` per page if given: page_id, pos, feed."""
    rows = pages.select("page_id", "url", F.posexplode(find_all(F.col("html"), r"(?is)<link\b[^>]*>", 0)).alias("pos", "tag"))
    kind = F.trim(F.split_part(F.lower(attribute(F.col("tag"), "type")), F.lit(";"), F.lit(1)))
    plain = kind.isin([name for name in fixed.FEED_TYPES if name != "application/json"])
    titled = (kind == "application/json") & F.lower(attribute(F.col("tag"), "title")).contains("feed")
    rows = rows.where(F.lower(attribute(F.col("tag"), "rel")).contains("alternate") & (plain | titled))
    rows = rows.select("page_id", "pos", urls.resolve("url", attribute(F.col("tag"), "href")).alias("feed")).where(
        F.col("feed").rlike("^https?://"))
    first = rows.groupBy("page_id", "feed").agg(F.min("pos").alias("pos"))
    if limit is None:
        return first
    order = Window.partitionBy("page_id").orderBy("pos")
    return first.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).drop("rn")


# ---- lists in JSON ----------------------------------------------------------------------------------
def json_lists(values: DataFrame) -> DataFrame:
    """Every list of three or more objects in a page's JSON, with its path: page_id, pos, path, rows, objects."""
    rows = walk(values).withColumn("rows", items_of(F.col("v")))
    objects = F.filter("rows", lambda row: fields_of(row).isNotNull())
    return rows.where(F.col("rows").isNotNull()).withColumn("objects", objects).where(F.size("objects") >= 3).select(
        "page_id", "pos", "path", "rows", "objects")


def longest_list(values: DataFrame) -> DataFrame:
    """How much a payload looks like a feed: its longest list of objects."""
    found = walk(values).withColumn("rows", items_of(F.col("v"))).where(F.col("rows").isNotNull())
    size = F.size(F.filter("rows", lambda row: fields_of(row).isNotNull()))
    return found.groupBy("page_id", "pos").agg(F.max(size).alias("rows"))


def _role_priority(role: str) -> Column:
    """Where a leaf path stands in the search for a role: own keys first, then nested containers in order; null if nowhere."""
    keys, nests = words_in(fixed.LIST_ROLES[role]), words_in(fixed.LIST_NESTS)
    parts = F.filter(F.split("leaf", r"\."), lambda part: ~part.rlike(r"^\d+$"))
    tail = F.element_at(parts, -1)
    link_tail = tail.isin("url", "src", "href") & (F.size(parts) >= 2) & F.array_contains(
        keys, F.try_element_at(parts, F.lit(-2))) if role in ("url", "image") else F.lit(False)
    named = F.when(link_tail, F.try_element_at(parts, F.lit(-2))).otherwise(tail)
    above = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.when(link_tail, 2).otherwise(1), F.lit(0)))
    known = F.array_contains(keys, named) & (F.size(above) <= 2) & F.forall(above, lambda nest: F.array_contains(nests, nest))
    rank = F.concat(F.array_join(F.transform(above, lambda nest: F.concat(F.lit("1"), F.lpad(F.array_position(nests, nest).cast("string"), 2, "0"))), ""),
                    F.lit("0"), F.lpad(F.array_position(keys, named).cast("string"), 2, "0"))
    return F.when(known, rank)


def _role_fits(role: str) -> Column:
    value, size = F.trim("value"), F.length(F.trim("value"))
    if role == "price":
        return (F.length("value") < 40) & F.col("value").rlike(r"\d")
    if role in ("url", "image"):
        return value.rlike(r"^(?:https?://|/)") & ~value.contains(" ")
    return size.between(2, 400) & ~F.col("numeric")


def score_lists(lists: DataFrame, pages: DataFrame, terms: Column | None = None) -> DataFrame:
    """How item-like each JSON list is: page_id, pos, path, fields found, rows, score; page furniture is left out.

    A list of which more than half of the rows link to other sites than the page's is none of its own. ``terms``: an array of lower-case words per page
    (a column of ``pages``): a list none of whose rows names one is left out, others gain with the share of rows that do; without names the
    whole row is looked at. A page without terms is scored as it is."""
    sample = lists.select("page_id", "pos", "path", F.size("rows").alias("n_rows"), F.size("objects").alias("n_objects"),
                          F.posexplode("objects").alias("at", "row")).where(F.col("n_objects") >= 0.8 * F.col("n_rows"))
    keys = sample.groupBy("page_id", "pos", "path", "n_objects").agg(
        F.count(F.lit(1)).alias("sampled"), F.avg(F.size(fields_of(F.col("row")))).alias("keys"))
    packed = sample.select("page_id", F.struct("pos", "path", "at").alias("pos"), F.col("row").alias("value"))
    leaves = walk(packed).select("page_id", "pos.pos", "pos.path", "pos.at", F.col("path").alias("leaf"), as_text(F.col("v")).alias("value"),
                                    F.try_variant_get("v", "$", "double").isNotNull().alias("numeric"))
    leaves = leaves.where(F.col("value").isNotNull() & (F.col("leaf") != ""))
    ranked = [F.struct(F.lit(role).alias("role"), F.when(_role_fits(role), _role_priority(role)).alias("rank")) for role in fixed.LIST_ROLES]
    rows = leaves.select("*", F.explode(F.array(*ranked)).alias("r")).where(F.col("r.rank").isNotNull())
    per_row = rows.groupBy("page_id", "pos", "path", "at", "r.role").agg(F.min_by(F.struct("leaf", "value"), "r.rank").alias("b"))
    per_path = per_row.groupBy("page_id", "pos", "path", "role", "b.leaf").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct(F.lower(F.trim("b.value"))).alias("distinct"))
    best = per_path.groupBy("page_id", "pos", "path", "role").agg(F.max_by(F.struct("leaf", "hits", "distinct"), F.struct("hits", "leaf")).alias("f"))
    weights = F.create_map(*[item for role, weight in fixed.LIST_WEIGHTS.items() for item in (F.lit(role), F.lit(weight))])
    found = best.join(keys, ["page_id", "pos", "path"]).where(F.col("f.hits") >= 0.6 * F.col("sampled"))
    lists_scored = found.groupBy("page_id", "pos", "path", "n_objects", "sampled", "keys").agg(
        F.sum(weights[F.col("role")]).alias("weight"), F.count(F.lit(1)).alias("n_fields"),
        F.max(F.when(F.col("role") == "name", F.col("f.distinct"))).alias("names"),
        F.max(F.when(F.col("role") == "url", F.lit(1))).alias("has_url"), F.max(F.when(F.col("role") == "name", F.lit(1))).alias("has_name"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "role", "f.leaf"))), ",").alias("fields"))
    tail = F.slice(F.reverse(F.filter(F.split("path", r"\."), lambda part: ~part.rlike(r"^\d+$"))), 1, 2)
    rich = F.when(F.col("keys") >= 6, 1.5).when(F.col("keys") >= 4, 1.0).otherwise(0.6)
    of_list = ["page_id", "pos", "path"]
    chosen = found.select(*of_list, "role", F.col("f.leaf").alias("chosen"))
    values = per_row.select(*of_list, "at", "role", F.col("b.leaf").alias("leaf"), F.col("b.value").alias("value")).join(chosen, [*of_list, "role"]).where("leaf = chosen")
    about = pages.select("page_id", urls.host("url").alias("host"), (F.lit(None).cast("array<string>") if terms is None else terms).alias("terms"))
    linked = values.where((F.col("role") == "url") & (urls.host("value") != "")).join(about.where("host <> ''"), "page_id")
    away = linked.groupBy(*of_list).agg(F.count_if(urls.registrable_tail(urls.host("value")) != urls.registrable_tail(F.col("host"))).alias("away"))
    lists_scored = lists_scored.join(away, of_list, "left").where(F.coalesce("away", F.lit(0)) <= 0.5 * F.col("sampled"))
    if terms is not None:
        named = values.where(F.col("role") == "name").select(*of_list, F.lower("value").alias("text"))
        rest = sample.join(chosen.where(F.col("role") == "name"), of_list, "left_anti").select(*of_list, F.lower(F.to_json("row")).alias("text"))
        asked = about.where(F.size("terms") > 0).select("page_id", "terms")
        named_hits = named.unionByName(rest).join(asked, "page_id").groupBy(*of_list).agg(F.count_if(F.exists("terms", lambda term: F.contains(F.col("text"), term))).alias("hits"))
        lists_scored = lists_scored.join(named_hits, of_list, "left").where(F.col("hits").isNull() | (F.col("hits") > 0)).withColumn(
            "weight", F.col("weight") * (1 + 2 * F.coalesce("hits", F.lit(0)) / F.col("sampled")))
    good = lists_scored.where((F.col("has_url").isNotNull() | F.col("has_name").isNotNull())
                              & ((F.col("n_fields") >= 2) | F.col("path").endswith("itemListElement"))
                              & (F.col("names").isNull() | (F.col("names") >= 0.7 * F.col("sampled")))
                              & ~F.exists(tail, lambda part: part.rlike(fixed.CHROME_KEY)))
    return good.select("page_id", "pos", "path", "fields", "n_objects", (F.col("weight") * rich * F.col("n_objects")).alias("score"))


def best_list(scored: DataFrame) -> DataFrame:
    return scored.groupBy("page_id").agg(F.max_by(F.struct("path", "fields", "n_objects", "score"), F.struct("score", "path")).alias("b")).select(
        "page_id", "b.*")


# ---- spec-driven extraction ----------------------------------------------------------------------------
def _spec_value(value: Column, kind: str, base: Column) -> Column:
    text = as_text(value)
    if kind == "url":
        link = urls.resolve(base, text)
        return F.when((F.trim(text) != "") & link.rlike("^https?://"), link)
    if kind in ("number", "price"):
        return F.replace(find(text, r"-?\d[\d,]*(?:\.\d+)?"), F.lit(","), F.lit("")).try_cast("double")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _spec_path(value: Column, path: str) -> Column:
    for part in [piece for piece in path.split(".") if piece]:
        value = F.try_variant_get(value, f"$[{part}]", "variant") if part.isdigit() else get(value, part)
    return value


def extract_items(spec: dict, pages: DataFrame) -> DataFrame:
    """Items of each page by a declarative spec: source, type or path, typed field map, limit; with ``total`` rows found."""
    if spec["source"] == "jsonld":
        nodes = jsonld_nodes(pages).where(F.array_contains("types", spec["type"].lower()) if spec.get("type") else F.lit(True))
        rows = nodes.withColumn("found", _spec_path(F.col("node"), spec["path"])).where(F.col("found").isNotNull())
        rows = rows.groupBy("page_id").agg(F.min_by("found", "ord").alias("found"))
    else:
        rows = embedded_json(pages).withColumn("found", _spec_path(F.col("value"), spec["path"])).where(F.col("found").isNotNull())
        rows = rows.groupBy("page_id").agg(F.min_by("found", "pos").alias("found"))
    listed = F.coalesce(items_of(F.col("found")), F.when(fields_of(F.col("found")).isNotNull(), F.array("found")))
    rows = rows.withColumn("rows", listed).where(F.col("rows").isNotNull()).join(pages.select("page_id", F.col("url").alias("base")), "page_id")
    items = rows.select("page_id", "base", F.size("rows").alias("total"), F.posexplode(F.slice("rows", 1, spec["limit"]) if "limit" in spec else "rows").alias("pos", "row"))
    fields = [_spec_value(_spec_path(F.col("row"), rule["path"]), rule["type"], F.col("base")).alias(name)
              for name, rule in spec["fields"].items()]
    out = items.select("page_id", "pos", "total", *fields)
    return out.where(F.coalesce(*[F.col(name).cast("string") for name in spec["fields"]]).isNotNull())


def next_page(url, param: str, start: int, step: int, max_pages: int) -> Column:
    """The address of the page after this one: a numeric parameter plus a step, up to a number of pages."""
    parts = urls.query_parts(url)
    own = F.try_element_at(F.filter(parts, lambda part: F.split_part(part, F.lit("="), F.lit(1)) == param), F.lit(1))
    page = F.when(own.isNull(), F.lit(start)).otherwise(F.regexp_extract(own, "^[^=]*=(.*)$", 1).try_cast("int"))
    kept = F.filter(parts, lambda part: F.split_part(part, F.lit("="), F.lit(1)) != param)
    query = F.array_join(F.concat(kept, F.array(F.concat(F.lit(param + "="), (page + step).cast("string")))), "&")
    front = F.regexp_extract(c(url), r"^([^?#]*)", 1)
    return F.when(F.floor((page - start) / step) + 1 < max_pages, F.concat(front, F.lit("?"), query))


def invalid_page(title: Column, text: Column, final_url: Column, markers: dict[str, list[str]]) -> Column:
    """A page that a site's own markers call an error or empty page."""
    def any_in(value, found):
        low = F.lower(F.coalesce(value, F.lit("")))
        hit = F.lit(False)
        for marker in found:
            hit = hit | low.contains(marker)
        return hit

    return (any_in(final_url, markers.get("final_url_contains", [])) | any_in(title, markers.get("title", []))
            | any_in(text, markers.get("text", [])))


def assertion(value: Column, operator: str, expected: object = None) -> Column:
    """One data assertion on a JSON value: nonempty, equals (same type) or a minimum length."""
    text, listed, keyed = as_text(value), items_of(value), fields_of(value)
    if operator == "nonempty":
        return F.coalesce(((text.isNotNull() & (text != "")) | (F.size(listed) > 0) | (F.size(F.map_keys(keyed)) > 0)), F.lit(False))
    if operator == "equals":
        kind = {str: "STRING", bool: "BOOLEAN", int: "BIGINT", float: "DOUBLE"}[type(expected)]
        same_type = F.schema_of_variant(value).startswith("DECIMAL") if kind == "DOUBLE" else F.schema_of_variant(value) == kind
        want = str(expected).lower() if isinstance(expected, bool) else str(expected)
        return F.coalesce(same_type & (text == want), F.lit(False))
    size = F.coalesce(F.size(listed), F.size(F.map_keys(keyed)), F.when(F.schema_of_variant(value) == "STRING", F.length(text)))
    return F.coalesce(size >= expected, F.lit(False))


def check_assertions(rows: DataFrame, value: str, checks: list[tuple[str, str, object]]) -> DataFrame:
    """Adds one boolean per (path, operator, expected) and whether all of them pass."""
    names = []
    for at, (path, operator, expected) in enumerate(checks):
        names.append(f"check_{at}")
        rows = rows.withColumn(names[-1], assertion(_spec_path(F.col(value), path), operator, expected))
    passed = F.lit(True)
    for name in names:
        passed = passed & F.col(name)
    return rows.withColumn("passed", passed)


_CHUNK = r'self\.__next_f\.push\(\[1,("(?:[^"\\]|\\.)*")\]\)'


def streamed_payload(html: Column, marker: str | None = None) -> Column:
    """The JSON value streamed as script chunks: the first object or list after ``marker``."""
    joined = F.array_join(each(find_all(html, _CHUNK, 1), lambda chunk: F.try_variant_get(F.try_parse_json(chunk), "$", "string")), "")
    return json_after(joined, marker)


def json_after(text: Column, marker: str | None = None) -> Column:
    """The first JSON object or list after ``marker``: read token by token until its brackets close."""
    if marker is not None:
        at = F.position(F.lit(marker), text)
        text = F.when(at > 0, F.substring(text, at + len(marker), F.length(text)))
    body = F.regexp_extract(text, r"(?s)([{\[].*)$", 1)
    tokens = find_all(body, r'"(?:[^"\\]|\\.)*"|[{}\[\]]|[^"{}\[\]]+|"', 0)

    def step(state, token):
        change = F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)
        done = state["done"] | (state["depth"] + change == 0)
        return F.struct((state["depth"] + F.when(state["done"], 0).otherwise(change)).alias("depth"),
                        (state["taken"] + F.when(state["done"], 0).otherwise(1)).alias("taken"), done.alias("done"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("taken"), F.lit(False).alias("done"))
    taken = F.aggregate(tokens, start, step, lambda state: state["taken"])
    return F.when(body != "", F.try_parse_json(F.array_join(F.slice(tokens, F.lit(1), taken), "")))
