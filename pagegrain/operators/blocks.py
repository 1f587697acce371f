"""Element tables: one tokenizer pass turns each page's HTML into rows, everything after that is joins and aggregates.

The tokenizer is the one place where a built-in expression cannot do the work (nesting). It runs inside ``mapInPandas``,
a page at a time, and only lists elements; scoring, choosing and assembling happen in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.functions import fixed, urls
from pagegrain.functions.columns import each
from pagegrain.session import kept

_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_TEXT_TAGS = set("a p li h1 h2 h3 h4 h5 h6 td th blockquote pre figcaption title time".split())
_HOLDS = set("p li h1 h2 h3 h4".split())
_HIDDEN = set("script style noscript template".split())
_WORDS = re.compile(fixed.BOILERPLATE_WORDS)

SCHEMA = ("page_id bigint, pos int, tag string, ancestors array<int>, attrs map<string,string>, text string, "
          "loose_text string, linked int, holds boolean, chrome boolean, loose_chrome boolean")


# Rows of one batch on the way back to Spark.
ELEMENTS_AT_ONCE = 4000


class _Tree(HTMLParser):
    """Elements of one page in document order, with their text pieces."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        self._imply_ends(tag)
        parent = self.stack[-1] if self.stack else -1
        self.nodes.append({"tag": tag, "attrs": {key: value or "" for key, value in attrs}, "parent": parent, "inner": []})
        if parent >= 0:
            self.nodes[parent]["inner"].append(len(self.nodes) - 1)
        if tag not in _VOID:
            self.stack.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.stack.pop()

    def _imply_ends(self, tag):
        """An opening tag ends what cannot hold it: paragraphs before a line of its own, items, cells and rows before their like."""
        ends, inside = fixed.IMPLIED_ENDS.get(tag, (("p",), fixed.HOLDS_PARAGRAPHS) if tag in fixed.ENDS_PARAGRAPH else ((), ()))
        lowest = None
        for depth in range(len(self.stack) - 1, -1, -1) if ends else ():
            name = self.nodes[self.stack[depth]]["tag"]
            if name in ends:
                lowest = depth
            elif name in inside:
                break
        if lowest is not None:
            del self.stack[lowest:]

    def handle_endtag(self, tag):
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[depth]]["tag"] == tag:
                del self.stack[depth:]
                return

    def handle_data(self, data):
        if self.stack:
            self.nodes[self.stack[-1]]["inner"].append(data)


def _chrome(node, strict: bool) -> bool:
    attrs = node["attrs"]
    if node["tag"] in ("article", "main") or attrs.get("role") == "main":
        return False
    if node["tag"] in fixed.BOILERPLATE_TAGS or attrs.get("role", "").lower() in fixed.BOILERPLATE_ROLES:
        return True
    if attrs.get("aria-hidden") == "true" or "hidden" in attrs:
        return True
    words = (attrs.get("id", "") + " " + attrs.get("class", "")).strip()
    return strict and bool(words) and bool(_WORDS.search(words))


def _pieces(nodes, at, skip) -> list[str]:
    """The text pieces under one element, without those under elements that ``skip`` marks; no recursion, pages nest deep."""
    out, waiting = [], list(reversed(nodes[at]["inner"]))
    while waiting:
        item = waiting.pop()
        if isinstance(item, str):
            out.append(item)
        elif nodes[item]["tag"] not in _HIDDEN and not nodes[item].get(skip):
            waiting.extend(reversed(nodes[item]["inner"]))
    return out


def _joined(pieces) -> str:
    return " ".join(" ".join(pieces).split())


def tokens(html: str) -> list[dict]:
    """Elements in document order: tag, attrs, parent, and inner: the texts and elements they hold, in order."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.nodes


def parse(html: str) -> list[dict]:
    nodes = tokens(html)
    for node in nodes:
        above = nodes[node["parent"]] if node["parent"] >= 0 else {}
        node["chrome"] = bool(above.get("chrome")) or _chrome(node, True)
        node["loose"] = bool(above.get("loose")) or _chrome(node, False)
        node["ancestors"] = ([node["parent"]] + above["ancestors"]) if node["parent"] >= 0 else []
    for at, node in enumerate(nodes):
        node["text"] = node["loose_text"] = None
        node["linked"], node["holds"] = 0, False
        if node["tag"] in _TEXT_TAGS or "itemprop" in node["attrs"]:
            node["text"] = _joined(_pieces(nodes, at, "chrome"))
            node["loose_text"] = _joined(_pieces(nodes, at, "loose"))
    for node in nodes:
        for above in node["ancestors"]:
            if node["tag"] in _HOLDS:
                nodes[above]["holds"] = True
            if node["tag"] == "a":
                nodes[above]["linked"] += len(node["text"] or "")
    return nodes


def elements(pages: DataFrame) -> DataFrame:
    """One row per element of ``pages(page_id, html)``, in document order; written once, however often a job reads them."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("tag", "ancestors", "attrs", "text", "loose_text", "linked", "holds", "chrome", "loose")
        columns = ["page_id", "pos", *names[:-1], "loose_chrome"]
        for batch in batches:
            # A few thousand elements at a time, so that memory holds no more than those and one page.
            rows: list[tuple] = []
            for page_id, html in zip(batch["page_id"], batch["html"]):
                rows += [(page_id, pos, *[node[name] for name in names]) for pos, node in enumerate(parse(html))]
                if len(rows) > ELEMENTS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return kept(pages.select("page_id", "html").mapInPandas(read, SCHEMA))


# ---- microdata -------------------------------------------------------------------
def microdata(found: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """First value of each itemprop under a top-level itemscope: page_id, scope, type, prop, value."""
    scoped = found.where(F.map_contains_key("attrs", "itemscope"))
    scopes = scoped.select("page_id", F.col("pos").alias("scope"), "ancestors", F.regexp_extract(
        F.coalesce(F.try_element_at("attrs", F.lit("itemtype")), F.lit("")), "([^/]*)$", 1).alias("type"))
    above = scopes.select("page_id", "scope", F.explode("ancestors").alias("above"))
    nested = above.join(scopes.select("page_id", F.col("scope").alias("above")), ["page_id", "above"]).select(
        "page_id", "scope").distinct()
    top = scopes.drop("ancestors").join(nested, ["page_id", "scope"], "left_anti")
    value = F.coalesce(*[F.when(F.try_element_at("attrs", F.lit(name)) != "", F.try_element_at("attrs", F.lit(name)))
                         for name in ("content", "datetime", "href", "src")], F.when(F.col("text") != "", F.col("text")))
    props = (found.where(F.map_contains_key("attrs", "itemprop"))
             .select("page_id", "pos", F.element_at("attrs", "itemprop").alias("prop"), value.alias("value"),
                     F.explode("ancestors").alias("scope")).where(F.col("value").isNotNull() & (F.col("prop") != "")))
    return (props.join(top, ["page_id", "scope"]).groupBy("page_id", "scope", "type", "prop")
            .agg(F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos")))


# ---- main content ------------------------------------------------------------------
_BLOCKS = ["h1", "h2", "h3", "h4", "p", "li", "blockquote", "pre", "td", "figcaption"]


def _main_lines(found: DataFrame, text: str, chrome: str) -> DataFrame:
    kept = found.where(~F.col(chrome))
    attr = F.coalesce(F.try_element_at("attrs", F.lit("role")), F.lit(""))
    prop = F.coalesce(F.try_element_at("attrs", F.lit("itemprop")), F.lit(""))
    containers = kept.select("page_id", F.col("pos").alias("box"), F.size("ancestors").alias("depth"), F.col("tag").alias("box_tag"),
                             (F.col("tag").isin("article", "main") | (attr == "main") | (prop == "articleBody")).alias("named")
                             ).where(F.col("named") | F.col("box_tag").isin("div", "section", "td", "body"))
    paras = kept.where(F.col("tag") == "p").select("page_id", F.length(text).alias("chars"), "linked",
                                                   F.explode("ancestors").alias("box"))
    # Per container: all paragraph text, and the density of its longer paragraphs.
    scores = containers.join(paras, ["page_id", "box"], "left").groupBy("page_id", "box", "depth", "named", "box_tag").agg(
        F.coalesce(F.sum("chars"), F.lit(0)).alias("all_chars"),
        F.coalesce(F.sum(F.when(F.col("chars") >= 40, F.col("chars") - 2 * F.col("linked"))), F.lit(0)).alias("dense"),
        F.count_if(F.col("chars") >= 40).alias("long"))
    dense = F.when(F.col("long") > 0, F.col("dense") + F.col("depth")).otherwise(0)
    # A named body wins when it has 400 characters; else the densest block; else the whole body.
    rank = F.when(F.col("named") & (F.col("all_chars") >= 400), F.struct(F.lit(2).alias("tier"), F.col("all_chars").alias("score"),
                                                                        (-F.col("box")).alias("first")))
    rank = rank.when(F.col("box_tag").isin("div", "section", "td"), F.struct(F.lit(1).alias("tier"), dense.cast("bigint").alias("score"),
                                                                             (-F.col("box")).alias("first")))
    rank = rank.when(F.col("box_tag") == "body", F.struct(F.lit(0).alias("tier"), F.lit(0).cast("bigint").alias("score"),
                                                          (-F.col("box")).alias("first")))
    best = scores.where(rank.isNotNull()).groupBy("page_id").agg(F.max_by("box", rank).alias("box"))
    line = F.col(text)
    rows = (kept.where(F.col("tag").isin(_BLOCKS) & ~F.col("holds") & (F.length(line) >= 2)
                       & ~((F.col("tag") == "li") & (F.length(line) < 25) & (F.col("linked") > 0)))
            .select("page_id", "pos", "tag", line.alias("line"), F.explode("ancestors").alias("box")))
    return rows.join(best, ["page_id", "box"]).select("page_id", "pos", "line")


def main_content(found: DataFrame) -> DataFrame:
    """A page's article: page_id, text, method (how strictly chrome was dropped), chars."""
    head = found.where((F.col("tag") == "h1") & F.col("text").isNotNull()).groupBy("page_id").agg(
        F.min_by("text", "pos").alias("heading"))

    def assembled(text, chrome):
        rows = _main_lines(found, text, chrome).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("rows"))
        listed = each(F.col("rows"), lambda row: row["line"])
        once = F.filter(listed, lambda line, at: (at == 0) | (line != F.try_element_at(listed, F.when(at > 0, at).otherwise(1))))
        return rows.select("page_id", once.alias("lines"))

    strict = assembled("text", "chrome").withColumnRenamed("lines", "strict")
    loose = assembled("loose_text", "loose_chrome").withColumnRenamed("lines", "loose")
    both = strict.join(loose, "page_id", "full").join(head, "page_id", "left")

    def text_of(name):
        lines = F.coalesce(F.col(name), F.array().cast("array<string>"))
        first = F.try_element_at(lines, F.lit(1))
        titled = F.when((F.coalesce(F.col("heading"), F.lit("")) != "") & (first.isNull() | (first != F.col("heading"))),
                        F.concat(F.array("heading"), lines)).otherwise(lines)
        return F.array_join(titled, "\n\n")

    both = both.withColumn("_strict", text_of("strict")).withColumn("_loose", text_of("loose"))
    wider = (F.length("_strict") < 300) & (F.length("_loose") > F.length("_strict"))
    text = F.when(wider, F.col("_loose")).otherwise(F.col("_strict"))
    return both.select("page_id", F.when(text != "", text).alias("text"), F.when(wider, "loose").otherwise("strict").alias("method"),
                       F.length(text).alias("chars"))


# ---- cards ---------------------------------------------------------------------------
def _image(attrs: Column) -> Column:
    """The best image address of an element: lazy attributes, the last srcset entry, then src."""

    def attr(name):
        return F.coalesce(F.try_element_at(attrs, F.lit(name)), F.lit(""))

    def last_of(name):
        return F.regexp_extract(attr(name), r"([^\s,]+)(?:\s+[\d.]+[wx])?\s*$", 1)

    chrome = r"(?i)(^|[/_.-])(logo|logos|icon|icons|sprite|favicon|placeholder|spacer)([/_.-]|$)"
    options = [last_of("data-srcset"), last_of("srcset"), *[attr(name) for name in (
        "data-src", "data-lazy-src", "data-original", "data-lazy", "src")]]
    return F.coalesce(*[F.when((option != "") & ~option.startswith("data:") & ~option.rlike(chrome), option) for option in options])


def cards(pages: DataFrame, found: DataFrame, listed: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Result cards: each item link with its title and its own nearest image; listed entries (page_id, url, title, image) first.

    An image belongs to a link when it sits inside the link, or inside the nearest container that holds no other item link.
    """
    base = pages.select("page_id", F.col("url").alias("base"))

    def attr(name):
        return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))

    anchors = (found.where((F.col("tag") == "a") & (attr("href") != "")).join(base, "page_id")
               .select("page_id", "base", "pos", "ancestors", "attrs", "text", urls.resolve("base", attr("href")).alias("link")))
    anchors = anchors.where((urls.bare_host("link") == urls.bare_host("base")) & F.col("link").rlike("^https?://")
                            & (urls.path("link") != urls.path("base")) & urls.item_like(urls.path("link")))
    anchors = anchors.withColumn("item", urls.rtrim_slash(urls.path("link")))
    title = F.coalesce(*[F.when(option != "", option) for option in (attr("aria-label"), attr("title"), F.col("text"))], F.lit(""))
    near = F.concat(F.array("pos"), F.col("ancestors"))
    climbs = anchors.select("page_id", "base", "pos", "item", "link", title.alias("title"), F.posexplode(near).alias("level", "box"))
    crowd = climbs.groupBy("page_id", "box").agg(F.min("item").alias("one"), F.max("item").alias("other"))
    crowd = crowd.where(F.col("one") == F.col("other")).select("page_id", "box")
    bodies = found.where(F.col("tag").isin("body", "html")).select("page_id", F.col("pos").alias("box"))
    alone = climbs.join(crowd, ["page_id", "box"], "left_semi").join(bodies, ["page_id", "box"], "left_anti")
    images = found.where(F.col("tag").isin("img", "source")).select(
        "page_id", F.col("pos").alias("image_pos"), _image(F.col("attrs")).alias("image"), attr("alt").alias("alt"),
        F.explode(F.concat(F.array("pos"), F.col("ancestors"))).alias("box")).where(F.col("image").isNotNull())
    own = (alone.join(images, ["page_id", "box"]).groupBy("page_id", "item")
           .agg(F.min_by(F.struct("image", "alt"), F.struct("level", "image_pos")).alias("picture")))
    named = anchors.groupBy("page_id", "base", "item").agg(
        F.min("pos").alias("pos"), F.min_by("link", "pos").alias("link"),
        F.min_by(F.when(title != "", title), F.when(title != "", F.col("pos"))).alias("title"))
    linked = named.join(own, ["page_id", "item"], "left").select(
        "page_id", F.col("link").alias("url"), F.coalesce("title", F.when(F.col("picture.alt") != "", F.col("picture.alt")),
                                                          F.lit("")).alias("title"),
        urls.resolve("base", F.col("picture.image")).alias("image"), "pos")
    if listed is None:
        listed = linked.select("page_id", "url", "title", "image").where(F.lit(False))
    told = listed.select("page_id", urls.rtrim_slash(F.col("url")).alias("key"), F.col("url").alias("l_url"),
                         F.col("title").alias("l_title"), F.col("image").alias("l_image"))
    both = linked.withColumn("key", urls.rtrim_slash(F.col("url"))).join(told, ["page_id", "key"], "full")
    tier = F.when(F.col("l_url").isNotNull(), 0).when(F.col("image").isNotNull(), 1).otherwise(2)
    rows = both.select("page_id", F.coalesce("l_url", "url").alias("url"),
                       F.coalesce(F.when(F.col("l_title") != "", F.col("l_title")), "title").alias("title"),
                       F.coalesce("l_image", "image").alias("image"), tier.alias("tier"), "pos")
    order = Window.partitionBy("page_id").orderBy("tier", F.col("pos").asc_nulls_last(), "url")
    ranked = rows.withColumn("rank", F.row_number().over(order)).drop("pos", "tier")
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


# ---- markdown ---------------------------------------------------------------------------
# Elements whose content is no text of the page; elements that stand on lines of their own; and inline marks.
_DROP = set("script style noscript template svg canvas iframe object embed head form button input select textarea dialog map".split())
_OWN_LINE = set("p div section article main header footer nav aside figure figcaption address details summary dl dd dt center body "
                "html ul ol li table thead tbody tfoot tr td th pre blockquote hr h1 h2 h3 h4 h5 h6".split())
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~", "strike": "~~"}
FRAGMENTS = ("page_id bigint, pos int, block int, kind string, quotes int, indent int, marker string, grid int, line int, cell int, text string")
# Private characters around what an inline element holds, until its block is whole: opening and closing ends of marks and links.
_OPEN, _CLOSE, _LINK, _TO, _END = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"


class _Place:
    """Where the reader of a page stands: what a new line would be."""

    def __init__(self):
        self.kind, self.quotes, self.pre, self.lists, self.marker, self.own = "text", 0, 0, [], "", ""
        # Open tables: number, row, next cell, and the cell around the table. ``tables`` counts all so far.
        self.grids, self.cell, self.tables = [], None, 0


def _fragments(nodes: list[dict], base) -> Iterator[tuple]:
    """The text pieces of a page in order, each with the line it belongs to. Lines open where an element of its own line begins or ends."""
    place, block, fresh = _Place(), 0, True
    for entering, at in _tour(nodes):
        item = nodes[at] if isinstance(at, int) else None
        if item is None:
            text = at if place.pre else re.sub(r"\s+", " ", at)
            if fresh and not text.strip():
                continue
        else:
            tag, attrs = item["tag"], item["attrs"]
            if tag in _OWN_LINE:
                fresh = fresh or place.cell is None
                _step(place, tag, entering)
                if tag in ("td", "th"):
                    fresh = True
                elif place.cell is not None:
                    yield (block, *_line(place), " ")
                    continue
                if tag == "hr" and entering:
                    block, fresh = block + 1, True
                    place.own = ""
                    yield (block, "rule", *_line(place)[1:], "---")
                if not (tag in ("td", "th") and entering):
                    continue
                text = ""
            elif tag == "br":
                text = "  \n" if entering else ""
            elif tag == "img":
                source = attrs.get("src") or attrs.get("data-src") or ""
                alt = " ".join(attrs.get("alt", "").split())
                text = "" if not entering else alt if not source or source.startswith("data:") else f"![{alt}]({base(source)})"
            elif tag == "a":
                href = attrs.get("href", "").strip()
                live = bool(href) and not href.startswith("#")
                text = "" if not live else _LINK if entering else f"{_TO}{base(href)}{_END}"
            else:
                text = (_OPEN if entering else _CLOSE) + _MARKS[tag] + _END if tag in _MARKS and not place.pre else ""
            if not text and not (tag in ("td", "th")):
                continue
        if fresh:
            block, fresh = block + 1, False
            # The first line of a list item takes its marker; later ones stand under its text.
            place.own, place.marker = place.marker, ""
        yield (block, *_line(place), text)


def _line(place: _Place) -> tuple:
    grid, row = (place.grids[-1][0], place.grids[-1][1]) if place.cell is not None else (None, None)
    return ("cell" if place.cell is not None else "pre" if place.pre else place.kind, place.quotes, len(place.lists), place.own, grid, row, place.cell)


def _step(place: _Place, tag: str, entering: bool) -> None:
    """Moves the place over the border of an element of its own line."""
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        place.kind = tag if entering else "text"
    elif tag == "blockquote":
        place.quotes += 1 if entering else -1
    elif tag == "pre":
        place.pre += 1 if entering else -1
    elif tag in ("ul", "ol"):
        place.lists.append([tag, 0]) if entering else place.lists.pop()
    elif tag == "li" and entering and place.lists:
        place.lists[-1][1] += 1
        place.marker = f"{place.lists[-1][1]}. " if place.lists[-1][0] == "ol" else "- "
    elif tag == "table":
        if entering:
            place.tables += 1
            place.grids.append([place.tables, 0, 0, place.cell])
            place.cell = None
        else:
            place.cell = place.grids.pop()[3]
    elif place.grids and tag == "tr" and entering:
        place.grids[-1][1:3] = [place.grids[-1][1] + 1, 0]
    elif place.grids and tag in ("td", "th"):
        place.cell = place.grids[-1][2] if entering else None
        place.grids[-1][2] += entering


def _tour(nodes: list[dict]) -> Iterator[tuple]:
    """Every text and element of a page in order, elements once on entering and once on leaving; hidden and dropped ones left out."""
    waiting = [iter([at for at, node in enumerate(nodes) if node["parent"] < 0])]
    open_ = []
    while waiting:
        item = next(waiting[-1], None)
        if item is None:
            waiting.pop()
            if open_:
                yield False, open_.pop()
        elif isinstance(item, str):
            yield True, item
        elif _shown(nodes[item]):
            yield True, item
            open_.append(item)
            waiting.append(iter(nodes[item]["inner"]))


def _shown(node: dict) -> bool:
    attrs = node["attrs"]
    dead = node["tag"] == "a" and attrs.get("href", "").strip().startswith("javascript:")
    return node["tag"] not in _DROP and not dead and "hidden" not in attrs and attrs.get("aria-hidden") != "true"


def to_markdown(pages: DataFrame) -> DataFrame:
    """Each page as markdown: headings, paragraphs, lists, links, images, emphasis, code, tables and quotes.

    The tokenizer lists text pieces with their line; lines, tables and the page are put together by aggregates."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import urljoin
        names = [part.split()[0] for part in FRAGMENTS.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"]):
                rows += [(page_id, pos, *piece) for pos, piece in enumerate(_fragments(tokens(html), lambda link, url=url: urljoin(url or "", link)))]
                if len(rows) > ELEMENTS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=names).astype({name: "Int64" for name in ("grid", "line", "cell")})
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({name: "Int64" for name in ("grid", "line", "cell")})

    found = pages.select("page_id", "url", "html").mapInPandas(read, FRAGMENTS)
    raw = found.groupBy("page_id", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda piece: piece["text"]), "").alias("text"),
        *[F.min_by(name, "pos").alias(name) for name in ("kind", "quotes", "indent", "marker", "grid", "line", "cell")])
    # Written once, read twice: as cells and as other lines. Pages are not tokenized a second time.
    lines = kept(raw.withColumn("text", F.when(F.col("kind") == "pre", _bare(F.col("text"))).otherwise(_finished(F.col("text")))))
    # Cells to rows, rows to tables: a table is as wide as its widest row.
    cells = lines.where("kind = 'cell'").withColumn("text", F.replace(F.regexp_replace("text", r"\s+", " "), F.lit("|"), F.lit("\\|")))
    grid = cells.groupBy("page_id", "grid", "line").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell", "block", "text"))), lambda piece: piece["text"]).alias("texts"), F.min("block").alias("block"),
        F.min_by("quotes", "block").alias("quotes")).groupBy("page_id", "grid").agg(
        F.array_sort(F.collect_list(F.struct("line", "texts"))).alias("rows"), F.min("block").alias("block"), F.min_by("quotes", "block").alias("quotes"), F.max(F.size("texts")).alias("wide"))
    told = F.transform("rows", lambda row: F.concat(F.lit("| "), F.array_join(F.concat(row["texts"], F.array_repeat(F.lit(""), F.col("wide") - F.size(row["texts"]))), " | "), F.lit(" |")))
    rule = F.concat(F.array_join(F.array_repeat(F.lit("| ---"), F.col("wide")), " "), F.lit(" |"))
    tables = grid.select("page_id", "block", "quotes", F.lit("table").alias("kind"), F.lit(0).alias("indent"), F.lit("").alias("marker"), F.array_join(
        F.concat(F.slice(told, 1, 1), F.array(rule), F.slice(told, 2, F.greatest(F.size(told), F.lit(1)))), "\n").alias("text"))
    whole = lines.where("kind <> 'cell' AND text <> ''").select("page_id", "block", "quotes", "kind", "indent", "marker", "text").unionByName(tables)
    depth = F.repeat(F.lit("  "), F.greatest(F.col("indent") - F.when(F.col("marker") != "", 1).otherwise(0), F.lit(0)))
    front = F.when(F.col("kind").rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring("kind", 2, 1).cast("int")), F.lit(" "))).otherwise(F.concat(depth, "marker"))
    body = F.when(F.col("kind") == "pre", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).when(F.col("kind").rlike("^h[1-6]$"), F.regexp_replace("text", r"\s+", " ")).otherwise(F.col("text"))
    quoted = F.replace(F.concat(front, body), F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit("> "), F.col("quotes"))))
    shown = whole.select("page_id", F.struct("block", F.concat(F.repeat(F.lit("> "), F.col("quotes")), quoted).alias("text"), (F.col("marker") != "").alias("item")).alias("line"))
    listed = shown.groupBy("page_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))

    def spaced(line, at):
        before = F.get(F.col("lines"), F.greatest(at - 1, F.lit(0)))
        return F.concat(F.when(at == 0, "").when(line["item"] & before["item"], "\n").otherwise("\n\n"), line["text"])

    text = F.regexp_replace(F.array_join(F.transform("lines", spaced), ""), r"[ \t]+\n", "\n")
    made = listed.select("page_id", F.concat(F.trim(text), F.lit("\n")).alias("markdown"))
    return pages.select("page_id").distinct().join(made, "page_id", "left").withColumn("markdown", F.coalesce("markdown", F.lit("")))


def _bare(text: Column) -> Column:
    """Preformatted text: no marks, no line breaks around it."""
    plain = F.regexp_replace(F.regexp_replace(text, f"{_TO}[^{_END}]*{_END}|[{_OPEN}{_CLOSE}][^{_END}]*{_END}", ""), _LINK, "")
    return F.regexp_replace(plain, r"^\n+|\n+$", "")


def _finished(text: Column) -> Column:
    """A line with its marks: spaces go outside of marks, marks and links around nothing go."""
    mark = f"[^{_END}]*{_END}"
    # Marks nest, so emptied ones empty what holds them: as often as the longest run of openings is deep.
    opens = f"(?:{_OPEN}{mark}|{_LINK})"
    depth = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"{opens}(?: *{opens})*"), F.lit(0)), lambda run: F.regexp_count(run, F.lit(opens))))
    text = F.aggregate(F.sequence(F.lit(1), F.greatest(F.coalesce(depth, F.lit(1)), F.lit(1))), text, lambda left, _: F.regexp_replace(
        left, f"{_OPEN}{mark} *{_CLOSE}{mark}|{_LINK} *{_TO}{mark}", ""))
    text = F.regexp_replace(text, f"({_OPEN}{mark}|{_LINK}) +", " $1")
    text = F.regexp_replace(text, f" +({_CLOSE}{mark}|{_TO}{mark})", "$1 ")
    text = F.regexp_replace(text, f"[{_OPEN}{_CLOSE}]([^{_END}]*){_END}", "$1")
    text = F.regexp_replace(F.replace(text, F.lit(_LINK), F.lit("[")), f"{_TO}([^{_END}]*){_END}", "]($1)")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" {3,}(?!\n)|(?<! ) {2}(?![ \n])", " "), r"  \n *| *\n *", "\n"))
