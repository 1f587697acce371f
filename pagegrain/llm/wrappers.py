"""Main text of pages by inferred wrappers: a union-free regular expression per host, and text taken from its main part.

A page is read as nested token streams: each element has the stream of its children, elements by tag and class, and text. The
pages of a host are aligned one after the other: equal tokens are matched in order, what only one side has becomes optional, adjacent
repeats of up to three tokens become a repeated group, and texts that differ become slots. The wrapper then tells which part of
the host's pages is the article (where most text that differs between pages stands outside of links) and which texts inside it are
the template's own. Wrappers are folded in every task first, so a host of any size meets as a few partial wrappers.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import kept, small
from pagegrain.llm.url_filter import url_host

# Element names by their part in HTML, all fixed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title xmp noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul""".split())
# An opening tag of the key ends the open elements of the value, up to the stop elements.
CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr
    main menu nav ol p pre search section table ul""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"},
         "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
# Parts that are never the article, by element or role, and by words of a class or id.
OUTSIDE = frozenset("nav footer aside form button dialog menu input fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OUTSIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side-?bar|"
    r"widgets?|footers?|comments?|commentlist|respond|disqus|reader-comments|notices?|cookies?|consent|gdpr|newsletters?|subscribe|subscription|popups?|modals?|overlay|"
    r"share|sharing|social|related|recommend(?:ed|ations)?|pagination|pager|toolbar|skip-link|masthead|site-header|page-header|login|signup|paywall|alerts?)(?=$|[\s_-])", re.I)
ARTICLE_WORDS = re.compile(r"(?:^|[\s_-])(?:article(?:-?body)?|post-?(?:content|body|text)|entry-?content|main-?content|story(?:-?body)?|content)(?=$|[\s_-])", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "label", "outside", "children")

    def __init__(self, tag: str, label: str, outside: bool):
        self.tag, self.label, self.outside, self.children = tag, label, outside, []


def _node(tag: str, attributes: str) -> Node:
    if not attributes or attributes.isspace():
        return Node(tag, tag, tag in OUTSIDE)
    found = {}
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html_lib.unescape(a or b or c))
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    label = f"{tag}.{re.sub(r'[0-9]+', 'N', names.split()[0])}" if names else tag
    outside = (tag in OUTSIDE or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
               or "display:none" in found.get("style", "").replace(" ", "").lower() or (bool(names) and tag not in ("html", "body") and bool(OUTSIDE_WORDS.search(names))))
    return Node(tag, label, outside)


def parse(page: str) -> Node:
    """The element tree of a page, however deep, with implied end tags. Text is undecoded; what cannot hold text is left out."""
    root = Node("", "", False)
    stack, at, end = [root], 0, len(page)
    while at < end:
        token = TOKEN.match(page, at)
        at = token.end()
        name = token[2]
        if name is None:
            text = token[0]
            if not (text.startswith("<!") or text.startswith("<?")):
                stack[-1].children.append(text)
            continue
        tag = name.lower()
        if not token[4]:
            # A tag that the page's end cuts off.
            break
        if token[1]:
            # A closing tag ends the nearest open element of its name, unless a block stands between that an inline tag cannot close.
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag not in BLOCK and stack[depth].tag in BLOCK:
                    break
            continue
        if tag in RAW and not token[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        ends = CLOSES.get(tag)
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCK:
                    break
        elif ends:
            lowest = None
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in STOPS[tag]:
                    break
                if stack[depth].tag in ends:
                    lowest = depth
            if lowest is not None:
                del stack[lowest:]
        node = _node(tag, token[3].rstrip("/"))
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
    return root


# ---- wrappers ---------------------------------------------------------------
TEXT = "#"


@dataclass
class Part:
    """A token of a wrapper: an element with its stream, or a text slot. ``same``: the one text it had so far, None when texts differ.
    ``plain`` and ``linked``: characters of text outside and inside of links; ``seen``: pages that have it."""

    label: str
    children: list[Part] = field(default_factory=list)
    optional: bool = False
    repeated: bool = False
    outside: bool = False
    same: str | None = None
    plain: int = 0
    linked: int = 0
    seen: int = 1

    def plan(self) -> list:
        return [self.label, [child.plan() for child in self.children], self.optional, self.repeated, self.outside, self.same, self.plain, self.linked, self.seen]

    @classmethod
    def of(cls, plan: list) -> Part:
        label, children, *rest = plan
        return cls(label, [cls.of(child) for child in children], *rest)


# A template's own text is on so many pages at least, and on this share of its host's.
TEMPLATE_PAGES, TEMPLATE_SHARE = 5, 0.5
# Deeper nesting than this is read as the text of its last level, so that no page can exhaust a task.
DEEPEST = 60


def _texts(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            todo += reversed(item.children)
    return "".join(out)


def _name_of(text: str) -> str:
    """A text's stand-in inside wrappers: a hash of the whole of it."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def sketch(node: Node, linked: bool = False, depth: int = 0) -> Part:
    """The wrapper of one page: its tokens, with adjacent repeats grouped."""
    linked = linked or node.tag == "a"
    part = Part(node.label, outside=node.outside)
    for child in node.children:
        if isinstance(child, Node) and depth < DEEPEST:
            part.children.append(sketch(child, linked, depth + 1))
            continue
        text = SPACE.sub(" ", child if isinstance(child, str) else _texts(child)).strip()
        if text:
            part.children.append(Part(TEXT, same=_name_of(text), plain=0 if linked else len(text), linked=len(text) if linked else 0))
    part.children = _grouped(part.children)
    part.plain, part.linked = sum(x.plain for x in part.children), sum(x.linked for x in part.children)
    return part


def _merged(a: Part, b: Part, add_seen: bool = True) -> Part:
    """Two readings of one token: their streams aligned; equal texts stay, others become a slot."""
    out = Part(a.label, optional=a.optional or b.optional, repeated=a.repeated or b.repeated, outside=a.outside or b.outside,
               same=a.same if a.same == b.same else None, plain=a.plain + b.plain, linked=a.linked + b.linked, seen=a.seen + b.seen if add_seen else max(a.seen, b.seen))
    out.children = align(a.children, b.children, add_seen) if a.children or b.children else []
    return out


def _grouped(stream: list[Part]) -> list[Part]:
    """Adjacent repeats of one to three tokens as a repeated group; the repeats are aligned into one."""
    for period in (1, 2, 3):
        out: list[Part] = []
        for part in stream:
            out.append(part)
            if len(out) >= 2 * period and all(x.label == y.label for x, y in zip(out[-period:], out[-2 * period : -period])) and (
                    period == 1 or len({x.label for x in out[-period:]}) > 1):
                last = out[-period:]
                del out[-period:]
                for k, part_ in enumerate(last):
                    out[-period + k] = _merged(out[-period + k], part_, False)
                    out[-period + k].repeated = True
        stream = out
    return stream


def align(a: list[Part], b: list[Part], add_seen: bool = True) -> list[Part]:
    """The tokens both streams have, in order (a longest common subsequence of labels); what only one has is optional."""
    if [x.label for x in a] == [y.label for y in b]:
        return [_merged(x, y, add_seen) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].label == b[j].label else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i].label == b[j].label:
            out.append(_merged(a[i], b[j], add_seen))
            i, j = i + 1, j + 1
            continue
        take_a = j == m or (i < n and best[i + 1][j] >= best[i][j + 1])
        part = a[i] if take_a else b[j]
        part.optional = True
        out.append(part)
        i, j = i + take_a, j + (not take_a)
    return _grouped(out)


def expression(part: Part) -> str:
    """The wrapper as a union-free regular expression, to be read by people."""
    inner = "".join(expression(child) for child in part.children)
    body = "#" if part.label == TEXT else f"<{part.label}>{inner}</>" if part.label else inner
    return (f"({body})" if part.optional or part.repeated else body) + ("+" if part.repeated else "") + ("?" if part.optional else "")


def _own_text(part: Part) -> int:
    """Characters that differ between pages or repeats, outside of links and of parts that are never the article."""
    if part.outside:
        return 0
    if part.label == TEXT:
        return part.plain if part.same is None or part.seen == 1 else 0
    return sum(_own_text(child) for child in part.children)


def main_part(wrapper: Part) -> tuple[list[str], list[tuple[list[str], str]]]:
    """(path of labels to the article; paths below it and texts there that are the template's own). An article element with text wins; else the
    deepest part that holds most of the host's own text."""
    def named(part: Part, path: list[str]):
        if part.outside:
            return
        if part.label.split(".")[0] in ("article", "main") or ARTICLE_WORDS.search(part.label.partition(".")[2] or "-"):
            yield path + [part.label], part
        for child in part.children:
            yield from named(child, path + [part.label])

    whole = max(_own_text(wrapper), 1)
    chosen = None
    for path, part in named(wrapper, []):
        if _own_text(part) * 2 >= whole and (chosen is None or path[-1].split(".")[0] == "article" or chosen[0][-1].split(".")[0] != "article"):
            chosen = (path, part)
            if path[-1].split(".")[0] == "article":
                break
    if chosen is None:
        path, part = [], wrapper
        while True:
            path = path + [part.label]
            inner = max((child for child in part.children if child.label != TEXT), key=_own_text, default=None)
            if inner is None or _own_text(inner) < 0.8 * whole or inner.label.split(".")[0] in ("p", "ul", "ol", "table"):
                break
            part = inner
        chosen = (path, part)
    fixed: list[tuple[list[str], str]] = []

    def template(part: Part, path: list[str]):
        for child in part.children:
            if child.label != TEXT:
                if not child.repeated:
                    template(child, path + [child.label])
            # The same text on every page that has it, several and a share of the host's, in a part that does not repeat on a page.
            elif child.same is not None and child.seen >= max(TEMPLATE_PAGES, TEMPLATE_SHARE * wrapper.seen) and not child.repeated:
                fixed.append((path, child.same))

    template(chosen[1], [])
    return chosen[0], fixed


# ---- text -------------------------------------------------------------------
def _places(root: Node, path: list[str]) -> list[Node]:
    found = [root]
    for label in path[1:]:
        found = [child for node in found for child in node.children if isinstance(child, Node) and child.label == label]
    return found


def _generic(root: Node) -> list[Node]:
    """Where a page does not fit its host's wrapper: its articles, else its main element, else its body, else all of it."""
    todo, by_tag = [root], {"article": [], "main": [], "body": []}
    while todo:
        node = todo.pop()
        if node.outside:
            continue
        if node.tag in by_tag:
            by_tag[node.tag].append(node)
            if node.tag == "article":
                continue
        todo += [child for child in reversed(node.children) if isinstance(child, Node)]
    return by_tag["article"] or by_tag["main"][:1] or by_tag["body"][:1] or [root]


def blocks(nodes: list[Node], fixed: set[tuple[tuple[str, ...], str]]) -> list[str]:
    """The texts of the block elements in page order, decoded, with single spaces; without what is never the article."""
    out: list[str] = []
    run: list[str] = []

    def close():
        text = SPACE.sub(" ", html_lib.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    for top in nodes:
        # (node, path below the top, next child)
        stack = [(top, (), iter(top.children))]
        while stack:
            node, path, rest = stack[-1]
            child = next(rest, None)
            if child is None:
                stack.pop()
                if node.tag in BLOCK:
                    close()
            elif isinstance(child, str):
                if not fixed or (path, _name_of(SPACE.sub(" ", child).strip())) not in fixed:
                    run.append(child)
            elif child.outside:
                continue
            elif child.tag == "br":
                run.append("\n")
            elif child.tag not in ("head",):
                if child.tag in BLOCK:
                    close()
                stack.append((child, path + (child.label,), iter(child.children)))
        close()
    return out


def page_text(page: str | None, main: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    path, fixed = json.loads(main) if main else ([], [])
    nodes = _places(root, path) if len(path) > 1 else []
    found = blocks(nodes, {(tuple(path_), name) for path_, name in fixed}) if nodes else []
    return "\n\n".join(found or blocks(_generic(root), set()))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host from all of a task's pages."""
    held: dict[str, Part] = {}
    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not page:
                continue
            part = sketch(parse(page))
            held[host] = _merged(held[host], part) if host in held else part
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(part.plan()) for part in held.values()], pa.string())], names=["host", "wrapper"])


def _join(group: pd.DataFrame) -> pd.DataFrame:
    whole: Part | None = None
    for plan in sorted(group.wrapper):
        part = Part.of(json.loads(plan))
        whole = part if whole is None else _merged(whole, part)
    return pd.DataFrame({"host": [group.host.iloc[0]], "main": [json.dumps(main_part(whole))], "wrapper": [expression(whole)]})


def infer(pages: DataFrame) -> DataFrame:
    """host, main (the article's place, as JSON), wrapper (the expression) for every host with a page. A null URL has the host ''."""
    slim = pages.select(url_host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(_fold, "host string, wrapper string").groupBy("host").applyInPandas(_join, "host string, main string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (the article's blocks, joined by an empty line; empty if none), n_chars.

    A null or empty html has no text. A page that does not fit its host's wrapper is read by its own article, main or body element. Repeated
    rows are read alike; other columns are ignored; an empty table gives an empty result."""
    mains = small(kept(infer(pages).select(F.col("host").alias("__host"), "main")), 200_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(page, main) for page, main in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(text) for text in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    placed = slim.withColumn("__host", url_host(F.col("url"))).join(mains, "__host", "left").select("page_id", "url", "html", "main")
    return placed.mapInArrow(run, "page_id long, url string, text string, n_chars long")
