"""Small column helpers shared by every area."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def words_in(items: Iterable[str]) -> Column:
    return F.array(*[F.lit(item) for item in items])


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match (or one of its groups), null when there is none or it is empty."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | text.contains(phrase)
    return hit


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def opening(text: Column, within: int | None) -> Column:
    """The first ``within`` characters of a text, or all of it."""
    return text if within is None else F.substring(text, 1, within)


def first_of(pairs: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds: precedence as one expression."""
    chain = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain if otherwise is None else chain.otherwise(
        otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def distinct_in_order(items: Column) -> Column:
    return F.array_distinct(items)


def none_if_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def each(items: Column, fn: Callable[[Column], Column]) -> Column:
    return F.transform(items, fn)


def unescape(text: Column) -> Column:
    """The character references that pages use, as the characters they stand for."""
    out = text
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "),
                       ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
                       ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&euro;", "€"), ("&pound;", "£"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out
