"""Scans of page tables, imported evidence and case files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import urls
from pagegrain.functions.columns import blank_to_null, find, find_all, squeeze, unescape
from pagegrain.operators.links import strip_tags

_HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->"


def page_title(html: Column) -> Column:
    return squeeze(unescape(strip_tags(find(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1))))


def page_text(html: Column) -> Column:
    """A page's whole text: scripts, styles and comments out, tags as spaces, references as characters."""
    return squeeze(unescape(strip_tags(F.regexp_replace(html, _HIDDEN, " "))))


def markdown_title(content: Column) -> Column:
    """The first ``# `` or ``Title:`` line."""
    line = find(content, r"(?im)^[ \t]*(?:#[ ]|title:)[ \t]*([^\n]*)$", 1)
    return blank_to_null(F.trim(line))


def with_text(pages: DataFrame) -> DataFrame:
    """Pages with the title and text their own HTML carries."""
    return pages.withColumn("title", page_title(F.col("html"))).withColumn("text", page_text(F.col("html")))


def scan(pages: DataFrame) -> DataFrame:
    """The fetched pages as the other jobs read them: whole content, with its size and host."""
    return pages.select("page_id", "url", "html", urls.bare_host("url").alias("host"),
                        F.length("html").alias("html_chars"))


def import_evidence(pages: DataFrame, supplied: DataFrame, now: Column, slack_seconds: int = 60) -> DataFrame:
    """Page rows with those a person supplied; a supplied time in the future (past the slack) rejects the row."""
    latest = now + F.make_dt_interval(secs=F.lit(slack_seconds))
    good = supplied.where(F.col("observed_at").isNotNull() & (F.col("observed_at") <= latest)
                          & F.col("method").isin("operator_browser", "user_supplied")
                          & F.col("content_type").isin("text/html", "text/plain", "application/json"))
    shared = ["url", "content", "content_type", "observed_at", "method"]
    return pages.select(*shared).unionByName(good.select(*shared))


def case_lines(lines: DataFrame) -> DataFrame:
    """``url<TAB>phrase`` lines as rows; blank lines and ``#`` lines are skipped and the phrase may be missing."""
    trimmed = F.trim("value")
    return (lines.where((trimmed != "") & ~F.startswith(trimmed, F.lit("#")))
            .select(F.trim(F.split_part(trimmed, F.lit("\t"), F.lit(1))).alias("url"),
                    blank_to_null(F.regexp_extract(trimmed, r"^[^\t]*\t(.*)$", 1)).alias("expect")))


def hosts_in(texts: DataFrame, column: str) -> DataFrame:
    """Every host that any text of a corpus links to, once."""
    found = texts.select(F.explode(find_all(F.col(column), r"""https?://[^\s"'<>\\)]+""", 0)).alias("link"))
    return found.select(urls.bare_host("link").alias("host")).where(F.contains("host", F.lit("."))).distinct()
