"""Markdown pages by line: what each line is, whether the page is led by navigation, and its body.

A document is one row, so its lines are arrays inside that row: no shuffle, and nothing larger than a document moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import fixed, texts
from pagegrain.functions.columns import each, first_of, squeeze

LEAD_CHARS, LEAD_SHARE, THIN_PROSE, BARE_PROSE, BARE_LINKS, ARTICLE_RUN = 1200, 0.5, 1200, 400, 0.5, 800


def _plain(line: Column) -> Column:
    return F.regexp_replace(squeeze(texts.visible(line)), r"^[ *#>\-|_`]+|[ *#>\-|_`]+$", "")


def _read(row: Column) -> Column:
    """What the rules look at, once per line: sizes, link share and whether it is a sentence."""
    line, plain = row["line"], row["plain"]
    return F.struct(
        line.alias("line"), plain.alias("plain"), row["fenced"].alias("fenced"), F.length(plain).alias("size"),
        F.when(line.contains("]("), texts.link_share(line)).otherwise(F.lit(0.0)).alias("share"),
        line.startswith("#").alias("heading"), texts.word_count(plain).alias("words"),
        F.rtrim(plain).rlike(fixed.SENTENCE_END).alias("ends"))


def _line_kind(row: Column) -> Column:
    line, plain, size = row["line"], row["plain"], row["size"]
    prose = (row["words"] >= 8) & row["ends"] & (row["share"] < 0.35)
    linked = (row["share"] >= 0.6) & line.rlike(fixed.MD_LINK)
    menu = (size <= 40) & ~row["heading"] & plain.rlike(texts.uni(fixed.NAV_TOKEN))
    meta = row["heading"] | line.rlike(r"(?i)^(title|url source|published time|markdown content|description):")
    return first_of([
        (row["fenced"], "code"), (linked | menu, "nav"), (meta, "neutral"),
        (prose, first_of([(plain.rlike(texts.uni(fixed.CONSENT)), "consent"), (plain.rlike(texts.uni(fixed.FOOTER)), "footer")],
                         "prose")),
        ((size > 0) & (size <= 40) & (row["words"] <= 5) & ~row["ends"], "short")], "neutral")


def with_lines(docs: DataFrame, content: Column, name: str = "lines") -> DataFrame:
    """Adds the non-blank lines of ``content`` as array<struct<kind,size,line>>; fenced lines are code."""
    # Text between fence lines: every second piece is inside a fence.
    pieces = F.split(F.coalesce(content, F.lit("")), r"(?m)^[ \t]*(?:```|~~~)[^\n]*$", -1)
    rows = F.flatten(F.transform(pieces, lambda piece, at: F.transform(
        F.filter(each(texts.lines_of(piece), lambda part: F.trim(part)), lambda line: line != ""),
        lambda line: F.struct(line.alias("line"), _plain(line).alias("plain"), (at % 2 == 1).alias("fenced")))))
    # Three projections, so that no rule repeats the work of the step before it.
    df = docs.withColumn(name, rows).withColumn(name, F.transform(name, _read))
    df = df.withColumn(name, F.transform(name, lambda row: F.struct(
        _line_kind(row).alias("kind"), row["size"].alias("size"), row["line"].alias("line"), row["fenced"].alias("fenced"))))
    return df.withColumn(name, F.transform(name, lambda row: F.struct(
        row["kind"].alias("kind"), F.when(row["fenced"] | ((row["kind"] == "nav") & (row["size"] == 0)), F.length(row["line"])
                                          ).otherwise(row["size"]).alias("size"), row["line"].alias("line"))))


def _total(lines: Column, kinds: list[str] | None = None, but: list[str] | None = None) -> Column:
    def counts(line):
        return line["kind"].isin(kinds) if kinds is not None else ~line["kind"].isin(but)

    return F.aggregate(lines, F.lit(0), lambda total, line: total + F.when(counts(line), line["size"]).otherwise(0))


def with_nav_measure(df: DataFrame, lines: str = "lines") -> DataFrame:
    """Adds the navigation measure of a page: how it opens, what follows, and why it is led by navigation (or null)."""
    rows = F.col(lines)
    opening = F.array_position(each(rows, lambda line: (line["kind"] == "code") | (
        (line["kind"] == "prose") & (line["size"] >= 120))), F.lit(True)).cast("int")
    df = df.withColumn("_start", F.when(opening > 0, opening - 1).otherwise(F.size(rows)))
    lead = F.slice(rows, F.lit(1), F.col("_start"))
    rest = F.slice(rows, F.col("_start") + 1, F.greatest(F.size(rows), F.lit(1)))

    def step(state, line):
        run = F.when(line["kind"].isin("prose", "code"), state["run"] + line["size"]).when(
            line["kind"] == "neutral", state["run"]).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"))

    longest = F.aggregate(rest, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda state: state["best"])
    df = (df.withColumn("lead_chars", _total(lead, but=["neutral"]))
          .withColumn("lead_nav", _total(lead, ["nav", "short", "footer", "consent"]))
          .withColumn("prose_chars", _total(rows, ["prose", "code"]))
          .withColumn("nav_chars", _total(rows, ["nav"]))
          .withColumn("total_chars", F.greatest(_total(rows, but=["neutral", "short"]), F.lit(1)))
          .withColumn("after_chars", _total(rest, ["prose", "code"]))
          .withColumn("article_run_chars", longest))
    led = (F.col("lead_chars") >= LEAD_CHARS) & (F.col("lead_nav") / F.col("lead_chars") >= LEAD_SHARE)
    bare = ((F.col("prose_chars") < BARE_PROSE) & (F.col("nav_chars") / F.col("total_chars") >= BARE_LINKS)
            & (F.col("total_chars") >= 400))
    reason = first_of([(led & (F.col("after_chars") < THIN_PROSE), "thin prose after navigation"),
                       (led & (F.col("article_run_chars") < ARTICLE_RUN), "no article after navigation"),
                       (bare, "mostly links and menu words")])
    return df.withColumn("nav_reason", reason).drop("_start")


def markdown_body(content: Column) -> Column:
    """struct(lines, title) with every raw line of a markdown page: the input of ``with_markdown_main``."""
    return texts.lines_of(F.coalesce(content, F.lit("")))


def with_markdown_main(docs: DataFrame, content: Column, name: str = "main_text") -> DataFrame:
    """A markdown page cut to its body: from just before the first real paragraph to just after the last one."""
    df = docs.withColumn("_lines", texts.lines_of(F.coalesce(content, F.lit(""))))
    df = df.withColumn("_lines", F.transform("_lines", lambda line: F.struct(
        line.alias("line"), texts.link_share(line).alias("share"), texts.body_line(line).alias("body"))))
    flags = each(F.col("_lines"), lambda line: line["body"])
    df = (df.withColumn("_first", F.array_position(flags, F.lit(True)).cast("int"))
          .withColumn("_last", F.size("_lines") - F.array_position(F.reverse(flags), F.lit(True)).cast("int") + 1))
    before = F.reverse(F.slice("_lines", F.lit(1), F.greatest(F.col("_first") - 1, F.lit(0))))

    def back(state, line):
        filled = F.trim(line["line"]) != ""
        stop = state["stop"] | (state["kept"] >= 3) | (filled & (line["share"] >= 0.5))
        return F.struct(stop.alias("stop"), F.when(stop, state["kept"]).otherwise(state["kept"] + filled.cast("int")).alias("kept"),
                        F.when(stop, state["taken"]).otherwise(state["taken"] + 1).alias("taken"))

    taken = F.aggregate(before, F.struct(F.lit(False).alias("stop"), F.lit(0).alias("kept"), F.lit(0).alias("taken")), back,
                        lambda state: state["taken"])
    df = df.withColumn("_first", F.col("_first") - taken)
    body = F.slice("_lines", F.greatest(F.col("_first"), F.lit(1)), F.greatest(F.col("_last") - F.col("_first") + 1, F.lit(0)))
    kept = F.filter(body, lambda line: ~((F.trim(line["line"]) != "") & (line["share"] >= 0.8) & ~line["body"]))
    text = F.regexp_replace(F.trim(F.array_join(each(kept, lambda line: line["line"]), "\n")), r"\n{3,}", "\n\n")
    title = F.trim(F.try_element_at(F.filter(each(F.col("_lines"), lambda line: line["line"]), lambda line: (
        line.startswith("# ") | F.lower(line).startswith("title:"))), F.lit(1)))
    titled = F.when(title.isNotNull() & ~F.contains(text, title), F.concat(title, F.lit("\n\n"), text)
                    ).otherwise(text)
    whole = F.when(F.trim(content) != "", F.trim(content))
    return (df.withColumn(name, F.when(F.exists(flags, lambda flag: flag), titled).otherwise(whole))
            .drop("_lines", "_first", "_last"))
