"""Rule-based quality: counts per document, and a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed to a fixed number of buckets. Bucket counts of the target documents and of the whole corpus give two
smoothed multinomials; a document's score is the mean log-ratio of its n-grams, and one fixed threshold judges every document.
DataFrame operations only; a document's windows never leave its row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import kept, small, words_of

BUCKETS = 1 << 14
# Mean log-ratio from which a document counts as like the target: between the two labels of the labelled documents.
THRESHOLD = -0.12
SMOOTHING = 1.0
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
# A window's hash and place share one long: this many low bits hold the place.
_PLACE_BITS = 22


def _windows(words: Column, n: Column) -> Column:
    """Hash and place of every three-word window, sorted, so that equal windows stand side by side."""
    return F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda at: F.shiftleft(
        F.xxhash64(F.get(words, at), F.get(words, at + 1), F.get(words, at + 2)), _PLACE_BITS).bitwiseOR(at.cast("long"))))


def _wide_windows(words: Column, n: Column) -> Column:
    """The same for texts whose places need more bits."""
    return F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda at: F.struct(
        F.xxhash64(F.get(words, at), F.get(words, at + 1), F.get(words, at + 2)).alias("hash"), at.alias("place"))))


def _twins(sorted_windows: Column, hash_of) -> Column:
    """Indexes of the windows equal to the one before."""
    return F.filter(F.sequence(F.lit(1), F.size(sorted_windows) - 1), lambda at: hash_of(F.get(sorted_windows, at)) == hash_of(F.get(sorted_windows, at - 1)))


def _places(sorted_windows: Column, twins: Column, place_of) -> Column:
    """Places of all windows that have an equal one, ascending."""
    both = F.array_union(twins, F.transform(twins, lambda at: at - 1))
    return F.sort_array(F.transform(both, lambda at: place_of(F.get(sorted_windows, at))))


def _covered(places: Column) -> Column:
    """Words under three-word windows at ``places``: each adds what reaches past the one before."""
    return F.aggregate(places, F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
                       lambda got, at: F.struct((got["sum"] + F.least(F.lit(3), at - got["last"])).alias("sum"), at.alias("last")), lambda got: got["sum"])


def with_repeats(df: DataFrame) -> DataFrame:
    """``df`` (with ``words`` and ``n``) and n_repeat_words: words in a three-word window found twice or more in the text."""
    few, many = (F.col("n") >= 4) & (F.col("n") < 1 << _PLACE_BITS), F.col("n") >= 1 << _PLACE_BITS
    words, n = F.col("words"), F.col("n")
    df = df.withColumns({"__narrow": F.when(few, _windows(words, n)), "__wide": F.when(many, _wide_windows(words, n))})
    narrow, wide = F.col("__narrow"), F.col("__wide")

    def top(value):
        return F.shiftright(value, _PLACE_BITS)

    def low(value):
        return value.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")

    df = df.withColumn("__twins", F.when(few, _twins(narrow, top)).when(many, _twins(wide, lambda value: value["hash"])))
    twins = F.col("__twins")
    df = df.withColumn("__places", F.when(few, _places(narrow, twins, low)).when(many, _places(wide, twins, lambda value: value["place"])))
    covered = F.when(F.size("__places") > 0, _covered(F.col("__places"))).otherwise(F.lit(0))
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__narrow", "__wide", "__twins", "__places")


def ngram_buckets(words: Column, buckets: int) -> Column:
    """A bucket per word and one per pair of neighbours, of the words of one text."""
    single = F.transform(words, lambda word: F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda at: F.pmod(F.xxhash64(F.get(words, at - 1), F.get(words, at)), F.lit(buckets)).cast("int"))
    return F.when(F.size(words) >= 2, F.concat(single, pairs)).otherwise(single)


def bucket_ratios(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The log-ratio of target to corpus per bucket. ``target_ids``: the doc_id of the trusted documents.

    Counts cover every n-gram of every document; what comes to the driver is two numbers per bucket."""
    marks = kept(target_ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("target", F.lit(1)))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(small(marks), "doc_id", "left")
    worded = marked.select("target", words_of(F.col("text")).alias("words"))
    grams = worded.select("target", F.explode(ngram_buckets(F.col("words"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_raw"), F.count("target").alias("n_target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in counts:
        raw[row["bucket"]], target[row["bucket"]] = row["n_raw"], row["n_target"]
    return np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * buckets)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * buckets))


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text, words, n and the counts the fixed rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", text.alias("text"))
    lined = slim.withColumns({"words": words_of(F.col("text")), "__lines": F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))})
    counted = lined.select(
        "doc_id", "words", F.size("words").alias("n"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"))
    return with_repeats(counted)


def quality_rules(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio, kept.

    Null and empty texts have no words: they fail the base rules and have a log_ratio of 0. Equal rows are judged alike; ids may be null;
    other columns are ignored; an empty table gives an empty result. Without target documents the ratio is flat up to smoothing."""
    ratios = F.lit(bucket_ratios(docs, target_ids, buckets))
    ruled = base_rules(docs).withColumn("__grams", ngram_buckets(F.col("words"), buckets))
    total = F.aggregate("__grams", F.lit(0.0), lambda sum_, bucket: sum_ + F.get(ratios, bucket))
    scored = ruled.withColumn("log_ratio", F.when(F.col("n") > 0, total / F.size("__grams")).otherwise(F.lit(0.0)))
    n_words = F.col("n").cast("long")
    failed = (n_words < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * n_words)
    return scored.select("doc_id", n_words.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "log_ratio").withColumn(
        "kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
