"""What several operators need: reading, folds, words in column expressions, cutting lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.session import checkpoint_dir, kept

# A word is a run of anything but these white-space characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of).cast("int")


def words_of(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner != "", F.split(inner, WORD_GAP)).otherwise(F.array().cast("array<string>"))


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` of a few plain columns, marked for broadcast when it has been counted to have at most ``rows`` rows; else as it is, so
    that a join shuffles. ``df`` should be written already (``kept``)."""
    return F.broadcast(df) if df.count() <= rows else df
