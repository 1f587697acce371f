"""Watches as Structured Streaming jobs.

What a watch has seen is keyed state: one value per (watch, link), (site, page) or change key in the RocksDB state store, kept with the
query's progress below ``home``. A micro-batch touches the keys that it holds and no others, so its cost does not grow with the history,
and a batch that runs again finds the state as it was before it. Rows of one key are thinned in their task before they are dealt out.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from pagegrain.operators.graph import change_tracking
from pagegrain.session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def drain(stream: DataFrame, name: str, mode: str = "append", handle: Callable[[DataFrame], DataFrame] | None = None, home: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns what this call wrote. ``handle(batch)`` makes the rows to write.

    ``home`` is a folder of the caller's that keeps progress and state, so that a later call goes on where this one ended; without
    it the watch starts anew in a folder of its own."""
    spark = stream.sparkSession
    home = home or folder(spark, name)
    runs = os.path.join(home, "runs")
    out = os.path.join(runs, f"run={uuid.uuid4().hex}")

    ran = False

    def write(batch: DataFrame, batch_id: int) -> None:
        nonlocal ran
        if handle is not None:
            # Written before it is looked at twice: a batch's state is worked out once.
            raw = os.path.join(home, "batches", f"batch={batch_id}")
            batch.write.mode("overwrite").parquet(raw)
            batch = handle(spark.read.schema(batch.schema).parquet(raw))
        batch.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))
        ran = True

    provider = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        job = (stream.writeStream.outputMode(mode).option("checkpointLocation", os.path.join(home, "progress"))
               .trigger(availableNow=True).foreachBatch(write).start())
    finally:
        spark.conf.set(_PROVIDER, provider)
    job.awaitTermination()
    if ran:
        return spark.read.parquet(out)
    # Nothing was there: no rows, in the form that earlier calls wrote.
    return spark.read.parquet(runs).drop("run").where(F.lit(False))


# ---- keyed state ------------------------------------------------------------------------------
def _best(df: DataFrame, keys: list[str], order: list[tuple[str, str]]) -> DataFrame:
    """The first row of each key in ``order`` within every Arrow batch: what a later step would pick, picked before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).sort_by(order)
            first = rows.append_column("__at", pa.array(np.arange(rows.num_rows))).group_by(keys).aggregate([("__at", "min")])["__at_min"]
            yield from rows.take(first).to_batches()

    return df.mapInArrow(run, df.schema)


class _Keyed(StatefulProcessor):
    """One value per key; it is forgotten ``ttl_ms`` after it was last written, if that is given."""

    def __init__(self, schema: StructType, value: list[str], order: list[tuple[str, str]], ttl_ms: int | None):
        self.names, self.order, self.ttl_ms, self.value = schema.names, order, ttl_ms, StructType([schema[name] for name in value])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("value", self.value, self.ttl_ms)

    def first(self, rows: Iterator[Row]) -> Row:
        best = next(rows)
        for row in rows:
            for name, way in self.order:
                if row[name] != best[name]:
                    best = row if (row[name] < best[name]) == (way == "ascending") else best
                    break
        return best

    def close(self) -> None:
        pass


class _Unseen(_Keyed):
    """The first row of a key that has not been seen, and nothing ever after."""

    def handleInputRows(self, key, rows, timerValues):
        best = self.first(rows)
        if not self.state.exists():
            self.state.update(tuple(best[name] for name in self.value.names))
            yield best


class _Before(_Keyed):
    """The value a key had before; the first of the new rows takes its place."""

    def handleInputRows(self, key, rows, timerValues):
        best, before = self.first(rows), self.state.get() if self.state.exists() else None
        self.state.update(tuple(best[name] for name in self.value.names))
        if before is not None:
            known = dict(zip(self.value.names, before))
            yield Row(**{name: known.get(name, best[name]) for name in self.names})


def _with_state(rows: DataFrame, keys: list[str], kind: type[_Keyed], value: list[str], order: list[tuple[str, str]], ttl_ms: int | None) -> DataFrame:
    processor = kind(rows.schema, value, order, ttl_ms)
    return _best(rows, keys, order).groupBy(*keys).transformWithState(processor, rows.schema, "Append", "None" if ttl_ms is None else "ProcessingTime")


def link_watch(stream: DataFrame, name: str = "link-watch", home: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Links of each watch not seen before, with ``first_poll`` for the poll that set the baseline; failed polls change nothing.

    ``stream(watch, link, polled_at, ok)``. State is one value per (watch, link), and one per watch, so one watch may hold a third of
    all links. With ``ttl_ms`` a link not seen for that long counts as new again.
    """
    # A link and its watch are two keys of one kind of state: '' stands for the watch itself.
    both = stream.where("ok AND link IS NOT NULL").select("watch", F.explode(F.array(F.struct(F.lit(True).alias("is_link"), F.col("link").alias("item")), F.struct(
        F.lit(False).alias("is_link"), F.lit("").alias("item")))).alias("key"), "polled_at").select("watch", "key.is_link", "key.item", "polled_at")
    new = _with_state(both, ["watch", "is_link", "item"], _Unseen, ["polled_at"], [("polled_at", "ascending")], ttl_ms)

    def handle(batch: DataFrame) -> DataFrame:
        first = batch.where("NOT is_link").select("watch", F.col("polled_at").alias("first_at"))
        return batch.where("is_link").join(first, "watch", "left").select("watch", F.col("item").alias("link"), "polled_at", F.coalesce(
            F.col("polled_at") == F.col("first_at"), F.lit(False)).alias("first_poll"))

    return drain(new, name, handle=handle, home=home)


def site_watch(stream: DataFrame, key: Column, name: str = "site-watch", home: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """New feed and sitemap entries per site: each page once, undated sitemap rows (and a site's undated first entries) only as the
    baseline. ``stream(site, url, title, published, source)``. State is one value per (site, page) and one per site."""
    page = F.struct(F.lit(True).alias("is_page"), F.col("page").alias("item"))
    both = stream.withColumn("page", key).where(F.col("page").isNotNull()).select(
        "site", F.explode(F.array(page, F.struct(F.lit(False).alias("is_page"), F.lit("").alias("item")))).alias("key"), "url", "title", "published", "source", F.coalesce("published", F.lit("")).alias("dated"))
    both = both.select("site", "key.is_page", "key.item", F.coalesce("url", F.lit("")).alias("url"), "title", "published", "source", "dated")
    new = _with_state(both, ["site", "is_page", "item"], _Unseen, ["dated"], [("dated", "descending"), ("url", "descending")], ttl_ms)

    def handle(batch: DataFrame) -> DataFrame:
        first = batch.where("NOT is_page").select("site", F.lit(True).alias("first"))
        told = batch.where("is_page").join(first, "site", "left").select(
            "site", F.col("item").alias("page"), "url", "title", "published", "source", F.coalesce("first", F.lit(False)).alias("first_poll"))
        return told.where(~(F.col("published").isNull() & (F.col("first_poll") | (F.col("source") == "sitemap"))))

    return drain(new, name, handle=handle, home=home)


def change_watch(stream: DataFrame, keys: list[str], content: Column, order: str, chunk: Column, name: str = "change-watch", home: str | None = None,
                 ttl_ms: int | None = None) -> DataFrame:
    """new, same or changed for every snapshot, against the one before it by ``order``, in its micro-batch or an earlier one. ``chunk`` grows
    with ``order`` and bounds what one task sorts. State is the last content of each key."""
    rows = stream.where(F.col(order).isNotNull()).select(*keys, F.col(order), F.sha2(content, 256).alias("content"))
    last = _with_state(rows, keys, _Before, [order, "content"], [(order, "descending")], ttl_ms)
    both = rows.withColumn("own", F.lit(True)).unionByName(last.withColumn("own", F.lit(False)))

    def handle(batch: DataFrame) -> DataFrame:
        return change_tracking(batch, keys, order, F.col("content"), chunk).where("own").select(*keys, order, "change")

    return drain(both, name, handle=handle, home=home)


def story_dedupe(stream: DataFrame, at: str, story: Column, delay: str = "1 day") -> DataFrame:
    """One entry per story across sites: the same story may come back only after the watermark has passed it."""
    return stream.withColumn("story", story).withWatermark(at, delay).dropDuplicatesWithinWatermark(["story"])


def on_time(stream: DataFrame, at: str, ttl: str, now: Column) -> DataFrame:
    """Rows within the TTL by their own time: neither later than ``now`` nor older than the TTL."""
    return stream.where((F.col(at) <= now) & (F.col(at) >= now - F.expr(f"interval {ttl}"))).withWatermark(at, ttl)


def running_tool_counts(stream: DataFrame, at: str, window: str = "1 day") -> DataFrame:
    """Tries and wins per tool and time window, kept as the stream goes on."""
    return stream.withWatermark(at, "1 day").groupBy(F.window(at, window).alias("w"), "provider").agg(
        F.count(F.lit(1)).alias("tries"), F.count_if(F.col("outcome") == "observed").alias("wins"))


def unchanged_skipped(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Sources whose validator was seen already are skipped."""
    return stream.dropDuplicates(keys)
