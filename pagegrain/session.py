"""Session settings the jobs rely on, and the one place lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# How many partitions wide tables are dealt out to when they are read; unset: as they are scanned.
SPREAD = "spark.pagegrain.spread"

# Joins whose side is estimated below the first are broadcast from the start; all others once a shuffled side was measured to be below the second.
# The files' size says little: a row of a few bytes on disk becomes a page of some thousand, or as many elements.
MEASURED = {"spark.sql.autoBroadcastJoinThreshold": "32KB", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB"}

# How many partitions a shuffle starts with, before those of little data are merged.
START_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

# Whether the shuffle files of a query go when it has ended; otherwise they stay until the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str = "pagegrain", cores: str = "8", **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "8")
               .config(SPREAD, cores)
               .config("spark.driver.memory", "12g"))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def join_by_measure(spark: SparkSession) -> None:
    """Lets sizes that were measured, not estimates from file sizes, choose what is broadcast through the driver. A session that broadcasts less keeps its own."""
    for key, value in MEASURED.items():
        own = spark.conf.get(key, None)
        if own is None or not own.startswith("-"):
            spark.conf.set(key, value)


def widen_shuffles(spark: SparkSession, partitions: int) -> None:
    """Lets shuffles start with at least that many partitions; Spark merges small ones by their measured sizes, but never splits what a fixed number
    has put together. A session that starts with more keeps its own number."""
    own = spark.conf.get(START_PARTITIONS, None)
    plain = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(partitions, plain, int(own or 0))
    if wanted > int(own or plain):
        spark.conf.set(START_PARTITIONS, str(wanted))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names for checkpoints; a private one only where none is named on a local master."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    current = sc.getCheckpointDir()
    if current is not None:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="pagegrain-checkpoint-")
    sc.setCheckpointDir(own)
    return own


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Tables that are made and read inside leave no shuffle files behind: for results that are held or written, and plans that run once."""
    own = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, own)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut at a reliable checkpoint, so a lost executor never replays a whole loop."""
    checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A name for a new folder below the session's shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/pagegrain-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the session's shared folder and read again: computed once, read by the columns asked for."""
    spark = df.sparkSession
    path = new_folder(spark)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spent(*tables: DataFrame) -> None:
    """Removes the files of tables that ``kept`` wrote and that no later query reads: steps of a job that has gone on from them."""
    for df in tables:
        spark = df.sparkSession
        base = f"{checkpoint_dir(spark).rstrip('/')}/pagegrain-"
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            files = path.getFileSystem(spark._jsc.hadoopConfiguration())
            if str(files.makeQualified(path)).startswith(str(files.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(base)))):
                files.delete(path, True)
