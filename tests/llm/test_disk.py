"""Jobs give back the disk of their steps: shuffles, tables that no later step reads, copies of texts."""

import pickle
import time
from pathlib import Path

import corpus_pipeline
import numpy as np
from pagegrain import session
from pagegrain.llm import decontaminate, line_dedup
from pyspark import cloudpickle
from pyspark.sql import functions as F

DOCS = [(1, "one line of some words\nshared line of some words", "en", "web", 10), (2, "shared line of some words\nshared line of same words", "en", "web", 10), (None, None, None, None, None)]


def _folders(spark):
    return set(Path(session.checkpoint_dir(spark).removeprefix("file:")).glob("pagegrain-*"))


def _shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return {str(path) for folder in env.blockManager().diskBlockManager().localDirs() for path in Path(folder.getPath()).glob("*/shuffle_*")}


def test_written_tables_leave_no_shuffle_files(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, own = _shuffle_files(spark), spark.conf.get(session.SHUFFLES_GO, None)
    written, held = session.kept(rows), session.cut(rows.where("k > 2"))
    for _ in range(50):
        if _shuffle_files(spark) <= before:
            break
        time.sleep(0.2)
    assert _shuffle_files(spark) <= before
    assert spark.conf.get(session.SHUFFLES_GO, None) == own and written.count() == 7 and held.count() == 4


def test_spent_tables_go_and_others_stay(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "given"))
    before = _folders(spark)
    one, other = session.kept(spark.range(5)), session.kept(spark.range(6))
    session.spent(one, spark.read.parquet(str(tmp_path / "given")))
    assert len(_folders(spark) - before) == 1 and other.count() == 6 and spark.read.parquet(str(tmp_path / "given")).count() == 3


def test_line_dedup_keeps_what_its_result_reads_only(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    before = _folders(spark)
    assert line_dedup.line_dedup(docs).count() == 3
    assert len(_folders(spark) - before) == 1


def test_stages_that_judge_texts_write_no_copy_of_them(spark, sf_dir):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    before = _folders(spark)
    assert corpus_pipeline.drop_benchmark_leaks(spark, docs, sf_dir).count() == 3
    assert all("text" not in spark.read.parquet(str(path)).columns for path in _folders(spark) - before)


def test_a_task_of_the_fit_is_sent_one_table(spark):
    basis = np.random.default_rng(1).standard_normal((decontaminate.COLUMNS, 16))
    sent = len(cloudpickle.dumps(decontaminate._gram(basis, np.ones(decontaminate.COLUMNS), 48), protocol=pickle.HIGHEST_PROTOCOL))
    assert sent < 1.3 * basis.size * 4


def test_sums_of_runs_of_any_length():
    rng = np.random.default_rng(2)
    rows = rng.standard_normal((50, 8)).astype(np.float32)
    for sizes in ([1], [3, 1, 700, 2], [64, 65, 1, 64 * 64 + 1], rng.integers(1, 200, 1500).tolist()):
        pick, first = rng.integers(0, 50, sum(sizes)), np.cumsum([0, *sizes[:-1]])
        plain = np.stack([rows[pick[at : at + n]].astype(np.float64).sum(axis=0) for at, n in zip(first, sizes)])
        assert np.allclose(decontaminate._sums_of(rows, pick.astype(np.uint16), first), plain, atol=1e-3)
