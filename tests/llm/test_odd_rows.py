"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing names, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagegrain.llm import byte_network, decontaminate, language_model, line_dedup, mixing, ngram_join, quality_rules, toxicity

ITEMS = "item_id long, text string, doc_id long"


def items(spark, some=True):
    rows = [(1, "f g h another line altogether and more", 5), (2, None, None), (None, "x y z " * 9, 1), (3, "", 1), (1, "f g h another line altogether and more", 5)]
    return spark.createDataFrame(rows if some else [], ITEMS)


OPERATORS = {
    "quality": lambda spark, docs, labels: quality_rules.quality_rules(docs, labels.where("quality = 1").select("doc_id")),
    "join": lambda spark, docs, labels: ngram_join.ngram_join(docs),
    "toxicity": lambda spark, docs, labels: toxicity.toxicity(docs, labels),
    "language model": lambda spark, docs, labels: language_model.score_texts(docs, steps=3),
    "lines": lambda spark, docs, labels: line_dedup.line_dedup(docs),
    "bytes": lambda spark, docs, labels: byte_network.byte_quality(docs, labels),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, odd_docs, no_docs, odd_labels, name):
    run = OPERATORS[name]
    got = run(spark, odd_docs, odd_labels)
    assert got.count() == odd_docs.count()
    assert run(spark, no_docs, odd_labels).count() == 0
    # Without labels there is a result too.
    assert run(spark, odd_docs, odd_labels.where(F.lit(False))).count() == odd_docs.count()


def test_mixing_gives_each_text_once(spark, odd_docs, no_docs, odd_labels):
    got = mixing.mix(odd_docs, mixing.labelled_domains(odd_docs, odd_labels), mixing.TARGETS).collect()
    assert len(got) == odd_docs.select("doc_id", "text").distinct().count()
    assert all(row["rate"] >= 0 and abs(sum(row["posterior"]) - 1) < 1e-9 for row in got)
    assert mixing.mix(no_docs, mixing.labelled_domains(no_docs, odd_labels), mixing.TARGETS).count() == 0


def test_leaks_once_per_document_and_item(spark, odd_docs, no_docs):
    got = [(row["doc_id"], row["item_id"]) for row in decontaminate.find_leaks(odd_docs, items(spark)).collect()]
    assert got == [(7, 1)]
    assert decontaminate.find_leaks(no_docs, items(spark)).count() == 0
    assert decontaminate.find_leaks(odd_docs, items(spark, False)).count() == 0
    kept = decontaminate.decontaminate(odd_docs, items(spark))
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 7").count() == 0 and kept.where("doc_id IS NULL").count() == 2


def test_repeated_and_null_rows_are_defined(spark, odd_docs, odd_labels):
    joined = {(row["doc_id"], row["n_copies"], row["n_links"]) for row in ngram_join.ngram_join(odd_docs).collect()}
    assert (6, 2, 0) in joined and (1, 1, 0) in joined and (None, 1, 0) in joined
    lines = line_dedup.line_dedup(odd_docs).where("doc_id = 6").collect()
    assert [row["text"] for row in lines] == ["a b c d e f g h\nsame line of words here"] * 2
    assert line_dedup.line_dedup(odd_docs).where("doc_id = 7").select("text").orderBy("text").first()["text"] == "another line altogether"
    quality = {row["doc_id"]: row for row in quality_rules.quality_rules(odd_docs, odd_labels.where("quality = 1").select("doc_id")).collect()}
    assert quality[1]["n_words"] == 0 and quality[1]["base_failed"] and quality[6]["n_dup_lines"] == 1
    scored = {row["doc_id"]: row for row in language_model.score_texts(odd_docs, steps=3).collect()}
    assert scored[1]["n_tokens"] == 1 and scored[1]["score"] == scored[2]["score"] == scored[3]["score"]


def test_stages_keep_their_columns_on_odd_rows(spark, odd_docs, no_docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd_docs, no_docs):
            got = stage(spark, docs.select(corpus_pipeline.COLUMNS), sf_dir)
            got.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == corpus_pipeline.COLUMNS, name


def test_near_copies_are_judged_row_by_row(spark, sf_dir):
    text, other = " ".join(f"word{i}" for i in range(60)), " ".join(f"other{i}" for i in range(60))
    rows = [(3, text), (1, text + " more"), (3, other), (2, text), (2, text), (None, text), (None, "alone here"), (4, None), (5, None)]
    docs = spark.createDataFrame([(doc_id, text, "en", "s", 1) for doc_id, text in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(row["doc_id"], row["text"]) for row in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert got == {(1, text + " more"), (3, other), (None, "alone here"), (4, None), (5, None)}
