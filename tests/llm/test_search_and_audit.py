"""Hard negatives, the filter audit and the licence scan: brute force, odd rows, SQL over the small tables."""

import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagegrain.llm import filter_audit, hard_negatives, license_scan, queries

VECTORS = "id long, label long, vector array<double>, score double, at int"


def _plain(rows, anchors, low=50, high=95):
    """Every row against every anchor; equal rows count once, a missing id is the largest."""
    big = float("inf")
    distinct = sorted({(big if row[0] is None else row[0], row[1], tuple(row[2])) for row in rows})
    width = max((len(row[2]) for row in distinct), default=0)
    padded = [(i, label, list(vector) + [0.0] * (width - len(vector)), vector) for i, label, vector in distinct]
    out = []
    for anchor in [row for row in padded if (row[0], row[1], row[3]) in {(big if a[0] is None else a[0], a[1], tuple(a[2])) for a in anchors}]:
        scored = sorted((-int(sum(x * y for x, y in zip(anchor[2], row[2]))), row[0], row[1]) for row in padded if row is not anchor)
        for score, positive, _ in [row for row in scored if row[2] == anchor[1]][:5]:
            fit = [row for row in scored if row[2] != anchor[1] and low * -score <= 100 * -row[0] <= high * -score]
            out += [(anchor[0], positive, rank, row[1], -score, -row[0]) for rank, row in enumerate(fit[:3], 1)]
    return sorted(tuple(None if value == big else value for value in row) for row in out) if out else []


def _key(row):
    return tuple(float("inf") if value is None else value for value in row)


def _mined(spark, rows, anchors, **settings):
    frame = spark.createDataFrame([(*row, 0.0, 1) for row in rows], VECTORS)
    chosen = spark.createDataFrame([(*row, 0.0, 1) for row in anchors], VECTORS)
    got = hard_negatives.hard_negatives(frame, chosen, **settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(row) for row in got.collect()), key=_key)


def test_negatives_of_ties_copies_and_odd_rows(spark):
    rng = random.Random(4)
    vectors = [[float(rng.randint(-9, 9)) for _ in range(6)] for _ in range(40)]
    rows = [(i, i % 3, vectors[rng.randrange(40)]) for i in range(400)]
    # A common vector, repeated rows, one id with two vectors, rows without an id, short and empty vectors, one value beyond 16 bits.
    rows += [(1000 + i, i % 2, vectors[0]) for i in range(300)] + rows[:30] + [(7, 1, vectors[3]), (None, 1, vectors[5]), (None, 0, vectors[6]), (2000, 1, vectors[2][:3]), (2001, 0, []), (2002, 2, [1e6, *vectors[1][1:]])]
    anchors = [row for row in rows if row[0] is not None and row[0] % 50 == 0]
    assert _mined(spark, rows, anchors) == sorted(_plain(rows, anchors), key=_key)
    assert _mined(spark, rows, anchors, block=5) == sorted(_plain(rows, anchors), key=_key)


def test_negatives_of_nothing(spark):
    rows = [(0, 1, [1.0, 2.0]), (50, 1, [1.0, 1.0])]
    assert _mined(spark, [], []) == [] and _mined(spark, rows, []) == [] and _mined(spark, rows, rows) == []
    frame = spark.createDataFrame([([1.0, None],), ([float("nan")],), ([float("inf")],), (None,), ([0.5],), ([],)], "v array<double>")
    assert [row[0] for row in frame.select(hard_negatives.usable(F.col("v"))).collect()] == [False, False, False, False, True, True]


def test_the_tree_passes_over_boxes_and_loses_nothing():
    # Clusters far apart: boxes below the k-th best, and outside the windows, stay closed.
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 300, (40, 8))
    vectors = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(0, 5, (4000, 8)))
    labels, ids = np.arange(4000) % 2, rng.permutation(4000)
    column = pa.ListArray.from_arrays(pa.array(np.arange(4001, dtype=np.int32) * 8), pa.array(vectors.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), column], names=["id", "label", "vector"])
    tree = list(hard_negatives._packer([0, 1, 2], 8)(iter([batch])))
    anchors = np.arange(0, 4000, 400)
    query = hard_negatives.Query(ids[anchors], labels[anchors], vectors[anchors], np.full((10, 1), -np.inf), np.full((10, 1), np.inf), 5, True)
    best = hard_negatives.Best(query)
    opened = sum(hard_negatives.search(query, best, part, at) for part in tree for at in range(part.num_rows))
    assert opened < 0.25 * 10 * -(-4000 // hard_negatives.LEAF)
    for i, anchor in enumerate(anchors):
        score = vectors @ vectors[anchor]
        others = [j for j in range(4000) if labels[j] == labels[anchor] and j != anchor]
        want = sorted((-score[j], ids[j]) for j in others)[:5]
        assert [(-s, int(k)) for s, k in zip(best.score[i, 0], best.id[i, 0])] == want


def test_a_trie_tells_whole_texts_apart():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(3000)] + ["ää".encode(), "äö".encode(), b""]
    trie = filter_audit.Trie()
    for at, text in enumerate(texts):
        trie.insert(text, None if at % 7 == 0 else 5000 - at, at)
    groups = sorted(sorted(node.members) for node in trie.terminals())
    want = {}
    for at, text in enumerate(texts):
        want.setdefault(text, []).append(at)
    assert groups == sorted(want.values())
    assert all(node.least == min((5000 - at for at in node.members if at % 7), default=None) for node in trie.terminals())


def _duplicates(rows):
    least = {}
    for doc_id, text in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    return sorted((doc_id is None, doc_id or 0, doc_id is not None and least[text or ""] < doc_id) for doc_id, text in rows)


@pytest.mark.parametrize("cell", [1, 64, 1 << 20])
def test_duplicates_over_cells_of_any_size(spark, cell):
    rng = random.Random(2)
    long = "the same opening of many texts " * 9
    pool = [None, "", "a", "ab", "abc", "é", "é!", "x" * 5000, "x" * 5000 + "y"] + [long + str(i) for i in range(40)] + ["".join(rng.choice("abc") for _ in range(6)) for _ in range(60)]
    rows = [(i if i % 13 else None, rng.choice(pool)) for i in range(500)] + [(5, "a"), (5, "a"), (6, "two texts of one id")]
    docs = spark.createDataFrame([(*row, "en") for row in rows], "doc_id long, text string, lang string").repartition(5)
    got = sorted((row["doc_id"] is None, row["doc_id"] or 0, row["mask"] & filter_audit.E > 0) for row in filter_audit.judged(docs, cell).collect())
    assert got == _duplicates(rows)


def test_audit_of_odd_rows(spark, odd_docs, no_docs, odd_labels):
    got = filter_audit.audit(odd_docs, odd_labels).collect()
    parts = {row["lang"] or "" for row in odd_docs.collect()}
    assert len(got) == len(parts) * 600 and {row["part"] for row in got} == parts
    first = {(row["part"], row["filter_order"][0]): row["removed"] for row in got if row["step"] == 1}
    for part in parts:
        n = sum((row["lang"] or "") == part for row in odd_docs.collect())
        for order in itertools.permutations("ABCDE"):
            rows = [row for row in got if row["part"] == part and row["filter_order"] == "".join(order)]
            assert sum(row["removed"] for row in rows) + min(row["kept"] for row in rows) == n
        for letter in "ABCDE":
            shapley = {row["shapley"] for row in got if row["part"] == part and row["filter_order"][row["step"] - 1] == letter}
            assert shapley == {sum(row["removed"] for row in got if row["part"] == part and row["filter_order"][row["step"] - 1] == letter)}
    assert first[("en", "A")] >= 4 and filter_audit.audit(no_docs, odd_labels).count() == 0


def test_licences_of_odd_rows(spark, odd_docs, no_docs):
    assert license_scan.license_scan(odd_docs).count() == odd_docs.count() and license_scan.license_scan(no_docs).count() == 0
    mit = next(one.text for one in license_scan.TEMPLATES if one.text.startswith("permission is hereby granted free of charge to any person obtaining"))
    told = [(1, "GNU General  Public-License; MIT license\nMIT LICENSE"), (2, mit.upper()), (3, "word " * 40 + mit.replace("merge publish", "merge and then publish") + " word" * 40), (4, "mit the license"),
            (5, None), (6, "gnu general public"), (7, "MIT lıcense"), (8, "permission is hereby granted free of charge"), (9, "This work is licensed under the GNU General Public License, version 3."), (10, mit)]
    docs = spark.createDataFrame([(*row, "w", 3) for row in told], "doc_id long, text string, word string, row int")
    got = {row["doc_id"]: row for row in license_scan.license_scan(docs).collect()}
    assert tuple(got[1])[1:6] == (8, 3, 0, 6, "gpl,mit") and got[1]["score"] == 1.0
    assert [got[i]["labels"] for i in (2, 3, 4, 5, 6, 7, 8, 10)] == ["mit", "mit", "", "", "", "", "", "mit"]
    assert got[5]["n_words"] == 0 and got[5]["first_word"] is None and got[5]["score"] == 0 and 0 < got[3]["score"] <= 1
    assert got[9]["base_labels"] == "gpl" and got[9]["labels"] == "gpl,gpl-3.0" and got[7]["n_words"] == 2


def test_the_small_tables_agree_with_sql(spark, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name in ("op11_hard_negatives", "op12_filter_audit", "op13_license_scan"):
        frame, want = queries.QUERIES[name](spark, sf_dir), con.execute(queries.ORACLES[name])
        columns = [item[0] for item in want.description]
        assert sorted(map(repr, (tuple(row) for row in frame.select(columns).collect()))) == sorted(map(repr, want.fetchall())), name
