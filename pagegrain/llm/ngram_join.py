"""Near-duplicate join of documents by the Jaccard similarity of their word n-grams, over a MinHash LSH forest.

Texts with the same set of n-grams form one class. Every class has ``trees`` signatures of ``depth`` minima each; a tree is the
sorted prefix trie of its signatures. Classes that share a prefix of the current length in any tree are candidates. The prefix
starts at ``depth`` and is shortened by one until the recall estimated from the verified links reaches the target: a verified
pair of similarity s shares a prefix of length d in some of t trees with probability p = 1 - (1 - s**d)**t, so each pair found
stands for 1/p pairs. Candidates are verified exactly on whole n-gram sets.

Pairs are never rows. Candidate classes are grouped by the connected parts of the candidate graph; a part too large for one
task is cut into blocks, and each pair of blocks is one task that answers with a link count per class and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import kept, small
from pagegrain.llm.components import components
from pagegrain.llm.textops import mix, pieces, signed

WORDS = 5
SIMILARITY = 0.8
TREES, DEPTH = 16, 8
RECALL = 0.99
# Classes in one block; a block pair needs memory for this many sets and a square matrix of this side.
BLOCK = 512
# Columns of one incidence matrix.
_COLUMNS = 8192


def _set_key(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = np.add.reduceat(mix(hashes), first)
    two = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
    return one, two


def _distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[new], docs[new]


def _minima(hashes: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """count x texts minima of multiply-shift hashes, cut to 16 bits of a second mix."""
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.empty((count, len(first)), np.uint32)
    for k in range(count):
        factor = mix(np.array([2 * k + 1], np.uint64))[0] | np.uint64(1)
        shift = mix(np.array([2 * k + 2], np.uint64))[0]
        value = (folded ^ np.uint32(shift >> np.uint64(32))) * np.uint32(factor & np.uint64(0xFFFFFFFF))
        out[k] = np.minimum.reduceat(value, first)
    return (mix(out) >> np.uint64(48)).astype(np.uint16)


def _signer(words: int, trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, to, piece in pieces(batch.column(1)):
                hashes, docs = _distinct(*piece.shingles(words))
                n = to - at
                sizes = np.bincount(docs, minlength=n)
                have = np.flatnonzero(sizes)
                first = np.concatenate([[0], np.cumsum(sizes[have])[:-1]]).astype(np.int64)
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                forest: list[bytes | None] = [None] * n
                if len(have):
                    one[have], two[have] = _set_key(hashes, first)
                    table = np.ascontiguousarray(_minima(hashes, first, trees * depth).T)
                    for row, doc in enumerate(have):
                        forest[doc] = table[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n), pa.array(signed(one)), pa.array(signed(two)), pa.array(sizes.astype(np.int32)), pa.array(forest, pa.binary())],
                    names=["doc_id", "key_a", "key_b", "n_grams", "forest"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, piece in pieces(batch.column(1)):
                hashes, docs = _distinct(*piece.shingles(words))
                n = to - at
                cut = np.searchsorted(docs, np.arange(n + 1))
                have = np.flatnonzero(np.diff(cut))
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(have):
                    one[have], two[have] = _set_key(hashes, cut[have])
                grams = [hashes[cut[i] : cut[i + 1]].tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(signed(one)), pa.array(signed(two)), pa.array(grams, pa.binary())],
                    names=["cid", "key_a", "key_b", "grams"])

    return run


def _collide(left: np.ndarray, right: np.ndarray, trees: int, depth: int, prefix: int) -> np.ndarray:
    """left x right: whether two signatures share a prefix of that length in some tree."""
    met = np.zeros((len(left), len(right)), bool)
    for tree in range(trees):
        same = np.ones_like(met)
        for level in range(prefix):
            column = tree * depth + level
            same &= left[:, column][:, None] == right[:, column][None, :]
            if not same.any():
                break
        met |= same
    return met


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """left x right: sizes of the intersections of sets of hashes, by products of incidence matrices over slices of the hashes
    that both sides have."""
    flat_l, flat_r = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(flat_l, flat_r)
    out = np.zeros((len(left), len(right)), np.float32)

    def places(sets, flat):
        owner = np.repeat(np.arange(len(sets)), [len(item) for item in sets])
        at = np.searchsorted(common, flat)
        at[at == len(common)] = 0
        hit = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        return owner[hit][order], at[hit][order]

    if not len(common):
        return out
    (own_l, at_l), (own_r, at_r) = places(left, flat_l), places(right, flat_r)
    for base in range(0, len(common), _COLUMNS):
        sides = []
        for own, at, size in ((own_l, at_l, len(left)), (own_r, at_r, len(right))):
            lo, hi = np.searchsorted(at, [base, base + _COLUMNS])
            matrix = np.zeros((size, min(_COLUMNS, len(common) - base)), np.float32)
            matrix[own[lo:hi], at[lo:hi] - base] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return out


def verify_pairs(left: list[np.ndarray], right: list[np.ndarray], met: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity where ``met``, else 0."""
    sizes_l, sizes_r = np.array([len(x) for x in left], np.float64), np.array([len(x) for x in right], np.float64)
    rows, columns = np.nonzero(met)
    score = np.zeros(met.shape)
    if len(rows) < 64:
        for i, j in zip(rows, columns):
            shared = len(np.intersect1d(left[i], right[j], assume_unique=True))
            score[i, j] = shared / (sizes_l[i] + sizes_r[j] - shared)
        return score
    use_l, use_r = np.unique(rows), np.unique(columns)
    shared = _shared([left[i] for i in use_l], [right[j] for j in use_r]).astype(np.float64)
    part = shared / (sizes_l[use_l][:, None] + sizes_r[use_r][None, :] - shared)
    score[np.ix_(use_l, use_r)] = part
    return np.where(met, score, 0.0)


def _linker(trees: int, depth: int, prefix: int, similarity: float):
    """One block pair of every part in the group: links counted per class, and enough of them to join what they connect."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        # Several rows of one doc_id may hold the same text.
        for (_, low, high), rows in group.drop_duplicates(["part", "low", "high", "cid"]).groupby(["part", "low", "high"], sort=False):
            sides = [rows[rows.block == low]] if low == high else [rows[rows.block == low], rows[rows.block == high]]
            if any(side.empty for side in sides):
                continue
            left, right = sides[0], sides[-1]
            signs = [np.frombuffer(b"".join(side.forest), np.uint16).reshape(len(side), -1) for side in (left, right)]
            met = _collide(signs[0], signs[1], trees, depth, prefix)
            if low == high:
                met = np.triu(met, 1)
            score = verify_pairs([np.frombuffer(x, np.uint64) for x in left.grams], [np.frombuffer(x, np.uint64) for x in right.grams], met)
            linked = score >= similarity
            ids_l, ids_r = left.cid.to_numpy(), right.cid.to_numpy()
            counts: dict[int, int] = {}
            for ids, axis in ((ids_l, 1), (ids_r, 0)):
                for cid, n in zip(ids.tolist(), linked.sum(axis=axis).tolist()):
                    if n:
                        counts[cid] = counts.get(cid, 0) + n
            out += [(cid, None, n, 0.0) for cid, n in counts.items()]
            i, j = np.nonzero(linked)
            if len(i):
                # For the recall estimate: how many pairs of such a similarity stand behind each one found.
                behind = 1 / (1 - (1 - score[i, j] ** prefix) ** trees)
                out.append((int(ids_l[i[0]]), None, 0, float(behind.sum() - len(i))))
                out += [(a, b, 0, 0.0) for a, b in _forest(ids_l[i], ids_r[j])]
        return pd.DataFrame(out, columns=["cid", "other", "links", "missed"]).astype({"cid": "int64", "other": "Int64", "links": "int64", "missed": "float64"})

    return run


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    chosen = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            chosen.append((a, b))
    return chosen


def _candidate_parts(classes: DataFrame, trees: int, depth: int, prefix: int) -> DataFrame:
    """(node, component) of the graph that ties every class to the least class it shares a prefix with, in each tree."""
    # A signature is trees x depth numbers of two bytes.
    keys = F.array(*[F.xxhash64(F.lit(tree), F.substring("forest", 2 * depth * tree + 1, 2 * prefix)) for tree in range(trees)])
    entries = classes.select("cid", F.explode(keys).alias("key"))
    shared = entries.groupBy("key").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return components(entries.join(shared, "key").select(F.col("cid").alias("a"), F.col("hub").alias("b")))


def _links(classes: DataFrame, parts: DataFrame, sets: DataFrame, trees: int, depth: int, prefix: int, similarity: float, block: int) -> DataFrame:
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = parts.join(sizes, "component").select(
        F.col("node").alias("cid"), F.col("component").alias("part"), F.ceil(F.col("n") / block).cast("int").alias("blocks"),
        F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block).cast("int")).cast("int").alias("block"))
    payload = members.join(classes.select("cid", "key_a", "key_b", "forest"), "cid").join(sets, ["cid", "key_a", "key_b"])
    paired = payload.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cid", "part", "block", "forest", "grams", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
        # Parts of one block share bins of a bounded expected size; a block pair of a large part has its own.
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("part"), F.lit(1 << 20))).otherwise(F.lit(-1)).alias("small"))
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paired = paired.withColumn("bin", F.when(F.col("small") >= 0, F.pmod(F.col("small"), F.lit(8 * tasks))).otherwise(F.xxhash64("part", "low", "high")))
    return paired.drop("small").groupBy("bin").applyInPandas(_linker(trees, depth, prefix, similarity), "cid long, other long, links long, missed double")


def ngram_join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH,
               recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, copy_id (the least doc_id with the same n-gram set), class_id (the least doc_id of its near-duplicate
    component), n_copies (documents of its copy class), n_links (other copy classes of at least that similarity).

    A null or wordless text has no n-grams: it is its own class, with one copy and no link. A text of fewer than ``words`` words is one
    n-gram of all its words. Rows without a doc_id are classes of nothing and come back with nulls. Repeated rows of one doc_id come back
    once each. Other columns are ignored; an empty table gives an empty result."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed_rows = kept(slim.mapInArrow(_signer(words, trees, depth), "doc_id long, key_a long, key_b long, n_grams int, forest binary"))
    classes = kept(signed_rows.where("forest IS NOT NULL AND doc_id IS NOT NULL").groupBy("key_a", "key_b").agg(
        F.min("doc_id").alias("cid"), F.count(F.lit(1)).alias("n_copies"), F.first("forest").alias("forest")))
    # With one document per candidate class, sets are made only for those.
    prefix, found = depth, None
    while True:
        parts = kept(_candidate_parts(classes, trees, depth, prefix))
        near = small(parts.select(F.col("node").alias("doc_id")))
        sets = slim.join(near, "doc_id", "left_semi").mapInArrow(_sets(words), "cid long, key_a long, key_b long, grams binary")
        found = kept(_links(classes, parts, sets, trees, depth, prefix, similarity, block))
        seen = found.agg(F.sum("links"), F.sum("missed")).head()
        pairs, missed = (seen[0] or 0) / 2, seen[1] or 0.0
        if prefix == 1 or pairs >= recall * (pairs + missed):
            break
        prefix -= 1
    edges = found.where("other IS NOT NULL").select(F.col("cid").alias("a"), F.col("other").alias("b"))
    labels = components(edges).select(F.col("node").alias("cid"), F.col("component").alias("class_id"))
    counts = found.groupBy("cid").agg(F.sum("links").alias("n_links"))
    judged = classes.drop("forest").join(labels, "cid", "left").join(counts, "cid", "left")
    return signed_rows.drop("forest").join(judged, ["key_a", "key_b"], "left").select(
        "doc_id", F.coalesce("cid", "doc_id").alias("copy_id"), F.coalesce("class_id", "cid", "doc_id").alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
