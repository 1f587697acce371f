"""Hard negatives by exact inner product over an STR-packed R-tree.

1. Rows are range-partitioned by label and the widest coordinate; each task packs its slab by sort-tile-recursive on the next
   coordinates: leaves of ``LEAF`` rows, subtrees of ``TILE`` rows. A subtree is one row of the index: its leaves' minimum bounding
   boxes, labels, ids and vectors. Equal vectors share boxes without extent, cut by id.
2. Anchors are taken in blocks of a bounded number, each block broadcast once and held against every subtree. A box gives the
   interval of the inner products that it can hold, coordinate by coordinate. From root to leaf, boxes outside every score window,
   or strictly below the k-th best found, are passed over; of what is left each anchor opens its best boxes first.
3. Every task answers with k rows an anchor and window, which Spark ranks.

A pass over the index costs reading it once; anchors are never joined with rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegrain.llm.common import kept
from pagegrain.session import checkpoint_dir

LEAF, FANOUT, TILE = 64, 8, 4096
# Rows that one task packs, about; coordinates that a slab is tiled by; anchors of one pass.
SLAB, AXES, ANCHORS = 65_536, 3, 16_384
POSITIVES, NEGATIVES = 5, 3
# A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
# Stands for a missing id, after all others.
_NO_ID = np.iinfo(np.int64).max
_INDEX = "label_low long, label_high long, least_id long, n int, dim int, ids binary, labels binary, low binary, high binary, vectors binary"
_FOUND = "at int, slot int, score double, id long"


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components; a null vector has none."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _distinct(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are equal in every respect, once."""
    whole = np.ascontiguousarray(np.column_stack([ids, labels, (vectors + 0.0).view(np.int64)]))
    _, first = np.unique(whole.view([("", whole.dtype)] * whole.shape[1]).ravel(), return_index=True)
    return ids[first], labels[first], vectors[first]


def _tiled(vectors: np.ndarray, ids: np.ndarray, axes: list[int]) -> np.ndarray:
    """Sort-tile-recursive order of one label's rows: slabs along the first axis, tiled along the next ones; equal places go by id."""
    if len(axes) <= 1 or len(ids) <= LEAF:
        return np.lexsort((ids, *(vectors[:, axis] for axis in reversed(axes))))
    leaves = -(-len(ids) // LEAF)
    slabs = int(np.ceil(leaves ** (1 / len(axes))))
    size = -(-leaves // slabs) * LEAF
    order = np.lexsort((ids, *(vectors[:, axis] for axis in reversed(axes))))
    return np.concatenate([part[_tiled(vectors[part], ids[part], axes[1:])] for part in (order[at : at + size] for at in range(0, len(order), size))])


def _packer(axes: list[int], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                parts.append(_distinct(ids, batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2), dim)))
        if not parts:
            return
        ids, labels, vectors = _distinct(*(np.concatenate(side) for side in zip(*parts)))
        del parts
        order = np.argsort(labels, kind="stable")
        runs = np.split(order, np.flatnonzero(np.diff(labels[order])) + 1)
        order = np.concatenate([part[_tiled(vectors[part], ids[part], axes)] for part in runs])
        for at in range(0, len(order), TILE):
            rows = order[at : at + TILE]
            first = np.arange(0, len(rows), LEAF)
            block = vectors[rows]
            small = np.abs(block).max(initial=0) < 2**15 and (block == np.floor(block)).all()
            kind = np.int16 if small else np.float64
            low, high = np.minimum.reduceat(block, first), np.maximum.reduceat(block, first)
            yield pa.RecordBatch.from_pylist([{
                "label_low": int(labels[rows].min()), "label_high": int(labels[rows].max()), "least_id": int(ids[rows].min()), "n": len(rows), "dim": dim,
                "ids": ids[rows].tobytes(), "labels": labels[rows].tobytes(), "low": low.astype(kind).tobytes(), "high": high.astype(kind).tobytes(),
                "vectors": block.astype(kind).tobytes()}], schema=_ARROW_INDEX)

    return run


_ARROW_INDEX = pa.schema([("label_low", pa.int64()), ("label_high", pa.int64()), ("least_id", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()),
                          *[(name, pa.binary()) for name in ("ids", "labels", "low", "high", "vectors")]])


def _axes(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Number of rows, dimension, and the coordinates by falling variance; one row a coordinate and task comes together."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            dim = int(sizes.max(initial=0))
            matrix = _matrix(column, dim)
            total = sums.setdefault(dim, np.zeros((3, max(dim, 1))))
            total[0] += len(sizes)
            if dim:
                total[1] += matrix.sum(axis=0)
                total[2] += (matrix**2).sum(axis=0)
        for dim, total in sums.items():
            n = max(dim, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dim)), pa.array(np.arange(n)), *(pa.array(x) for x in total)], names=["dim", "at", "n", "s", "ss"])

    found = rows.select("vector").mapInArrow(moments, "dim long, at long, n double, s double, ss double").groupBy("at").agg(
        F.max("dim").alias("dim"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).toPandas()
    if found.empty:
        return 0, 0, []
    n, dim = int(found.n.max()), max(int(found.dim.max()), 1)
    found["spread"] = found.ss / n - (found.s / n) ** 2
    order = found.sort_values(["spread", "at"], ascending=[False, True])["at"].astype(int).tolist()
    return n, dim, order[:AXES]


def pack(rows: DataFrame) -> tuple[DataFrame, int]:
    """The index of ``rows`` (id long, label long, vector array<double>) and the vectors' dimension; every row is in it."""
    n, dim, axes = _axes(rows)
    # Labels and places first, then content: a hot label is cut by place, equal vectors by id.
    keys = [F.get("vector", F.lit(axis)) for axis in axes]
    dealt = rows.repartitionByRange(max(1, -(-n // SLAB)), "label", *keys, F.xxhash64("vector"), "id")
    return kept(dealt.select("id", "label", "vector").mapInArrow(_packer(axes, dim), _INDEX)), dim


@dataclass
class Query:
    """Anchors of one block: their ids, labels and vectors, and the score windows (anchor x slot) with how many rows each wants.

    ``same``: rows of the anchor's label are searched, else those of the others. A window that is not there begins above its end."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    k: int
    same: bool


class Best:
    """The k best (score, id) found for every anchor and slot; higher scores first, then smaller ids."""

    def __init__(self, query: Query):
        shape = (*query.low.shape, query.k)
        self.score, self.id = np.full(shape, -np.inf), np.full(shape, _NO_ID)
        self.k, self.slots = query.k, shape[1]

    def add(self, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group = anchor * self.slots + slot
        touched = np.unique(group)
        at, to = np.divmod(touched, self.slots)
        group = np.concatenate([np.repeat(touched, self.k), group])
        score, ids = np.concatenate([self.score[at, to].ravel(), score]), np.concatenate([self.id[at, to].ravel(), ids])
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.searchsorted(group, touched)
        places = first[:, None] + np.arange(self.k)
        self.score[at, to], self.id[at, to] = score[places], ids[places]


def _bounds(query: Query, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors x boxes: the least and the greatest inner product that a box can hold."""
    up, down = np.maximum(query.vectors[rows], 0), np.minimum(query.vectors[rows], 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


def _wanted(query: Query, best: Best, rows: np.ndarray, low: np.ndarray, high: np.ndarray, least_id: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors x boxes: whether a box may hold a row that is still wanted, and the best score it may have."""
    own = query.labels[rows][:, None]
    fits = (labels[0] <= own) & (own <= labels[1]) if query.same else (labels[0] != own) | (labels[1] != own)
    want, most = np.zeros(low.shape, bool), np.full(low.shape, -np.inf)
    for slot in range(query.low.shape[1]):
        start, end = query.low[rows, slot][:, None], query.high[rows, slot][:, None]
        kth, kth_id = best.score[rows, slot, -1][:, None], best.id[rows, slot, -1][:, None]
        reach = np.minimum(high, end)
        ok = fits & (high >= start) & (low <= end) & (start <= end) & ((reach > kth) | ((reach == kth) & (least_id < kth_id)))
        want |= ok
        most = np.where(ok, np.maximum(most, reach), most)
    return want, most


def _read(batch: pa.RecordBatch, at: int) -> tuple:
    row = {name: batch.column(place)[at].as_py() for place, name in enumerate(_ARROW_INDEX.names)}
    n, dim = row["n"], row["dim"]
    kind = np.int16 if len(row["vectors"]) == 2 * n * dim else np.float64
    shaped = [np.frombuffer(row[name], kind).astype(np.float64).reshape(-1, dim) for name in ("low", "high", "vectors")]
    return row, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), *shaped


def search(query: Query, best: Best, batch: pa.RecordBatch, at: int) -> int:
    """Takes one subtree into ``best``; how many leaves were opened, counted per anchor."""
    row, ids, labels, low, high, vectors = _read(batch, at)
    everyone, opened = np.arange(len(query.ids)), 0
    starts = np.arange(0, len(ids), LEAF)

    def level(anchors, boxes_low, boxes_high, size):
        first = np.arange(0, len(ids), size)
        kinds = np.minimum.reduceat(labels, first), np.maximum.reduceat(labels, first)
        return _wanted(query, best, anchors, *_bounds(query, anchors, boxes_low, boxes_high), np.minimum.reduceat(ids, first), kinds)

    alive = np.flatnonzero(level(everyone, low.min(axis=0, keepdims=True), high.max(axis=0, keepdims=True), len(ids))[0][:, 0])
    if not len(alive):
        return 0
    groups = np.arange(0, len(starts), FANOUT)
    inner, _ = level(alive, np.minimum.reduceat(low, groups), np.maximum.reduceat(high, groups), LEAF * FANOUT)
    some = inner.any(axis=1)
    alive, inner = alive[some], inner[some]
    if not len(alive):
        return 0
    parents = np.repeat(inner, FANOUT, axis=1)[:, : len(starts)]
    reach = _bounds(query, alive, low, high)
    least, kinds = np.minimum.reduceat(ids, starts), (np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts))
    left, step = parents, 1
    while True:
        want, most = _wanted(query, best, alive, *reach, least, kinds)
        left = left & want
        if not left.any():
            return opened
        # The queue of each anchor: the best boxes that are left, more of them every time.
        most = np.where(left, most, -np.inf)
        nth = min(step, most.shape[1])
        edge = -np.partition(-most, nth - 1, axis=1)[:, nth - 1]
        now = left & (most >= edge[:, None])
        for leaf in np.flatnonzero(now.any(axis=0)):
            rows = np.flatnonzero(now[:, leaf])
            opened += len(rows)
            span = slice(starts[leaf], min(starts[leaf] + LEAF, len(ids)))
            _open(query, best, alive[rows], ids[span], labels[span], vectors[span])
        left &= ~now
        step *= 4


def _open(query: Query, best: Best, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
    score = query.vectors[anchors] @ vectors.T
    low, high = query.low[anchors], query.high[anchors]
    kth = best.score[anchors, :, -1]
    least = np.where(low <= high, np.maximum(low, kth), np.inf).min(axis=1)
    fits = labels[None, :] == query.labels[anchors][:, None]
    mask = (score >= least[:, None]) & (fits if query.same else ~fits)
    if query.same:
        itself = ids[None, :] == query.ids[anchors][:, None]
        for i, j in zip(*np.nonzero(itself & mask)):
            mask[i, j] = not np.array_equal(query.vectors[anchors[i]], vectors[j])
    i, j = np.nonzero(mask)
    value, own = score[i, j], ids[j]
    for slot in range(low.shape[1]):
        edge, edge_id = kth[i, slot], best.id[anchors[i], slot, -1]
        ok = (value >= low[i, slot]) & (value <= high[i, slot]) & ((value > edge) | ((value == edge) & (own < edge_id)))
        if ok.any():
            best.add(anchors[i[ok]], np.full(int(ok.sum()), slot), value[ok], own[ok])


def _run(index: DataFrame, query: Query) -> DataFrame:
    """at (the anchor's place in its block), slot, score, id: the best k of every task, ranked by Spark to the best k of all."""
    shared = index.sparkSession.sparkContext.broadcast(query)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Best(own)
        for batch in batches:
            for at in range(batch.num_rows):
                search(own, best, batch, at)
        at, slot, _ = found = np.nonzero(best.score > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(best.score[found]), pa.array(best.id[found])],
                                         names=["at", "slot", "score", "id"])

    ranked = Window.partitionBy("at", "slot").orderBy(F.desc("score"), "id")
    return index.mapInArrow(run, _FOUND).withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= query.k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor and each of its first ``positives`` rows of the same
    label, the first ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.

    ``rows`` and ``anchors``: id long, label long, vector array<double> of whole numbers; anchors are rows too. Scores are inner products, exact below
    2**53; higher ones come first, ties by smaller id. A shorter vector counts as ending in zeros. Rows equal in all three columns count once; rows that
    share an id and differ are rows of their own, and so are such anchors. A missing id comes after all others. Without a negative in its window a
    positive has no row (so has one of a negative score); empty tables give an empty result."""
    spark = rows.sparkSession
    index, dim = pack(rows)
    wanted = kept(anchors.select("id", "label", "vector").distinct())
    blocks = max(1, -(-wanted.count() // block))
    path = f"{checkpoint_dir(spark).rstrip('/')}/pagegrain-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for nth in range(blocks):
        got = wanted.where(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)) == nth).toArrow()
        if not got.num_rows or not dim:
            continue
        ids = got.column("id").combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        labels, vectors = got.column("label").combine_chunks().to_numpy(zero_copy_only=False), _matrix(got.column("vector"), dim)
        nothing = np.full((len(ids), 1), np.inf)
        near = _run(index, Query(ids, labels, vectors, -nothing, nothing, positives, True)).orderBy("at", "nth").toPandas()
        start, end = np.full((len(ids), positives), np.inf), np.full((len(ids), positives), -np.inf)
        at, slot, score = near["at"].to_numpy(), near["nth"].to_numpy() - 1, near["score"].to_numpy()
        start[at, slot], end[at, slot] = np.ceil(score * low / 100), np.floor(score * high / 100)
        found = _run(index, Query(ids, labels, vectors, start, end, negatives, False))
        named = spark.createDataFrame(pd.DataFrame({"at": at, "slot": slot, "anchor_id": ids[at], "positive_id": near["id"], "positive_score": score.astype(np.int64)}),
                                      "at int, slot int, anchor_id long, positive_id long, positive_score long")
        joined = found.join(F.broadcast(named), ["at", "slot"])

        def name(column: str) -> Column:
            return F.nullif(F.col(column), F.lit(_NO_ID))

        joined.select(name("anchor_id").alias("anchor_id"), name("positive_id").alias("positive_id"), F.col("nth").alias("rank"), name("id").alias("negative_id"),
                      "positive_score", F.col("score").cast("long").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
