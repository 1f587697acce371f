"""Benchmark decontamination by latent semantic retrieval, with longest-common-subsequence and answer checks.

Terms are hashed to a fixed number of columns. Their document frequencies count every passage of the corpus. A randomised SVD of the
TF-IDF passages (range finder, one power step, Rayleigh-Ritz) is summed over Spark tasks; it is fitted on all passages of all
documents and benchmark items, and every window of every document is searched in it. Windows of a few lengths slide over the
whole text; a window's latent vector is the difference of two running sums. A window close to an item is a candidate; the
candidate's words and the item's are then compared by their longest common subsequence, and for paraphrases also the item's answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import kept, small
from pagegrain.llm.textops import pieces
from pagegrain.session import shuffles_removed

COLUMNS = 1 << 15
RANK = 64
# Words of one passage, for frequencies and the SVD.
PASSAGE = 48
COSINE = 0.6
# Share of an item's words found in order: enough alone, or enough when its answer is found too.
SAME, LIKE, ANSWER = 0.8, 0.6, 0.75
# Shorter items are no evidence.
LEAST_WORDS = 8
# Items searched in one pass over the corpus.
ITEMS_AT_ONCE = 20_000
_CHUNK = 256
_PIECE = 1 << 19
# Rows added in one run, and runs added together.
_RUN, _PART = 64, 512


def _columns(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(COLUMNS)).astype(np.uint16)


def _passages(piece, size: int) -> np.ndarray:
    """The passage of every word: consecutive runs of ``size`` words inside each text."""
    within = np.arange(len(piece.doc)) - piece.first[:-1][piece.doc]
    turn = within // size
    new = np.ones(len(turn), bool)
    new[1:] = (piece.doc[1:] != piece.doc[:-1]) | (turn[1:] != turn[:-1])
    return np.cumsum(new) - 1


def _cells(columns: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words in the order of their columns, inside a column by passage; where each distinct (column, passage) begins in it; how many words each has."""
    # Sorting 16-bit numbers is a radix sort, which keeps the passages in order.
    order = np.argsort(columns, kind="stable")
    column, turn = columns[order], passage[order]
    first = np.flatnonzero(np.append(True, (column[1:] != column[:-1]) | (turn[1:] != turn[:-1])))
    return order, first, np.diff(np.append(first, len(order)))


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros(COLUMNS, np.int64), 0
        for batch in batches:
            for _, _, piece in pieces(batch.column(0), letters=True):
                passage = _passages(piece, size)
                if len(passage):
                    columns = _columns(piece.hashes())
                    order, first, _ = _cells(columns, passage)
                    totals += np.bincount(columns[order[first]], minlength=COLUMNS)
                    n += int(passage[-1]) + 1
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(totals[some], n))], names=["term", "n"])

    return run


def _sums_of(rows: np.ndarray, pick: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``rows[pick]`` over the runs that begin at ``first``. Runs are cut into short ones; of as many as a processor's cache holds, longest
    first, the first rows are added at once, then the second ones, and so on."""
    ends, pick = np.append(first, len(pick)), pick.astype(np.intp)
    per = -(-np.diff(ends) // _RUN)
    own = np.cumsum(per) - per
    begin = np.repeat(ends[:-1] - own * _RUN, per) + np.arange(int(per.sum())) * _RUN
    size = np.minimum(np.repeat(ends[1:], per) - begin, _RUN)
    order = np.argsort((_RUN - size).astype(np.uint8), kind="stable")
    begin, size = begin[order], size[order]
    out, sums, read = np.empty((len(begin), rows.shape[1]), rows.dtype), *np.empty((2, _PART, rows.shape[1]), rows.dtype)
    for base in range(0, len(begin), _PART):
        at, left = begin[base : base + _PART], size[base : base + _PART]
        np.take(rows, pick[at], axis=0, mode="clip", out=sums[: len(at)])
        for k in range(1, int(left[0])):
            live = int(np.searchsorted(-left, -k))
            np.take(rows, pick[at[:live] + k], axis=0, mode="clip", out=read[:live])
            sums[:live] += read[:live]
        out[order[base : base + _PART]] = sums[: len(at)]
    if len(out) == len(first):
        return out
    found, many = out[own], np.flatnonzero(per > 1)
    cut = np.cumsum(per[many]) - per[many]
    found[many] = _sums_of(out, np.repeat(own[many] - cut, per[many]) + np.arange(int(per[many].sum())), cut)
    return found


def _gram(basis: np.ndarray, idf: np.ndarray, size: int):
    """Sums A' (A basis) over a task's passages, in chunks of columns. A passage's row of A has the TF-IDF weights of its words and unit length.

    A weight is the sum over a word's places of its column's idf, so both products are sums over places of rows that hold the idf already."""
    scaled, shape = (idf[:, None] * basis).astype(np.float32), basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros(shape, np.float32), False
        for batch in batches:
            for _, _, piece in pieces(batch.column(0), letters=True):
                if not len(piece.doc):
                    continue
                any_row = True
                passage, columns = _passages(piece, size), _columns(piece.hashes())
                order, first, counts = _cells(columns, passage)
                square = np.bincount(passage[order[first]], (counts * idf[columns[order[first]]]) ** 2)
                latent = _sums_of(scaled, columns, np.flatnonzero(np.append(True, passage[1:] != passage[:-1])))
                latent /= np.maximum(square, 1e-24).astype(np.float32)[:, None]
                at = columns[order]
                starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                total[at[starts]] += _sums_of(latent, passage[order], starts)
        if any_row:
            total *= idf[:, None].astype(np.float32)
            for base in range(0, len(total), _CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([base], pa.int64()), pa.array([total[base : base + _CHUNK].tobytes()], pa.binary())], names=["base", "sums"])

    return run


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(0, np.float32)
    for sums in group.sums:
        part = np.frombuffer(sums, np.float32)
        total = part + total if len(total) else part
    return pd.DataFrame({"base": [int(group.base.iloc[0])], "sums": [total.astype(np.float32).tobytes()]})


@dataclass
class Space:
    """idf per column and the projection (columns x rank) that already includes it."""

    idf: np.ndarray
    projection: np.ndarray


def fit(docs: DataFrame, items: DataFrame, rank: int = RANK, passage: int = PASSAGE, seed: int = 7) -> Space:
    texts = docs.select(F.col("text").cast("string").alias("text"))
    item_texts = items.select(F.col("text").cast("string").alias("text"))
    with shuffles_removed(docs.sparkSession):
        counted = texts.union(item_texts).mapInArrow(_frequencies(passage), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = {row["term"]: row["n"] for row in counted}
    n = counts.pop(-1, 0)
    frequency = np.zeros(COLUMNS)
    for term, k in counts.items():
        frequency[term] = k
    idf = np.log((n + 1) / (frequency + 1)) ** 2 + 0.01
    # Every task gives sums of the size of the space, so there are as many tasks as cores and not as the corpus has splits.
    every = texts.union(item_texts).coalesce(max(2, docs.sparkSession.sparkContext.defaultParallelism))

    def step(basis: np.ndarray) -> np.ndarray:
        out = np.zeros_like(basis)
        with shuffles_removed(docs.sparkSession):
            rows = every.mapInArrow(_gram(basis, idf, passage), "base long, sums binary").groupBy("base").applyInPandas(_add, "base long, sums binary").collect()
        for row in rows:
            part = np.frombuffer(row["sums"], np.float32).reshape(-1, basis.shape[1])
            out[row["base"] : row["base"] + len(part)] = part
        return out

    start = np.random.default_rng(seed).standard_normal((COLUMNS, rank)) / np.sqrt(COLUMNS)
    basis, _ = np.linalg.qr(step(start))
    image = step(basis)
    values, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
    # Every latent direction counts alike: with plain singular values a few directions (the languages) would decide every cosine.
    scale = 1 / np.sqrt(np.maximum(values, max(float(values.max(initial=0.0)), 1e-9) * 1e-4))
    return Space(idf, (idf[:, None] * (basis @ turn * scale)).astype(np.float32))


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None], 1e-9)


def common_words(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of an item (word -> bits of its places) and some words, one big-integer step per word."""
    full = (1 << size) - 1
    row = full
    for word in words:
        hit = masks.get(word, 0)
        if hit:
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return size - row.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for at, word in enumerate(words.tolist()):
        masks[word] = masks.get(word, 0) | (1 << at)
    return masks


def running_sums(rows: np.ndarray, run: int = 16) -> np.ndarray:
    """Sums of the first 0, 1, ... rows: whole rows are added, inside short runs first and then run by run."""
    n, width = rows.shape
    runs = -(-n // run)
    sums = np.zeros((runs * run + 1, width), rows.dtype)
    sums[1 : n + 1] = rows
    cells = sums[1:].reshape(runs, run, width)
    for k in range(1, run):
        cells[:, k] += cells[:, k - 1]
    ends = np.zeros((runs, width), rows.dtype)
    if runs > run:
        ends[:] = running_sums(cells[:, -1])[:runs]
    else:
        for k in range(1, runs):
            ends[k] = ends[k - 1] + cells[k - 1, -1]
    cells += ends[:, None]
    return sums[: n + 1]


class Search:
    def __init__(self, space: Space, items: list[Item]):
        self.space, self.items = space, items
        sizes = np.array([len(item.words) for item in items])
        # Length classes a factor of 1.6 apart; an item is searched with the windows of its class.
        self.classes: list[tuple[int, np.ndarray, np.ndarray]] = []
        ranks = np.floor(np.log(np.maximum(sizes, 1) / LEAST_WORDS) / np.log(1.6)).astype(int) if len(items) else sizes
        vectors = _unit(np.stack([space.projection[_columns(item.words)].sum(axis=0) for item in items])) if items else None
        for rank in np.unique(ranks):
            own = np.flatnonzero(ranks == rank)
            self.classes.append((int(np.median(sizes[own])), own, vectors[own].T.astype(np.float32)))
        self.own = [np.sort(item.words) for item in items]
        self.masks = [(_masks(item.words), _masks(item.answer)) for item in items]

    def windows(self, piece, hashes: np.ndarray) -> dict[tuple[int, int], list[list[int]]]:
        """(text, item) -> word ranges around close windows, merged where they touch."""
        found: dict[tuple[int, int], list[list[int]]] = {}
        sums = running_sums(np.take(self.space.projection, _columns(hashes).astype(np.intp), axis=0, mode="clip"))
        counts = np.diff(piece.first)
        for size, own, vectors in self.classes:
            stride = max(1, size // 3)
            # Windows start every stride words, and one ends each text.
            per = np.where(counts > 0, np.maximum(0, -(-(counts - size) // stride)) + 1, 0)
            doc = np.repeat(np.arange(len(counts)), per)
            turn = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            begin = piece.first[:-1][doc] + np.maximum(0, np.minimum(turn * stride, counts[doc] - size))
            end = np.minimum(begin + size, piece.first[1:][doc])
            for base in range(0, len(doc), 8192):
                part = slice(base, base + 8192)
                latent = np.take(sums, end[part], axis=0, mode="clip")
                latent -= np.take(sums, begin[part], axis=0, mode="clip")
                close = _unit(latent) @ vectors
                for at, which in zip(*(x.tolist() for x in np.divmod(np.flatnonzero(close >= COSINE), len(own)))):
                    at += base
                    text, item = int(doc[at]), int(own[which])
                    reach = len(self.items[item].words) // 2
                    low = max(int(piece.first[text]), int(begin[at]) - reach)
                    high = min(int(piece.first[text + 1]), int(end[at]) + reach)
                    ranges = found.setdefault((text, item), [])
                    if ranges and low <= ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], high)
                    else:
                        ranges.append([low, high])
        return found

    def verify(self, item: int, words: np.ndarray) -> tuple[float, float, bool]:
        """Shares of the item and of its answer found in order, and the verdict. Long ranges are read in overlapping spans twice the item's size."""
        size, answer = len(self.items[item].words), len(self.items[item].answer)
        best = (0.0, 0.0, False)
        span = 2 * size
        own_words = self.own[item]
        place = np.searchsorted(own_words, words)
        place[place == len(own_words)] = 0
        known = own_words[place] == words
        for base in range(0, max(1, len(words) - size), size):
            # Only the item's own words can be in a common subsequence.
            own = known[base : base + span]
            if own.sum() < LIKE * size:
                continue
            part = words[base : base + span][own].tolist()
            share = common_words(self.masks[item][0], size, part) / size
            found = common_words(self.masks[item][1], answer, part) / answer
            best = max(best, (share, found, share >= SAME or (share >= LIKE and found >= ANSWER)), key=lambda x: (x[2], x[0], x[1]))
        return best


def read_items(items: DataFrame) -> list[Item]:
    """Items with an id and enough words. The answer is the last sentence of the text, or its last eight words if that is longer or not set apart."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", F.col("text").cast("string").alias("text")).distinct().collect()
    out = []
    for row in rows:
        (_, _, piece), *_ = [*pieces(pa.array([row["text"]]), letters=True)]
        words = piece.hashes()
        if len(words) < LEAST_WORDS:
            continue
        ends = [m for m in range(len(row["text"].rstrip()) - 1) if row["text"][m] in ".!?\n"]
        tail = len([*pieces(pa.array([row["text"][ends[-1] + 1 :]]), letters=True)][0][2].doc) if ends else 8
        out.append(Item(row["item_id"], words, words[-min(max(tail, 3), 8) :]))
    return out


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = shared.value
        for batch in batches:
            for at, _, piece in pieces(batch.column(1), letters=True, limit=_PIECE):
                hashes = piece.hashes()
                rows = []
                for (text, item), ranges in search.windows(piece, hashes).items():
                    checks = [(search.verify(item, hashes[low:high]), low, high) for low, high in ranges]
                    (share, found, leak), low, high = max(checks, key=lambda x: (x[0][2], x[0][0], x[0][1]))
                    if leak:
                        base = int(piece.first[text])
                        rows.append((batch.column(0)[at + text].as_py(), search.items[item].item_id, share, found, low - base, high - base))
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64()),
                         pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64())],
                        names=["doc_id", "item_id", "item_share", "answer_share", "from_word", "to_word"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame, space: Space | None = None) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, item_share, answer_share, from_word, to_word (the words looked at).

    Words are runs of letters and digits, lower-cased. A null or empty text holds nothing; items without id or with fewer than eight words are
    no evidence; repeated rows of a document, or of an item, give one row. An empty side gives an empty result; other columns are ignored."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, item_share double, answer_share double, from_word long, to_word long"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    passes = -(-items.count() // ITEMS_AT_ONCE)
    if not passes:
        return spark.createDataFrame([], schema)
    space = space or fit(docs, items)
    out = None
    for turn in range(passes):
        some = read_items(items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn))
        part = slim.mapInArrow(_finder(spark.sparkContext.broadcast(Search(space, some))), schema)
        out = part if out is None else out.union(part)
    best = F.max(F.struct("item_share", "answer_share", "from_word", "to_word")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. Rows without a doc_id stay."""
    leaks = small(kept(find_leaks(docs, items).select(F.col("doc_id").alias("__leak")).distinct()))
    return docs.join(leaks, docs["doc_id"].cast("long") == F.col("__leak"), "left_anti")
