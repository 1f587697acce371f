"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are whole words (letters and digits, lower-cased) and openings of four to six bytes. Every word of the examples (a bounded sample of
labelled documents) is a dimension, and so is every opening that tells their labels apart; document frequencies are counted over all documents. A
term's weight is its IDF times how well it
tells the examples' labels apart: chi-squared against ``SIGNIFICANT``, squared, ``FAINT`` at least, so a handful of words in a long text is not
drowned. Terms of many examples lie in a matrix by blocks of examples, the others in posting lists. A block's bound is made of its largest weight per
common term and of the exact sums over its posting lists; a block is opened only while its bound beats the k-th best similarity found, which leaves
the top k exact. The votes' share is calibrated by a logistic curve fitted on leave-one-out votes of the examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import kept, remainder
from pagegrain.llm.textops import Pieces, mix, pieces, signed

# The bound of the sample the labels are learnt from: documents per label.
EXAMPLES = 3000
# A term of this chi-squared (one degree of freedom) has its whole IDF as weight, one of no information this part of it.
SIGNIFICANT, FAINT = 15.0, 0.05
OPENINGS = (4, 5, 6)
NEIGHBOURS = 15
BLOCK = 64
# A term in this part of the examples, or more, is a column of the matrix. Documents that are searched for at once.
COMMON, TOGETHER = 1 / 16, 128
# Postings that are added up at once, about.
POSTINGS = 1 << 19
# Similarities are told apart to this precision.
EXACT = 5
EVIDENCE = 3
# Rows whose remainder by this many is 0 are held out.
FOLDS = 5


def _terms(piece: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(term, text) with every occurrence: whole words, and openings of words that are longer."""
    long = piece.ends - piece.starts
    found, docs = [piece.hashes()], [piece.doc]
    for size in OPENINGS:
        longer = long > size
        found.append(mix(piece.hashes(size)[longer] ^ np.uint64(size)))
        docs.append(piece.doc[longer])
    return np.concatenate(found), np.concatenate(docs)


def _placed(piece: Pieces, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place of the term in ``terms``, count), by text and then place; other terms are left out."""
    found, docs = _terms(piece)
    if not len(terms) or not len(found):
        return (np.zeros(0, np.int64),) * 3
    at = np.searchsorted(terms, found)
    at[at == len(terms)] = 0
    hit = terms[at] == found
    keys, counts = np.unique(docs[hit].astype(np.int64) * len(terms) + at[hit], return_counts=True)
    return *np.divmod(keys, len(terms)), counts


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece of the sample: term, whether it is a word (not an opening), how many texts of each label have it."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, to, piece in pieces(batch.column(0), letters=True):
            names = np.unique(_terms(piece)[0])
            docs, places, _ = _placed(piece, names)
            label = toxic[at:to][docs]
            sides = [np.bincount(places, side, len(names)).astype(np.int64) for side in (label, 1 - label)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(names)), pa.array(np.isin(names, piece.hashes())), *map(pa.array, sides)], names=["term", "word", "n_toxic", "n_clean"])


def _example_terms(names: np.ndarray):
    """Per example: doc_id, toxic, the places of its terms and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, piece in pieces(batch.column(1), letters=True):
                docs, places, counts = _placed(piece, names)
                cut = pa.array(np.searchsorted(docs, np.arange(to - at + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(values.astype(np.int32))) for values in (places, counts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), batch.column(2).slice(at, to - at), *lists], names=["doc_id", "toxic", "places", "counts"])

    return run


def _document_counts(names: np.ndarray):
    """Per task: in how many of its texts each of the terms is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            for _, _, piece in pieces(batch.column(0), letters=True):
                total += np.bincount(_placed(piece, names)[1], minlength=len(names))
        at = np.flatnonzero(total)
        for low in range(0, len(at), 1 << 16):
            part = at[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["place", "n"])

    return run


def telling(n_toxic: np.ndarray, n_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """The part of its IDF that a term weighs, by how many examples of each label have it."""
    a, b = n_toxic.astype(np.float64), n_clean.astype(np.float64)
    c, d = toxic - a, clean - b
    below = (a + b) * (c + d) * max(toxic, 1) * max(clean, 1)
    chi = (toxic + clean) * (a * d - b * c) ** 2 / np.where(below > 0, below, 1) * (below > 0)
    return np.clip((chi / _significant(toxic + clean)) ** 2, FAINT, 1.0)


def _significant(examples: int) -> float:
    return min(SIGNIFICANT, max(examples / 8, 1e-9))


def _telling_terms(sample: DataFrame, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample's words, and those of its openings that weigh more than the least, ascending; and the part of its IDF each weighs."""
    a, b = F.col("a"), F.col("b")
    c, d = F.lit(float(toxic)) - a, F.lit(float(clean)) - b
    below = (a + b) * (c + d) * F.lit(float(max(toxic, 1)) * max(clean, 1))
    chi = F.coalesce(F.lit(float(toxic + clean)) * (a * d - b * c) * (a * d - b * c) / F.nullif(below, F.lit(0.0)), F.lit(0.0))
    counted = sample.select("text", "toxic").mapInArrow(_term_counts, "term long, word boolean, n_toxic long, n_clean long").groupBy("term").agg(
        F.bool_or("word").alias("word"), F.sum("n_toxic").cast("double").alias("a"), F.sum("n_clean").cast("double").alias("b"))
    # Openings of no information say what their words say.
    found = counted.where(F.col("word") | (chi > _significant(toxic + clean) * FAINT**0.5)).select("term", "a", "b").toArrow()
    names = found.column("term").to_numpy().view(np.uint64)
    order = np.argsort(names)
    return names[order], telling(found.column("a").to_numpy()[order], found.column("b").to_numpy()[order], toxic, clean)


@dataclass
class Index:
    """terms, ascending, and their weights; examples (ordered so that alike ones share a block), their ids and labels; the matrix of common terms
    (``column`` of a term, or -1) with its largest weights per block; posting lists of the others."""

    terms: np.ndarray
    weight: np.ndarray
    ids: list
    labels: np.ndarray
    column: np.ndarray
    matrix: np.ndarray
    bounds: np.ndarray
    first: np.ndarray
    rows: np.ndarray
    values: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def build(cls, terms, weight, rows: list[tuple], prior: float, neighbours: int = NEIGHBOURS) -> Index:
        """rows: (id, label, term places, unit weights)."""
        rows = sorted(rows, key=lambda row: (int(row[2][int(np.argmax(row[3]))]) if len(row[2]) else -1, row[0]))
        owner = np.repeat(np.arange(len(rows)), [len(row[2]) for row in rows])
        places = np.concatenate([np.asarray(row[2], np.int64) for row in rows]) if rows else np.zeros(0, np.int64)
        values = np.concatenate([np.asarray(row[3], np.float32) for row in rows]) if rows else np.zeros(0, np.float32)
        frequency = np.bincount(places, minlength=len(terms))
        common = np.flatnonzero(frequency >= max(COMMON * len(rows), 2))
        column = np.full(len(terms), -1, np.int32)
        column[common] = np.arange(len(common))
        blocks = -(-len(rows) // BLOCK)
        matrix = np.zeros((blocks * BLOCK, len(common)), np.float32)
        dense = column[places] >= 0
        matrix[owner[dense], column[places[dense]]] = values[dense]
        bounds = matrix.reshape(blocks, BLOCK, len(common)).max(axis=1) if blocks else np.zeros((0, len(common)), np.float32)
        places, owner, values = places[~dense], owner[~dense], values[~dense]
        order = np.lexsort((owner, places))
        first = np.searchsorted(places[order], np.arange(len(terms) + 1))
        return cls(terms, weight, [row[0] for row in rows], np.array([row[1] for row in rows], np.float64), column, matrix, bounds, first, owner[order].astype(np.int32), values[order],
                   prior, neighbours)

    def nearest(self, docs: np.ndarray, places: np.ndarray, weights: np.ndarray, n: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """n x k rows and cosines of the k nearest examples that share a term, exact; ties go to the earlier row; places beyond are -1 and 0.

        ``docs``, ``places``, ``weights``: the texts' terms, by text; ``skip``: a row per text that does not count."""
        k, blocks, width = self.neighbours, len(self.bounds), len(self.matrix)
        best, who = np.zeros((n, k), np.float32), np.full((n, k), -1, np.int64)
        if not blocks or not n:
            return who, best
        dense = self.column[places] >= 0
        query = np.zeros((n, self.matrix.shape[1]), np.float32)
        query[docs[dense], self.column[places[dense]]] = weights[dense]
        docs, places, weights = docs[~dense], places[~dense], weights[~dense]
        listed = self._listed(docs, places, weights, n)
        limits = query @ self.bounds.T + listed.reshape(n, blocks, BLOCK).max(axis=2)
        left, step = limits > 0, 2
        while True:
            left &= limits >= best[:, -1:] - 2 * 10.0**-EXACT
            if not left.any():
                return who, best
            rank = np.where(left, limits, -1)
            nth = min(step, blocks)
            now = left & (rank >= -np.partition(-rank, nth - 1, axis=1)[:, nth - 1 : nth])
            for block in np.flatnonzero(now.any(axis=0)):
                some, span = np.flatnonzero(now[:, block]), slice(block * BLOCK, (block + 1) * BLOCK)
                score = np.round(query[some] @ self.matrix[span].T + listed[some, span], EXACT)
                own = np.broadcast_to(np.arange(block * BLOCK, (block + 1) * BLOCK), score.shape)
                if skip is not None:
                    score[own == skip[some][:, None]] = 0
                score, own = np.concatenate([best[some], score], axis=1), np.concatenate([who[some], np.where(score > 0, own, -1)], axis=1)
                order = np.lexsort((np.where(own < 0, width, own), -score), axis=1)[:, :k]
                best[some], who[some] = np.take_along_axis(score, order, axis=1), np.take_along_axis(own, order, axis=1)
            left &= ~now
            step *= 2

    def _listed(self, docs: np.ndarray, places: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """n x rows: the part of every cosine that the posting lists give, taken in runs of a bounded number of postings."""
        width, out = len(self.matrix), np.zeros((n, len(self.matrix)), np.float32)
        sizes = self.first[places + 1] - self.first[places]
        ends = np.cumsum(sizes)
        edges = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, POSTINGS)), len(sizes)))
        for low, high in zip(edges[:-1], edges[1:]):
            part, doc = sizes[low:high], docs[low:high]
            at = np.repeat(self.first[places[low:high]] - (np.cumsum(part) - part), part) + np.arange(part.sum())
            span = doc[-1] - doc[0] + 1
            sums = np.bincount(np.repeat((doc - doc[0]) * width, part) + self.rows[at], np.repeat(weights[low:high], part) * self.values[at], span * width)
            out[doc[0] : doc[-1] + 1] += sums.reshape(span, width).astype(np.float32)
        return out

    def votes(self, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The toxic share of the neighbours' votes, each worth its similarity squared, with one prior vote of small weight."""
        worth = np.where(rows >= 0, scores.astype(np.float64), 0.0) ** 2
        toxic = self.labels[np.maximum(rows, 0)] if len(self.labels) else np.zeros(rows.shape)
        return ((worth * toxic).sum(axis=1) + 0.1 * self.prior) / (worth.sum(axis=1) + 0.1)

    def score(self, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        share = np.clip(self.votes(rows, scores), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(share / (1 - share)) + self.shift)))

    def calibrate(self, shares: np.ndarray) -> None:
        """A logistic curve from the leave-one-out votes to the labels, each label weighing as often as it occurs among all documents."""
        n_toxic, n_clean = self.labels.sum(), (1 - self.labels).sum()
        if not n_toxic or not n_clean:
            return
        x = np.clip(shares, 1e-6, 1 - 1e-6)
        x = np.log(x / (1 - x))
        weight = np.where(self.labels > 0, self.prior / n_toxic, (1 - self.prior) / n_clean) * len(x)
        design = np.stack([x, np.ones_like(x)], axis=1)
        beta = np.array([1.0, 0.0])
        ridge = np.diag([0.5, 0.5])
        # Targets short of 0 and 1, so that labels the votes separate cleanly leave the curve finite.
        goal = np.where(self.labels > 0, (n_toxic + 1) / (n_toxic + 2), 1 / (n_clean + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge,
                                   design.T @ (weight * (goal - p)) - ridge @ (beta - np.array([1.0, 0.0])))
            beta = beta + step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = max(float(beta[0]), 0.05), float(beta[1])


def _vectors(piece: Pieces, terms: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term place, unit TF-IDF weight) of the texts' dimensions."""
    docs, places, counts = _placed(piece, terms)
    values = (1 + np.log(np.maximum(counts, 1))) * weight[places] if len(places) else np.zeros(0)
    length = np.sqrt(np.bincount(docs, values**2, minlength=len(piece.borders) - 1))
    return docs, places, (values / length[docs]).astype(np.float32) if len(docs) else values.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> Index:
    """The index of a bounded sample of the labelled documents outside the held-out fold: at most ``examples`` per label, by the order of a
    hash of their ids.

    Counts, the sample's terms and their document frequencies come to the driver; how many these are is bounded by the sample."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.select("doc_id").where(remainder(F.col("doc_id"), FOLDS) != 0).join(marks, "doc_id")
    totals = {row["toxic"]: row["n"] for row in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    first = [known.where(F.col("toxic") == label).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for label in (0, 1)]
    ids = kept(first[0].union(first[1]))
    sample = kept(texts.join(F.broadcast(ids), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"))
    sizes = {row["toxic"]: row["n"] for row in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    names, share = _telling_terms(sample, sizes.get(1, 0), sizes.get(0, 0))
    if not len(names):
        return Index.build(names, share, [], prior, neighbours)
    rows = sample.mapInArrow(_example_terms(names), "doc_id long, toxic int, places array<int>, counts array<int>").orderBy("doc_id").toArrow()
    toxic, lists = rows.column("toxic").to_numpy(), rows.column("places").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(sizes)), sizes)
    places, counts = lists.flatten().to_numpy(), rows.column("counts").combine_chunks().flatten().to_numpy()
    counted = texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_document_counts(names), "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(len(names))
    frequency[counted["place"].to_numpy()] = counted["n"].to_numpy()
    weight = (np.log((docs.count() + 1) / (frequency + 1)) + 1) * share
    values = (1 + np.log(counts)) * weight[places]
    length = np.sqrt(np.bincount(owner, values**2, minlength=len(sizes)))
    values, cut = (values / length[owner]).astype(np.float32), np.cumsum(np.append(0, sizes))
    # An example without a term is near nothing.
    whole = [(doc_id, int(label), places[cut[i] : cut[i + 1]], values[cut[i] : cut[i + 1]]) for i, (doc_id, label) in enumerate(zip(rows.column("doc_id").to_pylist(), toxic)) if sizes[i]]
    index = Index.build(names, weight, whole, prior, neighbours)
    index.calibrate(_own_votes(sample, index))
    return index


def _own_votes(sample: DataFrame, index: Index) -> np.ndarray:
    """The votes for every example by the others, in the index's order."""
    shared = sample.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        at_row = {doc_id: at for at, doc_id in enumerate(own.ids)}
        for batch in batches:
            places = np.array([at_row.get(doc_id, -1) for doc_id in batch.column(0).to_pylist()], np.int64)
            for at, rows, near in _searched(batch.column(1), own, places):
                there = places[at : at + len(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(there[there >= 0]), pa.array(own.votes(rows, near)[there >= 0])], names=["at", "share"])

    shares = np.full(len(index.ids), index.prior)
    for row in sample.select("doc_id", "text").mapInArrow(run, "at long, share double").groupBy("at").agg(F.max("share").alias("share")).collect():
        shares[row["at"]] = row["share"]
    return shares


def _searched(texts: pa.Array, index: Index, skip: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, rows, cosines) of the nearest examples of a run of texts; ``skip``: see ``nearest``."""
    for at, to, piece in pieces(texts, letters=True):
        docs, places, weights = _vectors(piece, index.terms, index.weight)
        for low in range(at, to, TOGETHER):
            n = min(TOGETHER, to - low)
            span = slice(*np.searchsorted(docs, [low - at, low - at + n]))
            yield low, *index.nearest(docs[span] - (low - at), places[span], weights[span], n, None if skip is None else skip[low : low + n])


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score (0 to 1), predicted, evidence (the nearest examples: doc_id, toxic, similarity) for every row.

    A null or empty text, and one that shares no term with an example, has no neighbour: it gets the calibrated prior."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for low, rows, near in _searched(batch.column(1), own):
                scores = own.score(rows, near)
                evidence = [[{"doc_id": own.ids[r], "toxic": int(own.labels[r]), "similarity": s} for r, s in zip(found, values) if r >= 0]
                            for found, values in zip(rows[:, :EVIDENCE].tolist(), near[:, :EVIDENCE].astype(np.float64).round(EXACT).tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(rows)), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(evidence, kind)],
                                                 names=["doc_id", "score", "predicted", "evidence"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, predicted int, evidence array<struct<doc_id: long, toxic: int, similarity: double>>")


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, evidence.

    Without labels of both kinds every document gets the prior. Null texts count as empty; repeated rows are scored alike; a label row
    repeated for one document counts once (the larger label). Other columns are ignored; an empty table gives an empty result."""
    index = fit(docs, labels, examples, neighbours)
    return score(docs, index).withColumn("held_out", remainder(F.col("doc_id"), FOLDS) == 0)
