"""Audit of how filters overlap: which filter removes what in every order, with exact duplicates found by radix tries.

1. Every task judges whole texts by the plain filters and inserts the texts of each batch into a compressed trie, whose terminals
   hold the least id; so a text that repeats within a batch travels once.
2. The texts that are left are range-partitioned by adaptive prefixes: a prefix shared by more than ``CELL`` bytes of text is made
   longer, until every cell fits. Each cell is one compressed trie of whole texts; its terminals' least ids come back to the batches.
3. The filters a document fails are one mask. Documents are counted by part and mask, and every order is read off these counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import kept, small
from pagegrain.llm.textops import pieces

FILTERS = "ABCDE"
A, B, C, D, E = (1 << at for at in range(5))
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "#$%&*|"
# Bytes of text of one trie, about, and the first prefix in characters; a prefix that is too common is made so many times longer.
CELL, PREFIX, LONGER = 16 << 20, 4, 4


class Trie:
    """A compressed trie of byte strings. An edge carries a run of bytes, a terminal the least id of its texts and who they were."""

    __slots__ = ("run", "edges", "least", "members")

    def __init__(self, run: bytes = b""):
        self.run, self.edges, self.least, self.members = run, {}, None, None

    def insert(self, text: bytes, least: int | None, member: int) -> Trie:
        node, at, size = self, 0, len(text)
        while at < size:
            edge = node.edges.get(text[at])
            if edge is None:
                edge = node.edges[text[at]] = Trie(text[at:])
                node = edge
                break
            run = edge.run
            if not text.startswith(run, at):
                # The edge is cut where the text leaves it.
                shared = _shared(run, text, at)
                upper = Trie(run[:shared])
                edge.run = run[shared:]
                upper.edges[edge.run[0]] = edge
                node.edges[text[at]] = edge = upper
            node = edge
            at += len(edge.run)
        if node.members is None:
            node.members = []
        node.members.append(member)
        if least is not None and (node.least is None or least < node.least):
            node.least = least
        return node

    def terminals(self) -> Iterator[Trie]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.members is not None:
                yield node
            stack.extend(node.edges.values())


def _shared(run: bytes, text: bytes, at: int) -> int:
    """How many bytes of ``run`` the text goes on with at ``at``; they differ somewhere, or the text ends inside the run."""
    low, high = 1, min(len(run), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(run[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(char) for char in SYMBOLS]] = True


def _masks(piece, data: np.ndarray) -> np.ndarray:
    """The plain filters each text fails. Distinct words are told apart by hashes of 64 bits."""
    borders = piece.borders
    n = len(borders) - 1
    words = np.diff(piece.first)
    hashes = piece.hashes()
    order = np.lexsort((hashes, piece.doc))
    hashes, docs = hashes[order], piece.doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    distinct = np.bincount(docs[new], minlength=n)

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[borders[1:]] - total[borders[:-1]]

    points, capitals, symbols = count((data & 0xC0) != 0x80), count((data >= 65) & (data <= 90)), count(_SYMBOL[data])
    return ((words < MIN_WORDS) * A + (100 * distinct < DISTINCT_PERCENT * words) * B + (100 * capitals > CAPITAL_PERCENT * points) * C + (symbols > 0) * D).astype(np.int32)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: doc_id, part, mask, key (of its text in the batch), least (id with that text in the batch), text (once a key)."""
    key = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids, trie, masks, n = batch.column(0).to_pylist(), Trie(), [], 0
        firsts: list[bytes | None] = [None] * batch.num_rows
        for at, to, piece in pieces(batch.column(2), lower=False):
            masks.append(_masks(piece, piece.data))
            raw, borders = piece.data.tobytes(), piece.borders.tolist()
            for row in range(at, to):
                text = raw[borders[row - at] : borders[row - at + 1]]
                if len(trie.insert(text, ids[row], row).members) == 1:
                    firsts[row] = text
        keys, least = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows
        for terminal in trie.terminals():
            for row in terminal.members:
                keys[row], least[row] = key + n, terminal.least
            n += 1
        key += n
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.concatenate(masks)), pa.array(keys), pa.array(least, pa.int64()), pa.array(firsts, pa.binary()).cast(pa.string())],
                names=["doc_id", "part", "mask", "key", "least", "text"])


def _cells(texts: DataFrame, cell: int) -> DataFrame:
    """``texts`` (with a text) and their ``cell``: the shortest prefix of the ladder that few enough bytes of text share."""
    length = F.octet_length("text")
    total = texts.agg(F.sum(length)).head()[0] or 0
    done, chosen, size = texts, F.lit(None).cast("string"), PREFIX
    levels: list[Column] = []
    while True:
        prefix = F.substring("text", 1, size)
        name = f"crowded_{size}"
        within = done.where(levels[-1]) if levels else done
        # A text that ends within the prefix cannot be told from its equals by a longer one.
        crowded = within.groupBy(prefix.alias("prefix")).agg(F.sum(length).alias("bytes"), F.count(F.lit(1)).alias("n"), F.max(F.char_length("text")).alias("longest")).where(
            (F.col("bytes") > cell) & (F.col("n") > 1) & (F.col("longest") > size)).select("prefix", F.lit(True).alias(name)) if total > cell else None
        crowded = kept(crowded) if crowded is not None else None
        if crowded is None or crowded.isEmpty():
            return done.withColumn("cell", F.coalesce(chosen, prefix)).drop(*[column for column in done.columns if column.startswith("crowded_")])
        done = done.join(small(crowded.withColumnRenamed("prefix", "__prefix")), F.col("__prefix") == prefix, "left").drop("__prefix")
        open_ = F.col(name).isNotNull()
        chosen = F.coalesce(chosen, F.when(~open_, prefix))
        levels.append(open_)
        size *= LONGER


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and the least id of its text, where another batch holds a smaller one; rows come sorted by cell, and each cell is one trie."""
    cell, trie, known, changed = None, Trie(), {}, []

    def told() -> pa.RecordBatch:
        columns = [pa.array(side, pa.int64()) for side in (zip(*changed) if changed else ([], []))]
        changed.clear()
        return pa.RecordBatch.from_arrays(columns, names=["key", "first"])

    def close() -> None:
        changed.extend((key, terminal.least) for terminal in trie.terminals() if len(terminal.members) > 1 for key in terminal.members if known[key] != terminal.least)

    for batch in batches:
        for own, key, least, text in zip(*(column.to_pylist() for column in batch.columns)):
            if own != cell:
                close()
                cell, trie, known = own, Trie(), {}
            known[key] = least
            trie.insert(text, least, key)
        if len(changed) >= 8192:
            yield told()
    close()
    yield told()


def judged(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, part (lang; null counts as empty), mask: the filters that every row of ``docs`` fails, A to D of its own text, E if a smaller doc_id has
    the same text.

    A null text counts as empty: it fails A, and E behind a smaller id with no text. A row without a doc_id fails E never and makes no other row
    fail it; repeated rows fail alike. Other columns are ignored; an empty table gives an empty result."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = kept(slim.mapInArrow(_judge, "doc_id long, part string, mask int, key long, least long, text string"))
    texts = own.where("text IS NOT NULL").select("key", "least", "text")
    dealt = _cells(texts, cell).repartitionByRange("cell").sortWithinPartitions("cell")
    met = kept(dealt.select("cell", "key", "least", F.col("text").cast("binary").alias("text")).mapInArrow(_meet, "key long, first long"))
    joined = own.select("doc_id", "part", "mask", "key", "least").join(small(met), "key", "left")
    later = F.coalesce(F.coalesce("first", "least") < F.col("doc_id"), F.lit(False))
    return joined.select("doc_id", "part", F.when(later, F.col("mask") + E).otherwise(F.col("mask")).alias("mask"))


def tallied(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many rows of ``judged`` fail just these filters; a document is good or toxic if any of its labels says so."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    marked = masks.join(small(kept(marks.where("good + toxic > 0"))), "doc_id", "left")
    return marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def interactions(tally: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of what each step does, for every order of the filters; parts have all their rows, zeros included.

    A part has at most 2 ** len(filters) masks, so it is one short list; the bit of the n-th filter of ``filters`` is 1 << n."""
    orders = ["".join(order) for order in itertools.permutations(filters)]
    parts = tally.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    ordered = parts.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))

    letters = F.split("filter_order", "")
    value = F.create_map(*[F.lit(item) for at, name in enumerate(filters) for item in (name, 1 << at)])
    bits = ordered.withColumn("bits", F.transform(letters, lambda letter: value[letter])).select(
        "part", "filter_order", "step", "masks", F.get("bits", F.col("step") - 1).alias("own"),
        F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda total, one: total + one).alias("before"))

    def total(of: str, holds) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda found, x: found + F.when(holds(x["mask"]), x[of]).otherwise(F.lit(0).cast("long")))

    own, before = F.col("own"), F.col("before")

    def hit(mask: Column) -> Column:
        return mask.bitwiseAND(own) != 0

    def fresh(mask: Column) -> Column:
        return mask.bitwiseAND(before) == 0

    # A document that fails k filters is removed by each of them in one k-th of all orders.
    share = F.aggregate("masks", F.lit(0).cast("long"), lambda found, x: found + F.when(hit(x["mask"]), (x["n"] * F.lit(len(orders)) / F.bit_count(x["mask"])).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n", lambda mask: mask.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"), total("n", lambda mask: hit(mask) & fresh(mask)).alias("removed"),
        total("n", lambda mask: hit(mask) & ~fresh(mask)).alias("redundant"), total("n", lambda mask: mask == own).alias("unique_fails"),
        total("good", lambda mask: hit(mask) & fresh(mask)).alias("good_lost"), total("toxic", lambda mask: hit(mask) & fresh(mask)).alias("toxic_lost"),
        share.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, cell: int = CELL) -> DataFrame:
    """The interactions of all filters over ``docs``, per part. ``labels``: doc_id, quality, toxic; rows without an id count for nothing."""
    return interactions(kept(tallied(judged(docs, cell), labels)))
