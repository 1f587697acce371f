"""Document quality by a convolutional network over bytes, trained and applied in numpy.

Bytes are embedded by a table per filter offset, so a convolution is a sum of table rows. A document is cut into chunks that
overlap by a filter's reach, so that every window of bytes lies in some chunk; each filter's largest response over a chunk, and then
over the document, together with its share of the document's windows, feeds a logistic output. Labels are learnt from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.llm.common import kept, remainder
from pagegrain.llm.textops import buffers

FOLDS = 5
# The bound of the sample the labels are learnt from: documents per label, and bytes read of all of them.
EXAMPLES, TRAIN_BYTES = 1500, 6_000_000
FILTERS, REACH = 16, 8
CHUNK = 4096
EPOCHS, RATE = 12, 0.02
THRESHOLD = 0.3


@dataclass
class Network:
    """table: offset x byte x filter; bias per filter; out: weights of the largest and the mean responses; out_b."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_b: float
    shift: float = 0.0

    @classmethod
    def fresh(cls, filters: int = FILTERS, reach: int = REACH, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        return cls((rng.standard_normal((reach, 256, filters)) * 0.3).astype(np.float32), np.zeros(filters, np.float32),
                   (rng.standard_normal(2 * filters) * 0.1).astype(np.float32), 0.0)

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Rectified responses of every window (windows x filters); zero bytes fill up data shorter than a window."""
        reach = len(self.table)
        data = padded(data, reach)
        n = len(data) - reach + 1
        total = self.table[0][data[:n]] + self.bias
        for offset in range(1, reach):
            total += self.table[offset][data[offset : offset + n]]
        return np.maximum(total, 0, out=total)

    def logit(self, best: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return np.concatenate([best, mean], axis=1) @ self.out + self.out_b


def padded(data: np.ndarray, reach: int) -> np.ndarray:
    return np.concatenate([data, np.zeros(reach - len(data), np.uint8)]) if len(data) < reach else data


def chunks(data: np.ndarray, reach: int, size: int = CHUNK) -> Iterator[np.ndarray]:
    """The whole of ``data`` in pieces of ``size`` bytes and the ``reach - 1`` after, at least one; a piece starts at a multiple of ``size``."""
    for base in range(0, max(1, len(data) - reach + 1), size):
        yield data[base : base + size + reach - 1]


def pooled(network: Network, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and mean response per filter over all chunks of one document."""
    best, total, n = np.zeros(len(network.bias), np.float32), np.zeros(len(network.bias)), 0
    for chunk in chunks(data, len(network.table)):
        got = network.responses(chunk)
        best, total, n = np.maximum(best, got.max(axis=0)), total + got.sum(axis=0), n + len(got)
    return best, (total / max(n, 1)).astype(np.float32)


def train(texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 13) -> Network:
    """Adam on the logistic loss, a step per document batch; the gradient of a largest response goes to the window that gave it."""
    network, rng = Network.fresh(), np.random.default_rng(seed)
    params = {"table": network.table, "bias": network.bias, "out": network.out, "out_b": np.zeros(1, np.float32)}
    m = {name: np.zeros_like(value) for name, value in params.items()}
    v = {name: np.zeros_like(value) for name, value in params.items()}
    reach, filters, turn = len(network.table), len(network.bias), 0
    steps = max(1, epochs * -(-len(texts) // 16))
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for base in range(0, len(order), 16):
            turn += 1
            g = {name: np.zeros_like(value) for name, value in params.items()}
            for i in order[base : base + 16]:
                data = padded(texts[i], reach)
                got = network.responses(data)
                top, n = got.argmax(axis=0), len(got)
                features = np.concatenate([got[top, np.arange(filters)], got.mean(axis=0)])
                p = 1 / (1 + np.exp(-np.clip(features @ network.out + params["out_b"][0], -30, 30)))
                d = np.float32((p - labels[i]) * weight[i] / 16)
                g["out"] += d * features
                g["out_b"] += d
                d_mean, d_top = d * network.out[filters:] / n, d * network.out[:filters]
                active = got > 0
                g["bias"] += d_mean * active.sum(axis=0) + d_top * active[top, np.arange(filters)]
                pull = np.where(active, d_mean, 0).astype(np.float32)
                pull[top, np.arange(filters)] += d_top * active[top, np.arange(filters)]
                # In slices, so that a long text needs little memory at once.
                for low in range(0, n, 16 * CHUNK):
                    high = min(low + 16 * CHUNK, n)
                    for offset in range(reach):
                        cell = data[low + offset : high + offset][:, None].astype(np.int64) * filters + np.arange(filters)
                        g["table"][offset] += np.bincount(cell.ravel(), pull[low:high].ravel(), 256 * filters).reshape(256, filters)
            now = rate * (0.5 + 0.5 * np.cos(np.pi * turn / steps)) + 1e-4
            for name, value in g.items():
                m[name] += 0.1 * (value - m[name])
                v[name] += 0.01 * (value * value - v[name])
                params[name] -= (now * (m[name] / (1 - 0.9**turn)) / (np.sqrt(v[name] / (1 - 0.99**turn)) + 1e-7)).astype(np.float32)
    network.out_b = float(params["out_b"][0])
    return network


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, most_bytes: int = TRAIN_BYTES) -> Network:
    """A network learnt from at most ``examples`` labelled documents per label outside the held-out fold, in the order of a hash of their ids,
    and at most ``most_bytes`` of text (an even share per label; whole texts only, a text that does not fit into what is left of the share is passed over)."""
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.select("doc_id").where(remainder(F.col("doc_id"), FOLDS) != 0).join(marks, "doc_id").distinct()
    totals = {row["quality"]: row["n"] for row in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for label in (0, 1)]
    ids = kept(first[0].union(first[1]))
    sample = kept(texts.join(F.broadcast(ids), "doc_id").select("quality", F.xxhash64("doc_id").alias("order"), F.coalesce("text", F.lit("")).cast("binary").alias("data")))
    held: dict[int, list[np.ndarray]] = {0: [], 1: []}
    size = {0: 0, 1: 0}
    for row in sample.orderBy("order").toLocalIterator():
        label, room = row["quality"], most_bytes // 2 - size[row["quality"]]
        data = np.frombuffer(bytes(row["data"]), np.uint8)
        if len(data) <= room:
            held[label].append(data)
            size[label] += len(data)
    n0, n1 = len(held[0]), len(held[1])
    prior = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    if not n0 or not n1:
        network = Network.fresh()
        network.out[:] = 0
        network.out_b = float(np.log(prior / (1 - prior)))
        return network
    marks_ = np.concatenate([np.zeros(n0), np.ones(n1)])
    # Both labels weigh alike in training; the output is then shifted to how often they occur.
    weight = np.where(marks_ > 0, 0.5 / n1, 0.5 / n0) * (n0 + n1)
    network = train([*held[0], *held[1]], marks_, weight)
    network.shift = float(np.log(prior / (1 - prior)))
    return network


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score, predicted for every row; a null or empty text is scored as one window of zero bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Network = shared.value
        for batch in batches:
            data, borders = buffers(batch.column(1))
            rows = [pooled(own, data[borders[i] : borders[i + 1]]) for i in range(len(batch))]
            if rows:
                logit = own.logit(np.stack([x for x, _ in rows]), np.stack([x for _, x in rows])).astype(np.float64) + own.shift
                chance = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chance), pa.array((chance >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, predicted int")


def byte_quality(docs: DataFrame, labels: DataFrame, **sizes) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from 0.3 on).

    With labels of one kind only, or none, every score is the labels' smoothed share. Null texts count as empty, repeated rows are scored
    alike, a label row repeated for one document counts once (the larger label); other columns are ignored; an empty table gives an
    empty result."""
    network = fit(docs, labels, **sizes)
    return score(docs, network).withColumn("held_out", remainder(F.col("doc_id"), FOLDS) == 0)
