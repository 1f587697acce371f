"""Whole-batch text work in numpy: words, their hashes and shingles of many texts at once, with no Python step per word.

A column of texts is one byte buffer with offsets. A word's hash is a polynomial over its bytes, read off one running sum
of the buffer; prefixes of words cost no more than whole ones. Batches are cut at text borders to a bounded number of bytes
(one longer text is a piece of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_ODD, -1, 1 << 64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
# Letters and digits of ASCII and every byte of a longer character.
_NOT_LETTER = np.ones(256, dtype=bool)
_NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    values = np.asarray(values, np.uint64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        for at, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class Pieces:
    """The words of some consecutive texts: ``starts`` and ``ends`` in ``data``, the text each word is in (``doc``), and ``first``,
    the index of each text's first word (one more entry than texts)."""

    def __init__(self, data: np.ndarray, borders: np.ndarray, lower: bool = True, letters: bool = False):
        data = _LOWER[data] if lower else data
        self.data, self.borders, n = data, borders, len(data)
        gap = (_NOT_LETTER if letters else _SPACE)[data]
        opens, closes = ~gap, ~gap
        if n:
            opens = opens.copy()
            closes = closes.copy()
            opens[1:] &= gap[:-1]
            closes[:-1] &= gap[1:]
            inner = borders[(borders > 0) & (borders < n)]
            opens[inner] = ~gap[inner]
            closes[inner - 1] = ~gap[inner - 1]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, borders)
        self.doc = np.repeat(np.arange(len(borders) - 1), np.diff(self.first))
        self._sums: np.ndarray | None = None

    def hashes(self, prefix: int | None = None) -> np.ndarray:
        """A hash per word, or of its first ``prefix`` bytes."""
        powers, inverse = _power_tables(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[self.data] * powers[: len(self.data)], out=self._sums[1:])
        ends = self.ends if prefix is None else np.minimum(self.ends, self.starts + prefix)
        return mix((self._sums[ends] - self._sums[self.starts]) * inverse[self.starts])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of every run of ``size`` words inside one text; a text of fewer words, but some, is one run."""
        words, n = self.hashes(), len(self.starts)
        counts = np.diff(self.first)
        rolled = np.zeros(n, np.uint64)
        for k in range(size):
            step = np.uint64(pow(_ODD, k + 1, 1 << 64))
            if n > k:
                rolled[: n - k] += words[k:] * step
        left = self.first[1:][self.doc] - np.arange(n)
        keep = left >= size
        hashes, docs = mix(rolled[keep]), self.doc[keep]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            tails = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                has = counts[short] > k
                tails[has] += words[self.first[short[has]] + k] * np.uint64(pow(_ODD, k + 1, 1 << 64))
            hashes = np.concatenate([hashes, mix(tails ^ counts[short].astype(np.uint64))])
            docs = np.concatenate([docs, short])
            order = np.argsort(docs, kind="stable")
            hashes, docs = hashes[order], docs[order]
        return hashes, docs


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    borders = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), borders


def pieces(texts: pa.Array, lower: bool = True, letters: bool = False, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, Pieces]]:
    """(from, to, words) over runs of texts of about ``limit`` bytes."""
    data, borders = buffers(texts)
    at, n = 0, len(borders) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + limit, side="right")) - 1)
        yield at, to, Pieces(data[borders[at] : borders[to]], borders[at : to + 1] - borders[at], lower, letters)
        at = to


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(values, np.uint64).view(np.int64)
