"""URL filters by a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed side by side into the bits of some 64-bit words. Reading a character shifts every rule's states at once
(with the carry from word to word), keeps those whose character matches, and lets wildcard states stay where they are. In a glob,
``**`` stands for any characters, ``*`` for any but ``/``, ``?`` for one character but ``/``; all else for itself. A rule must match the whole URL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A glob over the canonical URL, what it says, its verdict, and its rank: of all rules that match, the one of the highest rank decides."""

    glob: str
    name: str | None
    verdict: str
    rank: int


# Words that mark a page as spam when they occur in a host or path, as whole hyphenated parts or inside.
SPAM = ["casino", "pills", "viagra", "poker", "porn", "xxx", "replica", "free-money", "payday", "torrent"]
# Files and pages without prose of their own.
CHAFF = ["/**.jpg", "/**.png", "/**.gif", "/**.css", "/**.js", "/**.zip", "/**.exe", "/**/login", "/**/cart", "/**/search"]
# (host, path, verdict): a host stands for itself and all subdomains, a path for all that start with it.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_rules(rules: list[tuple[str, str, str]]) -> list[Rule]:
    """The canonical URL starts with ``.host``, so a leading wildcard without ``/`` covers the host and every subdomain."""
    return [Rule(f"*.{host}{path}**", host + path, verdict, 1000 + len(host + path)) for host, path, verdict in rules]


def default_rules() -> list[Rule]:
    """The named rules, and behind them the globs that block spam hosts, spam paths and chaff."""
    behind = [f"*{word}*/**" for word in SPAM] + [f"*{word}*" for word in SPAM] + [f"*/**{word}**" for word in SPAM] + [f"*{glob}" for glob in CHAFF]
    return [*host_rules(RULES), *(Rule(glob, None, "block", 1) for glob in behind)]


class Automaton:
    def __init__(self, rules: list[Rule]):
        self.rules = sorted(rules, key=lambda rule: -rule.rank)
        # One state per character or wildcard step, and one before the first.
        parts = [self._steps(rule.glob) for rule in self.rules]
        size = sum(len(steps) + 1 for steps in parts)
        self.words = max(1, -(-size // 64))
        self.match = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.begin = np.zeros(self.words, np.uint64)
        self.skip = np.zeros(self.words, np.uint64)
        self.last: list[tuple[int, np.uint64]] = []
        at = 0
        for steps in parts:
            self._set(self.begin, at)
            for kind in steps:
                at += 1
                if isinstance(kind, int):
                    self._set(self.match[kind], at)
                elif kind == "?":
                    for byte in range(256):
                        if byte != 47:
                            self._set(self.match[byte], at)
                else:
                    # A wildcard is entered without a character and kept by those it stands for.
                    self._set(self.skip, at)
                    for byte in range(256):
                        if kind == "**" or byte != 47:
                            self._set(self.stay[byte], at)
            self.last.append((at // 64, np.uint64(1 << (at % 64))))
            at += 1
        self.begin = self._closed(self.begin[None, :])[0]

    @staticmethod
    def _steps(glob: str) -> list:
        steps, at, raw = [], 0, glob.encode()
        while at < len(raw):
            if raw[at] == 42:
                double = raw[at : at + 2] == b"**"
                steps.append("**" if double else "*")
                at += 1 + double
            else:
                steps.append("?" if raw[at] == 63 else raw[at])
                at += 1
        return steps

    @staticmethod
    def _set(row: np.ndarray, at: int) -> None:
        row[at // 64] |= np.uint64(1 << (at % 64))

    @staticmethod
    def _shifted(states: np.ndarray) -> np.ndarray:
        out = states << np.uint64(1)
        out[:, 1:] |= states[:, :-1] >> np.uint64(63)
        return out

    def _closed(self, states: np.ndarray) -> np.ndarray:
        """With the wildcards that the states lead to; two wildcards never follow each other in more than a run of them."""
        while True:
            more = states | (self._shifted(states) & self.skip)
            if (more == states).all():
                return states
            states = more

    def first_match(self, urls: list[bytes]) -> np.ndarray:
        """The index in ``rules`` of the matching rule of the highest rank, or -1."""
        sizes = np.array([len(url) for url in urls], np.int64)
        order = np.argsort(-sizes, kind="stable")
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(urls) else sizes
        data = np.frombuffer(b"".join(urls), np.uint8)
        states = np.tile(self.begin, (len(urls), 1))
        ordered, begin = sizes[order], starts[order]
        for step in range(int(ordered[0]) if len(urls) else 0):
            # URLs in order of length: those that still have a character come first.
            live = int(np.searchsorted(-ordered, -step, side="left"))
            byte = data[begin[:live] + step]
            now = states[:live]
            states[:live] = self._closed((self._shifted(now) & self.match[byte]) | (now & self.stay[byte]))
        found = np.full(len(urls), -1, np.int64)
        for index in range(len(self.rules) - 1, -1, -1):
            word, bit = self.last[index]
            found[order[(states[:, word] & bit) != 0]] = index
        return found


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A to Z in lower case; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_verdicts(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (name of the rule that decided, null for one without), verdict.

    The canonical URL is ``.host`` and path: scheme, query and fragment play no part. A null URL, or one without ://, has neither host
    nor path; no rule that needs a character of either fits it. A URL that no rule fits gets ``default``. Repeated rows are judged
    alike; other columns are ignored; an empty table gives an empty result."""
    automaton = Automaton(default_rules() if rules is None else rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = automaton.first_match([f".{host}{path}".encode() for host, path in zip(hosts, paths)]).tolist()
            hit = [automaton.rules[at] if at >= 0 else None for at in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([rule.name if rule else None for rule in hit], pa.string()),
                 pa.array([rule.verdict if rule else default for rule in hit], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    url = F.col("url").cast("string")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    return slim.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
