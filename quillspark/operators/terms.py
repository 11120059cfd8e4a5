"""Names of the terms of texts: 64 bits, and 16 more that tell two terms of one name apart. Made from bytes, without a string for each term."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, functions as F

#: Bytes of texts that are looked at, and that go on, at a time; places in a word that have a table of random numbers.
PIECE, GROUP, PLACES = 1 << 18, 1 << 20, 64
_bounds: list[np.ndarray] = []


def character_classes(spark: SparkSession) -> np.ndarray:
    """Where characters' classes change, from 0 (neither) on, and to which: 1 letter, 2 number or underscore. As Spark's own patterns have them."""
    if not _bounds:
        c = spark.range(0, 0x110000, 1, 4).where("id < 55296 OR id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
        kind = c.select("id", F.when(F.rlike("c", F.lit(r"^\p{L}$")), 1).when(F.rlike("c", F.lit(r"^[\p{N}_]$")), 2).alias("kind")).where("kind IS NOT NULL").toArrow()
        table = np.zeros(0x110001, np.uint8)
        table[kind.column("id").to_numpy()] = kind.column("kind").to_numpy()
        at = np.flatnonzero(np.diff(table, prepend=0))
        _bounds.append(np.stack([at, table[at]]))
    return _bounds[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers that look random, one for each x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Terms:
    """Lower-case words of four letters and more and pairs of neighbours among them, as similarity.tokens() has them, of texts in lower case.

    A word's name is the sum of a random number for each of its bytes and their places; a pair's is that of its second word and three times that of its
    first, so no two terms have the same numbers in their sums.
    """

    def __init__(self, bounds: np.ndarray, salt: int):
        self.bounds, self.salt, self.table = bounds, salt, None

    def _load(self) -> None:
        at, kind = self.bounds
        self.table = np.repeat(np.concatenate([[0], kind]), np.diff(at, prepend=0, append=0x110000)).astype(np.uint8)
        self.bytes = np.where(np.arange(256) < 128, self.table[:256], 0).astype(np.uint8)
        self.seeds = _mixed(np.array([2 * self.salt + 1, 2 * self.salt + 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.random = [self._number(np.arange(PLACES * 256, dtype=np.uint64), s) for s in self.seeds]

    @staticmethod
    def _number(x: np.ndarray, seed: np.uint64) -> np.ndarray:
        return _mixed(_mixed(x + seed) + seed)

    def _classes(self, b: np.ndarray) -> np.ndarray:
        """Of each byte, that of its character."""
        kind = self.bytes[b]
        lead = np.flatnonzero(b >= 0xC0)
        if len(lead):
            x, size = b[lead].astype(np.int64), 2 + (b[lead] >= 0xE0) + (b[lead] >= 0xF0)
            code = x & (0x7F >> size)
            for k in range(1, 4):
                more = size > k
                code[more] = (code[more] << 6) | (b[np.minimum(lead[more] + k, len(b) - 1)] & 0x3F)
            of = self.table[np.minimum(code, 0x10FFFF)]
            for k in range(4):
                more = (size > k) & (lead + k < len(b))
                kind[lead[more] + k] = of[more]
        return kind

    @staticmethod
    def _counts(flags: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many are set of n from first on, each."""
        if not flags.any():
            return np.zeros(len(first), np.int32)
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        return sums[first + n] - sums[first]

    def _words(self, data: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first byte, name, further name) of words; none goes over an edge. Texts are cut where no word is."""
        s = 0
        while s < len(data):
            size = PIECE
            while True:
                e = min(len(data), s + size)
                late = max(s, e - size // 64)
                gaps = np.flatnonzero((data[late:e] < 128) & (self.bytes[data[late:e]] == 0)) if e < len(data) else [e - late - 1]
                if len(gaps):
                    break
                size *= 2
            e = late + int(gaps[-1]) + 1
            b = data[s:e]
            kind = self._classes(b)
            inside = np.concatenate([[False], kind > 0, [False]])
            opened, closed = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
            cuts = edges[np.searchsorted(edges, s) : np.searchsorted(edges, e)] - s
            opened[cuts] = inside[1:-1][cuts]
            cuts = cuts[cuts > 0] - 1
            closed[cuts] = inside[1:-1][cuts]
            first, n = np.flatnonzero(opened), np.flatnonzero(closed) + 1
            n -= first
            if len(first):
                other, tails = self._counts(kind == 2, first, n), self._counts((b & 0xC0) == 0x80, first, n)
                good = (other == 0) & (n - tails >= 4)
                first, n = first[good], n[good]
            if len(first):
                begin = np.cumsum(n) - n
                place = np.arange(int(begin[-1] + n[-1]))
                place -= np.repeat(begin, n)
                x = b[place + np.repeat(first, n)].astype(np.int64)
                x += place * 256
                far = np.flatnonzero(place >= PLACES)
                names = []
                for random, seed in zip(self.random, self.seeds):
                    each = random[np.minimum(x, len(random) - 1)] if len(far) else random[x]
                    each[far] = self._number(x[far].astype(np.uint64), seed)
                    names.append(np.add.reduceat(each, begin))
                yield first + s, *names
            s = e

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Some rows of (text), bounds of each row's terms, the names of all, 16 more bits of each."""
        if self.table is None:
            self._load()
        for batch in batches:
            texts = batch.column("text").fill_null("")
            bounds = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            s = 0
            while s < len(batch):
                e = max(s + 1, min(s + 60_000, int(np.searchsorted(bounds, bounds[s] + GROUP, "right")) - 1))
                edges = bounds[s : e + 1] - bounds[s]
                found = list(self._words(data[bounds[s] : bounds[e]], edges[:-1]))
                first, h, c = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), *(np.zeros(0, np.uint64),) * 2)
                row = (np.searchsorted(edges, first, "right") - 1).astype(np.uint16)
                next_to = np.flatnonzero(row[1:] == row[:-1])
                pair = [x[next_to] * np.uint64(3) + x[next_to + 1] for x in (h, c)]
                row = np.concatenate([row, row[next_to]])
                order = np.argsort(row, kind="stable")
                h, c = (np.concatenate([x, y])[order] for x, y in zip((h, c), pair))
                yield batch.slice(s, e - s), np.concatenate([[0], np.cumsum(np.bincount(row, minlength=e - s))]), h.view(np.int64), (c >> np.uint64(48)).astype(np.uint16)
                s = e
