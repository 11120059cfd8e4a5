"""Repeated passages of words through compressed FM-indexes.

Documents' segments come to shards by anchor (see anchors). Of the segments under one anchor, in the order of their
documents, those in even blocks of 1, 2, 4 ... are indexed, and those in the odd block that follows are streamed through the index: so every pair of
segments under an anchor meets once, the smaller document's in the index and the greater's in the stream, and no streamed text is in
the index that it is streamed through.

An index is an FM-index: the Burrows-Wheeler transform in a wavelet matrix of packed bits, and two bit vectors that mark where
suffixes differ in their first 12 and 13 words. The suffix array is dropped once the smallest document of each 13-word interval is noted.
A segment is streamed by backward search from its end. At 13 words the interval is reported; it is then widened to the suffixes that share
the first 12 of them, so that each further word costs one step. Where the search fails, the windows left of the failure start anew, each on its own.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quillspark.llm.anchors import Windows, covered, key_column, keyed, ranks, repeated_spans, with_spans, word_slices
from quillspark.llm.worker import frugal, text_slices

#: Suffixes are ordered through so many words.
DEPTH = 16
#: Windows that are streamed in one go; longer segments are cut.
_STRETCH = 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_NONE = np.iinfo(np.int64).max


def _words(text) -> list[bytes]:
    return bytes(text).split()  # at ASCII white space: space and \x09-\x0D


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and those of its inverse."""
    out = []
    for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)):
        x, n = np.ones(size, np.uint64), 1
        with np.errstate(over="ignore"):
            while n < size:  # twice as many each time
                x[n : 2 * n] = x[: min(n, size - n)] * np.uint64(pow(base, n, 1 << 64))
                n *= 2
        out.append(x)
    return out[0], out[1]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words: differences of one running polynomial over the bytes, shifted to the same place."""
    data, starts, counts = word_slices(texts)
    power, inverse = _powers(1 << max(21, int(len(data)).bit_length()))
    with np.errstate(over="ignore"):
        upto = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
        return np.diff(upto[starts]) * inverse[starts[:-1]], counts


def _contents(text):
    words = _words(text)
    return lambda a, b: b" ".join(words[a:b]) if b <= len(words) else b""


def word_windows(threshold: int = 13) -> Windows:
    if not 8 <= threshold < DEPTH:
        raise ValueError(f"suffixes are ordered through {DEPTH} words and anchors take 4: thresholds are 8 to {DEPTH - 1}")
    return Windows(threshold, 4, _tokens, _contents)


class BitVector:
    """Packed bits with a running count per word of 64."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.concatenate([bits.astype(np.uint8), np.zeros(64 + (-len(bits)) % 64, np.uint8)]), bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.counts = (np.cumsum(ones) - ones).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Bits set before each place."""
        word = at >> 6
        return self.counts[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class WaveletMatrix:
    """Ranks of symbols in a sequence."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1 == 1
            self.levels.append(BitVector(bit))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where prefixes [0, at) of the sequence end among the symbol's place in the last level."""
        at = at.astype(np.int64)
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.ones(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Index of a sequence of symbols from 1 on, with 0 before, between and after texts. labels: a number for each symbol of the sequence."""

    def __init__(self, seq: np.ndarray, threshold: int, labels: np.ndarray | None = None):
        if not len(seq) or seq[0] or seq[-1]:
            raise ValueError("the sequence must begin and end with 0")
        self.n, self.threshold, self.symbols = len(seq), threshold, int(seq.max()) + 1
        rank, step = seq.astype(np.int64), 1
        while step < DEPTH:  # prefix doubling, through DEPTH symbols
            after = np.zeros(self.n, np.int64)
            after[: self.n - step] = rank[step:] + 1
            key = rank * (int(after.max()) + 1) + after
            order = np.argsort(key)
            s = key[order]
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
            step *= 2
        del rank, key, s, after
        self.wavelet = WaveletMatrix(seq[order - 1], self.symbols)
        c = np.bincount(seq, minlength=self.symbols)
        self.first = np.concatenate([[0], np.cumsum(c)])
        self.offset = self.first[:-1] - self.wavelet.walk(np.arange(self.symbols), np.zeros(self.symbols, np.int64))
        differ = np.zeros(self.n, bool)
        differ[0] = True
        for k in range(threshold):
            x = np.where(order + k < self.n, seq[np.minimum(order + k, self.n - 1)], -1)
            differ[1:] |= x[1:] != x[:-1]
            if k == threshold - 2:  # suffixes that share all words of a window but the last are neighbours
                self.short, self.starts = BitVector(differ), np.append(np.flatnonzero(differ), self.n).astype(np.int32)
        self.whole = BitVector(differ)
        self.least = np.minimum.reduceat(labels[order], np.flatnonzero(differ)) if labels is not None else None

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of pattern."""
        at = self.wavelet.walk(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        off = self.offset[symbol]
        return off + at[: len(symbol)], off + at[len(symbol) :]

    def count(self, pattern: list[int]) -> int:
        """Occurrences of a pattern of fewer than DEPTH symbols."""
        low, high = np.zeros(1, np.int64), np.array([self.n])
        for s in reversed(pattern):
            if not 0 < s < self.symbols:
                return 0
            low, high = self.step(np.array([s]), low, high)
            if low[0] >= high[0]:
                return 0
        return int(high[0] - low[0])

    def least_of(self, seq: np.ndarray, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """For every place of seq, the least label of the window that starts there; _NONE where that is not in the index, or not asked for.

        Asked for: stretches of `windows` windows from `first` on. seq: symbols of the index, or 0 for what is none.
        """
        out = np.full(len(seq), _NONE, np.int64)
        m = self.threshold

        def search(start, end, chain):
            """Backward search of seq[start:end] from the end. Without chain, it ends with the first window or failure; returns where it failed."""
            known = seq[end - 1] > 0
            failed = [[start[~known]], [end[~known]]]
            start, end = start[known], end[known]
            symbol = seq[end - 1]
            low, high, length = self.first[symbol], self.first[symbol + 1], np.ones(len(start), np.int64)
            while len(start):
                at = end - length - 1
                symbol = seq[at]
                low, high = self.step(symbol, low, high)
                good = (low < high) & (symbol > 0)
                if not good.all():
                    failed[0].append(start[~good])
                    failed[1].append(end[~good])
                    start, end, low, high, length, at = (x[good] for x in (start, end, low, high, length, at))
                length = length + 1
                full = length == m
                if full.any():
                    place = at[full]
                    out[place] = self.least[self.whole.ones(low[full] + 1) - 1]
                    if not chain:
                        return failed
                    group = self.short.ones(low[full] + 1) - 1
                    low[full], high[full] = self.starts[group], self.starts[group + 1]
                    length[full], end[full] = m - 1, end[full] - 1
                    going = ~full
                    going[full] = place > start[full]
                    start, end, low, high, length = (x[going] for x in (start, end, low, high, length))
            return failed

        pieces = -(-windows // _STRETCH)
        own = np.repeat(np.arange(len(first)), pieces)
        k = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first[own] + k * _STRETCH
        end = np.minimum(start + _STRETCH, first[own] + windows[own]) + m - 1
        begun, stopped = map(np.concatenate, search(start, end, True))
        n = np.maximum(stopped - m - begun, 0)  # windows without the last word of the failed one
        at = np.repeat(begun, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        unknown = np.concatenate([[0], np.cumsum(seq == 0)])
        at = at[unknown[at + m] == unknown[at]]
        search(at, at + m, False)
        return out


def _decide(items, w: Windows):
    """Windows that also start in a smaller document than the one which waits. Equal contents are settled before."""
    groups = defaultdict(list)
    for i, (_, c) in enumerate(items):
        groups[c.route].append(i)
    groups = [v for v in groups.values() if len(v) > 1]  # a content alone under its anchor shares no window
    if not groups:
        return
    rank = ranks(items)
    for v in groups:
        v.sort(key=lambda i: rank[i])
    used = [i for v in groups for i in v]
    place = dict(zip(used, range(len(used))))
    data, starts, sizes = word_slices(pa.array([items[i][0] for i in used], pa.binary()))
    symbols = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.cumsum(sizes) - sizes
    masks = {i: np.zeros(items[i][1].n, bool) for i in used if items[i][1].refs}
    size = 1
    while groups:
        indexed = [i for v in groups for at in range(0, len(v) - size, 2 * size) for i in v[at : at + size]]
        streamed = [i for v in groups for at in range(size, len(v), 2 * size) for i in v[at : at + size] if i in masks and not masks[i].all()]
        if streamed:
            a, b = (np.array([place[i] for i in x], np.int64) for x in (indexed, streamed))
            least = _stream(symbols, (first[a], sizes[a], rank[indexed]), (first[b], sizes[b]), w)
            at = 0
            for i, n in zip(streamed, sizes[b].tolist()):
                masks[i] |= least[at : at + items[i][1].n] < rank[i]
                at += n
        size *= 2
        groups = [v for v in groups if len(v) > size]
    for i, mask in masks.items():
        if mask.any():
            yield i, mask


def _places(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _stream(symbols: np.ndarray, indexed: tuple, streamed: tuple, w: Windows) -> np.ndarray:
    """For every word of the streamed texts, the least rank in an index of the others of the window that starts there.

    indexed: first places, sizes and ranks of texts in symbols; streamed: first places and sizes.
    """
    first, sizes, rank = indexed
    words = symbols[_places(first, sizes)]
    there = np.zeros(int(symbols.max()) + 1, bool)
    there[words] = True
    number = np.where(there, np.cumsum(there), 0)  # from 1 on; 0 for words that the index does not have
    seq = np.zeros(len(words) + len(sizes) + 1, np.int64)
    own = np.ones(len(seq), bool)
    own[np.cumsum(sizes + 1) - sizes - 1], own[-1] = False, False  # a 0 before each text and one at the end
    seq[own] = number[words]
    labels = np.full(len(seq), _NONE, np.int64)
    labels[own] = np.repeat(rank, sizes)
    index = FMIndex(seq, w.threshold, labels)
    first, sizes = streamed
    return index.least_of(number[symbols[_places(first, sizes)]], np.cumsum(sizes) - sizes, sizes - w.threshold + 1)


@frugal
def _digest(rows):
    for whole in rows:
        for batch in text_slices(whole, "text"):
            out = [[], [], []]
            for text, blobs in zip(batch.column("text"), batch.column("blobs").to_pylist()):
                words = _words(memoryview(text.as_buffer()))
                n = len(words)
                gone = 0
                if blobs:
                    mask = covered(blobs, n)
                    gone = int(mask.sum())
                    words = [x for x, z in zip(words, mask.tolist()) if not z]
                for o, x in zip(out, (n, gone, hashlib.sha256(b" ".join(words)).hexdigest())):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(o, pa.int64()) for o in out[:2]), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def cut_words(text: bytes, mask: np.ndarray) -> bytes:
    """text without the words in mask; each goes with the white space after it."""
    out, at = [], 0
    spans = [m.span() for m in _WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    for a, b in edge.reshape(-1, 2).tolist():
        out.append(text[at : spans[a][0]])
        at = spans[b][0] if b < len(spans) else len(text)
    return b"".join([*out, text[at:]])


@frugal
def _cut(rows):
    for whole in rows:
        for batch in text_slices(whole, "text"):
            texts = []
            for text, blobs in zip(batch.column("text"), batch.column("blobs").to_pylist()):
                b = bytes(memoryview(text.as_buffer()))
                texts.append(cut_words(b, covered(blobs, len(b.split()))) if blobs else b)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.binary()).cast(pa.string())], names=["row", "text"])


def repeated_word_spans(docs: DataFrame, threshold: int = 13, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows of keyed(), spans): words covered by windows whose sequence also starts in a document with a smaller key."""
    rows = keyed(docs, key, text)
    return rows, repeated_spans(rows, word_windows(threshold), _decide, by_order=True)


def remove_repeated_words(docs: DataFrame, threshold: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space), a row per row of docs.

    A word goes if a window of `threshold` words over it also starts in a document with a smaller key, judged on the input.
    Null keys come after all others. Repeated rows have one key, so neither gives way to the other. Null texts have no words. Rows that
    share a key with other texts are documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    rows, spans = repeated_word_spans(docs, threshold, key, text)
    return with_spans(rows, spans).select(key_column().alias("doc_id"), "text", "blobs").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeated_words(docs: DataFrame, threshold: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with those words cut out of the text, each with the white space after it; other columns and null texts stay, and so do all rows."""
    rows = keyed(docs, key, text, carry=True)
    spans = repeated_spans(rows, word_windows(threshold), _decide, by_order=True)
    joined = with_spans(rows, spans)
    schema = T.StructType([T.StructField("row", joined.schema["row"].dataType), T.StructField("text", T.StringType())])
    out = joined.select("row", "text", "blobs").mapInArrow(_cut, schema)
    value = F.when(F.col("row")[text].isNotNull(), F.col("text")).alias(text)
    return out.select(*[F.col("row")[c].alias(c) if c != text else value for c in docs.columns])
