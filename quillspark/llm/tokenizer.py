"""Whole-text byte-level BPE encoding that encodes each distinct piece of text once.

The tokenizer's split pattern (GPT-2's) allows safe cuts: places where a match is certain to end, and where what comes before
and after is split alike whether it stands alone or not. Texts are cut there, bytes at a time in NumPy; Arrow's dictionary
encoding finds the distinct pieces of a slice of the table, only those are looked up in Python, only unknown ones reach
the library, and ids are gathered by NumPy offsets. The ids of the pieces, put together, are the ids of the whole text.

Safe cuts, for characters whose class is certain (ASCII, and letters since Unicode 3.2 of up to three bytes); all others are left uncut:
  after a letter, before ASCII that is no letter
  before a space that a character follows which is not white space
  after a digit or sign, before a letter; not after an apostrophe, which may begin a contraction
  after a single white space other than a space, before a letter
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from quillspark.llm.worker import resident

_LETTER, _SPACE, _WHITE, _SIGN, _QUOTE = 1, 2, 4, 8, 16
#: Pieces, and ids of pieces, that are kept; beyond them a pool starts anew.
POOL_PIECES, POOL_IDS = 700_000, 1 << 23
#: Pieces that may be put together with a line feed between them, which always is a token of its own there.
_JOINABLE = re.compile(r" ?[^\s](?:[^\n]*\S)?")
_GROUP = 200


@functools.cache
def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for b in range(0x21, 0x7F):
        out[b] = _LETTER if chr(b).isalpha() else _QUOTE if chr(b) == "'" else _SIGN
    out[0x20] = _SPACE
    out[9:14] = _WHITE
    return out


@functools.cache
def _letters() -> np.ndarray:
    """Code points of two and three bytes that are letters in Unicode 3.2 and now."""
    was = unicodedata.ucd_3_2_0.category
    return np.array([0x80 <= c and not 0xD800 <= c < 0xE000 and was(chr(c))[0] == "L" == unicodedata.category(chr(c))[0] for c in range(1 << 16)])


def safe_cuts(data: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Mask of len(data) + 1: whether the UTF-8 bytes may be cut before each place. stops: where texts begin or end, cuts themselves."""
    n = len(data)
    mark = np.zeros(n + 1, bool)
    mark[stops] = True
    mark[0] = mark[n] = True
    if n < 2:
        return mark
    kind = _byte_classes()[data]
    begins = kind & _LETTER != 0  # the first byte of a letter
    ends = begins.copy()  # its last byte
    if (data >= 0x80).any():
        two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        code = (data[two].astype(np.int32) & 0x1F) << 6 | data[two + 1] & 0x3F
        ok = _letters()[code]
        begins[two], ends[two + 1] = ok, ok
        three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
        if len(three):
            code = (data[three].astype(np.int32) & 0x0F) << 12 | (data[three + 1].astype(np.int32) & 0x3F) << 6 | data[three + 2] & 0x3F
            ok = _letters()[code]
            begins[three], ends[three + 2] = ok, ok
    plain = kind & (_SIGN | _QUOTE) != 0
    solid = begins | plain  # certainly not white space
    mark[1:n] |= ends[:-1] & ((kind[1:] & (_SPACE | _WHITE) != 0) | plain[1:])
    lone = kind == _SPACE
    lone[:-1] &= solid[1:]
    lone[-1] = False
    lone[(stops[(stops > 0) & (stops < n)] - 1)] = False  # what follows is another text
    mark[:n] |= lone
    mark[1:n] |= (kind[:-1] == _SIGN) & begins[1:]
    mark[2:n] |= (ends | plain)[:-2] & (kind[1:-1] == _WHITE) & begins[2:]
    return mark


class PiecePool:
    """Ids of distinct pieces. encode: pieces -> (them in some order, their ids in it, how many each has)."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[list[bytes], np.ndarray, np.ndarray]], pieces: int = POOL_PIECES):
        self.encode, self.size = encode, pieces
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        pieces, ids, sizes = self.encode(pieces)
        at, n = len(self.known), len(self.known) + len(pieces)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[at:n], self.sizes[at:n] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)
        self.known.update(zip(pieces, range(at, n)))

    def gather(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces of data between cuts, how many each piece has)."""
        if len(self.known) > self.size or self.used > POOL_IDS:
            self._forget()
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        code = list(map(self.known.get, distinct))
        if None in code:
            self._learn([p for p, c in zip(distinct, code) if c is None])
            code = list(map(self.known.get, distinct))
        each = np.array(code, np.int64)[pieces.indices.to_numpy()]
        sizes = self.sizes[each]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[each] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.ids[at], sizes


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, where each begins and the last ends); null is empty."""
    if texts.type not in (pa.string(), pa.binary()):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null(pa.scalar("", texts.type))
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, ends - ends[0]


class Encoder:
    """ids of whole texts, equal to those of the library's Tokenizer of a JSON file with add_special_tokens=False.

    special: whether strings of added tokens in a text become those tokens, as the library's default is, or ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not special
        vocabulary = self.tok.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a byte-level token has a character per byte
        added = list(self.tok.get_added_tokens_decoder().values())
        for t in added:
            self.n_bytes[vocabulary[t.content]] = len(t.content.encode())
        splits = json.loads(self.tok.to_str())
        kind = splits["pre_tokenizer"] or {}
        plain = splits["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not any(t.lstrip or t.rstrip or t.single_word for t in added)
        if not plain:
            raise ValueError("texts can be cut for byte-level tokenizers with the GPT-2 pattern and plain added tokens only")
        line = self._alone(["\n"])
        if len(line[0]) != 1:
            raise ValueError("a line feed must be one token")
        self.line = int(line[0][0])
        names = sorted((t.content.encode() for t in added if special or not t.special), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.tok.model._resize_cache(0)  # pieces are kept here
        self.pool = PiecePool(self._encode)

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _encode(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        texts = [p.decode("utf-8", "surrogatepass") for p in pieces]
        fits = list(map(_JOINABLE.fullmatch, texts))
        join = [m.string for m in fits if m]
        apart = [t for t, m in zip(texts, fits) if not m]
        ids = self._alone(["\n".join([*join[at : at + _GROUP], ""]) for at in range(0, len(join), _GROUP)])
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        own = ids != self.line
        sizes = np.diff(np.flatnonzero(~own), prepend=-1) - 1
        alone = self._alone(apart)
        order = [p for p, m in zip(pieces, fits) if m] + [p for p, m in zip(pieces, fits) if not m]
        return order, np.concatenate([ids[own], *alone]), np.concatenate([sizes, np.fromiter(map(len, alone), np.int64, len(alone))])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each text has)."""
        data, ends = column_bytes(texts)
        stops, inside = ends, []
        if self.added is not None and self.added.search(data):
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                inside += [(a + m.start(), a + m.end()) for m in self.added.finditer(data[a:b])]
            stops = np.unique(np.concatenate([ends, np.array(inside, np.int64).ravel()]))
        mark = safe_cuts(data, stops)
        for a, b in inside:
            mark[a + 1 : b] = False
        cuts = np.flatnonzero(mark) if len(data) else np.zeros(1, np.int64)
        ids, sizes = self.pool.gather(data, cuts)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(upto[np.searchsorted(cuts, ends)])


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id after each text."""
    counts = counts + 1
    last = np.cumsum(counts) - 1
    out = np.empty(len(ids) + len(counts), "<u4")
    own = np.ones(len(out), bool)
    own[last] = False
    out[last], out[own] = end_id, ids
    return out, counts


def encoder(path: str, special: bool = True) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    return resident(("encoder", path, special), lambda: Encoder(path, special))
