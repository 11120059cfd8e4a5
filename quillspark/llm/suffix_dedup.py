"""Repeated byte windows by a depth-limited radix sort.

Suffixes are ordered only through their first 200 bytes, most significant digit first: 25 digits of eight bytes, read big-endian.
A pass looks at the next digit of every suffix that is left; groups whose members differ in it are sorted by it and split, and a suffix alone in
its group is dropped, as it can't be repeated. The groups left after the last digit are exactly the repeated windows, in byte order.

The first pass runs across the cluster: windows meet in shards by anchor (see anchors), so only suffixes that share one are ever sorted.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.anchors import Windows, covered, key_column, keyed, repeated_spans, with_spans
from quillspark.llm.tokenizer import column_bytes
from quillspark.llm.worker import frugal, text_slices

#: Bytes of a digit.
DIGIT = 8


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, ends = column_bytes(texts)
    return data, np.diff(ends)


def _slices(text):
    return lambda a, b: bytes(text[a:b]) if b <= len(text) else b""


def byte_windows(threshold: int = 200) -> Windows:
    if threshold < 64:
        raise ValueError("anchors take windows of 64 bytes at least")
    return Windows(threshold, 32, _tokens, _slices)


def big_endian(buf: np.ndarray) -> np.ndarray:
    """The digit at each place of buf, as if zeros followed it."""
    out = np.concatenate([buf, np.zeros(DIGIT - 1, np.uint8)]).astype(np.uint64)
    size = 1
    while size < DIGIT:
        out = out[:-size] << np.uint64(8 * size) | out[size:]
        size *= 2
    return out


def radix_groups(buf: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes whose first depth bytes another of starts has too, the number of each one's group), groups in byte order.

    group: suffixes of different groups are told apart already; their order comes first. All suffixes have depth bytes.
    """
    digits = big_endian(buf)
    order = np.argsort(group, kind="stable")
    at, group = starts[order], group[order]
    new = np.concatenate([[True], group[1:] != group[:-1]]) if len(at) else np.zeros(0, bool)
    for done in range(0, depth, DIGIT):
        edge = np.flatnonzero(new)
        size = np.diff(np.append(edge, len(at)))
        if (size == 1).any():
            keep = np.repeat(size > 1, size)
            at, new = at[keep], new[keep]
            edge = np.flatnonzero(new)
            size = np.diff(np.append(edge, len(at)))
        if not len(at):
            break
        d = digits[at + done]
        if depth - done < DIGIT:  # bytes beyond the depth don't count
            d = d >> np.uint64(8 * (DIGIT - depth + done))
        differ = np.add.reduceat(d != np.repeat(d[edge], size), edge) > 0
        if differ.any():
            mine = np.flatnonzero(np.repeat(differ, size))
            own = np.repeat(np.arange(len(size)), size)[mine]
            order = mine[np.lexsort((d[mine], own))]
            at[mine], d[mine] = at[order], d[order]
            new[1:] |= d[1:] != d[:-1]
    group = np.cumsum(new) - 1
    size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    keep = size[group] > 1
    return at[keep], (np.cumsum(size > 1) - 1)[group[keep]]


def _decide(items, w: Windows):
    by = defaultdict(list)
    for i, (_, c) in enumerate(items):
        by[c.route].append(i)
    # all windows of contents that occur twice are settled; a lone one of these tells nobody anything
    sorted_ones = [i for v in by.values() if len(v) > 1 or items[v[0]][1].times == 1 for i in v]
    if not sorted_ones:
        return
    n = np.array([items[i][1].n for i in sorted_ones], np.int64)
    size = np.array([len(items[i][0]) for i in sorted_ones], np.int64)
    first = np.cumsum(size) - size
    buf = np.frombuffer(b"".join(items[i][0] for i in sorted_ones), np.uint8)
    own = np.repeat(np.arange(len(n)), n)
    starts = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    route = np.array([items[i][1].route for i in sorted_ones], np.int64)
    mask = np.zeros(len(buf), bool)
    mask[radix_groups(buf, starts, route[own], w.threshold)[0]] = True
    for i, a, m in zip(sorted_ones, first.tolist(), n.tolist()):
        if items[i][1].refs and mask[a : a + m].any():
            yield i, mask[a : a + m]


@frugal
def _digest(rows):
    for whole in rows:
        for batch in text_slices(whole, "text"):
            out = [[], [], [], []]
            for text, blobs in zip(batch.column("text"), batch.column("blobs").to_pylist()):
                view = memoryview(text.as_buffer())
                n = len(view)
                if blobs:
                    b, mask = np.frombuffer(view, np.uint8), covered(blobs, n)
                    edges = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
                    row = (n, int(mask.sum()), edges, hashlib.sha256(b[~mask].tobytes()).hexdigest())
                else:
                    row = (n, 0, 0, hashlib.sha256(view).hexdigest())
                for o, x in zip(out, row):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_byte_spans(docs: DataFrame, threshold: int = 200, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows of keyed(), spans): the bytes covered by strings of `threshold` bytes that also start elsewhere in the table."""
    rows = keyed(docs, key, text)
    return rows, repeated_spans(rows, byte_windows(threshold), _decide, by_order=False)


def remove_repeated_bytes(docs: DataFrame, threshold: int = 200, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 (of the bytes that remain), a row per row of docs.

    A byte goes if a string of `threshold` bytes over it also starts anywhere else: another document, a repeated row, or another place in the same
    document, overlaps included. Null texts are empty. Repeated rows repeat each other's windows, so all of theirs go. Null keys
    stay null; rows that share a key are documents of their own. Other columns are ignored; an empty table gives no rows.
    """
    rows, spans = repeated_byte_spans(docs, threshold, key, text)
    return with_spans(rows, spans).select(key_column().alias("doc_id"), "text", "blobs").mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
