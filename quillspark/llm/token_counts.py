"""Token counts of sections by offset-mapped attribution.

A document is encoded once, whole. Each token keeps the span of characters that its bytes lie in; spans and sections, both
sorted, meet in an interval join (two binary searches per token). A token that lies in one section counts there; a token
over a boundary is allocated by a rule:
  first  the section of its first character
  last   the section of its last character
  most   the section with most of its characters, the earliest of equals
Counts therefore add up to the document's token count, which counting sections one by one would not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.tokenizer import column_bytes, encoder
from quillspark.llm.worker import text_slices

RULES = ("first", "last", "most")
_OUT = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"


def line_starts(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first byte) of the lines of texts between ends in data; a line holds the \\n that ends it."""
    feeds = np.flatnonzero(data == 10)
    doc = np.concatenate([np.arange(len(ends) - 1), np.searchsorted(ends, feeds, side="right") - 1])
    at = np.concatenate([ends[:-1], feeds + 1])
    order = np.lexsort((at, doc))
    return doc[order], at[order]


def given_starts(own: list, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first character, counted over all texts) of sections that are given by their starts."""
    lists = [sorted({0, *(x for x in o if x is not None and 0 <= x < max(1, n))}) for o, n in zip(own, sizes.tolist())]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return doc, np.array([x for o in lists for x in o], np.int64) + (np.cumsum(sizes) - sizes)[doc]


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, end: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section. Tokens reach from first up to last; sections from starts to the next or to end."""
    a = np.searchsorted(starts, first, side="right") - 1
    b = np.searchsorted(starts, np.maximum(last - 1, first), side="right") - 1
    home = b.copy() if rule == "last" else a.copy()
    crossing = np.flatnonzero(a != b)
    if rule == "most" and len(crossing):
        n = (b - a + 1)[crossing]
        new = np.cumsum(n) - n
        section = np.repeat(a[crossing] - new, n) + np.arange(int(n.sum()))
        edges, token = np.append(starts, end), np.repeat(crossing, n)
        part = np.minimum(edges[section + 1], last[token]) - np.maximum(edges[section], first[token])
        best = np.flatnonzero(part == np.repeat(np.maximum.reduceat(part, new), n))
        home[crossing] = section[best[np.searchsorted(best, new)]]  # the earliest of equals
    return np.bincount(home, minlength=len(starts)), np.bincount(home[crossing], minlength=len(starts))


def _count_partition(path: str, rule: str, special: bool):
    def run(rows):
        enc = encoder(path, special)
        for batch in rows:
            for s in text_slices(batch):
                data, ends = column_bytes(s.column(1))
                ids, counts = enc.encode_column(s.column(1))
                upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters that begin before each byte
                stop = np.cumsum(enc.n_bytes[ids])
                first, last = upto[np.minimum(stop - enc.n_bytes[ids] + 1, len(data))] - 1, upto[stop]
                doc, at = line_starts(data, ends)
                at, edges = upto[at], upto[ends]
                if s.num_columns > 2:
                    own = s.column(2).to_pylist()
                    theirs = given_starts([x or [] for x in own], np.diff(edges))
                    lines = np.array([x is None for x in own], bool)
                    doc, at = (np.concatenate([x[lines[doc]], y[~lines[theirs[0]]]]) for x, y in zip((doc, at), theirs))
                    order = np.lexsort((at, doc))
                    doc, at = doc[order], at[order]
                n, crossing = allocate(first, last, at, int(edges[-1]), rule)
                begin = np.searchsorted(doc, np.arange(len(ends) - 1))
                stops = np.append(at[1:], edges[-1])
                stops[np.append(begin[1:], len(doc)) - 1] = edges[1:]
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(pa.array(doc)), pa.array((np.arange(len(doc)) - begin[doc]).astype(np.int32)), *(pa.array(x.astype(np.int64)) for x in (at - edges[doc], stops - edges[doc], n, crossing, counts[doc]))],
                    names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"],
                )

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, rule: str = "most", key: str = "doc_id", text: str = "text", starts: str | None = None, special: bool = True) -> DataFrame:
    """Tokens of every section of every document: a row per section, numbered from 0.

    Sections are the text's lines, or begin at the character offsets in the array column `starts` (0 is added; offsets
    outside the text are ignored; a null array means lines). A null or empty text has one empty section without tokens. Repeated
    rows give repeated results, a null key stays null, other columns are ignored, an empty table gives no rows. No shuffle.
    special: whether strings of the tokenizer's added tokens in a text become those tokens, as by the library's default.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    lean = [F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")]
    if starts:
        lean.append(F.col(starts).cast("array<long>").alias("starts"))
    return docs.select(*lean).mapInArrow(_count_partition(tokenizer_path, rule, special), _OUT)
