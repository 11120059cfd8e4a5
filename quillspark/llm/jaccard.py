"""Near duplicates by the exact Jaccard similarity of word shingles.

Candidates come from prefix filtering, which loses no pair. Put the shingles of every document in one order, rarest in the corpus
first. Two sets of similarity 0.8 or more share one of the first n - ceil(0.8 n) + 1 shingles of each (n: its size). Shingles that only one
document has come first and are shared with nobody, so most prefixes have nothing left to look up, and common passages are looked up only
by documents that hold little else. Of two sets whose first common shingle has k shingles from it on in the smaller rest, at most k are common, which
rules out most of the others.

Documents that share a prefix shingle meet in its cell. A document has to find one similar document before it in the order of
keys: it tries the first two of its rarest cell, then the first few of each of its cells, then the next four times as many, and so on until it has found one or tried all of them.
So a large group of copies costs a few tries each, and nothing is left untried. Shingles are told apart by a 64-bit hash.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillspark.llm.worker import text_slices
from quillspark.workspace import ROW, discard, materialize

WIDTH = 5
SEED = 42
#: Shingles are dealt to so many parts by their hash, and counted a part at a time.
PARTS = 1024
#: Bytes of a hash, besides the part that it leads to, by which shingles are counted. If two meet, a pair more may be verified, none less.
_CELL_BYTES = 5
_SLICE_BYTES = 8_000_000
_RAREST_TRIES, _FIRST_TRIES, _MORE = 2, 4, 4


def shingle_set(text: str | bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, A-Z lower-cased; a shorter text is one shingle, one without words none."""
    import xxhash

    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()  # bytes.split() parts at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(width)))) if n > 1 else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, n)))


def _packed(h: np.ndarray, own: np.ndarray, n: np.ndarray) -> bytes:
    """Numbers byte by byte, all first ones, all second ones and so on, compressed: those that hardly vary take next to nothing."""
    planes = [x.view(np.uint8).reshape(len(x), x.itemsize).T[:size].tobytes() for x, size in ((h, _CELL_BYTES), (own, 8), (n, 4))]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, count: int) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(pa.decompress(blob, (_CELL_BYTES + 12) * count, codec="zstd", asbytes=True), np.uint8), 0, []
    for kind, size in (("<u8", _CELL_BYTES), ("<i8", 8), ("<u4", 4)):
        x = np.zeros((count, np.dtype(kind).itemsize), np.uint8)
        x[:, :size] = raw[at : at + size * count].reshape(size, count).T
        out.append(x.view(kind).ravel())
        at += size * count
    return out


def _sets_of(part: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return [shingle_set(bytes(memoryview(t.as_buffer())) if t.is_valid else None, width) for t in part.column(1)]


def _deal(width: int):
    def run(rows):
        for batch in rows:
            for part in text_slices(batch, 1, _SLICE_BYTES):
                sets = _sets_of(part, width)
                sizes = np.array([len(s) for s in sets], np.int64)
                h = np.concatenate(sets)
                if not len(h):
                    continue
                order = np.argsort(h)
                h = h[order]
                own = np.repeat(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), sizes)[order]
                n = np.repeat(sizes, sizes)[order].astype(np.uint32)
                ends = np.searchsorted(h, np.arange(1, PARTS, dtype=np.uint64) * np.uint64((1 << 64) // PARTS))  # parts by the first bits
                cuts = [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends.tolist()], [*ends.tolist(), len(h)])) if b > a]
                for at in range(0, len(cuts), 128):
                    some = cuts[at : at + 128]
                    blobs = [_packed(h[a:b], own[a:b], n[a:b]) for _, a, b in some]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.int32()), pa.array([b - a for _, a, b in some], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "count", "blob"])

    return run


def _shared(rows):
    """Of the shingles that two documents or more have: row, size of its set, shingle, documents. Rows come in the order of parts."""

    def out(part, held):
        h, own, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        h = h[order] + np.uint64(part << 8 * _CELL_BYTES)
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        df = np.diff(np.append(new, len(h)))
        df = np.repeat(df, df)
        at = np.flatnonzero(df > 1)
        for s in range(0, len(at), 100_000):
            i = at[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own[order[i]]), pa.array(n[order[i]].astype(np.int64)), pa.array(h[i].view(np.int64)), pa.array(df[i].astype(np.int64))], names=["row", "n", "h", "df"])

    now, held = None, []
    for batch in rows:
        for k, count, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "count", "blob"))):
            if k != now:
                if held:
                    yield from out(now, held)
                now, held = k, []
            held.append(_unpacked(blob, count))
    if held:
        yield from out(now, held)


def _sets(width: int):
    def run(rows):
        for batch in rows:
            for part in text_slices(batch, 1, _SLICE_BYTES // 4):
                sets = _sets_of(part, width)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["row", "shingles"])

    return run


def _tries(low: int, high: int, num: int, den: int):
    """Pairs (row, other) with the members of a cell at places low to high before an open row; other null: there are more."""

    def run(rows):
        now, ids, sizes = None, [], []
        for batch in rows:
            a, b = [], []
            for h, row, n, left, is_open in zip(*(batch.column(c).to_pylist() for c in ("h", "row", "n", "left", "open"))):
                if h != now:
                    now, ids, sizes = h, [], []
                if is_open:
                    for x, (m, theirs) in zip(ids[low:high], sizes[low:high]):
                        # if this is the first shingle that both have, no more than what is left can be common
                        if den * min(n, m) >= num * max(n, m) and (num + den) * min(left, theirs) >= num * (n + m):
                            a.append(row)
                            b.append(x)
                    if len(ids) > high:
                        a.append(row)
                        b.append(None)
                ids.append(row)
                sizes.append((n, left))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["row", "other"])

    return run


def rows_near_earlier(rows: DataFrame, num: int = 4, den: int = 5, width: int = WIDTH, key: str = "doc_id", text: str = "text", first: DataFrame | None = None) -> DataFrame:
    """Row ids of the rows (of with_row_ids) that have a similarity of num/den or more to a row with a smaller key.

    first: candidates (row, other), other with the smaller key, that are verified before all others. Null keys come after all others; rows of one key come in the order of their row ids. Texts without words are similar to none.
    """
    lean = rows.select(ROW, F.col(text).alias("text"))
    dealt = lean.mapInArrow(_deal(width), "part int, count int, blob binary")
    shared = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_shared, "row long, n long, h long, df long")
    own = shared.groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("x"))
    # the prefix without the shingles that no other document has
    prefix = F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1 - (n - size(x))").cast("int")
    cells = own.withColumn("left", prefix).where("left > 0").select("row", "n", F.size("x").alias("shared"), F.posexplode(F.slice("x", F.lit(1), F.col("left"))).alias("place", "x"))
    cells = cells.select("row", "n", "place", (F.col("shared") - F.col("place")).alias("left"), F.col("x.h").alias("h"))
    dealt = cells = materialize(cells, "near-cells")
    met = cells.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    keys = rows.select(F.col(ROW).alias("row"), F.col(key).cast("long").alias("key"))
    rarest = F.row_number().over(Window.partitionBy("row").orderBy("place")) == 1
    cells = materialize(cells.join(met, "h").join(keys, "row").withColumn("rarest", rarest).drop("place"), "near-cells")
    discard(dealt)
    sets = materialize(lean.join(cells.select(F.col("row").alias(ROW)).distinct(), ROW, "left_semi").mapInArrow(_sets(width), "row long, shingles array<long>"), "near-sets")
    other = sets.select(F.col("row").alias("other"), F.col("shingles").alias("theirs"))
    common = F.size(F.array_intersect("shingles", "theirs"))
    similar = (num + den) * common >= num * (F.size("shingles") + F.size("theirs"))
    verified = lambda pairs: materialize(pairs.join(sets, "row").join(other, "other").where(similar).select("row").distinct(), "near-found")
    def settled(tried, low, high):
        """Pairs of open rows with the members of their cells at places low to high before them, and the rows found similar by them."""
        order = F.col("key").asc_nulls_last()
        pairs = tried.repartition("h").sortWithinPartitions("h", order, "row").mapInArrow(_tries(low, high, num, den), "row long, other long").distinct()
        pairs = materialize(pairs, "near-pairs")
        return pairs, verified(pairs.where("other IS NOT NULL"))

    def opened(rows_left):
        return cells.join(rows_left.withColumn("open", F.lit(True)), "row", "left").withColumn("open", F.coalesce("open", F.lit(False)))

    candidates = cells.where("rarest").select("row")
    gone = verified(first) if first is not None else candidates.limit(0)
    # most near copies are found where their rarest shingle leads
    left = candidates.join(gone, "row", "left_anti")
    tried, found = settled(opened(left).withColumn("open", F.col("open") & F.col("rarest")), 0, _RAREST_TRIES)
    discard(tried)
    gone = gone.union(found)
    left = materialize(candidates.join(gone, "row", "left_anti"), "near-open")
    low, high = 0, _FIRST_TRIES
    while not left.isEmpty():
        tried, found = settled(opened(left), low, high)
        gone = gone.union(found)
        after = materialize(tried.where("other IS NULL").select("row").join(found, "row", "left_anti"), "near-open")
        discard(tried, left)
        left = after
        low, high = high, high + (high - low) * _MORE
    return gone
