"""SimHash fingerprints and near-duplicate components.

Fingerprints that differ in at most 3 bits are linked. A fingerprint is embedded as the bit counts of its 32 two-bit
segments, a point with coordinates 0, 1 or 2; the Manhattan distance of two points is a lower bound of the Hamming distance of
their fingerprints. If that distance is at most 3, it is at most 1 over the segments of one half. So the grid of each half
(one cell per vector of 16 bit counts) is range-joined at radius 1: a point stands in its own cell and looks into the 16 cells
one step up; of a pair one step apart, the lower point looks up. Who meet in a cell are verified exactly.

Equal fingerprints are one point with one row, so copies cost nothing. Cells are a fixed set, so they grow with the corpus: inside a
large one, points are compared only with those that have one of four 16-bit blocks in common, as any two linked ones have. Links of many points are reduced to a spanning
forest, never all pairs. Components come from star contraction of those links.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.jaccard import rows_near_earlier
from quillspark.operators.graph import connected_components
from quillspark.workspace import ROW, materialize, with_row_ids

MAX_BITS = 3
SEED = 42
_PAIRS = np.uint64(0x5555555555555555)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the text's word shingles, A-Z lower-cased, repeats counted; 0 without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.split() parts at ASCII white space only
    if not words:
        return 0
    n = len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + width - 1]
        m = len(part) - width + 1
        shingles = map(b" ".join, zip(*(part[i : i + m] for i in range(width))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(rows):
        for batch in rows:
            fp = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def link_cell(fp: np.ndarray, home: np.ndarray, most: int = MAX_BITS) -> list[tuple[int, int]]:
    """Indices of linked points of a cell, a spanning forest; of a pair one at least is at home in the cell."""
    out, left, todo = [], np.arange(len(fp)), []
    while len(left) or todo:
        if not todo:
            todo, left = [int(left[0])], left[1:]
        i = todo.pop()
        if not len(left):
            break
        near = np.bitwise_count(fp[left] ^ fp[i]) <= most
        if not home[i]:
            near &= home[left]
        if near.any():
            found = left[near].tolist()
            out += [(i, j) for j in found]
            todo += found
            left = left[~near]
    return out


def _small_cells(fp: np.ndarray, home: np.ndarray, cell: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside cells of few points: rows against the next, next but one and so on, all cells at once."""
    a, b = [], []
    for step in range(1, len(fp)):
        same = cell[step:] == cell[:-step]
        if not same.any():
            break
        hit = np.flatnonzero(same & (home[step:] | home[:-step]))
        hit = hit[np.bitwise_count(fp[hit] ^ fp[hit + step]) <= most]
        a.append(hit)
        b.append(hit + step)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _runs_linked(fp: np.ndarray, home: np.ndarray, run: np.ndarray, most: int, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal values of run: small runs all at once, the others by a spanning forest each."""
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.append(starts, len(run)))
    tiny = np.flatnonzero(np.repeat(sizes <= small, sizes))
    pairs = [tuple(tiny[x] for x in _small_cells(fp[tiny], home[tiny], run[tiny], most))]
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        found = np.array(link_cell(fp[s : s + n], home[s : s + n], most), np.int64).reshape(-1, 2) + s
        pairs.append((found[:, 0], found[:, 1]))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    return a, b


def link_large_cell(fp: np.ndarray, home: np.ndarray, most: int = MAX_BITS, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links of a cell of many points: of four blocks of 16 bits, two fingerprints that differ in three bits at most have one in common,
    so points are compared with those of an equal block only."""
    a, b = [], []
    for block in range(4):
        value = (fp >> np.uint64(16 * block)) & np.uint64(0xFFFF)
        order = np.argsort(value, kind="stable")
        x, y = _runs_linked(fp[order], home[order], value[order], most, small)
        a.append(order[x])
        b.append(order[y])
    return np.concatenate(a), np.concatenate(b)


def _link_partition(most: int, small: int = 24, large: int = 512):
    def links(cell, fp, home):
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        sizes = np.diff(np.append(starts, len(cell)))
        few = np.flatnonzero(np.repeat(sizes <= large, sizes))
        pairs = [tuple(few[x] for x in _runs_linked(fp[few], home[few], cell[few], most, small))] if len(few) else []
        for s, n in zip(starts[sizes > large].tolist(), sizes[sizes > large].tolist()):
            pairs.append(tuple(s + x for x in link_large_cell(fp[s : s + n], home[s : s + n], most, small)))
        a, b = (np.concatenate(x) for x in zip(*pairs))
        return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], names=["src", "dst"])

    def run(rows):
        # rows come in the order of their cells; the last cell of a batch may go on in the next
        held, size = [], 0
        for batch in rows:
            new = [batch.column("cell").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), batch.column("home").to_numpy(zero_copy_only=False)]
            if not len(new[0]):
                continue
            end = int(np.searchsorted(new[0], new[0][-1]))  # where the batch's last cell begins
            if size > 50_000 and (end or new[0][0] != held[-1][0][-1]):
                yield links(*(np.concatenate(x) for x in zip(*held, [x[:end] for x in new])))
                held, size, new = [], 0, [x[end:] for x in new]
            held.append(new)
            size += len(new[0])
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def fingerprint_links(points: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """(src, dst) of distinct fingerprints `fp` that differ in at most `most` (3 at most) bits; enough of them to connect all."""
    if not 0 <= most <= 3:
        raise ValueError("a radius of 1 in one of two halves holds for 3 bits at most")
    # two-bit counts of all 32 segments at once
    odd, even = (x.bitwiseAND(F.lit(int(_PAIRS))) for x in (F.col("fp"), F.shiftrightunsigned("fp", 1)))
    counts = odd.bitwiseXOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))
    halves = points.select("fp", counts.alias("c")).select(
        "fp", F.explode(F.array(F.col("c").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("c", 32).bitwiseOR(F.lit(1 << 40)))).alias("own")
    )
    up = [F.when(F.shiftright("own", 2 * i).bitwiseAND(F.lit(3)) < 2, F.col("own") + F.lit(1 << (2 * i))) for i in range(16)]
    cells = halves.select("fp", "own", F.explode(F.array_compact(F.array("own", *up))).alias("cell")).select("cell", "fp", (F.col("own") == F.col("cell")).alias("home"))
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_link_partition(most), "src long, dst long")


def _classes(marked: DataFrame, most: int) -> DataFrame:
    """(fp, root) of all fingerprints of marked; root is the same for all that links connect."""
    points = marked.select("fp").distinct()
    labels = connected_components(fingerprint_links(points, most))
    return points.join(labels, points["fp"] == labels["node"], "left").select("fp", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, most: int = MAX_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest key that links lead to, its own included.

    One row per row of docs, repeated rows too. Texts without words, null among them, have fingerprint zero, which links like any
    other. Null keys are never the smallest; a component of null keys has component_id null. Other columns are ignored; an empty
    table gives no rows.
    """
    lean = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked = materialize(lean.mapInArrow(_fingerprints(width), "doc_id long, fp long"), "simhash")
    points = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = points.join(_classes(marked, most), "fp")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def linked_rows(rows: DataFrame, width: int, most: int = MAX_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, other) of the rows of with_row_ids() that links lead to a row with a smaller key (null last), or an equal key and a smaller row id: the least one."""
    lean = rows.select(F.col(ROW).alias("doc_id"), F.col(text).alias("text"))
    marked = materialize(lean.mapInArrow(_fingerprints(width), "doc_id long, fp long"), "simhash")
    placed = marked.join(_classes(marked, most), "fp").select(F.col("doc_id").alias("row"), "root")
    keys = rows.select(F.col(ROW).alias("row"), F.col(key).isNull().alias("null"), F.col(key).cast("long").alias("key"))
    placed = materialize(placed.join(keys, "row"), "simhash")
    least = placed.groupBy("root").agg(F.min(F.struct("null", "key", "row")).alias("low"), F.count("*").alias("n")).where("n > 1").select("root", F.col("low.row").alias("other"))
    return placed.join(least, "root").where("row <> other").select("row", "other")


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows whose word shingles have a Jaccard similarity of num/den or more to those of a row with a smaller key.

    Fingerprint links give the first candidates, which are verified on the whole shingle sets. A similarity of 0.8 lets fingerprints
    differ in ten bits or so, far beyond what they can be searched for, so rows that no link settles are held against all
    that share a rare shingle (see jaccard), which misses none. Null keys come after all others; of rows that share a key, or repeat each other, the first
    row stays. Texts without words, null among them, are similar to none and stay. All columns stay, whatever their names; an empty table
    gives no rows.
    """
    rows = with_row_ids(docs.select(F.struct(*docs.columns).alias("own")))
    key, text = f"own.`{key}`", f"own.`{text}`"
    gone = rows_near_earlier(rows, num, den, width, key, text, linked_rows(rows, width, MAX_BITS, key, text)).select(F.col("row").alias(ROW))
    return rows.join(gone, ROW, "left_anti").select("own.*")
