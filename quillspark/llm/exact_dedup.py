"""Exact deduplication by Grace hash partitioning.

The shuffle is the first level of partitioning: records go to the task of their content's hash. A task reads records into an
open-addressing table that compares complete contents; when the contents outgrow its budget it spills them to sixteen files
by the next four bits of the hash and treats each file the same way, until a bucket fits. Before the shuffle every task collapses equal
contents through the same table, so a text that a third of the rows share is sent once per task, not once per row.
"""

from __future__ import annotations

import os
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_SPACES = r"[\x20\x09-\x0D]+"
_CLASS = "digest binary, keep_id long, group_size long"
_CONTENT = "digest binary, min_id long, n long, content string"
_RECORD = struct.Struct("<32s?qqI")
#: Bytes of distinct contents that a table may hold.
BUDGET = 96 << 20


class ContentTable:
    """Open addressing with linear probing over complete contents: content -> [digest, smallest id, rows]."""

    def __init__(self):
        self.slots = np.full(1024, -1, np.int64)
        self.entries: list[list] = []
        self.bytes = 0

    def _find(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[24:32], "little") & mask
        slots, entries = self.slots, self.entries
        while (e := slots[at]) >= 0:
            if entries[e][3] == content:
                return at
            at = (at + 1) & mask
        return at

    def add(self, digest: bytes, low: int | None, n: int, content: bytes) -> None:
        at = self._find(digest, content)
        if (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            entry[2] += n
            if low is not None and (entry[1] is None or low < entry[1]):
                entry[1] = low
            return
        self.slots[at] = len(self.entries)
        self.entries.append([digest, low, n, content])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int64)
            for i, (d, _, _, c) in enumerate(self.entries):
                self.slots[self._find(d, c)] = i


def _write(f, r) -> None:
    f.write(_RECORD.pack(r[0], r[1] is None, r[1] or 0, r[2], len(r[3])))
    f.write(r[3])


def _read(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while head := f.read(_RECORD.size):
            digest, null, low, n, size = _RECORD.unpack(head)
            yield digest, None if null else low, n, f.read(size)


def grace(records: Iterable[tuple], folder: str, budget: int = BUDGET, level: int = 0) -> Iterator[list]:
    """Distinct contents of (digest, id, rows, content) with their smallest id and rows; folder takes the spill files."""
    table, it = ContentTable(), iter(records)
    for r in it:
        table.add(*r)
        if table.bytes > budget and len(table.entries) > 1 and level < 64:
            break
    else:
        yield from table.entries
        return
    own = tempfile.mkdtemp(dir=folder)
    paths = [os.path.join(own, str(b)) for b in range(16)]
    files = [open(p, "wb") for p in paths]  # noqa: SIM115
    nibble = lambda d: d[level >> 1] >> 4 if level & 1 == 0 else d[level >> 1] & 15
    try:
        for r in table.entries:
            _write(files[nibble(r[0])], r)
        del table
        for r in it:
            _write(files[nibble(r[0])], r)
    finally:
        for f in files:
            f.close()
    for p in paths:
        if os.path.getsize(p):
            yield from grace(_read(p), own, budget, level + 1)
        os.remove(p)
    shutil.rmtree(own, ignore_errors=True)


def _records(rows) -> Iterator[tuple]:
    for batch in rows:
        for d, low, n, c in zip(batch.column("digest").to_pylist(), batch.column("min_id").to_pylist(), batch.column("n").to_pylist(), batch.column("content")):
            yield d, low, n, bytes(memoryview(c.as_buffer()))


def _collapse(budget: int):
    """Before the shuffle: equal contents of a task become one record; a full table is handed on and emptied."""

    def flush(table: ContentTable):
        for at in range(0, len(table.entries), 2000):
            d, low, n, c = zip(*table.entries[at : at + 2000])
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(low, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.binary()).cast(pa.string())], names=["digest", "min_id", "n", "content"])

    def run(rows):
        table = ContentTable()
        for r in _records(rows):
            table.add(*r)
            if table.bytes > budget:
                yield from flush(table)
                table = ContentTable()
        yield from flush(table)

    return run


def _distinct(budget: int):
    def run(rows):
        # Spark's own spill folder of this executor: scratch of one task, gone with it and made anew if the task runs again
        top = os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0]
        os.makedirs(top, exist_ok=True)
        folder, seen = tempfile.mkdtemp(prefix="grace-", dir=top), []

        def out():
            d, low, n = zip(*seen)
            return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(low, pa.int64()), pa.array(n, pa.int64())], names=["digest", "keep_id", "group_size"])

        try:
            for d, low, n, _ in grace(_records(rows), folder, budget):
                seen.append((d, low, n))
                if len(seen) == 20_000:
                    yield out()
                    seen = []
            if seen:
                yield out()
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _hashed(docs: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(doc_id, content: normalised text, digest, more)."""
    lean = docs.select(F.col(key).cast("long").alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), _SPACES, " ").alias("content"), *more)
    return lean.withColumn("digest", F.unhex(F.sha2("content", 256)))


def content_classes(hashed: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(digest, keep_id, group_size) of every distinct content."""
    records = hashed.select("digest", F.col("doc_id").alias("min_id"), F.lit(1).cast("long").alias("n"), "content")
    return records.mapInArrow(_collapse(budget // 2), _CONTENT).repartition("digest").mapInArrow(_distinct(budget), _CLASS)


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """Every row of docs with the class of its text: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after each run of ASCII white space has become one space; null counts as empty. keep_id is
    the smallest key of the class, null keys last, and exactly one row of a class is kept, also where rows repeat
    with one key. A class of null keys has keep_id null. Other columns are ignored; an empty table gives no rows.
    """
    hashed = _hashed(docs, key, text)
    rows = hashed.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))  # repeated rows, without a hot task
    joined = rows.join(content_classes(hashed, budget), "digest")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return joined.select("doc_id", "keep_id", "group_size", copy.alias("copy"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row of docs, with all its columns, for each class of equal texts: one with the smallest key, null keys last.

    Of rows that share key and class, which one stays is not defined; the others are dropped before the rows are shuffled. All columns
    stay, whatever their names; an empty table gives no rows.
    """
    null = lambda c: F.col(c).isNull()
    own = _hashed(docs, key, text, F.struct(*docs.columns).alias("row"))
    one = own.groupBy("digest", F.coalesce("doc_id", F.lit(0)).alias("k"), null("doc_id").alias("null")).agg(F.first("row").alias("row"))
    low = content_classes(own, budget).select("digest", F.coalesce("keep_id", F.lit(0)).alias("k"), null("keep_id").alias("null"))
    return one.join(low, ["digest", "k", "null"], "left_semi").select("row.*")
