"""Packing documents into training sequences: concatenate and cut.

Two passes. The first encodes every document once and writes ids, with each document's offset inside its partition. The
partitions' token totals (one row a partition) are then summed up to give each partition its global offset. The second pass
is narrow: a document at global offset g takes part of every window [k*L, (k+1)*L) that it meets, one piece each; a document
that runs over a boundary has a piece, and so a boundary record, on both sides of it. All sequences but the last are full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from quillspark.llm.tokenizer import encoder, with_end
from quillspark.llm.worker import binaries, text_slices
from quillspark.workspace import materialize

#: Partition offsets are broadcast up to this many partitions (about 32 MB); beyond it they are joined by a shuffle.
BROADCAST_PARTITIONS = 1_000_000

_ENCODED = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("doc_id", T.LongType()), ("local_start", T.LongType()), ("n_tokens", T.LongType()), ("ids", T.BinaryType()))])
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, crosses boolean"


def _encode_partition(path: str, end_id: int, special: bool):
    def run(rows):
        enc, part, at = encoder(path, special), TaskContext.get().partitionId(), 0
        for batch in rows:
            for s in text_slices(batch):
                ids, n = with_end(*enc.encode_column(s.column(1)), end_id)
                starts = at + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), s.column(0), pa.array(starts), pa.array(n), binaries(ids, 4 * n)],
                    names=[f.name for f in _ENCODED],
                )
                at += len(ids)

    return run


def _cut_partition(length: int):
    def run(rows):
        for batch in rows:
            keys, ids = batch.column("doc_id").to_pylist(), batch.column("ids")
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
            g = batch.column("global_start").to_numpy(zero_copy_only=False).astype(np.int64)
            first, last = g // length, (g + n - 1) // length
            count = last - first + 1
            doc = np.repeat(np.arange(len(n)), count)
            seq = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[doc]
            a = np.maximum(g[doc], seq * length)
            b = np.minimum(g[doc] + n[doc], (seq + 1) * length)
            start = a - g[doc]
            views = [memoryview(x.as_buffer()) for x in ids]
            crc = [zlib.crc32(views[d][4 * s : 4 * e]) for d, s, e in zip(doc.tolist(), start.tolist(), (start + b - a).tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[d] for d in doc.tolist()], pa.int64()), pa.array(start), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(seq), pa.array(a - seq * length), pa.array(count[doc] > 1)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "crosses"],
            )

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text", special: bool = True) -> DataFrame:
    """First pass, written to the shared folder: (part, doc_id, local_start, n_tokens, ids), ids with the end id."""
    lean = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(lean.mapInArrow(_encode_partition(tokenizer_path, end_id, special), _ENCODED), "packed-ids")


def partition_offsets(encoded: DataFrame) -> DataFrame:
    """Prefix sums over the partitions' totals: (part, base). One row a partition, whatever the corpus holds."""
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text", special: bool = True) -> DataFrame:
    """Pieces of documents in sequences of `length` ids.

    One row per piece: doc_id, start (the document's ids before it), length, ids_crc32 (unsigned, of the piece's ids as
    little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id, offset (in the sequence), crosses (whether
    the document runs over a boundary). Null texts are empty: one piece that holds the end id alone. Repeated rows, also
    those with one doc_id, are documents of their own. A null key stays null. An empty table gives no rows. Other columns
    of docs are ignored. The last sequence alone may be short; whoever fills tensors pads it. special: whether strings of the
    tokenizer's added tokens in a text become those tokens, as by the library's default.
    """
    encoded = encode_documents(docs, tokenizer_path, end_id, key, text, special)
    offsets = partition_offsets(encoded)
    parts = max(1, len(encoded.inputFiles()))
    if parts <= BROADCAST_PARTITIONS:
        offsets = F.broadcast(offsets)
    placed = encoded.join(offsets, "part").select("doc_id", "n_tokens", "ids", (F.col("base") + F.col("local_start")).alias("global_start"))
    return placed.mapInArrow(_cut_partition(length), _PIECES)
