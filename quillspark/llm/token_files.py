"""Token ids on disk: patched frame-of-reference blocks.

A segment image holds the ids of consecutive documents: a header, the documents' lengths, an index of block starts, and
blocks of 1024 ids. A block subtracts its minimum, packs the differences at the width that a given share of them fits, and
stores the high bits of the others in an exception list (positions and high parts), so one rare id does not widen the rest. Widths are even,
so that four values make whole bytes.

Layout of an image, little-endian:
  magic 'PFR1' | u32 docs | u64 ids | u32 blocks | i64 first id's place in its partition
  i64 doc keys [docs] | u8 key is null [docs] | u32 doc lengths [docs] | u64 block starts [blocks] | blocks
  block: u32 minimum | u16 width | u16 exceptions | u16 ids | packed low bits | u16 positions | u32 high parts
Images are rows of a table (part, seq, first_place, n_ids, image), since only Spark's writers reach every store and commit
a task's output once; an image is a file of its own to anything that reads it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quillspark.llm.tokenizer import encoder, with_end
from quillspark.llm.worker import text_slices

BLOCK = 1024
MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIQIq")
_BLOCK = struct.Struct("<IHHH")
#: An image holds so many ids at most; a longer document has an image to itself.
IMAGE_IDS = 1 << 20

IMAGES = T.StructType([T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("seq", T.IntegerType()), ("first_place", T.LongType()), ("n_ids", T.LongType()), ("image", T.BinaryType()))])


def _pack_rows(v: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2**width, width even and 16 at most or 32: four values make width/2 bytes; rows are padded to fours."""
    if width == 0:
        return np.zeros((len(v), 0), np.uint8)
    v = np.pad(v, ((0, 0), (0, -v.shape[1] % 4)))
    if width > 16:
        return v.astype("<u4").view(np.uint8)
    q = v.reshape(len(v), -1, 4).astype(np.uint64)
    acc = q[:, :, 0]
    for i in (1, 2, 3):
        acc = acc | q[:, :, i] << np.uint64(i * width)
    return np.ascontiguousarray(acc.astype("<u8").view(np.uint8).reshape(len(v), -1, 8)[:, :, : width // 2]).reshape(len(v), -1)


def _unpack_rows(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    if width == 0:
        return np.zeros((len(raw), n), np.uint32)
    if width > 16:
        return np.ascontiguousarray(raw).view("<u4")[:, :n].copy()
    acc = np.zeros((len(raw), -(-n // 4), 8), np.uint8)
    acc[:, :, : width // 2] = raw.reshape(len(raw), -1, width // 2)
    acc = acc.reshape(len(raw), -1).view("<u8")
    out = np.empty((len(raw), acc.shape[1], 4), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(4):
        out[:, :, i] = (acc >> np.uint64(i * width)) & mask
    return out.reshape(len(raw), -1)[:, :n]


def _row_bytes(n: int, width: int) -> int:
    return -(-n // 4) * (16 if width > 16 else width // 2)


def encode_blocks(ids: np.ndarray, share: float = 0.9) -> list[bytes]:
    """Blocks of ids; the width of a block is the least (even; 32 above 16) that `share` of its differences fit."""
    out: list[bytes] = [b""] * -(-len(ids) // BLOCK)
    whole = len(ids) // BLOCK
    groups = [(np.arange(whole), ids[: whole * BLOCK].reshape(whole, BLOCK))] if whole else []
    if len(ids) % BLOCK:
        groups.append((np.array([whole]), ids[whole * BLOCK :].reshape(1, -1)))
    for at, rows in groups:
        base = rows.min(axis=1)
        diff = (rows - base[:, None]).astype(np.uint32)
        k = min(rows.shape[1] - 1, int(np.ceil(share * rows.shape[1])) - 1)
        top = np.partition(diff, k, axis=1)[:, k]
        widths = np.array([n + n % 2 if n <= 16 else 32 for n in map(int.bit_length, top.tolist())])
        for w in np.unique(widths).tolist():
            mine = np.flatnonzero(widths == w)
            d = diff[mine]
            low = _pack_rows(d & np.uint32((1 << w) - 1), w)
            row, pos = np.nonzero(d >> np.uint32(w)) if w < 32 else (np.zeros(0, int), np.zeros(0, int))
            high = (d[row, pos] >> np.uint32(min(w, 31))).astype("<u4")
            cuts = np.searchsorted(row, np.arange(len(mine) + 1))
            for i, b in enumerate(mine.tolist()):
                s, e = cuts[i], cuts[i + 1]
                out[at[b]] = _BLOCK.pack(int(base[b]), w, e - s, rows.shape[1]) + low[i].tobytes() + pos[s:e].astype("<u2").tobytes() + high[s:e].tobytes()
    return out


def decode_block(buf: memoryview, at: int) -> np.ndarray:
    base, width, nx, n = _BLOCK.unpack_from(buf, at)
    at += _BLOCK.size
    size = _row_bytes(n, width)
    v = _unpack_rows(np.frombuffer(buf, np.uint8, size, at)[None, :], width, n)[0].copy()
    at += size
    if nx:
        v[np.frombuffer(buf, "<u2", nx, at)] |= np.frombuffer(buf, "<u4", nx, at + 2 * nx) << np.uint32(width)
    return v + np.uint32(base)


def encode_image(keys: list, lengths: list[int], ids: np.ndarray, place: int, share: float = 0.9) -> bytes:
    """An image of documents whose ids follow one another in `ids`; place: ids before them in their partition."""
    blocks = encode_blocks(ids, share)
    head = _HEAD.pack(MAGIC, len(lengths), len(ids), len(blocks), place)
    tables = np.array([0 if k is None else k for k in keys], "<i8").tobytes() + np.array([k is None for k in keys], np.uint8).tobytes() + np.array(lengths, "<u4").tobytes()
    first = len(head) + len(tables) + 8 * len(blocks)
    starts = first + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[:-1] if blocks else []
    return b"".join([head, tables, np.array(starts, "<u8").tobytes(), *blocks])


class Image:
    """Reader of an image; any range of ids without the blocks around it."""

    def __init__(self, data: bytes):
        self.buf = memoryview(data)
        magic, docs, self.n_ids, blocks, self.place = _HEAD.unpack_from(self.buf, 0)
        if magic != MAGIC:
            raise ValueError("not a token image")
        at = _HEAD.size
        keys, null = np.frombuffer(self.buf, "<i8", docs, at), np.frombuffer(self.buf, np.uint8, docs, at + 8 * docs)
        self._keys, self._null = keys, null.astype(bool)
        self.lengths = np.frombuffer(self.buf, "<u4", docs, at + 9 * docs).astype(np.int64)
        self.starts = np.frombuffer(self.buf, "<u8", blocks, at + 13 * docs).astype(np.int64)

    def key_array(self) -> pa.Array:
        return pa.array(self._keys, pa.int64(), mask=self._null)

    @property
    def keys(self) -> list:
        return self.key_array().to_pylist()

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        if first == 0 and stop == self.n_ids:
            return self._all()[start:stop]
        got = np.concatenate([decode_block(self.buf, int(self.starts[b])) for b in range(first, last + 1)])
        return got[start - first * BLOCK : stop - first * BLOCK]

    def _all(self) -> np.ndarray:
        """All blocks, those of one width together."""
        raw = np.frombuffer(self.buf, np.uint8)
        heads = np.lib.stride_tricks.sliding_window_view(raw, _BLOCK.size)[self.starts].copy()
        base = heads[:, :4].copy().view("<u4")[:, 0]
        width, nx, n = (heads[:, i : i + 2].copy().view("<u2")[:, 0].astype(int) for i in (4, 6, 8))
        out = np.zeros((len(base), BLOCK), np.uint32)
        for w, m in {*zip(width.tolist(), n.tolist())}:
            mine = np.flatnonzero((width == w) & (n == m))
            size = _row_bytes(m, w)
            rows = np.empty((len(mine), size), np.uint8)
            for i, b in enumerate(mine.tolist()):
                s = int(self.starts[b]) + _BLOCK.size
                rows[i] = raw[s : s + size]
            out[mine, :m] = _unpack_rows(rows, w, m)
        for b in np.flatnonzero(nx).tolist():
            at, k = int(self.starts[b]) + _BLOCK.size + _row_bytes(int(n[b]), int(width[b])), int(nx[b])
            out[b, np.frombuffer(self.buf, "<u2", k, at)] |= np.frombuffer(self.buf, "<u4", k, at + 2 * k) << np.uint32(width[b])
        return (out + base[:, None]).reshape(-1)[: self.n_ids]


def _write_partition(path: str, end_id: int, share: float, special: bool):
    def run(rows):
        enc, part = encoder(path, special), TaskContext.get().partitionId()
        place = seq = held = 0
        keys, sizes, ids = [], [], []

        def image():
            own = np.concatenate(ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([place], pa.int64()), pa.array([len(own)], pa.int64()), pa.array([encode_image(keys, sizes, own, place, share)], pa.binary())], names=IMAGES.names)

        for batch in rows:
            for s in text_slices(batch):
                flat, counts = with_end(*enc.encode_column(s.column(1)), end_id)
                at = done = 0  # ids of this slice: seen, and handed to an image
                for k, n in zip(s.column(0).to_pylist(), counts.tolist()):
                    if held and held + n > IMAGE_IDS:
                        ids.append(flat[done:at])
                        yield image()
                        place, seq, held, done, keys, sizes, ids = place + held, seq + 1, 0, at, [], [], []
                    keys.append(k)
                    sizes.append(n)
                    held, at = held + n, at + n
                ids.append(flat[done:])
        if keys:
            yield image()

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, share: float = 0.9, key: str = "doc_id", text: str = "text", special: bool = True) -> None:
    """Encode whole texts and write images under path, in ascending key order over all files (null keys first).

    One range shuffle of the texts orders them; ids are made after it and never shuffled. Ties keep any order among
    themselves. Null texts are empty. Other columns are ignored; an empty table writes a table without rows.
    """
    lean = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    lean = lean.repartitionByRange(n, "key").sortWithinPartitions("key")
    lean.mapInArrow(_write_partition(tokenizer_path, end_id, share, special), IMAGES).write.option("compression", "none").parquet(path)


def _read_partition(rows):
    for batch in rows:
        for image, base in zip(batch.column("image"), batch.column("base").to_pylist()):
            img = Image(image.as_buffer())
            ids = memoryview(img.ids().astype("<u4").tobytes())
            ends = np.cumsum(img.lengths)
            starts = ends - img.lengths
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([img.key_array(), pa.array(starts + img.place + base), pa.array(img.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under path."""
    images = spark.read.schema(IMAGES).parquet(path)
    totals = images.groupBy("part").agg(F.sum("n_ids").alias("total"))
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    # one row for each written partition, of which there were spark.sql.shuffle.partitions at most
    return images.select("part", "image").join(F.broadcast(base), "part").mapInArrow(_read_partition, "doc_id long, start long, n_tokens long, ids_crc32 long")
