"""Byte-level BPE through a sentencepiece model that is written, not trained.

The model file is a serialised protocol buffer: one piece per rank, its bytes mapped to printable characters one to one,
scored by its negative rank, with identity normalisation. sentencepiece's BPE joins the adjacent pair of the highest score,
the leftmost of equals, so it makes the merges that the ranks ask for. Texts are split by the pattern and every pre-token is
encoded on its own, once for each distinct piece between safe cuts (see tokenizer); ids are decoded through the inverse of the byte mapping.
"""

from __future__ import annotations

import base64
import functools
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.tokenizer import PiecePool, column_bytes, safe_cuts
from quillspark.llm.worker import digests, resident, text_slices

_BPE, _UNKNOWN = 2, 2  # TrainerSpec.ModelType.BPE, SentencePiece.Type.UNKNOWN


@functools.cache
def byte_chars() -> list[str]:
    """A printable character for each byte: itself where Latin-1 has one, else those from U+0100 on, in order."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(n): base64.b64decode(t) for t, n in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[n] for n in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float | str) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(tokens: list[bytes]) -> bytes:
    """A ModelProto: pieces (1: piece, 2: score, 3: type), trainer_spec (2), normalizer_spec (3)."""
    chars = byte_chars()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t)) + _field(2, -float(rank))) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN)))  # required; all bytes are pieces, so never used
    trainer = _field(3, _BPE) + _field(4, len(pieces)) + _field(24, 0) + _field(40, len(tokens)) + b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))
    normal = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, no space removal, no escaping
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal)


class BytePairCodec:
    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(ranks_path)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(tokens))
        self.to_chars = dict(enumerate(byte_chars()))
        back = {c: b for b, c in enumerate(byte_chars())}
        inverse = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        self.bytes, self.sizes = np.frombuffer(b"".join(inverse), np.uint8), np.fromiter(map(len, inverse), np.int64, len(inverse))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = PiecePool(self._encode)

    def _encode(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        words = [self.split(p.decode("utf-8", "surrogatepass")) for p in pieces]
        ids = self.model.encode([w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars) for ws in words for w in ws], num_threads=1)
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        each = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        return pieces, np.fromiter(chain.from_iterable(ids), np.uint32, int(upto[-1])), np.diff(upto[each])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each text has)."""
        data, ends = column_bytes(texts)
        cuts = np.flatnonzero(safe_cuts(data, ends)) if len(data) else np.zeros(1, np.int64)
        ids, sizes = self.pool.gather(data, cuts)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(upto[np.searchsorted(cuts, ends)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts one after another, how many each has), of ids one after another and their counts."""
        sizes = self.sizes[ids]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[ids] - upto[:-1], sizes)
        at += np.arange(len(at))
        return self.bytes[at], np.diff(upto[np.concatenate([[0], np.cumsum(counts)])])


def codec(ranks_path: str, pattern: str) -> BytePairCodec:
    """One codec for each Python worker."""
    return resident(("codec", ranks_path, pattern), lambda: BytePairCodec(ranks_path, pattern))


def _digest_partition(ranks_path: str, pattern: str):
    def run(rows):
        bpe = codec(ranks_path, pattern)
        for batch in rows:
            for s in text_slices(batch):
                ids, n = bpe.encode_column(s.column(1))
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n), pa.array(digests(ids.astype("<u4"), 4 * n)), pa.array(digests(*bpe.decode(ids, n)))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, SHA-256 of the ids and of the decoded bytes.

    One row per row of docs, repeated rows too, without a shuffle. Null texts are empty (no tokens); a null key stays null;
    other columns are ignored; an empty table gives no rows.
    """
    lean = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return lean.mapInArrow(_digest_partition(ranks_path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
