"""Exact vector search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import col

#: Vectors that a task of the all-pairs join holds at most, and at least where there are more cores than such tasks; vectors compared with them at once.
BLOCK, LEAST_BLOCK, _STREAMED = 4096, 512, 1024


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column | str) -> Column:
    n = norm(v)
    return F.transform(col(v), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def top_k(vectors: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """The k rows most similar to a unit query: similarity = dot product; ties by key. One pass and a top-k per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("similarity", F.round(dot(vector, q), digits)).orderBy(F.desc("similarity"), key).limit(k)


class _Nearest:
    """The k nearest of the vectors shown so far to each vector of a block; ties by id."""

    def __init__(self, ids: np.ndarray, block: np.ndarray, k: int, digits: int):
        self.ids, self.block, self.digits = ids, block, digits
        self.sims, self.others = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def show(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        k = self.sims.shape[1]
        sims = np.hstack([self.sims, np.round(self.block @ vectors.T, self.digits)])
        others = np.hstack([self.others, np.broadcast_to(ids, (len(sims), len(ids)))])
        least = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        row, at = np.nonzero(sims >= least)  # k a row, or more with ties
        order = np.lexsort((others[row, at], -sims[row, at], row))
        row, at = row[order], at[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < k
        self.sims, self.others = sims[row[best], at[best]].reshape(-1, k), others[row[best], at[best]].reshape(-1, k)

    def result(self) -> pa.RecordBatch:
        row, at = np.nonzero(self.sims > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.others[row, at]), pa.array(self.sims[row, at]), pa.array((at + 1).astype(np.int32))], names=["a", "b", "similarity", "rank"])


def _stream_past_blocks(k: int, digits: int):
    """Rows come by block, its own first, then all, in batches."""

    def run(batches):
        now, held, near = None, [], None
        for batch in batches:
            p, side, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p", "side", "id"))
            v = batch.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            cuts = np.flatnonzero(np.diff(p) | np.diff(side)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                if p[s] != now:
                    if near is not None:
                        yield near.result()
                    now, held, near = p[s], [], None
                if side[s] == 0:
                    held.append((ids[s:e], flat[s:e]))
                    continue
                if near is None and held:
                    near, held = _Nearest(*(np.concatenate(x) for x in zip(*held)), k, digits), []
                for i in range(s, e if near is not None else s, _STREAMED):
                    near.show(ids[i : min(e, i + _STREAMED)], flat[i : min(e, i + _STREAMED)])
        if near is not None:
            yield near.result()

    return run


def knn_join(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(a, b, similarity, rank): every vector with its k most similar, itself among them; ties by b. Rows without key or vector have none.

    A task holds a block of vectors, with the k best of each, and all vectors stream past it, as matrix products. So one side only is copied, a block holds
    a bounded number of rows, and what a task returns is final. Exact, and quadratic in arithmetic as the operator is defined.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    n = rows.count()
    blocks = max(1, -(-n // BLOCK), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_BLOCK)))
    own = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("p"), F.lit(0).alias("side"))
    streamed = rows.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("p"), F.lit(1).alias("side"))
    dealt = own.unionByName(streamed).repartitionById(blocks, "p").sortWithinPartitions("p", "side")
    return dealt.mapInArrow(_stream_past_blocks(k, digits), "a long, b long, similarity double, rank int")
