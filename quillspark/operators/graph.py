"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.workspace import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected edge table; component is the smallest node of its component.

    Alternating large-star and small-star contraction (Kiveris et al., SoCC 2014): O(log n) rounds whatever the diameter,
    each round two shuffles of at most the edge count, written to the shared folder in place of the round before, so lineage stays short. Hot nodes
    (a star centre with a third of the edges) are only ever aggregated by min(), which combines before the shuffle, and
    joined back, where adaptive execution splits a skewed side. Edges with a null end and self loops are ignored: a node
    that appears only in those is not returned.
    """
    e = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    )
    e = materialize(e.distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        after = materialize(_small_star(_large_star(e)), "edges")
        discard(e)
        e = after
        # a fixed point of both contractions is a set of stars, each centred on its smallest node
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    )


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the smallest node of the node's closed neighbourhood."""
    both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(e.select(F.col("v").alias("a"), F.col("u").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = both.where("b > a").join(low, "a").select(F.col("m").alias("u"), F.col("b").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them. Edges have u < v."""
    low = e.groupBy("v").agg(F.min("u").alias("m"))
    moved = e.join(low, "v").select(F.col("m").alias("p"), F.explode(F.array("u", "v")).alias("q"))
    return moved.where("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct()
