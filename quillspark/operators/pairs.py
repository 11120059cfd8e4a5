"""Candidate pairs of chunks that may contradict each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import lexicon as L
from quillspark.functions.text import col, or_default, strip


def title_signature(title: Column | str) -> Column:
    """Distinct words of three letters and more without the common ones."""
    words = F.regexp_extract_all(F.lower(col(title)), F.lit("([а-яіїєґ'’ʼ]{3,})"), 1)
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, L.TITLE_STOPWORDS)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    x, y = col(a), col(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def same_template(a: Column | str, b: Column | str, threshold: float = 0.55) -> Column:
    """Whether two signatures overlap by the threshold; never where one is empty."""
    return (F.size(col(a)) > 0) & (F.size(col(b)) > 0) & (jaccard(a, b) >= threshold)


def band(neighbours: DataFrame, meta: DataFrame, low: float, high: float) -> DataFrame:
    """Neighbours (a, b, similarity) in the band and of another document; meta: (id, doc, category, title)."""
    m = lambda x: meta.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("doc", "category", "title")])
    return neighbours.where((F.col("a") != F.col("b")) & F.col("similarity").between(low, high)).join(m("a"), "a").join(m("b"), "b").where("doc_a <> doc_b")


def suppress_fanout(directed: DataFrame, most: int = 3) -> DataFrame:
    """Without the probes that match more than `most` documents; judged on the probing side only."""
    wide = directed.groupBy("a").agg(F.count_distinct("doc_b").alias("n")).where(F.col("n") > most)
    return directed.join(wide, "a", "left_anti")


def unordered(directed: DataFrame) -> DataFrame:
    """One row per unordered pair: that of the smaller probe."""
    key = [F.least("a", "b"), F.greatest("a", "b")]
    return directed.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("a"))).where("__n = 1").drop("__n")


def candidate_pairs(neighbours: DataFrame, meta: DataFrame, low: float = 0.90, high: float = 0.97, fanout: int = 3, cross_category: bool = True) -> DataFrame:
    """The whole mining step, most similar first. Blank categories are equal to each other."""
    pairs = unordered(suppress_fanout(band(neighbours, meta, low, high), fanout))
    pairs = pairs.where(~same_template(title_signature("title_a"), title_signature("title_b")))
    if cross_category:
        pairs = pairs.where(or_default("category_a", "") != or_default("category_b", ""))
    return pairs.orderBy(F.desc("similarity"), "a", "b")


def parse_verdict(content: Column | str) -> Column:
    """struct(verdict, explanation) of a judge's answer; unsure without a verdict, else the first 200 characters as explanation."""
    x = col(content)
    verdict = F.upper(F.regexp_extract(x, r"ВЕРДИКТ:\s*(\S+)", 1))
    why = strip(F.regexp_extract(x, r"ПОЯСНЕННЯ:\s*([^\n]+)", 1))
    return F.struct(F.coalesce(F.nullif(verdict, F.lit("")), F.lit(L.VERDICTS["unsure"])).alias("verdict"), F.when(F.rlike(x, F.lit(r"ПОЯСНЕННЯ:\s*[^\n]+")), why).otherwise(F.substring(strip(x), 1, 200)).alias("explanation"))


def verdict_counts(judged: DataFrame, verdict: str = "verdict") -> DataFrame:
    return judged.groupBy(verdict).agg(F.count("*").alias("n"))


def shortlist(judged: DataFrame) -> DataFrame:
    """Conflicts first, then the unsure, by similarity."""
    kept = judged.where(F.col("verdict").isin(L.VERDICTS["conflict"], L.VERDICTS["unsure"]))
    return kept.orderBy(F.col("verdict") != L.VERDICTS["conflict"], F.desc("similarity"))


def for_judging(pairs: DataFrame, most: int = L.JUDGED_PAIRS) -> DataFrame:
    """The most similar pairs, which are handed to the judge; ties by their ends."""
    return pairs.orderBy(F.desc("similarity"), "a", "b").limit(most)
