"""From raw documents to packed training sequences, a table written after every stage.

STAGES are (name, function); a function takes (spark, docs, sf_dir), docs being what its predecessor wrote, and returns a
DataFrame with the columns of `documents`, but for the last, which returns pieces of packed sequences. Every stage takes null keys and texts,
repeated rows, texts of any length and empty tables; what it does with them its operator says. Tables behind a stage's result live until
the next stage is called.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.entries import tokenizer_file
from quillspark.llm.exact_dedup import drop_exact_duplicates
from quillspark.llm.packing import pack
from quillspark.llm.quality import keep_quality
from quillspark.llm.simhash import drop_near_duplicates
from quillspark.llm.substring_dedup import drop_repeated_words
from quillspark.workspace import discard, materialize, release, tables


_left: set[str] = set()


def _stage(function):
    """function, after deleting the tables that the stage called before has left: its result was written by then."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_left)
        before = tables()
        out = function(spark, docs, sf_dir)
        _left.clear()
        _left.update(tables() - before)
        return out

    return run_stage


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go, null and empty texts among them. Repeated rows are judged alike."""
    return keep_quality(docs)


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) one row stays, that with the smallest doc_id, a null one last; so one of repeated rows too."""
    return drop_exact_duplicates(docs)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose five-word shingles have a Jaccard similarity of 0.8 or more to those of a smaller doc_id go, so one of each group stays."""
    return drop_near_duplicates(docs)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words and more that a smaller doc_id has go; documents left without a word go too; n_chars follows."""
    cut = drop_repeated_words(docs)
    return cut.where(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]"))).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"), 2048, 1)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("simhash near dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", packing)]

#: Shingle sets, estimates by concentration steps and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
