"""Incremental ingestion: new Markdown files become chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.sections import chunk_documents
from quillspark.sources.wiki import file_stem, split_front_matter


def stream_wiki(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.readStream.option("pathGlobFilter", "*.md").option("wholetext", "true").text(folder)
    return split_front_matter(files.select(file_stem().alias("stem"), F.col("value").alias("text"))).select("stem", "body")


def chunk_stream(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Chunks of every new file, appended to out; each batch is a batch plan, and runs until nothing is left."""

    def write(batch: DataFrame, epoch: int) -> None:
        chunk_documents(batch, ["stem"]).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
