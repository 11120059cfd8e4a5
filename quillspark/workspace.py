"""Intermediate tables in the folder that the whole cluster shares.

``materialize`` writes a frame as Parquet below ``spark.checkpoint.dir`` and reads it back, so that lineage is cut by
files every executor can reach: losing an executor costs nothing that was finished before.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Used by local sessions that name no folder, as tests do.
_FALLBACK = "/tmp/quillspark-checkpoints"
_written: dict[str, SparkSession] = {}
#: The column of with_row_ids().
ROW = "__row"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local session that names none has one of its own; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _FALLBACK
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by release()."""
    path = f"{shared_folder(spark)}/quillspark-{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def materialize(df: DataFrame, label: str, rows_per_file: int = 0) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return a frame that reads it. Large rows are best few to a file."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillspark_path = path
    return out


def with_row_ids(df: DataFrame) -> DataFrame:
    """df with an id of each row in the column ROW, given once and written, so that every reading has the same."""
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _delete(path: str, spark: SparkSession) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone by then
        pass


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames that materialize() returned. What is read from them ends with them."""
    for df in frames:
        path = getattr(df, "_quillspark_path", None)
        if path in _written:
            _delete(path, _written.pop(path))


def tables() -> set[str]:
    """Paths of the tables of this process that are in the shared folder now."""
    return set(_written)


def release(paths: set[str] | None = None) -> None:
    """Delete the tables at paths, or all of this process. Runs at exit too; frames read from them end with it."""
    for path in tables() if paths is None else tables() & paths:
        _delete(path, _written.pop(path))


atexit.register(release)
