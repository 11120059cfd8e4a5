"""Readers of Markdown collections, chunk files and vector tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_S = T.StringType()
_PERSON = T.StructType([T.StructField("position", _S), T.StructField("name", _S)])
PRINT = T.StructType([T.StructField("doc_code", _S), T.StructField("issue", T.IntegerType()), T.StructField("changes", T.IntegerType()), T.StructField("official_title", _S), T.StructField("approver", _PERSON), T.StructField("council_approval", _S), T.StructField("developers", T.ArrayType(_PERSON)), T.StructField("agreed", T.ArrayType(_PERSON))])
FRONT = T.StructType([*[T.StructField(c, _S) for c in ("title", "status", "order_number", "order_date", "source_pdf")], T.StructField("title_locked", T.BooleanType()), T.StructField("category", _S), T.StructField("subgroup", _S), T.StructField("print", PRINT), T.StructField("fm_ok", T.BooleanType())])
CHUNKS = T.StructType([*[T.StructField(c, _S) for c in ("chunk_id", "doc_id", "wiki_page", "source_pdf", "title", "category", "subgroup", "status", "order_number", "order_date", "section_path")], T.StructField("chunk_index", T.IntegerType()), T.StructField("text", _S), T.StructField("embedding_text", _S)])
VECTORS = T.StructType([T.StructField("chunk_id", _S), T.StructField("embedding", T.ArrayType(T.FloatType())), *[T.StructField(c, _S) for c in ("doc_id", "wiki_page", "title", "category", "subgroup", "status", "order_number", "order_date", "section_path", "document")]])


def split_front_matter(df: DataFrame, text: str = "text") -> DataFrame:
    """df with front (null without front matter) and body."""
    x = F.replace(F.col(text), F.lit("\r\n"), F.lit("\n"))
    end = F.when(F.startswith(x, F.lit("---\n")), F.locate("\n---\n", x, 5)).otherwise(F.lit(0))
    return df.withColumns({"front": F.when(end > 0, F.substring(x, F.lit(5), end - 4)), "body": F.when(end > 0, F.substring(x, end + 5, F.length(x))).otherwise(x)})


def _parse(texts: pd.Series) -> pd.DataFrame:
    import yaml

    class Loader(yaml.SafeLoader):
        """Dates stay text."""

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    text = lambda v: None if v is None else str(v)
    person = lambda p: {k: text((p or {}).get(k)) for k in ("position", "name")}

    def one(t):
        row = dict.fromkeys(FRONT.names)
        try:
            got = yaml.load(t, Loader) if t is not None else None
        except yaml.YAMLError:
            return row | {"fm_ok": False}
        if not isinstance(got, dict):
            return row | {"fm_ok": t is None}
        row |= {k: text(got.get(k)) for k in ("title", "status", "order_number", "order_date", "source_pdf", "category", "subgroup")}
        row |= {"title_locked": got.get("title_locked"), "fm_ok": True}
        if isinstance(p := got.get("print"), dict):
            row["print"] = {k: text(p.get(k)) for k in ("doc_code", "official_title", "council_approval")} | {k: p.get(k) for k in ("issue", "changes")} | {"approver": person(p.get("approver"))} | {k: [person(x) for x in p.get(k) or []] for k in ("developers", "agreed")}
        return row

    return pd.DataFrame([one(t) for t in texts], columns=FRONT.names)


def file_stem() -> Column:
    """The name of the file that a row comes from, without .md; Spark gives it URL-encoded."""
    return F.regexp_replace(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))), r"\.md$", "")


def read_wiki(spark: SparkSession, folder: str) -> DataFrame:
    """One row per *.md file: stem, the front matter's fields, fm_ok (false where it doesn't parse), body. Titles default to the stem."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(file_stem().alias("stem"), F.col("value").alias("text"))
    parsed = split_front_matter(files).withColumn("fm", F.pandas_udf(_parse, FRONT)("front"))
    return parsed.select("stem", "fm.*", "body", F.col("front").isNotNull().alias("has_front")).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.col("stem")))


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The collection as an audit reads it: files with front matter, missing fields empty."""
    fields = {c: F.coalesce(c, F.lit("")) for c in ("status", "order_number", "order_date")}
    return read_wiki(spark, folder).where("has_front").withColumns(fields).select("stem", "title", "status", "order_number", "order_date", "body")


def site_pages(pages: DataFrame, path: str = "path", part: str = "wiki-pages/") -> DataFrame:
    """Pages of a site whose path holds part."""
    return pages.where(F.contains(F.col(path), F.lit(part)))


def index_rows(docs: DataFrame) -> DataFrame:
    """What the index shows of a document."""
    return docs.select("title", "status", "order_number", "order_date")


def read_binary(spark: SparkSession, folder: str) -> DataFrame:
    """PDF files, then DOCX files, as binary rows for a page reader."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).unionByName(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(folder))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)
