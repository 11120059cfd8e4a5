"""TF-IDF similarity graphs of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quillspark.functions.text import col
from quillspark.operators import allpairs
from quillspark.operators.graph import connected_components
from quillspark.operators.terms import Terms, character_classes
from quillspark.workspace import materialize


def tokens(text: Column | str) -> Column:
    """Lower-case words of four letters and more; a word with a digit or underscore yields none."""
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}_]+", -1), lambda t: F.rlike(t, F.lit(r"^\p{L}{4,}$")))


def _terms() -> Column:
    """Words and pairs of neighbours among them, of the column t."""
    pairs = F.transform(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("t", i + 1)))
    return F.concat("t", pairs)


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term, tf): words and pairs of neighbours among them. Tokens are a column of their own, made once per row."""
    rows = docs.select(F.col(key).alias("id"), tokens(text).alias("t"))
    return rows.select("id", F.explode(_terms()).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame, n_docs: Column | int, min_df: int = 2, max_df: float = 0.15) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.lit(n_docs)))


def _spread(docs: DataFrame) -> DataFrame:
    """docs over all cores, where a file or two with few row groups would leave most of them idle."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def tfidf(docs: DataFrame, key: str = "doc_id", text: str = "text", min_df: int = 2, max_df: float = 0.15) -> DataFrame:
    """(id, term, df, weight): 1 + ln tf times ln((1 + n) / (1 + df)) + 1, unit length per document; n counts all documents."""
    n = docs.count()
    counts = materialize(term_counts(_spread(docs.select(key, text)), key, text), "terms")  # read for the frequencies and for the weights
    df = document_frequency(counts, n, min_df, max_df)
    raw = counts.join(df, "term").select("id", "term", "df", ((1 + F.log("tf")) * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).select("id", "term", "df", "weight")


def cosine_edges(weights: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(src, dst, sim) with src < dst, of the rows of tfidf(): all pairs that share a term and have that similarity or more."""
    return allpairs.similar_pairs(allpairs.blocks_of_weights(weights), threshold)


#: Classes of copies that are broadcast at most; more are joined by a shuffle of the texts.
_CLASSES = 500_000


def _named(docs: DataFrame, key: str, text: str, *others: str):
    """For allpairs.blocks_of_terms(): texts, and what names their terms. Tokens never are strings of their own."""

    def named(salt: int) -> tuple[DataFrame, Terms]:
        rows = docs.select(F.col(key).alias("id"), F.lower(F.col(text)).alias("text"), *others)
        return rows, Terms(character_classes(docs.sparkSession), salt)

    return named


def _repeats(docs: DataFrame, key: str) -> bool:
    return not docs.groupBy(key).count().where("count > 1").isEmpty()


def tfidf_edges(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.2, min_df: int = 2, max_df: float = 0.15) -> DataFrame:
    """cosine_edges(tfidf(docs)), where terms stay hashes in arrays and only their frequencies are shuffled. Rows that share a key are one document, as there."""
    docs = _spread(docs.select(key, text))
    if _repeats(docs, key):
        return cosine_edges(tfidf(docs, key, text, min_df, max_df), threshold)
    n = docs.count()
    return allpairs.similar_pairs(allpairs.blocks_of_terms(_named(docs, key, text), docs.schema[key].dataType, n, min_df, max_df), threshold, n)


def _one_of_each(docs: DataFrame, key: str, text: str, min_df: int, max_df: float) -> tuple[DataFrame, int, DataFrame]:
    """Blocks of the vectors of different texts; n; (node, member) of texts that occur more than once, where node is the least key.

    Copies are found by 128 bits of hashes, so texts are not shuffled for it. A text counts for all its copies where frequencies are counted.
    """
    docs = _spread(docs.select(key, text))
    kind = docs.schema[key].dataType
    spark = docs.sparkSession
    if _repeats(docs, key):
        return allpairs.blocks_of_weights(tfidf(docs, key, text, min_df, max_df)), 0, spark.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("member", kind)]))
    n = docs.count()
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    classes = materialize(named.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("m")).where("m > 1"), "classes")
    few = classes.count() <= _CLASSES
    small = F.broadcast(classes) if few else classes
    members = materialize(named.select("id", "h1", "h2").join(small, ["h1", "h2"]).select("node", F.col("id").alias("member")), "copies")
    nameless = docs.where(F.col(key).isNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.lit(1).cast("long").alias("m"))
    first = named.join(small, ["h1", "h2"], "left").where("node IS NULL OR node = id").select("id", "text", F.coalesce("m", F.lit(1)).alias("m"))
    blocks = allpairs.blocks_of_terms(_named(first.unionByName(nameless), "id", "text", "m"), kind, n, min_df, max_df)
    del docs, named, nameless, first
    allpairs.sweep(spark)
    return blocks, n, members


def tfidf_best(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.2, min_df: int = 2, max_df: float = 0.15) -> DataFrame:
    """best_edges(tfidf_edges(docs)), of different texts only and without writing edges. A text that occurs more than once has itself at similarity 1."""
    blocks, n, members = _one_of_each(docs, key, text, min_df, max_df)
    copied = materialize(members.join(allpairs.vectors(blocks), "node").select(F.col("member").alias("node"), F.lit(1.0).alias("best")), "copied")
    return allpairs.best_similarity(blocks, threshold, n).unionByName(copied).groupBy("node").agg(F.max("best").alias("best"))


def tfidf_clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.2, min_df: int = 2, max_df: float = 0.15) -> DataFrame:
    """clusters(tfidf_edges(docs)), of different texts only; tasks pass on spanning forests."""
    blocks, n, members = _one_of_each(docs, key, text, min_df, max_df)
    copied = materialize(members.join(allpairs.vectors(blocks), "node").where("node <> member"), "copied")
    parts = connected_components(allpairs.spanning_links(blocks, threshold, n))
    own = copied.join(parts, "node", "left").select("member", F.coalesce("component", "node").alias("component"), "node")
    alone = own.where("component = node").select("node", "component").distinct()  # those of parts that are a component's least are among them
    return _sized(parts.unionByName(alone).distinct().unionByName(own.select(F.col("member").alias("node"), "component")))


def clusters(edges: DataFrame) -> DataFrame:
    """(cluster, size, member): components of two and more."""
    return _sized(connected_components(edges))


def _sized(parts: DataFrame) -> DataFrame:
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    return parts.join(sizes, "component").select(F.col("component").alias("cluster"), "size", F.col("node").alias("member")).orderBy(F.desc("size"), "cluster", "member")


def best_edges(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array("src", "dst")).alias("node"), "sim")  # a union would find the edges twice
    return both.groupBy("node").agg(F.max("sim").alias("best"))
