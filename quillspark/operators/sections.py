"""Sections of Markdown documents and chunks made of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import lexicon as L
from quillspark.functions.text import col, or_default, strip
from quillspark.operators.lines import explode_lines

_HEADING = r"^(#{2,4}) (.*)$"


def short_title(title: Column | str, most: int = L.TITLE_MAX) -> Column:
    """Titles of over `most` characters are cut at the last space before that, with an ellipsis."""
    t = col(title)
    head = F.substring(t, 1, most)
    cut = F.coalesce(F.nullif(F.regexp_extract(head, r"^([\s\S]+) ", 1), F.lit("")), head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(cut, F.lit("…")))


def sections(docs: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """key, section (line of its heading, -1 for the root), level (0 for the root), title, path, text, has_children.

    Headings are of depth 2 to 4; others are text. All windows share the key, so the lines are shuffled once.
    """
    lines = explode_lines(docs, body, key)
    lines = lines.withColumns({"level": F.when(F.rlike("line", F.lit(_HEADING)), F.length(F.regexp_extract("line", _HEADING, 1)) - 1), "title": F.when(F.rlike("line", F.lit(_HEADING)), strip(F.regexp_extract("line", _HEADING, 2)))})
    w = Window.partitionBy(*key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda k: F.last(F.when(F.col("level") == k, F.struct(F.col("line_no").alias("at"), short_title("title").alias("t"))), ignorenulls=True).over(w)
    marked = lines.withColumns({"section": F.coalesce(F.last(F.when(F.col("level").isNotNull(), F.col("line_no")), ignorenulls=True).over(w), F.lit(-1)), "h1": last(1), "h2": last(2), "h3": last(3)})
    at = lambda c: F.coalesce(F.col(c)["at"], F.lit(-1))
    valid2, valid3 = at("h2") > at("h1"), at("h3") > F.greatest(at("h1"), at("h2"))
    path = F.concat_ws(" > ", F.col("h1")["t"], F.when(valid2, F.col("h2")["t"]), F.when(valid3, F.col("h3")["t"]))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    grouped = marked.groupBy(*key, "section").agg(F.max("level").alias("level"), F.max("title").alias("title"), F.min_by(path, "line_no").alias("path"), strip(text).alias("text"))
    after = F.lead("level").over(Window.partitionBy(*key).orderBy("section"))
    return grouped.withColumns({"level": F.coalesce("level", F.lit(0)), "has_children": F.coalesce(after > F.coalesce("level", F.lit(0)), F.lit(False))})


def own_text(level: Column | str = "level", title: Column | str = "title", text: Column | str = "text", has_children: Column | str = "has_children") -> Column:
    """A section's own text: with its title where it has a body, or a long title, or a fairly long one and no children."""
    t, b = col(title), col(text)
    named = (b != "") | (F.length(t) > L.TITLE_MAX) | (~col(has_children) & (F.length(t) >= L.MIN_CHUNK))
    return F.when((col(level) > 0) & named, strip(F.concat(t, F.lit("\n\n"), b))).otherwise(b)


def leaves(secs: DataFrame, key: list[str]) -> DataFrame:
    """key, leaf (from 0, in order), path, text of the sections with text of their own."""
    got = secs.select(*key, "section", F.when(F.col("level") == 0, F.lit("")).otherwise(F.col("path")).alias("path"), own_text().alias("text")).where("text <> ''")
    return got.withColumn("leaf", F.row_number().over(Window.partitionBy(*key).orderBy("section")) - 1).drop("section")


def merge_tiny(found: DataFrame, key: list[str], least: int = L.MIN_CHUNK) -> DataFrame:
    """Leaves under `least` characters join the kept leaf before them; those at the start are carried to the first that makes the length.

    Closed form: k is the first leaf at which the running length, blank lines counted, reaches `least`; leaves to k are one output
    with k's path; after k every leaf of that length opens another. Without k everything is one output without a path.
    """
    w = Window.partitionBy(*key).orderBy("leaf")
    run = found.withColumns({"n": F.length("text"), "run": F.sum(F.length("text")).over(w) + 2 * F.col("leaf")})
    reach = run.withColumn("k", F.min(F.when(F.col("run") >= least, F.col("leaf"))).over(Window.partitionBy(*key)))
    opens = F.when((F.col("leaf") > F.col("k")) & (F.col("n") >= least), 1).otherwise(0)
    placed = reach.withColumn("chunk", F.coalesce(F.sum(opens).over(w), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leaf", "text"))), lambda x: x["text"]), "\n\n")
    path = F.coalesce(F.max(F.when(F.col("leaf") == F.col("k"), F.col("path"))), F.when(F.max("k").isNotNull(), F.min_by("path", "leaf")), F.lit(""))
    return placed.groupBy(*key, F.col("chunk").cast("int").alias("chunk")).agg(path.alias("path"), text.alias("text"))


def split_paragraphs(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(text), r"\n\s*\n", -1), strip), lambda p: p != "")


def pack_paragraphs(paragraphs: Column | str, target: int = L.TARGET_CHUNK) -> Column:
    """Greedy groups: one closes when it has something and the next paragraph would pass the target; each costs two more."""
    state = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.expr("cast(array() as array<string>)").alias("open"), F.lit(0).alias("n"))
    close = lambda s: F.concat(s["done"], F.array(F.array_join(s["open"], "\n\n")))

    def step(s, p):
        fresh = F.struct(close(s).alias("done"), F.array(p).alias("open"), (F.length(p) + 2).alias("n"))
        more = F.struct(s["done"].alias("done"), F.concat(s["open"], F.array(p)).alias("open"), (s["n"] + F.length(p) + 2).alias("n"))
        return F.when((F.size(s["open"]) > 0) & (s["n"] + F.length(p) > target), fresh).otherwise(more)

    return F.aggregate(col(paragraphs), state, step, lambda s: F.when(F.size(s["open"]) > 0, close(s)).otherwise(s["done"]))


def _hard_split(texts: pd.Series) -> pd.Series:
    def one(t):
        out = []
        while len(t) > L.MAX_CHUNK:
            at = t.rfind(" ", 0, L.TARGET_CHUNK)
            at = at if at > 0 else L.TARGET_CHUNK
            out.append(t[:at].strip())
            t = t[at:].strip()
        return [*out, t]

    return texts.map(one)


def split_oversized(df: DataFrame, text: str = "text") -> DataFrame:
    """df with `pieces`: the text alone up to 2500 characters; packed paragraphs above; a lone giant paragraph cut at spaces.

    Only giant paragraphs go through Python, Arrow-batched; the branch is a filter, so that other rows don't.
    """
    pars = split_paragraphs(text)
    long = F.length(text) > L.MAX_CHUNK
    easy = df.where(~F.coalesce(long & (F.size(pars) <= 1), F.lit(False))).withColumn("pieces", F.when(long, pack_paragraphs(pars)).otherwise(F.array(F.col(text))))
    split = F.pandas_udf(_hard_split, "array<string>")
    giant = df.where(long & (F.size(pars) <= 1)).withColumn("pieces", split(strip(text)))
    return easy.unionByName(giant)


def chunk_documents(docs: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """key, chunk_index from 0, section_path, text: sections, tiny ones merged, long ones split, blank ones dropped.

    Documents without leaves are packed by paragraphs.
    """
    merged = merge_tiny(leaves(sections(docs, key, body), key), key)
    with_leaves = merged.select(*key).distinct()
    rest = docs.join(with_leaves, key, "left_anti").select(*key, F.posexplode(pack_paragraphs(split_paragraphs(body))).alias("chunk", "text")).withColumn("path", F.lit(""))
    pieces = split_oversized(merged.unionByName(rest.select(*merged.columns)))
    flat = pieces.select(*key, "chunk", "path", F.posexplode("pieces").alias("piece", "t")).withColumn("t", strip("t")).where("t <> ''")
    return flat.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy("chunk", "piece")) - 1).alias("chunk_index"), F.col("path").alias("section_path"), F.col("t").alias("text"))


def embedding_text(title, category, subgroup, status, number, date, path, text) -> Column:
    dash = lambda c: or_default(c, L.DASH)
    group = F.when(or_default(subgroup, "") != "", F.concat(dash(category), F.lit(" / "), col(subgroup))).otherwise(dash(category))
    return F.concat(F.lit("Документ: "), dash(title), F.lit("\nКатегорія: "), group, F.lit("\nСтатус: "), or_default(status, L.UNKNOWN_STATUS), F.lit("\n№ наказу: "), dash(number), F.lit(" від "), dash(date), F.lit("\nРозділ: "), dash(path), F.lit("\n\n"), col(text))


def chunk_records(docs: DataFrame) -> DataFrame:
    """Full chunk records of documents with stem, front matter fields and body: chunk_id is stem::index."""
    meta = ["source_pdf", "title", "category", "subgroup", "status", "order_number", "order_date"]
    chunks = chunk_documents(docs.select("stem", "body"), ["stem"]).join(docs.select("stem", *meta), "stem")
    ids = {"chunk_id": F.concat("stem", F.lit("::"), F.col("chunk_index").cast("string")), "doc_id": F.col("stem"), "wiki_page": F.concat(F.lit("wiki-pages/"), "stem", F.lit(".md"))}
    whole = chunks.withColumns(ids).withColumn("embedding_text", embedding_text("title", "category", "subgroup", "status", "order_number", "order_date", "section_path", "text"))
    return whole.select("chunk_id", "doc_id", "wiki_page", *meta, "section_path", F.col("chunk_index").cast("int").alias("chunk_index"), "text", "embedding_text")


def chunk_statistics(chunks: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row: documents, chunks, least, upper median and greatest length, documents of one chunk.

    The median comes from counts per length, so no task sorts all rows.
    """
    sizes = chunks.groupBy(F.length(text).cast("long").alias("n")).agg(F.count("*").alias("c"))
    run = sizes.withColumns({"upto": F.sum("c").over(Window.orderBy("n")), "all": F.sum("c").over(Window.partitionBy())})
    middle = run.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("n").alias("median_chars"))
    per = chunks.groupBy(*key).agg(F.count("*").alias("k"), F.min(F.length(text)).alias("lo"), F.max(F.length(text)).alias("hi"))
    whole = per.agg(F.count("*").alias("n_docs"), F.sum("k").alias("n_chunks"), F.min("lo").cast("long").alias("min_chars"), F.max("hi").cast("long").alias("max_chars"), F.count_if(F.col("k") == 1).alias("single_chunk_docs"))
    return whole.crossJoin(F.broadcast(middle))  # two rows
