"""Cross-references: documents that name each other by title."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import lexicon as L
from quillspark.functions.text import col, strip
from quillspark.operators.metadata import split_title

#: Link specs (about 200 bytes each) are broadcast up to so many.
BROADCAST_SPECS = 50_000


def link_pattern(title: Column | str) -> Column:
    """Pattern of mentions of a title in any inflection of its anchor word; null without an anchor or with under two other words."""
    parts = split_title(title)
    core = strip(F.regexp_replace(parts["rest"], "(?iu)" + L.UNIVERSITY_SUFFIX, ""))
    stem = F.element_at(F.create_map(*[F.lit(x) for kv in L.ANCHOR_STEMS.items() for x in kv]), parts["anchor"])
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    quoted = lambda c: F.array_join(F.transform(words(c), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"\s+")
    head = F.concat(F.when(parts["lead"] != "", F.concat(quoted(parts["lead"]), F.lit(r"\s+"))).otherwise(F.lit("")), stem, F.lit(r"[\p{L}\p{N}_]*"))
    body = F.concat(head, F.when(core != "", F.concat(F.lit(r"\s+"), quoted(core))).otherwise(F.lit("")))
    return F.when(F.size(words(parts["lead"])) + F.size(words(core)) >= 2, F.concat(F.lit("(?iu)"), body, F.lit(f"(?:{L.UNIVERSITY_MENTION})?")))


def link_url(stem: Column | str, base: str = "") -> Column:
    return F.concat(F.lit(f"{base}/wiki-pages/"), F.replace(F.replace(F.url_encode(F.concat(col(stem), F.lit(".html"))), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def _tokens(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}_]+", -1), lambda t: t != "")


def link_tokens(title: Column | str) -> Column:
    """Words that a mention of the title holds whole: those of its lead but the first, and of its rest but the last, which may be part of longer ones."""
    parts = split_title(title)
    core = _tokens(strip(F.regexp_replace(parts["rest"], "(?iu)" + L.UNIVERSITY_SUFFIX, "")))
    lead = _tokens(parts["lead"])
    size = lambda c: F.greatest(F.size(c) - 1, F.lit(0))
    return F.array_distinct(F.concat(F.slice(lead, F.lit(2), size(lead)), F.slice(core, F.lit(1), size(core))))


def link_specs(docs: DataFrame, stem: str = "stem", title: str = "title", base: str = "") -> DataFrame:
    """(target, pattern, url, tokens) of the documents that can be linked to; needs every title, so it comes before any linking."""
    return docs.select(F.col(stem).alias("target"), link_pattern(title).alias("pattern"), link_url(stem, base).alias("url"), link_tokens(title).alias("tokens")).where("pattern IS NOT NULL")


def mentions(docs: DataFrame, specs: DataFrame, stem: str = "stem", body: str = "body") -> DataFrame:
    """(stem, target, start, end, url): the first mention of each other document, offsets from 0.

    A spec is filed under the one of its tokens that fewest documents hold; documents fetch specs by their words, and patterns run on
    those only. Specs without tokens run on every document, broadcast up to BROADCAST_SPECS and dealt in blocks beyond.
    """
    wanted = specs.select(F.explode("tokens").alias("token")).distinct()
    words = docs.select(F.col(stem).alias("stem"), F.explode(F.array_distinct(_tokens(body))).alias("token")).join(wanted, "token")
    df = words.groupBy("token").agg(F.count("*").alias("df"))
    filed = specs.select("target", F.explode("tokens").alias("token")).join(df, "token").groupBy("target").agg(F.min(F.struct("df", "token")).alias("least"), F.count("*").alias("known"))
    filed = specs.where(F.size("tokens") > 0).join(filed, "target").where(F.col("known") == F.size("tokens"))  # a word that no document holds: no mention
    found = words.join(filed.select("target", F.col("least.token").alias("token")), "token").where("stem <> target").select(F.col("stem").alias("__stem"), F.col("target").alias("__target"))
    fetched = found.join(docs, F.col("__stem") == F.col(stem)).join(specs, F.col("__target") == F.col("target")).drop("__stem", "__target")
    return _located(fetched.select(stem, body, *specs.columns).unionByName(_every(docs.select(stem, body), specs.where(F.size("tokens") == 0), stem)), stem, body)


def _every(docs: DataFrame, specs: DataFrame, stem: str) -> DataFrame:
    n = specs.count()
    if n <= BROADCAST_SPECS:
        return docs.join(F.broadcast(specs), F.col(stem) != F.col("target"))
    blocks = n // BROADCAST_SPECS + 1
    left = docs.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = specs.withColumn("__b", F.pmod(F.xxhash64("target"), F.lit(blocks)).cast("int"))
    return left.join(right, "__b").where(F.col(stem) != F.col("target")).drop("__b")


def _located(pairs: DataFrame, stem: str, body: str) -> DataFrame:
    hit = pairs.where(F.rlike(F.col(body), F.col("pattern"))).withColumn("hit", F.regexp_substr(F.col(body), F.col("pattern")))
    at = F.length(F.split(F.col(body), F.col("pattern"), 2)[0])
    return hit.select(F.col(stem), "target", at.alias("start"), (at + F.length("hit")).alias("end"), "url")


def accept_spans(found: DataFrame, stem: str = "stem") -> DataFrame:
    """(stem, spans): of each document's mentions, those that don't start inside one accepted before; earliest first."""
    spans = F.array_sort(F.collect_list(F.struct("start", "end", "url")))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,url:string>>)")
    fold = lambda s, x: F.when(F.coalesce(F.element_at(s, -1)["end"] > x["start"], F.lit(False)), s).otherwise(F.concat(s, F.array(x)))
    got = found.groupBy(stem).agg(spans.alias("all"))
    return got.select(stem, F.aggregate("all", empty, lambda s, x: F.when(F.size(s) == 0, F.array(x)).otherwise(fold(s, x))).alias("spans"))


def link_cross_references(docs: DataFrame, specs: DataFrame, stem: str = "stem", body: str = "body") -> DataFrame:
    """docs with accepted mentions turned into Markdown links, and n_links."""
    accepted = accept_spans(mentions(docs, specs, stem, body), stem)
    state = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))
    x = F.col(body)
    step = lambda s, p: F.struct(F.concat(s["t"], F.substring(x, s["at"] + 1, p["start"] - s["at"]), F.lit("["), F.substring(x, p["start"] + 1, p["end"] - p["start"]), F.lit("]("), p["url"], F.lit(")")).alias("t"), p["end"].alias("at"))
    linked = F.aggregate("spans", state, step, lambda s: F.concat(s["t"], F.substring(x, s["at"] + 1, F.length(x))))
    return docs.join(accepted, stem, "left").withColumns({body: F.when(F.col("spans").isNotNull(), linked).otherwise(x), "n_links": F.coalesce(F.size("spans"), F.lit(0))}).drop("spans")
