"""Rule classification: the first rule that fits wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import lexicon as L
from quillspark.functions.text import col, matches, strip


def is_garbage_title(title: Column | str) -> Column:
    t = strip(title)
    return (F.length(t) < 15) | matches(F.lower(t), "|".join(f"(?:{p})" for p in L.GARBAGE_TITLE_PATTERNS), fold=True)


def _first_rule(haystack: Column) -> Column:
    """A CASE in rule order, one pattern per rule; it stops at the first that fits and needs neither join nor shuffle."""
    out = None
    for category, subgroup, patterns in L.CATEGORY_RULES:
        value = F.struct(F.lit(category).alias("category"), F.lit(subgroup).cast("string").alias("subgroup"))
        test = matches(haystack, "|".join(f"(?:{p})" for p in patterns))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def classify(title: Column | str, body: Column | str, prefix: int = 600) -> Column:
    """struct(category, subgroup): by the title unless it is garbage, then by title and the body's start, else the default."""
    t = F.lower(col(title))
    both = F.lower(F.concat(col(title), F.lit(" "), F.substring(col(body), 1, prefix)))
    default = F.struct(F.lit(L.DEFAULT_CATEGORY).alias("category"), F.lit(None).cast("string").alias("subgroup"))
    return F.coalesce(F.when(~is_garbage_title(title), _first_rule(t)), _first_rule(both), default)


def preserve_unless_forced(new: DataFrame, previous: DataFrame, key: str, columns: list[str], force: bool = False) -> DataFrame:
    """new with the previous snapshot's values where it has the first of columns; `origin` says which (kept or new).

    A kept row keeps all of columns, a null subgroup too. force takes the new values everywhere.
    """
    old = previous.select(F.col(key), F.lit(True).alias("__old"), *[F.col(c).alias(f"__{c}") for c in columns])
    keep = F.lit(not force) & F.coalesce(F.nullif(F.col(f"__{columns[0]}"), F.lit("")).isNotNull(), F.lit(False))
    joined = new.join(old, key, "left").withColumn("__keep", keep)
    picked = {c: F.when(F.col("__keep"), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(picked | {"origin": F.when(F.col("__keep"), "kept").otherwise("new")}).select(*new.columns, "origin")


def carry_prior_state(new: DataFrame, previous: DataFrame, key: str = "stem") -> DataFrame:
    """new with status, category and subgroup of the previous snapshot, and its title where that was locked.

    Documents that are new, or had an empty status, get the unknown status.
    """
    old = previous.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in ("status", "category", "subgroup")], F.when(F.col("title_locked"), F.nullif("title", F.lit(""))).alias("__title"))
    lean = new.drop("status", "category", "subgroup").join(old, key, "left")
    carried = {"title": F.coalesce("__title", "title"), "status": F.coalesce(F.nullif("__status", F.lit("")), F.lit(L.UNKNOWN_STATUS)), "category": F.col("__category"), "subgroup": F.col("__subgroup")}
    return lean.withColumns(carried).drop(*[f"__{c}" for c in ("status", "category", "subgroup", "title")])


def distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)
