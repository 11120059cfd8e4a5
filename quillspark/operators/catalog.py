"""Listings of a corpus and blocks of its printed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import lexicon as L
from quillspark.functions.text import col, or_default, strip
from quillspark.operators.lines import explode_lines


def in_fixed_order(df: DataFrame, column: str, values: list[str], title: str) -> DataFrame:
    """Rows whose column is one of values, with position (from 0) in that order, sorted by title within; others vanish."""
    at = F.array_position(F.array(*map(F.lit, values)), F.col(column)) - 1
    return df.withColumn("position", at.cast("int")).where("position >= 0").orderBy("position", title)


def tabs(df: DataFrame, subgroup: str, values: list[str]) -> DataFrame:
    """(tab, label, n, active): the general bucket of null subgroups first, then the ordered subgroups, empty ones left out."""
    named = in_fixed_order(df, subgroup, values, subgroup).groupBy("position", F.col(subgroup).alias("label")).agg(F.count("*").alias("n"))
    general = df.where(F.col(subgroup).isNull()).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(-1).alias("position"), F.lit(None).cast("string").alias("label"), "n")
    both = named.unionByName(general)  # as many rows as tabs
    return both.select((F.row_number().over(Window.orderBy("position")) - 1).alias("tab"), "label", "n").withColumn("active", F.col("tab") == 0)


def inline(text: Column | str) -> Column:
    """Links become their label; bold marks and escaped dots go."""
    t = F.regexp_replace(col(text), r"\[([^\]]*)\]\([^)]*\)", "$1")
    return strip(F.replace(F.replace(t, F.lit("**"), F.lit("")), F.lit("\\."), F.lit(".")))


def blocks(docs: DataFrame, key: list[str], body: str = "body", title_most: int = 160) -> DataFrame:
    """key, block_no from 0, type (section, para, bullet, table), text, rows (of tables): consecutive table lines are one block."""
    heading = r"^(#{2,6})\s+(.*\S)\s*$"
    lines = explode_lines(docs, body, key).withColumn("line", strip("line")).where("line <> ''")
    is_row = F.startswith("line", F.lit("|"))
    lines = lines.where(~(is_row & F.rlike("line", F.lit(r"^\|[\s:|-]+\|?$"))))
    head = F.rlike("line", F.lit(heading))
    text = inline(F.regexp_extract("line", heading, 2))
    section = (F.length(F.regexp_extract("line", heading, 1)) <= 3) & (F.length(text) <= title_most) & ~F.rlike(text, F.lit(r"[.;]$"))
    bullet = F.rlike("line", F.lit(L.BULLET)) & (F.regexp_replace("line", L.BULLET, "") != "")
    kind = F.when(is_row, "table").when(head & section, "section").when(head, "para").when(bullet, "bullet").otherwise("para")
    value = F.when(is_row, F.lit(None)).when(head, text).when(bullet, inline(F.regexp_replace("line", L.BULLET, ""))).otherwise(inline("line"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+$", ""), r"\|", -1), inline)
    typed = lines.withColumns({"type": kind, "value": value, "cells": F.when(is_row, cells)})
    w = Window.partitionBy(*key).orderBy("line_no")
    islands = typed.withColumn("block_no", F.sum(F.when((F.col("type") == "table") & (F.lag("type").over(w) == "table"), 0).otherwise(1)).over(w) - 1)
    rows = F.transform(F.array_sort(F.collect_list(F.when(F.col("cells").isNotNull(), F.struct("line_no", "cells")))), lambda x: x["cells"])
    return islands.groupBy(*key, F.col("block_no").cast("int").alias("block_no")).agg(F.max("type").alias("type"), F.max("value").alias("text"), rows.alias("rows"))


def pad_table(rows: Column | str) -> Column:
    """Every row as wide as the widest."""
    r = col(rows)
    width = F.array_max(F.transform(r, lambda x: F.size(x)))
    return F.transform(r, lambda x: F.concat(x, F.array_repeat(F.lit(""), width - F.size(x))))


def bullet_runs(found: DataFrame, key: list[str]) -> DataFrame:
    """(key, block_no, items) of blocks(): bullets that follow one another are one list, under the number of its first."""
    w = Window.partitionBy(*key).orderBy("block_no")
    opens = F.coalesce(F.lag("type").over(w) != "bullet", F.lit(True))
    runs = found.withColumn("__run", F.sum(F.when((F.col("type") == "bullet") & ~opens, 0).otherwise(1)).over(w)).where("type = 'bullet'")
    items = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"])
    return runs.groupBy(*key, "__run").agg(F.min("block_no").alias("block_no"), items.alias("items")).drop("__run")


def localised_date(iso: Column | str) -> Column:
    """'D month YYYY р.'; anything shorter than a date as it is."""
    x = F.coalesce(col(iso), F.lit(""))
    month = F.get(F.array(*map(F.lit, L.MONTHS)), F.substring(x, 6, 2).try_cast("int") - 1)
    return F.when(F.length(x) < 10, x).otherwise(F.concat(F.substring(x, 9, 2).try_cast("int").cast("string"), F.lit(" "), month, F.lit(" "), F.substring(x, 1, 4), F.lit(" р.")))


def form_defaults(issue: Column | str, changes: Column | str, official_title: Column | str, title: Column | str) -> Column:
    return F.struct(F.coalesce(col(issue), F.lit(1)).alias("issue"), F.coalesce(col(changes), F.lit(0)).alias("changes"), F.coalesce(col(official_title), col(title), F.lit("")).alias("official_title"))


def real_people(people: Column | str) -> Column:
    return F.filter(col(people), lambda p: (F.coalesce(p["position"], F.lit("")) != "") | (F.coalesce(p["name"], F.lit("")) != ""))


def saved_form(doc_code, issue, changes, official_title, approver, council_approval, developers, agreed) -> Column:
    """The print form as it is saved: empty texts, empty lists and an approver without a name are null."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    people = lambda c: F.when(F.size(real_people(c)) > 0, real_people(c))
    number = lambda c, default: F.coalesce(F.nullif(F.trim(c), F.lit("")).try_cast("int"), F.lit(default))
    named = F.when(F.coalesce(F.trim(col(approver)["name"]), F.lit("")) != "", col(approver))
    return F.struct(
        text(doc_code).alias("doc_code"), number(issue, 1).alias("issue"), number(changes, 0).alias("changes"), text(official_title).alias("official_title"),
        named.alias("approver"), text(council_approval).alias("council_approval"), people(developers).alias("developers"), people(agreed).alias("agreed"),
    )


def page_header(docs: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, field, value) of the fields that are not empty."""
    return docs.unpivot(key, fields, "field", "value").where(or_default("value", "") != "")
