"""Writers."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillspark.functions import lexicon as L
from quillspark.functions.text import or_default
from quillspark.sources.wiki import VECTORS


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines; null keys are written too."""
    chunks.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_vectors(chunks: DataFrame, path: str) -> None:
    """The vector table, written anew: missing metadata is empty, a missing status has its default."""
    plain = {c: or_default(c, "") for c in ("wiki_page", "title", "category", "subgroup", "order_number", "order_date", "section_path")}
    rows = chunks.withColumns(plain | {"status": or_default("status", L.UNKNOWN_STATUS), "document": F.col("text")})
    rows.select(*VECTORS.names).write.mode("overwrite").parquet(path)


def _quoted(c: str) -> Column:
    """A YAML scalar in double quotes."""
    x = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(F.lit(f"{c}: \""), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def markdown_record(optional: tuple[str, ...] = ("category", "subgroup")) -> Column:
    """The document as Markdown: front matter in fixed order, optional keys only where set, a blank line, the body."""
    fixed = [_quoted(c) for c in ("title", "status", "order_number", "order_date", "source_pdf")]
    locked = F.when(F.coalesce("title_locked", F.lit(False)), F.lit("title_locked: true"))
    extra = [F.when(or_default(c, "") != "", _quoted(c)) for c in optional]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *fixed, locked, *extra), F.lit("\n---\n\n"), F.col("body"))


def write_records(docs: DataFrame, folder: str, link: str = "/wiki-pages/") -> int:
    """A file <stem>.md per document in folder (a path or URI that Arrow's file systems know); returns the number of links in their bodies.

    A file is written under a name of its own and then moved, so it is whole whenever it is there, also if its task runs twice. Files of
    documents that are not in docs stay as they are.
    """

    def run(frames):
        import uuid

        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        system.create_dir(top, recursive=True)
        for f in frames:
            for stem, value in zip(f["stem"], f["value"]):
                part = f"{top}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(value.encode())
                system.move(part, f"{top}/{stem}.md")
            yield f[["links"]]

    count = F.size(F.regexp_extract_all("body", F.lit(r"\]\([^)\s]*" + link), F.lit(0))).cast("long")
    rows = docs.select("stem", markdown_record().alias("value"), count.alias("links"))
    return rows.mapInPandas(run, "links long").agg(F.coalesce(F.sum("links"), F.lit(0))).first()[0]


def changed(before: Column, after: Column) -> Column:
    return ~before.eqNullSafe(after)


@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """The lines that differ, for a dry run; empty for equal texts."""
    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm="")) for a, b in zip(before, after)], dtype=object)


def pair_report(title_a, path_a, page_a, text_a, title_b, path_b, page_b, text_b, similarity, verdict=None, explanation=None, most: int = 400) -> Column:
    """A pair as a section of a report: of the candidates, or with verdict and explanation of the shortlist."""
    x = lambda c: F.col(c) if isinstance(c, str) else c
    score = F.format_string("%.3f", x(similarity))
    if verdict is None:
        head = F.concat(F.lit("## Схожість "), score)
    else:
        head = F.concat(F.lit("## "), x(verdict), F.lit(" (схожість "), score, F.lit(")\n\nПояснення моделі: "), x(explanation))
    side = lambda n, t, p, g, c: F.concat(F.lit(f"**[{n}]** "), x(t), F.lit(" — "), or_default(p, L.DASH), F.lit(" ("), x(g), F.lit(")\n> "), F.substring(x(c), 1, most))
    return F.concat(head, F.lit("\n\n"), side("A", title_a, path_a, page_a, text_a), F.lit("\n\n"), side("B", title_b, path_b, page_b, text_b), F.lit("\n\n---\n"))
