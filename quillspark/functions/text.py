"""Text predicates as Column expressions that mean the same for every script."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from quillspark.functions import lexicon as L

_BLANK = r"[\s\x{A0}]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, f) -> Column:
    """f(value), where value is computed once, however often f uses it and in whatever lambda."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(x), rf"^{_BLANK}+", ""), rf"{_BLANK}+$", "")


def rstrip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), rf"{_BLANK}+$", "")


def matches(x: Column | str, pattern: str, fold: bool = False) -> Column:
    """Whether pattern is found; word classes and boundaries cover all scripts, fold ignores case."""
    return F.rlike(col(x), F.lit(("(?iuU)" if fold else "(?U)") + pattern))


def letters(x: Column | str) -> Column:
    return F.length(F.regexp_replace(col(x), r"[^\p{L}]", ""))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def letter_ratio(x: Column | str) -> Column:
    s = strip(x)
    return share(letters(s), F.length(s))


def bare_length(x: Column | str) -> Column:
    """Characters left after blanks, line ends and no-break spaces are cut from both ends; null of null."""
    return F.length(F.btrim(col(x), F.lit(" \t\n\f\r\u00a0")))


def is_page_broken(x: Column | str) -> Column:
    """Blank, under 40 characters, or under three tenths letters, all after stripping; null counts as blank."""
    s = strip(F.coalesce(col(x), F.lit("")))
    return (F.length(s) < L.MIN_PAGE_CHARS) | (letter_ratio(s) < L.LETTER_RATIO)


def is_mostly_uppercase(x: Column | str) -> Column:
    return share(F.length(F.regexp_replace(col(x), r"[^\p{Lu}]", "")), letters(x)) > 0.8


def or_default(x: Column | str, default: str) -> Column:
    """default for null and for the empty string."""
    return F.coalesce(F.nullif(col(x), F.lit("")), F.lit(default))


def point_number(line: Column | str) -> Column:
    """Roman section or decimal point number that opens a line, unless a month follows (a date); null without one."""
    x = col(line)
    decimal = F.regexp_extract(x, L.POINT, 1)
    return F.coalesce(F.nullif(F.regexp_extract(x, L.SECTION, 1), F.lit("")), F.when((decimal != "") & ~starts_with_month(F.regexp_extract(x, L.POINT, 2)), decimal))


def starts_with_month(x: Column | str) -> Column:
    first = F.regexp_replace(F.lower(F.regexp_extract(col(x), r"^\s*(\S+)", 1)), r"[.,]+$", "")
    return first.isin(L.MONTHS)


def to_re2(pattern: str) -> str:
    """The pattern in the syntax that DuckDB's engine shares, for oracles: explicit word classes and boundaries."""
    word = r"\p{L}\p{N}_"
    p = pattern.replace(r"\w", f"[{word}]")
    p = re.sub(r"^\\b", lambda m: f"(?:^|[^{word}])", p)
    return re.sub(r"\\b$", lambda m: f"(?:$|[^{word}])", p)
