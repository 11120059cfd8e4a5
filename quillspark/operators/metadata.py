"""Recognition of numbers, dates and titles on cover pages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspark.functions import lexicon as L
from quillspark.functions.text import col, is_mostly_uppercase, matches, strip

_MONTHS = "|".join(L.MONTHS)
_TEXTUAL = rf"(\d{{1,2}})\s+({_MONTHS})\s+(\d{{4}})"
_NUMERIC = r"(?:^|[^\p{L}\p{N}_])(\d{2})[./](\d{2})[./](\d{4})(?:$|[^\p{L}\p{N}_])"


def approval_slice(text: Column | str) -> Column:
    """600 characters from the approval word on, else the first 2500."""
    x = col(text)
    at = F.locate(L.APPROVAL_WORD, x)
    return F.when(at > 0, F.substring(x, at, F.lit(600))).otherwise(F.substring(x, 1, 2500))


def order_number(text: Column | str) -> Column:
    """The first number after a number sign that holds a digit and isn't a copy's, page's, issue's, protocol's or row's; else null."""
    x = approval_slice(text)
    pieces = F.split(x, "№", -1)
    found = F.transform(
        pieces,
        lambda p, i: F.struct(
            F.regexp_replace(F.regexp_extract(p, r"^\s*([\p{L}\p{N}_./-]+)", 1), r"[.,]+$", "").alias("v"),
            F.right(F.array_join(F.slice(pieces, F.lit(1), F.greatest(i, F.lit(0))), "№"), F.lit(25)).alias("c"),
            i.alias("i"),
        ),
    )
    good = F.filter(found, lambda f: (f["i"] > 0) & F.rlike(f["v"], F.lit(r"\d")) & ~matches(f["c"], L.NUMBER_STOP, fold=True))
    return F.get(good, 0)["v"]


def _iso(x: Column, pattern: str) -> Column:
    month = F.array_position(F.array(*map(F.lit, L.MONTHS)), F.lower(F.regexp_extract(x, pattern, 2)))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = F.lpad(F.regexp_extract(x, pattern, 1), 2, "0")
    return F.when(F.rlike(x, F.lit(pattern)), F.concat_ws("-", F.regexp_extract(x, pattern, 3), two(month), day))


def order_date(text: Column | str) -> Column:
    """ISO date, as text: written out after "від", else written out, else dd.mm.yyyy; no calendar check; null without one."""
    x = approval_slice(text)
    numeric = F.when(F.rlike(x, F.lit(_NUMERIC)), F.concat_ws("-", *(F.regexp_extract(x, _NUMERIC, i) for i in (3, 2, 1))))
    return F.coalesce(_iso(x, r"(?iu)від\s+" + _TEXTUAL), _iso(x, "(?iu)" + _TEXTUAL), numeric)


def digits(x: Column | str) -> Column:
    return F.length(F.regexp_replace(col(x), r"[^\p{Nd}]", ""))


def is_logo_or_code(line: Column | str) -> Column:
    low = F.lower(strip(line))
    logo = F.array(*map(F.lit, L.HEADER_FILLERS[:2]))
    words = F.regexp_extract_all(low, F.lit("([а-яіїєґ]+)"), 1)
    return low.isin(L.HEADER_FILLERS[:2]) | ((F.length(col(line)) <= 60) & F.arrays_overlap(words, logo) & (digits(line) >= 2))


def is_control_code(line: Column | str) -> Column:
    return (digits(line) >= 4) & (F.length(F.regexp_replace(col(line), r"[^\p{L}]", "")) <= 2)


def is_transient_noise(line: Column | str) -> Column:
    x = col(line)
    return F.rlike(x, F.lit(L.DOT_LEADER)) | is_logo_or_code(x) | is_control_code(x) | matches(x, _TEXTUAL, fold=True) | F.rlike(x, F.lit(_NUMERIC)) | F.rlike(x, F.lit(L.NUMBER_SIGN)) | matches(x, L.ISSUER_LINE, fold=True)


def _is_stop(x: Column) -> Column:
    return matches(x, L.TITLE_STOP, fold=True) | F.rlike(x, F.lit(L.BODY_SECTION_START))


def collect_title(lines: Column, start: Column, first: Column, window: int = 16) -> Column:
    """first and what follows it in lines[start:start+window], up to a stop or a blank line after content; 300 characters at most."""
    state = F.struct(F.array(first).alias("parts"), F.lit(False).alias("started"), F.lit(False).alias("stopped"))

    def step(s, x):
        end = F.struct(s["parts"].alias("parts"), s["started"].alias("started"), F.lit(True).alias("stopped"))
        add = F.struct(F.concat(s["parts"], F.array(x)).alias("parts"), F.lit(True).alias("started"), F.lit(False).alias("stopped"))
        skip = ~s["started"] & matches(x, L.INSTITUTION_ONLY, fold=True)
        return F.when(s["stopped"], s).when(_is_stop(x), end).when((x == "") & s["started"], end).when((x == "") | skip | is_transient_noise(x), s).otherwise(add)

    return F.aggregate(F.slice(lines, start + 1, F.lit(window)), state, step, lambda s: F.substring(F.array_join(s["parts"], " "), 1, 300))


def title(text: Column | str) -> Column:
    """The title on a cover page: from a line in capitals that an anchor word opens, else from the first line that could be one, else ''."""
    lines = F.transform(F.split(approval_slice(text), "\n", -1), strip)
    tagged = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("t")))
    anchors = F.array(*map(F.lit, L.ANCHOR_STEMS))
    opens = lambda x: F.arrays_overlap(F.slice(F.split(x, r"\s+"), 1, 2), anchors)
    anchored = F.get(F.filter(tagged, lambda l: (l["t"] != "") & is_mostly_uppercase(l["t"]) & (l["t"] != L.GENERAL_PROVISIONS) & opens(l["t"])), 0)
    header = "|".join(f"(?:{p})" for p in L.RUNNING_HEADERS)
    plain = lambda x: (F.length(x) >= 8) & ~is_mostly_uppercase(x) & F.rlike(x, F.lit(r"\p{L}")) & ~is_transient_noise(x) & ~matches(x, L.INSTITUTION_ONLY, fold=True) & ~_is_stop(x) & ~matches(x, header, fold=True)
    fallback = F.get(F.filter(tagged, lambda l: plain(l["t"])), 0)
    return F.when(anchored.isNotNull(), collect_title(lines, anchored["i"] + 1, anchored["t"])).when(fallback.isNotNull(), collect_title(lines, fallback["i"] + 1, F.substring(fallback["t"], 1, 200))).otherwise(F.lit(""))


def split_title(value: Column | str) -> Column:
    """struct(anchor, lead, rest) of a title whose first or second word is an anchor; null otherwise."""
    words = F.split(strip(value), r"\s+")
    known = F.array(*map(F.lit, L.ANCHOR_STEMS))
    at = F.when(F.array_contains(known, F.upper(words[0])), 1).when(F.array_contains(known, F.upper(F.get(words, F.lit(1)))), 2)
    rest = F.array_join(F.slice(words, at + 1, F.size(words)), " ")
    return F.when(at.isNotNull(), F.struct(F.upper(F.get(words, at - 1)).alias("anchor"), F.when(at == 2, words[0]).otherwise(F.lit("")).alias("lead"), rest.alias("rest")))
