"""Line-level repair and typing of page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import lexicon as L
from quillspark.functions.text import bind, col, is_mostly_uppercase, matches, point_number, starts_with_month, strip


def explode_lines(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    """key, line_no from 0, line; one trailing empty line is not a line."""
    cut = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n\z", "")
    return df.select(*key, F.posexplode(F.split(cut, "\n", -1)).alias("line_no", "line"))


def join_lines(lines: DataFrame, key: list[str], order: str = "line_no", line: str = "line", sep: str = "\n") -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line])
    return lines.groupBy(*key).agg(F.array_join(ordered, sep).alias("text"))


def is_header_noise(line: Column | str) -> Column:
    """A mixed-case institutional stamp: nothing but the institution's name, filler words and codes."""
    x = strip(line)
    words = lambda c: F.regexp_extract_all(c, F.lit(f"({L.REAL_WORD})"), 1)
    filler = lambda w: F.lower(w).isin(L.HEADER_FILLERS)
    named = matches(x, L.INSTITUTION, fold=True)
    rest = words(F.regexp_replace(x, "(?iu)" + L.INSTITUTION, " "))
    short = (F.length(x) <= 80) & (F.size(words(x)) > 0) & F.forall(words(x), filler)
    return (x != "") & ~F.rlike(x, F.lit(r"^\d")) & F.when(named, F.forall(rest, filler)).otherwise(short)


def is_boilerplate(line: Column | str) -> Column:
    x = strip(line)
    header = matches(x, "|".join(f"(?:{p})" for p in L.RUNNING_HEADERS))
    return x.isin(L.LOGO_LINES) | F.rlike(x, F.lit(L.DOT_LEADER)) | F.rlike(x, F.lit(L.LONE_NUMBER)) | header | is_header_noise(x)


def strip_boilerplate(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.where(~is_boilerplate(line))


def drop_cover_page(pages: DataFrame, key: list[str], page: str = "page_no", text: str = "text") -> DataFrame:
    """Without page 1 of documents of several pages where it holds the approval word."""
    n = F.count("*").over(Window.partitionBy(*key))
    flagged = pages.withColumn("__n", n)
    return flagged.where(~((F.col(page) == 1) & (F.col("__n") > 1) & F.contains(F.col(text), F.lit(L.APPROVAL_WORD)))).drop("__n")


def cut_trailer(text: Column | str) -> Column:
    """Everything from the first tracking sheet on goes, with the signatures in the 800 characters before it."""
    x = col(text)
    parts = F.split(x, "(?iu)" + L.TRAILER_SHEET, 2)
    before = F.regexp_replace(parts[0], r"[\s\x{A0}]+$", "")
    start = F.greatest(F.length(before) - 800, F.lit(0))
    head, tail = F.substring(before, F.lit(1), start), F.substring(before, start + 1, F.length(before))
    kept = F.concat(head, F.split(tail, L.SIGNATURE, 2)[0])
    return F.when(F.size(parts) > 1, F.regexp_replace(kept, r"[\s\x{A0}]+$", "")).otherwise(x)


def heading_level(line: Column | str) -> Column:
    """2 for roman sections, 3 and more (6 at most) for numbered points, null for dates and other text."""
    x = strip(line)
    number, body = F.regexp_extract(x, L.POINT, 1), F.regexp_extract(x, L.POINT, 2)
    point = F.when((number != "") & ~starts_with_month(body), F.least(3 + F.size(F.split(number, r"\.")) - 1, F.lit(6)))
    return F.when(F.rlike(x, F.lit(L.SECTION)), F.lit(2)).otherwise(point).cast("int")


def heading_markup(line: Column | str) -> Column:
    """The line as Markdown: headings with their marks, other lines stripped."""
    x, level = strip(line), heading_level(line)
    number = F.when(level == 2, F.regexp_extract(x, L.SECTION, 1)).otherwise(F.regexp_extract(x, L.POINT, 1))
    body = F.when(level == 2, F.regexp_extract(x, L.SECTION, 2)).otherwise(F.regexp_extract(x, L.POINT, 2))
    return F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), number, F.lit(". "), body)).otherwise(x)


def split_into_blocks(text: Column | str) -> Column:
    """Whole-text form of heading_markup: blank lines around headings, runs of blank lines collapsed."""
    mark = lambda x: F.when(heading_level(x) == 2, F.concat(F.lit("\n"), heading_markup(x), F.lit("\n"))).when(heading_level(x).isNotNull(), F.concat(F.lit("\n"), heading_markup(x))).otherwise(strip(x))
    joined = F.array_join(F.transform(F.split(col(text), "\n", -1), mark), "\n")
    return F.concat(strip(F.regexp_replace(joined, r"\n{3,}", "\n\n")), F.lit("\n"))


def baseline_margin(lines: DataFrame, key: list[str], order: list[str], x0: str = "x0") -> DataFrame:
    """key, margin: the least rounded margin that occurs twice, else the first line's. Rounds half to even."""
    counts = lines.groupBy(*key, F.bround(F.col(x0)).alias("m")).agg(F.count("*").alias("n"), F.min_by(F.bround(F.col(x0)), F.struct(*order)).alias("f"), F.min(F.struct(*order)).alias("o"))
    return counts.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("n") >= 2, F.col("m"))), F.min_by("f", "o")).alias("margin"))


def paragraphs(lines: DataFrame, key: list[str], order: list[str], x0: str = "x0", line: str = "line") -> DataFrame:
    """key, paragraph from 0, text: islands of lines; one starts at an indent beyond the tolerance or at a marker."""
    w = Window.partitionBy(*key).orderBy(*order)
    base = baseline_margin(lines, key, order, x0)
    marked = lines.join(base, key).withColumn("__new", (F.abs(F.bround(F.col(x0)) - F.col("margin")) > L.INDENT_TOLERANCE) | F.rlike(F.col(line), F.lit(L.PARAGRAPH_MARKER)))
    numbered = marked.withColumns({"__n": F.row_number().over(w)}).withColumn("__g", F.sum(((F.col("__n") == 1) | F.col("__new")).cast("int")).over(w) - 1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col(line).alias("t")))), lambda x: x["t"])
    return numbered.groupBy(*key, F.col("__g").cast("int").alias("paragraph")).agg(F.array_join(ordered, " ").alias("text"))


def outer_boxes(boxes: DataFrame, key: list[str], box_id: str = "box_id") -> DataFrame:
    """Boxes that lie in no other box of their page: an anti join on containment. Equal boxes do not hide each other."""
    a, b = boxes.alias("a"), boxes.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col(f"a.{box_id}") != F.col(f"b.{box_id}")]
    inside = (F.col("b.x0") <= F.col("a.x0")) & (F.col("b.y0") <= F.col("a.y0")) & (F.col("b.x1") >= F.col("a.x1")) & (F.col("b.y1") >= F.col("a.y1"))
    wider = (F.col("b.x0") < F.col("a.x0")) | (F.col("b.y0") < F.col("a.y0")) | (F.col("b.x1") > F.col("a.x1")) | (F.col("b.y1") > F.col("a.y1"))
    cond = inside & wider
    for c in on:
        cond = cond & c
    return a.join(b, cond, "left_anti")


def data_tables(tables: DataFrame, key: list[str], box_id: str = "box_id", n_rows: str = "n_rows", n_columns: str = "n_columns") -> DataFrame:
    """Tables with enough rows, and columns in their first row, that lie in no other such table of their page."""
    large = tables.where((F.col(n_rows) >= L.MIN_TABLE_ROWS) & (F.col(n_columns) >= L.MIN_TABLE_COLUMNS))
    return outer_boxes(large, key, box_id)


def merge_by_position(prose: DataFrame, rows: DataFrame, boxes: DataFrame, key: list[str]) -> DataFrame:
    """Lines (key, top, x0, pos, line) outside all boxes and table rows (key, top, row_no, line), in order of top.

    Of equal tops lines come first, in order of pos, then table rows.
    """
    a, b = prose.alias("a"), boxes.alias("b")
    cond = (F.col("a.top") >= F.col("b.y0")) & (F.col("a.top") <= F.col("b.y1")) & (F.col("a.x0") >= F.col("b.x0")) & (F.col("a.x0") <= F.col("b.x1"))
    for k in key:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    outside = a.join(b, cond, "left_anti").select(*key, "top", F.lit(0).alias("__kind"), F.col("pos").cast("long").alias("__pos"), "line")
    placed = rows.select(*key, (F.col("top") + 0.01 * F.col("row_no")).alias("top"), F.lit(1).alias("__kind"), F.col("row_no").cast("long").alias("__pos"), "line")
    order = Window.partitionBy(*key).orderBy("top", "__kind", "__pos", "line")
    return outside.unionByName(placed).withColumn("line_no", F.row_number().over(order) - 1).drop("__kind", "__pos")


def ocr_paragraphs(words: DataFrame, key: list[str]) -> DataFrame:
    """Words (key, block_num, par_num, pos, word) joined by paragraph, paragraphs in order of their first word."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    pars = words.where(strip("word") != "").groupBy(*key, "block_num", "par_num").agg(F.min("pos").alias("pos"), F.array_join(ordered, " ").alias("par"))
    return join_lines(pars, key, "pos", "par", "\n\n")


def flatten_table(rows: Column | str) -> Column:
    """Table (array of arrays of nullable cells) -> array of lines: the first row labels the cells of the others."""
    clean = lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x{A0}]+", " "))
    table = col(rows)
    header = F.transform(F.get(table, 0), clean)

    def line(row):
        pairs = F.filter(F.transform(F.transform(row, clean), lambda c, i: F.struct(F.get(header, i).alias("h"), c.alias("c"))), lambda p: (p["c"] != "") & p["h"].isNotNull())
        numbered = F.coalesce(matches(F.get(pairs, 0)["h"], r"№|n[ou]?\b", fold=True), F.lit(False))
        lead = F.when(numbered, F.concat(F.get(pairs, 0)["c"], F.lit(". "))).otherwise(F.lit(""))
        rest = F.when(numbered, F.slice(pairs, F.lit(2), F.greatest(F.size(pairs), F.lit(1)))).otherwise(pairs)
        labelled = F.concat(F.lit("- "), lead, F.array_join(F.transform(rest, lambda p: F.concat(p["h"], F.lit(": "), p["c"])), "; "))
        plain = F.concat(F.lit("- "), F.array_join(F.transform(pairs, lambda p: p["c"]), " "))
        return F.when(F.size(pairs) == 0, F.lit(None)).when(F.size(pairs) <= 2, plain).otherwise(labelled)

    return F.array_compact(F.transform(F.slice(table, F.lit(2), F.greatest(F.size(table), F.lit(1))), line))


def plain_heading(line: Column | str) -> Column:
    return F.regexp_replace(col(line), r"^#{2,6} ", "")


def continues_sentence(previous: Column | str, line: Column | str) -> Column:
    """The previous text has no terminal punctuation and the line starts in lower case."""
    return ~F.rlike(col(previous), F.lit(r"[.;:!?]$")) & F.rlike(col(line), F.lit(r"^\p{Ll}"))


def continues_heading(heading: Column | str, line: Column | str) -> Column:
    h, x = col(heading), col(line)
    header = matches(x, "|".join(f"(?:{p})" for p in L.RUNNING_HEADERS))
    return ~F.rlike(h, F.lit(r"[.;:!?]$")) & (F.length(x) <= 120) & ~F.rlike(x, F.lit(L.BLOCK_MARKER)) & ~header & is_mostly_uppercase(h) & is_mostly_uppercase(x)


#: Finished lines that join_wrapped_lines() copies from step to step; older ones are joined into blocks.
_BLOCK_LINES = 128


def join_wrapped_lines(text: Column | str) -> Column:
    """Lines that go on from the last line that isn't blank are joined to it; blank lines between the halves go.

    A fold, since the test for headings reads what has been joined so far. State: blocks of finished lines, the finished lines since, the last
    line that isn't blank, the blank lines after it, whether it is a heading. So a step copies a block's lines, whatever the length of the text.
    """
    none = F.expr("cast(array() as array<string>)")
    state = F.struct(none.alias("blocks"), none.alias("done"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("blank"), F.lit(False).alias("heading"))
    since = lambda s: F.concat(F.when(s["last"].isNull(), none).otherwise(F.array(s["last"])), F.array_repeat(F.lit(""), s["blank"]))

    def step(s, raw):
        line = F.regexp_replace(raw, r"[\s\x{A0}]+$", "")
        body = plain_heading(line)
        head = F.rlike(line, F.lit(r"^#{2,6} "))
        number = point_number(body)
        tail = F.when(number.isNotNull(), F.regexp_replace(body, r"^(?:[IVXLCDM]{1,6}\.|\d{1,3}(?:\.\d{1,3}){0,3}\.?)\s+", "")).otherwise(body)
        before = plain_heading(F.coalesce(s["last"], F.lit("")))
        usable = (before != "") & ~F.startswith(before, F.lit("|"))
        marker = F.rlike(body, F.lit(L.BLOCK_MARKER))
        sentence = continues_sentence(before, tail) & (number.isNotNull() | ~marker)
        title = s["heading"] & number.isNull() & ~head & continues_heading(before, body)
        full = F.size(s["done"]) >= _BLOCK_LINES
        blocks = F.when(full, F.concat(s["blocks"], F.array(F.array_join(s["done"], "\n")))).otherwise(s["blocks"])
        done = F.concat(F.when(full, none).otherwise(s["done"]), since(s))
        blank = s.withField("blank", s["blank"] + 1)
        joined = s.withField("last", F.concat_ws(" ", s["last"], body)).withField("blank", F.lit(0))
        fresh = F.struct(blocks.alias("blocks"), done.alias("done"), line.alias("last"), F.lit(0).alias("blank"), head.alias("heading"))
        return F.when(strip(line) == "", blank).when(usable & (sentence | title), joined).otherwise(fresh)

    return F.aggregate(F.split(col(text), "\n", -1), state, step, lambda s: F.array_join(F.concat(s["blocks"], s["done"], since(s)), "\n"))


def drop_contents(text: Column | str, start_lines: int = 15, long_line: int = 150, reach: int = 80) -> Column:
    """Body without its table of contents. The header must be among the first lines that aren't blank; the body begins at the
    first sub-point or long line, or at its own headings just before that; with no body in reach only the header goes.
    """
    plain = lambda x: strip(plain_heading(x))
    opens = lambda x: F.rlike(x["t"], F.lit(r"^\d{1,3}\.\d")) | (F.length(x["t"]) > long_line)

    def header(tagged):
        filled = F.slice(F.filter(tagged, lambda x: x["t"] != ""), F.lit(1), F.lit(start_lines))
        return F.get(F.filter(filled, lambda x: F.rlike(x["t"], F.lit("(?iu)" + L.CONTENTS_HEADER))), 0)["i"]

    def opening(tagged, head):
        return F.get(F.filter(F.slice(tagged, head + 2, F.lit(reach)), opens), 0)

    def start(tagged, head, first, part):
        def back(s, x):
            number = point_number(x["t"])
            own = number.isin("1", "I") | F.coalesce(number == F.nullif(part, F.lit("")), F.lit(False))
            marker = F.rlike(x["t"], F.lit(L.BLOCK_MARKER))
            stay = lambda at, stop: F.struct(at.alias("at"), stop.alias("stop"))
            return (
                F.when(s["stop"] | (x["t"] == ""), s)
                .when(number.isNotNull(), stay(F.when(own, x["i"]).otherwise(s["at"]), F.lit(True)))
                .when(marker, stay(x["i"], F.lit(False)))
                .otherwise(stay(s["at"], F.length(x["t"]) > long_line))
            )

        walk = F.reverse(F.slice(tagged, head + 2, first["i"] - head - 1))
        return F.aggregate(walk, F.struct(first["i"].alias("at"), F.lit(False).alias("stop")), back, lambda s: s["at"])

    def kept(lines, tagged, head, first):
        rest = bind(F.regexp_extract(first["t"], r"^(\d{1,3})", 1), lambda part: start(tagged, head, first, part))
        return F.concat(F.slice(lines, F.lit(1), head), F.slice(lines, F.when(first.isNull(), head + 1).otherwise(rest) + 1, F.size(lines)))

    def cut(lines, tagged, head):
        found = bind(opening(tagged, head), lambda first: F.array_join(kept(lines, tagged, head, first), "\n"))
        return F.when(head.isNull(), F.array_join(lines, "\n")).otherwise(found)

    tag = lambda lines: F.transform(lines, lambda x, i: F.struct(i.alias("i"), plain(x).alias("t")))
    return bind(F.split(col(text), "\n", -1), lambda lines: bind(tag(lines), lambda tagged: bind(header(tagged), lambda head: cut(lines, tagged, head))))


def clean_markdown(markdown: Column | str) -> Column:
    """Front matter as it is, body without contents table and with wrapped lines joined."""

    def cleaned(x, end):
        front = F.when(end > 0, F.substring(x, F.lit(1), end + 4)).otherwise(F.lit(""))
        body = F.when(end > 0, F.substring(x, end + 5, F.length(x))).otherwise(x)
        return F.concat(front, join_wrapped_lines(drop_contents(body)))

    end = lambda x: F.when(F.startswith(x, F.lit("---\n")), F.locate("\n---\n", x, 5)).otherwise(F.lit(0))
    return bind(col(markdown), lambda x: bind(end(x), lambda at: cleaned(x, at)))
