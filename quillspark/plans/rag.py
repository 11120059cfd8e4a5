"""Retrieval and judging: assembled in Spark, with models behind small hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import lexicon as L
from quillspark.functions.text import col, is_page_broken, or_default, strip
from quillspark.operators import lines, metadata
from quillspark.operators.pairs import parse_verdict
from quillspark.workspace import materialize


class Embedder(Protocol):
    """Unit vectors of texts; made once per task by the factory that is handed in."""

    def encode(self, texts: list[str]) -> list[list[float]]: ...


class ChatModel(Protocol):
    def answer(self, system: str, user: str) -> str: ...


class PageReader(Protocol):
    """(page_no, raw, reflowed) of the pages of a binary document."""

    def pages(self, content: bytes) -> Iterator[tuple[int, str, str]]: ...


def passage(text: Column | str) -> Column:
    return F.concat(F.lit("passage: "), col(text))


def question(text: Column | str) -> Column:
    return F.concat(F.lit("query: "), col(text))


def embed(chunks: DataFrame, factory: Callable[[], Embedder], text: str = "embedding_text", batch: int = 64) -> DataFrame:
    """chunks with `embedding`, encoded in batches by one model per task."""

    def run(frames):
        model = factory()
        for f in frames:
            vectors = [v for s in range(0, len(f), batch) for v in model.encode(("passage: " + f[text].iloc[s : s + batch]).tolist())]
            yield f.assign(embedding=vectors)

    return chunks.mapInPandas(run, chunks.withColumn("embedding", F.lit(None).cast("array<float>")).schema)


def read_pages(files: DataFrame, factory: Callable[[], PageReader]) -> DataFrame:
    """(path, page_no, raw, reflowed, error) of binaryFile rows; a file that can't be read is a row with its error."""

    def run(frames):
        reader = factory()
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    out += [(path, n, raw, text, None) for n, raw, text in reader.pages(bytes(content))]
                except Exception as e:  # one bad file doesn't end the run
                    out.append((path, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "page_no", "raw", "reflowed", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, raw string, reflowed string, error string")


class OcrReader(Protocol):
    """Recognised pages of a binary document: all as (page_no, raw, reflowed), or one, numbered from 1, as (raw, reflowed)."""

    def document(self, content: bytes) -> Iterator[tuple[int, str, str]]: ...

    def page(self, content: bytes, page_no: int) -> tuple[str, str]: ...


class WordReader(Protocol):
    """Paragraphs, and table cells in reading order, of a word processor's document."""

    def paragraphs(self, content: bytes) -> list[str]: ...

    def cells(self, content: bytes) -> list[str]: ...


class _WordPages:
    """A word processor's document as one page: paragraphs, then cells that aren't blank."""

    def __init__(self, reader: WordReader):
        self.reader = reader

    def pages(self, content: bytes) -> Iterator[tuple[int, str, str]]:
        text = "\n".join([*self.reader.paragraphs(content), *(c for c in self.reader.cells(content) if c.strip())])
        yield 1, text, text


class _OcrPages:
    def __init__(self, reader: OcrReader):
        self.pages = reader.document


def page_route(path: Column | str, raw: Column | str, error: Column | str) -> Column:
    """Where a page's text comes from: word, text, or ocr of the page or of the whole document."""
    word = F.endswith(F.lower(col(path)), F.lit(".docx"))
    return F.when(word, "word").when(col(error).isNotNull(), "ocr document").when(is_page_broken(raw), "ocr page").otherwise("text")


def extract_pages(files: DataFrame, pages: Callable[[], PageReader], ocr: Callable[[], OcrReader], word: Callable[[], WordReader]) -> DataFrame:
    """(path, page_no, raw, reflowed, used_ocr, error) of binaryFile rows (path, content).

    Word documents are read directly, others through their text layer; where that can't be read the whole document is recognised, else
    only the pages whose layer is broken. The text layer is read once and written; recognition fetches only the files that need it.
    """
    is_word = page_route("path", F.lit("x"), F.lit(None).cast("string")) == "word"
    first = read_pages(files.where(is_word), lambda: _WordPages(word())).unionByName(read_pages(files.where(~is_word), pages))
    routed = materialize(first.withColumn("route", page_route("path", "raw", "error")), "pages")
    good = routed.where(F.col("route").isin("word", "text")).withColumn("used_ocr", F.lit(False))
    failed = routed.where("route = 'ocr document'").select("path").distinct()
    whole = read_pages(files.join(failed, "path", "left_semi"), lambda: _OcrPages(ocr())).withColumn("used_ocr", F.lit(True))
    weak = routed.where("route = 'ocr page'").groupBy("path").agg(F.sort_array(F.collect_list("page_no")).alias("numbers"))

    def run(frames):
        reader = ocr()
        for f in frames:
            out = []
            for path, content, numbers in zip(f["path"], f["content"], f["numbers"]):
                for n in numbers:
                    try:
                        out.append((path, n, *reader.page(bytes(content), int(n)), None))
                    except Exception as e:  # one bad page doesn't end the run
                        out.append((path, n, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "page_no", "raw", "reflowed", "error"])

    kind = "path string, page_no int, raw string, reflowed string, error string"
    single = files.select("path", "content").join(weak, "path").mapInPandas(run, kind).withColumn("used_ocr", F.lit(True))
    columns = ["path", "page_no", "raw", "reflowed", "used_ocr", "error"]
    return good.select(*columns).unionByName(whole.select(*columns)).unionByName(single.select(*columns))


def analyze_documents(pages: DataFrame, previous: DataFrame) -> DataFrame:
    """One row per document of extract_pages(): stem, source, n_pages, used_ocr, title, title_locked, order_number, order_date, body, error.

    previous: (stem, title, title_locked) of documents that were written before; a locked title wins over the guessed one. A document that
    can't be read, or holds no text, is a row with its error and nothing else.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    named = pages.withColumns({"source": name, "stem": F.regexp_replace(name, r"\.[^.]*$", "")})
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.col(c).alias("t")))), lambda x: F.coalesce(x["t"], F.lit(""))), "\n\n")
    whole = named.groupBy("stem", "source").agg(F.count("page_no").alias("n_pages"), F.max("used_ocr").alias("used_ocr"), F.min("error").alias("error"), in_order("raw").alias("text"))
    kept = lines.drop_cover_page(named.where("page_no IS NOT NULL"), ["stem", "source"], "page_no", "reflowed")
    bodies = kept.groupBy("stem", "source").agg(in_order("reflowed").alias("body"))
    text = F.array_join(F.filter(F.split("body", "\n", -1), lambda x: ~lines.is_boilerplate(x)), "\n")
    blocks = lines.split_into_blocks(lines.cut_trailer(text))
    error = F.coalesce("error", F.when(strip("text") == "", F.lit(L.NO_TEXT)))
    locked = previous.where("title_locked").select("stem", F.nullif("title", F.lit("")).alias("locked"))
    joined = whole.withColumn("error", error).join(bodies, ["stem", "source"], "left").join(locked, "stem", "left")
    good = lambda c: F.when(F.col("error").isNull(), c)
    return joined.select(
        "stem", "source", "n_pages", "used_ocr",
        good(F.coalesce("locked", metadata.title("text"))).alias("title"),
        F.col("locked").isNotNull().alias("title_locked"),
        good(F.coalesce(metadata.order_number("text"), F.lit(""))).alias("order_number"),
        good(F.coalesce(metadata.order_date("text"), F.lit(""))).alias("order_date"),
        good(F.coalesce(blocks, F.lit(""))).alias("body"),
        "error",
    )


def context_block(number: Column | str, title, category, subgroup, status, order_number, order_date, path, text) -> Column:
    group = F.when(or_default(subgroup, "") != "", F.concat(col(category), F.lit(" / "), col(subgroup))).otherwise(col(category))
    return F.concat(F.lit("[Фрагмент "), col(number).cast("string"), F.lit("]\nДокумент: "), col(title), F.lit("\nКатегорія: "), group, F.lit("\nСтатус: "), col(status), F.lit("\n№ наказу: "), or_default(order_number, L.DASH), F.lit(" від "), or_default(order_date, L.DASH), F.lit("\nРозділ: "), or_default(path, L.DASH), F.lit("\n\n"), col(text))


def assemble(blocks: DataFrame, order: str, block: str, key: list[str] | None = None) -> DataFrame:
    """Context of each key: its blocks in order between rules."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, block))), lambda x: x[block])
    return blocks.groupBy(*(key or [])).agg(F.array_join(ordered, "\n\n---\n\n").alias("context"))


def preview(text: Column | str, most: int = 500) -> Column:
    return F.when(F.length(col(text)) > most, F.concat(F.substring(col(text), 1, most), F.lit("..."))).otherwise(col(text))


def retrieval_entry(number, similarity, title, category, subgroup, status, order_number, order_date, path, page, text) -> Column:
    """A hit as an entry of a retrieval report."""
    group = F.concat(col(category), F.when(or_default(subgroup, "") != "", F.concat(F.lit(" / "), col(subgroup))).otherwise(F.lit("")))
    head = F.concat(F.lit("--- #"), col(number).cast("string"), F.lit(" (similarity "), F.format_string("%.3f", col(similarity)), F.lit(") ---"))
    order = F.concat(F.lit("Статус: "), col(status), F.lit("  №"), col(order_number), F.lit(" від "), col(order_date))
    return F.concat_ws("\n", head, F.concat(F.lit("Документ: "), col(title)), F.concat(F.lit("Категорія: "), group), order, F.concat(F.lit("Розділ: "), col(path)), F.concat(F.lit("Файл: "), col(page)), preview(text))


def answer_prompt(context: Column | str, asked: Column | str) -> Column:
    return F.concat(F.lit("Контекст (фрагменти документів):\n\n"), col(context), F.lit("\n\n---\n\nПитання: "), col(asked))


def answer(prompts: DataFrame, prompt: str, factory: Callable[[], ChatModel], system: str = L.ANSWER_RULES) -> DataFrame:
    """prompts with the model's `answer`. A call that fails ends the job: an answer isn't left out silently."""

    def run(frames):
        model = factory()
        for f in frames:
            yield f.assign(answer=[model.answer(system, p) for p in f[prompt]])

    return prompts.mapInPandas(run, prompts.withColumn("answer", F.lit(None).cast("string")).schema)


def used_fragment(number, title, path, order_number, order_date, page, similarity) -> Column:
    """A fragment that an answer was given from, as an entry of its report."""
    order = F.concat(F.lit("      №"), or_default(order_number, L.DASH), F.lit(" від "), or_default(order_date, L.DASH), F.lit(" | "), col(page), F.lit(" (similarity "), F.format_string("%.3f", col(similarity)), F.lit(")"))
    return F.concat_ws("\n", F.concat(F.lit("  ["), col(number).cast("string"), F.lit("] "), col(title)), F.concat(F.lit("      Пункт: "), or_default(path, L.DASH)), order)


def answer_report(asked: Column | str, answered: Column | str, fragments: Column | str) -> Column:
    """Question, answer and the fragments used; fragments is an array of used_fragment() in order."""
    return F.concat(F.lit("Питання: "), col(asked), F.lit("\n\nВідповідь:\n"), col(answered), F.lit("\n\nВикористані фрагменти:\n"), F.array_join(col(fragments), "\n"))


def judge_prompt(title_a, path_a, text_a, title_b, path_b, text_b, most: int = 800) -> Column:
    side = lambda n, t, p, x: F.concat(F.lit(f"[Фрагмент {n}] Документ: "), col(t), F.lit(" (розділ "), or_default(p, L.DASH), F.lit(")\n"), F.substring(col(x), 1, most))
    return F.concat(side("A", title_a, path_a, text_a), F.lit("\n\n"), side("B", title_b, path_b, text_b))


def judge(pairs: DataFrame, prompt: str, system: str, factory: Callable[[], ChatModel]) -> DataFrame:
    """pairs with verdict and explanation; a call that fails gives the error verdict for its pair alone."""

    def run(frames):
        model = factory()
        for f in frames:
            answers = []
            for p in f[prompt]:
                try:
                    answers.append(model.answer(system, p))
                except Exception:
                    answers.append(None)
            yield f.assign(answer=answers)

    answered = pairs.mapInPandas(run, pairs.withColumn("answer", F.lit(None).cast("string")).schema)
    parsed = parse_verdict("answer")
    failed = F.struct(F.lit(L.VERDICTS["error"]).alias("verdict"), F.lit("немає відповіді").alias("explanation"))
    return answered.withColumn("v", F.when(F.col("answer").isNull(), failed).otherwise(parsed)).select(*pairs.columns, "v.verdict", "v.explanation")
