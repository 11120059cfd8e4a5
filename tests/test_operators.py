"""Boundary cases of the folds, and graphs, readers and hooks."""

import random

from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import catalog, classify, lines, links, metadata, sections
from quillspark.operators.graph import connected_components
from quillspark.plans import rag
from quillspark.sources import sinks, wiki


def value(spark, column, **literals):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in literals.items()]).select(column.alias("v")).first()["v"]


def test_page_quality_boundaries(spark):
    for text, broken in (("", True), ("а" * 39, True), ("а" * 40, False), ("а" * 12 + "1" * 28, False), ("а" * 11 + "1" * 29, True), (" " * 50, True)):
        assert value(spark, X.is_page_broken("t"), t=text) is broken


def test_packing_boundaries(spark):
    pack = lambda *sizes: [len(x) for x in value(spark, sections.pack_paragraphs("p"), p=["x" * n for n in sizes])]
    assert pack(600, 598) == [1200]  # 602 + 598 is the target exactly
    assert pack(600, 599) == [600, 599]
    assert pack(1300, 5) == [1300, 5]
    assert pack() == []


def test_oversized_split(spark):
    df = spark.createDataFrame([(1, "y" * 2501), (2, "z" * 2500), (3, "w " * 1300)], "id int, text string")
    got = {r["id"]: [len(p) for p in r["pieces"]] for r in sections.split_oversized(df).collect()}
    assert got == {1: [1200, 1301], 2: [2500], 3: [1199, 1399]}


def test_short_title(spark):
    assert value(spark, sections.short_title("t"), t="а" * 80) == "а" * 80
    assert value(spark, sections.short_title("t"), t="слово " + "б" * 80) == "слово…"


def test_tiny_merge(spark):
    def merge(*sizes):
        df = spark.createDataFrame([(1, i, f"p{i}", "x" * n) for i, n in enumerate(sizes)], "d int, leaf int, path string, text string")
        return [(r["path"], len(r["text"])) for r in sections.merge_tiny(df, ["d"]).orderBy("chunk").collect()]

    assert merge(39, 40) == [("p1", 81)]
    assert merge(40, 39, 40) == [("p0", 81), ("p2", 40)]
    assert merge(19, 19, 50) == [("p1", 40), ("p2", 50)]
    assert merge(5, 5) == [("", 12)]


def test_sections_skip_levels(spark):
    body = "intro\n## A\ntext\n#### B\nmore text\n### C\n##### kept as text\n## D\n"
    df = spark.createDataFrame([(1, body)], "d int, body string")
    got = [(r["level"], r["path"], r["text"]) for r in sections.sections(df, ["d"]).orderBy("section").collect()]
    assert got == [(0, "", "intro"), (1, "A", "text"), (3, "A > B", "more text"), (2, "A > C", "##### kept as text"), (1, "D", "")]


def test_wrapped_lines_and_contents(spark):
    assert value(spark, lines.join_wrapped_lines("t"), t="Перша частина\n\nдруга частина.\nНовий") == "Перша частина друга частина.\nНовий"
    assert value(spark, lines.join_wrapped_lines("t"), t="## ПЕРШИЙ ЗАГОЛОВОК\nПРОДОВЖЕННЯ ЗАГОЛОВКА\nтекст") == "## ПЕРШИЙ ЗАГОЛОВОК ПРОДОВЖЕННЯ ЗАГОЛОВКА текст"
    toc = "ЗМІСТ\nВступ\n1. Загальне\n2. Інше\n## 1. Загальне\n1.1. Текст пункту\nдалі"
    assert value(spark, lines.drop_contents("t"), t=toc) == "## 1. Загальне\n1.1. Текст пункту\nдалі"
    assert value(spark, lines.drop_contents("t"), t="Без змісту\nтекст") == "Без змісту\nтекст"


def test_metadata(spark):
    cover = "Екземпляр № 1\nЗАТВЕРДЖЕНО\nНаказ від 7 травня 2024 р. № 123/од.\nПОЛОЖЕННЯ\nпро щось важливе\n\nРектор"
    assert value(spark, metadata.order_number("t"), t=cover) == "123/од"
    assert value(spark, metadata.order_date("t"), t=cover) == "2024-05-07"
    assert value(spark, metadata.title("t"), t=cover) == "ПОЛОЖЕННЯ про щось важливе"
    assert value(spark, metadata.order_date("t"), t="01.02.2020") == "2020-02-01"
    assert value(spark, metadata.order_date("t"), t="нічого") is None


def test_components_against_union_find(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(120)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_wiki_round_trip(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: 'Довга\n  назва'\nstatus: затверджено\norder_date: 2024-01-02\ntitle_locked: true\n---\n\nтіло\n", "utf-8")
    (tmp_path / "b.md").write_text("---\nstatus:\tзламано\n---\nтіло\n", "utf-8")
    (tmp_path / "c.md").write_text("без заголовка", "utf-8")
    got = {r["stem"]: r for r in wiki.read_wiki(spark, str(tmp_path)).collect()}
    assert (got["a"]["title"], got["a"]["order_date"], got["a"]["fm_ok"], got["a"]["title_locked"]) == ("Довга назва", "2024-01-02", True, True)
    assert (got["b"]["fm_ok"], got["b"]["title"]) == (False, "b")
    assert (got["c"]["has_front"], got["c"]["body"]) == (False, "без заголовка")
    record = wiki.read_wiki(spark, str(tmp_path)).where("stem = 'a'").select(sinks.markdown_record()).first()[0]
    assert record.startswith('---\ntitle: "Довга назва"\nstatus: "затверджено"\n') and record.endswith("тіло\n")


def test_hooks(spark):
    class Fake:
        def encode(self, texts):
            return [[float(len(t)), 0.0] for t in texts]

        def answer(self, system, user):
            if "bad" in user:
                raise OSError
            return "ВЕРДИКТ: суперечність\nПОЯСНЕННЯ: так"

        def pages(self, content):
            if content == b"broken":
                raise ValueError("broken")
            yield 1, content.decode(), content.decode()

    df = spark.createDataFrame([(1, "ab"), (2, "bad")], "id int, embedding_text string")
    assert [r["embedding"] for r in rag.embed(df, Fake).orderBy("id").collect()] == [[11.0, 0.0], [12.0, 0.0]]
    assert [r["verdict"] for r in rag.judge(df, "embedding_text", "", Fake).orderBy("id").collect()] == ["СУПЕРЕЧНІСТЬ", "ПОМИЛКА"]
    files = spark.createDataFrame([("x", bytearray(b"ok")), ("y", bytearray(b"broken"))], "path string, content binary")
    assert [(r["path"], r["raw"], r["error"]) for r in rag.read_pages(files, Fake).orderBy("path").collect()] == [("x", "ok", None), ("y", None, "broken")]


def test_print_helpers(spark):
    assert value(spark, catalog.localised_date("d"), d="2024-02-03") == "3 лютого 2024 р."
    assert value(spark, catalog.localised_date("d"), d="") == ""
    assert value(spark, catalog.inline("d"), d="**[так](x)** і 1\\.") == "так і 1."
    assert value(spark, catalog.pad_table("d"), d=[["a"], ["b", "c"]]) == [["a", ""], ["b", "c"]]


def test_merge_by_position_ties(spark):
    prose = spark.createDataFrame([(1, 5.0, 0.0, 1, "b"), (1, 5.0, 0.0, 2, "a"), (1, 9.0, 6.0, 3, "in a box"), (1, 9.0, 50.0, 4, "beside")], "doc int, top double, x0 double, pos int, line string")
    rows = spark.createDataFrame([(1, 5.0, 1, "r1"), (1, 5.0, 0, "r0")], "doc int, top double, row_no int, line string")
    boxes = spark.createDataFrame([(1, 6.0, 10.0, 5.0, 30.0)], "doc int, y0 double, y1 double, x0 double, x1 double")
    got = lines.merge_by_position(prose, rows, boxes, ["doc"]).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in got] == [(0, "b"), (1, "a"), (2, "r0"), (3, "r1"), (4, "beside")]
    assert lines.merge_by_position(prose.limit(0), rows.limit(0), boxes, ["doc"]).count() == 0


def test_prior_state(spark):
    new = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "stem string, title string").withColumns({"status": F.lit("x"), "category": F.lit("new"), "n": F.lit(1)})
    old = spark.createDataFrame([("a", "old A", True, "чинний", "k", "s"), ("b", "old B", None, "", None, None)], "stem string, title string, title_locked boolean, status string, category string, subgroup string")
    got = {r["stem"]: (r["title"], r["status"], r["category"], r["subgroup"], r["n"]) for r in classify.carry_prior_state(new, old).collect()}
    assert got == {"a": ("old A", "чинний", "k", "s", 1), "b": ("B", "невідомо", None, None, 1), "c": ("C", "невідомо", None, None, 1)}


def test_bullet_runs(spark):
    body = "- один\n- два\nабзац\n- три"
    found = catalog.blocks(spark.createDataFrame([(1, body), (2, "абзац"), (3, None)], "doc int, body string"), ["doc"])
    got = {(r["doc"], r["block_no"]): r["items"] for r in catalog.bullet_runs(found, ["doc"]).collect()}
    assert got == {(1, 0): ["один", "два"], (1, 3): ["три"]}


def test_diff_of_equal_and_null_texts(spark):
    df = spark.createDataFrame([(1, "a\nb", "a\nc"), (2, "a", "a"), (3, None, "a"), (4, None, None)], "id int, old string, new string")
    got = {r["id"]: r["d"] for r in df.select("id", sinks.unified_diff("old", "new").alias("d")).collect()}
    assert got[1].splitlines()[-3:] == [" a", "-b", "+c"] and got[2] == "" and got[3].endswith("+a") and got[4] == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pages_are_routed_and_analysed(spark):
    good, weak = "Достатньо довгий рядок тексту на сторінці документа. ", "12"

    class Pdf:
        def pages(self, content):
            if content == b"broken":
                raise ValueError("no layer")
            for n, x in enumerate(content.decode().split("|"), 1):
                yield n, x, x

    class Ocr:
        def document(self, content):
            yield 1, "розпізнано цілком", "розпізнано цілком"

        def page(self, content, page_no):
            return f"сторінка {page_no}", f"сторінка {page_no}"

    class Word:
        def paragraphs(self, content):
            return ["перший", "другий"]

        def cells(self, content):
            return ["комірка", " ", "ще одна"]

    rows = [("d/a.pdf", f"{good}|{weak}".encode()), ("d/b.pdf", b"broken"), ("d/c.DOCX", b""), ("d/e.pdf", good.encode())]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    pages = rag.extract_pages(files, Pdf, Ocr, Word)
    got = {(r["path"], r["page_no"]): (r["raw"], r["used_ocr"]) for r in pages.collect()}
    assert got == {
        ("d/a.pdf", 1): (good, False),
        ("d/a.pdf", 2): ("сторінка 2", True),
        ("d/b.pdf", 1): ("розпізнано цілком", True),
        ("d/c.DOCX", 1): ("перший\nдругий\nкомірка\nще одна", False),
        ("d/e.pdf", 1): (good, False),
    }
    more = pages.unionByName(spark.createDataFrame([("d/x.pdf", None, None, None, True, "lost"), ("d/y.pdf", 1, " ", " ", True, None)], pages.schema))
    previous = spark.createDataFrame([("a", "Закріплена назва", True), ("e", "Стара назва", False)], "stem string, title string, title_locked boolean")
    docs = {r["stem"]: r for r in rag.analyze_documents(more, previous).collect()}
    assert (docs["a"]["title"], docs["a"]["title_locked"], docs["a"]["n_pages"], docs["a"]["used_ocr"]) == ("Закріплена назва", True, 2, True)
    assert docs["a"]["body"].strip().endswith("сторінка 2") and docs["e"]["title"] != "Стара назва"
    assert (docs["x"]["error"], docs["x"]["body"], docs["y"]["error"]) == ("lost", None, "no text extracted")


def test_answers_and_records(spark, tmp_path):
    class Model:
        def answer(self, system, user):
            assert system.startswith("Ти — асистент")
            return f"відповідь: {len(user)}"

    asked = spark.createDataFrame([(1, "питання")], "id int, p string")
    assert [r["answer"] for r in rag.answer(asked, "p", Model).collect()] == ["відповідь: 7"]
    body = "## I. Розділ\n\n" + "Речення документа. " * 40 + "[Статут](/wiki-pages/s.html)\n"
    text = lambda t: f"---\ntitle: '{t}'\nstatus: s\ncategory: k\n---\n{body}"
    (tmp_path / "in").mkdir()
    for name in ("a б.md", "c+d.md"):
        (tmp_path / "in" / name).write_text(text(name), "utf-8")
    (tmp_path / "in" / "bare.md").write_text("без заголовка", "utf-8")
    docs = wiki.read_wiki(spark, str(tmp_path / "in"))
    loaded = {r["stem"]: (r["title"], r["order_number"]) for r in wiki.load_documents(spark, str(tmp_path / "in")).collect()}
    assert loaded == {"a б": ("a б.md", ""), "c+d": ("c+d.md", "")}
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old.md").write_text("stays", "utf-8")
    assert sinks.write_records(docs.where("has_front"), str(tmp_path / "out")) == 2
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a б.md", "c+d.md", "old.md"]
    again = {r["stem"]: r["title"] for r in wiki.read_wiki(spark, str(tmp_path / "out")).collect()}
    assert again["a б"] == "a б.md" and again["old"] == "old"
    records = sections.chunk_records(docs.where("has_front"))
    sinks.write_chunks(records, str(tmp_path / "chunks"))
    chunks = {r["chunk_id"]: r for r in wiki.read_chunks(spark, str(tmp_path / "chunks")).collect()}
    assert set(chunks) >= {"a б::0", "c+d::0"} and chunks["a б::0"]["wiki_page"] == "wiki-pages/a б.md"
    assert chunks["a б::0"]["embedding_text"].startswith("Документ: a б.md\nКатегорія: k\n")
    vectors_of = wiki.read_chunks(spark, str(tmp_path / "chunks")).withColumn("embedding", F.array(F.lit(3.0).cast("float"), F.lit(4.0).cast("float")))
    sinks.write_vectors(vectors_of, str(tmp_path / "vectors"))
    row = wiki.read_vectors(spark, str(tmp_path / "vectors")).first()
    assert row["order_number"] == "" and row["status"] == "s" and row["document"]


def test_streamed_stems_and_chunks(spark, tmp_path):
    from quillspark.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a б.md").write_text("---\ntitle: x\n---\n## Розділ\n\nТекст документа, який досить довгий для шматка.\n", "utf-8")
    ingest.chunk_stream(ingest.stream_wiki(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r["stem"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a б"}


def test_mentions_equal_every_pattern_on_every_body(spark):
    rnd = random.Random(3)
    titles = ["Положення про відділ кадрів", "Положення про Вчену раду факультету", "Кодекс академічної доброчесності", "Тимчасове положення про практику", "Порядок прийому", "Правила прийому на навчання"]
    forms = ["положення про відділ кадрів", "Положенням про відділ кадрів", "кодексу академічної доброчесності", "тимчасового положення про практику", "Положення про вчену раду факультетуX", "xтимчасове положення про практику", "правилами прийому на навчання", "порядок прийому"]
    docs = spark.createDataFrame([(f"t{i}" if i < 6 else f"d{i}", " і ".join(rnd.choice(forms) for _ in range(3))) for i in range(60)], "stem string, body string")
    specs = links.link_specs(spark.createDataFrame([(f"t{i}", t) for i, t in enumerate(titles)], "stem string, title string"))
    got = {tuple(r) for r in links.mentions(docs, specs).collect()}
    plain = links._located(docs.crossJoin(specs).where("stem <> target"), "stem", "body")
    assert got == {tuple(r) for r in plain.collect()} and len(got) > 40
    linked = links.link_cross_references(docs, specs).collect()
    assert all(r["body"].count("](/wiki-pages/") == r["n_links"] for r in linked) and sum(r["n_links"] for r in linked) > 40
