"""The filtering forms and the pipeline's stages on rows made to be awkward."""

from collections import Counter

import pytest

pytest.importorskip("xxhash")

import corpus_pipeline  # noqa: E402
from quillspark.llm import exact_dedup, quality, simhash, substring_dedup  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, __row long, content string, own string"


def text(name, n=80):
    return " ".join(f"{name}{i * 37 % 101}" for i in range(n))


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", None, len(t) if t else None, "r", "d", 5, "c", "o") for k, t in rows], SCHEMA).repartition(3)


def kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


A, B, C = (text(x) for x in ("a77x", "b77x", "c77x"))
ROWS = [(1, A), (1, A), (2, A.replace(" ", "  ")), (1, B), (None, B), (None, C), (None, C), (3, None), (None, None), (None, None), (4, ""), (5, "  "), (6, "few words")]


def test_exact_keeps_one_row_of_each_class(spark):
    out = exact_dedup.drop_exact_duplicates(table(spark, ROWS))
    assert kept(out) == Counter({(1, A): 1, (1, B): 1, (None, C): 1, (3, None): 1, (5, "  "): 1, (6, "few words"): 1})
    assert out.columns == table(spark, ROWS).columns and {tuple(r)[5:] for r in out.collect()} == {("r", "d", 5, "c", "o")}


def test_near_keeps_one_row_of_each_group(spark):
    rows = [*ROWS, (7, A + " tail"), (None, C + " tail"), (0, "tail " + C)]
    out = simhash.drop_near_duplicates(table(spark, rows))
    assert kept(out) == Counter({(1, A): 1, (1, B): 1, (0, "tail " + C): 1, (3, None): 1, (None, None): 2, (4, ""): 1, (5, "  "): 1, (6, "few words"): 1})
    assert out.columns == table(spark, rows).columns


def test_quality_judges_every_row_by_itself(spark):
    rows = [(i, text(f"{'abcdefgh'[i % 8]}{i}x")) for i in range(60)] + ROWS + [(1, "### " * 80)]
    out = kept(quality.keep_quality(table(spark, rows)))
    assert out[(1, A)] == 2 and out[(1, B)] == 1 and out[(None, B)] == 1 and out[(None, C)] == 2
    assert not any(t is None or len(t) < 100 or "#" in t for _, t in out)


def test_substring_keeps_all_rows(spark):
    out = substring_dedup.drop_repeated_words(table(spark, ROWS))
    assert out.count() == len(ROWS)
    assert kept(out)[(None, None)] == 2 and kept(out)[(None, C)] == 2 and kept(out)[(2, "")] == 1


@pytest.mark.parametrize("k", range(5))
def test_stages_take_awkward_and_empty_tables(spark, k):
    _, stage = corpus_pipeline.STAGES[k]
    docs = table(spark, ROWS).select("doc_id", "text", "lang", "source", "n_chars")
    out = stage(spark, docs, "")
    out.collect()
    if k < 4:
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert stage(spark, docs.limit(0), "").count() == 0
