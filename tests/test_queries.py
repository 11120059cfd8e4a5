"""Every query of the core against its oracle in DuckDB."""

from collections import Counter

import duckdb
import pytest

from quillspark.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert rows == Counter(repr([plain(dict(zip(want.columns, r))[c]) for c in columns]) for r in want.fetchall())


#: Texts that are null, blank, long without letters, about 40 characters long, or that end in blanks which engines tell apart.
ODD_TEXTS = [None, "", " \u00a0\n", "12 345 " * 40, "1|2 " * 40, "|" * 39, "|" * 40, "а" * 39 + " \n", "а" * 40 + " \n", "а" * 39 + "\x0b", "а" * 39 + " \u2028", "а" * 38 + " \u2029 ", "\x85" + "а" * 38, "\f\u00a0|" + "а" * 37 + "\x1c"]


def against_sql(name, spark, tmp_path, rows, columns="doc_id long, text string, lang string, source string, n_chars long"):
    """The query and its SQL over documents of (doc_id, text)."""
    names = [c.split()[0] for c in columns.split(", ")]
    spark.createDataFrame([(*r, *[None] * (len(names) - len(r))) for r in rows], columns).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLES[name])
    got = Counter(repr([plain(r[c]) for c in want.columns]) for r in df.collect())
    assert got == Counter(repr([plain(v) for v in r]) for r in want.fetchall())
    return got


def test_text_routing_of_odd_texts(spark, tmp_path):
    against_sql("text_routing", spark, tmp_path, list(enumerate(ODD_TEXTS)))


def test_run_statistics_of_odd_texts(spark, tmp_path):
    against_sql("run_statistics", spark, tmp_path, list(enumerate(ODD_TEXTS)))
