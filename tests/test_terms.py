"""What the TF-IDF join costs for each document and each two blocks: names made from bytes, blocks sent once to a task, few cells at a time."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import allpairs, similarity, terms
from test_allpairs import bags

ODD = [
    None, "", "abcd", "Abcd efgh", "Їжак_один ієрогліф ієрогліф", "漢字漢字 𝐀𝐁𝐂𝐃 abcé²def ÀÉÎÕ-ñandú", "x" * 300 + " " + "y" * 70 + " " + "x" * 299, "ßtraße İstanbul ab1c ǅungla abcdéfghi",
    "ab\x00cd efgh ijkl", "efgh", "абв где жзик", "слово " * 500, "а" * 200 + " " + "б" * 200,
]


@pytest.mark.parametrize("piece, group", [(128, 300), (1 << 18, 1 << 20)])
def test_names_are_those_of_tokens(spark, monkeypatch, piece, group):
    """Texts have one name for each term of similarity.tokens(), and no term of another text that has not the same string."""
    monkeypatch.setattr(terms, "PIECE", piece)
    monkeypatch.setattr(terms, "GROUP", group)
    docs = spark.createDataFrame([(t,) for t in [*ODD, *bags(3, 40)]], "text string")
    rows = docs.select(F.lower("text").alias("text"), similarity.tokens("text").alias("t")).select("text", similarity._terms().alias("terms")).collect()
    batch = pa.RecordBatch.from_arrays([pa.array(["none of these", *(r["text"] for r in rows)], pa.string())], names=["text"]).slice(1)
    found, named = [], {}
    for part, at, h, c in terms.Terms(terms.character_classes(spark), 0)(iter([batch])):
        found += [Counter(zip(h[s:e].tolist(), c[s:e].tolist())) for s, e in zip(at[:-1], at[1:])]
        assert len(part) == len(at) - 1
    assert len(found) == len(rows)
    for r, got in zip(rows, found):
        want = Counter(r["terms"] or [])
        assert sorted(got.values()) == sorted(want.values()), r["text"]
        for name in got:
            named[name] = named.get(name, set(want)) & set(want)
    assert all(named.values()) and len(named) == len({t for r in rows for t in r["terms"] or []})


def test_a_task_gets_each_block_once(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(bags(5, 200))], "doc_id long, text string").repartition(9)
    n = docs.count()
    blocks = allpairs.blocks_of_terms(similarity._named(docs, "doc_id", "text"), docs.schema["doc_id"].dataType, n, 2, 1.0)
    count = blocks.count()
    assert count == 9
    for wide in (False, True):
        rows = allpairs._met(blocks, wide).withColumn("part", F.spark_partition_id()).collect()
        pairs = Counter(frozenset((r["a_block"], r["b_block"])) for r in rows if r["met"])
        assert len(pairs) == count * (count + 1) // 2 and set(pairs.values()) == {1}
        for side in "ab":
            sent = Counter((r["part"], r[f"{side}_block"]) for r in rows if r[f"{side}_terms"] is not None)
            assert set(sent) == {(r["part"], r[f"{side}_block"]) for r in rows} and set(sent.values()) == {1}


def test_cells_are_filled_some_rows_at_a_time(monkeypatch):
    """However large blocks are; copies too, of which every cell is wanted."""
    monkeypatch.setattr(allpairs, "_rows", lambda found, kind: found)
    monkeypatch.setattr(allpairs, "CELLS", 500)
    n = 90
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), *(pa.array(np.split(x, n)) for x in (np.tile([1, 2, 3], n), np.full(3 * n, n), np.full(3 * n, 3**-0.5)))], names=["id", "term", "df", "weight"])
    (row,) = allpairs._pack(iter([batch]))
    block = allpairs._Block(row | {"n": 0}, row["ids"])
    assert len(block.doc) == 3 * n
    held = allpairs._Held(block, 0.2)
    assert all(len(sums) <= 500 for _, sums, _ in held.meets(block))
    assert sum(len(x) for x, _, _ in held.similar(block, True)) == n * (n - 1) // 2
