"""The blocked similarity join against all pairs, and what it leaves on disk."""

import math
import os
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark import workspace
from quillspark.operators import allpairs, similarity
from quillspark.operators.graph import connected_components
from quillspark.plans.queries import QUERIES
from test_queries import against_sql

WORDS = [a + b + c for a in "бвгджзк" for b in "аеиоу" for c in ("лок", "мир", "сад", "тон")]


def bags(seed, n, sizes=(1, 4, 12, 60)):
    r = random.Random(seed)
    out = [r.choices(WORDS, k=r.choice(sizes)) for _ in range(n)]
    return [" ".join(b) for b in out + [[*b[:-1], r.choice(WORDS)] for b in out[: n // 5]] + out[:3]]


def odd_documents():
    return [*enumerate(bags(5, 60)), (900, None), (901, ""), (902, "балок бамир")]


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.7])
@pytest.mark.parametrize("docs, postings", [(7, 1 << 19), (2048, 40), (2048, 1 << 19)])
def test_blocks_against_all_pairs(monkeypatch, threshold, docs, postings):
    """Names come in three slices of the dictionary; documents are held and packed in small parts."""
    for name, value in (("DOCS", docs), ("POSTINGS", postings), ("HELD", 100), ("FORMED", 50)):
        monkeypatch.setattr(allpairs, name, value)
    monkeypatch.setattr(allpairs, "_rows", lambda found, kind: found)
    texts = [t.split() for t in bags(7, 90)]
    n, df = len(texts), Counter(w for t in texts for w in set(t))
    name = {w: random.Random(w).getrandbits(64) - (1 << 63) for w in WORDS}
    kept = {w for w in df if 2 <= df[w] <= 0.5 * n}
    slices = []
    for k in range(3):
        part = sorted((name[w], df[w]) for w in kept if name[w] % 3 == k)
        slices.append(SimpleNamespace(value=(np.array([h for h, _ in part], np.int64), np.array([d for _, d in part], np.int32))))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(s, min(s + 25, n))), pa.array([[name[w] for w in t] for t in texts[s : s + 25]], pa.list_(pa.int64()))], names=["id", "h"]) for s in range(0, n, 25)]
    blocks = [allpairs._Block(x | {"n": n}, x["ids"]) for x in allpairs._encode(slices, n)(iter(batches))]
    assert all(len(b.ids) <= docs for b in blocks)
    vectors = []
    for t in texts:
        v = {w: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in Counter(t).items() if w in kept}
        vectors.append({w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()})
    sims = {(i, j): sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) for i in range(n) for j in range(i + 1, n)}
    got = Counter()
    for i, a in enumerate(blocks):
        held = allpairs._Held(a, threshold)
        for b in blocks[i:]:
            for mine, row, sim in held.similar(b, a is b):
                got.update((*sorted((a.ids[int(x)].as_py(), b.ids[int(y)].as_py())), round(s, 6)) for x, y, s in zip(mine, row, sim) if round(s, 9) >= threshold)
    assert got == Counter((i, j, round(s, 6)) for (i, j), s in sims.items() if round(s, 9) >= threshold)


def test_terms_with_one_name_are_named_anew(spark):
    docs = spark.createDataFrame(odd_documents(), "id long, text string")

    def hashed(salt):
        name = lambda f: F.transform(F.split("text", " "), lambda x: f(x, F.lit(salt)))
        rows = docs.select("id", name(F.xxhash64).alias("h"), name(F.hash).alias("c"))
        return rows.withColumn("h", F.transform("h", lambda x: F.pmod(x, F.lit(50)))) if salt == 0 else rows

    blocks = allpairs.blocks_of_terms(hashed, docs.schema["id"].dataType, 500, 2, 1.0)
    names = {w for b in blocks.collect() for w in allpairs._Block(b.asDict() | {"n": 500}, b["ids"]).terms.tolist()}
    df = Counter(w for _, t in odd_documents() if t is not None for w in set(t.split(" ")))
    assert len(names) == sum(v >= 2 for v in df.values())


@pytest.mark.parametrize("name", ["tfidf_edges", "best_edge", "clusters_by_size"])
def test_queries_of_odd_documents(name, spark, tmp_path):
    """Keys that occur twice and rows without one are documents as in SQL, as are texts without terms."""
    assert against_sql(name, spark, tmp_path / "unique", odd_documents())
    assert against_sql(name, spark, tmp_path / "repeated", [*odd_documents(), (3, "бадон " * 4), (3, "бемир бамир"), (None, "балок бамир"), (None, "балок")])
    assert not against_sql(name, spark, tmp_path / "none", [(1, None), (2, "а")])


@pytest.mark.parametrize("name", ["tfidf_edges", "best_edge", "clusters_by_size"])
def test_what_pairs_have_in_common_is_not_written(name, spark, tmp_path):
    """Tables of the run are no larger than the texts; terms and meets are not shuffled rows of their own."""
    r = random.Random(3)
    words = ["".join(r.choices("абвгдежзик", k=6)) for _ in range(3000)]
    rows = [(i, " ".join(r.choices(words, k=200))) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    size = lambda top: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
    before, read = workspace.tables(), size(f"{tmp_path}/documents.parquet")
    QUERIES[name](spark, str(tmp_path)).collect()
    written = {p: size(p) for p in workspace.tables() - before}
    assert written and sum(written.values()) < 2 * read, (written, read)


def test_best_edges_finds_edges_once(spark, tmp_path):
    spark.createDataFrame(odd_documents(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["best_edge"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def copied_documents():
    """Different texts that are nearly one, copies of them and of odd ones; the least key of a text isn't its first."""
    near = [f"{' '.join(WORDS[:20])} {w} {v}" for w, v in zip(WORDS[20:80], WORDS[21:81])]
    texts = [*near, *[t for _, t in odd_documents()]]
    return [(1000 * (5 - k) + i, t) for k in range(5) for i, t in enumerate(texts)] + [(7, "щастя щогла"), (6, "щастя щогла"), (8, "щука"), (None, near[0])]


@pytest.mark.parametrize("name", ["best_edge", "clusters_by_size"])
def test_copies_are_compared_once(name, spark, tmp_path):
    before = workspace.tables()
    assert against_sql(name, spark, tmp_path, copied_documents())
    held = [p for p in workspace.tables() - before if "-blocks-" in p]
    compared = spark.read.parquet(*held).select(F.explode("ids").alias("id")).collect()
    assert len(compared) == len({t for _, t in copied_documents()})


def test_best_similarity_passes_on_a_row_per_document_and_task(spark, tmp_path, monkeypatch):
    """Pairs of a group of like texts are not rows of the shuffle: 60 texts, 1,770 pairs."""
    spark.createDataFrame(copied_documents()[:60], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(similarity, "_spread", lambda docs: docs)
    blocks, n, _ = similarity._one_of_each(docs, "doc_id", "text", 2, 1.0)
    met = allpairs._met(blocks, True)
    sent = met.mapInArrow(allpairs._best(0.2, n), "node long, best double").count()
    assert 60 <= sent <= 60 * met.rdd.getNumPartitions()
    assert allpairs.similar_pairs(blocks, 0.2, n).count() == 1770


def test_clusters_are_joined_from_forests(spark, tmp_path, monkeypatch):
    """Of a group's pairs only a spanning forest of each task goes on: fewer than 60 for 60 texts in one block."""
    spark.createDataFrame(copied_documents()[:60], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sent = []

    def components(edges):
        sent.append(edges.count())
        return connected_components(edges)

    monkeypatch.setattr(similarity, "_spread", lambda docs: docs)
    monkeypatch.setattr(similarity, "connected_components", components)
    QUERIES["clusters_by_size"](spark, str(tmp_path)).collect()
    assert len(sent) == 1 and 0 < sent[0] < 60


@pytest.mark.parametrize("docs", [5, 2048])
def test_folds_of_many_blocks_against_pairs(docs, monkeypatch):
    """The best of each document and the components, over blocks that meet in one task, against all pairs of them."""
    monkeypatch.setattr(allpairs, "DOCS", docs)
    monkeypatch.setattr(allpairs, "_rows", lambda found, kind: found)
    texts = [t.split() for t in bags(11, 60)]
    term = {w: i for i, w in enumerate(WORDS)}
    df = Counter(w for t in texts for w in set(t))
    rows = [sorted(Counter(t).items()) for t in texts]
    weights = [[c / math.sqrt(sum(x * x for _, x in r)) for _, c in r] for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([[term[w] for w, _ in r] for r in rows]), pa.array([[df[w] for w, _ in r] for r in rows]), pa.array(weights)], names=["id", "term", "df", "weight"])
    blocks = list(allpairs._pack(iter([batch])))
    columns = ["ids", *allpairs._FIELDS]

    def met():
        for i, a in enumerate(blocks):
            for j, b in enumerate(blocks[i:], i):
                cells = {"a_block": pa.array([i]), "b_block": pa.array([j])}
                for side, x in (("a", a), ("b", b)):
                    cells |= {f"{side}_{c}": pa.array([x[c].to_pylist()], pa.list_(pa.int64())) if c == "ids" else pa.array([x[c]], pa.binary()) for c in columns}
                yield pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))

    rows_of = lambda fold: [tuple(r.values()) for b in fold(0.3, 0)(met()) for r in b.to_pylist()]
    pairs, best, links = rows_of(allpairs._compare), rows_of(allpairs._best), rows_of(allpairs._links)
    want = {}
    for x, y, sim in pairs:
        if round(sim, 9) >= 0.3:
            want[x], want[y] = max(sim, want.get(x, 0)), max(sim, want.get(y, 0))
    assert {k: round(v, 9) for k, v in best} == {k: round(v, 9) for k, v in want.items()} and len(best) == len(want)

    def components(edges):
        up = {}
        root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
        for x, y in edges:
            x, y = sorted((root(x), root(y)))
            up[y] = x
        return {x: root(x) for x in up}

    assert components(links) == components([(x, y) for x, y, s in pairs if round(s, 9) >= 0.3])
    assert len(links) == len(want) - len(set(components(links).values()))
