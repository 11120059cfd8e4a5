"""The pipeline's near dedup against brute force."""

import random
from collections import Counter

import pytest

pytest.importorskip("xxhash")

import corpus_pipeline  # noqa: E402
from quillspark.llm import simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """Rows without those that are 0.8 similar to one before them, in the order of keys, null keys last."""
    shingles = []
    for k, t in rows:
        w = (t or "").encode().lower().split()
        shingles.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    near = lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b)
    return [rows[y] for n, y in enumerate(order) if not any(near(shingles[x], shingles[y]) for x in order[:n])]


def edited(rnd):
    """Texts with copies at all degrees of editing, a passage in many documents, and a large group of near copies."""
    words = [f"w{i}" for i in range(3000)]
    passage, out = " ".join(rnd.choices(words, k=40)), []
    for _ in range(60):
        base = rnd.choices(words, k=rnd.randrange(50, 200))
        out.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in rnd.sample(range(len(copy)), rnd.randrange(0, len(copy) // 20)):
                copy[at] = rnd.choice(words)
            out.append(" ".join(copy))
    out += [f"{passage} {' '.join(rnd.choices(words, k=rnd.randrange(0, 14)))}" for _ in range(150)]
    group = rnd.choices(words, k=120)
    out += [" ".join([*group[:at], "edit", *group[at + 1 :]]) for at in range(100)]
    rnd.shuffle(out)
    return out


def test_near_dedup_against_brute_force(spark):
    texts = edited(random.Random(7))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (904, "a c")]
    docs = spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], SCHEMA).repartition(3)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter(brute(rows))
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_near_dedup_of_shared_and_null_keys(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (None, b), (None, c), (None, c), (None, "d " * 60)]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
    assert Counter((r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs).collect()) == Counter([(1, a), (1, b), (None, c), (None, "d " * 60)])
