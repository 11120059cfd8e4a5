"""Repeated windows: the index, the radix sort, and rows that are alike."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import anchors, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string"


def contents(rnd):
    """Segments of one anchor: runs, parts of one passage, parts with unknown words; keys with ties, nulls and extremes."""
    base = [rnd.choice([b"a", b"b", b"c", b"w%d" % rnd.randrange(30)]) for _ in range(60)]
    items = {}
    for _ in range(rnd.randrange(1, 40)):
        n = rnd.choice([1, 2, 5, 9, 40])
        at = rnd.randrange(0, max(1, 48 - n))
        words = base[at : at + n + 12] if rnd.random() < 0.7 else [b"a"] * (n + 12) if rnd.random() < 0.3 else [rnd.choice(base) for _ in range(n + 12)]
        if rnd.random() < 0.4:
            words[rnd.randrange(len(words))] = b"zz%d" % rnd.randrange(3)
        low = (rnd.random() < 0.1, rnd.choice([-(1 << 63), (1 << 63) - 1, *range(12)]))
        items[b" ".join(words)] = anchors.Content(0, len(words) - 12, low, 1, {(1, 1, 0)} if rnd.random() < 0.8 else set())
    return list(items.items())


def brute(items):
    first, out = {}, {}
    for x, c in items:
        words = x.split()
        for i in range(c.n):
            k = tuple(words[i : i + 13])
            first[k] = min(first.get(k, c.low), c.low)
    for j, (x, c) in enumerate(items):
        words = x.split()
        mask = [first[tuple(words[i : i + 13])] < c.low for i in range(c.n)]
        if c.refs and any(mask):
            out[j] = mask
    return out


def decided(items):
    return {i: m.tolist() for i, m in substring_dedup._decide(items, substring_dedup.word_windows())}


def test_streams_through_indexes():
    rnd = random.Random(3)
    for _ in range(150):
        items = contents(rnd)
        assert decided(items) == brute(items)


def test_backward_search_is_what_finds_windows(monkeypatch):
    items = next(x for x in (contents(random.Random(i)) for i in range(99)) if brute(x))
    monkeypatch.setattr(substring_dedup.FMIndex, "step", lambda self, symbol, low, high: (low, low))
    assert decided(items) != brute(items)


def test_no_streamed_text_is_in_its_index(monkeypatch):
    stream = substring_dedup._stream

    def watched(symbols, indexed, streamed, w):
        texts = lambda first, sizes, *_: {tuple(symbols[a : a + n].tolist()) for a, n in zip(first.tolist(), sizes.tolist())}
        assert not texts(*indexed) & texts(*streamed)
        return stream(symbols, indexed, streamed, w)

    monkeypatch.setattr(substring_dedup, "_stream", watched)
    items = contents(random.Random(12))
    assert decided(items) == brute(items)


def test_radix_groups_in_byte_order():
    rnd = random.Random(4)
    for _ in range(150):
        buf = np.array([rnd.randrange(2) for _ in range(rnd.randrange(30, 300))], np.uint8) * rnd.choice([1, 255, 97])
        depth = rnd.choice([7, 8, 9, 16, 20])
        starts = np.array(rnd.sample(range(len(buf) - depth + 1), rnd.randrange(1, len(buf) - depth + 2)))
        group = np.array([rnd.randrange(2) for _ in starts])
        at, number = suffix_dedup.radix_groups(buf, starts, group, depth)
        by, found = defaultdict(list), defaultdict(list)
        for s, g in zip(starts.tolist(), group.tolist()):
            by[g, buf[s : s + depth].tobytes()].append(s)
        for s, g in zip(at.tolist(), number.tolist()):
            found[g].append(s)
        assert [sorted(found[g]) for g in range(len(found))] == [sorted(v) for _, v in sorted(by.items()) if len(v) > 1]


def brute_rows(rows, split, n, by_order):
    """(key, units removed) of every row."""
    order = lambda k: (k is None, k or 0)
    first, count, out = {}, Counter(), Counter()
    for k, t in rows:
        x = split(t or "")
        for i in range(len(x) - n + 1):
            w = tuple(x[i : i + n])
            first[w], count[w] = min(first.get(w, order(k)), order(k)), count[w] + 1
    for k, t in rows:
        x = split(t or "")
        hit = lambda w: first[w] < order(k) if by_order else count[w] > 1  # noqa: B023, E731
        gone = {j for i in range(len(x) - n + 1) if hit(tuple(x[i : i + n])) for j in range(i, i + n)}
        out[k, len(gone), hashlib.sha256((b" " if by_order else b"").join(u if by_order else bytes([u]) for i, u in enumerate(x) if i not in gone)).hexdigest()] += 1
    return out


def removed(df):
    return Counter((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def passages(rnd):
    word = lambda: f"w{rnd.randrange(10**6)}"
    shared = [" ".join(word() for _ in range(rnd.randrange(14, 60))) for _ in range(6)]
    text = lambda: " ".join(" ".join([word() for _ in range(rnd.randrange(0, 20))]) if rnd.random() < 0.5 else rnd.choice(shared) for _ in range(4))
    rows = [(rnd.choice([None, -(1 << 63), (1 << 63) - 1, *range(40)]), text()) for _ in range(120)]
    return [*rows, *rows[:5], (None, None), (3, ""), (None, text())]


@pytest.mark.parametrize("hot, shard", [(30_000, 6 << 20), (2, 400)])
def test_hot_anchors_and_small_shards(spark, hot, shard):
    """Splitting hot anchors into windows, and closing shards early, changes nothing."""
    rows = passages(random.Random(hot))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for windows, decide, by_order, split, n in (
        (substring_dedup.word_windows(), substring_dedup._decide, True, lambda t: t.encode().split(), 13),
        (suffix_dedup.byte_windows(), suffix_dedup._decide, False, lambda t: t.encode(), 200),
    ):
        named = anchors.keyed(docs)
        spans = anchors.with_spans(named, anchors.repeated_spans(named, windows, decide, by_order, hot, shard))
        digest, out = (substring_dedup._digest, "doc_id long, n_words long, n_removed long, kept_sha256 string") if by_order else (suffix_dedup._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
        got = removed(spans.select(anchors.key_column().alias("doc_id"), "text", "blobs").mapInArrow(digest, out))
        assert got == brute_rows(rows, split, n, by_order)


def test_rows_with_clashing_hashes(spark, monkeypatch):
    """Rows whose first name halves are all the same are still told apart."""
    keyed = anchors.keyed
    clash = lambda *a, **k: keyed(*a, **k).withColumn("h1", F.lit(7).cast("long"))
    monkeypatch.setattr(substring_dedup, "keyed", clash)
    monkeypatch.setattr(suffix_dedup, "keyed", clash)
    rows = passages(random.Random(5))[:60]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert removed(substring_dedup.remove_repeated_words(docs)) == brute_rows(rows, lambda t: t.encode().split(), 13, True)
    assert removed(suffix_dedup.remove_repeated_bytes(docs)) == brute_rows(rows, lambda t: t.encode(), 200, False)


def test_many_copies_of_one_row(spark):
    text = " ".join(f"w{i}" for i in range(40))
    one = spark.createDataFrame([(None, text)], SCHEMA)
    docs = one.crossJoin(spark.range(10_000).select(F.lit(1).alias("x"))).drop("x").repartition(5).union(spark.createDataFrame([(1, f"x {text}")], SCHEMA))
    out = substring_dedup.remove_repeated_words(docs).groupBy("doc_id", "n_removed").count().collect()
    assert {(r["doc_id"], r["n_removed"], r["count"]) for r in out} == {(None, 40, 10_000), (1, 0, 1)}
    out = suffix_dedup.remove_repeated_bytes(docs.where("doc_id IS NULL")).groupBy("n_removed").count().collect()
    assert [tuple(r) for r in out] == [(len(text) if len(text) >= 200 else 0, 10_000)]


def test_texts_beyond_every_block(spark):
    """Longer than a block of tokens, a slice and a stretch of windows."""
    rnd = random.Random(2)
    passage = [f"p{i}" for i in range(30)]
    words = [f"w{rnd.randrange(10**7)}" for _ in range(1_200_000)]
    for at in (0, 262_140, 1_048_570, 1_199_960):
        words[at : at + 30] = passage
    rows = [(1, " ".join(passage)), (2, " ".join(words)), (3, "same " * 300_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeated_words(docs).collect()}
    assert out == {1: (30, 0), 2: (1_200_000, 120), 3: (300_000, 0)}
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeated_bytes(docs.where("doc_id = 3")).collect()}
    assert out == {3: (1_500_000, 1_500_000, 1)}
