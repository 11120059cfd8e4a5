"""Repeated windows of tokens across a corpus, found through anchors.

A window is `threshold` consecutive tokens of one document. Its anchor is the least hash of the grams (`gram` tokens) in it, so
equal windows have equal anchors. Consecutive windows with one anchor position make a segment. The flow:

  ask      every document's segments are dealt to buckets by anchor, without content: an anchor that occurs once in the
           corpus can have no repeated window. Answers are written as a table
  fetch    documents send the content of their other segments, routed by the anchor
  match    rows come sorted by their route; whole routes are gathered to shards of bounded size, and each shard decides
           which windows are repeated: this is where the operators differ
  collect  the spans of each document come together again

What many documents share is settled before each shuffle: a task that holds equal anchors or equal segments twice knows the
answer for them, answers itself, and sends one record for all, so a hot passage costs a record per task, not one per document.
An anchor that more than HOT segments have (the edges of a passage that a third of all documents share, each with its own
context) is not a route of its own: its segments are sent window by window, routed by the window's hash. Nothing is capped.

A row is named by 128 bits of hashes of its key, whether that is null, and its text; rows that are alike in all of these share a name,
are looked at twice at most in a task, and have the same spans. Questions carry the first 64 bits and a tag of 32 of the others.
Lost executors cost the usual recomputation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillspark.llm.tokenizer import column_bytes
from quillspark.llm.worker import binaries, frugal, text_slices
from quillspark.workspace import materialize

_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POS = np.uint64((1 << 22) - 1)
#: Tokens handled at once; documents of more than four times as many are cut into overlapping blocks.
CHUNK = 1 << 18
#: Segments that a task gathers before it sends them.
BATCH = 250_000
#: Bytes of content that a task gathers before it sends it, and that a shard has before it is closed.
FETCH_BYTES, SHARD_BYTES = 24 << 20, 6 << 20
#: Spans that a task gathers.
MOST_SPANS = 300_000
#: Anchors of more segments are split into windows.
HOT = 30_000
#: Hot anchors are broadcast up to so many (16 bytes each), and joined by a shuffle beyond.
BROADCAST_HOT = 500_000
#: Bytes of input for each bucket of the first exchange, and the most buckets.
_BUCKET_BYTES, _MOST_BUCKETS = 8 << 20, 1 << 20

_DEALT = "bucket int, name long, blob binary"
_ANSWER = "name long, tag int, anchor long, start int, n int, hot long"
_CONTENT = "route long, low long, last boolean, n int, times int, content binary, blob binary"
_FOUND = "bucket int, blob binary"
_ASK = np.dtype([("anchor", "<u8"), ("name", "<i8"), ("tag", "<i4"), ("start", "<u4"), ("n", "<u4"), ("note", "<u4")])
_SEG = np.dtype([("anchor", "<u8"), ("tag", "<i4"), ("start", "<u4"), ("n", "<u4")])
_REF = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("start", "<u4")])
SPAN = np.dtype([("start", "<u4"), ("n", "<u4")])
_NAMED = np.dtype([("h1", "<i8"), ("h2", "<i8"), ("start", "<u4"), ("n", "<u4")])


@dataclass(frozen=True)
class Windows:
    """threshold and gram in tokens (gram a power of two); tokens: texts -> (hashes one after another, how many each text has);
    content: text -> slice of it by tokens, b"" beyond its end."""

    threshold: int
    gram: int
    tokens: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    content: Callable[[bytes], Callable[[int, int], bytes]]


def gram_hashes(tokens: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams: polynomials of doubled length, mixed."""
    h, m, size = tokens.astype(np.uint64), _MUL, 1
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * m + h[size:]
            m, size = m * m, 2 * size
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(29)
        h *= _MUL
    return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    have = 1
    while 2 * have <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def segments(tokens: np.ndarray, lengths: np.ndarray, w: Windows) -> tuple[np.ndarray, ...]:
    """Segments of documents that lie one after another in tokens: first window, windows, anchor, anchor's occurrences."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    has = lengths >= w.threshold
    if not has.any():
        return none
    h = gram_hashes(tokens, w.gram)
    low = _sliding_min(h & ~_POS | np.arange(len(h), dtype=np.uint64), w.threshold - w.gram + 1)
    ends = np.cumsum(lengths)
    mark = np.zeros(len(low) + 1, np.int64)
    np.add.at(mark, (ends - lengths)[has], 1)
    np.add.at(mark, (ends - w.threshold + 1)[has], -1)
    at = np.flatnonzero(np.cumsum(mark[:-1]))
    pos = (low[at] & _POS).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, n, anchor = at[new], np.diff(np.append(new, len(at))), h[pos[new]]
    # one anchor again and again, as in a run of one character: one segment
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + n[:-1])]))
    return first[new], np.add.reduceat(n, new), anchor[new], np.diff(np.append(new, len(first)))


def _all_segments(names: np.ndarray, tags: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, w: Windows) -> Iterator[np.ndarray]:
    """Segment records (_ASK; note holds the anchor's occurrences, 2 for more) of documents that lie one after another in tokens."""

    def out(blocks):
        doc, at, size = (np.array(x, np.int64) for x in zip(*blocks))
        flat = tokens[at[0] : at[-1] + size[-1]] if (at[1:] == at[:-1] + size[:-1]).all() else np.concatenate([tokens[a : a + s] for a, s in zip(at, size)])
        first, n, anchor, occ = segments(flat, size, w)
        starts = np.cumsum(size) - size
        own = np.searchsorted(starts, first, side="right") - 1
        r = np.zeros(len(first), _ASK)
        r["anchor"], r["n"], r["note"], r["name"], r["tag"] = anchor, n, np.minimum(occ, 2), names[doc[own]], tags[doc[own]]
        r["start"] = first - starts[own] + (at - begin[doc])[own]
        return r

    begin = np.cumsum(lengths) - lengths
    group, size = [], 0
    for doc in np.flatnonzero(lengths >= w.threshold).tolist():
        n = int(lengths[doc])
        for at in range(0, n - w.threshold + 1, 4 * CHUNK):  # blocks share no window
            part = min(n - at, 4 * CHUNK + w.threshold - 1)
            group.append((doc, int(begin[doc]) + at, part))
            size += part
            if size >= CHUNK:
                yield out(group)
                group, size = [], 0
    if group:
        yield out(group)


def _planes(r: np.ndarray) -> bytes:
    """Records byte by byte, all first bytes, all second ones and so on, for the codec of the exchange."""
    return np.ascontiguousarray(r).view(np.uint8).reshape(len(r), r.dtype.itemsize).T.tobytes()


def _records(blob: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    """A batch of columns of one length, the first of them given; None stands for nulls."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    size = len(next(c for c in columns if c is not None))
    return pa.RecordBatch.from_arrays([pa.nulls(size, kinds[t]) if c is None else pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _ask(w: Windows, buckets: int):
    def send(records: np.ndarray):
        r = records[np.argsort(records["anchor"], kind="stable")]
        new = _runs(r["anchor"])
        total = np.add.reduceat(r["note"].astype(np.int64), new)
        known = np.repeat(total > 1, np.diff(np.append(new, len(r))))
        asks = np.concatenate([r[~known], r[new[total > 1]]])  # one note for all that is known here
        asks["note"] = np.concatenate([np.zeros(int((~known).sum()), np.int64), np.minimum(total[total > 1], 1 << 31)])
        to = ((asks["anchor"] >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((asks["start"], to))
        asks, to = asks[order], to[order]
        out = [(int(to[a]), 0, _planes(asks[a:b])) for a, b in _pairs(_runs(to), len(to))]
        own = r[known]
        own = own[np.lexsort((own["start"], own["name"]))]
        for a, b in _pairs(_runs(own["name"]), len(own)):
            name = int(own["name"][a])
            seg = np.zeros(b - a, _SEG)
            for c in _SEG.names:
                seg[c] = own[c][a:b]
            out.append((buckets + name % buckets, name, _planes(seg)))
        return _batch(_DEALT, list(zip(*out)))

    def run(rows):
        held, size, seen = [], 0, Counter()
        for batch in rows:
            for s in text_slices(batch, "text", 2_000_000):
                names, others = (s.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2"))
                new = []
                for i, name in enumerate(zip(names.tolist(), others.tolist())):  # a row like two others here tells nothing new
                    seen[name] += 1
                    if seen[name] <= 2:
                        new.append(i)
                if len(new) < len(names):
                    s, names, others = s.take(pa.array(new, pa.int64())), names[new], others[new]
                for r in _all_segments(names, others.astype(np.int32), *w.tokens(s.column("text")), w):
                    held.append(r)
                    size += len(r)
                if size >= BATCH:
                    yield send(np.concatenate(held))
                    held, size = [], 0
                    seen.clear()
        if size:
            yield send(np.concatenate(held))

    return frugal(run)


def _pairs(starts: np.ndarray, end: int) -> list[tuple[int, int]]:
    starts = starts.tolist()
    return list(zip(starts, [*starts[1:], end]))


def _by_bucket(rows, columns: tuple[str, ...] = ("bucket", "name", "blob")) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows that come in the order of their buckets, a bucket at a time."""
    bucket, held = None, []
    for batch in rows:
        for b, name, x in zip(*(batch.column(c).to_pylist() for c in columns)):
            if b != bucket:
                if held:
                    yield bucket, held
                bucket, held = b, []
            held.append((name, x))
    if held:
        yield bucket, held


def _answer(buckets: int, hot: int):
    """Segments whose anchors occur again, and anchors of more than `hot` segments."""

    def pack(name, r):
        return _batch(_ANSWER, [name, r["tag"].astype(np.int32), np.ascontiguousarray(r["anchor"]).view(np.int64), r["start"].astype(np.int32), r["n"].astype(np.int32), None])

    def run(rows):
        for bucket, held in _by_bucket(rows):
            if bucket >= buckets:
                parts = [_records(x, _SEG) for _, x in held]
                yield pack(np.repeat(np.array([name for name, _ in held], np.int64), [len(x) for x in parts]), np.concatenate(parts))
                continue
            r = np.concatenate([_records(x, _ASK) for _, x in held])
            r = r[np.argsort(r["anchor"], kind="stable")]
            new = _runs(r["anchor"])
            size = np.diff(np.append(new, len(r)))
            often = r["anchor"][new[np.add.reduceat(np.maximum(r["note"].astype(np.int64), 1), new) > hot]]
            again = np.repeat((size > 1) | (np.maximum.reduceat(r["note"], new) > 0), size) & (r["note"] == 0)
            yield pack(r["name"][again].astype(np.int64), r[again])
            if len(often):
                yield _batch(_ANSWER, [None, None, None, None, None, np.ascontiguousarray(often).view(np.int64)])

    return frugal(run)


@dataclass(slots=True)
class Content:
    """A distinct segment: its route, windows, least document (whether its key is null, and the key), how often it occurs, and who waits for an answer."""

    route: int
    n: int
    low: tuple[bool, int]
    times: int
    refs: set[tuple[int, int, int]]  # h1, h2, start


def merge(into: dict[bytes, Content], content: bytes, c: Content, settle: Callable[[Content, tuple[int, int, int]], None], by_order: bool) -> None:
    """Add c to the contents of a task. settle() is told of those whose windows are all repeated as of now.

    by_order: only a smaller document's copy counts, so of equal contents the least document's rows go on waiting.
    Otherwise nobody waits once there are two.
    """
    have = into.get(content)
    if have is None:
        into[content] = c
        if not by_order and c.times > 1:
            for r in c.refs:
                settle(c, r)
            c.refs = set()
        return
    have.times += c.times
    if not by_order:
        for r in have.refs | c.refs:
            settle(have, r)
        have.refs = set()
    elif c.low == have.low:
        have.refs |= c.refs
    else:
        first, last = (have, c) if have.low < c.low else (c, have)
        for r in last.refs:
            settle(last, r)
        have.low, have.refs = first.low, first.refs


class Spans:
    """Spans of tokens found so far, with the names of their rows."""

    def __init__(self, buckets: int):
        self.buckets, self.flat = buckets, []

    def add(self, h1: int, h2: int, start: int, n: int) -> None:
        self.flat.append((h1, h2, start, n))

    def take(self) -> tuple[list[int], list[bytes]]:
        """(buckets, records of each); none are left. A record goes to the bucket of its name's first half."""
        r = np.unique(np.array(self.flat, _NAMED))
        self.flat = []
        to = r["h1"] % self.buckets
        order = np.argsort(to, kind="stable")
        r, to = r[order], to[order]
        cuts = _pairs(_runs(to), len(to))
        return [int(to[a]) for a, _ in cuts], [_planes(r[a:b]) for a, b in cuts]


def _asked_of(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, int, bool]]]:
    """The distinct segments (anchor, start, n, hot) that each row is asked for. Those with another tag are another row's."""
    lists = batch.column("asked")
    flat = lists.flatten()
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    own = flat.field("tag").to_numpy(zero_copy_only=False) == np.repeat(batch.column("h2").to_numpy(zero_copy_only=False).astype(np.int32), size)
    flat = flat.filter(pa.array(own))
    parts = [flat.field(c).to_pylist() for c in ("anchor", "start", "n", "hot")]
    ends = np.concatenate([[0], np.cumsum(own)])[np.cumsum(size)].tolist()
    for a, b in zip([0, *ends[:-1]], ends):
        yield sorted(set(zip(*(x[a:b] for x in parts))), key=lambda x: x[1])


def _fetch(w: Windows, by_order: bool, buckets: int):
    import xxhash

    def send(contents, spans):
        items = list(contents.items())
        for at in range(0, len(items), 10_000):
            some = items[at : at + 10_000]
            c = [x for _, x in some]
            yield _batch(_CONTENT, [[x.route for x in c], [x.low[1] for x in c], [x.low[0] for x in c], [x.n for x in c], [x.times for x in c], [x for x, _ in some], [np.array(list(x.refs), _REF).tobytes() for x in c]])
        bucket, blob = spans.take()
        yield _batch(_CONTENT, [bucket, None, None, None, None, None, blob])

    def run(rows):
        contents, spans, size, seen = {}, Spans(buckets), 0, Counter()
        settle = lambda c, r: spans.add(*r, c.n + w.threshold - 1)
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        for batch in rows:
            for h1, h2, low, last, text, asked in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "dk", "nk")), batch.column("text"), _asked_of(batch)):
                seen[h1, h2] += 1
                if seen[h1, h2] > (1 if by_order else 2):  # rows like others that are held tell nothing new
                    continue
                take = w.content(memoryview(text.as_buffer()))
                for anchor, start, n, hot in asked:
                    for first, k in [(start + i, 1) for i in range(n)] if hot else [(start, n)]:
                        x = take(first, first + k + w.threshold - 1)
                        if x:
                            merge(contents, x, Content(signed(xxhash.xxh64_intdigest(x)) if hot else anchor, k, (last, low), 1, {(h1, h2, first)}), settle, by_order)
                            size += len(x) + 500  # with its objects
                if size > FETCH_BYTES or len(spans.flat) > MOST_SPANS:
                    yield from send(contents, spans)
                    contents, size = {}, 0
                    seen.clear()
        yield from send(contents, spans)

    return frugal(run)


def _match(w: Windows, by_order: bool, buckets: int, decide: Callable[[list[tuple[bytes, Content]], Windows], Iterator[tuple[int, np.ndarray]]], most: int):
    """Shards of whole routes. decide: of the contents of a shard, (index, mask of repeated windows) of those that somebody waits for."""

    def shard(contents, spans) -> None:
        items = list(contents.items())
        for i, mask in decide(items, w):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            for a, b in edge.reshape(-1, 2).tolist():
                for h1, h2, start in items[i][1].refs:
                    spans.add(h1, h2, start + a, b - a + w.threshold - 1)

    def run(rows):
        contents, spans, size, now = {}, Spans(buckets), 0, None
        settle = lambda c, r: spans.add(*r, c.n + w.threshold - 1)
        for batch in rows:
            told = batch.filter(batch.column("content").is_null())
            if len(told):
                yield _batch(_FOUND, [told.column("route").cast(pa.int32()), told.column("blob")])
            batch = batch.filter(batch.column("content").is_valid())
            for route, low, last, n, times, x, refs in zip(*(batch.column(c).to_pylist() for c in ("route", "low", "last", "n", "times", "content", "blob"))):
                if route != now and size > most:
                    shard(contents, spans)
                    contents, size = {}, 0
                    if len(spans.flat) > MOST_SPANS:
                        yield _batch(_FOUND, list(spans.take()))
                now = route
                size += len(x)
                merge(contents, x, Content(route, n, (last, low), times, set(np.frombuffer(refs, _REF).tolist())), settle, by_order)
        shard(contents, spans)
        yield _batch(_FOUND, list(spans.take()))

    return frugal(run)


@frugal
def _collect(rows):
    """The spans of a bucket by row: (h1, found: h2 and SPAN records of each row with that first half)."""
    for _, held in _by_bucket(rows, ("bucket", "bucket", "blob")):
        r = np.unique(np.concatenate([_records(x, _NAMED) for _, x in held]))  # in the order of names
        new = np.flatnonzero(np.concatenate([[True], (r["h1"][1:] != r["h1"][:-1]) | (r["h2"][1:] != r["h2"][:-1])]))
        spans = np.zeros(len(r), SPAN)
        spans["start"], spans["n"] = r["start"], r["n"]
        blobs = binaries(spans.view(np.uint8), SPAN.itemsize * np.diff(np.append(new, len(r))))
        h1, h2 = np.ascontiguousarray(r["h1"][new]), np.ascontiguousarray(r["h2"][new])
        first = _runs(h1)
        ends = np.append(first, len(h1)).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(h2), blobs], ["h2", "blob"]))
        yield pa.RecordBatch.from_arrays([pa.array(h1[first]), found], names=["h1", "found"])


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(h1, h2, dk, nk, text): the two halves of a row's name, its key (0 for null), whether that is null, its text.

    carry: also `row`, the columns of docs but for an empty text, so that the joins of the flow share one shuffle of the rows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    k, null = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")), F.col(key).isNull()
    own = [F.struct(*[F.col(c) if c != text else F.when(F.col(c).isNotNull(), F.lit("")).alias(c) for c in docs.columns]).alias("row")]
    return docs.select(*[F.xxhash64(F.lit(f"name {i}"), null, k, t).alias(f"h{i}") for i in (1, 2)], k.alias("dk"), null.alias("nk"), t.alias("text"), *own[: int(carry)])


def _plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of df."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def repeated_spans(rows: DataFrame, w: Windows, decide, by_order: bool, hot: int = HOT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(h1, found: array of (h2, binary SPAN records)) of the rows of keyed() that have repeated windows."""
    buckets = min(_MOST_BUCKETS, max(4 * max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), _plan_bytes(rows) // _BUCKET_BYTES))
    dealt = rows.select("h1", "h2", "text").mapInArrow(_ask(w, buckets), _DEALT)
    answers = materialize(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer(buckets, hot), _ANSWER), "answers")
    often = answers.where("hot IS NOT NULL").select(F.col("hot").alias("anchor"))
    n_often = often.count()
    segs = answers.where("hot IS NULL").drop("hot")
    if n_often:
        marked = often.withColumn("hot", F.lit(True))
        segs = segs.join(F.broadcast(marked) if n_often <= BROADCAST_HOT else marked, "anchor", "left")
    else:
        segs = segs.withColumn("hot", F.lit(False))
    one = F.struct("tag", "anchor", "start", "n", F.coalesce("hot", F.lit(False)).alias("hot"))
    asked = segs.groupBy(F.col("name").alias("h1")).agg(F.collect_set(one).alias("asked"))
    sent = rows.join(asked.hint("merge"), "h1").select("h1", "h2", "dk", "nk", "text", "asked").mapInArrow(_fetch(w, by_order, buckets), _CONTENT)
    found = sent.repartition("route").sortWithinPartitions("route").mapInArrow(_match(w, by_order, buckets, decide, shard_bytes), _FOUND)
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_collect, "h1 long, found array<struct<h2:long,blob:binary>>")


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row of keyed() with its spans, `blobs`; null where it has none."""
    own = F.transform(F.filter("found", lambda x: x["h2"] == F.col("h2")), lambda x: x["blob"])
    return rows.join(spans.hint("merge"), "h1", "left").withColumn("blobs", own).drop("found")


def key_column() -> Column:
    return F.when(~F.col("nk"), F.col("dk"))


def covered(blobs: list[bytes] | None, n: int) -> np.ndarray:
    """Mask of the tokens in spans."""
    if not blobs:
        return np.zeros(n, bool)
    s = np.frombuffer(b"".join(blobs), SPAN)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, s["start"], 1)
    np.add.at(mark, s["start"].astype(np.int64) + s["n"], -1)
    return np.cumsum(mark[:-1]) > 0


def ranks(items: list[tuple[bytes, Content]]) -> np.ndarray:
    """Places of the contents' least documents in the order of keys, null last; equal keys have one place."""
    null, key = np.array([c.low[0] for _, c in items], bool), np.array([c.low[1] for _, c in items], np.int64)
    order = np.lexsort((key, null))
    out = np.empty(len(items), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], (key[order][1:] != key[order][:-1]) | (null[order][1:] != null[order][:-1])])) if len(items) else 0
    return out


def word_slices(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of texts without ASCII white space, where each word begins in them and the last ends, words of each text)."""
    data, ends = column_bytes(texts)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    first = ~gap
    cut = np.concatenate([[True], gap[:-1]]) if len(data) else np.zeros(0, bool)
    cut[ends[:-1][ends[:-1] < len(data)]] = True
    first &= cut
    upto = np.concatenate([[0], np.cumsum(~gap)])
    words = np.flatnonzero(first)
    return data[~gap], np.append(upto[words], upto[-1]), np.diff(np.searchsorted(words, ends))
