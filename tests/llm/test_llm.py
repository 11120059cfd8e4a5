"""The operators against brute force, on texts made to be awkward and on a small table."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillspark.llm import exact_dedup, packing, quality, simhash, sp_bpe, substring_dedup, suffix_dedup, token_counts, token_files, tokenizer, url_filter  # noqa: E402

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dk string, row int, bucket int, words string"


def awkward():
    rnd = random.Random(3)
    words = ["the", "über", "𝄞x", "слово", "a.b", "it's", "12", "…", "x" * 40]
    prose = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120))) for _ in range(25)]
    passage = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", " ", "\n", "a", "one two", " a  b\t\tc \n\n d ", "\u00a0x\u2003y\x1cz\x85", "<|endoftext|> end", "r" * 700, "ab" * 400, passage, f"x {passage} y", f"{passage} {passage}", "word " * 3000, *prose, prose[0], prose[0].replace(" ", "  "), prose[1] + " tail"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}", None, "clash", i, i, "clash") for i, t in enumerate(awkward())]
    rows += [rows[12], (None, "null key " * 30, None, None, None, None, None, None, None), (None, "null key " * 30, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def got(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def ids_of(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


ALPHABET = ["a", "B", "the", "é", "×", "÷", "ß", " ", " ", "  ", "\n", "\n", "\t", "\r\n", "'", "'s", "'ll", "1", "23", ".", ",", "(", "<|endoftext|>", "<|endof", "text|>", "слово", "…", "\u00a0", "\u2028", "\x1c", "\x85", "漢字", "한", "𝄞", "ª", "\u0301", "\x00", "$", "_", "''"]


@pytest.mark.parametrize("special", [True, False])
def test_pieces_equal_whole(special):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = not special
    enc, rnd = tokenizer.Encoder(JSON, special), random.Random(8)
    enc.pool.size = 200  # forget again and again
    for _ in range(60):
        texts = [*awkward(), *("".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(30))) for _ in range(30))]
        rnd.shuffle(texts)
        ids, counts = enc.encode_column(pa.array(texts).slice(rnd.randrange(3)))
        texts = texts[-len(counts) :]
        cut = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in cut] == [ids_of(tok, t or "") for t in texts]


def test_added_tokens_are_the_librarys(spark, tok):
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n", "<|endof", "text|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {i: ids_of(tok, t) for i, t in enumerate(texts)}
    assert 50256 in want[0]
    assert {r["doc_id"]: r["doc_tokens"] for r in token_counts.count_tokens(df, JSON).collect()} == {i: len(x) for i, x in want.items()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert {r["doc_id"]: r["ids_crc32"] for r in packing.pack(df, JSON).collect()} == {i: crc([*x, 1]) for i, x in want.items()}


def test_token_counts(docs, rows, tok, empty):
    length = {i: len(t) for t, i in tok.get_vocab().items()}
    for rule in token_counts.RULES:
        want = Counter()
        for k, t in rows:
            raw, at, n = t.encode(), 0, len(t.split("\n"))
            char = [i for i, c in enumerate(t) for _ in c.encode()]
            line = [t[:i].count("\n") for i in range(len(t))]
            counts = [0] * n
            for i in ids_of(tok, t):
                own = [line[c] for c in sorted({char[b] for b in range(at, at + length[i])})]
                pick = own[0] if rule == "first" else own[-1] if rule == "last" else min(set(own), key=lambda x: (-own.count(x), x))
                counts[pick] += 1
                at += length[i]
            assert at == len(raw)
            want.update((k, s, c) for s, c in enumerate(counts))
        assert got(token_counts.count_tokens(docs, JSON, rule), "doc_id", "section", "n_tokens") == want
    assert token_counts.count_tokens(empty, JSON).count() == 0
    cut = docs.withColumn("starts", F.array(F.lit(3), F.lit(5)))
    total = {r["doc_id"]: r["n"] for r in token_counts.count_tokens(cut, JSON, starts="starts").where("doc_id < 40").groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert all(total[k] == (2 if k == 12 else 1) * len(ids_of(tok, t)) for k, t in rows if k is not None and k < 40)


URLS = ["http://Example.COM/en/a", "https://www.example.com/en/", "x", None, "", "http://a.net/es/1?x#y", "http://net/fr/", "ftp://my-casino.org/", "http://com", "http://notcom/", "http://com/#a", "a://b.com?/en/", "http://casino.org", "http://a.casino/", "http://a.org/casino", "http://a.org/casinos/x", "http://a.org/?casino=1", "http://a.org/?x=casino", "http://a.org/free-poker.html", "http://a.org/freepoker", "http://a.org/poker-free", "http://x.org/a.net/es/", "http://x.org?b.net/es/", "http://free_slots.org", "http://a.org/s-e-x", "http://z.org/@"]


def judged(u, words, modifiers):
    """(host, path, rule, verdict) by every rule in turn."""
    import re

    from quillspark.llm.entries import URL_RULES

    host = path = query = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1].split("#")[0]
        place, mark, query = rest.partition("?")
        host, slash, path = place.partition("/")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path, query = slash + path, mark + query
    fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    bad = any(w in host.split(".")[:-1] or re.split("[._-]", s)[0] == w for w in words for s in path.split("/")[1:] or [""])
    bad |= any(p.partition("=")[0] in words and "=" in p for p in re.split("[?&]", query)[1:])
    runs = re.findall("[A-Za-z0-9]+", host + path + query)
    bad |= any(x in {m + w for m in modifiers for w in words} for x in runs)
    bad |= any(re.search(rf"(^|[^A-Za-z0-9]){m}[-_]{w}([^A-Za-z0-9]|$)", host + path + query) for m in modifiers for w in words)
    return host, path, None, "block" if bad else "allow"


@pytest.mark.parametrize("inline", [10_000, 0])
def test_url_filter(spark, inline):
    from quillspark.llm.entries import URL_RULES, URL_WORDS, url_rules

    pages = spark.createDataFrame([(i % 11, u, "clash") for i, u in enumerate([*URLS, URLS[0]])], "page_id long, url string, rule string")
    words, modifiers = ["casino", "poker", "slots", "sex"], ["free", "my"]
    rules = [url_filter.prefix_rule(*r) for r in URL_RULES]
    for w in words:
        rules += [url_filter.label_rule("block", w), url_filter.segment_rule("block", w), url_filter.parameter_rule("block", w)]
        rules += [r for m in modifiers for r in url_filter.pair_rules("block", m, w)]
    want = Counter((i % 11, *judged(u, words, modifiers)) for i, u in enumerate([*URLS, URLS[0]]))
    assert got(url_filter.judge_urls(pages, rules, inline=inline), "page_id", "host", "path", "rule", "verdict") == want
    extra = [*rules, url_filter.Rule("block", "@", ()), url_filter.word_rule("block", "casinos")]
    blocked = {r["url"] for r in url_filter.judge_urls(pages, extra, inline=inline).where("verdict = 'block' AND rule IS NULL").collect()}
    assert {"http://z.org/@", "http://a.org/casinos/x"} <= blocked
    assert url_filter.judge_urls(pages.limit(0), rules, inline=inline).count() == 0
    assert len(url_rules()) > 2_000 and len(set(URL_WORDS)) == len(URL_WORDS)


def test_simhash(docs, rows, empty):
    import xxhash

    fp = []
    for _, t in rows:
        w = t.encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    part = list(range(len(fp)))
    for _ in fp:
        part = [min(part[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 3) for i in range(len(fp))]
    low = {}
    for (k, _), p in zip(rows, part):
        low[p] = min((x for x in (k, low.get(p)) if x is not None), default=None)
    want = Counter((k, f"{f:016x}", low[p]) for (k, _), f, p in zip(rows, fp, part))
    assert got(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_are_complete(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(0, 4))) for b in base for _ in range(30)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long")).collect()
    assert len(links) < 40 * len(fps)

    def parts(edges):
        parent = {f: f for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        return Counter(frozenset(f for f in fps if find(f) == r) for r in {find(f) for f in fps})

    mask = (1 << 64) - 1
    assert parts([(r["src"] & mask, r["dst"] & mask) for r in links]) == parts([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])


def check_packing(pieces, rows, tok, length):
    """Every id of every row in exactly one piece, sequences full but for the last."""
    seqs, by = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
        by[p["doc_id"]].append((p["doc_tokens"], p["start"], p["length"], p["ids_crc32"]))
    assert sorted(seqs) == list(range(len(seqs)))
    for s, own in seqs.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at == length or s == max(seqs) and at < length
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    texts = defaultdict(list)
    for k, t in rows:
        texts[k].append([*ids_of(tok, t), 1])
    assert set(by) == set(texts)
    for k, own in by.items():
        assert sum(n for _, _, n, _ in own) == sum(map(len, texts[k]))
        for size, start, n, c in own:
            assert any(len(x) == size and crc(x[start : start + n]) == c for x in texts[k])
        if len(texts[k]) == 1:
            starts = sorted((start, n) for _, start, n, _ in own)
            assert [s for s, _ in starts] == [0, *np.cumsum([n for _, n in starts])[:-1].tolist()]


def test_packing(docs, rows, tok, empty):
    check_packing(packing.pack(docs, JSON, 64).collect(), rows, tok, 64)
    assert packing.pack(empty, JSON).count() == 0


def test_byte_level_bpe(docs, rows, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((k, len(i := enc.encode_ordinary(t)), sha(np.array(i, "<u4").tobytes()), sha(t.encode())) for k, t in rows)
    assert got(sp_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert sp_bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, docs, rows, tok, empty, tmp_path):
    token_files.write_token_files(docs, str(tmp_path / "t"), JSON)
    read = sorted(token_files.read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in read] == sorted((k for k, _ in rows), key=lambda k: -1 if k is None else k)
    at = 0
    for r in read:
        assert r["start"] == at
        at += r["n_tokens"]
    want = Counter((k, len(i := ids_of(tok, t) + [2]), zlib.crc32(np.array(i, "<u4").tobytes())) for k, t in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read) == want
    token_files.write_token_files(empty, str(tmp_path / "e"), JSON)
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_blocks_of_any_ids():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 5, 1024, 1025, 5000):
        for high in (1, 2, 300, 60_000, 1 << 32):
            ids = rnd.integers(0, high, n, dtype=np.uint64).astype("<u4")
            if n:
                ids[rnd.integers(0, n)] = (1 << 32) - 1
            image = token_files.Image(token_files.encode_image([1, None], [n // 2, n - n // 2], ids, 0))
            assert (image.ids() == ids).all() and image.keys == [1, None]
            a, b = sorted(rnd.integers(0, n + 1, 2).tolist())
            assert (image.ids(a, b) == ids[a:b]).all()


def test_base_statistics(docs, rows):
    want = Counter()
    for k, t in rows:
        w = t.encode().split()
        tri = list(zip(w, w[1:], w[2:]))
        n = Counter(tri)
        cover = {j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want[k, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)] += 1
    assert got(quality.base_statistics(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want


def feature_rows(out, rows):
    """The transformed statistics of the rows that pass the base rules, recomputed from the texts."""
    x = {}
    for i, text, *_ in rows:
        if not out[i]["base_failed"]:
            w, lines = text.split(), [t for t in text.split("\n") if t.split()]
            share = lambda a, b: np.log(1 + 100 * a / b)
            v = [np.log(1 + sum(map(len, w)) / len(w)), share(sum(c in "#*$%&|<>" for c in text), len(w)), share(len(lines) - len(set(lines)), len(lines)), share(out[i]["n_repeat_words"], len(w))]
            x[i] = np.round(1000 * np.array(v))
    return x


def regularised_mcd(x, tries=60):
    """Least determinant by exact concentration steps from random starts."""
    rnd, tol, h = np.random.default_rng(4), np.diag(np.square(np.array(quality.TOLERANCE, float))), int(np.ceil(quality.SHARE * len(x)))
    best = np.inf
    for _ in range(tries):
        own = rnd.choice(len(x), min(len(x), 6), replace=False)
        last = np.inf
        while True:
            mu, cov = x[own].mean(axis=0), quality.CONSISTENCY * np.cov(x[own].T, bias=True) + tol
            det = np.linalg.det(cov) if len(own) == h else np.inf
            if det >= last * (1 - 1e-9) and len(own) == h:
                break
            last = det
            own = np.argsort(np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu), kind="stable")[:h]
        best = min(best, last)
    return best


def test_quality_against_numpy(spark, empty):
    rnd = random.Random(2)
    rows = []
    for i in range(400):
        lang, source = ("en", "a") if i % 3 else ("en", f"b{i % 9}") if i % 2 else (None, None) if i % 4 else ("de", f"c{i}")
        words = [rnd.choice("abcdefgh") * rnd.randrange(2, 8) + str(rnd.randrange(500)) for _ in range(rnd.randrange(55, 150))]
        if i % 20 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words) + "\n" + "\n".join(rnd.choice(["x", "y", "zz"]) for _ in range(rnd.randrange(1, 6))), lang, source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in quality.judge_quality(df).collect()}
    x = feature_rows(out, rows)
    groups = {"all": list(x)}
    for i, _, lang, source in rows:
        if i in x:
            groups.setdefault(lang, []).append(i)
            groups.setdefault((lang, source), []).append(i)
    number = {g: k for k, g in enumerate(groups)}
    table = [([number[g] for g, own in groups.items() if i in own], *map(int, v)) for i, v in x.items()]
    found = {r["grp"]: r for r in quality.least_determinants(spark.createDataFrame(table, "grps array<long>, " + ", ".join(f"{c} long" for c in quality.FEATURES)), len(groups)).collect()}
    for g, own in groups.items():
        if len(own) >= 8:  # the subset's 75 % is a whole number of rows there, or nearly
            assert found[number[g]]["det"] <= 1.05 * regularised_mcd(np.array([x[i] for i in own]))
    mean = lambda e: np.array([e[f"mu{i}"] for i in range(4)])
    cov = lambda e: np.array([[e[f"s{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])

    def blend(n, own, above):
        a, d = n / (n + quality.PRIOR), own[0] - above[0]
        return a * own[0] + (1 - a) * above[0], a * own[1] + (1 - a) * above[1] + a * a * (1 - a) * np.outer(d, d)

    estimate = {g: (mean(found[k]), cov(found[k])) for g, k in number.items()}
    for i, _, lang, source in rows:
        if i not in x:
            assert not out[i]["kept"] and out[i]["distance"] is None
            continue
        mu, s = blend(len(groups[lang, source]), estimate[lang, source], blend(len(groups[lang]), estimate[lang], estimate["all"]))
        d = (x[i] - mu) @ np.linalg.inv(s) @ (x[i] - mu)
        assert abs(out[i]["distance"] - d) < 1e-6 * max(1, d)
        assert out[i]["kept"] == (d <= quality.CUTOFF)
    assert {i for i in out if not out[i]["kept"]} >= {i for i in range(0, 400, 20)}
    assert sum(not r["kept"] for r in out.values()) <= 24
    assert quality.judge_quality(empty).count() == 0 and quality.keep_quality(empty).count() == 0


def test_small_groups_are_judged(spark):
    """A text is judged alike whether its source has one row or many."""
    rnd = random.Random(6)
    text = lambda mark: " ".join(rnd.choice("abcdefgh") * rnd.randrange(2, 8) + str(rnd.randrange(500)) + mark for _ in range(90))
    rows = [(i, text(""), "en", "big") for i in range(60)] + [(100, text("###"), "en", "lone"), (101, text("###"), "fr", "lone"), (102, text(""), "en", "one"), (103, text(""), None, None)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i in kept if not kept[i]] == [100, 101]
    alone = spark.createDataFrame(rows[:3], "doc_id long, text string, lang string, source string")
    assert all(r["kept"] for r in quality.judge_quality(alone).collect())


def brute_words(rows, n):
    order = lambda k: float("inf") if k is None else k
    first = {}
    for k, t in rows:
        w = t.encode().split()
        for i in range(len(w) - n + 1):
            x = tuple(w[i : i + n])
            first[x] = min(first.get(x, float("inf")), order(k))
    want = Counter()
    for k, t in rows:
        w = t.encode().split()
        gone = {j for i in range(len(w) - n + 1) if first[tuple(w[i : i + n])] < order(k) for j in range(i, i + n)}
        want[k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()] += 1
    return want


def test_substring_dedup(docs, rows, empty):
    assert got(substring_dedup.remove_repeated_words(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_words(rows, 13)
    assert substring_dedup.remove_repeated_words(empty).count() == 0
    cut = substring_dedup.drop_repeated_words(docs)
    assert cut.columns == docs.columns
    left = Counter((r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in cut.collect())
    assert left == Counter({(k, s): n for (k, _, _, s), n in brute_words(rows, 13).items()})


def test_fm_index():
    rnd = random.Random(11)
    seq = [0, *(rnd.choice([0, 1, 2, 3, 9]) for _ in range(698)), 0]
    index = substring_dedup.FMIndex(np.array(seq), 13)
    for _ in range(300):
        at, n = rnd.randrange(690), rnd.randrange(1, 10)
        pattern = seq[at : at + n]
        if 0 not in pattern:
            assert index.count(pattern) == sum(seq[i : i + n] == pattern for i in range(700 - n + 1))
    assert index.count([4]) == index.count([77]) == 0


def test_suffix_dedup(docs, rows, empty):
    n, counts, want = 200, Counter(), Counter()
    for _, t in rows:
        b = t.encode()
        counts.update(b[i : i + n] for i in range(len(b) - n + 1))
    for k, t in rows:
        b = t.encode()
        gone = {j for i in range(len(b) - n + 1) if counts[b[i : i + n]] > 1 for j in range(i, i + n)}
        spans = sum(j - 1 not in gone for j in gone)
        want[k, len(b), len(gone), spans, hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()] += 1
    assert got(suffix_dedup.remove_repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


def test_exact_dedup(docs, rows, empty):
    import re

    norm = [(k, re.sub(r"[\x20\x09-\x0D]+", " ", t)) for k, t in rows]
    by = defaultdict(list)
    for k, t in norm:
        by[t].append(k)
    low = {t: min((k for k in ks if k is not None), default=None) for t, ks in by.items()}
    want = Counter((k, low[t], len(by[t]), hashlib.sha256(t.encode()).hexdigest()) for k, t in norm)
    for budget in (96 << 20, 2000):
        df = exact_dedup.exact_duplicates(docs, budget=budget)
        assert got(df, "doc_id", "keep_id", "group_size", "text_sha256") == want
        assert Counter(r["text_sha256"] for r in df.where("kept").collect()) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in by})
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_grace_recursion(tmp_path):
    texts = [f"text {i % 300}".encode() for i in range(2000)]
    records = [(hashlib.sha256(t).digest(), i, 1, t) for i, t in enumerate(texts)]
    out = list(exact_dedup.grace(records, str(tmp_path), budget=3000))
    assert {e[3]: (e[1], e[2]) for e in out} == {t: (texts.index(t), texts.count(t)) for t in set(texts)}
    assert not list(tmp_path.iterdir())


def test_large_cells_lose_no_link():
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = list({b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(0, 4))) for b in base for _ in range(25)})
    rnd.shuffle(fps)
    fp, home = np.array(fps, np.uint64), np.array([rnd.random() < 0.6 for _ in fps])

    def parts(edges):
        label = list(range(len(fps)))
        for a, b in edges:
            label = [label[a] if x == label[b] else x for x in label]
        return Counter(frozenset(i for i, x in enumerate(label) if x == y) for y in set(label))

    want = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3 and (home[i] or home[j])]
    for small in (0, 24):
        a, b = simhash.link_large_cell(fp, home, 3, small)
        assert all((fps[i] ^ fps[j]).bit_count() <= 3 for i, j in zip(a, b))
        assert parts(zip(a.tolist(), b.tolist())) == parts(want)


def test_pipeline(spark, sf, tok):
    import corpus_pipeline as p
    from test_near import brute

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    verdict = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs).collect()}
    stages = []
    for _, stage in p.STAGES[:-1]:
        docs = p.materialize(stage(spark, docs, sf), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        stages.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert stages[0] == {k: t for k, t in start.items() if verdict[k]}
    low = {}
    for k, t in stages[0].items():
        low.setdefault(" ".join(t.split()), []).append(k)
    assert set(stages[1]) == {min(v) for v in low.values()}
    assert stages[2] == dict(brute(list(stages[1].items())))
    words = Counter({(k, s): n for (k, w, g, s), n in brute_words(list(stages[2].items()), 13).items() if w > g})
    assert Counter((k, hashlib.sha256(b" ".join(t.encode().split())).hexdigest()) for k, t in stages[3].items()) == words
    check_packing(p.run(spark, sf).collect(), list(stages[3].items()), tok, 2048)
