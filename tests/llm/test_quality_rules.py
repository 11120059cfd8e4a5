"""What the outlier test of the quality rules rejects."""

import random

from quillspark.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rnd, n=100):
    return [rnd.choice("abcdefgh") * rnd.randrange(2, 8) + str(rnd.randrange(10**5, 10**6)) for _ in range(n)]


def lined(words):
    return "\n".join(" ".join(words[i : i + 5]) for i in range(0, len(words), 5))


def test_each_statistic_rejects_alone(spark):
    rnd = random.Random(4)
    rows = [(i, lined(plain(rnd)), "en", "a") for i in range(120)]
    long = lined([w + "x" * 25 for w in plain(rnd)])
    symbols = lined(["#" + w[1:] for w in plain(rnd)])
    lines = "\nand\n".join(lined(plain(rnd)).split("\n"))  # half of the lines, but no three words twice
    words = plain(rnd, 80)
    repeats = lined(words[:20] + words[20:41] + words[:20] + words[41:])  # 40 % of the words, but no line twice
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate([long, symbols, lines, repeats])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r for r in quality.judge_quality(df).collect()}
    faults = {i: (r["n_symbols"] > 0, r["n_dup_lines"] > 0, r["n_repeat_words"] > 0) for i, r in out.items() if i >= 1000}
    assert faults == {1000: (False, False, False), 1001: (True, False, False), 1002: (False, True, False), 1003: (False, False, True)}
    assert not any(r["base_failed"] for r in out.values())
    assert {i for i, r in out.items() if not r["kept"]} == {1000, 1001, 1002, 1003}
