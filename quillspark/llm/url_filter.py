"""URL filters: pattern rules indexed by their rarest literal token.

Every rule has literal tokens that any URL it fits must contain whole. The rule is filed under the one of them that fewest URLs
of the table hold (counted over all of them), so common tokens fetch few rules. A URL's tokens fetch its
candidates, and only those run their regular expressions. DataFrame functions only.

Up to INLINE_RULES rules the index is a constant array of hash buckets inside the expression: a URL is judged in its row
without join or shuffle. Longer lists are joined: distinct URLs, their tokens exploded, against the index by token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame, functions as F

INLINE_RULES = 2_000
#: Larger indexes than this (about 100 bytes a rule) are never broadcast.
BROADCAST_RULES = 100_000
_TOKEN = re.compile(r"[A-Za-z0-9]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A regular expression on host + path + query (Java and RE2 syntax in common), the tokens it needs, and its rank: higher wins."""

    action: str
    pattern: str
    literals: tuple[str, ...]
    name: str | None = None
    rank: tuple[int, int] = (0, 0)
    token: str = field(default="", compare=False)


def prefix_rule(action: str, host: str, path: str) -> Rule:
    """Fits host and its subdomains where the path starts with path; longer rules win, of equals the longer host."""
    whole = host + path
    found = [(m[0], m.end()) for m in _TOKEN.finditer(whole)]
    literals = tuple(t for t, end in found if end < len(whole))  # the last may go on in a URL
    return Rule(action, rf"^(?:[^/?]*\.)?{re.escape(host)}{re.escape(path)}", literals, whole, (len(whole), len(host)))


def word_rule(action: str, word: str) -> Rule:
    """Fits wherever word is a token; like the rules below, it ranks below every named rule."""
    return Rule(action, rf"(?:^|[^A-Za-z0-9]){re.escape(word)}(?:[^A-Za-z0-9]|$)", (word,))


def label_rule(action: str, word: str) -> Rule:
    """Fits where a label of the host but the last is word."""
    return Rule(action, rf"^(?:[^/?]*\.)?{re.escape(word)}\.", (word,))


def segment_rule(action: str, word: str) -> Rule:
    """Fits where a segment of the path is word or begins with it."""
    return Rule(action, rf"/{re.escape(word)}(?:[/?._-]|$)", (word,))


def parameter_rule(action: str, word: str) -> Rule:
    """Fits where a parameter of the query is called word."""
    return Rule(action, rf"[?&]{re.escape(word)}=", (word,))


def pair_rules(action: str, first: str, second: str) -> list[Rule]:
    """Fit two words in this order, with a hyphen or underscore between them or none."""
    edge = lambda x: rf"(?:^|[^A-Za-z0-9]){x}(?:[^A-Za-z0-9]|$)"
    a, b = re.escape(first), re.escape(second)
    return [Rule(action, edge(f"{a}[-_]{b}"), (first, second)), Rule(action, edge(a + b), (first + second,))]


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and query with its question mark; all empty without "://" or for null."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(place, F.lit(r"([A-Za-z0-9]+)"), 1))


def index_rules(rules: list[Rule], places: DataFrame) -> list[Rule]:
    """The rules with the token that each is filed under; places has a column `place`, host + path + query of every URL.

    Counts only the rules' own tokens, summed per task before the shuffle; as many rows as rules have tokens come back.
    """
    wanted = sorted({t for r in rules for t in r.literals})
    spark = places.sparkSession
    vocabulary = spark.createDataFrame([(t,) for t in wanted], "token string")
    if len(wanted) <= BROADCAST_RULES:
        vocabulary = F.broadcast(vocabulary)
    counts = places.select(F.explode(_tokens(F.col("place"))).alias("token")).join(vocabulary, "token", "left_semi").groupBy("token").count()
    df = {r["token"]: r["count"] for r in counts.collect()} if wanted else {}
    best = lambda r: min(r.literals, key=lambda t: (df.get(t, 0), -len(t), t), default="")
    return [Rule(r.action, r.pattern, r.literals, r.name, r.rank, best(r)) for r in rules]


def _struct(r: Rule) -> Column:
    return F.struct(F.lit(r.token).alias("token"), F.lit(r.rank[0]).alias("rank"), F.lit(r.rank[1]).alias("host_rank"), F.lit(r.action).alias("action"), F.lit(r.name).cast("string").alias("name"), F.lit(r.pattern).alias("pattern"))


def _order(x: Column) -> Column:
    """What the best fitting rule is the greatest by: rank, then "block" before "allow"."""
    return F.struct(x["rank"].alias("rank"), x["host_rank"].alias("host_rank"), x["action"].alias("action"), x["name"].alias("name"))


def _inline(places: DataFrame, rules: list[Rule]) -> DataFrame:
    n = 1 << max(4, len(rules).bit_length() + 1)
    buckets: list[list[Rule]] = [[] for _ in range(n)]
    for r in rules:
        if r.token:
            buckets[xxhash.xxh64_intdigest(r.token.encode(), 42) % n].append(r)
    none = F.filter(F.array(_struct(Rule("", "", ()))), lambda x: F.lit(False))
    table = F.array(*[F.array(*map(_struct, b)) if b else none for b in buckets])
    fetched = F.flatten(
        F.transform(_tokens(F.col("place")), lambda t: F.filter(F.element_at(table, (F.xxhash64(t).bitwiseAND(F.lit(n - 1)) + 1).cast("int")), lambda r: r["token"] == t))
    )
    return places.withColumn("best", F.array_max(F.transform(_fitting(fetched), _order)))


def _fitting(candidates: Column) -> Column:
    return F.filter(candidates, lambda r: F.rlike(F.col("place"), r["pattern"]))


def _joined(places: DataFrame, rules: list[Rule]) -> DataFrame:
    spark = places.sparkSession
    index = spark.createDataFrame([(r.token, r.rank[0], r.rank[1], r.action, r.name, r.pattern) for r in rules if r.token], "token string, rank int, host_rank int, action string, name string, pattern string")
    if len(rules) <= BROADCAST_RULES:
        index = F.broadcast(index)
    asked = places.select("place").distinct().select("place", F.explode(_tokens(F.col("place"))).alias("token"))
    fits = asked.join(index, "token").where(F.rlike(F.col("place"), F.col("pattern")))
    best = fits.groupBy("place").agg(F.max(F.struct("rank", "host_rank", "action", "name")).alias("best"))
    return places.join(best, "place", "left")


def _with_tokenless(places: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rules without a token, which no index holds, are run on every URL in its row."""
    always = [_struct(r) for r in rules if not r.token]
    if not always:
        return places
    own = F.array_max(F.transform(_fitting(F.array(*always)), _order))
    return places.withColumn("best", F.when(F.col("best").isNull() | (own > F.col("best")), own).otherwise(F.col("best")))


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """pages' columns and host, path, rule, verdict: the action of the best rule that fits, else default.

    rule is the name of that rule; null when none fits or the rule has none (word rules). A null URL, or one without "://", has
    an empty host and path, which no prefix rule fits. Rows are neither merged nor dropped; pages' own columns host, path,
    rule or verdict are replaced.
    """
    host, path, query = split_url(F.col(url))
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    placed = pages.select(F.struct(*own).alias("row"), host.alias("host"), path.alias("path"), query.alias("query")).withColumn("place", F.concat("host", "path", "query")).drop("query")
    filed = index_rules(rules, placed.select("place"))
    best = _with_tokenless((_inline if len(rules) <= inline else _joined)(placed, filed), filed)
    return best.select("row.*", "host", "path", F.col("best")["name"].alias("rule"), F.coalesce(F.col("best")["action"], F.lit(default)).alias("verdict"))
