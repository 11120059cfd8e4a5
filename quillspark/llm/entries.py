"""The queries of this subpackage and, where SQL can state them, their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.exact_dedup import exact_duplicates
from quillspark.llm.packing import pack
from quillspark.llm.quality import judge_quality
from quillspark.llm.simhash import near_duplicates
from quillspark.llm.sp_bpe import round_trip
from quillspark.llm.substring_dedup import remove_repeated_words
from quillspark.llm.suffix_dedup import remove_repeated_bytes
from quillspark.llm.token_counts import count_tokens
from quillspark.llm.token_files import read_token_files, write_token_files
from quillspark.llm.url_filter import Rule, judge_urls, label_rule, pair_rules, parameter_rule, prefix_rule, segment_rule
from quillspark.workspace import scratch

#: The contract's rules: action, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Words that block a URL which no rule above fits, as a label of its host, a segment of its path or a parameter of its query;
#: and words that do so together with one of them.
URL_WORDS = (
    "adult bets betting bingo blackjack bookmaker camgirl camgirls cams casino casinos cialis crack cracked dating escort escorts fetish gambling "
    "hentai hookup jackpot keygen kinky levitra lottery milf nude nudes nsfw payday penis phentermine pills poker porn porno pornhub replica replicas "
    "roulette serial sex sexcam sexy shemale slots sportsbook steroids tramadol viagra voyeur warez webcam webcams xanax xxx"
).split()
URL_MODIFIERS = "amateur best bonus buy cheap cheapest club deals discount download erotic free hot live nude online real sale teen top wild win".split()


def url_rules() -> list[Rule]:
    """The contract's rules, and those made of the words: some 2,600."""
    rules = [prefix_rule(*r) for r in URL_RULES]
    for w in URL_WORDS:
        rules += [label_rule("block", w), segment_rule("block", w), parameter_rule("block", w)]
        for m in URL_MODIFIERS:
            rules += pair_rules("block", m, w)
    return rules


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_docs(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_docs(spark, sf_dir, "pages").select("page_id", "url"), url_rules()).select("page_id", "host", "path", "rule", "verdict")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), 2048, 1)


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(_docs(spark, sf_dir), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_token_files(_docs(spark, sf_dir), path, tokenizer_file("byte_bpe_50k.json"), 2)
    return read_token_files(spark, path)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(_docs(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(_docs(spark, sf_dir))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_docs(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_url_filters, op3_simhash, op4_packing, op5_byte_level_bpe, op6_token_files, op7_quality_rules, op8_substring_dedup, op9_suffix_array_dedup, op10_exact_dedup)}

_ANY, _MODIFIER = f"({'|'.join(URL_WORDS)})", f"({'|'.join(URL_MODIFIERS)})"
_BLOCKED = rf"^([^/?]*\.)?{_ANY}\.|/{_ANY}([/?._-]|$)|[?&]{_ANY}=|(^|[^A-Za-z0-9]){_MODIFIER}[-_]?{_ANY}([^A-Za-z0-9]|$)"
_RULE_VALUES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in URL_RULES)
ORACLE_SQL = {
    "op2_url_filters": f"""
WITH rules(action, rhost, rpath) AS (VALUES {_RULE_VALUES}),
cut AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*([?][^#]*)', 1) AS query FROM cut),
fits AS (
  SELECT k, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, arg_max(action, length(rhost || rpath) * 1000 + length(rhost)) AS action
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN regexp_matches(host || path || query, '{_BLOCKED}') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN fits USING (k)""",
    "op10_exact_dedup": r"""
WITH norm AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM norm""",
}
