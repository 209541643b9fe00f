"""One query per operator over its whole table, and its expected result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat,
    conversation_repair,
    exact_dedup,
    filter_audit,
    language,
    main_text,
    mixing,
    perplexity,
    pieces,
    quality_classifier,
    simhash,
    url_filter,
    warc,
)
from .common import read


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.sql(
        "SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text"
        " FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"
    )
    return chat.read_back(chat.prefix_targets(rows.unionByName(planted)))


def op2_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality(read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def model_path() -> str:
    """The vocabulary file, where the tokenizers are installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_digests(read(spark, sf_dir, "documents"), model_path())


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read(spark, sf_dir, "pages"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.reported(pages), url_filter.RULES).drop("possible")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_and_repaired(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_prefix_targets,
        op2_perplexity_rules,
        op3_quality_classifier,
        op4_language_id,
        op5_sentencepiece,
        op6_simhash_near_dedup,
        op7_warc,
        op8_main_text,
        op9_mix_sources,
        op10_exact_dedup,
        op11_url_filter,
        op12_filter_audit,
        op13_conversation_repair,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_prefix_targets": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>'))
          + length(replace(replace(replace(replace(text, '\', '\\'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>'))
          + length('[INST] ' || ' [/INST] ' || '</s>') AS piece
  FROM t
), w AS (
  SELECT *, sum(piece) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS so_far,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id""",
    "op7_warc": r"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op10_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op11_url_filter": r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT r, page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|ref)(=|$)'))) AS asked
  FROM p
), c AS (
  SELECT *, CASE WHEN host <> '' THEN
           regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') || rtrim(path, '/')
           || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical
  FROM h
), listed AS (
  SELECT DISTINCT canonical FROM c
  WHERE list_has_any(string_split(host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm'])
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT r, rhost || rpath AS rule, verdict,
         row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS place
  FROM c, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fit ON fit.r = c.r AND place = 1 LEFT JOIN listed ON listed.canonical = c.canonical""",
    "op12_filter_audit": r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t
), f AS (
  SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, first IS NOT NULL AND coalesce(doc_id > first, TRUE) AS e
  FROM w
), known AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS failed,
         coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, count(*) AS n
  FROM f LEFT JOIN known USING (doc_id) GROUP BY ALL
), l(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT p1.letter || p2.letter || p3.letter || p4.letter || p5.letter AS filter_order, [p1.bit, p2.bit, p3.bit, p4.bit, p5.bit] AS bits
  FROM l p1, l p2, l p3, l p4, l p5 WHERE p1.bit | p2.bit | p3.bit | p4.bit | p5.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
  FROM o, (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)
), x AS (
  SELECT part, filter_order, step, bit,
         CAST(coalesce(sum(n) FILTER (failed & bit = 0 AND failed & before = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & before = 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & before <> 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (failed = bit), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & before = 0 AND good), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n) FILTER (failed & bit <> 0 AND failed & before = 0 AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM cells, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM x""",
}
