"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackscan.llm import arrow_ids, blob_ledger, byte_bpe, exact_dedup, html_extract, language_id, ngram_join, packing, quality_rules, sharding, substring_dedup, token_anchors, turn_repair
from stackscan.llm.common import table

MEASURES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    trusted = quality_rules.trusted_ids(table(spark, sf, "labels"))
    return quality_rules.quality_rules(table(spark, sf, "documents"), trusted, sound=True).select(*MEASURES)


def op2_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf, "documents"))


def op3_byte_cnn(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    network = language_id.fit(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"))
    found = language_id.identify(docs, network)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_html_crf(spark: SparkSession, sf: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf, "pages"), html_extract.fit())
    return found.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf, "documents"))


def op6_stratified_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = sharding.stratified_shards(sharding.sized(table(spark, sf, "documents")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned text of every document and the passages removed from it."""
    found = substring_dedup.substring_dedup(table(spark, sf, "documents"), edges=True)
    return found.select("row.doc_id", "text", "removed", "n_removed")


def op8_vector_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("loss_tokens")


def op9_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(table(spark, sf, "documents"), path, public_tokenizers.PATTERN)


def op10_arrow_ids(spark: SparkSession, sf: str) -> DataFrame:
    return arrow_ids.encode_to_files(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_blob_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return blob_ledger.secret_spans(table(spark, sf, "documents"))


def op12_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    return turn_repair.repaired_after_damage(table(spark, sf, "conversations"))


def op13_token_anchors(spark: SparkSession, sf: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_anchors.token_anchors(table(spark, sf, "documents"), *paths)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_ngram_join, op3_byte_cnn, op4_html_crf, op5_exact_dedup, op6_stratified_shards, op7_substring_dedup, op8_vector_packing, op9_byte_bpe, op10_arrow_ids,
                                  op11_blob_ledger, op12_turn_repair, op13_token_anchors)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _spans_sql() -> str:
    """Every rule's findings as rows (n, k, kind, start, end); letters in either case are spelled out."""
    parts = []
    for k, rule in enumerate(blob_ledger.RULES):
        pattern = rule.pattern
        if (words := re.match(r"\(\?i:([^)]*)\)", pattern)):
            either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words[1])
            pattern = f"(?:{either})" + pattern[words.end():]
        pattern = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
          SELECT n, {k} AS k, '{rule.kind}' AS kind, s.start AS start, s.start + s.size AS stop FROM (
            SELECT n, unnest(list_filter(list_transform(range(1, len(w) + 1), lambda i: {{
                'start': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0),
                'size': length(w[i]), 'part': length(g[i])}}), lambda m: m.part >= {rule.least})) AS s
            FROM (SELECT n, string_split_regex(x, {pattern}) AS p, regexp_extract_all(x, {pattern}) AS w, regexp_extract_all(x, {pattern}, {rule.group}) AS g
                  FROM t WHERE regexp_matches(x, {pattern})))""")
    return " UNION ALL ".join(parts)


ORACLES = {
    "op11_blob_ledger": f"""
        WITH t AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS x FROM documents),
        found AS ({_spans_sql()}),
        lists AS (
          SELECT n, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < 3) AS base,
                 string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM found GROUP BY n)
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN lists ON t.n = lists.n""",
    "op2_ngram_join": f"""
        WITH RECURSIVE words AS (
          SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        grams AS (
          SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 75 * (s.n + t.n - c)),
        edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other)
        SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
        FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
}
