"""The queries of this subpackage, one for each operator, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webextract.llm import chat, decontaminate, html_main, katz, mixing, paragraph_dedup, quality_classifier, quality_rules, simhash, token_output
from webextract.llm.common import Workspace

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    extra = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "element_at(array('user', 'assistant'), int(id) + 1) AS role").crossJoin(
        spark.range(1).selectExpr(f"r'{text}' AS text")
    )
    return chat.digests(chat.format_chats(rows.unionByName(extra)))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(_table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_token_output(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    out = Workspace(spark).path
    token_output.write_ids(_table(spark, sf_dir, "documents"), out, public_tokenizers.path(tokenizer), public_tokenizers.PATTERN, added=True)
    return token_output.read_ids(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_chat_formatting,
            op2_simhash_near_dedup,
            op3_html_extraction,
            op4_lm_scoring,
            op5_decontamination,
            op6_quality_rules,
            op7_substring_dedup,
            op8_source_mixing,
            op9_quality_classifier,
            op10_token_output,
        )
    }


CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *,
    replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '</role>', '<\/role>'), '</turn>', '<\/turn>') AS er,
    replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '</role>', '<\/role>'), '</turn>', '<\/turn>') AS et
  FROM rows
), moves AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM escaped
), judged AS (
  SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user')
    ELSE (before, role) IN (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) END AS good
  FROM moves
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(6 + length(er) + 7 + length(et) + 7) AS BIGINT) AS formatted_chars,
  bool_and(good) AND coalesce(bool_or(role IN ('user', 'assistant')) FILTER (back = 1), false) AS valid,
  CAST(min(place) FILTER (NOT good) AS INTEGER) AS error_turn
FROM judged GROUP BY conv_id
"""


#: The articles of the test pages hold headings and paragraphs only, so rules on their tags give the same text.
PAGES_SQL = r"""
WITH cut AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1),
    '</?(p|h1)>', chr(1), 'g'), '<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS body FROM pages
), plain AS (
  SELECT page_id, url, replace(replace(replace(replace(replace(replace(body, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS body FROM cut
), blocks AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(body, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM plain
)
SELECT page_id, url, text, length(text) AS n_chars FROM blocks
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": CHAT_SQL, "op3_html_extraction": PAGES_SQL}
