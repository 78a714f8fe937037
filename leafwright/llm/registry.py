"""Queries of the training-data operators over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests

    own = spark.sql("SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'")
    return digests(table(spark, sf_dir, "conversations").select(*own.columns).unionByName(own))


OP1_SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, CAST(ceil(length(coalesce(text, '')) / 3.0) AS BIGINT) + 4 AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS idx
  FROM raw
), summed AS (
  SELECT *, role = 'system' AND idx = 0 AS sys, CAST(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    20 + length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g'))
       + length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')) AS chars
  FROM numbered
), placed AS (
  SELECT *, CASE WHEN tokens > 768 THEN 2 * before + 1 ELSE 2 * (before - before % 768) END AS span FROM summed
), starts AS (
  SELECT conv_id, span, min(idx) AS first, min(before) AS begin_at FROM placed GROUP BY ALL
), parts AS (
  SELECT conv_id, span, chars FROM placed
  UNION ALL SELECT p.conv_id, s.span, p.chars FROM placed p JOIN starts s ON p.conv_id = s.conv_id AND p.idx < s.first AND p.idx >= s.first - 4 WHERE NOT p.sys AND s.begin_at - p.before <= 256
  UNION ALL SELECT p.conv_id, s.span, p.chars FROM placed p JOIN starts s ON p.conv_id = s.conv_id AND p.idx < s.first WHERE p.sys
), sizes AS (
  SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars, count(DISTINCT span) AS n_windows FROM parts GROUP BY conv_id
)
SELECT p.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars, any_value(n_windows) AS n_windows
FROM placed p JOIN sizes USING (conv_id) GROUP BY p.conv_id
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "ratio")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False).drop("text")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op9_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming_index import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("pmod(vec_id, 20) = 0"), k=20)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_tree_lm import score

    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline} | {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {"op1_chat_format": OP1_SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {k: v for k, v in own.items() if v}
