"""The driver's tables as books: a source is a book, a document a chapter, a line that is not blank a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.functions import text as T

HEADING_CHARS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(docs: DataFrame) -> DataFrame:
    """``book, chapter, title, block, anchor, kind, level, dedup, text, tokens``.

    Block numbers come from each document's own array of lines, so nothing is shuffled. A first line of 60
    characters at most is the chapter's title and its heading of level 1; other such lines are of level 2.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), T.collapse), lambda x: x != "")
    rows = docs.where("text IS NOT NULL").select(F.col("source").alias("book"), F.col("doc_id").alias("chapter"), lines.alias("lines"))
    rows = rows.select("book", "chapter", F.substring(F.get("lines", F.lit(0)), 1, HEADING_CHARS).alias("title"), F.posexplode("lines").alias("block", "text"))
    short = F.length("text") <= HEADING_CHARS
    return rows.select(
        "book", "chapter", "title", F.col("block").cast("long").alias("block"), T.anchor(F.col("chapter"), F.col("block")).alias("anchor"),
        F.when(short, "heading").otherwise("para").alias("kind"), F.when(short, F.when(F.col("block") == 0, 1).otherwise(2)).otherwise(0).cast("long").alias("level"),
        (short & (F.col("block") == 0)).alias("dedup"), "text", T.count_tokens(F.col("text")).alias("tokens"),
    )


#: The same relation for the SQL oracles.
BLOCKS_SQL = r"""lines AS (
  SELECT source AS book, doc_id AS chapter, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\n\f\v\x{00a0}\x{3000}]+', ' ', 'g'))), lambda x: x <> '') AS ls
  FROM documents WHERE text IS NOT NULL
), exploded AS (
  SELECT book, chapter, substr(ls[1], 1, 60) AS title, unnest(ls) AS text, CAST(generate_subscripts(ls, 1) - 1 AS BIGINT) AS block FROM lines
), blocks AS (
  SELECT book, chapter, title, block, 'c' || chapter || 'p' || block AS anchor, CASE WHEN length(text) <= 60 THEN 'heading' ELSE 'para' END AS kind,
    CAST(CASE WHEN length(text) > 60 THEN 0 WHEN block = 0 THEN 1 ELSE 2 END AS BIGINT) AS level, length(text) <= 60 AND block = 0 AS dedup, text,
    CAST(greatest(1, floor(length(text) - length(regexp_replace(text, '[\x{1100}-\x{11ff}\x{2e80}-\x{2eff}\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3130}-\x{318f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]', '', 'g'))
      + length(regexp_replace(text, '[\x{1100}-\x{11ff}\x{2e80}-\x{2eff}\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3130}-\x{318f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{ff00}-\x{ffef}]', '', 'g')) / 4.0 + 0.5)) AS BIGINT) AS tokens
  FROM exploded
)"""
