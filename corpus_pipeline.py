"""A training-data pipeline over ``documents``: toxicity, near copies, repeated passages, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read as
the next one's ``docs``. All but the last return the columns of ``documents``; extra columns are not passed on.
Before each stage the executors give back the memory that the stages before left in use.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwright.llm import decontaminate, exchange, ngram_jaccard, packing, registry, suffix_dedup, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rested(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        exchange.rest(spark)
        return stage(spark, docs, sf_dir)

    return run


@_rested
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go; null and empty texts stay unless the labels call empty texts toxic."""
    return toxicity.score(docs, registry.table(spark, sf_dir, "labels")).where("predicted = 0").select(*COLUMNS)


def _keyed(docs: DataFrame, text_key: Column) -> DataFrame:
    """Adds columns without nulls that tell (doc_id, text) apart, so that a join and a window on them share one shuffle."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_nul": F.col("doc_id").isNull(), "_key": text_key})


_KEYS = ["_id", "_nul", "_key"]


@_rested
def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays (ties: by a hash of the text; a null id is last).

    Rows equal in id and text are copies too. Texts without words have no copies and all stay. No rows give no rows.
    """
    classes = exchange.settle(ngram_jaccard.jaccard_classes(docs))
    pick = classes.where("class_id <> 0").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")).alias("pick")).select("pick.doc_id", "pick.text_key", F.lit(False).alias("empty"))
    pick = pick.unionByName(classes.where("class_id = 0").select("doc_id", "text_key", F.lit(True).alias("empty")).distinct())
    pick = _keyed(pick, F.col("text_key")).select(*_KEYS, "empty")
    rows = _keyed(docs.select(*COLUMNS), F.xxhash64(F.col("text").cast("string"))).join(pick, _KEYS)
    nth = F.row_number().over(Window.partitionBy(*_KEYS).orderBy(F.lit(0)))
    return rows.withColumn("_n", nth).where("_n = 1 OR empty").select(*COLUMNS)


@_rested
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of strings of 50 bytes are cut out of the texts; ``n_chars`` is counted again. Every row stays, a null text as an empty one."""
    cut = suffix_dedup.suffix_dedup(docs.select(*COLUMNS))
    return cut.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*COLUMNS)


@_rested
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    found = decontaminate.leaks(docs, registry.table(spark, sf_dir, "benchmark")).select("doc_id", "text_key").distinct()
    rows = _keyed(docs.select(*COLUMNS), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return rows.join(_keyed(found, F.col("text_key")).select(*_KEYS), _KEYS, "left_anti").select(*COLUMNS)


@_rested
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    return packing.pack(docs, registry.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_copies", keep_one_copy), ("repeats", cut_repeats), ("leaks", drop_leaks), ("packing", pack)]

#: Toxicity models, common subsequences and packing can't be said in SQL; the stages' operators are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a table in the shared folder, and goes when the next is there."""
    docs = registry.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = exchange.settle_alone(spark, partial(stage, spark, docs, sf_dir))
        exchange.discard(docs)
        docs = done
    return docs
