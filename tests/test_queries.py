"""The catalogue against its SQL on the smallest tables, and the contract of the entry module."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from leafwright.plans import catalogue

FEW = ("token_count", "char_counts", "block_extract_lines", "anchor_parse", "book_stats", "outline_sections", "search_phrase", "search_snippet", "read_budget", "next_anchor", "chunks_pack", "chunks_overlap", "split_long_text", "toc_ancestors", "chapter_starts", "rescue_cut", "markdown_budget", "footnote_number", "href_resolve", "resolve_cuts", "search_multi")


def plain(df: pd.DataFrame) -> list:
    one = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v.is_integer() else str(v)
    return sorted(tuple(str(one(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, sf, duck, name):
    assert plain(catalogue.queries()[name](spark, sf).toPandas()) == plain(duck.execute(catalogue.oracle_sql()[name]).df())


def test_pieces_are_lossless_and_within_budget(spark, sf):
    from pyspark.sql import functions as F

    from leafwright.functions import text as T
    from leafwright.operators.packing import split_pieces

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", split_pieces(F.col("text"), 50).alias("p"))
    assert rows.where(F.exists("p", lambda x: T.count_tokens(x) > 50)).count() == 0
    assert rows.where(F.regexp_replace(F.array_join("p", ""), "\\s", "") != F.regexp_replace("text", "\\s", "")).count() == 0


def test_entry_module(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
