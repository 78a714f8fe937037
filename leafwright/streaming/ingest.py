"""Incremental ingest: new files of a folder become the same relations as a batch build, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafwright.sources import epub
from leafwright.sources.shared import Tables


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Parses files that are new since the last run and appends their rows to Parquet tables below ``target``.

    A file is a whole book, so no state goes from one batch to the next, and no watermark is needed. A batch that is run
    again overwrites its own folder, so a lost driver leaves no rows twice.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[eE][pP][uU][bB]").option("recursiveFileLookup", "true").load(source)

    def one(batch: DataFrame, number: int) -> None:
        rows = epub.unpack(batch).persist()
        tables = Tables(rows.sparkSession)
        made = epub.build(rows, tables)
        for name in ("blocks", "chapters", "toc", "warnings"):
            made[name].write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        epub.of(rows, "status").select("book", "status").write.mode("overwrite").parquet(f"{target}/books/batch={number}")
        tables.discard()
        rows.unpersist()

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
