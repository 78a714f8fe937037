"""Tables on the way of a build, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; one of our own where a local session has none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"{tempfile.gettempdir()}/leafwright-build"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Tables:
    """Written tables of one build; ``discard`` deletes them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{folder(spark)}/leafwright-build/{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows from a table: lineage and plan end there, so a lost executor costs no second parse."""
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def discard(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
