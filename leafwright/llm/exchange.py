"""Moving packed columns between blobs of documents and hash buckets.

A *blob* is a group of whole documents, dealt by a hash of the row; a *bucket* is a range of key
hashes. A blob sends each bucket one row that holds all its keys there as one binary value; the
bucket answers with one row per blob. So a count over all shingles, words or anchors of a corpus
moves a few bytes per distinct key and blob, and no row per occurrence. A key that a third of the
documents hold reaches its bucket once per blob, so it does not make the bucket large.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOB_BYTES = 4 << 20
UNKNOWN_BYTES = 1 << 52  # the planner says as much where it knows nothing


def blob_count(df: DataFrame, bytes_each: int = BLOB_BYTES) -> int:
    """How many blobs to deal ``df`` into: by the planner's estimate of its size, one per shuffle partition at least."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if estimate >= UNKNOWN_BYTES else max(least, min(-(-estimate // bytes_each), 1 << 20))


def with_blob(df: DataFrame, *columns: str, count: int | None = None, name: str = "blob") -> DataFrame:
    """Adds the column ``name``, a hash of the named columns."""
    return df.withColumn(name, F.pmod(F.xxhash64(*columns), F.lit(count or blob_count(df))).cast("int"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"{tempfile.gettempdir()}/leafwright-checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/leafwright/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._leafwright_path = path
    _written.append(path)
    return out


def settle_dealt(df: DataFrame, column: str) -> DataFrame:
    """``settle``, dealt by the hash of a column: what groups the table by that column shuffles nothing of it."""
    spark = df.sparkSession
    name = f"leafwright_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/leafwright/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, column).write.bucketBy(n, column).format("parquet").option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are outside of the warehouse, and ``out`` knows them
    out._leafwright_path = path
    _written.append(path)
    return out


_written: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes a table that ``settle`` wrote and that nothing reads any more."""
    if path := getattr(df, "_leafwright_path", None):
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles and broadcasts that nothing refers to any more, on all machines.

    Its cleaner acts when the driver's JVM collects, which a driver of many small jobs seldom does by itself. What the C
    library holds for the JVM's threads beyond their use goes back to the system too, where the JVM has a command for that.
    """
    gc.collect()
    spark._jvm.System.gc()
    with contextlib.suppress(Py4JError):
        _trim(spark)


def _trim(spark: SparkSession) -> str:
    """Runs the JVM's command ``System.trim_native_heap`` in the driver, by reflection, as the server's own class is not open."""
    lang, array = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    invoke = next(m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    given = array(lang.Object, 4)
    given[0], given[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    given[2], given[3] = array(lang.Object, 0), array(lang.String, 0)
    return invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows as they are; the Python worker gives back what its allocators hold beyond its use."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)
    yield from batches


def rest(spark: SparkSession) -> None:
    """Lets the executors give back what earlier jobs left there: garbage on their JVMs' heaps, and what Python workers hold beyond their use.

    A heap that has grown hardly shrinks without a full collection, so a job's Python workers would find an executor as
    full as the largest job before made it. One small task a core, so that each executor gets some if all are free.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").mapInArrow(_trimmed, "done string").collect()


@contextlib.contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffles go from all disks when the query ends, not when the driver's JVM happens to collect."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def settle_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``settle(make())``; the tables that were settled on the way are deleted."""
    begun = len(_written)
    out = settle(make())
    for path in _written[begun:-1]:
        _delete(spark, path)
    del _written[begun:]
    return out


def deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts hashes by (bucket, hash); the buckets present; their first positions, with the end."""
    b = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.lexsort((keys, b))
    present, first = np.unique(b[order], return_index=True)
    return order, present.astype(np.int64), np.append(first, len(keys))


def sorted_by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes arranged by bucket, with the buckets and their bounds. Same input, same arrangement."""
    b = (keys >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(b.astype(np.uint32), kind="stable")
    b = b[order]
    present, first = np.unique(b, return_index=True)
    return keys[order], present.astype(np.int64), np.append(first, len(keys))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node of the links (u, v): root is the smallest node that can be reached.

    Alternates the large-star and small-star steps on tables in the shared folder. Each step is a
    minimum per node (combined before the shuffle) and a join, so a hub of any size is never
    gathered into one task.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = sign(now)
    for _ in range(rounds):
        if not was[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low2, "u").selectExpr("CASE WHEN v = low THEN u ELSE v END AS u", "low AS v").distinct()
        after = settle(small)
        discard(now)
        now, is_ = after, sign(after)
        release(edges.sparkSession)
        if is_ == was:
            break
        was = is_
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
