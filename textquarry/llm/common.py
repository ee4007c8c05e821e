"""Scratch tables in the cluster's shared folder, and small helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the operators' word and line rules name: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only for a local master that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(f"file://{tempfile.mkdtemp(prefix='textquarry-')}")
    return _own_dir[0]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and lost executors lose none of it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collected(spark: SparkSession) -> None:
    """Ask the driver to collect garbage: Spark deletes the shuffle files of plans that nothing refers to any more only then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str, dealt: bool = False) -> tuple[str, str]:
    """df as a table in buckets by keys, sorted by them, so that joins on the keys don't shuffle it; its name and its folder.
    ``dealt``: df is dealt by the keys already, as by groupBy(), and each of its tasks writes its own buckets."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    (df if dealt else df.repartition(buckets, *keys)).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return table, path


def dropped(spark: SparkSession, table: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    removed(spark, path)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that no column of df has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 512, size: str = "8m") -> None:
    """Python workers get texts in Arrow batches of bounded rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, that gives a worker's memory back when its task ends: workers live on and wait beside others."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return task


def text_of(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, with a null text as an empty one."""
    return df.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
