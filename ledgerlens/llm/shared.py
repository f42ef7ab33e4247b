"""Shared-folder tables, size-checked broadcasts and prefix sums that several operators use."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a one-long-column side up to which a join may broadcast it (about 64 MB in the JVM).
BROADCAST_ROWS = 500_000
#: Files up to which the table of their numbers is broadcast (some 200 bytes each).
FILE_ROWS = 100_000
#: Column of with_row_key.
ROW = "__row"

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where it is unset, a temporary one, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        found = _own[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ledgerlens/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes df as Parquet in the shared folder and reads it back. Returns the path too, for drop_table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


class Scratch:
    """Owns intermediate tables: drop() deletes all but the kept ones, once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        table, path = write_table(df, name)
        self.paths.append(path)
        return table

    def drop(self) -> None:
        drop_table(self.spark, *self.paths)
        self.paths = []


def plain_columns(df: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """df with names of its own for all columns but the needed ones: those given may hold dots or clash with any other name.

    Columns stay in their order, so toDF(*df.columns) gives a result of them its names back.
    """
    return df.toDF(*[c if c in needed else f"extra{k}" for k, c in enumerate(df.columns)])


def with_row_key(df: DataFrame) -> DataFrame:
    """df with a number for each row (ROW) that stays however often df is read: ids may be null or repeated, numbers are neither.

    Rows of files are numbered by their file and their place in it; other rows are written first.
    """
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    except AnalysisException:  # not read from files with row numbers
        return write_table(df.withColumn(ROW, F.monotonically_increasing_id()), "keyed")[0]
    # One row per file; only footers are read for it.
    files, _ = write_table(placed.select("__file").distinct().withColumn("__number", F.row_number().over(Window.orderBy("__file")).cast("long")), "files")
    numbered = placed.join(small(files.withColumnRenamed("__file", "__of"), FILE_ROWS), F.col("__file") == F.col("__of"))
    return numbered.select(*[numbered[f"`{c}`"] for c in df.columns], (F.col("__number") * (1 << 36) + F.col("__index")).alias(ROW))


def drop_table(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of write_table that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows, else df: then the join shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Inclusive running sum of value in each group, in the order (bucket, *order), without a task per group.

    bucket is an integer column that follows the order and splits every group into ranges of bounded size;
    only one row per (group, bucket) is summed across buckets.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    ranges = df.groupBy(*keys).agg(F.sum(value).alias("__range_sum"))
    ranges = ranges.select(*[F.col(c).alias(f"__{c}") for c in keys], F.coalesce(F.sum("__range_sum").over(before), F.lit(0)).alias("__before"))
    joined = df.join(ranges, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left").select(*df.columns, "__before")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.sum(value).over(inside) + F.col("__before")).drop("__before")


def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") and hasattr(libc, "mallopt") else None
    except OSError:  # another C library
        return None


def _settle() -> None:
    """Once per worker: arrays of eight megabytes and more are mapped by themselves, so the system has them back when they are freed."""
    if "settled" not in _own:
        _own["settled"] = ""
        if libc := _libc():
            libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-8, 2)  # M_ARENA_MAX


def _give_back() -> None:
    """Returns freed memory to the system: workers live on from task to task beside a JVM with a full heap."""
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose tasks give their memory back at the end."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _settle()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(tidy, schema)
