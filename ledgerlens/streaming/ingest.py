"""Incremental loading: new files of a folder are loaded as they come, each document replacing its earlier rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ingest import clean_chunks, first_of, write_by_document


def load_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, schema: str, available_now: bool = True, version_col: str | None = None, buckets: int = 256) -> StreamingQuery:
    """Watches folder for Parquet chunk files and loads them into target, which is partitioned by a hash of the document.

    A batch rewrites the buckets of its documents, so the number of folders is the same however many documents there are.
    Without version_col a document's rows of one batch replace its earlier rows, so its files have to come in one batch. With
    version_col they may come in several: rows of the same version add to those that are there, a larger version replaces
    them, and a smaller one is ignored. A batch that is run again leaves the same rows, so the sink is idempotent.
    """

    def load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path
        files = path(target).getFileSystem(session._jsc.hadoopConfiguration())
        rows = first_of(clean_chunks(batch), ["chunk_id"], [F.desc("page_start")]).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most the number of buckets
        if not touched:
            return
        if files.exists(path(target)):
            there = session.read.schema(rows.schema).parquet(target).where(F.col("bucket").isin(*touched)).select(*rows.columns)
            if version_col:
                both = rows.unionByName(there)
                newest = both.groupBy("doc_id").agg(F.max(version_col).alias("__newest"))
                rows = first_of(both.join(newest, "doc_id").where(F.col(version_col) == F.col("__newest")).drop("__newest"), ["chunk_id"], [F.desc("page_start")])
            else:
                rows = rows.unionByName(there.join(rows.select("doc_id").distinct(), "doc_id", "left_anti").select(*rows.columns))
        # Written aside first: a table cannot be read and overwritten at once.
        aside = f"{checkpoint}/aside/{number}"
        rows.write.mode("overwrite").parquet(aside)
        write_by_document(session.read.schema(rows.schema).parquet(aside), target, "bucket")
        files.delete(path(aside), True)

    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
