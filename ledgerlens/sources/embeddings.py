"""The cache of embeddings: vectors by the digest of their text, in a bucketed table that is only ever appended to.

Rows meet the cache bucket by bucket: texts are made distinct and dealt by digest, the cache is read as it lies, without a
shuffle, and only for digests where vectors are not needed. An append is written beside the table and its files are moved in,
each whole: vectors depend on nothing but their text, so a reader may see some files of an append before others, two appends
at once do not hinder each other, and a digest that both have is given once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "digest string, embedding array<double>"
#: Buckets of a new cache. A terabyte of vectors makes some four gigabytes a bucket.
BUCKETS = 256


def distinct_texts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, text) of each text once; null texts have none. Copies are merged before they are dealt."""
    named = rows.select(F.col(text_col).alias("text")).where("text is not null").withColumn("digest", F.md5("text"))
    return named.groupBy("digest").agg(F.first("text").alias("text"))


class EmbeddingCache:
    """A cache in a folder; an existing one keeps the number of buckets it was made with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self._path = spark, spark._jvm.org.apache.hadoop.fs.Path
        root = self._path(path)
        self._files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        there = [f.getPath().getName() for f in self._files.globStatus(self._path(f"{path}/buckets-*")) or []]
        self.buckets = int(there[0].rpartition("-")[2]) if there else buckets
        self.root = self._files.makeQualified(root).toString()
        self.folder = f"{self.root}/buckets-{self.buckets}"
        self.name = "embeddings_" + hashlib.md5(self.folder.encode()).hexdigest()

    def table(self) -> DataFrame:
        """(digest, embedding) as it lies, bucketed by digest. The folder is made by the first append."""
        if not self._files.exists(self._path(self.folder)):
            return self.spark.createDataFrame([], SCHEMA)
        place = self.folder.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def missing(self, texts: DataFrame) -> DataFrame:
        """The rows of distinct texts (digest, text) that the cache lacks."""
        return texts.repartition(self.buckets, "digest").join(self.table().select("digest"), "digest", "left_anti")

    def vectors(self, texts: DataFrame) -> DataFrame:
        """(digest, embedding) of the distinct texts that the cache has."""
        found = self.table().join(texts.select("digest").repartition(self.buckets, "digest"), "digest", "left_semi")
        return found.groupBy("digest").agg(F.first("embedding").alias("embedding"))

    def count(self) -> int:
        """Digests that have a vector."""
        return self.table().groupBy("digest").agg(F.lit(1)).count()

    def append(self, vectors: DataFrame) -> None:
        """Adds (digest, embedding)."""
        draft, name = f"{self.root}/draft-{uuid.uuid4().hex}", f"draft_{uuid.uuid4().hex}"
        try:
            vectors.select("digest", F.col("embedding").cast("array<double>").alias("embedding")).write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", draft).saveAsTable(name)
            self._files.mkdirs(self._path(self.folder))
            for made in self._files.globStatus(self._path(f"{draft}/part-*")) or []:
                if not self._files.rename(made.getPath(), self._path(f"{self.folder}/{made.getPath().getName()}")):
                    raise OSError(f"{made.getPath()} could not be moved into {self.folder}")
        finally:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self._files.delete(self._path(draft), True)

    def fill(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame], waves: int = 1) -> None:
        """Embeds the distinct texts that the cache lacks, each once: embed is (digest, text) to (digest, embedding).

        With several waves each is appended when it is done, so a run that is broken off goes on with those that are left.
        """
        for wave in range(waves):
            own = texts.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave) if waves > 1 else texts
            self.append(embed(self.missing(own)))

    def embedded(self, rows: DataFrame, embed: Callable[[DataFrame], DataFrame], text_col: str = "text", waves: int = 1) -> DataFrame:
        """rows with their embedding, null where the text is; texts that the cache lacks are embedded and appended first."""
        texts = distinct_texts(rows, text_col)
        self.fill(texts, embed, waves)
        # Only vectors of these rows are dealt again: a text in very many rows is then split like any other hot key.
        keyed = rows.withColumn("__digest", F.md5(text_col))
        return keyed.join(self.vectors(texts).withColumnRenamed("digest", "__digest"), "__digest", "left").drop("__digest")
