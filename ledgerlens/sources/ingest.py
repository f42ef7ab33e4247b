"""Loading documents, chunks and facts: upserts, replacement by document, uniqueness, embeddings by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fact_text, scrub
from . import versions


def upsert_documents(existing: DataFrame, incoming: DataFrame, key: str, refreshed: str) -> DataFrame:
    """existing and the new rows; of a row that is there already only the refreshed column changes."""
    old = existing.select(*[F.col(c).alias(f"old_{c}") for c in existing.columns])
    joined = incoming.join(old, F.col(key) == F.col(f"old_{key}"), "full_outer")
    known = F.col(f"old_{key}").isNotNull()
    pick = [(F.coalesce(F.col(c), F.col(f"old_{c}")) if c == refreshed else F.when(known, F.col(f"old_{c}")).otherwise(F.col(c))).alias(c) for c in existing.columns]
    return joined.select(*pick)


def replace_by_document(existing: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """incoming, and the existing rows of all other documents."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming)


def stamped(rows: DataFrame, column: str = "ingested_at") -> DataFrame:
    """rows with the time of the load (UTC where the session's time zone is)."""
    return rows.withColumn(column, F.current_timestamp())


def all_chunks(prose: DataFrame, tables: DataFrame) -> DataFrame:
    """Prose and table chunks of documents, one table; prose has no table."""
    return prose.withColumns({"kind": F.lit("prose"), "table_ordinal": F.lit(None).cast("int")}).unionByName(tables.withColumn("kind", F.lit("table")))


def delete_documents(gone: DataFrame, *tables: DataFrame, key: str = "doc_id") -> list[DataFrame]:
    """The tables (documents, chunks, facts) without the rows of documents that are gone."""
    names = gone.select(key).distinct()
    return [t.join(names, key, "left_anti") for t in tables]


def detach_chunks(facts: DataFrame, gone: DataFrame, key: str = "chunk_id") -> DataFrame:
    """facts that lose their chunk where it is gone, and stay otherwise."""
    names = gone.select(F.col(key).alias("__gone")).distinct()
    joined = facts.join(names, F.col(key) == F.col("__gone"), "left")
    return joined.select(*[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in facts.columns])


def commit_together(tables: dict[str, DataFrame], folder: str) -> int:
    """Writes the tables as one commit after the last one under folder; returns its number. See sources.versions.

    Readers (read_current) see either all tables of a commit or none of them, and a run that fails leaves all as it was.
    """
    return versions.commit(next(iter(tables.values())).sparkSession, folder, tables)


def read_current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as it was committed last."""
    return versions.read(spark, folder, name)


def write_by_document(rows: DataFrame, path: str, partition: str) -> None:
    """Overwrites only the partitions that rows has, in one commit."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Insert or ignore: the first row of each key in the order of arrival."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def unique_chunks(chunks: DataFrame, order: str = "chunk_id") -> DataFrame:
    """Table chunks once per (document, kind, table, page, text); prose, which has no table, is not unique by these."""
    keys = ["doc_id", "kind", "table_ordinal", "page_start"]
    tables = chunks.where("table_ordinal is not null").withColumn("__md5", F.md5("text"))
    return first_of(tables, [*keys, "__md5"], [order]).drop("__md5").unionByName(chunks.where("table_ordinal is null"))


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks without NUL characters and without those that are blank."""
    return chunks.withColumn("text", scrub(F.col("text"))).where(F.length(F.trim("text")) > 0)


def with_heading(facts: DataFrame, chunks: DataFrame, left: str = "left") -> DataFrame:
    """facts with their table's chunk and the last heading above it; the last chunk of a table counts."""
    tables = chunks.where("table_ordinal is not null").groupBy("doc_id", "table_ordinal").agg(F.max_by(F.struct("chunk_id", "heading_trail"), "chunk_id").alias("c"))
    named = tables.select(F.col("doc_id").alias("__doc"), F.col("table_ordinal").alias("__table"), F.col("c.chunk_id"), F.try_element_at("c.heading_trail", F.lit(-1)).alias("context"))
    # The table is no key of the join: facts that lie by document stay where they are, and meet their document's tables there.
    own = (F.col("doc_id") == F.col("__doc")) & (F.col("table_ordinal") <= F.col("__table")) & (F.col("table_ordinal") >= F.col("__table"))
    return facts.join(named, own, left).select("doc_id", "table_ordinal", *[c for c in facts.columns if c not in ("doc_id", "table_ordinal")], "chunk_id", "context")


def load_facts(documents: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts ready to embed: one of each (document, table, row, column), with its table's chunk and its text.

    documents: doc_id, company; chunks: doc_id, chunk_id, table_ordinal, heading_trail; facts: doc_id, fact_id, table_ordinal,
    row_label, column_label, value_raw, scale. The first fact by id stays.
    """
    first = first_of(facts, ["doc_id", "table_ordinal", "row_label", "column_label"], ["fact_id"])
    placed = with_heading(first.join(documents.select("doc_id", "company"), "doc_id"), chunks)
    text = fact_text(F.col("company"), F.col("context"), F.col("row_label"), F.col("column_label"), F.col("value_raw"), F.col("scale"))
    return placed.withColumn("fact_text", text).drop("company", "context")


def embed_missing(rows: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """rows with their embedding, and the cache with the new ones: only texts that the cache lacks are embedded, once each.

    cache: (digest, embedding); embed: (digest, text) -> (digest, embedding).
    """
    keyed = rows.withColumn("digest", F.md5(text_col))
    misses = keyed.join(cache, "digest", "left_anti").groupBy("digest").agg(F.first(text_col).alias("text"))
    full = cache.unionByName(embed(misses).select("digest", "embedding"))
    return keyed.join(full, "digest", "left").drop("digest"), full


def violations(chunks: DataFrame) -> DataFrame:
    """Chunks whose kind is neither prose nor table."""
    return chunks.where(~F.coalesce(F.col("kind").isin("prose", "table"), F.lit(False)))
