"""A load in one step: converted documents become rows of documents, chunks and facts in one commit; their vectors go to the cache before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import scrub
from . import versions
from .embeddings import SCHEMA, EmbeddingCache, distinct_texts
from .ingest import clean_chunks, load_facts, unique_chunks, upsert_documents

TABLES = ("documents", "chunks", "facts")


def embedder(load_model: Callable[[], Callable[[list[str]], list]], batch_chars: int = 100_000) -> Callable[[DataFrame], DataFrame]:
    """An embed for the cache: (digest, text) to (digest, embedding). The model is loaded once per task.

    Texts of about a length go through the model together, batch_chars characters at once at most; a longer text goes by itself.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            if model is None and len(batch):
                model = load_model()
            batch = batch.assign(size=batch["text"].str.len()).sort_values("size")
            first = 0
            while first < len(batch):
                last = first
                while last < len(batch) and (last == first or int(batch["size"].iloc[last]) * (last - first + 1) <= batch_chars):
                    last += 1
                own = batch.iloc[first:last]
                yield pd.DataFrame({"digest": own["digest"], "embedding": [list(map(float, v)) for v in model(own["text"].tolist())]})
                first = last

    return lambda missing: missing.select("digest", "text").mapInPandas(run, "digest string, embedding array<double>")


def _scrubbed(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: scrub(F.col(c)) for c in columns if c in rows.columns})


def _numbered(rows: DataFrame, column: str, highest: int) -> DataFrame:
    """rows with numbers above the highest there is; with gaps, and the same ones however often they are read once written."""
    return rows.withColumn(column, F.monotonically_increasing_id() + F.lit(highest + 1))


def _highest(rows: DataFrame, column: str) -> int:
    return rows.agg(F.max(column)).first()[0] or 0


def plan(current: dict[str, DataFrame], documents: DataFrame, chunks: DataFrame, facts: DataFrame, embed: Callable[[DataFrame], DataFrame], number: Callable[[DataFrame, str, int], DataFrame] = _numbered) -> dict[str, DataFrame]:
    """The tables after the load, from the current ones (TABLES) and what was converted; nothing is written.

    documents: doc_name and its columns; chunks and facts name their document by doc_name. A document that is there keeps its
    number and gets its time of loading; its chunks and facts are replaced. Texts lose NUL characters before anything else,
    blank chunks go, table chunks and facts are unique by their keys, and each fact has its table's chunk and its text. embed
    is called once, with all distinct texts (digest, text), and gives (digest, embedding).
    """
    there = current["documents"]
    fresh = number(documents.join(there, "doc_name", "left_anti"), "doc_id", _highest(there, "doc_id")).select("doc_name", F.col("doc_id").alias("new_id"))
    named = documents.join(fresh, "doc_name", "left").join(there.select("doc_name", F.col("doc_id").alias("old_id")), "doc_name", "left")
    named = named.withColumn("doc_id", F.coalesce("old_id", "new_id")).drop("old_id", "new_id")
    ids = named.select("doc_name", "doc_id")

    # Numbered as they come, before any shuffle: the first of a key is the first to arrive.
    new_chunks = number(chunks, "chunk_id", _highest(current["chunks"], "chunk_id")).join(ids, "doc_name").drop("doc_name")
    new_chunks = unique_chunks(clean_chunks(_scrubbed(new_chunks, "item_section")).withColumn("heading_trail", F.transform("heading_trail", scrub)))
    new_facts = number(facts, "fact_id", _highest(current["facts"], "fact_id")).join(ids, "doc_name").drop("doc_name")
    new_facts = load_facts(named, new_chunks, _scrubbed(new_facts, "row_label", "column_label", "value_raw")).withColumn("signed", F.when(F.col("parenthesized"), -F.col("value")).otherwise(F.col("value")))

    vectors = embed(distinct_texts(new_chunks.select("text").unionByName(new_facts.select(F.col("fact_text").alias("text"))))).select("digest", "embedding")

    def embedded(rows: DataFrame, text: Column) -> DataFrame:
        return rows.withColumn("digest", F.md5(text)).join(vectors, "digest", "left").drop("digest")

    def replaced(name: str, rows: DataFrame) -> DataFrame:
        kept = current[name].join(ids.select("doc_id"), "doc_id", "left_anti")
        return kept.unionByName(rows.select(*kept.columns))

    return {
        "documents": upsert_documents(there, named.withColumn("ingested_at", F.current_timestamp()).select(*there.columns), "doc_id", "ingested_at"),
        "chunks": replaced("chunks", embedded(new_chunks, F.col("text"))), "facts": replaced("facts", embedded(new_facts, F.col("fact_text"))),
    }


def load(spark: SparkSession, folder: str, documents: DataFrame, chunks: DataFrame, facts: DataFrame, embed: Callable[[DataFrame], DataFrame], dry_run: bool = False, facts_only: bool = False) -> dict[str, int]:
    """Loads into the tables under folder (sources.versions) in one commit; returns the rows that each table has then.

    Vectors are kept in the cache under folder/embeddings, which grows by the texts that it lacks before the commit is tried. A
    dry run counts, embeds and writes nothing; facts_only leaves chunks and passages' texts as they are. Of two loads at once
    one is done again on what the other has committed, with the vectors that are there by then.
    """
    cache, texts = EmbeddingCache(spark, f"{folder}/embeddings"), []

    def filled(asked: DataFrame) -> DataFrame:
        cache.fill(asked, embed)
        return cache.vectors(asked)

    def seen(asked: DataFrame) -> DataFrame:
        texts.append(asked)
        return spark.createDataFrame([], SCHEMA)

    def change(read: Callable[[str], DataFrame], vectors: Callable[[DataFrame], DataFrame] = filled) -> dict[str, DataFrame]:
        made = plan({name: read(name) for name in TABLES}, documents, chunks, facts, vectors)
        return {name: rows for name, rows in made.items() if not (facts_only and name == "chunks")}

    if dry_run:
        number = versions.latest(spark, folder)
        counted = {name: rows.count() for name, rows in change(lambda name: versions.read(spark, folder, name, number), seen).items()}
        return counted | {"cache": cache.count() + cache.missing(texts[0]).count()}
    number = versions.update(spark, folder, change)
    return {name: versions.read(spark, folder, name, number).count() for name in TABLES} | {"cache": cache.count()}


def violations(documents: DataFrame, chunks: DataFrame, facts: DataFrame, parts: int | None = None) -> DataFrame:
    """What the tables' constraints forbid: (table, rule, key, n), a row for each key that breaks a rule and how many rows do.

    Rules: columns that must not be null, unique keys (a key with a null is never a repeat), kinds of chunks, and documents and
    chunks that rows refer to. Repeats are counted by grouped sums, so a key with very many rows meets in no task.
    Rules on single rows are one pass over a table. parts: into how many parts keys are dealt, for tables whose keys would take too much memory otherwise.
    """
    text = lambda *c: F.concat_ws("/", *[F.coalesce(F.col(x).cast("string"), F.lit("null")) for x in c])
    dealt = lambda rows, *c: rows.repartition(parts, *c) if parts else rows
    found = []

    def rowwise(name: str, rows: DataFrame, key: str, rules: dict[str, Column]) -> None:
        broken = rows.where(reduce(Column.__or__, rules.values())).select(text(key).alias("key"), F.explode(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()])).alias("rule")).where("rule is not null")
        found.append(broken.groupBy("rule", "key").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "rule", "key", "n"))

    def nulls(*columns: str) -> dict[str, Column]:
        return {f"{c} is null": F.col(c).isNull() for c in columns}

    def unique(name: str, rows: DataFrame, columns: tuple[str, ...]) -> None:
        whole = dealt(rows.dropna(subset=list(columns)).select(*columns), columns[0]).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
        found.append(whole.select(F.lit(name).alias("table"), F.lit(f"{', '.join(columns)} repeated").alias("rule"), text(*columns).alias("key"), "n"))

    def refers(name: str, rows: DataFrame, column: str, to: DataFrame) -> None:
        counted = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        unknown = counted.join(to.select(column).distinct(), column, "left_anti")
        found.append(unknown.select(F.lit(name).alias("table"), F.lit(f"{column} unknown").alias("rule"), text(column).alias("key"), "n"))

    rowwise("documents", documents, "doc_id", nulls("doc_name", "company", "doc_type"))
    rowwise("chunks", chunks, "chunk_id", nulls("doc_id", "text") | {"kind unknown": ~F.coalesce(F.col("kind").isin("prose", "table"), F.lit(False))})
    rowwise("facts", facts, "fact_id", nulls("doc_id", "table_ordinal", "row_label", "column_label", "value_raw", "value", "page"))
    unique("documents", documents, ("doc_id",))
    unique("documents", documents, ("doc_name",))
    unique("chunks", chunks, ("chunk_id",))
    unique("chunks", chunks.withColumn("text_md5", F.md5("text")), ("doc_id", "kind", "table_ordinal", "page_start", "text_md5"))
    unique("facts", facts, ("fact_id",))
    unique("facts", facts, ("doc_id", "table_ordinal", "row_label", "column_label"))
    refers("chunks", chunks, "doc_id", documents)
    refers("facts", facts, "doc_id", documents)
    refers("facts", facts, "chunk_id", chunks)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
