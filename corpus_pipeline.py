"""From raw documents to token files, in stages that each write and read Parquet.

Counted as part of ledgerlens.llm. Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with
their columns; the last returns what the token files hold of each document. Decisions are on rows, by a number that each
stage gives them, so a row is judged by its own columns whatever its id: ids may be null or repeated, rows of one id may
have other texts, and equal rows are rows of their own. Null and empty texts pass every stage; an empty table gives an
empty one; further columns, of whatever name, pass the first four stages as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, language_id, mixing, ngram_join, token_files
from ledgerlens.llm.shared import ROW, plain_columns, small, with_row_key, write_table

#: The columns that stages work with; all others pass under their own names.
COLUMNS = ("doc_id", "text", "lang", "source")


def _without(docs: DataFrame, out: DataFrame) -> DataFrame:
    """docs (with_row_key) without the rows in out, whose numbers are written first."""
    rows, _ = write_table(out.select(F.col(ROW).alias("__out")), "stage-out")
    return docs.join(small(rows), docs[ROW] == F.col("__out"), "left_anti").drop(ROW)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown or doubtful. One without text is judged by its declared language and source."""
    keyed = with_row_key(plain_columns(docs, COLUMNS))
    return _without(keyed, language_id.language_documents(keyed, id_col=ROW).where("not kept")).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, one without an id only if none has one.

    Of equal rows one stays; documents without words are copies of none and all stay.
    """
    keyed = with_row_key(plain_columns(docs, COLUMNS))
    groups, _ = write_table(ngram_join.join_ngrams(keyed, id_col=ROW).select(ROW, "component_id"), "stage-groups")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", ROW)
    first = groups.join(keyed.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(order)[ROW].alias(ROW))
    return _without(keyed, groups.join(first.select(ROW), ROW, "left_anti")).toDF(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item; items without an id count too, items and documents without words match nothing."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix does: not at all, once or twice. Those without words are taken as their place in the queue says."""
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns their documents: doc_id, start, n_tokens, ids_crc32."""
    index = token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, index)


STAGES = [
    ("language_id", identify_languages),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mix_sources", mix),
    ("token_files", write_token_files),
]

#: SQL can express neither the language model nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's result is written and reread as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
