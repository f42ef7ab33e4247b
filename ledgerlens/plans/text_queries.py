"""Registered queries of English full text: vectors of texts, ranked words, phrases and exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import english, text
from ..operators import fulltext
from ..sources.io import read_table
from .queries import query


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.postings(read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def _shown(found: DataFrame, name: str) -> DataFrame:
    counted = found.groupBy("id").agg(F.count("*").alias("n"))
    return fulltext.text_vector(found).join(counted, "id").select(F.col("id").alias(name), "n", F.md5("vector").alias("vector_md5"))


@query
def text_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The lexemes of every document with their positions."""
    return _shown(_passages(spark, d), "doc_id")


@query
def page_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The same of every page: marks and references are no words, addresses are three."""
    return _shown(fulltext.postings(read_table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))), "page_id")


@query
def lexical_stemmed(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold most of each test item's first terms, by their stems."""
    terms = text.query_terms(F.col("text"))
    asked = read_table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), fulltext.any_words(terms).alias("question"))
    return fulltext.ranked_search(_passages(spark, d), asked, 10)


def _free(word: Column) -> Column:
    return ~word.isin(*sorted(english.STOP))


@query
def lexical_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Queries of three kinds: a phrase of each item or its last word; two words without a third; the phrase alone."""
    all_of = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    pair = F.get(F.filter(all_of("[a-z]{5,} [a-z]{5,}"), lambda p: _free(F.split(p, " ")[0]) & _free(F.split(p, " ")[1])), F.lit(0))
    chosen = read_table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), pair.alias("pair"), F.try_element_at(F.filter(all_of("[a-z]{5,}"), _free), F.lit(-1)).alias("last"))
    first, second = F.split("pair", " ")[0], F.split("pair", " ")[1]
    quoted = F.concat(F.lit('"'), "pair", F.lit('"'))
    asked = F.when(F.col("qid") % 3 == 0, F.concat(quoted, F.lit(" OR "), "last")).when(F.col("qid") % 3 == 1, F.concat(first, F.lit(" "), "last", F.lit(" -"), second)).otherwise(quoted)
    return fulltext.ranked_search(_passages(spark, d), chosen.select("qid", asked.alias("question")), 10)
