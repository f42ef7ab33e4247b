"""What a question is about: company, fiscal year, kind; and what a conversation carries over."""

from __future__ import annotations

import uuid
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NUMERIC_QUESTION, fiscal_year, follow_up, squash

#: Facts and passages that a question of each kind gets.
BUDGET = {"numeric": (10, 3), "narrative": (4, 10)}


#: Names of an automaton; a larger table is taken in blocks of so many.
BLOCK_NAMES = 200_000
_automata: dict[str, object] = {}


def _longest(shared):
    """For each text the longest name in it, and the value that the name stands for: one automaton finds all names in one pass."""

    key = uuid.uuid4().hex

    def find(texts: pd.Series) -> pd.DataFrame:
        automaton = _automata.get(key)
        if automaton is None:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for name, value in shared.value.items():
                automaton.add_word(name, (len(name), name, value))
            automaton.make_automaton()
            if len(_automata) >= 8:  # a worker keeps those that it uses
                _automata.clear()
            _automata[key] = automaton
        best = [max((hit for _, hit in automaton.iter(t)), default=(None, None, None)) if t else (None, None, None) for t in texts]
        return pd.DataFrame(best, columns=["size", "name", "value"]).astype({"size": "Int32"})

    return find


def longest_name(text: Column, names: DataFrame) -> Column | None:
    """The value (string) of the longest of the names (name, value) that occurs in a text; of equally long ones the last by name.

    A name of several values stands for the first. The work follows the texts' lengths, whatever the number of names; None
    without names.
    """
    spark, best = names.sparkSession, None
    rows = names.where("name <> '' and value is not null").groupBy("name").agg(F.min("value").alias("value")).toLocalIterator()
    while block := dict(tuple(r) for r in islice(rows, BLOCK_NAMES)):
        found = F.pandas_udf(_longest(spark.sparkContext.broadcast(block)), "size int, name string, value string")(text)
        best = found if best is None else F.greatest(best, found)
    return None if best is None else best["value"]


def resolve_scope(questions: DataFrame, companies: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """questions (qid, question, ...) with company and fiscal_year, null where the question names none.

    The longest company name that occurs in the squashed question wins. Aliases (alias, company) are tried only where no
    name occurs, longest first, and count only if their company is known.
    """
    known = companies.select(squash(F.col("company")).alias("name"), F.col("company").alias("value")).where("name <> ''")
    none = F.lit(None).cast("string")
    text = squash(F.col("question"))
    named = longest_name(text, known)
    found = none if named is None else named
    if aliases is not None:
        usable = aliases.join(known.select(F.col("value").alias("company")).distinct(), "company", "left_semi").select(squash(F.col("alias")).alias("name"), F.col("company").alias("value"))
        other = longest_name(text, usable)
        found = found if other is None else F.coalesce(found, other)
    return questions.withColumns({"company": found, "fiscal_year": fiscal_year(F.col("question"))})


def route(questions: DataFrame) -> DataFrame:
    """kind (numeric or narrative) and the numbers of facts and passages that it gets."""
    kind = F.when(F.regexp_like("question", F.lit(NUMERIC_QUESTION)), "numeric").otherwise("narrative")
    budget = lambda n: F.when(F.col("kind") == "numeric", BUDGET["numeric"][n]).otherwise(BUDGET["narrative"][n])
    return questions.withColumn("kind", kind).withColumns({"k_facts": budget(0), "k_chunks": budget(1)})


def carry_over(turns: DataFrame, by: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """turns (conv_id, turn, question, company, fiscal_year) with the gaps of scope filled from earlier turns and the search text."""
    order = Window.partitionBy(*by).orderBy("turn")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = {c: F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(before)) for c in ("company", "fiscal_year")}
    return turns.withColumns({"search_text": follow_up(F.col("question"), F.lag("question").over(order))} | filled)


def with_fallback(hits: DataFrame, loose: DataFrame) -> DataFrame:
    """hits, and the loose hits (found without the year) of the queries that have none at all."""
    missing = loose.join(hits.select("qid").distinct(), "qid", "left_anti")
    return hits.unionByName(missing)
