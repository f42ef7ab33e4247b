"""From questions to checked answers in one plan: route, retrieve, render, generate, verify."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..operators.grounding import REFUSAL, problem_lists

HEADING_CHARS, PASSAGE_CHARS = 70, 700


def clip(text: Column, size: int) -> Column:
    return F.substring(collapse(text), 1, size)


def fact_line(fact_id: Column, text: Column, page: Column, doc_name: Column) -> Column:
    return F.concat(F.lit("[F"), fact_id.cast("string"), F.lit("] "), text, F.lit(" (p. "), F.coalesce(page.cast("string"), F.lit("?")), F.lit(", "), doc_name, F.lit(")"))


def passage_line(chunk_id: Column, heading: Column, text: Column) -> Column:
    return F.concat(F.lit("[C"), chunk_id.cast("string"), F.lit("] "), F.substring(F.coalesce(heading, F.lit("")), 1, HEADING_CHARS), F.lit(": "), clip(text, PASSAGE_CHARS))


def prompts(questions: DataFrame, lines: DataFrame) -> DataFrame:
    """(qid, prompt, ids): the evidence lines (qid, place, id, line) of each question in order, then the question."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "id", "line")))
    shown = lines.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("evidence"), F.transform(ordered, lambda s: s["id"]).alias("ids"))
    joined = questions.join(shown, "qid", "left")
    prompt = F.concat_ws("\n\n", F.coalesce("evidence", F.lit("(no evidence)")), F.concat(F.lit("Question: "), "question"))
    return joined.select("qid", prompt.alias("prompt"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def within_budget(hits: DataFrame, questions: DataFrame, budget: str) -> DataFrame:
    """hits (qid, rank, ...) up to each question's own budget."""
    return hits.join(questions.select("qid", budget), "qid").where(F.col("rank") <= F.col(budget)).drop(budget)


def generate(prompted: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """Answers by a text model with the seconds that each took; a prompt on which it fails gets an error and no answer, the others go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for qid, prompt in zip(batch["qid"], batch["prompt"], strict=True):
                began, said, failed = time.perf_counter(), None, None
                try:
                    said = model(prompt)
                except Exception as error:  # one question's failure is a result of its own
                    failed = repr(error)
                rows.append((qid, said, failed, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["qid", "answer", "error", "seconds"])

    kind = prompted.schema["qid"].dataType.simpleString()
    return prompted.select("qid", "prompt").mapInPandas(run, f"qid {kind}, answer string, error string, seconds double")


def first_line_model(prompt: str) -> str:
    """A deterministic stand-in for a language model: repeats the first line of evidence after its id."""
    line = prompt.split("\n", 1)[0]
    head, mark, rest = line.partition("] ")
    return f"{rest} {head}]" if mark else f"{REFUSAL}: no evidence was supplied."


def checked(answers: DataFrame, context: DataFrame) -> DataFrame:
    """Answers (qid, answer) with their problems, given context (qid, ids, supplied)."""
    found = problem_lists(answers.join(context, "qid")).select("qid", F.transform("found", lambda p: F.concat_ws(": ", p["problem"], p["detail"])).alias("problems"))
    return answers.join(found, "qid", "left")


def ranked(rows: DataFrame, by: str, order: list[Column | str]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
