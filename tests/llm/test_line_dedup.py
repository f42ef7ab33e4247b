import random
from bisect import bisect_left
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import line_dedup
from ledgerlens.llm.oracle import OP8
from ledgerlens.llm.shared import Scratch

from ..oracle_check import assert_same
from . import brute

SCHEMA = "doc_id long, text string"


def marked(spark, rows, min_words):
    out = line_dedup.repeated_lines(spark.createDataFrame(rows, SCHEMA), min_words).select("doc", "seq").collect()
    return {tuple(r) for r in out}


def corpus(seed, docs=30):
    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 6))) for _ in range(12)]
    return [(k, "\n".join(rng.choice(["", " ", ""]) + rng.choice(pool) for _ in range(rng.randrange(1, 14)))) for k in range(docs)]


@pytest.mark.parametrize(("seed", "min_words"), [(0, 7), (1, 12), (2, 1), (3, 50)])
def test_equals_brute_force(spark, seed, min_words):
    rows = corpus(seed)
    assert marked(spark, rows, min_words) == brute.line_runs(rows, min_words)


def test_ranks_are_places_in_the_suffix_array(spark):
    """By 1, 2 and 4 lines: of the suffixes that another shares so many lines with, in the order of these lines."""
    docs = spark.createDataFrame(corpus(5, 40), SCHEMA)
    scratch = Scratch(spark)
    ids = line_dedup.line_table(docs, "doc_id", "text").select("doc", "tie", "seq", F.xxhash64("body").alias("a"))
    order = {tuple(r[:3]): r[3] for r in ids.collect()}
    ranks = line_dedup._ranked(ids, ["a"], scratch)
    for n in (1, 2, 4):
        keys = {(d, t, s): tuple(order[d, t, s + k] for k in range(n)) for d, t, s in order if (d, t, s + n - 1) in order}
        counts = Counter(keys.values())
        kept = sorted(k for k in keys.values() if counts[k] > 1)
        assert {tuple(r[:3]): r[3] for r in ranks.select("doc", "tie", "seq", "rank").collect()} == {p: bisect_left(kept, k) for p, k in keys.items() if counts[k] > 1}
        ranks = line_dedup._doubled(ranks, n, scratch)
    scratch.drop()


def test_query_equals_its_oracle(spark):
    rows = [(k, t + "\n" + "\n".join(["one two three four five six seven"] * (k % 9))) for k, t in corpus(4, 60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert_same(line_dedup.repeated_runs(docs), OP8, None, {"documents": docs.toPandas()})


def test_first_copies_stay_and_text_and_columns_are_kept(spark):
    run = "\n".join(f"this is line number {k} of the run" for k in range(8))
    rows = [(1, f"head\n{run}\n\ntail"), (2, f"other\n\n{run}\nend"), (3, "short"), (4, "short"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"seq": F.lit(1), "doc": F.lit("clash"), "name": F.lit(0)})
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: rows[0][1], 2: "other\n\nend", 3: "short", 4: "short", 5: None, 6: ""}
    runs = line_dedup.repeated_runs(docs).collect()
    assert [tuple(r) for r in runs] == [(2, 1, 8, 64, 1, 1)]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = "\n".join(f"line {k} with some more words in it" for k in range(9))
    rows = [(1, text), (1, text), (None, text), (2, text + "\nmore"), (2, "other")]
    found = line_dedup.repeated_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["source_doc_id"], r["n_lines"]) for r in found) == [(1, None, 9), (2, None, 9)]
    assert line_dedup.repeated_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert line_dedup.dedup_lines(spark.createDataFrame([(1, "x")], SCHEMA)).first()["text"] == "x"


def test_very_long_texts(spark):
    """Thousands of lines that all repeat, of one and of many kinds, and a line of a megabyte."""
    many = "\n".join(f"line number {k} of a long text" for k in range(5000))
    rows = [(1, many), (2, many + "\nend"), (3, "word\n" * 3000), (4, "w " * 500_000 + "\nx"), (5, "y\n" + "w " * 500_000)]
    out = {(r["doc_id"], r["start_line"]): (r["n_lines"], r["source_doc_id"], r["source_start_line"]) for r in line_dedup.repeated_runs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(n for (d, _), (n, _, _) in out.items() if d == 3) == 2999 and out[2, 0] == (5000, 1, 0) and out[5, 1] == (1, 4, 0) and {d for d, _ in out} == {2, 3, 5}


def test_no_python_in_the_plan(spark):
    plan = line_dedup.repeated_runs(spark.createDataFrame(corpus(1), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
