import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerlens.operators import corpus, evaluation, fulltext, search


def test_a_label_of_0_is_a_label_and_null_is_none(spark):
    rows = spark.createDataFrame([(n, [1.0, n / 10], n % 4) for n in range(1, 20)], "id long, embedding array<double>, label int")
    asked = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.0], None), (3, [1.0, 0.3], 0)], "qid long, qvec array<double>, want int")
    assert {r["qid"]: r["rank"] for r in search.first_relevant(rows, asked, {"label": "want"}, leave_out="qid").collect()} == {1: 3, 2: None, 3: 1}


def test_equal_vectors_are_scored_once_for_each_way_to_filter():
    index = search.QueryIndex([([None, "a", "a"], False)], 3)
    ids, signature = np.arange(40), np.arange(40) % 2
    columns = [pa.array(["a", "b"] * 20)]
    groups = [(own.tolist(), queries.tolist()) for own, queries in index.groups(columns, ids, signature, 3)]
    assert groups == [([0, 2, 4, 1, 3, 5], [0]), ([0, 2, 4], [1, 2])]


def test_search_as_by_brute_force(spark):
    """Many equal vectors and queries; filters that name one document, a company and a year, alone and together."""
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(7)] + [[0.0] * 4]
    rows = [(n, vectors[rng.randrange(8)], f"d{n % 30}", f"Nation_{n % 4}", 2000 + n % 3 if n % 9 else None) for n in range(300)]
    asked = [(q, vectors[q % 5], f"d{q}" if q % 4 == 0 else None, "nation_1" if q % 3 == 0 else None, 2001 if q % 2 else 0) for q in range(24)]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = set()
    for q, qvec, doc, company, year in asked:
        fits = [r for r in rows if (not doc or r[2] == doc) and (not company or company in r[3].lower()) and (not year or r[4] == year)]
        scored = sorted((-round(float(unit(r[1]) @ unit(qvec)), 6) if any(r[1]) else 9.0, r[0]) for r in fits)[:5]
        want |= {(q, i, None if s == 9.0 else -s, k) for k, (s, i) in enumerate(scored, 1)}
    table = spark.createDataFrame(rows, "id long, embedding array<float>, doc_name string, company string, fiscal_year int")
    queries = spark.createDataFrame(asked, "qid long, qvec array<double>, q_doc_name string, q_company string, q_fiscal_year int")
    found = search.vector_ranks(table, queries, 5, filters=search.BY_FILING).collect()
    shown = lambda rows: sorted((q, k, i, s is None or round(s, 5)) for q, i, s, k in rows)
    assert shown((r["qid"], r["id"], r["score"], r["rank"]) for r in found) == shown(want)


def test_rows_that_name_their_vector_are_found_alike_and_each_vector_is_scored_once(spark):
    rng = random.Random(6)
    vectors = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(40)] + [[0.0] * 4, None]
    rows = [(n, vectors[rng.randrange(42)], f"d{n % 30}", f"Nation_{n % 4}", 2000 + n % 3 if n % 9 else None) for n in range(3000)]
    table = spark.createDataFrame(rows, "id long, embedding array<float>, doc_name string, company string, fiscal_year int").repartition(6, "id")
    asked = spark.createDataFrame([(q, vectors[q], f"d{q}" if q % 4 == 0 else None, "nation_1" if q % 3 == 0 else None, 2001 if q % 2 else 0) for q in range(24)], "qid long, qvec array<double>, q_doc_name string, q_company string, q_fiscal_year int")
    named, held = search.numbered(table)
    assert held.count() == 41 and "embedding" not in named.columns
    shown = lambda found: sorted((r["qid"], r["rank"], r["id"], r["score"] is None or round(r["score"], 5)) for r in found.collect())
    assert shown(search.vector_ranks(named, asked, 5, filters=search.BY_FILING, vectors=held)) == shown(search.vector_ranks(table, asked, 5, filters=search.BY_FILING))
    # Rows come in order of their vectors, so no vector is in two tasks.
    seen = search.with_vectors(named.select("id", search.NUMBER), held).withColumn("task", F.spark_partition_id()).groupBy("embedding").agg(F.count_distinct("task").alias("n"))
    assert seen.where("n > 1").count() == 0
    many = named.select("id", search.NUMBER).repartition(200, "id")
    assert search.with_vectors(many, held.repartition(200, search.NUMBER)).rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism


def test_equal_queries_come_to_the_driver_once_and_vectors_as_matrices(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_QUERIES", 4)
    asked = spark.createDataFrame([(n, [float(n % 3), 1.0]) for n in range(12)] + [(None, [0.0, 1.0])], "qid long, qvec array<float>")
    blocks = list(search._blocks(asked, ["qvec"]))
    assert len(blocks) > 1 and all(isinstance(b["qvec"], np.ndarray) for b in blocks) and {q for b in blocks for q in b["qid"]} == {None, *range(12)}
    (block,) = search._blocks(search._once(asked, ["qvec"]), ["qvec"])
    assert isinstance(block["qvec"], np.ndarray) and sorted(len(q) for q in block["qid"]) == [4, 4, 5]
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "id long, embedding array<float>")
    found = {r["qid"]: r["id"] for r in search.vector_ranks(rows, asked, 1).collect()}
    assert found == {None: 1} | {n: 2 if n % 3 == 2 else 1 for n in range(12)}  # (1, 1) is as near to both: the smaller id


def test_cover_in_rounds_of_any_size_is_the_greedy_one(spark, monkeypatch):
    """As by brute force, with all questions on the driver (one round) and with few of them at once."""
    rng = random.Random(3)
    needs = {q: {f"d{rng.randrange(30)}" for _ in range(rng.randrange(1, 7))} for q in range(80)}
    left, want = set().union(*needs.values()), []
    named = {d: sum(d in own for own in needs.values()) for d in left}
    while left:
        gain = {d: sum(own & left == {d} for own in needs.values()) for d in left}
        best = max(left, key=lambda d: (gain[d], named[d], d))
        want.append((best, gain[best], named[best]))
        left.discard(best)
    table = spark.createDataFrame([(q, d) for q, own in needs.items() for d in own], "qid long, doc string")
    rounds, take = [], corpus._take
    monkeypatch.setattr(corpus, "_take", lambda *a: rounds.append(1) or take(*a))
    assert corpus.greedy_cover(table) == want and len(rounds) == 1
    monkeypatch.setattr(corpus, "DRIVER_PAIRS", 60)
    assert corpus.greedy_cover(table) == want and 1 < len(rounds) < 20
    assert corpus.greedy_cover(table, 5) == want[:5]


def test_cover_of_linked_questions_needs_few_rounds(spark, monkeypatch):
    """Questions that are left out of a round end it only where they would change the order; ids may be of any type."""
    items = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet")
    rounds, take = [], corpus._take
    monkeypatch.setattr(corpus, "_take", lambda *a: rounds.append(1) or take(*a))
    cover = lambda kind: corpus.greedy_cover(items.select(F.col("l_partkey").cast(kind).alias("qid"), F.col("l_suppkey").cast("string").alias("doc")))
    want = cover("long")
    assert len(want) == 1000 and len(rounds) == 1
    monkeypatch.setattr(corpus, "DRIVER_PAIRS", 133_000)
    assert cover("double") == want and 2 < len(rounds) <= 6


def test_texts_are_taken_up_by_small_chunks():
    batch = pa.RecordBatch.from_arrays([pa.array(range(64)), pa.array(["x" * 1000] * 64)], ["id", "text"])
    chunks = list(search._chunks(iter([batch, batch.slice(0, 0), batch]), 10_000))
    assert [i for c in chunks for i in c.column(0).to_pylist()] == [*range(64)] * 2
    assert max(c.nbytes for c in chunks) < 21_000 and search.TEXT_BYTES <= 8 << 20


def test_figures_of_all_answers_are_not_broadcast(spark):
    facts = spark.createDataFrame([(n, float(n)) for n in range(50)], "fact_id long, value double")
    asked = spark.createDataFrame([(1, [3.0, 7000.0]), (2, [0.5])], "qid long, targets array<double>")
    found = evaluation.figure_matches(asked, facts)
    assert sorted((r["qid"], r["target"], r["n_facts"], r["first_fact"]) for r in found.collect()) == [(1, 3.0, 1, 3), (1, 7000.0, 1, 7), (2, 0.5, 0, None)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_narrative_hits_are_scored_in_tasks(spark):
    """The evidence's trigrams are made once for all of its hits, not once for each."""
    asked = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "x y")], "qid long, evidence_text string")
    hits = spark.createDataFrame([(1, 1, "A b c!", 7, "d"), (1, 2, "z a b c d", 8, "e"), (1, 3, "a b c d", 9, "f"), (2, 1, "a b c", 1, "d"), (3, 1, None, 1, "d")], "qid long, rank int, text string, page_start int, doc_name string")
    found = evaluation.score_narrative(asked, hits)
    assert sorted(map(tuple, found.collect())) == [(1, 1.0, 2, 8, "e"), (2, 0.0, None, None, None), (3, 0.0, None, None, None)]
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_positions_are_looked_up(monkeypatch):
    """The rank of words together is that of the plain formula, without its work for each pair."""

    def plain(held):
        total = None
        for k, own in enumerate(held):
            for a, b in ((a, b) for other in held[:k] for a in own for b in other if a != b):
                near = np.float32(1e-30) if abs(a - b) > 100 else np.float32(1.0 / (1.005 + 0.05 * np.exp(float(np.float32(abs(a - b))) / 1.5 - 2)))
                one = np.float32(np.sqrt(float(np.float32(np.float32(fulltext.WEIGHT * fulltext.WEIGHT) * near))))
                total = one if total is None else np.float32(1.0 - (1.0 - float(total)) * (1.0 - float(one)))
        return float(np.float32(1e-20) if total is None else total)

    rng = random.Random(3)
    cases = [[sorted(rng.randrange(1, top) for _ in range(rng.randrange(1, 30))) for _ in range(n)] for top in (5, 60, 16383) for n in (1, 2, 3) for _ in range(5)]
    want = [plain(c) for c in cases]
    fulltext.pair_scores()
    monkeypatch.setattr(fulltext.math, "exp", None)
    assert [fulltext.rank_all(c) for c in cases] == want


def test_texts_of_one_partition_are_dealt_to_many_tasks(spark):
    rows = spark.createDataFrame([(n, f"net sales of {n} companies") for n in range(60)], "id long, text string").coalesce(1)
    found = fulltext.postings(rows)
    assert found.groupBy("lexeme").count().where("lexeme = 'sale'").first()["count"] == 60
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 6
