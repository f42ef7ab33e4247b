import random
import threading

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import evaluation, grounding, scope, search
from ledgerlens.plans import answer, chat, retrieve
from ledgerlens.sources import load, versions

DOCS = "doc_id long, doc_name string, company string, fiscal_year int"


def filings(spark):
    return spark.createDataFrame([(1, "ACME_2018_10K", "ACME", 2018), (2, "ACME_2019_10K", "ACME", 2019), (3, "BIG CO_2018_10K", "BIG CO", 2018)], DOCS)


LINES = [
    (1, 0, "What was Acme revenue in FY2018?"), (1, 2, "and 2019?"), (1, 4, "   "), (1, 6, "What about Big Co?"), (1, 8, "/context"), (1, 10, "now tell me in many more words about the revenue of that year"), (1, 12, "/reset"), (1, 14, "and now?"),
    (2, 0, "and FY2018?"), (2, 1, None), (2, 2, "Big Co please"), (3, 0, "/quit"),
]
CARRIED = [
    (1, 0, "What was Acme revenue in FY2018?", "What was Acme revenue in FY2018?", "ACME", 2018), (1, 2, "and 2019?", "What was Acme revenue in FY2018? and 2019?", "ACME", 2019),
    (1, 6, "What about Big Co?", "and 2019? What about Big Co?", "BIG CO", 2019), (1, 10, LINES[5][2], LINES[5][2], "BIG CO", 2019), (1, 14, "and now?", "and now?", None, None),
    (2, 0, "and FY2018?", "and FY2018?", None, 2018), (2, 2, "Big Co please", "and FY2018? Big Co please", "BIG CO", 2018),
]
SCHEMA = "conv_id long, turn long, question string"
COLUMNS = ["conv_id", "turn", "question", "search_text", "company", "fiscal_year"]


def rows_of(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def test_scope_and_topic_are_carried_from_turn_to_turn(spark):
    lines = chat.stated(spark.createDataFrame(LINES, SCHEMA), filings(spark))
    assert rows_of(chat.carried(lines)) == sorted(CARRIED, key=str)
    asked = {r["qid"]: r for r in chat.asked(chat.carried(lines)).collect()}
    assert asked["1/0"]["kind"] == "numeric" and asked["1/6"]["kind"] == "narrative" and asked["1/6"]["k_chunks"] == 10
    assert chat.carried(lines.limit(0)).count() == 0


def test_a_stream_carries_as_a_batch_does(spark, tmp_path):
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    for part in (LINES[:2], LINES[2:6], LINES[6:]):  # conversations go on from batch to batch
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        lines = chat.stated(spark.readStream.schema(SCHEMA).parquet(source), filings(spark))
        chat.carried_stream(lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert rows_of(spark.read.parquet(out)) == sorted(CARRIED, key=str)


def evidence(spark):
    facts = spark.createDataFrame(
        [(11, 1, 0, "Net sales", "2018", "100", 100.0, None, 3, "ACME net sales 2018 100", [1.0, 0.0]), (12, 2, 0, "Net sales", "2019", "120", 120.0, None, 4, "ACME net sales 2019 120", [1.0, 0.1]), (13, 3, 0, "Net sales", "2018", "7", 7.0, "millions", 5, "BIG net sales 7", [0.0, 1.0])],
        "fact_id long, doc_id long, table_ordinal int, row_label string, column_label string, value_raw string, signed double, scale string, page int, fact_text string, embedding array<double>",
    )
    chunks = spark.createDataFrame([(21, 1, "prose", "Item 1", ["A"], 1, None, "ACME grew", [1.0, 0.0])], "chunk_id long, doc_id long, kind string, item_section string, heading_trail array<string>, page_start int, table_ordinal int, text string, embedding array<double>")
    return facts, chunks


def test_turns_reach_retrieval_in_their_scope(spark, tmp_path):
    facts, chunks = evidence(spark)
    embed = lambda asked: asked.withColumn("qvec", F.array(F.lit(1.0), F.lit(0.0)))
    lines = chat.stated(spark.createDataFrame(LINES, SCHEMA), filings(spark))
    want = {(r["conv_id"], r["turn"]): r["answer"] for r in chat.answers(chat.carried(lines), filings(spark), facts, chunks, embed).collect()}
    assert want[1, 0] == "The figure is 100.0 [F11]." and want[1, 2] == "The figure is 120.0 [F12]." and want[2, 2] == "The figure is 7.0 millions [F13]."
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    spark.createDataFrame(LINES, SCHEMA).coalesce(1).write.parquet(source)
    streamed = chat.stated(spark.readStream.schema(SCHEMA).parquet(source), filings(spark))
    chat.answer_stream(streamed, filings(spark), facts, chunks, embed, out, state).trigger(availableNow=True).start().awaitTermination()
    assert {(r["conv_id"], r["turn"]): r["answer"] for r in spark.read.parquet(out).collect()} == want


def test_budgets_can_be_set_and_rows_have_notes(spark):
    facts, chunks = evidence(spark)
    asked = spark.createDataFrame([(1, "What was net sales of Acme in FY2018?", [1.0, 0.0], "It was 100", "ACME_2018_10K"), (2, "Describe Big Co", [0.0, 1.0], "because of growth in all markets", "x"), (3, "How much was it at Acme?", [1.0, 0.0], "5,000.5 or 6", "y")], "qid long, question string, qvec array<double>, answer string, oracle_doc string")
    routed = retrieve.routed(asked.select("qid", "question", "qvec"), filings(spark), k_facts=1, k_chunks=0)
    assert {(r["k_facts"], r["k_chunks"]) for r in routed.collect()} == {(1, 0)}
    labels = asked.select("qid", "answer", "oracle_doc", F.when(F.col("qid") == 2, "narrative").otherwise("direct").alias("group"))
    rows = {r["qid"]: r for r in retrieve.answer_rows(retrieve.answers(routed, filings(spark), facts, chunks), labels).collect()}
    assert [rows[q]["outcome"] for q in (1, 2, 3)] == ["correct", "unscored", "wrong"] and rows[1]["oracle_doc"] == "ACME_2018_10K"
    assert [rows[q]["note"] for q in (1, 2, 3)] == ["", "overlap 0.00", "expected 6, 5000.5, said 100"] and all(r["seconds"] >= 0 and r["n_facts"] == 1 and r["n_chunks"] == 0 for r in rows.values())


def test_the_groups_of_an_evaluation_are_those_of_the_whole(spark):
    facts, chunks = evidence(spark)
    asked = [(1, "What was net sales of Acme in FY2018?", [1.0, 0.0], "It was 100", "sales of 100 and 7", "ACME_2018_10K"), (2, "Describe Acme", [1.0, 0.0], "growth", "ACME grew", "ACME_2018_10K"), (3, "Ratio of Big Co?", [0.0, 1.0], "4", "100 and 7", "BIG CO_2018_10K")]
    questions = spark.createDataFrame(asked, "qid long, question string, qvec array<double>, answer string, evidence_text string, oracle_doc string")
    run = lambda **k: retrieve.evaluate(questions, filings(spark), facts, chunks, **k)
    whole = sorted(map(str, run().collect()))
    parts = [sorted(map(str, run(groups=g).collect())) for g in (("direct",), ("computed",), ("narrative",), ("direct", "narrative"))]
    assert sorted(sum(parts[:3], [])) == whole and sorted(parts[0] + parts[2]) == parts[3] and all(len(p) == 3 for p in parts[:3])
    counted = retrieve.judged(questions, filings(spark), groups=("computed",)).select("qid", F.size("wanted").alias("n")).collect()
    assert [tuple(r) for r in counted] == [(3, 2)]


def test_errors_and_ungrounded_answers_have_their_reason(spark):
    rows = spark.createDataFrame([(1, "direct", None, 0, [1.0], "1", [], "TimeoutError('x')"), (2, "direct", "9 [F9]", 1, [1.0], "1", ["first", "second"], None), (3, "direct", "no number", 0, [1.0], "1", [], None), (4, "direct", grounding.REFUSAL, 0, [1.0], "1", [], None)], "qid int, group string, answer string, n_problems int, expected array<double>, label string, problems array<string>, error string")
    assert [r["note"] for r in grounding.with_note(grounding.outcome(rows)).orderBy("qid").collect()] == ["TimeoutError('x')", "first", "answered with no figure", ""]


def test_problems_are_told_in_order_and_as_often_as_they_occur(spark):
    answers = spark.createDataFrame([(1, "5 and 5 and 4 [F3] [F2]", ["F1"], [1.0])], "qid int, answer string, ids array<string>, supplied array<double>")
    (row,) = answer.checked(answers.select("qid", "answer"), answers.select("qid", "ids", "supplied")).collect()
    assert row["problems"] == ["fabricated citation: F2", "fabricated citation: F3", "ungrounded figure: 5", "ungrounded figure: 5", "ungrounded figure: 4"]


def test_figures_against_all_facts(spark):
    draw = random.Random(1)
    values = [draw.choice([0.0, 5.0, draw.uniform(0, 50), draw.uniform(0, 50_000), 1234.5]) * draw.choice([1, -1]) for _ in range(300)]
    targets = {q: [draw.choice([0.0, 1234.5, 1.2345, 5.0, 0.005, draw.choice(values), abs(draw.choice(values)) / 1000, draw.choice(values) * 1000 + 0.009]) for _ in range(3)] for q in range(40)}
    same = lambda t, f: abs(t - f) < 0.01 or abs(t * 1000 - f) < 0.01 or abs(t / 1000 - f) < 1e-6
    want = sorted((q, t, sum(same(t, abs(v)) for v in values), min((k for k, v in enumerate(values) if same(t, abs(v))), default=None)) for q, own in targets.items() for t in set(own))
    facts = spark.createDataFrame([*enumerate(values), (900, None), (901, float("nan"))], "fact_id long, value double")
    found = evaluation.figure_matches(spark.createDataFrame([*targets.items(), (77, []), (78, None)], "qid long, targets array<double>"), facts)
    assert sorted(map(tuple, found.collect())) == want


@pytest.mark.parametrize("block", [200_000, 7])
def test_the_longest_of_very_many_names(spark, monkeypatch, block):
    monkeypatch.setattr(scope, "BLOCK_NAMES", block)
    draw = random.Random(2)
    names = sorted({"".join(draw.choice("AB") for _ in range(draw.randint(2, 9))) for _ in range(60)}) + ["AB"]
    texts = ["".join(draw.choice("ABC") for _ in range(draw.randint(0, 40))) for _ in range(80)]
    known = spark.createDataFrame([(n, f"of {n}") for n in names] + [("", "nothing"), ("C", None)], "name string, value string")
    asked = spark.createDataFrame([*enumerate(texts), (500, None)], "qid long, text string")
    found = {r["qid"]: r["v"] for r in asked.select("qid", scope.longest_name(F.col("text"), known).alias("v")).collect()}
    best = {k: max((n for n in names if n in t), key=lambda n: (len(n), n), default=None) for k, t in enumerate(texts)}
    assert found == {k: n and f"of {n}" for k, n in best.items()} | {500: None}
    assert scope.longest_name(F.col("text"), known.limit(0)) is None


def test_rows_meet_only_queries_that_may_have_them():
    import numpy as np
    import pyarrow as pa

    draw = random.Random(3)
    asked = {"qid": list(range(50)), "y": [draw.choice([None, 0, 1, 2]) for _ in range(50)], "c": [draw.choice([None, "", "al", "B%a", "beta"]) for _ in range(50)]}
    rows = [(draw.choice([None, 1, 2, 3]), draw.choice([None, "Alpha", "BETA", "gamma"])) for _ in range(70)]
    index = search.Filters(equal={"year": "y"}, contains={"company": "c"}).index(asked)
    seen = np.zeros((70, 50), bool)
    for own, queries in index.groups([pa.array([y for y, _ in rows], pa.int32()), pa.array([c for _, c in rows])], 70):
        assert not seen[np.ix_(own, queries)].any()
        seen[np.ix_(own, queries)] = True
    want = [[(not y or y == year) and (not c or (company is not None and search._ilike(company, c))) for y, c in zip(asked["y"], asked["c"], strict=True)] for year, company in rows]
    assert seen.tolist() == want


def test_rank_of_the_first_close_value(spark):
    draw = random.Random(4)
    rows = [(k, [draw.uniform(-1, 1), draw.uniform(-1, 1)], float(draw.randint(-5, 5))) for k in range(400)] + [(900, None, 3.0), (901, [1.0, 1.0], None)]
    queries = [(q, [draw.uniform(-1, 1), 1.0], [float(q % 7), 99.0]) for q in range(12)] + [(50, [1.0, 0.0], []), (51, [1.0, 0.0], None), (52, [0.0, 1.0], [77.0])]
    found = search.first_close(spark.createDataFrame(rows, "id long, embedding array<double>, v double"), spark.createDataFrame(queries, "qid long, qvec array<double>, targets array<double>"), "v", "targets")
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 6)
    want = {}
    for q, vector, targets in queries:
        order = sorted((-cosine(e, vector), k, v) for k, e, v in rows if e)
        want[q] = next((n for n, (_, _, v) in enumerate(order, 1) if v is not None and any(abs(abs(v) - t) < 0.01 for t in targets or [])), None)
    assert {r["qid"]: r["rank"] for r in found.collect()} == want


# Commits.


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def test_commits_name_whole_states_and_stay_readable(spark, tmp_path):
    path = str(tmp_path)
    held = lambda name, number=None: sorted(r["v"] for r in versions.read(spark, path, name, number).collect())
    assert versions.latest(spark, path) == 0
    assert versions.commit(spark, path, {"a": numbers(spark, 1), "b": numbers(spark, 2)}) == 1 and versions.commit(spark, path, {"a": numbers(spark, 3)}) == 2
    assert held("a") == [3] and held("b") == [2] and held("a", 1) == [1]
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, {"a": numbers(spark, 9)}, base=1)
    assert held("a") == [3] and len(list(tmp_path.glob("v-*"))) == 2 and not list(tmp_path.glob("draft-*"))
    assert versions.commit(spark, path, {"b": numbers(spark, 4)}) == 3 and versions.clean_up(spark, path, keep=1) == [1, 2]
    assert held("a") == [3] and held("b") == [4] and len(list(tmp_path.glob("v-*/*"))) == 2
    with pytest.raises(KeyError):
        versions.read(spark, path, "c")


def test_racing_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path)
    versions.commit(spark, path, {"a": numbers(spark, 0)})
    ready = threading.Barrier(2)
    conflicts = []

    def add(value):
        tries = []

        def change(read):
            rows = read("a").unionByName(numbers(spark, value))
            if not tries:
                ready.wait(60)  # both start from the same commit
            tries.append(1)
            return {"a": rows}

        versions.update(spark, path, change)
        conflicts.append(len(tries) - 1)

    writers = [threading.Thread(target=add, args=(v,)) for v in (1, 2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(r["v"] for r in versions.read(spark, path, "a").collect()) == [0, 1, 2] and sorted(conflicts) == [0, 1]


def test_a_whole_load_in_one_commit(spark, tmp_path):
    path = str(tmp_path / "db")
    doc, chunk = "doc_name string, company string, doc_type string, fiscal_year int", "doc_name string, kind string, item_section string, heading_trail array<string>, page_start int, table_ordinal int, text string"
    fact = "doc_name string, table_ordinal int, row_label string, column_label string, value_raw string, value double, parenthesized boolean, scale string, page int"
    empty = lambda schema: spark.createDataFrame([], schema)
    tables = {
        "documents": empty("doc_id long, " + doc + ", ingested_at timestamp"), "chunks": empty("chunk_id long, doc_id long, kind string, item_section string, heading_trail array<string>, page_start int, table_ordinal int, text string, embedding array<double>"),
        "facts": empty("fact_id long, doc_id long, chunk_id long, " + fact.split(", ", 1)[1] + ", signed double, fact_text string, embedding array<double>"),
    }
    versions.commit(spark, path, tables)
    documents = spark.createDataFrame([("A_2018", "A", "10K", 2018)], doc)
    chunks = spark.createDataFrame([("A_2018", "table", "Item\x00 8", ["x", "Balance\x00 sheet:"], 1, 0, "cells"), ("A_2018", "table", None, ["again"], 1, 0, "cells"), ("A_2018", "prose", None, None, 2, None, "te\x00xt"), ("A_2018", "prose", None, None, 2, None, " \x00 ")], chunk)
    facts = spark.createDataFrame([("A_2018", 0, "Net sales", "2018", "(5)", 5.0, True, None, 1), ("A_2018", 0, "Net sales", "2018", "6", 6.0, False, None, 1), ("A_2018", 3, "Other", "2018", "7", 7.0, False, "millions", 1)], fact)
    loads = spark.sparkContext.accumulator(0)
    texts = spark.sparkContext.accumulator(0)

    def model():
        loads.add(1)

        def encode(own):
            texts.add(len(own))
            return [[float(len(t))] for t in own]

        return encode

    embed = load.embedder(model, batch_chars=10)
    assert load.load(spark, path, documents, chunks, facts, embed, dry_run=True) == {"documents": 1, "chunks": 2, "facts": 2, "cache": 4} and versions.latest(spark, path) == 1 and texts.value == 0
    assert load.load(spark, path, documents, chunks, facts, embed) == {"documents": 1, "chunks": 2, "facts": 2, "cache": 4} and versions.latest(spark, path) == 2 and texts.value == 4
    rows = versions.read(spark, path, "facts").orderBy("row_label").collect()
    assert rows[0]["fact_text"].startswith("A · Balance sheet · Net sales · 2018 · ") and rows[0]["chunk_id"] is not None and rows[1]["chunk_id"] is None and rows[1]["fact_text"] == "A · Other · 2018 · 7 millions"
    assert all(r["embedding"] == [float(len(r["fact_text"]))] and r["signed"] == (-r["value"] if r["parenthesized"] else r["value"]) for r in rows)
    before = texts.value
    again = load.load(spark, path, documents, chunks, facts.limit(1), embed)
    assert again["facts"] == 1 and again["documents"] == 1 and texts.value == before  # every text was known
    assert load.load(spark, path, documents, chunks.limit(0), facts, embed, facts_only=True)["chunks"] == 2
    assert load.violations(*[versions.read(spark, path, n) for n in ("documents", "chunks", "facts")]).count() == 0


def test_scopes_of_a_year_without_rows_go_with_the_first_search(spark, monkeypatch):
    documents = spark.createDataFrame([(1, "a1", "A_ONE", 2020), (2, "b1", "B", 2021)], "doc_id long, doc_name string, company string, fiscal_year int")
    facts = spark.createDataFrame([(n, doc, 0, "Net sales", "2020", 1.0, None, n, f"f{n}", v) for n, doc, v in ((1, 1, [1.0, 0.0]), (2, 1, [0.0, 1.0]), (3, 2, [1.0, 1.0]))], "fact_id long, doc_id long, table_ordinal int, row_label string, column_label string, signed double, scale string, page int, fact_text string, embedding array<double>")
    chunks = spark.createDataFrame([(1, 2, "prose", "Item 1", None, 4, "text", [1.0, 0.0])], "chunk_id long, doc_id long, kind string, item_section string, heading_trail array<string>, page_start int, text string, embedding array<double>")
    scopes = {1: ("A_ONE", 2020), 2: ("A_ONE", 2060), 3: (None, 2060), 4: ("a%e", 2020), 5: ("B\\", 2021), 6: ("B", None), 7: ("A_ONE", 2021), 8: (None, 0)}
    asked = spark.createDataFrame([(q, "?", [1.0, 0.0], c, y, "numeric", 2, 1, "?", None) for q, (c, y) in scopes.items()], "qid long, question string, qvec array<double>, company string, fiscal_year int, kind string, k_facts int, k_chunks int, search_text string, metric string")
    searches, once = [], retrieve._search_both
    monkeypatch.setattr(retrieve, "_search_both", lambda first, *rest: searches.append(sorted(r["qid"] for r in first.collect())) or once(first, *rest))
    used, hits, passages, _ = retrieve.retrieve(asked, documents, facts, chunks)
    assert {r["qid"]: r["fiscal_year"] for r in used.collect()} == {1: 2020, 2: None, 3: None, 4: 2020, 5: None, 6: None, 7: None, 8: 0}
    assert sorted((r["qid"], r["rank"], r["fact_id"]) for r in hits.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 1, 1), (3, 2, 3), (4, 1, 1), (4, 2, 2), (6, 1, 3), (7, 1, 1), (7, 2, 2), (8, 1, 1), (8, 2, 3)]
    assert sorted((r["qid"], r["chunk_id"]) for r in passages.collect()) == [(3, 1), (6, 1), (8, 1)]
    assert searches == [[1, 2, 3, 4, 5, 6, 7, 8]]


def test_facts_that_are_searched_travel_without_their_vectors(spark, monkeypatch):
    from ledgerlens.plans import queries

    joined, with_vector = [], queries._with_vector
    monkeypatch.setattr(queries, "_with_vector", lambda s, d, rows, *a: joined.append(rows.columns) or with_vector(s, d, rows, *a))
    assert queries.QUERIES["search_facts_filtered"](spark, "/root/testdata/sf0.01").count() > 0
    assert joined and not any("fact_id" in columns for columns in joined)


def test_only_first_fits_meet_their_texts(spark, monkeypatch):
    from ledgerlens.plans import queries

    held, settled = [], retrieve.settled
    monkeypatch.setattr(retrieve, "settled", lambda frame: held.append(set(frame.columns)) or settled(frame))
    assert queries.QUERIES["evaluation_rows"](spark, "/root/testdata/sf0.001").count() > 0
    assert any("signed" in columns for columns in held) and not any({"signed", "fact_text"} <= columns for columns in held)
