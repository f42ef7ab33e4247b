import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import corpus, evaluation, grounding, inspection, metrics, scope, search
from ledgerlens.plans import answer


def test_filters_compose(spark):
    rows = spark.createDataFrame([("prose", "3M", "1", "a", 2018), ("table", "3M Co", "7", "a", 2018), ("prose", "AMD", "7", "ab", 2019)], "kind string, company string, item_section string, doc_name string, fiscal_year int")
    count = lambda **k: rows.where(search.filters(**k)).count()
    assert count() == 3 and count(company="3m") == 2 and count(kind="prose", company="3m") == 1
    assert count(doc_name="a") == 2 and count(fiscal_year=2019) == 1 and count(fiscal_year=0) == 3 and count(item="7", company="a%") == 1


def test_filter_comes_before_the_cut_and_nulls_are_left_out(spark):
    rows = spark.createDataFrame([(n, [1.0, float(n)], n % 50) for n in range(200)] + [(999, None, 3)], "id long, embedding array<float>, label int")
    found = search.vector_search(rows, [1.0, 0.0], 3, where=F.col("label") == 3).collect()
    assert [r["id"] for r in found] == [3, 53, 103]


def test_fusion_prefers_the_earlier_list_on_ties(spark):
    lists = [spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid int, id int, rank int"), spark.createDataFrame([(1, 12, 1), (1, 11, 3)], "qid int, id int, rank int")]
    assert [r["id"] for r in search.fuse(lists, 3).orderBy("rank").collect()] == [11, 10, 12]
    assert search.depth(5) == 20 and search.depth(15) == 30


def test_zero_vectors_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<float>")
    assert [(r["id"], r["score"]) for r in search.vector_search(rows, [1.0, 0.0], 5).collect()] == [(2, 1.0), (1, None)]
    assert search.vector_search(rows.limit(0), [1.0, 0.0], 5).count() == 0


def test_scope_is_longest_name_first_then_alias(spark):
    asked = spark.createDataFrame([(1, "sales of Nation_12 in FY2020"), (2, "Coke and 2021"), (3, "nothing"), (4, "FY2023 margin"), (5, "Pepsi")], "qid int, question string")
    names = spark.createDataFrame([("NATION_1",), ("NATION_12",), ("3M",), ("COCACOLA",)], "company string")
    aliases = spark.createDataFrame([("Coke", "COCACOLA"), ("Pepsi", "PEPSICO")], "alias string, company string")
    found = {r["qid"]: (r["company"], r["fiscal_year"]) for r in scope.resolve_scope(asked, names, aliases).collect()}
    assert found == {1: ("NATION_12", 2020), 2: ("COCACOLA", 2021), 3: (None, None), 4: ("3M", 2023), 5: (None, None)}


FACTS = "fact_id long, doc_id long, doc_name string, table_ordinal int, row_label string, column_label string, signed double, scale string, page int, company string, fiscal_year int"


def fact(n, doc, table, label, column, value, company="A", scale=None):
    return (n, doc, f"d{doc}", table, label, column, value, scale, n, company, 2018)


def test_ratio_needs_one_table(spark):
    rows = [fact(1, 1, 0, "Total current assets", "2018", 10.0), fact(2, 1, 1, "Total current liabilities", "2018", 5.0), fact(3, 2, 0, "Total current assets", "Dec 2018", 12.0, scale="millions"), fact(4, 2, 0, "Total current liabilities", "Dec 2018", 4.0), fact(5, 3, 0, "Total current assets", "2017", 1.0, "B")]
    found = metrics.compute(spark.createDataFrame(rows, FACTS), ("current ratio",)).collect()
    assert [(r["company"], r["metric"], r["doc_id"], r["value"], r["shown"], r["scale"]) for r in found] == [("A", "current ratio", 2, 3.0, "3.00", "millions")]
    assert [(i["key"], i["fact_id"], i["page"]) for i in found[0]["inputs"]] == [("current_assets", 3, 3), ("current_liabilities", 4, 4)]


def test_only_facts_of_whole_tables_are_chosen_from(spark):
    rows = [fact(1, 1, 0, "Total current assets", "2018", 10.0), fact(2, 1, 1, "Total current liabilities", "2018", 5.0), fact(3, 2, 0, "TOTAL CURRENT ASSETS", "2018", 12.0), fact(4, 2, 0, "Total current liabilities", "2018", 4.0), fact(5, 2, 0, None, "2018", 4.0)]
    wanted = {key: metrics.LINE_ITEMS[key] for key in ("current_assets", "current_liabilities")}
    kept = metrics.in_whole_tables(spark.createDataFrame(rows, FACTS), ("current ratio",), wanted, ["doc_id", "table_ordinal"])
    assert sorted(r["fact_id"] for r in kept.collect()) == [3, 4, 5]


def test_losses_stay_negative_and_a_zero_divisor_gives_nothing(spark):
    loss = [fact(1, 1, 0, "Net income", "2018", -50.0), fact(2, 1, 0, "Net sales", "2018", 200.0)]
    assert metrics.compute(spark.createDataFrame(loss, FACTS), ("net margin",)).first()["shown"] == "-25.0%"
    # The table with the better labels divides by zero; the next best is not taken instead.
    zero = [fact(1, 1, 0, "Total net sales", "2018", 0.0), fact(2, 1, 0, "Net income", "2018", 1.0), fact(3, 2, 0, "Revenue", "2018", 10.0), fact(4, 2, 0, "Net income", "2018", 1.0)]
    assert metrics.compute(spark.createDataFrame(zero, FACTS), ("net margin",)).count() == 0


def test_a_segment_line_is_no_consolidated_one(spark):
    rows = [fact(1, 1, 0, "Revenue of segment A", "2018", 5.0), fact(2, 1, 0, "Net income", "2018", 1.0), fact(3, 1, 0, "Net income from other", "2018", 1.0)]
    assert metrics.compute(spark.createDataFrame(rows, FACTS)).count() == 0


def test_equal_facts_stay_apart_in_line_items(spark):
    rows = spark.createDataFrame([("Net sales",), ("Net sales",), ("Inventory, net",), ("x",)], "row_label string")
    assert sorted((r["key"], r["place"]) for r in metrics.line_items(rows).collect()) == [("inventory", 2), ("revenue", 1), ("revenue", 1)]


def test_grounding(spark):
    rows = [(1, "It was 5 [F1]", ["F1"], [5000.0]), (2, "It was 6 [F2]", ["F1"], [5.0]), (3, "It was 5", ["F1"], [5.0]), (4, grounding.REFUSAL + " it", [], []), (5, "In 2018 and $2018 it was 2,031; 2018, has a comma [C1]", ["C1"], [])]
    found = grounding.problems(spark.createDataFrame(rows, "qid int, answer string, ids array<string>, supplied array<double>")).orderBy("qid", "problem", "detail").collect()
    assert [tuple(r) for r in found] == [(2, "fabricated citation", "F2"), (2, "ungrounded figure", "6"), (3, "no citation", ""), (5, "ungrounded figure", "2,031"), (5, "ungrounded figure", "2018,")]


def test_outcomes(spark):
    rows = [(1, "direct", grounding.REFUSAL, 0, [1.0]), (2, "direct", "1 [F1]", 1, [1.0]), (3, "narrative", "text", 0, []), (4, "direct", "none", 0, [1.0]), (5, "computed", "1,000 or 2", 0, [1.0]), (6, "direct", "3", 0, [1.0])]
    found = grounding.outcome(spark.createDataFrame(rows, "qid int, group string, answer string, n_problems int, expected array<double>")).orderBy("qid")
    assert [r["outcome"] for r in found.collect()] == ["refused", "ungrounded", "unscored", "wrong", "correct", "wrong"]
    year = spark.createDataFrame([(1, "direct", "in 2018 [F9]", 0, [2018.0]), (2, "direct", None, 0, [1.0])], "qid int, group string, answer string, n_problems int, expected array<double>")
    assert [r["outcome"] for r in grounding.outcome(year).orderBy("qid").collect()] == ["correct", "error"]


def test_p90_is_by_floor_index_and_splits_are_checked(spark):
    rows = spark.createDataFrame([(n / 24,) for n in range(24)], "best double")
    assert evaluation.overlap_summary(rows).first()["p90"] == 20 / 24
    evaluation.check_split({"direct": 70}, {"direct": 70})
    with pytest.raises(ValueError):
        evaluation.check_split({"direct": 69}, {"direct": 70})


def test_page_batches_cover_all_pages(spark):
    docs = spark.createDataFrame([("a", 25), ("b", 12), ("c", 0)], "doc string, pages int")
    rows = corpus.page_batches(docs, 12).orderBy("doc", "lo").collect()
    assert [(r["doc"], r["lo"], r["hi"]) for r in rows] == [("a", 1, 12), ("a", 13, 24), ("a", 25, 25), ("b", 1, 12)]
    assert {r["doc"]: r["complete"] for r in corpus.batches_complete(corpus.page_batches(docs, 12).where("lo <> 13 or doc <> 'a'").where("hi <> 25"), "doc").collect()} == {"a": False, "b": True}


def test_fallback_only_where_nothing_was_found(spark):
    hits = spark.createDataFrame([(1, 5)], "qid int, id int")
    loose = spark.createDataFrame([(1, 6), (2, 7)], "qid int, id int")
    assert sorted(tuple(r) for r in scope.with_fallback(hits, loose).collect()) == [(1, 5), (2, 7)]


def test_vertical_extent_of_both_origins(spark):
    box = lambda origin: tuple(spark.range(1).select(inspection.vertical_extent(F.lit(25.0), F.lit(50.0), F.lit(100.0), F.lit(origin)).alias("b")).first()["b"])
    assert box("CoordOrigin.TOPLEFT") == (0.25, 0.5) and box("CoordOrigin.BOTTOMLEFT") == (0.5, 0.75)


def test_one_failing_prompt_does_not_stop_the_others(spark):
    def model(prompt: str) -> str:
        if "bad" in prompt:
            raise RuntimeError("no")
        return prompt.upper()

    rows = answer.generate(spark.createDataFrame([(1, "good"), (2, "bad")], "qid int, prompt string"), model).orderBy("qid").collect()
    assert rows[0]["answer"] == "GOOD" and rows[0]["error"] is None and rows[1]["answer"] is None and "no" in rows[1]["error"]


def test_greedy_cover_orders_the_whole_pool(spark):
    import random

    from ledgerlens.plans.queries import QUERIES

    rng = random.Random(1)
    needs = {q: set(rng.sample([f"d{k}" for k in range(14)], rng.randrange(1, 5))) for q in range(30)}
    order, pool = [], set().union(*needs.values())
    while pool:
        scores = {d: (sum(s - {x for x, _, _ in order} == {d} for s in needs.values()), sum(d in s for s in needs.values()), d) for d in pool}
        best = max(pool, key=scores.get)
        order.append((best, *scores[best][:2]))
        pool.discard(best)
    frame = spark.createDataFrame([(q, d) for q, s in needs.items() for d in s] * 2, "qid long, doc string")
    assert corpus.greedy_cover(frame) == order and corpus.greedy_cover(frame, 3) == order[:3]
    assert corpus.greedy_cover(frame.limit(0)) == []
    assert QUERIES["greedy_cover"](spark, "/root/testdata/sf0.01").count() == 100


def test_ranks_under_filters(spark):
    rows = spark.createDataFrame([(n, [1.0, n / 10], "a" if n % 2 else None, f"Co_{n % 3}", n % 4) for n in range(1, 41)] + [(99, [0.0, 0.0], "a", "Co_1", 1), (98, [1.0], "a", "Co_1", 1)], "id long, embedding array<float>, kind string, company string, year int")
    asked = spark.createDataFrame([("p", [1.0, 0.0], "a", "co_1", None, 1), ("q", [1.0, 0.0], None, None, None, None), ("r", [1.0, 0.0], None, "none", None, None), ("s", [1.0, 0.0], None, None, 3, None)], "qid string, qvec array<float>, k string, c string, y int, own long")
    found = search.vector_ranks(rows, asked, 2, filters=search.Filters(equal={"kind": "k", "year": "y"}, contains={"company": "c"}, leave_out="own"))
    assert sorted((r["qid"], r["rank"], r["id"]) for r in found.collect()) == [("p", 1, 7), ("p", 2, 13), ("q", 1, 1), ("q", 2, 2), ("s", 1, 3), ("s", 2, 7)]
    # A zero vector is ranked last, without a score; one of another length not at all.
    last = search.vector_ranks(rows.where("id > 38"), asked.where("qid = 'q'"), 9).orderBy("rank").collect()
    assert [(r["id"], r["score"] is None) for r in last] == [(39, False), (40, False), (99, True)]


def test_queries_in_blocks_and_rows_in_slices(spark, monkeypatch):
    rows = spark.createDataFrame([(n, [float(n % 7), float(n % 5 + 1)]) for n in range(60)], "id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(n, [float(n), 1.0]) for n in range(7)], "qid long, qvec array<double>")
    whole = sorted(map(tuple, search.vector_ranks(rows, asked, 4).collect()))
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(search, "CELLS", 8)
    assert sorted(map(tuple, search.vector_ranks(rows, asked, 4).collect())) == whole and len(whole) == 28
    assert search.vector_ranks(rows, asked.limit(0), 4).count() == 0 and search.vector_ranks(rows.limit(0), asked, 4).count() == 0


def test_first_relevant_counts_what_is_before(spark):
    rows = spark.createDataFrame([(n, [1.0, n / 10], n % 4) for n in range(1, 20)], "id long, embedding array<double>, label int")
    asked = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [1.0, 0.1], 1), (3, [1.0, 0.0], 9)], "qid long, qvec array<double>, want int")
    assert {r["qid"]: r["rank"] for r in search.first_relevant(rows, asked, {"label": "want"}, leave_out="qid").collect()} == {1: 2, 2: 1, 3: None}


def test_lexical_ranks_count_words_as_often_as_they_stand(spark):
    rows = spark.createDataFrame([(1, "sales sales sales"), (2, "net sales"), (3, None), (4, "wholesales"), (5, "")], "id long, text string")
    asked = spark.createDataFrame([(1, "What were the Sales"), (2, "net sales?"), (3, "of the")], "qid long, question string")
    found = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in search.lexical_ranks(rows, asked, 5).collect()}
    assert found == {(1, 1): (1, 1.361111), (1, 2): (2, 1.0), (2, 1): (2, 1.0), (2, 2): (1, 0.680556)}


def test_p90_without_gathering_the_values(spark):
    rows = spark.createDataFrame([(x,) for x in [0.5] * 7 + [0.1, 0.9, 0.9]], "best double")
    assert [evaluation.at_index(rows, "best", s).first()["best"] for s in (0.0, 0.05, 0.5, 0.9, 1.0)] == [0.1, 0.1, 0.5, 0.9, 0.9]


def test_headline_and_order_of_outcomes(spark):
    rows = spark.createDataFrame([("direct", "correct", 1.0), ("direct", "ungrounded", 2.0), ("direct", "wrong", 9.0), ("direct", "refused", 3.0), ("narrative", "unscored", None)], "group string, outcome string, seconds double")
    assert tuple(evaluation.headline(rows).first()) == (4, 1, 2, 1, 2.5, round(15 / 3600, 6))
    shares = evaluation.outcome_shares(rows, "group", "outcome").orderBy("group", evaluation.place_of("outcome", evaluation.OUTCOMES))
    assert [r["outcome"] for r in shares.where("`group` = 'direct'").collect()] == ["correct", "wrong", "ungrounded", "refused"]


def test_subset_of_questions(spark):
    rows = spark.createDataFrame([(n, "direct" if n % 2 else "narrative") for n in range(10)], "qid int, group string")
    ids = lambda **k: sorted(r["qid"] for r in evaluation.subset(rows, "qid", **k).collect())
    assert ids(group="direct", limit=2, offset=1) == [3, 5] and ids(ids=[4, 77]) == [4] and ids(ids=[]) == [] and ids(offset=8) == [8, 9] and len(ids()) == 10


def test_narrative_overlap_takes_the_first_best_hit(spark):
    asked = spark.createDataFrame([(1, "a b c d"), (2, "x y")], "qid int, evidence_text string")
    hits = spark.createDataFrame([(1, 1, "q a b c", 4, "d4"), (1, 2, "a b c d", 5, "d5"), (1, 3, "z a b c d", 6, "d6"), (2, 1, "x y", 1, "d1")], "qid int, rank int, text string, page_start int, doc_name string")
    assert sorted(tuple(r) for r in evaluation.score_narrative(asked, hits).collect()) == [(1, 1.0, 2, 5, "d5"), (2, 0.0, None, None, None)]


def test_evidence_page_by_its_rarest_numbers(spark):
    evidence = spark.createDataFrame([(1, "100 2,000 300.5."), (2, "100 2,000 300.5."), (3, "100"), (4, "none"), (5, "555 666")], "e_id int, text string")
    pages = spark.createDataFrame([(n, "100 and") for n in range(10)] + [(20, "2,000 300.5"), (21, "2,000"), (22, "2000")], "page_id int, blob string")
    found = sorted(tuple(r) for r in inspection.evidence_pages(evidence, pages).collect())
    assert found == [(e, p, s, k) for e in (1, 2) for p, s, k in ((9, 0.333333, 3), (20, 0.666667, 1), (21, 0.333333, 2))] + [(3, 7, 1.0, 3), (3, 8, 1.0, 2), (3, 9, 1.0, 1)]


def test_the_best_so_far_keep_out_what_comes_too_late():
    import random

    import numpy as np

    rng = random.Random(2)
    best, seen = search._Best(3, 5), []
    best.room = 20
    for _ in range(60):
        ids = np.array([rng.randrange(1000) for _ in range(10)], object)
        query, row = np.array([rng.randrange(5) for _ in range(10)]), np.arange(10)
        score = np.array([rng.choice([0.1, 0.2, 0.5]) for _ in range(10)])
        seen += list(zip(query.tolist(), (-score).tolist(), ids.tolist(), strict=True))
        best.add(query, row, score, ids)
    best.prune()
    want = [x for q in range(5) for x in sorted(h for h in seen if h[0] == q)[:3]]
    assert sorted(zip(best.query.tolist(), (-best.score).tolist(), best.ids.tolist(), strict=True)) == want
