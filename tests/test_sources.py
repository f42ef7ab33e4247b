import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import ingest, io, schemas
from ledgerlens.streaming.ingest import load_stream


def test_questions_skip_blank_lines(spark, tmp_path):
    row = {"financebench_id": "q1", "question": "?", "answer": "0", "company": "A", "doc_name": "d", "evidence": [{"doc_name": "d", "evidence_text": "0", "evidence_page_num": 3}]}
    (tmp_path / "q.jsonl").write_text(json.dumps(row) + "\n\n  \n")
    found = io.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert found.count() == 1 and io.question_by_id(found, "q1").first()["evidence"][0]["evidence_page_num"] == 3
    assert io.question_by_id(found, "none").count() == 0


def test_converted_documents_cells_and_stems(spark, tmp_path):
    doc = {"pages": {"1": {"size": {"height": 10.0}}}, "tables": [{"prov": [{"page_no": 2}], "data": {"num_rows": 1, "num_cols": 2, "table_cells": [{"text": "x", "column_header": True}, {"text": "y", "column_header": False}]}}], "texts": []}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=1))
    cells = io.table_cells(io.read_converted(spark, str(tmp_path))).collect()
    assert [(c["stem"], c["page"], c["num_cols"], c["text"]) for c in cells] == [("one", 2, 2, "x"), ("one", 2, 2, "y")]
    assert [r[0] for r in io.stems(spark, str(tmp_path), "*.json").collect()] == ["one"]


def test_parts_merge_in_order(spark):
    parts = spark.createDataFrame([("a", 2, [3]), ("a", 1, [1, 2])], "doc string, lo int, texts array<int>")
    assert io.merge_parts(parts, "doc", "lo", "texts").first()["texts"] == [1, 2, 3]


def test_csv_json_and_markdown(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "x")], "a int, b string, extra string")
    io.write_csv(rows, ["a", "b"], str(tmp_path / "c"))
    io.write_csv(rows, ["a", "b"], str(tmp_path / "c"), mode="append")
    again = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert again.columns == ["a", "b"] and again.count() == 2
    io.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["a"] == 1
    assert io.markdown(rows.select("a", "b"), "T") == "## T\n\n| a | b |\n|---|---|\n| 1 |  |\n"


def test_facts_cited_view(spark):
    empty = {n: spark.createDataFrame([], s) for n, s in (("documents", schemas.DOCUMENTS), ("chunks", schemas.CHUNKS), ("facts", schemas.FACTS))}
    io.register_views(**empty)
    assert len(spark.table("facts_cited").columns) == 12


def test_upsert_keeps_old_columns(spark):
    old = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], "name string, company string, at int")
    new = spark.createDataFrame([("a", "new", 2), ("c", "new", 2)], "name string, company string, at int")
    assert sorted(tuple(r) for r in ingest.upsert_documents(old, new, "name", "at").collect()) == [("a", "old", 2), ("b", "old", 1), ("c", "new", 2)]


def test_chunks_are_unique_by_table_only(spark):
    rows = [(1, 1, "table", 0, 1, "x"), (2, 1, "table", 0, 1, "x"), (3, 1, "prose", None, 1, "y"), (4, 1, "prose", None, 1, "y"), (5, 1, "prose", None, 1, " \x00 ")]
    chunks = spark.createDataFrame(rows, "chunk_id int, doc_id int, kind string, table_ordinal int, page_start int, text string")
    assert sorted(r["chunk_id"] for r in ingest.unique_chunks(ingest.clean_chunks(chunks)).collect()) == [1, 3, 4]
    assert ingest.violations(chunks).count() == 0 and ingest.violations(chunks.withColumn("kind", F.lit(None).cast("string"))).count() == 5


def test_last_chunk_of_a_table_names_its_facts(spark):
    chunks = spark.createDataFrame([(1, 1, 0, ["a"]), (2, 1, 0, ["b", "c"]), (3, 1, None, ["d"])], "chunk_id int, doc_id int, table_ordinal int, heading_trail array<string>")
    facts = spark.createDataFrame([(9, 1, 0), (10, 1, 7)], "fact_id int, doc_id int, table_ordinal int")
    found = {r["fact_id"]: (r["chunk_id"], r["context"]) for r in ingest.with_heading(facts, chunks).collect()}
    assert found == {9: (2, "c"), 10: (None, None)}


def test_only_missing_texts_are_embedded(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, text string")
    cache = spark.createDataFrame([("a",)], "t string").select(F.md5("t").alias("digest"), F.array(F.lit(1.0)).alias("embedding"))
    asked = []

    def embed(misses):
        asked.append(misses.count())
        return misses.select("digest", F.array(F.lit(2.0)).alias("embedding"))

    done, full = ingest.embed_missing(rows, cache, embed)
    assert sorted((r["id"], r["embedding"][0]) for r in done.collect()) == [(1, 1.0), (2, 2.0), (3, 2.0)] and asked == [1] and full.count() == 2


def test_stream_replaces_documents_and_goes_on_where_it_stopped(spark, tmp_path):
    schema = "chunk_id long, doc_id long, page_start int, text string"
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    put = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
    put([(1, 1, 1, "one"), (2, 1, 1, " "), (3, 2, 1, "two")])
    load_stream(spark, source, target, state, schema).awaitTermination()
    put([(4, 1, 1, "new")])
    load_stream(spark, source, target, state, schema).awaitTermination()
    load_stream(spark, source, target, state, schema).awaitTermination()
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(target).collect()) == [(1, "new"), (2, "two")]


def test_write_by_document_leaves_other_documents(spark, tmp_path):
    path = str(tmp_path / "t")
    ingest.write_by_document(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string"), path, "doc_id")
    ingest.write_by_document(spark.createDataFrame([(2, "c")], "doc_id int, text string"), path, "doc_id")
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_tables_as_grids(spark, tmp_path):
    cells = spark.createDataFrame([("s", 0, 2, 1, 1, "d"), ("s", 0, 2, 0, 0, "a"), ("s", 0, 2, 0, 1, None), ("s", 0, 2, 1, 0, "c,1")], "stem string, table_ordinal int, num_cols int, start_row_offset_idx int, start_col_offset_idx int, text string")
    grid = io.table_grid(cells)
    assert [(r["row"], r["cells"]) for r in grid.orderBy("row").collect()] == [(0, ["a", ""]), (1, ["c,1", "d"])]
    io.write_table_csv(grid, 2, str(tmp_path / "t"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "t")).collect()] == [("a", None), ("c,1", "d")]


def test_results_survive_a_run_that_stops(spark, tmp_path):
    rows = spark.createDataFrame([(n,) for n in range(20)], "id int")
    calls = []

    def run(part):
        calls.append(part.count())
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return part.withColumn("twice", F.col("id") * 2)

    path = str(tmp_path / "out")
    try:
        io.write_csv_in_parts(rows, "id", ["id", "twice"], path, run, 4)
    except RuntimeError:
        pass
    kept = spark.read.option("header", True).csv(path).count()
    done = io.write_csv_in_parts(rows, "id", ["id", "twice"], path, lambda part: part.withColumn("twice", F.col("id") * 2), 4)
    assert 0 < kept < 20 and sorted((r["id"], r["twice"]) for r in done.collect()) == [(n, 2 * n) for n in range(20)]


def test_report_and_tables_that_are_there(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.12345)], "k string, v double")
    said = io.report("Run", ["note"], {"one": rows, "none": rows.limit(0)})
    assert said == "# Run\n\nnote\n\n## one\n\n| k | v |\n|---|---|\n| a | 0.123 |\n"
    io.create_tables(spark, str(tmp_path))
    spark.createDataFrame([(1, "d")], "doc_id long, doc_name string").selectExpr("doc_id", "doc_name", *[f"cast(null as {t}) as {n}" for n, t in (x.split(" ", 1) for x in schemas.DOCUMENTS.split(", ")[2:])]).write.mode("append").parquet(str(tmp_path / "documents"))
    io.create_tables(spark, str(tmp_path))
    assert spark.table("documents").count() == 1 and spark.table("facts_cited").count() == 0


def test_tables_are_committed_together(spark, tmp_path):
    path = "file://" + str(tmp_path)
    put = lambda n: {"chunks": spark.range(n), "facts": spark.range(2 * n)}
    ingest.commit_together(put(2), path)
    ingest.commit_together(put(3), path)
    bad = {"chunks": spark.range(9), "facts": spark.range(9).select(F.raise_error(F.lit("no")).alias("id"))}
    try:
        ingest.commit_together(bad, path)
    except Exception:
        pass
    assert ingest.read_current(spark, path, "chunks").count() == 3 and ingest.read_current(spark, path, "facts").count() == 6


def test_deleting_documents_and_chunks(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id int")
    facts = spark.createDataFrame([(10, 1, 5), (11, 2, 6), (12, 2, None)], "fact_id int, doc_id int, chunk_id int")
    left = ingest.delete_documents(docs.where("doc_id = 1"), docs, facts)
    assert [x.count() for x in left] == [1, 2]
    assert sorted((r["fact_id"], r["chunk_id"]) for r in ingest.detach_chunks(facts, spark.createDataFrame([(6,)], "chunk_id int")).collect()) == [(10, 5), (11, None), (12, None)]
    assert ingest.stamped(docs).first()["ingested_at"] is not None


def test_a_document_may_come_in_several_batches_of_one_version(spark, tmp_path):
    schema = "chunk_id long, doc_id long, page_start int, text string, version int"
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([(1, 1, 1, "one", 1), (3, 2, 1, "two", 1)], [(2, 1, 2, "more", 1)], [(9, 2, 1, "newer", 2)], [(4, 2, 1, "late", 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        load_stream(spark, source, target, state, schema, version_col="version").awaitTermination()
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(target).collect()) == [(1, "more"), (1, "one"), (2, "newer")]


def test_results_with_line_breaks_are_read_back_as_they_were(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a\nb "c", d'), (2, "e"), (3, None)], "id int, text string")
    path = str(tmp_path / "out")
    for _ in range(2):  # a rerun adds nothing
        found = io.write_csv_in_parts(rows, "id", ["id", "text"], path, lambda part: part, 2)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 'a\nb "c", d'), (2, "e"), (3, None)]


def test_a_stream_keeps_few_folders_and_nothing_aside(spark, tmp_path):
    schema = "chunk_id long, doc_id long, page_start int, text string"
    source, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for part in ([(k, k // 2, 1, f"t{k}") for k in range(40)], [(100, 3, 1, "new")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        load_stream(spark, source, target, state, schema, buckets=4).awaitTermination()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(target).collect()]
    assert sorted(rows) == sorted([(k // 2, f"t{k}") for k in range(40) if k // 2 != 3] + [(3, "new")])
    assert len(list((tmp_path / "out").glob("bucket=*"))) == 4 and not list((tmp_path / "state" / "aside").glob("*"))


def test_facts_meet_their_tables_where_their_document_lies(spark):
    facts = spark.createDataFrame([(1, 7, 0), (2, 7, 1), (3, 7, None), (4, 8, 0)], "fact_id long, doc_id long, table_ordinal int").repartition(3, "doc_id")
    chunks = spark.createDataFrame([(10, 7, 0, ["a"]), (11, 7, 0, ["b", "c"]), (12, 8, 1, ["d"]), (13, 7, None, ["e"])], "chunk_id long, doc_id long, table_ordinal int, heading_trail array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = ingest.with_heading(facts, chunks)
        assert re.search(r"SortMergeJoin \[doc_id#\d+L\], \[__doc#\d+L\]", made._jdf.queryExecution().executedPlan().toString())
        assert sorted(map(tuple, made.select("fact_id", "chunk_id", "context").collect())) == [(1, 11, "c"), (2, None, None), (3, None, None), (4, None, None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["constraint_violations", "load_facts"])
def test_line_items_in_parts_give_the_same(spark, monkeypatch, name):
    from ledgerlens.plans import flow_queries, queries  # noqa: F401
    from ledgerlens.plans.oracle import ORACLE

    from .oracle_check import assert_same

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, "PART_ROWS", 500)
    assert queries._parts(spark, folder) == 12 and queries._lines(spark, folder).rdd.getNumPartitions() == 12
    assert_same(queries.QUERIES[name](spark, folder), ORACLE[name], folder)
