from pyspark.sql import functions as F

from ledgerlens.llm import mixing
from ledgerlens.llm.oracle import OP2

from ..oracle_check import assert_same

SCHEMA = "doc_id long, text string, source string"


def rows_of(n):
    return [(k, " ".join(["w"] * (1 + (k * 7) % 30)), None if k % 9 == 0 else f"s{k % 5 if k % 3 else 0}") for k in range(n)]


def test_equals_its_oracle_with_null_sources_and_empty_texts(spark):
    docs = spark.createDataFrame([*rows_of(400), (900, None, "s1"), (901, "", None), (902, " \t", "z")], SCHEMA).withColumn("tokens", F.lit("clash")).withColumn("range", F.lit(1))
    assert_same(mixing.mix_sources(docs).drop("copies"), OP2, None, {"documents": docs.toPandas()})


def test_targets_are_met_and_nothing_is_taken_more_than_twice(spark):
    docs = spark.createDataFrame(rows_of(500), SCHEMA)
    out = mixing.mix_sources(docs).toPandas()
    assert (out["taken"] <= 2 * out["size"]).all()
    names = {r[0]: r[2] for r in rows_of(500)}
    for _, own in out.groupby(out["doc_id"].map(names).fillna("none")):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= 60
    again = mixing.mix_sources(docs.orderBy(F.desc("doc_id"))).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == out.sort_values("doc_id")["taken"].tolist()


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (5, 2, 1), 1.5, 2).collect()}
    assert found == {"a": 20.0, "b": 200.0, "c": 1445.0}


def test_documents_of_the_mix_keep_their_columns(spark):
    docs = spark.createDataFrame(rows_of(60), SCHEMA).withColumn("copies", F.col("doc_id") + 1)
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in taken.items() if v} and out.where("copies <> doc_id + 1").count() == 0


def test_repeated_rows_null_ids_and_empty_tables(spark):
    out = mixing.mix_sources(spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x")], SCHEMA)).collect()
    assert len(out) == 3 and all(r["source_size"] == 5 for r in out)
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["taken"] for r in mixing.mix_sources(spark.createDataFrame([(1, None, "x")], SCHEMA)).collect()] == [0]


def test_the_mix_takes_rows_with_null_and_repeated_ids_as_often_as_it_counts_them(spark):
    rows = [*rows_of(60), *[(7, "a b c", "s1")] * 40, *[(None, f"n{k} x", "s2") for k in range(30)], *[(8, f"t{k} y z", "s1") for k in range(20)]]
    docs = spark.createDataFrame(rows, SCHEMA)
    words = lambda t: len(t.split())
    budget = 1.5 * sum(words(r[1]) for r in rows)
    out = [tuple(r) for r in mixing.mixed_documents(docs).collect()]
    assert budget - 60 <= sum(words(r[1]) for r in out) <= budget
    assert all(out.count(r) <= 2 * rows.count(r) for r in set(out)) and set(out) <= set(rows)
    assert any(r[0] is None for r in out)
    taken = mixing.mix_sources(docs).toPandas()
    for of, own in (("null", taken["doc_id"].isna()), ("7", taken["doc_id"] == 7), ("8", taken["doc_id"] == 8)):
        assert sum(words(r[1]) for r in out if str(r[0]).replace("None", "null") == of) == taken[own]["taken"].sum()


def test_a_very_long_text_among_short_ones(spark):
    docs = spark.createDataFrame([*rows_of(300), (999, "word " * 1_500_000, "s1"), (1000, "x" * 3_000_000, None)], SCHEMA).withColumns({"a.b": F.lit("clash"), "size": F.lit(3), "taken": F.lit(1)})
    out = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    assert len(out) == 302 and (out[999]["size"], out[1000]["size"]) == (1_500_000, 1) and all(r["taken"] <= 2 * r["size"] for r in out.values())
    assert out[999]["source_size"] == 1_500_000 + sum(len(t.split()) for _, t, s in rows_of(300) if s == "s1")
