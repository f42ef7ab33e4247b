import duckdb
import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import graph, line_dedup, oracle, queries
from ledgerlens.llm.shared import running_sum

from ..oracle_check import assert_same
from . import brute

DATA = "/root/testdata/sf0.001"
P = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_its_oracle(spark, name):
    assert_same(queries.QUERIES[name](spark, DATA), oracle.ORACLE[name], DATA)


def documents():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


def test_pipeline_stages(spark):
    from tokenizers import Tokenizer

    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = documents()
    # Every document here has a language, so the first stage keeps all.
    docs = corpus_pipeline.identify_languages(spark, docs, DATA)
    assert docs.columns == columns and docs.count() == len(rows)
    groups = brute.ngram_join([(d, t) for d, t, _ in rows])
    docs = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    kept = {d for d, (_, c) in groups.items() if c == d}
    assert docs.columns == columns and {r["doc_id"] for r in docs.select("doc_id").collect()} == kept
    items = duckdb.sql(f"SELECT item_id, text FROM '{DATA}/benchmark.parquet'").fetchall()
    leaks = {d for d, t, _ in rows if any(" ".join(i.split()) in " ".join((t or "").split()) for _, i in items)}
    docs = corpus_pipeline.drop_benchmark_leaks(spark, docs, DATA)
    kept -= leaks
    assert docs.columns == columns and {r["doc_id"] for r in docs.select("doc_id").collect()} == kept
    frame = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    taken = dict(con.sql(f"WITH {oracle.mix_sql('documents')} SELECT doc_id, copies FROM mixed WHERE copies > 0").fetchall())
    docs = corpus_pipeline.mix(spark, docs, DATA)
    assert docs.columns == columns
    assert {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == taken
    out = [tuple(r) for r in corpus_pipeline.write_token_files(spark, docs, DATA).orderBy("start").collect()]
    texts = {d: t for d, t, _ in rows}
    assert out == brute.token_rows([(d, texts[d]) for d in sorted(taken) for _ in range(taken[d])], Tokenizer.from_file(P.path("word_bpe_49k.json")), 2)


def test_stage_names_and_an_empty_table(spark, tmp_path):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(3)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 180)] + [(int(a), int(b)) for a, b in rng.integers(200, 260, (40, 2))] + [(300, 300), (5, None)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for e in edges if None not in e for x in e}
    assert found == brute.roots(sorted(nodes), [e for e in edges if None not in e])


def test_running_sum_over_ranges(spark):
    rows = [(None if k % 4 == 0 else f"g{k % 3}", k // 10, k, k % 7) for k in range(100)]
    out = running_sum(spark.createDataFrame(rows, "g string, part int, k int, v int"), ["g"], "part", ["k"], "v", "s")
    total, want = {}, {}
    for g, _, k, v in rows:
        total[g] = total.get(g, 0) + v
        want[k] = total[g]
    assert {r["k"]: r["s"] for r in out.collect()} == want


def test_stages_judge_rows_with_null_and_repeated_ids_by_themselves(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string"
    text = lambda k: " ".join(f"{w}{k}" for w in ("amber", "birch", "cedar", "delta", "ember", "flint", "grove", "heath", "inlet", "jetty"))
    test_item = "which river runs through the old mill town near the hills? the silver one by the bridge"

    def stage(f, rows):
        spark.createDataFrame([(1, test_item)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        return sorted(((r["doc_id"], r["text"]) for r in f(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()), key=str)

    rows = [(1, text("a"), "en", "x"), (None, text("a"), "en", "x"), (2, text("b"), "en", "x"), (2, text("b"), "en", "x"), (2, text("c"), "en", "x"), (None, text("d"), "en", "x"), (None, text("d"), "en", "x"), (0, text("c"), "en", "x")]
    assert stage(corpus_pipeline.drop_near_copies, rows) == sorted([(1, text("a")), (2, text("b")), (0, text("c")), (None, text("d"))], key=str)
    rows = [(3, test_item, "en", "x"), (3, text("e"), "en", "x"), (None, test_item, "en", "x"), (None, text("f"), "en", "x")]
    assert stage(corpus_pipeline.drop_benchmark_leaks, rows) == sorted([(3, text("e")), (None, text("f"))], key=str)
    english = [(k, f"the people of the town and their {w} are here with the others", "en", "x") for k, w in enumerate("house river garden bridge market".split() * 8)]
    odd = "\u0416\u0449\u042e \u042a\u044d\u0424 " * 20
    kept = stage(corpus_pipeline.identify_languages, [*english, (0, odd, None, "y"), (None, odd, None, "y"), (None, english[0][1], "en", "x")])
    assert kept == sorted([*[r[:2] for r in english], (None, english[0][1])], key=str)


def test_further_columns_of_any_name_pass_every_stage(spark, tmp_path):
    names = ("a.b", "__row", "__file", "__index", "__out", "__leak", "__copies", "__copy", "__taken_row", "extra0", "id", "label", "digest", "b`c")
    spark.createDataFrame([(1, "which river runs through the old mill town? the silver one by the bridge", "x")], "item_id long, text string, `a.b` string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(k, f"the people of town {k} are here with the others of word{k} and word{k + 1}", "en", f"s{k % 2}") for k in range(40)], "doc_id long, text string, lang string, source string")
    rows = docs.toDF(*docs.columns).selectExpr("*", *[f"'{k}' as `{n.replace('`', '``')}`" for k, n in enumerate(names)])
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, str(tmp_path))
        assert out.columns == rows.columns, name
        assert {tuple(r)[4:] for r in out.collect()} == {tuple(str(k) for k in range(len(names)))}, name
    assert corpus_pipeline.STAGES[-1][1](spark, given, str(tmp_path)).count() == 40
    assert line_dedup.dedup_lines(rows).columns == rows.columns and line_dedup.dedup_lines(rows).count() == 40
