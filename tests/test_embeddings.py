"""The bucketed cache of embeddings: appended, read without a shuffle, each distinct text embedded once."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources.embeddings import EmbeddingCache, distinct_texts

ROWS = [(1, "a"), (2, "bb"), (3, "bb"), (4, None), (5, ""), (6, "a much longer text")]
TEXTS = "id int, text string"


def counting(spark, value):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch.assign(embedding=[[value, float(len(t))] for t in batch["text"]])[["digest", "embedding"]]

    return seen, lambda missing: missing.select("digest", "text").mapInPandas(run, "digest string, embedding array<double>")


def by_id(rows):
    return {r["id"]: r["embedding"] for r in rows.collect()}


def test_each_distinct_text_is_embedded_once_and_appended(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "c"), 4)
    seen, embed = counting(spark, 1.0)
    rows = spark.createDataFrame(ROWS, TEXTS)
    first = by_id(cache.embedded(rows, embed))
    assert first == {1: [1.0, 1.0], 2: [1.0, 2.0], 3: [1.0, 2.0], 4: None, 5: [1.0, 0.0], 6: [1.0, 18.0]} and seen.value == 4
    held = {f: os.path.getmtime(f) for f in glob.glob(f"{tmp_path}/c/buckets-4/*.parquet")}
    # Another model sees new texts only, and files that are there stay as they are.
    seen, embed = counting(spark, 2.0)
    more = rows.unionByName(spark.createDataFrame([(7, "new"), (8, "new"), (9, "newer")], TEXTS))
    assert by_id(cache.embedded(more, embed, waves=3)) == first | {7: [2.0, 3.0], 8: [2.0, 3.0], 9: [2.0, 5.0]} and seen.value == 2
    assert held and held == {f: os.path.getmtime(f) for f in held} and cache.count() == 6
    # A later session finds it with its number of buckets; nothing is left beside it.
    again = EmbeddingCache(spark, str(tmp_path / "c"), 99)
    assert again.buckets == 4 and again.count() == 6 and os.listdir(tmp_path / "c") == ["buckets-4"]
    assert by_id(again.embedded(rows, embed)) == first and seen.value == 2


def test_the_cache_is_read_as_it_lies(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "c"), 8)
    _, embed = counting(spark, 1.0)
    texts = distinct_texts(spark.range(500).select(F.concat(F.lit("t"), "id").alias("text")))
    cache.fill(texts.where("length(text) < 4"), embed)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for asked in (cache.missing(texts), cache.vectors(texts)):
            plan = asked._jdf.queryExecution().executedPlan().toString().splitlines()
            scan = next(k for k, line in enumerate(plan) if "FileScan parquet" in line)
            depth = len(plan[scan]) - len(plan[scan].lstrip(" :+-"))
            above = []
            for line in reversed(plan[:scan]):
                own = len(line) - len(line.lstrip(" :+-"))
                if own < depth:
                    above.append(line)
                    depth = own
            assert "Bucketed: true" in plan[scan] and not any("Exchange" in line for line in above)
        assert "ReadSchema: struct<digest:string>" in cache.missing(texts)._jdf.queryExecution().executedPlan().toString()
        assert cache.missing(texts).count() == 400 and cache.vectors(texts).count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_two_appends_at_once_and_one_that_fails(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "c"), 4)
    texts = distinct_texts(spark.createDataFrame(ROWS, TEXTS))
    made = [texts.select("digest", F.array(F.lit(v)).alias("embedding")) for v in (1.0, 2.0)]
    workers = [threading.Thread(target=cache.append, args=(x,)) for x in made]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    assert cache.table().count() == 8 and cache.count() == 4 and cache.vectors(texts).count() == 4
    with pytest.raises(Exception, match="boom"):
        cache.append(texts.select("digest", F.array(F.raise_error(F.lit("boom")).cast("double")).alias("embedding")))
    assert cache.table().count() == 8 and os.listdir(tmp_path / "c") == ["buckets-4"]


def test_nothing_to_embed(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "it's a c"), 4)
    seen, embed = counting(spark, 1.0)
    assert cache.count() == 0
    none = spark.createDataFrame([(1, None)], TEXTS)
    assert by_id(cache.embedded(none, embed)) == {1: None} and by_id(cache.embedded(none.limit(0), embed)) == {} and seen.value == 0
    assert by_id(cache.embedded(spark.createDataFrame(ROWS, TEXTS), embed))[2] == [1.0, 2.0] and cache.count() == 4
