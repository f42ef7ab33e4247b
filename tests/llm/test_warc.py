import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import warc
from ledgerlens.llm.oracle import OP4

from ..oracle_check import assert_same
from . import brute

SCHEMA = "page_id long, url string, html string"
PAGES = [(1, "http://a.org/ x\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://b", None), (4, "http://c", ""), (5, "http://d", "once\r\n\r\nWARC/1.1\r\n")]


def result(spark, pages, **options):
    index = warc.write_warc(pages, **options)
    return index, warc.read_warc(spark, index)


def test_round_trip_and_revisits(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA).withColumn("sha", F.lit("clash")).withColumn("id", F.lit(7))
    index, back = result(spark, pages)
    found = {r["id"]: r for r in back.collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in found.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)}
    for key, _, html in PAGES:
        payload = (html or "").encode()
        assert (found[key]["payload_bytes"], found[key]["payload_digest"]) == (len(payload), brute.base32_sha1(payload))
        assert found[key]["payload"] == (payload if found[key]["record_type"] == "response" else None)
    entry = index.where("id = 5").first()
    assert warc.read_record(entry["bundle"], entry["frame_start"], entry["offset"], entry["length"])["payload"] == PAGES[4][2].encode()


def test_query_columns_equal_the_oracle(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"page {k % 7}" * (k % 5)) for k in range(60)], SCHEMA)
    _, back = result(spark, pages)
    assert_same(back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"), OP4, None, {"pages": pages.toPandas()})


def test_frames_are_independent_and_bundles_roll_over(spark, monkeypatch):
    import random

    rng = random.Random(1)
    pages = spark.createDataFrame([(k, "u", "".join(rng.choices("abcdefghijklmnop", k=40_000))) for k in range(60)], SCHEMA).coalesce(1)
    index, back = result(spark, pages)
    assert back.count() == 60 and index.select("bundle", "frame_start").distinct().count() > 5
    row = index.where("id = 59").first()
    system, path = warc.open_fs(row["bundle"])
    with system.open_input_file(path) as file:
        starts = [s for s, _, _ in warc.seek_table(file)]
    assert row["frame_start"] in starts and starts == sorted(starts)


def test_small_payloads_repeated_rows_null_ids_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (3, "u", "abcdef"), (4, "u", "abcdef"), (None, "u", "abcdef")], SCHEMA)
    _, back = result(spark, pages, min_revisit_bytes=4)
    kinds = sorted(((r["id"] or 0), r["record_type"], r["refers_to"]) for r in back.collect())
    assert kinds == [(0, "revisit", 4), (1, "response", None), (2, "response", None), (3, "revisit", 4), (3, "revisit", 4), (4, "response", None)]
    assert result(spark, spark.createDataFrame([], SCHEMA))[1].count() == 0


def test_a_changed_payload_is_noticed():
    record = warc.record_bytes(1, "u", b"payload", None, False)
    assert next(warc.parse_records(record))["payload"] == b"payload"
    with pytest.raises(ValueError):
        list(warc.parse_records(record.replace(b"\r\n\r\npayload", b"\r\n\r\npaYload")))


def test_records_have_what_the_format_demands():
    import re
    import uuid

    response, revisit = (warc.record_bytes(k, "http://h/", b"same", 9 if k == 1 else None, k == 1, "2024-05-06T07:08:09Z").decode() for k in (9, 1))
    for record in (response, revisit):
        head = dict(x.split(": ", 1) for x in record.split("\r\n\r\n")[0].split("\r\n")[1:])
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(head) and head["WARC-Date"] == "2024-05-06T07:08:09Z"
        assert uuid.UUID(re.fullmatch("<urn:uuid:(.*)>", head["WARC-Record-ID"])[1])
    assert re.search("WARC-Refers-To: (.*)\r", revisit)[1] == re.search("WARC-Record-ID: (.*)\r", response)[1]


def test_bundles_are_read_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1)
    pages = spark.createDataFrame([(k, "u", str(k) * warc.FRAME_BYTES) for k in range(12)], SCHEMA)
    index, back = result(spark, pages)
    assert index.select("bundle").distinct().count() == 12
    assert back.count() == 12 and back.select(F.spark_partition_id().alias("p")).distinct().count() > 1
