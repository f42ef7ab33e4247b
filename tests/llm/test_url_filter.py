from ledgerlens.llm import url_filter
from ledgerlens.llm.oracle import OP7

from ..oracle_check import assert_same

SCHEMA = "page_id long, url string, id string"
URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/1", "https://example.org/en/142?x", "http://example.org/en/2", "http://notexample.org/es/x", "http://x.com/de/1#y", "http://x.com/fr/", "http://x.com", "http://x.net/login",
    "http://ad.doubleclick.net/x", "http://x.net/a/wp-json/y", "http://org/", "http://x.org:80/", "http://x.com/DE/1", "http://x.com/?http://y.org/es/", "//x.org/", "http://É.com/de/", "http://x.org/\nes/", "http://x.net/mylogin", "http://x.net/cart.html",
]


def test_equals_its_oracle(spark):
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(URLS)] + [(4, URLS[4], "again")], SCHEMA)
    assert_same(url_filter.filter_urls(pages, url_filter.PAGE_RULES), OP7, None, {"pages": pages.toPandas()[["page_id", "url"]]})


def test_only_candidates_run_and_the_longest_rule_wins(spark):
    pages = spark.createDataFrame([(1, "http://a.example.org/en/15", "")], SCHEMA)
    row = url_filter.filter_urls(pages, url_filter.PAGE_RULES).first()
    assert (row["rule"], row["verdict"]) == ("example.org/en/1", "block")
    counts = url_filter.token_counts(pages, "url", ["example", "org", "fr"])
    assert counts == {"example": 1, "org": 1}


def test_no_rules_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a/", "")], SCHEMA)
    assert [r["verdict"] for r in url_filter.filter_urls(pages, [], default="block").collect()] == ["block"]
    assert url_filter.filter_urls(pages.limit(0), url_filter.PAGE_RULES).count() == 0


def test_ids_beside_a_null_one_keep_every_digit(spark):
    pages = spark.createDataFrame([(9007199254740993, "http://a.org/", ""), (None, "http://b.com/de/", ""), (9007199254740993, None, "")], SCHEMA).coalesce(1)
    found = [(r["page_id"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.PAGE_RULES).collect()]
    assert found == [(9007199254740993, "allow"), (None, "block"), (9007199254740993, "allow")]


def test_every_rule_of_the_query_has_a_token():
    assert all(r.tokens for r in url_filter.PAGE_RULES)
