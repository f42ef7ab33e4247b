import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import finance, text


def value(spark, expression, **columns):
    names = {"a": "", **columns}
    schema = ", ".join(f"{k} string" for k in names)
    return spark.createDataFrame([tuple(names.values())], schema).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("said", "found"),
    [("0", [0.0]), ("$(3)", [3.0]), ("-$(5)", []), ("(1,577)", [1577.0]), ("12.5% and -7", [12.5, 7.0]), ("none", []), (None, []), ("5 and 5.00", [5.0])],
)
def test_numbers(spark, said, found):
    assert value(spark, text.numbers(F.col("a")), a=said) == found


@pytest.mark.parametrize(("said", "year"), [("FY2018 or 2020", 2018), ("in 2019", 2019), ("in 1998", None), ("FY1999", 1999), ("FY18", None), ("Q22023", None), ("FY2018Q1", None)])
def test_fiscal_year(spark, said, year):
    assert value(spark, text.fiscal_year(F.col("a")), a=said) == year


def test_query_terms(spark):
    assert value(spark, text.query_terms(F.col("a")), a="What was 3M's capex in 2018, the Capex of 123456?") == ["m's", "capex", "2018", "1234"]
    assert len(value(spark, text.query_terms(F.col("a")), a=" ".join(f"word{n}" for n in range(30)))) == 12


def test_expansion_takes_whole_terms_in_order(spark):
    said = value(spark, text.expand_terms(F.col("a")), a="EPS and capex, not steps")
    assert said == "EPS and capex, not steps earnings per share capital expenditures purchases of property plant and equipment"
    assert value(spark, text.expand_terms(F.col("a")), a="steps") == "steps"


def test_figures_and_citations(spark):
    said = "In 2018 3M paid $2,031 [F12] in a 10-K, or 7.5 [C3][F12]"
    assert value(spark, text.figures(F.col("a")), a=said) == ["$2,031", "10", "7.5"]
    assert value(spark, text.citations(F.col("a")), a=said) == ["F12", "C3"]


def test_follow_up(spark):
    assert value(spark, text.follow_up(F.col("a"), F.col("b")), a="and 2019?", b="What was capex") == "What was capex and 2019?"
    assert value(spark, text.follow_up(F.col("a"), F.col("b")), a="one two three four five six seven", b="x") == "one two three four five six seven"
    assert value(spark, text.follow_up(F.col("a"), F.col("b")), a="and 2019?", b=None) == "and 2019?"


@pytest.mark.parametrize(("name", "company"), [("3M_2018_10K", "3M"), ("JOHNSON_JOHNSON_2022Q4_EARNINGS", "JOHNSON_JOHNSON"), ("ACME_8K_x", "ACME"), ("plain", "plain"), ("acme_8k", "acme"), ("A_10KSB_2018", "A_10KSB"), ("2018_10K", "2018_10K")])
def test_company_of(spark, name, company):
    assert value(spark, text.company_of(F.col("a")), a=name) == company


def test_trigrams_of_short_text(spark):
    assert value(spark, text.trigrams(F.col("a")), a="one two") == []
    assert value(spark, text.trigrams(F.col("a")), a="A b, c d a b c") == ["a b c", "b c d", "c d a", "d a b"]


def test_same_figure_over_scales(spark):
    check = lambda a, b: spark.range(1).select(text.same_figure(F.lit(a), F.lit(b))).first()[0]
    assert check(1577.0, 1577.0) and check(1577.0, 1577000.0) and check(1577.0, 1.577) and not check(1577.0, 1578.0)


def test_scrub_and_fact_text(spark):
    assert value(spark, text.scrub(F.col("a")), a="a\x00b") == "ab"
    parts = [F.lit("Co"), F.lit("Assets:"), F.lit("Cash"), F.lit(""), F.lit(None), F.lit("millions")]
    assert value(spark, text.fact_text(*parts)) == "Co · Assets · Cash · millions"
    assert value(spark, text.fact_text(F.lit("Co"), F.lit(None), F.lit("Cash"), F.lit("2018"), F.lit("5"), F.lit("millions"))) == "Co · Cash · 2018 · 5 millions"


def test_number_tokens_keep_commas_but_no_full_stop(spark):
    assert value(spark, text.number_tokens(F.col("a")), a="In 2018. 10. 1,577 and 3.25, 12 99") == ["2018", "1,577", "3.25"]
    assert value(spark, text.as_float(F.col("a")), a="1,577.5") == 1577.5 and value(spark, text.as_float(F.col("a")), a="x1") is None


@pytest.mark.parametrize(("said", "scale"), [("Sales (in Millions)", "millions"), ("(thousands)", "thousands"), ("(in billions, except)", None), ("millions", None)])
def test_scale(spark, said, scale):
    assert value(spark, text.scale_of(F.col("a")), a=said) == scale


def test_render_of_a_metric(spark):
    inputs = F.array(*[F.struct(F.lit(i).alias("fact_id"), F.lit(n).alias("label"), F.lit(v).alias("value"), F.lit(3).alias("page"), F.lit("d").alias("doc_name")) for i, n, v in ((1, "A", 12345.0), (2, "B", -5.0))])
    said = value(spark, finance.render(F.lit("working capital"), F.lit("12,350"), F.lit("a - b"), F.lit("millions"), inputs))
    assert said == "working capital: 12,350 millions\n  a - b\n  computed from:\n    [F1] A = 12,345  (d p3)\n    [F2] B = -5  (d p3)"


def test_metrics(spark):
    run = lambda name, *xs: spark.range(1).select(finance.METRICS[name].formula(*[F.lit(float(x)) for x in xs])).first()[0]
    assert run("current ratio", 6, 3) == 2 and run("current ratio", 6, 0) is None
    assert run("quick ratio", 1, 2, 4) == 0.75 and run("working capital", 5, 3) == 2 and run("net margin", 1, 4) == 25
    assert value(spark, finance.show(F.lit(12345.6), finance.METRICS["working capital"])) == "12,346"
    assert value(spark, finance.show(F.lit(33.333), finance.METRICS["net margin"])) == "33.3%"
    assert value(spark, finance.detect(F.col("a")), a="The Quick Ratio and net margin") == "quick ratio"
