import hashlib
import re

import pytest

from ledgerlens.llm import fill_middle
from ledgerlens.llm.oracle import ORACLE
from ledgerlens.llm.queries import op12_fill_middle

from ..oracle_check import assert_same

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
SCHEMA = "doc_id long, text string"


def plainly(doc_id, text, plain_from=90, spm_below=20):
    """The row that a text gives, by slicing strings."""
    text = text or ""
    tokens = UNIT.findall(text)
    name = "" if doc_id is None else doc_id
    digest = hashlib.sha256(f"1:{name}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    parts = ["".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= plain_from:
        return doc_id, len(tokens), "plain", None, None, text
    p, m, s = parts
    spm = h[3] % 100 < spm_below
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(tokens), "spm" if spm else "psm", len(p), len(m), out


TEXTS = ["", None, "a", "ab cd", "<", "<<P", "P>", "holds <M> a mark", "<S", ">>", "é", "naïve café\n\n12 über", "日本語 text 漢字", "x" * 5000, "\x00\x01", "🙂a🙂", "a<" * 50, "M>" * 40, "word " * 40_000]


def test_every_text_under_many_draws(spark):
    rows = [(d, t) for d in range(60) for t in TEXTS[:-1]] + [(None, t) for t in TEXTS] + [(7, "same"), (7, "same")]
    made = fill_middle.restore(fill_middle.fill_in_middle(spark.createDataFrame(rows, SCHEMA)))
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(repr(plainly(d, t)) for d, t in rows)
    assert sorted(r["restored"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_very_long_text_whole(spark):
    text = "Länge und Wörter, " * 200_000  # several times what is worked on at once
    (row,) = fill_middle.restore(fill_middle.fill_in_middle(spark.createDataFrame([(2, text), ], SCHEMA), plain_from=100)).collect()
    assert tuple(row)[:6] == plainly(2, text, 100) and row["restored"] == text and row["form"] != "plain"


def test_shares_are_parameters(spark):
    docs = spark.createDataFrame([(d, "one two three") for d in range(50)], SCHEMA)
    forms = lambda **k: {r["form"] for r in fill_middle.fill_in_middle(docs, **k).collect()}
    assert forms(plain_from=0) == {"plain"} and forms(plain_from=100, spm_below=0) == {"psm"} and forms(plain_from=100, spm_below=100) == {"spm"}
    a, b = ([r["output"] for r in fill_middle.fill_in_middle(docs, seed=s).orderBy("doc_id").collect()] for s in "12")
    assert a != b


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 3)], "doc_id long, text string, output string, form string, `a.b` int")
    assert fill_middle.fill_in_middle(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    outputs = fill_middle.fill_in_middle(docs).selectExpr("*", "1 as `a.b`", "output as `o``p`")
    assert fill_middle.restore(outputs).first()["restored"] == "a b"
    with pytest.raises(ValueError):
        fill_middle.restore(outputs.selectExpr("*", "1 as restored"))
    none = fill_middle.restore(fill_middle.fill_in_middle(docs.where("doc_id < 0")))
    assert none.count() == 0 and none.columns[-1] == "restored"
    blank = spark.createDataFrame([(None, "psm"), ("<P>a<S>b<M>c", None), ("<P>a<S>b<M>c", "psm")], "output string, form string")
    assert sorted(str(r["restored"]) for r in fill_middle.restore(blank).collect()) == ["None", "None", "acb"]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert_same(op12_fill_middle(spark, folder), ORACLE["op12_fill_middle"], folder)
