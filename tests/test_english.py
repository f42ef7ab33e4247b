import random

import pytest

from ledgerlens.functions import english
from ledgerlens.operators import fulltext, search

STEMS = """consign consigned:consign consigning:consign consistency:consist consolation:consol knightly:knight knocked:knock kitten generously:generous caresses:caress ties:tie cries:cri gaps:gap gas kiwis:kiwi
agreed:agre hopping:hop hoping:hope happy:happi say cry:cri by relational:relat conditional:condit vietnamization:vietnam electriciti:electr hopefulness:hope adjustment:adjust adoption:adopt probate:probat controll:control roll
margins:margin apples:appl youth boyish communication:communic arsenal exceeding:exceed skies:sky luxuriated:luxuri national:nation dying:die sky news proceed earrings:earring bled sing falling:fall plastered:plaster
analogously:analog formality:formal sensitivities:sensit decisiveness:decis callousness:callous triplicate:triplic revival:reviv allowance:allow inference:infer airliner:airlin defensible:defens irritant:irrit
replacement:replac dependent:depend effective:effect rate:rate cease:ceas possibly:possibl geology:geolog helplessly:helpless""".split()


@pytest.mark.parametrize("pair", STEMS)
def test_stems(pair):
    word, _, stem = pair.partition(":")
    assert english.stem(word) == (stem or word)


def test_tokens_and_positions():
    held = english.vector("The state-of-the-art and/or e.g. sales; see http://example.com/a/b?x=1 &amp; <b>bold</b> foo_bar 3.14 -5 1.2.3 1e5 10K me@x.org company's $1,577")
    assert held == {
        "state-of-the-art": [2], "state": [3], "art": [6], "and/or": [7], "e.g": [8], "sale": [9], "see": [10], "example.com/a/b?x=1": [11], "example.com": [12], "/a/b?x=1": [13], "bold": [14], "foo": [15], "bar": [16],
        "3.14": [17], "-5": [18], "1.2.3": [19], "1e5": [20], "10k": [21], "me@x.org": [22], "compani": [23], "1": [25], "577": [26],
    }
    assert english.vector("The the THE") == {} == english.vector("") and english.vector("Margins, margin") == {"margin": [1, 2]}
    many = english.vector("word " * 20_000 + "last")
    assert len(many["word"]) == english.MOST and many["last"] == [english.LAST]
    assert english.vector("x" * 3000 + " short") == {"short": [1]}


def test_queries():
    word = lambda x: ("phrase", ((x, 0),))
    assert english.websearch("apples OR Oranges or") == ("or", (word("appl"), word("orang")))
    assert english.websearch('"cat in the hat" -dog') == ("and", (("phrase", (("cat", 0), ("hat", 3))), ("not", word("dog"))))
    assert english.websearch("r&d") == ("phrase", (("r", 0), ("d", 1)))
    assert english.websearch("the of") is None and english.websearch("") is None and english.websearch('"') is None
    assert english.operands(english.websearch("b OR é a b")) == ["b", "é"]
    held = {"cat": [1, 9], "hat": [4], "dog": [12]}
    fits = lambda q: english.matches(english.websearch(q), held)
    assert fits('"cat in the hat"') and not fits('"cat hat"') and fits("cat -bird") and not fits("cat -dog") and fits("bird OR dog") and not fits("bird dog")


def test_ranks_by_hand():
    """Known values: one word of one asked for, of two; two of two; neighbours that belong together."""
    assert round(fulltext.rank_any([[1]], 1), 7) == 0.0607927 and round(fulltext.rank_any([[1]], 2), 7) == 0.0303964 and round(fulltext.rank_any([[1], [2]], 2), 7) == 0.0607927
    assert round(fulltext.rank_any([[1, 5]], 1), 6) == round(0.1 * 1.25 / 1.64493406685, 6)
    assert round(fulltext.rank_all([[1], [2]]), 7) == 0.0991032
    assert fulltext.rank_all([[1], [2]]) > fulltext.rank_all([[1], [9]]) > fulltext.rank_all([[1], [200]]) > 0
    assert fulltext.rank_all([[3]]) == fulltext.rank_all([]) == pytest.approx(1e-20)


def rows_by_hand(docs, queries, k):
    """(qid, id, score, rank) by trying every text."""
    out = []
    for qid, question in queries:
        tree = english.websearch(question or "")
        words = english.operands(tree)
        found = []
        for doc, text in docs:
            held = english.vector(text or "")
            if tree and any(w in held for w in words) and english.matches(tree, held):
                found.append((-fulltext.rank(tree, words, held), doc))
        out += [(qid, doc, -score, place) for place, (score, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_search_equals_trying_every_text(spark, tmp_path):
    draw = random.Random(4)
    words = ["apple", "apples", "margin", "margins", "growing", "sales", "the", "net", "r&d", "state-of-the-art", "2018"]
    docs = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(1, 14)))) for k in range(120)] + [(500, None), (501, ""), (502, "the of")]
    queries = [(1, "apple"), (2, "Margin OR apples"), (3, "net margins"), (4, '"net margin" -sales'), (5, '"growing sales" OR "apples margin"'), (6, "the"), (7, None), (8, "r&d OR 2018"), (9, "state-of-the-art"), (10, "nowhere"), (11, "-net")]
    made = fulltext.postings(spark.createDataFrame(docs, "id long, text string"))
    kept = fulltext.write_postings(made, f"{tmp_path}/postings", partitions=3)
    found = fulltext.ranked_search(kept, spark.createDataFrame(queries, "qid long, question string"), 7)
    assert sorted(map(tuple, found.select("qid", "id", "score", "rank").collect())) == rows_by_hand(docs, queries, 7)


def test_a_scan_gives_what_postings_give_and_shuffles_no_pairs(spark):
    draw = random.Random(6)
    words = ["apple", "apples", "margin", "net", "r&d", "r", "d", "sales", "2018", "the"]
    docs = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 9))), draw.choice(["Big", None, "Other"])) for k in range(200)]
    asked = [(1, "margin OR apples OR r&d", None), (2, "r&d OR 2018", "big"), (3, "apple", "oth"), (4, "net sales", None), (5, "r&d", None), (6, "the", None), (7, "d OR r&d OR net", None), (8, "d OR r&d OR net", None)]
    rows, queries = spark.createDataFrame(docs, "id long, text string, company string"), spark.createDataFrame(asked, "qid long, question string, q_company string")
    wanted = search.Filters(contains={"company": "q_company"})
    want = fulltext.ranked_search(fulltext.postings(rows, keep=("company",)), queries, 9, filters=wanted)
    found = fulltext.scanned_search(rows, queries, 9, filters=wanted)
    order = ["qid", "id", "score", "rank"]
    assert sorted(map(tuple, found.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))
    plan = fulltext.scanned_search(rows, queries.where("qid <> 4 and qid <> 5"), 9, filters=wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan


def test_postings_keep_columns_that_filters_ask_for(spark):
    rows = spark.createDataFrame([(1, "net sales", "Big Co", 2018), (2, "net sale", "Other", 2018), (3, "sales", "big co", 2019), (4, "sales", None, None)], "id long, text string, company string, `fiscal_year` int")
    made = fulltext.postings(rows, keep=("company", "fiscal_year"))
    asked = spark.createDataFrame([(1, "sales", "big", None), (2, "sales", None, 2018), (3, "sales", "BIG", 2018), (4, "sales", None, 0), (5, "sales", "none", None)], "qid long, question string, q_company string, q_fiscal_year int")
    wanted = search.Filters(equal={"fiscal_year": "q_fiscal_year"}, contains={"company": "q_company"})
    found = fulltext.ranked_search(made, asked, 10, filters=wanted).collect()
    by_query = {q: {r["id"] for r in found if r["qid"] == q} for q in range(1, 6)}
    assert by_query == {1: {1, 3}, 2: {1, 2}, 3: {1}, 4: {1, 2, 3, 4}, 5: set()}
