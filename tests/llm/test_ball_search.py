import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import ball_search
from ledgerlens.llm.oracle import ORACLE
from ledgerlens.llm.queries import op11_lexical_search

from ..oracle_check import assert_same
from .brute import LOWER

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def ranked(docs, items, k=10):
    """All scores of all pairs, then the best of each item row."""
    vectors = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    vectors = [(d, v) for d, v in vectors if v]
    n, words = len(vectors), sum(sum(v.values()) for _, v in vectors)
    df = Counter(t for _, v in vectors for t in v)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for d, v in vectors:
            m = 100 - 75 + 75 * sum(v.values()) * n // words
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * v[t] // (1000 * v[t] + 8 * m)) for t, c in asked.items() if t in v)
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(repr, out))


def found(spark, docs, items, **options):
    rows = ball_search.search_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"] and dict(rows.dtypes)["rank"] == "int"
    return sorted(repr(tuple(r)) for r in rows.collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_scoring_everything(spark, seed):
    draw = random.Random(seed)
    words = [f"w{int(draw.paretovariate(0.6)) % 300}" for _ in range(4000)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    docs = [(d, text(draw.choice([1, 5, 30, 200]))) for d in range(400)]
    docs += [(d + 1000, docs[d][1]) for d in range(0, 400, 9)] + [(5, docs[5][1]), (5, "other w1 w2"), (None, docs[3][1]), (None, "w3"), (900, None), (901, ""), (902, ".,;")]
    items = [(i, text(draw.choice([1, 3, 20]))) for i in range(30)] + [(3, "w1 w1 W1 w2"), (3, "w1 w1 W1 w2"), (None, "w5 w9"), (50, None), (51, "!"), (52, "nowhere"), (53, docs[40][1])]
    assert found(spark, docs, items, tree_docs=64, leaf_docs=4) == ranked(docs, items)
    assert found(spark, docs, items, k=3) == ranked(docs, items, 3)


def test_ties_go_to_the_smaller_id(spark):
    docs = [(d, "alpha beta" if d % 2 else "beta alpha") for d in range(200, 0, -1)] + [(None, "alpha beta")]
    items = [(1, "alpha"), (2, "Beta ALPHA")]
    assert found(spark, docs, items, tree_docs=16, leaf_docs=2) == ranked(docs, items)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(ball_search, "BLOCK_ITEMS", 2)
    docs = [(d, f"term{d % 7} term{d % 3} common") for d in range(60)]
    items = [(i, f"term{i} common common") for i in range(7)]
    assert found(spark, docs, items) == ranked(docs, items)


def test_very_long_text_other_scripts_and_clashing_columns(spark):
    docs = [(1, "naïve Ümläut 日本 " * 100_000), (2, "日本 naïve"), (3, "NAÏVE \x00x\x7fy~z")]
    items = [(1, "日本"), (2, "naïve x"), (3, "x y z"), (4, "NAÏVE")]
    assert found(spark, docs, items) == ranked(docs, items)
    extra = spark.createDataFrame([(1, "a b", 9, 8, 7)], "doc_id long, text string, score int, `a.b` int, item int")
    assert ball_search.search_documents(extra, spark.createDataFrame([(1, "a", 2)], "item_id long, text string, id int")).count() == 1


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == [] == found(spark, [(1, "a")], []) == found(spark, [(1, None)], [(1, "a")])


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(1)
    count, columns = 300, 80
    lists = [np.unique(np.concatenate((draw.integers(0, 8, 6) + 8 * (k % 10), draw.integers(0, columns, 2)))) for k in range(count)]
    first = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    rows = ball_search.Rows(first, np.concatenate(lists), draw.integers(1, 900_000, first[-1]).astype(float))
    dense = np.array([rows.one(k, columns) for k in range(count)])
    asked = draw.integers(0, 3, (20, columns)) * draw.uniform(0, 90, columns)
    at = [np.flatnonzero(x) for x in asked]
    items = ball_search.Rows(np.concatenate(([0], np.cumsum([len(x) for x in at]))), np.concatenate(at), np.concatenate([x[k] for x, k in zip(asked, at, strict=True)]))
    tree = ball_search.build(rows, columns, 8, items)
    assert sorted(tree.order.tolist()) == list(range(count))
    most = ball_search.bounds(tree, np.sqrt((asked * asked).sum(axis=1)))
    for node in range(len(tree.radius)):
        own = tree.order[tree.low[node] : tree.high[node]]
        assert ((asked @ dense[own].T).max(axis=1) <= most[:, node]).all()


def test_far_subtrees_are_not_opened():
    """Ten clusters that share no term: an item about one of them does not look into most of the others."""
    docs = [(c, [10 * c + k for k in range(10) if (d >> k % 5) & 1 or k == 0]) for c in range(10) for d in range(32)]
    block = ball_search.make_block([(c, " ".join(f"t{10 * c + k}" for k in range(10))) for c in range(10)])
    place = {int(h): k for k, h in enumerate(block.hashes)}
    of = lambda t: place[int(ball_search.make_block([(0, f"t{t}")]).hashes[0])]
    lists = [sorted(of(t) for t in terms) for _, terms in docs]
    first = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    search = ball_search.Search(block, np.full(len(block.hashes), 1000), len(docs), int(first[-1]), 5, 8)
    search.add(list(range(len(docs))), np.diff(first), first, np.concatenate(lists), np.ones(first[-1], np.int64))
    assert search.opened < search.leaves / 2 and all(len(b) == 5 for b in search.best)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert_same(op11_lexical_search(spark, folder), ORACLE["op11_lexical_search"], folder)
