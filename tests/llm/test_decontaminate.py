import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate

from . import brute

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(rng, n):
    return [f"w{int(rng.paretovariate(0.3)) % 10**9}" for _ in range(n)]


def planted(seed=0):
    rng = random.Random(seed)
    items = [(k, " ".join(words(rng, rng.randrange(15, 40)) + ["?"] * (k % 2) + words(rng, rng.randrange(4, 10)))) for k in range(30)]
    docs, leaks = [], set()
    for k in range(150):
        text = words(rng, rng.randrange(1, 400))
        if k % 5 == 0:
            item, passage = items[rng.randrange(30)]
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage.upper().split() if k % 10 else passage.split()
            leaks.add((k, item))
        docs.append((k, " ".join(text)))
    return docs, items, leaks


def found(spark, docs, items, **options):
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_planted_items_are_found_and_nothing_else(spark, seed):
    docs, items, leaks = planted(seed)
    assert found(spark, docs, items) == leaks


def test_shards_make_no_difference(spark):
    docs, items, leaks = planted(3)
    assert found(spark, docs, items, shard_postings=200) == leaks


def test_block_max_retrieval_equals_scoring_everything():
    import pandas as pd

    rng = random.Random(4)
    texts = {k: " ".join(words(rng, 30)) for k in range(40)}
    rows = [(k, int(h.view(np.int64)), rng.random() + 0.1) for k, t in texts.items() for h in np.unique(decontaminate._hashes(t))]
    index = decontaminate.build_index(pd.DataFrame(rows, columns=["item", "term", "weight"]), texts)
    terms = len(index.hashes)
    passage, term = [], []
    for p in range(60):
        own = set(rng.sample(range(terms), rng.randrange(1, terms))) if p % 3 else {int(index.number[k]) for k in np.searchsorted(index.hashes, np.unique(decontaminate._hashes(texts[p % 40])))}
        passage += [p] * len(own)
        term += sorted(own)
    passage, term = np.array(passage), np.array(term)
    dense = np.zeros((terms, 40))
    dense[np.repeat(np.arange(terms), np.diff(index.first)), index.item] = index.impact
    for threshold in (0.3, 0.5, 0.9):
        got = {(p, i): s for p, i, s in zip(*(x.tolist() for x in decontaminate.retrieve(index, passage, term, threshold)), strict=True)}
        want = {}
        for p in range(60):
            scores = dense[term[passage == p]].sum(axis=0)
            want |= {(p, i): scores[i] for i in range(40) if scores[i] >= threshold - 1e-9}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def damaged(seed):
    """Items of a small vocabulary, and documents that hold parts of them: whole, with words left out or changed, one half, in another order."""
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.6)), 400)}"
    items = [(k, " ".join([*(word() for _ in range(rng.randrange(6, 20))), "end?", *(word() for _ in range(rng.randrange(3, 9)))])) for k in range(24)]
    docs = []
    for k in range(120):
        own = rng.choice(items)[1].split()
        how, kept = k % 6, rng.random()
        if how == 1:
            own = [w for w in own if rng.random() < kept]
        elif how == 2:
            own = [w if rng.random() < kept else word() for w in own]
        elif how == 3:
            own = own[: own.index("end?") + 1] if rng.random() < 0.5 else own[own.index("end?") + 1 :]
        elif how == 4:
            at = rng.randrange(len(own))
            own = own[at:] + own[:at]
        elif how == 5:
            own = []
        text = [word() for _ in range(rng.randrange(0, 150))]
        at = rng.randrange(len(text) + 1)
        docs.append((k, " ".join([*text[:at], *own, *text[at:]])))
    return docs, items


@pytest.mark.parametrize(("seed", "threshold", "overlap"), [(0, 0.5, 0.5), (1, 0.3, 0.2), (2, 0.8, 0.7), (3, 0.5, 0.0), (4, 0.5, 0.0)])
def test_the_whole_query_equals_brute_force(spark, seed, threshold, overlap):
    docs, items = damaged(seed)
    out = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), threshold, overlap, shard_postings=150).collect()
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in out}
    want = brute.leaks(docs, items, threshold, overlap, decontaminate.split_item)
    assert len(out) == len(got) > 10 and set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in got)


def test_half_of_an_item_is_no_leak_but_both_its_parts_are(spark):
    item = [(1, "what is the tallest mountain of the northern range near the old border town? it is called the grey summit")]
    docs = [(1, "he asked what is the tallest mountain of the northern range near the old border town? nobody knew"), (2, "x " * 300 + item[0][1] + " y" * 300), (3, "it is called the grey summit"), (4, item[0][1].title().replace(" ", ",\n"))]
    assert found(spark, docs, item) == {(2, 1), (4, 1)}


def test_edge_cases(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "alpha beta gamma delta epsilon zeta eta theta"), (3, None), (4, "..."), (5, "single"), (None, "alpha beta gamma")]
    docs = [(1, None), (2, ""), (3, items[0][1]), (3, items[0][1]), (4, "!!!"), (5, "word " * 70_000 + items[0][1])]
    frame = spark.createDataFrame(docs, DOCS).withColumns({"item": F.lit(1), "id": F.lit("clash"), "score": F.lit(2)})
    out = decontaminate.find_leaks(frame, spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in out) == [(3, 1), (3, 1), (3, 2), (3, 2), (5, 1), (5, 2)]
    assert found(spark, [], items) == set() and found(spark, docs, []) == set()
    kept = decontaminate.clean_documents(frame, spark.createDataFrame(items, ITEMS))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4] and kept.columns == frame.columns


@pytest.mark.parametrize("times", (2, 3))
def test_repeated_benchmark_rows_change_nothing(spark, times):
    docs, items, leaks = planted(5)
    part = [(200 + k, " ".join(w for n, w in enumerate(items[k][1].split()) if n != 3)) for k in range(0, 30, 7)]
    once = spark.createDataFrame(docs + part, DOCS)
    rows = [tuple(r) for r in decontaminate.find_leaks(once, spark.createDataFrame(items, ITEMS)).collect()]
    again = [tuple(r) for r in decontaminate.find_leaks(once, spark.createDataFrame(items * times, ITEMS)).collect()]
    assert sorted(rows) == sorted(again) and {r[:2] for r in again} == leaks | {(200 + k, k) for k in range(0, 30, 7)}
    kept = decontaminate.clean_documents(once, spark.createDataFrame(items * times, ITEMS))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in leaks}


def test_texts_of_one_item_id_and_items_without_an_id(spark):
    rng = random.Random(6)
    first, second, third = (" ".join(words(rng, 25)) for _ in range(3))
    items = [(1, first), (1, second), (1, second), (None, third), (None, third)]
    docs = [(1, first), (2, second), (3, f"{first} {second}"), (4, third), (5, " ".join(words(rng, 50)))]
    for shard_postings in (20, 10_000):
        out = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), shard_postings=shard_postings)
        assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == [(1, 1), (2, 1), (3, 1)]
        kept = decontaminate.clean_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), shard_postings=shard_postings)
        assert [r["doc_id"] for r in kept.collect()] == [5]
