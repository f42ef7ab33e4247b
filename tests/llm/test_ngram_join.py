import random

import numpy as np
import pytest

from ledgerlens.llm import ngram_join
from ledgerlens.llm.wordhash import shingle_sets

from . import brute

SCHEMA = "doc_id long, text string"


def run(spark, rows, schema=SCHEMA, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_ngrams(spark.createDataFrame(rows, schema), **options).collect()}


def corpus(rng, groups, copies, words):
    rows, n = [], 0
    for _ in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(*words))]
        for _ in range(rng.randrange(*copies)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 12)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                text = text[: rng.randrange(1, len(text) + 1)]
            rows.append((n, " ".join(text)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = corpus(random.Random(seed), 25, (1, 9), (3, 150))
    assert run(spark, rows) == brute.ngram_join(rows)


def test_a_large_group_is_cut_into_blocks_and_a_common_passage_links_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "TREE_ROWS", 16)
    rng = random.Random(5)
    rows = corpus(rng, 2, (60, 61), (80, 90))
    passage = " ".join(f"p{k}" for k in range(30))
    rows += [(1000 + k, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))) for k in range(60)]
    assert run(spark, rows) == brute.ngram_join(rows)


def test_edge_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \t\n", 9), (4, "A b", 9), (5, "a\x0bB", 9), (6, "a b c", 9), (7, "one two three four five", 9), (8, "ONE two three four five", 9), (9, "É a b c d", 9), (10, "é a b c d", 9), (None, "one two three four five", 9)]
    found = run(spark, rows, "doc_id long, text string, n int")
    assert found[None] == (1, None)
    assert {k: v for k, v in found.items() if k} == brute.ngram_join([(a, b) for a, b, _ in rows if a])


def test_repeated_ids_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    out = ngram_join.join_ngrams(spark.createDataFrame([(1, text), (2, text), (2, other), (3, other), (3, other)], SCHEMA)).collect()
    assert len(out) == 5 and {r["component_id"] for r in out} == {1}
    assert run(spark, spark.createDataFrame([], SCHEMA).collect()) == {}


def test_a_very_long_text(spark):
    base = [f"w{k}" for k in range(30_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:27_000])), (3, " ".join(base[:20_000]))]
    assert run(spark, rows) == brute.ngram_join(rows)


def test_signature_tree_rules_out_no_link():
    rng = random.Random(3)
    rows = corpus(rng, 12, (5, 9), (20, 200))
    data = [t.encode() for _, t in rows]
    sets, begin = shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(x) for x in data]), 5)
    order = np.argsort(np.diff(begin), kind="stable")
    raw, n = [], np.diff(begin)[order]
    for k in order:
        wide = ngram_join.bitmap_bits(int(begin[k + 1] - begin[k]))
        mask = np.zeros(wide, bool)
        mask[(sets[begin[k] : begin[k + 1]] & np.uint64(wide - 1)).astype(np.int64)] = True
        raw.append(np.packbits(mask, bitorder="little").tobytes())
    forest = ngram_join.tree_forest(ngram_join.Bitmaps(raw, n.astype(np.int64)), n.astype(np.int64), np.arange(len(n)), 80)
    part = brute.roots(range(len(n)), forest)
    ids = [rows[k][0] for k in order]
    exact = brute.ngram_join(rows)
    for a in range(len(n)):
        for b in range(a):
            if exact[ids[a]][1] == exact[ids[b]][1]:
                assert part[a] == part[b]


@pytest.mark.parametrize("partitions", [4, 300])
def test_a_passage_of_many_texts_makes_no_large_piece_however_they_are_dealt(spark, partitions):
    from pyspark.sql import functions as F

    from ledgerlens.llm.shared import Scratch, map_arrow

    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(k, passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(40))) for k in range(600)]
    rows += [(1000 + k, rows[k][1] + " end") for k in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(partitions, "doc_id").select(F.col("doc_id").alias("id"), "text")
    scratch = Scratch(spark)
    described = scratch.write(map_arrow(docs, ngram_join._describe(5), "kind int, id long, n int, fp1 long, fp2 long, bits binary"), "t")
    pieces = ngram_join.candidate_pieces(docs, described, 5, 80, scratch).groupBy("component").count()
    assert sorted(r["count"] for r in pieces.collect()) == [2] * 5
    scratch.drop()


def test_texts_made_up_of_common_passages(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE_ROWS", 8)
    monkeypatch.setattr(ngram_join, "HOT_COUNT", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    rng = random.Random(12)
    passages = [" ".join(f"p{j}w{k}" for k in range(20)) for j in range(6)]
    rows = [(k, " ".join(rng.sample(passages, 3)) + f" own{k}") for k in range(80)]
    assert run(spark, rows) == brute.ngram_join(rows)


def test_tables_in_between_are_deleted(spark):
    import os

    from ledgerlens.llm.shared import shared_dir

    folder = shared_dir(spark).removeprefix("file://") + "/ledgerlens"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    ngram_join.join_ngrams(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f g")], SCHEMA)).collect()
    assert sorted(x.rpartition("-")[0] for x in set(os.listdir(folder)) - before) == ["components", "ngram-members"]
