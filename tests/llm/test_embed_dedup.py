import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import embed_dedup

from . import brute

SCHEMA = "vec_id long, embedding array<float>"


def expected(rows, threshold=0.9):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(i for i, _ in rows)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if a in good and b in good and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold]
    component = roots = brute.roots(ids, links)
    count = {i: sum(i in x for x in links) for i in ids}
    return {i: (count[i], component[i], roots[i] == i) for i in ids}


def run(spark, rows, schema=SCHEMA):
    out = embed_dedup.near_embeddings(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}


def clusters(seed, groups, size, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        for _ in range(rng.integers(1, size)):
            rows.append((len(rows), [float(x) for x in (centre + rng.standard_normal(dim) * rng.choice([0.05, 0.3]))]))
    return rows


def test_recall_and_precision_against_brute_force(spark):
    rows = clusters(1, 150, 12)
    found, want = run(spark, rows), expected(rows)
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(f[0] for f in found.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert found == want


def test_a_cell_larger_than_a_block_is_exact(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rows = clusters(2, 3, 60)
    rows += [(1000 + k, rows[0][1]) for k in range(20)]
    assert run(spark, rows) == expected(rows)


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [0.5]), (12, [3.0]), (13, [-1.0])]
    got = run(spark, [(*r, 0, 1) for r in rows], SCHEMA + ", rep int, cell int")
    assert got == {**{i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 10, 13)}, 7: (2, 7, True), 8: (2, 7, False), 9: (2, 7, False), 11: (1, 11, True), 12: (1, 11, False)}


def test_null_ids_and_empty_tables(spark):
    got = run(spark, [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1])])
    assert got == {None: (0, None, True), 1: (1, 1, True), 2: (1, 1, False)}
    assert embed_dedup.near_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("dim", [8, 64])
def test_estimates_are_unbiased_and_bounded(dim):
    rng = np.random.default_rng(dim)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.standard_normal((2, 400, dim)))
    turn = embed_dedup.rotation(dim)
    rotated, codes, factor = embed_dedup.encode(b, turn)
    guess, bound = embed_dedup.estimate(a @ turn, codes, factor)
    error = guess - a @ b.T
    assert abs(error.mean()) < 0.01 and (np.abs(error) <= bound[None, :]).mean() > 0.999


def test_multiplicity_of_a_hot_vector(spark):
    docs = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.when(F.col("id") < 300, 0.0).otherwise(F.col("id") * 1.0)).cast("array<float>").alias("embedding"))
    out = embed_dedup.near_embeddings(docs)
    assert out.where("vec_id < 300 and n_links <> 299").count() == 0 and out.where("kept").count() == 2


def test_rows_of_one_id_are_judged_by_their_own_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.05]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0])]
    out = sorted(tuple(r) for r in embed_dedup.near_embeddings(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]


def test_signed_zeros_are_equal_and_doubles_keep_their_width(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [1e-200, 1e-200])]
    assert run(spark, rows[:2]) == {1: (1, 1, True), 2: (1, 1, False)}
    assert run(spark, [*rows[2:], (4, [1.0, 1.0])], "vec_id long, embedding array<double>") == {3: (1, 3, True), 4: (1, 3, False)}


def test_a_tree_of_two_levels_finds_the_links(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "ONE_BRANCH", 4)
    monkeypatch.setattr(embed_dedup, "ROWS_PER_CELL", 8)
    rows = clusters(7, 260, 9)
    found, want = run(spark, rows), expected(rows)
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(f[0] for f in found.values()) >= 0.95 * sum(w[0] for w in want.values())


def test_leaves_of_a_tree():
    rng = np.random.default_rng(4)
    sample = rng.standard_normal((3000, 8)).astype(np.float32)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    tree = embed_dedup.Tree(sample, 700)
    near = tree.nearest(sample)
    assert tree.first[-1] == len(tree.leaves) and near.max() < len(tree.leaves) and near.shape == (3000, embed_dedup.PROBES)
    assert all(len(set(r[r >= 0])) == (r >= 0).sum() >= 1 for r in near)
    exact = np.argmax(sample @ tree.leaves.T, axis=1)
    assert np.mean([e in r for e, r in zip(exact, near, strict=True)]) > 0.95


def test_forest_spans_the_components():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 80, (2, 60))
    x, y = embed_dedup._forest(a, b)
    nodes = set(a.tolist()) | set(b.tolist())
    assert brute.roots(sorted(nodes), zip(a.tolist(), b.tolist(), strict=True)) == brute.roots(sorted(nodes), zip(x.tolist(), y.tolist(), strict=True))
