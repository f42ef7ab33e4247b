"""Near-duplicate embeddings by randomised-rotation binary codes.

Vectors are normalised and rotated at random; the signs are the code and the inner product of vector and code direction
is stored as its correction factor. The product of one rotated vector with another's code, divided by that factor, is an
unbiased estimate of their cosine with a known error bound; only pairs whose upper bound reaches the threshold are
recomputed, in double precision. Which vectors meet at all is decided by an index: a tree of centroids of two levels is
fitted on a bounded sample (SAMPLE rows), every vector goes to its PROBES nearest leaves among those under its TOP_PROBES
nearest branches, and cells over BLOCK rows are compared block against block, so no cell is capped. A pair that meets in
several cells counts in the smallest one only. The tests measure recall against brute force.

Leaves follow the number of vectors, ROWS_PER_CELL to a leaf, up to LEAVES; beyond about four million vectors cells grow with
the input. Equal vectors collapse first and are counted by their number. Links are not returned as pairs: tasks return
counts and a spanning forest. Vectors travel to their cells in the width they came in, since a group of near copies has
far more pairs to recompute than vectors.

Every row is judged by its own vector, whatever its id; rows of one id and other vectors are vectors of their own, each
with a result. Edge cases: null, empty or zero vectors and those with null or non-finite components link with nothing, nor
do vectors of different lengths with each other; a null id links with nothing and is kept as such; an empty table gives an
empty result; labels and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch, map_arrow, shuffle_partitions, write_table

SAMPLE, LEAVES, ROWS_PER_CELL, TOP_PROBES, PROBES, BLOCK = 131_072, 65_536, 64, 6, 4, 256
#: Numbers in the sample at most: long vectors have a smaller one.
SAMPLE_VALUES = 1 << 24
#: Leaves up to which there is one branch, so that all are looked at.
ONE_BRANCH = 256
#: Standard errors of the bound on the estimate.
EPSILON = 4.0


def rotation(size: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, packed sign codes and correction factors of unit vectors."""
    rotated = unit @ turn
    signs = rotated >= 0
    factor = np.abs(rotated).sum(axis=1) / np.sqrt(unit.shape[1])
    return rotated, np.packbits(signs, axis=1), factor


def estimate(rotated: np.ndarray, codes: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (rows of rotated by codes) and the error bound of each code."""
    size = rotated.shape[1]
    signs = np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1
    found = (rotated.astype(np.float32) @ signs.T) / np.sqrt(size) / factor[None, :]
    spread = np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor
    return found, EPSILON * spread / np.sqrt(size - 1) if size > 1 else np.full(len(factor), np.inf)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(sample[i : i + 4096] @ centroids.T, axis=1) for i in range(0, len(sample), 4096)])
        order = np.argsort(nearest, kind="stable")
        cells, first = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = centroids.copy()
        centroids[cells] = np.where(length > 0, sums / np.maximum(length, 1e-12), centroids[cells])
    return centroids


class Tree:
    """Centroids of two levels: branches, and the leaves under each (leaf k of branch b is first[b] + k)."""

    def __init__(self, sample: np.ndarray, leaves: int):
        branches = 1 if leaves <= ONE_BRANCH else int(np.ceil(np.sqrt(leaves)))
        self.branches = fit_centroids(sample, branches)
        nearest = np.concatenate([np.argmax(sample[i : i + 4096] @ self.branches.T, axis=1) for i in range(0, len(sample), 4096)])
        found = []
        for b in range(len(self.branches)):
            own = sample[nearest == b]
            found.append(fit_centroids(own, max(1, round(leaves * len(own) / len(sample)))) if len(own) else self.branches[b : b + 1])
        self.first = np.cumsum([0, *[len(x) for x in found]])
        self.leaves = np.concatenate(found)

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        """The PROBES nearest leaves of each vector, in ascending order of number; fewer where its branches have fewer, filled up with -1."""
        tops = min(TOP_PROBES, len(self.branches))
        near = np.argpartition(-(unit @ self.branches.T), tops - 1, axis=1)[:, :tops]
        best, score = np.full((len(unit), PROBES), -1, np.int32), np.full((len(unit), PROBES), -2.0, np.float32)
        for b in np.unique(near):
            rows = np.flatnonzero((near == b).any(axis=1))
            low, high = self.first[b], self.first[b + 1]
            take = min(PROBES, high - low)
            own = unit[rows] @ self.leaves[low:high].T
            at = np.argpartition(-own, take - 1, axis=1)[:, :take]
            both = np.concatenate((score[rows], np.take_along_axis(own, at, axis=1)), axis=1)
            names = np.concatenate((best[rows], (at + low).astype(np.int32)), axis=1)
            keep = np.argpartition(-both, PROBES - 1, axis=1)[:, :PROBES]
            score[rows], best[rows] = np.take_along_axis(both, keep, axis=1), np.take_along_axis(names, keep, axis=1)
        return np.sort(best, axis=1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by the largest component first, so that no square leaves the range of doubles."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(raw: bytes, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(-1, size).astype(np.float64)


def _assign(model, size: int, kind: str):
    """Codes and, for each of a vector's nearest leaves, one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, turn = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                unit = _unit(_matrix(b"".join(part.column(2).to_pylist()), size, kind))
                _, codes, factor = encode(unit, turn)
                near = tree.nearest(unit.astype(np.float32))
                take, column = np.nonzero(near >= 0)
                rows = pa.array(take)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near[take, column]), part.column(0).take(rows), part.column(1).take(rows), part.column(2).take(rows), pa.array([codes[i].tobytes() for i in take], pa.binary()), pa.array(factor[take]), pa.array([near[i].tobytes() for i in take], pa.binary())],
                    ["cell", "id", "copies", "vec", "code", "factor", "probes"],
                )

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of the pairs (a, b): each node with the smallest one that it reaches."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            far = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[far], nodes[label[far]]
        label = after


def _compare(threshold: float, size: int, kind: str, turn_of):
    """Kind 0: (id, weighted links); kind 1: an edge of a spanning forest of the links in a unit (cell, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        _, turn = turn_of.value
        table = pa.Table.from_batches(found).combine_chunks()
        cell, i, j, side, owner, copies = (table.column(c).to_numpy() for c in ("cell", "i", "j", "side", "id", "copies"))
        order = np.lexsort((owner, side, j, i, cell))
        key = np.stack((cell, i, j), axis=1)[order]
        cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1), [True])))
        vec, code, factor, probes = table.column("vec"), table.column("code"), table.column("factor").to_numpy(), table.column("probes")
        take = lambda column, rows: b"".join(column[int(k)].as_buffer() for k in rows)
        kinds, one, two = [], [], []
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            rows = order[start:end]
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            if i[rows[0]] == j[rows[0]]:
                right = left
            if not len(left) or not len(right):
                continue
            unit_a, unit_b = (_unit(_matrix(take(vec, r), size, kind)) for r in (left, right))
            codes = np.frombuffer(take(code, right), np.uint8).reshape(len(right), -1)
            guess, bound = estimate(unit_a @ turn, codes, factor[right])
            a, b = np.nonzero(guess + bound[None, :] >= threshold)
            if right is left:
                a, b = a[a < b], b[a < b]
            else:
                other = owner[left[a]] != owner[right[b]]
                a, b = a[other], b[other]
            exact = np.einsum("ij,ij->i", unit_a[a], unit_b[b]) >= threshold
            a, b = a[exact], b[exact]
            near_a = np.frombuffer(take(probes, left), np.int32).reshape(len(left), -1)
            near_b = np.frombuffer(take(probes, right), np.int32).reshape(len(right), -1)
            common = np.where((near_a[a][:, :, None] == near_b[b][:, None, :]).any(axis=2) & (near_a[a] >= 0), near_a[a], np.iinfo(np.int32).max).min(axis=1)
            mine = common == cell[rows[0]]
            a, b = left[a[mine]], right[b[mine]]
            if not len(a):
                continue
            ends, others = np.concatenate((a, b)), np.concatenate((b, a))
            total = np.bincount(ends, weights=copies[others].astype(float))
            linked = np.flatnonzero(total)
            kinds += [np.zeros(len(linked), np.int32)]
            one += [owner[linked]]
            two += [total[linked].astype(np.int64)]
            ends, others = _forest(a, b)
            kinds += [np.ones(len(ends), np.int32)]
            one += [owner[ends]]
            two += [owner[others]]
        if kinds:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, one, two)], ["kind", "a", "b"])

    return run


def _links(vectors: DataFrame, size: int, kind: str, threshold: float, scratch: Scratch) -> DataFrame:
    """(kind, a, b) of _compare for vectors (id, copies, vec) of one length."""
    spark = vectors.sparkSession
    rows = vectors.count()
    share = min(1.0, 0.98 * min(SAMPLE, SAMPLE_VALUES // size) / max(1, rows))
    sample = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec").toPandas()["vec"]
    units = _unit(_matrix(b"".join(sample), size, kind)).astype(np.float32) if len(sample) else np.eye(1, size, dtype=np.float32)
    model = spark.sparkContext.broadcast((Tree(units, max(1, min(LEAVES, rows // ROWS_PER_CELL, len(units) // 4))), rotation(size)))
    placed = scratch.write(map_arrow(vectors.repartition(shuffle_partitions(spark), "id"), _assign(model, size, kind), "cell int, id long, copies long, vec binary, code binary, factor double, probes binary"), "embed-cells")
    # One row per leaf, LEAVES at most.
    cells = placed.groupBy("cell").agg(F.count("*").alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    blocked = placed.join(F.broadcast(cells.select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("id", "cell"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units_of = blocked.select("cell", "id", "copies", "vec", "code", "factor", "probes", "block", other)
    units_of = units_of.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other"), "side": (F.col("block") > F.col("other")).cast("int")}).drop("block", "other")
    total = cells.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0] or 0
    compared = map_arrow(units_of.repartition(max(shuffle_partitions(spark), total // 20_000), "cell", "i", "j"), _compare(threshold, size, kind, model), "kind int, a long, b long")
    return scratch.write(compared, "embed-links")


def near_embeddings(embeddings: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n_links (other rows linked directly), component_id (smallest id that links reach) and kept (id = component_id), one row per input row."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    kind = "<f4" if embeddings.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    vec = F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    source = embeddings.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    infinite = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", infinite) & F.exists("vec", lambda x: x != 0)
    source = source.withColumn("vec", F.when(F.coalesce(usable, F.lit(False)), F.col("vec")))
    digest = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")]
    classes = source.where("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = scratch.write(classes.select("vec", *digest, "rep", "copies", F.monotonically_increasing_id().alias("number")), "embed-classes")
    sizes = [r[0] for r in classes.select(F.size("vec")).distinct().collect()]
    found = None
    for size in sorted(sizes):
        own = classes.where(F.size("vec") == size).select(F.col("number").alias("id"), "copies", "vec")

        def pack(batches: Iterator[pa.RecordBatch], size=size) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flat = batch.column(2).flatten().to_numpy().reshape(-1, size).astype(kind)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in flat], pa.binary())], ["id", "copies", "vec"])

        packed = scratch.write(map_arrow(own, pack, "id long, copies long, vec binary"), "embed-vectors")
        links = _links(packed, size, kind, threshold, scratch)
        found = links if found is None else found.unionByName(links)
    if found is None:
        found = spark.createDataFrame([], "kind int, a long, b long")
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("others"))
    pieces = components(found.where("kind = 1").select("a", "b"), scratch)
    least = pieces.join(classes.select("number", "rep"), F.col("node") == F.col("number")).groupBy("component").agg(F.min("rep").alias("least"))
    pieces = pieces.join(least, "component").select("node", "least")
    known = classes.select("number", "h1", "h2", "rep", "copies").join(counts, F.col("number") == F.col("a"), "left").join(pieces, F.col("number") == F.col("node"), "left")
    # Written first, so the join deals both sides anew and Spark can split a vector that very many rows share.
    known, _ = write_table(known.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id")), "embed-known")
    scratch.drop()
    named = source.where("vec is not null").select(F.col("id").alias("own"), *digest).join(known, ["h1", "h2"]).select("own", "n_links", "component_id")
    rest = source.where("vec is null").select(F.col("id").alias("own"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = named.unionByName(rest)
    return out.select(F.col("own").alias(id_col), "n_links", "component_id", F.coalesce(F.col("own") == F.col("component_id"), F.lit(True)).alias("kept"))
