"""N-gram Jaccard self-join: exact links between texts, by signature trees over groups that share a prefix n-gram.

1. Every text becomes its set of hashed word n-grams (64-bit; equal hashes count as equal n-grams) and a bitmap of it. Equal
   sets collapse to their smallest id.
2. Two sets with Jaccard >= p % share one of the first n - ceil(p n / 100) + 1 n-grams of either, in any common order of
   n-grams. The order used first puts n-grams last that repeat within a task's window of texts, by their summed count.
3. In each group of up to TREE_ROWS texts that share such an n-gram, a signature tree (nodes hold OR-combined bitmaps and
   size ranges) is traversed against itself; node pairs whose largest possible overlap or sizes cannot reach the threshold
   are pruned. What is left of a group is kept as a spanning forest.
4. Texts of larger groups, however their rows were dealt, are matched among themselves once more: all their n-grams are
   counted exactly, and in the new order the rarest come first, so a passage that many texts share leads few of them
   together. Only groups that are large in that order too, of texts that common passages make up almost wholly, are kept
   as a star. The connected pieces hold every link. Neither order changes the result.
5. The full sets are brought to their piece once and compared exactly. A piece over BLOCK texts is cut into blocks by
   three independent hashes; whatever these leave unconnected is compared block against block, leaving out blocks of one
   component. Only components are made, so a group of copies is never expanded into all its pairs.

The tables of n-grams for the orders are bounded (HOT_ROWS) and are the only things sent to the driver; joins broadcast only
sides of a checked size, and all tables in between are deleted. Edge cases: null or empty text and text without words has an empty set, linked with nothing; a text with fewer words
than an n-gram is one n-gram; rows of one id count as one document with links of all its texts; a null id gets a null
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch, map_arrow, shuffle_partitions, small
from .wordhash import mix, shingle_sets, text_chunks

#: Bits of a bitmap for each n-gram of the text (rounded up to a power of two), and the least and most bits.
BITS_PER_GRAM, LEAST_BITS, MOST_BITS = 2, 256, 1 << 17
#: N-grams whose counts are kept for the order, at most, and the least count.
HOT_ROWS, HOT_COUNT = 1_000_000, 32
#: Hashes whose repeats are counted at once in a task.
WINDOW = 1_500_000
#: Largest group that is searched by a tree; rows of a group that may be together in one partition; texts of a block.
TREE_ROWS, SPLIT_ROWS, BLOCK = 256, 20_000, 64
LEAF, FANOUT = 8, 4
#: Sets with copies up to which their table is broadcast.
CLASS_ROWS = 200_000


def _flat(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, sets end to end, where each begins) of runs of (id, text) rows."""
    for batch in batches:
        for first, last, data, offsets in text_chunks(batch.column(1)):
            sets, begin = shingle_sets(data, offsets, size)
            yield batch.column(0).slice(first, last - first), sets, begin


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def bitmap_bits(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, int(BITS_PER_GRAM * n - 1)).bit_length()))


def _describe(size: int):
    """Per text: size, fingerprint and bitmap of its set (kind 0); per window: repeated n-grams with their count (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, window, held = ["kind", "id", "n", "fp1", "fp2", "bits"], [], 0

        def repeats():
            hashes, counts = np.unique(np.concatenate(window), return_counts=True)
            often = counts >= 3
            n = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.array(counts[often].astype(np.int32)), _long(hashes[often]), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.binary())], names)

        for ids, sets, begin in _flat(batches, size):
            k = len(ids)
            spread = mix(sets)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))
            again = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(spread ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
            bits = []
            for i in range(k):
                wide = bitmap_bits(begin[i + 1] - begin[i])
                mask = np.zeros(wide, bool)
                mask[(sets[begin[i] : begin[i + 1]] & np.uint64(wide - 1)).astype(np.int64)] = True
                bits.append(np.packbits(mask, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(k, np.int32)), ids, pa.array(np.diff(begin).astype(np.int32)), _long(sums[begin[1:]] - sums[begin[:-1]]), _long(again[begin[1:]] - again[begin[:-1]]), pa.array(bits, pa.binary())], names
            )
            window.append(sets)
            held += len(sets)
            if held >= WINDOW:
                yield repeats()
                window, held = [], 0
        if window:
            yield repeats()

    return run


def _gram_counts(size: int):
    """(gram, n): the distinct n-grams of a window of texts and in how many of them each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, held = [], 0

        def counted():
            grams, counts = np.unique(np.concatenate(window), return_counts=True)
            return pa.RecordBatch.from_arrays([_long(grams), pa.array(counts.astype(np.int32))], ["gram", "n"])

        for _, sets, _ in _flat(batches, size):
            window.append(sets)
            held += len(sets)
            if held >= WINDOW:
                yield counted()
                window, held = [], 0
        if window:
            yield counted()

    return run


def _prefixes(size: int, percent: int, hot):
    """(key, salt, id, n, pos) of each text's leading n-grams; pos: n-grams before it in the order; salt is -1, or a part of a key with over SPLIT_ROWS texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = hot.value
        seen = np.zeros(1 << 20, bool)
        seen[(hashes >> np.uint64(44)).astype(np.int64)] = True
        for ids, sets, begin in _flat(batches, size):
            n = np.diff(begin)
            lead = n - -(-percent * n // 100) + 1
            count = np.zeros(len(sets), np.int64)
            if len(hashes):
                maybe = np.flatnonzero(seen[(sets >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(hashes, sets[maybe]), len(hashes) - 1)
                count[maybe] = np.where(hashes[at] == sets[maybe], counts[at], 0)
            before = np.concatenate(([0], np.cumsum(count > 0)))
            sets, count = sets.copy(), count
            for i in np.flatnonzero(before[begin[1:]] > before[begin[:-1]]):
                own = slice(begin[i], begin[i + 1])
                order = np.argsort(count[own], kind="stable")
                sets[own], count[own] = sets[own][order], count[own][order]
            lead[n == 0] = 0
            text = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(sets)) - begin[text]
            take = place < lead[text]
            keys, owner, often = sets[take], ids.to_numpy()[text[take]], count[take]
            parts = -(-often // SPLIT_ROWS)
            salt = np.where(often > SPLIT_ROWS, (mix(owner.view(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), -1)
            yield pa.RecordBatch.from_arrays([_long(keys), pa.array(salt.astype(np.int32)), pa.array(owner), pa.array(n[text[take]].astype(np.int32)), pa.array(place[take].astype(np.int32))], ["key", "salt", "id", "n", "pos"])

    return run


def _columns(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found).combine_chunks() if found else None


def _enough(overlap, low_a, low_b, percent: int):
    return (100 + percent) * overlap >= percent * (low_a + low_b)


def _shared(percent: int):
    """Keeps the rows of keys that texts of matching sizes and positions share, with the group's rows (-1: part of a large group).

    Two texts whose first common n-gram is this one have no more in common than what follows it in either, itself included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _columns(batches)
        if table is None:
            return
        key, salt, owner, n, pos = (table.column(c).to_numpy() for c in ("key", "salt", "id", "n", "pos"))
        order = np.lexsort((n, key))
        key, salt, owner, n, rest = key[order], salt[order], owner[order], n[order].astype(np.int64), (n - pos)[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        rows = np.repeat(sizes, sizes)
        keep = (rows > LEAF) | (salt >= 0)
        for shift in range(1, LEAF):
            i = np.flatnonzero((rows[:-shift] > shift) & (rows[:-shift] <= LEAF) & (key[shift:] == key[:-shift]))
            j = i + shift
            i, j = (x[(100 * n[i] >= percent * n[j]) & _enough(np.minimum(rest[i], rest[j]), n[i], n[j], percent)] for x in (i, j))
            keep[i] = keep[j] = True
        rows = np.where(salt >= 0, -1, rows)
        yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(owner[keep]), pa.array(n[keep].astype(np.int32)), pa.array(rest[keep].astype(np.int32)), pa.array(rows[keep].astype(np.int32))], ["key", "id", "n", "rest", "rows"])

    return run


class Bitmaps:
    """Bitmaps of different widths (powers of two), compared at the narrower one's after folding the wider."""

    def __init__(self, raw: list[bytes], n: np.ndarray):
        self.raw, self.n = raw, n
        self.width = np.array([8 * len(x) for x in raw], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def at(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows at a width, each text's row (texts of less width have none) and by how many n-grams a set exceeds its bits."""
        if width not in self.folded:
            place, parts, done = np.full(len(self.raw), -1, np.int64), [], 0
            for wide in np.unique(self.width[self.width >= width]):
                own = np.flatnonzero(self.width == wide)
                words = np.frombuffer(b"".join(self.raw[k] for k in own), np.uint64).reshape(len(own), wide // width, width // 64)
                parts.append(np.bitwise_or.reduce(words, axis=1))
                place[own] = done + np.arange(len(own))
                done += len(own)
            rows = np.concatenate(parts)
            spare = np.zeros(len(self.raw), np.int64)
            there = place >= 0
            spare[there] = self.n[there] - np.bitwise_count(rows).sum(axis=1).astype(np.int64)[place[there]]
            self.folded[width] = rows, place, spare
        return self.folded[width]

    def overlap(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The largest overlap that the bitmaps leave to pairs of texts."""
        found, narrow = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for width in np.unique(narrow):
            own = np.flatnonzero(narrow == width)
            rows, place, spare = self.at(int(width))
            for part in np.array_split(own, max(1, len(own) * int(width) >> 27)):
                a, b = i[part], j[part]
                found[part] = np.bitwise_count(rows[place[a]] & rows[place[b]]).sum(axis=1).astype(np.int64) + np.minimum(spare[a], spare[b])
        return found


def _pairs_left(maps: Bitmaps, rest: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of texts may link, by sizes, positions and then bitmaps."""
    n = maps.n
    ok = (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i]) & _enough(np.minimum(rest[i], rest[j]), n[i], n[j], percent)
    left = np.flatnonzero(ok)
    ok[left] = _enough(maps.overlap(i[left], j[left]), n[i[left]], n[j[left]], percent)
    return ok


def tree_forest(maps: Bitmaps, rest: np.ndarray, own: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs among texts own that sizes, positions and bitmaps do not rule out.

    A signature tree over own (in the order of sizes) is traversed against itself: node pairs stay while their size ranges
    and the common bits of their OR-combined bitmaps allow some pair to link. Pairs within one component are skipped.
    """
    rows, n, rest_of = len(own), maps.n[own], rest[own]
    bits, place, spare = maps.at(int(maps.width[own].min()))
    bits, spare = bits[place[own]], spare[own]
    levels, width = [], LEAF
    while True:
        cuts = np.arange(0, rows, width)
        levels.append((width, np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(n, cuts), *(np.maximum.reduceat(x, cuts) for x in (n, spare, rest_of))))
        if len(cuts) == 1:
            break
        width *= FANOUT
    a = b = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        width, node_bits, low, high, extra, left = levels[depth]
        overlap = np.bitwise_count(node_bits[a] & node_bits[b]).sum(axis=1).astype(np.int64) + np.minimum(extra[a], extra[b])
        overlap = np.minimum(overlap, np.minimum(left[a], left[b]))
        ok = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a]) & _enough(overlap, low[a], low[b], percent)
        a, b = a[ok], b[ok]
        fan, count = (FANOUT, -(-rows // (width // FANOUT))) if depth else (LEAF, rows)
        kids_a = np.repeat(a, fan * fan) * fan + np.tile(np.repeat(np.arange(fan), fan), len(a))
        kids_b = np.repeat(b, fan * fan) * fan + np.tile(np.tile(np.arange(fan), fan), len(b))
        ok = (kids_a < count) & (kids_b < count) & (kids_a <= kids_b)
        a, b = kids_a[ok], kids_b[ok]
    a, b = a[a < b], b[a < b]
    parent = list(range(rows))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for start in range(0, len(a), 1 << 13):
        i, j = a[start : start + (1 << 13)], b[start : start + (1 << 13)]
        at = np.array([root(x) for x in range(rows)])
        apart = at[i] != at[j]
        i, j = i[apart], j[apart]
        ok = _pairs_left(maps, rest, own[i], own[j], percent)
        for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            if (rx := root(x)) != (ry := root(y)):
                parent[ry] = rx
                found.append((x, y))
    return found


def _candidates(percent: int):
    """Edges (a, b) that connect, in each key's group, all texts that sizes, positions and bitmaps allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _columns(batches)
        if table is None:
            return
        key, owner, n, rest = (table.column(c).to_numpy() for c in ("key", "id", "n", "rest"))
        order = np.lexsort((owner, n, key))
        key, owner, n, rest = key[order], owner[order], n[order].astype(np.int64), rest[order].astype(np.int64)
        maps = Bitmaps(table.column("bits").take(pa.array(order)).to_pylist(), n)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        few = np.repeat(sizes <= LEAF, sizes)
        edges = []
        for shift in range(1, LEAF):  # groups of one leaf, all at once
            i = np.flatnonzero(few[:-shift] & (key[shift:] == key[:-shift]) & (owner[shift:] != owner[:-shift]))
            i = i[_pairs_left(maps, rest, i, i + shift, percent)]
            edges.append(np.stack((owner[i], owner[i + shift]), axis=1))
        for g in np.flatnonzero(sizes > LEAF):
            own = np.arange(starts[g], starts[g] + sizes[g])
            found = tree_forest(maps, rest, own, percent)
            if found:
                edges.append(owner[own][np.array(found)])
        pairs = np.unique(np.concatenate([np.sort(e, axis=1) for e in edges]).reshape(-1, 2), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, begin in _flat(batches, size):
            grams = [sets[begin[i] : begin[i + 1]].tobytes() for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(grams, pa.binary())], ["id", "grams"])

    return run


def linked_parts(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the first one that exact links reach. Overlaps are a product of 0/1 matrices of the shared n-grams."""
    rows = len(sets)
    n = np.array([len(s) for s in sets])
    if rows == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        overlap = np.array([[n[0], common], [common, n[1]]])
    else:
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(rows), n)
        often = count > 1
        place = np.cumsum(often) - 1
        use = often[column]
        row, column = row[use], place[column[use]]
        overlap = np.zeros((rows, rows), np.int64)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for low in range(0, int(often.sum()), 1 << 14):
            i, j = np.searchsorted(column, (low, low + (1 << 14)))
            part = np.zeros((rows, 1 << 14), np.float32)
            part[row[i:j], column[i:j] - low] = 1
            overlap += (part @ part.T).astype(np.int64)
        overlap[np.arange(rows), np.arange(rows)] = n
    linked = 100 * overlap >= percent * (n[:, None] + n[None, :] - overlap)
    label = np.arange(rows)
    while True:
        after = np.where(linked, label[None, :], rows).min(axis=1)
        after = np.minimum(after, label)
        if (after == label).all():
            return label
        label = after[after]


def _verify(percent: int):
    """Edges that span the exactly linked parts of each unit (x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _columns(batches)
        if table is None:
            return
        x, y, owner = (table.column(c).to_numpy() for c in ("x", "y", "id"))
        grams = table.column("grams")
        order = np.lexsort((owner, y, x))
        cuts = np.flatnonzero(np.concatenate(([True], (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1]), [True])))
        edges = []
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[start:end]
            if len(own) > 1:
                label = linked_parts([np.frombuffer(grams[int(k)].as_buffer(), np.uint64) for k in own], percent)
                far = np.flatnonzero(label != np.arange(len(own)))
                edges.append(np.stack((owner[own[far]], owner[own[label[far]]]), axis=1))
        pairs = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _in_units(units: DataFrame, percent: int) -> DataFrame:
    """Links within units: rows (x, y, id, grams)."""
    count = units.select("x", "y", "id").count()
    parts = max(shuffle_partitions(units.sparkSession), count // 4096)
    return map_arrow(units.repartition(parts, "x", "y"), _verify(percent), "a long, b long")


def _exact_links(pieces: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges whose components are the exact links' within pieces (node, component)."""
    sizes = pieces.groupBy("component").agg(F.count("*").alias("rows"))
    placed = scratch.write(sets.join(pieces.withColumnRenamed("node", "id"), "id").join(sizes, "component"), "ngram-sets")
    blocks = F.ceil(F.col("rows") / BLOCK)
    one = placed.where(f"rows <= {BLOCK}").select(F.col("component").alias("x"), F.lit(0).cast("long").alias("y"), "id", "grams")
    rounds = F.explode(F.transform(F.array(*[F.lit(r) for r in range(3)]), lambda r: (r * 1_000_000_000 + F.pmod(F.xxhash64("id", r), blocks)).cast("long")))
    many = placed.where(f"rows > {BLOCK}").select(F.col("component").alias("x"), rounds.alias("y"), "id", "grams")
    links = scratch.write(_in_units(one.unionByName(many), percent), "ngram-links")
    if not sizes.where(f"rows > {BLOCK}").limit(1).count():
        return links
    labels = components(links, scratch)
    large = placed.where(f"rows > {BLOCK}").select("component", "id").join(labels.withColumnRenamed("node", "id").withColumnRenamed("component", "label"), "id", "left")
    large = large.withColumn("label", F.coalesce("label", "id"))
    label_rows = large.groupBy("component", "label").agg(F.count("*").alias("own"))
    split = label_rows.groupBy("component").agg(F.count("*").alias("labels"), F.sum(F.when(F.col("own") <= BLOCK, F.col("own")).otherwise(0)).alias("loose")).where("labels > 1")
    known = large.join(label_rows, ["component", "label"]).join(split, "component")
    pooled = F.col("own") <= BLOCK
    block = F.when(pooled, F.pmod(F.xxhash64("label"), F.ceil(F.col("loose") / BLOCK))).otherwise(F.pmod(F.xxhash64("id"), F.ceil(F.col("own") / BLOCK)))
    known = scratch.write(known.select("component", "id", F.when(pooled, F.lit(-1).cast("long")).otherwise(F.col("label")).alias("side"), block.cast("long").alias("block")), "ngram-blocks")
    units = known.select("component", "side", "block").distinct()
    left, right = (units.select("component", *[F.col(c).alias(f"{c}_{k}") for c in ("side", "block")]) for k in "ab")
    ordered = (F.col("side_a") < F.col("side_b")) | ((F.col("side_a") == -1) & (F.col("side_b") == -1) & (F.col("block_a") <= F.col("block_b")))
    pairs = left.join(right, "component").where(ordered).withColumn("y", F.xxhash64("side_a", "block_a", "side_b", "block_b"))
    members = pairs.select("component", "y", F.explode(F.array_distinct(F.array(F.struct(F.col("side_a").alias("side"), F.col("block_a").alias("block")), F.struct(F.col("side_b").alias("side"), F.col("block_b").alias("block"))))).alias("u")).select("component", "y", "u.*")
    rest = members.join(known, ["component", "side", "block"]).select(F.col("component").alias("x"), "y", "id")
    rest = rest.join(placed.select("id", "grams"), "id")
    more = scratch.write(_in_units(rest.select("x", "y", "id", "grams"), percent), "ngram-more-links")
    return links.unionByName(more)


class _Order:
    """N-grams that come last in an order, with their counts."""

    def __init__(self, counts: DataFrame):
        """counts: (gram, count); the HOT_ROWS largest of at least HOT_COUNT are used."""
        top = counts.where(f"count >= {HOT_COUNT}").orderBy(F.desc("count"), "gram").limit(HOT_ROWS).toPandas()
        hashes = top["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.shared = counts.sparkSession.sparkContext.broadcast((hashes[order], top["count"].to_numpy(np.int64)[order]))


def _groups(texts: DataFrame, order: _Order, grams: float, size: int, percent: int) -> DataFrame:
    """(key, id, n, rest, rows) of _shared for texts (id, text) under an order; grams: how many leading n-grams there are about."""
    keys = map_arrow(texts, _prefixes(size, percent, order.shared), "key long, salt int, id long, n int, pos int")
    parts = max(shuffle_partitions(texts.sparkSession), int(grams // 1_000_000))
    return map_arrow(keys.repartition(parts, "key", "salt"), _shared(percent), "key long, id long, n int, rest int, rows int")


def _in_trees(shared: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Edges of the groups that trees search."""
    own = shared.where(f"rows between 0 and {TREE_ROWS}")
    parts = max(shuffle_partitions(shared.sparkSession), own.count() // 40_000)
    signed = own.join(bitmaps, ["id", "n"])
    return map_arrow(signed.repartition(parts, "key"), _candidates(percent), "a long, b long")


def candidate_pieces(single: DataFrame, described: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component): pieces of texts (id, text, one row per id) outside of which no link is."""
    described_texts = described.where("kind = 0")
    bitmaps = described_texts.select("id", "n", "bits")
    total = described_texts.agg(F.sum(F.col("n") * (100 - percent) / 100 + 1)).first()[0] or 0
    repeats = described.where("kind = 1").groupBy(F.col("fp1").alias("gram")).agg(F.sum("n").alias("count"))
    shared = scratch.write(_groups(single, _Order(repeats), total, size, percent), "ngram-shared")
    edges = _in_trees(shared, bitmaps, percent)
    crowd = scratch.write(shared.where(f"rows < 0 or rows > {TREE_ROWS}").select("id").distinct(), "ngram-crowd")
    if rows := crowd.count():
        # Counted whole, so that it does not matter which task had which rows.
        own = single.join(F.broadcast(crowd) if rows <= CLASS_ROWS else crowd, "id", "left_semi")
        counts = map_arrow(own, _gram_counts(size), "gram long, n int").groupBy("gram").agg(F.sum("n").alias("count"))
        again = scratch.write(_groups(own, _Order(counts), total, size, percent), "ngram-again")
        wide = again.where(f"rows < 0 or rows > {TREE_ROWS}")
        stars = wide.join(wide.groupBy("key").agg(F.min("id").alias("b")), "key").select(F.col("id").alias("a"), "b").where("a <> b")
        edges = edges.unionByName(_in_trees(again, bitmaps, percent)).unionByName(stars)
    return components(scratch.write(edges.distinct(), "ngram-edges"), scratch)


def join_ngrams(documents: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links of Jaccard >= percent / 100 reach), one row per input row."""
    spark = documents.sparkSession
    scratch, kept = Scratch(spark), Scratch(spark)
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    described = scratch.write(map_arrow(source, _describe(size), "kind int, id long, n int, fp1 long, fp2 long, bits binary"), "ngram-described")
    texts = described.where("kind = 0").drop("kind")

    # Written first, so the join deals both sides anew and Spark can split a set that very many texts share.
    classes = scratch.write(texts.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "ngram-classes")
    named = texts.drop("bits").alias("t").join(small(classes, CLASS_ROWS).alias("c"), ["fp1", "fp2", "n"], "left")
    members = kept.write(named.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep")), "ngram-members")

    own = members.where("id is not null").groupBy("id").agg(F.max((F.col("id") == F.col("rep")).cast("int")).alias("first"), F.count("*").alias("rows"))
    copies = own.where("first = 0").select("id")
    single = source.where("id is not null").join(small(copies), "id", "left_anti")
    pieces = candidate_pieces(single, described, size, percent, scratch)

    needed = source.join(small(pieces.select(F.col("node").alias("id"))), "id", "left_semi")
    links = _exact_links(pieces, map_arrow(needed, _sets(size), "id long, grams binary"), percent, scratch)
    repeated = members.join(own.where("rows > 1").select("id"), "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(repeated))
    scratch.drop()
    out = members.join(found, members["rep"] == found["node"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
