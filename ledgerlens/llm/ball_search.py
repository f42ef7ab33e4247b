"""Ranked lexical search: the exact k documents of largest integer score for each item, by ball trees of sparse vectors.

A document's vector has, for each term, (SCALE * tf) div (1000 * tf + 8 * m), where m grows with the document's length; an item's
has its terms' weights times their occurrences. The score is the inner product, in 64-bit integers. Only terms that an item
of the block has can count, so documents are cut down to these by one scan, whose table also gives all counts.

Each task puts its documents, some thousand at a time, into a ball tree: a node has the centroid of its documents and the
largest distance from it, and is split in halves by which of two far documents they are nearer to, down to leaves. Both sides
are scaled by the root of the weights, which leaves products as they are. An inner product is at most that with the centroid
plus the item's length times the radius, so subtrees are opened best first and the search of a tree ends at the first node
whose bound is below the item's k-th score so far. Bounds are raised by more than all rounding can lower them; a node whose bound
equals that score is opened, since ties go to the smaller id. Leaves are scored exactly. A task's k best of each item are
kept from tree to tree and are all that it returns.

Terms are known by 64-bit hashes of their bytes and by their length. Items are taken in blocks, for each of which the
documents are scanned once; a block's terms are counted where the documents are, and only sums leave the tasks.

Edge cases: null and empty texts, and texts without terms, are no documents, and such items find nothing; repeated documents
are documents of their own, rows of one id too; one without an id comes last among equal scores; repeated items have their rows
each; very long texts count whole; an empty table on either side gives an empty result; other columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, map_arrow, small
from .wordhash import MARKS, text_chunks, word_hashes

#: What the largest value of a vector nears.
SCALE = 1_000_000_000
#: Items and their terms of a block at most.
BLOCK_ITEMS, BLOCK_TERMS = 4096, 1_000_000
#: Documents and entries of a tree at most, documents of a leaf.
TREE_DOCS, TREE_ENTRIES, LEAF_DOCS = 4096, 2_000_000, 32
VECTOR = "id long, n long, terms array<int>, tfs array<int>"
#: An id that is missing comes after all others.
LAST = 1 << 63


@dataclass
class Block:
    """Items and their terms. hashes are sorted; term and times are those of item k from first[k] on."""

    names: list[int]
    hashes: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of each term of the texts, and each text's first."""
    hashes, sizes, first = [], [], [0]
    for text in texts:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        words, _, begin, end = word_hashes(raw, np.array([0, len(raw)]), MARKS)
        hashes.append(words)
        sizes.append(end - begin)
        first.append(first[-1] + len(words))
    none = np.zeros(0, np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([none, *sizes]), np.array(first)


def make_block(items: list[tuple[int, str | None]]) -> Block:
    words, sizes, first = _words([text for _, text in items])
    hashes, place, term = np.unique(words, return_index=True, return_inverse=True)
    item = np.repeat(np.arange(len(items)), np.diff(first))
    pair, times = np.unique(item * max(1, len(hashes)) + term, return_counts=True)
    item, term = pair // max(1, len(hashes)), pair % max(1, len(hashes))
    return Block([name for name, _ in items], hashes, sizes[place], np.searchsorted(item, np.arange(len(items) + 1)), term, times)


def blocks(items: DataFrame) -> Iterator[Block]:
    """Items (item, text) by blocks of a bounded size."""
    held, words = [], 0
    for r in items.select("item", "text").toLocalIterator():
        held.append((r["item"], r["text"]))
        words += len(r["text"] or "") // 2
        if len(held) >= BLOCK_ITEMS or words >= BLOCK_TERMS:
            yield make_block(held)
            held, words = [], 0
    if held:
        yield make_block(held)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _vectors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        count = len(block.hashes)
        seen = np.zeros(1 << 20, bool)
        seen[(block.hashes >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                words, begin, starts, ends = word_hashes(data, offsets, MARKS)
                maybe = np.flatnonzero(seen[(words >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(block.hashes, words[maybe]), count - 1)
                known = (block.hashes[at] == words[maybe]) & (block.sizes[at] == ends[maybe] - starts[maybe])
                text = np.searchsorted(begin, maybe[known], "right") - 1
                pair, tf = np.unique(text * count + at[known], return_counts=True)
                upto = np.searchsorted(pair // count, np.arange(last - first), "right")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(begin)), _lists(pair % count, upto), _lists(tf, upto)], ["id", "n", "terms", "tfs"])

    return run


def _counts(terms: int):
    """(term, df) of what a task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(df[own])], ["term", "df"])

    return run


@dataclass
class Rows:
    """Sparse rows: entries of row k are those from first[k] to first[k + 1]."""

    first: np.ndarray
    column: np.ndarray
    value: np.ndarray

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """The product of each row; every row has entries."""
        return np.add.reduceat(self.value * dense[self.column], self.first[:-1])

    def take(self, rows: np.ndarray) -> Rows:
        count = self.first[rows + 1] - self.first[rows]
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) + np.repeat(self.first[rows] - (ends - count), count)
        return Rows(np.concatenate(([0], ends)), self.column[at], self.value[at])

    def one(self, row: int, columns: int) -> np.ndarray:
        dense = np.zeros(columns)
        own = slice(self.first[row], self.first[row + 1])
        dense[self.column[own]] = self.value[own]
        return dense


@dataclass
class Tree:
    """Nodes in the order in which they were made: children of node k are child[k] and child[k] + 1, of a leaf 0.

    Of a node's centroid only the product with each item is kept: products is (node, item).
    """

    order: np.ndarray  # rows, so that each node's follow each other
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    products: np.ndarray
    radius: np.ndarray


def build(rows: Rows, columns: int, leaf: int, items: Rows) -> Tree:
    """A ball tree over the rows, for these items. Radii are rounded up by more than their rounding errors."""
    asked = len(items.first) - 1
    item = np.repeat(np.arange(asked), np.diff(items.first))
    size = len(rows.first) - 1
    squares = np.add.reduceat(rows.value * rows.value, rows.first[:-1])
    order = np.arange(size)
    low, high, child, products, radius = [0], [size], [0], [], []
    node = 0
    while node < len(low):
        own = order[low[node] : high[node]]
        part, square = rows.take(own), squares[own]
        mean = np.bincount(part.column, weights=part.value, minlength=columns) / len(own)
        middle = float(mean @ mean)
        away = square - 2 * part.dot(mean) + middle
        products.append(np.bincount(item, weights=items.value * mean[items.column], minlength=asked))
        radius.append(math.sqrt(max(0.0, float((away + 1e-10 * (square + middle)).max()))))
        if len(own) > leaf:
            one = int(away.argmax())
            far = part.one(one, columns)
            other = part.one(int((square - 2 * part.dot(far)).argmax()), columns)
            halves = np.argsort(-part.dot(far - other), kind="stable")
            order[low[node] : high[node]] = own[halves]
            cut = low[node] + len(own) // 2
            child[node] = len(low)
            low += [low[node], cut]
            high += [cut, high[node]]
            child += [0, 0]
        node += 1
    return Tree(order, np.array(low), np.array(high), np.array(child), np.array(products), np.array(radius))


def bounds(tree: Tree, lengths: np.ndarray) -> np.ndarray:
    """(item, node): no inner product of a node's rows with an item of this length is larger, rounding included."""
    return (tree.products.T + lengths[:, None] * tree.radius[None, :]) * (1 + 1e-9) + 1e-3


class Search:
    """The k best (score, id) of each item among the documents seen; scored counts the leaves opened of those there are."""

    def __init__(self, block: Block, weights: np.ndarray, documents: int, words: int, k: int, leaf: int):
        self.block, self.weights, self.documents, self.words, self.k, self.leaf = block, weights, documents, words, k, leaf
        self.best: list[list[tuple[int, int]]] = [[] for _ in block.names]
        self.opened = self.leaves = 0

    def add(self, ids: list[int | None], n: np.ndarray, first: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents with at least one term of the block's each."""
        m = 25 + (75 * n * self.documents) // self.words
        value = (SCALE * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(first)))
        columns, column = np.unique(term, return_inverse=True)
        root = np.sqrt(self.weights[columns].astype(float))
        # The items' terms that the tree has.
        at = np.minimum(np.searchsorted(columns, self.block.term), len(columns) - 1)
        there = columns[at] == self.block.term
        item = np.repeat(np.arange(len(self.block.names)), np.diff(self.block.first))[there]
        items = Rows(np.searchsorted(item, np.arange(len(self.block.names) + 1)), at[there], self.block.times[there])
        scaled = items.value * root[items.column]
        lengths = np.sqrt(np.bincount(item, weights=scaled * scaled, minlength=len(self.block.names)))
        tree = build(Rows(first, column, value * root[column]), len(columns), self.leaf, Rows(items.first, items.column, scaled))
        exact = Rows(first, column, value * self.weights[term]).take(tree.order)
        keys = [LAST if ids[k] is None else ids[k] for k in tree.order.tolist()]
        most = bounds(tree, lengths)
        times = np.zeros(len(columns), np.int64)
        self.leaves += int((tree.child == 0).sum()) * len(self.block.names)
        for k in np.flatnonzero(np.diff(items.first)).tolist():
            own = slice(items.first[k], items.first[k + 1])
            times[items.column[own]] = items.value[own]
            self._search(tree, exact, keys, most[k].tolist(), times, self.best[k])
            times[items.column[own]] = 0

    def _search(self, tree: Tree, exact: Rows, keys: list[int], most: list[float], times: np.ndarray, best: list[tuple[int, int]]) -> None:
        """Opens nodes best first until no bound reaches the k-th score."""
        waiting = [(-most[0], 0)]
        while waiting:
            bound, node = heapq.heappop(waiting)
            least = best[0][0] if len(best) == self.k else 1
            if -bound < least:
                return
            if child := int(tree.child[node]):
                for k in (child, child + 1):
                    if most[k] >= least:
                        heapq.heappush(waiting, (-most[k], k))
                continue
            self.opened += 1
            low, high = int(tree.low[node]), int(tree.high[node])
            part = slice(exact.first[low], exact.first[high])
            score = np.add.reduceat(exact.value[part] * times[exact.column[part]], exact.first[low:high] - exact.first[low])
            for row in np.flatnonzero(score >= least).tolist():
                found = (int(score[row]), -keys[low + row])
                if len(best) < self.k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


def _searcher(shared, k: int, tree_docs: int, leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights, documents, words = shared.value
        search = Search(block, weights, documents, words, k, leaf)
        ids, n, counts, terms, tfs, entries = [], [], [], [], [], 0

        def close() -> None:
            if ids:
                first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
                search.add(ids, np.concatenate(n), first, np.concatenate(terms), np.concatenate(tfs))

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                length = np.array(part.column(2).value_lengths())
                some = length > 0
                ids += part.column(0).filter(pa.array(some)).to_pylist()
                n.append(part.column(1).to_numpy()[some])
                counts.append(length[some])
                terms.append(part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                tfs.append(part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                entries += len(terms[-1])
                if len(ids) >= tree_docs or entries >= TREE_ENTRIES:
                    close()
                    ids, n, counts, terms, tfs, entries = [], [], [], [], [], 0
        close()
        rows = [(block.names[q], None if -key == LAST else -key, score) for q, best in enumerate(search.best) for score, key in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["item", "id", "score"])

    return run


def term_weight(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def search_documents(documents: DataFrame, items: DataFrame, k: int = 10, tree_docs: int = TREE_DOCS, leaf_docs: int = LEAF_DOCS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item, rank (int, from 1), id and score of the k best documents of each item whose score is above 0."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    asked = scratch.write(items.select(F.col(item_col).cast("long").alias("name"), F.col(item_text_col).cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()), "search-items")
    found = spark.createDataFrame([], "item long, id long, score long")
    for block in blocks(asked):
        if not len(block.hashes):
            continue
        shared = spark.sparkContext.broadcast(block)
        own = Scratch(spark)
        vectors = own.write(map_arrow(source, _vectors(shared), VECTOR), "search-vectors")
        totals = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("words")).first()
        if totals["words"]:
            df = np.zeros(len(block.hashes), np.int64)
            for r in map_arrow(vectors.select("terms"), _counts(len(df)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
                df[r["term"]] = r["df"]
            known = spark.sparkContext.broadcast((block, term_weight(totals["documents"], df), totals["documents"], totals["words"]))
            # Written before the block's vectors and broadcasts go.
            found = found.unionByName(scratch.write(map_arrow(vectors, _searcher(known, k, tree_docs, leaf_docs), "item long, id long, score long"), "search-hits"))
            known.destroy()
        own.drop()
        shared.destroy()
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(small(asked.select("item", "name")), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
