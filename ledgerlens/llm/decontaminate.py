"""Benchmark decontamination: every training passage is a query against a BM25 index of the test items.

The inverted index of items keeps, per term, postings in blocks of BLOCK_ITEMS items with the largest impact in each block.
Impacts are BM25 weights divided by the item's own score, so a passage that holds all of an item's terms scores 1 and one
threshold fits all items. Block-max WAND runs over many passages at once: terms whose largest impacts do not reach the
threshold together cannot bring an item in alone, so only the others' blocks are candidates; a candidate block is opened
when the block maxima of all the passage's terms reach the threshold; items of opened blocks are scored in full and all
above the threshold are retrieved. A retrieved item counts when the passage also holds enough of the n-grams of its question
and of its answer. A question ends at the last question mark, else before the last sentence, else half way.

Passages are windows of twice the longest item, at steps of that item's length, over all words of the text (letters and
digits, case and punctuation aside), so every span as long as an item is whole in one. Documents are scanned once per
shard of the index and not shuffled; an index of over SHARD_POSTINGS postings is cut into shards, with statistics of all.

Rows of the benchmark that are equal in id and text are one item; texts that share an item id are matched each by itself
and reported once, by the best of them.

Edge cases: null or empty texts match nothing; an item without words is left out; items of the same text are all reported;
find_leaks leaves out items without an id, clean_documents does not; a document repeated, or without an id, is reported for
each of its rows; an empty table on either side gives an empty result (clean_documents: all documents without items); other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ROW, map_arrow, plain_columns, small, with_row_key, write_table
from .wordhash import MARKS, _BASE, mix, text_chunks, word_hashes

K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
SHARD_POSTINGS = 2_000_000
GRAM = 3


@dataclass
class Index:
    """Terms are numbered in ascending order of their largest impact, items as they come."""

    hashes: np.ndarray  # of terms, sorted
    number: np.ndarray  # of the term of each hash
    largest: np.ndarray  # impact of each term
    first: np.ndarray  # of each term's postings
    item: np.ndarray
    impact: np.ndarray
    block_first: np.ndarray  # of each term's blocks
    block: np.ndarray
    block_impact: np.ndarray
    ids: np.ndarray  # of items
    question: list[tuple[int, np.ndarray]]  # size and hashes of n-grams
    answer: list[tuple[int, np.ndarray]]


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashed n-grams of a word sequence."""
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * np.uint64(_BASE) + words[k : k + len(total)]
    return np.unique(mix(total + np.uint64(size)))


def _part(text: str) -> tuple[int, np.ndarray]:
    """Size of the n-grams of a part (all its words, if it has fewer) and the n-grams."""
    words = _hashes(text)
    size = max(1, min(GRAM, len(words)))
    return size, _grams(words, size)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer; half and half where either would have fewer than GRAM words."""
    at = text.rstrip().rfind("?", 0, len(text.rstrip()) - 1)
    if at < 0:
        body = text.rstrip().rstrip(".!?")
        at = max(body.rfind("."), body.rfind("!"))
    if at < 0 or min(len(text[: at + 1].split()), len(text[at + 1 :].split())) < GRAM:
        words = text.split()
        return " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])
    return text[: at + 1], text[at + 1 :]


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]), MARKS)[0]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, tf, length) of the items."""
    for batch in batches:
        for first, last, data, offsets in text_chunks(batch.column(1)):
            words, begin, _, _ = word_hashes(data, offsets, MARKS)
            for k in range(last - first):
                terms, tf = np.unique(words[begin[k] : begin[k + 1]], return_counts=True)
                n = len(terms)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first + k, 1).take(pa.array(np.zeros(n, np.int64))), pa.array(terms.view(np.int64)), pa.array(tf.astype(np.int32)), pa.array(np.full(n, begin[k + 1] - begin[k], np.int32))], ["item", "term", "tf", "length"])


def build_index(postings, texts: dict[int, str]) -> Index:
    """postings: a frame (item, term, weight) of one shard, weight being the plain BM25 weight."""
    ids = np.unique(postings["item"].to_numpy())
    item = np.searchsorted(ids, postings["item"].to_numpy())
    weight = postings["weight"].to_numpy(float)
    impact = weight / np.bincount(item, weights=weight, minlength=len(ids))[item]
    hashes, term = np.unique(postings["term"].to_numpy().view(np.uint64), return_inverse=True)
    largest = np.zeros(len(hashes))
    np.maximum.at(largest, term, impact)
    rank = np.empty(len(hashes), np.int64)
    rank[np.argsort(largest, kind="stable")] = np.arange(len(hashes))
    order = np.lexsort((item, rank[term]))
    term, item, impact = rank[term][order], item[order], impact[order]
    first = np.searchsorted(term, np.arange(len(hashes) + 1))
    block = item // BLOCK_ITEMS
    starts = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1]))))
    parts = [split_item(texts[int(i)]) for i in ids]
    return Index(
        hashes, rank, np.sort(largest, kind="stable"), first, item, impact, np.searchsorted(term[starts], np.arange(len(hashes) + 1)), block[starts], np.maximum.reduceat(impact, starts), ids,
        [_part(q) for q, _ in parts], [_part(a) for _, a in parts],
    )


def _expand(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term its postings: (which term, posting)."""
    count = first[terms + 1] - first[terms]
    which = np.repeat(np.arange(len(terms)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[terms][which]


def _sums(key: np.ndarray, value: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Sum of value by key, for each of the wanted keys (sorted)."""
    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
    there = wanted[at] == key
    return np.bincount(at[there], weights=value[there], minlength=len(wanted))


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all scores at the threshold or above, from distinct (passage, term) pairs in that order."""
    slack = threshold - 1e-9
    upto = np.cumsum(index.largest[term])
    starts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    begin = np.repeat(starts, np.diff(np.concatenate((starts, [len(passage)]))))
    essential = upto - (upto[begin] - index.largest[term[begin]]) >= slack
    blocks, items = int(index.item.max()) // BLOCK_ITEMS + 1, len(index.ids)
    none = np.zeros(0, np.int64)
    which, posting = _expand(index.block_first, term[essential])
    candidates = np.unique(passage[essential][which] * blocks + index.block[posting])
    if not len(candidates):
        return none, none, none.astype(float)
    own = np.isin(passage, np.unique(candidates // blocks))
    passage, term = passage[own], term[own]
    which, posting = _expand(index.block_first, term)
    bound = _sums(passage[which] * blocks + index.block[posting], index.block_impact[posting], candidates)
    opened = candidates[bound >= slack]
    if not len(opened):
        return none, none, none.astype(float)
    own = np.isin(passage, np.unique(opened // blocks))
    passage, term = passage[own], term[own]
    which, posting = _expand(index.first, term)
    key = passage[which] * blocks + index.item[posting] // BLOCK_ITEMS
    at = np.minimum(np.searchsorted(opened, key), len(opened) - 1)
    there = opened[at] == key
    pair, inverse = np.unique(passage[which[there]] * items + index.item[posting[there]], return_inverse=True)
    score = np.bincount(inverse, weights=index.impact[posting[there]])
    hit = score >= slack
    return pair[hit] // items, pair[hit] % items, score[hit]


def _scan(index_of, step: int, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, names = index_of.value
        first_of: dict[int, int] = {}
        owner = [i if name is None else first_of.setdefault(name, i) for i, name in enumerate(names)]
        seen = np.zeros(1 << 20, bool)
        seen[(index.hashes >> np.uint64(44)).astype(np.int64)] = True
        terms = len(index.hashes)
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                words, begin, _, _ = word_hashes(data, offsets, MARKS)
                maybe = np.flatnonzero(seen[(words >> np.uint64(44)).astype(np.int64)])
                at = np.minimum(np.searchsorted(index.hashes, words[maybe]), terms - 1)
                known = index.hashes[at] == words[maybe]
                place, term = maybe[known], index.number[at[known]]
                if not len(place):
                    continue
                # Passages are pairs of neighbouring steps of a text; passage s begins at step s.
                steps = np.maximum(1, -(-np.diff(begin) // step))
                step_first = np.concatenate(([0], np.cumsum(steps)))
                text = np.searchsorted(begin, place, "right") - 1
                at_step = step_first[text] + (place - begin[text]) // step
                earlier = at_step > step_first[text]
                pairs = np.unique(np.concatenate((at_step * terms + term, (at_step[earlier] - 1) * terms + term[earlier])))
                passage, item, score = retrieve(index, pairs // terms, pairs % terms, threshold)
                best: dict[tuple[int, int], tuple] = {}
                for p, i, s in zip(passage.tolist(), item.tolist(), score.tolist(), strict=True):
                    t = int(np.searchsorted(step_first, p, "right")) - 1
                    low = begin[t] + (p - step_first[t]) * step
                    own = words[low : min(begin[t + 1], low + 2 * step)]
                    shares = []
                    for size, grams in (index.question[i], index.answer[i]):
                        shares.append(len(np.intersect1d(grams, _grams(own, size))) / len(grams) if len(grams) else 1.0)
                    if min(shares) >= overlap:  # scores are sums in any order: equal ones differ in their last digits
                        best[t, owner[i]] = max(best.get((t, owner[i]), ()), (round(s, 9), *shares))
                if best:
                    rows = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([first + t for t, _ in rows])), pa.array([names[i] for _, i in rows], pa.int64()), *[pa.array(np.round([best[r][k] for r in rows], 6)) for k in range(3)]], ["id", "item", "score", "question_overlap", "answer_overlap"]
                    )

    return run


def _leaks(documents: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """What find_leaks returns, and the items without an id, each of whose texts is an item of its own."""
    spark = documents.sparkSession
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = items.select(F.col(item_col).cast("long").alias("name"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    tests, _ = write_table(named.withColumn("item", F.monotonically_increasing_id()), "leak-items")
    postings, _ = write_table(map_arrow(tests.select("item", "text"), _postings, "item long, term long, tf int, length int"), "leak-postings")
    lengths = postings.groupBy("item").agg(F.max("length").alias("length"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), F.max("length").alias("longest")).first()
    empty = spark.createDataFrame([], f"{id_col} long, {item_col} long, score double, question_overlap double, answer_overlap double")
    if not stats["n"]:
        return empty
    idf = postings.groupBy("term").agg(F.log(1 + (stats["n"] - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / stats["mean"]))
    shards = -(-postings.count() // shard_postings)
    # The texts of an item id share a shard, so that its best one is found in one scan.
    shard_of = tests.select("item", F.pmod(F.xxhash64(F.coalesce("name", "item")), F.lit(shards)).alias("shard"))
    weighed, _ = write_table(postings.join(idf, "term").join(small(shard_of), "item").select("item", "term", weight.alias("weight"), "shard"), "leak-index")
    found = None
    for shard in range(shards):
        own = weighed.where(F.col("shard") == shard).select("item", "term", "weight").toPandas()
        if len(own):
            rows = tests.where(F.pmod(F.xxhash64(F.coalesce("name", "item")), F.lit(shards)) == shard).toLocalIterator()
            texts, names = {}, {}
            for r in rows:
                texts[r["item"]], names[r["item"]] = r["text"], r["name"]
            built = build_index(own, texts)
            index = spark.sparkContext.broadcast((built, [names[int(i)] for i in built.ids]))
            hits = map_arrow(source, _scan(index, max(32, stats["longest"]), threshold, overlap), "id long, item long, score double, question_overlap double, answer_overlap double")
            found = hits if found is None else found.unionByName(hits)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def find_leaks(documents: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """id, item, score, question_overlap and answer_overlap (shares of the best passage, of equal scores that with the larger shares): one row per document and item found."""
    return _leaks(documents, items.where(F.col(item_col).isNotNull()), threshold, overlap, id_col, text_col, item_col, item_text_col, shard_postings)


def clean_documents(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those that hold a test item, each row judged by its own text whatever its id.

    Ids may be null or repeated, and equal rows all stay or all go; null and empty texts stay. Items without an id count too.
    Further columns stay, whatever their names.
    """
    text_col = options.get("text_col", "text")
    keyed = with_row_key(plain_columns(documents, (id_col, text_col)))
    leaks = _leaks(keyed, items, id_col=ROW, **options).select(F.col(ROW).alias("__leak")).distinct()
    leaks, _ = write_table(leaks, "leaks")
    return keyed.join(small(leaks), keyed[ROW] == F.col("__leak"), "left_anti").drop(ROW).toDF(*documents.columns)
