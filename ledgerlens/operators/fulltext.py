"""English full-text search over postings: where each lexeme stands in each text.

Postings are made once, by the tasks that read the texts, and kept as a table ordered by lexeme: a search reads the lexemes
that some query has, and its work follows their postings. Queries have trees (words together, phrases, OR, minus). Their rank
is the classic one of full-text search in databases, in single precision: for words of which any will do, each lexeme's sum of
1/j**2 over its positions, by the number of lexemes; for words that must be there together, nearness of their positions.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import english
from .search import CELLS, TEXT_BYTES, Filters, _column, _scan, sized

#: Weight of a word in a text without marked parts; what sums of 1/j**2 are divided by.
WEIGHT, SUM_LIMIT = np.float32(0.1), 1.64493406685
PARSED = "tree string, lexemes array<string>, plain boolean, nodes array<string>"


def postings(rows: DataFrame, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lexeme, positions, further columns to keep) of all texts; null and empty texts have none."""
    kinds = [rows.schema[c] for c in (id_col, *keep)]
    types = [to_arrow_type(f.dataType) for f in kinds]
    # Numbered names, for those given may hold dots.
    source = rows.select(F.col(id_col).alias("c0"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(keep, 1)])
    # Texts are short of bytes for the work that they make, and a file may be a single row group: they are dealt to tasks of a number that stays.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 3 * rows.sparkSession.sparkContext.defaultParallelism)
    source = source.where("text <> ''").repartition(parts, F.xxhash64("c0", "text"))
    fields = ["c0", "lexeme", "positions", *[f"c{k}" for k in range(1, len(kinds))]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, words, places = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                held = english.vector(text) if text else {}
                row += [k] * len(held)
                words += held.keys()
                places += held.values()
                if len(words) >= 100_000 or k == batch.num_rows - 1:
                    own = [batch.column(0), *batch.columns[2:]]
                    taken = [c.cast(t).take(pa.array(row, pa.int64())) for c, t in zip(own, types, strict=True)]
                    yield pa.RecordBatch.from_arrays([taken[0], pa.array(words, pa.string()), pa.array(places, pa.list_(pa.int32())), *taken[1:]], fields)
                    row, words, places = [], [], []

    shape = [f"c0 {kinds[0].dataType.simpleString()}", "lexeme string", "positions array<int>", *[f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(kinds[1:], 1)]]
    return source.mapInArrow(run, ", ".join(shape)).toDF(id_col, "lexeme", "positions", *keep)


def write_postings(made: DataFrame, path: str, id_col: str = "id", partitions: int | None = None) -> DataFrame:
    """Keeps postings in order of lexeme and id, so that a search reads few row groups; a frequent lexeme spans several files."""
    order = ["lexeme", id_col]
    ranged = made.repartitionByRange(partitions, *order) if partitions else made.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return made.sparkSession.read.schema(made.schema).parquet(path)


def text_vector(found: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, vector): the lexemes of each text with their positions as one string, in order."""
    one = F.concat(F.lit("'"), "lexeme", F.lit("':"), F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))
    return found.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list(one)), " ").alias("vector"))


def _parse(texts: pd.Series) -> pd.DataFrame:
    trees = [english.websearch(t or "") for t in texts]
    single = lambda t: t[0] == "phrase" and len(t[1]) == 1
    plain = [t is not None and (single(t) or (t[0] == "or" and all(map(single, t[1])))) for t in trees]
    either = lambda t: t[1] if t[0] == "or" and all(x[0] == "phrase" for x in t[1]) else (t,) if single(t) else None
    nodes = [None if t is None or either(t) is None else sorted({json.dumps(x) for x in either(t)}) for t in trees]
    return pd.DataFrame({"tree": [json.dumps(t) for t in trees], "lexemes": [english.operands(t) for t in trees], "plain": plain, "nodes": nodes})


def parse(text: Column) -> Column:
    """Struct of a query: its tree as JSON, its distinct lexemes in order, whether any single one of them will do, and where any word or phrase will, these."""
    return F.pandas_udf(_parse, PARSED)(text)


def any_words(terms: Column) -> Column:
    """The query that asks for any of the terms."""
    return F.array_join(terms, " OR ")


@lru_cache(1)
def occurrence_scores() -> list[float]:
    """What a lexeme with 1, 2, ... positions adds to a rank."""
    out, total = [], np.float32(0)
    for j in range(1, english.MOST + 1):
        total = np.float32(total + np.float32(WEIGHT / np.float32(j * j)))
        out.append(float(np.float32(np.float32(WEIGHT + total) - WEIGHT)) / SUM_LIMIT)
    return out


def rank_any(held: list[list[int]], lexemes: int) -> float:
    """Rank of a text where any lexeme will do; held: the positions of those that it has, in order of the lexemes."""
    scores, total = occurrence_scores(), np.float32(0)
    for positions in held:
        total = np.float32(float(total) + scores[len(positions) - 1])
    return float(np.float32(total / np.float32(lexemes)))


#: Distance from which two positions are far apart; what a far pair adds is lost in single precision beside a rank above LOST.
FAR, LOST = 101, 1e-6


@lru_cache(1)
def pair_scores() -> list[float]:
    """What a pair of positions 0, 1, ... apart adds to a rank; the last is that of all pairs further apart."""
    near = [np.float32(1.0 / (1.005 + 0.05 * math.exp(float(np.float32(apart)) / 1.5 - 2))) for apart in range(FAR)] + [np.float32(1e-30)]
    return [float(np.float32(math.sqrt(float(np.float32(np.float32(WEIGHT * WEIGHT) * x))))) for x in near]


def rank_all(held: list[list[int]]) -> float:
    """Rank of a text whose lexemes belong together: one less the product of what each pair of positions leaves; next to nothing without a pair.

    Positions are in order. A rank of 1 stays, and beside a rank above LOST far pairs change nothing, so these are passed over.
    """
    total, scores = None, pair_scores()
    for k, own in enumerate(held):
        for other in held[:k]:
            for a in own:
                if total is not None and total > LOST:
                    other_near = other[bisect_right(other, a - FAR) : bisect_left(other, a + FAR)]
                else:
                    other_near = other
                for b in other_near:
                    if apart := abs(a - b):
                        one = scores[min(apart, FAR)]
                        total = one if total is None else float(np.float32(1.0 - (1.0 - total) * (1.0 - one)))
                if total == 1.0:
                    return 1.0
    return float(np.float32(1e-20)) if total is None else total


def rank(tree, lexemes: list[str], held: dict[str, list[int]]) -> float:
    """Rank of a text that fits a tree."""
    positions = [held[x] for x in lexemes if x in held]
    together = tree[0] == "and" or (tree[0] == "phrase" and len(tree[1]) > 1)
    return rank_all(positions) if together and len(lexemes) > 1 else rank_any(positions, len(lexemes))


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs that fit, with their score."""
    trees: dict[str, tuple] = {}
    for batch in batches:
        scores = []
        for text, lexemes, hits in zip(batch["tree"], batch["lexemes"], batch["hits"], strict=True):
            if text not in trees:
                trees[text] = json.loads(text)
            held = {h["lexeme"]: list(h["positions"]) for h in hits}
            scores.append(rank(trees[text], list(lexemes), held) if english.matches(trees[text], held) else None)
        out = batch[["c0", "c1"]].assign(score=pd.array(scores, "Float64"))
        yield out[out["score"].notna()].astype({"score": float})


def _may_have(filters: Filters) -> Column:
    """Whether a query may have a row, both with their filter columns."""
    out = F.lit(True)
    for row, query in (filters.equal or {}).items():
        none = F.coalesce(F.col(query).cast("string"), F.lit("")).isin("", "0")
        out &= none | F.coalesce(F.col(row) == F.col(query), F.lit(False))
    for row, query in (filters.contains or {}).items():
        held = F.expr(f"`{row}` ilike concat('%', `{query}`, '%')")
        out &= (F.coalesce(F.col(query), F.lit("")) == "") | F.coalesce(held, F.lit(False))
    return out


def ranked_search(found: DataFrame, queries: DataFrame, k: int, id_col: str = "id", filters: Filters | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best texts of each query (qid, question, filter columns) among postings.

    The filters' row columns are columns that the postings keep. Texts are found by a lexeme of the query: a query of nothing
    but exclusions finds none, as one of nothing but stop words does.
    """
    filters = filters or Filters()
    asked = queries.select("qid", parse(F.col("question")).alias("q"), *filters.query_columns()).select("qid", "q.*", *filters.query_columns()).where(F.size("lexemes") > 0)
    wanted = asked.select("qid", "plain", F.size("lexemes").alias("n"), F.explode("lexemes").alias("lexeme"), *filters.query_columns())
    columns = [id_col, "lexeme", "positions", *filters.row_columns()]
    hits = found.select(*columns).join(sized(wanted), "lexeme").where(_may_have(filters)).select("qid", F.col(id_col).alias("id"), "lexeme", "positions", "plain", "n")

    # One shuffle serves both kinds of queries; where any lexeme will do, positions need not travel.
    one = F.struct("lexeme", F.size("positions").alias("times"), F.when(~F.col("plain"), F.col("positions")).alias("positions"))
    pairs = hits.groupBy("qid", "id").agg(F.array_sort(F.collect_list(one)).alias("hits"), F.first("plain").alias("plain"), F.first("n").alias("n"))
    single = lambda c: c.cast("float").cast("double")  # noqa: E731  each step is rounded to single precision
    scores = F.array(*[F.lit(x) for x in occurrence_scores()])
    total = F.aggregate("hits", F.lit(0.0), lambda s, x: single(s + F.element_at(scores, x["times"])))
    plain = pairs.where("plain").select("qid", "id", single(total / F.col("n")).alias("score"))

    kinds = [found.schema[id_col].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()]
    treed = pairs.where("not plain").join(sized(asked.where("not plain").select("qid", "tree", "lexemes")), "qid")
    other = treed.select(F.col("qid").alias("c1"), F.col("id").alias("c0"), "tree", "lexemes", "hits").mapInPandas(_judge, f"c0 {kinds[0]}, c1 {kinds[1]}, score double").select(F.col("c1").alias("qid"), F.col("c0").alias("id"), "score")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = plain.unionByName(other).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumnRenamed("id", id_col)


def _alternatives(asked: dict[str, list]) -> tuple:
    """Queries by their lexemes, how many these are, queries by their single words, phrases by their first lexeme, queries by their phrases."""
    wanted, single, phrases, by_phrase = {}, {}, {}, {}
    for place, (lexemes, nodes) in enumerate(zip(asked["lexemes"], asked["nodes"], strict=True)):
        for lexeme in lexemes:
            wanted.setdefault(lexeme, []).append(place)
        for node in nodes:
            words = json.loads(node)[1]
            if len(words) == 1:
                single.setdefault(words[0][0], []).append(place)
            else:
                if node not in by_phrase:
                    phrases.setdefault(words[0][0], []).append(node)
                by_phrase.setdefault(node, []).append(place)
    places = lambda held: {k: np.array(p) for k, p in held.items()}
    return places(wanted), np.array([len(x) for x in asked["lexemes"]], float), places(single), {w: [(n, json.loads(n)) for n in x] for w, x in phrases.items()}, places(by_phrase)


def _lexeme_signatures(prepared: tuple, chunk: pa.Table) -> tuple[np.ndarray, tuple[list[tuple], dict]]:
    """How often each text has which wanted lexemes, and the phrases that it fits; texts that no query may have do not count."""
    wanted, _, single, phrases, _ = prepared
    numbers: dict[tuple, int] = {}
    out = []
    for text in _column(chunk, 1).to_pylist():
        held = english.vector(text) if text else {}
        words = tuple(sorted((w, len(p)) for w, p in held.items() if w in wanted))
        fits = tuple(sorted(node for w, _ in words for node, tree in phrases.get(w, ()) if english.matches(tree, held)))
        some = fits or any(w in single for w, _ in words)
        out.append(numbers.setdefault((words, fits), len(numbers)) if some else -1)
    return np.array(out, np.int64), (list(numbers), {})


def _lexeme_hits(prepared: tuple, of: tuple[list[tuple], dict], codes: np.ndarray, queries: np.ndarray, least: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ranks of texts for the queries that they fit; what a signature gives is kept for the groups to come, up to CELLS of them."""
    wanted, sizes, single, _, by_phrase = prepared
    held, known = of
    scores = np.array([0.0, *occurrence_scores()])
    may = np.zeros(len(sizes), bool)
    may[queries] = True

    def ranked(code: int) -> tuple[np.ndarray, np.ndarray]:
        words, fits = held[code]
        total, fit = np.zeros(len(sizes), np.float32), np.zeros(len(sizes), bool)
        for word, times in words:  # each step is rounded to single precision
            total[wanted[word]] = (total[wanted[word]].astype(float) + scores[times]).astype(np.float32)
            if word in single:
                fit[single[word]] = True
        for node in fits:
            fit[by_phrase[node]] = True
        own = np.flatnonzero(fit)
        return own, (total[own].astype(float) / sizes[own]).astype(np.float32).astype(float)

    places, found, values, size = [], [], [], 0
    for place, code in enumerate(codes.tolist()):
        if (made := known.get(code)) is None:
            made = ranked(code)
            if known.get("size", 0) + len(made[0]) <= CELLS:
                known[code], known["size"] = made, known.get("size", 0) + len(made[0])
        own, value = made
        some = may[own] & (value >= least[own])
        own, value = own[some], value[some]
        places.append(np.full(len(own), place))
        found.append(own)
        values.append(value)
        size += len(own)
        if size > CELLS:
            yield np.concatenate(places), np.concatenate(found), np.concatenate(values)
            places, found, values, size = [], [], [], 0
    if size:
        yield np.concatenate(places), np.concatenate(found), np.concatenate(values)


def scanned_search(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "text", filters: Filters | None = None) -> DataFrame:
    """What ranked_search gives, from the texts themselves: for very many queries at once, each of which may have very many texts.

    Queries of alternatives (words or phrases with OR between) are scored where the texts stand, equal signatures once for each
    way to filter, so no row per query and text is shuffled. The others are looked up in postings.
    """
    filters = filters or Filters()
    columns = [c for c in filters.query_columns() if c != "qid"]
    asked = queries.select("qid", "question", parse(F.col("question")).alias("q"), *columns).where(F.size("q.lexemes") > 0)
    either = asked.where("q.nodes is not null").select("qid", "q.lexemes", "q.nodes", *columns)
    best = _scan(rows, [text_col], k, either, ["lexemes", "nodes"], filters, _alternatives, _lexeme_signatures, _lexeme_hits, id_col, TEXT_BYTES)
    other = asked.where("q.nodes is null").drop("q")
    if other.isEmpty():
        return best
    return best.unionByName(ranked_search(postings(rows, id_col, text_col, tuple(filters.row_columns())), other, k, id_col, filters))
