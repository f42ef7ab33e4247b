"""Exact vector search, lexical search and reciprocal-rank fusion, over any number of queries at once.

Filters come before ranking, so a selective filter never loses rows to an approximate index. Every order ends in the row id.

Queries are a small table: equal ones are made one, then they are taken to the driver in blocks of BLOCK_QUERIES, one at a
time, and broadcast, and the rows are scanned once per block. A task takes up rows by chunks. What they are scored by (their vector, or how often they have which wanted
words) is made distinct first: for each way in which queries filter, rows of equal filter values and equal signature are
scored once, and their k smallest ids stand for all. What is shuffled is k rows per query and task.
Rows may name their vector by a number (numbered): they are joined, filtered and shuffled without it, and meet it in order of
these numbers just before they are scored, so each vector is scored once for each way to filter, however many rows have it.
Queries that name a value which few rows have (Filters.narrow) meet these rows in a join instead.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import query_terms
from ..functions.vector import cosine, literal
from ..sources.io import settled

#: A query table up to this many rows is broadcast in joins.
BROADCAST_QUERIES = 10_000
#: Queries that a task scores at once; a row that is not scored (a zero vector) is last.
BLOCK_QUERIES, NO_SCORE = 131_072, -9.0
#: Cells of a (row, query) matrix at most; bytes of rows that a task takes up at once.
CELLS, CHUNK_BYTES = 2_000_000, 64 << 20
#: The same of texts, whose words take many times the memory.
TEXT_BYTES = 8 << 20
#: Vectors of a group that are ranked to bound the others' scores.
FIRST = 256
#: The column with the number of a row's vector.
NUMBER = "vector"
#: Values of a narrow filter up to which they are broadcast to leave out the rows that no query names.
BROADCAST_NAMES = 250_000
#: Ids of hits up to which they are broadcast to leave out the rows that are none; the driver makes a table of them.
BROADCAST_IDS = 1_000_000
WORDS = re.compile("[a-z0-9&']+")


def filters(kind: str | None = None, company: str | None = None, item: str | None = None, doc_name: str | None = None, fiscal_year: int | None = None) -> Column:
    """The conjunction of the filters given; company is a case-insensitive substring, a year of 0 is none."""
    parts = [F.lit(True)]
    if kind:
        parts.append(F.col("kind") == kind)
    if company:
        parts.append(F.col("company").ilike(f"%{company}%"))
    if item:
        parts.append(F.col("item_section") == item)
    if doc_name:
        parts.append(F.col("doc_name") == doc_name)
    if fiscal_year:
        parts.append(F.col("fiscal_year") == fiscal_year)
    return reduce(Column.__and__, parts)


def sized(queries: DataFrame) -> DataFrame:
    """Broadcast hint for a query table whose size is checked."""
    return F.broadcast(queries) if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES else queries


def vector_search(rows: DataFrame, query: list[float], k: int, where: Column | None = None, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The k rows most similar to one vector, with score; rows without a vector are left out."""
    kept = rows.where(F.col(vec_col).isNotNull() & (F.lit(True) if where is None else where))
    scored = kept.withColumn("score", F.round(cosine(F.col(vec_col), literal(query)), 6))
    return scored.drop(vec_col).orderBy(F.desc("score"), id_col).limit(k)


@dataclass
class Filters:
    """Filters of each query on the rows: row column -> query column. A null query value (or 0, for equal) is no filter.

    equal: the same value. contains: the row's value holds the query's as ILIKE '%value%' does. leave_out: the query column
    with the id of a row that does not count. narrow: the columns of equal of which a value has few rows. exact: every query
    states every filter, 0 is a value and null none that a row could have.
    """

    equal: dict[str, str] | None = None
    contains: dict[str, str] | None = None
    leave_out: str | None = None
    narrow: tuple[str, ...] = ()
    exact: bool = False

    def row_columns(self) -> list[str]:
        return [*(self.equal or {}), *(self.contains or {})]

    def query_columns(self) -> list[str]:
        return [*(self.equal or {}).values(), *(self.contains or {}).values(), *([self.leave_out] if self.leave_out else [])]

    def index(self, asked: dict[str, list]) -> QueryIndex:
        """The queries by what they ask of the rows."""
        return QueryIndex([(asked[q], False) for q in (self.equal or {}).values()] + [(asked[q], True) for q in (self.contains or {}).values()], len(asked["qid"]), self.exact)


class QueryIndex:
    """Queries by the filters that they state (a shape: places of filter columns) and the values there, so that rows meet only those that may have them."""

    def __init__(self, columns: list[tuple[list, bool]], size: int, exact: bool = False):
        self.substring = [substring for _, substring in columns]
        self.known: dict[tuple, np.ndarray] = {}
        self.shapes: dict[tuple[int, ...], dict[tuple, dict[tuple, list[int]]]] = {}
        for place in range(size):
            own = [wanted[place] for wanted, _ in columns]
            if exact and None in own:
                continue
            shape = tuple(c for c, value in enumerate(own) if exact or value)
            values = tuple(own[c] for c in shape if not self.substring[c]), tuple(own[c] for c in shape if self.substring[c])
            self.shapes.setdefault(shape, {}).setdefault(values[0], {}).setdefault(values[1], []).append(place)

    def fitting(self, shape: tuple[int, ...], values: tuple) -> np.ndarray:
        """The queries of a shape that may have a row with these values of its columns."""
        if (shape, values) not in self.known:
            found: list[int] = []
            if None not in values:
                equal = tuple(v for c, v in zip(shape, values, strict=True) if not self.substring[c])
                held = tuple(v for c, v in zip(shape, values, strict=True) if self.substring[c])
                for wanted, places in self.shapes[shape].get(equal, {}).items():
                    if all(_ilike(v, w) for v, w in zip(held, wanted, strict=True)):
                        found += places
            self.known[shape, values] = np.array(sorted(found), np.int64)
        return self.known[shape, values]

    def groups(self, columns: list[pa.Array], ids: np.ndarray | int, signature: np.ndarray | None = None, keep: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, queries that may have them), for rows of equal filter values: in order of signature and id, no more than keep of a signature; one of -1 does not count.

        Without signatures (ids may be the number of rows then) each row has one of its own.
        """
        ids = np.arange(ids) if isinstance(ids, int) else ids
        signature = np.arange(len(ids)) if signature is None else signature
        coded = [c.dictionary_encode() for c in columns]
        codes = [c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) for c in coded]
        names = [[*c.dictionary.to_pylist(), None] for c in coded]
        some = np.flatnonzero(signature >= 0)
        for shape in self.shapes:
            key = np.zeros(len(some), np.int64)
            for c in shape:
                key = key * len(names[c]) + codes[c][some]
            order = np.lexsort((ids[some], signature[some], key))
            rows, key = some[order], key[order]
            first = np.r_[True, (key[1:] != key[:-1]) | (np.diff(signature[rows]) != 0)][: len(rows)]
            at = np.arange(len(rows))
            kept = at - np.maximum.accumulate(np.where(first, at, 0)) < keep
            rows, key = rows[kept], key[kept]
            for own in np.split(rows, np.flatnonzero(np.diff(key)) + 1):
                if len(own) and len(queries := self.fitting(shape, tuple(names[c][codes[c][own[0]]] for c in shape))):
                    yield own, queries


@lru_cache(100_000)
def _ilike(value: str, wanted: str) -> bool:
    pattern = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in wanted)
    return re.search(pattern, value, re.I | re.S) is not None


def _lists(column: pa.ChunkedArray, vectors: bool) -> list | np.ndarray:
    """A column's values; vectors of one length as a matrix, for as lists they take ten times the memory."""
    if vectors and len(column) and not column.null_count:
        held = column.combine_chunks()
        size, flat = np.array(held.value_lengths()), held.flatten()
        if size[0] and (size == size[0]).all() and not flat.null_count:
            return flat.to_numpy(zero_copy_only=False).reshape(-1, size[0])
    return column.to_pylist()


def _blocks(queries: DataFrame, columns: list[str]) -> Iterator[dict[str, list | np.ndarray]]:
    """The queries' columns, about BLOCK_QUERIES at a time; qvec as a matrix. The driver holds one block."""
    wanted = queries.select("qid", *[c for c in columns if c != "qid"])
    held = lambda block: {c: _lists(block.column(c), c == "qvec") for c in block.column_names if c != "__block"}
    block = wanted.limit(BLOCK_QUERIES + 1).toArrow()
    if block.num_rows <= BLOCK_QUERIES:
        if block.num_rows:
            yield held(block)
        return
    del block
    wanted = settled(wanted)
    parts = -(-wanted.count() // BLOCK_QUERIES)
    dealt = wanted.withColumn("__block", F.pmod(F.xxhash64("qid"), F.lit(parts)))
    for part in range(parts):
        block = dealt.where(F.col("__block") == part).toArrow()
        if block.num_rows:
            yield held(block)


class _Best:
    """The k best (query, id, score) of what a task has seen; what cannot be among them any more is not taken up."""

    def __init__(self, k: int, queries: int):
        self.k, self.room, self.size = k, k * queries + max(k * queries // 4, 500_000), 0
        self.query, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        self.added: list[tuple] = []
        self.least, self.last = np.full(queries, -np.inf), np.full(queries, None, object)  # score and id of each query's k-th

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Hits of rows, whose ids are given for all rows."""
        least = self.least[query]
        keep = score > least
        tied = np.flatnonzero(score == least)
        keep[tied] = (ids[row[tied]] < self.last[query[tied]]).astype(bool)
        self.added.append((query[keep], ids[row[keep]], score[keep]))
        self.size += len(self.added[-1][0])
        if self.size > self.room:
            self.prune()

    def prune(self) -> None:
        parts = ([(self.query, self.ids, self.score)] if len(self.query) else []) + self.added
        if not parts:
            return
        query, ids, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(order)) - np.searchsorted(query, query)
        full = order[place == self.k - 1]
        self.least[query[place == self.k - 1]], self.last[query[place == self.k - 1]] = score[full], ids[full]
        keep = order[place < self.k]
        self.query, self.ids, self.score = query[place < self.k], ids[keep], score[keep]
        self.added, self.size = [], 0


def _chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Rows by chunks of about so many bytes; a batch of more is cut."""
    held, size = [], 0
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for part in (batch.slice(at, rows) for at in range(0, batch.num_rows, rows)):
            held.append(part)
            size += part.nbytes
            if size >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(chunk: pa.Table, at: int) -> pa.Array:
    column = chunk.column(at)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _names(column: pa.Array) -> np.ndarray:
    """Ids as numbers where they are such."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) and not column.null_count else np.array(column.to_pylist(), object)


def _once(queries: DataFrame, columns: list[str]) -> DataFrame:
    """Equal queries as one; qid is the list of those that ask it."""
    qids = F.transform(F.collect_list(F.struct("qid")), lambda x: x["qid"])  # null is an id too
    return queries.groupBy(*columns).agg(qids.alias("qid"))


def _best_only(query: np.ndarray, score: np.ndarray, count: np.ndarray, keep: int) -> np.ndarray:
    """Which hits (of count rows each) may hold one of a query's first rows: fewer than keep rows score higher."""
    order = np.lexsort((-score, query))
    query, score, count = query[order], score[order], count[order]
    new = np.r_[True, query[1:] != query[:-1]]
    at, before = np.arange(len(order)), np.cumsum(count) - count
    start = np.maximum.accumulate(np.where(new, at, 0))
    level = np.maximum.accumulate(np.where(new | np.r_[True, score[1:] != score[:-1]], at, 0))
    return order[before[level] - before[start] < keep]


def _scan(rows: DataFrame, columns: list[str], k: int, queries: DataFrame, query_columns: list[str], filters: Filters, prepare: Callable, signatures: Callable, hits: Callable, id_col: str, most: int = CHUNK_BYTES, ready: Callable = lambda prepared: prepared) -> DataFrame:
    """(qid, id, score, rank): the k best rows of each query.

    prepare(asked) makes what tasks need of a block of queries, and ready(prepared) what is larger than it and made in each; signatures(prepared, chunk) gives each row's signature (-1: it does not count)
    and what hits needs of them; hits(prepared, of, signatures, queries, least, keep) gives places of signatures and queries with their scores,
    those at least that are among a query's keep best and not below least.
    """
    spark = rows.sparkSession
    kinds = {"qid": queries.schema["qid"].dataType, "id": rows.schema[id_col].dataType}
    source = rows.select(F.col(id_col).alias("id"), *columns, *[F.col(c) for c in filters.row_columns()])
    keep, found = k + bool(filters.leave_out), None
    if filters.leave_out:  # a column of its own, for qid becomes a list
        queries, filters = queries.withColumn("__own", F.col(filters.leave_out)), replace(filters, leave_out="__own")
    wanted = list(dict.fromkeys([*query_columns, *filters.query_columns()]))
    for asked in _blocks(_once(queries, wanted), wanted):
        shared = spark.sparkContext.broadcast(({c: v for c, v in asked.items() if c not in query_columns or c in filters.query_columns()}, prepare(asked)))
        del asked

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked, prepared = shared.value[0], ready(shared.value[1])
            best, index = _Best(k, len(asked["qid"])), filters.index(asked)
            own = np.array(asked[filters.leave_out], object) if filters.leave_out else None
            for chunk in _chunks(batches, most):
                ids = _names(_column(chunk, 0))
                signature, of = signatures(prepared, chunk)
                for group, fitting in index.groups([_column(chunk, c) for c in range(1 + len(columns), chunk.num_columns)], ids, signature, keep):
                    codes, start, count = np.unique(signature[group], return_index=True, return_counts=True)
                    for place, query, value in hits(prepared, of, codes, fitting, best.least, keep):
                        some = _best_only(query, value, count[place], keep)
                        place, query, value = place[some], query[some], value[some]
                        each = count[place]
                        at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[place], each)
                        row, query, value = group[at], np.repeat(query, each), np.repeat(value, each)
                        if own is not None:
                            other = ids[row] != own[query]
                            row, query, value = row[other], query[other], value[other]
                        best.add(query, row, value, ids)
                best.prune()
            values = np.where(best.score == NO_SCORE, np.nan, best.score)
            yield pa.RecordBatch.from_arrays([pa.array(best.query), pa.array(best.ids.tolist(), to_arrow_type(kinds["id"])), pa.array(values, from_pandas=True)], ["place", "id", "score"])

        def named(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            asked = shared.value[0]["qid"]
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    names = [asked[p] for p in part.column(0).to_pylist()]
                    row = pa.array(np.repeat(np.arange(len(names)), [len(x) for x in names]))
                    yield pa.RecordBatch.from_arrays([pa.array([q for x in names for q in x], to_arrow_type(kinds["qid"])), *[part.column(c).take(row) for c in (1, 2, 3)]], ["qid", "id", "score", "rank"])

        kind = f"id {kinds['id'].simpleString()}, score double"
        order = Window.partitionBy("place").orderBy(F.desc("score"), "id")
        ranked = source.mapInArrow(run, f"place long, {kind}").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked = ranked.mapInArrow(named, f"qid {kinds['qid'].simpleString()}, {kind}, rank int")
        found = ranked if found is None else found.unionByName(ranked)
    if found is None:
        found = spark.createDataFrame([], f"qid {kinds['qid'].simpleString()}, id {kinds['id'].simpleString()}, score double, rank int")
    return found.withColumnRenamed("id", id_col)


def _unit(vectors: list) -> np.ndarray:
    """Rows of length 1 in double precision; nan where a vector is zero."""
    matrix = np.array(vectors, np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _distinct_vectors(size: int, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's vector among the distinct ones of this size (-1: it has another), and these at length 1. Equal neighbours are looked at once."""
    fits = np.array(vectors.value_lengths().fill_null(-1)) == size
    matrix = (vectors if fits.all() else vectors.filter(pa.array(fits))).flatten().to_numpy(zero_copy_only=False)
    matrix = np.ascontiguousarray(matrix if matrix.dtype in (np.float32, np.float64) else matrix.astype(np.float64)).reshape(-1, size)
    words = matrix.view(np.uint32 if matrix.dtype == np.float32 else np.uint64)
    new = np.r_[True, (words[1:] != words[:-1]).any(axis=1)][: len(words)]
    run, begins = np.cumsum(new) - 1, np.flatnonzero(new)
    words = words[begins]
    factors = np.random.default_rng(7).integers(1, 1 << 63, size, np.uint64) | np.uint64(1)
    digest = np.zeros(len(words), np.uint64)
    for c in range(size):
        digest = (digest ^ words[:, c]) * factors[c]
        digest ^= digest >> np.uint64(29)
    _, first, number = np.unique(digest, return_index=True, return_inverse=True)
    other = np.flatnonzero((words != words[first[number]]).any(axis=1))  # equal digests, unequal vectors
    number[other] = len(first) + np.arange(len(other))
    out = np.full(len(fits), -1, np.int64)
    out[fits] = number[run]
    return out, _unit(matrix[begins[np.r_[first, other]]])


def _six(cosines: np.ndarray) -> np.ndarray:
    """Six decimals; NO_SCORE where a vector is zero."""
    return np.nan_to_num(np.round(cosines, 6), nan=NO_SCORE)


def _vector_signatures(units: np.ndarray, chunk: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _distinct_vectors(units.shape[1], _column(chunk, 1))


def _vector_hits(units: np.ndarray, of: np.ndarray, codes: np.ndarray, queries: np.ndarray, least: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    own, step = of[codes], max(1, CELLS // len(codes))
    some = min(len(own), max(FIRST, 8 * keep))
    for part in (queries[at : at + step] for at in range(0, len(queries), step)):
        value = own @ units[part].T
        if np.isnan(value[:, 0]).any() or np.isnan(value[0]).any():
            value = np.nan_to_num(value, nan=NO_SCORE)
        bound = least[part]
        if len(value) > keep:  # the keep-th of the first rows is a bound for all
            bound = np.maximum(bound, _six(np.partition(value[:some], some - keep, axis=0)[some - keep]))
        place, query = np.nonzero(value >= bound[None, :] - 1e-6)  # exactly once rounded
        score = _six(value[place, query])
        kept = score >= bound[query]
        yield place[kept], part[query[kept]], score[kept]


def numbered(rows: DataFrame, vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """rows with the number of their vector in its place, and the distinct vectors (NUMBER, vec_col). Two hashes of 64 bits are a vector's number."""
    number = F.when(F.col(vec_col).isNotNull(), F.struct(F.xxhash64(vec_col).alias("a"), F.xxhash64(F.lit(1), vec_col).alias("b")))
    made = rows.withColumn(NUMBER, number)
    return made.drop(vec_col), made.where(F.col(NUMBER).isNotNull()).groupBy(NUMBER).agg(F.any_value(vec_col).alias(vec_col))


def with_vectors(rows: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """rows (NUMBER, ...) with their vectors, in order of them; a vector that very many rows have may go to several tasks."""
    if vectors is None:
        return rows
    # Few tasks for each core: each makes its own index of the queries, and has its own best rows for each.
    return rows.join(vectors.hint("merge"), NUMBER).drop(NUMBER).coalesce(3 * rows.sparkSession.sparkContext.defaultParallelism)


def vector_ranks(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", filters: Filters | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank): the k rows most similar to each query (qid, qvec, ...) among those that its filters leave.

    Rows without a vector, or with one of another length than the queries', are left out. With vectors (NUMBER, vec_col) given, the rows have a vector's number in its place.
    """
    filters, held = filters or Filters(), vec_col if vectors is None else NUMBER
    kept = rows.where(F.col(held).isNotNull()).select(F.col(id_col), held, *[c for c in filters.row_columns() if c not in (id_col, held)])
    asked = queries.where("qvec is not null")
    scan = lambda asked, filters: _scan(with_vectors(kept, vectors), [vec_col], k, asked, ["qvec"], filters, lambda block: block["qvec"], _vector_signatures, _vector_hits, id_col, ready=_unit)
    if not filters.narrow:
        return scan(asked, filters)
    equal = filters.equal or {}
    named = [F.coalesce(F.col(equal[c]).cast("string"), F.lit("")).isin("", "0") for c in filters.narrow]
    free = reduce(Column.__and__, named)
    wide = replace(filters, equal={c: q for c, q in equal.items() if c not in filters.narrow}, narrow=())
    found = scan(asked.where(free), wide)
    for at, column in enumerate(filters.narrow):  # a query meets the rows of the first narrow value that it names
        own = asked.where(reduce(Column.__and__, named[:at], ~named[at]))
        found = found.unionByName(_joined(kept, own, k, column, id_col, vec_col, filters, vectors))
    return found


def may_have(filters: Filters) -> Column:
    """Whether a query may have a row, both with their filter columns."""
    out = F.lit(True)
    for row, query in (filters.equal or {}).items():
        none = F.coalesce(F.col(query).cast("string"), F.lit("")).isin("", "0")
        out &= none | F.coalesce(F.col(row) == F.col(query), F.lit(False))
    for row, query in (filters.contains or {}).items():
        held = F.ilike(F.col(row), F.concat(F.lit("%"), F.replace(F.col(query), F.lit("\\"), F.lit("\\\\")), F.lit("%")))
        out &= (F.coalesce(F.col(query), F.lit("")) == "") | F.coalesce(held, F.lit(False))
    return out


def _joined(rows: DataFrame, queries: DataFrame, k: int, column: str, id_col: str, vec_col: str, filters: Filters, vectors: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank) of queries that name a value of a column: they are joined with its rows."""
    name = (filters.equal or {})[column]
    held = vec_col if vectors is None else NUMBER
    own = rows.select(F.col(id_col).alias("__id"), F.col(held).alias("__vec"), *filters.row_columns())
    asked = queries.select("qid", F.col("qvec").alias("__qvec"), *filters.query_columns())
    names = asked.select(F.col(name).alias(column)).distinct()
    if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        own = own.join(F.broadcast(names), column, "left_semi")
    pairs = own.join(asked, F.col(column) == F.col(name)).where(may_have(filters))
    if filters.leave_out:
        pairs = pairs.where(~F.col("__id").eqNullSafe(F.col(filters.leave_out)))
    if vectors is not None:  # those of the pairs only
        pairs = pairs.withColumnRenamed("__vec", NUMBER).join(vectors.withColumnRenamed(vec_col, "__vec"), NUMBER)
    kinds = [queries.schema["qid"].dataType.simpleString(), rows.schema[id_col].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, queries = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            fits = np.array([len(a) == len(b) for a, b in zip(rows, queries, strict=True)], bool)
            value = [_six(np.einsum("j,j->", _unit([a])[0], _unit([b])[0])) for a, b, same in zip(rows, queries, fits, strict=True) if same]
            value = [None if v == NO_SCORE else float(v) for v in value]
            part = batch.filter(pa.array(fits))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(value, pa.float64())], ["qid", "id", "score"])

    scored = pairs.select("qid", "__id", "__vec", "__qvec").mapInArrow(run, f"qid {kinds[0]}, id {kinds[1]}, score double")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("id", id_col)


def first_relevant(rows: DataFrame, queries: DataFrame, relevant: dict[str, str], id_col: str = "id", vec_col: str = "embedding", leave_out: str | None = None) -> DataFrame:
    """(qid, rank) over all rows: the rank of the best row whose columns equal the query's (relevant; 0 is a value too), null without one.

    Nothing is ranked: the best relevant row is found first, then the rows before it are counted.
    """
    best = vector_ranks(rows, queries, 1, id_col, vec_col, Filters(equal=relevant, leave_out=leave_out, exact=True))
    return _rank_of(best, rows, queries, id_col, vec_col, leave_out)


def _levels(targets: str):
    """The queries' vectors, and all their target values in order with the query of each."""

    def prepare(asked: dict[str, list]) -> tuple:
        values = [(v, place) for place, own in enumerate(asked[targets]) for v in own or []]
        values.sort()
        return _unit(asked["qvec"]), np.array([v for v, _ in values]), np.array([p for _, p in values], np.int64)

    return prepare


def first_close(rows: DataFrame, queries: DataFrame, value: str, targets: str, id_col: str = "id", vec_col: str = "embedding", apart: float = 0.01) -> DataFrame:
    """(qid, rank) over all rows: the rank of the best row whose value, sign aside, is within apart of one of the query's targets (an array)."""
    kind, id_kind, kept = queries.schema["qid"].dataType, rows.schema[id_col].dataType, rows.where(F.col(vec_col).isNotNull())
    source, found = kept.select(F.col(id_col).alias("id"), vec_col, F.col(value).cast("double")), None
    for block in _blocks(queries.where(F.col("qvec").isNotNull() & (F.size(targets) > 0)), ["qvec", targets]):
        shared = rows.sparkSession.sparkContext.broadcast((block["qid"], _levels(targets)(block)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, (units, levels, owner) = shared.value
            best = _Best(1, len(names))
            for chunk in _chunks(batches):
                value = np.abs(_column(chunk, 2).to_numpy(zero_copy_only=False))
                low, high = np.searchsorted(levels, value - 2 * apart), np.searchsorted(levels, value + 2 * apart, "right")
                some = np.flatnonzero((high > low) & ~np.isnan(value))
                own = chunk.take(pa.array(some))
                signature, of = _distinct_vectors(units.shape[1], _column(own, 1))
                ids, value, count = _names(_column(own, 0)), value[some], np.where(signature >= 0, (high - low)[some], 0)
                step = np.cumsum(count) // CELLS
                for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(step)) + 1):
                    each = count[part]
                    row = np.repeat(part, each)
                    place = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low[some][part], each)
                    near = np.abs(value[row] - levels[place]) < apart
                    pair = np.unique(row[near] * len(units) + owner[place[near]])
                    row, query = pair // len(units), pair % len(units)
                    for at in range(0, len(row), CELLS // 16):
                        r, q = row[at : at + CELLS // 16], query[at : at + CELLS // 16]
                        best.add(q, r, _six(np.einsum("ij,ij->i", of[signature[r]], units[q])), ids)
            best.prune()
            values = np.where(best.score == NO_SCORE, np.nan, best.score)
            yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in best.query], to_arrow_type(kind)), pa.array(best.ids.tolist(), to_arrow_type(id_kind)), pa.array(values, from_pandas=True)], ["qid", "id", "score"])

        hits = source.mapInArrow(run, f"qid {kind.simpleString()}, id {id_kind.simpleString()}, score double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return queries.select("qid", F.lit(None).cast("long").alias("rank"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where("rank = 1").withColumnRenamed("id", id_col)
    return _rank_of(best, rows, queries, id_col, vec_col)


def _rank_of(best: DataFrame, rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, leave_out: str | None = None) -> DataFrame:
    """(qid, rank) of one hit of each query (qid, id, score) among all rows: those before it are counted; null without a hit."""
    asked = queries.join(best.select("qid", F.col("score").alias("best_score"), F.col(id_col).alias("best_id")), "qid")
    kind = queries.schema["qid"].dataType
    source = rows.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), vec_col)
    found = None
    for block in _blocks(asked, ["qvec", "best_score", "best_id", *([leave_out] if leave_out else [])]):
        units = _unit(block.pop("qvec"))
        shared = rows.sparkSession.sparkContext.broadcast((block, units))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, units = shared.value
            level = np.array([NO_SCORE if x is None else x for x in block["best_score"]])
            hit, before = block["best_id"], np.zeros(len(units), np.int64)
            leaving: dict = {}
            for place, key in enumerate(block[leave_out] if leave_out else []):
                leaving.setdefault(key, []).append(place)
            for chunk in _chunks(batches):
                signature, of = _distinct_vectors(units.shape[1], _column(chunk, 1))
                ids = _names(_column(chunk, 0))
                order = np.lexsort((ids, signature))
                names = ids[order]
                ends = np.searchsorted(signature[order], np.arange(len(of) + 1))
                count = np.diff(ends)
                step = max(1, CELLS // max(1, len(units)))
                for at in range(0, len(of), step):
                    score = _six(of[at : at + step] @ units.T)
                    before += count[at : at + step] @ (score > level)
                    for own, query in zip(*np.nonzero(score == level), strict=True):
                        low, high = ends[at + own], ends[at + own + 1]
                        before[query] += np.searchsorted(names[low:high], hit[query])
                for row in (np.flatnonzero(signature >= 0) if leaving else ()):
                    for query in leaving.get(ids[row], ()):
                        own = _six(of[signature[row]] @ units[query])
                        before[query] -= own > level[query] or (own == level[query] and ids[row] < hit[query])
            yield pa.RecordBatch.from_arrays([pa.array(block["qid"], to_arrow_type(kind)), pa.array(before)], ["qid", "before"])

        counts = source.mapInArrow(run, f"qid {kind.simpleString()}, before long")
        found = counts if found is None else found.unionByName(counts)
    if found is None:
        return queries.select("qid", F.lit(None).cast("long").alias("rank"))
    return queries.select("qid").join(found.groupBy("qid").agg((F.sum("before") + 1).alias("rank")), "qid", "left")


def lexical_score(tf: Column) -> Column:
    """Sum of 1 / j**2 for j up to the term frequency: grows with it, ever more slowly."""
    return F.aggregate(F.sequence(F.lit(1), tf), F.lit(0.0), lambda s, j: s + F.lit(1.0) / (j * j).cast("double"))


def _saturated(largest: int) -> np.ndarray:
    """lexical_score of 0, 1, 2, ... occurrences."""
    return np.concatenate(([0.0], np.cumsum(1.0 / np.arange(1, largest + 1, dtype=float) ** 2)))


def _terms_of(asked: dict[str, list]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Which queries ask for each term, and how many terms each query has."""
    found: dict[str, list[int]] = {}
    for place, terms in enumerate(asked["terms"]):
        for term in terms:
            found.setdefault(term, []).append(place)
    return {t: np.array(q) for t, q in found.items()}, np.array([len(t) for t in asked["terms"]], float)


def _word_signatures(counted: Callable[[str], dict]):
    """How often each text has which wanted words; texts without one do not count."""

    def signatures(prepared: tuple, chunk: pa.Table) -> tuple[np.ndarray, list[tuple]]:
        wanted, numbers, out = prepared[0], {}, []
        for text in _column(chunk, 1).to_pylist():
            held = tuple(sorted((w, n) for w, n in counted(text).items() if w in wanted)) if text else ()
            out.append(numbers.setdefault(held, len(numbers)) if held else -1)
        return np.array(out, np.int64), list(numbers)

    return signatures


def _words(text: str) -> Counter:
    return Counter(WORDS.findall(text.lower()))


def _word_hits(add: Callable[[np.ndarray, int], np.ndarray], whole: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type = float):
    """Scores of texts by words: add(total so far, times) for each word in order, then whole(total, number of words)."""

    def hits(prepared: tuple, of: list[tuple], codes: np.ndarray, queries: np.ndarray, least: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        wanted, n_terms = prepared
        may = np.zeros(len(n_terms), bool)
        may[queries] = True
        places, found, values, size = [], [], [], 0
        for place, code in enumerate(codes.tolist()):
            total = np.zeros(len(n_terms), kind)
            for term, times in of[code]:
                total[wanted[term]] = add(total[wanted[term]], times)
            own = np.flatnonzero((total > 0) & may)
            value = whole(total[own], n_terms[own])
            own, value = own[value >= least[own]], value[value >= least[own]]
            places.append(np.full(len(own), place))
            found.append(own)
            values.append(value)
            size += len(own)
            if size > CELLS:
                yield np.concatenate(places), np.concatenate(found), np.concatenate(values)
                places, found, values, size = [], [], [], 0
        if size:
            yield np.concatenate(places), np.concatenate(found), np.concatenate(values)

    return hits


def lexical_ranks(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "text", limit: int = 12, filters: Filters | None = None) -> DataFrame:
    """(qid, id, score, rank): rows with any of a query's terms, by mean saturated term frequency. queries: (qid, question, ...).

    Only words that some query asks for are counted, where the row stands; queries without terms find nothing.
    """
    asked = queries.withColumn("terms", query_terms(F.col("question"), limit)).where(F.size("terms") > 0)
    weights = _saturated(64)
    add = lambda total, times: total + (weights[times] if times < len(weights) else _saturated(times)[times])
    return _scan(rows, [text_col], k, asked, ["terms"], filters or Filters(), _terms_of, _word_signatures(_words), _word_hits(add, lambda total, terms: np.round(total / terms, 6)), id_col, TEXT_BYTES)


def fuse(lists: list[DataFrame], k: int, id_col: str = "id", constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (qid, id, rank): (qid, id, rrf, rank). Ties go to the earlier list, then rank."""
    tagged = [x.select("qid", id_col, F.col("rank").cast("int").alias("in_rank"), F.lit(n).alias("in_list")) for n, x in enumerate(lists)]
    merged = reduce(DataFrame.unionByName, tagged).groupBy("qid", id_col)
    summed = merged.agg(F.round(F.sum(F.lit(1.0) / (constant + F.col("in_rank"))), 9).alias("rrf"), F.min(F.struct("in_list", "in_rank")).alias("first"))
    order = Window.partitionBy("qid").orderBy(F.desc("rrf"), "first", id_col)
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("first")


def depth(k: int) -> int:
    """How many of each list to fetch before fusing."""
    return max(2 * k, 20)


def hybrid_ranks(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "id", text_col: str = "text", vec_col: str = "embedding", filters: Filters | None = None) -> DataFrame:
    """Vector and lexical lists of queries (qid, qvec, question), fused."""
    by_vector = vector_ranks(rows, queries, depth(k), id_col, vec_col, filters)
    by_words = lexical_ranks(rows, queries, depth(k), id_col, text_col, filters=filters)
    return fuse([by_vector, by_words], k, id_col)


def with_filing(rows: DataFrame, documents: DataFrame, columns: tuple[str, ...] = ("doc_name", "company", "fiscal_year")) -> DataFrame:
    """rows (doc_id, ...) with their document's columns; rows of unknown documents are left out. Rows that have these columns stay as they are."""
    if set(columns) <= set(rows.columns):
        return rows
    return rows.join(sized(documents.select("doc_id", *columns)), "doc_id")


def with_rows(hits: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """hits with their rows' columns. Where the hits are few enough, only their rows are shuffled."""
    ids = hits.select(id_col).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return hits.join(rows.join(F.broadcast(ids), id_col, "left_semi") if few else rows, id_col)


#: The filters of the query columns company, doc_name, fiscal_year on rows of with_filing; BY_PASSAGE also kind and item.
BY_FILING = Filters(equal={"doc_name": "q_doc_name", "fiscal_year": "q_fiscal_year"}, contains={"company": "q_company"}, narrow=("doc_name",))
BY_PASSAGE = Filters(equal={"doc_name": "q_doc_name", "fiscal_year": "q_fiscal_year", "kind": "q_kind", "item_section": "q_item"}, contains={"company": "q_company"}, narrow=("doc_name",))
