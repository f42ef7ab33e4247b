"""Token-id files: whole texts tokenised, range-coded in independently reset, checksummed blocks, in ascending id order.

A file holds up to FILE_IDS ids: a header, the documents' ids and lengths, the blocks' lengths and checksums, the
frequencies of its ids (order 0), and the blocks (range_coder). Texts are range-partitioned and sorted by document id and,
within one id, a hash of the text; each task writes the files of its range under random names, and only files that the
committed index names count. A document's start is its place in its file plus the ids of all files before it, which are
summed by partition first.

Tokenising works on distinct pieces. The vocabulary's pre-tokeniser never joins across white space, nor across an ASCII
letter and another ASCII character, apostrophes apart, so each piece is encoded once per worker by the tokenizers library
and its ids are reused; piece_starts says where texts may be cut, and words with ``<|`` stay whole for the special tokens.
This holds for the word-level vocabulary that the query uses; the tests compare it with encoding whole texts.

Edge cases: null and empty text give the end id alone; a null document id sorts first; rows of one id follow each other,
ordered by a hash of their text; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .range_coder import BLOCK_IDS, decode_blocks, encode_blocks, frequencies, pack_frequencies, unpack_frequencies
from .shared import map_arrow, new_path, shuffle_partitions
from .warc import open_fs
from .wordhash import _BASE, _WIDE, _power_tables, _space, mix, text_chunks

MAGIC = b"LLIDS003"
FILE_IDS = 6144 * BLOCK_IDS
#: Pieces whose ids a worker keeps; beyond it starts anew. Bits of each half of the table of pieces.
CACHE_PIECES, TABLE_BITS = 1_000_000, 20
#: Words that the tokenizers library encodes as one text.
WORDS_AT_ONCE = 1024
INDEX = "part int, seq int, path string, docs long, ids long"
DOCUMENT = "path string, place int, doc_id long, offset long, n_tokens long, ids_crc32 long"

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * _WIDE(2) + _WIDE(1)
_values[65:91] = _values[97:123]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans (starts, ends) of pieces: words, cut where an ASCII letter meets another ASCII character but '."""
    n = len(data)
    inside = ~_space[data]
    letter = _letter[data]
    cut = np.zeros(n + 1, bool)
    cut[0] = True
    cut[1:n] = inside[1:] != inside[:-1]
    cut[offsets[offsets <= n]] = True
    plain = (data < 128) & (data != 39)
    turn = np.zeros(n + 1, bool)
    turn[1:n] = inside[1:] & inside[:-1] & ((letter[:-1] & ~letter[1:] & (data[1:] < 128)) | (plain[:-1] & ~letter[:-1] & letter[1:]))
    marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if n > 1 else np.zeros(0, np.int64)
    words = np.flatnonzero(cut)
    if len(marks):  # words with <| stay whole
        for k in np.unique(np.searchsorted(words, marks, "right") - 1):
            turn[words[k] : words[k + 1] if k + 1 < len(words) else n] = False
    edges = np.flatnonzero(cut | turn)
    edges = edges[edges < n]
    ends = np.append(edges[1:], n)
    use = inside[edges]
    return edges[use], ends[use]


class PieceEncoder:
    """Ids of texts through a table of pieces that have been encoded before.

    A piece is known by a 64-bit hash of its bytes, A-Z taken as a-z; one that holds ``<|`` by a hash of its very bytes,
    since special tokens are told apart by case. A hash has two places in the table; a piece that finds both taken by
    others replaces one, and the other is encoded anew when it comes again.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.closes = np.zeros(self.size, bool)
        self.closes[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.table = np.zeros(2 << TABLE_BITS, np.int32)  # piece 0 is none
        self.hash, self.first, self.length = np.zeros(1, _WIDE), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint16)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = _WIDE((1 << TABLE_BITS) - 1)
        return (hashes & mask).astype(np.int64), ((hashes >> _WIDE(32)) & mask).astype(np.int64) + (1 << TABLE_BITS)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash's piece, 0 if it is not known."""
        one, two = self._places(hashes)
        found = self.table[one].astype(np.int64)
        other = np.flatnonzero((self.hash[found] != hashes) | (found == 0))
        again = self.table[two[other]].astype(np.int64)
        found[other] = np.where((self.hash[again] == hashes[other]) & (again > 0), again, 0)
        return found

    def _words(self, texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of words of letters, given as texts of many, end to end, and how many each word has; None if words fall apart."""
        ids = np.concatenate([np.array(x.ids, np.int64) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        last = np.flatnonzero(self.closes[ids]) + 1
        return (ids, np.diff(last, prepend=0)) if len(last) == words else None

    def _plain(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of a-z."""
        size = ends - starts + 1
        at = np.cumsum(size) - size
        buffer = np.full(int(size.sum()), 32, np.uint8)
        inside = np.ones(len(buffer), bool)
        inside[at + size - 1] = False
        buffer[inside] = data[np.repeat(starts - at, size - 1) + np.flatnonzero(inside)]
        text, cuts = buffer.tobytes().decode("ascii"), [*at[::WORDS_AT_ONCE].tolist(), len(buffer)]
        found = self._words([text[a : b - 1] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], len(starts))
        if found is None:
            raise ValueError("the vocabulary does not end each word by an id of its own")
        return found

    def _others(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any pieces: those of letters many at once, the others one by one."""
        lists: list = [None] * len(texts)
        words = [k for k, t in enumerate(texts) if t.isalpha()]
        for at in range(0, len(words), WORDS_AT_ONCE):
            own = words[at : at + WORDS_AT_ONCE]
            if found := self._words([" ".join([texts[k] for k in own])], len(own)):
                flat, upto = found[0].tolist(), [0, *np.cumsum(found[1]).tolist()]
                for n, k in enumerate(own):
                    lists[k] = flat[upto[n] : upto[n + 1]]
        rest = [k for k, x in enumerate(lists) if x is None]
        for k, x in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            lists[k] = x.ids
        return np.array([k for x in lists for k in x], np.int64), np.array([len(x) for x in lists], np.int64)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, letters: np.ndarray, marked: np.ndarray) -> None:
        """Encodes pieces (with distinct hashes) and adds them to the table."""
        folded = _fold[data]
        plain = np.flatnonzero(letters)
        rest = np.flatnonzero(~letters)
        ids, length = self._plain(folded, starts[plain], ends[plain]) if len(plain) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(rest):
            raw, low = data.tobytes(), folded.tobytes()
            texts = [(raw if exact else low)[a:b] for a, b, exact in zip(starts[rest].tolist(), ends[rest].tolist(), marked[rest].tolist(), strict=True)]
            more = self._others([t.decode("utf-8", "replace") for t in texts])
            ids, length = np.concatenate((ids, more[0])), np.concatenate((length, more[1]))
        number = len(self.hash) + np.arange(len(hashes))
        order = np.concatenate((plain, rest))
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(length) - length))
        self.length, self.hash, self.ids = np.concatenate((self.length, length)), np.concatenate((self.hash, hashes[order])), np.concatenate((self.ids, ids.astype(np.uint16)))
        one, two = self._places(hashes[order])
        self.table[np.where(self.table[one] == 0, one, two)] = number

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by end_id, and the number of each text's."""
        starts, ends = piece_starts(data, offsets)
        up, down = _power_tables(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, _WIDE)
            np.cumsum(_values[data] * up[: len(data)], out=sums[1:])
            hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_WIDE) * _WIDE(_BASE))
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else np.zeros(0, np.int64)
        marked = np.unique(np.searchsorted(starts, marks, "right") - 1)
        for k in marked.tolist():
            hashes[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        found = self._find(hashes)
        new, where = np.unique(hashes[lost], return_index=True) if len(lost := np.flatnonzero(found == 0)) else (hashes[:0], lost)
        if len(new):
            if len(self.hash) + len(new) > CACHE_PIECES:
                self.clear()
                new, where = np.unique(hashes, return_index=True)
                lost = np.arange(len(hashes))
            here = lost[where]
            letter = np.concatenate(([0], np.cumsum(_letter[data], dtype=np.int64)))
            exact = np.isin(here, marked)
            before = len(self.hash)
            self._learn(data, starts[here], ends[here], new, letter[ends[here]] - letter[starts[here]] == ends[here] - starts[here], exact)
            # Straight from what was just learned: its place in the table may have been taken already.
            order = np.argsort(self.hash[before:], kind="stable")
            found[lost] = before + order[np.searchsorted(self.hash[before:], hashes[lost], sorter=order)]
        length, first = self.length[found], self.first[found]
        text = np.searchsorted(starts, offsets)  # the first piece of each text
        upto = np.concatenate(([0], np.cumsum(length)))
        flat = self.ids[np.repeat(first - upto[:-1], length) + np.arange(upto[-1])] if upto[-1] else np.zeros(0, np.uint16)
        tokens = upto[text[1:]] - upto[text[:-1]]
        return np.insert(flat, upto[text[1:]], np.uint16(end_id)), tokens + 1


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    """One per worker process, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def file_bytes(docs: list[int | None], lengths: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    if vocabulary > 1 << 16:
        raise ValueError("ids must be below 65536")
    scaled = frequencies(ids)
    blocks = encode_blocks(ids, scaled)
    sums = [zlib.crc32(ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS].astype("<u2").tobytes()) for k in range(len(blocks))]
    nulls = sum(d is None for d in docs)
    table = np.array([0 if d is None else d for d in docs], "<i8").tobytes() + lengths.astype("<u4").tobytes() + np.array([len(b) for b in blocks], "<u4").tobytes() + np.array(sums, "<u4").tobytes()
    packed = zlib.compress(table, 1)
    return MAGIC + struct.pack("<QQQQII", len(docs), nulls, len(ids), len(packed), vocabulary, BLOCK_IDS) + packed + pack_frequencies(scaled) + b"".join(blocks)


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all token ids; fails when a block's checksum does not hold."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, nulls, ids, size, vocabulary, block = struct.unpack_from("<QQQQII", data, 8)
    if block != BLOCK_IDS:
        raise ValueError("another block size")
    at = 8 + struct.calcsize("<QQQQII")
    table, blocks = zlib.decompress(data[at : at + size]), -(-ids // block)
    names = np.frombuffer(table, "<i8", docs)
    lengths = np.frombuffer(table, "<u4", docs, 8 * docs).astype(np.int64)
    sizes = np.frombuffer(table, "<u4", blocks, 12 * docs).astype(np.int64)
    sums = np.frombuffer(table, "<u4", blocks, 12 * docs + 4 * blocks)
    starts = (np.cumsum(sizes) - sizes) // 4
    scaled, width = unpack_frequencies(data[at + size :])
    found = decode_blocks(np.frombuffer(data[at + size + width :], "<u4"), starts, ids, scaled)
    for k in range(blocks):
        if zlib.crc32(found[k * block : (k + 1) * block].astype("<u2").tobytes()) != sums[k]:
            raise ValueError(f"block {k} does not have its checksum")
    return [None] * nulls + names[nulls:].tolist(), lengths, found


def write_tokens(documents: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files and returns their index, read back from the table beside them."""
    spark = documents.sparkSession
    folder = folder or new_path(spark, "tokens")
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranged = source.repartitionByRange(shuffle_partitions(spark), F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        encoder = _encoder(tokenizer)
        docs, lengths, ids, held = [], [], [], 0

        def save():
            path = f"{folder}/files/{uuid.uuid4().hex}.ids"
            system, local = open_fs(path)
            system.create_dir(local.rpartition("/")[0], recursive=True)
            flat = np.concatenate(ids)
            with system.open_output_stream(local, compression=None) as out:
                out.write(file_bytes(docs, np.concatenate(lengths), flat, encoder.size))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, seq, path, len(docs), len(flat)), kinds, strict=True)], ["part", "seq", "path", "docs", "ids"])

        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                found, length = encoder.encode(data, offsets, end_id)
                docs += batch.column(0).slice(first, last - first).to_pylist()
                lengths.append(length)
                ids.append(found)
                held += len(found)
                if held >= FILE_IDS:
                    yield save()
                    docs, lengths, ids, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield save()

    map_arrow(ranged, run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_tokens(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Per document of the files that the index names: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, local = open_fs(path)
                with system.open_input_file(local) as file:
                    docs, lengths, ids = read_file(file.read())
                wide = memoryview(ids.astype("<u4")).cast("B")
                ends = np.cumsum(lengths)
                sums = [zlib.crc32(wide[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start + ends - lengths), pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("ids").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = index.join(parts, "part").select("path", (F.col("before") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("start"))
    return map_arrow(placed.repartition(max(shuffle_partitions(spark), 1)), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
