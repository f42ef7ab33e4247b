"""Best-fit packing of tokenised documents into as few sequences as possible, by bin completion.

Documents are tokenised and only those longer than a sequence are cut. The pieces' ids are written once; what is packed are
their numbers and lengths. Whole pieces are sequences of their own. The others are dealt by a hash of their number into groups
of about GROUP, each packed by itself in a task:

- best fit in descending order gives the incumbent, and sums and the counts of large pieces give a lower bound. If both are
  equal, the group is done;
- else branch and bound looks for one sequence fewer: each step takes the largest piece left and tries the undominated
  fillings of the rest of its sequence, least waste first. A filling is dominated where one piece left could stand in for some
  of its pieces and waste no more. A branch ends when it has wasted more than one sequence fewer allows. Each success is the next
  incumbent; the search of a group ends at the bound or after NODES steps for each of its pieces.

Sequences that a group leaves unfilled, the emptiest first and an eighth of its pieces at most, are dealt anew into fewer groups,
until there are LAST_GROUPS; so all groups together waste little more than one would, and no task ever holds more than a group.

Edge cases: null and empty texts are a piece of the end id alone; ids may be null or repeated: each row is a document of its own,
and its pieces have its id; a very long text gives pieces of whole sequences and one rest; an empty table gives empty ones;
other columns are left out, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, map_arrow, shuffle_partitions
from .token_files import _encoder
from .wordhash import text_chunks

#: Pieces of a group; groups of the last round; share of a group's pieces that goes on to the next round.
GROUP, LAST_GROUPS, CARRIED = 4096, 4, 8
#: Steps of the search for each piece of a group; fillings tried at each step, and choices looked at to find them.
NODES, FILLINGS, TRIES = 2, 4, 150
PIECE = "doc_id long, piece int, start long, length int, ids binary"


def pieces(documents: DataFrame, tokenizer: str, end_id: int, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece (from 0), start (its document's ids before it), length, ids (unsigned 16-bit little-endian, binary)."""
    source = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        if encoder.size > 1 << 16:
            raise ValueError("ids must be below 65536")
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                ids, lengths = encoder.encode(data, offsets, end_id)
                count = -(-lengths // size)
                text = np.repeat(np.arange(len(lengths)), count)
                piece = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                own = np.minimum(size, lengths[text] - start)
                edges = np.concatenate(([0], 2 * np.cumsum(own))).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(edges), pa.py_buffer(ids.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(text)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(own.astype(np.int32)), held], ["doc_id", "piece", "start", "length", "ids"])

    return map_arrow(source, run, PIECE)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences that any packing needs: by the sum, and by the pieces of which no two, or only few more, go together."""
    count = np.bincount(lengths, minlength=size + 1)
    upto, total = np.cumsum(count), np.cumsum(count * np.arange(size + 1))
    half = size // 2
    small = np.arange(half + 1)  # pieces below this are left out of account
    alone = len(lengths) - upto[size - small]  # cannot share with any that counts
    mid = upto[size - small] - upto[half]
    room = mid * size - (total[size - small] - total[half])
    rest = total[half] - np.where(small > 0, total[small - 1], 0)
    return max(int((alone + mid + np.maximum(0, -(-(rest - room) // size))).max()), -(-int(lengths.sum()) // size))


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Pieces in descending order, each where it leaves least room."""
    rooms: list[tuple[int, int]] = []  # (room, sequence), sorted
    out: list[list[int]] = []
    for x in lengths:
        at = bisect_left(rooms, (x, -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            room, k = size, len(out)
            out.append([])
        out[k].append(x)
        if room > x:
            insort(rooms, (room - x, k))
    return out


class Left:
    """The pieces left, as counts by length, and which lengths there are as the bits of one number."""

    def __init__(self, lengths: list[int], size: int):
        self.count = [0] * (size + 1)
        self.bits = 0
        for x in lengths:
            self.put(x)

    def put(self, x: int) -> None:
        self.count[x] += 1
        self.bits |= 1 << x

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            self.bits ^= 1 << x

    def largest(self, most: int) -> int:
        """The largest length of at most most; 0 if there is none."""
        return (self.bits & ((2 << most) - 1)).bit_length() - 1 if most > 0 and self.bits & ((2 << most) - 1) else 0


def fillings(left: Left, room: int, waste: int) -> list[tuple[int, ...]]:
    """Undominated fillings of room by pieces left, of at most this waste, least waste first and then the fewest pieces; FILLINGS at most.

    A single piece that fills the room dominates all others. Fillings of one more piece are made of the largest that fits
    beside each choice before it, so what any of their last pieces could be swapped for is smaller.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    if room <= waste:
        found.append((room, ()))
    best = left.largest(room)
    if not best:
        return [x for _, x in found]
    if best == room:
        return [(best,)]

    tries = TRIES

    def extend(chosen: tuple[int, ...], rest: int, most: int, deep: int) -> None:
        """Adds the fillings that go on with deep pieces of at most most and then the largest that fits."""
        nonlocal tries
        x = left.largest(min(rest, most))
        while x and tries > 0 and perfect[0] < FILLINGS:
            tries -= 1
            if left.count[x] > chosen.count(x):
                over, own = rest - x, (*chosen, x)
                fits = left.largest(min(over, x))
                if fits == x and left.count[x] <= own.count(x):
                    fits = left.largest(min(over, x - 1))
                if fits and deep > 1:
                    extend(own, over, fits, deep - 1)
                elif over - fits <= waste:
                    found.append((over - fits, (*own, fits) if fits else own))
                    perfect[0] += over == fits
                if deep == 1 and rest - 2 * x > waste:  # pieces of this length and less leave too much
                    break
            x = left.largest(x - 1)

    perfect = [0]
    for deep in (1, 2, 3):
        extend((), room, room, deep)
        if perfect[0]:
            break
    kept = []
    for w, own in sorted(set(found), key=lambda f: (f[0], len(f[1]), f[1])):
        if not dominated(left, own, w):
            kept.append(own)
            if len(kept) == FILLINGS:
                break
    return kept


def dominated(left: Left, own: tuple[int, ...], waste: int) -> bool:
    """Whether one piece left could stand in for some of own and waste no more: longer than they are, or several for one."""
    for mask in range(1, 1 << len(own)):
        part = [x for k, x in enumerate(own) if mask >> k & 1]
        total = sum(part)
        other = left.largest(total + waste)
        if other > total or (other == total and len(part) > 1 and left.count[other] > own.count(other)):
            if left.count[other] > own.count(other):
                return True
    return waste > 0 and not own and bool(left.largest(waste))


def complete(lengths: list[int], size: int, bins: int, nodes: int) -> list[list[int]] | None:
    """A packing into bins sequences by bin completion, None if there is none or it is not found within so many steps."""
    left = Left(lengths, size)
    spare = bins * size - sum(lengths)
    if spare < 0:
        return None
    path: list[list[int]] = []
    choices: list[Iterator[tuple[int, ...]]] = []
    wasted = [0]

    def branch() -> None:
        x = left.largest(size)
        left.take(x)
        path.append([x])
        choices.append(iter(fillings(left, size - x, spare - wasted[-1])))

    remaining = len(lengths)
    if not remaining:
        return []
    branch()
    remaining -= 1
    while choices and nodes > 0:
        nodes -= 1
        current = path[-1]
        for x in current[1:]:  # the filling tried last
            left.put(x)
            remaining += 1
        if len(wasted) > len(choices):
            wasted.pop()
        del current[1:]
        own = next(choices[-1], None)
        if own is None:
            left.put(current[0])
            remaining += 1
            path.pop()
            choices.pop()
            continue
        for x in own:
            left.take(x)
        current += own
        remaining -= len(own)
        wasted.append(wasted[-1] + size - sum(current))
        if not remaining:
            return path
        branch()
        remaining -= 1
    return None


def pack_group(lengths: list[int], size: int) -> list[list[int]]:
    """lengths in sequences: best fit, then one sequence fewer as long as the search finds that."""
    lengths = sorted(lengths, reverse=True)
    incumbent = best_fit(lengths, size)
    least = lower_bound(np.array(lengths, np.int64), size) if lengths else 0
    while len(incumbent) > least:
        better = complete(lengths, size, len(incumbent) - 1, NODES * len(lengths))
        if better is None:
            break
        incumbent = better
    return incumbent


def _pack_frame(rows: pd.DataFrame, size: int, final: bool) -> pd.DataFrame:
    """(key, length, sequence, place, carried, group) of one group's pieces; sequences are numbered from 0."""
    rows = rows.sort_values(["length", "key"])
    by_length: dict[int, list[int]] = defaultdict(list)
    for key, x in zip(rows["key"].tolist(), rows["length"].tolist(), strict=True):
        by_length[x].append(key)
    packed = pack_group(rows["length"].tolist(), size)
    packed.sort(key=sum)
    room, out = 0 if final else len(rows) // CARRIED, []
    for number, own in enumerate(packed):
        carried = sum(own) < size and room >= len(own)
        room = room - len(own) if carried else 0
        at = 0
        for x in own:
            out.append((by_length[x].pop(), x, number, at, carried))
            at += x
    return pd.DataFrame(out, columns=["key", "length", "sequence", "place", "carried"]).assign(group=rows["group"].iloc[0])


def _packer(size: int, final: bool):
    return lambda rows: _pack_frame(rows, size, final)


def pack(lengths: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """(key, sequence_id, offset) of pieces (key, length), whose keys are distinct."""
    whole = lengths.where(F.col("length") == size).select("key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).alias("offset"))
    open_pieces = lengths.where(F.col("length") < size).select("key", F.col("length").cast("int"))
    found, count, round_number, before = whole, open_pieces.count(), 0, None
    while count:
        groups = max(1, -(-count // GROUP))
        groups = groups if before is None else min(before, max(groups, LAST_GROUPS))
        final = groups <= LAST_GROUPS
        dealt = open_pieces.withColumn("group", F.pmod(F.xxhash64("key", F.lit(round_number)), F.lit(groups)))
        # The group is bound into the numbers of its sequences, which so never meet those of another group or round.
        number = lambda k, n=round_number: (F.lit(n).cast("long") * (1 << 58) + F.col("group") * (1 << 20) + F.col("sequence")).alias(k)
        # An explicit number of tasks: what goes to them is small, what they do is not.
        dealt = dealt.repartition(min(groups, 4 * shuffle_partitions(dealt.sparkSession)), "group")
        made = scratch.write(dealt.groupBy("group").applyInPandas(_packer(size, final), "key long, length int, sequence long, place int, carried boolean, group long"), "packed")
        found = found.unionByName(made.where("not carried").select("key", number("sequence_id"), F.col("place").alias("offset")))
        open_pieces, before, round_number = made.where("carried").select("key", "length"), groups, round_number + 1
        count = 0 if final else open_pieces.count()
    return found


@dataclass
class Packed:
    """pieces: key and PIECE; places: key, sequence_id, offset. scratch owns the tables under both."""

    pieces: DataFrame
    places: DataFrame
    scratch: Scratch

    def sequences(self) -> DataFrame:
        """(sequence_id, length, ids, parts): the packed ids of each sequence, end to end, and its documents' parts in order."""
        joined = self.pieces.join(self.places, "key")
        ordered = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
        listed = joined.groupBy("sequence_id").agg(ordered.alias("own"))
        ids = F.aggregate("own", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
        parts = F.transform("own", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["length"].alias("length")))
        return listed.select("sequence_id", F.aggregate("own", F.lit(0), lambda a, x: a + x["length"]).alias("length"), ids.alias("ids"), parts.alias("parts"))


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> Packed:
    """Tokenises and packs documents. Their pieces are numbered once and written, so a lost task finds the same numbers again."""
    scratch = Scratch(documents.sparkSession)
    made = pieces(documents, tokenizer, end_id, size, id_col, text_col).withColumn("key", F.monotonically_increasing_id())
    table = scratch.write(made, "pieces")
    return Packed(table, pack(table.select("key", "length"), size, scratch), scratch)


def digests(table: DataFrame) -> DataFrame:
    """key, doc_id, piece, start, length and ids_crc32 (of the ids as unsigned 32-bit little-endian numbers) of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sums, pa.int64())], ["key", "doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(table.select("key", "doc_id", "piece", "start", F.col("length").cast("long"), "ids"), run, "key long, doc_id long, piece int, start long, length long, ids_crc32 long")
