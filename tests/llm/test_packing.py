import random
import struct
import zlib

import pytest

from ledgerlens.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string"


def fewest(lengths, size):
    """The least number of sequences, by trying every place for every piece."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[k]}:
            at = rooms.index(room)
            place(k + 1, [*rooms[:at], room - lengths[k], *rooms[at + 1 :]])
        place(k + 1, [*rooms, size - lengths[k]])

    place(0, [])
    return best


def is_packing(packed, lengths, size):
    return sorted(x for s in packed for x in s) == sorted(lengths) and all(0 < sum(s) <= size for s in packed)


@pytest.mark.parametrize("seed", range(40))
def test_few_pieces_are_packed_as_well_as_they_can_be(seed):
    draw = random.Random(seed)
    lengths = [draw.randint(1, 40) for _ in range(draw.randint(1, 11))] if seed % 2 else [draw.randint(13, 28) for _ in range(10)]
    packed = packing.pack_group(lengths, 50)
    assert is_packing(packed, lengths, 50) and len(packed) == fewest(lengths, 50)


def test_the_search_beats_best_fit():
    few = [56, 53, 31, 29, 16, 14]
    assert len(packing.best_fit(few, 100)) == 3 and is_packing(packing.complete(few, 100, 2, 1000), few, 100)
    draw = random.Random(5)
    many = [draw.randint(900, 1800) for _ in range(300)]
    packed = packing.pack_group(many, 4096)
    assert is_packing(packed, many, 4096) and len(packed) < len(packing.best_fit(sorted(many, reverse=True), 4096))


def test_bounds_and_domination():
    assert packing.lower_bound(packing.np.array([60, 60, 60, 10]), 100) == 3 and packing.lower_bound(packing.np.array([51, 49, 50]), 100) == 2
    left = packing.Left([40, 30, 20, 10], 100)
    assert packing.fillings(left, 40, 40) == [(40,)]
    assert packing.fillings(left, 50, 50)[0] in ((40, 10), (30, 20))
    assert packing.fillings(left, 5, 5) == [()] and packing.fillings(left, 5, 4) == []
    assert packing.dominated(left, (20,), 15) and not packing.dominated(left, (40,), 5)
    assert packing.complete([7, 7, 6, 3, 3, 4], 10, 3, 1000) is not None and packing.complete([7, 7, 6, 3, 3, 5], 10, 3, 1000) is None


def check_rows(spark, rows, packed, size, end_id):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        for piece, start in enumerate(range(0, len(ids), size)):
            own = ids[start : start + size]
            want.append((doc_id, piece, start, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))))
    found = packing.digests(packed.pieces).join(packed.places, "key").collect()
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in found)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        upto = 0
        for offset, length in sorted(parts):
            assert offset == upto
            upto += length
        assert upto <= size
    whole = packed.sequences().collect()
    assert {r["sequence_id"]: r["length"] for r in whole} == {s: sum(n for _, n in parts) for s, parts in by_sequence.items()}
    assert all(len(r["ids"]) == 2 * r["length"] for r in whole)
    return [x[3] for x in want], len(by_sequence)


def test_documents_of_every_kind(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (None, "one two"), (3, "same"), (3, "same"), (4, "other of three"), (5, "word " * 9000), (6, "é 日本 <|x|>"), *[(10 + k, "text and more " * (k % 37)) for k in range(300)]]
    packed = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path("word_bpe_49k.json"), 1, 128)
    lengths, sequences = check_rows(spark, rows, packed, 128, 1)
    assert sequences == packing.lower_bound(packing.np.array(lengths), 128)
    packed.scratch.drop()


def test_many_groups_waste_little(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 150)
    draw = random.Random(3)
    rows = [(k, "token " * min(400, int(draw.lognormvariate(3, 1)))) for k in range(3000)]
    packed = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), public_tokenizers.path("word_bpe_49k.json"), 1, 128)
    lengths, sequences = check_rows(spark, rows, packed, 128, 1)
    assert sequences <= packing.lower_bound(packing.np.array(lengths), 128) + packing.LAST_GROUPS + 1


def test_equal_pieces_and_empty_table(spark):
    docs = spark.createDataFrame([(k, "a b c d e") for k in range(500)], SCHEMA)
    packed = packing.pack_documents(docs.withColumn("key", docs["doc_id"] * 0), public_tokenizers.path("word_bpe_49k.json"), 1, 6)
    assert packed.places.count() == 500 == packed.places.select("sequence_id").distinct().count()
    none = packing.pack_documents(docs.where("doc_id < 0"), public_tokenizers.path("word_bpe_49k.json"), 1)
    assert packing.digests(none.pieces).join(none.places, "key").count() == 0 and none.sequences().count() == 0
