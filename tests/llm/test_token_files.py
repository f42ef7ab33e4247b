import random

import numpy as np
import pytest

from ledgerlens.llm import range_coder, token_files

from . import brute

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string"
HARD = ["a<|endoftext|>b <|STARTOFTEXT|>", "don't we'll 's it's '' 'tis", "É é é ́x ñandú", "a​b  　c", "thor*** reed,reed. U.S.A. 3.14x10 x9y", "가 ᆨ", "MiXeD CaSe", "end!!'s <|x|> |<", "", None, "ǅ ß ẞ İ"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


def run(spark, rows, schema=SCHEMA):
    index = token_files.write_tokens(spark.createDataFrame(rows, schema), P.path("word_bpe_49k.json"), 2)
    return [tuple(r) for r in token_files.read_tokens(spark, index).orderBy("start").collect()]


def test_equals_encoding_whole_texts(spark, tokenizer):
    rows = [(100 - k, t) for k, t in enumerate(HARD)]
    assert run(spark, rows) == brute.token_rows(rows, tokenizer, 2)


def test_random_mixtures_of_marks_and_letters(spark, tokenizer):
    rng = random.Random(2)
    alphabet = "abcABC'’.,!<|>-_ 09éß́  \t\n"
    rows = [(k, "".join(rng.choices(alphabet, k=60))) for k in range(200)]
    assert run(spark, rows) == brute.token_rows(rows, tokenizer, 2)


def test_null_ids_repeated_rows_clashing_columns_and_empty_tables(spark, tokenizer):
    out = run(spark, [(3, "c", 1), (None, "n", 1), (1, "a b", 1), (1, "a b", 1)], "doc_id long, text string, id int")
    assert [r[0] for r in out] == [None, 1, 1, 3] and [r[2] for r in out] == [2, 3, 3, 2]
    assert run(spark, spark.createDataFrame([], SCHEMA).collect()) == []


def test_many_files_keep_the_order(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 300)
    rows = [(k, " ".join(f"word{(k * 31 + j) % 97}" for j in range(k % 50))) for k in range(120)]
    index = token_files.write_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), P.path("word_bpe_49k.json"), 2)
    assert [tuple(r) for r in token_files.read_tokens(spark, index).orderBy("start").collect()] == brute.token_rows(rows, tokenizer, 2)


@pytest.mark.parametrize("n", [0, 1, range_coder.BLOCK_IDS - 1, range_coder.BLOCK_IDS, range_coder.BLOCK_IDS + 1, 5000])
@pytest.mark.parametrize("kind", ["noise", "same", "few", "words"])
def test_coder_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"noise": rng.integers(0, 49408, n), "same": np.full(n, 49407), "few": rng.integers(0, 3, n), "words": np.tile(rng.integers(0, 49408, 37), n // 37 + 1)[:n]}[kind].astype(np.uint16)
    docs, lengths = [None, 5], np.array([n // 3, n - n // 3])
    data = token_files.file_bytes(docs, lengths, ids, 49408)
    found_docs, found_lengths, found = token_files.read_file(data)
    assert found_docs == docs and (found_lengths == lengths).all() and (found == ids).all()
    if kind == "words" and n == 5000:
        assert len(data) < n


def test_damage_is_noticed():
    ids = np.random.default_rng(1).integers(0, 49408, 2000).astype(np.uint16)
    data = bytearray(token_files.file_bytes([1], np.array([2000]), ids, 49408))
    data[-300] ^= 255
    with pytest.raises(ValueError):
        token_files.read_file(bytes(data))


def encoded(encoder, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return encoder.encode(raw, np.array([0, len(raw)]), 2)[0].tolist()


def test_special_tokens_are_told_apart_by_case_in_either_order(tokenizer):
    texts = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "x<|StartOfText|>y", "x<|startoftext|>y", "<|", "<|a", "<|A", "End END end"]
    for order in (texts, texts[::-1]):
        encoder = token_files.PieceEncoder(P.path("word_bpe_49k.json"))
        for text in order:
            assert encoded(encoder, text) == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_pieces_that_lose_their_place_are_encoded_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "TABLE_BITS", 3)
    encoder = token_files.PieceEncoder(P.path("word_bpe_49k.json"))
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeéñ'1", k=4)) for _ in range(200)]
    for _ in range(5):
        text = " ".join(rng.choices(words, k=300))
        assert encoded(encoder, text) == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
    monkeypatch.setattr(token_files, "CACHE_PIECES", 250)
    for _ in range(3):
        text = " ".join(rng.choices(words, k=300))
        assert encoded(encoder, text) == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("kinds", [1, 2, 5000, 65536])
def test_frequencies_keep_every_id(kinds):
    ids = np.concatenate((np.arange(65536 - kinds, 65536), np.full(100_000, 65535))).astype(np.uint16)
    scaled = range_coder.frequencies(ids)
    assert scaled.sum() == 65536 and (scaled > 0).sum() == kinds
    again, size = range_coder.unpack_frequencies(range_coder.pack_frequencies(scaled) + b"more")
    assert (again == scaled).all() and size == len(range_coder.pack_frequencies(scaled))
    rows = range_coder.encode_blocks(ids, scaled)
    data, sizes = np.frombuffer(b"".join(rows), "<u4"), np.array([len(r) for r in rows])
    assert (range_coder.decode_blocks(data, (np.cumsum(sizes) - sizes) // 4, len(ids), scaled) == ids).all()


def test_ids_of_a_skewed_distribution_take_about_its_entropy():
    rng = np.random.default_rng(8)
    ids = np.minimum(rng.geometric(0.02, 200_000), 49407).astype(np.uint16)
    share = np.bincount(ids) / len(ids)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum() / 8
    assert len(token_files.file_bytes([1], np.array([len(ids)]), ids, 49408)) / len(ids) < 1.12 * entropy
