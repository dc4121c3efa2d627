"""Byte pairs of many texts at once, against the library and the encoder of single texts."""

import json
import random

import pyarrow as pa
import public_tokenizers
import pytest

from glyphmill.llm import bytepairs, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.UnitEncoder(PATH)


def by_library(encoder, texts):
    return [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def together(encoder, column):
    return [list(memoryview(ids).cast("I")) for ids in encoder.encode_all(column)]


def odd_texts(n):
    rng = random.Random(12)
    bits = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", *map(chr, (0, 0x1F, 0x7F, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
    bits += ["'", "'s", "'t", "'re", "'ll", "'S", "'eau", "''", "it's", ".'d", "<", "|", "<|", "<|endoftext|>", "é", "×", "÷", "ß", "À", "ÿ", "ª", "²", "ça", "é"]
    bits += ["жук", "中文", "\U0001f600", "’", "€", "…", "٠", "the", "The", "a", "and", "tion", "aaaa", "012", "7", "...", "-", "!?", "(", "_", "x" * 70, "-" * 65, "ab" * 32, "é" * 33]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_ids_are_those_of_the_library(encoder):
    texts = [None, "", *odd_texts(6000), "", None, " ", "\n", "<", "|endoftext|>", "'", "s", "Ã", "a ", " a"]
    want = by_library(encoder, texts)
    assert together(encoder, pa.array(texts)) == want
    assert together(encoder, pa.array(texts, pa.large_string())[7:5000]) == want[7:5000]
    assert together(encoder, pa.array([], pa.string())) == []
    assert together(encoder, pa.array([None, ""], pa.string())) == [[], []]


def test_long_texts_are_parted_where_no_token_crosses(encoder, monkeypatch):
    texts = [" ".join(odd_texts(400)), "", "word" * 300, "short one", " the end" * 300, "中" * 900]
    want = by_library(encoder, texts)
    monkeypatch.setattr(bytepairs, "AT_ONCE", 200)
    assert together(encoder, pa.array(texts)) == want


def test_words_of_a_batch_are_not_encoded_one_by_one(monkeypatch):
    encoder = packing.UnitEncoder(PATH)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 20))) for _ in range(20000)]
    texts = [" ".join(words[n : n + 400]) + ", 1984.\nAnd l'ami!" for n in range(0, len(words), 400)]
    want = by_library(encoder, texts)

    def alone(text):
        raise AssertionError(text)

    for name in ("encode", "whole", "word"):
        monkeypatch.setattr(encoder, name, alone)
    assert together(encoder, pa.array(texts)) == want
    assert not encoder.young and not encoder.words  # nothing is remembered


def test_other_files_are_left_to_the_library(encoder, tmp_path):
    found = json.loads(open(PATH, encoding="utf-8").read())
    found["model"]["ignore_merges"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(found), "utf-8")
    other = packing.UnitEncoder(str(path))
    assert other.merges is None and encoder.merges is not None
    texts = ["The first words, the last ones", None]
    assert together(other, pa.array(texts)) == by_library(other, texts)
