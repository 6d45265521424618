"""Ids and bytes against the library: odd texts, random texts, long matches, every given document."""

import hashlib
import random

import pytest
import public_tokenizers
import tiktoken

from skarn.llm import byte_bpe
from skarn.llm.byte_bpe import BytePairs, decode_ids, encode_texts, op13_byte_bpe, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(PATH)


@pytest.fixture(scope="module")
def coder(ranks):
    return BytePairs(ranks, PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(coder, library, text):
    ids = coder.encode(text).tolist()
    assert ids == library.encode_ordinary(text), text[:80]
    assert coder.decode(coder.encode(text)) == text.encode()


def test_odd_texts(coder, library):
    odd = [
        "", " ", "\n\n  x", "don't WE'LL 's", "<|endoftext|>", "naïve café ñandú ciónñas", "日本語のテキスト 한국어", "a\x1cb\x85c\xa0d e\x00f",
        "😀👩‍👩‍👧 ok", "12²³ ½ ٣٤٥", "Ω≈ç√∫˜µ≤≥÷", "́̂é", "﻿x", "a" * 7 + "b" * 5, "   leading", "tabs\t\t\tx", "x\r\n\r\ny",
    ]
    for text in odd:
        check(coder, library, text)


def test_letters_newer_than_the_library(coder, library):
    newer = [chr(c) for c in (0x558, 0x88F, 0xC5C, 0xA7CE, 0x10940, 0x11DE0, 0x1246F)]
    for c in newer:
        for text in (f"a{c}b", f" {c}{c}x", f"1{c}2", f"{c} {c}", f"é{c}-]^\\ {c}"):
            check(coder, library, text)
    check(coder, library, "x".join(newer))
    check(coder, library, "ᲉꟚ aᲉ")  # letters the library knows


def test_random_texts(coder, library, monkeypatch):
    rnd = random.Random(3)
    pools = ["ab", "a", "aeiourstn", "thein ", "дом ", "的一是在不了", "éñócij a", "0123 .,-'", "ab\n ", "\x00\xffࠀ\U00010000"]
    for remembered in (150_000, 3):
        monkeypatch.setattr(byte_bpe, "REMEMBERED_MATCHES", remembered)
        monkeypatch.setattr(byte_bpe, "REMEMBERED_PAIRS", remembered)
        for _ in range(1500):
            check(coder, library, "".join(rnd.choices(rnd.choice(pools), k=rnd.randint(1, 90))))


def test_every_entry_and_pairs_of_entries(coder, library, ranks):
    rnd = random.Random(4)
    entries = [e for e in ranks if e.isalpha()]
    for _ in range(5000):
        text = "".join(e.decode() for e in rnd.choices(entries, k=rnd.randint(1, 4)))
        check(coder, library, text)


def test_small_vocabulary_of_one_letter():
    # Ties of equal ranks: runs of a letter, with entries of several lengths.
    for lengths in ((2,), (2, 3), (2, 4, 3), (2, 4, 8, 6, 7), (2, 3, 5, 8)):
        ranks = {bytes([b]): b for b in range(256)} | {b"a" * n: 256 + k for k, n in enumerate(lengths)} | {b"ba": 300, b"aab": 301}
        coder, library = BytePairs(ranks, PATTERN), tiktoken.Encoding("s", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for n in range(1, 40):
            for text in ("a" * n, "b" + "a" * n, "a" * n + "b" + "a" * (n // 2)):
                check(coder, library, text)


def test_one_match_of_a_megabyte(coder, library):
    rnd = random.Random(5)
    for text in ("a" * 1_000_000, "".join(rnd.choices("abcdefgh", k=1_000_000))):
        data = coder.encode(text)
        assert coder.decode(data) == text.encode()
    for text in ("a" * 30_000, "".join(rnd.choices("abcdefgh", k=30_000))):
        check(coder, library, text)


def test_edges(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "é", "y"), (2, None, None), (3, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "c0")
    tokens = encode_texts(docs, PATH, PATTERN)
    assert tokens.columns == ["doc_id", "c0", "ids"]
    got = {(r["doc_id"], r["c0"], bytes(r["decoded"]).decode()) for r in decode_ids(tokens, PATH, PATTERN).collect()}
    assert got == {(1, "x", "a b"), (None, "y", "é"), (2, None, ""), (3, "z", "")}
    assert encode_texts(docs.limit(0), PATH, PATTERN).count() == 0
    clash = docs.withColumn("ids", docs["doc_id"])
    assert encode_texts(clash, PATH, PATTERN).schema["ids"].dataType.simpleString() == "array<int>"


def test_query(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = set()
    for d in docs:
        ids = library.encode_ordinary(d["text"] or "")
        digest = lambda data: hashlib.sha256(data).hexdigest()
        want.add((d["doc_id"], len(ids), digest(",".join(map(str, ids)).encode()), digest((d["text"] or "").encode())))
    assert {tuple(r) for r in op13_byte_bpe(spark, FOLDER).collect()} == want
