"""Ids against the library, the code's round trip, and the files read back."""

import random
import sys

import numpy as np
import pytest
from tokenizers import Tokenizer

from skarn.llm import token_files, vocab
from skarn.llm.token_files import (
    crc, op9_token_files, pack_ids, pack_many, read_token_files, unpack_ids, unpack_many, write_token_files,
)
from skarn.llm.vocab import Encoder, default_path

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def test_ids_of_odd_texts(library, monkeypatch):
    odd = [
        "", " ", "\n\n", "İstanbul ΣΑΣ", "don't WE'LL l'ami 12²³ x<|endoftext|>y a<|b", "\x85nb\xa0sp\tq\rz", "naïve café œuvre ǅ ß ẞ", "é à",
        "''s 's's '''ll'", "日本語 text", "a\x0bb\x1cc\x00d", "ªº¼½ µ ¡¿«»", "\U0001f600 ok", "x" * 5000, "#*$%&|<> " * 50, "A'S 'T 'RE", "ſ K Å",
    ]
    rnd = random.Random(1)
    pool = "abcÀéñßĿŉǆ012 \t\n'’.,;-|<>&" + "'sd"
    odd += ["".join(rnd.choices(pool, k=rnd.randint(1, 60))) for _ in range(600)]
    want = [library.encode(t, add_special_tokens=False).ids for t in odd]
    for remembered, portion in ((vocab.REMEMBERED_PARTS, vocab.PORTION), (5, 100)):
        monkeypatch.setattr(vocab, "REMEMBERED_PARTS", remembered)
        monkeypatch.setattr(vocab, "REMEMBERED_WORDS", remembered)
        monkeypatch.setattr(vocab, "PORTION", portion)
        coder = Encoder(default_path())
        for _ in range(2):
            assert [x.tolist() for x in coder.batch(odd)] == want
    assert [len(x) for x in coder.batch([None, ""])] == [0, 0]


def test_lower_case_beyond_latin(library):
    """Lower-case letters may lie outside the range that texts are cut for; contractions meet every kind of neighbour."""
    texts = [f"{a}{c}{b}" for c in "ȺȾɃɄɅƁƆɈ" for a in ("", "a", "'", "1") for b in ("b", "'s", "2", ".")]
    texts += [f"{a}'{c}{b}" for c in ("s", "T", "re", "vE", "m", "ll", "d", "l", "r") for a in ("", "a", "'", "1", ".", " ") for b in ("", "'", "'s", "e", "1", ".", " ")]
    assert [x.tolist() for x in Encoder(default_path()).batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_no_call_per_word(library):
    """Python's calls go with the texts, not with their words, none of which come twice here."""
    rnd = random.Random(2)
    texts = [" ".join("".join(rnd.choices("aeéinrst", k=9)) + ",'" for _ in range(3000)) for _ in range(20)]
    coder, calls = Encoder(default_path()), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = coder.batch(texts)
    finally:
        sys.setprofile(None)
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert calls < 2000


def test_long_text_in_pieces(library, monkeypatch):
    """What is held at a time goes with ``PORTION``, not with the longest text."""
    monkeypatch.setattr(vocab, "PORTION", 100)
    coder, sizes = Encoder(default_path()), []
    cut = coder._cut
    monkeypatch.setattr(coder, "_cut", lambda texts: sizes.append(sum(map(len, texts))) or cut(texts))
    texts = ["it's the été's ''s end\n" * 500, "short", "x" * 300 + " y'll " * 90]
    assert [x.tolist() for x in coder.batch(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(sizes) <= 300 and len(sizes) > 100


def test_code():
    rnd = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        for top in (200, 300, 70_000, 1 << 25, 1 << 32):
            ranks = rnd.integers(0, top, n, dtype=np.uint64).astype("<u4")
            control, data = pack_ids(ranks)
            assert len(control) == -(-n // 4) and (unpack_ids(n, control, data) == ranks).all()


def test_code_of_many():
    rnd = np.random.default_rng(1)
    for n in ([], [0], [0, 3, 0, 4, 1, 0], rnd.integers(0, 40, 200)):
        n = np.asarray(n, np.int64)
        ranks = rnd.integers(0, 1 << 17, int(n.sum()), dtype=np.uint64).astype("<u4")
        control, controls, data, sizes = pack_many(ranks, n)
        assert (unpack_many(n, control, data) == ranks).all()
        parts = [pack_ids(r) for r in np.split(ranks, np.cumsum(n)[:-1])] if len(n) else []
        assert [(len(c), len(d)) for c, d in parts] == list(zip(controls.tolist(), sizes.tolist()))
        assert b"".join(c for c, _ in parts) == control.tobytes() and b"".join(d for _, d in parts) == data.tobytes()


def test_portions(spark, library, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = None
    for portion in (token_files.PORTION, 700, 1):
        monkeypatch.setattr(token_files, "PORTION", portion)
        folder, order = write_token_files(docs, default_path())
        got = read_token_files(spark, folder, order).orderBy("start").collect()
        digests = read_token_files(spark, folder, order, digest=True).orderBy("start").collect()
        assert [r["ids_crc32"] for r in digests] == [crc(np.frombuffer(r["ids"], "<u4")) for r in got]
        want = want or got
        assert got == want


def test_query(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    got, start = op9_token_files(spark, FOLDER).orderBy("doc_id").collect(), 0
    assert len(got) == len(docs)
    for r, d in zip(got, docs):
        ids = np.array([*library.encode(d["text"], add_special_tokens=False).ids, 1])
        assert tuple(r) == (d["doc_id"], start, len(ids), crc(ids))
        start += len(ids)


def test_files(spark, library):
    rows = [(5, "b b a", 1), (2, None, 1), (9, "", 1), (2, "more words", 1), (None, "none", 1), (7, "b " * 9000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    folder, order = write_token_files(docs, default_path())
    assert order[0] == library.encode("b", add_special_tokens=False).ids[0]
    ids = [r["doc_id"] for r in spark.read.parquet(folder).orderBy("part", "local_start").collect()]
    assert ids == [None, 2, 2, 5, 7, 9]
    got = read_token_files(spark, folder, order).orderBy("start").collect()
    start = 0
    for r in got:
        texts = [t or "" for d, t, _ in rows if d == r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() in [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
        assert r["start"] == start
        start += r["n_tokens"]
    folder, order = write_token_files(docs.limit(0), default_path())
    assert read_token_files(spark, folder, order).count() == 0
