"""Counts and verdicts against a plain reading of the rules."""

import re

from skarn.llm.quality import op8_quality_rules, quality_rules, repeated_words

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts(spark):
    got = {r["doc_id"]: r for r in op8_quality_rules(spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, want = got[d["doc_id"]], plain(d["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_labelled_good_documents_stay(spark):
    rows = op8_quality_rules(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    good = rows.where("quality = 1 AND NOT base_failed")
    assert good.count() > 100 and good.where("NOT kept").count() == 0


def test_bands(spark):
    import random

    rnd = random.Random(1)
    prose = " ".join("".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 9))) for _ in range(900))
    noise = " ".join("".join(rnd.choices([chr(c) for c in range(0x21, 0x24F) if c != 0x7F and not 0x80 <= c <= 0xA0], k=60)) for _ in range(60))
    pattern = " ".join(f"row {i} of the same long table with no news" for i in range(900))
    rows = [(1, prose, "x"), (2, noise, "x"), (3, pattern, "x"), (4, None, "x"), (5, "", None), (1, prose, "x"), (6, prose + "\n" + pattern, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    kept = quality_rules(docs)
    assert kept.columns == ["doc_id", "text", "kept"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1]
    assert quality_rules(docs.limit(0)).count() == 0


def test_bands_come_from_good_documents():
    import pyarrow.parquet as pq

    from skarn.llm.quality import BANDS, LEAST_WORDS, bands_of

    good = {r["doc_id"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist() if r["quality"] == 1}
    texts = [r["text"].encode() for r in pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pylist() if r["doc_id"] in good and r["text"]]
    texts = [t for t in texts if len(t.split()) >= LEAST_WORDS and 100 * repeated_words(t.split()) <= 30 * len(t.split())]
    assert bands_of(texts) == BANDS


def test_random_letters_and_hex_fall(spark):
    import random

    rnd = random.Random(5)
    rows = []
    for letters, sizes in (("abcdefghijklmnopqrstuvwxyz", (1536, 2048, 4096, 16_000, 43_000)), ("0123456789abcdef", (3072, 4096, 16_000, 43_000)), ("abcdefghijklmnopqrstuvwxyz0123456789", (768, 2048, 43_000))):
        for size in sizes:
            rows += [(size, " ".join("".join(rnd.choices(letters, k=rnd.randint(2, 9))) for _ in range(size))[:size]) for _ in range(3)]
    assert quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0


def test_repeats_at_the_edges():
    assert repeated_words([]) == 0
    assert repeated_words([b"a"] * 8) == 0
    assert repeated_words([b"a"] * 9) == 9
    assert repeated_words([str(i).encode() for i in range(50)]) == 0
