"""Runs against a search of all periods, planted runs in every given document, edges."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from skarn.llm import periodic
from skarn.llm.periodic import collapse_runs, find_runs, op12_periodic_runs

FOLDER = "/root/testdata/sf0.01"


def plain_runs(w):
    """Every maximal stretch of every period, less those that have a smaller one."""
    n, found = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(w[i : j + q - r] == w[i + r : j + q] for r in range(1, q)):
                found.add((i, j + q - i, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def encoded(words):
    return [str(x).encode() for x in words]


def test_random_words_of_few_kinds():
    rnd = random.Random(1)
    texts = [[rnd.randrange(rnd.choice([1, 2, 3, 9])) for _ in range(rnd.randint(0, 120))] for _ in range(400)]
    assert find_runs([encoded(t) for t in texts]) == [plain_runs(t) for t in texts]


def test_planted_periods():
    rnd = random.Random(2)
    texts = []
    for q in [*range(1, 70), 127, 128, 129, 200, 256, 257]:
        kinds = rnd.choice([2, 3, 50])
        block = [rnd.randrange(kinds) for _ in range(q)]
        times = rnd.choice([3.9, 4, 4.3, 7])
        run = (block * 8)[: int(times * q) + 1]
        texts.append([rnd.randrange(50, 90) for _ in range(rnd.randint(0, 40))] + run + [rnd.randrange(40, 60) for _ in range(rnd.randint(0, 40))])
    # periods inside periods
    inner = [1, 2] * 6
    texts += [(inner + [7] + [3] * 9) * 5, ([0] * 40 + [1]) * 6, (([1] * 7 + [2]) * 5 + [3]) * 5, [0, 1, 0, 0, 1, 0, 1, 0] * 12]
    want = [plain_runs(t) for t in texts]
    assert find_runs([encoded(t) for t in texts]) == want
    assert [find_runs([encoded(t)])[0] for t in texts] == want
    assert sum(bool(r) for r in want) > 40


def test_long_text():
    rnd = random.Random(3)
    block = [rnd.randrange(1000) for _ in range(70_001)]
    text = encoded([2000, *block * 5, 2001] + [5] * 100_000)
    assert find_runs([text])[0] == [(1, 350_005, 70_001), (350_007, 100_000, 1)]


def test_equal_hashes_of_different_words(monkeypatch):
    rnd = random.Random(4)
    texts = [[rnd.randrange(3) for _ in range(300)] + [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11] * 6 for _ in range(5)]
    monkeypatch.setattr(periodic, "_mixed", lambda x: x & periodic.np.uint64(7))
    for t in texts:
        assert set(find_runs([encoded(t)])[0]) <= set(plain_runs(t))


def test_edges(spark):
    rows = [(1, "a b a b a b  a\nb x", "k"), (1, "a b a b a b  a\nb x", "k"), (None, None, "n"), (2, "", ""), (3, "one two", ""), (4, " z" * 9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("c0", periodic.F.col("runs"))
    got = collapse_runs(docs)
    assert got.columns == ["doc_id", "text", "c0", "runs", "strongest"]
    rows = [(r.doc_id, r.text, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest)) for r in got.collect()]
    ab = (1, "a b x", [(0, 8, 2)], (0, 8, 2))
    assert rows == [ab, ab, (None, None, [], None), (2, "", [], None), (3, "one two", [], None), (4, "z", [(0, 9, 1)], (0, 9, 1))]
    assert collapse_runs(docs.limit(0)).count() == 0


def test_query(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, with_runs = set(), 0
    for d in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")
        n, h = len(w), zlib.crc32(str(d["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        if n > 3000:  # too long for the plain search of all periods
            runs = find_runs([[x.encode() for x in w]])[0]
            for s, length, q in runs:
                assert w[s : s + length - q] == w[s + q : s + length] and length >= max(6, 4 * q)
        else:
            runs = plain_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        digest = sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
        want.add((d["doc_id"], len(runs), *four, digest, sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
        with_runs += bool(runs)
    got = op12_periodic_runs(spark, FOLDER)
    assert [f.dataType.simpleString() for f in got.schema[:6]] == ["bigint"] * 6
    assert {tuple(r) for r in got.collect()} == want
    assert with_runs > 50
