"""Ranks against plain integer arithmetic and DuckDB; ties, blocks, exactness beyond 2 ** 53."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from oracle import compare
from skarn.llm import lexical
from skarn.llm.lexical import MOST_WEIGHT, ORACLE_SQL, exact_parts, op11_ranked_search, ranked_search, terms


def plain(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(key, Counter(cut(t))) for key, t in docs]
    bags = [(key, bag) for key, bag in bags if bag]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, t in items:
        scores = []
        for key, bag in bags:
            m = 75 + 25 * bag.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * bag[x] // (1000 * bag[x] + 12 * m)) for x in cut(t) if bag[x])
            if s > 0:
                scores.append((-s, key is None, key))
        out += [(item, rank, key, -s) for rank, (s, _, key) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_terms():
    assert [w.decode() for w in terms("Ab-c_D É1\x7fx ÀÉ\n\x85y")] == ["ab", "c", "d", "É1", "x", "ÀÉ", "\x85y"]
    assert terms(None) == [] and terms("--- ") == []


def test_exact_parts():
    rnd = np.random.default_rng(1)
    weights = rnd.integers(0, MOST_WEIGHT, (30, 4))
    weights[3, 1] = 5 * MOST_WEIGHT + 3
    parts = exact_parts(weights)
    assert (sum(p.astype(np.int64) for p in parts) == weights).all() and len(parts) > 5
    assert all(p.sum(axis=0).max() <= MOST_WEIGHT for p in parts)
    assert exact_parts(np.zeros((3, 2), np.int64)) == []


@pytest.mark.parametrize("small", [False, True])
def test_random(spark, monkeypatch, small):
    if small:  # many tiles, many blocks, several exact parts
        monkeypatch.setattr(lexical, "ITEM_TILE", 3)
        monkeypatch.setattr(lexical, "DOC_TILE", 5)
        monkeypatch.setattr(lexical, "BLOCK_CHARACTERS", 120)
        monkeypatch.setattr(lexical, "MOST_WEIGHT", 5000)
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choices(["Ab", "b", "c-d", "É", "日本", "x1", "rare" + str(rnd.randrange(40))], k=n))
    docs = [(i, text(rnd.randint(0, 30))) for i in range(120)]
    docs += [(i, "b b Ab copy") for i in range(200, 260)]  # more equal scores than ranks
    docs += [(None, "b b Ab copy"), (None, "É É É É"), (3, "b b Ab copy"), (3, "b b Ab copy"), (7, None), (8, ""), (9, "-- --")]
    rnd.shuffle(docs)
    items = [(i, text(rnd.randint(0, 8))) for i in range(9)] + [(5, "copy copy É"), (5, "copy copy É"), (None, "copy"), (6, None), (11, "nothing here")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("score", lexical.F.lit("extra")).withColumn("rank", lexical.F.lit(0))
    q = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in ranked_search(d, q, 20).collect()]
    assert sorted(got, key=str) == plain(docs, items, 20)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, items in ((d.limit(0), q), (d, q.limit(0)), (d.where("false"), q.where("false"))):
        found = ranked_search(docs, items)
        assert found.columns == ["item", "rank", "key", "score"] and found.count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(spark, folder, "op11", op11_ranked_search, ORACLE_SQL)[0] == "ok"
