"""Fingerprints, links and components against brute force."""

import itertools
import random
import re

import pytest
import xxhash

from skarn.llm import simhash
from skarn.llm.simhash import keep_one, links, near_duplicates, op7_simhash_near_dedup

FOLDER = "/root/testdata/sf0.01"


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Label -> smallest label over links of 3 bits."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_print(d["text"]) for d in docs]
    want = [(d["doc_id"], f"{p:016x}", docs[c]["doc_id"]) for d, p, c in zip(docs, prints, plain_components(prints))]
    got = op7_simhash_near_dedup(spark, FOLDER).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def _near(rnd, value, most):
    for b in rnd.sample(range(64), rnd.randint(0, most)):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("crowd", [64, 4])
def test_crowded_groups_keep_every_link(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rnd = random.Random(crowd)
    centre = rnd.getrandbits(64)
    values = {_near(rnd, centre, 9) for _ in range(150)} | {rnd.getrandbits(64) for _ in range(50)}
    values |= {_near(rnd, v, 3) for v in list(values)[:40]}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    prints = [v % (1 << 64) for v in signed]
    frame = spark.createDataFrame([(v,) for v in signed], "f long")
    from skarn.llm.components import components

    label = {r["v"]: r["label"] for r in components(links(frame)).collect()}
    want = plain_components(prints)
    groups = lambda names: sorted(sorted(g) for g in names.values())
    ours, theirs = {}, {}
    for i, v in enumerate(signed):
        ours.setdefault(label.get(v, v), []).append(i)
        theirs.setdefault(want[i], []).append(i)
    assert groups(ours) == groups(theirs)


def test_edges(spark):
    text = "one two three four five six seven"
    rows = [(5, text, 1), (2, text, 1), (2, text, 1), (9, None, 2), (8, "", 2), (7, "\t \n", 3), (None, "other words entirely here", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int").drop("component_id")
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 2), (2, 2), (2, 2), (9, 7), (8, 7), (7, 7), (None, None)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS f", "2 AS component_id", "3 AS fingerprint")
    kept = keep_one(clash)
    assert kept.columns == clash.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 7, None]


def test_stage_keeps_one_row_of_each_group(spark):
    from corpus_pipeline import near_duplicate_stage

    text, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(5, text, 1), (2, text, 2), (2, text, 3), (None, text, 4), (None, "other words entirely here", 5), (None, other, 6), (None, other, 7), (8, "", 8), (7, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f int")
    got = near_duplicate_stage(spark, docs, FOLDER)
    assert got.columns == docs.columns and got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert [r["f"] for r in got.orderBy("f").collect()] == [2, 5, 6, 9]
    assert near_duplicate_stage(spark, docs.limit(0), FOLDER).count() == 0
