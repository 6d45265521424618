"""Leaks against a search of all windows, and planted cases."""

import random
import re
from collections import Counter

from skarn.llm.decontamination import CHANGES, decontaminate, leaks, op3_benchmark_decontamination

FOLDER = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def similarity(a, b, size):
    bag = lambda w: Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def plain_leaks(docs, items):
    """All pairs whose similarity reaches 0.8 in some window of the item's length."""
    found = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v:
                continue
            size, n = min(5, len(v)), len(v)
            common = {tuple(v[k : k + size]) for k in range(n - size + 1)}
            if not any(tuple(w[k : k + size]) in common for k in range(len(w) - size + 1)):
                continue
            if any(similarity(w[max(0, s) : s + n], v, size) >= 0.8 for s in range(-n, len(w))):
                found.add((d, i))
    return found


def test_query_finds_what_all_windows_show(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op3_benchmark_decontamination(spark, FOLDER).collect()}
    assert got == plain_leaks(docs, items) and got


def test_planted(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(4000)]
    say = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(i, say(rnd.randint(25, 70))) for i in range(30)] + [(90, "short item here"), (91, ""), (92, None), (93, "..."), (3, None)]
    docs = []
    for i, text in items[:30]:
        w = text.split()
        changed = [*w[:-1], "changed"]
        docs += [(10 * i, f"{say(40)} {text} {say(60)}"), (10 * i + 1, f"{say(30)}\n{' '.join(changed).upper()}, {say(9)}"), (10 * i + 2, say(120))]
        docs += [(10 * i + 3, " ".join(w[: len(w) // 2]) + " " + say(80))]
    docs += [(1000, "a Short, item HERE now"), (1001, "short item there"), (1002, None), (1003, ""), (None, items[4][1]), (0, docs[0][1]), (1004, items[5][1])]
    frame = spark.createDataFrame([(d, t, d, "x") for d, t in docs], "doc_id long, text string, item_id long, words string")
    bench = spark.createDataFrame([(i, t, i) for i, t in items], "item_id long, text string, doc_id long")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(frame, bench).collect()}
    assert got == plain_leaks(docs, items)
    assert {(10 * i, i) for i in range(30)} <= got and (1000, 90) in got and (1001, 90) not in got
    kept = decontaminate(frame, bench)
    assert kept.columns == frame.columns
    held = {d for d, _ in got}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in docs if d not in held)
    assert leaks(frame.limit(0), bench).count() == 0 and leaks(frame, bench.limit(0)).count() == 0


def test_index_covers_the_radius():
    assert len(CHANGES) == 697 and len(set(CHANGES)) == 697
