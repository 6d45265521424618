"""Lines that go, against a comparison of all lines with all earlier ones."""

import random

from skarn.llm.line_dedup import LEAST_WORDS, drop_repeats, end_keys, one_edit, op2_line_dedup, variant_keys

FOLDER = "/root/testdata/sf0.001"


def plain(docs):
    """Places that go, by key: every line against every earlier one."""
    seen, short, gone = [], set(), {}
    for key, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            words = line.encode().split()
            if len(words) < LEAST_WORDS:  # exact copies only
                if words and tuple(words) in short:
                    gone.setdefault(key, []).append(at)
                short.add(tuple(words))
                continue
            if any(abs(len(s) - len(words)) < 2 and one_edit(s, words) for s in seen):
                gone.setdefault(key, []).append(at)
            seen.append(words)
    return gone


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_one_edit():
    rnd = random.Random(2)
    for _ in range(3000):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randint(0, 6))] for _ in range(2))
        assert one_edit(a, b) == (distance(a, b) <= 1)


def test_keys_meet():
    rnd = random.Random(3)
    for _ in range(300):
        a = [rnd.choice([b"x", b"yy", b"zzz", b"w"]) for _ in range(rnd.randint(8, 12))]
        b = list(a)
        i = rnd.randrange(len(a))
        change = rnd.choice(("replace", "add", "drop"))
        b[i : i + (change != "add")] = [] if change == "drop" else [b"new"]
        assert set(end_keys(a)) & set(end_keys(b))
        x, y = variant_keys(a).tolist(), variant_keys(b).tolist()
        met = {(k, i) for i, k in enumerate(x) if i} & {(k, i) for i, k in enumerate(y) if i}
        assert met or x[0] in y[1:] or y[0] in x[1:]


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()]
    want = plain(docs)
    got = {r["doc_id"]: r for r in op2_line_dedup(spark, FOLDER).collect()}
    assert {d: list(r["dropped"]) for d, r in got.items() if r["dropped"]} == want and want
    for d, text in docs:
        gone = set(want.get(d, ()))
        assert got[d]["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def test_planted(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choices("abcdefgh", k=3))
    lines = [" ".join(word() for _ in range(rnd.randint(8, 20))) for _ in range(40)]
    docs = []
    for d in range(60):
        own = []
        for _ in range(4):
            w = rnd.choice(lines).split()
            for _ in range(rnd.randint(0, 2)):
                i = rnd.randrange(len(w))
                w[i : i + rnd.randint(0, 1)] = [word()] * rnd.randint(0, 1)
            own.append(" ".join(w))
        docs.append((d, "\n".join(own + ["too short", ""])))
    docs += [(100, None), (101, ""), (102, "\n\n"), (103, docs[3][1] + "\nend"), (104, "é " * 30_000)]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, line int, dropped string")
    got = drop_repeats(frame)
    assert sorted(got.columns) == sorted(frame.columns)
    assert {r["doc_id"]: list(r["dropped"]) for r in got.collect() if r["dropped"]} == plain(docs)
    twice = drop_repeats(frame.where("doc_id < 1").union(frame.where("doc_id < 1"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    assert drop_repeats(frame.limit(0)).count() == 0


def test_short_copies(spark):
    long = "one two three four five six seven eight"
    rows = [(1, "MIT License.\n\n中文没有空格\nMIT licence."), (2, f"  MIT  License. \n\n中文没有空格\nword\n{long}"), (3, f"MIT License.\nwords\n{long} nine\nword")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    gone = lambda **how: {r["doc_id"]: list(r["dropped"]) for r in drop_repeats(frame, **how).collect() if r["dropped"]}
    assert gone() == {2: [0, 2], 3: [0, 2, 3]}
    assert gone(short_copies=False) == {3: [2]}
