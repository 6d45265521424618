"""Spans against Python's own search; links between parts on planted texts."""

import hashlib
import re

from skarn.llm.secrets import SCOPE, op4_secret_scans, scan

FOLDER = "/root/testdata/sf0.01"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(spans)


def joined(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = op4_secret_scans(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        want = base_spans(docs[r["doc_id"]])
        kinds = [k for _, k, _ in want]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds.count(k) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got) > 10


TOKEN = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
FAR = " word" * SCOPE


def test_base_edges(spark):
    texts = [
        "password=token: abcdefgh", "secret: pass token=abc_123 apikey = 'zzzzzz'", "é\U0001f600 PASSWORD=\"abcdef", "x" * 5 + "AKIA" + "A" * 15,
        "AKIAAKIA" + "B" * 12 + " " + "0123456789abcdef" * 2, "api_key=abcdef0123456789abcdef01", None, "", "token=" + "a" * 100_000,
    ]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    got = {r["doc_id"]: r for r in scan(docs).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]["spans"] if s["kind"] < 3] == base_spans(t), t
    assert scan(docs.limit(0)).count() == 0


def test_links(spark):
    cases = {
        1: (f"see {TOKEN} alone", []),
        2: (f"user: admin99 and {TOKEN}", ["login", "token"]),
        3: (f"user: admin99{FAR} {TOKEN}", []),
        4: (f"https://db.example.org/x then {TOKEN}", ["endpoint", "token"]),
        5: ("https://db.example.org/x is a page, user: bob", ["endpoint"]),
        6: (f"AKIA{'Z' * 16} {TOKEN}", ["access", "token"]),
        7: (f"password={TOKEN}", ["assign"]),
        8: (f"password=abcdefgh at https://db.example.org/x{FAR} https://other.example.org/y", ["assign", "endpoint"]),
    }
    rows = [(i, t) for i, (t, _) in cases.items()] + [(1, cases[1][0]), (None, cases[2][0])]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = cases[2 if r["doc_id"] is None else r["doc_id"]][1]
        assert [s["name"] for s in r["spans"]] == want, r
