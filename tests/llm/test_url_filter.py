"""Rules by hand, cuts against all cuts, verdicts against a plain naive Bayes."""

import itertools
import math
import random
import re
from collections import Counter

from skarn.llm.url_filter import RULES, UNKNOWN, cut, judge, op6_url_filters

FOLDER = "/root/testdata/sf0.01"


def split_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def rule_for(host, path):
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1]), default=None)


def plain(rows, words):
    """Verdicts by dictionaries."""
    total = sum(words.values()) + 1
    named = {w for h, p, _ in RULES for w in re.findall("[a-z]+", h + p)}
    letters = lambda t: [w for w in re.split(r"[\W\d_]+", t) if w]

    def tokens(host, path):
        own = ["host " + w for name in letters(host) for w in cut(name, words, total) if w not in named]
        route = [w for w in re.split(r"[^a-z0]+", re.sub("[0-9]+", " 0 ", path.lower())) if w]
        return own + ["path " + w for w in route if w not in named]

    counts = {"block": Counter(), "allow": Counter()}
    for _, url in rows:
        rule = rule_for(*split_url(url))
        if rule:
            counts[rule[2]].update(tokens(*split_url(url)))
    size = len(counts["block"] | counts["allow"])
    b, a = counts["block"].total(), counts["allow"].total()
    out = []
    for page, url in rows:
        host, path = split_url(url)
        rule = rule_for(host, path)
        score = 0.0
        if a and b:
            score = sum(math.log((counts["block"][t] + 1) / (b + size)) - math.log((counts["allow"][t] + 1) / (a + size)) for t in tokens(host, path))
        verdict = rule[2] if rule else "block" if round(score, 9) > 0 else "allow"
        out.append((page, host, path, rule and rule[0] + rule[1], verdict))
    return out


def test_query(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    words = Counter()
    for p in pages:
        words.update(w for w in re.split(r"[\W\d_]+", re.search("<title>([^<]*)", p["html"])[1].lower()) if w)
    want = plain([(p["page_id"], p["url"]) for p in pages], words)
    got = [tuple(r)[:5] for r in op6_url_filters(spark, FOLDER).collect()]
    assert sorted(got) == sorted(want)
    assert {v for *_, r, v in got if r is None} == {"allow", "block"}


def test_cut():
    rnd = random.Random(6)
    known = {w: rnd.randint(1, 50) for w in ("a", "an", "ana", "na", "the", "them", "hem", "me", "e", "m")}
    total = sum(known.values()) + 1
    log = lambda w: math.log(known[w] / total) if w in known else math.log(1 / total) - len(w) * math.log(UNKNOWN)
    for _ in range(200):
        name = "".join(rnd.choice("anthem") for _ in range(rnd.randint(1, 9)))
        best = max(
            sum(log(name[a:b]) for a, b in itertools.pairwise([0, *bounds, len(name)]))
            for n in range(len(name)) for bounds in itertools.combinations(range(1, len(name)), n)
        )
        words = cut(name, known, total)
        assert "".join(words) == name and math.isclose(sum(map(log, words)), best)
    assert cut("", known, total) == []


def test_edges(spark):
    urls = [
        None, "", "no address", "https://A.Example.NET/en/1", "https://a.example.net/de/1", "http://net/", "http://net", "http://x.net?a=/", "ftp://example.com/de/x",
        "http://notexample.com/de/", "http://w.org/fr/", "http://w.org/fr", "http://EXAMPLE.com/de/#x", "x://y://z.net/", "http://a.net:80/", "://q.net/ä/ö 12", "http://" + "ab" * 3000 + ".com/",
    ]
    rows = list(enumerate(urls)) + [(3, urls[3]), (None, urls[4])]
    frame = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id long, url string, host string, word int")
    words = spark.createDataFrame([("example", 5), ("a", 2), ("", 4), (None, 3)], "word string, n long")
    got = judge(frame, words)
    plain_rows = plain([r for r in rows if r[0] != 15], {"example": 5, "a": 2})
    assert sorted((tuple(r)[:4] for r in got.collect() if r[0] != 15), key=str) == sorted((r[:4] for r in plain_rows), key=str)
    assert judge(frame.limit(0), words.limit(0)).count() == 0
