"""Column functions against small Python models."""

import hashlib
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skarn.functions import fields as fd, geo, text as tx
from skarn.operators import corpus as cp, joins as jn, telemetry as tel

TEXTS = [
    "", " ", "one", "Two  words", "a\n\nb\n\na", "École É́cole x", "İstanbul ﬁne\tTAB",
    "para one.\n\npara one.\n\n  para two. ", "the of and to in 123 456", "é É   wide",
    "x" * 50 + " " + "y" * 3, "12345 !!! ???", "word " * 40, "\x1c sep \x1d more",
]


# Worked out by hand: letters over characters, word length mark, different pairs over pairs,
# different paragraphs over paragraphs, score, tier, tokens, normal form.
BY_HAND = [
    ("", (0, 0, 0, 0), 0.0, "low", 0, ""),
    ("one", (1, 0, 0, 1), 0.5, "low", 1, "one"),
    ("Two  words", (0.8, 1, 1, 1), 0.94, "high", 2, "two words"),
    ("a\n\nb\n\na", (3 / 7, 0, 1, 2 / 3), 0.5619, "low", 3, "a b a"),
    ("same same same same", (16 / 19, 1, 1 / 3, 1), 0.7526, "medium", 5, "same same same same"),
    ("12345 !!! ???", (0, 0, 1, 1), 0.5, "low", 3, "12345 !!! ???"),
    ("E\u0301cole", (5 / 6, 1, 0, 1), 0.65, "medium", 1, "\u00e9cole"),
    ("\tTabs\x1cand\u2003wide gaps \n", (15 / 21, 0, 1, 1), 0.7143, "medium", 5, "tabs and wide gaps"),
]


def test_texts_by_hand(spark):
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(BY_HAND)], "doc_id bigint, raw_text string")
    scored = cp.score(cp.with_hash(df)).withColumns(
        {"q": tx.quality_components(F.col("raw_text")), "n": tx.normalise_text(F.col("raw_text"))}
    )
    for r in scored.collect():
        _, parts, score, tier, tokens, form = BY_HAND[r["doc_id"]]
        assert tuple(r["q"]) == pytest.approx(parts)
        assert (r["quality_score"], r["quality_tier"], r["token_count_estimate"]) == (score, tier, tokens)
        assert r["n"] == form and r["dedup_hash"] == hashlib.sha256(form.encode()).hexdigest()


words = st.text(alphabet="abc\u00e9\u0301 \n\t.Z9", max_size=40)


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(words, min_size=1, max_size=30))
def test_text_properties(spark, texts):
    wider = [" \n" + t.replace(" ", " \t\n ") + "\u2003" for t in [*TEXTS, *texts]]
    df = spark.createDataFrame(list(zip([*TEXTS, *texts], wider)), "t string, wide string")
    once = tx.normalise_text(F.col("t"))
    rows = df.select(
        tx.quality_components(F.col("t")).alias("q"), once.alias("n"), tx.normalise_text(once).alias("nn"),
        tx.dedup_hash(F.col("t")).alias("h"), tx.dedup_hash(F.col("wide")).alias("hw"), tx.token_estimate(F.col("t")).alias("k"),
    ).collect()
    for r in rows:
        assert all(0 <= x <= 1 for x in r["q"]) and r["q"]["word_length"] in (0.0, 1.0)
        assert r["n"] == r["nn"] and r["h"] == r["hw"] and "  " not in r["n"] and r["n"] == r["n"].strip()
        assert r["k"] >= 0 and (r["k"] == 0) == (r["n"] == "")


def test_arrow_normal_form_agrees(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select(tx.nfc(F.col("t")).alias("jvm"), tx._nfc_arrow(F.col("t")).alias("arrow")).collect()
    assert all(r["jvm"] == r["arrow"] for r in rows)


def test_language_and_gate(spark):
    rows = [(1, "the cat is in the house and it was not happy"), (2, "der Hund und die Katze sind nicht im Haus"),
            (3, "el perro y los gatos están en la casa pero no su"), (4, "le chat est dans la maison avec les enfants"),
            (5, "zzz qqq")]
    df = spark.createDataFrame(rows, "doc_id int, raw_text string")
    got = {r["doc_id"]: (r["language_detected"], r["rejected"], r["reason"]) for r in cp.lang_gate(df).collect()}
    assert got == {
        1: ("en", False, None), 2: ("de", True, "language:de"), 3: ("es", True, "language:es"),
        4: ("fr", True, "language:fr"), 5: (None, True, "language_detection_failed"),
    }


def test_detector_agrees_with_labels(views):
    docs = cp.lang_gate(views.corpus.filter(F.length("raw_text") > 200))
    share = docs.agg(F.avg((F.col("language") == F.col("language_detected")).cast("int"))).first()[0]
    assert share > 0.9


@pytest.mark.parametrize("text,found", [
    ("mail me at a.b+c@example.org", True), ("call +1 (555) 123-4567 now", True), ("card 4111 1111 1111 1111", True),
    ("ssn 123-45-6789", True), ("nothing here 12 34", False), (None, False), ("a@b", False),
])
def test_pii(spark, text, found):
    df = spark.createDataFrame([(text,)], "raw_text string")
    assert cp.pii_flag(df).first()["pii_detected"] is found


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_ground_motion(spark):
    lit = F.lit
    pga = [value(spark, geo.gmpe_pga(lit(6.7), lit(17.0), lit(float(d)))) for d in (0, 5, 20, 100)]
    assert pga == sorted(pga, reverse=True)
    model = math.exp(-1.715 + 0.5 * 6.7 - 1.344 * math.log(math.hypot(5, 17)))
    assert pga[1] == pytest.approx(model)
    near = value(spark, geo.gmpe_pga(lit(5.0), lit(0.0), lit(0.0)))
    assert near == pytest.approx(math.exp(-1.715 + 2.5 - 1.344 * math.log(0.1)))


@pytest.mark.parametrize("kind,factor", [("very_high", 2.0), ("high", 1.5), ("moderate", 1.1), ("low", 1.0), ("none", 1.0), ("?", 1.0)])
def test_damage_probability(spark, kind, factor):
    p = lambda g: value(spark, geo.damage_probability(F.lit(g), F.lit(kind)))
    assert p(0.3) == pytest.approx(min(1.0, 0.5 * factor))
    assert p(5.0) == pytest.approx(1.0)
    assert 0 <= p(0.0) < 0.1


def test_inside_ring(spark):
    star = [(0.0, 0.0), (4.0, 0.0), (2.0, 1.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    ring = F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in star])
    for lng, lat, want in [(1, 1, True), (3.5, 1.0, False), (2.5, 3, True), (5, 5, False), (-1, 2, False), (1, 3.9, True)]:
        assert value(spark, geo.inside_ring(F.lit(float(lat)), F.lit(float(lng)), ring)) is want


def test_key_parts(spark):
    for key, want in [("a:b", ("a", "b")), ("a:b:c", ("a", "b:c")), ("plain", (None, "plain"))]:
        assert tuple(value(spark, fd.key_parts(F.lit(key)))) == want


@settings(max_examples=6, deadline=None)
@given(counts=st.lists(st.integers(0, 30), min_size=1, max_size=6), over=st.integers(0, 20), q=st.sampled_from([0.5, 0.9, 0.99]))
def test_histogram_quantile(spark, counts, over, q):
    bounds = [0.1 * (i + 1) for i in range(len(counts))]
    cum = [sum(counts[: i + 1]) for i in range(len(counts))]
    total = cum[-1] + over
    rows = [("m", b, c) for b, c in zip(bounds, cum)] + [("m", float("inf"), total)]
    df = spark.createDataFrame(rows, "k string, le double, cum bigint")
    got = tel.histogram_quantile(df, ["k"], q).first()["value_ms"]
    want = next((b for b, c in zip(bounds, cum) if c >= q * total), bounds[-1]) * 1000 if total else 0.0
    assert got == pytest.approx(want)


def test_nearest_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    far = [(-75.0, 10.0), (75.0, -170.0), (0.0, 179.99), (0.1, -179.99), (60.0, 5.0), (-33.0, 151.0), (34.0, -118.0)]
    spots = [(f"p{i}", lat, lng) for i, (lat, lng) in enumerate(far)]
    spots += [(f"q{i}", 34 + rnd.random(), -118 - rnd.random()) for i in range(60)]
    crews = [(f"c{i:02}", 34 + rnd.random() / 3, -118 - rnd.random() / 3) for i in range(25)]
    crews += [("c80", 0.0, -179.98), ("c81", 70.0, 10.0), ("c82", 34.2, -118.2), ("c83", 34.2, -118.2)]
    points = spark.createDataFrame(spots, "id string, lat double, lng double")
    targets = spark.createDataFrame(crews, "id string, lat double, lng double")

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for k in (1, 4, 40):
        got = {}
        for r in jn.nearest(points, targets, k).collect():
            got.setdefault(r["id"], []).append(r["target_id"])
        for spot in spots:
            want = [c[0] for c in sorted(crews, key=lambda c: (round(km(spot, c), 9), c[0]))[:k]]
            assert sorted(got[spot[0]]) == sorted(want), (k, spot)


def test_nearest_everywhere(spark):
    import random

    rnd = random.Random(8)

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))

    frame = lambda rows: spark.createDataFrame(rows, "id string, lat double, lng double")
    polar = [(f"n{i}", rnd.choice([80.0, 89.9, -89.99, 90.0, -90.0]) + 0.0, rnd.uniform(-180, 180)) for i in range(40)]
    line = [(f"d{i}", rnd.uniform(-60, 60), rnd.choice([180.0, -180.0, 179.999, -179.999])) for i in range(40)]
    # A city: hundreds of targets within some hundred metres, a few at the very same place.
    city = [(f"t{i:03}", 48.85 + rnd.randrange(60) / 20000, 2.35 + rnd.randrange(60) / 20000) for i in range(600)] + [(f"s{i}", 48.85, 2.35) for i in range(30)]
    around = [(f"a{i}", 48.85 + rnd.uniform(-1, 1) ** 5, 2.35 + rnd.uniform(-1, 1) ** 5) for i in range(60)]
    for points, targets in ((polar, [("x" + r[0], -r[1], r[2] / 2) for r in polar]), (line, [("x" + r[0], r[1] + 0.1, -r[2]) for r in line]), (around, city)):
        for k in (1, 5, 70):
            got = {}
            for r in jn.nearest(frame([*points, ("none", None, 1.0)]), frame([*targets, ("nowhere", 1.0, None)]), k).collect():
                got.setdefault(r["id"], []).append(r["target_id"])
            assert set(got) == {p[0] for p in points}
            for p in points:
                want = [t[0] for t in sorted(targets, key=lambda t: (round(km(p, t), 9), t[0]))[:k]]
                assert sorted(got[p[0]]) == sorted(want), (k, p)
    assert jn.nearest(frame(line), frame(city).limit(0)).count() == jn.nearest(frame(line).limit(0), frame(city)).count() == 0
