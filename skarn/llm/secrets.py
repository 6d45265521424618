"""Secret scans with multipart credential linking.

Some credentials come in parts: who (an access identifier), with what (a secret), where (an
endpoint). Strong parts are findings by themselves: ``assign``, ``access``, ``hex`` (the base).
Weak parts - a user name, a long bare token, an address - are common in clean text, so one is
reported only if a part that completes it lies in its scope, ``SCOPE`` code points to either side:

    login      needs a secret (assign, hex, token)
    token      needs an identifier (access, login) or an endpoint; it mixes upper, lower and digits
    endpoint   needs an identifier or a secret

Weak parts that overlap a base span are that span's own text and are left out.

Parts of a text are found in one pass of SQL functions: a split and an extraction by the same
pattern give the gaps and the matches, whose lengths (code points) give the places. Only numbers
leave that pass, no text and no secret. The interval join cuts each text into cells of ``SCOPE``
code points: a weak part asks the cells its scope covers, other parts stand in the cells they
cover, and a left semi join on document and cell tests the intervals. No pairs are returned, and a
cell holds few parts whatever the text's length. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skarn.llm.common import table, written

#: Code points to either side of a weak part in which a complementary part must lie.
SCOPE = 200

#: The base kinds in the order of their names' rank, with their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Matches of these two are whole runs, so the least length may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak kinds.
LOGIN = r"""(?i)\b(user|username|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}"
#: A scheme is a whole run of its characters, taken once: no text is read twice.
ENDPOINT = r"""(?<![A-Za-z0-9_+.-])[a-z][a-z0-9+.-]*+://[^\x20\x09-\x0D"'<>]+"""

KINDS = ("assign", "access", "hex", "login", "token", "endpoint")
#: Kinds that complete a weak part.
COMPLETES = {
    "login": ("assign", "hex", "token"),
    "token": ("access", "login", "endpoint"),
    "endpoint": ("assign", "access", "hex", "login", "token"),
}


def _part(kind: str, pattern: str, test: str, good) -> Column:
    """Gaps, lengths and verdicts of one kind's matches; nothing for texts that fail ``test``."""
    text = F.col("text")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gaps"),
        F.transform(matches, lambda m: F.length(m)).alias("sizes"),
        good(matches).alias("good"),
    )
    return F.when(text.rlike(test), found)


def _longer(n: int):
    return lambda matches: F.transform(matches, lambda m: F.length(m) >= n)


def _second_longer(pattern: str, n: int):
    second = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(2))
    return lambda _: F.transform(second, lambda g: F.length(g) >= n)


def _mixed(matches: Column) -> Column:
    return F.transform(matches, lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]"))


def parts(docs: DataFrame) -> DataFrame:
    """``row, doc_id, kind, start, end`` of all parts, and a row without kind for every document."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = F.array_compact(
        F.array(
            _part("assign", ASSIGN, ASSIGN, _second_longer(ASSIGN, 6)),
            _part("access", ACCESS, r"AKIA[A-Z0-9]{16}", _longer(20)),
            _part("hex", HEX, r"[0-9a-f]{24}", _longer(24)),
            _part("login", LOGIN, LOGIN, _second_longer(LOGIN, 3)),
            _part("token", TOKEN, r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32}", _mixed),
            _part("endpoint", ENDPOINT, "://", _longer(8)),
        )
    )
    # Written: a document keeps one number from here on, though its doc_id may be null or repeated.
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", found.alias("found")), "parts")
    kinds = rows.select("row", "doc_id", F.explode_outer("found").alias("f"))
    each = F.arrays_zip(F.col("f.gaps").alias("gap"), F.col("f.sizes").alias("size"), F.col("f.good").alias("good"))
    each = kinds.select("row", "doc_id", F.col("f.kind").alias("kind"), F.posexplode_outer(each).alias("at", "m"))
    before = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.coalesce("m.size", F.lit(0))).over(before)
    placed = each.withColumn("end", end).select("row", "doc_id", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end", F.col("m.good").alias("good"))
    return placed.select("row", "doc_id", *[F.when(F.col("good"), F.col(c)).alias(c) for c in ("kind", "start", "end")]).distinct()


def _cells(start: Column, end: Column, margin: int) -> Column:
    least = F.greatest(F.floor((start - margin) / SCOPE), F.lit(0))
    return F.explode(F.sequence(least, F.floor((end - 1 + margin) / SCOPE)))


def linked(found: DataFrame) -> DataFrame:
    """Base parts, and the weak parts that a part in their scope completes."""
    found = written(found.where("kind IS NOT NULL"), "found")
    base, weak = found.where("kind < 3"), found.where("kind >= 3")
    stands = base.select("row", "start", "end", _cells(F.col("start"), F.col("end"), 0).alias("cell"))
    own = weak.select("*", _cells(F.col("start"), F.col("end"), 0).alias("cell")).alias("w").join(
        stands.alias("o"), F.expr("w.row = o.row AND w.cell = o.cell AND w.start < o.end AND o.start < w.end"), "left_semi"
    )
    weak = weak.join(own.select("row", "kind", "start").distinct(), ["row", "kind", "start"], "left_anti")
    weak = written(weak, "weak")

    allowed = [(KINDS.index(w), KINDS.index(o)) for w, others in COMPLETES.items() for o in others]
    fits = " OR ".join(f"(w.kind = {w} AND o.kind = {o})" for w, o in allowed)
    others = base.unionByName(weak).select("row", "kind", "start", "end", _cells(F.col("start"), F.col("end"), 0).alias("cell"))
    asks = weak.select("*", _cells(F.col("start"), F.col("end"), SCOPE).alias("cell"))
    near = f"w.row = o.row AND w.cell = o.cell AND w.start - {SCOPE} < o.end AND o.start < w.end + {SCOPE} AND ({fits})"
    kept = asks.alias("w").join(others.alias("o"), F.expr(near), "left_semi").drop("cell").distinct()
    return base.unionByName(kept)


def _is(kind: int):
    return lambda s: s["kind"] == kind


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: ``row, doc_id, n_assign, n_access, n_hex, spans`` (structs by start, then kind).

    Null texts are empty. Repeated rows and repeated or null ``doc_id`` values are documents of their
    own. Other columns are not read.
    """
    found = written(parts(docs), "spans")
    named = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1).alias("name")
    spans = linked(found).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", named))).alias("spans"))
    rows = found.select("row", "doc_id").distinct().join(spans, "row", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,name:string>>"))
    rows = rows.select("row", "doc_id", spans.alias("spans"))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return rows.select("row", "doc_id", *counts, "spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def op4_secret_scans(spark, folder: str) -> DataFrame:
    base = F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < 3)), 256)
    found = scan(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
