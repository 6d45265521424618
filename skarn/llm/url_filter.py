"""URL filters: rules first, then naive Bayes over the words of segmented host names and paths.

Host names write words together. A name is cut by unigram Viterbi: the cut whose words have the
highest product of probabilities under the counts of a word list (``words``: word, n); a run that is
no known word counts as unknown, less probable with each letter. Only the substrings of a name that
are known words reach the function that cuts it, through a join, so the word list may have any size.

Rules label the URLs they fit. Of those labelled URLs, all of them, a multinomial naive Bayes learns
how much each word of a host and each word of a path speaks for blocking, with add-one smoothing
and even priors (the number of URLs that rules fit says nothing about the others). Words that the
rules themselves name are left out, as they would only say that a rule exists. It judges the URLs
that no rule fits: block if the sum of weights is above zero.

Counting and scoring run over distinct hosts and distinct paths (digits read as one sign), each with
its number of URLs, so a host with a third of all pages is one row there. Pages meet their scores in
joins that Spark splits at hot keys. To the driver goes one row of totals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from skarn.llm.common import table, written

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with its own.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Letters of the longest word that is looked up, and the factor of an unknown word's probability per letter.
LONGEST, UNKNOWN = 24, 10.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; else empty."""
    host = F.regexp_extract(url.cast("string"), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url.cast("string"), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found, verdict = F.when(fits, f"{h}{p}").otherwise(found), F.when(fits, v).otherwise(verdict)
    return found, verdict


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != "")


def path_words(path: Column) -> Column:
    """Words of a path in lower case; a run of digits reads ``0``."""
    plain = F.regexp_replace(F.lower(path), r"[0-9]+", " 0 ")
    return F.filter(F.split(plain, r"[^\p{L}0]+"), lambda w: w != "")


def cut(name: str, known: dict[str, int], total: int) -> list[str]:
    """The most probable words of a name; of equals, the one whose last word is longest."""
    n = len(name)
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, n + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            word = name[start:end]
            count = known.get(word)
            log = math.log(count / total) if count else math.log(1 / total) - len(word) * math.log(UNKNOWN)
            options.append((best[start][0] + log, -start, start))
        log, _, start = max(options)
        best.append((log, start))
    out, end = [], n
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return out[::-1]


def segment(names: DataFrame, words: DataFrame) -> DataFrame:
    """``name, words`` for distinct ``name``s, cut under the counts ``word, n``."""
    words = words.where("n > 0 AND length(word) > 0").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words, "words")
    total = (words.agg(F.sum("n")).first()[0] or 0) + 1
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("at") + 1))).alias("size")
    pieces = starts.select("name", "at", sizes).select("name", F.expr("substr(name, at, size)").alias("word")).distinct()
    known = pieces.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf(ArrayType(StringType()))
    def viterbi(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for name, found in batches:
            out = [cut(x, {} if k is None else {w["word"]: w["n"] for w in k}, total) for x, k in zip(name, found)]
            yield pd.Series(out, dtype=object)

    return names.join(known, "name", "left").select("name", viterbi("name", "known").alias("words"))


def judge(pages: DataFrame, words: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row.

    ``score`` is the sum of weights (above zero: block), also where a rule decides. A null URL and one
    without ``://`` have no host, no path, no rule and the score 0. Without labelled URLs of one
    kind every score is 0. Repeated rows are judged alike. Other columns are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("route", F.array_join(path_words(F.col("path")), " "))
    counts = rows.groupBy("host", "route", verdict.alias("label")).agg(F.count("*").alias("n"))
    counts = written(counts, "addresses")

    hosts = counts.select("host").distinct()
    split = hosts.select("host", F.posexplode(_letters(F.col("host"))).alias("at", "name"))
    cuts = segment(split.select("name").distinct(), words)
    named = sorted({w for h, p, _ in rules for w in f"{h} {p}".replace(".", " ").replace("/", " ").split()})
    said = F.array(*map(F.lit, named)) if named else F.array().cast("array<string>")
    own = split.join(cuts, "name").select("host", F.explode(F.filter("words", lambda w: ~F.array_contains(said, w))).alias("word"))
    host_words = written(own.select("host", F.concat(F.lit("host "), "word").alias("word")), "host-words")
    routes = counts.select("route").distinct()
    of_route = F.explode(F.filter(F.split("route", " "), lambda w: (w != "") & ~F.array_contains(said, w)))
    route_words = routes.select("route", of_route.alias("word")).select("route", F.concat(F.lit("path "), "word").alias("word"))

    labelled = counts.where("label IS NOT NULL")
    seen = [labelled.groupBy(k, "label").agg(F.sum("n").alias("n")).join(w, k).select("word", "label", "n") for k, w in (("host", host_words), ("route", route_words))]
    sums = [F.sum(F.when(F.col("label") == v, F.col("n")).otherwise(0)).alias(v) for v in ("block", "allow")]
    model = written(seen[0].union(seen[1]).groupBy("word").agg(*sums), "model")
    blocks, allows, size = model.agg(F.sum("block"), F.sum("allow"), F.count("*")).first()
    blocks, allows = blocks or 0, allows or 0
    even = math.log((allows + size) / (blocks + size)) if blocks and allows else 0.0
    weight = F.log((F.col("block") + 1) / (F.col("allow") + 1)) + even if blocks and allows else F.lit(0.0)
    model = model.select("word", weight.alias("weight"))

    def scores(of: DataFrame, key: str) -> DataFrame:
        known = of.join(model, "word", "left").select(key, F.coalesce("weight", F.lit(even)).alias("weight"))
        # Written: below the join each side is then just shuffled and sorted, so Spark can split a hot host.
        return written(known.groupBy(key).agg(F.sum("weight").alias(f"{key}_score")), f"{key}-scores")

    scored = rows.join(scores(host_words, "host"), "host", "left").join(scores(route_words, "route"), "route", "left")
    score = F.round(F.coalesce("host_score", F.lit(0.0)) + F.coalesce("route_score", F.lit(0.0)), 9)
    judged = scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("label"), score.alias("score"))
    learned = F.when(F.col("score") > 0, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("label", learned).alias("verdict"), "score")


def title_words(pages: DataFrame) -> DataFrame:
    """``word, n`` over the titles of all pages, in lower case."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)", 1)
    return pages.select(F.explode(_letters(F.lower(title))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def op6_url_filters(spark, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return judge(pages, title_words(pages))
