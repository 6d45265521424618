"""Queries of text columns and the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.catalog.book import query
from skarn.catalog.telemetry import rounded
from skarn.functions import text as tx
from skarn.operators import corpus as op, telemetry as tel
from skarn.plans import corpus as plan
from skarn.session import settle

NORM = "trim(regexp_replace(nfc_normalize(lower(raw_text)), '\\s+', ' ', 'g'))"
GATED = """
SELECT *, language AS language_detected, language <> 'en' AS rejected,
       CASE WHEN language <> 'en' THEN 'language:' || language END AS reason FROM corpus
"""
PII = " OR ".join(f"regexp_matches(raw_text, '{p}')" for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
    r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
))
# Words and paragraphs first, ratios second, score third.
SCORED = f"""
SELECT *, CASE WHEN raw >= 0.8 THEN 'high' WHEN raw >= 0.6 THEN 'medium' ELSE 'low' END AS quality_tier,
       CAST(round(CAST(CAST(raw AS VARCHAR) AS DECIMAL(24, 20)), 4) AS DOUBLE) AS quality_score, CAST(floor(n * 1.3e0) AS INTEGER) AS token_count_estimate
FROM (SELECT *, a * 0.3e0 + w * 0.2e0 + b * 0.3e0 + p * 0.2e0 AS raw
 FROM (SELECT *, length(regexp_replace(raw_text, '[^\\p{{L}}]', '', 'g')) / greatest(1, length(raw_text))::DOUBLE AS a,
     CASE WHEN list_sum(list_transform(ws, lambda x: length(x))) / greatest(1, n)::DOUBLE BETWEEN 4 AND 8
          THEN 1e0 ELSE 0e0 END AS w,
     len(list_distinct(list_transform(range(1, n), lambda i: ws[i] || ' ' || ws[i + 1]))) / greatest(1, n - 1)::DOUBLE AS b,
     len(list_distinct(ps)) / greatest(1, len(ps))::DOUBLE AS p
  FROM (SELECT *, len(ws) AS n FROM (SELECT *,
     list_filter(string_split_regex(raw_text, '\\s+'), lambda x: x <> '') AS ws,
     list_filter(list_transform(string_split(raw_text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))),
                 lambda x: x <> '') AS ps,
     sha256({NORM}) AS dedup_hash, {PII} AS pii_detected,
     language AS language_detected FROM corpus))))
"""
CLEAN = f"""
SELECT document_id, source, dedup_hash, language_detected, quality_score, quality_tier,
       token_count_estimate, file_path, ingested_ms, pii_detected
FROM ({SCORED}) AS s WHERE language_detected = 'en'
QUALIFY row_number() OVER (PARTITION BY dedup_hash ORDER BY doc_id) = 1
"""
GATE_COLUMNS = ("document_id", "language_detected", "rejected", "reason")


def _clean(v):
    return plan.corpus_clean(v.corpus, F.col("language"))


@query("corpus_clean", CLEAN)
def _(v):
    return _clean(v)


@query("lang_gate", f"SELECT document_id, language_detected, rejected, reason FROM ({GATED}) AS g")
def _(v):
    return op.lang_gate(v.corpus, F.col("language")).select(*GATE_COLUMNS)


# Words of a list instead of a pattern.
SCORES = ", ".join(
    f"{{'n': len(list_filter(ws, lambda w: list_contains([{', '.join(repr(x) for x in words.split())}], w))), 'l': '{lang}'}}"
    for lang, words in tx.STOP_WORDS.items()
)
DETECTED = f"""
SELECT language, CASE WHEN best.n > 0 THEN best.l END AS language_detected
FROM (SELECT language, list_max([{SCORES}]) AS best
      FROM (SELECT language, string_split_regex(lower(raw_text), '[^\\p{{L}}\\p{{N}}_]+') AS ws FROM corpus))
"""


@query("lang_detect", f"SELECT language, language_detected, count(*) AS n FROM ({DETECTED}) GROUP BY 1, 2")
def _(v):
    found = op.lang_gate(v.corpus)
    return found.groupBy("language", "language_detected").agg(F.count("*").alias("n"))


@query("route_accepted", f"SELECT document_id, source FROM ({GATED}) AS g WHERE NOT rejected")
def _(v):
    return op.route(op.lang_gate(v.corpus, F.col("language")))[0].select("document_id", "source")


@query("route_rejected", f"SELECT document_id, source, reason FROM ({GATED}) AS g WHERE rejected")
def _(v):
    rejected = op.route(op.lang_gate(v.corpus, F.col("language")))[1]
    return rejected.select("document_id", "source", "reason")


@query(
    "corpus_metadata",
    f"""SELECT document_id, source, quality_score, quality_tier, dedup_hash, token_count_estimate, ingested_ms
        FROM ({SCORED}) AS s""",
)
def _(v):
    return op.corpus_metadata(op.score(op.with_hash(v.corpus)))


@query("pii_flag", f"SELECT document_id, {PII} AS pii_detected FROM corpus")
def _(v):
    return op.pii_flag(v.corpus).select("document_id", "pii_detected")


ADMITTED = f"""
SELECT * FROM ({CLEAN}) AS c WHERE quality_tier IN ('high', 'medium') AND quality_score >= 0.6
AND NOT pii_detected AND token_count_estimate BETWEEN 100 AND 32768
"""


@query("corpus_admit", ADMITTED)
def _(v):
    return op.corpus_admit(_clean(v))


SHARDED = f"""
SELECT document_id, source, dedup_hash, token_count_estimate, quality_score, quality_tier, file_path,
       CAST(place % 8 AS INTEGER) AS shard_id,
       row_number() OVER (PARTITION BY place % 8 ORDER BY place, document_id) - 1 AS shard_offset
FROM (SELECT *, CAST('0x' || substr(md5(document_id), 1, 15) AS BIGINT) AS place FROM ({ADMITTED}) AS a) AS p
"""


@query("training_dataset", SHARDED)
def _(v):
    # The clean table is written first, as it is in the lake: sharding reads it more than once.
    return plan.training_dataset(settle(_clean(v), "clean"), 8)


@query(
    "shard_assign",
    """SELECT document_id, CAST(place % 16 AS INTEGER) AS shard_id,
              row_number() OVER (PARTITION BY place % 16 ORDER BY place, document_id) - 1 AS shard_offset
       FROM (SELECT *, CAST('0x' || substr(md5(document_id), 1, 15) AS BIGINT) AS place FROM corpus) AS p""",
)
def _(v):
    return op.shard_assign(v.corpus.select("document_id"), 16)


@query("tokens_by_source", f"SELECT source, CAST(sum(token_count_estimate) AS BIGINT) AS tokens FROM ({CLEAN}) AS c GROUP BY 1")
def _(v):
    return tel.tokens_by_source(_clean(v))


@query(
    "quality_metrics",
    f"""WITH c AS ({CLEAN}), m AS (SELECT count(*)::DOUBLE AS documents, round(avg(quality_score), 6) AS mean_score,
            round(avg((quality_tier = 'high')::INT), 6) AS share_high,
            round(avg((quality_tier = 'medium')::INT), 6) AS share_medium,
            round(avg((quality_tier = 'low')::INT), 6) AS share_low FROM c)
        UNPIVOT m ON * INTO NAME metric VALUE value""",
)
def _(v):
    return rounded(tel.quality_metrics(_clean(v)))


@query(
    "dedup_first",
    f"""SELECT document_id, source, raw_text FROM (SELECT *, sha256({NORM}) AS h FROM corpus) AS c
        QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1""",
)
def _(v):
    return op.dedup_first(op.with_hash(v.corpus)).select("document_id", "source", "raw_text")


@query("normalise_text", f"SELECT document_id, {NORM} AS normal FROM corpus")
def _(v):
    return v.corpus.select("document_id", tx.normalise_text(F.col("raw_text")).alias("normal"))


@query("dedup_hash", f"SELECT document_id, sha256({NORM}) AS dedup_hash FROM corpus")
def _(v):
    return op.with_hash(v.corpus).select("document_id", "dedup_hash")


@query(
    "quality_components",
    f"""SELECT document_id, round(a, 9) AS alphabetic_ratio, w AS word_length, round(b, 9) AS unique_bigrams,
               round(p, 9) AS unique_paragraphs FROM ({SCORED}) AS s""",
)
def _(v):
    parts = v.corpus.withColumn("q", tx.quality_components(F.col("raw_text")))
    return rounded(parts.select("document_id", "q.*"), 9)


@query("quality_score", f"SELECT document_id, quality_score, quality_tier FROM ({SCORED}) AS s")
def _(v):
    return op.score(v.corpus).select("document_id", "quality_score", "quality_tier")


@query(
    "token_estimate",
    """SELECT conv_id, turn, CAST(floor(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 1.3e0)
              AS INTEGER) AS tokens FROM conversations""",
)
def _(v):
    return v.conversations.select("conv_id", "turn", tx.token_estimate(F.col("text")).alias("tokens"))
