"""Text columns: normalisation, hashes, quality components, language and PII marks."""

from __future__ import annotations

from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

# Score weights, tier bounds, tokens per word.
WEIGHTS = {"alphabetic_ratio": 0.3, "word_length": 0.2, "unique_bigrams": 0.3, "unique_paragraphs": 0.2}
HIGH, MEDIUM = 0.8, 0.6
TOKENS_PER_WORD = 1.3

# Frequent short words that tell languages apart.
STOP_WORDS = {
    "en": "the of and to in is that it for was with as on are this be by not have from",
    "de": "der die und das nicht ein eine ist mit den von zu auf sich dem des im auch wie für",
    "es": "el los las que del una por con para su al lo como más pero sus es está también fue",
    "fr": "le les des et une est dans que pour qui sur pas plus avec au ce il sont ou nous",
}

#: Unicode white space plus the four separators that also count as such in text processing.
SPACE = r"(?U)[\s\x1c-\x1f]+"

#: The characters of SPACE that can end a paragraph, for trimming without a pattern.
SPACE_CHARS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)

# Marks of personal data, each cut to what decides that there is one.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "card": r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


@F.pandas_udf(T.StringType())
def _nfc_arrow(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFC")


@lru_cache(maxsize=1)
def _jvm_compose() -> bool:
    """Whether the ICU normaliser that comes with Spark can be called through ``reflect``."""
    spark = SparkSession.getActiveSession()
    try:
        probe = "reflect('com.ibm.icu.text.Normalizer', 'compose', 'é', false)"
        return spark.range(1).select(F.expr(probe)).first()[0] == "é"
    except Exception:  # class not on this cluster's path
        return False


def nfc(col: Column) -> Column:
    """Unicode NFC; ASCII text is passed through untouched."""
    if not _jvm_compose():
        return _nfc_arrow(col)
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col, F.lit(False)
    )
    return F.when(col.rlike(r"[^\x00-\x7F]"), composed).otherwise(col)


def normalise_text(col: Column) -> Column:
    """Lower case, NFC, whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(nfc(F.lower(col)), SPACE, " "))


def dedup_hash(col: Column) -> Column:
    return F.sha2(normalise_text(col), 256)


def flatten(col: Column) -> Column:
    """White-space runs to one space, trimmed; case and form kept."""
    return F.trim(F.regexp_replace(col, SPACE, " "))


def words(col: Column) -> Column:
    """Whitespace-separated words; none for blank text."""
    return words_of_flat(flatten(col))


def words_of_flat(flat: Column) -> Column:
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def alphabetic_ratio(col: Column) -> Column:
    letters = F.length(F.regexp_replace(col, r"[^\p{L}]+", ""))
    return letters / F.greatest(F.lit(1), F.length(col))


def word_length_score(flat: Column, n_words: Column) -> Column:
    """1.0 where the words of flat text average 4 to 8 characters."""
    characters = F.length(flat) - F.greatest(n_words - 1, F.lit(0))
    mean = characters / F.greatest(F.lit(1), n_words)
    return F.when(mean.between(4, 8), 1.0).otherwise(0.0)


def unique_bigram_ratio(tokens: Column) -> Column:
    """Distinct neighbouring word pairs over all pairs.

    Pairs are joined to one string: distinct strings are hashed, distinct structs are not.
    """
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    both = F.zip_with(
        F.slice(tokens, F.lit(1), pairs),
        F.slice(tokens, F.lit(2), pairs),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.size(F.array_distinct(both)) / F.greatest(F.lit(1), pairs)


def unique_paragraph_ratio(col: Column) -> Column:
    """Distinct paragraphs (parts between blank lines, stripped, not empty) over all."""
    parts = F.filter(
        F.transform(F.split(col, "\n\n"), lambda p: F.btrim(p, F.lit(SPACE_CHARS))),
        lambda p: p != "",
    )
    return F.size(F.array_distinct(parts)) / F.greatest(F.lit(1), F.size(parts))


def quality_components(col: Column) -> Column:
    """The four score parts as a struct of doubles."""
    text = F.coalesce(col, F.lit(""))
    return F.struct(
        alphabetic_ratio(text).alias("alphabetic_ratio"),
        word_length_score(flatten(text), F.size(words(text))).alias("word_length"),
        unique_bigram_ratio(words(text)).alias("unique_bigrams"),
        unique_paragraph_ratio(text).alias("unique_paragraphs"),
    )


def raw_quality_score(parts: Column) -> Column:
    """Weighted sum of the parts, added in their order, not rounded."""
    return reduce(lambda a, b: a + b, [parts[name] * F.lit(w) for name, w in WEIGHTS.items()])


def quality_tier(raw_score: Column) -> Column:
    return F.when(raw_score >= HIGH, "high").when(raw_score >= MEDIUM, "medium").otherwise("low")


def tokens_of(n_words: Column) -> Column:
    return F.floor(n_words * F.lit(TOKENS_PER_WORD)).cast("int")


def token_estimate(col: Column) -> Column:
    return tokens_of(F.size(words(F.coalesce(col, F.lit("")))))


def detect_language(col: Column) -> Column:
    """Language whose stop words occur most in the whole text; null where none occur."""
    text = F.lower(col)
    hits = [
        F.struct(
            F.regexp_count(text, F.lit(rf"(?U)\b(?:{'|'.join(ws.split())})\b")).alias("n"),
            F.lit(lang).alias("lang"),
        )
        for lang, ws in STOP_WORDS.items()
    ]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["lang"])


def pii_detected(col: Column) -> Column:
    return F.coalesce(col, F.lit("")).rlike("|".join(PII_PATTERNS.values()))
