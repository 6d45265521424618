"""Quality rules: counts of words, symbols, lines and repeats, and bands of zstandard ratios.

A text compresses by a factor that depends on its length. Prose of a given length stays in a band:
repeated text lies above it, random letters and digits below. The whole document is held against
the band of its length, and so is each fixed chunk of it, so a page of junk inside a long document
counts too. The limits are parameters. ``BANDS`` is what ``bands_of`` gives for the documents of sf0.1
that are labelled good and pass the base rules (3,302 documents in four languages): per length, the
lowest and highest ratio of their beginnings and chunks of that length, with a margin of 1 % and
1 / sqrt(number of documents as long). Short random text lies inside the band of good documents
(hex below 3 KB, lower-case letters below 1.5 KB) and cannot be told by its ratio.

All work is per document, in one pass of an Arrow function; there is no shuffle. A null text has no
words. Documents of any length are measured whole; memory is that of a document's words.
"""

from __future__ import annotations

from bisect import bisect_right
from math import log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skarn.llm.common import by_slices, small_batches, table

#: Bytes of a text, its least and its most bytes per compressed byte.
BANDS = (
    (1, 0.0, 1.264), (64, 0.853, 1.264), (96, 0.889, 1.429), (128, 1.004, 1.547), (192, 1.139, 1.644), (256, 1.209, 1.697),
    (384, 1.283, 1.853), (512, 1.356, 1.853), (768, 1.503, 1.966), (1024, 1.609, 2.053), (1536, 1.74, 2.158), (2048, 1.819, 2.22),
    (3072, 1.914, 2.313), (4096, 1.966, 2.373), (6144, 2.002, 2.479), (8192, 2.012, 2.539), (12288, 2.012, 2.794), (16384, 2.012, 3.012),
)
#: Lengths at which bands are measured.
SIZES = (64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144, 8192, 12288, 16384)
#: Bytes of a chunk, and the share of a document's bytes that may lie in chunks outside their band.
CHUNK, BAD_SHARE = 2_048, 0.3
#: Fixed values of the base rules.
SYMBOLS, LEAST_WORDS, WINDOW, MOST_REPEATED = "#*$%&|<>", 20, 8, 30
LEVEL = 3

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "ratio double, bad_chunk_share double"
)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows found twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    if len(number) == len(words):
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n] + np.uint64(1)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    left, right = order[:-1][same], order[1:][same]
    if not len(left):
        return 0
    alike = np.ones(len(left), bool)
    for k in range(window):
        alike &= ids[left + k] == ids[right + k]
    if alike.all():
        found = np.union1d(left, right)
    else:  # two windows of one hash differ: compare the windows themselves
        seen: dict[tuple, list[int]] = {}
        for i in range(n):
            seen.setdefault(tuple(ids[i : i + window].tolist()), []).append(i)
        found = np.array([i for at in seen.values() if len(at) > 1 for i in at], np.int64)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found, 1)
    np.add.at(change, found + window, -1)
    return int(np.count_nonzero(np.cumsum(change)))


def in_band(size: int, ratio: float, bands=BANDS) -> bool:
    """Limits between two lengths are in proportion to the logarithm; the last ones hold from there on."""
    k = bisect_right(bands, size, key=lambda band: band[0])
    if not k or k == len(bands):
        _, least, most = bands[max(0, k - 1)]
    else:
        (a, *low), (b, *high) = bands[k - 1], bands[k]
        part = log2(size / a) / log2(b / a)
        least, most = (x + part * (y - x) for x, y in zip(low, high))
    return least <= ratio <= most


def bands_of(texts: list[bytes], sizes=SIZES, chunk: int = CHUNK) -> tuple[tuple[int, float, float], ...]:
    """Bands for texts like these; a longer text of one kind is taken to compress no worse."""
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL)
    out, least, most = [], 0.0, 0.0
    for size in sizes:
        long = [t for t in texts if len(t) >= size]
        if not long:
            break
        ratios = [size / len(press.compress(t[at : at + size])) for t in long for at in (range(0, len(t) - size + 1, chunk) if size <= chunk else (0,))]
        margin = 0.01 + 1 / sqrt(len(long))
        least, most = max(least, min(ratios) * (1 - margin)), max(most, max(ratios) * (1 + margin))
        out.append((size, round(least, 3), round(most, 3)))
    return ((1, 0.0, out[0][2]), *out)


def _rows(texts: pa.Array, bands, chunk: int, bad_share: float) -> pa.Array:
    import zstandard

    press = zstandard.ZstdCompressor(level=LEVEL)
    size = lambda b: len(press.compress(b))
    out = []
    for text in texts.to_pylist():
        text = text or ""
        data = text.encode()
        words = data.split()  # bytes: blank and the controls 9 to 13
        n = len(words)
        lines = [x for x in data.split(b"\n") if x.strip()]
        repeated = repeated_words(words)
        failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
        ratio = len(data) / size(data) if data else None
        bad = 0
        for at in range(0, len(data), chunk):
            part = data[at : at + chunk]
            bad += 0 if in_band(len(part), len(part) / size(part), bands) else len(part)
        share = bad / len(data) if data else 0.0
        kept = not failed and in_band(len(data), ratio, bands) and share <= bad_share
        out.append(
            (n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, failed, kept, ratio, share)
        )
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]] for c in SCHEMA.split(", ")]
    return pa.StructArray.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out) if out else [()] * len(names), kinds)], names)


def quality(text: Column, bands=BANDS, chunk: int = CHUNK, bad_share: float = BAD_SHARE) -> Column:
    """A struct of the counts, the verdict and the ratios behind it."""

    @F.arrow_udf(SCHEMA)
    def measure(texts: pa.Array) -> pa.Array:
        return by_slices(lambda part: _rows(part, bands, chunk, bad_share), texts)

    return measure(text.cast("string"))


def quality_rules(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The documents that pass, with their own columns; repeated rows each pass or fail alone."""
    small_batches(docs.sparkSession)
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column of the documents can clash
    rows = docs.toDF(*names)
    judged = rows.withColumn("quality", quality(F.col(names[docs.columns.index(text)]), **limits)).where("quality.kept")
    return judged.select(*names).toDF(*docs.columns)


def op8_quality_rules(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", quality(F.col("text")).alias("q")).select("doc_id", "q.*")
