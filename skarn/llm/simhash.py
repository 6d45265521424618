"""Near-duplicates by SimHash: fingerprints within a few bits, found through blocks of bits.

Fingerprints. A document's words, lower-cased in A to Z, give its 3-word shingles with repeats; a
bit of the fingerprint is set if it is set in over half of the shingles' 64-bit hashes.

Links. Two fingerprints that differ in at most 3 bits agree on at least 3 of 6 blocks, so they meet
under one of 20 masks that keep 3 blocks (32 bits or more). Equal fingerprints are one node before
that. Groups of one mask and key are counted first. Those of up to ``CROWD`` fingerprints are
compared where they stand. The fingerprints of larger ones take finer masks: with 16 blocks of 4
bits the 3 bits lie in some 3 blocks, so two of them meet under one of 560 masks that leave 12 bits
open, and a group under such a mask has 4,096 different fingerprints at most. No group of unknown
size is gathered, no pair is left out, and a group gives a spanning tree of its links, not its pairs.

The smallest document of a component names it. Texts never enter a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType

from skarn.llm.common import by_slices, small_batches, table, written
from skarn.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a group that are compared under the coarse masks; larger groups take the fine ones.
CROWD = 64
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint_of(text: str | None) -> int:
    """The unsigned fingerprint of a whole text; without words it is zero."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: only A to Z change, white space is blank and 9 to 13
    n = len(words)
    if not n:
        return 0
    line, take = b" ".join(words), xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return take(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[: -SHINGLE] + 1].tolist()
    hashes = np.array([take(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], "<u8")
    m = len(hashes)
    if m < 300:
        ones = np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(column, minlength=256) @ _BITS for column in hashes.view(np.uint8).reshape(m, 8).T])
    return int(np.packbits(2 * ones > m, bitorder="little").view("<u8")[0])


def _prints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint_of(t) for t in texts.to_pylist()], np.uint64).view(np.int64))


@F.arrow_udf(LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    return by_slices(_prints, texts)


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long of the same bits."""
    return _fingerprint(text.cast("string"))


def _masks(sizes: list[int], kept: int) -> list[int]:
    """Signed masks that keep ``kept`` of the blocks."""
    starts = np.cumsum([0, *sizes])
    blocks = [((1 << n) - 1) << int(s) for n, s in zip(sizes, starts)]
    masks = [sum(c) for c in combinations(blocks, kept)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


COARSE = _masks([11, 11, 11, 11, 10, 10], 6 - RADIUS)
FINE = _masks([4] * 16, 16 - RADIUS)


def _keyed(prints: DataFrame, masks: list[int]) -> DataFrame:
    """``mask, key, f``: each fingerprint under each mask."""
    keys = F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("f").bitwiseAND(m))
    return prints.select("f", F.posexplode(keys).alias("mask", "key"))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of different fingerprints -> links (a, b) that join what the group's links join."""
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        for group in batch.column(0).to_pylist():
            if len(group) == 2:
                x, y = group
                if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= RADIUS:
                    a.append(x)
                    b.append(y)
                continue
            left = np.array(group, np.int64)
            while len(left) > 1:
                first, left = left[:1], left[1:]
                front = first
                while len(front) and len(left):
                    near = np.zeros(len(left), bool)
                    for x in front:
                        near |= np.bitwise_count((left ^ x).view(np.uint64)) <= RADIUS
                    front, left = left[near], left[~near]
                    a += [int(first[0])] * len(front)
                    b += front.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Links that join exactly the fingerprints ``f`` (distinct) within the radius."""
    keyed = _keyed(prints, COARSE)
    counted = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    # The keys that several fingerprints have, then their rows: groups of known size.
    # Joined on another form of the key: both sides are shuffled anew, and Spark can split a crowded one.
    other = F.bitwise_not("key").alias("not_key")
    rows = written(keyed.select("*", other).join(counted.select("mask", other, "n"), ["mask", "not_key"]).drop("not_key"), "blocks")
    small = rows.where(F.col("n") <= CROWD).groupBy("mask", "key").agg(F.collect_list("f").alias("fs"))
    crowded = rows.where(F.col("n") > CROWD).select("f").distinct()
    fine = _keyed(crowded, FINE).groupBy("mask", "key").agg(F.collect_list("f").alias("fs")).where(F.size("fs") > 1)
    found = small.select("fs").union(fine.select("fs")).mapInArrow(_trees, "a long, b long")
    return found.distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fingerprint (signed), component_id`` for every row.

    Rows of one fingerprint, empty and null texts among them, are linked. A null key never names a
    component unless all its keys are null. Repeated rows give repeated results.
    """
    small_batches(docs.sparkSession)
    rows = written(docs.select(F.col(key), fingerprint(F.col(text)).alias("f")), "prints")
    nodes = rows.groupBy("f").agg(F.min(key).alias("least"))
    labels = components(links(nodes.select("f")))
    named = nodes.join(labels, F.col("f") == F.col("v"), "left").select("f", "least", F.coalesce("label", "f").alias("root"))
    named = written(named, "roots")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(roots, "root").select("f", "component_id")
    return rows.join(by_print, "f").select(key, F.col("f").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component, with all columns: that of the smallest key, null keys last.

    Rows are told apart by a number of their own, so rows without a key, and rows that share one, are
    rows like all others. Of rows with the smallest key of a component, the first one stays.
    """
    names = [f"_{k}" for k in range(len(docs.columns))]
    numbered = written(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "numbered")
    of = dict(zip(docs.columns, names))
    found = near_duplicates(numbered.select(F.struct(F.col(of[key]).isNull().alias("none"), F.col(of[key]).alias("key"), "row").alias("place"), F.col(of[text]).alias("text")), "text", "place")
    first = found.select(F.col("component_id.row").alias("row")).distinct()
    return numbered.join(first, "row", "left_semi").select(*names).toDF(*docs.columns)


def op7_simhash_near_dedup(spark, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
