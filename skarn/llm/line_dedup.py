"""Line dedup by a deletion-neighbourhood join.

Two lines are alike if they are one edit of a word apart at most: a word replaced, added or left
out. Of lines that are alike, a later one goes and the earliest stays; a line that itself goes
still counts as an earlier one. Order is document, then place in it. Lines of fewer than
``LEAST_WORDS`` words have no neighbourhood, since one word is most of what they say; with
``short_copies`` the later exact copies of those that have a word go, without it they are left alone.
Blank lines always stay.

1. Equal lines become one row with its first place. What is left are different lines.
2. One edit leaves the first or the last words of a line as they are: of ``h`` words at either end,
   with 2 h no more than the line's words, one end is whole. ``h`` is a power of two that depends on
   the line's length, so most lines have two keys. Only lines that share an end with another go on;
   nothing is lost by this, and most lines finish here.
3. These emit their deletion variants as hashed keys: the line itself, and the line without each
   one of its words. Lines with the same variant and the same place of the left-out word differ by
   a replacement; a line that equals a variant of another lacks one word of it. So the members of a
   key are alike, and its earliest member is found by an aggregate. A key's lines are never paired
   with each other, however many there are.
4. Each line with an earlier member is held against that one line, word by word.

Words are runs of anything but white space. All rows are hashes and places but for the lines of
step 3. Text goes through a shuffle twice, packed by zstandard: to fetch those lines, and to meet
the places that go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, StringType

from skarn.llm.common import by_slices, slices, small_batches, table, written

#: Words of the shortest line that takes part.
LEAST_WORDS = 8
#: Odd factors of the keys' polynomial and of their mixing.
BASE, LENGTH, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def one_edit(a: list, b: list) -> bool:
    """Whether at most one word has to be replaced, added or left out."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _hash(data: bytes, seed: int = 0) -> int:
    import xxhash

    v = xxhash.xxh3_64_intdigest(data, seed)
    return v - (1 << 64) if v >> 63 else v


def end_keys(words: list[bytes]) -> list[int]:
    """Keys of the ends under which a line meets all lines alike to it.

    ``h`` is the highest power of two up to half the words. Where a line of one word less has a
    lower one, the longer line has the keys of both.
    """
    n, out = len(words), []
    h = 1 << (n // 2).bit_length() - 1
    for size in (h, h // 2) if n == 2 * h else (h,):
        out += [_hash(b" ".join(words[:size]), 2 * size), _hash(b" ".join(words[n - size :]), 2 * size + 1)]
    return out


def variant_keys(words: list[bytes]) -> np.ndarray:
    """Key of the whole line, then of the line without word 0, 1, ...; equal words, equal keys.

    A polynomial over the words' hashes, so all keys of a line come from two running sums.
    """
    n = len(words)
    h = np.fromiter(map(_hash, words), np.int64, n).view(np.uint64)
    power = np.full(n, BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
    moved = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[1:] * power[:-1], dtype=np.uint64)])  # words that stand one place earlier
    keys = np.concatenate([before[-1:], before[:-1] + (moved[-1] - moved)])
    keys[0:1] += np.uint64(n * LENGTH % (1 << 64))
    keys[1:] += np.uint64((n - 1) * LENGTH % (1 << 64))
    keys = (keys ^ keys >> np.uint64(30)) * np.uint64(MIX_1)
    keys = (keys ^ keys >> np.uint64(27)) * np.uint64(MIX_2)
    return (keys ^ keys >> np.uint64(31)).view(np.int64)


def _pressed(texts: pa.Array) -> pa.Array:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    return pa.array([None if t is None else press.compress(t.encode()) for t in texts.to_pylist()], pa.binary())


@F.arrow_udf(BinaryType())
def _pack(texts: pa.Array) -> pa.Array:
    return by_slices(_pressed, texts)


def _unpacked(blob: bytes | None) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob) if blob is not None else b""


def _left(blobs: pa.Array, dropped: pa.Array) -> pa.Array:
    out: list[bytes | None] = []
    for blob, places in zip(blobs.to_pylist(), dropped.to_pylist()):
        text = None if blob is None else _unpacked(blob)
        if text is not None and places:
            gone = set(places)
            text = b"\n".join([x for k, x in enumerate(text.split(b"\n")) if k not in gone])
        out.append(text)
    return pa.array(out, pa.binary()).cast(pa.string())


@F.arrow_udf(StringType())
def _without(blobs: pa.Array, dropped: pa.Array) -> pa.Array:
    return by_slices(_left, blobs, dropped)


@F.arrow_udf(BooleanType())
def _alike(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([one_edit(x.split(), y.split()) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def _places(rows: DataFrame, ends: bool, short: bool = False) -> DataFrame:
    """``key, at, line`` and, if asked for, ``ends``: every line that takes part, as hashes."""

    least = 1 if short else LEAST_WORDS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            who, at, line, keys = [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                for place, x in enumerate((text or "").encode().split(b"\n")):
                    words = x.split()
                    if len(words) >= least:
                        who.append(k)
                        at.append(place)
                        line.append(_hash(b" ".join(words)))
                        if ends:
                            keys.append(end_keys(words) if len(words) >= LEAST_WORDS else [])
            columns = {"key": b.column(0).take(pa.array(who, pa.int64())), "at": pa.array(at, pa.int32()), "line": pa.array(line, pa.int64())}
            if ends:
                columns["ends"] = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    schema = f"key {rows.schema['key'].dataType.simpleString()}, at int, line long"
    return rows.mapInArrow(cut, schema + ", ends array<long>" * ends)


def _neighbourhoods(texts: DataFrame) -> DataFrame:
    """Rows (packed, lines: at, line, first) -> ``line, first, words, variants`` of those lines."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            line, first, words, variants = [], [], [], []
            for blob, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = _unpacked(blob).split(b"\n")
                for w in wanted:
                    found = lines[w["at"]].split() if w["at"] < len(lines) else []
                    if _hash(b" ".join(found)) == w["line"]:  # else a row of the same key with another text
                        line.append(w["line"])
                        first.append(w["first"])
                        words.append(b" ".join(found).decode())
                        variants.append(variant_keys(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(line, pa.int64()), pa.array(first, b.schema.field(1).type.value_type.field("first").type), pa.array(words, pa.string()), pa.array(variants, pa.list_(pa.int64()))],
                ["line", "first", "words", "variants"],
            )

    first = texts.schema["lines"].dataType.elementType["first"].dataType.simpleString()
    return texts.select("packed", "lines").mapInArrow(emit, f"line long, first {first}, words string, variants array<long>")


def _fresh(k: str) -> Column:
    """The key in another form: a join on it shuffles both sides anew, and Spark can split a crowded key."""
    return F.bitwise_not(F.col(k)).alias(f"not_{k}")


def _near(lines: DataFrame) -> DataFrame:
    """``line`` of those with an earlier line one edit away."""
    keys = lines.select("line", F.posexplode("variants").alias("place", "k"))
    # Most keys have one line: they go before anything else is known of them.
    shared = keys.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select(_fresh("k"))
    met = keys.select("*", _fresh("k")).join(shared, "not_k", "left_semi").drop("not_k")
    keys = written(met.join(lines.select("line", "first"), "line"), "variants")
    me = F.struct("first", "line")
    same_place = keys.where("place > 0").groupBy("k", "place").agg(F.min(me).alias("m"), F.count("*").alias("n")).where("n > 1")
    same_place = same_place.select(_fresh("k"), _fresh("place"), "m")
    again = keys.select("*", _fresh("k"), _fresh("place"))
    replaced = again.join(same_place, ["not_k", "not_place"]).where(F.col("m.first") < F.col("first")).select("line", F.col("m.line").alias("other"))
    whole = F.min(F.when(F.col("place") == 0, me)).alias("whole")
    part = F.min(F.when(F.col("place") > 0, me)).alias("part")
    both = keys.groupBy("k").agg(whole, part).where("whole IS NOT NULL AND part IS NOT NULL").select(_fresh("k"), "whole", "part")
    other = F.when(F.col("place") == 0, F.col("part")).otherwise(F.col("whole"))
    added = again.join(both, "not_k").select("line", "first", other.alias("m")).where(F.col("m.first") < F.col("first")).select("line", F.col("m.line").alias("other"))
    pairs = replaced.union(added).distinct()
    words = lines.select("line", "words")
    pairs = pairs.join(words, "line").join(words.select(F.col("line").alias("other"), F.col("words").alias("other_words")), "other")
    return pairs.where(_alike("words", "other_words")).select("line").distinct()


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", short_copies: bool = True) -> DataFrame:
    """``key, dropped``: places (from 0) of the lines of a document that go; no row if none does."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    first = F.min(F.struct("key", "at")).alias("first")
    different = written(_places(rows, True, short_copies).groupBy("line").agg(first, F.any_value("ends").alias("ends")), "different")

    ends = different.select("line", F.explode("ends").alias("end"))
    shared = ends.groupBy("end").agg(F.count("*").alias("n")).where("n > 1").select(_fresh("end"))
    going_on = ends.select("line", _fresh("end")).join(shared, "not_end", "left_semi").select("line").distinct()
    going_on = different.select("line", "first").join(going_on, "line", "left_semi")

    wanted = going_on.groupBy(F.col("first.key").alias("of")).agg(F.collect_list(F.struct(F.col("first.at").alias("at"), "line", "first")).alias("lines"))
    # Merge joins at every size: the functions before and after them then run in different stages, so a
    # task has one Python worker.
    texts = rows.select("key", _pack("text").alias("packed")).join(wanted.hint("merge"), F.col("key").eqNullSafe(F.col("of")))
    neighbours = written(_neighbourhoods(texts).dropDuplicates(["line"]), "neighbourhoods")
    near = _near(neighbours).withColumn("near", F.lit(True))

    lines = different.select("line", "first").join(near, "line", "left").select(_fresh("line"), "first", "near")
    # The places are found again, which costs less than keeping them.
    gone = _places(rows, False, short_copies).select("key", "at", _fresh("line")).join(lines, "not_line").where(F.col("near") | (F.col("first") < F.struct("key", "at")))
    return gone.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("dropped"))


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", short_copies: bool = True) -> DataFrame:
    """All columns of ``docs``, the text without its repeated lines, and ``dropped``, their places.

    ``dropped`` is null where nothing goes, and replaces a column of that name. A null text stays
    null and has no lines. A null key comes first in the order. Rows that share a key are one
    document in the order: lines at the same place of it do not repeat each other, so repeated rows
    stay alike.
    """
    columns = [c for c in docs.columns if c != "dropped"]
    names = [f"c{k}" for k in range(len(columns))]  # so that no column of the documents can clash
    own, body = names[columns.index(key)], names[columns.index(text)]
    where = repeats(docs, text, key, short_copies).withColumnRenamed("key", "whose")
    packed = docs.select(*columns).toDF(*names).withColumn(body, _pack(F.col(body).cast("string")))
    met = packed.join(where.hint("merge"), F.col(own).eqNullSafe(F.col("whose")), "left").withColumn(body, _without(body, "dropped"))
    return met.select(*names, "dropped").toDF(*columns, "dropped")


def op2_line_dedup(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return drop_repeats(docs).select("doc_id", "text", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"), "dropped")
