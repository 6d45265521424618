"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact similarity.

Words are runs of letters and digits in lower case; shingles are 5 words (of an item with fewer: all
of them). A window of a document is as long as an item. A window that shares no shingle with any
item cannot be similar to one, so only windows that a shared shingle lines up with an item get a
fingerprint: the shingle's place in the document less its place in the item is where they start.

Fingerprints have 64 bits. Those within ``RADIUS`` = 15 bits agree up to 3 bits on one of 4 blocks
of 16 bits, so the index holds every item under each block with every change of up to 3 bits (697
keys a block), and a window meets all items within the radius by its four plain blocks. What the
index and the exact distance let through is compared in full: the weighted Jaccard similarity of
the two bags of shingles, of which ``SIMILARITY`` is asked.

DataFrame functions only. The benchmark's shingles are broadcast while there are ``MOST_BROADCAST``
rows of them at most (counted); beyond that the same join is left to Spark. Hits are a few narrow
rows per leak, and text is read again only for documents with hits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from skarn.llm.common import table, written

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS, BLOCK_BITS = 15, 4, 16
MOST_BROADCAST = 500_000

#: All changes of up to RADIUS // BLOCKS bits of a block.
CHANGES = [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), n)]


def words(text: Column) -> Column:
    """Runs of letters and digits, in lower case; none for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _places(values: Column, size: int) -> Column:
    """0, 1, ... for each run of ``size`` values."""
    n = F.size(values) - size
    return F.when(n >= 0, F.sequence(F.lit(0), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _run_hashes(hashes: Column, size: int) -> Column:
    return F.transform(_places(hashes, size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))


def _hashed(rows: DataFrame, size: int) -> DataFrame:
    """Adds ``hs``, the hashes of all shingles of ``size`` words of ``words``."""
    coded = rows.withColumn("coded", F.transform("words", lambda w: F.xxhash64(w)))
    return coded.withColumn("hs", _run_hashes(F.col("coded"), size)).drop("coded")


def fingerprint(hashes: Column) -> Column:
    """SimHash: a bit is set if it is set in over half of the hashes."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0).cast("long"), lambda n, h: n + _bit_of(h, b))
        return F.when(2 * ones > F.size(hashes), _power(b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def _bit_of(h: Column, b: Column) -> Column:
    return F.call_function("getbit", h, b).cast("long")


def _power(b: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), b)


def _blocks(print_: Column) -> Column:
    mask = (1 << BLOCK_BITS) - 1
    return F.array(*[F.shiftrightunsigned(print_, BLOCK_BITS * k).bitwiseAND(F.lit(mask).cast("long")) for k in range(BLOCKS)])


def _bag_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays as bags."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def _shingles(run: Column, size: int) -> Column:
    return F.transform(_places(run, size), lambda i: F.concat_ws(" ", F.slice(run, i + 1, size)))


def _leaks(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """Leaks of items whose shingles have ``size`` words."""
    items = written(_hashed(items, size).withColumn("print", fingerprint(F.col("hs"))), "items")
    anchors = items.select("item_id", F.size("words").alias("n"), F.posexplode_outer("hs").alias("place", "h")).distinct()
    anchors = written(anchors.groupBy("h").agg(F.collect_set(F.struct("place", "n")).alias("at")), "anchors")
    if anchors.count() <= MOST_BROADCAST:
        anchors = F.broadcast(anchors)

    # The outer form, as Spark would test the inner one's array first and compute it twice for that.
    seen = _hashed(docs, size).select("doc_id", F.posexplode_outer("hs").alias("p", "h"))
    hits = seen.join(anchors, "h").select("doc_id", "p", F.explode("at").alias("a"))
    windows = hits.select("doc_id", (F.col("p") - F.col("a.place")).alias("start"), F.col("a.n").alias("n")).distinct()
    windows = written(windows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("at")), "windows")

    # Texts of documents with hits; a window is cut at the document's ends.
    texts = docs.join(windows.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")))
    spans = texts.select("doc_id", "words", F.explode("at").alias("a")).select(
        "doc_id", F.greatest("a.start", F.lit(0)).alias("start"), F.least(F.col("a.start") + F.col("a.n"), F.size("words")).alias("end"), "words"
    )
    spans = spans.where(F.col("end") - F.col("start") >= size)
    spans = spans.select("doc_id", "start", F.slice("words", F.col("start") + 1, F.col("end") - F.col("start")).alias("words")).distinct()
    found = written(_hashed(spans, size).withColumn("print", fingerprint(F.col("hs"))).drop("hs"), "fingerprints")

    # Windows of one text and fingerprint ask the index once.
    changes = F.array(*[F.lit(c).cast("long") for c in CHANGES])
    index = items.select("item_id", F.col("print").alias("item_print"), F.posexplode(_blocks(F.col("print"))).alias("block", "value"))
    index = index.select("item_id", "item_print", "block", F.explode(F.transform(changes, lambda c: F.col("value").bitwiseXOR(c))).alias("value"))
    prints = found.select("print").distinct().select("print", F.posexplode(_blocks(F.col("print"))).alias("block", "value"))
    # Both sides are shuffled: the index is thousands of rows an item, which Spark's estimate of it misses.
    near = prints.join(index.hint("merge"), ["block", "value"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    near = written(near.select("print", "item_id").distinct(), "near")

    pairs = found.join(near.hint("merge"), "print").join(items.select("item_id", F.col("words").alias("item_words")), "item_id")
    pairs = pairs.select("doc_id", "item_id", "start", F.size("words").alias("n_words"), _shingles(F.col("words"), size).alias("a"), _shingles(F.col("item_words"), size).alias("b"))
    return pairs.select("doc_id", "item_id", "start", "n_words", _bag_similarity(F.col("a"), F.col("b")).alias("similarity"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, start, n_words, similarity``: a row per document and item it holds.

    ``start`` (in words) and ``similarity`` are those of the most similar window, of ties the first.
    Null and empty texts hold nothing and items without words are never found. Repeated rows give
    one result, rows that share a ``doc_id`` count as parts of one document. Other columns are not read.
    """
    docs = docs.select("doc_id", words(F.col("text")).alias("words"))
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    items = written(items, "benchmark")
    sizes = [r[0] for r in items.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().collect()]  # 5 values at most
    found = None
    for size in sorted(sizes) or [SHINGLE]:
        part = _leaks(docs, items.where(F.least(F.size("words"), F.lit(SHINGLE)) == size), size)
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n_words")).alias("best")
    found = found.groupBy("doc_id", "item_id").agg(best).where(F.col("best.similarity") >= similarity)
    return found.select("doc_id", "item_id", (-F.col("best.before")).alias("start"), "best.n_words", "best.similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, that hold no item of the benchmark."""
    held = written(leaks(docs, benchmark, similarity).select(F.col("doc_id").alias("held")).distinct(), "contaminated")
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column of the documents can clash
    own = F.col(names[docs.columns.index("doc_id")])
    return docs.toDF(*names).join(held, own.eqNullSafe(F.col("held")), "left_anti").toDF(*docs.columns)


def op3_benchmark_decontamination(spark, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
