"""Ranked lexical search: dense products of impact tiles and item tiles, exact in float64.

Every item is ranked against every document with one of its terms. Terms, statistics and scores are
integers (``weight``, ``impact``), so the order has no rounding in it.

1. One pass over the texts keeps of each document its number of terms and, for the terms that items
   have, places in the items' vocabulary and counts: the written *postings*. The number of documents
   ``N``, of terms ``L`` and the documents of each vocabulary term are counted over all of them.
2. Items stand in tiles of ``ITEM_TILE``. A tile has a compact vocabulary of its own, the terms of its
   items, and a matrix of weights. ``DOC_TILE`` documents at a time become a dense matrix of their
   impacts under that vocabulary, and BLAS multiplies the two.
3. An impact is below ``IMPACT``, so a product is exact while the weights of an item sum up to
   ``(2 ** 53 - 1) // IMPACT`` at most. Weights beyond that are laid into further matrices, and their
   products are added as 64-bit integers.
4. A task keeps for each item its best ``k`` so far. A tile's scores at or above the k-th enter, ties
   included, and the order by score and key decides. The tasks' lists, ``k`` rows an item at most,
   meet in one window.

Items are a query set: they go to the tasks in blocks of ``BLOCK_CHARACTERS`` of text, so what is
sent is bounded whatever their number; each block is a pass of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skarn.llm.common import slices, table, written

ITEM_TILE, DOC_TILE = 128, 512
#: Text of the items of one block, in characters; a longer item is a block of its own.
BLOCK_CHARACTERS = 1_000_000
#: Bound of an impact.
IMPACT = 1_000_000
MOST_WEIGHT = (2**53 - 1) // IMPACT

#: Bytes of terms are digits, letters and all of other characters; A to Z become a to z.
_TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text in order; a null text has none."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of so many documents hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(count: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impact of terms with this count in documents of this length; all of ``total`` terms."""
    m = 75 + (25 * length * documents) // total
    return (1_000_000_000 * count) // (1000 * count + 12 * m)


def exact_parts(weights: np.ndarray) -> list[np.ndarray]:
    """Matrices that sum up to ``weights`` (terms x items), no column of one over ``MOST_WEIGHT``."""
    parts, left = [], weights.copy()
    while left.any():
        before = np.cumsum(left, axis=0) - left
        part = np.clip(MOST_WEIGHT - before, 0, left)
        parts.append(part.astype(np.float64))
        left -= part
    return parts


class _Best:
    """The best ``k`` keys of each item so far: by score, then key, null keys last."""

    def __init__(self, items: int, k: int, key_type: pa.DataType):
        self.k, self.least = k, np.zeros(items, np.int64)
        self.item, self.score, self.key = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], key_type)
        self.waiting: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.rows = 0

    def offer(self, item: np.ndarray, score: np.ndarray, key: pa.Array) -> None:
        self.waiting.append((item, score, key))
        self.rows += len(item)
        if self.rows > 4 * self.k * len(self.least):
            self.settle()

    def settle(self) -> None:
        items, scores, keys = zip((self.item, self.score, self.key), *self.waiting)
        item, score, key = np.concatenate(items), np.concatenate(scores), pa.concat_arrays(keys)
        self.waiting, self.rows = [], 0
        if not len(item):
            return
        place = pc.rank(key, null_placement="at_end", tiebreaker="dense").to_numpy()
        order = np.lexsort((place, -score, item))
        item, score = item[order], score[order]
        first = np.concatenate([[True], item[1:] != item[:-1]])
        nth = np.arange(len(item)) - np.maximum.accumulate(np.where(first, np.arange(len(item)), 0))
        kept = nth < self.k
        self.item, self.score, self.key = item[kept], score[kept], key.take(pa.array(order[kept]))
        full = nth == self.k - 1
        self.least[item[full]] = score[full]


def _postings(docs: DataFrame, vocabulary: dict[bytes, int], text: str, key: str) -> DataFrame:
    """``key, n, term, count`` of every document with a term; ``term`` and ``count`` are arrays."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            whole, found = [], []
            for t in b.column(1).to_pylist():
                words = terms(t)
                whole.append(len(words))
                places = [p for p in map(vocabulary.get, words) if p is not None]
                found.append(np.unique(np.array(places, np.int32), return_counts=True))
            ends = pa.array(np.cumsum([0, *(len(p) for p, _ in found)]), pa.int32())
            flat = [np.concatenate([f[i] for f in found] or [np.zeros(0, np.int32)]).astype(np.int32) for i in (0, 1)]
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat]
            rows = pa.RecordBatch.from_arrays([b.column(0), pa.array(whole, pa.int64()), *lists], ["key", "n", "term", "count"])
            yield rows.filter(pa.array([n > 0 for n in whole], pa.bool_()))

    rows = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].cast("string").alias("text"))
    added = StructType.fromDDL("n bigint, term array<int>, count array<int>")
    return rows.mapInArrow(count, StructType([rows.schema["key"], *added.fields]))


def _tiles(item_terms: list[dict[int, int]], weights: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Of each tile of items its vocabulary and its exact weight matrices."""
    out = []
    for at in range(0, len(item_terms), ITEM_TILE):
        tile = item_terms[at : at + ITEM_TILE]
        own = np.array(sorted(set().union(*tile)), np.int64)
        place = {t: k for k, t in enumerate(own.tolist())}
        matrix = np.zeros((len(own), len(tile)), np.int64)
        for column, counts in enumerate(tile):
            for t, times in counts.items():
                matrix[place[t], column] = times * weights[t]
        out.append((own, exact_parts(matrix)))
    return out


def _search_block(docs: DataFrame, item_keys: list, item_type, item_texts: list[str | None], k: int, text: str, key: str) -> DataFrame:
    """``item, n_item, rank, key, score`` for the items of a block."""
    vocabulary: dict[bytes, int] = {}
    item_terms: list[dict[int, int]] = []
    for t in item_texts:
        counts: dict[int, int] = {}
        for word in terms(t):
            place = vocabulary.setdefault(word, len(vocabulary))
            counts[place] = counts.get(place, 0) + 1
        item_terms.append(counts)
    postings = written(_postings(docs, vocabulary, text, key), "postings")
    documents, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    # A row per term of the block's vocabulary at most.
    for row in postings.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        weights[row["t"]] = weight(documents, row["n"])
    n_items, n_terms = len(item_terms), len(vocabulary)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = _tiles(item_terms, weights)
        best = None
        for b in slices(batches, DOC_TILE):
            best = best or _Best(n_items, k, b.schema.field("key").type)
            lists = b.column("term")
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            term, count = (b.column(c).flatten().to_numpy().astype(np.int64) for c in ("term", "count"))
            value = impact(count, b.column("n").to_numpy()[row], documents, total)
            for t, (own, parts) in enumerate(tiles):
                if not parts:
                    continue
                column = np.full(n_terms, -1)
                column[own] = np.arange(len(own))
                column = column[term]
                held = column >= 0
                dense = np.zeros((b.num_rows, len(own)))
                dense[row[held], column[held]] = value[held]
                scores = sum((dense @ part).astype(np.int64) for part in parts)
                least = np.maximum(best.least[t * ITEM_TILE : t * ITEM_TILE + scores.shape[1]], 1)
                at, item = np.nonzero(scores >= least)
                if len(at):
                    best.offer(item + t * ITEM_TILE, scores[at, item], b.column("key").take(pa.array(at)))
        if best is not None:
            best.settle()
            if len(best.item):
                yield pa.RecordBatch.from_arrays([pa.array(best.item), best.key, pa.array(best.score)], ["n_item", "key", "score"])

    schema = StructType([StructField("n_item", LongType()), postings.schema["key"], StructField("score", LongType())])
    found = postings.mapInArrow(search, schema)
    order = Window.partitionBy("n_item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame(list(enumerate(item_keys)), StructType([StructField("n_item", LongType()), StructField("item", item_type)]))
    return ranked.join(names, "n_item").select("item", "rank", "key", "score")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 20, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id"
) -> DataFrame:
    """``item, rank, key, score``: the best ``k`` documents with a score above 0 for every row of ``items``.

    Equal scores stand by ascending key, null keys last; rows that share a key are documents of their
    own, and rows of ``items`` that share one are items of their own. Null and empty texts have no
    terms: they match nothing and do not count as documents. Other columns are not read.
    """
    spark = docs.sparkSession
    asked = items.select(items[f"`{item_key}`"].alias("item"), items[f"`{item_text}`"].cast("string").alias("text"))
    results, keys, texts, size = [], [], [], 0

    def close() -> None:
        nonlocal keys, texts, size
        if keys:
            results.append(_search_block(docs, keys, asked.schema["item"].dataType, texts, k, text, key))
        keys, texts, size = [], [], 0

    for row in asked.toLocalIterator():  # a block at a time
        length = len(row["text"] or "")
        if size + length > BLOCK_CHARACTERS:
            close()
        keys.append(row["item"])
        texts.append(row["text"])
        size += length + 1
    close()
    if not results:
        schema = StructType([asked.schema["item"], *StructType.fromDDL("rank int").fields, StructField("key", docs.schema[key].dataType), StructField("score", LongType())])
        return spark.createDataFrame([], schema)
    if len(results) > 1:
        results = [written(r, "ranked") for r in results]
    found = results[0]
    for other in results[1:]:
        found = found.union(other)
    return found


def op11_ranked_search(spark, folder: str) -> DataFrame:
    found = ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("key").alias("doc_id"), "score")


ORACLE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), q AS (
    SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark
), s AS (
    SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0
), c AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term
), f AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term, n_docs
), m AS (
    SELECT r, doc_id, 75 + (25 * len(ts) * n_docs) // total AS m FROM d, s WHERE len(ts) > 0
), qt AS (
    SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS term FROM q) GROUP BY i, item_id, term
), scored AS (
    SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM qt JOIN f USING (term) JOIN c USING (term) JOIN m USING (r) GROUP BY i, item_id, r, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scored WHERE score > 0
) WHERE rank <= 20
"""
