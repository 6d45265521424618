"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces are dealt at random into shards of about ``SHARD`` pieces. A shard is a packing problem of
its own and one row of a DataFrame; ``ISLANDS`` populations work on it in different tasks. A
population is a few packings (a bin number per piece). Crossover takes whole well-filled bins of
one parent, removes the other parent's bins that hold a piece twice, and places the displaced
pieces by best fit, largest first. Between two epochs every island gets the elite of all islands of
its shard. A population stops early once a packing needs no more bins than the tokens demand.

Bins that a shard leaves badly filled are taken apart, and their pieces form the shards of the next
level, until one shard is left: a shard costs no half-empty bin of its own. Pieces that no packing
fills well (many copies of one length over half the capacity) would come back on every level. So a
level that leaves more than ``PROGRESS`` of its pieces takes only the emptiest quarter of each
shard's badly filled bins apart, and if even that leaves so many, it is the last. So every level but
the last leaves fewer pieces by a fixed factor. Nothing but counts goes through the driver; a task
holds one shard.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from skarn.llm.common import slices, table, written
from skarn.llm.vocab import default_path, encoder

#: Pieces of a shard, populations of a shard, packings of a population, and crossovers in an epoch.
SHARD, ISLANDS, POPULATION, CROSSOVERS, EPOCHS = 4096, 2, 3, 6, 2
#: A bin with less of its capacity used is taken apart for the next level.
WELL_FILLED = 0.995
#: Most of a level's pieces that go on to the next, and the least bins' worth of tokens of a shard.
PROGRESS, LEAST_BINS = 0.75, 4


def best_fit(lengths: list[int], capacity: int, order: list[int], bins: np.ndarray, free: list[int]) -> None:
    """Place the pieces in ``order`` where the least room is left; ``bins`` and ``free`` change."""
    room: dict[int, list[int]] = {}
    present = 0  # bit s: a bin with s free tokens
    for b, s in enumerate(free):
        if s:
            room.setdefault(s, []).append(b)
            present |= 1 << s
    for i in order:
        n = lengths[i]
        fits = present >> n
        if fits:
            s = n + (fits & -fits).bit_length() - 1
            group = room[s]
            b = group.pop()
            if not group:
                present &= ~(1 << s)
        else:
            s, b = capacity, len(free)
            free.append(capacity)
        left = s - n
        free[b] = left
        bins[i] = b
        if left:
            group = room.get(left)
            if group:
                group.append(b)
            else:
                room[left] = [b]
            present |= 1 << left


class Shard:
    """One packing problem: piece lengths and a capacity."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths.astype(np.int64), capacity
        self.plain = self.lengths.tolist()
        self.least = -(-int(self.lengths.sum()) // capacity)
        self.random = np.random.default_rng(seed)

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lengths, minlength=1).astype(np.int64)

    def cost(self, bins: np.ndarray) -> tuple[int, float]:
        """Bins, then the fitness of full bins over even ones."""
        fill = self.fills(bins) / self.capacity
        return int(np.count_nonzero(fill)), -float((fill**2).sum())

    def place(self, order: np.ndarray, bins: np.ndarray, free: list[int]) -> np.ndarray:
        best_fit(self.plain, self.capacity, order.tolist(), bins, free)
        return bins

    def fresh(self, blur: float) -> np.ndarray:
        """Best fit of all pieces, largest first, their order blurred."""
        key = self.lengths * (1 + blur * self.random.standard_normal(len(self.lengths)))
        return self.place(np.argsort(-key, kind="stable"), np.empty(len(self.lengths), np.int64), [])

    def cross(self, giver: np.ndarray, taker: np.ndarray) -> np.ndarray:
        """Well-filled bins of the giver go into the taker whole."""
        fill = self.fills(giver)
        full = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        chosen = np.zeros(len(fill), bool)
        chosen[self.random.permutation(full)[: max(1, len(full) // 2)]] = True
        given = chosen[giver]
        broken = np.zeros(int(taker.max()) + 1, bool)
        broken[taker[given]] = True  # these hold a piece that is now there twice
        displaced = np.flatnonzero(broken[taker] & ~given)
        kept = ~broken[taker]
        label = np.where(given, giver, np.where(kept, taker + len(fill), -1))
        used, bins = np.unique(label, return_inverse=True)
        bins = bins.astype(np.int64) - (1 if len(used) and used[0] == -1 else 0)
        placed = bins >= 0
        room = self.capacity - np.bincount(bins[placed], self.lengths[placed], minlength=1).astype(np.int64)
        if not placed.any():
            room = room[:0]
        order = displaced[np.argsort(-self.lengths[displaced], kind="stable")]
        return self.place(order, bins, room.tolist())

    def evolve(self, population: list[np.ndarray], crossovers: int) -> np.ndarray:
        """The best packing after some crossovers; a child replaces the worst if it is better."""
        ranked = sorted(((self.cost(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
        for k in range(crossovers):
            if ranked[0][0][0] <= self.least or len(ranked) < 2:
                break
            a, b = self.random.permutation(len(ranked))[:2]
            child = self.cross(ranked[a][2], ranked[b][2])
            cost = self.cost(child)
            if cost < ranked[-1][0]:
                ranked[-1] = (cost, len(population) + k, child)
                ranked.sort(key=lambda x: x[:2])
        return ranked[0][2]


def _epoch(capacity: int, number: int):
    """Rows (shard, island, lengths, elites) -> the island's elite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for shard, island, lengths, elites in zip(*(b.column(c).to_pylist() for c in ("shard", "island", "lengths", "elites"))):
                work = Shard(np.array(lengths), capacity, hash((shard, island, number)) & 0x7FFFFFFF)
                population = [np.frombuffer(x, np.int32).astype(np.int64) for x in elites or ()]
                if population and work.cost(population[0])[0] <= work.least:
                    out.append(elites[0])
                    continue
                while len(population) < POPULATION:
                    # The first of an island is the plain order on island 0 and a blurred one elsewhere.
                    population.append(work.fresh(0.02 * len(population) + 0.1 * island))
                    if work.cost(population[-1])[0] <= work.least:
                        break
                out.append(work.evolve(population, CROSSOVERS).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("island"), pa.array(out, pa.binary())], ["shard", "island", "elite"])

    return run


def _lay_out(capacity: int):
    """Rows (shard, rows, lengths, elites) -> the best packing, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, rows, lengths, elites in zip(*(b.column(c).to_pylist() for c in ("shard", "rows", "lengths", "elites"))):
                lengths = np.array(lengths, np.int64)
                work = Shard(lengths, capacity, 0)
                bins = min((np.frombuffer(x, np.int32).astype(np.int64) for x in elites), key=work.cost)
                order = np.lexsort((-lengths, bins))
                ends = np.cumsum(lengths[order])
                firsts = np.flatnonzero(np.r_[True, np.diff(bins[order]) != 0])
                base = np.repeat((ends - lengths[order])[firsts], np.diff(np.r_[firsts, len(order)]))
                fills = work.fills(bins)
                bad = np.flatnonzero((fills > 0) & (fills < WELL_FILLED * capacity))
                emptiest = np.zeros(len(fills), bool)
                emptiest[bad[np.argsort(fills[bad], kind="stable")][: -(-len(bad) // 4)]] = True
                n = len(order)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard)), pa.array(np.array(rows)[order]), pa.array(lengths[order]), pa.array(bins[order]),
                     pa.array(ends - lengths[order] - base), pa.array(fills[bins[order]]), pa.array(emptiest[bins[order]])],
                    ["shard", "row", "length", "bin", "offset", "fill", "emptiest"],
                )

    return run


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``row, sequence_id, offset`` of pieces (``row`` unique, ``length`` of 1 to ``capacity``).

    A piece of full length is a sequence by itself. An empty table gives no rows.
    """
    full = pieces.where(F.col("length") == capacity).select("row", (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, done, level = pieces.where(F.col("length") < capacity).select("row", "length"), [full], 0
    while True:
        count, tokens = rest.agg(F.count("*"), F.sum("length")).first()
        if not count:
            break
        # With fewer tokens a shard would be a bin or two; it still has LEAST_BINS * capacity pieces at most.
        shards = min(math.ceil(count / SHARD), math.ceil(tokens / (LEAST_BINS * capacity)))
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(shards)))
        # A shard's pieces are one row: about SHARD of them, since ``row`` is unique.
        problems = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("p"))
        problems = written(problems.select("shard", F.col("p.row").alias("rows"), F.col("p.length").alias("lengths")), "shards")
        islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
        elites = None
        for number in range(EPOCHS):
            state = problems.select("shard", "lengths", islands)
            if elites is None:
                state = state.withColumn("elites", F.lit(None).cast("array<binary>"))
            else:
                state = state.join(elites, "shard")
            state = state.select("shard", "island", "lengths", "elites").repartition(min(shards * ISLANDS, 4096), "shard", "island")
            found = state.mapInArrow(_epoch(capacity, number), "shard long, island int, elite binary")
            # Migration: the elites of a shard's islands meet; ISLANDS of them at most.
            met = found.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("island", "elite"))).alias("e"))
            elites = written(met.select("shard", F.col("e.elite").alias("elites")), "elites")
        schema = "shard long, row long, length long, bin long, offset long, fill long, emptiest boolean"
        placed = written(problems.join(elites, "shard").select("shard", "rows", "lengths", "elites").mapInArrow(_lay_out(capacity), schema), "packed")
        badly_filled = F.col("fill") < WELL_FILLED * capacity
        again = F.lit(False)
        if shards > 1:
            for again in (badly_filled, badly_filled & F.col("emptiest"), F.lit(False)):
                if placed.where(again).count() <= PROGRESS * count:
                    break
        name = F.lit(level) * F.lit(1 << 56) + F.col("shard") * F.lit(1 << 24) + F.col("bin")
        done.append(placed.where(~again).select("row", name.alias("sequence_id"), "offset"))
        if shards == 1:
            break
        rest, level = placed.where(again).select("row", "length"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents as token pieces: ``row, doc_id, piece, start, length, ids_crc32``.

    Null and empty texts have the end id alone. Only documents longer than ``capacity`` are cut.
    ``row`` numbers the pieces within their task, so repeated documents stay apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(path), TaskContext.get().partitionId() << 40
        for b in slices(batches, 1024):
            out: list[list[int]] = [[], [], [], [], [], []]
            for k, ids in enumerate(coder.batch(b.column(1).to_pylist())):
                ids = np.append(ids, coder.kind.type(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, x in zip(out, (row, k, piece, start, len(part), zlib.crc32(part.data))):
                        column.append(x)
                    row += 1
            where = pa.array(out[1], pa.int64())
            kinds = (pa.int64(), None, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [b.column(0).take(where) if t is None else pa.array(v, t) for v, t in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"row long, doc_id {key_type}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Ties and repeated rows are pieces of their own; other columns are not read.
    """
    pieces = written(cut_pieces(docs, path or default_path(), capacity, end_id), "pieces")
    return pieces.join(pack(pieces.select("row", "length"), capacity), "row").drop("row")


def op5_best_fit_packing(spark, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))
