"""Runs of repeated word sequences: multi-scale minimizers, direct scans for short periods.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are equal) and
at least ``max(LEAST_LENGTH, LEAST_TIMES * q)`` words, which no neighbouring word extends. All runs
of a text are found:

- Periods up to ``SHORT`` are looked for directly: where do words ``q`` apart agree, and how long.
- Longer ones are split by scale, ``G / 2 < q <= G`` for G = 16, 32, ... Every ``G`` words in a row
  have a hash, built from those of the scale before. Of each ``G / 2`` hashes in a row the smallest,
  leftmost one is selected. A run has at least ``4 q`` words, so it holds a whole such window and the
  same window ``q`` later: both select the same place in it. ``G >= q`` words of a run with smallest
  period ``q`` return only at multiples of ``q``, so the next equal selected hash is exactly ``q``
  on. Pairs of neighbours with equal hashes and such a distance are the seeds.
- A seed is extended in both directions as far as words ``q`` apart agree (this also tests the hash),
  once for each stretch. Stretches that are too short, or have a smaller period, go.

A scale selects about 4 / G of its places, so the pairs of all scales are linear in the text. Texts
are worked on in portions, laid end to end with a word of its own between two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from skarn.llm.common import WORD, slices, table

LEAST_LENGTH, LEAST_TIMES = 6, 4
#: Periods found by direct scans; a power of two.
SHORT = 8
#: Characters of the texts that are searched together.
PORTION = 2_000_000
#: Odd factors of the hashes.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _B
    return x ^ x >> np.uint64(29)


def _same_for(w: np.ndarray, at: int, lag: int, step: int) -> int:
    """Number of places from ``at`` on (``step`` 1) or before it (-1) with equal words ``lag`` on."""
    done, block = 0, 64
    room = len(w) - lag - at if step > 0 else at
    while done < room:
        size = min(block, room - done)
        i = at + done if step > 0 else at - done - size
        same = w[i : i + size] == w[i + lag : i + lag + size]
        if not same.all():
            return done + int(np.argmin(same if step > 0 else same[::-1]))
        done += size
        block = min(2 * block, 1 << 16)
    return done


def _smallest(w: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether a stretch of this period, at least twice as long, has no smaller one: such a one divides it."""
    left, factor = period, 2
    while left > 1:
        if factor * factor > left:
            factor = left
        if left % factor == 0:
            q = period // factor
            if (w[start : end - q] == w[start + q : end]).all():
                return False
            while left % factor == 0:
                left //= factor
        factor += 1
    return True


def _short_runs(w: np.ndarray) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, min(SHORT, len(w) - 1) + 1):
        unlike = np.flatnonzero(w[q:] != w[:-q])
        edges = np.concatenate([[-1], unlike, [len(w) - q]])
        need = max(LEAST_LENGTH, LEAST_TIMES * q) - q
        for k in np.flatnonzero(np.diff(edges) - 1 >= need):
            start, end = int(edges[k]) + 1, int(edges[k + 1]) + q
            if _smallest(w, start, end, q):
                found.append((start, end - start, q))
    return found


def _selected(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest, leftmost hash of every ``window`` (a power of two) in a row."""
    low, place, size = hashes, np.arange(len(hashes)), 1
    while size < window:
        later = low[size:] < low[:-size]
        low = np.where(later, low[size:], low[:-size])
        place = np.where(later, place[size:], place[:-size])
        size *= 2
    return place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place


def _seeds(hashes: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """(period, place) of neighbours among the selected places with equal hashes."""
    at = _selected(hashes, gram // 2)
    values = hashes[at]
    order = np.argsort(values, kind="stable")
    equal = values[order[1:]] == values[order[:-1]]
    first, lag = at[order[:-1]][equal], np.diff(at[order])[equal]
    fits = (lag > gram // 2) & (lag <= gram)
    return sorted(zip(lag[fits].tolist(), first[fits].tolist()))


def _long_runs(w: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of periods over ``SHORT`` in texts of these lengths, each followed by one separator."""
    found = []
    hashes, gram = _mixed((w.astype(np.uint64) + np.uint64(1)) * _A), 1
    base = np.zeros(1, np.int64)  # where the part that is still searched begins in w, text by text
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    part, part_starts, base = w, starts, starts
    while len(lengths):
        hashes = _mixed(hashes[:-gram] * _A + (hashes[gram:] ^ _B)) if len(hashes) > gram else hashes[:0]
        gram *= 2
        if gram <= SHORT:
            continue
        # A period over gram / 2 needs a text of so many words; shorter texts leave the search.
        stay = lengths >= LEAST_TIMES * (gram // 2 + 1)
        if not stay.all():
            keep = np.repeat(stay, lengths + 1)
            part, hashes = part[keep], np.concatenate([hashes, np.zeros(len(keep) - len(hashes), np.uint64)])[keep]
            lengths, base = lengths[stay], base[stay]
            hashes = hashes[: max(0, len(part) - gram + 1)]
            part_starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
            if not len(lengths):
                break
        period, reached = 0, 0
        for q, i in _seeds(hashes, gram):
            if q == period and i < reached:
                continue
            ahead = _same_for(part, i, q, 1)
            if ahead < gram:
                continue  # equal hashes of different words
            start = i - _same_for(part, i, q, -1)
            period, reached = q, i + ahead
            end = reached + q
            if end - start >= max(LEAST_LENGTH, LEAST_TIMES * q) and _smallest(part, start, end, q):
                k = int(np.searchsorted(part_starts, start, "right")) - 1
                found.append((int(base[k]) + start - int(part_starts[k]), end - start, q))
    return found


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each list of words, by start, then period."""
    lengths = np.array([len(words) for words in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not lengths.any():
        return out
    coded = pa.array([x for words in texts for x in words], pa.large_binary()).dictionary_encode()
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    w = np.empty(starts[-1], np.int64)
    separators = starts[1:] - 1
    word = np.ones(len(w), bool)
    word[separators] = False
    w[word] = coded.indices.to_numpy()
    w[separators] = len(coded.dictionary) + np.arange(len(texts))
    for start, length, period in sorted(_short_runs(w) + _long_runs(w, lengths), key=lambda r: (r[0], r[2])):
        k = int(np.searchsorted(starts, start, "right")) - 1
        out[k].append((start - int(starts[k]), length, period))
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run contains after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return list(compress(words, np.cumsum(change[:-1]) == 0))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; of equal ones the first by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _portions(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    held: list[list[bytes]] = []
    size = 0
    for text in texts:
        held.append((text or "").encode().split())  # white space of bytes is blank and 9 to 13
        size += len(text or "")
        if size >= PORTION:
            yield held
            held, size = [], 0
    yield held


_RUN = "struct<start: bigint, length: bigint, period: bigint>"


def collapse_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with each run of ``text`` cut to its first period, and ``runs``, ``strongest``.

    ``runs`` has all runs by start, then period; ``strongest`` is the one with the greatest length /
    period (ties: smallest start, then period), null without a run. Words are joined by one blank. A
    null text stays null and has no runs. Columns named ``runs`` or ``strongest`` are replaced.
    """
    columns = [c for c in docs.columns if c not in ("runs", "strongest")]
    names = [f"c{k}" for k in range(len(columns))]
    at = names[columns.index(text)]
    rows = docs.select(*[docs[f"`{c}`"].cast("string").alias(n) if n == at else docs[f"`{c}`"].alias(n) for c, n in zip(columns, names)])
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            texts = b.column(at).to_pylist()
            found, left = [], []
            for portion in _portions(texts):
                runs = find_runs(portion)
                found += runs
                left += [b" ".join(kept_words(words, r)).decode() for words, r in zip(portion, runs)]
            named = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
            best = [None if (r := strongest(runs)) is None else dict(zip(("start", "length", "period"), r)) for runs in found]
            texts = pa.array([None if t is None else x for t, x in zip(texts, left)], pa.string())
            old = [texts if n == at else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*old, pa.array(named, pa.list_(run_type)), pa.array(best, run_type)], [*names, "runs", "strongest"])

    added = StructType.fromDDL(f"runs array<{_RUN}>, strongest {_RUN}")
    schema = StructType([*[StructField(n, rows.schema[n].dataType) for n in names], *added.fields])
    return rows.mapInArrow(search, schema).toDF(*columns, "runs", "strongest")


def planted(text: Column, key: Column) -> Column:
    """Contract of the query: a tenth of the texts, by the key's checksum, get a periodic tail. A null key: none."""
    h = F.crc32(key.cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    n = F.size(words).cast("long")
    g = F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole = F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)


def op12_periodic_runs(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = collapse_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.floor(1000 * F.col("strongest.length") / F.col("strongest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"),
    )
