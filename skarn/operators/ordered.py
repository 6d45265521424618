"""Ordered work per key that does not depend on how rows spread over the keys.

A window partitioned by key alone puts the whole of a hot key into one task.  The functions here
cut keys with many rows into *pieces* of the order axis, by the number of rows and not by a fixed
width, so a burst of one hour is cut like a year.  Keys are counted first, on narrow rows that
collapse before the shuffle.  The ``KEYS`` largest of those over ``CUT_ROWS`` rows are cut into
``PIECES`` pieces at most; any other key holds less than 1 / KEYS of the rows.  The places to cut
come from a sample of the key's order values that is taken by their hash, so it has the same values
wherever and how often it is taken.  What crosses from piece to piece (a running total, the last seen
row) is one row per piece.  All of this is bounded by KEYS * PIECES rows, which is what is broadcast.
Nothing runs before the query does: without a key to cut, Spark drops the joins as it finds out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

#: Width of a cell of time, in milliseconds.
DAY_MS = 86_400_000
#: Cells per doubling of a measured value.
PER_OCTAVE = 16
#: A key with more rows is cut, if it is one of the ``KEYS`` largest, into ``PIECES`` (a power of two) at most.
CUT_ROWS, KEYS, PIECES = 1 << 18, 2048, 512
#: Sampled order values per piece.
PER_PIECE = 32


def ordinal(df: DataFrame, col: str) -> Column:
    """Numeric position of an orderable column; timestamps become microseconds."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.TimestampNTZType):
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(col))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    return F.col(col)


def cell_width(kind: T.DataType) -> int:
    """Default width of a cell in the units of ``ordinal``: a day; numbers count as epoch milliseconds."""
    return DAY_MS * (1000 if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else 1)


def cell_of(df: DataFrame, col: str, cell: int | None = None) -> Column:
    """Cell of an orderable column; it never falls where the column rises.

    Floating-point values have ``cell`` cells per doubling, others are cut every ``cell`` units.
    """
    kind = df.schema[col].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = F.col(col).cast("double")
        return F.floor(F.signum(x) * F.log2(1 + F.abs(x)) * (cell or PER_OCTAVE)).cast("bigint")
    return F.floor(ordinal(df, col) / F.lit(cell or cell_width(kind))).cast("bigint")


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches null keys, keeping one copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__{k}" for k in keys])


def cuts(df: DataFrame, keys: list[str], at: str, rows: int | None = None) -> DataFrame:
    """``keys, _starts``: the values of ``at`` with which the pieces of a key but the first begin.

    Only of keys that are cut; ``_starts`` rises and has ``PIECES - 1`` values at most.
    """
    rows = rows or CUT_ROWS
    load = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    load = load.orderBy(F.col("_n").desc(), *keys).limit(KEYS)
    # Every 1 / every of the values, by their hash: about PIECES * PER_PIECE of them, fewer if values repeat.
    some = join_keys(df.select(*keys, at), F.broadcast(load), keys, "inner")
    every = F.ceil(F.col("_n") / (PIECES * PER_PIECE))
    some = some.filter(F.pmod(F.xxhash64(at), every) == 0)
    found = some.groupBy(*keys).agg(F.sort_array(F.collect_set(at)).alias("_some"), F.max("_n").alias("_n"))
    pieces = F.least(F.lit(PIECES), F.ceil(F.col("_n") / rows), F.size("_some")).cast("int")
    place = lambda i: (i.cast("bigint") * F.size("_some") / pieces).cast("int")
    starts = F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.get("_some", place(i)))
    return found.filter(pieces > 1).select(*keys, starts.alias("_starts"))


def piece_of(at: Column, starts: Column) -> Column:
    """Number of ``starts`` at or below a value, by halving steps; 0 for a key that is not cut."""
    steps = F.array(*[F.lit(PIECES >> k) for k in range(1, PIECES.bit_length())])
    down = F.aggregate(steps, F.lit(0), lambda done, step: F.when(F.get(starts, done + step - 1) <= at, done + step).otherwise(done))
    return F.when(starts.isNull() | at.isNull(), F.lit(0)).otherwise(down)


def with_piece(df: DataFrame, where: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The rows of a frame with the number of their piece, ``_piece``."""
    met = join_keys(df, F.broadcast(where), keys)
    return met.withColumn("_piece", piece_of(F.col(at), F.col("_starts"))).drop("_starts")


def _cut_rows(df: DataFrame, where: DataFrame, keys: list[str], at: str) -> DataFrame:
    """As ``with_piece``, of cut keys only."""
    met = join_keys(df, F.broadcast(where), keys, "inner")
    return met.withColumn("_piece", piece_of(F.col(at), F.col("_starts"))).drop("_starts")


def _all_pieces(where: DataFrame, keys: list[str]) -> DataFrame:
    return where.select(*keys, F.explode(F.sequence(F.lit(0), F.size("_starts"))).alias("_piece"))


def running_total(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    out: str,
    *,
    tie: list[str] | None = None,
    cell: int | None = None,
) -> DataFrame:
    """Cumulative sum of ``value`` per key in the order of a column (then ``tie``).

    Keys with more than ``cell`` rows are cut (``CUT_ROWS`` if not given).
    """
    where = cuts(df, keys, order, cell)
    cut = with_piece(df, where, keys, order)
    inner = (
        W.partitionBy(*keys, "_piece").orderBy(order, *(tie or []))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        _cut_rows(df, where, keys, order).groupBy(*keys, "_piece").agg(F.sum(value).alias("_n"))
        .select(*keys, "_piece", F.sum("_n").over(before).alias("_offset"))
    )
    inside = cut.withColumn(out, F.sum(value).over(inner))
    total = join_keys(inside, F.broadcast(offsets), [*keys, "_piece"])
    return total.withColumn(out, F.when(F.col("_offset").isNull(), F.col(out)).otherwise(F.col(out) + F.col("_offset"))).drop("_piece", "_offset")


def previous_row(df: DataFrame, keys: list[str], at: str, cols: list[str], out: str, *, cell: int | None = None) -> DataFrame:
    """Rows with the struct of ``cols`` of the key's row before; a key has one row per value of ``at``."""
    narrow = df.select(*keys, ordinal(df, at).alias("_at"), F.struct(*cols).alias("_own"))
    where = cuts(narrow, keys, "_at", cell)
    ends = _cut_rows(narrow, where, keys, "_at").groupBy(*keys, "_piece").agg(F.max_by("_own", "_at").alias("_last"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    entry = ends.select(*keys, "_piece", F.last("_last", ignorenulls=True).over(before).alias("_entry"))
    placed = with_piece(df.withColumn("_at", ordinal(df, at)), where, keys, "_at")
    prior = F.lag(F.struct(*cols)).over(W.partitionBy(*keys, "_piece").orderBy("_at"))
    met = join_keys(placed.withColumn("_prior", prior), F.broadcast(entry), [*keys, "_piece"])
    return met.select(*df.columns, F.coalesce("_prior", "_entry").alias(out))


def asof_last(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_ts: str,
    right_ts: str,
    cols: list[str],
    out: str = "_match",
    *,
    forward: bool = False,
    strict: bool = False,
    tie: str | None = None,
    cell: int | None = None,
) -> DataFrame:
    """Left rows plus ``out``: a struct of the nearest earlier right row of the same key.

    Equal times match unless ``strict``; ``forward`` looks for the nearest later row.  The
    struct holds ``ts`` (time of the match) and ``cols``; of right rows at one instant the one of
    the highest ``tie``, then of the highest struct, counts.  A key with a null matches nothing.
    Left rows are never multiplied.  Both sides are laid on one time axis and a window carries the
    last right row along, so there is no range join.  Keys with more than ``cell`` rows on both
    sides together are cut (``CUT_ROWS`` if not given); each piece is entered by the last right row
    of the pieces before it.  The left rows of one instant stay together.
    """
    sign = -1 if forward else 1
    # Order inside one instant: right rows first, unless the match has to be strictly earlier.
    left_flag, right_flag = (0, 1) if strict else (1, 0)
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(on)]
    names = [f"_k{i}" for i in range(len(on))]
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on], F.lit(True))
    found = F.struct(F.col(right_ts).alias("ts"), *[F.col(c) for c in cols])
    kind = right.select(found.alias("f")).schema[0].dataType
    tie_col = F.col(tie) if tie else F.lit(None).cast("bigint")
    lefts = left.filter(known)
    rights = right.filter(known & F.col(right_ts).isNotNull())
    left_at, right_at = (sign * ordinal(left, left_ts)).alias("_at"), (sign * ordinal(right, right_ts)).alias("_at")
    where = cuts(lefts.select(*keys, left_at).unionByName(rights.select(*keys, right_at)), names, "_at", cell)
    rows = lefts.select(
        *keys, left_at,
        F.lit(left_flag).alias("_flag"),
        F.struct(*left.columns).alias("_row"),
        F.lit(None).cast(kind).alias("_found"),
    )
    # One right row per (key, instant).
    seen = (
        rights.select(*keys, right_at, tie_col.alias("_tie"), found.alias("_found"))
        .groupBy(*names, "_at").agg(F.max(F.struct("_tie", "_found"))["_found"].alias("_found"))
    )
    no_row = F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")
    placed = with_piece(
        rows.unionByName(seen.select(*names, "_at", F.lit(right_flag).alias("_flag"), no_row, "_found")), where, names, "_at"
    )
    # What each piece but the first is entered with.
    ends = _cut_rows(seen, where, names, "_at").groupBy(*names, "_piece").agg(F.max_by("_found", "_at").alias("_found"))
    every = _all_pieces(where, names).unionByName(ends, allowMissingColumns=True)
    before = W.partitionBy(*names).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        every.groupBy(*names, "_piece").agg(F.max("_found").alias("_found"))
        .withColumn("_found", F.last("_found", ignorenulls=True).over(before))
        .filter(F.col("_found").isNotNull())
        .select(
            *names, F.lit(-(1 << 62)).cast(rows.schema["_at"].dataType).alias("_at"), F.lit(-1).alias("_flag"), no_row, "_found", "_piece"
        )
    )
    win = (
        W.partitionBy(*names, "_piece").orderBy("_at", "_flag")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    matched = (
        placed.unionByName(carried)
        .withColumn("_found", F.last("_found", ignorenulls=True).over(win))
        .filter(F.col("_row").isNotNull())
        .select("_row.*", F.col("_found").alias(out))
    )
    return matched.unionByName(left.filter(~known).withColumn(out, F.lit(None).cast(kind)))


def summarise(
    df: DataFrame,
    keys: list[str],
    aggs: list[Column],
    percentiles: dict[str, tuple[str, float]],
    *,
    exact: bool = True,
    cell: int | None = None,
) -> DataFrame:
    """``groupBy(keys)`` with plain aggregates and percentiles ``{name: (column, p)}``.

    ``exact=False`` takes the mergeable sketch.  Exact percentiles interpolate linearly; they come
    from counts per distinct value and a running total over pieces, since the built-in aggregate
    would gather all values of a group in one task.
    """
    if not exact:
        sketches = [F.percentile_approx(c, p).alias(n) for n, (c, p) in percentiles.items()]
        return df.groupBy(*keys).agg(*aggs, *sketches)
    result = df.groupBy(*keys).agg(*(aggs or [F.lit(True).alias("_any")]))
    if not keys:
        df, result = df.withColumn("_all", F.lit(0)), result.withColumn("_all", F.lit(0))
    for column in dict.fromkeys(c for c, _ in percentiles.values()):
        wanted = {n: p for n, (c, p) in percentiles.items() if c == column}
        result = join_keys(result, _percentiles(df, keys or ["_all"], column, wanted, cell), keys or ["_all"])
    return result.drop("_any", "_all")


def merge_by_key(keys: list[str], *parts: DataFrame) -> DataFrame:
    """Frames with one row per key and distinct columns, side by side (full outer).

    A union and one aggregate: one shuffle however many parts, and none of them can multiply.  Of a
    part with several rows per key the highest whole row counts, never a mixture of them.
    """
    own = [[c for c in p.columns if c not in keys] for p in parts]
    rows = [p.select(*keys, F.struct(*cs).alias(f"_p{i}")) for i, (p, cs) in enumerate(zip(parts, own))]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    merged = stacked.groupBy(*keys).agg(*[F.max(f"_p{i}").alias(f"_p{i}") for i in range(len(parts))])
    return merged.select(*keys, *[F.col(f"_p{i}.{c}").alias(c) for i, cs in enumerate(own) for c in cs])


def _percentiles(
    df: DataFrame, keys: list[str], column: str, wanted: dict[str, float], cell: int | None
) -> DataFrame:
    """``keys`` and the wanted percentiles: rank and value from counts per distinct value.

    A group's values are counted first, so a value that many rows share is one row.  A group with more
    than ``cell`` distinct values is cut, each piece knows how many values and rows are before it.
    """
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    where = cuts(counts, keys, "_v", cell)
    pieces = _cut_rows(counts, where, keys, "_v").groupBy(*keys, "_piece").agg(F.sum("_n").alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    entry = pieces.select(
        *keys, "_piece", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(W.partitionBy(*keys)).alias("_total"),
    )
    group = W.partitionBy(*keys, "_piece")
    inner = group.orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = with_piece(counts, where, keys, "_v").withColumns({"_upto": F.sum("_n").over(inner), "_all": F.sum("_n").over(group)})
    met = join_keys(placed, F.broadcast(entry), [*keys, "_piece"])
    last = F.coalesce("_total", "_all") - 1
    upto = F.col("_upto") + F.coalesce("_offset", F.lit(0))
    holds = lambda rank: (upto - F.col("_n") <= rank) & (rank < upto)
    at = lambda rank: F.max(F.when(holds(rank), F.col("_v")))

    parts, results = [], []
    for name, p in wanted.items():
        pos = F.lit(p) * last
        parts += [
            at(F.floor(pos)).alias(f"_{name}_lo"),
            at(F.ceil(pos)).alias(f"_{name}_hi"),
            F.max(pos - F.floor(pos)).alias(f"_{name}_w"),
        ]
        lo, hi, w = (F.col(f"_{name}_{x}") for x in ("lo", "hi", "w"))
        results.append((lo + (hi - lo) * w).alias(name))
    return met.groupBy(*keys).agg(*parts).select(*keys, *results)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key.  Spark limits every map task to ``n`` per key before the shuffle."""
    win = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(win)).filter(F.col("_rank") <= n).drop("_rank")
