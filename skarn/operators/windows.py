"""Per-key ordered rules, top lists, unions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from skarn.operators.ordered import asof_last, cuts, join_keys, ordinal, piece_of, previous_row, running_total, top_n, with_piece

# Trend bounds of the loss slope.
IMPROVING, DIVERGING = -0.001, 0.001
#: Rows of a run that the gap rule folds as one array.
FOLD = 1024
#: Rows of a sorted table that are a top list; pages after them are found by counts.
DEEP = 10_000
# Order of time sensitivity.
SENSITIVITY = ("immediate", "high", "medium", "low")


def latest_per_key(
    df: DataFrame, keys: list[str], cols: list[str], ts: str, start, end, created: str | None = None
) -> DataFrame:
    """Latest row per key in an inclusive time window, requested columns that exist."""
    kind = df.schema[ts].dataType
    inside = df.filter((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) <= F.lit(end).cast(kind)))
    wanted = [c for c in dict.fromkeys(cols) if c in df.columns and c not in (*keys, ts)]
    extra = [created] if created and created in df.columns and created not in wanted else []
    order = F.struct(ts, *extra, *wanted)
    return inside.groupBy(*keys).agg(F.max(order).alias("r")).select(*keys, "r.*")


def counter_deltas(
    df: DataFrame, keys: list[str], ts: str, counters: list[str], cell: int | None = None
) -> DataFrame:
    """Increase of every counter since the previous scrape, 0 after a reset, from 0 at the first.

    A key has one value per time: of several scrapes at one instant the highest counts.
    """
    other = [c for c in df.columns if c not in {*keys, ts, *counters}]
    scrapes = df.groupBy(*keys, ts).agg(*[F.max(c).alias(c) for c in [*counters, *other]])
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*keys, ts]])
    first = scrapes.filter(~known).withColumn("_prev", F.lit(None).cast(scrapes.select(F.struct(*counters)).schema[0].dataType))
    scrapes = previous_row(scrapes.filter(known), keys, ts, counters, "_prev", cell=cell).unionByName(first)
    prior = {c: F.col(f"_prev.{c}") for c in counters}
    gain = lambda c: F.greatest(F.lit(0.0), F.col(c) - F.coalesce(prior[c], F.lit(0.0)))
    return scrapes.withColumns({f"{c}_delta": gain(c) for c in counters}).drop("_prev")


def last_points(training: DataFrame, n: int) -> DataFrame:
    return top_n(training, ["run_id"], [F.col("step").desc()], n)


def rolling_loss(training: DataFrame, n: int = 100, least: int = 5) -> DataFrame:
    """Mean loss of the last ``n`` points per run, null below ``least`` points."""
    mean = F.when(F.count("*") >= least, F.avg("train_loss"))
    return last_points(training, n).groupBy("run_id").agg(mean.alias("avg_loss"))


def loss_trend(training: DataFrame, n: int = 50, least: int = 10) -> DataFrame:
    """Least-squares slope of the last ``n`` losses on their index, and its verdict."""
    index = F.row_number().over(W.partitionBy("run_id").orderBy("step"))
    points = last_points(training, n).withColumn("_i", index.cast("double"))
    slope = F.when(F.count("*") >= least, F.regr_slope("train_loss", "_i"))
    verdict = (
        F.when(F.col("slope") < IMPROVING, "improving")
        .when(F.col("slope") > DIVERGING, "diverging")
        .when(F.col("slope").isNotNull(), "stalling")
    )
    return points.groupBy("run_id").agg(slope.alias("slope")).withColumn("trend", verdict)


def step_rate(training: DataFrame, runs: DataFrame | None = None, n: int = 10) -> DataFrame:
    """Steps and tokens per second over the last ``n`` points; ETA seconds where a run has max_steps."""
    ends = last_points(training, n).groupBy("run_id").agg(
        F.count("*").alias("_n"),
        F.min(F.struct("step", "timestamp_ms")).alias("_a"),
        F.max(F.struct("step", "timestamp_ms")).alias("_b"),
        F.avg("tokens_per_sec").alias("tokens_per_s"),
    )
    seconds = (F.col("_b.timestamp_ms") - F.col("_a.timestamp_ms")) / 1000
    rate = F.when(
        (F.col("_n") >= n) & (seconds > 0) & (F.col("tokens_per_s") > 0),
        (F.col("_b.step") - F.col("_a.step")) / seconds,
    )
    rated = ends.select("run_id", rate.alias("steps_per_s"), "tokens_per_s", F.col("_b.step").alias("step"))
    if runs is None:
        return rated.withColumn("eta_s", F.lit(None).cast("double"))
    limits = runs.select("run_id", "max_steps")
    left = F.col("max_steps") - F.col("step")
    eta = F.when((F.col("steps_per_s") > 0) & (left > 0), left / F.col("steps_per_s"))
    return rated.join(limits, "run_id", "left").withColumn("eta_s", eta).drop("max_steps")


def row_count_bound(df: DataFrame, ts: str, days: int = 7, k: float = 3.0) -> DataFrame:
    """Rows per day against mean +- k standard deviations of the days before.

    The window sees one row per day, already counted.
    """
    daily = df.groupBy(F.to_date(ts).alias("date")).agg(F.count("*").alias("n"))
    before = W.orderBy("date").rowsBetween(-days, -1)
    mean, spread = F.avg("n").over(before), F.stddev_samp("n").over(before)
    bounded = daily.withColumns({"low": mean - k * spread, "high": mean + k * spread})
    return bounded.withColumn(
        "ok", F.coalesce(F.col("n").between(F.col("low"), F.col("high")), F.lit(True))
    )


def action_dedup(
    actions: DataFrame,
    keys: list[str],
    ts: str,
    row_id: str = "id",
    seconds: int = 10,
    cell: int | None = None,
    fold: int = FOLD,
) -> DataFrame:
    """Per key in time order: a row is kept if none was kept in the seconds before it.

    Rows without a time wait for nothing and are kept.  Skipped rows do not extend the wait, so
    each decision depends on the one before.  Rows of one instant are first reduced to their lowest
    id (null ids last); rows that share key, instant and id stay together.

    A row that follows its key's previous instant by the gap or more is kept whatever came before it.
    Such rows cut a key into runs that do not depend on each other.  A run of up to ``fold`` instants
    is one short array, folded in order.  Longer runs, and keys that are cut for their number of rows
    (more than ``cell``), go by pieces (``_in_pieces``).
    """
    timed = actions.filter(F.col(ts).isNotNull()).withColumn("_instant", ordinal(actions, ts))
    at = timed.select(*keys, F.col("_instant").alias("_at"), F.col(row_id).alias("_id"))
    firsts = at.groupBy(*keys, "_at").agg(F.min("_id").alias("_id"))
    gap = seconds * (1000 if isinstance(actions.schema[ts].dataType, T.LongType) else 1_000_000)
    placed = join_keys(firsts, F.broadcast(cuts(firsts, keys, "_at", cell)), keys)
    cut = F.col("_starts").isNotNull()
    placed = placed.select(*keys, "_at", "_id", piece_of(F.col("_at"), F.col("_starts")).alias("_piece"), cut.alias("_cut"))
    order = W.partitionBy(*keys, "_piece").orderBy("_at")
    opens = F.coalesce(F.col("_at") - F.lag("_at").over(order) >= gap, F.lit(True))
    run = [*keys, "_piece", "_run"]
    runs = (
        placed.withColumn("_opens", opens.cast("int")).withColumn("_run", F.sum("_opens").over(order)).drop("_opens")
        .withColumn("_hard", F.col("_cut") | (F.count("*").over(W.partitionBy(*run)) > fold))
    )

    rows = runs.filter(~F.col("_hard")).groupBy(*run).agg(F.sort_array(F.collect_list(F.struct("_at", "_id"))).alias("_rows"))
    kind = rows.schema["_rows"].dataType
    none = F.struct(F.lit(None).cast(kind.elementType["_at"].dataType).alias("last"), F.array().cast(kind).alias("kept"))

    def step(done: Column, row: Column) -> Column:
        free = done["last"].isNull() | (row["_at"] - done["last"] >= gap)
        taken = F.struct(row["_at"].alias("last"), F.concat(done["kept"], F.array(row)).alias("kept"))
        return F.when(free, taken).otherwise(done)

    short = rows.select(*keys, F.explode(F.aggregate("_rows", none, step, lambda done: done["kept"])).alias("_row"))
    # The pieces of a cut key belong together, whatever runs they have.
    hard = runs.filter("_hard").withColumn("_run", F.when(F.col("_cut"), 0).otherwise(F.col("_run")))
    long = _in_pieces(hard.drop("_hard", "_cut"), [*keys, "_run"], gap)
    kept = short.select(*keys, "_row._at", "_row._id").unionByName(long.select(*keys, "_at", "_id"))
    wanted = kept.select(*keys, F.col("_at").alias("_instant"), F.col("_id").alias(row_id))
    decided = join_keys(timed, wanted, [*keys, "_instant", row_id], "left_semi").select(actions.columns)
    return decided.unionByName(actions.filter(F.col(ts).isNull()))


def _in_pieces(rows: DataFrame, run: list[str], gap: int) -> DataFrame:
    """Rows that the gap rule keeps of ``run, _piece, _at``, a piece at a time.

    A piece is summed up as "first time kept -> last time kept", the sums are chained per run, and each
    piece is then played from its entry.
    """
    group = [*run, "_piece"]
    fields = [rows.schema[c] for c in group]
    array = T.ArrayType(T.LongType())

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_at"].to_numpy())
        following = np.searchsorted(times, times + gap)
        last = times.copy()
        for i in range(len(times) - 1, -1, -1):
            if following[i] < len(times):
                last[i] = last[following[i]]
        # Only times within one gap of the piece's start can be the first kept one.
        some = min(int(np.searchsorted(times, times[0] + gap)) + 1, len(times))
        heads, exits = times[:some], last[:some]
        ends = np.flatnonzero(np.append(exits[1:] != exits[:-1], True))
        row = {c: pdf[c].iloc[0] for c in group}
        return pd.DataFrame([{**row, "heads": heads[ends].tolist(), "exits": exits[ends].tolist()}])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, entries = pdf.sort_values("_piece"), None, []
        for heads, exits in zip(pdf["heads"], pdf["exits"]):
            entries.append(last)
            i = 0 if last is None else int(np.searchsorted(heads, last + gap))
            if i < len(exits):
                last = int(exits[i])
        out = pdf[group].copy()
        out["_last"] = pd.array(entries, dtype="Int64")
        return out

    def replay(part: pa.Table, entry: pa.Table) -> pa.Table:
        part = part.sort_by("_at")
        times, last, kept = part["_at"].to_numpy(), entry["_last"][0].as_py(), []
        i = 0 if last is None else int(np.searchsorted(times, last + gap))
        while i < len(times):
            kept.append(i)
            i = int(np.searchsorted(times, times[i] + gap))
        return part.take(pa.array(kept, pa.int64()))

    sums = rows.groupBy(*group).applyInPandas(
        summarise, T.StructType([*fields, T.StructField("heads", array), T.StructField("exits", array)])
    )
    entries = sums.groupBy(*run).applyInPandas(chain, T.StructType([*fields, T.StructField("_last", T.LongType())]))
    return rows.groupBy(*group).cogroup(entries.groupBy(*group)).applyInArrow(replay, rows.schema)


def delivery_health(
    failures: DataFrame, key: str, ts: str, n: int = 3, seconds: int = 60, cell: int | None = None
) -> DataFrame:
    """Instants at which a key has more than ``n`` failures in the last seconds (both ends in).

    Failures are counted per instant first; the difference of two running totals cuts a hot key
    over many tasks.
    """
    unit = 1000 if isinstance(failures.schema[ts].dataType, T.LongType) else 1_000_000
    per_instant = (
        failures.select(key, ts, ordinal(failures, ts).alias("_at"))
        .groupBy(key, ts, "_at").agg(F.count("*").alias("_n"))
    )
    reach = seconds * unit
    upto = running_total(per_instant, [key], "_at", "_n", "_upto", cell=cell)
    floor = upto.withColumn("_floor", F.col("_at") - reach)
    counted = asof_last(
        floor, upto, [key], "_floor", "_at", ["_upto"], "_before", strict=True, cell=cell
    ).withColumn("failures", F.col("_upto") - F.coalesce("_before._upto", F.lit(0)))
    return counted.filter(F.col("failures") > n).select(key, ts, "failures")


def cell_ring_rank(cells: DataFrame, events: DataFrame, cell: int | None = None) -> DataFrame:
    """Cells of an event ranked outwards by distance from its epicentre (in degrees)."""
    centre = events.select(F.col("id").alias("event_id"), F.col("lat").alias("_y"), F.col("lng").alias("_x"))
    dy, dx = F.col("lat") - F.col("_y"), F.col("lng") - F.col("_x")
    away = (
        cells.join(centre, "event_id")
        .withColumn("_d", F.sqrt(dy * dy + dx * dx))
        .withColumn("_one", F.lit(1).cast("bigint"))
    )
    ranked = running_total(away, ["event_id"], "_d", "_one", "ring_rank", tie=["id"], cell=cell)
    return ranked.select(*cells.columns, "ring_rank")


def latest_n(df: DataFrame, keys: list[str], ts: str, tie: str, n: int) -> DataFrame:
    return top_n(df, keys, [F.col(ts).desc(), F.col(tie).desc()], n)


def newest(df: DataFrame, ts: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)


def top_damage(zones: DataFrame, n: int = 500) -> DataFrame:
    return zones.orderBy(F.col("damage_probability").desc(), F.col("id")).limit(n)


def pending_actions(actions: DataFrame) -> DataFrame:
    """Pending actions, most confident and newest first."""
    return actions.filter(F.col("status") == "pending").orderBy(
        F.col("confidence").desc(), F.col("created_at").desc(), F.col("id")
    )


def sensitivity_rank(col: Column) -> Column:
    rank = F.lit(len(SENSITIVITY))
    for i, name in enumerate(SENSITIVITY):
        rank = F.when(col == name, i).otherwise(rank)
    return rank


def action_priority(actions: DataFrame) -> DataFrame:
    ranked = actions.withColumn("priority", sensitivity_rank(F.col("time_sensitivity")))
    return ranked.orderBy("priority", F.col("confidence").desc(), "resource_id", "zone_id")


def sparkline(telemetry: DataFrame, n: int = 20) -> DataFrame:
    """Mean utilisation of the last ``n`` timestamps."""
    return telemetry.groupBy("ts").agg(F.avg("utilization_pct").alias("util")).orderBy(F.col("ts").desc()).limit(n)


def table_page(
    df: DataFrame, key: str, tie: str, desc: bool = False, page: int = 0, size: int = 25, *, cell: int | None = None
) -> DataFrame:
    """One page of a table sorted by a column: numbers as numbers, text without case, nulls as ''.

    The first ``DEEP`` rows are a top list. A page further down reads its own part of the table: the
    table is cut into pieces of the sort column (``ordered.cuts``), the rows of each are counted, and
    only the pieces that hold the page are put in order.
    """
    number = isinstance(df.schema[key].dataType, T.NumericType)
    value = F.col(key) if number else F.lower(F.coalesce(F.col(key).cast("string"), F.lit("")))
    order = value.desc_nulls_last() if desc else value.asc_nulls_first()
    skip = page * size
    if skip + size <= DEEP:
        return df.orderBy(order, tie).offset(skip).limit(size)
    cut = df.select(F.lit(0).alias("_all"), value.alias("_at"), F.struct(*df.columns).alias("_row"))
    placed = with_piece(cut, cuts(cut.select("_all", "_at"), ["_all"], "_at", cell), ["_all"], "_at")
    direction = F.col("_piece").desc() if desc else F.col("_piece").asc()
    upto = F.sum("_n").over(W.orderBy(direction).rowsBetween(W.unboundedPreceding, W.currentRow))
    pieces = placed.groupBy("_piece").agg(F.count("*").alias("_n")).select("_piece", "_n", upto.alias("_upto"))  # PIECES rows at most
    pieces = pieces.filter((F.col("_upto") > skip) & (F.col("_upto") - F.col("_n") < skip + size))
    held = placed.join(F.broadcast(pieces), "_piece")
    at = F.col("_at").desc_nulls_last() if desc else F.col("_at").asc_nulls_first()
    place = F.row_number().over(W.partitionBy("_piece").orderBy(at, f"_row.{tie}")) + F.col("_upto") - F.col("_n")
    found = held.withColumn("_place", place).filter((F.col("_place") > skip) & (F.col("_place") <= skip + size))
    return found.orderBy("_place").select("_row.*")


def recent_fire_coords(zones: DataFrame, n: int = 5) -> DataFrame:
    """The most recent distinct positions."""
    latest = zones.groupBy("lat", "lng").agg(F.max("seq").alias("seq"))
    return latest.orderBy(F.col("seq").desc()).limit(n).select("lat", "lng")


def top_events(events: DataFrame, n: int = 5) -> DataFrame:
    """Newest ``n`` events per pod."""
    return top_n(events, ["namespace", "pod_name"], [F.col("timestamp_ms").desc(), F.col("event_id").desc()], n)


def sync_status(sync: DataFrame) -> DataFrame:
    """Feeds by name with their last success and last status."""
    ok = F.max(F.when(F.col("status") == "ok", F.col("finished_at")))
    last = F.max(F.struct("finished_at", "event_id", "status"))["status"]
    return sync.groupBy("pipeline").agg(ok.alias("last_success"), last.alias("status")).orderBy("pipeline")


def merge_live_history(history: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """History with live points in place of, or besides, those of the same key."""
    both = history.withColumn("_p", F.lit(0)).unionByName(live.withColumn("_p", F.lit(1)))
    rest = [c for c in history.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("_p", *rest)).alias("r")).select(
        *keys, *[f"r.{c}" for c in rest]
    )


def unseen_events(new: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """New rows whose id was not seen before, each id once (its lowest row)."""
    rest = [c for c in new.columns if c != key]
    once = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return once.join(seen.select(key), key, "left_anti")


def action_union(*actions: DataFrame) -> DataFrame:
    """Actions of several rules in one frame, one per (resource, zone): the most urgent."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), actions)
    rest = [c for c in both.columns if c not in ("resource_id", "zone_id")]
    urgent = F.struct(
        sensitivity_rank(F.col("time_sensitivity")).alias("_s"), (-F.col("confidence")).alias("_c"), *rest
    )
    return both.groupBy("resource_id", "zone_id").agg(F.min(urgent).alias("r")).select(
        "resource_id", "zone_id", *[f"r.{c}" for c in rest]
    )


def lineage_edges(feeds: DataFrame) -> DataFrame:
    """Edges source -> feed and feed -> target."""
    into = feeds.select(F.explode("sources").alias("src"), F.col("name").alias("dst"))
    out = feeds.select(F.col("name").alias("src"), F.explode("targets").alias("dst"))
    return into.unionByName(out)


def action_lifecycle(events: DataFrame) -> DataFrame:
    """Current state per action from its create / approve / dismiss events."""
    order = F.struct("at", "seq", "status")
    return events.groupBy("id").agg(
        F.max(order)["status"].alias("status"),
        F.max(F.when(F.col("status") == "approved", F.col("at"))).alias("approved_at"),
        F.min("at").alias("created_at"),
    )


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """INSERT OR REPLACE by key: the row of the highest version stays, new over old on a tie."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    rest = [c for c in old.columns if c not in (*keys, version)]
    return both.groupBy(*keys).agg(F.max(F.struct(version, "_p", *rest)).alias("r")).select(
        *keys, f"r.{version}", *[f"r.{c}" for c in rest]
    )
