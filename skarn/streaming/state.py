"""Stateful per-key operators: alert and telemetry join, action de-duplication."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skarn.functions.fields import ms_of_ts
from skarn.session import ROCKSDB

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_PARTITIONS = "spark.sql.shuffle.partitions"
GPU = {
    "utilization_pct": "gpu_utilization_pct", "temperature_c": "gpu_temperature_c",
    "power_draw_w": "gpu_power_draw_w", "device_id": "gpu_device_id",
}
_GPU_SCHEMA = "gpu_utilization_pct double, gpu_temperature_c double, gpu_power_draw_w double, gpu_device_id string"


#: Partitions of the state, at least: executors that join after the start find some.
STORES = 24


def stores(spark: SparkSession) -> int:
    """Partitions of the state of a query that starts now: two for each core, never more than shuffles have.

    A partition of the state costs a store's commit and a Python task in every batch whether it holds rows
    or not, and adaptive execution does not join small ones in such a query.  A query that starts again
    keeps the number of its checkpoint.
    """
    return min(int(spark.conf.get(_PARTITIONS)), max(2 * spark.sparkContext.defaultParallelism, STORES))


@contextmanager
def rocksdb(spark: SparkSession):
    """RocksDB state store, in as many partitions as the cluster can use, for queries started inside the block."""
    settings = {_PROVIDER: ROCKSDB, _PARTITIONS: str(stores(spark))}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_OUT = ["alert", *GPU.values()]
_KINDS = {n: "float64" for n in list(GPU.values())[:3]}


#: Milliseconds of event time that no part of the waiting rows is cut inside of.
SPAN_MS = 21_600_000
#: Rows that are sorted together before they are cut into parts, and played together afterwards.
RUN_ROWS = 32_768
#: Rows of a part, at least, unless its run ends.
PART_ROWS = 512


class Timeline(StatefulProcessor):
    """Holds rows until the watermark has passed them, then plays them in time order.

    However rows are cut into Arrow batches and whatever their order, ``play`` sees the rows of a key
    in the order of their time, all rows of an instant at once.  Waiting rows are sorted in runs and a
    run is kept in parts of neighbouring spans of time, as many as give a part its rows, so the number
    of parts goes with the rows and not with the time they cover.  Playing merges the parts: it takes
    them by their first time and plays what lies before the first one not taken.  A key has one timer,
    at the earliest time at which something is due, so calls to the state go with parts and not with
    rows.  Input has ``at_ms``; rows without it are given to ``loose``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "part long", "rows binary")
        self.parts = handle.getValueState("parts", "parts binary")
        self.wake = handle.getValueState("wake", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, run, n = self._parts(), [], 0
        for chunk in rows:
            timeless = chunk["at_ms"].isna()
            if timeless.any():
                yield self.loose(chunk[timeless])
                chunk = chunk[~timeless]
            run.append(chunk)
            n += len(chunk)
            if n >= RUN_ROWS:
                self._hold(pd.concat(run), parts)
                run, n = [], 0
        if n:
            self._hold(pd.concat(run), parts)
        self._keep_parts(parts)
        self._wake_by(list(parts.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        parts = self._parts()
        due = sorted((first, part) for part, first in parts.items() if first <= now)
        rows, at = None, 0
        while at < len(due):
            taken, n = ([], 0) if rows is None else ([rows], -len(rows))
            while at < len(due) and n < RUN_ROWS:  # as many as were left over, and a run more
                part = due[at][1]
                taken.append(pickle.loads(self.held.getValue((part,))[0]))
                self.held.removeKey((part,))
                del parts[part]
                n += len(taken[-1])
                at += 1
            rows = pd.concat(taken)
            ready = rows["at_ms"] < (due[at][0] if at < len(due) else now + 1)
            if ready.any():
                yield from self.play(rows[ready])
            rows = rows[~ready]
        if rows is not None:
            self._hold(rows, parts)
        yield from self.rest(now)
        self._keep_parts(parts)
        self.wake.clear()
        self._wake_by([*parts.values(), *self.ends()])

    def _hold(self, rows: pd.DataFrame, parts: dict[int, int]) -> None:
        """Adds the parts of a run to the state and to ``parts``, whose highest number is the last."""
        rows = rows.sort_values("at_ms", kind="stable")
        times = rows["at_ms"].to_numpy().astype("int64")
        spans, start = times // SPAN_MS, 0
        while start < len(rows):
            stop = int(spans.searchsorted(spans[min(start + PART_ROWS, len(rows)) - 1], side="right"))
            part = next(reversed(parts), -1) + 1
            self.held.updateValue((part,), (pickle.dumps(rows.iloc[start:stop]),))
            parts[part] = int(times[start])
            start = stop

    def _parts(self) -> dict[int, int]:
        """First time of every part of the waiting rows."""
        return pickle.loads(self.parts.get()[0]) if self.parts.exists() else {}

    def _keep_parts(self, parts: dict[int, int]) -> None:
        if parts:
            self.parts.update((pickle.dumps(parts),))
        else:
            self.parts.clear()

    def _wake_by(self, times: list[int]) -> None:
        """Sets the key's timer to the earliest of these times, unless it is set to one before."""
        if not times:
            return
        at = min(times)
        if self.wake.exists():
            before = self.wake.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.wake.update((at,))

    def loose(self, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def play(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def rest(self, now: int) -> Iterator[pd.DataFrame]:
        """What is due at a time besides rows."""
        return iter(())

    def ends(self) -> list[int]:
        """Times at which ``rest`` has something to do, all after the present one."""
        return []

    def close(self) -> None:
        pass


class AlertGpuProcessor(Timeline):
    """Keeps the latest telemetry of a node and the alerts that wait for the next one.

    Both live for ``ttl_ms`` of event time: an older sample does not count for an alert, and an
    alert that waited that long leaves without telemetry.  Of samples at one instant the one of the
    highest device counts.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.latest = handle.getValueState("latest", f"at_ms long, {_GPU_SCHEMA}")
        self.waiting = handle.getListState("waiting", "at_ms long, alert string")

    def loose(self, rows: pd.DataFrame) -> pd.DataFrame:
        return self._bare(rows.loc[rows["is_alert"], "alert"].tolist())

    def play(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found = self._match(rows.sort_values(["at_ms", "gpu_device_id"], kind="stable", na_position="first"))
        if len(found):
            yield found[_OUT].astype(_KINDS)

    def rest(self, now: int) -> Iterator[pd.DataFrame]:
        limit = now - self.ttl_ms
        if self.latest.exists() and self.latest.get()[0] <= limit:
            self.latest.clear()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        done = [r[1] for r in held if r[0] <= limit]
        if done:
            self._keep([r for r in held if r[0] > limit])
            yield self._bare(done)

    def ends(self) -> list[int]:
        kept = [self.latest.get()[0]] if self.latest.exists() else []
        held = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        return [at + self.ttl_ms for at in kept + held]

    @staticmethod
    def _bare(alerts: list[str]) -> pd.DataFrame:
        bare = pd.DataFrame({"alert": alerts}).reindex(columns=_OUT)
        return bare.astype({**_KINDS, "gpu_device_id": "object"})

    def _keep(self, rows: list[tuple]) -> None:
        if rows:
            self.waiting.put([(int(at), alert) for at, alert in rows])
        else:
            self.waiting.clear()

    def _match(self, chunk: pd.DataFrame) -> pd.DataFrame:
        """Alerts of these rows and waiting ones against their samples and the kept sample."""
        fields = ["at_ms", *GPU.values()]
        samples = chunk.loc[~chunk["is_alert"], fields]
        if self.latest.exists():
            kept = pd.DataFrame([tuple(self.latest.get())], columns=fields)
            samples = pd.concat([kept, samples]) if len(samples) else kept
        if len(samples):
            samples = samples.sort_values("at_ms", kind="stable")
            self.latest.update((int(samples["at_ms"].iloc[-1]), *samples.iloc[-1, 1:].tolist()))
        asked = chunk.loc[chunk["is_alert"], ["at_ms", "alert"]]
        if self.waiting.exists():
            held = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=["at_ms", "alert"])
            asked = pd.concat([held, asked]).sort_values("at_ms", kind="stable")
        if asked.empty:
            return asked
        if samples.empty:
            hit = asked.reindex(columns=["at_ms", *_OUT])
            later = pd.Series(False, index=range(len(asked)))
        else:
            times, at = samples["at_ms"].to_numpy(), asked["at_ms"].to_numpy()
            back = times.searchsorted(at, side="right") - 1
            ahead = times.searchsorted(at, side="left").clip(max=len(times) - 1)
            fresh = (back >= 0) & (at - times[back] < self.ttl_ms)
            later = pd.Series(times[-1] >= at)
            soon = ~fresh & later.to_numpy() & (times[ahead] - at < self.ttl_ms)
            gpu = samples[list(GPU.values())].iloc[[b if f else a for b, a, f in zip(back, ahead, fresh)]]
            gpu = gpu.reset_index(drop=True).where(pd.Series(fresh | soon), axis=0)
            hit = pd.concat([asked.reset_index(drop=True), gpu], axis=1)
            later = later | pd.Series(fresh)
        wait = hit.reset_index(drop=True)[~later.to_numpy()]
        self._keep(list(zip(wait["at_ms"], wait["alert"])))
        return hit.reset_index(drop=True)[later.to_numpy()]


def alert_join(
    alerts: DataFrame, telemetry: DataFrame, ttl_seconds: int = 3600, alert_ts: str = "triggered_at",
    lateness: str = "30 seconds",
) -> DataFrame:
    """Alerts of a stream with telemetry of their node: the latest within the TTL, else the next one.

    The stream form of the batch join: an alert is decided once the watermark has passed its time, or
    that of the next sample; one that finds none leaves when its TTL has passed.
    """
    schema = alerts.schema
    none = {n: F.lit(None).cast("string" if n == "gpu_device_id" else "double").alias(n) for n in GPU.values()}
    asked = alerts.select(
        "node_id", F.lit(True).alias("is_alert"), ms_of_ts(F.col(alert_ts)).alias("at_ms"),
        F.to_json(F.struct(*alerts.columns)).alias("alert"), *none.values(),
    )
    told = telemetry.select(
        "node_id", F.lit(False).alias("is_alert"), F.col("timestamp_ms").alias("at_ms"),
        F.lit(None).cast("string").alias("alert"),
        *[F.col(c).cast("string" if c == "device_id" else "double").alias(n) for c, n in GPU.items()],
    )
    joined = (
        asked.unionByName(told).withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", lateness)
        .groupBy("node_id")
        .transformWithStateInPandas(
            AlertGpuProcessor(ttl_seconds * 1000), f"alert string, {_GPU_SCHEMA}", "append", "EventTime"
        )
    )
    return joined.select(F.from_json("alert", schema).alias("a"), *GPU.values()).select("a.*", *GPU.values())


class ActionGapProcessor(Timeline):
    """Passes a row only if none of its key passed during the gap before it.

    Of rows at one instant the lowest id counts; the time of the last row that passed leaves the
    state when the gap is over.
    """

    def __init__(self, gap_ms: int, columns: list[str]):
        self.gap_ms = gap_ms
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at_ms long")

    def loose(self, rows: pd.DataFrame) -> pd.DataFrame:
        return rows[self.columns]

    def play(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.sort_values(["at_ms", "row_id"], kind="stable")
        times, kept = rows["at_ms"].to_numpy(), []
        last = self.last.get()[0] if self.last.exists() else None
        i = 0 if last is None else int(times.searchsorted(last + self.gap_ms))
        while i < len(times):
            kept.append(i)
            last = int(times[i])
            i = int(times.searchsorted(last + self.gap_ms))
        if kept:
            self.last.update((last,))
            yield rows.iloc[kept][self.columns]

    def rest(self, now: int) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] + self.gap_ms <= now:
            self.last.clear()
        return iter(())

    def ends(self) -> list[int]:
        return [self.last.get()[0] + self.gap_ms] if self.last.exists() else []


def action_dedup(
    actions: DataFrame, keys: list[str], ts: str, row_id: str = "id", seconds: int = 10, lateness: str = "30 seconds"
) -> DataFrame:
    """Stream form of the gap rule: rows are decided in time order once the watermark has passed them.

    Rows without a time pass at once.
    """
    rows = actions.withColumn("at_ms", ms_of_ts(F.col(ts))).withColumn("row_id", F.col(row_id))
    timed = rows.withColumn("_event", F.timestamp_millis("at_ms")).withWatermark("_event", lateness)
    return timed.groupBy(*keys).transformWithStateInPandas(
        ActionGapProcessor(seconds * 1000, actions.columns), actions.schema, "append", "EventTime"
    )
