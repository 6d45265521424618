"""Small field rules: units, keys, times, JSON, text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Feed confidence letters, freshness bounds in seconds.
CONFIDENCE_LETTERS = {"n": 50.0, "l": 25.0, "h": 100.0}
GREEN_S, AMBER_S = 60, 180
MISSING = -1.0

# Lines of the alert context block.
CONTEXT_LINES = (
    "[SYSTEM CONTEXT]\n"
    "Alert: %s, Severity: %s, Time: %s\n"
    "Affected Node: %s, GPU Count: %s\n"
    "Current GPU Utilization: %s%%\n"
    "Recent Alerts on this Node: %s in last 24h\n"
    "Recent K8s Events: %s\n"
    "[END SYSTEM CONTEXT]"
)


def kmh_to_ms(col: Column) -> Column:
    return col / F.lit(3.6)


def bytes_to_gb(col: Column) -> Column:
    return col / F.lit(1e9)


def sentinel_to_null(col: Column, sentinel: float = MISSING) -> Column:
    return F.nullif(col, F.lit(sentinel))


def firms_confidence(col: Column) -> Column:
    """Number, or the value of its letter, else 0."""
    by_letter = F.lit(0.0)
    for letter, value in CONFIDENCE_LETTERS.items():
        by_letter = F.when(F.lower(col) == letter, value).otherwise(by_letter)
    return F.coalesce(col.try_cast("double"), by_letter)


def mask_user_id(col: Column) -> Column:
    return F.sha2(col, 256)


def event_key(first: Column, second: Column) -> Column:
    return F.concat_ws(":", first, second)


def key_parts(key: Column) -> Column:
    """Parts before and after the first ``:``; a key without one is its own second part."""
    parts = F.split(key, ":", 2)
    whole = F.size(parts) < 2
    return F.struct(
        F.when(~whole, parts[0]).alias("first"),
        F.when(whole, key).otherwise(F.get(parts, F.lit(1))).alias("second"),
    )


def ts_of_ms(ms: Column) -> Column:
    """Timestamp without zone of epoch milliseconds."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("MILLISECOND", ms, epoch)


def ms_of_ts(ts: Column) -> Column:
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("MILLISECOND", epoch, ts.cast("timestamp_ntz"))


def trunc_ts(df: DataFrame, unit: str, col: str) -> Column:
    """``date_trunc`` that keeps a zone-free column zone-free."""
    return F.date_trunc(unit, F.col(col)).cast(df.schema[col].dataType)


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def freshness_class(age_s: Column) -> Column:
    return F.when(age_s < GREEN_S, "green").when(age_s <= AMBER_S, "amber").otherwise("red")


def rationale_text(crew: Column, kind: str, probability: Column) -> Column:
    """``Deploy <crew> to <zone kind> (prob 85%)``; ember zones speak of density."""
    zone, word = {"damage": ("high-damage zone", "prob"), "ember": ("ember risk zone", "density")}[kind]
    # Half-even on the scaled value, like Python's percent format.
    percent = F.bround(probability * 100).cast("int")
    return F.format_string(f"Deploy %s to {zone} ({word} %d%%)", crew, percent)


def context_string(
    title: Column, severity: Column, at: Column, host: Column, gpus: Column,
    utilisation: Column, alerts_24h: Column, events: Column,
) -> Column:
    text = lambda c, missing: F.coalesce(c.cast("string"), F.lit(missing))
    return F.format_string(
        CONTEXT_LINES, text(title, "Unknown Alert"), text(severity, "UNKNOWN"), text(at, ""),
        text(host, "unknown"), text(gpus, "0"), text(utilisation, "N/A"), text(alerts_24h, "N/A"),
        F.when(F.coalesce(events, F.lit("")) == "", "none").otherwise(events),
    )


def json_in(col: Column, schema: str | T.DataType) -> Column:
    return F.from_json(col, schema)


def json_out(col: Column) -> Column:
    return F.to_json(col)


def json_array_append(col: Column, value: Column) -> Column:
    """Append to an array kept as JSON text; repeats stay."""
    return F.to_json(F.array_append(F.from_json(col, "array<string>"), value))
