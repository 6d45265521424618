"""Chat formatting with minimum-cost role repair.

A legal conversation is at most one system turn, then user and assistant in turn, the user first.
An automaton says so: its states are start, after system, after user, after assistant. Each given
turn takes one action, and dynamic programming finds the cheapest actions for the whole sequence:

    keep       the turn as it is, where its role may follow                           0
    merge      into the turn before, of the same role (after a relabel or not)        MERGE
    relabel    to user or assistant                                                   RELABEL
    insert     one empty turn of the other role before it                             INSERT

``ALIASES`` are read as their role free of charge; an unknown or null role must be relabelled. No
turn is made a system turn; a late one is relabelled. Of equal costs, the state named first and the action named first win. The repaired sequence is
rendered turn by turn: ``<|role|>``, a line end, the text, a line end; merged texts are joined by an
empty line, and an empty turn has the empty text.

A conversation may have any number of turns. Rows are sorted by conversation and turn in ranges (a
long conversation spans several) and numbered in slices of ``SLICE`` turns. What a slice does to the
automaton is a matrix of costs from each state to each state, so the slices of a conversation are
worked on apart, their matrices are combined in order (one small row per slice), and each slice
then finds its actions between the two states it was given. The result has a row per slice; most
conversations are one slice, and a longer one is the concatenation of its slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from skarn.llm.common import slices, table, written

MERGE, RELABEL, INSERT = 1.0, 3.0, 2.0
SLICE = 4096
ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "sys": "system", "developer": "system"}
#: States: 0 start, then after the role at that place of ROLES.
FIRST, STATES, NEVER = 0, 4, float("inf")
#: States a conversation may end in; the start is that of a conversation without turns.
ENDS = (1, 2, 3)


def role_of(name: str | None) -> int | None:
    """Place in ROLES of a given name; None if it is none."""
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else None


def _steps(state: int, role: int) -> list[tuple[float, str]]:
    """Ways to put a turn of a role after a state, the cheapest first."""
    if role == 0:
        return [(0.0, "keep")] if state == 0 else [(MERGE, "merge")] if state == 1 else []
    if state == role + 1:
        return sorted([(MERGE, "merge"), (INSERT, "insert")])
    if role == 1:
        return [(0.0, "keep")]
    return [(0.0, "keep")] if state == 2 else [(INSERT, "insert")]


def _table() -> list[list[tuple[int, int, float, str]]]:
    """For each given role (the last: none): state, next state, cost, action, in order of preference."""
    out = []
    for given in (0, 1, 2, None):
        rows = []
        for state in range(STATES):
            for role in range(0 if given == 0 else 1, 3):
                extra = 0.0 if role == given else RELABEL
                for cost, action in _steps(state, role)[:1]:
                    rows.append((state, role + 1, cost + extra, action))
        out.append(rows)
    return out


MOVES = _table()


def sweep(roles: list[int | None], entry: list[float]) -> tuple[list[float], list[list[tuple[int, str] | None]]]:
    """Cheapest costs of each state after the turns, and how each was reached."""
    cost, back = entry, []
    for given in roles:
        after, how = [NEVER] * STATES, [None] * STATES
        for state, to, extra, action in MOVES[3 if given is None else given]:
            if cost[state] + extra < after[to]:
                after[to], how[to] = cost[state] + extra, (state, action)
        cost = after
        back.append(how)
    return cost, back


def repair(roles: list[int | None], entry: int, end: int) -> list[tuple[int, str]]:
    """Role and action of each turn on the cheapest way from state to state."""
    _, back = sweep(roles, [0.0 if s == entry else NEVER for s in range(STATES)])
    out, state = [], end
    for how in reversed(back):
        before, action = how[state]
        out.append((state - 1, action))
        state = before
    return out[::-1]


def _turn(role: int, text: str) -> str:
    return f"<|{ROLES[role]}|>\n{text}\n"


def render(steps: list[tuple[int, str]], texts: list[str]) -> str:
    """The repaired turns as text; a merge at the start continues what came before."""
    out = []
    for (role, action), text in zip(steps, texts):
        if action == "merge":
            out.append(f"\n{text}\n")
            continue
        if action == "insert":
            out.append(_turn(2 if role == 1 else 1, ""))
        out.append(_turn(role, text))
    return "".join(out)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers sorted rows: their range, the number of their conversation's first row in it, and their own place from there."""
    part, row, first, last = TaskContext.get().partitionId(), 0, 0, None
    for b in batches:
        bases, places = [], []
        for conv in b.column("conv").to_pylist():
            if conv != last or row == 0:
                first, last = row, conv
            bases.append((part << 40) + first)
            places.append(row - first)
            row += 1
        added = {"rng": pa.array([part] * b.num_rows, pa.int32()), "base": pa.array(bases, pa.int64()), "n": pa.array(places, pa.int64())}
        yield pa.RecordBatch.from_arrays([*b.columns, *added.values()], [*b.schema.names, *added])


def _sliced(rows: DataFrame) -> DataFrame:
    """Rows of ``_number`` with ``slice`` and ``at``: every SLICE turns of a conversation, wherever ranges end.

    Only the first conversation of a range can have begun in one before it, so what is added to its
    numbers is a row per range at most.
    """
    by_range = Window.partitionBy("conv").orderBy("rng")
    held = rows.groupBy("conv", "rng").agg(F.count("*").alias("rows"), F.min("base").alias("base"))
    before = F.sum("rows").over(by_range.rowsBetween(Window.unboundedPreceding, -1)).alias("before")
    start = F.first("base").over(by_range.rowsBetween(Window.unboundedPreceding, 0)).alias("start")
    carried = held.select("rng", "base", before, start).where("before > 0")
    place = F.col("n") + F.coalesce("before", F.lit(0))
    met = rows.join(F.broadcast(carried), ["rng", "base"], "left")
    numbered = met.withColumn("place", place).withColumn("slice", F.coalesce("start", "base") + F.floor(F.col("place") / SLICE))
    return numbered.select("conv", "turn", "role", "text", "slice", (F.col("place") % SLICE + 1).cast("int").alias("at"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each slice, from rows sorted by slice; at most SLICE at a time."""
    rows: list[dict] = []
    for b in slices(batches, 2048):
        for row in b.to_pylist():
            if rows and rows[0]["slice"] != row["slice"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    part = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield pa.RecordBatch.from_pylist(part, schema)
            part = []
    yield pa.RecordBatch.from_pylist(part, schema)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for turns in _runs(batches):
            roles = [role_of(t["role"]) for t in turns]
            # A slice whose turns start at one of a conversation is asked for from all states: it may be a later one.
            costs = [sweep(roles, [0.0 if s == e else NEVER for s in range(STATES)])[0] for e in range(STATES)]
            yield {"slice": turns[0]["slice"], "costs": [x for row in costs for x in row]}

    return _batched(rows(), pa.schema([("slice", pa.int64()), ("costs", pa.list_(pa.float64()))]))


@F.pandas_udf(ArrayType(StructType().add("slice", "long").add("entry", "integer").add("end", "integer").add("cost", "double")))
def _chain(matrices: pd.Series) -> pd.Series:
    out = []
    for slices in matrices:
        total, back = [0.0] + [NEVER] * (STATES - 1), []
        for s in slices:
            costs = s["costs"]
            options = [[(total[e] + costs[e * STATES + to], e) for e in range(STATES)] for to in range(STATES)]
            best = [min(o) for o in options]
            back.append([e for _, e in best])
            total = [c for c, _ in best]
        state, found = min(ENDS, key=lambda e: total[e]), []
        for s, ways in zip(reversed(slices), reversed(back)):
            entry = ways[state]
            found.append({"slice": s["slice"], "entry": entry, "end": state, "cost": s["costs"][entry * STATES + state]})
            state = entry
        out.append(found[::-1])
    return pd.Series(out, dtype=object)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, part, n_turns, cost, roles, actions, text``: a row per slice of a conversation.

    ``part`` counts the slices of a conversation from 0; ``roles`` and ``actions`` are those of the
    given turns, in order of ``turn`` (nulls last), then role and text. Turns of one number and
    repeated rows are turns of their own. A null text is empty, a null ``conv_id`` a conversation.
    Other columns are not read.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # repeated rows can be dealt apart
    order = ["conv", F.col("turn").asc_nulls_last(), "role", "text", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"conv {types['conv']}, turn {types['turn']}, role string, text string, rng int, base long, n long"
    rows = _sliced(written(rows.mapInArrow(_number, schema), "turns"))

    dealt = rows.select("slice", "at", "role").repartition("slice").sortWithinPartitions("slice", "at")
    matrices = dealt.mapInArrow(_matrices, "slice long, costs array<double>")
    slices = rows.where("at = 1").select("slice", "conv")
    chained = slices.join(matrices, "slice").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("slice", "costs"))).alias("m"))
    ways = chained.select("conv", F.posexplode(_chain("m")).alias("part", "w")).select("part", "w.*")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def each():
            for found in _runs(batches):
                first = found[0]
                steps = repair([role_of(t["role"]) for t in found], first["entry"], first["end"])
                yield {
                    "conv_id": first["conv"], "part": first["part"], "n_turns": len(found), "cost": first["cost"],
                    "roles": [ROLES[r] for r, _ in steps], "actions": [a for _, a in steps], "text": render(steps, [t["text"] for t in found]),
                }

        kind = pa.schema([("conv_id", conv_type), ("part", pa.int32()), ("n_turns", pa.int32()), ("cost", pa.float64()), ("roles", pa.list_(pa.string())), ("actions", pa.list_(pa.string())), ("text", pa.string())])
        return _batched(each(), kind)

    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(rows.schema["conv"].dataType)
    # Dealt after the join, which may be split at large keys: a slice has to be in one task.
    both = rows.join(ways, "slice").repartition("slice").sortWithinPartitions("slice", "at")
    return both.mapInArrow(apply, f"conv_id {types['conv']}, part int, n_turns int, cost double, roles array<string>, actions array<string>, text string")


def op10_chat_formatting(spark, folder: str) -> DataFrame:
    return format_chats(table(spark, folder, "conversations"))
