"""Costs against all ways through the automaton, slices against one piece, and renderings by hand."""

import itertools
import random

from skarn.llm import chat
from skarn.llm.chat import INSERT, MERGE, RELABEL, format_chats, op10_chat_formatting, repair, render, sweep

FOLDER = "/root/testdata/sf0.01"


def legal(roles):
    roles = roles[1:] if roles[:1] == [0] else roles
    return all(r == (1, 2)[i % 2] for i, r in enumerate(roles))


def cheapest(given):
    """Every choice of role and action, kept if the sequence it gives is legal."""
    best = None
    for roles in itertools.product(range(3), repeat=len(given)):
        for actions in itertools.product(("keep", "merge", "insert"), repeat=len(given)):
            out, cost, good = [], 0.0, not any(r == 0 != g for g, r in zip(given, roles))
            for g, r, a in zip(given, roles, actions):
                cost += (g != r) * RELABEL + {"keep": 0, "merge": MERGE, "insert": INSERT}[a]
                if a == "merge":
                    good &= out[-1:] == [r]
                else:
                    out += ([2 if r == 1 else 1] if a == "insert" else []) + [r]
            if good and legal(out) and (best is None or cost < best):
                best = cost
    return best


def test_costs():
    for n in range(1, 5):
        for given in itertools.product((0, 1, 2, None), repeat=n):
            total, _ = sweep(list(given), [0.0, *[float("inf")] * 3])
            assert min(total[1:]) == cheapest(given), given
            end = min(chat.ENDS, key=lambda e: total[e])
            steps = repair(list(given), 0, end)
            out = []
            for r, a in steps:
                out += [] if a == "merge" else ([2 if r == 1 else 1] if a == "insert" else []) + [r]
            assert legal(out)


def plain(turns):
    """One conversation, sorted, in one piece."""
    roles = [chat.role_of(r) for r, _ in turns]
    total, _ = sweep(roles, [0.0, *[float("inf")] * 3])
    return min(total[1:])


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()
    given = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        given.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = op10_chat_formatting(spark, FOLDER).collect()
    assert {r["conv_id"] for r in got} == set(given) and len(got) == len(given)
    for r in got:
        turns = given[r["conv_id"]]
        assert r["cost"] == plain(turns) and r["n_turns"] == len(turns)
        if r["cost"] == 0:
            assert r["text"] == "".join(f"<|{role}|>\n{text}\n" for role, text in turns)


def test_slices_change_nothing(spark, monkeypatch):
    rnd = random.Random(8)
    names = ["user", "assistant", "system", "Human", "gpt", None, "tool"]
    rows = [(c, t, rnd.choice(names), f"{c}-{t}") for c in range(6) for t in range(rnd.choice([1, 2, 40, 90]))]
    rows += [(9, None, "user", None), (9, 1, "user", "a"), (9, 1, "user", "a"), (None, 0, "assistant", "hi"), (7, 0, None, "")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, slice string")

    def whole():
        out = {}
        for r in sorted(format_chats(frame).collect(), key=lambda r: (str(r["conv_id"]), r["part"])):
            cost, n, text = out.get(r["conv_id"], (0, 0, ""))
            out[r["conv_id"]] = (cost + r["cost"], n + r["n_turns"], text + r["text"])
        return out

    at_once = whole()
    monkeypatch.setattr(chat, "SLICE", 3)
    assert whole() == at_once
    assert at_once[None] == (INSERT, 1, "<|user|>\n\n<|assistant|>\nhi\n")
    assert at_once[9] == (2 * MERGE, 3, "<|user|>\na\n\na\n\n\n")
    assert at_once[7] == (RELABEL, 1, "<|user|>\n\n")
    for c in range(6):
        turns = [(r, t) for k, _, r, t in rows if k == c]
        assert at_once[c][:2] == (plain(turns), len(turns))
    assert format_chats(frame.limit(0)).count() == 0


def test_rendering():
    assert render([(0, "keep"), (1, "keep"), (1, "merge"), (1, "insert")], list("abcd")) == "<|system|>\na\n<|user|>\nb\n\nc\n<|assistant|>\n\n<|user|>\nd\n"


def test_rows_do_not_depend_on_partitions(spark):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    found = []
    try:
        spark.conf.set(names[1], "false")
        for parts in (8, 40, 211):
            spark.conf.set(names[0], str(parts))
            found.append(sorted(tuple(map(str, r)) for r in op10_chat_formatting(spark, FOLDER).collect()))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert found[0] == found[1] == found[2]
    assert len(found[0]) == spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count()
