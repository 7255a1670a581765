"""Chat formatting: the cheapest repair of a conversation's roles, then its text.

Legal is an optional system turn, then user and assistant in turn, the assistant last. Dynamic
programming over that automaton chooses for every turn to keep it, relabel it, merge it into the turn
before or put an empty turn of the other speaker before it, at the least sum of costs. Among equally
cheap repairs the choice is fixed: turn by turn, the first of system, user and assistant that is on a
cheapest way, and a merge only where it is cheaper than an empty turn.

Turns stand in the order of ``turn``, then role, then text. A role other than the three, or null, always
needs a label; a null text is empty. Rows with a null ``conv_id`` are one conversation. A conversation of
any length is spread over tasks: the steps from state to state form small matrices, so a task needs of
its neighbours only the state in which it begins and the one in which it has to end. Repeated rows are
turns of their own. Empty tables give no rows. Only the four named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stringloom.llm.common import append_ends, stage, width

ROLES = ("system", "user", "assistant")
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
START, SYSTEM, USER, ASSISTANT = range(4)
# Empty turns needed before a turn of the column's role, by the state before it; system comes first or never.
_BEFORE = {
    SYSTEM: {START: ()},
    USER: {START: (), SYSTEM: (), ASSISTANT: (), USER: (ASSISTANT,)},
    ASSISTANT: {USER: (), START: (USER,), SYSTEM: (USER,), ASSISTANT: (USER,)},
}
_AFTER = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


class Costs:
    """What each choice costs; ``steps[role][before, after]`` is a turn's cheapest step and ``how`` its kind."""

    def __init__(self, merge: float = MERGE, relabel: float = RELABEL, insert: float = INSERT):
        self.steps, self.merges = [], []
        self.final = np.array([0.0, *(insert * len(_AFTER[s]) for s in (SYSTEM, USER, ASSISTANT))])
        for role in range(4):  # 0 stands for an unknown role
            step = np.full((4, 4), np.inf)
            merged = np.zeros((4, 4), bool)
            for after, befores in _BEFORE.items():
                for before, empty in befores.items():
                    step[before, after] = insert * len(empty) + relabel * (role != after)
            for state in (SYSTEM, USER, ASSISTANT):
                cost = merge + relabel * (role != state)
                if cost < step[state, state]:
                    step[state, state], merged[state, state] = cost, True
            self.steps.append(step)
            self.merges.append(merged)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).min(axis=1)


def matrix(roles: list[int], costs: Costs) -> np.ndarray:
    """Least cost from each state before the turns to each state after them."""
    out = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for role in roles:
        out = _times(out, costs.steps[role])
    return out


def path(roles: list[int], costs: Costs, begin: int, end: int) -> list[int]:
    """States after each turn on the cheapest way from ``begin`` to ``end``."""
    rest = [np.where(np.arange(4) == end, 0.0, np.inf)]
    for role in reversed(roles):
        rest.append((costs.steps[role] + rest[-1]).min(axis=1))
    rest.reverse()
    states, state = [], begin
    for role, after in zip(roles, rest[1:], strict=True):
        state = int(np.argmin(costs.steps[role][state] + after))
        states.append(state)
    return states


def _code(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def _tag(state: int) -> str:
    return f"<|{ROLES[state - 1]}|>\n"


def render(text: str, before: int, state: int, merged: bool, last: bool) -> str:
    """A turn's part of the conversation; the parts in order are its text."""
    end = "<|end|>\n"
    if merged:
        out = "\n" + text
    else:
        empty = "".join(_tag(s) + end for s in _BEFORE[state][before])
        out = (end if before != START else "") + empty + _tag(state) + text
    return out + (end + "".join(_tag(s) + end for s in _AFTER[state]) if last else "")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The turns (conversation, turn, role, text) of one conversation after the other, in a task's order."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def repair(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    costs: Costs | None = None, parts: int | None = None,
) -> DataFrame:
    """``conv_id, turn, role, action, inserted, segment``, one row per row of ``turns``.

    ``action`` is keep, relabel, merge or relabel and merge; ``inserted`` counts the empty turns before the
    turn and, at the last one, after it. The segments of a conversation in order are its rendered text.
    """
    costs = costs or Costs()
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col(c) for c in ("conv_id", "turn", "role", "text")]
    dealt = stage(append_ends(rows, order, parts or width(turns.sparkSession)), "turns")
    # Written files keep a task's rows and their order apart: they are dealt again by part and sorted alike.
    dealt = dealt.repartition(parts or width(turns.sparkSession), "_part").sortWithinPartitions("_part", "_row").select(
        "conv_id", "turn", "role", "text", "_part")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for part, groups in _by_part(batches):
            first = last = None
            for group in groups:
                first = first or group
                last = group
            for group in ([first] if first is last else [first, last]):
                out.append({"part": part, "conv": group[0][0], "steps": matrix([_code(r[2]) for r in group], costs).ravel().tolist()})
        kind = pa.schema([("part", pa.int64()), ("conv", pa.int64()), ("steps", pa.list_(pa.float64()))])
        yield pa.RecordBatch.from_pylist(out, kind)

    # At most two rows per task: the conversations in which it begins and ends.
    border = dealt.mapInArrow(ends, "part bigint, conv bigint, steps array<double>").collect()
    ways = _ways(border, costs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, groups in _by_part(batches):
            out: list[tuple] = []
            for group in groups:
                roles = [_code(r[2]) for r in group]
                way = ways.get((part, group[0][0]))
                if way is None:
                    end = int(np.argmin(matrix(roles, costs)[START] + costs.final))
                    way = (START, end, True)
                begin, end, closes = way
                out += _told(group, roles, path(roles, costs, begin, end), begin, closes, costs)
                if len(out) >= 4096:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return dealt.mapInArrow(work, "conv_id bigint, turn bigint, role string, action string, inserted int, segment string")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[list[tuple]]]]:
    """Each part's number and its conversations; a task may hold several parts."""
    runs = _runs(batches)
    current = next(runs, None)
    while current is not None:
        part = current[0]
        following: list = [current]

        def own(part: int = part, following: list = following) -> Iterator[pa.RecordBatch]:
            while following[0] is not None and following[0][0] == part:
                yield following[0][1]
                following[0] = next(runs, None)

        yield part, _groups(own())
        current = following[0]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        parts = batch.column(4).to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield int(parts[a]), batch.slice(a, b - a)


def _ways(border: list, costs: Costs) -> dict[tuple[int, int | None], tuple[int, int, bool]]:
    """For conversations in several parts: the states in which each part begins and ends, and whether it is the last."""
    shares: dict[int | None, list] = {}
    for row in sorted(border, key=lambda r: r["part"]):
        shares.setdefault(row["conv"], []).append((row["part"], np.array(row["steps"]).reshape(4, 4)))
    ways = {}
    for conv, own in shares.items():
        if len(own) < 2:
            continue
        rest = [costs.final]
        for _, steps in reversed(own):
            rest.append((steps + rest[-1]).min(axis=1))
        rest.reverse()
        state = START
        for i, (part, steps) in enumerate(own):
            after = int(np.argmin(steps[state] + rest[i + 1]))
            ways[part, conv] = (state, after, i == len(own) - 1)
            state = after
    return ways


def _told(group: list[tuple], roles: list[int], states: list[int], begin: int, closes: bool, costs: Costs) -> list[tuple]:
    out, before = [], begin
    for i, ((conv, turn, _, text), role, state) in enumerate(zip(group, roles, states, strict=True)):
        merged = bool(costs.merges[role][before, state])
        last = closes and i == len(group) - 1
        words = (["relabel"] if role != state else []) + (["merge"] if merged else [])
        inserted = (0 if merged else len(_BEFORE[state][before])) + (len(_AFTER[state]) if last else 0)
        out.append((conv, turn, ROLES[state - 1], " and ".join(words) or "keep", inserted, render(text, before, state, merged, last)))
        before = state
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
    names = ["conv_id", "turn", "role", "action", "inserted", "segment"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
