"""Role repair against an exhaustive search over all ways to repair a short conversation."""

import itertools
import random

import pytest

from stringloom.llm import chat

LEGAL = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def cheapest(roles):
    """Least cost over every choice of label, merge and up to two empty turns before each turn and after the last."""
    best = float("inf")
    gaps = [()] + [g for n in (1, 2) for g in itertools.product(chat.ROLES, repeat=n)]
    states = {"": 0.0}
    for role in roles:
        found = {}
        for (state, cost), label in itertools.product(states.items(), chat.ROLES):
            change = 2 * (label != role)
            if state == label:
                found[label] = min(found.get(label, best), cost + change + 1)
            for gap in gaps:
                at = state
                for step in (*gap, label):
                    at = step if at is not None and step in LEGAL[at] else None
                if at is not None:
                    found[at] = min(found.get(at, best), cost + change + 3 * len(gap))
        states = found
    for state, cost in states.items():
        for gap in gaps:
            at = state
            for step in gap:
                at = step if at is not None and step in LEGAL[at] else None
            if at == "assistant":
                best = min(best, cost + 3 * len(gap))
    return best


def parse(text):
    turns = []
    while text:
        assert text.startswith("<|")
        role, _, rest = text[2:].partition("|>\n")
        body, _, text = rest.partition("<|end|>\n")
        turns.append((role, body))
    return turns


def rows_of(seed, n):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.randint(1, 6)):
            rows.append((conv if conv else None, turn, draw.choice(["system", "user", "assistant", "tool", None]), f"t{conv}.{turn}"))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_cheapest_legal_repair(spark, parts):
    rows = rows_of(parts, 60)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in chat.repair(table, parts=parts).collect():
        got.setdefault(r["conv_id"], []).append(r)
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    assert got.keys() == by.keys()
    for conv, turns in by.items():
        told = sorted(got[conv], key=lambda r: r["turn"])
        cost = sum(2 * ("relabel" in r["action"]) + ("merge" in r["action"]) + 3 * r["inserted"] for r in told)
        assert cost == cheapest([role for _, role, _ in turns])
        parsed = parse("".join(r["segment"] for r in told))
        before = ""
        for role, _ in parsed:
            assert role in LEGAL[before]
            before = role
        assert before == "assistant"
        said = [line for _, body in parsed for line in body.split("\n") if line]
        assert said == [text for _, _, text in turns]


def test_one_long_conversation_over_many_tasks(spark):
    rows = [(5, i, ["user", "user", "assistant", "system"][i % 4], str(i)) for i in range(400)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    results = [
        [tuple(r) for r in chat.repair(table, parts=parts).orderBy("turn").collect()] for parts in (1, 9)]
    costs = [sum(2 * ("relabel" in a) + ("merge" in a) + 3 * n for _, _, _, a, n, _ in rows) for rows in results]
    assert costs[0] == costs[1] and len(results[1]) == 400


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, segment int, _part int"
    rows = [(1, 0, "user", None, 1, 2), (1, 0, "user", None, 1, 2), (1, None, "", "x" * 100_000, 0, 0)]
    got = chat.repair(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 3 and sum("x" * 100_000 in r["segment"] for r in got) == 1
    assert chat.repair(spark.createDataFrame([], schema)).count() == 0
