"""Repair of turns: against a search over all repairs, and the defined results of odd input."""

import hashlib
import heapq
import random
import zlib

import pytest

from packlake.llm.conversations import SUMMARY, Search, audit, repair, summaries

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(turns):
    """(cost, edits) of `(initial, must go, truncated)` turns, by shortest paths over whole edit strings."""
    heap, done = [(0, "", 0, 0)], {}
    while heap:
        cost, edits, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done[at, state] = cost, edits
        for role in "ua":
            if role in NEXT[state]:
                heapq.heappush(heap, (cost + 2, edits + "I", at, NEXT[state][role]))
        if at < len(turns):
            initial, must_go, late = turns[at]
            heapq.heappush(heap, (cost + 3, edits + "D", at + 1, state))
            if not must_go:
                if initial in NEXT[state]:
                    heapq.heappush(heap, (cost + late, edits + "K", at + 1, NEXT[state][initial]))
                for role in "ua":
                    if role in NEXT[state]:
                        heapq.heappush(heap, (cost + 2 + late, edits + "R", at + 1, NEXT[state][role]))
    return min(done[len(turns), state] for state in (0, 3) if (len(turns), state) in done)


def all_repairs(turns):
    """The same over all edit strings, one by one."""
    found = []

    def go(at, state, cost, edits, inserted):
        if cost > 3 * len(turns):
            return
        if at == len(turns) and state in (0, 3):
            found.append((cost, edits))
        for role in "ua":
            if role in NEXT[state] and inserted < 3:
                go(at, NEXT[state][role], cost + 2, edits + "I", inserted + 1)
        if at < len(turns):
            initial, must_go, late = turns[at]
            go(at + 1, state, cost + 3, edits + "D", 0)
            if not must_go:
                if initial in NEXT[state]:
                    go(at + 1, NEXT[state][initial], cost + late, edits + "K", 0)
                for role in "ua":
                    if role in NEXT[state]:
                        go(at + 1, NEXT[state][role], cost + 2 + late, edits + "R", 0)

    go(0, 0, 0, "", 0)
    return min(found)


def searched(turns):
    search, steps = Search(), []
    for k, (initial, must_go, late) in enumerate(turns):
        steps += search.add((k,), initial.encode(), must_go, bool(late))
    steps += search.end()
    return sum(s.cost for s in steps), "".join(s.edit for s in steps)


@pytest.mark.parametrize("most, model, runs", [(7, all_repairs, 600), (50, cheapest, 600)])
def test_search_is_the_cheapest_and_least(most, model, runs):
    draw = random.Random(most)
    for _ in range(runs):
        letters = draw.choice(["sua", "ua", "suax", "x", "xu", "us", "a", "uua"])
        size = draw.randint(0, most)
        turns = [(draw.choice(letters), draw.random() < 0.15, int(draw.random() < 0.3)) for _ in range(size)]
        assert searched(turns) == model(turns), turns


def test_memory_is_the_unresolved_suffix():
    draw, search = random.Random(3), Search()
    pending = most = 0
    for k in range(20000):
        settled = search.add((k,), draw.choice([b"u", b"a", b"s", b"x"]), draw.random() < 0.1, draw.random() < 0.1)
        pending += 1 - sum(s.edit != "I" for s in settled)
        most = max(most, pending)
    assert most < 100


def test_freed_steps_leave_no_references():
    search = Search()
    for k in range(500):
        search.add((k,), b"usa"[k % 3 : k % 3 + 1], k % 7 == 0, k % 5 == 0)
    steps, reached = list(search.survivors.values()), {}
    while steps:
        step = steps.pop()
        reached[id(step)] = reached.get(id(step), 0) + 1
        if reached[id(step)] == 1:
            assert step.refs >= 1
            if step.parent:
                steps.append(step.parent)
    assert len(reached) < 200


TURNS = "conv_id long, turn long, role string, text string"


def test_edits_and_texts(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again!"), (1, 2, "assistant", "Well"), (1, 3, "user", " \n")]
    found = [tuple(r) for r in repair(spark.createDataFrame(rows, TURNS)).collect()]
    assert [(r[2], r[5], r[6], r[7], r[8]) for r in found] == [
        ("K", "user", "Hi.", None, 0),
        ("I", "assistant", "", None, 2),
        ("K", "user", "Again!", None, 0),
        ("K", "assistant", "Well", "truncated", 1),
        ("D", None, None, "blank", 3),
    ]


def test_odd_rows(spark):
    rows = [
        (None, None, None, None),  # one space each, so blank
        (None, 4, "user", "x."),
        (2, 1, "user", "same."),
        (2, 1, "user", "same."),
        (2, 9, "user", "same."),
        (3, None, "assistant", "y" * 100_000),
        (4, 5, "", ""),
    ]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], TURNS + ", cost string")
    found = {r["conv_id"]: r for r in summaries(repair(turns)).collect()}
    assert set(found) == {None, 2, 3, 4}
    assert (found[None]["blank"], found[None]["audit"], found[None]["gaps"]) == (1, "DKI", 0)
    assert (found[2]["duplicate"], found[2]["audit"], found[2]["gaps"], found[2]["illegal"]) == (2, "KDDI", 7, 2)
    assert found[3]["truncated"] == 1 and found[3]["gaps"] == 0 and found[3]["cost"] == 3
    assert found[4]["audit"] == "D" and found[4]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_and_all_dropped(spark):
    empty = audit(spark.createDataFrame([], TURNS))
    assert empty.columns == ["conv_id", *SUMMARY] and not empty.collect()
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    (row,) = audit(spark.createDataFrame([(7, turn, "user", "gone.")], TURNS)).collect()
    assert tuple(row)[:8] == (7, 0, 0, 0, 0, 0, 0, "")


def test_one_long_conversation(spark):
    """Half of all turns in one conversation, over several batches: as the model has it."""
    draw = random.Random(5)
    rows = [(1, k, draw.choice(["user", "assistant", "system", "tool"]), f"{k}" + draw.choice([".", ""])) for k in range(6000)]
    rows += [(100 + k, 0, "user", "a?") for k in range(6000)]
    draw.shuffle(rows)
    found = {r["conv_id"]: r for r in summaries(repair(spark.createDataFrame(rows, TURNS))).collect()}
    turns = [(r[2][0], False, int(not r[3].endswith("."))) for r in sorted(r for r in rows if r[0] == 1)]
    assert (found[1]["cost"], found[1]["audit"]) == cheapest(turns)
    assert len(found) == 6001 and found[150]["audit"] == "KI"
