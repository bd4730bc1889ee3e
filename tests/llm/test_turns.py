from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from orderlens.llm import turns
from orderlens.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, fault string, alive int, same string, nth int"
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"user": "u", "assistant": "a"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, marks):
    """(cost, audit, lines) of the best edits, row by row from the front, ties ASCII-least."""
    states = [("", "", 0, [])]  # place, audit, cost, lines
    best = None

    def grow(states):  # insert zero or more rows
        out = list(states)
        frontier = states
        for _ in range(2):
            frontier = [
                (r[0], audit + "I", cost + 3, [*lines, f"{r}:"])
                for place, audit, cost, lines in frontier for r in ROLES
                if legal(place, r[0])
            ]
            out += frontier
        return out

    def prune(states):  # of each place, the least
        kept = {}
        for state in states:
            place = state[0]
            if place not in kept or (state[2], state[1]) < (kept[place][2], kept[place][1]):
                kept[place] = state
        return list(kept.values())

    for (_, _, role, text), mark in zip(rows, marks, strict=True):
        after = []
        for place, audit, cost, lines in grow(states):
            after.append((place, audit + "D", cost + 4, lines))
            if mark in (1, 2):
                continue
            extra = 3 if mark == 3 else 0
            choices = [("K", role, role[:1], 0)] + [("R", r, r[0], 3) for r in ROLES]
            for letter, name, initial, price in choices:
                if legal(place, initial):
                    after.append((initial, audit + letter, cost + price + extra, [*lines, f"{name}:{text}"]))
        states = prune(after)
    for place, audit, cost, lines in grow(states):
        if place in ("", "a") and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
    return best


def plain(rows):
    conversations = defaultdict(list)
    for row in rows:
        conversations[row[0]]
    for row in damage(rows):
        conversations[row[0]].append(row)
    out = []
    for conv, own in conversations.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marks = faults(own)
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = cheapest(own, marks)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, marks.count(1), marks.count(2), marks.count(3), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", " ", "u"]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=5))
def test_walk_is_the_cheapest_and_least(case):
    rows = [(1, i, role, f"t{i}.") for i, (role, _) in enumerate(case)]
    marks = [mark for _, mark in case]
    conversation = turns.Conversation(turns.Costs(), held_bytes=150)
    for (_, turn, role, text), mark in zip(reversed(rows), reversed(marks), strict=True):
        conversation.add(turn, role, text, mark)
    found = conversation.result()
    # All ways without any pruning.
    best = None
    edits = [["D"] if m in (1, 2) else ["D", "K", "Ruser", "Rassistant"] for m in marks]
    for chosen in itertools.product(*edits):
        parts, price = [], 0
        for edit, (_, _, role, text), mark in zip(chosen, rows, marks, strict=True):
            price += {"D": 4, "K": 0, "R": 3}[edit[0]] + (3 if mark == 3 and edit != "D" else 0)
            name = role if edit == "K" else edit[1:]
            parts.append((edit[0], None if edit == "D" else name, text))
        for way in filled(parts):
            cost = price + 3 * sum(letter == "I" for letter, _, _ in way)
            audit = "".join(letter for letter, _, _ in way)
            if best is None or (cost, audit) < best[:2]:
                lines = "\n".join(f"{name}:{text}" for _, name, text in way if name is not None)
                best = (cost, audit, lines)
    assert found[5:7] == best[:2]
    assert found[7] == hashlib.sha256(best[2].encode()).hexdigest()


def filled(parts):
    """All ways to put inserts between the edits, at most two at a place, that end in a legal form."""
    fitting = []

    def go(i, place, done, run):
        if i == len(parts) and place in ("", "a"):
            fitting.append(done)
        if run < 2:
            for name in ("user", "assistant"):
                if legal(place, name[0]):
                    go(i, name[0], [*done, ("I", name, "")], run + 1)
        if i < len(parts):
            letter, name, text = parts[i]
            if name is None:
                go(i + 1, place, [*done, parts[i]], 0)
            elif legal(place, name[:1]):
                go(i + 1, name[:1], [*done, parts[i]], 0)

    go(0, "", [], 0)
    return fitting


def legal(place, initial):
    return (place, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


def test_given_conversations(spark):
    given = table(spark, "/root/testdata/sf0.001", "conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in given.collect()]
    assert rows_of(turns.repair_conversations(given)) == plain(rows)


def odd_rows():
    rows = [(1, None, None, None), (1, None, "user", "a."), (None, 0, "user", "b"), (None, None, None, "c!")]
    rows += [(2, t, "user", "same.") for t in range(12)] + [(2, 3, "user", "same.")] * 3
    rows += [(3, t, "assistant" if t % 2 else "user", "日本語 😀 ？" if t % 3 else "x" * 30_000 + ".") for t in range(9)]
    rows += [(4, t, "tool", " \t\n") for t in range(5)] + [(4, -5, "", "no end"), (4, 9, "system", "late.")]
    rows += [(5, 7, "user", "b."), (5, 7, "user", "a."), (5, 7, "assistant", "z."), (5, 10**15, "user", "far.")]
    rows += [(10 + i, 0, "user", f"short {i}?") for i in range(40)]  # some lose their only row
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "none", 0, "s", 1) for r in rows], SCHEMA).repartition(5)
    want = plain(rows)
    assert rows_of(turns.repair_conversations(df)) == want
    empty = hashlib.sha256(b"").hexdigest()
    lost = [r for r in want if r[1:] == (0, 0, 0, 0, 0, 0, "", empty)]
    assert lost  # a conversation without any row left


def test_giant_conversation_spills_and_crosses_batches(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"row {t % 400}" + "." * (t % 4)) for t in range(1500)]
    rows += [(2, 0, "user", "one."), (2, 1, "assistant", "two.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    want = plain(rows)
    assert rows_of(turns.repair_conversations(df, held_bytes=2_000)) == want
    assert rows_of(turns.repair_conversations(df)) == want


def test_one_exchange(spark):
    given = table(spark, "/root/testdata/sf0.001", "conversations")
    plan = turns.repair_conversations(given)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_nothing(spark):
    found = turns.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert found.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found.collect() == []
