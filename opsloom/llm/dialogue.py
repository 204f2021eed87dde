"""Repair of conversation structure: the cheapest edits that make the roles of a conversation an optional system turn and pairs of user and assistant.

Method: a path through the edits of a conversation weighs one integer.  Its high digits are the cost; its low digits, four bits each
and as many as there can be letters, are the edits' letters by place, zeros behind the last one.  Each edge of the graph
(rows consumed, last role) adds cost and letter at its place, so the smallest sum alone decides cost and ties.  Two paths of equal cost
to one node are never a prefix of each other (the longer one would end in more inserted turns and cost more), so the zeros
never decide between paths that still grow, and one number per node is enough.

Long conversations are cut.  Rows are range-partitioned by conversation and turn, and tasks cut the sorted runs into segments of at
most ``ROWS`` rows or ``BYTES`` of text.  A conversation that lies within one segment is settled there.  For any other, each segment
gives the smallest weights between all roles before and after it, one pass over these small rows chains them, and the segments are
edited in parallel.  Only the edit letters of one conversation meet in one task, never its texts.

Nulls: a null role or text is one blank; null turns sort first and count for no gap; a null conversation is one conversation.  Rows of equal turn are
taken by role, then by SHA-256 of role and text.  An empty role can't be kept.  Empty texts are blank.  Equal rows: the first stays, others are duplicates.  An empty
table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.session import keep

ROWS, BYTES = 512, 4 << 20
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
START, SYSTEM, USER, ASSISTANT = range(4)  # the last role so far
NEXT = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
_D, _I, _K, _R = 1, 2, 3, 4  # digits in the order of their letters
_LETTER = str.maketrans("1234", "DIKR")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_MOST = (1 << 63) - 1


# ---------------------------------------------------------------- the graph
def cheapest(initials: list[str], faults: list[str], enter: int = START) -> dict[int, tuple[int, str]]:
    """Smallest cost and letters from ``enter`` to each role that can be the last one after these rows; ``faults`` holds d(elete), t(runcated) or nothing."""
    width = 3 * (len(initials) + 1)  # at most two useful inserts before each row and at the end
    low = 4 * width
    at = [4 * (width - 1 - p) for p in range(width)]
    cost = [c << low for c in range(DELETE + REROLE + 1)]
    nodes: dict[int, tuple[int, int]] = {enter: (0, 0)}

    def inserted(nodes):
        for _ in range(2):
            for state, (w, p) in list(nodes.items()):
                to, w = NEXT[state], w + cost[INSERT]
                if to not in nodes or w < nodes[to][0]:
                    w += _I << at[p]
                    if to not in nodes or w < nodes[to][0]:
                        nodes[to] = (w, p + 1)
        return nodes

    for initial, fault in zip(initials, faults, strict=True):
        after: dict[int, tuple[int, int]] = {}
        more = TRUNCATED if fault == "t" else 0
        for state, (w, p) in inserted(nodes).items():
            edges = [(state, DELETE, _D)]
            if fault != "d":
                to = NEXT[state]
                edges.append((to, REROLE + more, _R))
                if initial == "s" and state == START:
                    edges.append((SYSTEM, KEEP + more, _K))
                elif initial and initial == NAME[to][0]:
                    edges[-1] = (to, KEEP + more, _K)  # the same turn as it is costs less
            for to, c, letter in edges:
                new = w + cost[c] + (letter << at[p])
                if to not in after or new < after[to][0]:
                    after[to] = (new, p + 1)
        nodes = after
    return {s: (w >> low, format(w & ((1 << low) - 1), f"0{width}x")[:p].translate(_LETTER)) for s, (w, p) in inserted(nodes).items()}


def edited(audit: str, state: int, roles: list, texts: list) -> tuple[list, list]:
    """Roles and texts after the edits."""
    out_roles, out_texts, i = [], [], 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out_roles.append(NAME[state])
            out_texts.append("")
            continue
        if letter != "D":
            state = SYSTEM if letter == "K" and roles[i][:1] == "s" else NEXT[state]
            out_roles.append(roles[i] if letter == "K" else NAME[state])
            out_texts.append(texts[i])
        i += 1
    return out_roles, out_texts


# ---------------------------------------------------------------- rows
_LINE = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("last", pa.string()), ("sha", pa.binary()), ("copies", pa.int32())])
_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_LINES = "array<struct<turn:bigint,role:string,text:string,last:string,sha:binary,copies:int>>"
_TURNS = "array<struct<role:string,text:string>>"
_SOLVED = "audit string, " + ", ".join(f"{c} bigint" for c in COUNTS) + f", messages {_TURNS}"


def _rows(turns: DataFrame, copies: str | None) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    end = F.rtrim(text, F.lit(BLANKS))
    return turns.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.substring(end, -1, 1).alias("last"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("sha"),
        (F.col(copies) if copies else F.lit(1)).cast("int").alias("copies"),
        F.monotonically_increasing_id().alias("_id"),
    )


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one conversation; those that hold a whole conversation for sure are settled."""
    part = TaskContext.get().partitionId()
    number, held, open_from = 0, None, 0  # rows of the open segment; how many segments its conversation had before in this task
    head = True  # still the first conversation of this task, which may have begun in another

    def out(made):
        nonlocal number
        whole = [m for m, _ in made]
        rows = [_settled(t) if w else _raw(t) for w, t in made]
        ids = [(part << 32) + number + k for k in range(len(made))]
        number += len(made)
        cols = {n: [r[n] for r in rows] for n in ("audit", *COUNTS)}
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([t["conv_id"].slice(0, 1) for _, t in made]), pa.array(ids, pa.int64()), pa.array(whole, pa.bool_()), pa.array(cols["audit"], pa.string()),
             *(pa.array(cols[c], pa.int64()) for c in COUNTS), _lists([r["messages"] for r in rows], _TURN), _lists([r["lines"] for r in rows], _LINE)],
            names=["conv_id", "segment", "whole", "audit", *COUNTS, "messages", "lines"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        conv = rows["conv_id"]
        null, n = conv.is_null().to_numpy(zero_copy_only=False), len(conv)
        other = pc.fill_null(pc.not_equal(conv.slice(1), conv.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(other | (null[1:] != null[:-1])) + 1).tolist(), n]
        size = np.concatenate(([0], np.cumsum(pc.binary_length(rows["text"]).to_numpy().astype(np.int64))))
        made = []
        for a, b in zip(edges, edges[1:], strict=False):
            while True:
                most = min(a + ROWS, max(a + 1, int(np.searchsorted(size, size[a] + BYTES, side="right")) - 1))
                if most >= b:
                    break
                made.append((False, rows.slice(a, most - a)))
                open_from, a = open_from + 1, most
            if b == n:
                held = rows.slice(a, b - a)
                break
            made.append((not head and not open_from, rows.slice(a, b - a)))
            open_from, head = 0, False
        if made:
            yield out(made)
    if held is not None:
        yield out([(False, held)])


def _lists(values: list[pa.Array | None], kind: pa.DataType) -> pa.Array:
    sizes = [0 if v is None else len(v) for v in values]
    flat = pa.concat_arrays([v for v in values if v is not None]) if any(v is not None for v in values) else pa.array([], kind)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.array([*(v is None for v in values), False]))
    return pa.ListArray.from_arrays(offsets, flat)


def _raw(rows: pa.RecordBatch) -> dict:
    lines = pa.StructArray.from_arrays([rows[f.name].cast(f.type) for f in _LINE], fields=list(_LINE))
    return {"audit": None, "messages": None, "lines": lines, **dict.fromkeys(COUNTS)}


class _Facts:
    """What the rows of a segment say before any edit; ``firsts``: the places of rows that no equal row precedes, None: look here."""

    def __init__(self, turn: list, role: list, last: list, sha: list, copies: list, firsts: set | None):
        self.source, self.initials, self.faults = [], [], []
        self.turns: list[int] = []
        seen: set = set()
        for i, (r, end, h, n) in enumerate(zip(role, last, sha, copies, strict=True)):
            if not n:
                continue
            if turn[i] is not None and (not self.turns or self.turns[-1] != turn[i]):
                self.turns.append(turn[i])
            first = i in firsts if firsts is not None else h not in seen
            seen.add(h)
            for _ in range(n):
                self.source.append(i)
                self.initials.append(r[:1])
                self.faults.append("b" if not end else "d" if not first else "" if end in ".!?" else "t")
                first = False
        self.blank, self.duplicate, self.truncated = (self.faults.count(f) for f in "bdt")
        self.illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:], strict=False))
        self.must = ["d" if f == "b" else f for f in self.faults]


def _facts(rows, firsts: set | None = None) -> _Facts:
    def column(n):
        return (rows.field(n) if isinstance(rows, pa.StructArray) else rows[n]).to_pylist()

    return _Facts(*(column(n) for n in ("turn", "role", "last", "sha", "copies")), firsts)


def _messages(rows, facts: _Facts, audit: str, state: int) -> pa.Array:
    role, text = ((rows.field(n) if isinstance(rows, pa.StructArray) else rows[n]).to_pylist() for n in ("role", "text"))
    roles, texts = edited(audit, state, [role[i] for i in facts.source], [text[i] for i in facts.source])
    return pa.StructArray.from_arrays([pa.array(roles, pa.string()), pa.array(texts, pa.string())], fields=list(_TURN))


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else min(high - low + 1 - distinct, _MOST)


def _settled(rows: pa.RecordBatch) -> dict:
    f = _facts(rows)
    found = cheapest(f.initials, f.must)
    cost, audit = min(found[s] for s in (START, ASSISTANT) if s in found)
    gaps = _gaps(*(f.turns[0], f.turns[-1]) if f.turns else (None, None), len(f.turns))
    return {"audit": audit, "messages": _messages(rows, f, audit, START), "lines": None, "gaps": gaps, "blank": f.blank, "duplicate": f.duplicate, "truncated": f.truncated, "illegal": f.illegal, "cost": cost}


# ---------------------------------------------------------------- conversations of several segments
_STEP = "array<struct<enter:int,leave:int,cost:bigint,audit:string>>"
_WEIGHED = f"segment bigint, steps {_STEP}, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint"


def _weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest weights through each segment for every pair of roles before and behind it."""
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            f = _facts(batch["lines"][k].values, set(batch["firsts"][k].as_py() or ()))
            steps = [{"enter": a, "leave": b, "cost": c, "audit": s} for a in range(4) for b, (c, s) in cheapest(f.initials, f.must, a).items()]
            rows.append({
                "segment": batch["segment"][k].as_py(), "steps": steps, "blank": f.blank, "duplicate": f.duplicate, "truncated": f.truncated, "illegal": f.illegal,
                "first": f.initials[0] if f.initials else None, "last": f.initials[-1] if f.initials else None,
                "low": f.turns[0] if f.turns else None, "high": f.turns[-1] if f.turns else None, "turns": len(f.turns),
            })
            rows[-1]["conv_id"] = batch["conv_id"][k].as_py()
        yield from pa.Table.from_pylist(rows, _arrow(batch.schema.field("conv_id").type)).to_batches()


def _arrow(conv: pa.DataType) -> pa.Schema:
    step = pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    longs = [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")]
    return pa.schema([("conv_id", conv), ("segment", pa.int64()), ("steps", pa.list_(step)), *longs, ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64())])


class _Node:
    """The best way from a role before a segment to the end: cost, role behind the segment, its letters, the node that follows."""

    __slots__ = ("audit", "cost", "leave", "then")

    def __init__(self, cost, leave, audit, then):
        self.cost, self.leave, self.audit, self.then = cost, leave, audit, then


def _less(a: _Node, b: _Node) -> bool:
    """By cost, then by letters; ways that meet in one node are compared up to it."""
    if a.cost != b.cost:
        return a.cost < b.cost
    x, y, a_next, b_next = a.audit, b.audit, a.then, b.then
    while True:
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]
        if not x and not y and a_next is b_next:
            return False
        if not x and a_next is not None:
            x, a_next = a_next.audit, a_next.then
        elif not y and b_next is not None:
            y, b_next = b_next.audit, b_next.then
        elif not x or not y:
            return not x and bool(y)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment of a conversation the role before it and its letters; the first segment also carries the conversation's counts."""

    def finish(parts: list[dict]):
        nodes = {START: _Node(0, -1, "", None)}
        nodes[ASSISTANT] = nodes[START]  # the two roles a conversation may end with
        levels = []
        for p in reversed(parts):
            before: dict[int, _Node] = {}
            for s in p["steps"]:
                then = nodes.get(s["leave"])
                if then is not None:
                    node = _Node(s["cost"] + then.cost, s["leave"], s["audit"], then)
                    if s["enter"] not in before or _less(node, before[s["enter"]]):
                        before[s["enter"]] = node
            nodes = before
            levels.append(before)
        counts = dict.fromkeys(COUNTS, 0) | {"cost": levels[-1][START].cost}
        low = high = last = None
        distinct = 0
        for p in parts:
            for c in ("blank", "duplicate", "truncated", "illegal"):
                counts[c] += p[c]
            if last is not None and p["first"] is not None:
                counts["illegal"] += last + p["first"] not in ("su", "ua", "au")
            last = p["last"] if p["last"] is not None else last
            if p["low"] is not None:
                distinct += p["turns"] - (high == p["low"])
                low, high = p["low"] if low is None else low, p["high"]
        counts["gaps"] = _gaps(low, high, distinct)
        state, rows = START, []
        for k, (p, level) in enumerate(zip(parts, reversed(levels), strict=True)):
            node = level[state]
            rows.append({"segment": p["segment"], "enter": state, "audit": node.audit, **(counts if not k else dict.fromkeys(COUNTS))})
            state = node.leave
        return pa.RecordBatch.from_pylist(rows, pa.schema([("segment", pa.int64()), ("enter", pa.int32()), ("audit", pa.string()), *((c, pa.int64()) for c in COUNTS)]))

    parts: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if parts and parts[-1]["conv_id"] != row["conv_id"]:
                yield finish(parts)
                parts = []
            parts.append(row)
    if parts:
        yield finish(parts)


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for k in range(batch.num_rows):
            lines = batch["lines"][k].values
            made.append(_messages(lines, _facts(lines, set()), batch["audit"][k].as_py(), batch["enter"][k].as_py()))
        names = ["conv_id", "segment", "audit", *COUNTS]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), _lists(made, _TURN)], names=[*names, "messages"])


def repair(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """One row per segment of a conversation: conv_id, segment (ascending within it), whole, audit (its letters), messages (role and text after the edits), and
    gaps, blank, duplicate, truncated, illegal and cost of the whole conversation on its first segment, else null.

    ``copies`` may name a column that says how often a row stands there; rows with 0 only make their conversation known.
    """
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "sha", "_id"]
    conv = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}"
    rows = _rows(turns, copies).repartitionByRange(*order).sortWithinPartitions(*order).drop("_id")
    cut = keep(rows.mapInArrow(_segments, f"{conv}, segment bigint, whole boolean, {_SOLVED}, lines {_LINES}"), "dialogue-segments")
    parts = cut.filter(~F.col("whole")).select("conv_id", "segment", "lines")
    line = parts.select("conv_id", "segment", F.posexplode("lines").alias("i", "line")).filter("line.copies > 0")
    first = line.groupBy("conv_id", "line.sha").agg(F.min(F.struct("segment", "i")).alias("at"))  # copies meet as one row per task
    firsts = first.groupBy(F.col("at.segment").alias("segment")).agg(F.collect_list("at.i").alias("firsts"))  # at most ROWS of them
    weighed = parts.join(firsts, "segment", "left").select("conv_id", "segment", "lines", "firsts").mapInArrow(_weighed, f"{conv}, {_WEIGHED}")
    chained = weighed.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_chained, "segment bigint, enter int, audit string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    solved = parts.join(chained, "segment").mapInArrow(_rendered, f"{conv}, segment bigint, {_SOLVED}")
    names = ["conv_id", "segment", "whole", "audit", *COUNTS, "messages"]
    return cut.filter("whole").select(*names).unionByName(solved.withColumn("whole", F.lit(False)).select(*names))


def digests(segments: DataFrame) -> DataFrame:
    """One row per conversation: its counts, audit and the SHA-256 of ``role:text`` of its messages, newline-joined; parts are hashed as they stream by."""
    body = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    one = segments.filter("whole").select("conv_id", *COUNTS, "audit", F.sha2(body, 256).alias("repaired_sha256"))
    conv = f"conv_id {segments.schema['conv_id'].dataType.simpleString()}"
    many = segments.filter(~F.col("whole")).select("conv_id", "segment", *COUNTS, "audit", body.alias("body"), F.size("messages").alias("n"))
    many = many.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return one.unionByName(many.mapInArrow(_hashed, f"{conv}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    def finish():
        cols = [pa.array([now[0]], kind), *(pa.array([c], pa.int64()) for c in now[1]), pa.array(["".join(now[2])]), pa.array([now[3].hexdigest()])]
        return pa.RecordBatch.from_arrays(cols, names=["conv_id", *COUNTS, "audit", "repaired_sha256"])

    now, some = None, False
    for batch in batches:
        kind = batch["conv_id"].type
        for k in range(batch.num_rows):
            conv = batch["conv_id"][k].as_py()
            if now is None or now[0] != conv:
                if now is not None:
                    yield finish()
                now, some = (conv, [batch[c][k].as_py() for c in COUNTS], [], hashlib.sha256()), False
            now[2].append(batch["audit"][k].as_py())
            if batch["n"][k].as_py():
                now[3].update((b"\n" if some else b"") + batch["body"][k].as_py().encode())
                some = True
    if now is not None:
        yield finish()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with made-up faults, chosen by CRC-32 of ``conv_id:turn`` modulo 20: 0 dropped (no copies), 1 emptied, 2 without end marks, 3 repeated, 4 said by the user."""
    blank = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))
    fault = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault <= 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
