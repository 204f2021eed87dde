"""Command history as tables: parsing, classification, phases, cooldowns, retries, stalls.

Every ordered rule takes ``keys`` (the machine, or machine and session), an integer or
double time in seconds ``sec`` and a tie-break ``seq``; see ``ordered`` for how a key's
sequence is cut so that a very large machine is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom import rules
from opsloom.functions import commands as cx
from opsloom.functions import text as tx
from opsloom.operators.ordered import (
    BLOCK_ROWS,
    blocked_scan,
    own_rows,
    running_last,
    seconds_bucket,
    with_lookback,
    with_position,
)
from opsloom.session import settle

KEYS = ("machine",)


def number_commands(df: DataFrame, keys: Sequence[str] = KEYS, sec: str = "sec", seq: str = "seq", bucket: Column | None = None) -> DataFrame:
    return with_position(df, keys, [sec, seq], seconds_bucket(sec) if bucket is None else bucket)


def _blocks(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys, "_blk").orderBy("pos")


# ---------------------------------------------------------------- parsing and per-row rules
def parse_history(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per command of a history text: line_no, epoch (if the shell wrote one), command."""
    line = tx.strip(F.col("_line"))
    is_zsh = line.startswith(": ") & line.contains(";")
    cmd = (
        F.when(is_zsh, tx.strip(F.regexp_extract(line, r"(?s)^[^;]*;(.*)$", 1)))
        .when(line.startswith("- cmd:"), tx.strip(F.substring(line, 7, 1 << 30)))
        .otherwise(line)
    )
    epoch = F.when(is_zsh, F.expr(r"try_cast(nullif(regexp_extract(_line, '^\\s*: (\\d+):', 1), '') as bigint)"))
    rest = [c for c in df.columns if c != raw]
    return (
        df.select(*rest, F.posexplode(tx.lines(tx.text_or_empty(raw))).alias("line_no", "_line"))
        .select(*rest, "line_no", epoch.alias("epoch"), cmd.alias("command"), (line.startswith("- cmd:")).alias("_fish"))
        .filter((F.col("command") != "") | F.col("_fish"))
        .drop("_fish")
    )


def first_seen(df: DataFrame, keys: Sequence[str] = KEYS, command: str = "command", sec: str = "sec", seq: str = "seq") -> DataFrame:
    """First occurrence of each command (up to whitespace) per key.

    A grouped minimum combines on the map side, so a command repeated by a large
    part of the rows reaches its task as one row per map task.
    """
    first = F.min_by(F.struct(*[F.col(c) for c in df.columns if c not in keys]), F.struct(sec, seq)).alias("_f")
    grouped = df.groupBy(*keys, cx.command_hash(command).alias("command_hash")).agg(first)
    return grouped.select(*keys, "command_hash", "_f.*")


def annotate(df: DataFrame, command: str = "command") -> DataFrame:
    """The per-row fields of a history event."""
    return (
        df.withColumn("feedback_signal", cx.feedback_signal(command))
        .withColumns(
            {
                "feedback_line": F.when(F.col("feedback_signal").isNotNull(), F.col(command)),
                "technical": cx.is_technical(command),
                "json_hint": cx.needs_json_hint(command),
                "cd_target": cx.cd_target(command),
                "host_target": cx.host_target(command),
            }
        )
        .withColumn("trigger", F.col("technical") | F.col("feedback_signal").isNotNull())
    )


# ---------------------------------------------------------------- bounded look-back
def rolling_context(
    numbered: DataFrame, keys: Sequence[str] = KEYS, command: str = "command", size: int = rules.CONTEXT_LIMIT, out: str = "context", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The last ``size`` commands, the row's own included, as an array."""
    w = _blocks(keys).rowsBetween(-(size - 1), 0)
    lent = with_lookback(numbered, size - 1, block_rows=block_rows)
    return own_rows(lent.withColumn(out, F.collect_list(command).over(w)))


def running_phase(
    numbered: DataFrame, keys: Sequence[str] = KEYS, command: str = "command", size: int = rules.CONTEXT_LIMIT, table=rules.PHASE_RULES, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Phase of the latest matching command among the last ``size``, and its bucket."""
    rated = numbered.withColumn("_p", cx.command_phase(command, table))
    w = _blocks(keys).rowsBetween(-(size - 1), 0)
    lent = with_lookback(rated, size - 1, block_rows=block_rows)
    phased = lent.withColumn("phase", F.coalesce(F.last("_p", ignorenulls=True).over(w), F.lit(rules.PHASE_IDLE)))
    return own_rows(phased).withColumn("phase_bucket", cx.phase_bucket("phase")).drop("_p")


def phase_changes(phased: DataFrame, keys: Sequence[str] = KEYS, start: str = rules.PHASE_IDLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows whose phase differs from the row before (the first row: from ``start``)."""
    lent = with_lookback(phased, 1, block_rows=block_rows)
    before = F.coalesce(F.lag("phase").over(_blocks(keys)), F.lit(start))
    return own_rows(lent.withColumn("previous_phase", before)).filter(F.col("phase") != F.col("previous_phase"))


def methodology_audit(numbered: DataFrame, keys: Sequence[str] = KEYS, command: str = "command", size: int = rules.CONTEXT_LIMIT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exploit-like commands without recon among the last ``size`` commands."""
    rated = numbered.withColumns({"_x": cx.is_exploit(command), "_r": cx.is_recon(command)})
    w = _blocks(keys).rowsBetween(-(size - 1), 0)
    lent = with_lookback(rated, size - 1, block_rows=block_rows).withColumn("_any", F.max("_r").over(w))
    return own_rows(lent).filter(F.col("_x") & ~F.col("_any")).drop("_x", "_r", "_any")


def similar_to_previous(numbered: DataFrame, keys: Sequence[str] = KEYS, command: str = "command", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Flags: same command up to numbers, and similar input, each against the row before."""
    lent = with_lookback(numbered, 1, block_rows=block_rows).withColumn("_prev", F.lag(command).over(_blocks(keys)))
    return (
        own_rows(lent)
        .withColumn("similar_command", F.coalesce(cx.similar_key(command) == cx.similar_key("_prev"), F.lit(False)) & F.col("_prev").isNotNull())
        .withColumn("similar_input", cx.is_similar_input(F.col(command), F.col("_prev")))
        .drop("_prev")
    )


def progress_signature(
    numbered: DataFrame, keys: Sequence[str] = KEYS, command: str = "command", size: int = rules.PROGRESS_COMMANDS, limit: int = rules.STUCK_TURNS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Signature of the last commands, turns since it changed, and whether the stuck rule fires.

    ``numbered`` has one row per turn; fires at every ``limit``-th turn with the same signature.
    """
    w = _blocks(keys).rowsBetween(-(size - 1), 0)
    lent = with_lookback(numbered, size, block_rows=block_rows)
    signed = lent.withColumn("signature", F.sha2(F.array_join(F.collect_list(command).over(w), "\n"), 256))
    changed = ~F.col("signature").eqNullSafe(F.lag("signature").over(_blocks(keys)))
    marked = settle(own_rows(signed.withColumn("_change", changed)))
    traced = running_last(marked, keys, F.when(F.col("_change"), F.col("pos")), "_since", block_rows=block_rows)
    return (
        traced.withColumn("turns_same", (F.col("pos") - F.col("_since")).cast("long"))
        .withColumn("stuck", (F.col("turns_same") > 0) & (F.col("turns_same") % limit == 0))
        .drop("_change", "_since")
    )


def stuck_status(numbered: DataFrame, keys: Sequence[str] = KEYS, text: str = "command", size: int = rules.STUCK_TURNS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    w = _blocks(keys).rowsBetween(-(size - 1), 0)
    lent = with_lookback(numbered, size - 1, block_rows=block_rows)
    blob = lent.withColumn("_blob", F.array_join(F.collect_list(text).over(w), " "))
    return own_rows(blob).withColumn("status", cx.stuck_status(F.col("_blob"))).drop("_blob")


# ---------------------------------------------------------------- any distance back
def retry_loop(
    numbered: DataFrame, keys: Sequence[str] = KEYS, command: str = "command", sec: str = "sec", window: float = rules.RETRY_SECONDS, threshold: int = rules.RETRY_THRESHOLD, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Consecutive quick repeats of a command and whether they make a loop."""
    order = _blocks(keys)
    lent = with_lookback(numbered, 1, block_rows=block_rows)
    again = (F.lag(command).over(order) == F.col(command)) & (F.col(sec) - F.lag(sec).over(order) < window)
    marked = settle(own_rows(lent.withColumn("_again", F.coalesce(again, F.lit(False)))))
    traced = running_last(marked, keys, F.when(~F.col("_again"), F.col("pos")), "_since", block_rows=block_rows)
    return (
        traced.withColumn("retries", (F.col("pos") - F.col("_since")).cast("long"))
        .withColumn("retry_loop", F.col("retries") >= threshold)
        .drop("_again", "_since")
    )


def probe_last(
    events: DataFrame,
    probes: DataFrame,
    fields: Sequence[str],
    keys: Sequence[str] = KEYS,
    sec: str = "sec",
    bucket: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """As-of lookup: each probe with the fields of the last event at or before it (null: none).

    Both sides are unioned and read by one ordered scan; there is no range join.
    ``probes``: keys, probe_id, sec; ``events`` carry seq.
    """
    carried = F.struct(F.col(sec).alias("at"), *[F.col(f) for f in fields])
    left = events.select(*keys, sec, F.lit(0).alias("_side"), F.col("seq").cast("long").alias("_tie"), F.lit(None).cast("long").alias("probe_id"), carried.alias("_v"))
    right = probes.select(*keys, sec, F.lit(1).alias("_side"), F.col("probe_id").cast("long").alias("_tie"), F.col("probe_id").cast("long").alias("probe_id"), F.lit(None).cast(left.schema["_v"].dataType).alias("_v"))
    union = settle(left.unionByName(right))
    both = settle(with_position(union, keys, [sec, "_side", "_tie"], seconds_bucket(sec) if bucket is None else bucket))
    traced = running_last(both, keys, F.col("_v"), "_last", block_rows=block_rows)
    return traced.filter(F.col("probe_id").isNotNull()).select(
        *keys, "probe_id", sec, F.col("_last.at").alias("last_at"), *[F.col("_last")[f].alias(f) for f in fields]
    )


def stall_state(
    retried: DataFrame,
    probes: DataFrame,
    keys: Sequence[str] = KEYS,
    sec: str = "sec",
    stall: float = rules.STALL_SECONDS,
    threshold: int = rules.RETRY_THRESHOLD,
    **scan,
) -> DataFrame:
    """State of each key at probe times: retry_loop, stalled, stalling or idle (unknown keys are idle)."""
    seen = probe_last(retried, probes, ["command", "retries"], keys, sec, **scan)
    elapsed = F.col(sec) - F.col("last_at")
    return seen.withColumn("elapsed", elapsed).withColumn(
        "state",
        F.when(F.col("last_at").isNull(), "idle")
        .when(F.col("retries") >= threshold, "retry_loop")
        .when(elapsed >= stall, "stalled")
        .when(elapsed >= stall * rules.STALLING_SHARE, "stalling")
        .otherwise("idle"),
    )


def hint_level(elapsed: Column, limits: Sequence[float] = rules.HINT_SECONDS) -> Column:
    low, mid, high = rules.HINT_LEVELS
    return F.when(elapsed < limits[0], low).when(elapsed < limits[1], mid).otherwise(high)


def hint_levels(
    progress: DataFrame, probes: DataFrame, keys: Sequence[str] = KEYS, sec: str = "sec", limits: Sequence[float] = rules.HINT_SECONDS, **scan
) -> DataFrame:
    """Hint level at probe times, from the last progress (technical command or phase change)."""
    seen = probe_last(progress, probes, [], keys, sec, **scan)
    elapsed = F.col(sec) - F.col("last_at")
    level = hint_level(elapsed, limits)
    return (
        seen.withColumn("elapsed", elapsed)
        .withColumn("hint_level", F.when(F.col("last_at").isNull(), rules.HINT_LEVELS[0]).otherwise(level))
        .withColumn("allow_web", F.col("hint_level") == rules.HINT_LEVELS[2])
    )


def progress_rows(phased: DataFrame, keys: Sequence[str] = KEYS, command: str = "command", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows that count as progress: technical commands and phase changes."""
    lent = with_lookback(phased, 1, block_rows=block_rows)
    before = F.coalesce(F.lag("phase").over(_blocks(keys)), F.lit(rules.PHASE_IDLE))
    return own_rows(lent.withColumn("_moved", F.col("phase") != before)).filter(cx.is_technical(command) | F.col("_moved")).drop("_moved")


def target_switch(numbered: DataFrame, keys: Sequence[str] = KEYS, command: str = "command", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows that name a target (cd first, then host) other than the current one."""
    named = numbered.withColumn("target", F.coalesce(cx.cd_target(command), cx.host_target(command))).filter(F.col("target").isNotNull())
    # Among rows that name a target the current one is the row before.
    renumbered = named.withColumnRenamed("pos", "_old")
    own = with_position(renumbered, keys, ["_old"], F.floor(F.col("_old") / block_rows).cast("long"))
    lent = with_lookback(own, 1, block_rows=block_rows).withColumn("previous_target", F.lag("target").over(_blocks(keys)))
    return own_rows(lent).filter(~F.col("target").eqNullSafe(F.col("previous_target"))).drop("pos").withColumnRenamed("_old", "pos")


def pending_json_hint(commands: DataFrame, outputs: DataFrame, keys: Sequence[str] = KEYS, sec: str = "sec", bucket: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """First long output line without a signal after a command that should have used JSON.

    ``commands``: keys, sec, seq, command; ``outputs``: keys, sec, line_id, line.
    """
    quiet = outputs.filter(cx.feedback_signal("line").isNull() & (F.length(tx.strip("line")) > rules.LONG_OUTPUT_CHARS))
    probes = quiet.select(*keys, sec, F.col("line_id").alias("probe_id"))
    seen = probe_last(commands, probes, ["seq", "command"], keys, sec, bucket, block_rows)
    pending = seen.filter(cx.needs_json_hint("command"))
    return pending.groupBy(*keys, "seq").agg(
        F.min_by("command", F.struct(sec, "probe_id")).alias("command"), F.min_by("probe_id", F.struct(sec, "probe_id")).alias("line_id")
    )


# ---------------------------------------------------------------- sequential rules
def cooldown(
    df: DataFrame, seconds: float, keys: Sequence[str] = KEYS, sec: str = "sec", seq: str = "seq", bucket: Column | None = None, out: str = "fired"
) -> DataFrame:
    """A row fires when at least ``seconds`` passed since the last row that fired.

    Whether a row fires depends on the last *accepted* row, so this is a fold.  It runs
    in parallel over time buckets: the effect of a bucket on "last fired" is a step
    function with few steps, because chains of fired rows started close together soon
    meet.  Returns keys, sec, seq and ``out``.
    """
    rows = df.select(*keys, F.col(sec).cast("double").alias(sec), seq)

    def transfer(g: dict[str, np.ndarray]):
        at = np.asarray(g[sec], dtype="float64")
        n = len(at)
        following = np.searchsorted(at, at + seconds, side="left").tolist()
        times = at.tolist()
        end = list(times)
        for i in range(n - 1, -1, -1):
            if following[i] < n:
                end[i] = end[following[i]]
        # A fire in an earlier bucket blocks at most the first ``seconds`` of this one,
        # so only the steps up to there can matter.
        reach = times[0] + seconds
        steps: list[list[float]] = []
        for i in range(n):
            if steps and steps[-1][1] == end[i]:
                steps[-1][0] = times[i]
            elif steps and steps[-1][0] >= reach:
                break
            else:
                steps.append([times[i], end[i]])
        return {"steps": steps, "last": times[-1]}

    def carry(state, effect):
        if state is None:
            return effect["steps"][0][1]
        threshold = state + seconds
        if threshold > effect["last"]:
            return state
        return next(end for upto, end in effect["steps"] if threshold <= upto)

    def flag(g: dict[str, np.ndarray], state) -> np.ndarray:
        at = np.asarray(g[sec], dtype="float64")
        fired = np.zeros(len(at), dtype=bool)
        i = 0 if state is None else int(np.searchsorted(at, state + seconds, side="left"))
        while i < len(at):
            fired[i] = True
            i = int(np.searchsorted(at, at[i] + seconds, side="left"))
        return fired

    width = seconds_bucket(sec) if bucket is None else bucket
    return blocked_scan(rows, keys, [sec, seq], width, None, transfer, carry, flag, out)


def guarded_cooldown(
    df: DataFrame, seconds: float = rules.COOLDOWN_SECONDS, keys: Sequence[str] = KEYS, sec: str = "sec", seq: str = "seq", line: str = "line", seen_limit: int = rules.SEEN_LIMIT
) -> DataFrame:
    """Cooldown with the seen-line guard: a line that fired does not fire again.

    The memory of fired lines is emptied once it holds more than ``seen_limit``.  That
    memory makes the rule sequential per key, so rows are cut down first (a line repeated
    at the same time can never fire twice) and then streamed in order through a fold whose
    state is one time and at most ``seen_limit`` digests; no group is held in memory.
    Returns keys, sec, seq, line_hash of the rows that fire.
    """
    hashed = df.select(*keys, F.col(sec).cast("double").alias(sec), seq, cx.command_hash(line).alias("line_hash"))
    reduced = hashed.groupBy(*keys, sec, "line_hash").agg(F.min(seq).alias(seq)).select(*keys, sec, seq, "line_hash")
    ordered = reduced.repartition(*keys).sortWithinPartitions(*keys, sec, seq)
    keys = list(keys)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last, seen = None, None, set()
        for pdf in batches:
            keep = []
            for row in zip(*[pdf[k] for k in keys], pdf[sec], pdf["line_hash"]):
                key, at, digest = row[:-2], row[-2], row[-1]
                if key != current:
                    current, last, seen = key, None, set()
                fires = (last is None or at - last >= seconds) and digest not in seen
                if fires:
                    last = at
                    seen.add(digest)
                    if len(seen) > seen_limit:
                        seen.clear()
                keep.append(fires)
            yield pdf[np.array(keep, dtype=bool)] if len(keep) else pdf

    return ordered.mapInPandas(fold, ordered.schema)


def scoped_context(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    command: str = "command",
    sec: str = "sec",
    seq: str = "seq",
    cwd: str = "cwd",
    home: str = "/home/user",
    limit: int = rules.CONTEXT_LIMIT,
    bucket: Column | None = None,
) -> DataFrame:
    """The last ``limit`` commands given in, or naming, the working directory; else the last of all.

    The shell directory follows ``cd``; moves compose (an absolute move forgets what came
    before), so each bucket is summarised as one move.  ``cwd`` is constant per key.
    """
    rows = df.select(*keys, F.col(sec).cast("double").alias(sec), seq, command, cwd)

    def move(text: str):
        """None, or [absolute?, path] of one command."""
        if not text.startswith("cd "):
            return None
        target = text[3:].strip().strip("\"'")
        if target in ("~", "$HOME"):
            return [True, home]
        if target.startswith("/"):
            return [True, target.rstrip("/") or "/"]
        return [False, target]

    def join(base: str, path: str) -> str:
        parts = [] if path.startswith("/") else [p for p in base.split("/") if p]
        for part in path.split("/"):
            if part == ".." and parts and parts[-1] != "..":
                parts.pop()
            elif part == ".." and not base.startswith("/") and not path.startswith("/"):
                parts.append(part)
            elif part not in ("", ".", ".."):
                parts.append(part)
        rooted = base.startswith("/") or path.startswith("/")
        return ("/" if rooted else "") + "/".join(parts)

    def transfer(g: dict[str, np.ndarray]):
        absolute, path = False, ""
        for text in g[command]:
            step = move(str(text).strip())
            if step is None:
                continue
            absolute, path = (True, step[1]) if step[0] else (absolute, join(path, step[1]))
        return [absolute, path]

    def carry(state, effect):
        if effect[0]:
            return ["abs", effect[1]]
        return [state[0], join(state[1], effect[1])]

    def flag(g: dict[str, np.ndarray], state) -> np.ndarray:
        base = str(g[cwd][0]).rstrip("/") or "/"
        name = base.rsplit("/", 1)[-1]
        here = state[1] if state[0] == "abs" else join(base, state[1])
        flags = []
        for text in g[command]:
            bare = str(text).strip()
            step = move(bare)
            if step is not None:
                here = step[1] if step[0] else join(here, step[1])
            parts = ["/"] + [p for p in here.split("/") if p]
            flags.append(here == base or base in bare or (name != "" and name in bare) or any(p in bare for p in parts))
        return np.array(flags, dtype=bool)

    width = seconds_bucket(sec) if bucket is None else bucket
    marked = blocked_scan(rows, keys, [sec, seq], width, ["rel", ""], transfer, carry, flag, "in_scope")
    w = Window.partitionBy(*keys).orderBy(F.desc("in_scope"), F.desc(sec), F.desc(seq))
    # Rows in scope come first; the others only count for keys without any.
    last = marked.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    any_scope = Window.partitionBy(*keys)
    return (
        last.withColumn("_any", F.max("in_scope").over(any_scope))
        .filter(F.col("in_scope") | ~F.col("_any"))
        .drop("_n", "_any")
    )


# ---------------------------------------------------------------- aggregates
def rabbit_hole(commands: DataFrame, solution: DataFrame, keys: Sequence[str] = KEYS, service: str = "service", threshold: int = rules.RABBIT_HOLE_COMMANDS) -> DataFrame:
    """Services with many commands that are not in the key's (non-empty) solution set."""
    counts = (
        commands.filter(tx.text_or_empty(service) != "")
        .groupBy(*keys, F.lower(service).alias("service"))
        .agg(F.count(F.lit(1)).alias("n_commands"))
        .filter(F.col("n_commands") >= threshold)
    )
    known = solution.select(*keys, F.lower(service).alias("service")).distinct()
    return counts.join(known.select(*keys).distinct(), list(keys), "left_semi").join(known, [*keys, "service"], "left_anti")


def recon_summary(commands: DataFrame, keys: Sequence[str] = KEYS, command: str = "command", sec: str = "sec", seq: str = "seq") -> DataFrame:
    """Latest share access with an address, else latest recon command, else a default."""
    share, recent, default = rules.RECON_SUMMARY_TEXTS
    address = tx.extract_or_null(command, rules.RECON_SMB_PATTERN)
    is_recon = tx.any_contains(F.lower(command), rules.RECON_TOOLS)
    order = F.struct(sec, seq)
    latest = commands.groupBy(*keys).agg(
        F.max_by(address, F.when(address.isNotNull(), order)).alias("_ip"),
        F.max_by(command, F.when(is_recon, order)).alias("_cmd"),
    )
    return latest.select(
        *keys,
        F.coalesce(
            F.concat(F.lit(share), "_ip"), F.concat(F.lit(recent), F.left("_cmd", F.lit(120))), F.lit(default)
        ).alias("recon_summary"),
    )


def usage_meter(df: DataFrame, easy: Column, ok: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """round(10 * easy / (easy + ok)) within 0..10, half to even; 0 without any."""
    sums = df.groupBy(*keys).agg(F.count_if(easy).alias("easy"), F.count_if(ok).alias("ok"))
    total = F.col("easy") + F.col("ok")
    share = F.bround(F.col("easy") * 10.0 / total, 0).cast("int")
    return sums.withColumn("meter", F.when(total <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(10), share))))
