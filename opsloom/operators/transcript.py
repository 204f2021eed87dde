"""Conversations, thoughts, per-machine state and request traces.

Conversations are numbered by ``with_position`` over blocks of turns, so one endless
conversation is not one task; texts that are joined per conversation come in parts of a
bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom import rules
from opsloom.functions import text as tx
from opsloom.functions.matching import block_similarity
from opsloom.operators.ordered import BLOCK_ROWS, own_rows, with_lookback, with_position

KEYS = ("conv_id",)
TURN_BLOCK = 10_000


def token_estimate(c: Column | str) -> Column:
    return F.floor(F.length(tx.strip(tx.text_or_empty(c))) / 4).cast("long")


def number_turns(df: DataFrame, keys: Sequence[str] = KEYS, turn: str = "turn", block: int = TURN_BLOCK) -> DataFrame:
    return with_position(df, keys, [turn], F.floor(F.col(turn) / block).cast("long"))


def context_tokens(
    turns: DataFrame, commands: DataFrame | None = None, keys: Sequence[str] = KEYS, text: str = "text", order: Sequence[str] = ("turn",), command: str = "command", last: int = rules.CONTEXT_COMMANDS
) -> DataFrame:
    """Tokens of the joined transcript plus those of the last commands.

    The joined text is never built: its stripped length is the sum of lengths plus the
    separators, less the blank ends.  Those lie in the first and last turn with text and
    in blank turns outside them, and only blank turns have to be joined to find out.
    """
    keys = list(keys)
    body = tx.text_or_empty(text)
    size = F.length(body)
    solid = tx.strip(body) != ""
    lead = F.struct(*order, (size - F.length(tx.lstrip(body))).alias("cut"))
    tail = F.struct(*order, (size - F.length(tx.rstrip(body))).alias("cut"))
    sums = turns.groupBy(*keys).agg(
        F.sum(size + 1).alias("_chars"), F.min(F.when(solid, lead)).alias("_lead"), F.max(F.when(solid, tail)).alias("_tail")
    )
    here = F.struct(*order)
    outside = (here < F.struct(*[F.col("_lead")[o].alias(o) for o in order])) | (here > F.struct(*[F.col("_tail")[o].alias(o) for o in order]))
    blank = (
        turns.filter(~solid).join(sums.filter(F.col("_lead").isNotNull()).select(*keys, "_lead", "_tail"), keys)
        .filter(outside).groupBy(*keys).agg(F.sum(size + 1).alias("_blank"))
    )
    chars = F.col("_chars") - 1 - F.coalesce("_blank", F.lit(0)) - F.col("_lead.cut") - F.col("_tail.cut")
    out = sums.join(blank, keys, "left").select(
        *keys, F.floor(F.coalesce(chars, F.lit(0)) / 4).cast("long").alias("transcript_tokens")
    )
    if commands is None:
        return out.withColumn("context_tokens", F.col("transcript_tokens"))
    w = Window.partitionBy(*keys).orderBy(F.desc("sec"), F.desc("seq"))
    recent = commands.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    joined = recent.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_n", command)), asc=False).alias("_l"))
    tokens = joined.select(*keys, token_estimate(F.array_join(F.transform("_l", lambda e: e[command]), "\n")).alias("command_tokens"))
    return (
        out.join(tokens, list(keys), "left")
        .withColumn("context_tokens", F.col("transcript_tokens") + F.coalesce("command_tokens", F.lit(0)))
        .drop("command_tokens")
    )


def is_spoken(role: Column | str) -> Column:
    return tx.col(role).isin("user", "assistant")


def condense_flag(turns: DataFrame, keys: Sequence[str] = KEYS, after: int = rules.CONDENSE_AFTER) -> DataFrame:
    return turns.groupBy(*keys).agg(F.count_if(is_spoken("role")).alias("spoken_turns")).withColumn("condense", F.col("spoken_turns") >= after)


def _prefix_sum(numbered: DataFrame, keys: Sequence[str], value: Column, out: str, total: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sum of ``value`` over all rows up to and including each row, and over the whole key, by blocks."""
    keys = list(keys)
    tagged = numbered.withColumn("_v", value.cast("long")).withColumn("_blk", F.floor(F.col("pos") / block_rows).cast("long"))
    sums = tagged.groupBy(*keys, "_blk").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        *keys, "_blk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_c"), F.sum("_s").over(Window.partitionBy(*keys)).alias(total)
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.join(carry, [*keys, "_blk"]).withColumn(out, F.col("_c") + F.sum("_v").over(inside)).drop("_v", "_blk", "_c")


def condense_split(numbered: DataFrame, keys: Sequence[str] = KEYS, window: int = rules.CONDENSE_WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """part = head for rows up to the one where the spoken turns reach ``window``; else tail.

    A row is in the head while fewer than ``window`` spoken turns precede it.  Keys with
    fewer spoken turns have no head.
    """
    spoken = is_spoken("role").cast("int")
    counted = _prefix_sum(numbered, keys, spoken, "_spoken", "_all", block_rows)
    head = (F.col("_all") >= window) & (F.col("_spoken") - spoken < window)
    return counted.withColumn("part", F.when(head, "head").otherwise("tail")).drop("_spoken", "_all")


def prune_limits(max_tokens: int) -> tuple[int, int]:
    """Character threshold and target of the budget prune."""
    chars = max_tokens * rules.CHARS_PER_TOKEN
    return int(chars * rules.PRUNE_SHARE), int(chars * rules.PRUNE_TARGET_SHARE)


def budget_prune(
    numbered: DataFrame, threshold: int, target: int, keys: Sequence[str] = KEYS, text: str = "text", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Flag the oldest rows to drop in keys above the threshold: drop until total - target is gone."""
    size = F.length(tx.text_or_empty(text))
    summed = _prefix_sum(numbered, keys, size, "_upto", "_total", block_rows)
    dropped = (F.col("_total") > threshold) & (F.col("_upto") - size < F.col("_total") - target)
    return summed.withColumn("dropped", dropped).drop("_upto", "_total")


def transcript_blob(numbered: DataFrame, keys: Sequence[str] = KEYS, text: str = "text", part_rows: int = 1000) -> DataFrame:
    """``role: text`` lines per key, in numbered parts of at most ``part_rows`` rows."""
    line = F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), tx.text_or_empty(text))
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return (
        numbered.withColumn("blob_part", F.floor(F.col("pos") / part_rows).cast("long"))
        .groupBy(*keys, "blob_part")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("blob"))
    )


def repetition(
    numbered: DataFrame, keys: Sequence[str] = KEYS, text: str = "text", ratio: float = rules.REPEAT_RATIO, exact: bool = False, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Assistant replies with their similarity to the assistant reply before.

    similarity = 1 - edit distance / longer length, computed in the JVM; with ``exact`` it is the
    ratio of the longest matching blocks (``functions/matching.py``).
    """
    replies = numbered.filter(F.col("role") == "assistant").withColumnRenamed("pos", "_old")
    own = with_position(replies, keys, ["_old"], F.floor(F.col("_old") / block_rows).cast("long"))
    w = Window.partitionBy(*keys, "_blk").orderBy("pos")
    lent = with_lookback(own, 1, block_rows=block_rows).withColumn("_prev", F.lag(text).over(w))
    longer = F.greatest(F.length(text), F.length("_prev"))
    sim = block_similarity("_prev", text) if exact else 1.0 - F.levenshtein(F.col(text), F.col("_prev")) / longer
    usable = (F.coalesce(F.col("_prev"), F.lit("")) != "") & (F.col(text) != "")
    return (
        own_rows(lent)
        .withColumn("similarity", F.when(usable, F.round(sim, 6)))
        .withColumn("repetitive", F.coalesce(F.col("similarity") >= ratio, F.lit(False)))
        .drop("_prev", "pos")
        .withColumnRenamed("_old", "pos")
    )


def dedupe_messages(
    numbered: DataFrame, keys: Sequence[str] = KEYS, fields: Sequence[str] = ("role", "content", "reasoning_content"), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Drop rows equal (null as empty) to the row before."""
    now = F.struct(*[tx.text_or_empty(f).alias(f) for f in fields])
    w = Window.partitionBy(*keys, "_blk").orderBy("pos")
    lent = with_lookback(numbered, 1, block_rows=block_rows).withColumn("_prev", F.lag(now).over(w))
    return own_rows(lent).filter(~now.eqNullSafe(F.col("_prev"))).drop("_prev")


def thought_tail(
    thoughts: DataFrame, keys: Sequence[str] = ("machine",), order: Sequence[str] = ("seq",), text: str = "thought", keep: int = rules.THOUGHT_KEEP, read: int = rules.THOUGHT_READ, chars: int = rules.THOUGHT_CHARS
) -> DataFrame:
    """The last thoughts joined, cut to the last ``chars`` characters (blank ones do not count)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    solid = thoughts.withColumn("_t", tx.strip(tx.text_or_empty(text))).filter(F.col("_t") != "")
    last = solid.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= min(keep, read))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_t")), asc=False), lambda e: e["_t"]), "\n\n")
    return last.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_thoughts"), F.right(joined, F.lit(chars)).alias("buffer"))


def latest_state(
    states: DataFrame, keys: Sequence[str] = ("machine",), at: str = "updated_at", tie: str | None = None, ttl_days: int | None = rules.STATE_TTL_DAYS, now: Column | None = None
) -> DataFrame:
    """Newest row per key, unless it expired."""
    order = F.struct(at, tie) if tie else F.col(at)
    fields = [c for c in states.columns if c not in keys]
    newest = states.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("_s")).select(*keys, "_s.*")
    if ttl_days is None or now is None:
        return newest
    return newest.filter(F.col(at) > now - F.make_dt_interval(days=F.lit(ttl_days)))


def with_defaults(machines: DataFrame, states: DataFrame, keys: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    """State per machine; a machine without one has an empty context."""
    joined = machines.select(*keys).distinct().join(states, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def after_summary(rows: DataFrame, keys: Sequence[str], order: str, marker: Column) -> DataFrame:
    """Rows from the latest summary marker on (keys without marker keep all rows)."""
    last = rows.filter(marker).groupBy(*keys).agg(F.max(order).alias("_m"))
    return rows.join(last, list(keys), "left").filter(F.col("_m").isNull() | (F.col(order) >= F.col("_m"))).drop("_m")


def delete_by_key(rows: DataFrame, gone: DataFrame, keys: Sequence[str] = ("machine",)) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def request_key(system: Column, user: Column, model: Column, temperature: Column, extra: Column) -> Column:
    """SHA-256 over the request; ``extra`` is JSON text and counts by its sorted form, with a blank after each comma and colon outside of its strings."""
    sorted_extra = F.coalesce(F.to_json(F.try_parse_json(extra)), F.lit("{}"))
    text = r'"(?:[^"\\]|\\.)*+"'
    spaced = F.regexp_replace(F.regexp_replace(sorted_extra, rf'\G((?:[^",]|{text})*+),', "$1, "), rf'\G((?:[^":]|{text})*+):', "$1: ")
    return F.sha2(F.concat_ws("\n", system, user, model, temperature.cast("string"), F.left(F.sha2(spaced, 256), F.lit(16))), 256)


def repeated_requests(requests: DataFrame, key: str = "request_key") -> DataFrame:
    return requests.groupBy(key).agg(F.count(F.lit(1)).alias("n_requests")).withColumn("cache_hits", F.col("n_requests") - 1)


def prompt_flags(df: DataFrame, text: str = "text") -> DataFrame:
    body = tx.text_or_empty(text)
    return df.withColumn("show_reasoning", body.rlike(rules.SHOW_REASONING)).withColumn("asks_wrong", body.rlike(rules.ASK_WRONG))


def session_snapshot(turns: DataFrame, phased: DataFrame, meters: DataFrame, reason: str, keys: Sequence[str] = ("machine",), part_rows: int = 1000) -> DataFrame:
    """Snapshot rows ready for ``write.json``: head (part -1) with phase and meter, then chat and command parts.

    ``turns``: keys, pos, role, text; ``phased``: keys, pos, command, phase; ``meters``: keys, meter.
    """
    keys = list(keys)
    from opsloom.operators.corpus import last_code_block

    phase = phased.groupBy(*keys).agg(F.max_by("phase", "pos").alias("phase"))
    code = turns.withColumn("_c", last_code_block("text")).filter(F.col("_c").isNotNull()).groupBy(*keys).agg(F.max_by("_c", "pos").alias("last_code_block"))
    names = phased.select(*keys).union(turns.select(*keys)).distinct()
    head = (
        names.join(phase, keys, "left").join(meters.select(*keys, "meter"), keys, "left").join(code, keys, "left")
        .select(*keys, F.lit("head").alias("kind"), F.lit(0).cast("long").alias("part"), F.to_json(F.struct(
            F.lit(reason).alias("reason"), F.coalesce("phase", F.lit(rules.PHASE_IDLE)).alias("phase"),
            F.coalesce("meter", F.lit(0)).alias("meter"), F.coalesce("last_code_block", F.lit("")).alias("last_code_block"),
        )).alias("payload"))
    )

    def parts(rows: DataFrame, kind: str, *fields: str) -> DataFrame:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", *fields))), lambda s: s.dropFields("pos"))
        return (
            rows.withColumn("part", F.floor(F.col("pos") / part_rows).cast("long"))
            .groupBy(*keys, "part")
            .agg(F.to_json(listed).alias("payload"))
            .select(*keys, F.lit(kind).alias("kind"), "part", "payload")
        )

    return head.unionByName(parts(turns, "chat", "role", "text")).unionByName(parts(phased, "history", "command"))


def request_context(requests: DataFrame, commands: DataFrame, references: DataFrame, outputs: DataFrame, keys: Sequence[str] = ("machine",), last: int = rules.CONTEXT_COMMANDS) -> DataFrame:
    """Message body per request: latest input, last commands, failure flag, reference block and shortened output.

    ``requests``: query_id, keys, input; ``commands``: keys, sec, seq, command;
    ``references``: query_id, reference_block; ``outputs``: query_id, summary.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(F.desc("sec"), F.desc("seq"))
    recent = commands.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last)
    block = recent.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "command")), asc=False), lambda e: F.concat(F.lit("- "), e["command"])), "\n").alias("_cmds")
    )
    none = F.lit("- none")

    def or_none(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), none)

    joined = requests.join(block, keys, "left").join(references, "query_id", "left").join(outputs, "query_id", "left")
    return joined.select(
        "query_id", *keys,
        tx.text_or_empty("summary").rlike(rules.NOT_FOUND).alias("not_found"),
        F.coalesce("reference_block", F.lit("Reference Material: none")).alias("reference_block"),
        F.concat_ws(
            "\n\n",
            F.concat(F.lit("Latest Command/Input:\n"), or_none("input")),
            F.concat(F.lit("Historical Commands:\n"), or_none("_cmds")),
            F.concat(F.lit("Minified tool output:\n"), or_none("summary")),
            F.concat(F.lit("User prompt:\n"), tx.text_or_empty("input")),
        ).alias("user_message"),
    )

