"""History rules as Structured Streaming jobs.

The rules are those of ``operators.history``, on event time: ``ts`` (timestamp) with a
watermark for late rows and for the end of state.  Keyed rules use ``transformWithState``
(RocksDB state store); a key's rows of one micro-batch are put in event order first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsloom import rules
from opsloom.functions import commands as cx
from opsloom.functions import text as tx
from opsloom.operators.history import annotate

WATERMARK = "10 minutes"
#: State of a key without rows for so long (in event time) ends, where a rule by itself would keep it for ever.
IDLE_SECONDS = 30 * 86_400
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COMMAND_SCHEMA = "machine string, ts timestamp, seq bigint, command string"


#: Folders are listed by so many tasks at most, as each task sends its own counters to the driver, and opening a file counts as reading so many bytes.
SMALL_FILES = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "64", "spark.sql.files.openCostInBytes": str(64 << 10)}
#: History segments of a batch: a batch takes the driver seconds however little it holds, and holds no state.
HISTORY_FILES = 50_000


@contextmanager
def small_files(spark: SparkSession) -> Iterator[None]:
    """While a stream over very many small files or folders is set up or runs: few tasks list them and few read them.

    A file source lists and reads by the settings of the session that it was made in, at the time of each batch.
    """
    before = {k: spark.conf.get(k) for k in SMALL_FILES}
    for k, v in SMALL_FILES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def use_rocksdb(spark: SparkSession) -> None:
    """``transformWithState`` needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# ---------------------------------------------------------------- sources
def read_history(spark: SparkSession, path: str, max_files: int = HISTORY_FILES) -> DataFrame:
    """Shell history segments of many machines, one text line per row.

    A segment is a file that is complete when it appears (rotated); the checkpoint
    remembers the files seen, the machine is the folder name.
    """
    with small_files(spark):
        found = spark.readStream.format("text").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(path)
    lines = found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("arrived"))
    line = tx.strip("value")
    is_zsh = line.startswith(": ") & line.contains(";")
    command = (
        F.when(is_zsh, tx.strip(F.regexp_extract(line, r"(?s)^[^;]*;(.*)$", 1)))
        .when(line.startswith("- cmd:"), tx.strip(F.substring(line, 7, 1 << 30)))
        .otherwise(line)
    )
    epoch = F.expr(r"try_cast(nullif(regexp_extract(value, '^\\s*: (\\d+):', 1), '') as bigint)")
    return lines.select(
        F.substring_index(F.substring_index("file", "/", -2), "/", 1).alias("machine"),
        "file",
        F.coalesce(F.timestamp_seconds(epoch), "arrived").alias("ts"),
        command.alias("command"),
    ).filter(F.col("command") != "")


def read_commands(spark: SparkSession, path: str, schema: str | T.StructType = COMMAND_SCHEMA, max_files: int = 1000, fmt: str = "parquet", names: str = "*") -> DataFrame:
    """Command rows from the files of a folder whose names match ``names``."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", names).load(path)


def with_feedback(commands: DataFrame, feedback: DataFrame) -> DataFrame:
    """Both logs as one stream with a ``kind``: command or feedback (machine, ts, seq, kind, line)."""
    left = commands.select("machine", "ts", "seq", F.lit("command").alias("kind"), F.col("command").alias("line"))
    right = feedback.select("machine", "ts", "seq", F.lit("feedback").alias("kind"), "line")
    return left.unionByName(right)


# ---------------------------------------------------------------- stateless and built-in state
def first_seen(commands: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """New commands only: repeats within the watermark are dropped, which also absorbs replayed files."""
    hashed = commands.withWatermark("ts", watermark).withColumn("command_hash", cx.command_hash("command"))
    return hashed.dropDuplicatesWithinWatermark(["machine", "command_hash"])


def events(commands: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """New commands with the per-row event fields."""
    return annotate(first_seen(commands, watermark))


# ---------------------------------------------------------------- keyed state
def _seconds(ts) -> float:
    return ts.timestamp()


def _ordered(rows: Iterator[Row]) -> list[Row]:
    """Rows (machine, ts, seq, ...) of one key in one micro-batch, whose size the source's rate option bounds, in the order of ts and seq."""
    return sorted(rows, key=itemgetter(1, 2))


def _end_at(handle: StatefulProcessorHandle, seconds: float) -> None:
    """One timer per key, for the end of its state."""
    _no_end(handle)
    handle.registerTimer(int(seconds * 1000))


def _no_end(handle: StatefulProcessorHandle) -> None:
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)


class Cooldown(StatefulProcessor):
    """Fires when the line is new and ``seconds`` passed since the last row that fired.

    State ends with an event-time timer: ``seconds`` after the last row that fired, when nothing depends on it any more; with the
    guard, which remembers lines, ``idle`` seconds after the last row.
    """

    def __init__(self, seconds: float, seen_limit: int, guard: bool, idle: float):
        self.seconds, self.seen_limit, self.guard, self.idle = seconds, seen_limit, guard, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("at", T.DoubleType())]))
        self.seen = handle.getMapState(
            "seen", T.StructType([T.StructField("line", T.StringType())]), T.StructType([T.StructField("at", T.DoubleType())])
        )

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        size = sum(1 for _ in self.seen.keys()) if self.guard else 0
        at = None
        for row in _ordered(rows):
            at = _seconds(row.ts)
            if last is not None and at - last < self.seconds:
                continue
            digest = (row.line_hash,)
            if self.guard and self.seen.containsKey(digest):
                continue
            last = at
            if self.guard:
                self.seen.updateValue(digest, (at,))
                size += 1
                if size > self.seen_limit:
                    self.seen.clear()
                    size = 0
            yield Row(machine=key[0], ts=row.ts, seq=row.seq, line=row.line)
        if last is not None:
            self.last.update((last,))
            _end_at(self.handle, (at or last) + self.idle if self.guard else last + self.seconds)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


FIRED = "machine string, ts timestamp, seq bigint, line string"


def cooldown(
    lines: DataFrame, seconds: float = rules.COOLDOWN_SECONDS, guard: bool = True, seen_limit: int = rules.SEEN_LIMIT, line: str = "line", watermark: str = WATERMARK, idle: float = IDLE_SECONDS
) -> DataFrame:
    """Feedback lines with a signal that fire; with ``guard=False`` the plain throttle.  Lines are remembered until their key had no row for ``idle`` seconds."""
    hashed = lines.withWatermark("ts", watermark).select("machine", "ts", "seq", F.col(line).alias("line"), cx.command_hash(line).alias("line_hash"))
    return hashed.groupBy("machine").transformWithState(
        statefulProcessor=Cooldown(seconds, seen_limit, guard, idle), outputStructType=FIRED, outputMode="append", timeMode="eventTime"
    )


class Stall(StatefulProcessor):
    """Reports retry loops as they happen, stalling and stalled keys by event-time timers, and hint levels."""

    def __init__(self, stall: float, threshold: int, window: float, hints: Sequence[float]):
        self.stall, self.threshold, self.window, self.hints = stall, threshold, window, tuple(hints)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "state",
            T.StructType([T.StructField("at", T.DoubleType()), T.StructField("command", T.StringType()), T.StructField("retries", T.LongType())]),
        )

    def marks(self) -> list[tuple[float, str]]:
        by_time: dict[float, str] = {}
        for after, name in ((self.stall * rules.STALLING_SHARE, "stalling"), (self.stall, "stalled"), *zip(self.hints, rules.HINT_LEVELS[1:])):
            by_time[after] = f"{by_time[after]},{name}" if after in by_time else name
        return sorted(by_time.items())

    def handleInputRows(self, key, rows, timerValues):
        at, command, retries = self.state.get() if self.state.exists() else (None, None, 0)
        for row in _ordered(rows):
            now = _seconds(row.ts)
            if at is not None and row.command == command and now - at < self.window:
                retries += 1
                if retries >= self.threshold:
                    yield Row(machine=key[0], at=now, state="retry_loop", command=row.command, retries=retries)
            else:
                retries = 0
            at, command = now, row.command
        if at is None:
            return
        self.state.update((at, command, retries))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for after in {a for a, _ in self.marks()} | {self.end()}:
            self.handle.registerTimer(int((at + after) * 1000))

    def end(self) -> float:
        """Seconds after a row when no rule depends on it any more."""
        return max([self.window, *(after for after, _ in self.marks())])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.state.exists():
            return
        at, command, retries = self.state.get()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        for after, name in self.marks():
            if int((at + after) * 1000) == fired:
                for part in name.split(","):
                    # A retry loop outranks the time-based stall states.
                    if retries >= self.threshold and part in ("stalling", "stalled"):
                        continue
                    yield Row(machine=key[0], at=fired / 1000.0, state=part, command=command, retries=retries)
        if int((at + self.end()) * 1000) == fired:
            self.state.clear()

    def close(self) -> None:
        pass


STALLS = "machine string, at double, state string, command string, retries bigint"


def stalls(
    commands: DataFrame,
    stall: float = rules.STALL_SECONDS,
    threshold: int = rules.RETRY_THRESHOLD,
    window: float = rules.RETRY_SECONDS,
    hints: Sequence[float] = rules.HINT_SECONDS,
    watermark: str = WATERMARK,
) -> DataFrame:
    """retry_loop rows at once; stalling, stalled, conceptual and direct when the watermark passes their time."""
    rows = commands.withWatermark("ts", watermark).select("machine", "ts", "seq", "command")
    return rows.groupBy("machine").transformWithState(
        statefulProcessor=Stall(stall, threshold, window, hints), outputStructType=STALLS, outputMode="append", timeMode="eventTime"
    )


class Phase(StatefulProcessor):
    """Emits a row when the phase over the last ``size`` commands changes; a key without rows for ``idle`` seconds starts anew."""

    def __init__(self, size: int, idle: float):
        self.size, self.idle = size, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState(
            "recent", T.StructType([T.StructField("current", T.StringType()), T.StructField("phases", T.ArrayType(T.StringType()))])
        )

    def handleInputRows(self, key, rows, timerValues):
        current, phases = self.recent.get() if self.recent.exists() else (rules.PHASE_IDLE, [])
        phases, at = list(phases), None
        for row in _ordered(rows):
            at = _seconds(row.ts)
            phases = (phases + [row.rule or ""])[-self.size :]
            found = next((p for p in reversed(phases) if p), rules.PHASE_IDLE)
            if found != current:
                yield Row(machine=key[0], ts=row.ts, seq=row.seq, previous_phase=current, phase=found)
                current = found
        self.recent.update((current, phases))
        if at is not None:
            _end_at(self.handle, at + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.recent.clear()
        return iter(())

    def close(self) -> None:
        pass


PHASES = "machine string, ts timestamp, seq bigint, previous_phase string, phase string"


def phase_changes(commands: DataFrame, size: int = rules.CONTEXT_LIMIT, watermark: str = WATERMARK, idle: float = IDLE_SECONDS) -> DataFrame:
    rated = commands.withWatermark("ts", watermark).select(F.col("machine").cast("string").alias("machine"), "ts", "seq", cx.command_phase("command").alias("rule"))
    return rated.groupBy("machine").transformWithState(
        statefulProcessor=Phase(size, idle), outputStructType=PHASES, outputMode="append", timeMode="eventTime"
    )


#: What a row does to a pending hint; ALIVE only shows that its key goes on.
OTHER_COMMAND, WANTS_JSON, LONG_QUIET, ALIVE = 0, 1, 2, 3


class Hint(StatefulProcessor):
    """First long quiet feedback line after a command that should have used JSON, within ``idle`` seconds of the key's last row.

    Takes a key's rows as frames: rows of most keys only pass by, and making a row of Python values of each was nearly all of the time.
    """

    def __init__(self, idle: float):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", T.StructType([T.StructField("seq", T.LongType()), T.StructField("command", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues):
        before = pending = self.pending.get() if self.pending.exists() else None
        frame = pd.concat(list(rows))
        at, seq, act, line = (frame[c].to_numpy() for c in ("at", "seq", "act", "line"))
        turn, out, last = np.lexsort((seq, at)), [], int(at.max())
        for i in turn[act[turn] != ALIVE].tolist():
            if act[i] == WANTS_JSON:
                pending = (int(seq[i]), line[i])
            elif act[i] == OTHER_COMMAND:
                pending = None
            elif pending is not None:
                out.append((key[0], int(at[i]), *pending, int(seq[i])))
                pending = None
        if out:
            yield pd.DataFrame(out, columns=["machine", "at", "command_seq", "command", "line_seq"])
        # Every call goes to the state store: a key without a pending command has neither state nor timer.
        if pending is not None:
            self.pending.update(tuple(pending))
            end = last / 1e6 + self.idle
            if before is None:
                self.handle.registerTimer(int(end * 1000))
            else:
                _end_at(self.handle, end)
        elif before is not None:
            self.pending.clear()
            _no_end(self.handle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.pending.clear()
        return iter(())

    def close(self) -> None:
        pass


HINTS = "machine string, at bigint, command_seq bigint, command string, line_seq bigint"


def json_hints(both: DataFrame, watermark: str = WATERMARK, idle: float = IDLE_SECONDS) -> DataFrame:
    """``both``: the union made by ``with_feedback``."""
    quiet = (F.col("kind") == "feedback") & cx.feedback_signal("line").isNull() & (F.length(tx.strip("line")) > rules.LONG_OUTPUT_CHARS)
    wants = (F.col("kind") == "command") & cx.needs_json_hint("line")
    act = F.when(wants, WANTS_JSON).when(F.col("kind") == "command", OTHER_COMMAND).when(quiet, LONG_QUIET).otherwise(ALIVE)
    # Rows go to Python with what the rule needs: numbers, and the text of the commands that may be pending, of no others.
    rows = both.withWatermark("ts", watermark).select("machine", "ts", F.unix_micros("ts").alias("at"), "seq", act.alias("act"), F.when(wants, F.col("line")).alias("line"))
    hints = rows.groupBy("machine").transformWithStateInPandas(
        statefulProcessor=Hint(idle), outputStructType=HINTS, outputMode="append", timeMode="eventTime"
    )
    return hints.select("machine", F.timestamp_micros("at").alias("ts"), "command_seq", "command", "line_seq")


# ---------------------------------------------------------------- late rows
def late_splitter(kept: str, late: str, marks: str, delay: float, at: str = "ts"):
    """``foreachBatch`` function: rows later than the watermark go to a side sink instead of being lost.

    The watermark of a batch is the latest time of all batches before it less ``delay`` seconds (stateful operators look one batch further back).  Rows, late rows and the
    latest time are written by batch, so a batch that is run again takes its own place.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
        before = _marks(spark, marks).filter(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
        is_late = F.lit(False) if before is None else F.col(at) < F.lit(before) - F.make_dt_interval(secs=F.lit(float(delay)))
        own = own.withColumn("_late", F.coalesce(is_late, F.lit(False)))
        for path, rows in ((late, own.filter("_late")), (kept, own.filter("NOT _late")), (marks, own.agg(F.max(at).alias("latest"), F.max("batch_id").alias("batch_id")).filter("batch_id IS NOT NULL"))):
            rows.drop("_late").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return split


def _marks(spark: SparkSession, path: str) -> DataFrame:
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], "latest timestamp, batch_id long")
    return spark.read.schema("latest timestamp, batch_id long").parquet(path)


def dropped_by_watermark(query) -> int:
    """Rows that the stateful operators of a query dropped as late, over its recent progress."""
    return sum(int(o.numRowsDroppedByWatermark) for p in query.recentProgress for o in p.stateOperators)


# ---------------------------------------------------------------- running
def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Process all files present, then stop; a restart goes on from the checkpoint."""
    with small_files(df.sparkSession):
        query = (
            df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return query
