"""Registered streaming queries: each runs its stream over the events table to the end and returns the sink's rows.

Sinks and checkpoints go to new folders below the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import commands as cx
from opsloom.plans import history as h
from opsloom.plans import views as v
from opsloom.session import shared_folder
from opsloom.sources import tail
from opsloom.streaming import history as st


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def drain(df: DataFrame) -> DataFrame:
    """Run a stream over all files present and read what it wrote."""
    spark = df.sparkSession
    base = _folder(spark)
    st.run_available(df, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def commands(spark: SparkSession, sf: str) -> DataFrame:
    """The derived commands as a stream: machine, ts, seq, command and the other columns."""
    st.use_rocksdb(spark)
    ev = st.read_commands(spark, sf, v.scan(spark, sf, "events").schema, names="events.parquet")
    return v.derive_commands(ev).withColumn("ts", F.timestamp_seconds("sec"))


def _write_files(rows: DataFrame, root: str, folder: str, part: str, name: str, shards: int = 1) -> None:
    """A file for each machine, its lines in order, written under another name (``part``) first; with ``folder`` in a folder of its own, below one of ``shards``.

    Executors write the files where they belong: with one file a machine, a writer that has its driver move each file into its place takes longer for that than for all else.
    """

    def of(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = (fs.FileSystem.from_uri(root)) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        system.create_dir(base, recursive=True)
        now, f, n, below = None, None, 0, ""

        def path(own: str) -> str:
            key = "__HIVE_DEFAULT_PARTITION__" if now is None else now
            return "/".join(x for x in (base, below, folder.format(key), own.format(key)) if x)

        def done():
            if f is not None:
                f.close()
                system.move(path(part), path(name))

        for batch in batches:
            machines, lines, shard = (batch[c].to_pylist() for c in ("machine", "line", "shard"))
            n += len(lines)
            for machine, run in groupby(range(len(lines)), key=machines.__getitem__):
                if f is None or machine != now:
                    done()
                    now = machine
                    if folder:
                        run = list(run)
                        below = str(shard[run[0]])
                        system.create_dir(path(""), recursive=False)
                    f = system.open_output_stream(path(part))
                if has := [lines[i] for i in run if lines[i] is not None]:
                    f.write("".join(f"{x}\n" for x in has).encode())
        done()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    for n in range(shards if folder else 0):  # also where there are no rows
        path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}")
        path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)
    shard = F.pmod(F.xxhash64("machine"), F.lit(shards)).cast("int").alias("shard")
    rows.select("machine", "line", "seq").repartition("machine").sortWithinPartitions("machine", "seq").select("machine", "line", shard).mapInArrow(of, "n bigint").agg(F.sum("n")).collect()


#: Machines whose files one stream follows: its driver lists them all and remembers them.
FOLLOWED = 45_000


def stream_history(spark, sf):
    """Shell history files, one folder per machine, written from the commands and read as a stream; of more machines than one stream follows, as several."""
    c = v.commands(spark, sf)
    base = _folder(spark)
    shards = -(-max(1, c.agg(F.approx_count_distinct("machine")).first()[0]) // FOLLOWED)
    line = F.concat(F.lit(": "), F.col("sec").cast("string"), F.lit(":0;"), "command")
    _write_files(c.select("machine", line.alias("line"), "seq"), f"{base}/history", "machine={}", "_part", "history", shards)
    out = reduce(DataFrame.unionByName, [drain(st.read_history(spark, f"{base}/history/{n}").drop("file")) for n in range(shards)])
    return out.groupBy("machine").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_timestamp("ts")).alias("last_sec"), F.count_distinct("command").alias("n_distinct"))


SQL_HIST = f"{h.C} SELECT concat('machine=', machine) AS machine, count(*) AS n, max(sec) AS last_sec, count(DISTINCT command) AS n_distinct FROM commands GROUP BY 1"


def stream_dedup(spark, sf):
    return drain(st.first_seen(commands(spark, sf)).select("machine", "command_hash"))


def stream_phase(spark, sf):
    return drain(st.phase_changes(commands(spark, sf), size=3)).select("machine", "seq", "previous_phase", "phase").withColumn("machine", F.col("machine").cast("long"))


def stream_cooldown(spark, sf):
    c = commands(spark, sf).filter(cx.feedback_signal("command").isNotNull()).withColumn("machine", F.col("machine").cast("string"))
    return drain(st.cooldown(c, 30, line="command")).select(F.col("machine").cast("long").alias("machine"), "seq")


def stream_feedback(spark, sf):
    """The plain throttle over both logs: commands, and feedback lines made from every third event."""
    c = commands(spark, sf).withColumn("machine", F.col("machine").cast("string"))
    f = commands(spark, sf).filter("k % 3 = 0").select(F.col("machine").cast("string").alias("machine"), (F.col("ts") + F.expr("interval 3 seconds")).alias("ts"), (F.col("seq") + 10_000_000).alias("seq"), F.lit("failed: x").alias("line"))
    both = st.with_feedback(c, f)
    return drain(st.cooldown(both, 20, guard=False)).select(F.col("machine").cast("long").alias("machine"), "seq")


SQL_FEED = f"""WITH RECURSIVE {v.SQL_COMMANDS}, b AS (SELECT machine, sec, seq FROM commands UNION ALL SELECT machine, sec + 3, seq + 10000000 FROM commands WHERE k % 3 = 0),
e AS (SELECT *, row_number() OVER (PARTITION BY machine ORDER BY sec, seq) AS pos FROM b),
f AS (SELECT machine, seq, pos, sec AS last, true AS fired FROM e WHERE pos = 1
 UNION ALL SELECT e.machine, e.seq, e.pos, CASE WHEN e.sec - f.last >= 20 THEN e.sec ELSE f.last END, e.sec - f.last >= 20 FROM f JOIN e ON e.machine = f.machine AND e.pos = f.pos + 1)
SELECT machine, seq FROM f WHERE fired"""


def stream_stall(spark, sf):
    """Retry loops, stalls and hint levels with small thresholds; timers fire up to the watermark."""
    c = commands(spark, sf).withColumn("command", F.col("event_type")).withColumn("machine", F.col("machine").cast("string"))
    s = st.stalls(c, stall=100, threshold=2, window=60, hints=(150, 1200), watermark="30 seconds")
    return drain(s).select(F.col("machine").cast("long").alias("machine"), F.floor("at").cast("long").alias("at"), "state", "retries")


SQL_STALLS = f"""{h.C}, {h._RETRY}, l AS (SELECT machine, max(sec) AS sec, arg_max(retries, (sec, seq)) AS retries FROM rt GROUP BY 1), wm AS (SELECT max(sec) - 30 AS w FROM commands)
SELECT machine, sec AS at, 'retry_loop' AS state, retries FROM rt WHERE retries >= 2
 UNION ALL SELECT machine, sec + 67, 'stalling', retries FROM l, wm WHERE retries < 2 AND sec + 67 <= w
 UNION ALL SELECT machine, sec + 100, 'stalled', retries FROM l, wm WHERE retries < 2 AND sec + 100 <= w
 UNION ALL SELECT machine, sec + 150, 'conceptual', retries FROM l, wm WHERE sec + 150 <= w
 UNION ALL SELECT machine, sec + 1200, 'direct', retries FROM l, wm WHERE sec + 1200 <= w"""


def stream_hint(spark, sf):
    """Commands and their output lines as two logs."""
    c = commands(spark, sf).withColumn("machine", F.col("machine").cast("string"))
    line = F.when(F.col("k") % 3 == 0, F.lit("short")).otherwise(F.repeat(F.lit("x y "), F.lit(60)))
    f = commands(spark, sf).filter("k % 2 = 1").select(F.col("machine").cast("string").alias("machine"), (F.col("ts") + F.expr("interval 3 seconds")).alias("ts"), (F.col("seq") + 10_000_000).alias("seq"), line.alias("line"))
    out = drain(st.json_hints(st.with_feedback(c, f)))
    return out.select(F.col("machine").cast("long").alias("machine"), F.col("command_seq").alias("seq"), (F.col("line_seq") - 10_000_000).alias("line_id"))


# ---------------------------------------------------------------- growing logs
#: What the logs hold at each look, by the event's number: grown, rotated to a part of it, grown again.
LOOKS = ("k % 3 = 0", "k % 3 <> 2", "k % 3 = 1 AND k % 2 = 0", "k % 2 = 0")


def stream_tail(spark, sf):
    """Logs that grow, are rotated and grow again, looked at after each step by a stream that stops and goes on from its checkpoint.

    A log holds at each look the events that LOOKS says, those of an earlier look first.
    """
    st.use_rocksdb(spark)
    c = v.commands(spark, sf)
    base = _folder(spark)
    root = f"{base}/logs"
    grown = F.when(F.expr(LOOKS[0]), 0).otherwise(1)
    again = F.when(F.expr(LOOKS[2]), 0).otherwise(1)
    for look, first in zip(LOOKS, (grown, grown, again, again), strict=True):
        line = F.when(F.expr(look), F.col("command"))
        # A rewritten log with more lines has grown.
        _write_files(c.select("machine", line.alias("line"), (first.cast("long") * 10_000_000_000 + F.col("seq")).alias("seq")), root, "", "{}.part", "{}.log")
        st.run_available(tail.new_commands(tail.tail(spark, root, ".log", 4096)), f"{base}/out", f"{base}/checkpoint")
    out = spark.read.schema("file string, place bigint, command string").parquet(f"{base}/out")
    return out.groupBy(F.regexp_extract("file", r"(\d+)\.log$", 1).cast("long").alias("machine"), "command").agg(F.count(F.lit(1)).alias("n"))


SQL_TAIL = f"""{h.C}, a AS (SELECT DISTINCT machine, trim(command) AS command FROM commands WHERE {LOOKS[1]}), had AS (SELECT DISTINCT machine, trim(command) AS command FROM commands WHERE {LOOKS[2]}),
b AS (SELECT DISTINCT machine, trim(command) AS command FROM commands WHERE {LOOKS[3]} EXCEPT SELECT * FROM had)
SELECT machine, command, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE command <> '' GROUP BY 1, 2"""


DELAY = 600


def stream_late(spark, sf):
    """Commands in three folders by time, every tenth one a folder later than it should be; counts of kept and late rows per machine."""
    c = v.commands(spark, sf).withColumn("ts", F.timestamp_seconds("sec"))
    low, high = c.agg(F.min("sec"), F.max("sec")).first()
    third = (high - low) // 3 + 1
    part = F.floor((F.col("sec") - low) / third) + F.when(F.col("k") % 10 == 0, 1).otherwise(0)
    base = _folder(spark)
    split = st.late_splitter(f"{base}/kept", f"{base}/late", f"{base}/marks", DELAY)
    for n in range(4):
        c.filter(part == n).select("machine", "ts", "seq").write.mode("append").parquet(f"{base}/in")
        stream = st.read_commands(spark, f"{base}/in", "machine bigint, ts timestamp, seq bigint")
        stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = None
    for name in ("kept", "late"):
        rows = spark.read.schema("machine bigint, ts timestamp, seq bigint, batch_id bigint").parquet(f"{base}/{name}").withColumn("sink", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("machine", "sink").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


SQL_LATE = f"""{h.C}, lim AS (SELECT min(sec) AS low, (max(sec) - min(sec)) // 3 + 1 AS third FROM commands),
p AS (SELECT machine, sec, seq, (sec - low) // third + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS part FROM commands, lim),
w AS (SELECT part, max(max(sec)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DELAY} AS mark FROM p GROUP BY part)
SELECT machine, CASE WHEN sec < mark THEN 'late' ELSE 'kept' END AS sink, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM p JOIN w USING (part) GROUP BY 1, 2"""


QUERIES = {
    "stream_history": (stream_history, SQL_HIST),
    "stream_dedup": (stream_dedup, f"{h.C} SELECT DISTINCT machine, sha256(command) AS command_hash FROM commands"),
    "stream_phase": (stream_phase, h.SQL_CHANGES),
    "stream_cooldown": (stream_cooldown, h.SQL_GUARDED),
    "stream_feedback": (stream_feedback, SQL_FEED),
    "stream_stall": (stream_stall, SQL_STALLS),
    "stream_hint": (stream_hint, h.SQL_PENDING),
    "stream_tail": (stream_tail, SQL_TAIL),
    "stream_late": (stream_late, SQL_LATE),
}
