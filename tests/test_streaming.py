"""Streaming forms against the batch forms of the same rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsloom.operators import history as hi
from opsloom.operators.ordered import seconds_bucket
from opsloom.streaming import history as st

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def rocksdb(spark):
    st.use_rocksdb(spark)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def land(spark, rows, schema, path, files):
    """Write rows as several files, one write per file, so that availableNow sees several."""
    for part in files:
        spark.createDataFrame([r for r in rows if part(r)], schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, tmp_path, rows, schema=st.COMMAND_SCHEMA, files=None, name="in"):
    path = str(tmp_path / name)
    land(spark, rows, schema, path, files or [lambda r: True])
    return st.read_commands(spark, path, schema, max_files=1)


def collect(spark, df, tmp_path, name="out"):
    out, cp = str(tmp_path / name), str(tmp_path / (name + "_cp"))
    q = st.run_available(df, out, cp)
    assert q.exception() is None
    return spark.read.parquet(out)


def test_dedup_absorbs_replayed_file_and_late_rows(spark, tmp_path):
    rows = [("m", at(0), 1, "ls  -la"), ("m", at(5), 2, "ls -la"), ("m", at(6), 3, "id")]
    src = str(tmp_path / "in")
    land(spark, rows, st.COMMAND_SCHEMA, src, [lambda r: True])
    df = st.first_seen(st.read_commands(spark, src))
    got = collect(spark, df, tmp_path)
    assert {r.command for r in got.collect()} == {"ls  -la", "id"} or {r.command for r in got.collect()} == {"ls -la", "id"}
    # The same content again (a replay), a newer row that moves the watermark, then a late row.
    land(spark, rows, st.COMMAND_SCHEMA, src, [lambda r: True])
    land(spark, [("m", at(7200), 4, "whoami")], st.COMMAND_SCHEMA, src, [lambda r: True])
    collect(spark, df, tmp_path)
    land(spark, [("m", at(10), 5, "late one")], st.COMMAND_SCHEMA, src, [lambda r: True])
    after = collect(spark, df, tmp_path)
    commands = [r.command for r in after.collect()]
    assert sorted(c.replace("  ", " ") for c in commands) == ["id", "ls -la", "whoami"]


def test_history_files_of_many_machines(spark, tmp_path):
    for machine in ("lame", "cap"):
        d = tmp_path / "hist" / machine
        d.mkdir(parents=True)
        (d / "seg1").write_text(": 1700000000:0;cd /tmp\n\n: 1700000001:0;ls -la\n- cmd: whoami\n")
    got = collect(spark, st.read_history(spark, str(tmp_path / "hist")), tmp_path).collect()
    assert sorted((r.machine, r.command) for r in got) == sorted((m, c) for m in ("lame", "cap") for c in ("cd /tmp", "ls -la", "whoami"))
    assert {r.ts.year for r in got if r.command == "ls -la"} == {2023}


def test_cooldown_equals_batch(spark, tmp_path):
    lines = ["failed: a", "failed: b", "failed: a", "done", "failed: c"]
    rows = [(f"m{i % 2}", at(i * 7), i, lines[i % 5]) for i in range(40)]
    files = [lambda r: r[2] < 13, lambda r: 13 <= r[2] < 25, lambda r: r[2] >= 25]
    got = collect(spark, st.cooldown(stream(spark, tmp_path, rows, files=files), line="command"), tmp_path)
    batch = spark.createDataFrame(rows, st.COMMAND_SCHEMA).withColumn("sec", F.col("ts").cast("double"))
    want = hi.guarded_cooldown(batch, 30, line="command")
    assert {(r.machine, r.seq) for r in got.collect()} == {(r.machine, r.seq) for r in want.collect()}
    plain = collect(spark, st.cooldown(stream(spark, tmp_path, rows, files=files, name="in2"), 10, guard=False, line="command"), tmp_path, "out2")
    want = hi.cooldown(batch, 10, bucket=seconds_bucket("sec", 50)).filter("fired")
    assert {(r.machine, r.seq) for r in plain.collect()} == {(r.machine, r.seq) for r in want.collect()}


def test_stall_timers_and_retry_loop(spark, tmp_path):
    rows = [("a", at(i * 10), i, "nmap x") for i in range(5)] + [("b", at(3), 100, "id")]
    rows += [("z", at(3000), 200, "ls"), ("z", at(6000), 201, "pwd"), ("z", at(9000), 202, "cat")]
    files = [lambda r: r[2] <= 100, lambda r: r[2] == 200, lambda r: r[2] == 201, lambda r: r[2] == 202]
    got = collect(spark, st.stalls(stream(spark, tmp_path, rows, files=files)), tmp_path).collect()
    states = {(r.machine, r.state, round(r.at - T0.replace(tzinfo=dt.timezone.utc).timestamp())) for r in got}
    assert ("a", "retry_loop", 30) in states and ("a", "retry_loop", 40) in states
    assert not any(m == "a" and s in ("stalled", "stalling") for m, s, _ in states)
    assert {("b", "stalling", 405), ("b", "stalled", 603), ("b", "conceptual", 603), ("b", "direct", 1203)} <= states


def test_phase_changes_equal_batch(spark, tmp_path):
    cmds = ["ls", "nmap x", "gobuster y", "ls", "ls", "whoami", "nc z", "ls", "ls", "ls", "ls"]
    rows = [("m", at(i), i, cmds[i % len(cmds)]) for i in range(22)]
    files = [lambda r: r[2] < 4, lambda r: 4 <= r[2] < 9, lambda r: r[2] >= 9]
    got = collect(spark, st.phase_changes(stream(spark, tmp_path, rows, files=files), size=3), tmp_path)
    batch = spark.createDataFrame(rows, st.COMMAND_SCHEMA).withColumn("sec", F.unix_timestamp("ts"))
    phased = hi.running_phase(hi.number_commands(batch, bucket=seconds_bucket("sec", 5)), size=3, block_rows=4)
    want = hi.phase_changes(phased, block_rows=4)
    assert sorted((r.seq, r.previous_phase, r.phase) for r in got.collect()) == sorted((r.seq, r.previous_phase, r.phase) for r in want.collect())


def test_json_hint_fires_once_per_command(spark, tmp_path):
    long = "word " * 60
    cmds = [("m", at(0), 1, "nmap -sV x"), ("m", at(50), 2, "ls"), ("m", at(100), 3, "ffuf -u y -oJ"), ("m", at(150), 4, "gobuster dir")]
    feed = [("m", at(1), 11, "short"), ("m", at(2), 12, long), ("m", at(3), 13, long), ("m", at(60), 14, long), ("m", at(110), 15, long), ("m", at(160), 16, long)]
    c = stream(spark, tmp_path, cmds)
    f = stream(spark, tmp_path, feed, "machine string, ts timestamp, seq bigint, line string", name="feed")
    got = collect(spark, st.json_hints(st.with_feedback(c, f)), tmp_path)
    assert sorted((r.command_seq, r.line_seq) for r in got.collect()) == [(1, 12), (4, 16)]


def _state_rows(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).count()


def test_state_ends(spark, tmp_path):
    """Once the watermark has passed a key's end nothing of it is left; the newest key's state is."""
    day = 86_400
    rows = [("m", at(0), 1, "nmap 10.0.0.1"), ("m", at(5), 2, "permission denied"), ("n", at(90 * day), 3, "permission denied"), ("n", at(90 * day + 5), 4, "whoami"), ("o", at(91 * day), 5, "permission denied")]
    files = [lambda r, k=k: r[2] == k for k in range(1, 6)]
    for name, job, state, left in (
        ("guard", lambda s: st.cooldown(s, 60, line="command"), "last", 2),
        ("plain", lambda s: st.cooldown(s, 60, guard=False, line="command"), "last", 1),
        ("phase", lambda s: st.phase_changes(s), "recent", 2),
        ("stall", lambda s: st.stalls(s, watermark="30 seconds"), "state", 1),
    ):
        collect(spark, job(stream(spark, tmp_path, rows, files=files, name=f"in_{name}")), tmp_path, name)
        assert _state_rows(spark, str(tmp_path / f"{name}_cp"), state) == left, name


def test_late_rows_go_to_a_side_sink(spark, tmp_path):
    split = st.late_splitter(str(tmp_path / "kept"), str(tmp_path / "late"), str(tmp_path / "marks"), 60)
    batch = lambda *r: spark.createDataFrame([(m, at(s), m) for m, s in r], "machine long, ts timestamp, seq long")
    for _ in range(2):  # a batch that runs again takes its own place
        split(batch((1, 0), (2, 1000)), 0)
    for _ in range(2):
        split(batch((3, 939), (4, 940), (5, 2000)), 1)
    split(batch(), 2)
    split(batch((6, 1939), (7, 1941)), 3)
    ids = lambda name: sorted(r.machine for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert ids("kept") == [1, 2, 4, 5, 7] and ids("late") == [3, 6]


def test_dropped_rows_are_counted(spark, tmp_path):
    rows = [("m", at(0), 1, "a"), ("m", at(7200), 2, "b"), ("m", at(7300), 3, "x"), ("m", at(10), 4, "c"), ("m", at(20), 5, "d")]
    src = stream(spark, tmp_path, rows, files=[lambda r: r[2] == 1, lambda r: r[2] == 2, lambda r: r[2] == 3, lambda r: r[2] > 3])
    q = st.run_available(st.first_seen(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert st.dropped_by_watermark(q) == 2


def test_many_folders_are_listed_and_read_by_few_tasks(spark, tmp_path):
    """A folder per machine: neither a task per folder when they are listed nor one per few files when they are read; settings come back."""
    for n in range(100):
        (tmp_path / "in" / f"m{n}").mkdir(parents=True)
        (tmp_path / "in" / f"m{n}" / "history").write_text(f": {n}:0;ls {n}\n")
    before = {k: spark.conf.get(k) for k in st.SMALL_FILES}
    context, group = spark.sparkContext, str(tmp_path)
    context.setJobGroup(group, "listing")
    out = collect(spark, st.read_history(spark, str(tmp_path / "in")).drop("file"), tmp_path)
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert out.count() == 100 and out.select("machine").distinct().count() == 100
    assert tasks and max(tasks) <= 64 < 100
    assert before == {k: spark.conf.get(k) for k in st.SMALL_FILES}


def test_hints_take_only_texts_that_may_be_pending(spark, tmp_path):
    """Feedback lines and other commands stay behind; a hint keeps its command's text, time and numbers beyond 2^53."""
    big = (1 << 60) + 1
    rows = [
        ("m", at(0), big, "nmap -sV host"), ("m", at(10), 2, "whoami"), ("m", at(20), 3, "nmap -sV other"),
    ]
    c = stream(spark, tmp_path, rows)
    f = stream(spark, tmp_path, [("m", at(5), big + 1, "x y " * 60), ("m", at(15), 5, "x y " * 60), ("m", at(25), 6, "short")], name="feedback").withColumnRenamed("command", "line")
    hints = st.json_hints(st.with_feedback(c, f))
    assert "command END AS line" not in hints._jdf.queryExecution().analyzed().toString()
    got = collect(spark, hints, tmp_path).collect()
    assert [tuple(r) for r in got if r.command_seq == big] == [("m", at(5), big, "nmap -sV host", big + 1)]


def test_many_history_folders_are_one_batch(spark, tmp_path):
    from opsloom.plans import stream

    rows = spark.range(2400).select((F.col("id") % 1200).alias("machine"), F.concat(F.lit(": "), (F.lit(1700000000) + F.col("id")).cast("string"), F.lit(":0;ls "), (F.col("id") % 7).cast("string")).alias("line"), F.col("id").alias("seq"))
    stream._write_files(rows, f"file://{tmp_path}/h", "machine={}", "_part", "history")
    assert (tmp_path / "h" / "0" / "machine=5" / "history").read_text() == ": 1700000005:0;ls 5\n: 1700001205:0;ls 1\n"
    assert sorted(x.name for x in (tmp_path / "h").rglob("*") if x.is_file()) == ["history"] * 1200
    query = st.run_available(st.read_history(spark, str(tmp_path / "h")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [2400]
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2400 and got.filter("machine = 'machine=5'").orderBy("ts").select("command").collect() == [("ls 5",), ("ls 1",)]


def test_histories_of_more_machines_than_a_stream_follows(spark, tmp_path, monkeypatch):
    """Several streams, each with a part of the folders, give what one gives."""
    from opsloom.plans import stream

    one = stream.stream_history(spark, "/root/testdata/sf0.001").collect()
    followed = []
    monkeypatch.setattr(stream, "FOLLOWED", 4)
    monkeypatch.setattr(st, "read_history", lambda spark, path, read=st.read_history: followed.append(path) or read(spark, path))
    assert sorted(one) == sorted(stream.stream_history(spark, "/root/testdata/sf0.001").collect()) and len(one) == 15
    assert len(followed) >= 3
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert stream.stream_history(spark, str(tmp_path)).collect() == []
