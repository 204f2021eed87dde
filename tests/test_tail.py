"""The growing-log source: appends, unfinished lines, rotation, restart, pieces."""

import os

import pytest
from opsloom.sources import tail as tl
from opsloom.streaming import history as st


@pytest.fixture(autouse=True)
def rocksdb(spark):
    st.use_rocksdb(spark)


@pytest.fixture
def logs(tmp_path):
    (tmp_path / "logs").mkdir()
    return tmp_path


def look(spark, base, piece=16, new=True):
    df = tl.tail(spark, str(base / "logs"), ".log", piece)
    name = "new" if new else "raw"
    st.run_available(tl.new_commands(df, buckets=3) if new else df, str(base / name), str(base / f"{name}_cp"))
    return spark.read.parquet(str(base / name))


def write(base, name, raw, mode="wb"):
    with open(base / "logs" / name, mode) as f:
        f.write(raw)


def test_only_new_bytes_are_read(spark, logs):
    write(logs, "a.log", b"one\ntwo\r\n\xff three\nunfin")
    write(logs, "b.txt", b"not a log\n")
    got = look(spark, logs, new=False)
    assert sorted((r.file, r.place, r.line, r.replay) for r in got.collect()) == [("a.log", 0, "one", False), ("a.log", 4, "two", False), ("a.log", 9, " three", False)]
    write(logs, "a.log", b"ished\n" + "".join(f"line {i}\n" for i in range(200)).encode(), "ab")
    write(logs, "c.log", b"")
    got = sorted((r.place, r.line) for r in look(spark, logs, new=False).collect())
    assert [line for _, line in got] == ["one", "two", " three", "unfinished"] + [f"line {i}" for i in range(200)]
    assert look(spark, logs, new=False).count() == len(got)  # no growth, nothing read


def test_pieces_share_out_every_line_once(tmp_path):
    raw = b"".join(b"x" * (i % 23) + b"\n" for i in range(300))
    (tmp_path / "a.log").write_bytes(raw + b"open")
    for piece in (1, 7, 64, 10_000):
        source = tl.Tail({"path": str(tmp_path), "pieceBytes": str(piece)})
        end = source.latestOffset()
        assert end["a.log"][0] == len(raw)
        rows = [x for p in source.partitions({"a.log": [28, end["a.log"][1]]}, end) for b in source.read(p) for x in zip(b["place"].to_pylist(), b["line"].to_pylist(), strict=True)]
        want, at = [], 0
        for line in raw.decode().splitlines():
            want.append((at, line))
            at += len(line) + 1
        assert sorted(rows) == [w for w in want if w[0] >= 28]


def test_new_commands_over_rotation(spark, logs):
    write(logs, "m.log", b"ls\nid\nls\n\n")
    write(logs, "n.log", b"ls\n")
    assert sorted((r.file, r.place, r.command) for r in look(spark, logs).collect()) == [("m.log", 0, "ls"), ("m.log", 3, "id"), ("n.log", 0, "ls")]
    write(logs, "m.log", b"id\nwho\n", "ab")
    assert look(spark, logs).count() == 4
    write(logs, "m.log", b"who\nnew after rotation\n")  # shrunk: read anew, nothing emitted
    assert look(spark, logs).count() == 4
    write(logs, "m.log", b"new after rotation\nwho\nls\n", "ab")  # only ls is new to this file
    got = look(spark, logs)
    assert got.count() == 5 and got.filter("command = 'ls' AND file = 'm.log'").count() == 2
    write(logs, "m.log", b"")  # emptied
    assert look(spark, logs).count() == 5
    write(logs, "m.log", b"who\nother, longer than before, long enough to be longer\n")
    assert look(spark, logs).count() == 7
    write(logs, "m.log", b"another first line, and longer than it was before this, surely so\nwho\n")  # rotated without shrinking
    assert look(spark, logs).count() == 7


def test_no_folder(spark, tmp_path):
    assert look(spark, tmp_path, new=False).count() == 0 and not os.path.exists(tmp_path / "logs")


def test_many_small_files_are_few_tasks(tmp_path):
    for n in range(300):
        (tmp_path / f"{n}.log").write_bytes(b"one\ntwo\n")
    source = tl.Tail({"path": str(tmp_path), "pieceBytes": "4"})
    tasks = source.partitions({}, source.latestOffset())
    assert 1 < len(tasks) < 10
    got = sorted((f, x) for t in tasks for b in source.read(t) for f, x in zip(b["file"].to_pylist(), b["line"].to_pylist(), strict=True))
    assert got == sorted((f"{n}.log", x) for n in range(300) for x in ("one", "two"))


def test_state_of_small_files_is_one_entry_a_file(spark, logs):
    for n in range(40):
        write(logs, f"{n}.log", "".join(f"command {i}\n" for i in range(20)).encode())
    df = tl.new_commands(tl.tail(spark, str(logs / "logs"), ".log"), slots=5)
    query = st.run_available(df, str(logs / "out"), str(logs / "cp"))
    assert spark.read.parquet(str(logs / "out")).count() == 800
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 40  # not one for each command


def test_a_file_grows_large_and_is_rotated(spark, logs):
    def told(n):
        got = [(r.place, r.command) for r in look(spark, logs, piece=1000).filter("file = 'm.log'").collect()]
        assert len(got) == n
        return sorted(got)

    def lines(a, b):
        return "".join(f"command {i:06d}\n" for i in range(a, b)).encode()

    write(logs, "m.log", lines(0, 100))
    told(100)
    write(logs, "m.log", lines(90, 5000), "ab")  # past SMALL, with ten commands that it had
    assert os.path.getsize(logs / "logs" / "m.log") > tl.SMALL
    assert told(5000)[-1] == (15 * 5009, "command 004999")
    write(logs, "m.log", lines(0, 100) + b"one more\n", "ab")
    told(5001)
    write(logs, "m.log", lines(50, 60))  # rotated, small again: nothing is new, and of the old commands none is known
    told(5001)
    write(logs, "m.log", lines(50, 70), "ab")
    told(5011)
    write(logs, "m.log", b"another first line, so a rotation\n" + lines(0, 5000))
    told(5011)
    write(logs, "m.log", lines(4990, 5010), "ab")
    told(5021)


def test_a_rotation_is_told_by_the_batch(spark, logs):
    """Twice the same first line and size: what the file had in between is forgotten each time."""
    for _ in range(2):
        write(logs, "m.log", b"ls\nid\n")
        look(spark, logs)
        write(logs, "m.log", b"who\n", "ab")
        look(spark, logs)
    write(logs, "m.log", b"ls\nid\n")
    look(spark, logs)
    write(logs, "m.log", b"who\n", "ab")
    assert look(spark, logs).filter("command = 'who'").count() == 3
