"""Append-only logs as a stream: only the bytes that are new since the last batch are read.

A streaming data source (``spark.readStream.format("log_tail")``).  Its offset says, for each file, how far it was read and the
digest of its first line.  A batch gets byte ranges: of a grown file what came after the last offset, cut into pieces that several
tasks read.  A file that shrank, or whose first line is another one, was rotated: it is read anew from its start and its rows are marked
``replay``, so that a reader can rebuild what it has seen and emit nothing.  A last line without its line end waits for the next batch.
A file that grows beyond ``SMALL`` bytes tells its first lines once more, as a replay before its new ones: ``new_commands`` keeps small files otherwise than large ones.

Only names, sizes and line ends are looked at on the driver.  The folder must be one that driver and executors reach by the same path, through a
file system that Arrow knows (local or shared folders, HDFS, object stores).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsloom.functions import commands as cx

LINES = "file string, epoch string, replay boolean, place bigint, line string, before bigint, size bigint"
#: Bytes of one task, bytes of a read while a line end is looked for, and bytes whose reading counts as much as opening a file.
PIECE, STEP, OPEN = 8 << 20, 64 << 10, 32 << 10
#: A first line is told by so many of its bytes.
HEAD = 4096
#: Up to so many bytes a file is one value of state, and such files share so many keys.
SMALL, SLOTS = 64 << 10, 4096
#: Lines, and bytes of them, that go to Spark at a time.
BATCH_ROWS, BATCH_BYTES = 10_000, 4 << 20
DIGEST = 32
#: A key that a line goes to.
TO = "array<struct<owner:string,bucket:bigint,line:string>>"


class Range(InputPartition):
    """Bytes [start, end) of a file; lines that begin in it belong to it.  The file had ``before`` bytes at the last offset and has ``size`` now."""

    def __init__(self, file: str, start: int, end: int, first: int, stop: int, epoch: str, replay: bool, before: int, size: int):
        self.file, self.start, self.end, self.first, self.stop, self.epoch, self.replay, self.before, self.size = file, start, end, first, stop, epoch, replay, before, size


class Task(InputPartition):
    """Ranges that one task reads."""

    def __init__(self, ranges: list[Range]):
        self.ranges = ranges


def _tasks(ranges: list[Range], most: int = PIECE) -> list[Task]:
    """Neighbouring ranges together, so that many small files are few tasks."""
    out, size = [], most
    for r in ranges:
        own = OPEN + r.end - r.start
        if size + own > most:
            out.append(Task([]))
            size = 0
        out[-1].ranges.append(r)
        size += own
    return out


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class Tail(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", "")
        self.piece = int(options.get("pieceBytes", PIECE))

    def initialOffset(self) -> dict:
        return {}

    def _state(self, system, info) -> list | None:
        """[bytes up to the last line end, digest of the first line], None for a file without a whole line that was never read."""
        with system.open_input_file(info.path) as f:
            end, size, head = info.size, info.size, b""
            while end:  # the last line end, from behind
                begin = max(0, end - STEP)
                f.seek(begin)
                block = f.read(end - begin)
                at = block.rfind(b"\n")
                if at >= 0:
                    end = begin + at + 1
                    if begin:
                        f.seek(0)
                    head = f.read(min(size, HEAD)) if begin else block[:HEAD]
                    break
                end = begin
        line = head.split(b"\n", 1)[0]
        return [end, hashlib.sha256(line).hexdigest()[:16]]

    def latestOffset(self) -> dict:
        from pyarrow import fs

        system, root = _open(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((i for i in found if i.type == fs.FileType.File and i.path.endswith(self.suffix)), key=lambda i: i.path)
        return {i.path[len(root) :].lstrip("/"): self._state(system, i) for i in files}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for file, (stop, digest) in end.items():
            was, before = start.get(file, (0, digest))
            replay = stop < was or (was > 0 and before != digest)
            first = 0 if replay else was
            epoch = f"{digest}:{stop}" if replay else ""
            if replay and not stop:
                out.append(Range(file, 0, 0, 0, 0, epoch, True, was, 0))  # emptied: one row without a line says so
            if not replay and 0 < was <= SMALL < stop:  # no longer small: what it has is told to the keys of a large file
                out += self._pieces(file, 0, was, f"{digest}:{was}", True, was, stop)
            out += self._pieces(file, first, stop, epoch, replay, was, stop)
        return _tasks(out)

    def _pieces(self, file: str, first: int, stop: int, epoch: str, replay: bool, before: int, size: int) -> list[Range]:
        return [Range(file, a, min(a + self.piece, stop), first, stop, epoch, replay, before, size) for a in range(first, stop, self.piece)]

    def read(self, part: Task) -> Iterator[pa.RecordBatch]:
        """Lines of neighbouring ranges go together, so that many small files are few batches."""
        held, rows, size = [], 0, 0
        for each in part.ranges:
            for places, lines in self._read(each):
                held.append((each, places, lines))
                rows, size = rows + len(lines), size + sum(map(len, filter(None, lines)))
                if rows >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(held)
                    held, rows, size = [], 0, 0
        if held:
            yield _batch(held)

    def _read(self, part: Range) -> Iterator[tuple[list, list]]:
        """Places and lines of a range, some at a time."""
        if not part.stop:
            yield [0], [None]
            return
        system, root = _open(self.root)
        with system.open_input_file(f"{root}/{part.file}") as f:
            at, rest = part.start, b""
            if at > part.first:  # the line that reaches into this piece belongs to the one before
                at -= 1
            f.seek(at)
            skip = at < part.start
            while True:
                raw = f.read(min(STEP * 16, part.stop - at - len(rest)))
                buffer = rest + raw
                places, lines, here = [], [], 0
                while (cut := buffer.find(b"\n", here)) >= 0:
                    if at + here >= part.end:
                        break
                    if not skip:
                        places.append(at + here)
                        lines.append(buffer[here:cut].removesuffix(b"\r").decode("utf-8", errors="ignore"))
                    skip, here = False, cut + 1
                if lines:
                    yield places, lines
                at, rest = at + here, buffer[here:]
                if at >= part.end or not raw:
                    return

    def commit(self, end: dict) -> None:
        pass


def _batch(held: list[tuple[Range, list, list]]) -> pa.RecordBatch:
    own = pa.array([i for i, (_, places, _) in enumerate(held) for _ in places], pa.int32())
    of = {name: pa.array([getattr(part, name) for part, _, _ in held], kind).take(own) for name, kind in (("file", pa.string()), ("epoch", pa.string()), ("replay", pa.bool_()), ("before", pa.int64()), ("size", pa.int64()))}
    of |= {"place": pa.array([x for _, places, _ in held for x in places], pa.int64()), "line": pa.array([x for _, _, lines in held for x in lines], pa.string())}
    names = ["file", "epoch", "replay", "place", "line", "before", "size"]
    return pa.RecordBatch.from_arrays([of[n] for n in names], names=names)


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return LINES

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return Tail(dict(self.options))


def tail(spark: SparkSession, path: str, suffix: str = "", piece_bytes: int = PIECE) -> DataFrame:
    """New lines of all files below ``path`` whose names end with ``suffix``: file (its path below the folder), epoch and replay (see above), place (byte), line,
    and the bytes that the file had at the last offset (0: it was not there) and has at this one."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("suffix", suffix).option("pieceBytes", piece_bytes).load(path)


class _New(StatefulProcessor):
    """Commands of a file that it had not before; a rotated file only tells anew what it has.

    Takes a key's rows as frames.  The key of a large file (owner) is a bucket of its commands and has one entry of state per command; other keys are
    slots of small files, with one entry per file: every call to the state store costs more than all else for such a file.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("digest", T.BinaryType())]), T.StructType([T.StructField("place", T.LongType())]))
        self.small = handle.getMapState("small", T.StructType([T.StructField("file", T.StringType())]), T.StructType([T.StructField("digests", T.BinaryType())]))

    def handleInputRows(self, key, rows, timerValues):
        again, fresh = {}, {}  # digests of each file that replays, and first row of each new command
        for frame in rows:
            for file, replay, place, line, digest in zip(*(frame[c].tolist() for c in ("file", "replay", "place", "line", "digest")), strict=True):
                if replay:
                    told = again.setdefault(file, {})
                    if line is not None:
                        told[bytes(digest)] = place
                else:
                    own = fresh.setdefault(file, {})
                    before = own.get(digest := bytes(digest))
                    if before is None or place < before[0]:  # the first of equal lines, in whatever order the pieces come
                        own[digest] = (place, line)
        out, of = [], self._large if key[0] else self._small
        known = self.seen.exists() if key[0] else self.small.exists()
        for file in again.keys() | fresh.keys():
            out += [(file, *row) for row in of(file, again.get(file), fresh.get(file, {}), known)]
        if out:
            yield pd.DataFrame(out, columns=["file", "place", "command"])

    def _small(self, file: str, told: dict | None, fresh: dict, known: bool) -> list:
        held = b"".join(told) if told is not None else ((known and self.small.getValue((file,))) or (b"",))[0]
        had = {held[i : i + DIGEST] for i in range(0, len(held), DIGEST)}
        new = {d: row for d, row in fresh.items() if d not in had}
        if (new or told) and (all_ := bytes(held) + b"".join(new)):
            self.small.updateValue((file,), (all_,))
        elif told is not None and known:
            self.small.removeKey((file,))
        return list(new.values())

    def _large(self, file: str, told: dict | None, fresh: dict, known: bool) -> list:
        if told is not None:
            if known:
                self.seen.clear()
            for digest, place in told.items():
                self.seen.updateValue((digest,), (place,))
            known = bool(told)
        new = [(d, row) for d, row in fresh.items() if not (known and self.seen.containsKey((d,)))]
        for digest, row in new:
            self.seen.updateValue((digest,), (row[0],))
        return [row for _, row in new]

    def close(self) -> None:
        pass


def new_commands(lines: DataFrame, buckets: int = 64, slots: int = SLOTS) -> DataFrame:
    """file, place and command of commands that their file did not have before.

    State of a file beyond ``SMALL`` bytes is kept by file and a bucket of the command's hash, so one busy file is many keys; small files are
    dealt to ``slots``, so very many of them are few keys.  After a rotation only commands of the new file count as seen, and none of those that it
    starts with is emitted.  A file that was away at a look and is small where it was large, or large where it was small, starts anew.
    """
    line = F.trim("line")
    digest = F.unhex(cx.command_hash(line))
    kept = lines.filter(F.col("replay") | (line != "")).select("file", "replay", "place", "before", "size", line.alias("line"), digest.alias("digest"))
    # A replay reaches every key that has or gets state of its file: rows of other commands arrive there without a line.
    slot = F.struct(F.lit("").alias("owner"), F.pmod(F.xxhash64("file"), F.lit(slots)).cast("long").alias("bucket"), F.lit(None).cast("string").alias("line"))
    every = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.struct(F.col("file").alias("owner"), b.cast("long").alias("bucket"), F.lit(None).cast("string").alias("line")))
    text = F.when(F.col("line") != "", F.col("line"))
    bucket = F.struct(F.col("file").alias("owner"), F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("long").alias("bucket"), text.alias("line"))
    large, was_large = F.col("size") > SMALL, F.col("before") > SMALL
    itself = F.array(F.when(large, bucket).otherwise(slot.withField("line", text)))
    marks = F.concat(F.when(large | was_large, every).otherwise(F.array().cast(TO)), F.when(large & ~was_large, F.array(slot)).otherwise(F.array().cast(TO)))
    first = F.col("replay") & (F.col("place") == 0)
    sent = kept.withColumn("to", F.explode(F.when(first, F.concat(itself, marks)).otherwise(itself)))
    keyed = sent.select("to.owner", "to.bucket", "file", "replay", "place", "to.line", "digest")
    return keyed.groupBy("owner", "bucket").transformWithStateInPandas(statefulProcessor=_New(), outputStructType="file string, place bigint, command string", outputMode="append", timeMode="None")
