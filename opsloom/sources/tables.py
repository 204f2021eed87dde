"""Chunk tables with versions: a whole source is replaced, rows are deleted and upserted, and readers always see one version.

A table is a folder.  ``data/`` holds folders of Parquet files that never change; ``manifest/`` holds one small JSON file per version, which lists
the folders that make it up: for each index its base, and the deltas of upserts in order.  A writer first writes its data and then
puts the next version's file in place; this is the only step that readers can see, and it fails if another writer was first (the writer
then starts again from the new version).  A writer that stops half-way leaves the version before as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom import rules
from opsloom.functions import text as tx
from opsloom.operators.corpus import distinct_by_key

KEY, AT, EXPIRES, DELETED = "doc_key", "updated_at", "expires_at", "deleted"


class Conflict(RuntimeError):
    """Another writer put this version in place first."""


def _counted(seen: Observation, written: dict) -> dict[str, int]:
    """total and failed; a plan without any row may have been folded away together with its counters."""
    try:
        return {c: int(seen.get[c]) for c in ("total", "failed")}
    except Py4JJavaError:
        if written:
            raise
        return {"total": 0, "failed": 0}


class ChunkTable:
    """``schema``: that of the rows, with a column ``index`` and a key ``doc_key``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = KEY):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ versions
    def version(self) -> int:
        """The newest version; 0 for a table without any."""
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """Folders of a version: index, folder, kind (base or delta), order."""
        version = self.version() if version is None else version
        if not version:
            return []
        (row,) = self.spark.read.text(f"{self.path}/manifest/{version:010d}.json", wholetext=True).collect()
        return json.loads(row[0])

    def _put(self, version: int, entries: list[dict]) -> None:
        """Put a version in place: written under another name, then renamed, which fails if it is there already."""
        spare = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(spare, False)
        out.write(bytearray(json.dumps(entries).encode()))
        out.close()
        target = self._path(f"{self.path}/manifest/{version:010d}.json")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(spare, target, options)
        except Exception as error:
            self._fs.delete(spare, False)
            if self._fs.exists(target):
                raise Conflict(f"version {version} is there already") from error
            raise

    def _commit(self, change: Callable[[list[dict]], list[dict]], tries: int = 20) -> int:
        """The version made by ``change`` of the newest version's entries."""
        for _ in range(tries):
            version = self.version()
            try:
                self._put(version + 1, change(self.manifest(version)))
                return version + 1
            except Conflict:
                continue
        raise Conflict("too many writers")

    # ------------------------------------------------------------ data
    def _write(self, rows: DataFrame, salt: int = 32) -> dict[str | None, str]:
        """Write rows by index, each index by many tasks; the folder of each index that has rows."""
        folder = f"data/{uuid.uuid4().hex}"
        names = [f.name for f in self.schema]
        spread = rows.select(*names, F.to_json(F.struct("index")).alias("_index")).repartition("_index", F.pmod(F.xxhash64(self.key), F.lit(salt)))
        spread.write.partitionBy("_index").parquet(f"{self.path}/{folder}")
        made = self._fs.listStatus(self._path(f"{self.path}/{folder}"))
        out = {}
        for s in made:
            name = s.getPath().getName()
            if name.startswith("_index="):
                row = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}/{name}").select("index").first()
                out[row["index"]] = f"{folder}/{name}"
        return out

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, index: str | None = None, version: int | None = None, now: Column | None = None) -> DataFrame:
        """Rows of a version, of one index or all: of each key the newest, unless it is deleted or expired."""
        entries = [e for e in self.manifest(version) if index is None or e["index"] == index]
        layered = {e["index"] for e in entries if e["kind"] == "delta"}
        plain = self._read([e["folder"] for e in entries if e["index"] not in layered])
        return self._alive(plain, now).unionByName(self._merged([e for e in entries if e["index"] in layered], now))

    def _alive(self, rows: DataFrame, now: Column | None) -> DataFrame:
        if EXPIRES in rows.columns:
            rows = rows.filter(F.col(EXPIRES).isNull() | (F.col(EXPIRES) > (F.current_timestamp() if now is None else now)))
        return rows.filter(~F.coalesce(DELETED, F.lit(False))) if DELETED in rows.columns else rows

    def _merged(self, entries: list[dict], now: Column | None) -> DataFrame:
        """Merge on read: the newest row of each key, found by its place, so that only keys and times are exchanged."""
        if not entries:
            return self._read([])
        rows, narrow = None, None
        for e in sorted(entries, key=lambda e: (str(e["index"]), e["order"])):
            one = self._read([e["folder"]]).withColumn("_order", F.lit(e["order"])).withColumn("_file", F.col("_metadata.file_path")).withColumn("_row", F.col("_metadata.row_index"))
            few = one.select("index", F.col(self.key).alias("_key"), F.struct(*([AT] if AT in one.columns else []), "_order", "_file", "_row").alias("_place"))
            rows, narrow = (one, few) if rows is None else (rows.unionByName(one), narrow.unionByName(few))
        newest = narrow.groupBy("index", "_key").agg(F.max("_place").alias("_place")).select(F.col("_place._file").alias("_f"), F.col("_place._row").alias("_r"))
        met = rows.join(newest, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r")), "left_semi").select(*(f.name for f in self.schema))
        return self._alive(met, now)

    # ------------------------------------------------------------ writers
    def replace(self, indexes: Iterable[str], rows: DataFrame, order: Iterable[str] = ("chunk_no",), vector: str = "embedding") -> dict[str, int]:
        """Full refresh: ``rows``, one per index and key, take the place of all rows of ``indexes``, also of those for which no row came.  Returns counters."""
        names = list(indexes)
        has_vector = vector in rows.columns
        seen = Observation()
        watched = rows.observe(seen, F.count(F.lit(1)).alias("total"), (F.count_if(F.col(vector).isNull()) if has_vector else F.lit(0).cast("long")).alias("failed"))
        good = watched.filter(F.col(vector).isNotNull()) if has_vector else watched
        folders = self._write(distinct_by_key(good.filter(F.col("index").isin(*names)), ["index", self.key], list(order)))
        base = [{"index": i, "folder": f, "kind": "base", "order": 0} for i, f in folders.items()]
        version = self._commit(lambda old: [e for e in old if e["index"] not in names] + base)
        return {**_counted(seen, folders), "version": version}

    def purge(self, fragment: str, index: str = "webcrawl", url: str = "url") -> int:
        """Delete the rows of an index whose address holds ``fragment``, ignoring case; returns their number."""
        gone = F.lower(tx.text_or_empty(url)).contains(fragment.lower())
        for _ in range(20):
            version = self.version()
            rows = self.read(index, version, F.lit("0001-01-01").cast("timestamp"))
            n = rows.filter(gone).count()
            if not n:
                return 0
            folders = self._write(rows.filter(~gone))
            base = [{"index": i, "folder": f, "kind": "base", "order": 0} for i, f in folders.items()]
            try:
                self._put(version + 1, [e for e in self.manifest(version) if e["index"] != index] + base)
                return n
            except Conflict:  # what the other writer wrote must be looked at too
                continue
        raise Conflict("too many writers")

    def upsert(self, rows: DataFrame, days: int | None = rules.CHUNK_TTL_DAYS, batch_rows: int = 50, vector: str = "embedding") -> dict[str, int]:
        """Add rows; of each key the newest counts (by ``updated_at``, then by order of writing).  A row with ``deleted`` is a tombstone.  Returns batch statistics."""
        if days is not None and EXPIRES in [f.name for f in self.schema] and EXPIRES not in rows.columns:
            rows = rows.withColumn(EXPIRES, F.col(AT) + F.make_dt_interval(days=F.lit(days)))
        if DELETED in [f.name for f in self.schema] and DELETED not in rows.columns:
            rows = rows.withColumn(DELETED, F.lit(False))
        failed = F.col(vector).isNull() & (~F.coalesce(DELETED, F.lit(False)) if DELETED in rows.columns else F.lit(True)) if vector in rows.columns else F.lit(False)
        seen = Observation()
        watched = rows.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"))
        kept = watched.filter(~failed)
        folders = self._write(kept)

        def change(old: list[dict]) -> list[dict]:
            last = max((e["order"] for e in old), default=0)
            return old + [{"index": i, "folder": f, "kind": "delta", "order": last + 1} for i, f in folders.items()]

        self._commit(change)
        total, bad = _counted(seen, folders).values()
        return {"total_chunks": total, "ingested": total - bad, "failed": bad, "batches": -(-total // batch_rows)}

    def compact(self, now: Column | None = None, index: str | None = None) -> int:
        """Write the deltas of indexes that have some into new bases, sorted by ranges of keys, without deleted and expired rows; returns the version.

        Deltas that other writers added in the meantime stay on top.
        """
        entries = self.manifest()
        chosen = [e for e in entries if e["index"] in {x["index"] for x in entries if x["kind"] == "delta"} and (index is None or e["index"] == index)]
        if not chosen:
            return self.version()
        folder = f"data/{uuid.uuid4().hex}"
        rows = self._merged(chosen, now).repartitionByRange(F.asc_nulls_first("index"), self.key).sortWithinPartitions(F.asc_nulls_first("index"), self.key)
        rows.withColumn("_index", F.to_json(F.struct("index"))).write.partitionBy("_index").parquet(f"{self.path}/{folder}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))]
        base = []
        for name in (n for n in made if n.startswith("_index=")):
            row = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}/{name}").select("index").first()
            base.append({"index": row["index"], "folder": f"{folder}/{name}", "kind": "base", "order": max(e["order"] for e in chosen if e["index"] == row["index"])})
        done = {e["folder"] for e in chosen}

        def change(old: list[dict]) -> list[dict]:
            if not done <= {e["folder"] for e in old}:
                raise RuntimeError("a compacted folder was replaced meanwhile; compact again")
            return [e for e in old if e["folder"] not in done] + base

        return self._commit(change)

    def vacuum(self, keep_versions: int = 2) -> int:
        """Delete data that none of the last ``keep_versions`` versions has, and older manifests; returns the number of folders deleted.  No writer may be at work."""
        newest = self.version()
        old = range(1, max(1, newest - keep_versions + 1))
        used = {e["folder"] for v in range(max(1, newest - keep_versions + 1), newest + 1) for e in self.manifest(v)}
        n = 0
        data = self._path(f"{self.path}/data")
        for top in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for part in self._fs.listStatus(top.getPath()):
                name = f"data/{top.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in used:
                    n += bool(self._fs.delete(part.getPath(), True))
        for v in old:
            self._fs.delete(self._path(f"{self.path}/manifest/{v:010d}.json"), False)
        return n
