"""Versioned chunk tables: replace, purge, upsert, compaction, writers that stop half-way or meet."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsloom.sources import tables as tb

SCHEMA = "index string, doc_key string, chunk_no int, url string, updated_at timestamp, expires_at timestamp, deleted boolean, embedding array<double>"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def table(spark, tmp_path):
    from pyspark.sql import types as T

    return tb.ChunkTable(spark, str(tmp_path / "t"), T.StructType.fromDDL(SCHEMA))


def rows(spark, *given):
    """(index, key, chunk_no, day, deleted, embedded)"""
    made = [(i, k, n, f"http://X/{k}", T0 + dt.timedelta(days=d), None, gone, [1.0] if ok else None) for i, k, n, d, gone, ok in given]
    return spark.createDataFrame(made, SCHEMA)


def keys(df):
    return sorted(((r["index"], r.doc_key, r.chunk_no) for r in df.collect()), key=repr)


def test_replace_and_empty_source(spark, table):
    assert table.read().count() == 0
    got = table.replace(["a", "b"], rows(spark, ("a", "k1", 1, 0, False, True), ("a", "k1", 0, 0, False, True), ("a", "k2", 0, 0, False, False), ("b", "k1", 5, 0, False, True), ("c", "not asked", 0, 0, False, True)))
    assert got == {"total": 5, "failed": 1, "version": 1} and keys(table.read()) == [("a", "k1", 1), ("b", "k1", 5)]
    table.replace(["a"], rows(spark, ("a", "k9", 0, 0, False, True)))
    assert keys(table.read()) == [("a", "k9", 0), ("b", "k1", 5)] and keys(table.read(version=1)) == [("a", "k1", 1), ("b", "k1", 5)]
    table.replace(["a"], rows(spark).limit(0))  # a source that came back empty
    assert keys(table.read()) == [("b", "k1", 5)] and table.read("a").count() == 0


def test_writer_that_stops_half_way(spark, table, monkeypatch):
    table.replace(["a"], rows(spark, ("a", "k1", 0, 0, False, True)))
    monkeypatch.setattr(tb.ChunkTable, "_put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.replace(["a"], rows(spark, ("a", "k2", 0, 0, False, True)))
    monkeypatch.undo()
    assert keys(table.read()) == [("a", "k1", 0)] and table.version() == 1
    table.replace(["a"], rows(spark, ("a", "k3", 0, 0, False, True)))
    assert keys(table.read()) == [("a", "k3", 0)]
    assert table.vacuum(1) >= 2 and keys(table.read()) == [("a", "k3", 0)]


def test_two_writers(spark, table, monkeypatch):
    """The second one to put a version in place starts again from the first one's."""
    other = tb.ChunkTable(spark, table.path, table.schema)
    put, met = tb.ChunkTable._put, []

    def late(self, version, entries):
        if self is table and not met:
            met.append(other.replace(["b"], rows(spark, ("b", "k", 0, 0, False, True))))
        put(self, version, entries)

    monkeypatch.setattr(tb.ChunkTable, "_put", late)
    table.replace(["a"], rows(spark, ("a", "k", 0, 0, False, True)))
    assert keys(table.read()) == [("a", "k", 0), ("b", "k", 0)] and table.version() == 2
    with pytest.raises(tb.Conflict):
        put(table, 2, [])


def test_purge(spark, table):
    table.replace(["webcrawl", "b"], rows(spark, ("webcrawl", "one", 0, 0, False, True), ("webcrawl", "two", 0, 0, False, True), ("b", "one", 0, 0, False, True)))
    assert table.purge("x/ONE") == 1 and keys(table.read()) == [("b", "one", 0), ("webcrawl", "two", 0)]
    assert table.purge("nowhere") == 0 and table.purge("two") == 1 and keys(table.read()) == [("b", "one", 0)]


def test_upsert_and_compact(spark, table):
    day = lambda n: F.lit(T0 + dt.timedelta(days=n))
    stats = table.upsert(rows(spark, ("a", "k1", 1, 0, False, True), ("a", "k2", 1, 0, False, True), ("a", "k3", 1, 0, False, False), (None, "k1", 1, 0, False, True)).drop("expires_at"), batch_rows=3)
    assert stats == {"total_chunks": 4, "ingested": 3, "failed": 1, "batches": 2}
    table.upsert(rows(spark, ("a", "k1", 2, 20, False, True), ("a", "k2", 2, 5, True, False)).drop("expires_at"))
    table.upsert(rows(spark, ("a", "k1", 3, 10, False, True)).drop("expires_at"))  # older than what is there
    for look in range(2):
        assert keys(table.read(now=day(21))) == [("a", "k1", 2), (None, "k1", 1)]
        assert keys(table.read(now=day(40))) == [("a", "k1", 2)] and table.read(now=day(51)).count() == 0
        if not look:
            table.compact(now=day(21))
    assert {e["kind"] for e in table.manifest()} == {"base"}
    table.compact(now=day(21))
    table.upsert(rows(spark, ("a", "k1", 9, 30, True, True)).drop("expires_at"))
    assert keys(table.read("a", now=day(31))) == []
    table.compact(now=day(31))
    assert keys(table.read(now=day(0))) == [(None, "k1", 1)]
