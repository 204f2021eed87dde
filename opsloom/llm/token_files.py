"""Token files: ids of whole documents, compressed one document at a time with a shared zstandard dictionary.

Format, a folder with two tables written by Spark:

* ``dictionary``: one row, ``dict_hash`` (SHA-256, hex) and ``dictionary`` (bytes; empty if there was too little to learn from).
* ``blocks``: runs of documents in ascending key order.  ``shard`` and ``block`` order them; ``doc_id`` and ``n_tokens``
  list the documents; ``offsets`` (one more than documents) says where each document's own frame lies in ``frames``;
  ``dict_hash`` names the dictionary.  A frame holds the ids as little-endian unsigned 16-bit integers, so one short
  document is read by one slice of ``frames`` and the dictionary.
* ``shards``: one row per shard, ``first`` being the number of ids in all shards before it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsloom.llm import tokens as tk
from opsloom.llm import words as wd

END = 1
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on the ids of at most so many documents, at most so many ids of each (a bound on what the driver holds).
SAMPLE_DOCS, SAMPLE_IDS = 2000, 4096
LEVEL = 3
BLOCKS = "shard int, block int, doc_id array<bigint>, n_tokens array<bigint>, offsets array<bigint>, frames binary, dict_hash string"


def train_dictionary(docs: DataFrame, path: str, size: int = DICTIONARY_BYTES, sample: int = SAMPLE_DOCS) -> bytes:
    """A zstandard dictionary of serialised id arrays, from the documents with the smallest key hashes."""
    rows = docs.orderBy(F.xxhash64("_key"), "_key").limit(sample).select(F.left("_text", F.lit(SAMPLE_IDS * 4)).alias("t")).toArrow()
    ids, counts = tk.encoder(path).encode(rows["t"].combine_chunks() if rows.num_rows else pa.array([], pa.string()))
    ends = np.cumsum(counts)
    samples = [ids[e - c : e][:SAMPLE_IDS].tobytes() for e, c in zip(ends, counts, strict=True) if c]
    if sum(map(len, samples)) < 20 * 256:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:  # too little or too uniform to learn from
        return b""


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, text: str = "text", key: str = "doc_id", end: int = END) -> None:
    """Encode every whole text, append ``end``, and write the folder described above.

    A null text is an empty one: its ids are just ``end``.  A null key comes first; rows with equal keys are ordered by text,
    and rows equal in both are written once each.  An empty table writes empty tables.  Other columns are not read.
    """
    spark = docs.sparkSession
    path = vocabulary or tk.vocabulary()
    one = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    learnt = train_dictionary(one, path)
    name = hashlib.sha256(learnt).hexdigest()
    spark.createDataFrame([(name, bytearray(learnt))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(learnt) if learnt else None)
        for block, b in enumerate(wd.chunks(batches, "_text", tk.CHUNK)):
            ids, counts = tk.with_end(*tk.encoder(path).encode(b["_text"]), end)
            ends = np.cumsum(counts)
            frames = [packer.compress(ids[e - c : e].tobytes()) for e, c in zip(ends, counts, strict=True)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in frames])))
            yield pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "doc_id": b["_key"].to_pylist(), "n_tokens": counts.tolist(), "offsets": offsets.tolist(), "frames": b"".join(frames), "dict_hash": name}], schema=SCHEMA)

    ordered = one.repartitionByRange(F.col("_key").asc_nulls_first(), F.col("_text")).sortWithinPartitions(F.col("_key").asc_nulls_first(), "_text")
    ordered.mapInArrow(of, BLOCKS).write.parquet(f"{folder}/blocks")
    totals = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per shard
    totals.select("shard", before.alias("first")).write.parquet(f"{folder}/shards")


SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary()), ("dict_hash", pa.string())])


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    return row["dict_hash"], bytes(row["dictionary"])


def _opener(learnt: bytes, name: str):
    if hashlib.sha256(learnt).hexdigest() != name:
        raise ValueError("the dictionary does not match its hash")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(learnt) if learnt else None)


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian uint32) and, if asked, ids."""
    name, learnt = _dictionary(spark, folder)
    out_schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("within", pa.int64()), ("block_tokens", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * ids)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = _opener(learnt, name)
        for b in batches:
            for row in b.to_pylist():
                if row["dict_hash"] != name:
                    raise ValueError("a block was written with another dictionary")
                n, frames = np.array(row["n_tokens"], np.int64), row["frames"]
                crc, own = [], []
                for a, e, want in zip(row["offsets"], row["offsets"][1:], row["n_tokens"], strict=False):
                    x = np.frombuffer(opener.decompress(frames[a:e]), "<u2")
                    if len(x) != want:
                        raise ValueError("a frame does not hold as many ids as its index says")
                    crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                    if ids:
                        own.append(x.astype(np.int32))
                many = len(n)
                cols = [pa.array(np.full(many, row["shard"], np.int32)), pa.array(np.full(many, row["block"], np.int32)), pa.array(row["doc_id"], pa.int64()), pa.array(np.cumsum(n) - n), pa.array(np.full(many, n.sum())), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(own, pa.list_(pa.int32()))] if ids else []), schema=out_schema)

    spec = "shard int, block int, doc_id bigint, within bigint, block_tokens bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sizes = blocks.select("shard", "block", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = sizes.join(spark.read.schema("shard int, first bigint").parquet(f"{folder}/shards"), "shard").select("shard", "block", (within + F.col("first")).alias("begin"))
    docs = blocks.mapInArrow(of, spec).join(begin, ["shard", "block"])
    return docs.select("doc_id", (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def document(spark: SparkSession, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (a list per row with that key), from its own frame alone."""
    name, learnt = _dictionary(spark, folder)
    opener = _opener(learnt, name)
    at = F.explode(F.filter(F.sequence(F.lit(0), F.size("doc_id") - 1), lambda i: F.get("doc_id", i) == doc_id)).alias("i")
    found = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").filter(F.array_contains("doc_id", F.lit(doc_id).cast("long"))).select("frames", "offsets", at)
    frame = F.expr("substring(frames, CAST(offsets[i] AS INT) + 1, CAST(offsets[i + 1] - offsets[i] AS INT))")
    return [np.frombuffer(opener.decompress(bytes(r[0])), "<u2").tolist() for r in found.select(frame).collect()]
