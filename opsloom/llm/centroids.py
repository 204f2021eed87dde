"""Centroid clustering of integer vectors with exact distances from subvector dictionaries.

Method: the dimensions are cut into blocks of ``WIDTH``.  Every chunk of at most ``ROWS`` vectors is written once, to the shared folder, as codes into
dictionaries of its different subvectors, one dictionary per block; nothing is lost.  In each round a task computes the squared distances of every
different subvector to the centroids' parts once, and adds them up by code for all vectors of the chunk.  Only sums and counts per centroid and
dimension leave a task, so no vector is exchanged and equal vectors meet nowhere.

All arithmetic is on integers.  Kept vectors have the asked number of components, none null, NaN or infinite, and none beyond ``LARGEST`` after
scaling (a squared distance might not fit a long); others give no row.  Ties go to the smaller centroid number.  Rows that repeat an id are vectors of their own; among the starting
centroids they come in the order of their components.  A null id is taken as the empty text in the starting order.  Fewer vectors than centroids: fewer centroids.  An empty table gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.session import keep

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
WIDTH, ROWS = 2, 16_384  # a code takes two bytes, so at most 65,536 rows
LARGEST = 1 << 27  # 64 squared differences of twice this stay below 2^63
_CHUNK = "ids array<bigint>, codes binary, dictionaries binary, sizes array<int>"


def integers(vectors: DataFrame, vector: str, dimensions: int, scale: int) -> DataFrame:
    """Only vectors that are kept, as ``whole``: floor(scale * x) of each component."""
    x = F.col(vector)
    good = F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double") * scale) <= LARGEST, F.lit(False)))  # false for null, NaN (above all numbers) and infinities
    return vectors.filter((F.size(x) == dimensions) & good).withColumn("whole", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int")))


def _encoded(dimensions: int, width: int, rows: int):
    def encode(ids: pa.Array, whole: np.ndarray) -> dict:
        codes, words, sizes = [], [], []
        for a in range(0, dimensions, width):
            part = np.ascontiguousarray(whole[:, a : a + width])
            _, first, code = np.unique(part.view([("", part.dtype)] * part.shape[1]).ravel(), return_index=True, return_inverse=True)
            codes.append(code.astype("<u2"))
            words.append(part[first].tobytes())
            sizes.append(len(first))
        return {"ids": ids.to_pylist(), "codes": np.concatenate(codes).tobytes(), "dictionaries": b"".join(words), "sizes": sizes}

    schema = pa.schema([("ids", pa.list_(pa.int64())), ("codes", pa.binary()), ("dictionaries", pa.binary()), ("sizes", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(rows - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                at, n = at + take, n + take
                if n == rows:
                    yield one(held)
                    held, n = [], 0
        if n:
            yield one(held)

    def one(held):
        table = pa.Table.from_batches(held).combine_chunks()
        whole = table["whole"].combine_chunks().flatten().to_numpy().astype("<i4").reshape(-1, dimensions)
        return pa.RecordBatch.from_pylist([encode(table["id"], whole)], schema)

    return run


class _Chunk:
    """Codes and dictionaries of one written chunk."""

    def __init__(self, batch: pa.RecordBatch, k: int, dimensions: int, width: int):
        sizes = batch["sizes"][k].as_py()
        self.n = len(batch["ids"][k])
        self.codes = np.frombuffer(batch["codes"][k].as_py(), "<u2").reshape(len(sizes), self.n)
        words = np.frombuffer(batch["dictionaries"][k].as_py(), "<i4").astype(np.int64)
        self.parts, at = [], 0
        for b, size in enumerate(sizes):
            w = min(width, dimensions - b * width)
            self.parts.append(words[at : at + size * w].reshape(size, w))
            at += size * w

    def nearest(self, centroids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and squared distance."""
        total = np.zeros((self.n, len(centroids)), np.int64)
        for b, part in enumerate(self.parts):
            own = centroids[:, b * width : b * width + part.shape[1]]
            distance = np.zeros((len(part), len(centroids)), np.int64)
            for k in range(part.shape[1]):
                distance += (part[:, k, None] - own[None, :, k]) ** 2
            total += distance[self.codes[b]]
        cluster = total.argmin(axis=1)  # the first of equal ones
        return cluster, total[np.arange(self.n), cluster]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """Component sums by cluster."""
        order = np.argsort(cluster, kind="stable")
        at = np.searchsorted(cluster[order], np.arange(k))
        full = np.flatnonzero(np.bincount(cluster, minlength=k))
        out = np.zeros((k, sum(p.shape[1] for p in self.parts)), np.int64)
        column = 0
        for b, part in enumerate(self.parts):
            out[full, column : column + part.shape[1]] = np.add.reduceat(part[self.codes[b][order]], at[full], axis=0)
            column += part.shape[1]
        return out


def _summed(centroids: np.ndarray, width: int):
    """Sums and counts of all chunks of a task: one row per centroid and task, added up in Python's integers where they outgrow a long."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dimensions), object), np.zeros(k, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = _Chunk(batch, i, dimensions, width)
                cluster, _ = chunk.nearest(centroids, width)
                sums += chunk.sums(cluster, k)
                counts += np.bincount(cluster, minlength=k)
        full = np.flatnonzero(counts)
        at = np.repeat(full, dimensions)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(np.tile(np.arange(dimensions), len(full)), pa.int32()), pa.array(list(map(str, sums[full].ravel())), pa.string()), pa.array(counts[at], pa.int64())],
            names=["cluster", "dimension", "total", "n"],
        )

    return run


def _assigned(centroids: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cluster, distance = _Chunk(batch, i, centroids.shape[1], width).nearest(centroids, width)
                yield pa.RecordBatch.from_arrays([batch["ids"][i].values, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    return run


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    dimensions: int = DIMENSIONS,
    centroids: int = CENTROIDS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    width: int = WIDTH,
    chunk_rows: int = ROWS,
    salt: str = "2:",
) -> tuple[DataFrame, list[list[int]]]:
    """(key, cluster, distance) of every kept vector after ``rounds`` rounds of Lloyd's algorithm, and the final centroids.

    The start is the ``centroids`` vectors with the smallest SHA-256 of ``salt`` and id.  The driver holds nothing but centroids and their sums.
    """
    whole = integers(vectors, vector, dimensions, scale).select(F.col(key).cast("long").alias("id"), "whole")
    by = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chunks = keep(whole.mapInArrow(_encoded(dimensions, width, chunk_rows), _CHUNK), "centroid-chunks")
    now = np.array([r["whole"] for r in whole.orderBy(by, "whole").limit(centroids).select("whole").collect()], np.int64).reshape(-1, dimensions)
    if len(now):
        for _ in range(rounds):
            total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
            sums = chunks.mapInArrow(_summed(now, width), "cluster int, dimension int, total string, n bigint").groupBy("cluster", "dimension").agg(total, F.sum("n").alias("n"))
            now = now.copy()
            for row in sums.collect():  # centroids x dimensions rows
                now[row["cluster"], row["dimension"]] = int(row["total"]) // row["n"]
    out = chunks.mapInArrow(_assigned(now, width), "id bigint, cluster int, distance bigint")
    return out.select(F.col("id").alias(key), "cluster", "distance"), now.tolist()


def with_inertia(assigned: DataFrame, centroids: list[list[int]], key: str = "vec_id") -> DataFrame:
    """The rows with their cluster's and the whole inertia and the SHA-256 of their centroid's components."""
    import hashlib

    rows = keep(assigned, "centroid-rows")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most one row per centroid
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = F.array(*(F.struct(F.lit(min(sums.get(i, 0), (1 << 63) - 1)).cast("long").alias("s"), F.lit(h).alias("h")) for i, h in enumerate(shas))) if shas else None
    own = F.element_at(facts, F.col("cluster") + 1) if shas else F.lit(None).cast("struct<s:bigint,h:string>")
    return rows.select(key, "cluster", "distance", own["s"].alias("cluster_inertia"), F.lit(min(sum(sums.values()), (1 << 63) - 1)).cast("long").alias("inertia"), own["h"].alias("centroid_sha256"))
