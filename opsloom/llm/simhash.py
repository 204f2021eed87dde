"""SimHash near duplicates by multi-index hashing.

A fingerprint is cut into segments.  Two fingerprints that differ in at most 4 bits differ, by the pigeonhole
principle, in at most ``radius`` bits of one of the segments, so it is enough to enumerate the Hamming ball of that
radius around each segment, fetch what the table holds under these keys, and verify the whole distance.
Links become components by alternating large-star and small-star rounds over tables in the shared folder.

Exact copies share a fingerprint and so are one row before any search.  A key that very many different fingerprints
share is searched block by block: tasks of bounded size compare blocks with numpy and give back no more than a forest
that connects what is linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm import words as wd
from opsloom.session import keep

RADIUS = 4
#: A key with more fingerprints than this is searched in blocks of BLOCK.
HOT = 48
BLOCK = 1024
#: Segments as (bits, radius); sum(radius + 1) is RADIUS + 1, so no link is missed.  Both layouts find the same links:
#: the wider segments keep buckets small once there are more fingerprints than the narrow ones have keys.
NARROW = ((22, 1), (22, 1), (20, 0))
WIDE = ((28, 2), (36, 1))


# ---------------------------------------------------------------- fingerprints
def shingles(text: pa.Array, n: int) -> tuple[list[bytes], np.ndarray]:
    """Space-joined runs of n words of each row end to end, and their number by row; a shorter row is one run of all its words."""
    words, counts = wd.split_words(text)
    ok = wd.starts(counts, n)
    at = np.flatnonzero(ok)
    m = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    joined = pc.binary_join_element_wise(*(words.take(pa.array(at + k)) for k in range(n)), " ").cast(pa.binary()).to_pylist()
    short = np.flatnonzero((counts > 0) & (counts < n))
    if not len(short):
        return joined, m
    first = np.concatenate(([0], np.cumsum(counts)))
    out, k = [], 0
    for row, (count, many) in enumerate(zip(counts.tolist(), m.tolist(), strict=True)):
        if 0 < count < n:
            out.append(" ".join(words.slice(int(first[row]), count).to_pylist()).encode())
        else:
            out += joined[k : k + many]
            k += many
    return out, m


def simhash(text: pa.Array, n: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half of the row's shingle hashes."""
    runs, m = shingles(pc.ascii_lower(pc.fill_null(text, "")), n)
    h = np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in runs), np.uint64, len(runs))
    votes = np.zeros((len(m), 64), np.int64)
    full = np.flatnonzero(m > 0)
    if len(full):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.concatenate(([0], np.cumsum(m)))[full]
        votes[full] = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
    ones = 2 * votes > m[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 4) -> DataFrame:
    """``key`` and ``fingerprint`` (a long with the 64 bits) of each row.  A null or blank text has fingerprint 0."""
    kind = docs.schema[key].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wd.chunks(batches, "_text"):
            yield pa.RecordBatch.from_arrays([b["_key"], pa.array(simhash(b["_text"], n).view(np.int64))], ["_key", "fingerprint"])

    one = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return one.mapInArrow(of, f"_key {kind}, fingerprint bigint").withColumnRenamed("_key", key)


# ---------------------------------------------------------------- links
def ball(bits: int, radius: int) -> list[int]:
    masks = [0]
    for _ in range(radius):
        masks = sorted({m ^ (1 << j) for m in masks for j in range(bits)} | set(masks))
    return masks


def _keys(fps: DataFrame, segments, probe: bool) -> DataFrame:
    """fp, seg, key.  Of two keys that differ, the one with 0 in the lowest differing bit probes for the other, so each pair is met once."""
    low, parts = 0, []
    for seg, (bits, radius) in enumerate(segments):
        own = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << bits) - 1))
        masks = F.array(*(F.lit(m).cast("long") for m in (ball(bits, radius) if probe else [0])))
        parts.append(_around(own, masks, F.lit(seg)))
        low += bits
    return fps.select("fp", F.explode(F.concat(*parts)).alias("_k")).select("fp", "_k.seg", "_k.key")


def _around(own: Column, masks: Column, seg: Column) -> Column:
    chosen = F.filter(masks, lambda m: own.bitwiseAND(m).bitwiseAND(-m) == 0)
    return F.transform(chosen, lambda m: F.struct(seg.alias("seg"), own.bitwiseXOR(m).alias("key")))


def _forest(radius: int):
    """Edges that connect whatever is linked between the two sides of a block."""

    def of(pdf):
        import pandas as pd

        a, b = (np.unique(pdf["fp"].to_numpy()[pdf["side"].to_numpy() == s]).view(np.uint64) for s in (0, 1))
        near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
        big = len(a)
        rows = np.where(near.any(1), np.arange(big), big)
        while True:
            cols = np.where(near, rows[:, None], big).min(0, initial=big)
            new = np.minimum(rows, np.where(near, cols[None, :], big).min(1, initial=big))
            if (new == rows).all():
                break
            rows = new
        i, j = np.flatnonzero(rows < big), np.flatnonzero(cols < big)
        left = np.concatenate((a[i], b[j])).view(np.int64)
        right = np.concatenate((a[rows[i]], a[cols[j]])).view(np.int64)
        return pd.DataFrame({"a": left, "b": right})[left != right]

    return of


def connections(fps: DataFrame, radius: int = RADIUS, hot: int = HOT, block: int = BLOCK, segments=None) -> DataFrame:
    """Edges a > b among distinct fingerprints ``fp``: every link of two keys that are not hot, and for hot keys a forest with the same components."""
    segments = segments or (NARROW if fps.count() <= 1 << 20 else WIDE)
    if sum(r + 1 for _, r in segments) != radius + 1 or sum(b for b, _ in segments) != 64:
        raise ValueError("segments must cover 64 bits and their radii must add up to the radius")
    index, probes = _keys(fps, segments, False), _keys(fps, segments, True)
    on = ["seg", "key"]
    crowded = keep(index.groupBy(on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot), "simhash-hot")
    cool = index.join(crowded, on, "left_anti").withColumnRenamed("fp", "b")
    met = probes.withColumnRenamed("fp", "a").join(cool, on).filter("a != b AND bit_count(a ^ b) <= %d" % radius)
    edges = met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if crowded.isEmpty():
        return edges.distinct()
    seekers = keep(probes.join(crowded, on), "simhash-seekers")
    size = seekers.groupBy(on).agg(F.count(F.lit(1)).alias("m"))
    cells = crowded.join(size, on).select(*on, F.ceil(F.col("n") / block).cast("int").alias("nb"), F.ceil(F.col("m") / block).cast("int").alias("mb"))
    here = F.pmod(F.xxhash64("fp"), F.col("count")).cast("int")

    def dealt(rows: DataFrame, side: int, own: str, other: str, own_cell: str, other_cell: str) -> DataFrame:
        x = rows.select("fp", *on).join(cells, on).withColumn("count", F.col(own))
        return x.select("fp", *on, F.lit(side).alias("side"), here.alias(own_cell), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_cell))

    both = dealt(seekers, 0, "mb", "nb", "i", "j").unionByName(dealt(index, 1, "nb", "mb", "j", "i"))
    found = both.groupBy(*on, "i", "j").applyInPandas(_forest(radius), "a long, b long")
    return edges.unionByName(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct()


# ---------------------------------------------------------------- components
def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node of ``edges`` (a, b)."""
    e = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = keep(large, "large-star")
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(first.select("a", F.col("m").alias("b")))
        e = keep(small.distinct(), "small-star")
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


# ---------------------------------------------------------------- documents
def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, n: int = 4, hot: int = HOT, block: int = BLOCK, segments=None) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest key reachable over links) of each row.

    Null, empty and blank texts have fingerprint 0 and are linked like any other.  Rows that repeat a key or a text give
    a row each.  A null key never names a component, unless all keys of the component are null.  An empty table gives an
    empty result.  Columns other than ``text`` and ``key`` are not read and may have any name.
    """
    fps = keep(fingerprints(docs, text, key, n), "fingerprints")
    classes = fps.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("first"))
    groups = components(connections(classes.select("fp"), radius, hot, block, segments))
    led = classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    led = keep(led, "classes")
    heads = led.groupBy("root").agg(F.min("first").alias("component_id"))
    named = led.join(heads, "root").select(F.col("fp").alias("fingerprint"), "component_id")
    out = fps.join(named, "fingerprint")
    return out.select(key, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
