"""Exact nearest neighbours of a query table in a vector table, with an optional predicate per query.

Vectors of length one obey the triangle inequality, so a query need not look at all of them.  A bounded sample of the vectors are pivots; every
vector belongs to its nearest one, and the vectors of a pivot are cut into tiles of at most ``tile_bytes`` (more where an index would have over ``TILES`` of them), sorted by their distance from it.  A tile
with vectors between r and R from its pivot holds nothing closer to a query than max(r - d, d - R), if the query is d from the pivot.
Tiles are looked at from the smallest such bound on, a few at first and eight times as many in each further look; a query and index is done when its
k-th best is closer than all that is left.  What a predicate rules out is never a candidate, and tiles without a vector that it allows are not looked at.

Queries travel to tiles in blocks of ``block_queries`` (more where these are under ``BLOCK_BYTES``), so a tile is sent once a look for each of them.  Between them a
pair of a query and a tile is two numbers: the vector itself is exchanged once for each of ``BUCKETS`` groups of tiles that it looks into.
Only what can be among the best k of a (query, index) leaves a tile: in further looks nothing that is farther than the k-th best of the looks before.
A task compares a tile with many queries in one matrix product of at most ``CELLS`` pairs, and computes distances anew only of those that it lets out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsloom.session import keep

TILE_BYTES = 4 << 20
#: Tiles that an index is cut into at most by size (until these have TILE_BYTES), besides those that end with their pivot: pairs of a query and a tile grow with the queries.
TILES = 32
#: A query's vector is sent to its tiles once per bucket of tiles; there are more buckets where one would be larger than BUCKET_BYTES.
BUCKETS, BUCKET_BYTES = 32, 16 << 20
#: Blocks of queries meet a bucket of tiles, both held by a task.
BLOCK_QUERIES, BLOCK_BYTES = 256, 32 << 20
#: Pairs of a query and a vector whose distance is in memory at a time, and bytes of components of those that are computed anew.
CELLS, EXACT_BYTES = 1 << 21, 8 << 20
#: Pivots: at most so many vectors are on the driver and in every task; fewer where an index has under ``CELL_ROWS`` vectors for each.
PIVOTS, CELL_ROWS = 256, 2_000
FIRST_LOOK = 4
#: More than what rounding in matrix products can shift a distance.
SLACK = 1e-9


def _units(lists: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors with ``size`` components that have a direction, and these as rows of length one."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    if not size:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    at = np.flatnonzero(lengths == size)
    rows = pc.fill_null(lists.take(pa.array(at)).flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(len(at), size)
    norm = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(norm) & (norm > 0)
    return at[good], rows[good] / norm[good, None]


def _sizes(lists: pa.Array) -> list[int]:
    return [s for s in pc.unique(pc.fill_null(pc.list_value_length(lists), 0)).to_pylist() if s]


def _edges(distance: np.ndarray) -> np.ndarray:
    """Straight-line distance of points of the unit sphere whose cosine is 1 - ``distance``."""
    return np.sqrt(np.maximum(0, 2 * distance))


class _Pivots:
    def __init__(self, rows: list):
        lists = pa.array([r for r in rows], pa.list_(pa.float64()))
        self.by_size = {s: u for s in _sizes(lists) if len(u := _units(lists, s)[1])}
        self.begin, n = {}, 0
        for s, u in sorted(self.by_size.items()):
            self.begin[s], n = n, n + len(u)

    def nearest(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Size (0: no direction), pivot (-1: none of its size) and straight-line distance from it, of each vector."""
        n = len(lists)
        size, pivot, edge = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.zeros(n)
        for s in _sizes(lists):
            at, units = _units(lists, s)
            size[at] = s
            if s in self.by_size and len(at):
                e = _edges(1 - units @ self.by_size[s].T)
                best = e.argmin(axis=1)
                pivot[at], edge[at] = best + self.begin[s], e[np.arange(len(at)), best]
        return size, pivot, edge


def _assigned(pivots: _Pivots):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, pivot, edge = pivots.nearest(b["vector"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(size), pa.array(pivot), pa.array(edge)], names=[*b.schema.names, "size", "pivot", "edge"])

    return of


def _tiled(most: int):
    """Runs of one (index, size, pivot), cut by bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        last = None

        def one(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            s = rows["size"][0].as_py()
            _, units = _units(rows["vector"].combine_chunks(), s)
            edge = rows["edge"].to_numpy()
            lists = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows[c].combine_chunks()) for c in ("doc_id", "machine")]
            first = rows["doc_id"].take(pc.sort_indices(rows["doc_id"])[:1]).combine_chunks()
            heads = [pa.array([(part << 32) + number], pa.int64()), rows["index"].slice(0, 1).combine_chunks(), pa.array([s], pa.int32()), rows["pivot"].slice(0, 1).combine_chunks(), pa.array([edge.min()]), pa.array([edge.max()]), first]
            return pa.RecordBatch.from_arrays([*heads, *lists, pa.array([units.tobytes()], pa.binary())], names=["tile", "index", "size", "pivot", "low", "high", "first", "docs", "machines", "units"])

        for b in batches:
            start = 0
            for k in range(b.num_rows):  # keys are small; the vectors stay in Arrow
                key = (b["index"][k].as_py(), b["size"][k].as_py(), b["pivot"][k].as_py())
                if held_rows(held) + k - start and (key != last or size >= most):
                    if k > start:
                        held.append(b.slice(start, k - start))
                    yield one(pa.Table.from_batches(held))
                    held, size, start = [], 0, k
                last = key
                size += 8 * key[1] + 64
            if b.num_rows > start:
                held.append(b.slice(start))
        if held:
            yield one(pa.Table.from_batches(held))

    def held_rows(held):
        return sum(b.num_rows for b in held)

    return of


def _distances(pivots: _Pivots):
    """Size of a query's vector and, for each pivot of that size, the straight-line distance."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, edges = np.zeros(b.num_rows, np.int32), [[] for _ in range(b.num_rows)]
            for s in _sizes(b["vector"]):
                at, units = _units(b["vector"], s)
                size[at] = s
                if s in pivots.by_size:
                    for row, e in zip(at.tolist(), _edges(1 - units @ pivots.by_size[s].T), strict=True):
                        edges[row] = [{"pivot": pivots.begin[s] + j, "d": x} for j, x in enumerate(e.tolist())]
            kind = pa.list_(pa.struct([("pivot", pa.int32()), ("d", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b["q"], pa.array(size), pa.array(edges, kind)], names=["q", "size", "edges"])

    return of


def _first_k(row: np.ndarray, x: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest ``x`` of each row, ties by place of the document."""
    turn = np.lexsort((doc, x, row))
    of = row[turn]
    return turn[np.arange(len(turn)) - np.searchsorted(of, of) < k]


def _nearest(own: np.ndarray, units: np.ndarray, limit: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best of ``units``, in the order of their documents, for each row of ``own`` (places of both, distance), without those beyond the row's limit."""
    step, exact = max(1, CELLS // len(units)), max(1, EXACT_BYTES // (8 * units.shape[1]))
    for begin in range(0, len(own), step):
        part, top = own[begin : begin + step], limit[begin : begin + step] + SLACK
        rough = 1 - part @ units.T
        if len(units) > k:
            many = np.flatnonzero((rough <= top[:, None]).sum(axis=1) > 4 * k)
            if len(many):
                top[many] = np.minimum(top[many], np.partition(rough[many], k - 1, axis=1)[:, k - 1] + SLACK)
        row, doc = np.nonzero(rough <= top[:, None])
        x = np.empty(len(row))
        for at in range(0, len(row), exact):  # the same for equal vectors, whatever tile they are in
            x[at : at + exact] = 1 - (units[doc[at : at + exact]] * part[row[at : at + exact]]).sum(axis=1)
        pick = _first_k(row, x, doc, k)
        yield row[pick] + begin, doc[pick], x[pick]


def _best(k: int):
    """The k best of each tile of a bucket for each query of a block that looks into it."""

    def of(tiles: pa.Table, asked: pa.Table) -> pa.Table:
        tiles, asked = tiles.combine_chunks(), asked.combine_chunks()
        nothing = [asked["q"].slice(0, 0), tiles["index"].slice(0, 0), pa.chunked_array([], tiles.schema.field("docs").type.value_type), pa.chunked_array([], pa.float64())]
        found = [pa.Table.from_arrays(nothing, names=["q", "index", "doc_id", "distance"])]
        if not tiles.num_rows or not asked.num_rows:
            return found[0]
        vectors, wanted = _one(asked["vector"]), np.array(asked["machine"].to_pylist(), object)
        named = any(w is not None for w in wanted)
        visits = _one(asked["tiles"])
        asks = np.repeat(np.arange(asked.num_rows), pc.list_value_length(visits).to_numpy(zero_copy_only=False))
        into, limits = (visits.flatten().field(i) for i in (0, 1))
        into, limits = into.to_numpy(zero_copy_only=False), pc.fill_null(limits, np.inf).to_numpy(zero_copy_only=False)
        turn = np.argsort(into, kind="stable")
        asks, into, limits = asks[turn], into[turn], limits[turn]
        held = {}  # of each size: place of each query among the vectors with a direction, and these
        for i in range(tiles.num_rows):
            tile, size = tiles["tile"][i].as_py(), tiles["size"][i].as_py()
            begin, end = np.searchsorted(into, [tile, tile + 1])
            if begin == end:
                continue
            who, limit = asks[begin:end], limits[begin:end]
            if size not in held:
                at, own = _units(vectors, size)
                place = np.full(asked.num_rows, -1)
                place[at] = np.arange(len(at))
                held[size] = place, own
            place, own = held[size]
            docs = tiles["docs"][i].values
            order = pc.sort_indices(docs).to_numpy()
            machines = np.array(tiles["machines"][i].as_py(), object) if named else None
            units = np.frombuffer(tiles["units"][i].as_buffer(), np.float64).reshape(-1, size) if size else None
            for name in set(wanted[who]) if named else (None,):
                mine = np.flatnonzero(wanted[who] == name) if named else np.arange(len(who))
                at = order if name is None else order[machines[order] == name]
                if not len(at):
                    continue
                near = mine[place[who[mine]] >= 0]
                out = []
                if len(near):
                    out += [(near[r], at[d], x) for r, d, x in _nearest(own[place[who[near]]], units[at], limit[near], k)]
                loose = mine[(place[who[mine]] < 0) & (limit[mine] >= 1.0 - SLACK)]  # all are at distance 1
                if len(loose):
                    out.append((np.repeat(loose, len(at[:k])), np.tile(at[:k], len(loose)), np.ones(len(loose) * len(at[:k]))))
                for r, d, x in out:
                    if len(r):
                        index = pa.chunked_array([tiles["index"].slice(i, 1).combine_chunks().take(pa.array(np.zeros(len(r), np.int64)))])
                        found.append(pa.Table.from_arrays([asked["q"].take(pa.array(who[r])), index, pa.chunked_array([docs.take(pa.array(d))]), pa.chunked_array([pa.array(x)])], names=found[0].column_names))
        return pa.concat_tables(found)

    return of


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def tile_bytes_of(least: int, rows: int, indexes: int, length: float) -> int:
    """Bytes of a tile: ``least``, or up to ``TILE_BYTES`` where an index of usual size would have over ``TILES`` of them."""
    return max(least, min(TILE_BYTES, int(rows * (8 * length + 64) / (indexes * TILES))))


def block_of(least: int, queries: int, length: float) -> int:
    """Queries of a block: ``least``, or as many as BLOCK_BYTES hold, with their pairs with the tiles of a bucket."""
    return max(least, min(queries, int(BLOCK_BYTES / (8 * length + 64 + 16 * TILES))))


def knn(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector: str = "embedding",
    index: str = "index",
    machine: str | None = None,
    only: str | None = None,
    pivots: int | None = None,
    tile_bytes: int = TILE_BYTES,
    block_queries: int = BLOCK_QUERIES,
    first_look: int = FIRST_LOOK,
    digits: int = 6,
    visits: list | None = None,
) -> DataFrame:
    """Best ``k`` per (query, index): query_id, index, doc_id, distance, rank.

    distance = 1 - cosine, ranked as it is and then rounded to ``digits``; ties go to the smaller doc_id.  Pairs
    with a null, empty, unequal or zero vector, or one with a component that is null, NaN or infinite, have cosine 0.  ``only`` names a column of the queries: where it is not
    null, only vectors whose column ``machine`` has this value are candidates.  ``visits`` is given (tiles looked at, tiles there were) over all queries.
    """
    text = F.lit(None).cast("string")
    c = chunks.select(F.col(index).alias("index"), F.col(doc_id).alias("doc_id"), F.col(vector).cast("array<double>").alias("vector"), (F.col(machine).cast("string") if machine else text).alias("machine"))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("vector"), (F.col(only).cast("string") if only else text).alias("machine"))
    q = keep(q.withColumn("q", F.monotonically_increasing_id()), "knn-queries")
    own, doc = c.schema["index"].dataType.simpleString(), c.schema["doc_id"].dataType.simpleString()

    n, indexes, long = c.agg(F.count(F.lit(1)), F.approx_count_distinct("index"), F.avg(F.greatest(F.size("vector"), F.lit(0)))).first()
    tile_bytes = tile_bytes_of(tile_bytes, n, max(1, indexes), long or 0)
    if pivots is None:
        pivots = max(1, min(PIVOTS, n // (max(1, indexes) * CELL_ROWS)))
    sample = c.filter(F.size("vector") > 0).select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(pivots).collect()
    held = _Pivots([r["vector"] for r in {r["h"]: r for r in sample}.values()])
    order = [F.asc_nulls_first("index"), F.col("size"), F.col("pivot"), F.col("edge"), F.col("doc_id")]
    placed = c.mapInArrow(_assigned(held), f"index {own}, doc_id {doc}, vector array<double>, machine string, size int, pivot int, edge double")
    spec = f"tile bigint, index {own}, size int, pivot int, low double, high double, first {doc}, docs array<{doc}>, machines array<string>, units binary"
    tiles = keep(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_tiled(tile_bytes), spec), "knn-tiles")

    heads = tiles.select("tile", "index", F.col("size").alias("_size"), "pivot", "low", "high", "first", F.array_distinct("machines").alias("_machines"))
    far = q.select("q", "vector").mapInArrow(_distances(held), "q bigint, size int, edges array<struct<pivot:int,d:double>>").join(q.select("q", "machine"), "q")
    near = far.select("q", "machine", F.explode("edges").alias("e")).select("q", "machine", F.col("e.pivot").alias("pivot"), F.col("e.d").alias("d"))
    edge = F.greatest(F.lit(0.0), F.col("low") - F.col("d"), F.col("d") - F.col("high"))
    allowed = F.col("machine").isNull() | F.array_contains("_machines", F.col("machine"))
    bounded = heads.join(near, "pivot").filter(allowed).select("q", "tile", "index", "first", (edge * edge / 2 - SLACK).alias("bound"))
    # Tiles that no pivot speaks for: of another size than the query, or without a direction, all at distance 1, and of sizes that the sample has not.
    kinds = heads.select("_size", (F.col("pivot") < 0).alias("_loose")).distinct().collect()  # one row per vector size
    every = F.array(*(F.struct(F.lit(r["_size"]).alias("_size"), F.lit(r["_loose"]).alias("_loose")) for r in kinds)) if kinds else F.array().cast("array<struct<_size:int,_loose:boolean>>")
    odd = far.select("q", "machine", "size", F.explode(F.filter(every, lambda s: s["_loose"] | (s["_size"] != F.col("size")))).alias("s")).select("q", "machine", "size", "s._size", "s._loose")
    other = heads.withColumn("_loose", F.col("pivot") < 0).join(odd, ["_size", "_loose"]).filter(allowed)
    loose = other.select("q", "tile", "index", "first", F.when((F.col("_size") == F.col("size")) & (F.col("_size") > 0), 0.0).otherwise(1.0).alias("bound"))
    turn = Window.partitionBy("q", "index").orderBy("bound", "first", "tile")
    plan = keep(bounded.unionByName(loose).withColumn("turn", F.row_number().over(turn)).withColumn("limit", F.lit(None).cast("double")), "knn-plan")
    most = plan.agg(F.max("turn")).first()[0] or 0

    asked_n = q.count()
    blocks = max(1, -(-asked_n // block_of(block_queries, asked_n, long or 0)))
    bucket = F.pmod(F.xxhash64("tile"), F.lit(max(BUCKETS, int(n * (8 * (long or 0) + 64) / BUCKET_BYTES)))).alias("bucket")
    asked = q.select("q", "vector", "machine", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block"))
    dealt = tiles.select(bucket, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "tile", "index", "size", "docs", "machines", "units")
    best, left, seen, look = None, plan, 0, first_look
    w = Window.partitionBy("q", "index").orderBy("distance", "doc_id")
    looked = 0
    while True:
        now = left.filter(F.col("turn") <= seen + look)
        if visits is not None:
            looked += now.count()
        sent = now.select("q", bucket, F.struct("tile", "limit").alias("visit")).groupBy("q", "bucket").agg(F.collect_list("visit").alias("tiles")).join(asked, "q")
        met = dealt.groupBy("bucket", "block").cogroup(sent.groupBy("bucket", "block"))
        found = met.applyInArrow(_best(k), f"q bigint, index {own}, doc_id {doc}, distance double")
        every = found if best is None else best.drop("rank").unionByName(found)
        best = keep(every.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k), "knn-best")
        seen, look = seen + look, look * 8
        if seen >= most:
            break
        last = best.filter(F.col("rank") == k).select(F.col("q").alias("_q"), F.col("index").alias("_index"), F.col("distance").alias("_distance"), F.col("doc_id").alias("_doc"))
        open_ = left.filter(F.col("turn") > seen).join(last, (F.col("q") == F.col("_q")) & F.col("index").eqNullSafe(F.col("_index")), "left")
        better = F.col("_q").isNull() | (F.col("bound") < F.col("_distance")) | ((F.col("bound") <= F.col("_distance") + SLACK) & (F.col("first") < F.col("_doc")))
        left = keep(open_.filter(better).select(*plan.columns[:-1], F.col("_distance").alias("limit")), "knn-left")
        if left.isEmpty():
            break
    if visits is not None:
        visits += [looked, plan.count()]
    return q.select("query_id", "q").join(best, "q").select("query_id", "index", "doc_id", (F.round("distance", digits) + 0.0).alias("distance"), "rank")
