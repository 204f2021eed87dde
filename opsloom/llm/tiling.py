"""Benchmark decontamination by greedy string tiling.

Documents and test items share a seed where ``seed`` consecutive words are equal (case and punctuation aside).  Seeds of
the documents, found with a rolling Karp-Rabin value, are looked up among those of the items; pairs whose seeds could
cover enough of the item are tiled: the longest common run of unmarked words is marked again and again, until none of
``seed`` words is left.  The share of the item that tiles cover does not depend on the order of its parts, so passages
with their sentences in another order are caught too.

The items are a stated query set.  They go to the tasks in blocks of bounded size, one pass over the documents per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm import words as wd

SEED = 5
COVERAGE = 0.5
#: Words of items that go to the tasks at a time (8 bytes each, and as much for their seeds).
BLOCK_WORDS = 1_000_000


def plain_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case runs of letters and digits."""
    return wd.split_words(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), r"[^\p{L}\p{M}\p{N}]+", " "))


# ---------------------------------------------------------------- tiling of one pair
def _runs(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least n unmarked words as (length, place in item, place in document), by a Karp-Rabin table of length n."""

    def table(x: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(x) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = np.convolve(free, np.ones(n, np.int64), "valid") == n
        at = np.flatnonzero(whole)
        return at, wd.rolling(x, n)[at]

    at_i, h_i = table(item, free_i)
    at_d, h_d = table(doc, free_d)
    where: dict[int, list[int]] = {}
    for a, h in zip(at_i.tolist(), h_i.tolist(), strict=True):
        where.setdefault(h, []).append(a)
    found, reached = [], {}
    for d, h in zip(at_d.tolist(), h_d.tolist(), strict=True):
        for i in where.get(h, ()):
            if reached.get(d - i, -1) > d:  # inside a run of this diagonal that is already known
                continue
            k = 0
            while i + k < len(item) and d + k < len(doc) and free_i[i + k] and free_d[d + k] and item[i + k] == doc[d + k]:
                k += 1
            if k >= n:
                found.append((k, i, d))
                reached[d - i] = d + k
    return found


def tile(item: np.ndarray, doc: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Non-overlapping tiles (length, place in item, place in document), longest first; words are given by their hashes."""
    free_i, free_d = np.ones(len(item), np.int64), np.ones(len(doc), np.int64)
    tiles: list[tuple[int, int, int]] = []
    seed = max(1, min(seed, len(item)))
    n = max(seed, len(item) // 2)
    while True:
        found = _runs(item, doc, free_i, free_d, n)
        longest = max(found)[0] if found else 0
        if longest > 2 * n:  # much longer than the length searched with: start again from there
            n = longest
            continue
        runs = [(-k, i, d) for k, i, d in found]
        heapify(runs)
        while runs:
            k, i, d = heappop(runs)
            free = (free_i[i : i - k] & free_d[d : d - k]).astype(np.int8)
            if free.all():
                free_i[i : i - k] = free_d[d : d - k] = 0
                tiles.append((-k, i, d))
                continue
            edge = np.diff(free, prepend=np.int8(0), append=np.int8(0))  # a longer tile cut it: what is left takes its place by length
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                if b - a >= n:  # shorter ones are met again when n is
                    heappush(runs, (a - b, i + a, d + a))
        if n == seed:
            return sorted(tiles, key=lambda t: (-t[0], t[1], t[2]))
        n = max(seed, n // 2)


# ---------------------------------------------------------------- items
class Items:
    """A block of items: hashed words, and the seeds of each seed length in use, sorted."""

    def __init__(self, ids: list, hashes: list[np.ndarray], seed: int):
        self.ids, self.hashes = ids, hashes
        self.size = np.array([len(h) for h in hashes], np.int64)
        self.seeds = {}
        for m in sorted({min(seed, len(h)) for h in hashes if len(h)}):
            own = [k for k, h in enumerate(hashes) if len(h) and min(seed, len(h)) == m]
            key = np.concatenate([wd.rolling(hashes[k], m) for k in own])
            item = np.concatenate([np.full(len(hashes[k]) - m + 1, k) for k in own])
            place = np.concatenate([np.arange(len(hashes[k]) - m + 1) for k in own])
            order = np.argsort(key, kind="stable")
            bloom = np.zeros(1 << 22, bool)
            bloom[(key & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.seeds[m] = (bloom, key[order], item[order], place[order])

    def hits(self, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """row, place in the chunk, item, place in the item, seed length of all shared seeds."""
        out = []
        row_of = np.repeat(np.arange(len(counts)), counts)
        for m, (bloom, key, item, place) in self.seeds.items():
            roll = wd.rolling(h, m)
            at = np.flatnonzero(bloom[(roll & np.uint64((1 << 22) - 1)).astype(np.int64)] & wd.starts(counts, m))
            low, high = np.searchsorted(key, roll[at], "left"), np.searchsorted(key, roll[at], "right")
            many = high - low
            pick = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            at = np.repeat(at, many)
            out.append((row_of[at], at, item[pick], place[pick], np.full(len(at), m)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def _blocks(items: DataFrame, text: str, key: str, seed: int, most: int) -> Iterator[Items]:
    ids, held, size = [], [], 0
    for row in items.select(key, text).toLocalIterator():
        words, _ = plain_words(pa.array([row[1]], pa.string()))
        if len(words):
            ids.append(row[0])
            held.append(wd.hashes(words))
            size += len(words)
        if size >= most:
            yield Items(ids, held, seed)
            ids, held, size = [], [], 0
    if held:
        yield Items(ids, held, seed)


# ---------------------------------------------------------------- documents
def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", seed: int = SEED, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per pair of a document and an item of which tiles cover at least ``coverage``: doc_id, item_id, n_words of the item, n_covered, n_tiles, longest, coverage.

    Null and empty texts match nothing; an item shorter than ``seed`` words must appear whole.  Rows that repeat a key give
    a row each; null keys stay null.  Empty tables give an empty result.  Other columns are not read.
    """
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    spec = f"doc_id {kind}, item_id {item_kind}, n_words bigint, n_covered bigint, n_tiles bigint, longest bigint, coverage double"
    one = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = None
    for block in _blocks(items, item_text, item_key, seed, block_words):
        part = one.mapInArrow(_tiler(block, seed, coverage), spec)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], spec)


def _tiler(block: Items, seed: int, coverage: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wd.chunks(batches, "_text"):
            words, counts = plain_words(b["_text"])
            h = wd.hashes(words)
            row, at, item, place, m = block.hits(h, counts)
            if not len(row):
                continue
            # Words of the item that shared seeds touch: tiles cannot cover more.
            pair, inverse = np.unique(row * len(block.ids) + item, return_inverse=True)
            longest = int(block.size.max())
            reach = np.unique(np.concatenate([inverse[m > k] * longest + place[m > k] + k for k in range(int(m.max()))]))
            bound = np.bincount(reach // longest, minlength=len(pair))
            base = np.cumsum(counts) - counts
            order = np.argsort(inverse, kind="stable")
            cuts = np.searchsorted(inverse[order], np.arange(len(pair) + 1))
            rows = []
            for p in np.flatnonzero(bound >= coverage * block.size[pair % len(block.ids)]).tolist():
                r, k = divmod(int(pair[p]), len(block.ids))
                # Only document words under a shared seed can lie in a tile; the rest is left out, runs apart stay apart.
                used = at[order[cuts[p] : cuts[p + 1]]] - base[r]
                length = int(m[order[cuts[p]]])
                spots = np.unique((used[:, None] + np.arange(length)).ravel())
                own = h[base[r] + spots].copy()
                gaps = np.flatnonzero(np.diff(spots) > 1) + 1
                own = np.insert(own, gaps, np.uint64(0))
                tiles = tile(block.hashes[k], own, seed)
                covered = sum(x[0] for x in tiles)
                if covered >= coverage * block.size[k]:
                    rows.append((r, block.ids[k], int(block.size[k]), covered, len(tiles), tiles[0][0], covered / int(block.size[k])))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([b["_key"].take(pa.array(cols[0])), *(pa.array(c) for c in cols[1:])], ["doc_id", "item_id", "n_words", "n_covered", "n_tiles", "longest", "coverage"])

    return of
