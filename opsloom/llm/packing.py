"""Packing of documents into sequences of fixed length by local search.

Only documents longer than a sequence are cut.  Pieces are dealt by hash into groups of bounded size, which pack
independently.  Each group starts from best fit decreasing and then searches locally: from the emptiest bin on, pieces
are moved into gaps, exchanged one for one or two for one with a smaller load of a fuller bin.  Every step
increases the sum of squared fills, so the search ends, and bins that run empty are given back.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm import tokens as tk
from opsloom.llm import words as wd
from opsloom.session import keep

CAPACITY = 2048
END = 0
#: Pieces per group: bounds the memory and time of one packing task.
GROUP = 20_000
ROUNDS = 4


# ---------------------------------------------------------------- pieces
def pieces(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document (a null text is an empty one: just the end id)."""
    path = vocabulary or tk.vocabulary()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wd.chunks(batches, "_text", tk.CHUNK):
            ids, counts = tk.with_end(*tk.encoder(path).encode(b["_text"]), end)
            many = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, counts[row] - start)
            at = (np.cumsum(counts) - counts)[row] + start
            crc = [zlib.crc32(ids[a : a + n].astype("<u4").tobytes()) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["_key"].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    one = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return one.mapInArrow(of, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# ---------------------------------------------------------------- one group
def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``sizes``, largest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []  # the gaps that some bin has, ascending
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(gaps, sizes[i])
        if at < len(gaps):
            gap = gaps[at]
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                del gaps[at]
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = gap - sizes[i]
        if left:
            if not by_gap[left]:
                insort(gaps, left)
            by_gap[left].append(b)
    return bins


class Search:
    """Bins of one group with an index from the load a bin could take in exchange for one of its pieces to that piece."""

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int):
        self.sizes, self.bins, self.capacity = sizes, bins, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.gap: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.room: list[dict[tuple[int, int], None]] = [{} for _ in range(capacity + 1)]
        for b in range(len(bins)):
            self.enter(b)

    def enter(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        if gap and self.fill[b]:
            self.gap[gap].add(b)
            for i in self.bins[b]:
                self.room[self.sizes[i] + gap][(b, i)] = None

    def leave(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        if gap and self.fill[b]:
            self.gap[gap].discard(b)
            for i in self.bins[b]:
                self.room[self.sizes[i] + gap].pop((b, i), None)

    def apply(self, a: int, out: tuple[int, ...], b: int, back: tuple[int, ...]) -> None:
        """``out`` goes from bin a to bin b and ``back`` the other way."""
        self.leave(b)
        for x, mine, theirs in ((a, out, back), (b, back, out)):
            self.bins[x] = [i for i in self.bins[x] if i not in mine] + list(theirs)
            self.fill[x] += sum(self.sizes[i] for i in theirs) - sum(self.sizes[i] for i in mine)
        self.enter(b)

    def partner(self, load: int, a: int) -> tuple[int, int] | None:
        """A bin and one piece of it smaller than ``load`` that would leave no gap, or the smallest gap near it, if exchanged for it."""
        for room in range(load, min(self.capacity, load + 8) + 1):
            for b, i in self.room[room]:
                if b != a and self.sizes[i] < load and self.fill[b] + load - self.sizes[i] > self.fill[a]:
                    return b, i
        return None

    def empty(self, a: int) -> bool:
        """Take pieces out of bin a by moves and exchanges until it is empty or nothing helps; did anything change?"""
        self.leave(a)
        changed, go = False, True
        while go and self.bins[a]:
            go = False
            own = sorted(self.bins[a], key=lambda i: -self.sizes[i])
            for i in own:  # move
                for gap in range(self.sizes[i], self.capacity):
                    if self.gap[gap] and (b := next(iter(self.gap[gap]))) is not None and self.fill[b] + self.sizes[i] > self.fill[a]:
                        self.apply(a, (i,), b, ())
                        changed = go = True
                        break
                if go:
                    break
            if go:
                continue
            loads = [(i,) for i in own] + [(i, j) for k, i in enumerate(own[:12]) for j in own[k + 1 : 12]]
            for out in loads:  # one for one, two for one
                load = sum(self.sizes[i] for i in out)
                if load <= self.capacity and (p := self.partner(load, a)):
                    self.apply(a, out, p[0], (p[1],))
                    changed = go = True
                    break
        self.enter(a)
        return changed


def pack(sizes: list[int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[list[int]]:
    """Bins as lists of positions in ``sizes``."""
    search = Search(sizes, best_fit_decreasing(sizes, capacity), capacity)
    for _ in range(rounds):
        open_bins = sorted((b for b, f in enumerate(search.fill) if 0 < f < capacity), key=lambda b: search.fill[b])
        if sum(capacity - search.fill[b] for b in open_bins) < capacity:
            break  # the gaps together do not make up a bin
        before = sum(1 for f in search.fill if f)
        changed = [search.empty(b) for b in open_bins if search.fill[b]]
        if not any(changed) or sum(1 for f in search.fill if f) == before:
            break
    return [b for b in search.bins if b]


# ---------------------------------------------------------------- all groups
def pack_documents(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, end: int = END, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Null and empty texts are one piece with the end id.  Rows that repeat a key are packed each on its own; a null key
    stays null.  An empty table gives an empty result.  Columns other than ``text`` and ``key`` are not read.
    """
    cut = keep(pieces(docs, vocabulary, text, key, capacity, end), "pieces")
    groups = max(1, -(-cut.count() // group))

    def of(pdf):
        bins = pack(pdf["length"].tolist(), capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(pdf))
        sizes = pdf["length"].to_numpy()[order]
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        ends = np.cumsum(sizes)
        first = np.concatenate(([0], np.cumsum([len(b) for b in bins])[:-1])).astype(int)
        begin = (ends - sizes)[first][number] if len(bins) else ends
        out = pdf.iloc[order].drop(columns="_group")
        return out.assign(sequence_id=pdf["_group"].to_numpy()[order] * (1 << 32) + number, offset=ends - sizes - begin)

    # The row number, as read from the written pieces, deals out equal rows as well.
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    out = dealt.groupBy("_group").applyInPandas(of, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out
