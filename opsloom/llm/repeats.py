"""Repeated passages: remove words that an earlier document already has in a run of ``window`` words.

1. Anchors.  Every document is a reference whose non-overlapping blocks of ``window // 2`` words are indexed, and is
   probed with every rolling window of that length.  Any repeat of ``window`` words holds a whole block of each document
   that has it, so words without a hit need no further look.  Hashes travel to ranges of the hash space in packed
   arrays, and hits travel back as (document, places).
2. Extension.  Around each hit the whole windows of ``window`` words are taken (96 bits of hash), and for each the
   smallest document that has it is found.  Windows next to each other join to maximal repeats.

A task sends each hash once, however many of its documents have it: what a task can settle on its own (the
documents after its first one) it does not send.  So a passage in a third of all documents costs one entry per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm import words as wd
from opsloom.session import keep

WINDOW = 50
#: Stands for a null key in comparisons: never smaller than another.
NONE = np.iinfo(np.int64).max
PACKED = "part int, docs binary, texts binary, sizes binary, places binary, keys binary, more binary, flags binary"
HITS = "doc_id bigint, text_key bigint, places array<int>"


# ---------------------------------------------------------------- packed arrays
def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which Spark's shuffle compression shortens well."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _pack(part: int, width: int, doc: np.ndarray, text: np.ndarray | None, place: np.ndarray, key: np.ndarray, more: np.ndarray | None, flag: np.ndarray) -> dict:
    """Entries in document order: documents once each with their number of entries, places as steps, keys without the byte that ``part`` implies."""
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    if text is not None:
        first[1:] |= text[1:] != text[:-1]
    else:  # a text begins anew where its places do
        first[1:] |= place[1:] < place[:-1]
    at = np.flatnonzero(first)
    step = place.astype(np.int64)
    step[1:] -= np.where(first[1:], 0, place[:-1])
    return {
        "part": part, "docs": _planes(doc[at]), "texts": b"" if text is None else text[at].tobytes(), "sizes": _planes(np.diff(np.append(at, len(doc))).astype("<u4")),
        "places": _planes(step.astype("<u4")), "keys": key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), "more": b"" if more is None else more.tobytes(), "flags": np.packbits(flag).tobytes(),
    }


#: Bytes of a hash that travel: for blocks, which together with the part are only a filter, and for whole windows (with 32 bits more).
BLOCK_BYTES, WINDOW_BYTES = 4, 8


def _unpack(row: dict) -> tuple[np.ndarray, ...]:
    size = _from_planes(row["sizes"], "<u4").astype(np.int64)
    n = int(size.sum())
    doc, text = np.repeat(_from_planes(row["docs"], "<i8"), size), np.repeat(np.frombuffer(row["texts"], "<i8"), size) if row["texts"] else np.zeros(n, np.int64)
    step = _from_planes(row["places"], "<u4").astype(np.int64)
    run = np.cumsum(step)
    begin = np.cumsum(size) - size
    place = run - np.repeat(run[begin] - step[begin], size)
    key = np.zeros((n, 8), np.uint8)
    width = len(row["keys"]) // max(n, 1)
    key[:, :width] = np.frombuffer(row["keys"], np.uint8).reshape(width, n).T
    flag = np.unpackbits(np.frombuffer(row["flags"], np.uint8), count=2 * n).astype(bool)
    return doc, text, place, key.view("<u8").ravel(), np.frombuffer(row["more"], "<u4") if row["more"] else np.zeros(n, "<u4"), flag[:n], flag[n:]


def _hit_rows(doc: np.ndarray, text: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per document and text, of entries sorted by document, text and place (repeats of a place count once)."""
    if not len(doc):
        return
    new = np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))
    other = new | np.append(True, place[1:] != place[:-1])
    doc, text, place, new = doc[other], text[other], place[other], new[other]
    first = np.flatnonzero(new)
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array(place.astype(np.int32)))
    whole = pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(text[first]), places], schema=HIT_SCHEMA)
    for at in range(0, whole.num_rows, 2000):
        yield whole.slice(at, 2000)


HIT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("places", pa.list_(pa.int32()))])
PACKED_SCHEMA = pa.schema([("part", pa.int32())] + [(c, pa.binary()) for c in ("docs", "texts", "sizes", "places", "keys", "more", "flags")])


def _send(parts: int, width: int, doc, text, place, key, more, settled, flags) -> Iterator[pa.RecordBatch]:
    """Packed rows of the entries to compare, and of those already settled (part -1 - part: they only pass through)."""
    if not len(doc):
        return
    part = (key >> np.uint64(40)).astype(np.int64) % parts
    part = np.where(settled, -1 - part, part)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
    rows = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
        o = order[a:b]
        rows.append(_pack(int(part[o[0]]), width, doc[o], None if text is None else text[o], place[o], key[o], None if more is None else more[o], np.concatenate((flags[0][o], flags[1][o]))))
        if len(rows) == 512:
            yield pa.RecordBatch.from_pylist(rows, schema=PACKED_SCHEMA)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=PACKED_SCHEMA)


def _exchange(sent: DataFrame, judge, parts: int) -> DataFrame:
    """doc_id, text_key, places of the entries that ``judge`` marks, one row per document.

    The entries of each part are brought together, one part at a time being unpacked; what is marked goes back to its
    documents, packed by ranges of documents.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        out: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            for row in b.to_pylist():
                if row["part"] < 0:
                    out.append(_unpack(row)[:3])
                else:
                    held.setdefault(row["part"], []).append(row)
                if sum(len(x[0]) for x in out) >= FLUSH:
                    yield _returned(out, parts)
                    out = []
        while held:
            doc, text, place, *rest = (np.concatenate(x) for x in zip(*map(_unpack, held.popitem()[1]), strict=True))
            at = np.flatnonzero(judge(doc, *rest))
            out.append((doc[at], text[at], place[at]))
            if not held or sum(len(x[0]) for x in out) >= FLUSH:
                yield _returned(out, parts)
                out = []
        if out:
            yield _returned(out, parts)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for b in batches:
            for row in b.to_pylist():
                held.setdefault(row["range"], []).append(row)
        while held:
            rows = held.popitem()[1]
            doc, text = (np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]) for c in ("docs", "texts"))
            place = np.concatenate([_from_planes(r["places"], "<u4") for r in rows])
            order = np.lexsort((place, text, doc))
            yield from _hit_rows(doc[order], text[order], place[order])

    return sent.repartition(parts, "part").mapInArrow(of, RETURNED).repartition(parts, "range").mapInArrow(together, HITS)


#: Bytes of text per range of hashes, and so about 1.5 million entries for the task that compares them; and the fewest ranges.  With few ranges a
#: document's entries in one share their header.
PART_BYTES, LEAST_PARTS = 8 << 20, 32
#: Entries that a task gathers before it sends them back to their documents.
FLUSH = 2_000_000
RETURNED = "range int, docs binary, texts binary, places binary"


def _returned(found: list[tuple[np.ndarray, ...]], ranges: int) -> pa.RecordBatch:
    doc, text, place = (np.concatenate(x) for x in zip(*found, strict=True))
    with np.errstate(over="ignore"):
        own = ((doc.view(np.uint64) * wd.ODD) >> np.uint64(33)).astype(np.int64) % ranges
    order = np.lexsort((place, doc, own))
    own = own[order]
    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    rows = []
    for a, b in zip(cuts.tolist(), np.append(cuts, len(own))[1:].tolist(), strict=True):
        o = order[a:b]
        rows.append({"range": int(own[a]), "docs": doc[o].astype("<i8").tobytes(), "texts": text[o].astype("<i8").tobytes(), "places": _planes(place[o].astype("<u4"))})
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("range", pa.int32()), ("docs", pa.binary()), ("texts", pa.binary()), ("places", pa.binary())]))


# ---------------------------------------------------------------- the two questions
def _groups(key: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal keys together (stable), and the number of the key of each entry in that order."""
    order = np.argsort(key, kind="stable") if more is None else np.lexsort((more, key))
    k = key[order]
    new = k[1:] != k[:-1]
    if more is not None:
        new |= more[order][1:] != more[order][:-1]
    return order, np.concatenate(([0], np.cumsum(new))) if len(k) else np.zeros(0, np.int64)


def _least(x: np.ndarray, group: np.ndarray, fold=np.minimum) -> np.ndarray:
    return fold.reduceat(x, np.flatnonzero(np.append(True, np.diff(group) != 0)))[group]


def _shared_blocks(doc, key, more, many, aligned) -> np.ndarray:
    """Block hashes that start at a block of some document and that another document has."""
    if not len(doc):
        return np.zeros(0, bool)
    order, group = _groups(key)
    d, m, a = doc[order], many[order], aligned[order]
    hit = ((_least(d, group) < _least(d, group, np.maximum)) | _least(m, group, np.logical_or)) & _least(a, group, np.logical_or) & ~m
    out = np.zeros(len(doc), bool)
    out[order] = hit
    return out


def _later_windows(doc, key, more, *_) -> np.ndarray:
    """Windows that a smaller document has too."""
    if not len(doc):
        return np.zeros(0, bool)
    order, group = _groups(key, more)
    out = np.zeros(len(doc), bool)
    out[order] = doc[order] > _least(doc[order], group)
    return out


# ---------------------------------------------------------------- documents
def _ids(b: pa.RecordBatch) -> np.ndarray:
    return pc.fill_null(b["_key"], int(NONE)).to_numpy(zero_copy_only=False)


def _text_keys(b: pa.RecordBatch) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in pc.fill_null(b["_text"], "").cast(pa.binary()).to_pylist()), np.uint64, b.num_rows).view(np.int64)


def anchors(docs: DataFrame, window: int, parts: int) -> DataFrame:
    block = window // 2

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wd.chunks(batches, "_text"):
            words, counts = wd.split_words(b["_text"])
            at = np.flatnonzero(wd.starts(counts, block))
            if not len(at):
                continue
            row = np.repeat(np.arange(len(counts)), counts)[at]
            place = at - (np.cumsum(counts) - counts)[row]
            key, doc = wd.rolling(wd.hashes(words), block)[at], _ids(b)[row]
            order, group = _groups(key)
            d = doc[order]
            many = _least(d, group) < _least(d, group, np.maximum)
            aligned = _least((place % block == 0)[order], group, np.logical_or)
            # One entry stands for a hash that several documents of this chunk have; all its places are hits already.
            lead = ~many | np.append(True, np.diff(group) != 0)
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            many, aligned, lead = many[back], aligned[back], lead[back]
            for chosen, settled in ((many, True), (lead, False)):
                o = np.flatnonzero(chosen)
                yield from _send(parts, BLOCK_BYTES, doc[o], None, place[o], key[o], None, np.full(len(o), settled), (many[o], aligned[o]))

    return docs.mapInArrow(of, PACKED)


def extensions(found: DataFrame, window: int, parts: int) -> DataFrame:
    block = window // 2

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wd.chunks(batches, "_text"):
            words, counts = wd.split_words(b["_text"])
            base = np.cumsum(counts) - counts
            lists = b["places"]
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            q = lists.flatten().to_numpy().astype(np.int64)
            ok = q < counts[row]
            row, q = row[ok], q[ok]
            # A whole window around a hit at q starts between q - (window - block) and q.
            mark = np.zeros(len(words) + 1, np.int64)
            np.add.at(mark, base[row] + np.maximum(0, q - (window - block)), 1)
            np.add.at(mark, base[row] + q + 1, -1)
            at = np.flatnonzero((np.cumsum(mark)[: max(0, len(words) - window + 1)] > 0) & wd.starts(counts, window)) if len(words) >= window else np.zeros(0, np.int64)
            if not len(at):
                continue
            row = np.repeat(np.arange(len(counts)), counts)[at]
            h = wd.hashes(words)
            key, more = wd.rolling(h, window)[at], (wd.rolling(h, window, 0x1F123BB5)[at] >> np.uint64(32)).astype("<u4")
            doc, text, place = _ids(b)[row], _text_keys(b)[row], at - base[row]
            order, group = _groups(key, more)
            later = np.zeros(len(at), bool)
            later[order] = doc[order] > _least(doc[order], group)
            none = np.zeros(len(at), bool)
            yield from _send(parts, WINDOW_BYTES, doc, text, place, key, more, later, (none, none))

    return found.mapInArrow(of, PACKED)


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space), kept_sha256, spans (maximal removed runs as word places, end exclusive).

    Without ``texts``, ``kept`` is null and texts without a hit are not exchanged.

    A null text has no words.  A null key is larger than any other.  Rows that repeat a key are one document as far as
    "an earlier document" goes: they never remove each other's words, and each gives a row.  An empty table gives an
    empty result.  Columns other than ``text`` and ``key`` are not read.
    """
    one = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    size = one.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    by_doc = _exchange(anchors(one, window, parts), _shared_blocks, parts)
    marked = one.join(by_doc, F.coalesce("_key", F.lit(int(NONE))) == F.col("doc_id"))
    found = keep(marked.select("_key", "_text", "places"), "repeat-candidates")
    later = _exchange(extensions(found, window, parts), _later_windows, parts)
    spec = "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string, spans array<struct<start:int,end:int>>"
    whole = one.withColumn("places", F.lit(None).cast("array<int>")).mapInArrow(_cut(window, texts), spec)
    clean = whole.join(found.select(F.col("_key").alias("_other")).distinct(), F.col("doc_id").eqNullSafe(F.col("_other")), "left_anti")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["_key"], b["_text"], pa.array(_ids(b)), pa.array(_text_keys(b))], ["_key", "_text", "doc_id", "text_key"])

    changed = found.select("_key", "_text").mapInArrow(keyed, "_key bigint, _text string, doc_id bigint, text_key bigint").join(later, ["doc_id", "text_key"], "left").select("_key", "_text", "places")
    return clean.unionByName(changed.mapInArrow(_cut(window, texts), spec))


def _cut(window: int, texts: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wd.chunks(batches, "_text"):
            words, counts = wd.split_words(b["_text"])
            base = np.cumsum(counts) - counts
            lists = b["places"]
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            q = lists.flatten().to_numpy().astype(np.int64)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, base[row] + q, 1)
            np.add.at(edge, base[row] + q + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            keep_ = ~gone
            left = np.concatenate(([0], np.cumsum(keep_)))
            ends = left[np.concatenate((base, [len(words)])).astype(np.int64)] if len(base) else left
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.filter(pa.array(keep_))), " ")
            spans = [[] for _ in range(b.num_rows)]
            for r in np.unique(row).tolist():
                g = np.diff(np.concatenate(([False], gone[base[r] : base[r] + counts[r]], [False])).astype(np.int8))
                spans[r] = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(g == 1).tolist(), np.flatnonzero(g == -1).tolist(), strict=True)]
            sha = [hashlib.sha256(k).hexdigest() for k in kept.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b["_key"], pa.array(counts), pa.array(counts - np.diff(ends)), kept if texts else pa.nulls(b.num_rows, pa.string()), pa.array(sha), pa.array(spans, schema.field("spans").type)], schema=schema)

    return of
