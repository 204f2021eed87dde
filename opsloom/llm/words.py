"""Words of Arrow text columns: splitting, hashing and rolling windows, all vectorised over a bounded chunk of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows again in runs of about ``most`` bytes of text, at least one row each; empty batches give nothing.

    Small batches are joined, so that the per-chunk work is shared; one very long text is a chunk of its own.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < batch.num_rows:
            before = lengths[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(lengths, before + most - size, side="right")))
            held.append(batch.slice(at, end - at))
            size += int(lengths[end - 1] - before)
            at = end
            if size >= most or at < batch.num_rows:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words between the blanks 0x20 and 0x09-0x0D, end to end, and the number of words of each row.  A null text has none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    flat = parts.flatten()
    if not len(parts):
        return flat, np.zeros(0, np.int64)
    ends = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not real.all():  # blanks at the edges leave empty strings
        ends = np.concatenate(([0], np.cumsum(real)))[ends]
        flat = flat.filter(pa.array(real))
    return flat, np.diff(ends)


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; each different word is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return own[coded.indices.to_numpy()]


def rolling(h: np.ndarray, n: int, base: int = 0x100000001B3) -> np.ndarray:
    """Karp-Rabin value of the n words from each place on, modulo 2^64, then mixed; shorter by n - 1."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    b = np.uint64(base)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * b + h[k : k + m]
        out ^= out >> np.uint64(31)
        out *= ODD
        out ^= out >> np.uint64(29)
    return out


def starts(counts: np.ndarray, n: int) -> np.ndarray:
    """Over all words end to end: may a window of n words start here without leaving its row?"""
    total = int(counts.sum())
    ok = np.ones(total, bool)
    ends = np.cumsum(counts)
    for k in range(1, n):
        back = ends - k
        ok[back[(counts >= k)]] = False
    return ok[: max(0, total - n + 1)]
