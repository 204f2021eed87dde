"""Toxicity scores from a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

1. Counts: for each hashed n-gram the number of toxic and of other labelled training documents that hold it, over at most
   COUNT_ROWS training rows (those with the smallest hashes of their keys), added up as arrays of fixed size.
2. Ratios r = log((p + a) / |p| : (q + a) / |q|); the n-grams with the largest |r| weighted by their spread stay as features.
3. Logistic regression on presence x r, fitted on at most FIT_ROWS training rows, with equal weight for both classes'
   share as found in the data, so that scores are probabilities.
4. Scores for every document, whole text, by looking up n-grams in the table of kept features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm import words as wd
from opsloom.session import keep

SIZES = (4, 5, 6)
BITS = 20
FEATURES = 4096
#: Most labelled rows that counts and ratios, and the regression, are fitted on: those with the smallest hashes of their keys.  Both bound what
#: is broadcast (a key and a label each), so labels go to the texts and no text is exchanged.
COUNT_ROWS, FIT_ROWS = 200_000, 20_000
#: Chosen among 1, 0.3, 0.1 and 0.03 by training rows alone (learnt on remainders 0 and 3, judged on 1).
SMOOTHING = 0.3
PENALTY = 1e-5
#: Bytes of text whose n-grams are held at a time.
CHUNK = 1 << 20
THRESHOLD = 0.3


def grams(text: pa.Array, sizes=SIZES, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the n-grams of each row's lower-case characters, blanks as one, with one blank at both ends (repeats included)."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(text, "")), r"\s+", " ")
    clean = pc.binary_join_element_wise(pa.scalar(" "), clean, pa.scalar(" "), "").to_pylist()
    chars = np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    counts = np.fromiter(map(len, clean), np.int64, len(clean))
    chars = (chars + np.uint64(1)) * wd.ODD
    row = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    rows, buckets = [], []
    for n in sizes:
        h = wd.rolling(chars, n)
        at = wd.starts(counts, n)
        rows.append(row[: len(h)][at])
        buckets.append((h[at] >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(rows), np.concatenate(buckets)


def _distinct(row: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((row.astype(np.int64) << bits) | bucket)
    return (both >> bits).astype(np.int64), both & ((1 << bits) - 1)


@dataclass
class Model:
    table: np.ndarray  # bucket to feature, or -1
    weight: np.ndarray  # ratio x regression weight by feature
    bias: float
    sizes: tuple = SIZES
    bits: int = BITS

    def scores(self, text: pa.Array) -> np.ndarray:
        row, bucket = grams(text, self.sizes, self.bits)
        feature = self.table[bucket]
        has = feature >= 0
        r, f = _distinct(row[has], feature[has], self.bits)
        z = np.bincount(r, weights=self.weight[f], minlength=len(text)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _counts(rows: DataFrame, sizes, bits: int) -> np.ndarray:
    """Documents per bucket, toxic and other, as a (buckets, 2) array whatever the number of documents.

    A task sends its counts as compressed arrays, one for each of 256 ranges of buckets; they are added in two steps, so that
    no group holds the arrays of more than 256 tasks, or of the sums of 256 tasks each.
    """
    width = max(1, (1 << bits) // 256)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, n = np.zeros((1 << bits, 2), np.int64), 0
        for b in wd.chunks(batches, "_text", CHUNK):
            r, g = _distinct(*grams(b["_text"], sizes, bits), bits)
            y = b["_toxic"].to_numpy(zero_copy_only=False)[r]
            for k in (0, 1):
                total[:, k] += np.bincount(g[y == k], minlength=1 << bits)
            n += b.num_rows
        if n:
            parts = range(0, 1 << bits, width)
            packed = [zlib.compress(total[at : at + width].astype("<i8").tobytes(), 1) for at in parts]
            own = [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), TaskContext.get().partitionId() // 256, np.int32)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(own, ["part", "salt", "counts"])

    def added(pdf):
        import pandas as pd

        total = sum(np.frombuffer(zlib.decompress(x), "<i8") for x in pdf["counts"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    sent = rows.mapInArrow(of, "part int, salt int, counts binary")
    spec = "part int, counts binary"
    got = sent.groupBy("part", "salt").applyInPandas(added, spec).groupBy("part").applyInPandas(added, spec).collect()
    out = np.zeros((1 << bits, 2))
    for row in got:
        out[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(zlib.decompress(row["counts"]), "<i8").reshape(-1, 2)
    return out


def _features(rows: DataFrame, table: np.ndarray, sizes, bits: int, most: int) -> tuple[list[np.ndarray], np.ndarray]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wd.chunks(batches, "_text", CHUNK):
            row, bucket = grams(b["_text"], sizes, bits)
            f = table[bucket]
            r, f = _distinct(row[f >= 0], f[f >= 0], bits)
            cuts = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=b.num_rows))))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(f.astype(np.int16))), b["_toxic"]], ["f", "y"])

    got = rows.mapInArrow(of, "f array<smallint>, y int").limit(most).toArrow()
    lists = got["f"].combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    flat = lists.flatten().to_numpy().astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    return [size, flat], got["y"].to_numpy().astype(float)


def _sample(known: DataFrame, rows: int, most: int) -> DataFrame:
    """About 0.95 x ``most`` of the ``rows`` labels, those with the smallest hashes of their keys; all if there are no more."""
    if rows > most:
        known = known.filter(F.xxhash64("_label_key") < F.lit(int(0.95 * most / rows * 2**64) - 2**63))
    return F.broadcast(known)


def _regression(size: np.ndarray, flat: np.ndarray, ratio: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps with a diagonal scale; sparse rows given by ``size`` and ``flat``."""
    n, row, x = max(1, len(y)), np.repeat(np.arange(len(y)), size), ratio[flat]
    rate = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
    w, bias = np.zeros(len(ratio)), float(np.log(rate / (1 - rate)))
    scale = 1 / (np.sqrt(np.bincount(flat, weights=x * x, minlength=len(ratio)) / n) * 2 + 0.05)
    v, vb, lead, leadb = w.copy(), bias, w.copy(), bias
    step = 2.0 / max(1.0, float(np.max(np.bincount(row, weights=np.abs(x * x) * scale[flat], minlength=1), initial=1.0)))
    for k in range(steps):
        z = np.bincount(row, weights=x * lead[flat], minlength=len(y)) + leadb
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(flat, weights=x * e[row], minlength=len(ratio)) / n + penalty * lead
        new, newb = lead - step * 4 * scale * g, leadb - 0.5 * float(e.sum()) / n
        lead, leadb = new + k / (k + 3) * (new - v), newb + k / (k + 3) * (newb - vb)
        v, vb = new, newb
    return v, vb


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", sizes=SIZES, bits: int = BITS, features: int = FEATURES, count_rows: int = COUNT_ROWS, fit_rows: int = FIT_ROWS, smoothing: float = SMOOTHING, penalty: float = PENALTY) -> Model:
    """A model from the documents that have a label of 0 or 1; others are left out.  ``key`` only joins them.  Without any, every score is 0.5.

    A key with several labels takes the larger one.  Labels go to the texts: at most ``count_rows`` and ``fit_rows`` of them, whatever the
    size of the tables.  Only keys and labels are exchanged, to leave out labels without a document.
    """
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_label_key")).agg(F.max(F.col(label).cast("int")).alias("_toxic"))
    bodies = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    known = keep(known.join(bodies.select(F.col("_doc").alias("_label_key")).distinct(), "_label_key", "left_semi"), "toxicity-labels")
    rows = known.count()
    met = F.col("_doc") == F.col("_label_key")
    counts = _counts(bodies.join(_sample(known, rows, count_rows), met).select("_text", "_toxic"), sizes, bits)
    p, q = counts[:, 0] + smoothing, counts[:, 1] + smoothing
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    # n-grams by how far they shift the odds, weighted by how often they can
    worth = np.where(counts.sum(1) >= 2, np.abs(ratio) * np.sqrt(counts.sum(1)), 0)
    best = np.sort(np.argsort(-worth, kind="stable")[:features])
    best = best[worth[best] > 0]
    table = np.full(1 << bits, -1, np.int32)
    table[best] = np.arange(len(best))
    (size, flat), y = _features(bodies.join(_sample(known, rows, fit_rows), met).select("_text", "_toxic"), table, sizes, bits, fit_rows)
    weight, bias = _regression(size, flat, ratio[best], y, penalty) if len(best) else (np.zeros(0), 0.0 if not len(y) else float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))))
    return Model(table, weight * ratio[best], bias, sizes, bits)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row, whole texts.  Null and empty texts get the score of a text without known n-grams.

    Rows that repeat a key get a row each; null keys stay null; an empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets and features

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in wd.chunks(batches, "_text", CHUNK):
            s = shared.value.scores(b["_text"])
            yield pa.RecordBatch.from_arrays([b["_key"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["_key", "score", "predicted"])

    one = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return one.mapInArrow(of, f"_key {kind}, score double, predicted int").withColumnRenamed("_key", key)


def held_out(key: str = "doc_id"):
    """Rows never learnt from: CRC-32 of the key as text leaves 2 when divided by 4 (a null key is one of the others)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: trained on the labelled rows that are not held out, then every row scored."""
    model = train(docs, labels.filter(~held_out(key)), text, label, key)
    return score(docs, model, text, key, threshold).select(key, held_out(key).alias("held_out"), "score", "predicted")
