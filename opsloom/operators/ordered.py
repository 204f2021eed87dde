"""Ordered per-key computations that no single task has to do for a whole key.

A plain window ``PARTITION BY machine ORDER BY ts`` sends all rows of one machine
to one task.  Where one machine may hold a third of all rows, the key's sequence
is cut into bounded pieces instead:

* ``with_position`` numbers the rows of a key exactly, from counts per
  (key, bucket) that are aggregated map-side first;
* ``with_lookback`` makes blocks of consecutive rows and lends each block the last
  rows of the block before, for rules that look back a fixed number of rows;
* ``running_last`` carries the latest non-null value over any distance by a scan
  in two levels: inside the block, and over one row per block;
* ``blocked_scan`` does the same for folds whose state is a small function.

Keys, order columns and the bucket must not be null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 100_000
BUCKET_SECONDS = 86_400


def seconds_bucket(seconds: Column | str, width: int = BUCKET_SECONDS) -> Column:
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.floor(seconds / width).cast("long")


def with_position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str = "pos", total: str | None = None
) -> DataFrame:
    """Add the exact 0-based position of each row within its key, and the key's row count as ``total``.

    ``bucket`` must rise with the order (a time bucket, or a block of turns) and be
    fine enough that one bucket of one key fits a task.  The join carries the bucket
    in its key, so rows of a large key stay spread for whatever follows.
    """
    keys = list(keys)
    tagged = df.withColumn("_bkt", bucket)
    counts = tagged.groupBy(*keys, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offsets = counts.select(*keys, "_bkt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), *whole)
    inside = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    return (
        tagged.join(offsets, [*keys, "_bkt"])
        .withColumn(out, (F.col("_off") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_bkt", "_off")
    )


def with_lookback(df: DataFrame, rows: int, pos: str = "pos", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``_blk`` and ``_lent``; the last ``rows`` rows of a block also appear, lent, in the next one.

    Windows over (keys, _blk) then see the full look-back; drop the lent rows with
    ``own_rows`` at the end.
    """
    if rows > block_rows:
        raise ValueError("look-back longer than a block")
    blk = F.floor(F.col(pos) / block_rows).cast("long")
    near_end = (F.col(pos) % block_rows) >= block_rows - rows
    copies = F.when(near_end, F.array(blk, blk + 1)).otherwise(F.array(blk))
    return df.withColumn("_blk", F.explode(copies)).withColumn("_lent", F.col("_blk") != blk)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_lent")).drop("_blk", "_lent")


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    out: str,
    pos: str = "pos",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Latest non-null ``value`` at or before each row of its key."""
    keys = list(keys)
    tagged = df.withColumn("_val", value).withColumn("_blk", F.floor(F.col(pos) / block_rows).cast("long"))
    # Blocks without a value give null here and inherit from the blocks before.
    ends = tagged.groupBy(*keys, "_blk").agg(F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col(pos))).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_blk", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.join(carry, [*keys, "_blk"])
        .withColumn(out, F.coalesce(F.last("_val", ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_val", "_blk", "_carry")
    )


def runs(batches: Iterable[pd.DataFrame], cols: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of each run of rows with equal ``cols``, across Arrow batch borders.

    The input must be sorted by ``cols``; only the run at hand is held.
    """
    held: pd.DataFrame | None = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        data = {c: pdf[c].to_numpy() for c in pdf.columns}
        change = np.zeros(len(pdf), dtype=bool)
        for c in cols:
            change[1:] |= data[c][1:] != data[c][:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts[:-1], starts[1:]):
            yield {c: x[a:b] for c, x in data.items()}
        held = pdf.iloc[starts[-1] :]
    if held is not None and len(held):
        yield {c: held[c].to_numpy() for c in held.columns}


def blocked_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    start: Any,
    transfer: Callable[[dict[str, np.ndarray]], Any],
    carry: Callable[[Any, Any], Any],
    flag: Callable[[dict[str, np.ndarray], Any], np.ndarray],
    out: str,
) -> DataFrame:
    """Sequential fold over each key, run in parallel over its buckets; adds a boolean column.

    ``transfer`` turns one bucket (columns as arrays, in order) into a small description
    of its effect on the state, ``carry`` applies a description to a state, and ``flag``
    runs the rule over one bucket once its entry state is known.  States and
    descriptions must survive JSON.  The middle step sees one row per bucket of a key.
    Every task streams sorted rows and holds one bucket of one key at a time.
    """
    keys, order, columns = list(keys), list(order), list(df.columns)
    place = [*keys, "_bkt"]
    tagged = df.withColumn("_bkt", bucket)
    key_fields = [T.StructField(k, tagged.schema[k].dataType) for k in keys]
    small = [*key_fields, T.StructField("_bkt", T.LongType())]
    fx_schema = T.StructType([*small, T.StructField("_fx", T.StringType())])
    in_schema = T.StructType([*small, T.StructField("_in", T.StringType())])
    out_schema = T.StructType([*df.schema.fields, T.StructField(out, T.BooleanType())])

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _chunks(([*(g[c][0] for c in place), json.dumps(transfer(g))] for g in runs(batches, place)), 5_000):
            yield pd.DataFrame(part, columns=fx_schema.names)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, start
        for pdf in batches:
            entry = []
            for key, effect in zip(zip(*[pdf[k] for k in keys]), pdf["_fx"]):
                if key != current:
                    current, state = key, start
                entry.append(json.dumps(state))
                state = carry(state, json.loads(effect))
            yield pdf[place].assign(_in=entry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def groups() -> Iterator[pd.DataFrame]:
            for g in runs(batches, place):
                # The entry state sorts first in its bucket.
                body = {c: g[c][1:] for c in columns}
                yield {**body, out: flag(body, json.loads(g["_in"][0]))}

        for part in _chunks(groups(), 2_000):
            yield pd.DataFrame({c: np.concatenate([np.asarray(g[c]) for g in part]) for c in out_schema.names})

    effects = tagged.repartition(*place).sortWithinPartitions(*place, *order).mapInPandas(describe, fx_schema)
    states = effects.repartition(*keys).sortWithinPartitions(*place).mapInPandas(chain, in_schema)
    rows = tagged.withColumns({"_in": F.lit(None).cast("string"), "_row": F.lit(1)})
    entry = states.withColumn("_row", F.lit(0))
    both = rows.unionByName(entry, allowMissingColumns=True)
    return both.repartition(*place).sortWithinPartitions(*place, "_row", *order).mapInPandas(run, out_schema)


def _chunks(items: Iterable[Any], size: int) -> Iterator[list[Any]]:
    part: list[Any] = []
    for item in items:
        part.append(item)
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part
