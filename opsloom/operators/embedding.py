"""Embedding of texts: hash vectors by default, a user model as a batched Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsloom import rules
from opsloom.functions import vectors as vx

ModelFactory = Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]]


def embed(
    df: DataFrame,
    text: str = "content",
    out: str = "embedding",
    dims: int = rules.EMBEDDING_DIMS,
    model_factory: ModelFactory | None = None,
    batch_size: int = 64,
) -> DataFrame:
    """Add a vector per row.

    ``model_factory`` is called once per Python worker and returns a function from
    texts to vectors.  A failing batch is retried text by text; a text that fails
    alone gets its hash vector, as does everything when no model is given.
    """
    hashed = vx.hash_embedding(text, dims)
    if model_factory is None:
        return df.withColumn(out, hashed)
    encode = _model_udf(model_factory, batch_size)
    return df.withColumn(out, F.coalesce(encode(F.coalesce(F.col(text), F.lit(""))), hashed.cast("array<float>")))


def try_embed(
    df: DataFrame, model_factory: ModelFactory, text: str = "content", out: str = "embedding", batch_size: int = 64
) -> DataFrame:
    """Like ``embed`` but a failed text keeps a null vector, to be counted by ``embedding_stats``."""
    return df.withColumn(out, _model_udf(model_factory, batch_size)(F.coalesce(F.col(text), F.lit(""))))


def _model_udf(model_factory: ModelFactory, batch_size: int):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()
        for series in batches:
            texts, vectors = list(series), []
            for at in range(0, len(texts), batch_size):
                vectors.extend(_encode(model, texts[at : at + batch_size]))
            yield pd.Series(vectors, dtype=object)

    return encode


def _encode(model, texts: list[str]) -> list[list[float] | None]:
    try:
        found = [_unit(v) for v in model(texts)]
        if len(found) == len(texts):
            return found
    except Exception:
        pass
    out: list[list[float] | None] = []
    for text in texts:
        try:
            out.append(_unit(model([text])[0]))
        except Exception:
            out.append(None)
    return out


def _unit(vector: Sequence[float]) -> list[float]:
    v = np.asarray(vector, dtype="float64")
    size = float(np.linalg.norm(v))
    return (v / size if size else v).astype("float32").tolist()


def embed_distinct(df: DataFrame, text: str = "content", out: str = "embedding", **options) -> DataFrame:
    """Embed each distinct text once and join the vectors back.

    The join key is the digest of the text, so neither the distinct nor the join
    moves texts more than once.  A text shared by a large part of the rows is a skewed
    join key; adaptive execution splits that side.
    """
    keyed = df.withColumn("_h", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    once = keyed.groupBy("_h").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    vectors = embed(once, "_t", out, **options).select("_h", out)
    return keyed.join(vectors, "_h", "left").drop("_h")


def embedding_stats(df: DataFrame, keys: Sequence[str] = ("source",), vector: str = "embedding") -> DataFrame:
    """Rows, embedded rows and failed rows per key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(vector).isNotNull()).alias("ingested"),
        F.count_if(F.col(vector).isNull()).alias("failed"),
    )
