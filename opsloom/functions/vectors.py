"""Vector column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsloom import rules
from opsloom.functions.text import col, let, text_or_empty


def hash_embedding(c: Column | str, dims: int = rules.EMBEDDING_DIMS) -> Column:
    """Deterministic vector: the 32 SHA-256 bytes scaled to [-1, 1], cycled to ``dims``."""
    digest = F.sha2(text_or_empty(c), 256)
    values = let(
        digest,
        lambda h: F.transform(
            F.sequence(F.lit(0), F.lit(31)),
            lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2 - 1,
        ),
    )
    if dims <= 32:
        return F.slice(values, 1, dims)
    return F.slice(F.flatten(F.array_repeat(values, -(-dims // 32))), 1, dims)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_safe(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0.0 for empty, unequal or zero-length vectors."""
    a, b = col(a), col(b)
    size = norm(a) * norm(b)
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0)
    return F.when(ok, dot(a, b) / size).otherwise(0.0)


def similarity(distance: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.coalesce(col(distance), F.lit(0.0))))
