"""Vectors as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = lambda: F.lit(0.0).cast("double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), ZERO(), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, ZERO(), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """-1 where b is a zero vector."""
    return F.when(norm(b) == 0, F.lit(-1.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def is_valid(v: Column, dimension: int) -> Column:
    """Of this length, and finite throughout."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dimension) & finite, F.lit(False))


def hashed_embedding(text: Column, dimension: int) -> Column:
    """A deterministic stand-in for a model: the text's SHA-256 bytes, cycled, in [-1, 1], scaled to length one."""
    digest = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(F.substr(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1)
    return F.transform(raw, lambda x: x / norm(raw))
