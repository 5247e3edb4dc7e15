"""Vector expressions on array<double> columns; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column, least: float = 1e-12) -> Column:
    """Divided by its length, which counts as ``least`` at least, so that a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(v, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(normalized(a), normalized(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def pad_or_cut(v: Column, length: int, fill: float = 0.0) -> Column:
    """Exactly ``length`` entries: cut on the right or filled there."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(fill), length)), 1, length)


def mask_of(v: Column, length: int) -> Column:
    """1 for each entry that ``pad_or_cut`` kept, 0 for each it filled in."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(i <= F.size(v), 1).otherwise(0))


def peak_normalized(v: Column, least: float = 1e-8) -> Column:
    """Divided by its greatest magnitude if that exceeds ``least``."""
    peak = F.array_max(F.transform(v, F.abs))
    return F.when(peak > least, F.transform(v, lambda x: x / peak)).otherwise(v)


def weighted_mean(frames: Column, weights: Column) -> Column:
    """The weighted sum of array<array<double>> frames, dimension by dimension."""
    first = F.transform(frames[0], lambda _: F.lit(0.0))
    scaled = F.zip_with(frames, weights, lambda f, w: F.transform(f, lambda x: x * w))
    return F.aggregate(scaled, first, lambda s, f: F.zip_with(s, f, lambda x, y: x + y))


def linear(weights: list[list[float]], v: Column) -> list[Column]:
    """Products of literal rows with a vector."""
    return [dot(F.array(*[F.lit(float(x)) for x in row]), v) for row in weights]
