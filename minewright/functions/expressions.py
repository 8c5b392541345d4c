"""Column expressions that the operators share; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(key: Column, seed: int) -> Column:
    """A hash of seed and key, uniform in 0 .. 2^32 - 1 and the same in any engine with md5."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def leading(vector: Column, n: int) -> Column:
    """The first n numbers of a vector."""
    return F.slice(doubles(vector), 1, n)


def squared_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def rbf(squared: Column, gamma: float) -> Column:
    return F.exp(-gamma * squared)


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where den is 0 or null."""
    return num / F.when(den != 0, den)
