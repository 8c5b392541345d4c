"""Seeded masks and exact splits by keyed hashing: the same rows whatever the partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.functions.expressions import keyed_hash

SPACE = 1 << 32
BINS = 1 << 16


def bernoulli_mask(df: DataFrame, key: str, rate: float = 0.1, seed: int = 42, name: str = "mask") -> DataFrame:
    """df plus a boolean that is true for about `rate` of the keys."""
    return df.withColumn(name, keyed_hash(F.col(key), seed) < int(rate * SPACE))


def hide_labels(df: DataFrame, label: str, mask: str = "mask", name: str = "seed_label") -> DataFrame:
    """df plus the label where the mask is true, else null."""
    return df.withColumn(name, F.when(F.col(mask), F.col(label)))


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest keys; each task hands on n rows at most."""
    return df.orderBy(key).limit(n)


def train_test(df: DataFrame, key: str, test_size: float | int, seed: int = 42, name: str = "is_test") -> DataFrame:
    """df plus a boolean, true for exactly ceil(test_size * rows) rows (a fraction) or test_size rows (a whole number).

    Test rows are those with the smallest (hash, key); keys must be unique. The border is found from a
    histogram of hashes and the few rows of one of its bins, so the split itself is a filter by a constant.
    """
    h = keyed_hash(F.col(key), seed)
    bins = df.groupBy(F.floor(h / (SPACE // BINS)).alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # at most BINS rows
    rows = sum(x.n for x in bins)
    wanted = math.ceil(round(test_size * rows, 9)) if isinstance(test_size, float) else test_size
    if not 0 <= wanted <= rows:
        raise ValueError(f"{wanted} test rows of {rows}")
    if not wanted:
        return df.withColumn(name, F.lit(False))
    for x in bins:
        if x.n >= wanted:
            break
        wanted -= x.n
    inside = df.select(h.alias("h"), F.col(key).alias("k")).filter(F.floor(F.col("h") / (SPACE // BINS)) == x.b)
    last = inside.orderBy("h", "k").limit(wanted).orderBy(F.desc("h"), F.desc("k")).first()
    return df.withColumn(name, (h < last.h) | ((h == last.h) & (F.col(key) <= F.lit(last.k))))
