"""Least squares from sums that one pass gathers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minewright.functions.storage import materialize


def ols(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """slope, intercept, r2 and n of the line through (x, y), for each group or for all rows."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n"))


def gram_matrix(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """The normal equations, long: i, j, value. 0 is the column of ones, 1.. the xs, -1 as j the target."""
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    target = F.col(y).cast("double")
    complete = df.dropna(subset=[*xs, y])
    cells = [(i, j, columns[i] * columns[j]) for i in range(len(columns)) for j in range(i, len(columns))]
    cells += [(i, -1, c * target) for i, c in enumerate(columns)]
    sums = complete.agg(*[F.sum(v).alias(f"s{k}") for k, (_, _, v) in enumerate(cells)])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{k}").alias("value")) for k, (i, j, _) in enumerate(cells)]))
    return sums.select(rows.alias("c")).select("c.*")


def ols_multi(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """term, weight: least squares on several columns, by the pseudo-inverse of the Gram matrix.

    The driver sees (p + 1) * (p + 2) / 2 sums, however many rows there are.
    """
    p = len(xs) + 1
    a, b = np.zeros((p, p)), np.zeros(p)
    for row in gram_matrix(df, xs, y).collect():
        if row.j < 0:
            b[row.i] = row.value or 0.0
        else:
            a[row.i, row.j] = a[row.j, row.i] = row.value or 0.0
    weights = np.linalg.pinv(a, hermitian=True) @ b
    return df.sparkSession.createDataFrame([(t, float(w)) for t, w in zip(["(intercept)", *xs], weights, strict=True)], "term string, weight double")


def _stacked_r(parts: Iterator[np.ndarray], width: int) -> np.ndarray:
    """The triangular factor R of all rows of some matrices, one of which is held at a time."""
    r = np.zeros((0, width))
    for rows in parts:
        r = np.linalg.qr(np.concatenate([r, rows]), mode="r")
    return r


def triangular_factor(df: DataFrame, xs: Sequence[str], y: str, fan_in: int = 16) -> np.ndarray:
    """R of the QR decomposition of the rows (1, xs, y), for complete rows, by a tree: a factor per task, merged `fan_in` at a time.

    A factor has at most p + 2 rows, so what rounds shuffle shrinks to one small matrix whatever the number of rows.
    """
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in [*xs, y]]]
    width = len(columns)
    rows = df.dropna(subset=[*xs, y]).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])

    def factor(batches):
        parts = (np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows)
        r = _stacked_r(parts, width)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in r.T], names)

    names = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{c} double" for c in names)
    found = materialize(rows.mapInArrow(factor, schema), "factors")
    parts = -(-found.count() // width)
    while parts > 1:
        parts = -(-parts // fan_in)
        found = materialize(found.repartition(parts).mapInArrow(factor, schema), "factors")
    return _stacked_r(iter([np.array(found.collect(), np.float64).reshape(-1, width)]), width)  # p + 2 rows at most


def ols_qr(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """term, weight: least squares on several columns from the triangular factor, right where columns nearly depend on each other.

    The Gram matrix that ols_multi() uses squares the condition number and loses twice as many digits. Columns that
    depend on others exactly, and fewer rows than columns, get the solution of least norm.
    """
    r = triangular_factor(df, xs, y)
    p = len(xs) + 1
    weights = np.linalg.lstsq(r[:, :p], r[:, p], rcond=None)[0] if len(r) else np.zeros(p)
    return df.sparkSession.createDataFrame([(t, float(w)) for t, w in zip(["(intercept)", *xs], weights, strict=True)], "term string, weight double")


def predict_line(df: DataFrame, coefs: DataFrame, x: str, by: Sequence[str] = (), name: str = "predicted") -> DataFrame:
    """df plus intercept + slope * x; coefs as ols() gives them, one row or one per group."""
    lines = coefs.select(*by, F.col("slope").alias("_slope"), F.col("intercept").alias("_intercept"))
    joined = df.join(lines, list(by), "left") if by else df.crossJoin(F.broadcast(lines))
    return joined.withColumn(name, F.col("_intercept") + F.col("_slope") * F.col(x)).drop("_slope", "_intercept")


def line_grid(coefs: DataFrame, low: float, high: float, n: int = 2) -> DataFrame:
    """n evenly spaced points (x, y) of each fitted line from low to high."""
    step = (high - low) / max(1, n - 1)
    grid = coefs.sparkSession.range(n).select((F.lit(float(low)) + F.col("id") * step).alias("x"))
    return coefs.crossJoin(F.broadcast(grid)).select(*[c for c in coefs.columns if c not in ("slope", "intercept", "r2", "n")], "x", (F.col("intercept") + F.col("slope") * F.col("x")).alias("y"))
