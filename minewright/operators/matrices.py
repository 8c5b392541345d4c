"""Vectors as matrices in tasks, and the nearest rows among them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rows(pairs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q_id").orderBy(F.round("dist", 9), "b_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of vectors of one length as a matrix; vectors of several lengths are an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size.min() != size.max() or not size[0]):
        raise ValueError(f"vectors of {size.min()} to {size.max()} numbers")
    return values.reshape(len(size), -1)


def closest(ids: pa.Array, q: np.ndarray, b_ids: pa.Array, b: np.ndarray, k: int, self_join: bool = False) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(q id, b id, distance, row of b) of at least the k nearest rows of b to each query.

    A matrix product finds all rows that its rounding error may put among the k nearest; their
    distances are then taken from the differences themselves.
    """
    squares = (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :]
    d = squares - 2 * (q @ b.T)
    wanted = min(k + self_join, len(b)) - 1
    border = np.partition(d, wanted, axis=1)[:, wanted]
    i, j = np.nonzero(d <= border[:, None] + 1e-9 * (1 + squares.max(1, keepdims=True)))
    return chosen(ids, q, b_ids, b, i, j, self_join)


def chosen(ids: pa.Array, q: np.ndarray, b_ids: pa.Array, b: np.ndarray, i: np.ndarray, j: np.ndarray, self_join: bool = False) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(q id, b id, distance, row of b) of the pairs of rows i of q and j of b."""
    exact = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        some = slice(at, at + (1 << 16))
        exact[some] = np.sqrt(((q[i[some]] - b[j[some]]) ** 2).sum(1))
    found = ids.take(pa.array(i)), b_ids.take(pa.array(j)), pa.array(exact), pa.array(j)
    if self_join:
        other = pc.not_equal(found[0], found[1])
        found = tuple(x.filter(other) for x in found)
    return found


def kept_nearest(rows: pa.Table, k: int) -> pa.Table:
    """The k nearest per query of these rows, ties to nine decimals by b_id."""
    rows = rows.append_column("_near", pa.array(np.round(rows["dist"].to_numpy(), 9)))
    rows = rows.take(pc.sort_indices(rows, [("q_id", "ascending"), ("_near", "ascending"), ("b_id", "ascending")]))
    code = rows["q_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    rank = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    return rows.filter(pa.array(rank < k)).drop_columns(["_near"])
